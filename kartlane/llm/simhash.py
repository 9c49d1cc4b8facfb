"""Operator 10, document fingerprints: SimHash in DataFrame functions only.

Terms are neighbouring word pairs (split at white space; a one-word text has
the word itself). Each term's 64-bit hash is stretched to 128 signed votes
weighted 1 to 3 by the term's length (longer terms are rarer). Votes are summed
in 64 packed longs of two 32-bit counters, so one aggregation row per document
leaves each task. A fingerprint is 32 hexadecimal digits.

Defined results: null texts count as empty; all empty texts share one
fingerprint. Rows are ordered by descending id (null ids last), ties by text;
after the last row comes the first again, so a lone row is its own neighbour.
Repeated rows stay separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 0x0000000100000001
HALF = 0xFFFFFFFF


def terms(text: Column) -> Column:
    """Longs that hold a word pair's hash and, in the two lowest bits, its weight."""
    words = F.split(text, "\\s+")
    pair = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))),
        F.when(F.size(words) > 1, F.slice(words, 2, F.size(words))).otherwise(F.array(F.lit(""))),
        lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(~3)).bitwiseOR(
            F.least(F.lit(3), 1 + F.floor((F.octet_length(a) + F.octet_length(b)) / 8)).cast("long")))
    return pair


def _votes() -> list[Column]:
    w = F.col("t").bitwiseAND(F.lit(3))
    out = [F.sum(w).alias("w")]
    for name in ("h1", "h2"):
        out += [F.sum(w * F.shiftrightunsigned(F.col(name), k).bitwiseAND(F.lit(LANES))).alias(f"{name}_{k}")
                for k in range(32)]
    return out


def _hex() -> Column:
    parts = []
    for name in ("h1", "h2"):
        bits = None
        for k in range(32):
            low = F.col(f"{name}_{k}").bitwiseAND(F.lit(HALF))
            high = F.shiftrightunsigned(F.col(f"{name}_{k}"), 32)
            for lane, at in ((low, k), (high, k + 32)):
                one = 1 << at if at < 63 else -(1 << 63)
                bit = F.when(2 * lane > F.col("w"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long"))
                bits = bit if bits is None else bits.bitwiseOR(bit)
        parts.append(F.lpad(F.hex(bits), 16, "0"))
    return F.lower(F.concat(*parts))


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint``: one row per distinct value of ``keys``."""
    rows = texts.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    rows = rows.select(*keys, "t", F.xxhash64("t").alias("h1"), F.xxhash64("t", F.lit(1)).alias("h2"))
    return rows.groupBy(*keys).agg(*_votes()).select(*keys, _hex().alias("fingerprint"))


def _words(fp: Column) -> list[Column]:
    """The four 32-bit words of a fingerprint, as longs."""
    return [F.conv(F.substring(fp, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_words(a), _words(b))), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return (F.lit(1.0) - distance(a, b) / F.lit(128.0)).cast("double")


def near_pairs(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``(a, b, distance)`` of different fingerprints within ``radius`` bits, ``a < b``; all of them.

    Distinct fingerprints only, so copies cost nothing. The 128 bits are cut
    into ``radius + 1`` blocks of whole hex digits: two fingerprints within the
    radius agree in one block at least. One permuted table per block, keyed by
    the block's value; a pair is reported by its first agreeing block.
    """
    n = radius + 1
    cuts = [32 * i // n for i in range(n + 1)]
    block = [F.substring(F.col("fingerprint"), cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(n)]
    one = prints.select("fingerprint").where("fingerprint is not null").distinct()
    table = one.select("fingerprint", F.posexplode(F.array(*block)).alias("i", "block"))
    x, y = table.alias("x"), table.alias("y")
    near = (x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.block") == F.col("y.block"))
                   & (F.col("x.fingerprint") < F.col("y.fingerprint")))
            .select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"), F.col("x.i").alias("i")))
    first = F.lit(n)
    for i in reversed(range(n)):
        same = (F.substring(F.col("a"), cuts[i] + 1, cuts[i + 1] - cuts[i])
                == F.substring(F.col("b"), cuts[i] + 1, cuts[i + 1] - cuts[i]))
        first = F.when(same, F.lit(i)).otherwise(first)
    return (near.where(F.col("i") == first).withColumn("distance", distance(F.col("a"), F.col("b")))
            .where(F.col("distance") <= radius).select("a", "b", "distance"))


def with_edits(docs: DataFrame, rows_per_range: int = 1024, most_ranges: int = 50_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to both neighbours.

    The next document is found without a global sort: ids are cut into equal
    ranges, each range is one window, and a range's first row is added to the
    range above it as the row that follows. ``most_ranges`` bounds the table of
    range heads that is broadcast.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lo, hi, n = base.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, min(most_ranges, -(-n // rows_per_range)))
    width = max(1, -(-(hi - lo + 1) // ranges)) if lo is not None else 1
    at = F.coalesce(F.floor((F.col("doc_id") - F.lit(lo or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    base = base.withColumn("range", at)
    # the largest id of each range, to be shown to the next higher range (the lowest shows to ... the highest id)
    heads = base.groupBy("range").agg(F.max("doc_id").alias("head"))
    w = Window.orderBy("range")  # at most most_ranges + 1 rows
    heads = heads.select(F.col("range").alias("of"), "head",
                         F.coalesce(F.lead("range").over(w), F.min("range").over(Window.partitionBy())).alias("to"))
    ghosts = (base.join(F.broadcast(heads), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
              .select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("ghost")))
    rows = base.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.select("range", "ghost", "doc_id", "text", F.row_number().over(order).alias("rn"),
                       F.coalesce(F.lead("text").over(order), F.lit("")).alias("after"))
    size = F.length("text").cast("long")
    rows = rows.select("range", "ghost", "doc_id", "rn", "text", size.alias("n_chars"),
                       F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"),
                                F.expr("substring(after, 1, length(text) div 3)")).alias("edited"))
    rows = rows.select("range", "ghost", "doc_id", "rn", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                                         F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("x"))
    rows = rows.select("*", "x.kind", "x.body").drop("x").where("kind = 0 or ghost = 0")
    keys = ["range", "rn", "ghost", "doc_id", "n_chars", "edited_sha256", "kind"]
    prints = fingerprint(rows, keys, "body")
    own = F.max(F.when(F.col("kind") == 0, F.col("fingerprint")))
    both = prints.groupBy(*keys[:-1]).agg(own.alias("fingerprint"),
                                          F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    nxt = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("rn"))
    return (both.withColumn("next_fingerprint", nxt).where("ghost = 0")
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")))
