"""Operator 13, phrase collocations by multikey three-way quicksort of suffix pointers.

1. Texts are cut into pieces and words; a chunk of texts of one language becomes
   word codes and its own dictionary, written once. The dictionaries add up to the
   counts of all words. Words below ``least`` can stand in no candidate, so they
   end a suffix as a piece's end does; the others get dense global numbers.
2. Each chunk learns the numbers of its own words by a join. Its suffixes, cut
   after ``DEPTH`` words, are routed by their leading words: up to and with
   the first word that is not hot. A word is hot above ``SUFFIXES / 8``
   occurrences, so no such group is larger, however frequent single words or
   pairs are. Equal suffixes of a chunk travel as one with a weight.
3. Every bucket sorts its suffix pointers by multikey three-way quicksort to
   depth ``DEPTH``; the size of an equal partition is its phrase's count, and partitions
   below ``least`` are abandoned. Only a phrase of two or three hot words lies in many
   buckets: each chunk counts its own and sends the counts to the phrase's bucket.
4. Counts of both parts of each cut come by joins on the words' numbers. Only
   whole numbers are used; products are decimals of up to 38 digits.

Words are ``[^\\x20\\x09]+`` within pieces between ``[.,;:!?\\x0A-\\x0D]``, A-Z
lower-cased. Defined results: null or empty texts have no words; a null language
is ``und`` and shares its counts with that name; repeated rows and null ids count
as rows like any other; very long texts are rows like any other; only ``text`` and
``lang`` are read, whatever other columns there are; an empty table has no phrases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces
from .words import bytes_in, split

DEPTH = 4
CHUNK = 4 << 20         # bytes of text whose words share a dictionary
SUFFIXES = 1 << 20      # suffixes that a bucket holds on average
SMALL = 2048            # partitions that one sort finishes
_BLANK = bytes_in((0x20, 0x20), (0x09, 0x09))
_STOP = bytes_in((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
_GAP = _BLANK | _STOP
_STOPS = [chr(i) for i in np.flatnonzero(_STOP)]
_IDS = ["w1", "w2", "w3", "w4"]
_OUT = "w1 int, w2 int, w3 int, w4 int, f bigint"


# --- words and their numbers

def chunks(docs: DataFrame) -> DataFrame:
    """``(chunk, lang, codes, words, counts)``: codes (32 bits each) into ``words``, -1 where a piece ends."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")

    def run(batches):
        import pyarrow as pa
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def out(lang):
            column = pa.chunked_array(held.pop(lang)).combine_chunks()
            size.pop(lang)
            w = split(column, _GAP)
            if not len(w.code):
                return
            stops = np.concatenate([[0], np.cumsum(_STOP[w.raw], dtype=np.int32)])
            ends = np.ones(len(w.code), bool)
            ends[:-1] = (w.doc[1:] != w.doc[:-1]) | (stops[w.start[1:]] > stops[w.end[:-1]])
            codes = np.full(len(w.code) + int(ends.sum()), -1, np.int32)
            codes[np.arange(len(w.code)) + np.cumsum(ends) - ends] = w.code
            counts = np.bincount(w.code, minlength=len(w.names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([codes.tobytes()], pa.binary()),
                 pa.array([w.names.cast(pa.large_string()).to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                ["lang", "codes", "words", "counts"])

        for b in pieces(batches):
            langs = b.column(0).dictionary_encode()
            which = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                text = shortened(b.column(1).cast(pa.large_string()).take(pa.array(np.flatnonzero(which == i))))
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + text.nbytes
                if size[lang] >= CHUNK:
                    yield from out(lang)
        for lang in list(held):
            yield from out(lang)

    made = own.mapInArrow(run, "lang string, codes binary, words array<string>, counts array<bigint>")
    return materialize(made.select(F.monotonically_increasing_id().alias("chunk"), "*"))


def shortened(texts, most: int | None = None):
    """The column with each text of more than ``most`` bytes (a chunk's size) cut into several between pieces."""
    import pyarrow as pa
    import pyarrow.compute as pc
    most = most or CHUNK
    if not len(texts) or pc.max(pc.binary_length(texts)).as_py() <= most:
        return texts
    out = []
    for t in texts.to_pylist():
        while len(t) > most:  # characters, so no part is longer than four times that
            at = max(t.rfind(c, 0, most) for c in _STOPS)
            at = at if at >= 0 else min((x for x in (t.find(c, most) for c in _STOPS) if x >= 0), default=-1)
            if at < 0:
                break
            out.append(t[:at])
            t = t[at + 1:]
        out.append(t)
    return pa.array(out, pa.large_string())


def vocabulary(chunked: DataFrame, least: int) -> DataFrame:
    """``(lang, word, f, id)`` of the words with at least ``least`` occurrences; ``id`` counts from 1 without gaps."""
    words = (chunked.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
             .groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= least))
    words = materialize(words.withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # one row per task that wrote the table
    ends = sorted((r.part, r.n) for r in words.groupBy(part.alias("part")).agg((F.max(row) + 1).alias("n")).collect())
    offsets, total = [], 1
    for p, n in ends:
        offsets.append((p, total))
        total += n
    if total > 1 << 31:
        raise ValueError("more frequent words than 32 bits can number")
    first = words.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    return materialize(words.withColumn("part", part).join(F.broadcast(first), "part")
                       .select("lang", "word", "f", (F.col("before") + row).cast("int").alias("id")))


# --- suffixes

def windows(gid: np.ndarray) -> np.ndarray:
    """``(DEPTH, n)`` numbers of the distinct suffixes' first words, 0 from an end on; and their weights as a last row."""
    n = len(gid)
    padded = np.concatenate([gid, np.zeros(DEPTH, gid.dtype)])
    at = np.flatnonzero((gid != 0) & (padded[1:n + 1] != 0))  # a lone word is no phrase
    cols = np.stack([padded[at + k] for k in range(DEPTH)])
    for k in range(2, DEPTH):
        cols[k] *= cols[k - 1] != 0
    order = _order(cols)
    cols = cols[:, order]
    new = np.ones(cols.shape[1], bool)
    new[1:] = (cols[:, 1:] != cols[:, :-1]).any(0)
    first = np.flatnonzero(new)
    return np.vstack([cols[:, first], np.diff(first, append=cols.shape[1])[None]]).astype(np.int32)


def _order(cols: np.ndarray) -> np.ndarray:
    wide = cols.astype(np.uint64)
    return np.lexsort(((wide[2] << np.uint64(32)) | wide[3], (wide[0] << np.uint64(32)) | wide[1]))


def routed(cols: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each suffix: by its leading words up to and with the first that is not in ``hot`` (sorted)."""
    from .common import mix
    key, go = np.zeros(cols.shape[1], np.uint64), np.ones(cols.shape[1], bool)
    for k in range(DEPTH):
        key = np.where(go, mix(key * np.uint64(0x9E3779B97F4A7C15) + cols[k].astype(np.int64).astype(np.uint64) + np.uint64(k + 1)), key)
        go &= is_hot(cols[k], hot)
    return (key % np.uint64(buckets)).astype(np.int64)


def is_hot(ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(ids), bool)
    return hot[np.minimum(np.searchsorted(hot, ids), len(hot) - 1)] == ids


def hot_prefixes(w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Counts of the phrases of two and three hot words in ``w`` (windows and weights), ended by -1."""
    out, go = [w[:, :0]], is_hot(w[0], hot)
    for k in range(1, DEPTH - 1):
        go = go & is_hot(w[k], hot)
        own = w[:, go].astype(np.int64)
        if not own.shape[1]:
            break
        own[k + 1:DEPTH] = -1  # windows are sorted: equal phrases lie together
        first = np.flatnonzero(np.append(True, (own[:k + 1, 1:] != own[:k + 1, :-1]).any(0)))
        counts = np.add.reduceat(own[DEPTH], first)
        out.append(np.vstack([own[:DEPTH, first], counts[None]]).astype(np.int32))
    return np.concatenate(out, 1)


def phrase_counts(cols: np.ndarray, weight: np.ndarray, hot: np.ndarray, least: int, small: int = SMALL):
    """``(words, count)`` of all phrases of 2 to ``DEPTH`` words with ``least`` occurrences, but those of two or three hot words."""
    hots = np.stack([is_hot(c, hot) for c in cols])
    found, rest = [], []
    todo = [(np.arange(cols.shape[1]), 0, True)]  # suffix pointers, how many words they share, whether all those are hot
    while todo:
        p, depth, hot_so_far = todo.pop()
        if not len(p) or weight[p].sum() < least:
            continue
        if len(p) <= small:
            rest.append((p, depth))
            continue
        key = cols[depth][p]
        some = key[::max(1, len(key) // 255)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        todo.append((p[key < pivot], depth, hot_so_far))
        todo.append((p[key > pivot], depth, hot_so_far))
        same = p[key == pivot]
        if pivot == 0:  # the suffixes end here
            continue
        all_hot = hot_so_far and bool(hots[depth][same[0]])
        count = int(weight[same].sum())
        if depth >= 1 and count >= least and (not all_hot or depth + 1 == DEPTH):
            found.append((cols[:depth + 1, same[0]].tolist() + [0] * (DEPTH - depth - 1), count))
        if depth + 1 < DEPTH:
            todo.append((same, depth + 1, all_hot))
    out = [np.array([w for w, _ in found], np.int32).reshape(-1, DEPTH)]
    counts = [np.array([c for _, c in found], np.int64)]
    if rest:  # all small partitions at once: their phrases beyond the shared words occur in no other partition
        p = np.concatenate([x for x, _ in rest])
        shared = np.repeat([d for _, d in rest], [len(x) for x, _ in rest])
        order = _order(cols[:, p])
        p, shared = p[order], shared[order]
        own, mass = cols[:, p], weight[p]
        new = np.zeros(len(p), bool)
        new[0] = True
        all_hot = np.ones(len(p), bool)
        for k in range(DEPTH):
            new[1:] |= own[k, 1:] != own[k, :-1]
            all_hot &= hots[k][p]
            if not k:
                continue
            first = np.flatnonzero(new)
            total = np.add.reduceat(mass, first)
            keep = (own[k, first] != 0) & (shared[first] <= k) & (total >= least) & (~all_hot[first] | (k + 1 == DEPTH))
            words = np.zeros((int(keep.sum()), DEPTH), np.int32)
            words[:, :k + 1] = own[:k + 1, first[keep]].T
            out.append(words)
            counts.append(total[keep])
    return np.concatenate(out), np.concatenate(counts)


def bucket_counts(w: np.ndarray, hot: np.ndarray, least: int, small: int = SMALL):
    """``phrase_counts`` of a bucket's windows, and the sums of the counted hot phrases."""
    counted_ = (w[:DEPTH] == -1).any(0)
    phrases, f = phrase_counts(w[:DEPTH, ~counted_], w[DEPTH, ~counted_].astype(np.int64), hot, least, small)
    sent = w[:, counted_]
    if sent.shape[1]:
        names, at = np.unique(np.maximum(sent[:DEPTH], 0).T, axis=0, return_inverse=True)
        total = np.bincount(at.ravel(), sent[DEPTH]).astype(np.int64)
        phrases, f = np.concatenate([phrases, names[total >= least]]), np.concatenate([f, total[total >= least]])
    return phrases, f


def counted(chunked: DataFrame, words: DataFrame, least: int, suffixes: int = SUFFIXES) -> DataFrame:
    """``(w1, w2, w3, w4, f)`` of all phrases of 2 to ``DEPTH`` words with at least ``least`` occurrences (0: no word)."""
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = int(max(1, -(-total // suffixes)))
    # words with more than suffixes / 8 of at most buckets * suffixes occurrences: at most 8 * buckets
    hot = np.sort(np.array([r.id for r in words.where(F.col("f") > suffixes // 8).select("id").collect()], np.int32))
    entry = chunked.select("chunk", "lang", F.posexplode("words").alias("code", "word"))
    numbers = (entry.join(words.select("lang", "word", "id"), ["lang", "word"])
               .groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("numbers")))  # at most the chunk's words
    known = chunked.select("chunk", "codes").join(numbers, "chunk")

    def cut(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                codes = np.frombuffer(b.column(1)[i].as_buffer(), np.int32)
                pair = b.column(2)[i].values
                code, ids = pair.field(0).to_numpy(), pair.field(1).to_numpy()
                table = np.zeros(int(codes.max(initial=0)) + 2, np.int32)
                table[code] = ids
                table[-1] = 0  # code -1, the end of a piece
                w = windows(table[codes])
                if not w.shape[1]:
                    continue
                w = np.concatenate([w, hot_prefixes(w, hot)], 1)
                to = routed(w[:DEPTH], hot, buckets)
                order = np.argsort(to, kind="stable")
                w, to = w[:, order], to[order]
                begin = np.flatnonzero(np.diff(to, prepend=-1))
                end, present = np.append(begin[1:], len(to)), to[begin]
                for x in range(0, len(present), 256):
                    y = slice(x, x + 256)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(present[y]), pa.array([w[:, s:e].tobytes() for s, e in zip(begin[y], end[y])], pa.binary())],
                        ["bucket", "suffixes"])

    def sort(group):
        import pyarrow as pa
        parts = [np.frombuffer(x.as_buffer(), np.int32).reshape(DEPTH + 1, -1) for x in group.column("suffixes")]
        w = np.concatenate(parts, 1)
        phrases, f = bucket_counts(w, hot, least)
        return pa.table({**{c: pa.array(phrases[:, k], pa.int32()) for k, c in enumerate(_IDS)}, "f": pa.array(f, pa.int64())})

    # several buckets of one task are handled one after another; no phrase occurs in two buckets
    return materialize(known.mapInArrow(cut, "bucket bigint, suffixes binary").groupBy("bucket").applyInArrow(sort, _OUT))


# --- scores

def _key(ids) -> F.Column:
    return F.array(*[F.lit(0) if x is None else F.col(x) for x in ids])


def _sub(a: int, b: int) -> F.Column:
    """Words ``a`` to ``b`` (exclusive) of the phrase, padded to ``DEPTH``."""
    return F.array(*[F.col(c) for c in _IDS[a:b]], *[F.lit(0)] * (DEPTH - (b - a)))


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``(key, size, a, l, r, score)`` of the candidates that no frequent longer one contains: 100 f(longer) >= 80 a."""
    size = sum((F.col(c) > 0).cast("int") for c in _IDS)
    p = phrases.select(*_IDS, F.col("f").alias("a"), size.alias("size"), _key(_IDS).alias("key"))
    inner = None
    for n in (3, 4):
        for k in range(2, n):
            for a in range(0, n - k + 1):
                x = F.when(F.col("size") == n, F.struct(_sub(a, a + k).alias("key"), F.col("a").alias("f")))
                inner = [x] if inner is None else [*inner, x]
    longer = (p.where("size > 2").select(F.explode(F.array_compact(F.array(*inner))).alias("x"))
              .groupBy(F.col("x.key").alias("key")).agg(F.max("x.f").alias("longer")))
    d = "decimal(38,0)"
    left = p.join(longer, "key", "left").where(
        F.col("longer").isNull() | (F.col("longer").cast(d) * 100 < F.col("a").cast(d) * 80)).drop("longer")
    cuts = []
    for n in (2, 3, 4):
        for k in range(1, n):
            cuts.append(F.when(F.col("size") == n, F.struct(F.lit(k).alias("k"), _sub(0, k).alias("one"), _sub(k, n).alias("two"))))
    parts = left.select("key", "size", "a", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select("key", "size", "a", "c.*")
    every = phrases.select(_key(_IDS).alias("part"), "f").unionByName(
        words.select(F.array("id", F.lit(0), F.lit(0), F.lit(0)).alias("part"), "f"))
    parts = (parts.join(every.select(F.col("part").alias("one"), F.col("f").alias("l")), "one")
             .join(every.select(F.col("part").alias("two"), F.col("f").alias("r")), "two"))
    score = F.expr("(2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    return (parts.withColumn("score", score).groupBy("key", "size", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("key", "size", "a", "x.l", "x.r", "x.score"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, suffixes: int = SUFFIXES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    chunked = chunks(docs)
    words = vocabulary(chunked, least)
    totals = (chunked.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n"))
              .groupBy("lang").agg(F.sum("n").alias("n")))
    best = materialize(scored(counted(chunked, words, least, suffixes), words))
    spelt = (best.select("key", F.posexplode(F.slice("key", 1, DEPTH)).alias("at", "id")).where("id > 0")
             .join(words.select("id", "lang", "word"), "id").groupBy("key", "lang")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase")))
    named = best.join(spelt, "key").join(totals, "lang")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's first rows are among the first of 64 parts of it
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    named = (named.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
             .where(F.col("rank") <= top))
    return (named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score")))
