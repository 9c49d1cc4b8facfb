"""Helpers shared by the training-data operators: shared scratch tables, components, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartlane.session import discard, shuffles_removed


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where a local master names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kartlane-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component = smallest node.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, so lineage stays short. Self loops and repeated or nulled
    edges are ignored; no edges give no rows.
    """
    e = (edges.select("a", "b").where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = materialize(small.select("u", F.col("m").alias("v"))
                        .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                        .distinct())
        if before is not None:
            discard(before)
        before = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["p"]) < n:
        size = max(n, 1 << 16)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        p[0] = q[0] = 1
        _POW["p"], _POW["q"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POW["p"][:n], _POW["q"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(b: np.ndarray, strip: bool) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of a lower-cased byte array; ``strip``: ASCII punctuation separates too."""
    gap = _SPACE[b]
    if strip:
        gap = gap | _PUNCT[b]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes | np.ndarray, strip: bool = False, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of one UTF-8 text, A-Z lower-cased, in text order.

    With ``strip`` ASCII punctuation separates words too. With ``prefixes`` one
    row for each number of bytes, of the words cut to that length, and a last
    row for the whole words.
    """
    b = np.frombuffer(raw, np.uint8) if not isinstance(raw, np.ndarray) else raw
    b = _LOWER[b]
    start, end = word_bounds(b, strip) if len(b) else (np.empty(0, np.int64),) * 2
    if not len(start):
        return np.empty((len(prefixes) + 1, 0) if prefixes else 0, np.uint64)
    p, q = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])

    def hashed(to):
        return mix((total[to] - total[start]) * q[start] + (to - start).astype(np.uint64) * _ODD)

    if not prefixes:
        return hashed(end)
    return np.stack([*(hashed(np.minimum(end, start + k)) for k in prefixes), hashed(end)])


_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"()[]{}"]] = True


ROWS_PER_BATCH = "1000"


def bounded_batches(spark: SparkSession) -> None:
    """Whole documents travel in Arrow batches here: Spark's 10,000 rows a batch become 1,000 where nobody has set them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ROWS_PER_BATCH)


def pieces(batches, rows: int = 2000, text: int | None = None, size: int = 1 << 21):
    """Arrow batches cut to at most ``rows`` rows; gives unused memory back when a task ends.

    With ``text``, a string column's number, also cut to at most ``size`` bytes of its texts (or one row).
    """
    import pyarrow.compute as pc
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            if text is None:
                yield part
                continue
            end = np.cumsum(pc.binary_length(part.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            x = 0
            while x < len(end):
                y = max(x + 1, int(np.searchsorted(end, (end[x - 1] if x else 0) + size, "right")))
                yield part.slice(x, y - x)
                x = y
    tidy()


def tidy() -> None:
    """Workers stay for the next task; the memory that this one has freed need not."""
    import contextlib
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_column(batch, name: str):
    """The text of a batch: a column, or a field of a struct column (``row.text``); null rows have null texts."""
    import pyarrow.compute as pc
    top, _, field = name.partition(".")
    column = batch.column(batch.schema.get_field_index(top))
    return pc.struct_field(column, field) if field else column


def texts_of(column):
    """Yield each value of an Arrow string column as a UTF-8 byte view (null: empty), without copies."""
    import pyarrow as pa
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield data[:0] if null is not None and null[i] else data[off[i]:off[i + 1]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, per_class: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``per_class`` labelled documents of each class, written once.

    Only rows with ``crc32(doc_id) mod fold <> held`` count; they are chosen by
    a hash of their id. Contradicting labels of one id count as 1. The chosen ids
    (twice ``per_class`` at most) are small enough to broadcast.
    """
    spark = docs.sparkSession
    own = (labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
           .where(F.crc32(F.col("doc_id").cast("string")) % fold != held).groupBy("doc_id").agg(F.max("y").alias("y")))
    own = materialize(own)
    parts = [own.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = [(r.doc_id, r.y) for p in parts for r in p.collect()]
    ids = spark.createDataFrame(ids, "doc_id bigint, y int")
    share = own.agg(F.avg("y")).first()[0]
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    return sample.withColumn("share", F.lit(share))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps on standardised columns; returns coefficients, intercept last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    c = np.zeros(z.shape[1])
    pen = np.full(len(c), ridge)
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(z @ c)
        g = z.T @ (weight * (p - y)) / weight.sum() + pen * c
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z / weight.sum() + np.diag(pen)
        step = np.linalg.solve(h, g)
        c -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return np.append(c[:-1] / scale, c[-1] - (c[:-1] * mean / scale).sum())


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
