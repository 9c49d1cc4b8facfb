"""Operator 12, hard negatives from Hilbert-ordered blocks with zone maps.

1. Vectors become whole numbers floor(256 * x). Rows are sorted by label and by
   place on a Hilbert curve through all dimensions, cut into blocks of ``BLOCK``
   rows and written as Parquet, one row per block: its labels' range, the least
   and greatest value of each dimension (the zone map), and the vectors.
2. For an anchor, interval arithmetic over a zone map bounds its product with every row
   of the block from below and above. Only the columns of the zone maps are
   read for that. Blocks whose bounds miss all of the anchor's windows, or that hold
   no label of the wanted kind, are not read.
3. Each search has two rounds: the blocks of the highest bounds of each page of
   zone maps (as many as the square root of its blocks), whose rows set the score that a place
   among the first k costs; then every other block whose bounds still reach into a
   window beyond that score. The bounds hold for all rows, so the result is exact.
4. First search: the ``positives`` best other rows of an anchor's label. Second: for each
   positive the ``negatives`` best rows of another label in the window between
   ``low`` and ``high`` hundredths of its score.

Defined results: rows with a null label, a null vector or any null or non-finite
component take no part; vectors of different dimension are not compared; empty
vectors have the product 0; rows that repeat an id are rows of their own, an
anchor only leaves itself out; equal scores are ordered by id, null ids last;
other columns are not read; an empty table gives an empty result; products beyond
64 bits are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 512             # rows of a block
PAGE = 256              # zone maps that are searched at once
ANCHORS = 256           # anchors that are compared with a page or block at once
SHARE = 65_536          # anchors that one task compares with a block, about
BITS, CURVE = 4, 32     # Hilbert curve: bits of each dimension, leading bytes kept
_EXACT = float(1 << 53)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of unsigned rows below ``2 ** bits``: one row of bytes each, ordered as bytes.

    The axes are turned into the transposed index as in Skilling, "Programming the Hilbert curve" (2004).
    """
    x = x.T.astype(np.uint32).copy()
    d = len(x)
    if not d:
        return np.zeros((x.shape[1], 0), np.uint8)
    for level in range(bits - 1, 0, -1):
        q = np.uint32(1 << level)
        p = np.uint32(q - 1)
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


def quantised(vectors: DataFrame, label, anchor) -> DataFrame:
    """``(key, vec_id, label, anchor, d, q, curve)`` of the rows that take part; ``q`` holds 64-bit whole numbers."""
    ok = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
          & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    own = (vectors.select("vec_id", "label", "embedding").where(ok)
           .select(F.monotonically_increasing_id().alias("key"), "vec_id", label.cast("bigint").alias("label"),
                   F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("x")))
    # one number: the greatest component, which scales the curve
    most = own.agg(F.max(F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v))))).first()[0] or 0.0
    if most * 256 >= 2.0 ** 62:
        raise ValueError("components beyond 62 bits")
    top = int(np.floor(most * 256)) + 1

    def run(batches):
        import pyarrow as pa
        for b in batches:
            x = b.column(4)
            flat = x.flatten().to_numpy(zero_copy_only=False)
            bounds = np.asarray(x.offsets).astype(np.int64)
            q = np.floor(flat * 256.0).astype(np.int64)
            bounds = bounds - bounds[0]
            curve = [b""] * b.num_rows
            size = np.diff(bounds)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                if d:
                    own_q = np.stack([q[bounds[i]:bounds[i + 1]] for i in rows])
                    place = np.clip((own_q + top) * (1.0 / (2 * top)) * (1 << BITS), 0, (1 << BITS) - 1)
                    for i, c in zip(rows, hilbert(place, BITS)[:, :CURVE]):
                        curve[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(size, pa.int64()), pa.array([q[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()),
                 pa.array(curve, pa.binary())], ["key", "vec_id", "label", "anchor", "d", "q", "curve"])

    return materialize(own.mapInArrow(run, "key bigint, vec_id bigint, label bigint, anchor boolean, d bigint, q binary, curve binary"))


_BLOCKS = ("block bigint, d bigint, n bigint, label_low bigint, label_high bigint, low binary, high binary, "
           "keys binary, ids array<bigint>, labels binary, wide boolean, q binary")


def _numbers(values, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(len(values), d)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows in the order of dimension, label and curve, as Parquet blocks with zone maps; written once."""
    def run(batches):
        import pyarrow as pa
        held, d = [], None

        def out():
            b = pa.Table.from_batches(held).combine_chunks()
            key, label = b.column("key").to_numpy(), b.column("label").to_numpy()
            q = _numbers(b.column("q").to_pylist(), d)
            low, high = (q.min(0), q.max(0))
            wide = bool(len(low) and max(-int(low.min()), int(high.max())) >= 1 << 15)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(key[0])]), pa.array([d]), pa.array([len(key)]), pa.array([int(label.min())]), pa.array([int(label.max())]),
                 *[pa.array([v.tobytes()], pa.binary()) for v in (low, high, key)], pa.array([b.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([label.tobytes()], pa.binary()), pa.array([wide]),
                 pa.array([(q if wide else q.astype(np.int16)).tobytes()], pa.binary())], [c.split()[0] for c in _BLOCKS.split(", ")])

        for b in batches:
            sizes = b.column(4).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows]
            for x, y in zip(cut, cut[1:]):
                if x == y:
                    continue
                if held and d != int(sizes[x]):
                    yield out()
                    held = []
                d = int(sizes[x])
                while x < y:
                    take = min(y - x, BLOCK - sum(h.num_rows for h in held))
                    held.append(b.slice(x, take))
                    x += take
                    if sum(h.num_rows for h in held) == BLOCK:
                        yield out()
                        held = []
        if held:
            yield out()

    order = ["d", "label", "curve", "key"]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _BLOCKS))


_WINDOWS = "array<struct<w:int,low:bigint,high:bigint,floor:bigint>>"


def _roles(held: DataFrame, asked: DataFrame, group: list[str]) -> DataFrame:
    """Rows of ``held`` (role 0) and ``asked`` (role 1) of one group in one task, those of ``held`` first."""
    both = held.withColumn("role", F.lit(0)).unionByName(asked.withColumn("role", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*group).sortWithinPartitions(*group, "role")


def _runs(batches, groups: int):
    """``(group, role, slice)`` of consecutive rows of one group (the first columns) and role (the column after them)."""
    for b in batches:
        keys = np.stack([b.column(i).to_numpy() for i in range(groups + 1)])
        cut = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), b.num_rows]
        for x, y in zip(cut, cut[1:]):
            if x < y:
                yield tuple(keys[:groups, x]), int(keys[groups, x]), b.slice(x, y - x)


def _windows(column):
    """Lists of windows as arrays ``(rows, most)``: low, high, floor; absent ones are empty (low above high)."""
    lists = column.to_pylist()
    most = max(map(len, lists), default=0)
    w = np.full((len(lists), max(most, 1)), -1, np.int64)
    low, high, floor = np.ones(w.shape, np.int64), np.zeros(w.shape, np.int64), np.full(w.shape, np.iinfo(np.int64).min)
    for i, own in enumerate(lists):
        for j, x in enumerate(own):
            w[i, j], low[i, j], high[i, j], floor[i, j] = x["w"], x["low"], x["high"], x["floor"]
    return w, low, high, floor


def needed(zones: DataFrame, anchors: DataFrame, pages: int, same: bool, later: bool) -> DataFrame:
    """``(block, key)``: the blocks that each anchor has to read.

    ``anchors(key, label, d, q, windows)``. The first round takes the blocks of the
    highest bounds of each page, the ``later`` one all others whose bounds reach into a window above its floor.
    """
    held = zones.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(pages)))
    asked = anchors.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pages - 1).cast("bigint"))))
    columns = ["page", "role", "block", "d", "label_low", "label_high", "low", "high", "key", "label", "q", "windows"]

    def run(batches):
        import pyarrow as pa
        page, zone = None, None
        for (at,), role, b in _runs(batches, 1):
            if page != at:
                page, zone = at, {}
            if role == 0:
                dims = b.column(3).to_numpy()
                for d in np.unique(dims):
                    p = b.filter(pa.array(dims == d))
                    own = (p.column(2).to_numpy(), p.column(4).to_numpy(), p.column(5).to_numpy(),
                           _numbers(p.column(6).to_pylist(), d).astype(float), _numbers(p.column(7).to_pylist(), d).astype(float))
                    zone[d] = own if d not in zone else tuple(np.concatenate(x) for x in zip(zone[d], own))
                continue
            dims = b.column(3).to_numpy()
            for d in np.unique(dims):
                if d not in zone:
                    continue
                mine = b.filter(pa.array(dims == d))
                for x in range(0, mine.num_rows, ANCHORS):
                    p = mine.slice(x, ANCHORS)
                    i, j = _reached(zone[d], p, int(d), same, later)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(zone[d][0][j]), p.column(8).take(pa.array(i))], ["block", "key"])

    rows = _roles(held.select(columns[0], *columns[2:8]), asked.select("page", "d", "key", "label", "q", "windows"), ["page"])
    return rows.select(columns).mapInArrow(run, "block bigint, key bigint")


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each row of ``a`` with any point of each box, by interval arithmetic."""
    up, down = np.maximum(a, 0), np.maximum(-a, 0)
    slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)  # covers rounding of products beyond 53 bits
    return up @ low.T - down @ high.T - slack, up @ high.T - down @ low.T + slack


def _reached(zone, p, d: int, same: bool, later: bool):
    _, label_low, label_high, low, high = zone
    label = p.column(9).to_numpy()[:, None]
    a = _numbers(p.column(10).to_pylist(), d).astype(float)
    least, most = bounds(a, low, high)
    _, window_low, window_high, floor = _windows(p.column(11))
    held = (label_low <= label) & (label <= label_high)
    fits = held if same else ~((label_low == label) & (label_high == label))
    open_ = window_low <= window_high
    some = np.zeros(fits.shape, bool)
    beyond = np.zeros(fits.shape, bool)
    for j in range(window_low.shape[1]):
        here = open_[:, j, None] & (most >= window_low[:, j, None]) & (least <= window_high[:, j, None])
        some |= here
        beyond |= here & (most >= floor[:, j, None])
    some &= fits
    # with m of n blocks first, later ones hold about k n / m rows above the floor: the sum is least at the root
    first_ = int(np.ceil(np.sqrt(fits.shape[1])))
    order = np.argsort(np.where(some, -most, np.inf), axis=1, kind="stable")[:, :first_]
    chosen = np.zeros(fits.shape, bool)
    np.put_along_axis(chosen, order, True, 1)
    chosen &= some
    return np.nonzero(beyond & some & ~chosen if later else chosen)


def hits(stored: DataFrame, anchors: DataFrame, need: DataFrame, parts: int, same: bool, k: int) -> DataFrame:
    """``(key, w, score, vec_id, other)``: of every needed block the first ``k`` rows in each of an anchor's windows."""
    asked = need.join(anchors, "key").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    chosen = asked.select("block", "part").distinct()
    held = stored.select("block", "d", "keys", "ids", "labels", "wide", "q").join(chosen, "block")
    columns = ["block", "part", "role", "d", "keys", "ids", "labels", "wide", "q", "key", "label", "windows"]

    def run(batches):
        import pyarrow as pa
        group, block = None, None
        for at, role, b in _runs(batches, 2):
            if group != at:
                group, block = at, None
            if role == 0:
                d, wide = b.column(3)[0].as_py(), b.column(7)[0].as_py()
                ids = b.column(5)[0].values
                known = ~ids.is_null().to_numpy(zero_copy_only=False)
                key = np.frombuffer(b.column(4)[0].as_buffer(), np.int64)
                q = np.frombuffer(b.column(8)[0].as_buffer(), np.int64 if wide else np.int16).reshape(len(key), d)
                block = (key, ids, known, ids.fill_null(0).to_numpy(), np.frombuffer(b.column(6)[0].as_buffer(), np.int64), q.astype(np.int64))
            elif block is not None:
                for x in range(0, b.num_rows, ANCHORS):
                    out = _compare(block, b.slice(x, ANCHORS), same, k)
                    if out is not None:
                        yield out

    rows = _roles(held, asked.select("block", "part", "key", "label", "q", "windows"), ["block", "part"])
    return rows.select(columns).mapInArrow(run, "key bigint, w int, score bigint, vec_id bigint, other bigint")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    size = max(1, a.shape[1]) * max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0)))
    if size < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if size < 2.0 ** 62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(abs(int(x)) for x in exact.ravel()) >= 1 << 63:
        raise ValueError("a product beyond 64 bits")
    return exact.astype(np.int64)


def _compare(block, p, same: bool, k: int):
    import pyarrow as pa
    key, ids, known, number, labels, q = block
    own, label = p.column(9).to_numpy(), p.column(10).to_numpy()
    score = products(_numbers(p.column(8).to_pylist(), q.shape[1]), q)
    fits = ((labels == label[:, None]) if same else (labels != label[:, None])) & (key != own[:, None])
    w, low, high, floor = _windows(p.column(11))
    out = []
    for j in range(w.shape[1]):
        inside = fits & (score >= np.maximum(low, floor)[:, j, None]) & (score <= high[:, j, None])
        for i in np.flatnonzero(inside.any(1)):
            at = np.flatnonzero(inside[i])
            s = score[i, at]
            if len(at) > k:
                worst = np.partition(s, len(s) - k)[len(s) - k]
                at, s = at[s >= worst], s[s >= worst]
                best = np.lexsort((key[at], number[at], ~known[at], -s))[:k]
                at, s = at[best], s[best]
            out.append((i, w[i, j], s, at))
    if not out:
        return None
    n = [len(x[2]) for x in out]
    at = np.concatenate([x[3] for x in out])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(own[[x[0] for x in out]], n)), pa.array(np.repeat([x[1] for x in out], n).astype(np.int32)),
         pa.array(np.concatenate([x[2] for x in out])), ids.take(pa.array(at)), pa.array(key[at])], ["key", "w", "score", "vec_id", "other"])


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor's window, with ``rank`` from 1."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("other")]
    return (found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "w").orderBy(*order)))
            .where(F.col("rank") <= k))


def search(stored: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``(key, w, score, vec_id, other, rank)``: the first ``k`` rows in each window of every anchor.

    ``anchors(key, label, d, q, windows)``; the windows' floors are set here.
    """
    # block and anchor counts: two numbers
    n, asked = stored.count(), anchors.count()
    pages, parts = max(1, -(-n // PAGE)), max(1, -(-asked // SHARE))
    zones = stored.select("block", "d", "label_low", "label_high", "low", "high")
    one = materialize(first(hits(stored, anchors, materialize(needed(zones, anchors, pages, same, False)), parts, same, k), k))
    floors = one.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
    raised = F.transform("windows", lambda x: F.struct(
        x.w.alias("w"), x.low.alias("low"), x.high.alias("high"),
        F.coalesce(F.try_element_at(F.col("reached"), x.w), x.floor).alias("floor")).cast("struct<w:int,low:bigint,high:bigint,floor:bigint>"))
    again = materialize(anchors.join(floors, "key", "left").select("key", "label", "d", "q", raised.alias("windows")))
    two = hits(stored, again, materialize(needed(zones, again, pages, same, True)), parts, same, k)
    return materialize(first(one.drop("rank").unionByName(two), k))


def mine(vectors: DataFrame, label, anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` per negative.

    ``vectors(vec_id, label, embedding)``; ``label`` and ``anchor`` are columns over
    them: the label to use, and whether a row is an anchor.
    """
    rows = quantised(vectors, label, anchor)
    stored = blocks(rows)
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(-(1 << 63)).cast("bigint").alias("low"), F.lit((1 << 63) - 1).alias("high"),
                             F.lit(-(1 << 63)).cast("bigint").alias("floor"))).cast(_WINDOWS)
    anchors = materialize(rows.where("anchor").select("key", "vec_id", "label", "d", "q", whole.alias("windows")))
    best = search(stored, anchors.drop("vec_id"), positives, True)
    wide = F.col("score").cast("decimal(38,0)")
    floor_div = lambda x: ((x - F.pmod(x, F.lit(100).cast("decimal(38,0)"))) / 100).cast("bigint")
    pairs = materialize(best.select("key", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                                    (-floor_div(-wide * low)).alias("low"), floor_div(wide * high).alias("high")))
    windows = pairs.where("low <= high").groupBy("key").agg(F.collect_list(F.struct(
        F.col("w").cast("int").alias("w"), "low", "high", F.lit(-(1 << 63)).cast("bigint").alias("floor"))).cast(_WINDOWS).alias("windows"))
    found = search(stored, anchors.drop("windows", "vec_id").join(windows, "key").select("key", "label", "d", "q", "windows"), negatives, False)
    return (found.select("key", "w", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pairs, ["key", "w"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """The contracted query: labels of ids divisible by 7 move on by one, ids divisible by 100 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, label, F.col("vec_id") % 100 == 0)
