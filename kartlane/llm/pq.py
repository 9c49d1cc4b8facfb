"""Operator 2, near-duplicate vectors by product quantisation.

1. Equal vectors are one class. A bounded sample (``SAMPLE`` vectors by a hash
   of their content) trains the coarse centroids and, on the residuals, one
   codebook per subspace.
2. Every class is stored in the inverted list of its nearest centroid, as its
   subspace codes and the exact length of what they miss.
3. As a query it probes every list whose border with its own list lies within
   ``SLACK`` standard deviations of a partner's offset along the border's normal
   (radius / sqrt(dimension) each). A partner outside would have to lie that far
   in one direction.
4. Asymmetric distances are sums of table entries per code. By the triangle
   inequality a stored vector can only be within the radius if its asymmetric
   distance is within radius + what its codes miss, so no partner in a probed
   list is lost. What passes is decided by the exact cosine in double precision.

Lists longer than ``BLOCK`` are split over tasks; no list of pairs leaves a
task, only link counts and a spanning forest.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different dimension never link;
repeated rows link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

SAMPLE, PER_LIST, MOST_LISTS, SLACK, BLOCK = 16_384, 128, 8192, 2.0, 2048
SUBSPACES, WORDS = 8, 256


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_square(x[i:i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])


class Index:
    """Coarse centroids, and codebooks over their residuals, of unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, n: int, radius: float):
        d = sample.shape[1]
        self.radius = radius
        self.coarse = _kmeans(sample, int(min(max(n // PER_LIST, 1), MOST_LISTS)), 12, 1)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = [int(v) for v in np.linspace(0, d, min(SUBSPACES, d) + 1)]
        self.books = [_kmeans(rest[:, a:b], WORDS, 8, 2 + a) for a, b in zip(self.cuts, self.cuts[1:])]
        self.between = np.sqrt(_square(self.coarse, self.coarse))
        self.margin = radius * min(1.0, SLACK / np.sqrt(d))

    def place(self, x: np.ndarray):
        """Own list, probed lists, codes and the length of what the codes miss, of unit vectors."""
        far = _square(x, self.coarse)
        own = far.argmin(1)
        border = (far - far[np.arange(len(x)), own][:, None]) / (2 * np.maximum(self.between[own], 1e-12))
        near = border <= self.margin
        near[np.arange(len(x)), own] = True
        probes = [np.flatnonzero(v).astype(np.int32) for v in near]
        rest = x - self.coarse[own]
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return own, probes, codes, np.sqrt(((rest - back) ** 2).sum(1))

    def candidates(self, q: np.ndarray, owner: int, codes: np.ndarray, miss: np.ndarray):
        """Index pairs (query, stored) whose asymmetric distance leaves a link possible."""
        at = q - self.coarse[owner]
        total = np.zeros((len(q), len(codes)))
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            total += _square(at[:, a:b], self.books[m])[:, codes[:, m]]
        return np.nonzero(np.sqrt(total) <= self.radius + miss + 1e-6)


def _unit(column, d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), "<f8").reshape(-1, d)
    return x


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members(vec_id, node)``, node null for vectors that cannot link, and ``reps(node, d, size, v)``, v the unit vector."""
    ok = (F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
          & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    # -0.0 and 0.0 are one value
    own = own.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    own = own.withColumn("node", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("embedding", F.size("embedding"))))
    firsts = (own.where("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("size")))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            d, v = [], []
            for x in b.column(1):
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x / np.abs(x).max()
                d.append(len(x))
                v.append((x / np.sqrt((x * x).sum())).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.int64()), b.column(2), pa.array(v, pa.binary())],
                                             ["node", "d", "size", "v"])
    reps = firsts.select("node", "embedding", "size").mapInArrow(run, "node bigint, d bigint, size bigint, v binary")
    return own.select("vec_id", "node"), materialize(reps)


def links(reps: DataFrame, cosine: float) -> DataFrame:
    """``(node, n, other)``: partial link counts (other null) and edges of a spanning forest (n 0), of one dimension."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    d, n = reps.agg(F.max("d"), F.count("*")).first()
    sample = reps.orderBy(F.xxhash64("node"), "node").select("v").limit(SAMPLE).collect()
    index = Index(_unit([r.v for r in sample], d), n, radius)

    def put(batches):
        import pyarrow as pa
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                own, probes, codes, miss = index.place(_unit(p.column(3).to_pylist(), d))
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), p.column(2), p.column(3), pa.array(own, pa.int32()), pa.array(probes, pa.list_(pa.int32())),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss)],
                    ["node", "size", "v", "list", "probes", "codes", "miss"])
    placed = materialize(reps.mapInArrow(put, "node bigint, size bigint, v binary, list int, probes array<int>, codes binary, miss double"))
    # at most MOST_LISTS rows
    length = {r.list: r.n for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = F.lit(1)
    split = {k: -(-v // BLOCK) for k, v in length.items() if v > BLOCK}
    if split:
        m = F.create_map(*[F.lit(x) for kv in split.items() for x in kv])
        parts = F.coalesce(F.element_at(m, F.col("at")), F.lit(1))
    columns = ["at", "block", "role", "node", "size", "v", "list", "probes", "codes", "miss"]
    stored = (placed.withColumn("at", F.col("list")).withColumn("role", F.lit(0))
              .withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int")).select(columns))
    asked = (placed.withColumn("at", F.explode("probes")).withColumn("role", F.lit(1))
             .withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
             .withColumn("probes", F.lit(None).cast("array<int>")).withColumn("codes", F.lit(None).cast("binary"))
             .select(columns))

    def scan(batches):
        import pyarrow as pa
        tile, held = None, None
        for b in batches:
            at, block, role = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for x, y in zip([0, *cut], [*cut, b.num_rows]):
                if x == y:
                    continue
                p = b.slice(x, y - x)
                if tile != (at[x], block[x]):
                    tile, held = (at[x], block[x]), None
                if role[x] == 0:
                    own = (p.column(3).to_numpy(), p.column(4).to_numpy(), _unit(p.column(5).to_pylist(), d),
                           np.frombuffer(b"".join(p.column(8).to_pylist()), np.uint8).reshape(p.num_rows, -1),
                           p.column(9).to_numpy(), p.column(7).to_pylist())
                    held = own if held is None else tuple(np.concatenate([u, w]) if isinstance(u, np.ndarray) else u + w
                                                          for u, w in zip(held, own))
                elif held is not None:
                    for k in range(0, p.num_rows, 512):
                        out = match(held, p.slice(k, 512), int(at[x]))
                        if out is not None:
                            yield out

    def match(held, p, owner):
        import pyarrow as pa
        node, size, v, codes, miss, probes = held
        qn, qs, qv, ql = p.column(3).to_numpy(), p.column(4).to_numpy(), _unit(p.column(5).to_pylist(), d), p.column(6).to_numpy()
        i, j = index.candidates(qv, owner, codes, miss)
        # a pair within one list is met twice; a pair of two lists too if both vectors probe the other's list
        fine = np.where(ql[i] == owner, qn[i] < node[j], True)
        i, j = i[fine], j[fine]
        fine = np.einsum("ij,ij->i", qv[i], v[j]) >= cosine
        i, j = i[fine], j[fine]
        back = np.array([ql[a] < owner and ql[a] in probes[b] for a, b in zip(i, j)], bool)
        i, j = i[~back], j[~back]
        if not len(i):
            return None
        names = np.unique(np.concatenate([qn[i], node[j]]))
        a, b = np.searchsorted(names, qn[i]), np.searchsorted(names, node[j])
        count = np.bincount(a, weights=size[j], minlength=len(names)) + np.bincount(b, weights=qs[i], minlength=len(names))
        root = np.arange(len(names))
        while True:
            least = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        edge = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([names, names[edge]])), pa.array(np.concatenate([count, np.zeros(len(edge))]).astype(np.int64)),
             pa.array(np.concatenate([np.zeros(len(names), np.int64), names[root[edge]]]),
                      mask=np.concatenate([np.ones(len(names), bool), np.zeros(len(edge), bool)]))], ["node", "n", "other"])

    rows = stored.unionByName(asked).repartition("at", "block").sortWithinPartitions("at", "block", "role")
    return rows.mapInArrow(scan, "node bigint, n bigint, other bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    members, reps = classes(vectors)
    spark = vectors.sparkSession
    found = None
    for (d,) in reps.select("d").distinct().collect():  # the dimensions that occur
        one = links(reps.where(F.col("d") == d), cosine)
        found = one if found is None else found.unionByName(one)
    found = spark.createDataFrame([], "node bigint, n bigint, other bigint") if found is None else materialize(found)
    count = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    least = members.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"))
    nodes = (reps.select("node", "size").join(least, "node").join(count, "node", "left").join(comp, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(ids, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    return (members.join(nodes, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
