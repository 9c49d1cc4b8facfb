"""Operator 3, n-gram Jaccard join over documents.

Every link ``|A & B| * den >= num * |A | B|`` between the word-shingle sets of
two texts is found; nothing is sampled, capped or approximated.

1. Texts become sets of 64-bit shingle hashes. Equal sets are one class (node).
2. Size bands: a pair can only link if its sizes are within ``num/den``. In a
   band two linked sets differ in at most D shingles, so of more than D hash
   ranges one at least holds the same shingles in both. A set's key per range is
   the hash of all it holds there. A set that differs from no partner in more
   than d shingles emits its non-empty ranges, and the empty ones too if it has
   no more than d non-empty ones, so no pair is lost.
   Of f > d non-empty ranges f - d at least are equal in a partner. With all keys
   in one order by how many sets hold them, the rarest key of a linked pair is
   never among the f - d - 1 most common ones of either set, so these count for
   nothing: what many texts hold, or a few ranges alone, ties no sets together.
3. Sets that share a key, and those that share one with them, form a cluster.
   A cluster is a tile; one of more than ``BLOCK`` sets or ``SHINGLES`` shingles is
   cut into size bands and these into blocks, with a tile for each two blocks of
   a band and for what two neighbouring bands hold within reach of their border.
   A task holds two blocks at most.
4. Tiles of hashed bitmaps come first: the bits of A that B lacks bound the
   overlap from above. Sets that no other set can reach by that bound are done.
5. The sets that are left meet in tiles again, with finer bitmaps and their
   sorted shingles: what the bound lets through is decided by exact sorted-array
   intersection. Sets known to be of one component are not compared again, and
   only a spanning forest of the links leaves a tile.

Every row gets a key of its own in a written table, and a set is read again by
the key of one of its rows, so ids may repeat or be null.

Defined results: null, empty and blank texts have no shingles and link with
nothing; a text with fewer words than a shingle is one shingle; repeated rows
and ids, and rows without an id, are rows of their own; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, materialize, mix, pieces, texts_of, tidy, word_hashes

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
BROADCAST_ROWS = 200_000  # sets whose place (about 100 bytes) may be broadcast; beyond, a shuffled join
BLOCK, SHINGLES = 4096, 1_500_000  # sets and shingles (12 MB) of a block
MANY = 1 << 16  # keys of so many sets or more are equally common
COARSE, FINE = 4, 16  # bits of a bitmap for each shingle, up to twice as many


def shingle_set(raw, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    h = word_hashes(raw)
    if not len(h):
        return h
    if len(h) < words:
        return mix(np.array([(h * (2 * np.arange(len(h), dtype=np.uint64) + np.uint64(3))).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - words + 1
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s += h[j:j + n] * _MUL[j % 8] * np.uint64(2 * (j // 8) + 1)
    return np.unique(mix(s))


def node_of(s: np.ndarray) -> int:
    """The identity of a set."""
    return int(mix(mix(s + _MUL[3]).sum(keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


class Bands:
    """Size bands, the largest difference of a linked pair in each, and the number of hash ranges."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.upper = num, den, [1]

    def _grow(self, size: int) -> None:
        while self.upper[-1] < size:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * 8 // 5))

    def of(self, size: int) -> range:
        """Bands in which a set of this size may be the smaller or the larger of a linked pair."""
        self._grow(size)
        low = -(-self.num * size // self.den)
        a, b = np.searchsorted(self.upper, [low, size])
        return range(int(a), int(b) + 1)

    def difference(self, band: int) -> int:
        """A pair of sizes a <= U, b <= a*den/num has at least (a+b)*num/(num+den) shingles in common."""
        u = self.upper[band]
        return (self.den - self.num) * (u + u * self.den // self.num) // (self.num + self.den)

    def own_difference(self, band: int, size: int) -> int:
        """The same for a set of this size: its partner is larger by den/num at most, or in the band of a smaller one."""
        u = self.upper[band]
        return (self.den - self.num) * (size + (size * self.den // self.num if size <= u else u)) // (self.num + self.den)


def range_keys(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int]]:
    """The keys of one non-empty set in all its bands, the band in the first byte, and ``band << 32 | keys that need not count``."""
    content = np.concatenate([[np.uint64(0)], np.cumsum(mix(s + _MUL[1]), dtype=np.uint64)])
    high, out, spare = s >> np.uint64(32), [], []
    for band in bands.of(len(s)):
        d = bands.difference(band)
        k = 1 if d == 0 else d + 1 + max(2, -(-(d + 1) // 10))
        cut = np.searchsorted((high * np.uint64(k)) >> np.uint64(32), np.arange(k + 1))
        key = mix((content[cut[1:]] - content[cut[:-1]]) * _MUL[2] + mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 40)))
        key = (key >> np.uint64(8)) | np.uint64(band << 56)
        full = cut[1:] > cut[:-1]
        more = int(full.sum()) - bands.own_difference(band, len(s))
        out.append(key[full] if more > 0 else key)
        spare.append(band << 32 | max(0, more - 1))
    return np.concatenate(out), spare


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bitmap of a set, in 64-bit words; ``bits`` is a power of two."""
    b = np.zeros(bits, bool)
    b[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(b, bitorder="little").view(np.uint64)


def width(shingles: int, each: int) -> int:
    return max(256, 1 << int(each * shingles - 1).bit_length())


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """The bitmap folded to fewer words; the low bits of a hash are its place."""
    return np.bitwise_or.reduce(b.reshape(-1, words), axis=0) if len(b) > words else b


def overlap_bound(maps: np.ndarray, n: np.ndarray, x: int, y: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of set ``x`` with each of ``y``: a set bit that the other lacks is a shingle it lacks."""
    other = maps[y]
    return np.minimum(n[x] - np.bitwise_count(maps[x] & ~other).sum(1, dtype=np.int64),
                      n[y] - np.bitwise_count(other & ~maps[x]).sum(1, dtype=np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, text)`` of every row, written once: the key is the row's own."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))


def signatures(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(key, doc_id, node, n, keys, spare)``; node null without shingles, keys on a set's first row of a task."""
    def run(batches):
        import pyarrow as pa
        bands, seen = Bands(num, den), set()
        for b in pieces(batches):
            ids, at = b.columns[:2], 0
            rows = []
            for t in texts_of(b.column(2)):
                s = shingle_set(t, words)
                if not len(s):
                    rows.append((None, 0, None, None))
                    continue
                node = node_of(s)
                if node in seen:
                    rows.append((node, len(s), None, None))
                else:
                    if len(seen) < 1_000_000:  # else a set may be sent once more, which changes nothing
                        seen.add(node)
                    keys, spare = range_keys(s, bands)
                    rows.append((node, len(s), keys.view(np.int64), spare))
                if len(rows) == 2000:
                    yield _rows([c.slice(at, 2000) for c in ids], rows)
                    at, rows = at + 2000, []
            yield _rows([c.slice(at, len(rows)) for c in ids], rows)

    def _rows(ids, rows):
        import pyarrow as pa
        node, n, keys, spare = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [*ids, pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
             pa.array(spare, pa.list_(pa.int64()))], ["key", "doc_id", "node", "n", "keys", "spare"])

    return rows.select("key", "doc_id", "text").mapInArrow(
        run, "key bigint, doc_id bigint, node bigint, n bigint, keys array<bigint>, spare array<bigint>")


def shared_keys(sig: DataFrame) -> DataFrame:
    """``(key, node, sets)``: the keys that several sets hold, and how many do, as far as ``MANY``."""
    many = MANY

    def run(batches):
        import pyarrow as pa
        # the sets of the last key so far; where these are many and told already, the last of them
        key, node, told = np.empty(0, np.int64), np.empty(0, np.int64), False
        for b in itertools.chain(batches, [None]):
            if b is not None:
                key, node = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([node, b.column(1).to_numpy()])
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[new], node[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rows = np.diff(start, append=len(key))
            sets = np.minimum(rows, many)
            if told:
                sets[0] = many
            give = np.repeat(sets > 1, rows)
            give[0] &= not told
            told = bool(sets[-1] == many)
            if b is not None and not told:
                give[start[-1]:] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[give]), pa.array(node[give]), pa.array(np.repeat(sets, rows)[give])],
                                             ["key", "node", "sets"])
            at = len(key) - 1 if told else start[-1]
            key, node = key[at:], node[at:]

    rows = sig.where("keys is not null").select("node", F.explode("keys").alias("key")).select("key", "node")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint, sets bigint")


def ties(shared: DataFrame, sig: DataFrame) -> DataFrame:
    """``(a, b)``: the first set of each key that counts for several sets, with each of the others."""
    def run(batches):
        import pyarrow as pa
        key0 = first0 = None
        for b in batches:
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            same = np.concatenate([[key0 is not None and key[0] == key0], key[1:] == key[:-1]])
            run_of = np.cumsum(~same)  # 0: the run that goes on from the batch before
            first = np.concatenate([[first0 if first0 is not None else 0], node[~same]])[run_of]
            yield pa.RecordBatch.from_arrays([pa.array(first[same]), pa.array(node[same])], ["a", "b"])
            key0, first0 = key[-1], first[-1]

    spare = sig.where("spare is not null").select("node", F.explode("spare").alias("s"))
    spare = spare.select("node", F.shiftright("s", 32).alias("band"), F.col("s").bitwiseAND((1 << 32) - 1).alias("spare")).distinct()
    rank = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("sets"), F.desc("key")))  # of one set's keys
    rows = (shared.withColumn("band", F.shiftrightunsigned("key", 56)).join(spare, ["node", "band"])
            .withColumn("rank", rank).where("rank > spare").select("key", "node"))
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def members(sig: DataFrame, edges: DataFrame) -> DataFrame:
    """``(key, node, cluster, n)``: a row for each set that shares a range key with another."""
    return materialize(sig.where("first").join(components(edges), "node").groupBy("node")
                       .agg(F.min("key").alias("key"), F.first("component").alias("cluster"), F.first("n").alias("n")))


def place(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``(key, node, cluster, own, tiles)``: each member's block and the tiles ``(i, j)`` it is needed in."""
    large = (rows.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
             .where((F.col("sets") > BLOCK) | (F.col("shingles") > SHINGLES)).select("cluster", F.lit(True).alias("large")))
    band = F.floor(F.log2("n")).cast("long")
    rows = rows.join(large, "cluster", "left").withColumn("band", F.when(F.col("large"), band).otherwise(0))
    parts = rows.groupBy("cluster", "band").agg(
        F.when(F.first("large"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES))).otherwise(1)
        .cast("long").alias("parts"))
    edge = F.pow(F.lit(2), F.col("band")).cast("long")  # the least size of the band
    rows = rows.join(parts, ["cluster", "band"]).select(
        "key", "node", "cluster", (F.col("band") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("own"),
        F.explode(F.array_compact(F.array(
            F.lit("same"), F.when(F.col("large") & (F.col("n") * den >= 2 * edge * num), F.lit("high")),
            F.when(F.col("large") & (F.col("n") * num < edge * den), F.lit("low"))))).alias("role"))
    block = parts.select("cluster", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    block = block.select("cluster", "band", (F.col("band") * (1 << 32) + F.col("part")).alias("own"))
    x, y = block.alias("x"), block.alias("y")
    met = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("y.own") >= F.col("x.own"))
                 & (F.col("y.band") - F.col("x.band") <= 1)).select(
        "x.cluster", F.struct(F.col("x.own").alias("i"), F.col("y.own").alias("j")).alias("tile"),
        (F.col("x.band") == F.col("y.band")).alias("within"))
    of = (met.select("cluster", F.col("tile.i").alias("own"), F.when(F.col("within"), "same").otherwise("high").alias("role"), "tile")
          .unionByName(met.where("tile.i <> tile.j").select(
              "cluster", F.col("tile.j").alias("own"), F.when(F.col("within"), "same").otherwise("low").alias("role"), "tile")))
    return materialize(rows.join(of, ["cluster", "own", "role"]).groupBy("node", "key", "cluster", "own")
                       .agg(F.collect_list("tile").alias("tiles")))


def in_tiles(rows: DataFrame, placed: DataFrame, words: int, payload, compare, schema: str) -> DataFrame:
    """``compare(within, own, node, payloads)`` for every tile, ``payload(set)`` being what a set is sent as."""
    few = placed.count() <= BROADCAST_ROWS

    def load(batches):
        import pyarrow as pa
        for b in pieces(batches):
            sets = [payload(shingle_set(t, words)).tobytes() for t in texts_of(b.column(4))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sets, pa.binary())],
                                             ["node", "cluster", "own", "tiles", "s"])

    def run(batches):
        held = []  # slices of the tile that is being read
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), b.num_rows]
            for x, y in zip(cut[:-1], cut[1:]):
                if held and tuple(k[x]) != held[0][0]:
                    yield from emit(held)
                    held = []
                held.append((tuple(k[x]), b.slice(x, y - x)))
        if held:
            yield from emit(held)
        held = None
        tidy()

    def emit(held):
        import pyarrow as pa
        t = pa.Table.from_batches([b for _, b in held])
        found = compare(held[0][0][1] == held[0][0][2], t.column(3).to_numpy(), t.column(4).to_numpy(),
                        [np.frombuffer(s, np.uint64) for s in t.column(5).to_pylist()])
        if len(found) and len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in found], [x.split()[0] for x in schema.split(", ")])

    texts = rows.select("key", "text").join(F.broadcast(placed) if few else placed, "key")
    sets = texts.select("node", "cluster", "own", "tiles", "text").mapInArrow(
        load, "node bigint, cluster bigint, own bigint, tiles array<struct<i: bigint, j: bigint>>, s binary")
    sent = sets.select("cluster", F.explode("tiles").alias("t"), "own", "node", "s").select("cluster", "t.i", "t.j", "own", "node", "s")
    return sent.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, schema)


def reachable(rows: DataFrame, placed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(node)``: the sets that by the bound of a coarse bitmap may link with another set of their cluster."""
    def payload(s):
        return np.concatenate([[np.uint64(len(s))], bitmap(s, width(len(s), COARSE))])

    def compare(within, own, node, sent):
        n = np.array([int(x[0]) for x in sent])
        order = np.argsort(n, kind="stable")
        n, node, own, maps = n[order], node[order], own[order], [sent[k][1:] for k in order]
        hit, at = np.zeros(len(n), bool), 0
        while at < len(n):  # rows whose partners have bitmaps of one width and the next
            words_ = len(maps[at])
            end = at + next((k for k, m in enumerate(maps[at:]) if len(m) > words_), len(n) - at)
            to = int(np.searchsorted(n, n[end - 1] * den // num, side="right"))
            table = np.stack([fold(m, words_) for m in maps[at:to]])
            sizes = n[at:to]
            for x in range(end - at):
                y = np.arange(x + 1, int(np.searchsorted(sizes, sizes[x] * den // num, side="right")))
                y = y[(node[at + y] != node[at + x]) & (within | (own[at + y] != own[at + x]))]
                if len(y):
                    fine = overlap_bound(table, sizes, x, y) * (num + den) >= num * (sizes[x] + sizes[y])
                    hit[at + y[fine]] = True
                    hit[at + x] |= fine.any()
            at = end
        return [node[hit]]

    return in_tiles(rows, placed, words, payload, compare, "node bigint").distinct()


def links(rows: DataFrame, placed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: a spanning forest of the linked sets of every tile."""
    def compare(within, own, node, sets):
        n = np.array([len(s) for s in sets])
        order = np.argsort(n, kind="stable")
        sets, n, node, own = [sets[k] for k in order], n[order], node[order], own[order]
        bits = width(int(n[-1]), FINE)
        while bits > 512 and bits // 8 * len(n) > 24 << 20:
            bits //= 2
        maps, root, found = np.stack([bitmap(s, bits) for s in sets]), np.arange(len(n)), []
        for x in range(len(n) - 1):
            y = np.arange(x + 1, int(np.searchsorted(n, n[x] * den // num, side="right")))  # size band of the smaller set
            y = y[(root[y] != root[x]) & (within | (own[y] != own[x]))]
            if not len(y):
                continue
            bound = overlap_bound(maps, n, x, y)
            least = -(-num * (n[x] + n[y]) // (num + den))  # common shingles that a link needs
            for k in np.flatnonzero(bound >= least):
                if root[y[k]] != root[x] and len(np.intersect1d(sets[x], sets[y[k]], assume_unique=True)) >= least[k]:
                    root[root == root[y[k]]] = root[x]
                    found.append((node[x], node[y[k]]))
        return list(zip(*found))

    return in_tiles(rows, placed, words, lambda s: s, compare, "a bigint, b bigint").where("a <> b")


def grouped(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(key, doc_id, n_shingles, component)`` of ``keyed`` rows; rows without shingles have no component."""
    whole = materialize(signatures(rows, words, num, den))
    shared = materialize(shared_keys(whole))
    edges = materialize(ties(shared, whole))
    # the range keys, most of the table, have done their work; what is written from here on takes their place on disk
    sig = materialize(whole.select("key", "doc_id", "node", "n", F.col("keys").isNotNull().alias("first")))
    discard(whole, shared)
    found = members(sig, edges)
    discard(edges)
    placed = place(found, num, den)
    left = materialize(reachable(rows, placed, words, num, den))
    discard(placed)
    placed = place(found.join(left, "node", "left_semi"), num, den)
    linked = materialize(links(rows, placed, words, num, den))
    discard(found, left, placed)
    comp = components(linked)
    discard(linked)
    return (sig.join(comp, "node", "left")
            .select("key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; the least id reachable by links, itself included."""
    found = grouped(keyed(docs), words, num, den)
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (found.join(least, "component", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def first_rows(rows: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(key)`` of the ``keyed`` rows to keep: of each group the least id (a null one last), and every row without shingles."""
    found = materialize(grouped(rows, words, num, den))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    return (found.where("component is not null").groupBy("component").agg(first).select("first.key")
            .unionByName(found.where("component is null").select("key")))
