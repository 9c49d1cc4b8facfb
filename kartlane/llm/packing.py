"""Operator 8, lexical retrieval packing.

1. A bounded sample of the documents gives at most ``PIVOTS`` pivots, numbered so
   that each is followed by one like it.
2. Each text is tokenised once into a table in the shared folder, together with
   the two pivots that its heaviest terms find by BM25; the same tasks add up
   document frequencies of all token ids (at most the vocabulary's size).
3. Rows in the order of their pivots are cut into shards of equal weight; rows
   that share both pivots are spread by a hash of their row number over as many
   shards as they fill. In a shard, a BM25
   inverted index over token ids returns the unused neighbours of each seed
   document, best first, which fill its window. The document that crosses the
   window's end is cut, and its rest seeds the next window.
4. What is left at a shard's end is cut into sequences of power-of-two lengths,
   so that no sequence needs padding.

``query_terms`` is the number of a seed's heaviest terms that make up its BM25
query. Defined results: a null text counts as empty and has the closing id
only; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, shared_dir

WINDOW, CLOSE = 4096, 2
WORDS = 250_000  # most words that a worker keeps from task to task, about 40 MB; those it used last stay
PIVOTS, SAMPLE, PIVOT_TERMS = 1024, 4096, 256  # most pivots, sampled documents and terms kept of each
POSTINGS = 1 << 20  # most index entries, and scores, that are added up at once
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


class Pivots:
    """Sampled documents by which the others are dealt to shards; ``sample``: ``(terms, counts)`` of each."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], most: int, vocabulary: int = 49_408):
        sample = list({t.tobytes() + c.tobytes(): (t, c) for t, c in sample}.values())  # copies would be one pivot
        df = np.zeros(vocabulary, np.int64)
        for t, _ in sample:
            df[t] += 1
        n = len(sample)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.idf[df == 0] = 0  # no pivot has them
        self.mean = max(1.0, sum(int(c.sum()) for _, c in sample) / max(n, 1))
        chosen = [sample[i] for i in np.linspace(0, n - 1, min(most, n)).astype(int)] if n else []
        self._index(chosen)
        order, left = [], np.ones(len(chosen), bool)
        at = 0
        while left.any():  # each pivot is followed by the most similar one that is left
            order.append(at)
            left[at] = False
            at = int(np.argmax(np.where(left, self._scores(*chosen[at]), -1)))
        self._index([chosen[i] for i in order])

    def _weights(self, terms, counts):
        norm = 1.2 * (0.25 + 0.75 * counts.sum() / self.mean)
        return self.idf[terms] * counts * np.float32(2.2) / (counts + np.float32(norm))

    def _index(self, chosen):
        self.n, parts = len(chosen), []
        for i, (t, c) in enumerate(chosen):
            w = self._weights(t, c)
            best = np.argsort(-w, kind="stable")[:PIVOT_TERMS]
            parts.append((t[best].astype(np.int64), np.full(len(best), i), w[best]))
        term, doc, weight = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order].astype(np.int32), weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(self.idf) + 1))

    def _scores(self, terms, counts, query_terms: int = 24):
        w, score = self._weights(terms, counts), np.zeros(self.n, np.float32)
        if len(w) > query_terms:
            terms = terms[np.argpartition(-w, query_terms)[:query_terms]]
        lists = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist()) if a < b]
        if lists:
            score += np.bincount(np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), self.n)
        return score

    def nearest(self, terms: np.ndarray, counts: np.ndarray, bound: np.ndarray, query_terms: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """The best and the second pivot of each document; ``n`` if it shares no heavy term with any.

        ``terms`` and ``counts`` hold all documents' distinct terms; ``bound`` is where each begins and ends.
        """
        size, out = np.diff(bound), np.full((2, len(bound) - 1), self.n)
        if not self.n or not len(terms):
            return out[0], out[1]
        total = np.add.reduceat(np.append(counts, 0), bound[:-1]) * (size > 0)
        norm = (1.2 * (0.25 + 0.75 * total / self.mean)).astype(np.float32)
        light = -(self.idf[terms] * counts * np.float32(2.2) / (counts + np.repeat(norm, size)))
        terms = terms.astype(np.int64)
        asked = [terms[a:b] if b - a <= query_terms else terms[a:b][np.argpartition(light[a:b], query_terms)[:query_terms]]
                 for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
        size = np.fromiter(map(len, asked), np.int64, len(asked))
        asked = np.concatenate(asked)
        first, length = self.start[asked], self.start[asked + 1] - self.start[asked]
        own = np.append(0, np.cumsum(size))             # where a document's query begins
        listed = np.append(0, np.cumsum(length))[own]   # and its postings
        x = 0
        while x < len(size):  # as many documents at once as have ``POSTINGS``
            y = max(x + 1, min(int(np.searchsorted(listed, listed[x] + POSTINGS, "right")) - 1, x + POSTINGS // self.n))
            a, b, k = own[x], own[y], length[own[x]:own[y]]
            at = np.repeat(first[a:b] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            doc = np.repeat(np.repeat(np.arange(y - x) * self.n, size[x:y]), k)
            score = np.bincount(doc + self.doc[at], self.weight[at], (y - x) * self.n).astype(np.float32).reshape(y - x, self.n)
            for o in out:
                best = score.argmax(1)
                found = score[np.arange(y - x), best] > 0
                o[x:y][found] = best[found]
                score[np.arange(y - x), best] = 0
            x = y
        return out[0], out[1]


def distinct(ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 16-bit ids of each text in order, how often each stands there, and where each text's begin and end."""
    d = len(bound) - 1
    wide = np.uint32 if d <= 1 << 16 else np.uint64
    key = np.repeat(np.arange(d, dtype=wide) << wide(16), np.diff(bound)) | ids.astype(wide)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + wide(1)) != 0)
    counts, key = np.diff(first, append=len(key)), key[first]
    return (key & wide(0xFFFF)).astype(np.uint16), counts, np.searchsorted(key >> wide(16), np.arange(d + 1))


def closed(ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, each text's followed by the closing one, and where each begins and ends."""
    to = bound + np.arange(len(bound))
    out = np.full(to[-1], CLOSE, "<u2")
    inner = np.ones(len(out), bool)
    inner[to[1:] - 1] = False
    out[inner] = ids
    return out, to


def pivots(docs: DataFrame, path: str, rows: int, shard_rows: int) -> Pivots:
    """Pivots from a sample of ``docs``; none where one shard holds all rows."""
    if rows <= shard_rows:
        return Pivots([], 0)

    def run(batches):
        import pyarrow as pa
        from .tokens import WordEncoder, encoder
        enc = encoder(WordEncoder, path, WORDS)
        for b in pieces(batches, text=0):
            ids, bound = enc.encode(b.column(0))
            out = []
            for x, y in zip(bound[:-1], bound[1:]):
                t, c = np.unique(ids[x:y], return_counts=True)
                top = np.sort(np.argsort(-c, kind="stable")[:8 * PIVOT_TERMS])
                out.append(np.stack([t[top].astype(np.int32), c[top].astype(np.int32)]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["terms"])

    some = docs.select("text").where("text is not null").sample(min(1.0, SAMPLE / rows), seed=17)
    found = [np.frombuffer(r.terms, np.int32).reshape(2, -1) for r in some.mapInArrow(run, "terms binary").limit(2 * SAMPLE).collect()]
    return Pivots([(x[0], x[1]) for x in found if x.shape[1]], min(PIVOTS, -(-4 * rows // shard_rows)))


def tokenise(docs: DataFrame, path: str, near: Pivots, vocabulary: int = 49_408) -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id, n, ids, p, q)`` with 16-bit ids and both pivots, and ``(term, df)``; both read from the shared folder."""
    def run(batches):
        import pyarrow as pa
        from .tokens import WordEncoder, encoder
        enc = encoder(WordEncoder, path, WORDS)
        df = np.zeros(vocabulary, np.int64)
        names = ["kind", "row", "doc_id", "n", "ids", "p", "q"]
        for b in pieces(batches, text=2):
            ids, bound = enc.encode(b.column(2))
            terms, counts, own = distinct(ids, bound)
            df += np.bincount(terms, minlength=vocabulary)
            df[CLOSE] += b.num_rows - np.count_nonzero(terms == CLOSE)  # each text has it at its end
            p, q = near.nearest(terms, counts, own)
            ids, bound = closed(ids, bound)
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * b.num_rows, pa.int32()), *b.columns[:2], pa.array(np.diff(bound), pa.int64()),
                 pa.array([raw[2 * x:2 * y] for x, y in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary()),
                 pa.array(p, pa.int32()), pa.array(q, pa.int32())], names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([1], pa.int32()), *[pa.array([None], pa.int64())] * 2, pa.array([0], pa.int64()),
             pa.array([df.tobytes()], pa.binary()), *[pa.array([0], pa.int32())] * 2], names)

    spark, where = docs.sparkSession, shared_dir(docs.sparkSession)
    schema = "row bigint, doc_id bigint, n bigint, ids binary, p int, q int"
    (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "kind int, " + schema)
     .write.partitionBy("kind").parquet(where))
    table = spark.read.schema(schema + ", kind int").parquet(where)

    def sums(batches):
        import pyarrow as pa
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    df = (table.where("kind = 1").select("ids").mapInArrow(sums, "term bigint, df bigint")
          .groupBy("term").agg(F.sum("df").alias("df")))
    return table.where("kind = 0").drop("kind"), df


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int = 24,
               k1: float = 1.2, b: float = 0.75) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard."""
    d = len(ids)
    sizes = np.array([len(x) for x in ids], np.int64)
    wide = np.uint32 if len(idf) * d < 1 << 32 else np.uint64
    key = np.concatenate([x.astype(wide) * wide(d) + wide(i) for i, x in enumerate(ids)])
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + wide(1)) != 0)
    tf = np.diff(first, append=len(key)).astype(np.float32)
    key = key[first]
    term, doc = (key // wide(d)).astype(np.int64), (key % wide(d)).astype(np.int64)
    norm = (k1 * (1 - b + b * sizes / max(mean_length, 1.0))).astype(np.float32)
    weight = idf[term] * tf * np.float32(k1 + 1) / (tf + norm[doc])
    start = np.searchsorted(term, np.arange(len(idf) + 1))
    # the heaviest terms of each document, as its query
    by_doc = np.lexsort((-weight, doc))
    own = np.searchsorted(doc[by_doc], np.arange(d + 1))
    unused, left = np.ones(d, bool), d
    pieces, seq, used, nxt = [], 0, 0, 0
    current, at = -1, 0
    while True:
        if current < 0:
            while nxt < d and not unused[nxt]:
                nxt += 1
            if nxt == d:
                break
            current, at = nxt, 0
            unused[nxt] = False
            left -= 1
        seed, queue = current, None
        while True:
            take = min(WINDOW - used, int(sizes[current]) - at)
            pieces.append((current, at, take, seq, used))
            at, used = at + take, used + take
            if at == sizes[current]:
                current = -1
            if used == WINDOW:
                seq, used = seq + 1, 0
                break
            if not left:
                break
            if queue is None:
                score = np.zeros(d, np.float32)
                for t in term[by_doc[own[seed]:min(own[seed + 1], own[seed] + query_terms)]]:
                    score[doc[start[t]:start[t + 1]]] += weight[start[t]:start[t + 1]]
                score[~unused] = -1
                need = min(left, 48)
                best = np.argpartition(-score, need - 1)[:need] if need < d else np.arange(d)
                best = best[np.lexsort((best, -score[best]))]
                queue = iter(best[score[best] >= 0].tolist())
            current = next(queue, -1)
            if current < 0:  # the neighbours found are used up: look again among the rest
                queue = None
                continue_from = np.flatnonzero(unused)
                if not len(continue_from):
                    break
                current = int(continue_from[0])
            unused[current], at = False, 0
            left -= 1
        if current < 0 and not left:
            break
    return _trim(pieces, seq, used)


def _trim(pieces, seq, used):
    """Cut the last, unfilled sequence into sequences of power-of-two lengths."""
    if not used:
        return pieces
    full = [p for p in pieces if p[3] != seq]
    room, filled = 1 << (used.bit_length() - 1), 0
    rest, last = used, [p for p in pieces if p[3] == seq]
    for doc, start, length, _, _ in last:
        while length:
            take = min(length, room - filled)
            full.append((doc, start, take, seq, filled))
            start, length, filled, rest = start + take, length - take, filled + take, rest - take
            if filled == room and rest:
                seq, filled, room = seq + 1, 0, 1 << (rest.bit_length() - 1)
    return full


def pack(docs: DataFrame, path: str, shard_rows: int = 2000, shard_tokens: int = 4_000_000) -> DataFrame:
    """All pieces of ``docs(doc_id, text)``; see the module's text."""
    table, df = tokenise(docs, path, pivots(docs, path, docs.count(), shard_rows))
    n, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.zeros(49_408, np.float32)
    for t, f in df.collect():  # one row per id of the vocabulary at most
        idf[t] = np.log1p((n - f + 0.5) / (f + 0.5))
    mean = total / max(n, 1)

    def run(group):
        import pyarrow as pa
        group = group.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        ids = [np.frombuffer(x, "<u2") for x in group.column("ids").to_pylist()]
        doc_id, shard = group.column("doc_id").to_pylist(), group.column("shard")[0].as_py()
        p = pack_shard(ids, idf, mean)
        crc = [zlib.crc32(ids[i][s:s + k].astype("<u4").tobytes()) for i, s, k, _, _ in p]
        cols = [[doc_id[x[0]] for x in p], [x[1] for x in p], [x[2] for x in p], crc, [len(ids[x[0]]) for x in p],
                [(shard << 32) + x[3] for x in p], [x[4] for x in p]]
        return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(SCHEMA.split(", "), cols)})

    return dealt(table, shard_rows, shard_tokens).groupBy("shard").applyInArrow(run, SCHEMA)


def dealt(table: DataFrame, shard_rows: int, shard_tokens: int) -> DataFrame:
    """``(doc_id, n, ids, shard)``: the rows in the order of their pivots, cut into shards of equal weight."""
    weight = F.greatest(F.lit(1 / shard_rows), F.col("n") / shard_tokens)
    # at most (PIVOTS + 1) ** 2 cells, which are small enough to broadcast at any size of the table
    cells = materialize(table.groupBy("p", "q").agg(F.sum(weight).alias("w")))
    at, first = 0.0, []
    for r in cells.groupBy("p").agg(F.sum("w").alias("w")).orderBy("p").collect():
        first.append((r.p, at))
        at += r.w
    shards = max(1, int(np.ceil(at - 1e-6)))
    first = table.sparkSession.createDataFrame(first, "p int, first double")
    before = F.sum("w").over(Window.partitionBy("p").orderBy("q")) - F.col("w")
    cells = materialize(cells.join(F.broadcast(first), "p").select("p", "q", "w", (F.col("first") + before).alias("from")))
    spread = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)
    shard = F.floor((F.col("from") + F.col("w") * spread) * (shards / max(at, 1e-9))).cast("long")
    return table.join(F.broadcast(cells), ["p", "q"]).select(
        "doc_id", "n", "ids", F.least(shard, F.lit(shards - 1).cast("long")).alias("shard"))
