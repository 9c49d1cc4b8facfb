"""Operator 9, toxicity by class-conditional Kneser-Ney models.

A word is generated from its start: its first 4 bytes, then its first 5 given
those, and so on up to 8, then the whole word. Two such models, toxic and ordinary, are interpolated with absolute discounting on a bounded, balanced
sample of labelled rows (at most ``per_class`` documents a class). Every step
backs off to counts that both classes share: the first to the counts over *all*
documents, the others to continuation counts (distinct words) of both classes.
Rare expressions (in fewer than ``MIN_COUNT`` documents of either class) have nothing but
the shared part, so they speak for neither side, while a rare form of a
frequent stem still speaks through its stem. Ratios are drawn towards 0 by two
standard errors of their document counts. A document's distinct words count once each,
in training and in scoring, so loops of one word weigh no more than the word.

A document's features are its mean log-likelihood ratio per distinct word, the
highest mean of any window of ``WINDOW`` of them, and the mean of its ``TOP``
highest. A logistic curve, fitted on
sample rows that the counts did not see, turns them into a probability at the
labels' own class share.

Defined results: null and empty texts have no words, so ratios of 0, and get a
score like any other; repeated rows are scored each; without labels of both
classes every row gets the class share. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import labelled_sample, logistic, materialize, pieces, sigmoid, text_column, texts_of, word_hashes

WINDOW, STEP, TOP = 32, 16, 4
PREFIXES = (4, 5, 6, 7, 8)
MIN_COUNT, DISCOUNT = 8, 0.75


def _distinct(text) -> np.ndarray:
    """Hash rows of a text's distinct words, in the order of their first appearance."""
    h = word_hashes(text, True, PREFIXES)
    _, first = np.unique(h[-1], return_index=True)
    return h[:, np.sort(first)]


def _grams(sample: DataFrame) -> DataFrame:
    """Units of every level: ``(y, level, h, up, n, d)``, ``n`` distinct words of a document summed, ``d`` documents."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            parts: dict = {}
            for y, t in zip(batch.column(1).to_pylist(), texts_of(batch.column(0))):
                h = _distinct(t).view(np.int64)
                for i in range(len(h)):
                    u, at, n = np.unique(h[i], return_index=True, return_counts=True)
                    parts.setdefault((y, i), []).append(np.stack([u, h[max(i - 1, 0)][at], n]))
            for (y, i), rows in parts.items():
                h, up, n = np.concatenate(rows, axis=1)
                u, at, back, d = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                n = np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)
                cols = [np.full(len(u), y, np.int64), np.full(len(u), i, np.int64), u, up[at], n, d.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["y", "level", "h", "up", "n", "d"])
    schema = "y bigint, level bigint, h bigint, up bigint, n bigint, d bigint"
    return (sample.select("text", "y").mapInArrow(run, schema).groupBy("y", "level", "h")
            .agg(F.first("up").alias("up"), F.sum("n").alias("n"), F.sum("d").alias("d")))


class Model:
    """Sorted unit hashes and log-likelihood ratios (last entry: any other unit, 0) of each step."""

    def __init__(self, steps: list[tuple[np.ndarray, np.ndarray]]):
        self.steps = steps

    def features(self, text) -> tuple[float, float, float]:
        h = _distinct(text)
        n = h.shape[1]
        if not n:
            return 0.0, 0.0, 0.0
        total = np.zeros(n + 1)
        for units, (known, ratio) in zip(h, self.steps):
            if len(known):
                at = np.minimum(np.searchsorted(known, units), len(known) - 1)
                total[1:] += np.where(known[at] == units, ratio[at], 0.0)
        top = float(np.partition(total[1:], n - TOP)[n - TOP:].sum() if n > TOP else total.sum()) / TOP
        total = np.cumsum(total)
        if n <= WINDOW:
            return total[-1] / n, total[-1] / WINDOW, top
        lo = np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)
        return total[-1] / n, float((total[lo + WINDOW] - total[lo]).max()) / WINDOW, top


def _step(rows: np.ndarray, docs: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Log ratios of units; ``rows``: for class 1, then 0, the unit's count, its context's count and types;
    ``docs``: in how many documents of each class the unit occurs."""
    out = []
    for n, of, types in (rows[:, 0:3].T, rows[:, 3:6].T):
        kept = np.minimum(1.0, DISCOUNT * types / np.maximum(of, 1)) + (of == 0)
        out.append(np.maximum(n - DISCOUNT, 0) / np.maximum(of, 1) + np.minimum(kept, 1.0) * shared)
    ratio = np.log(np.maximum(out[0], 1e-12) / np.maximum(out[1], 1e-12))
    error = 2 * np.sqrt(1 / (docs[:, 0] + 0.5) + 1 / (docs[:, 1] + 0.5))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - error, 0)


def _sorted(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Collected rows in the order of their first column, a hash, and those hashes."""
    rows = np.array([tuple(r) for r in df.collect()], np.int64).reshape(-1, width)
    rows = rows[np.argsort(rows[:, 0].view(np.uint64))]
    return rows[:, 0].copy().view(np.uint64), rows[:, 1:]


def estimate(docs: DataFrame, grams: DataFrame) -> Model:
    """The ratios of all units that occur ``MIN_COUNT`` times in a class; what is collected is bounded by the sample."""
    def both(name, alias):
        return [F.sum(F.when(F.col("y") == y, F.col(name)).otherwise(0)).alias(f"{alias}{y}") for y in (1, 0)]

    def unit(i):
        """Counts of a level's units in both classes, and how many units of the next level follow them."""
        after = (grams.where(F.col("level") == i + 1).groupBy(F.col("up").alias("h"))
                 .agg(F.count_if(F.col("y") == 1).alias("k1"), F.count_if(F.col("y") == 0).alias("k0"),
                      F.countDistinct(F.col("h")).alias("k")))
        own = (grams.where(F.col("level") == i).groupBy("h")
               .agg(F.first("up").alias("up"), *both("n", "n"), *both("d", "d")).join(after, "h", "left").fillna(0))
        return own.where(F.greatest("d1", "d0") >= MIN_COUNT)

    level = materialize(unit(0))
    top = (grams.where("level = 0").groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect())
    total_of, types_of = {r.y: r.n for r in top}, {r.y: r.k for r in top}
    known, rows = _sorted(level.select("h", "n1", "n0", "d1", "d0"), 5)
    count, total = shared_counts(docs, known)
    one = np.ones(len(rows))
    table = np.stack([rows[:, 0], total_of.get(1, 0) * one, types_of.get(1, 0) * one,
                      rows[:, 1], total_of.get(0, 0) * one, types_of.get(0, 0) * one], 1)
    steps = [(known, _step(table, rows[:, 2:], (count + 0.5) / (total + 0.5 * max(len(known), 1))))]
    for i in range(1, len(PREFIXES) + 1):
        # contexts of frequent units are frequent; their number is bounded by the sample
        above = F.broadcast(level.select(F.col("h").alias("up"), F.col("n1").alias("o1"), F.col("n0").alias("o0"),
                                         F.col("k1"), F.col("k0"), F.col("k")))
        level = materialize(unit(i))
        known, rows = _sorted(level.drop("k1", "k0", "k").join(above, "up")
                              .select("h", "n1", "o1", "k1", "n0", "o0", "k0", "d1", "d0", "k"), 10)
        steps.append((known, _step(rows[:, :6], rows[:, 6:8], 1 / np.maximum(rows[:, 8], 1))))
    return Model(steps)


def shared_counts(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each listed stem occurs in all documents, and the number of all words."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(len(known) + 1, np.int64)
        for b in pieces(batches):
            for t in texts_of(b.column(0)):
                h = _distinct(t)[0]
                if len(h) and len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    total += np.bincount(np.where(known[at] == h, at, len(known)), minlength=len(total))
                else:
                    total[-1] += len(h)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["w", "n"])
    out = np.zeros(len(known) + 1)
    for w, n in docs.select("text").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n")).collect():
        out[w] = n  # one row per listed stem
    return out[:-1], int(out.sum())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, held: int = 0,
          per_class: int = 3000) -> tuple[Model | None, np.ndarray]:
    """Model and logistic coefficients (mean ratio, highest window, highest words, intercept)."""
    sample = labelled_sample(docs, labels, label, fold, held, per_class)
    found = {r.y: r for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.max("share").alias("share")).collect()}
    if len(found) < 2:
        share = next((r.share for r in found.values()), 0.5)
        p = min(max(share, 1e-3), 1 - 1e-3)
        return None, np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))])
    share = found[1].share
    # a third for the curve; of the rest as many of one class as of the other
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3000))
    few = min(found[0].n, found[1].n)
    limit = F.when(F.col("y") == 1, int(2000 * few / found[1].n)).otherwise(int(2000 * few / found[0].n))
    model = estimate(docs, materialize(_grams(sample.where(part < limit))))
    got = features(sample.where(part >= 2000), model, ["y"]).collect()
    x = np.array([[r.mean, r.peak, r.top] for r in got]).reshape(-1, 3)
    y = np.array([r.y for r in got], float)
    if len(set(y)) < 2:
        return model, np.array([0.0, 0.0, 2.0, np.log(share / (1 - share))])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return model, logistic(x, y, weight, ridge=1e-3)


def features(rows: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the three ratios of each whole text; ``text`` may be a field of a kept struct."""
    schema = StructType([rows.schema[k] for k in keep] + [StructField(c, DoubleType()) for c in ("mean", "peak", "top")])

    def run(batches):
        import pyarrow as pa
        for b in pieces(batches):
            f = np.array([model.features(t) for t in texts_of(text_column(b, text))], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(f[:, i]) for i in range(3))],
                                             [*keep, "mean", "peak", "top"])
    return rows.select(*dict.fromkeys([*keep, text.split(".")[0]])).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None, coef: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``."""
    if model is None:
        return docs.select(*keep, F.lit(float(sigmoid(coef[-1]))).alias("score"))
    z = sum((F.col(c) * float(a) for c, a in zip(("mean", "peak", "top"), coef)), F.lit(float(coef[-1])))
    z = F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))
    return features(docs, model, keep, text).select(*keep, (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model, coef = train(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model, coef, ["doc_id"]).select("doc_id", held.alias("held_out"), "score",
                                                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
