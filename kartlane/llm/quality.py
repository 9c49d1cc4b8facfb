"""Operator 6, quality: a byte-level convolutional network in numpy.

``FILTERS`` learned filters of ``WIDTH`` bytes slide over the text in steps of
``STRIDE``; beside the bytes they see one channel that tells whether the next
eight bytes also stand 2 to 24 bytes earlier (looping text). Outputs are
max-pooled over overlapping chunks of ``CHUNK`` bytes that cover the whole
document, and one unit turns each chunk's maxima into a logit. A document's
probability is a logistic curve over the mean and the highest chunk logit.

Training: at most ``per_class`` labelled documents of each class, four evenly
spaced chunks of each, Adam on the logistic loss, on the driver (a few MB).
Scoring: every byte of every document, in Arrow tasks, in blocks of bounded size.

Defined results: null and empty texts are one chunk of zero bytes; repeated rows
are scored each; without labels of both classes all rows get the class share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import labelled_sample, logistic, pieces, sigmoid, text_column, texts_of

FILTERS, WIDTH, STRIDE, CHUNK = 16, 8, 4, 512
HALF = CHUNK // 2 // STRIDE  # positions in half a chunk
LAGS = range(2, 25)
PAD = 32  # zero bytes before a text
BLOCK = 1 << 19  # bytes convolved at once


def _positions(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every window, one row per position, and the loop channel; ``b`` has PAD bytes of context in front."""
    n = max(1, (len(b) - PAD - WIDTH) // STRIDE + 1)
    b = np.concatenate([b, np.zeros(max(0, PAD + (n - 1) * STRIDE + WIDTH + 4 - len(b)), np.uint8)])
    view = [np.frombuffer(b[r:len(b) - (len(b) - r) % 4].tobytes(), "<u4") for r in range(4)]
    lo, hi = view[0][PAD // 4:PAD // 4 + n], view[0][PAD // 4 + 1:PAD // 4 + 1 + n]
    loop = np.zeros(n, bool)
    for k in LAGS:
        at = PAD - k
        v = view[at % 4]
        loop |= (v[at // 4:at // 4 + n] == lo) & (v[at // 4 + 1:at // 4 + 1 + n] == hi)
    loop &= lo != 0
    return np.stack([b[PAD + j:PAD + j + (n - 1) * STRIDE + 1:STRIDE] for j in range(WIDTH)], 1), loop


class Net:
    """Weights: ``table[j, byte, f]``, ``loop[f]``, ``bias[f]``, ``out[f]`` and ``out0``."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.loop = r.normal(0, 0.5, FILTERS).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.5, FILTERS).astype(np.float32)
        self.out0 = np.zeros(1, np.float32)

    def respond(self, x: np.ndarray, loop: np.ndarray) -> np.ndarray:
        """Filter outputs of byte windows ``(..., WIDTH)``."""
        h = np.take(self.table[0], x[..., 0], axis=0)
        for j in range(1, WIDTH):
            h += np.take(self.table[j], x[..., j], axis=0)
        h += loop[..., None] * self.loop
        return h

    def chunk_logits(self, text: np.ndarray) -> np.ndarray:
        """One logit per chunk; chunks overlap by half and cover all of the text."""
        step, most = HALF * STRIDE, []
        for at in range(0, max(len(text), 1), BLOCK):
            front = text[max(0, at - PAD):at]
            b = np.concatenate([np.zeros(PAD - len(front), np.uint8), front, text[at:at + BLOCK + WIDTH - STRIDE]])
            h = self.respond(*_positions(b))
            most.append(np.maximum.reduceat(h, np.arange(0, len(h), step // STRIDE), axis=0))
        half = np.concatenate(most)
        if len(half) > 1:
            half = np.maximum(half[1:], half[:-1])
        return np.maximum(half + self.bias, 0) @ self.out + self.out0[0]

    def fit(self, x: np.ndarray, loop: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.02):
        """Adam; max-pooling passes each filter's gradient to one window of the chunk only."""
        r = np.random.default_rng(5)
        names = ["table", "loop", "bias", "out", "out0"]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        s = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, f = 0, np.arange(FILTERS)
        for epoch in range(epochs):
            order = r.permutation(len(x))
            lr = rate * (1 - epoch / epochs) + 1e-4
            for at in range(0, len(x), batch):
                i = order[at:at + batch]
                h = self.respond(x[i], loop[i])
                best = h.argmax(1)
                top = np.take_along_axis(h, best[:, None, :], 1)[:, 0] + self.bias
                act = np.maximum(top, 0)
                dz = ((sigmoid(act @ self.out + self.out0[0]) - y[i]) / len(i)).astype(np.float32)
                dh = dz[:, None] * self.out * (top > 0)
                g = {"out": act.T @ dz, "out0": dz.sum(keepdims=True), "bias": dh.sum(0),
                     "loop": (dh * np.take_along_axis(loop[i], best, 1)).sum(0)}
                won = x[i][np.arange(len(i))[:, None], best]  # batch, filter, byte
                cell = (np.arange(WIDTH) * 256 + won) * FILTERS + f[:, None]
                g["table"] = np.bincount(cell.ravel(), weights=np.repeat(dh.ravel(), WIDTH), minlength=self.table.size
                                         ).astype(np.float32).reshape(self.table.shape) + 2e-5 * self.table
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] * g[k]
                    getattr(self, k)[...] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 3, held: int = 1,
          per_class: int = 1500, chunks: int = 4) -> tuple[Net | None, np.ndarray]:
    """Network and logistic coefficients (mean chunk logit, highest, lowest, intercept)."""
    sample = labelled_sample(docs, labels, label, fold, held, per_class)
    share, classes = sample.agg(F.max("share"), F.countDistinct("y")).first()
    if classes < 2:
        p = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
        return None, np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))])

    def cut(batches):
        import pyarrow as pa
        for b in batches:
            y, out = [], []
            for v, t in zip(b.column(1).to_pylist(), texts_of(b.column(0))):
                for at in sorted({int(i * max(0, len(t) - CHUNK) / max(1, chunks - 1)) for i in range(chunks)}):
                    front = t[max(0, at - PAD):at]
                    body = np.concatenate([np.zeros(PAD - len(front), np.uint8), front, t[at:at + CHUNK]])
                    out.append(np.pad(body, (0, PAD + CHUNK - len(body))).tobytes())
                    y.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(out, pa.binary())], ["y", "chunk"])

    # at most 2 * per_class * chunks pieces of 544 bytes
    rows = sample.select("text", "y").mapInArrow(cut, "y bigint, chunk binary").orderBy("chunk", "y").collect()
    both = [_positions(np.frombuffer(r.chunk, np.uint8)) for r in rows]
    net = Net()
    net.fit(np.stack([x for x, _ in both]), np.stack([c for _, c in both]).astype(np.float32),
            np.array([r.y for r in rows], np.float32))
    got = features(sample, net, ["y"]).collect()
    x = np.array([[r.mean, r.top, r.low] for r in got])
    y = np.array([r.y for r in got], float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return net, logistic(x, y, weight)


def features(rows: DataFrame, net: Net, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and mean, highest and lowest chunk logit of each whole text; ``text`` may be a field of a kept struct."""
    schema = StructType([rows.schema[k] for k in keep] + [StructField(c, DoubleType()) for c in ("mean", "top", "low")])

    def run(batches):
        import pyarrow as pa
        for b in pieces(batches):
            f = []
            for t in texts_of(text_column(b, text)):
                z = net.chunk_logits(t)
                f.append((z.mean(), z.max(), z.min()))
            f = np.array(f, float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(f[:, i]) for i in range(3))],
                                             [*keep, "mean", "top", "low"])
    return rows.select(*dict.fromkeys([*keep, text.split(".")[0]])).mapInArrow(run, schema)


def score(docs: DataFrame, net: Net | None, coef: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``."""
    if net is None:
        return docs.select(*keep, F.lit(float(sigmoid(coef[-1]))).alias("score"))
    z = sum((F.col(c) * float(a) for c, a in zip(("mean", "top", "low"), coef)), F.lit(float(coef[-1])))
    z = F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))
    return features(docs, net, keep, text).select(*keep, (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    net, coef = train(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, net, coef, ["doc_id"]).select("doc_id", held.alias("held_out"), "score",
                                                     F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
