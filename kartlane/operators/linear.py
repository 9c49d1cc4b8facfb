"""Linear models of many groups at once: one pass of grouped moments, then one closed-form solve a group.

A group is whatever the keys say, for instance ``(fold, series_id, target)``. Each
task adds up the weight, the means and the centred products of its rows by group
(merged pairwise, so that large offsets cost no digits); a shuffle of one small
row per task and group brings them together, and the normal equations are
solved where they meet. The size of a group's state depends on the number of columns
alone. Models are rows, so predictions are a join and stay in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOT = 1e-9      # a column whose standardised pivot falls below depends on earlier ones: coefficient 0
CONSTANT = 1e-9   # relative standard deviation below which a column is constant: coefficient 0
_HELD = 256       # groups whose sums a task holds before it passes them on


def design(df: DataFrame, keys: list[str], cols: list[str], label=None, weight=None, keep: tuple[str, ...] = (),
           missing: bool = False) -> DataFrame:
    """``keys, keep, x`` (array of doubles) and, with a label, ``t`` and ``w``; rows without a value in any of them go.

    ``missing`` keeps rows whose features have none (NaN in ``x``), for models that can place them.
    """
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) if missing else F.col(c).cast("double") for c in cols])
    out = [F.col(k) for k in (*keys, *keep)] + [x.alias("x")]
    if label is not None:
        out += [label.cast("double").alias("t"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")]
    d = df.select(*out)
    fine = F.lit(True) if missing else F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    if label is not None:
        fine = fine & F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")) & (F.col("w") > 0)
    return d.where(fine)


def _merge(a, b):
    """Moments of the union of two sets of rows."""
    if a is None:
        return b
    n, w, mean, cross = a
    m, v, other, more = b
    d = other - mean
    return n + m, w + v, mean + d * (v / (w + v)), cross + more + np.outer(d, d) * (w * v / (w + v))


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _rows(keys, held, names):
    import pyarrow as pa
    at = list(held)
    columns = [pa.array([k[i] for k in at], t) for i, t in enumerate(keys)]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([held[k][0] for k in at], pa.int64()), pa.array([held[k][1] for k in at], pa.float64()),
         *[pa.array([held[k][j].ravel() for k in at], pa.list_(pa.float64())) for j in (2, 3)]], names)


def moments(d: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, weight, mean, cross``: weighted means and centred products of ``(x, t)`` of each group of a design."""
    schema = _schema(d, keys) + ", n bigint, weight double, mean array<double>, cross array<double>"
    names = [*keys, "n", "weight", "mean", "cross"]
    k = len(keys)

    def part(batches):
        held, types = {}, None
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.column(i).type for i in range(k)]
            code = np.zeros(b.num_rows, np.int64)
            for i in range(k):
                own = b.column(i).dictionary_encode()
                code = code * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
            x = np.column_stack([b.column(k).flatten().to_numpy().reshape(b.num_rows, -1), b.column(k + 1).to_numpy()])
            w = b.column(k + 2).to_numpy()
            _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            for rows, at in zip(np.split(order, np.flatnonzero(np.diff(inverse[order])) + 1), first):
                key = tuple(b.column(i)[int(at)].as_py() for i in range(k))
                mean = w[rows] @ x[rows] / w[rows].sum()
                z = x[rows] - mean
                held[key] = _merge(held.get(key), (len(rows), float(w[rows].sum()), mean, (z * w[rows, None]).T @ z))
            if len(held) > _HELD:
                yield _rows(types, held, names)
                held = {}
        if held:
            yield _rows(types, held, names)

    def whole(batches):
        key, total, types = None, None, None
        for b in batches:
            types = [b.column(i).type for i in range(k)]
            for i in range(b.num_rows):
                own = tuple(b.column(j)[i].as_py() for j in range(k))
                if key is not None and own != key:
                    yield _rows(types, {key: total}, names)
                    total = None
                mean = b.column(k + 2)[i].values.to_numpy()
                key, total = own, _merge(total, (b.column(k)[i].as_py(), b.column(k + 1)[i].as_py(), mean,
                                                 b.column(k + 3)[i].values.to_numpy().reshape(len(mean), -1)))
        if key is not None:
            yield _rows(types, {key: total}, names)

    parts = d.select(*keys, "x", "t", "w").mapInArrow(part, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(whole, schema)


def sweep(a: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
    """Solution of ``a b = c`` by Gauss-Jordan steps in column order; 0 where a pivot falls below ``least``."""
    m = np.column_stack([a, c])
    for k in range(len(a)):
        if m[k, k] <= least:
            m[k] = 0
            continue
        row = m[k] / m[k, k]
        m -= np.outer(m[:, k], row)
        m[k] = row
    return m[:, -1]


def ridge(mean: np.ndarray, cross: np.ndarray, weight: float, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ``min sum w (t - b0 - z b)^2 + alpha |b|^2``, z the standardised columns."""
    p = len(mean) - 1
    scale = np.sqrt(np.diag(cross)[:p] / weight)
    scale = np.where(scale > CONSTANT * np.maximum(1.0, np.abs(mean[:p])), scale, np.inf)
    a = cross[:p, :p] / np.outer(scale, scale)
    b = sweep(a + alpha * np.eye(p), cross[:p, p] / scale, PIVOT * weight) / scale
    return b, float(mean[p] - b @ mean[:p])


def fit(d: DataFrame, keys: list[str], alpha: float = 0.0) -> DataFrame:
    """``keys, n, coef, intercept`` of the ridge (``alpha`` 0: least squares) of each group of a design."""
    schema = _schema(d, keys) + ", n bigint, coef array<double>, intercept double"
    k = len(keys)

    def solve(batches):
        import pyarrow as pa
        for b in batches:
            coef, base = [], []
            for i in range(b.num_rows):
                mean = b.column(k + 2)[i].values.to_numpy()
                c, c0 = ridge(mean, b.column(k + 3)[i].values.to_numpy().reshape(len(mean), -1), b.column(k + 1)[i].as_py(), alpha)
                coef.append(c)
                base.append(c0)
            yield pa.RecordBatch.from_arrays([*b.columns[:k + 1], pa.array(coef, pa.list_(pa.float64())), pa.array(base, pa.float64())],
                                             [*keys, "n", "coef", "intercept"])

    return moments(d, keys).mapInArrow(solve, schema)


def predict(d: DataFrame, models: DataFrame, keys: list[str], out: str = "prediction") -> DataFrame:
    """A design with the prediction of its group's model; groups without a model have none and go."""
    terms = F.zip_with("x", "coef", lambda v, c: v * c)
    value = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) + F.col("intercept")
    return d.join(models.select(*keys, "coef", "intercept"), keys).withColumn(out, value).drop("x", "coef", "intercept")


def lasso(cross: np.ndarray, weight: float, l1: np.ndarray, l2: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """``min b'Gb / 2 - c'b + s (l1 |b| + l2 b^2 / 2)`` by coordinate descent on centred products.

    ``s`` is the residual variance of the columns without an ``l1`` penalty, so both
    penalties read as prior scales: ``1 / l1`` of a Laplace, ``1 / sqrt(l2)`` of a normal one.
    """
    p = len(cross) - 1
    g, c = cross[:p, :p], cross[:p, p]
    free = np.flatnonzero(l1 == 0)
    b0 = sweep(g[np.ix_(free, free)], c[free], PIVOT * max(1e-300, float(np.diag(g).max(initial=0))))
    noise = max(1e-12, float(cross[p, p] - c[free] @ b0) / weight)
    a, k = noise * l1, g.diagonal() + noise * l2
    b = np.zeros(p)
    b[free] = b0
    rest = c - g @ b
    active = np.flatnonzero(g.diagonal() > 0)
    for _ in range(rounds):
        most = 0.0
        for j in active:
            own = rest[j] + g[j, j] * b[j]
            new = np.sign(own) * max(0.0, abs(own) - a[j]) / k[j]
            if new != b[j]:
                rest -= g[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]) * np.sqrt(g[j, j]))
                b[j] = new
        if most < 1e-9 * np.sqrt(max(cross[p, p], 1e-300)):
            break
    return b


def fit_lasso(d: DataFrame, keys: list[str], l1: list[float], l2: list[float]) -> DataFrame:
    """As ``fit``, with an ``l1`` and an ``l2`` penalty for each column; unused columns have the coefficient 0."""
    schema = _schema(d, keys) + ", n bigint, coef array<double>, intercept double"
    k, one, two = len(keys), np.array(l1, float), np.array(l2, float)

    def solve(batches):
        import pyarrow as pa
        for b in batches:
            coef, base = [], []
            for i in range(b.num_rows):
                mean = b.column(k + 2)[i].values.to_numpy()
                own = lasso(b.column(k + 3)[i].values.to_numpy().reshape(len(mean), -1), b.column(k + 1)[i].as_py(), one, two)
                coef.append(own)
                base.append(float(mean[-1] - own @ mean[:-1]))
            yield pa.RecordBatch.from_arrays([*b.columns[:k + 1], pa.array(coef, pa.list_(pa.float64())), pa.array(base, pa.float64())],
                                             [*keys, "n", "coef", "intercept"])

    return moments(d, keys).mapInArrow(solve, schema)
