"""Boosted trees for every series of a panel: fits run side by side, one group of rows each.

A group is one series' calendar (a few thousand days, however many rows the raw
tables have), so a round takes milliseconds in its task, and what Spark distributes
are the groups. A fit can go on: the residuals, the holdout's predictions and the
generator of the draws are kept, so that more rounds continue where the last one
ended. Models are rows; they meet the rows they predict in a cogroup.

Trees are grown level by level on quantile bins. Each tree draws its own columns;
rows are drawn anew every ``every`` trees.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Search and tree parameters; with ``patience`` the last ``holdout`` days choose the number of rounds."""
    rounds: int
    step: float
    depth: int
    leaf: int = 1             # least rows of a leaf
    l2: float = 0.0
    rows: float = 1.0         # share of rows drawn
    columns: float = 1.0      # share of columns drawn for each tree
    every: int = 1            # trees that share a draw of rows
    patience: int = 0
    holdout: int = 180
    bins: int = 64
    seed: int = 42

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)


class Bins:
    """Quantile bins of each column; binary columns have two."""

    def __init__(self, x: np.ndarray, most: int):
        self.edges = []
        for col in x.T:
            v = np.unique(col)
            if len(v) > most:
                v = np.unique(np.quantile(col, np.linspace(0, 1, most)))
            self.edges.append((v[1:] + v[:-1]) / 2)
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, col, "left") for e, col in zip(self.edges, x.T)], 1).astype(np.int16)


class Boosting:
    """Squared-error boosting of ``t`` on coded columns; ``go_on`` adds rounds."""

    def __init__(self, x: np.ndarray, t: np.ndarray, w: np.ndarray, s: Settings):
        self.s, self.bins = s, Bins(x, s.bins)
        self.code, self.w = self.bins.code(x), w
        self.base = float(w @ t / w.sum())
        self.residual = t - self.base
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gain = np.zeros(x.shape[1])
        self.draw = np.random.default_rng(s.seed)
        self.used = np.arange(len(t))

    def go_on(self, rounds: int) -> None:
        n, p = self.code.shape
        for _ in range(rounds):
            if self.s.rows < 1 and len(self.trees) % self.s.every == 0:
                self.used = np.sort(self.draw.choice(n, max(1, int(round(self.s.rows * n))), replace=False))
            columns = np.sort(self.draw.choice(p, max(1, int(round(self.s.columns * p))), replace=False)) if self.s.columns < 1 else np.arange(p)
            tree = self._tree(columns)
            self.trees.append(tree)
            self.residual -= self.s.step * value(tree, self.code)

    def _tree(self, columns):
        depth, s = self.s.depth, self.s
        code, r, w = self.code[np.ix_(self.used, columns)], self.residual[self.used], self.w[self.used]
        sizes = np.diff(self.bins.first)[columns]
        first = np.concatenate([[0], np.cumsum(sizes)])
        total = int(first[-1])
        flat = code.astype(np.int64) + first[:-1]
        start, last = np.repeat(first[:-1], sizes), first[1:] - 1
        column_of = np.repeat(np.arange(len(columns)), sizes)
        feature = np.full((1 << depth) - 1, -1, np.int16)
        cut = np.zeros((1 << depth) - 1, np.int16)
        node = np.zeros(len(r), np.int64)
        live = np.ones(len(r), bool)
        mass, p = r * w, len(columns)

        def histograms(at, own, k):
            index = (own[:, None] * total + flat[at]).ravel()
            return [np.bincount(index, weights, k * total).reshape(k, total).astype(float)
                    for weights in (np.repeat(mass[at], p), np.repeat(w[at], p), None)]

        for level in range(depth):
            at = np.flatnonzero(live)
            if not len(at):
                break
            if not level:
                names, own = np.zeros(1, np.int64), np.zeros(len(at), np.int64)
                sums = histograms(at, own, 1)
            else:  # of two children the smaller is added up, the other is what its parent has besides
                place = np.zeros(1 << (level - 1), np.int64)
                place[names[split]] = np.arange(split.sum())
                parent, side = place[node[at] >> 1], node[at] & 1
                least = np.bincount(2 * parent + side, minlength=2 * int(split.sum())).reshape(-1, 2).argmin(1)
                few = side == least[parent]
                small = histograms(at[few], parent[few], len(least))
                names = np.stack([2 * names[split], 2 * names[split] + 1], 1).ravel()
                own = 2 * parent + side
                whole_sums, sums = [v[split] for v in sums], []
                for v, q in zip(small, whole_sums):
                    both = np.empty((len(least), 2, total))
                    both[np.arange(len(least)), least] = v
                    both[np.arange(len(least)), 1 - least] = q - v
                    sums.append(both.reshape(-1, total))
            left = []
            for v in sums:  # running sums within each column
                c = np.cumsum(v, 1)
                left.append(c - (c[:, start] - v[:, start]))
            whole = [v[:, last[:1]] for v in left]
            g, h, m = left
            rest_g, rest_h, rest_m = whole[0] - g, whole[1] - h, whole[2] - m
            fine = (m >= s.leaf) & (rest_m >= s.leaf) & (h + s.l2 > 0) & (rest_h + s.l2 > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fine, g * g / (h + s.l2) + rest_g * rest_g / (rest_h + s.l2) - whole[0] ** 2 / (whole[1] + s.l2), -np.inf)
            best = gain.argmax(1)
            got = gain[np.arange(len(names)), best]
            split = got > 1e-12
            which = column_of[best]
            base = (1 << level) - 1
            feature[base + names[split]] = columns[which[split]]
            cut[base + names[split]] = (best - first[which])[split]
            np.add.at(self.gain, columns[which[split]], got[split])
            live[at[~split[own]]] = False
            right = np.zeros(len(r), bool)
            moved = at[split[own]]
            o = own[split[own]]
            right[moved] = code[moved, which[o]] > (best - first[which])[o]
            node = 2 * node + right
        leaves = 1 << depth
        held = np.bincount(node, w, leaves) + s.l2
        return feature, cut, np.divide(np.bincount(node, mass, leaves), held, out=np.zeros(leaves), where=held > 0)


def value(tree, code: np.ndarray) -> np.ndarray:
    """A tree's value for each coded row."""
    feature, cut, leaf = tree
    node = np.zeros(len(code), np.int64)
    depth, rows = int(len(leaf)).bit_length() - 1, np.arange(len(code))
    for level in range(depth):
        f = feature[(1 << level) - 1 + node]
        node = 2 * node + ((f >= 0) & (code[rows, f] > cut[(1 << level) - 1 + node]))
    return leaf[node]


def search(x, t, w, day, s: Settings):
    """``(rounds, limit hit, losses)``: the rounds of least absolute error on the last ``holdout`` days.

    The search ends when the best round lies ``patience`` rounds back, or at ``rounds``. With
    fewer than 20 earlier rows it is scored on the rows it fits.
    """
    old = day <= day.max() - s.holdout
    new = ~old
    if old.sum() < 20:
        old = new = np.ones(len(t), bool)
    b = Boosting(x[old], t[old], w[old], s)
    code, seen = b.bins.code(x[new]), np.full(int(new.sum()), b.base)
    losses = []
    while len(losses) < s.rounds:
        b.go_on(1)
        seen = seen + s.step * value(b.trees[-1], code)
        losses.append(float(np.abs(t[new] - seen).mean()))
        if len(losses) - 1 - int(np.argmin(losses)) >= s.patience:
            break
    best = int(np.argmin(losses)) + 1
    return best, best + s.patience > len(losses), losses


_FITTED = "best_iteration int, limit_hit boolean, holdout_loss double, gain array<double>, fitted binary"


def _names(keys, schema):
    return [*keys, *[c.split()[0] for c in schema.split(", ")]]


def _types(df, keys):
    return "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)


def fit(d: DataFrame, keys: list[str], settings: dict[str, Settings] | Settings) -> DataFrame:
    """``keys, best_iteration, limit_hit, holdout_loss, gain, model`` per group of ``d(keys, Date, x, t, w)``.

    ``settings``: one for all, or one for each value of the key ``model``.
    """
    def run(key, rows):
        import pyarrow as pa
        own = dict(zip(keys, (k.as_py() for k in key)))
        s = settings[own["model"]] if isinstance(settings, dict) else settings
        rows = rows.sort_by("Date").combine_chunks()
        x = np.stack(rows.column("x").to_pylist()).astype(float)
        t, w = rows.column("t").to_numpy(), rows.column("w").to_numpy()
        day = rows.column("Date").cast(pa.int32()).to_numpy()
        best, hit, loss = s.rounds, False, None
        if s.patience:
            best, hit, losses = search(x, t, w, day, s)
            loss = losses[best - 1]
        b = Boosting(x, t, w, s)
        b.go_on(best)
        kept = pickle.dumps((b.base, s.step, b.bins, b.trees))
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], pa.array([best], pa.int32()), pa.array([hit]), pa.array([loss], pa.float64()),
                         pa.array([b.gain], pa.list_(pa.float64())), pa.array([kept], pa.binary())], names=_names(keys, _FITTED))

    return d.select(*keys, "Date", "x", "t", "w").groupBy(*keys).applyInArrow(run, _types(d, keys) + _FITTED)


def predict(d: DataFrame, models: DataFrame, keys: list[str], keep: str = "Date date, y double") -> DataFrame:
    """Rows of ``d(keys, keep, x)`` with ``prediction, best_iteration, limit_hit, holdout_loss`` of their group's model."""
    more = "prediction double, best_iteration int, limit_hit boolean, holdout_loss double"
    kept = [c.split()[0] for c in keep.split(", ")]

    def run(key, rows, fitted):
        import pyarrow as pa
        if not fitted.num_rows or not rows.num_rows:
            rows = rows.slice(0, 0)
        n = rows.num_rows
        total = np.zeros(n)
        if n:
            base, step, bins, trees = pickle.loads(fitted.column("fitted")[0].as_py())
            code = bins.code(np.stack(rows.column("x").to_pylist()).astype(float))
            total += base
            for tree in trees:
                total += step * value(tree, code)
        same = [pa.array([fitted.column(c)[0].as_py()] * n, fitted.column(c).type) for c in ("best_iteration", "limit_hit", "holdout_loss")] \
            if n else [pa.array([], fitted.column(c).type) for c in ("best_iteration", "limit_hit", "holdout_loss")]
        return pa.table([*[rows.column(c).combine_chunks() for c in (*keys, *kept)], pa.array(total), *same], names=_names([*keys, *kept], more))

    return (d.select(*keys, *kept, "x").groupBy(*keys).cogroup(models.drop("gain").groupBy(*keys))
            .applyInArrow(run, _types(d, keys) + keep + ", " + more))


def importances(models: DataFrame, cols: list[str]) -> DataFrame:
    """``target, feature, importance``: each column's share in the gain of its model."""
    named = models.select("model", "target", F.posexplode("gain").alias("i", "gain"), F.aggregate("gain", F.lit(0.0), lambda a, v: a + v).alias("all"))
    return named.select("model", "target", F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("feature"),
                        (F.col("gain") / F.nullif(F.col("all"), F.lit(0.0))).alias("importance"))
