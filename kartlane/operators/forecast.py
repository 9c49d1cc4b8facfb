"""Forecasting operators on a long daily panel ``(series_id, target, Date, y)``.

Relational baselines
--------------------
* lag-L naive, recursive past one season: y(t) = y(t - L*ceil((t-T)/L)) —
  the recursion has a closed form, so a 548-day horizon is one join;
* linear combinations of lags >= L (e.g. mean of 364/365/366): *block
  recursion* — the horizon is cut into blocks of L days; each block only
  reads actuals or earlier blocks, so B = ceil(H/L) joins replace H steps;
* calibration factors (shrunk medians), closed-form blend weights, weighted
  median scale — all group-bys / windows per (series, target).

Every operator works per (series_id, target), so a panel of many series is
one job; windows partition by (series_id, target) over calendar-bounded rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlane.functions.exprs import clip, fdiv, weekday_mon0
from kartlane.operators.windows import lag, shifted_rolling
from kartlane.session import checkpoint_dir

K = ["series_id", "target"]


def horizon_spine(long: DataFrame, origin: str, days: int) -> DataFrame:
    """(series_id, target, Date) for the ``days`` days after ``origin``."""
    keys = long.select(*K).distinct()
    o = F.lit(origin).cast("date")
    dates = keys.select(*K, F.explode(F.sequence(F.date_add(o, 1), F.date_add(o, days),
                                                 F.expr("interval 1 day"))).alias("Date"))
    return dates


def naive_closed_form(long: DataFrame, horizon: DataFrame, origin: str, season: int) -> DataFrame:
    """Lag-``season`` naive forecast, recursively extended past one season."""
    o = F.lit(origin).cast("date")
    k = F.ceil(F.datediff(F.col("Date"), o) / F.lit(float(season)))
    h = horizon.withColumn("_src", F.date_sub(F.col("Date"), (k * season).cast("int")))
    hist = long.filter(F.col("Date") <= o).select(*K, F.col("Date").alias("_src"), F.col("y").alias("yhat"))
    return h.join(hist, K + ["_src"], "left").drop("_src")


def block_recursive(long: DataFrame, horizon: DataFrame, origin: str, weights: dict[int, float],
                    horizon_days: int) -> DataFrame:
    """Forecast sum_k w_k * y(t - k) recursively over the horizon, block by block.

    Block b covers (T + (b-1)L, T + bL] with L = min lag; its inputs are
    actuals (<= T) or predictions of earlier blocks.  Lineage is cut with a
    checkpoint in the shared checkpoint folder every 3 blocks.
    """
    L = min(weights)
    o = F.lit(origin).cast("date")
    known = long.filter(F.col("Date") <= o).select(*K, "Date", F.col("y").alias("v"))
    hz = horizon.withColumn("_off", F.datediff(F.col("Date"), o))
    preds = None
    n_blocks = -(-horizon_days // L)
    for b in range(1, n_blocks + 1):
        blk = hz.filter((F.col("_off") > (b - 1) * L) & (F.col("_off") <= b * L)).select(*K, "Date")
        acc = None
        for lg, w in weights.items():
            src = known.select(*K, F.date_add(F.col("Date"), lg).alias("Date"), (F.col("v") * w).alias(f"_t{lg}"))
            blk = blk.join(src, K + ["Date"], "left")
            term = F.col(f"_t{lg}")
            acc = term if acc is None else acc + term
        blk = blk.select(*K, "Date", acc.alias("yhat"))
        if b % 3 == 0:
            checkpoint_dir(blk.sparkSession)
            blk = blk.checkpoint()
        preds = blk if preds is None else preds.unionByName(blk)
        known = known.unionByName(blk.select(*K, "Date", F.col("yhat").alias("v")))
    return preds


def with_actuals(pred: DataFrame, long: DataFrame, model: str) -> DataFrame:
    return (pred.join(long.select(*K, "Date", "y"), K + ["Date"], "left")
            .select(F.lit(model).alias("model"), *K, "Date", "y", "yhat"))


def weighted_baseline_one_step(long: DataFrame) -> DataFrame:
    """0.5*lag364 + 0.3*lag7 + 0.2*rolling30 with actual (one-step) lags."""
    p, o = K, "Date"
    yhat = (0.5 * lag("y", p, o, 364) + 0.3 * lag("y", p, o, 7)
            + 0.2 * shifted_rolling("y", p, o, 30, "avg", 30))
    return long.withColumn("yhat", yhat)


# FIXED VALUES - baseline features and their default weights.
BASELINE_LAGS = [364, 365, 371]
BASELINE_ROLLS = [7, 30, 90]
BASELINE_FEATURES = [f"lag_{k}" for k in BASELINE_LAGS] + [f"rolling_{n}" for n in BASELINE_ROLLS]
DEFAULT_BASELINE_WEIGHTS = [0.45, 0.35, 0.05, 0.10, 0.03, 0.02]


def baseline_raw(feats: DataFrame, weights: list[float] = DEFAULT_BASELINE_WEIGHTS,
                 weight_table: DataFrame | None = None) -> DataFrame:
    """baseline = X @ w over the 6 baseline features (fixed or per-series weights)."""
    if weight_table is None:
        acc = None
        for c, w in zip(BASELINE_FEATURES, weights):
            t = F.col(c) * F.lit(float(w))
            acc = t if acc is None else acc + t
        return feats.withColumn("pred", acc)
    j = feats.join(weight_table, K, "left")  # grows with the number of series: no broadcast hint
    acc = None
    for i, c in enumerate(BASELINE_FEATURES):
        t = F.col(c) * F.col(f"w{i}")
        acc = t if acc is None else acc + t
    return j.withColumn("pred", acc).drop(*[f"w{i}" for i in range(len(BASELINE_FEATURES))])


def calibration_factors(tab: DataFrame, fit: F.Column) -> DataFrame:
    """Month factors (median ratio shrunk n/(n+60), clip .8-1.2) then month x weekday
    factors on the month-adjusted ratio (n/(n+20), clip .9-1.1).

    ``tab`` has (series_id, target, Date, y, pred).  Output long:
    (series_id, target, level, month, dayofweek, factor, n).
    """
    f = (tab.filter(fit)
         .withColumn("ratio", F.coalesce(F.col("y") / F.nullif(F.col("pred"), F.lit(0.0)), F.lit(1.0)))
         .withColumns({"month": F.month("Date"), "dayofweek": weekday_mon0("Date")}))
    mf = (f.groupBy(*K, "month").agg(F.percentile("ratio", 0.5).alias("_med"), F.count(F.lit(1)).alias("n"))
          .withColumn("factor", clip(F.lit(1.0) + (F.col("_med") - 1.0) * (F.col("n") / (F.col("n") + 60.0)),
                                     0.8, 1.2)))
    adj = f.join(mf.select(*K, "month", F.col("factor").alias("_mf")), K + ["month"], "inner") \
           .withColumn("adj", F.col("ratio") / F.col("_mf"))
    wf = (adj.groupBy(*K, "month", "dayofweek").agg(F.percentile("adj", 0.5).alias("_med"),
                                                     F.count(F.lit(1)).alias("n"))
          .withColumn("factor", clip(F.lit(1.0) + (F.col("_med") - 1.0) * (F.col("n") / (F.col("n") + 20.0)),
                                     0.9, 1.1)))
    return (mf.select(*K, F.lit("month").alias("level"), "month", F.lit(None).cast("int").alias("dayofweek"),
                      "factor", "n")
            .unionByName(wf.select(*K, F.lit("weekday_month").alias("level"), "month", "dayofweek", "factor", "n")))


def apply_calibration(tab: DataFrame, factors: DataFrame, pred: str = "pred",
                      out: str = "pred_calibrated") -> DataFrame:
    """pred x month factor x (month, weekday) factor, missing factors = 1.0.

    Factor tables hold <= 12 + 84 rows per (series, target): joined on keys.
    """
    m = factors.filter(F.col("level") == "month").select(*K, "month", F.col("factor").alias("_fm"))
    w = factors.filter(F.col("level") == "weekday_month").select(*K, "month", "dayofweek",
                                                                 F.col("factor").alias("_fw"))
    t = tab.withColumns({"month": F.month("Date"), "dayofweek": weekday_mon0("Date")})
    t = t.join(m, K + ["month"], "left").join(w, K + ["month", "dayofweek"], "left")
    return t.withColumn(out, F.col(pred) * F.coalesce("_fm", F.lit(1.0)) * F.coalesce("_fw", F.lit(1.0))) \
            .drop("_fm", "_fw", "month", "dayofweek")


def residual_target(tab: DataFrame, base: str = "pred_calibrated") -> DataFrame:
    return tab.withColumn("residual", F.col("y") - F.col(base)).dropna(subset=["residual"])


# -- blends ---------------------------------------------------------------------------------
QUARTER_ALPHA = {1: 0.6, 2: 0.6, 3: 1.0, 4: 0.6}


def blend_alpha(tab: DataFrame, spec: str, base: str, alpha_by_quarter: dict[int, float] = QUARTER_ALPHA,
                out: str = "blend") -> DataFrame:
    a = None
    for q, v in alpha_by_quarter.items():
        cond = F.quarter("Date") == q
        a = F.when(cond, F.lit(v)) if a is None else a.when(cond, F.lit(v))
    return tab.withColumn(out, a * F.col(spec) + (F.lit(1.0) - a) * F.col(base))


def alpha_tuning(tab: DataFrame, spec: str, base: str, lo: float = 0.05, hi: float = 0.85,
                 keys: list[str] = K) -> DataFrame:
    """Per (series, target, quarter) alpha minimising squared error of a*s + (1-a)*b.

    The objective is a convex quadratic in a: a* = sum((y-b)(s-b)) / sum((s-b)^2),
    clipped to [lo, hi].  (Each target is scored against its own actuals.)
    """
    d = F.col(spec) - F.col(base)
    g = (tab.filter(F.col("y").isNotNull() & F.col(spec).isNotNull() & F.col(base).isNotNull())
         .groupBy(*keys, F.quarter("Date").alias("quarter"))
         .agg(F.sum((F.col("y") - F.col(base)) * d).alias("_num"), F.sum(d * d).alias("_den")))
    best = F.col("_num") / F.nullif(F.col("_den"), F.lit(0.0))
    return g.select(*keys, "quarter", clip(F.coalesce(best, F.lit(lo)), lo, hi).alias("alpha"), best.alias("unclipped"))


def blend_families(tab: DataFrame, cols_weights: dict[str, float], out: str = "blend") -> DataFrame:
    acc = None
    for c, w in cols_weights.items():
        t = F.col(c) * F.lit(float(w))
        acc = t if acc is None else acc + t
    return tab.withColumn(out, acc)


def scale_calibration(tab: DataFrame, pred: str, lo: float = 0.8, hi: float = 2.0, keys: list[str] = K) -> DataFrame:
    """c minimising sum |y - c*p| per (series, target): the weighted median of y/p
    with weights p (p > 0), clipped to [lo, hi].

    Window per (series, target) over the validation days (calendar-bounded).
    """
    t = (tab.filter((F.col(pred) > 0) & F.col("y").isNotNull())
         .select(*keys, "Date", (F.col("y") / F.col(pred)).alias("r"), F.col(pred).alias("w")))
    w = Window.partitionBy(*keys).orderBy("r", "Date").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"_cw": F.sum("w").over(w), "_tw": F.sum("w").over(Window.partitionBy(*keys))})
    return (t.filter(F.col("_cw") >= F.col("_tw") / 2.0).groupBy(*keys)
            .agg(F.min_by("r", F.struct("r", "Date")).alias("_c"))
            .select(*keys, clip("_c", lo, hi).alias("scale"), F.col("_c").alias("unclipped")))


def combine_components(preds_long: DataFrame, weights: DataFrame, keys: list[str] = K) -> DataFrame:
    """sum over models of w(model, target) * yhat, floored at 0 (long join + agg)."""
    j = preds_long.join(F.broadcast(weights), ["model", "target"], "inner")   # weights: models x targets
    # a component without a value leaves no value, rather than a blend with too little weight
    return (j.groupBy(*keys, "Date").agg(F.sum(F.col("w") * F.col("yhat")).alias("_s"),
                                      (F.count("yhat") == F.count(F.lit(1))).alias("_all"))
            .select(*keys, "Date", F.when(F.col("_all"), F.greatest(F.col("_s"), F.lit(0.0))).alias("yhat")))


# Fixed ensemble weights (workload constants).
REVENUE_ENSEMBLE_WEIGHTS = {"residual_lgbm": 0.50, "residual_xgb": 0.25, "direct_lgbm": 0.15,
                            "calibrated_baseline": 0.10}
COGS_ENSEMBLE_WEIGHTS = {"residual_lgbm": 0.60, "residual_xgb": 0.25, "calibrated_baseline": 0.15}


def fixed_ensemble_weights(spark) -> DataFrame:
    """Weight table (model, target, w) of the fixed ensembles."""
    rows = [(m, "Revenue", w) for m, w in REVENUE_ENSEMBLE_WEIGHTS.items()] + [(m, "COGS", w) for m, w in COGS_ENSEMBLE_WEIGHTS.items()]
    return spark.createDataFrame(rows, "model string, target string, w double")


ALPHA_GRID = [0.25, 0.5, 0.75, 1.0]


def residual_alpha_blend(tab: DataFrame, base: str, resid_pred: str, spark) -> DataFrame:
    """baseline + a * residual prediction for a in the grid (long, one row per alpha)."""
    grid = spark.createDataFrame([(a,) for a in ALPHA_GRID], "alpha double")
    return tab.crossJoin(F.broadcast(grid)).withColumn("yhat", F.col(base) + F.col("alpha") * F.col(resid_pred))


# -- simplex weights (Gram aggregate + per-group exact solve) -------------------------------
def gram(tab: DataFrame, cols: list[str], keys: list[str] = K) -> DataFrame:
    """X'X, X'y, y'y, n per (series, target) in one aggregate (complete rows only)."""
    t = tab.dropna(subset=cols + ["y"])
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(F.col(a) * F.col("y")).alias(f"xy{i}"))
        for j, b in enumerate(cols):
            if j >= i:
                aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"xx{i}_{j}"))
    return t.groupBy(*keys).agg(*aggs)


def simplex_solve(G: np.ndarray, c: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """min w'Gw - 2c'w  s.t. w >= 0, sum w = 1, by an active-set method that adds and drops columns.

    From the best single column on, the column whose derivative lies furthest below
    that of the used ones is added; the equality-constrained optimum of the used
    columns is approached as far as no weight turns negative, and the columns that
    reach 0 are dropped. Each optimum lowers the objective, so no set comes back.
    """
    m = len(c)
    size = max(float(np.abs(G).max(initial=0)), float(np.abs(c).max(initial=0)), 1e-300)
    G, c = G / size, c / size
    w = np.zeros(m)
    w[int(np.argmin(np.diag(G) - 2 * c))] = 1.0
    used = w > 0
    for _ in range(rounds):
        while True:
            idx = np.flatnonzero(used)
            r = len(idx)
            kkt = np.zeros((r + 1, r + 1))
            kkt[:r, :r] = 2 * G[np.ix_(idx, idx)]
            kkt[:r, r] = kkt[r, :r] = 1.0
            want = np.linalg.lstsq(kkt, np.append(2 * c[idx], 1.0), rcond=None)[0][:r]
            down = want <= 1e-13
            if not down.any():
                w[:] = 0
                w[idx] = want
                break
            step = np.min(np.where(down, w[idx] / np.maximum(w[idx] - want, 1e-300), np.inf))
            w[idx] += min(1.0, step) * (want - w[idx])
            out = idx[down & (w[idx] <= 1e-12)]
            if not len(out):
                out = idx[[int(np.argmin(w[idx]))]]
            w[out], used[out] = 0.0, False
        slope = 2 * (G @ w - c)
        level = slope[used].max()
        rest = np.where(used, np.inf, slope)
        j = int(np.argmin(rest))
        if rest[j] >= level - 1e-10:
            break
        used[j] = True
    return w / w.sum()


def _gram_row(columns: dict, i: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    G = np.zeros((m, m))
    for a in range(m):
        for b in range(a, m):
            G[a, b] = G[b, a] = columns[f"xx{a}_{b}"][i]
    return G, np.array([columns[f"xy{a}"][i] for a in range(m)])


def simplex_weights(gram_tab: DataFrame, m: int, keys: list[str] = K) -> DataFrame:
    """Exact simplex-constrained least squares per group from the Gram rows: one small row a group, solved where it lies."""
    schema = ", ".join(f"{k} string" for k in keys) + ", " + ", ".join(f"w{i} double" for i in range(m)) + ", rmse double"

    def solve(batches):
        import pyarrow as pa
        for b in batches:
            col = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            found, error = [], []
            for i in range(b.num_rows):
                G, c = _gram_row(col, i, m)
                w = simplex_solve(G, c)
                found.append(w)
                error.append(float(np.sqrt(max(col["yy"][i] - 2 * c @ w + w @ G @ w, 0.0) / col["n"][i])))
            w = np.array(found).reshape(-1, m)
            yield pa.RecordBatch.from_arrays([*(pa.array(col[k], pa.string()) for k in keys), *(pa.array(w[:, i]) for i in range(m)),
                                              pa.array(error, pa.float64())], [*keys, *[f"w{i}" for i in range(m)], "rmse"])

    return gram_tab.mapInArrow(solve, schema)


def simplex_grid(spark, m: int, steps: int) -> DataFrame:
    """All ``(g0, ..., g<m-1>)`` of whole numbers from 0 that add up to ``steps``, built column by column."""
    grid = spark.createDataFrame([(0,)], "used int")
    for i in range(m):
        low = F.lit(steps) - F.col("used") if i == m - 1 else F.lit(0)
        grid = grid.withColumn(f"g{i}", F.explode(F.sequence(low, F.lit(steps) - F.col("used")))).withColumn("used", F.col("used") + F.col(f"g{i}"))
    return grid.drop("used")


def simplex_weights_grid(gram_tab: DataFrame, m: int, steps: int = 10, keys: list[str] = K) -> DataFrame:
    """The best weights in steps of ``1 / steps``, and their RMSE; of equal ones the first in the order of the weights.

    The grid has C(steps + m - 1, m - 1) rows whatever the data, and meets one Gram row a group.
    """
    g = [F.col(f"g{i}").cast("double") for i in range(m)]
    cost = F.lit(0.0)
    for a in range(m):
        for b in range(a, m):
            cost = cost + F.col(f"xx{a}_{b}") * (g[a] * g[b]) * (1.0 if a == b else 2.0)
    linear = F.lit(0.0)
    for a in range(m):
        linear = linear + F.col(f"xy{a}") * g[a]
    sse = F.col("yy") - 2.0 * linear / F.lit(float(steps)) + cost / F.lit(float(steps * steps))
    # the grid's size depends on m and steps alone: broadcast
    best = (gram_tab.crossJoin(F.broadcast(simplex_grid(gram_tab.sparkSession, m, steps))).withColumn("sse", sse)
            .groupBy(*keys).agg(F.min(F.struct("sse", *[f"g{i}" for i in range(m)])).alias("x"), F.first("n").alias("n")))
    return best.select(*keys, *[(F.col(f"x.g{i}") / float(steps)).alias(f"w{i}") for i in range(m)],
                       F.sqrt(F.greatest(F.col("x.sse"), F.lit(0.0)) / F.col("n")).alias("rmse"))
