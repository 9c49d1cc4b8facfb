"""The blended final forecast, the monthly models, the random forest and the recursive baseline.

The members are panel models (``panel_models``): grouped closed forms and grouped
boosting. The random forest is MLlib's, fitted by distributed jobs.

Workload -> re-aims (see README): its boosting engines -> ``boosting``; its
decomposition model -> ``panel_models.structural``.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlane.operators import boosting as B
from kartlane.operators import features as FE
from kartlane.operators import linear
from kartlane.operators import panel_models as PM
from kartlane.session import cut_lineage as materialize

TARGETS = ["Revenue", "COGS"]
# ---------------------------------------------------------------------------
# FIXED VALUES - the workload's final ensemble.
# ---------------------------------------------------------------------------
QUARTER_SHARE = {1: 0.6, 2: 0.6, 3: 1.0, 4: 0.6}                    # specialists' share of the boosted blend
FAMILY_WEIGHTS = {"ridge": 0.10, "structural": 0.10, "boosted": 0.80}
LEVEL = {"Revenue": 1.26, "COGS": 1.32}


def random_forest(cat, num_trees: int = 300, depth: int = 14, leaf: int = 3, series: str = PM.TOTAL, fold: str = "A") -> DataFrame:
    """MLlib forest on the one-step features of one series: ``model, target, Date, y, yhat`` of the fold's validation days."""
    rows, cols = PM.lag_rows(cat)
    rows = materialize(PM.only(PM.in_folds(rows, cat.spark), series, fold).dropna(subset=cols + ["y"]))
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    out = None
    for t in TARGETS:
        own = rows.where(F.col("target") == t)
        est = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=num_trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42)
        p = est.fit(own.where("role = 'train'")).transform(own.where("role = 'valid'")).select(
            F.lit("random_forest").alias("model"), "target", "Date", "y", F.col("prediction").alias("yhat"))
        out = p if out is None else out.unionByName(p)
    return out


# --- the final forecast

def final_members(cat, settings: B.Settings = PM.TWO_PHASE) -> DataFrame:
    """``fitted_members``, written once (``Catalog.shared``)."""
    return cat.shared(f"final_members_{hash(settings)}", lambda: fitted_members(cat, settings))


def fitted_members(cat, settings: B.Settings) -> DataFrame:
    """Ridge, structural model, boosted base and quarter specialists, all fitted on every
    observed day: ``(target, Date, ridge, structural, base, specialist, ...)`` over the template."""
    rows, cols = PM.calendar_rows(cat)
    rows = materialize(PM.observed_and_template(cat, PM.only(rows, PM.TOTAL)))
    keys = PM.SERIES
    fitted = linear.fit(linear.design(rows.where("role = 'train' and y > 0"), keys, cols, F.log("y")), keys, PM.RIDGE_LOG_ALPHA)
    ridge = linear.predict(linear.design(rows.where("role = 'valid'"), keys, cols, keep=("Date",)), fitted, keys)
    long = ridge.select("target", "Date", F.lit("ridge").alias("model"), F.exp("prediction").alias("yhat"),
                        F.lit(None).cast("int").alias("best_iteration"), F.lit(None).cast("double").alias("holdout_loss"))
    _, trend = PM.structural(rows, keys=keys)
    for p in (trend.withColumns({"best_iteration": F.lit(None).cast("int"), "holdout_loss": F.lit(None).cast("double")}),
              PM.two_phase(rows, cols, "base", keys, settings), PM.specialists(rows, cols, "specialist", keys, settings)):
        long = long.unionByName(p.select(*long.columns))
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return long.groupBy("target", "Date").agg(
        *[pick(m, "yhat").alias(m) for m in ("ridge", "structural", "base", "specialist")],
        *[pick(m, c).alias(f"{m}_{c}") for m in ("base", "specialist") for c in ("best_iteration", "holdout_loss")])


def blend_members(members: DataFrame) -> DataFrame:
    """Tiers 1 to 3: specialists by quarter share, families by weight, target by level; a missing member gives null."""
    share = F.element_at(F.create_map(*[F.lit(x) for kv in QUARTER_SHARE.items() for x in kv]), F.quarter("Date"))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv]), F.col("target"))
    blend = share * F.col("specialist") + (1 - share) * F.col("base")
    raw = (FAMILY_WEIGHTS["ridge"] * F.col("ridge") + FAMILY_WEIGHTS["structural"] * F.col("structural")
           + FAMILY_WEIGHTS["boosted"] * blend)
    return members.withColumns({"blend": blend, "raw": raw, "yhat": level * raw})


def final_forecast(cat, settings: B.Settings = PM.TWO_PHASE) -> DataFrame:
    """The submission frame: ``Date, Revenue, COGS`` of the blended members."""
    return submission(blend_members(final_members(cat, settings)))


def submission(blended: DataFrame) -> DataFrame:
    return blended.groupBy("Date").agg(*[F.max(F.when(F.col("target") == t, F.col("yhat"))).alias(t) for t in TARGETS])


def forecast_sink(cat, forecast: DataFrame, path: str) -> DataFrame:
    """Template order kept, ISO dates, round(2), >= 0; a template day without a forecast is an error;
    written as CSV, as a new version below ``path``."""
    tmpl = cat.table("sample_submission").select("Date")

    def known(c):
        gap = F.raise_error(F.concat(F.lit(f"no {c} forecast for "), F.col("Date").cast("string"))).cast("double")
        return F.round(F.greatest(F.coalesce(F.nanvl(F.col(c), gap), gap), F.lit(0.0)), 2).alias(c)

    f = tmpl.join(forecast, "Date", "left").select(
        F.date_format("Date", "yyyy-MM-dd").alias("Date"), known("Revenue"), known("COGS")).orderBy("Date")
    from kartlane.plans.reports import commit, read_version
    commit({"forecast": f}, path, "csv")
    return read_version(cat.spark, path)["forecast"]


# lagged columns only: what is known when a month is forecast (``orders`` of the month itself is not)
MONTHLY_COLS = ["signups", "stockout_rate", "fill_rate", "year", "month_num", "quarter", "rev_lag_1", "rev_lag_3_avg",
                "orders_lag_1"]


def monthly_table(cat) -> DataFrame:
    from kartlane.operators import facts as FX
    of = FX.order_fact(cat)
    return FE.monthly_features(FE.monthly_panel(of, FX.customer_fact(cat), FX.inventory_fact(cat)))


def _monthly_design(rows: DataFrame, label=None, keep=("Date",)) -> DataFrame:
    rows = rows.withColumns({"series": F.lit(PM.TOTAL), "Date": F.col("month")})
    return linear.design(rows, ["series"], MONTHLY_COLS, label, keep=keep, missing=label is None)


def monthly_fit(rows: DataFrame, settings: B.Settings = PM.MONTHLY) -> DataFrame:
    """Boosted model of the monthly revenue on what is known when a month is forecast."""
    return materialize(B.fit(_monthly_design(rows, F.col("revenue")), ["series"], settings))


def monthly_predict(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``month, y, yhat, best_iteration, limit_hit`` of the rows; unknown features count as larger than all known values."""
    d = _monthly_design(rows.withColumn("y", F.col("revenue").cast("double")), keep=("Date", "y"))
    return B.predict(d, models, ["series"]).select(F.col("Date").alias("month"), "y", F.col("prediction").alias("yhat"), "best_iteration", "limit_hit")


def rollforward_monthly(cat, steps: int = 6, settings: B.Settings = PM.MONTHLY) -> DataFrame:
    """Monthly model rolled forward ``steps`` months, refreshing rev_lag_1 from predictions.

    Like the workload, rev_lag_3_avg and the other lagged columns are carried from the last
    observed month.  Each step predicts one row (the next month).
    """
    mp = materialize(monthly_table(cat))
    models = monthly_fit(mp, settings)
    cur, out = mp.orderBy(F.desc("month")).limit(1), None       # one row: the feature carrier
    for _ in range(steps):
        m = F.add_months("month", 1)
        nxt = cur.select(m.alias("month"), "signups", "stockout_rate", "fill_rate", F.year(m).alias("year"),
                         F.month(m).alias("month_num"), F.quarter(m).alias("quarter"), F.col("revenue").alias("rev_lag_1"),
                         "rev_lag_3_avg", "orders_lag_1")
        p = monthly_predict(nxt.withColumn("revenue", F.lit(None).cast("double")), models)
        cur = materialize(nxt.join(p.select("month", F.col("yhat").alias("revenue"), "best_iteration", "limit_hit"), "month"))
        p = cur.select("month", "revenue", "best_iteration", "limit_hit")
        out = p if out is None else out.unionByName(p)
    return out


# --- the recursive baseline, without a loop over its days

def lag_weights(weights: list[float]) -> np.ndarray:
    """Weight of each of the last days, the most recent first, in one step of the baseline."""
    from kartlane.operators import forecast as FC
    w = np.zeros(max(FC.BASELINE_LAGS))
    for k, x in zip(FC.BASELINE_LAGS, weights):
        w[k - 1] += x
    for n, x in zip(FC.BASELINE_ROLLS, weights[len(FC.BASELINE_LAGS):]):
        w[:n] += x / n
    return w


def horizon_matrix(w: np.ndarray, days: int) -> np.ndarray:
    """``(days, len(w))``: each day ahead as a combination of the last ``len(w)`` days, the most recent first.

    The rows of the companion matrix' powers that belong to the newest day: those of m
    days times the m-th power give those of the next m, so the number of days doubles with each product.
    """
    power = np.eye(len(w), k=-1)
    power[0] = w
    rows = w[None].copy()
    while len(rows) < days:
        rows = np.vstack([rows, rows @ power])
        power = power @ power
    return rows[:days]


def calibrated_horizon(w: np.ndarray, factor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Days ahead of ``y(t) = factor(t) * sum w(k) y(t - k)``: one triangular system for all days.

    ``last``: the last days, the most recent first.
    """
    days, n = len(factor), len(w)
    lagged = np.concatenate([w, np.zeros(max(0, days - n))])
    ahead = np.subtract.outer(np.arange(days), np.arange(days))                 # how many days earlier a day of the horizon lies
    inner = np.where(ahead > 0, lagged[np.maximum(ahead, 1) - 1], 0.0)
    reach = np.add.outer(np.arange(days), np.arange(n))                         # lag of a known day, less one
    known = np.where(reach < n, w[np.minimum(reach, n - 1)], 0.0) @ last
    return np.linalg.solve(np.eye(days) - factor[:, None] * inner, factor * known)


def recursive_linear(cat, weights: list[float] | None = None, horizon_days: int = 548, calibrated: bool = True,
                     long: DataFrame | None = None) -> DataFrame:
    """Roll-forward of the weighted baseline (times calibration) per (series, target), without a step for each day.

    A day ahead is linear in the last ``max(lag)`` days. Uncalibrated, all series share one
    matrix, found by doubling; a calibrated series solves one triangular system. Weights and values
    must not be negative, so the floor at 0 never acts; series shorter than the longest lag are
    reported as skipped.
    """
    from kartlane.functions.exprs import weekday_mon0
    from kartlane.operators import forecast as FC
    w = lag_weights(weights or FC.DEFAULT_BASELINE_WEIGHTS)
    if (w < 0).any():
        raise ValueError("negative weights: the floor at 0 would act")
    n = len(w)
    long = materialize(FE.to_long(cat.table("sales_panel")) if long is None else long)
    keys = PM.SERIES
    back = Window.partitionBy(*keys).orderBy(F.desc("Date"))
    last = (long.where("y is not null").withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).groupBy(*keys)
            .agg(F.max("Date").alias("origin"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "y"))), lambda x: x.y).alias("last")))
    if calibrated:
        feats = FC.baseline_raw(FE.baseline_lags(long), weights or FC.DEFAULT_BASELINE_WEIGHTS)
        fac = FC.calibration_factors(feats, F.col("pred").isNotNull())
        month = fac.where("level = 'month'").select(*keys, "month", F.col("factor").alias("fm"))
        day = fac.where("level = 'weekday_month'").select(*keys, "month", "dayofweek", F.col("factor").alias("fw"))
        days = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("h"), F.date_add("origin", F.col("h")).alias("d"))
        days = days.withColumns({"month": F.month("d"), "dayofweek": weekday_mon0("d")})
        # at most the horizon's days a series
        grid = (days.join(month, [*keys, "month"], "left").join(day, [*keys, "month", "dayofweek"], "left").groupBy(*keys)
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("h", (F.coalesce("fm", F.lit(1.0)) * F.when(F.col("fm").isNull(), 1.0).otherwise(
                    F.coalesce("fw", F.lit(1.0)))).alias("f")))), lambda x: x.f).alias("factor")))
        last = last.join(grid, keys)
    else:
        last = last.withColumn("factor", F.lit(None).cast("array<double>"))
    steps = None if calibrated else horizon_matrix(w, horizon_days)

    def roll(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for i in range(b.num_rows):
                past = b.column(3)[i].values.to_numpy()
                if len(past) < n:
                    out.append(None)
                elif (past < 0).any():
                    raise ValueError("negative values: the floor at 0 would act")
                else:
                    out.append(calibrated_horizon(w, b.column(4)[i].values.to_numpy(), past) if calibrated else steps @ past)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.float64()))], [*keys, "origin", "path"])

    path = last.select(*keys, "origin", "last", "factor").mapInArrow(roll, "series_id string, target string, origin date, path array<double>")
    return (path.select(*keys, "origin", F.posexplode_outer("path").alias("h", "yhat"))
            .select(*keys, F.date_add("origin", F.col("h") + 1).alias("Date"), "yhat", F.col("h").isNull().alias("skipped")))
