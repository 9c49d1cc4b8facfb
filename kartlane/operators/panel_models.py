"""Models of a panel: every (fold, series, target) is fitted in the same job.

The panel holds one row per (series, day): the series of the market segments and
``total``, their sum. Folds are date bounds (a broadcast table of three rows).
Predictions are rows ``(model, fold, series_id, target, Date, y, yhat)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartlane.operators import boosting as B
from kartlane.operators import evaluate as EV
from kartlane.operators import features as FE
from kartlane.operators import linear
from kartlane.operators.windows import lag, rolling
from kartlane.session import cut_lineage
from kartlane.sources.inline import fold_table

VAL_YEAR = 2000
TOTAL = "total"
# ---------------------------------------------------------------------------
# FIXED VALUES - the workload's boosting parameters.
# ---------------------------------------------------------------------------
TWO_PHASE = B.Settings(rounds=5000, step=0.03, depth=6, leaf=30, l2=1.0, rows=0.85, columns=0.85, every=5, patience=300, holdout=180)
CANDIDATES = {
    "gbt_trial_1": B.Settings(rounds=500, step=0.03, depth=4, leaf=20, rows=0.9, columns=0.9),
    "gbt_trial_2": B.Settings(rounds=800, step=0.02, depth=5, leaf=20, rows=0.9, columns=0.8),
    "gbt_trial_3": B.Settings(rounds=500, step=0.05, depth=3, leaf=20, rows=0.8, columns=0.9),
}
RESIDUAL = {
    "residual_lgbm": B.Settings(rounds=350, step=0.035, depth=4, leaf=20, rows=0.9, columns=0.9),
    "residual_xgb": B.Settings(rounds=350, step=0.035, depth=4, leaf=3, l2=1.0, rows=0.9, columns=0.9),
    "direct_lgbm": B.Settings(rounds=350, step=0.035, depth=4, leaf=20, rows=0.9, columns=0.9),
}
MONTHLY = B.Settings(rounds=300, step=0.05, depth=3)
CLEAN_ERA, QUARTER_BOOST = (1996, 1999), 3.0
CHANGEPOINTS, CHANGEPOINT_RANGE, CHANGEPOINT_SCALE, SEASON_SCALE = 25, 0.8, 0.05, 10.0

SERIES = ["series_id", "target"]
GROUP = ["fold", *SERIES]
OUT = ["model", *GROUP, "Date", "y", "yhat"]


def panel(cat) -> DataFrame:
    """``(series_id, Date, Revenue, COGS)``: the segments and ``total``, written once."""
    def build():
        total = cat.table("sales").select(F.lit(TOTAL).alias("series_id"), "Date", "Revenue", "COGS")
        return cat.table("sales_panel").select("series_id", "Date", "Revenue", "COGS").unionByName(total)
    return cat.shared("panel_all", build)


def calendar(cat) -> tuple[DataFrame, list[str]]:
    """The 81 features of every day of the panel and of the template, written once, and their names."""
    def build():
        days = cat.table("sales").select("Date").unionByName(cat.table("sample_submission").select("Date")).distinct()
        return FE.build_features(cat.spark, days)
    f = cat.shared("calendar_features", build)
    return f, [c for c in f.columns if c != "Date"]


def calendar_rows(cat) -> tuple[DataFrame, list[str]]:
    """Long panel with the calendar features of its days."""
    f, cols = calendar(cat)
    return FE.to_long(panel(cat)).join(f, "Date"), cols


def lag_rows(cat) -> tuple[DataFrame, list[str]]:
    """Long panel with the 68 one-step features: lags and rolling statistics of both targets, their ratio, the calendar."""
    def build():
        wide = panel(cat)
        lags = cut_lineage(FE.lag_rolling(FE.to_long(wide)))
        names = [c for c in lags.columns if c.startswith(("lag_", "roll_", "expanding_"))]
        f = FE.cross_target_lags(wide).select("series_id", "Date", "gross_margin_lag_1", "cogs_to_revenue_lag_1")
        for t in FE.TARGETS:
            own = lags.filter(F.col("target") == t).select("series_id", "Date", *[F.col(c).alias(f"{t}_{c}") for c in names])
            f = f.join(own, ["series_id", "Date"])
        return FE.cyclical(FE.calendar_basic(f))
    f = cat.shared("lag_features", build)
    return FE.to_long(panel(cat)).join(f, ["series_id", "Date"]), [c for c in f.columns if c not in ("series_id", "Date")]


def in_folds(rows: DataFrame, spark, val_year: int = VAL_YEAR) -> DataFrame:
    return EV.temporal_folds(rows, fold_table(spark, val_year))


def ridge_panel(cat, name: str, rows: DataFrame, cols: list[str], alpha: float, log: bool = False, label=None, weight=None,
                extra: tuple[str, ...] = (), add: str | None = None) -> DataFrame:
    """Ridge of every fold, series and target on the training days, applied to the validation days; one job for all.

    ``rows`` are in folds. With ``log`` the logarithm of the target is fitted, on days with a
    positive one. ``extra`` are further keys, ``add`` is a column that the prediction is added to.
    """
    keys = [*GROUP, *extra]
    fitted = rows.where(F.col("role") == "train")
    if log:
        fitted = fitted.where(F.col("y") > 0)
    if label is None:
        label = F.log("y") if log else F.col("y")
    models = linear.fit(linear.design(fitted, keys, cols, label, weight), keys, alpha)
    seen = linear.design(rows.where(F.col("role") == "valid"), keys, cols, keep=("Date", "y", *([add] if add else [])))
    p = linear.predict(seen, models, keys)
    yhat = F.exp("prediction") if log else F.col("prediction") + (F.col(add) if add else F.lit(0.0))
    return p.select(F.lit(name).alias("model"), *GROUP, "Date", "y", yhat.alias("yhat"))


RIDGE_LOG_ALPHA, RIDGE_LAG_ALPHA = 3.0, 10.0


def _folded(cat, rows: tuple[DataFrame, list[str]]) -> tuple[DataFrame, list[str]]:
    return in_folds(rows[0], cat.spark), rows[1]


def ridge_log(cat) -> DataFrame:
    """Ridge on the standardised calendar features, logarithm of the target."""
    return ridge_panel(cat, "ridge_log", *_folded(cat, calendar_rows(cat)), RIDGE_LOG_ALPHA, log=True)


def ridge_lag(cat) -> DataFrame:
    """Ridge on the standardised one-step features."""
    return ridge_panel(cat, "ridge_lag", *_folded(cat, lag_rows(cat)), RIDGE_LAG_ALPHA)


def least_squares(cat) -> DataFrame:
    """Least squares on the one-step features; of columns that depend on each other the first ones count."""
    return ridge_panel(cat, "linear", *_folded(cat, lag_rows(cat)), 0.0)


def quarter_ridge(cat) -> DataFrame:
    """Era-weighted ridge on the calendar features, one a quarter, whose days count thrice; each day asks its quarter's."""
    rows, cols = _folded(cat, calendar_rows(cat))
    rows = (rows.withColumn("specialty", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)])))
            .where((F.col("role") == "train") | (F.col("specialty") == F.quarter("Date"))))
    weight = era_weight() * F.when(F.col("specialty") == F.quarter("Date"), QUARTER_BOOST).otherwise(1.0)
    return ridge_panel(cat, "quarter_ridge", rows, cols, RIDGE_LOG_ALPHA, log=True, weight=weight, extra=("specialty",))


def _residual_ridge(cat, name: str, rows: tuple[DataFrame, list[str]], alpha: float) -> DataFrame:
    base = calibrated(cat).select(*GROUP, "Date", "role", F.col("pred_calibrated").alias("_base"))
    both = rows[0].join(base, [*SERIES, "Date"])
    return ridge_panel(cat, name, both.where("_base is not null"), rows[1], alpha, label=F.col("y") - F.col("_base"), add="_base")


def residual_calendar(cat) -> DataFrame:
    """Ridge of the calibrated baseline's residual on the calendar features, added back to it."""
    return _residual_ridge(cat, "residual_calendar", calendar_rows(cat), RIDGE_LOG_ALPHA)


def residual_lags(cat) -> DataFrame:
    """Ridge of the calibrated baseline's residual on the one-step features, added back to it."""
    return _residual_ridge(cat, "residual_lags", lag_rows(cat), RIDGE_LAG_ALPHA)


# --- boosted models

def boosted(rows: DataFrame, cols: list[str], keys: list[str], settings, label, weight=None) -> tuple[DataFrame, DataFrame]:
    """Models of the rows with the role ``train``, and their predictions of those with the role ``valid``.

    ``rows`` holds ``keys, Date, y, role`` and ``cols``; the models are written once.
    """
    fitted = linear.design(rows.where(F.col("role") == "train"), keys, cols, label, weight, keep=("Date",))
    models = cut_lineage(B.fit(fitted, keys, settings))
    return models, B.predict(linear.design(rows.where(F.col("role") == "valid"), keys, cols, keep=("Date", "y")), models, keys)


def era_weight(date="Date"):
    year = F.year(date)
    return F.when(year.between(*CLEAN_ERA), 1.0).otherwise(0.01)


def two_phase(rows: DataFrame, cols: list[str], name: str, keys: list[str] = GROUP, settings: B.Settings = TWO_PHASE) -> DataFrame:
    """Era-weighted boosting of the logarithm: the last days choose the rounds, then all rows are fitted with them."""
    rows = rows.where("role = 'valid' or y > 0").withColumn("model", F.lit(name))
    _, p = boosted(rows, cols, ["model", *keys], settings, F.log("y"), era_weight())
    return p.withColumn("yhat", F.exp("prediction")).select("model", *keys, "Date", "y", "yhat", "best_iteration", "limit_hit", "holdout_loss")


def specialists(rows: DataFrame, cols: list[str], name: str = "quarter_specialist", keys: list[str] = GROUP,
                settings: B.Settings = TWO_PHASE) -> DataFrame:
    """One two-phase model a quarter, whose days count thrice; each day is predicted by its quarter's model."""
    rows = (rows.where("role = 'valid' or y > 0").withColumn("model", F.lit(name))
            .withColumn("specialty", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)])))
            .where((F.col("role") == "train") | (F.col("specialty") == F.quarter("Date"))))
    weight = era_weight() * F.when(F.col("specialty") == F.quarter("Date"), QUARTER_BOOST).otherwise(1.0)
    _, p = boosted(rows, cols, ["model", *keys, "specialty"], settings, F.log("y"), weight)
    return p.withColumn("yhat", F.exp("prediction")).select("model", *keys, "Date", "y", "yhat", "best_iteration", "limit_hit", "holdout_loss")


def only(rows: DataFrame, series: str | None = None, fold: str | None = None) -> DataFrame:
    if series:
        rows = rows.where(F.col("series_id") == series)
    return rows.where(F.col("fold") == fold) if fold else rows


def candidates(cat, series: str = TOTAL, fold: str = "A", settings: dict = CANDIDATES) -> tuple[DataFrame, DataFrame, list[str]]:
    """Models and predictions of the boosting candidates on the one-step features, and the features' names."""
    rows, cols = lag_rows(cat)
    rows = only(in_folds(rows, cat.spark), series, fold).withColumn("model", F.explode(F.array(*[F.lit(m) for m in settings])))
    keys = ["model", *GROUP]
    fitted = linear.design(rows.where("role = 'train'"), keys, cols, F.col("y"), keep=("Date",))
    models = cat.shared(f"candidates_{series}_{fold}_{hash(tuple(settings.items()))}", lambda: B.fit(fitted, keys, settings))
    p = B.predict(linear.design(rows.where("role = 'valid'"), keys, cols, keep=("Date", "y")), models, keys)
    return models, p.withColumn("yhat", F.greatest("prediction", F.lit(0.0))), cols


def observed_and_template(cat, rows: DataFrame) -> DataFrame:
    """``rows`` of all observed days as ``train``, and of the template's days as ``valid``."""
    f, cols = calendar(cat)
    days = cat.table("sample_submission").select("Date").join(f, "Date")
    series = rows.select(*SERIES).distinct()
    ahead = series.join(F.broadcast(days)).select(*SERIES, "Date", F.lit(None).cast("double").alias("y"), *cols, F.lit("valid").alias("role"))
    return rows.select(*SERIES, "Date", "y", *cols).withColumn("role", F.lit("train")).unionByName(ahead)


# --- forecasts beyond the data: a model for each block of the horizon

BLOCKS = ((1, 182), (183, 364), (365, 548))   # days ahead; each block uses lags of at least its last day


def block_features(long: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """Lags and rolling means of ``y`` that are known ``least`` days ahead."""
    season = 364 * -(-least // 364)
    cols = {f"known_{k}": lag("y", SERIES, "Date", k) for k in sorted({least, least + 1, least + 7, season, season + 1, season + 7})}
    for n in (7, 30, 90):
        cols[f"known_mean_{n}"] = rolling("y", SERIES, "Date", -(least + n - 1), -least, "avg", n)
    return long.withColumns(cols), list(cols)


def direct(cat, series: str = TOTAL, settings: B.Settings = TWO_PHASE) -> DataFrame:
    """Direct forecast of the template: one boosted model for each horizon block, with the lags that are known there.

    ``holdout_loss`` is that of the block's model on the last days, ``calendar_loss``
    that of a model on the calendar features alone.
    """
    rows, cols = calendar_rows(cat)
    base = cut_lineage(observed_and_template(cat, only(rows, series)))
    last = base.where("role = 'train'").groupBy(*SERIES).agg(F.max("Date").alias("last"))
    ahead = F.datediff("Date", "last")
    out = None
    for first, end in BLOCKS:
        own, known = block_features(base, end)
        own = own.join(last, SERIES).where((F.col("role") == "train") | ahead.between(first, end)).drop("last")
        p = two_phase(own, cols + known, "direct", SERIES, settings).withColumn("block", F.lit(end))
        out = p if out is None else out.unionByName(p)
    alone = two_phase(base, cols, "calendar", SERIES, settings).groupBy(*SERIES).agg(F.max("holdout_loss").alias("calendar_loss"))
    return out.join(alone, SERIES)


# --- trend, changepoints, seasons, promotions

def structural(rows: DataFrame, name: str = "structural", keys: list[str] = GROUP, train_from: int = 1997,
               changepoints: int = CHANGEPOINTS) -> tuple[DataFrame, DataFrame]:
    """Models and predictions of a trend whose changepoints are chosen by an L1 penalty, with seasons and promotions.

    The logarithm is fitted on days from ``train_from`` on; time runs from 0 to 1 over
    them. Changepoints lie evenly over the first ``CHANGEPOINT_RANGE`` of it; those that the
    data do not call for have a slope change of exactly 0.
    """
    used = rows.where((F.col("role") == "valid") | (F.col("y") > 0) & (F.year("Date") >= train_from))
    span = used.where("role = 'train'").groupBy(*keys).agg(F.min("Date").alias("_a"), F.max("Date").alias("_b"))
    t = F.datediff("Date", "_a") / F.greatest(F.datediff("_b", "_a"), F.lit(1))
    knots = [CHANGEPOINT_RANGE * (i + 1) / changepoints for i in range(changepoints)]
    hinges = {f"hinge_{i}": F.greatest(F.col("_t") - F.lit(k), F.lit(0.0)) for i, k in enumerate(knots)}
    seasons = [f"{s}_y{k}" for k in (1, 2, 3, 4, 5) for s in ("sin", "cos")] + [f"{s}_w{k}" for k in (1, 2) for s in ("sin", "cos")]
    promos = [c for c in rows.columns if c.startswith("promo_") and not c.endswith(("_since", "_until", "_disc"))]
    cols = ["_t", *hinges, *seasons, *promos]
    f = used.join(span, keys).withColumn("_t", t).withColumns(hinges)
    l1 = [0.0] + [1 / CHANGEPOINT_SCALE] * len(hinges) + [0.0] * (len(cols) - 1 - len(hinges))
    l2 = [0.0] * (1 + len(hinges)) + [SEASON_SCALE ** -2] * (len(cols) - 1 - len(hinges))
    models = cut_lineage(linear.fit_lasso(linear.design(f.where("role = 'train'"), keys, cols, F.log("y")), keys, l1, l2))
    p = linear.predict(linear.design(f.where("role = 'valid'"), keys, cols, keep=("Date", "y")), models, keys)
    return models, p.select(F.lit(name).alias("model"), *keys, "Date", "y", F.exp("prediction").alias("yhat"))


# --- residuals of the calibrated baseline

def calibrated(cat, val_year: int = VAL_YEAR) -> DataFrame:
    """One-step calibrated baseline of every fold, its factors learnt on the fold's training days; with the fold's roles, written once."""
    from kartlane.operators import forecast as FC
    def build():
        b = cut_lineage(FC.baseline_raw(FE.baseline_lags(FE.to_long(panel(cat)))))
        out = None
        for f in fold_table(cat.spark, val_year).collect():   # three rows
            factors = FC.calibration_factors(b, (F.col("Date") <= F.lit(f.train_end)) & F.col("pred").isNotNull())
            one = in_folds(FC.apply_calibration(b, factors), cat.spark, val_year).where(F.col("fold") == f.fold)
            out = one if out is None else out.unionByName(one)
        return out
    return cat.shared(f"calibrated_{val_year}", build)


def residual_rows(cat) -> tuple[DataFrame, list[str]]:
    """Calibrated baseline with the features of the residual learners: baseline lags, growth, events, calendar, trend."""
    from kartlane.operators import forecast as FC
    lg = FE.yoy_growth(FE.to_long(panel(cat))).drop("y")
    f = calibrated(cat).join(lg, [*SERIES, "Date"])
    start = f.groupBy(*SERIES).agg(F.min("Date").alias("data_start"))
    f = FE.fourier_trend(FE.event_distance(FE.events_v2(FE.calendar_basic(f.join(start, SERIES)))))
    grown = [c for c in f.columns if c.startswith("yoy_") or c.endswith("_yoy_growth")]
    cols = [c for c in f.columns if c.startswith(("event_", "days_to_", "is_", "sin_", "cos_"))
            or c in ("year", "quarter", "month", "weekofyear", "dayofyear", "dayofmonth", "dayofweek", "days_from_start")]
    return f.fillna(0.0, grown), [*FC.BASELINE_FEATURES, *grown, *cols]


def residual_models(cat, fold: str | None = "A", series: str | None = None, settings: dict = RESIDUAL) -> DataFrame:
    """The residual learners, added back to the baseline, and the direct learner of Revenue; best round as set, not searched."""
    rows, cols = residual_rows(cat)
    rows = cut_lineage(only(rows, series, fold).withColumn("model", F.explode(F.array(*[F.lit(m) for m in settings])))
                       .where("model not like 'direct%' or target = 'Revenue'"))
    base = F.when(F.col("model").startswith("direct"), 0.0).otherwise(F.col("pred_calibrated"))
    keys = ["model", *GROUP]
    fitted = linear.design(rows.where("role = 'train'"), keys, cols, F.col("y") - base, keep=("Date",))
    seen = linear.design(rows.where("role = 'valid'").withColumn("_base", base), keys, cols, keep=("Date", "y", "_base"))
    p = B.predict(seen, cut_lineage(B.fit(fitted, keys, settings)), keys, "Date date, y double, _base double")
    return p.select(*keys, "Date", "y", (F.col("prediction") + F.col("_base")).alias("yhat"), "best_iteration", "limit_hit")


# --- out-of-fold predictions

def _baseline(cat, name: str) -> DataFrame:
    """One relational baseline of every fold, forecast from the last training day (the weighted one from actual lags)."""
    from kartlane.operators import forecast as FC
    long = FE.to_long(panel(cat))
    if name == "calibrated_baseline":
        return calibrated(cat).where("role = 'valid'").select(F.lit(name).alias("model"), *GROUP, "Date", "y", F.col("pred_calibrated").alias("yhat"))
    if name == "weighted_baseline":
        seen = in_folds(FC.weighted_baseline_one_step(long), cat.spark).where("role = 'valid'")
        return seen.select(F.lit(name).alias("model"), *GROUP, "Date", "y", "yhat")
    season = {"seasonal_naive": 365, "lag364": 364}[name]
    out = None
    for f in fold_table(cat.spark, VAL_YEAR).collect():   # three rows
        ahead = long.where(F.col("Date").between(F.lit(f.val_start), F.lit(f.val_end))).select(*SERIES, "Date")
        p = FC.with_actuals(FC.naive_closed_form(long, ahead, str(f.train_end), season), long, name).withColumn("fold", F.lit(f.fold)).select(*OUT)
        out = p if out is None else out.unionByName(p)
    return out


BASELINES = ("seasonal_naive", "lag364", "weighted_baseline", "calibrated_baseline")
LEARNERS = {"ridge_log": ridge_log, "ridge_lag": ridge_lag, "linear": least_squares, "quarter_ridge": quarter_ridge,
            "residual_calendar": residual_calendar, "residual_lags": residual_lags}
BOOSTED = ("gbt_weighted_2phase", "quarter_specialist", *RESIDUAL)


def _boosted_member(cat, name: str) -> DataFrame:
    if name in RESIDUAL:
        return residual_models(cat, None, TOTAL, {name: RESIDUAL[name]})
    rows, cols = _folded(cat, calendar_rows(cat))
    return (two_phase if name == "gbt_weighted_2phase" else specialists)(only(rows, TOTAL), cols, name)


def out_of_fold(cat, models=(*BASELINES, *LEARNERS)) -> DataFrame:
    """``model, fold, series_id, target, Date, y, yhat``: what each model, fitted on a fold's training days, predicts of its
    validation days. Each model is written once (``Catalog.shared``); a learner's ``yhat`` keeps five digits; days without a prediction are absent.

    ``BASELINES`` and ``LEARNERS`` cover all series, ``BOOSTED`` the total.
    """
    def build(m):
        p = _baseline(cat, m) if m in BASELINES else LEARNERS[m](cat) if m in LEARNERS else _boosted_member(cat, m)
        p = p.select(*OUT).where("yhat is not null")
        if m in BASELINES:
            return p
        # sums of a hundred terms differ in their last digits
        return p.withColumn("yhat", F.when(F.col("yhat").isNotNull(), F.format_string("%.4e", "yhat")).cast("double"))

    out = None
    for m in models:
        p = cat.shared(f"oof_{m}", lambda m=m: build(m))
        out = p if out is None else out.unionByName(p)
    return out


def side_by_side(oof: DataFrame, models) -> DataFrame:
    """``fold, series_id, target, Date, y`` and one column a model, of the days that all of them predict."""
    wide = oof.groupBy(*GROUP, "Date").agg(F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models])
    return wide.dropna(subset=list(models))
