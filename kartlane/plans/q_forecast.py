"""Forecast, split and metric queries.

Relational operators carry DuckDB twins; MLlib fits are registered without
SQL (rows-only check).  Panel: daily Revenue / COGS per market segment;
validation year VAL_YEAR with forecast origin the last day before it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kartlane.operators import evaluate as EV
from kartlane.operators import features as FE
from kartlane.operators import forecast as FC
from kartlane.operators import panel_models as PM
from kartlane.plans import linear_sql as LS
from kartlane.plans.oracle import D, R, STANDINS, with_views as W
from kartlane.plans.registry import register
from kartlane.sources.inline import fold_table

VAL_YEAR = 2000
ORIGIN = f"{VAL_YEAR - 1}-12-31"
H_DAYS = 366
K = FC.K


def _long(cat):
    # written once: the models of one query scan the small panel instead of deriving it each
    return FE.to_long(cat.checkpointed("sales_panel"))


def _hz(cat):
    return FC.horizon_spine(_long(cat), ORIGIN, H_DAYS)


def _naive(cat, L, name):
    lg = _long(cat)
    return FC.with_actuals(FC.naive_closed_form(lg, _hz(cat), ORIGIN, L), lg, name)


def _mean3(cat):
    lg = _long(cat)
    p = FC.block_recursive(lg, _hz(cat), ORIGIN, {364: 1 / 3, 365: 1 / 3, 366: 1 / 3}, H_DAYS)
    return FC.with_actuals(p, lg, "mean_364_366")


def _wb(cat):
    lg = _long(cat)
    t = FC.weighted_baseline_one_step(lg).filter(F.year("Date") == VAL_YEAR)
    return t.select(F.lit("weighted_baseline").alias("model"), *K, "Date", "y", "yhat")


def _bfeat(cat):
    return FC.baseline_raw(FE.baseline_lags(_long(cat)))


def _factors(cat):
    b = _bfeat(cat)
    return FC.calibration_factors(b, (F.col("Date") < F.lit(f"{VAL_YEAR}-01-01").cast("date"))
                                  & F.col("pred").isNotNull())


def _calibrated(cat):
    b = _bfeat(cat)
    return FC.apply_calibration(b, _factors(cat))


def _models(cat):
    cal = _calibrated(cat).filter(F.year("Date") == VAL_YEAR).select(
        F.lit("calibrated_baseline").alias("model"), *K, "Date", "y", F.col("pred_calibrated").alias("yhat"))
    return [_naive(cat, 365, "seasonal_naive"), _naive(cat, 364, "lag364"), _mean3(cat), _wb(cat), cal]


# ---------------------------------------------------------------------- SQL library
_VS = f"DATE '{ORIGIN}'"
STANDINS.update({
    "v_hz": (["v_panel_long"], f"""
        SELECT k.series_id, k.target, CAST(unnest(generate_series({_VS} + 1, {_VS} + {H_DAYS}, INTERVAL 1 DAY)) AS DATE) AS Date
        FROM (SELECT DISTINCT series_id, target FROM v_panel_long) k"""),
    "v_naive365": (["v_hz", "v_panel_long"], f"""
        SELECT 'seasonal_naive' AS model, h.series_id, h.target, h.Date, a.y, s.y AS yhat FROM v_hz h
        LEFT JOIN v_panel_long s ON s.series_id = h.series_id AND s.target = h.target AND s.Date <= {_VS}
             AND s.Date = h.Date - CAST(365 * ceil(date_diff('day', {_VS}, h.Date) / 365.0) AS INTEGER)
        LEFT JOIN v_panel_long a ON a.series_id = h.series_id AND a.target = h.target AND a.Date = h.Date"""),
    "v_lag364": (["v_hz", "v_panel_long"], f"""
        SELECT 'lag364' AS model, h.series_id, h.target, h.Date, a.y, s.y AS yhat FROM v_hz h
        LEFT JOIN v_panel_long s ON s.series_id = h.series_id AND s.target = h.target AND s.Date <= {_VS}
             AND s.Date = h.Date - CAST(364 * ceil(date_diff('day', {_VS}, h.Date) / 364.0) AS INTEGER)
        LEFT JOIN v_panel_long a ON a.series_id = h.series_id AND a.target = h.target AND a.Date = h.Date"""),
    "v_mean3_b1": (["v_hz", "v_panel_long"], f"""
        SELECT h.series_id, h.target, h.Date,
               k4.y * {1 / 3!r} + k5.y * {1 / 3!r} + k6.y * {1 / 3!r} AS yhat
        FROM v_hz h
        LEFT JOIN (SELECT * FROM v_panel_long WHERE Date <= {_VS}) k4
          ON k4.series_id = h.series_id AND k4.target = h.target AND k4.Date + 364 = h.Date
        LEFT JOIN (SELECT * FROM v_panel_long WHERE Date <= {_VS}) k5
          ON k5.series_id = h.series_id AND k5.target = h.target AND k5.Date + 365 = h.Date
        LEFT JOIN (SELECT * FROM v_panel_long WHERE Date <= {_VS}) k6
          ON k6.series_id = h.series_id AND k6.target = h.target AND k6.Date + 366 = h.Date
        WHERE date_diff('day', {_VS}, h.Date) <= 364"""),
    "v_mean3": (["v_mean3_b1", "v_hz", "v_panel_long"], f"""
        WITH known AS (SELECT series_id, target, Date, y AS v FROM v_panel_long WHERE Date <= {_VS}
                       UNION ALL SELECT series_id, target, Date, yhat FROM v_mean3_b1),
        b2 AS (SELECT h.series_id, h.target, h.Date,
                      k4.v * {1 / 3!r} + k5.v * {1 / 3!r} + k6.v * {1 / 3!r} AS yhat
               FROM v_hz h
               LEFT JOIN known k4 ON k4.series_id = h.series_id AND k4.target = h.target AND k4.Date + 364 = h.Date
               LEFT JOIN known k5 ON k5.series_id = h.series_id AND k5.target = h.target AND k5.Date + 365 = h.Date
               LEFT JOIN known k6 ON k6.series_id = h.series_id AND k6.target = h.target AND k6.Date + 366 = h.Date
               WHERE date_diff('day', {_VS}, h.Date) > 364)
        SELECT 'mean_364_366' AS model, p.series_id, p.target, p.Date, a.y, p.yhat
        FROM (SELECT * FROM v_mean3_b1 UNION ALL SELECT * FROM b2) p
        LEFT JOIN v_panel_long a USING (series_id, target, Date)"""),
    "v_wb": (["v_panel_long"], f"""
        SELECT 'weighted_baseline' AS model, series_id, target, Date, y, yhat FROM (
          SELECT series_id, target, Date, y,
                 0.5 * lag(y, 364) OVER w + 0.3 * lag(y, 7) OVER w
                 + 0.2 * CASE WHEN count(y) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) >= 30
                              THEN avg(y) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS yhat
          FROM v_panel_long WINDOW w AS (PARTITION BY series_id, target ORDER BY Date))
        WHERE year(Date) = {VAL_YEAR}"""),
    "v_bfeat": (["v_panel_long"], """
        SELECT *, """ + " + ".join(f"{c} * {float(w)!r}" for c, w in zip(FC.BASELINE_FEATURES, FC.DEFAULT_BASELINE_WEIGHTS))
        + """ AS pred FROM (
          SELECT series_id, target, Date, y,
                 lag(y, 364) OVER w AS lag_364, lag(y, 365) OVER w AS lag_365, lag(y, 371) OVER w AS lag_371,
                 """ + ", ".join(
            f"CASE WHEN count(y) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n} "
            f"THEN avg(y) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS rolling_{n}" for n in (7, 30, 90))
        + """ FROM v_panel_long WINDOW w AS (PARTITION BY series_id, target ORDER BY Date))"""),
    "v_factors": (["v_bfeat"], f"""
        WITH f AS (SELECT series_id, target, Date, month(Date) AS month, isodow(Date) - 1 AS dayofweek,
                          coalesce(y / nullif(pred, 0), 1.0) AS ratio
                   FROM v_bfeat WHERE Date < DATE '{VAL_YEAR}-01-01' AND pred IS NOT NULL),
        mf AS (SELECT series_id, target, month, count(*) AS n,
                      least(greatest(1.0 + (quantile_cont(ratio, 0.5) - 1.0) * (count(*) / (count(*) + 60.0)), 0.8), 1.2) AS factor
               FROM f GROUP BY 1, 2, 3),
        wf AS (SELECT f.series_id, f.target, f.month, f.dayofweek, count(*) AS n,
                      least(greatest(1.0 + (quantile_cont(f.ratio / mf.factor, 0.5) - 1.0) * (count(*) / (count(*) + 20.0)), 0.9), 1.1) AS factor
               FROM f JOIN mf USING (series_id, target, month) GROUP BY 1, 2, 3, 4)
        SELECT series_id, target, 'month' AS level, month, CAST(NULL AS INTEGER) AS dayofweek, factor, n FROM mf
        UNION ALL SELECT series_id, target, 'weekday_month', month, dayofweek, factor, n FROM wf"""),
    "v_cal": (["v_bfeat", "v_factors"], """
        SELECT b.*, b.pred * coalesce(m.factor, 1.0) * coalesce(w.factor, 1.0) AS pred_calibrated
        FROM v_bfeat b
        LEFT JOIN (SELECT * FROM v_factors WHERE level = 'month') m
          ON m.series_id = b.series_id AND m.target = b.target AND m.month = month(b.Date)
        LEFT JOIN (SELECT * FROM v_factors WHERE level = 'weekday_month') w
          ON w.series_id = b.series_id AND w.target = b.target AND w.month = month(b.Date)
             AND w.dayofweek = isodow(b.Date) - 1"""),
    "v_calm": (["v_cal"], f"""
        SELECT 'calibrated_baseline' AS model, series_id, target, Date, y, pred_calibrated AS yhat
        FROM v_cal WHERE year(Date) = {VAL_YEAR}"""),
    "v_models": (["v_naive365", "v_lag364", "v_mean3", "v_wb", "v_calm"], """
        SELECT * FROM v_naive365 UNION ALL SELECT * FROM v_lag364 UNION ALL SELECT * FROM v_mean3
        UNION ALL SELECT * FROM v_wb UNION ALL SELECT * FROM v_calm"""),
})

_FC_OUT = f"SELECT model, series_id, target, {D('Date')} AS Date, {R('y')} AS y, {R('yhat')} AS yhat FROM "


@register("fc_seasonal_naive", W(_FC_OUT + "v_naive365", "v_naive365"))
def fc_seasonal_naive(cat):
    """y(t - 365), recursively past one season (closed form, one join)."""
    return _naive(cat, 365, "seasonal_naive")


@register("fc_lag364", W(_FC_OUT + "v_lag364", "v_lag364"))
def fc_lag364(cat):
    """Weekday-aligned y(t - 364), recursive."""
    return _naive(cat, 364, "lag364")


@register("fc_mean_364_366", W(_FC_OUT + "v_mean3", "v_mean3"))
def fc_mean_364_366(cat):
    """Mean of lags 364/365/366 by block recursion (2 blocks for a 366-day horizon)."""
    return _mean3(cat)


@register("fc_weighted_baseline", W(_FC_OUT + "v_wb", "v_wb"))
def fc_weighted_baseline(cat):
    """0.5*lag364 + 0.3*lag7 + 0.2*rolling30 (one-step, actual lags)."""
    return _wb(cat)


_MET = f"""(SELECT model, target, avg(abs(y - yhat)) AS MAE, sqrt(avg((y - yhat) * (y - yhat))) AS RMSE,
                   1.0 - sum((y - yhat) * (y - yhat)) / nullif(sum((y - ybar) * (y - ybar)), 0) AS R2
            FROM (SELECT *, avg(y) OVER (PARTITION BY model, target) AS ybar FROM v_models
                  WHERE y IS NOT NULL AND yhat IS NOT NULL) GROUP BY 1, 2)"""
_MET_ALL = f"""(SELECT * FROM {_MET} UNION ALL
                SELECT model, 'average', avg(MAE), avg(RMSE), avg(R2) FROM {_MET} GROUP BY model)"""


@register("ev_metrics", W(f"SELECT model, target, {R('MAE')} AS MAE, {R('RMSE')} AS RMSE, {R('R2')} AS R2 "
                          f"FROM {_MET_ALL}", "v_models"))
def ev_metrics(cat):
    """MAE, RMSE, R2 per (model, target) + average row, for the relational baselines."""
    u = _models(cat)
    t = u[0]
    for m in u[1:]:
        t = t.unionByName(m)
    return EV.metrics(t)


# what the learners and baselines of the folds are compared on: days that all of them predict
SCORED = ("seasonal_naive", "lag364", "weighted_baseline", "calibrated_baseline", "ridge_log", "ridge_lag", "linear")
G = PM.GROUP


def _oof_wide(models):
    """Registers the view of the models' out-of-fold predictions side by side; returns its name."""
    name = LS.oof_view(models).replace("v_oof__", "v_side__")
    STANDINS[name] = ([LS.oof_view(models)], f"""
        SELECT * FROM (SELECT fold, series_id, target, Date, max(y) AS y, {', '.join(f"max(yhat) FILTER (WHERE model = '{m}') AS {m}" for m in models)}
                       FROM {LS.oof_view(models)} GROUP BY 1, 2, 3, 4) WHERE {' AND '.join(f'{m} IS NOT NULL' for m in models)}""")
    return name


def _oof(cat, models):
    return PM.side_by_side(PM.out_of_fold(cat, models), models)


def _oof_long(cat, models):
    return _oof(cat, models).unpivot([*G, "Date", "y"], list(models), "model", "yhat")


_V_SCORED = _oof_wide(SCORED)
_FOLD_MET = f"""(WITH l AS (UNPIVOT {_V_SCORED} ON {', '.join(SCORED)} INTO NAME model VALUE yhat),
    t AS (SELECT fold, model, target, avg(abs(y - yhat)) AS MAE, sqrt(avg((y - yhat) * (y - yhat))) AS RMSE,
                 1.0 - sum((y - yhat) * (y - yhat)) / nullif(sum((y - ybar) * (y - ybar)), 0) AS R2
          FROM (SELECT *, avg(y) OVER (PARTITION BY fold, model, target) AS ybar FROM l) GROUP BY 1, 2, 3)
    SELECT fold, model, 'average' AS target, avg(MAE) AS MAE, avg(RMSE) AS RMSE, avg(R2) AS R2 FROM t GROUP BY 1, 2)"""


@register("fc_oof_predictions", W(f"SELECT model, fold, series_id, target, {D('Date')} AS Date, {R('y')} AS y, {R('yhat')} AS yhat "
                                  f"FROM {LS.oof_view(PM.BASELINES + tuple(PM.LEARNERS))}", LS.oof_view(PM.BASELINES + tuple(PM.LEARNERS))))
def fc_oof_predictions(cat):
    """Rolling-origin predictions of baselines and closed-form learners: every fold, series and target."""
    return PM.out_of_fold(cat)


@register("fc_oof_boosted")
def fc_oof_boosted(cat):
    """Rolling-origin predictions of the boosted members of the total, every fold."""
    return PM.out_of_fold(cat, PM.BOOSTED)


@register("ev_leaderboard", W(f"""
    SELECT fold, model, target, {R('MAE')} AS MAE, {R('RMSE')} AS RMSE, {R('R2')} AS R2,
           row_number() OVER (PARTITION BY fold ORDER BY RMSE, model) AS rank FROM {_FOLD_MET}""", _V_SCORED))
def ev_leaderboard(cat):
    """Models of every fold ranked by average RMSE on their out-of-fold predictions."""
    return EV.leaderboard([EV.metrics(_oof_long(cat, SCORED), ["fold", "model"])], ["fold"])


@register("ev_best_model", W(f"""
    SELECT fold, arg_min(model, (RMSE, model)) AS best_model, {R('min(RMSE)')} AS best_rmse FROM {_FOLD_MET} GROUP BY fold""", _V_SCORED))
def ev_best_model(cat):
    """argmin of average RMSE over the candidates of every fold."""
    return EV.best_model(EV.metrics(_oof_long(cat, SCORED), ["fold", "model"]), ["fold"])


@register("ev_holdout_year", W(f"""
    SELECT {D('Date')} AS Date, CASE WHEN year(Date) < {VAL_YEAR} THEN 'train' ELSE 'valid' END AS role
    FROM v_sales WHERE year(Date) <= {VAL_YEAR}""", "v_sales"))
def ev_holdout_year(cat):
    """train < validation year, validate that year."""
    return EV.holdout_year(cat.table("sales").select("Date"), VAL_YEAR)


@register("ev_temporal_folds", W(f"""
    SELECT f.fold, {D('s.Date')} AS Date, CASE WHEN s.Date <= f.te THEN 'train' ELSE 'valid' END AS role
    FROM v_sales s CROSS JOIN (VALUES
      ('A', DATE '{VAL_YEAR - 1}-12-31', DATE '{VAL_YEAR}-01-01', DATE '{VAL_YEAR}-12-31'),
      ('B', DATE '{VAL_YEAR - 2}-12-31', DATE '{VAL_YEAR - 1}-01-01', DATE '{VAL_YEAR - 1}-12-31'),
      ('C', DATE '{VAL_YEAR - 1}-06-30', DATE '{VAL_YEAR - 1}-07-01', DATE '{VAL_YEAR}-06-30')) f(fold, te, vs, ve)
    WHERE s.Date <= f.te OR s.Date BETWEEN f.vs AND f.ve""", "v_sales"))
def ev_temporal_folds(cat):
    """Folds A/B/C as (fold, role) per day via a broadcast fold table."""
    return EV.temporal_folds(cat.table("sales").select("Date"), fold_table(cat.spark, VAL_YEAR)).select(
        "fold", "Date", "role")


@register("ev_expanding_split", W(f"""
    WITH r AS (SELECT Date, row_number() OVER (ORDER BY Date DESC) - 1 AS rev FROM v_sales),
    v AS (SELECT 5 - CAST(floor(rev / 365) AS INTEGER) AS fold, min(Date) AS vs, max(Date) AS ve, count(*) AS vr
          FROM r WHERE rev < 5 * 365 GROUP BY 1)
    SELECT CAST(fold AS BIGINT) AS fold, {D('(SELECT min(Date) FROM v_sales)')} AS train_start,
           {D('(SELECT max(Date) FROM v_sales s WHERE s.Date < v.vs)')} AS train_end,
           {D('vs')} AS valid_start, {D('ve')} AS valid_end,
           (SELECT count(*) FROM v_sales s WHERE s.Date < v.vs) AS train_rows, vr AS valid_rows FROM v""", "v_sales"))
def ev_expanding_split(cat):
    """TimeSeriesSplit(5, test_size=365) bounds table."""
    return EV.expanding_split(cat.table("sales").select("Date"), 5, 365)


@register("ev_ratio_split", W(f"""
    SELECT {D('month')} AS month, {R('revenue')} AS revenue,
           CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role
    FROM (SELECT order_month AS month, coalesce(sum(net_revenue), 0.0) AS revenue,
                 row_number() OVER (ORDER BY order_month) AS rn, count(*) OVER () AS n
          FROM v_order_fact GROUP BY order_month)""", "v_order_fact"))
def ev_ratio_split(cat):
    """First 80 % of months train, last 20 % test (monthly panel)."""
    from kartlane.operators import facts as FX
    of = FX.order_fact(cat)
    mp = FE.monthly_panel(of, FX.customer_fact(cat), FX.inventory_fact(cat))
    return EV.ratio_split(mp, 0.8, "month").select("month", "revenue", "role")


@register("ev_driver_labels")
def ev_driver_labels(cat):
    """Boosting importances with the kind, window and target of each feature, told by the operator that makes it."""
    from kartlane.operators import boosting as B
    models, _, cols = PM.candidates(cat)
    return EV.driver_labels(EV.importance_share(B.importances(models, cols)))


_FAC_OUT = f"""SELECT series_id, target, level, CAST(month AS BIGINT) AS month, CAST(dayofweek AS BIGINT) AS dayofweek,
                      {R('factor')} AS factor, CAST(n AS BIGINT) AS n FROM v_factors"""


@register("fc_calibration_factors", W(_FAC_OUT, "v_factors"))
def fc_calibration_factors(cat):
    """Month (n/(n+60), clip .8-1.2) then month x weekday (n/(n+20), clip .9-1.1) shrunk median factors."""
    return _factors(cat)


@register("fc_apply_calibration", W(f"""
    SELECT series_id, target, {D('Date')} AS Date, {R('y')} AS y, {R('pred')} AS pred,
           {R('pred_calibrated')} AS pred_calibrated FROM v_cal WHERE year(Date) = {VAL_YEAR}""", "v_cal"))
def fc_apply_calibration(cat):
    """Baseline x factors (default 1.0) over the validation year."""
    return _calibrated(cat).filter(F.year("Date") == VAL_YEAR).select(*K, "Date", "y", "pred", "pred_calibrated")


@register("fc_residual_target", W(f"""
    SELECT series_id, target, {D('Date')} AS Date, {R('y - pred_calibrated')} AS residual
    FROM v_cal WHERE y - pred_calibrated IS NOT NULL AND Date < DATE '{VAL_YEAR}-01-01'""", "v_cal"))
def fc_residual_target(cat):
    """y - calibrated baseline on training rows (NULL rows dropped)."""
    c = _calibrated(cat).filter(F.col("Date") < F.lit(f"{VAL_YEAR}-01-01").cast("date"))
    return FC.residual_target(c).select(*K, "Date", "residual")


_ALPHA_CASE = ("CASE quarter(Date) " + " ".join(f"WHEN {q} THEN {a}" for q, a in FC.QUARTER_ALPHA.items()) + " END")


SPECIALIST, BASE = "quarter_ridge", "ridge_log"
_TIER1 = (SPECIALIST, BASE)
_V_TIER1 = _oof_wide(_TIER1)
_K_SQL = ", ".join(G)


@register("fc_blend_alpha", W(f"""
    SELECT {_K_SQL}, {D('Date')} AS Date, {R(f'{_ALPHA_CASE} * {SPECIALIST} + (1.0 - {_ALPHA_CASE}) * {BASE}')} AS blend
    FROM {_V_TIER1}""", _V_TIER1))
def fc_blend_alpha(cat):
    """Tier 1: alpha(quarter) * specialist + (1 - alpha) * base, alpha {.6,.6,1,.6}, on out-of-fold predictions."""
    return FC.blend_alpha(_oof(cat, _TIER1), SPECIALIST, BASE).select(*G, "Date", "blend")


_BEST_ALPHA = f"sum((y - {BASE}) * ({SPECIALIST} - {BASE})) / nullif(sum(({SPECIALIST} - {BASE}) * ({SPECIALIST} - {BASE})), 0)"


@register("fc_alpha_tuning", W(f"""
    SELECT {_K_SQL}, CAST(quarter(Date) AS BIGINT) AS quarter, {R(f'least(greatest(coalesce({_BEST_ALPHA}, 0.05), 0.05), 0.85)')} AS alpha,
           {R(_BEST_ALPHA)} AS unclipped
    FROM {_V_TIER1} WHERE y IS NOT NULL GROUP BY {_K_SQL}, quarter(Date)""", _V_TIER1))
def fc_alpha_tuning(cat):
    """Per-quarter alpha in [.05, .85] minimising squared error (closed form) of the out-of-fold blend."""
    return FC.alpha_tuning(_oof(cat, _TIER1), SPECIALIST, BASE, keys=G)


# tier 2: ridge, least squares and the tier-1 blend by the workload's family weights
_FAMILIES = {"ridge_lag": 0.10, "linear": 0.10, "blend": 0.80}
_TIER2 = (*_TIER1, "ridge_lag", "linear")
_V_TIER2 = _oof_wide(_TIER2)
_FAM_SQL = f"(ridge_lag * 0.1 + linear * 0.1 + ({_ALPHA_CASE} * {SPECIALIST} + (1.0 - {_ALPHA_CASE}) * {BASE}) * 0.8)"


def _family_blend(cat):
    return FC.blend_families(FC.blend_alpha(_oof(cat, _TIER2), SPECIALIST, BASE), _FAMILIES, "families")


@register("fc_blend_families", W(f"SELECT {_K_SQL}, {D('Date')} AS Date, {R(_FAM_SQL)} AS blend FROM {_V_TIER2}", _V_TIER2))
def fc_blend_families(cat):
    """Tier 2: .10 / .10 / .80 of ridge, least squares and the tier-1 blend, on out-of-fold predictions."""
    return _family_blend(cat).select(*G, "Date", F.col("families").alias("blend"))


@register("fc_scale_calibration", W(f"""
    SELECT {_K_SQL}, {R('least(greatest(min(r), 0.8), 2.0)')} AS scale, {R('min(r)')} AS unclipped FROM (
      SELECT {_K_SQL}, r, sum(w) OVER (PARTITION BY {_K_SQL} ORDER BY r, Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw,
             sum(w) OVER (PARTITION BY {_K_SQL}) AS tw
      FROM (SELECT {_K_SQL}, Date, y / {_FAM_SQL} AS r, {_FAM_SQL} AS w FROM {_V_TIER2} WHERE {_FAM_SQL} > 0 AND y IS NOT NULL))
    WHERE cw >= tw / 2.0 GROUP BY {_K_SQL}""", _V_TIER2))
def fc_scale_calibration(cat):
    """Tier 3: c in [.8, 2] minimising MAE of the tier-2 blend = weighted median of y/p (weights p)."""
    return FC.scale_calibration(_family_blend(cat), "families", keys=G)


_CW = {("ridge_log", "Revenue"): 0.2, ("ridge_lag", "Revenue"): 0.3, ("calibrated_baseline", "Revenue"): 0.5,
       ("ridge_log", "COGS"): 0.25, ("ridge_lag", "COGS"): 0.25, ("calibrated_baseline", "COGS"): 0.5}
_COMPONENTS = ("ridge_log", "ridge_lag", "calibrated_baseline")
_V_COMPONENTS = _oof_wide(_COMPONENTS)


@register("fc_combine_components", W(f"""
    SELECT {_K_SQL}, {D('Date')} AS Date, {R('greatest(sum(w * yhat), 0.0)')} AS yhat
    FROM (UNPIVOT {_V_COMPONENTS} ON {', '.join(_COMPONENTS)} INTO NAME model VALUE yhat)
    JOIN (VALUES {', '.join(f"('{m}', '{t}', {w!r})" for (m, t), w in _CW.items())}) c(model, target, w)
    USING (model, target) GROUP BY {_K_SQL}, Date""", _V_COMPONENTS))
def fc_combine_components(cat):
    """Weighted sum over (model, target) component weights of the out-of-fold predictions, floored at 0."""
    wt = cat.spark.createDataFrame([(m, tg, w) for (m, tg), w in _CW.items()], "model string, target string, w double")
    return FC.combine_components(_oof_long(cat, _COMPONENTS), wt, G)


FIXED = ("residual_lgbm", "residual_xgb", "direct_lgbm", "calibrated_baseline")


@register("fc_fixed_ensemble")
def fc_fixed_ensemble(cat):
    """Fixed .50/.25/.15/.10 (Revenue) and .60/.25/.15 (COGS) ensembles of the residual, direct and baseline members, floor 0.

    Out-of-fold predictions of the total; days that one of a target's members does not predict are absent.
    """
    oof = PM.out_of_fold(cat, FIXED).where(F.col("series_id") == PM.TOTAL)
    weights = FC.fixed_ensemble_weights(cat.spark)
    members = F.count_distinct("model").alias("members")
    days = oof.join(F.broadcast(weights), ["model", "target"]).groupBy(*G, "Date").agg(members)   # weights: seven rows
    whole = days.join(F.broadcast(weights.groupBy("target").agg(F.count("*").alias("members"))), ["target", "members"]).drop("members")
    return FC.combine_components(oof.join(whole, [*G, "Date"]), weights, G)


_RESIDUAL = ("calibrated_baseline", "residual_calendar")
_V_RESIDUAL = _oof_wide(_RESIDUAL)


@register("fc_residual_alpha_blend", W(f"""
    SELECT {R('alpha')} AS alpha, target, {R('avg(abs(y - yhat))')} AS MAE, {R('sqrt(avg((y - yhat) * (y - yhat)))')} AS RMSE FROM (
      SELECT *, calibrated_baseline + alpha * (residual_calendar - calibrated_baseline) AS yhat
      FROM {_V_RESIDUAL} CROSS JOIN (VALUES (0.25), (0.5), (0.75), (1.0)) a(alpha)) WHERE y IS NOT NULL GROUP BY 1, 2""", _V_RESIDUAL))
def fc_residual_alpha_blend(cat):
    """baseline + alpha * predicted residual for alpha in {.25,.5,.75,1}: metrics per alpha over all folds and series."""
    c = _oof(cat, _RESIDUAL).withColumn("rp", F.col("residual_calendar") - F.col("calibrated_baseline"))
    e = FC.residual_alpha_blend(c, "calibrated_baseline", "rp", cat.spark).filter(F.col("y").isNotNull())
    return (e.groupBy("alpha", "target")
            .agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("MAE"),
                 F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("RMSE")))


_INNER = f"Date >= DATE '{VAL_YEAR - 1}-01-01' AND Date < DATE '{VAL_YEAR}-01-01'"


@register("fc_simplex_gram", W(f"""
    SELECT series_id, target, count(*) AS n, {R('sum(y * y) / 1e6')} AS yy, """ + ", ".join(
    [f"{R(f'sum({a} * y) / 1e6')} AS xy{i}" for i, a in enumerate(FC.BASELINE_FEATURES)]
    + [f"{R(f'sum({a} * {b}) / 1e6')} AS xx{i}_{j}" for i, a in enumerate(FC.BASELINE_FEATURES)
       for j, b in enumerate(FC.BASELINE_FEATURES) if j >= i]) + f"""
    FROM v_bfeat WHERE {_INNER} AND {' AND '.join(f'{c} IS NOT NULL' for c in FC.BASELINE_FEATURES)} AND y IS NOT NULL
    GROUP BY 1, 2""", "v_bfeat"))
def fc_simplex_gram(cat):
    """X'X, X'y, y'y of the 6 baseline features per (series, target) on the inner window.

    Reported in millions (sums of ~1e12 carry summation-order noise in the
    last bits; the scaled value keeps 10+ significant digits).
    """
    b = _bfeat(cat).filter((F.col("Date") >= F.lit(f"{VAL_YEAR - 1}-01-01").cast("date"))
                           & (F.col("Date") < F.lit(f"{VAL_YEAR}-01-01").cast("date")))
    g = FC.gram(b, FC.BASELINE_FEATURES)
    return g.select(*K, "n", *[(F.col(c) / 1e6).alias(c) for c in g.columns if c not in K + ["n"]])


@register("fc_simplex_weights")
def fc_simplex_weights(cat):
    """Simplex weights (>= 0, sum 1) minimising RMSE of the baseline features, solved per group."""
    b = _bfeat(cat).filter((F.col("Date") >= F.lit(f"{VAL_YEAR - 1}-01-01").cast("date"))
                           & (F.col("Date") < F.lit(f"{VAL_YEAR}-01-01").cast("date")))
    return FC.simplex_weights(FC.gram(b, FC.BASELINE_FEATURES), len(FC.BASELINE_FEATURES))


def _grid_sql(view, cols, keys, where="TRUE", steps=10):
    m = len(cols)
    xs = " + ".join(f"xx{a}_{b} * (g{a}::DOUBLE * g{b}::DOUBLE) * {'1.0' if a == b else '2.0'}" for a in range(m) for b in range(a, m))
    ys = " + ".join(f"xy{a} * g{a}::DOUBLE" for a in range(m))
    grid = ", ".join(f"(SELECT unnest(range(0, {steps + 1})) AS g{i}) r{i}" for i in range(m - 1))
    last = f"{steps} - " + " - ".join(f"g{i}" for i in range(m - 1))
    ws = ", ".join(f"g{i}" for i in range(m))
    return f"""
    , gram_ AS (SELECT {', '.join(keys)}, count(*) AS n, sum(y * y) AS yy, {', '.join(f'sum({a} * y) AS xy{i}' for i, a in enumerate(cols))},
                       {', '.join(f'sum({a} * {b}) AS xx{i}_{j}' for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i)}
                FROM {view} WHERE {where} AND y IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in cols)} GROUP BY ALL),
    grid_ AS (SELECT *, {last} AS g{m - 1} FROM {grid} WHERE {last} >= 0),
    cost_ AS (SELECT *, yy - 2.0 * ({ys}) / {float(steps)!r} + ({xs}) / {float(steps * steps)!r} AS sse FROM gram_ CROSS JOIN grid_)
    SELECT {', '.join(keys)}, {', '.join(f"{R(f'g{i} / {float(steps)!r}')} AS w{i}" for i in range(m))},
           {R("CAST(printf('%.6e', sqrt(greatest(sse, 0.0) / n)) AS DOUBLE)")} AS rmse
    FROM cost_ QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY sse, {ws}) = 1"""


@register("fc_simplex_weights_grid", W("SELECT 0", "v_bfeat").replace(
    "\nSELECT 0", _grid_sql("v_bfeat", FC.BASELINE_FEATURES, K, _INNER)), significant=("rmse",))
def fc_simplex_weights_grid(cat):
    """Simplex weights of the six baseline features in steps of a tenth, by enumeration (3,003 points)."""
    b = _bfeat(cat).filter((F.col("Date") >= F.lit(f"{VAL_YEAR - 1}-01-01").cast("date"))
                           & (F.col("Date") < F.lit(f"{VAL_YEAR}-01-01").cast("date")))
    return FC.simplex_weights_grid(FC.gram(b, FC.BASELINE_FEATURES), len(FC.BASELINE_FEATURES))


@register("fc_ensemble_weights")
def fc_ensemble_weights(cat):
    """Exact simplex weights over the out-of-fold predictions of all scored models per fold, series and target."""
    return FC.simplex_weights(FC.gram(_oof(cat, SCORED), list(SCORED), G), len(SCORED), G)


@register("fc_ensemble_weights_grid", W("SELECT 0", _V_COMPONENTS).replace(
    "\nSELECT 0", _grid_sql(_V_COMPONENTS, _COMPONENTS, G, steps=20)), significant=("rmse",))
def fc_ensemble_weights_grid(cat):
    """Weights of three components in steps of a twentieth that minimise the out-of-fold RMSE."""
    return FC.simplex_weights_grid(FC.gram(_oof(cat, _COMPONENTS), list(_COMPONENTS), G), len(_COMPONENTS), 20, G)


# ----------------------------------------------------------------------------- learners
def _ml():
    from kartlane.operators import mlmodels as ML
    return ML


def naive_template_forecast(cat):
    """Template-horizon forecast by the closed-form seasonal naive from the last day."""
    s = cat.table("sales")
    end = s.agg(F.max("Date").alias("_T"))
    t = cat.table("sample_submission").select("Date").crossJoin(F.broadcast(end))      # one-row scalar
    t = t.withColumn("_src", F.date_sub("Date", (F.ceil(F.datediff("Date", "_T") / 365.0) * 365).cast("int")))
    hist = s.select(F.col("Date").alias("_src"), "Revenue", "COGS")
    return t.join(hist, "_src", "left").select("Date", "Revenue", "COGS")


@register("dq_forecast_sanity", W(f"""
    SELECT count(*) AS rows, {D('min(Date)')} AS first_date, {D('max(Date)')} AS last_date,
           {R('min(Revenue)')} AS min_revenue, {R('max(Revenue)')} AS max_revenue,
           {R('min(COGS)')} AS min_cogs, {R('max(COGS)')} AS max_cogs,
           count(*) FILTER (WHERE Revenue IS NULL OR COGS IS NULL) > 0 AS any_null,
           count(*) FILTER (WHERE Revenue < 0 OR COGS < 0) > 0 AS any_negative
    FROM (SELECT t.Date, s.Revenue, s.COGS FROM
            (SELECT CAST(unnest(generate_series(max(Date) + 1, max(Date) + 548, INTERVAL 1 DAY)) AS DATE) AS Date,
                    max(Date) AS T FROM v_sales) t
          LEFT JOIN v_sales s ON s.Date = t.Date - CAST(365 * ceil(date_diff('day', t.T, t.Date) / 365.0) AS INTEGER))""",
    "v_sales"))
def dq_forecast_sanity(cat):
    """Forecast frame checks: shape, date range, min/max, any null, any negative."""
    f = naive_template_forecast(cat)
    return f.agg(F.count(F.lit(1)).alias("rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"),
                 F.min("Revenue").alias("min_revenue"), F.max("Revenue").alias("max_revenue"),
                 F.min("COGS").alias("min_cogs"), F.max("COGS").alias("max_cogs"),
                 (F.count_if(F.col("Revenue").isNull() | F.col("COGS").isNull()) > 0).alias("any_null"),
                 (F.count_if((F.col("Revenue") < 0) | (F.col("COGS") < 0)) > 0).alias("any_negative"))


# ----------------------------------------------------------------------------- panel fits
SIG = "CAST(printf('%.4e', {}) AS DOUBLE)"  # five digits: sums of a hundred terms differ in their last ones


def _panel_sql(view):
    return W(f"SELECT model, fold, series_id, target, {D('Date')} AS Date, {R('y')} AS y, {R(SIG.format('yhat'))} AS yhat FROM {view}", view)


def _five(p, *cols):
    return p.withColumns({c: F.format_string("%.4e", F.col(c)).cast("double") for c in cols or ("yhat",)})


@register("fc_ridge_log", _panel_sql("v_ridge_log"))
def fc_ridge_log(cat):
    """Ridge (alpha=3) on the 81 standardised calendar features, log target: every fold, series and target in one job."""
    return _five(PM.ridge_log(cat))


@register("fc_ridge_lag", _panel_sql("v_ridge_lag"))
def fc_ridge_lag(cat):
    """Ridge (alpha=10) on the 68 standardised one-step features: every fold, series and target in one job."""
    return _five(PM.ridge_lag(cat))


@register("fc_linear", _panel_sql("v_linear"))
def fc_linear(cat):
    """Least squares on the one-step features: every fold, series and target in one job."""
    return _five(PM.least_squares(cat))


@register("fc_random_forest")
def fc_random_forest(cat):
    """Random forest (300 trees, depth 14, min leaf 3) on lag features."""
    return _ml().random_forest(cat)


@register("fc_gbt_candidates")
def fc_gbt_candidates(cat):
    """Three boosting configs scored on the validation year; metrics with the best flagged."""
    _, p, _ = PM.candidates(cat)
    used = p.groupBy("model").agg(F.max("best_iteration").alias("best_iteration"), F.max("limit_hit").alias("limit_hit"))
    m = EV.metrics(p.select("model", "target", "y", "yhat")).join(F.broadcast(used), "model")   # three rows
    best = EV.best_model(m).select("best_model")
    return m.crossJoin(best).withColumn("is_best", F.col("model") == F.col("best_model")).drop("best_model")


@register("fc_gbt_monthly")
def fc_gbt_monthly(cat):
    """Monthly boosting (300 rounds, lagged features) scored on the last 20 % of months."""
    ML = _ml()
    sp = EV.ratio_split(ML.monthly_table(cat).dropna(subset=ML.MONTHLY_COLS + ["revenue"]), 0.8, "month")
    return ML.monthly_predict(sp.filter(F.col("role") == "test"), ML.monthly_fit(sp.filter(F.col("role") == "train")))


def _total_rows(cat, fold=None):
    rows, cols = PM.calendar_rows(cat)
    return PM.only(PM.in_folds(rows, cat.spark), PM.TOTAL, fold), cols


@register("fc_gbt_weighted_2phase")
def fc_gbt_weighted_2phase(cat):
    """Era-weighted boosting of every fold: the last 180 days pick the best of up to 5,000 rounds (patience 300), then a refit."""
    return PM.two_phase(*_total_rows(cat), "gbt_weighted_2phase")


@register("fc_quarter_specialists")
def fc_quarter_specialists(cat):
    """4 boosted fits per target (quarter weight x3); each day uses its quarter's model."""
    return PM.specialists(*_total_rows(cat, "A"))


@register("fc_structural")
def fc_structural(cat):
    """Trend with changepoints chosen by an L1 penalty + Fourier + promo regressors in log space: every fold, series and target."""
    rows, _ = PM.calendar_rows(cat)
    return PM.structural(PM.in_folds(rows, cat.spark))[1]


@register("fc_residual_models")
def fc_residual_models(cat):
    """Per series and target: two learners of the residual (y - calibrated baseline), added back to it, and one of y for Revenue."""
    return PM.residual_models(cat)


@register("fc_recursive_linear")
def fc_recursive_linear(cat):
    """Weighted baseline x calibration rolled forward 548 days: one triangular system a series."""
    return _ml().recursive_linear(cat)


@register("fc_direct_ml")
def fc_direct_ml(cat):
    """Direct forecast of the template: a boosted model per horizon block with the lags that are known there."""
    p = PM.direct(cat)
    pick = lambda t: F.max(F.when(F.col("target") == t, F.col("yhat"))).alias(t)
    return p.groupBy("Date", "block").agg(pick("Revenue"), pick("COGS"), F.max("best_iteration").alias("best_iteration"),
                                          F.max("limit_hit").alias("limit_hit"), F.avg("holdout_loss").alias("holdout_loss"),
                                          F.avg("calendar_loss").alias("calendar_loss"))


@register("fc_rollforward_monthly")
def fc_rollforward_monthly(cat):
    """6-month roll-forward of the monthly model with rev_lag_1 refreshed from predictions."""
    return _ml().rollforward_monthly(cat)


@register("fc_refit_full")
def fc_refit_full(cat):
    """All members refit on all observed days, blended by quarter, family and level, over the template."""
    return _ml().final_forecast(cat)


@register("snk_forecast")
def snk_forecast(cat):
    """Forecast written as CSV in template order (ISO dates, 2 decimals, >= 0), read back."""
    import uuid
    from kartlane.plans.reports import output_root
    ML = _ml()
    path = f"{output_root(cat.spark)}/forecast_{uuid.uuid4().hex[:8]}"
    return ML.forecast_sink(cat, ML.final_forecast(cat), path)


@register("snk_run_metadata")
def snk_run_metadata(cat):
    """Parameters, members, rounds and losses of the final forecast written as one JSON record, read back."""
    import dataclasses
    import uuid
    from kartlane.plans.reports import output_root, write_run_metadata
    ML = _ml()
    members = ML.final_members(cat)
    own = [f"{m}_{c}" for m in ("base", "specialist") for c in ("best_iteration", "holdout_loss")]
    # one row a target
    fits = {r.target: {c: r[c] for c in own} for r in members.groupBy("target").agg(*[F.max(c).alias(c) for c in own]).collect()}
    first, last, days = members.agg(F.min("Date"), F.max("Date"), F.count_distinct("Date")).first()
    meta = {"model": "blended", "members": ["ridge", "structural", "base", "specialist"], "ridge_alpha": PM.RIDGE_LOG_ALPHA,
            "boosting": dataclasses.asdict(PM.TWO_PHASE), "quarter_boost": PM.QUARTER_BOOST, "clean_era": list(PM.CLEAN_ERA),
            "quarter_share": ML.QUARTER_SHARE, "family_weights": ML.FAMILY_WEIGHTS, "level": ML.LEVEL, "fits": fits,
            "first_date": str(first), "last_date": str(last), "days": days, "revenue_weights": FC.REVENUE_ENSEMBLE_WEIGHTS,
            "cogs_weights": FC.COGS_ENSEMBLE_WEIGHTS}
    path = write_run_metadata(cat.spark, meta, f"{output_root(cat.spark)}/meta_{uuid.uuid4().hex[:8]}")
    back = cat.spark.read.text(path)
    get = lambda p, t="string": F.get_json_object("value", p).cast(t)
    return back.select(get("$.model").alias("model"), get("$.days", "int").alias("days"), get("$.first_date").alias("first_date"),
                       get("$.fits.Revenue.base_best_iteration", "int").alias("revenue_rounds"),
                       get("$.fits.Revenue.base_holdout_loss", "double").alias("revenue_holdout_loss"),
                       get("$.boosting.patience", "int").alias("patience"), F.to_json(F.json_object_keys("value")).alias("keys"))


@register("ev_feature_importance")
def ev_feature_importance(cat):
    """Boosting importances long (model, target, feature, importance) + share + rank."""
    from kartlane.operators import boosting as B
    models, _, cols = PM.candidates(cat)
    return EV.importance_share(B.importances(models, cols))
