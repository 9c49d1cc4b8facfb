"""DuckDB views of the panel models: feature rows, moments and the sweep, in SQL alone."""

from __future__ import annotations

from kartlane.operators import features as FE
from kartlane.operators import forecast as FC
from kartlane.operators import linear
from kartlane.operators import panel_models as PM
from kartlane.operators.panel_models import VAL_YEAR
from kartlane.plans.oracle import STANDINS
from kartlane.plans.q_features import _CAL_SQL, _CF, _INST, _TETD, TAU, _lg, _promo_cols, _w
from kartlane.sources.inline import FIXED_HOLIDAYS, PROMO_SCHEDULE

_BF = """CASE WHEN Date = (SELECT max(d) FROM (SELECT CAST(unnest(generate_series(make_date(year(Date), 11, 24),
    make_date(year(Date), 11, 30), INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) = 5) THEN 1 ELSE 0 END"""
_CALX = (["year", "month", "day", "dow", "doy", "quarter", "is_weekend", "days_to_eom", "days_from_som", "dim"]
         + [f"CASE WHEN {c} <= {k - 1} THEN 1 ELSE 0 END" for k in (1, 2, 3) for c in ("days_to_eom", "days_from_som")]
         + ["date_diff('day', DATE '2020-01-01', Date)", "date_diff('day', DATE '2020-01-01', Date) / 365.25"]
         + [f"CASE WHEN year {o} {FE.REGIME_YEAR} THEN 1 ELSE 0 END" for o in ("<", "=", ">")]
         + [f"{fn}({TAU * k!r} * {x})" for ks, x in (((1, 2, 3, 4, 5), "doy / 365.25"), ((1, 2), "dow / 7.0"), ((1, 2), "(day - 1) / dim"))
            for k in ks for fn in ("sin", "cos")]
         + [f"CASE WHEN month = {m} AND day = {d} THEN 1 ELSE 0 END" for m, d, _ in FIXED_HOLIDAYS]
         + ["td"] + [f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in
                     ("abs(td) <= 7", "abs(td) <= 14", "td >= -7 AND td < 0", "td > 0 AND td <= 7", "td = 0")]
         + [_BF] + [f"promo_{n}{s}" for n, *_ in PROMO_SCHEDULE for s in ("", "_since", "_until", "_disc")] + ["year % 2"])


def _list(exprs) -> str:
    return "[" + ", ".join(f"CAST({e} AS DOUBLE)" for e in exprs) + "]"


def _lag_names() -> list[str]:
    return ([f"lag_{k}" for k in FE.LAGS] + [f"roll_{fn}_{n}" for n in FE.ROLLING_WINDOWS for fn in ("mean", "std", "min", "max")]
            + ["expanding_mean"])


def _lag_exprs() -> str:
    out = [f"{_lg(k)} AS lag_{k}" for k in FE.LAGS]
    for n in FE.ROLLING_WINDOWS:
        frame = _w(f"{n} PRECEDING", "1 PRECEDING")
        for fn, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            out.append(f"CASE WHEN count(y) {frame} >= {max(2, n // 3)} THEN {f}(y) {frame} END AS roll_{fn}_{n}")
    frame = _w("UNBOUNDED PRECEDING", "1 PRECEDING")
    out.append(f"CASE WHEN count(y) {frame} >= 30 THEN avg(y) {frame} END AS expanding_mean")
    return ", ".join(out)


_CYC = [f"{fn}({TAU!r} * {c} / {float(p)!r})" for c, p in FE.CYCLES.items() for fn in ("sin", "cos")]
_CALB = ["year", "quarter", "month", "weekofyear", "dayofyear", "dayofmonth", "dayofweek", "is_weekend", "is_month_start", "is_month_end",
         "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end"]
CALENDAR_COLUMNS, LAG_COLUMNS = len(_CALX), 2 + 2 * len(_lag_names()) + len(_CALB) + len(_CYC)
_FOLDS = f"""(VALUES
    ('A', DATE '{VAL_YEAR - 1}-12-31', DATE '{VAL_YEAR}-01-01', DATE '{VAL_YEAR}-12-31'),
    ('B', DATE '{VAL_YEAR - 2}-12-31', DATE '{VAL_YEAR - 1}-01-01', DATE '{VAL_YEAR - 1}-12-31'),
    ('C', DATE '{VAL_YEAR - 1}-06-30', DATE '{VAL_YEAR - 1}-07-01', DATE '{VAL_YEAR}-06-30')) f(fold, te, vs, ve)"""

STANDINS.update({
    "v_panel_all": (["v_panel_long", "v_sales"], """
        SELECT series_id, target, Date, y FROM v_panel_long
        UNION ALL SELECT 'total', 'Revenue', Date, Revenue FROM v_sales UNION ALL SELECT 'total', 'COGS', Date, COGS FROM v_sales"""),
    "inst": (["v_sales"], f"SELECT * FROM {_INST}"),
    "v_promo_days": (["v_sales", "inst"], f"SELECT s.Date, {_promo_cols(False)} FROM v_sales s"),
    "v_calx": (["v_promo_days", "v_sales", "v_tet"], f"""
        SELECT Date, {_list(_CALX)} AS x FROM (SELECT s.*, {_TETD} AS td FROM {_CF} s) JOIN v_promo_days USING (Date)"""),
    "v_calrows": (["v_panel_all", "v_calx"], "SELECT p.*, c.x FROM v_panel_all p JOIN v_calx c USING (Date)"),
    "v_lagx": (["v_panel_all"], f"""
        WITH g AS (SELECT series_id, target, Date, y, {_lag_exprs()} FROM v_panel_all),
        j AS (SELECT r.series_id, r.Date, {', '.join(f'r.{c} AS r_{c}, c.{c} AS c_{c}' for c in _lag_names())}
              FROM g r JOIN g c ON r.series_id = c.series_id AND r.Date = c.Date AND r.target = 'Revenue' AND c.target = 'COGS')
        SELECT series_id, Date, {_list(['r_lag_1 - c_lag_1', 'c_lag_1 / nullif(r_lag_1, 0)'] + [f'{t}_{c}' for t in 'rc' for c in _lag_names()]
                                       + _CALB + _CYC)} AS x
        FROM (SELECT *, {_CAL_SQL} FROM j)"""),
    "v_lagrows": (["v_panel_all", "v_lagx"], """
        SELECT p.*, l.x FROM v_panel_all p JOIN v_lagx l USING (series_id, Date) WHERE len([v FOR v IN l.x IF v IS NULL OR isnan(v)]) = 0"""),
})


def ridge_views(name: str, rows: str, p: int, alpha: float, label: str = "y", where: str = "y IS NOT NULL", out: str = "{}",
                weight: str = "1.0", extra: str | None = None, joined: str | None = None) -> str:
    """Registers the view ``v_<name>``: predictions of a ridge of every fold, series and target; returns its name.

    ``label``, ``where`` and ``weight`` speak of the training rows, ``out`` turns a
    prediction into the result. ``extra`` is a key of four specialties, of which each day asks its
    quarter's; ``joined`` is a view by fold, series, target and day.
    """
    k = "fold, series_id, target" + (f", {extra}" if extra else "")
    on = " AND ".join(f"a.{c} = b.{c}" for c in k.split(", "))
    v = f"v_{name}"
    more = f"CROSS JOIN (VALUES (1), (2), (3), (4)) q({extra})" if extra else ""
    asked = f"AND {extra} = quarter(r.Date)" if extra else ""
    beside = f"JOIN {joined} o ON o.fold = f.fold AND o.series_id = r.series_id AND o.target = r.target AND o.Date = r.Date" if joined else ""
    STANDINS.update({
        f"{v}_rows": ([rows, *([joined] if joined else [])], f"""
            SELECT f.fold, r.*{f', {extra}' if extra else ''}{', o.offset_' if joined else ''},
                   CASE WHEN r.Date <= f.te THEN 'train' ELSE 'valid' END AS role
            FROM {rows} r CROSS JOIN {_FOLDS} {more} {beside} WHERE r.Date <= f.te OR r.Date BETWEEN f.vs AND f.ve {asked}"""),
        f"{v}_cells": ([f"{v}_rows"], f"""
            SELECT {k}, Date, w, unnest(range(1, {p + 2})) AS i, unnest(list_append(x, t)) AS v
            FROM (SELECT {k}, Date, x, {label} AS t, {weight} AS w FROM {v}_rows WHERE role = 'train' AND {where})"""),
        f"{v}_stat": ([f"{v}_cells"], f"""
            SELECT {k}, i, n, m, CASE WHEN i = {p + 1} THEN 1.0 WHEN s > {linear.CONSTANT!r} * greatest(1.0, abs(m)) THEN s END AS s FROM (
              SELECT c.{k.replace(', ', ', c.')}, c.i, any_value(n) AS n, any_value(m) AS m, sqrt(sum(w * (v - m) * (v - m)) / any_value(n)) AS s
              FROM {v}_cells c JOIN (SELECT {k}, i, sum(w) AS n, sum(w * v) / sum(w) AS m FROM {v}_cells GROUP BY {k}, i) USING ({k}, i)
              GROUP BY ALL)"""),
        f"{v}_cols": ([f"{v}_cells", f"{v}_stat"], f"""
            SELECT {k}, i, any_value(n) AS n, list(coalesce(sqrt(w) * (v - m) / s, 0.0) ORDER BY Date) AS z
            FROM {v}_cells JOIN {v}_stat USING ({k}, i) GROUP BY {k}, i"""),
        f"{v}_gram": ([f"{v}_cols"], f"""
            SELECT {', '.join(f'a.{c}' for c in k.split(', '))}, a.i AS i, b.i AS j, any_value(a.n) AS n,
                   any_value(list_inner_product(a.z, b.z)) AS g
            FROM {v}_cols a JOIN {v}_cols b ON {on} AND a.i <= b.i GROUP BY ALL"""),
        f"{v}_matrix": ([f"{v}_gram"], f"""
            SELECT {k}, any_value(n) AS n, list(r ORDER BY i) AS m FROM (
              SELECT {k}, i, any_value(n) AS n, list(g + CASE WHEN i = j THEN {alpha!r} ELSE 0.0 END ORDER BY j) AS r FROM (
                SELECT {k}, i, j, n, g FROM {v}_gram WHERE i <= {p}
                UNION ALL SELECT {k}, j, i, n, g FROM {v}_gram WHERE i < j AND j <= {p}) GROUP BY {k}, i) GROUP BY {k}"""),
        f"{v}_sweep": ([f"{v}_matrix"], f"""
            WITH RECURSIVE s AS (
              SELECT {k}, n, 1 AS step, m FROM {v}_matrix
              UNION ALL
              SELECT {k}, n, step + 1, CASE WHEN m[step][step] <= {linear.PIVOT!r} * n
                THEN [CASE WHEN i = step THEN [0.0 FOR c IN r] ELSE r END FOR r, i IN m]
                ELSE [CASE WHEN i = step THEN [c / m[step][step] FOR c IN r]
                      ELSE [c - r[step] * (m[step][j] / m[step][step]) FOR c, j IN r] END FOR r, i IN m] END
              FROM s WHERE step <= {p})
            SELECT {k}, [r[{p + 1}] FOR r IN m] AS beta FROM s WHERE step = {p + 1}"""),
        f"{v}_coef": ([f"{v}_sweep", f"{v}_stat"], f"""
            SELECT {k}, b.beta, list(s.m ORDER BY s.i) AS m, list(s.s ORDER BY s.i) AS s
            FROM {v}_sweep b JOIN {v}_stat s USING ({k}) GROUP BY {k}, b.beta"""),
        v: ([f"{v}_rows", f"{v}_coef"], f"""
            SELECT '{name}' AS model, fold, series_id, target, Date, y, {out.format('p')} AS yhat FROM (
              SELECT r.*, c.m[{p + 1}] + list_sum([coalesce(c.beta[i] * (v - c.m[i]) / c.s[i], 0.0) FOR v, i IN r.x]) AS p
              FROM {v}_rows r JOIN {v}_coef c USING ({k}) WHERE role = 'valid')"""),
    })
    return v


# --- out-of-fold predictions: baselines of every fold, and the learners

def _naive(name: str, season: int) -> None:
    STANDINS[f"v_oof_{name}"] = (["v_panel_all"], f"""
        SELECT '{name}' AS model, f.fold, h.series_id, h.target, h.Date, h.y, s.y AS yhat
        FROM {_FOLDS} JOIN v_panel_all h ON h.Date BETWEEN f.vs AND f.ve
        LEFT JOIN v_panel_all s ON s.series_id = h.series_id AND s.target = h.target AND s.Date <= f.te
             AND s.Date = h.Date - CAST({season} * ceil(date_diff('day', f.te, h.Date) / {float(season)!r}) AS INTEGER)""")


_naive("seasonal_naive", 365)
_naive("lag364", 364)
_K3 = "model, fold, series_id, target, Date, y, yhat"
STANDINS.update({
    "v_bfeat_all": (["v_panel_all"], """
        SELECT *, """ + " + ".join(f"{c} * {float(w)!r}" for c, w in zip(FC.BASELINE_FEATURES, FC.DEFAULT_BASELINE_WEIGHTS))
        + """ AS pred FROM (SELECT series_id, target, Date, y, """
        + ", ".join(f"{_lg(k)} AS lag_{k}" for k in FC.BASELINE_LAGS) + ", "
        + ", ".join(f"CASE WHEN count(y) {_w(f'{n} PRECEDING', '1 PRECEDING')} >= {n} THEN avg(y) {_w(f'{n} PRECEDING', '1 PRECEDING')} END AS rolling_{n}"
                    for n in FC.BASELINE_ROLLS) + " FROM v_panel_all)"),
    "v_cal_all": (["v_bfeat_all"], f"""
        WITH f AS (SELECT fold, series_id, target, Date, month(Date) AS month, isodow(Date) - 1 AS dayofweek,
                          coalesce(y / nullif(pred, 0), 1.0) AS ratio
                   FROM v_bfeat_all CROSS JOIN {_FOLDS} WHERE Date <= f.te AND pred IS NOT NULL),
        mf AS (SELECT fold, series_id, target, month,
                      least(greatest(1.0 + (quantile_cont(ratio, 0.5) - 1.0) * (count(*) / (count(*) + 60.0)), 0.8), 1.2) AS factor
               FROM f GROUP BY ALL),
        wf AS (SELECT f.fold, f.series_id, f.target, f.month, f.dayofweek,
                      least(greatest(1.0 + (quantile_cont(f.ratio / mf.factor, 0.5) - 1.0) * (count(*) / (count(*) + 20.0)), 0.9), 1.1) AS factor
               FROM f JOIN mf USING (fold, series_id, target, month) GROUP BY ALL)
        SELECT g.fold, b.series_id, b.target, b.Date, b.y, CASE WHEN b.Date <= g.te THEN 'train' ELSE 'valid' END AS role,
               b.pred * coalesce(m.factor, 1.0) * coalesce(w.factor, 1.0) AS offset_
        FROM v_bfeat_all b CROSS JOIN {_FOLDS.replace(' f(', ' g(')}
        LEFT JOIN mf m ON m.fold = g.fold AND m.series_id = b.series_id AND m.target = b.target AND m.month = month(b.Date)
        LEFT JOIN wf w ON w.fold = g.fold AND w.series_id = b.series_id AND w.target = b.target AND w.month = month(b.Date)
             AND w.dayofweek = isodow(b.Date) - 1
        WHERE b.Date <= g.te OR b.Date BETWEEN g.vs AND g.ve"""),
    "v_oof_calibrated_baseline": (["v_cal_all"], """
        SELECT 'calibrated_baseline' AS model, fold, series_id, target, Date, y, offset_ AS yhat FROM v_cal_all WHERE role = 'valid'"""),
    "v_oof_weighted_baseline": (["v_panel_all"], f"""
        SELECT 'weighted_baseline' AS model, f.fold, b.* FROM (
          SELECT series_id, target, Date, y, 0.5 * {_lg(364)} + 0.3 * {_lg(7)}
                 + 0.2 * CASE WHEN count(y) {_w('30 PRECEDING', '1 PRECEDING')} >= 30 THEN avg(y) {_w('30 PRECEDING', '1 PRECEDING')} END AS yhat
          FROM v_panel_all) b JOIN {_FOLDS} ON b.Date BETWEEN f.vs AND f.ve"""),
})
LEARNERS = {
    "ridge_log": dict(rows="v_calrows", p=CALENDAR_COLUMNS, alpha=PM.RIDGE_LOG_ALPHA, label="ln(y)", where="y > 0", out="exp({})"),
    "ridge_lag": dict(rows="v_lagrows", p=LAG_COLUMNS, alpha=PM.RIDGE_LAG_ALPHA),
    "linear": dict(rows="v_lagrows", p=LAG_COLUMNS, alpha=0.0),
    "quarter_ridge": dict(rows="v_calrows", p=CALENDAR_COLUMNS, alpha=PM.RIDGE_LOG_ALPHA, label="ln(y)", where="y > 0", out="exp({})",
                          weight=f"CASE WHEN year(Date) BETWEEN {PM.CLEAN_ERA[0]} AND {PM.CLEAN_ERA[1]} THEN 1.0 ELSE 0.01 END"
                                 f" * CASE WHEN specialty = quarter(Date) THEN {PM.QUARTER_BOOST!r} ELSE 1.0 END", extra="specialty"),
    "residual_calendar": dict(rows="v_calrows", p=CALENDAR_COLUMNS, alpha=PM.RIDGE_LOG_ALPHA, label="y - offset_",
                              where="y - offset_ IS NOT NULL", out="offset_ + {}", joined="v_cal_all"),
    "residual_lags": dict(rows="v_lagrows", p=LAG_COLUMNS, alpha=PM.RIDGE_LAG_ALPHA, label="y - offset_", where="y - offset_ IS NOT NULL",
                          out="offset_ + {}", joined="v_cal_all"),
}
for _name, _how in LEARNERS.items():
    STANDINS[f"v_oof_{_name}"] = ([ridge_views(_name, **_how)], f"SELECT {_K3} FROM v_{_name}")


def _kept(model: str) -> str:
    return "yhat" if model in PM.BASELINES else "CAST(printf('%.4e', yhat) AS DOUBLE)"


def oof_view(models) -> str:
    """Registers the union of the models' out-of-fold predictions, rounded as the written table is; returns its name."""
    name = "v_oof__" + "__".join(models)
    STANDINS[name] = ([f"v_oof_{m}" for m in models], " UNION ALL ".join(
        f"SELECT model, fold, series_id, target, Date, y, {_kept(m)} AS yhat FROM v_oof_{m} WHERE yhat IS NOT NULL"
        for m in models))
    return name
