"""Time-series feature queries with oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kartlane.operators import facts as FX
from kartlane.operators import features as FE
from kartlane.plans.oracle import D, R, with_views as W
from kartlane.plans.registry import register
from kartlane.sources.inline import EVENT_CENTERS, FIXED_HOLIDAYS, PROMO_SCHEDULE

TAU = 2 * math.pi


def _dates(cat):
    return cat.table("sales").select("Date")


def _long(cat):
    return FE.to_long(cat.table("sales_panel"))


# -- calendar basic + cyclical --------------------------------------------------------
_CAL_SQL = """year(Date) AS year, quarter(Date) AS quarter, month(Date) AS month, weekofyear(Date) AS weekofyear,
    dayofyear(Date) AS dayofyear, day(Date) AS dayofmonth, isodow(Date) - 1 AS dayofweek,
    CASE WHEN isodow(Date) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN day(Date) = 1 THEN 1 ELSE 0 END AS is_month_start,
    CASE WHEN Date = last_day(Date) THEN 1 ELSE 0 END AS is_month_end,
    CASE WHEN day(Date) = 1 AND month(Date) % 3 = 1 THEN 1 ELSE 0 END AS is_quarter_start,
    CASE WHEN Date = last_day(Date) AND month(Date) % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end,
    CASE WHEN day(Date) = 1 AND month(Date) = 1 THEN 1 ELSE 0 END AS is_year_start,
    CASE WHEN day(Date) = 31 AND month(Date) = 12 THEN 1 ELSE 0 END AS is_year_end"""
_CAL_COLS = ["year", "quarter", "month", "weekofyear", "dayofyear", "dayofmonth", "dayofweek", "is_weekend",
             "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end"]


def _ints(cols):
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


@register("fe_calendar_basic", W(f"SELECT {D('Date')} AS Date, {_ints(_CAL_COLS)} FROM (SELECT Date, {_CAL_SQL} FROM v_sales)",
                                 "v_sales"))
def fe_calendar_basic(cat):
    """14 calendar columns with ISO week and Monday=0 weekday."""
    return FE.calendar_basic(_dates(cat))


@register("fe_cyclical", W(f"SELECT {D('Date')} AS Date, " + ", ".join(
    f"{R(f'sin({TAU!r} * {c} / {float(p)!r})')} AS {c}_sin, {R(f'cos({TAU!r} * {c} / {float(p)!r})')} AS {c}_cos"
    for c, p in FE.CYCLES.items()) + f" FROM (SELECT Date, {_CAL_SQL} FROM v_sales)", "v_sales"))
def fe_cyclical(cat):
    """sin / cos encodings with periods 7, 366, 12, 53."""
    return FE.cyclical(FE.calendar_basic(_dates(cat))).select(
        "Date", *[f"{c}_{t}" for c in FE.CYCLES for t in ("sin", "cos")])


# -- lag / rolling ---------------------------------------------------------------------
def _w(lo, hi):
    return f"OVER (PARTITION BY series_id, target ORDER BY Date ROWS BETWEEN {lo} AND {hi})"


def _roll(fn, n, mp):
    f = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[fn]
    frame = _w(f"{n} PRECEDING", "1 PRECEDING")
    return R(f"CASE WHEN count(y) {frame} >= {mp} THEN {f}(y) {frame} END")


_LR_COLS = ([f"{R(f'lag(y, {k}) OVER (PARTITION BY series_id, target ORDER BY Date)')} AS lag_{k}" for k in FE.LAGS]
            + [f"{_roll(fn, n, max(2, n // 3))} AS roll_{fn}_{n}" for n in FE.ROLLING_WINDOWS
               for fn in ("mean", "std", "min", "max")]
            + [f"{R('CASE WHEN count(y) ' + _w('UNBOUNDED PRECEDING', '1 PRECEDING') + ' >= 30 THEN avg(y) ' + _w('UNBOUNDED PRECEDING', '1 PRECEDING') + ' END')} AS expanding_mean"])


@register("fe_lag_rolling", W(f"SELECT series_id, target, {D('Date')} AS Date, {R('y')} AS y, "
                              + ", ".join(_LR_COLS) + " FROM v_panel_long", "v_panel_long"))
def fe_lag_rolling(cat):
    """Lags, shifted rolling mean/std/min/max (min_periods max(2, n//3)), expanding mean per (series, target)."""
    return FE.lag_rolling(_long(cat))


@register("fe_cross_target_lags", W(f"""
    SELECT series_id, {D('Date')} AS Date,
           {R('lag(Revenue) OVER w - lag(COGS) OVER w')} AS gross_margin_lag_1,
           {R('lag(COGS) OVER w / nullif(lag(Revenue) OVER w, 0)')} AS cogs_to_revenue_lag_1
    FROM v_sales_panel WINDOW w AS (PARTITION BY series_id ORDER BY Date)""", "v_sales_panel"))
def fe_cross_target_lags(cat):
    """Previous-day gross margin and COGS / Revenue ratio per series."""
    return FE.cross_target_lags(cat.table("sales_panel")).select(
        "series_id", "Date", "gross_margin_lag_1", "cogs_to_revenue_lag_1")


# -- build_features groups ------------------------------------------------------------
_CF = """(SELECT Date, year(Date) AS year, month(Date) AS month, day(Date) AS day, isodow(Date) - 1 AS dow,
                 dayofyear(Date) AS doy, quarter(Date) AS quarter,
                 CASE WHEN isodow(Date) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
                 day(last_day(Date)) - day(Date) AS days_to_eom, day(Date) - 1 AS days_from_som,
                 day(last_day(Date)) AS dim FROM v_sales)"""
_CF_COLS = FE.FEATURE_GROUPS["calendar"] + FE.FEATURE_GROUPS["edges"] + ["t_days", "regime_pre2019", "regime_2019",
                                                                          "regime_post2019"]


@register("fe_calendar_final", W(f"""
    SELECT {D('Date')} AS Date, {_ints(FE.FEATURE_GROUPS['calendar'])},
           {', '.join(f"CAST(CASE WHEN days_to_eom <= {k - 1} THEN 1 ELSE 0 END AS BIGINT) AS is_last{k}, CAST(CASE WHEN days_from_som <= {k - 1} THEN 1 ELSE 0 END AS BIGINT) AS is_first{k}" for k in (1, 2, 3))},
           CAST(date_diff('day', DATE '2020-01-01', Date) AS BIGINT) AS t_days,
           {R("date_diff('day', DATE '2020-01-01', Date) / 365.25")} AS t_years,
           CAST(CASE WHEN year < {FE.REGIME_YEAR} THEN 1 ELSE 0 END AS BIGINT) AS regime_pre2019,
           CAST(CASE WHEN year = {FE.REGIME_YEAR} THEN 1 ELSE 0 END AS BIGINT) AS regime_2019,
           CAST(CASE WHEN year > {FE.REGIME_YEAR} THEN 1 ELSE 0 END AS BIGINT) AS regime_post2019
    FROM {_CF}""", "v_sales"))
def fe_calendar_final(cat):
    """build_features groups a-c: 10 basics, edge flags, days to EOM, trend, regimes."""
    return FE.calendar_final(_dates(cat))


@register("fe_fourier_calendar", W(f"SELECT {D('Date')} AS Date, " + ", ".join(
    [f"{R(f'sin({TAU * k!r} * doy / 365.25)')} AS sin_y{k}, {R(f'cos({TAU * k!r} * doy / 365.25)')} AS cos_y{k}"
     for k in (1, 2, 3, 4, 5)]
    + [f"{R(f'sin({TAU * k!r} * dow / 7.0)')} AS sin_w{k}, {R(f'cos({TAU * k!r} * dow / 7.0)')} AS cos_w{k}"
       for k in (1, 2)]
    + [f"{R(f'sin({TAU * k!r} * (day - 1) / dim)')} AS sin_m{k}, {R(f'cos({TAU * k!r} * (day - 1) / dim)')} AS cos_m{k}"
       for k in (1, 2)]) + f" FROM {_CF}", "v_sales"))
def fe_fourier_calendar(cat):
    """Annual k=1..5 (365.25), weekly k=1..2, monthly k=1..2 harmonics."""
    f = FE.fourier_calendar(FE.calendar_final(_dates(cat)))
    return f.select("Date", *[c for c in f.columns if c[:4] in ("sin_", "cos_")])


@register("fe_fixed_holidays", W(f"SELECT {D('Date')} AS Date, " + ", ".join(
    f"CAST(CASE WHEN month = {m} AND day = {d} THEN 1 ELSE 0 END AS BIGINT) AS hol_{n}" for m, d, n in FIXED_HOLIDAYS)
    + f" FROM {_CF}", "v_sales"))
def fe_fixed_holidays(cat):
    """10 fixed month/day holiday flags."""
    f = FE.fixed_holidays(FE.calendar_final(_dates(cat)))
    return f.select("Date", *[f"hol_{n}" for _, _, n in FIXED_HOLIDAYS])


_TETD = """coalesce((SELECT date_diff('day', tet_date, s.Date) FROM v_tet
                     WHERE abs(date_diff('day', tet_date, s.Date)) <= 45
                     ORDER BY abs(date_diff('day', tet_date, s.Date)), date_diff('day', tet_date, s.Date) LIMIT 1), 999)"""


@register("fe_tet", W(f"""
    SELECT {D('Date')} AS Date, CAST(x AS BIGINT) AS tet_days_diff,
           CAST(CASE WHEN abs(x) <= 7 THEN 1 ELSE 0 END AS BIGINT) AS tet_in_7,
           CAST(CASE WHEN abs(x) <= 14 THEN 1 ELSE 0 END AS BIGINT) AS tet_in_14,
           CAST(CASE WHEN x >= -7 AND x < 0 THEN 1 ELSE 0 END AS BIGINT) AS tet_before_7,
           CAST(CASE WHEN x > 0 AND x <= 7 THEN 1 ELSE 0 END AS BIGINT) AS tet_after_7,
           CAST(CASE WHEN x = 0 THEN 1 ELSE 0 END AS BIGINT) AS tet_on
    FROM (SELECT s.Date, {_TETD} AS x FROM v_sales s)""", "v_sales", "v_tet"))
def fe_tet(cat):
    """Signed days to the nearest Tet within +-45 (999 otherwise) + 5 flags."""
    return FE.tet_features(cat.spark, _dates(cat))


@register("fe_black_friday", W(f"""
    SELECT {D('Date')} AS Date, CAST(CASE WHEN Date = (
        SELECT max(d) FROM (SELECT CAST(unnest(generate_series(make_date(year(Date), 11, 24), make_date(year(Date), 11, 30),
                                                               INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) = 5)
      THEN 1 ELSE 0 END AS BIGINT) AS hol_black_friday FROM v_sales""", "v_sales"))
def fe_black_friday(cat):
    """Last Friday of November flag."""
    return FE.black_friday(_dates(cat))


_CAMP = ("(VALUES " + ", ".join(
    f"('{n}', {m}, {d}, {dur}, {float(disc) if disc is not None else 'NULL'}, '{rec}')"
    for n, m, d, dur, disc, rec in PROMO_SCHEDULE) + ") c(campaign, sm, sd, dur, disc, rec)")
_INST = f"""(SELECT campaign, make_date(y, sm, sd) AS start_date, make_date(y, sm, sd) + dur AS end_date,
                    coalesce(disc, 0.0) AS discount
             FROM (SELECT unnest(range(CAST(min(year(Date)) - 1 AS BIGINT), CAST(max(year(Date)) + 2 AS BIGINT))) AS y
                   FROM v_sales) yrs CROSS JOIN {_CAMP} WHERE rec <> 'odd' OR y % 2 = 1)"""


def _promo_cols(flags_only):
    out = []
    for n, *_ in PROMO_SCHEDULE:
        hit = (f"(SELECT {{}} FROM inst WHERE campaign = '{n}' AND s.Date BETWEEN start_date AND end_date "
               f"ORDER BY start_date DESC LIMIT 1)")
        out.append(f"CAST(CASE WHEN {hit.format('1')} IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS promo_{n}")
        if not flags_only:
            out.append(f"{R('coalesce(CAST(' + hit.format(chr(100) + 'ate_diff(' + chr(39) + 'day' + chr(39) + ', start_date, s.Date)') + ' AS DOUBLE), -1.0)')} AS promo_{n}_since")
            out.append(f"{R('coalesce(CAST(' + hit.format(chr(100) + 'ate_diff(' + chr(39) + 'day' + chr(39) + ', s.Date, end_date)') + ' AS DOUBLE), -1.0)')} AS promo_{n}_until")
            out.append(f"{R('coalesce(' + hit.format('discount') + ', 0.0)')} AS promo_{n}_disc")
    return ", ".join(out)


@register("fe_promo_windows", W(f"SELECT {D('s.Date')} AS Date, {_promo_cols(False)} FROM v_sales s",
                                "v_sales").replace("FROM v_sales s", f"FROM v_sales s", 1).replace(
    "\nSELECT", f", inst AS {_INST}\nSELECT", 1))
def fe_promo_windows(cat):
    """6 campaigns x (in, since, until, disc) with -1 sentinels and odd-year recurrence."""
    return FE.promo_windows(cat.spark, _dates(cat))


@register("fe_promo_regressors", W(f"SELECT {D('s.Date')} AS Date, {_promo_cols(True)} FROM v_sales s",
                                   "v_sales").replace("\nSELECT", f", inst AS {_INST}\nSELECT", 1))
def fe_promo_regressors(cat):
    """The 6 in-promo flags used as regressors."""
    return FE.promo_windows(cat.spark, _dates(cat), flags_only=True)


@register("fe_odd_year", W("SELECT strftime(Date, '%Y-%m-%d') AS Date, CAST(year(Date) % 2 AS BIGINT) AS is_odd_year "
                           "FROM v_sales", "v_sales"))
def fe_odd_year(cat):
    """Year parity flag."""
    return _dates(cat).select("Date", (F.year("Date") % 2).alias("is_odd_year"))


@register("fe_build_features_width")
def fe_build_features_width(cat):
    """All 81 calendar-only features over the sales dates and the forecast template."""
    dates = cat.table("sales").select("Date").unionByName(cat.table("sample_submission").select("Date"))
    return FE.build_features(cat.spark, dates)


_EV = {
    "event_new_year": "(m = 12 AND d >= 29) OR (m = 1 AND d <= 5)",
    "event_tet_like": "(m = 1 AND d >= 20) OR (m = 2 AND d <= 10)",
    "event_valentine": "m = 2 AND d BETWEEN 10 AND 15",
    "event_womens_day": "m = 3 AND d BETWEEN 5 AND 9",
    "event_mid_year_sale": "(m = 6 AND d >= 15) OR (m = 7 AND d <= 7)",
    "event_back_to_school": "m = 8 OR (m = 9 AND d <= 10)",
    "event_9_9": "m = 9 AND d BETWEEN 7 AND 11",
    "event_10_10": "m = 10 AND d BETWEEN 8 AND 12",
    "event_11_11": "m = 11 AND d BETWEEN 9 AND 13",
    "event_12_12": "m = 12 AND d BETWEEN 10 AND 14",
    "event_christmas_year_end": "m = 12 AND d >= 20",
    "event_payday": "d >= 25 OR d <= 5",
}


@register("fe_events_v2", W(f"SELECT {D('Date')} AS Date, " + ", ".join(
    f"CAST(CASE WHEN {c} THEN 1 ELSE 0 END AS BIGINT) AS {n}" for n, c in _EV.items())
    + " FROM (SELECT Date, month(Date) AS m, day(Date) AS d FROM v_sales)", "v_sales"))
def fe_events_v2(cat):
    """12 retail event-range flags + payday."""
    return FE.events_v2(_dates(cat))


@register("fe_event_distance", W(f"SELECT {D('Date')} AS Date, " + ", ".join(
    f"CAST(least(abs(doy - {c}), 366 - abs(doy - {c})) AS BIGINT) AS days_to_{n}" for n, c in EVENT_CENTERS.items())
    + " FROM (SELECT Date, dayofyear(Date) AS doy FROM v_sales)", "v_sales"))
def fe_event_distance(cat):
    """Circular day-of-year distance to 11 event centres."""
    return FE.event_distance(_dates(cat))


@register("fe_fourier_trend", W(f"SELECT {D('Date')} AS Date, CAST(i AS BIGINT) AS days_from_start, " + ", ".join(
    f"{R(f'sin({TAU * k!r} * i / {float(p)!r})')} AS sin_{str(p).replace('.', '_')}_{k}, "
    f"{R(f'cos({TAU * k!r} * i / {float(p)!r})')} AS cos_{str(p).replace('.', '_')}_{k}"
    for p in FE.FOURIER_PERIODS for k in FE.FOURIER_K)
    + " FROM (SELECT Date, date_diff('day', min(Date) OVER (), Date) AS i FROM v_sales)", "v_sales"))
def fe_fourier_trend(cat):
    """sin/cos k=1..3 of days since series start for periods 7, 30.5, 365.25."""
    s = _dates(cat)
    start = s.agg(F.min("Date").alias("data_start"))
    return FE.fourier_trend(s.crossJoin(F.broadcast(start))).drop("data_start")


@register("fe_baseline_lags", W(f"SELECT series_id, target, {D('Date')} AS Date, " + ", ".join(
    [f"{R(f'lag(y, {k}) OVER (PARTITION BY series_id, target ORDER BY Date)')} AS lag_{k}" for k in (364, 365, 371)]
    + [f"{_roll('mean', n, n)} AS rolling_{n}" for n in (7, 30, 90)]) + ", " + R("y") + " AS y FROM v_panel_long",
    "v_panel_long"))
def fe_baseline_lags(cat):
    """lag 364/365/371 and full-window shifted rolling means 7/30/90."""
    return FE.baseline_lags(_long(cat))


def _lg(k):
    return f"lag(y, {k}) OVER (PARTITION BY series_id, target ORDER BY Date)"


@register("fe_yoy_growth", W(f"""
    SELECT series_id, target, {D('Date')} AS Date, {R('y')} AS y,
           {R(f'{_lg(364)} / nullif({_lg(728)}, 0) - 1.0')} AS yoy_lag_364_growth,
           {R(f'{_lg(365)} / nullif({_lg(730)}, 0) - 1.0')} AS yoy_lag_365_growth,
           {R("CASE WHEN count(y) " + _w('30 PRECEDING', '1 PRECEDING') + " >= 30 THEN avg(y) " + _w('30 PRECEDING', '1 PRECEDING') + " END / nullif(CASE WHEN count(y) " + _w('394 PRECEDING', '365 PRECEDING') + " >= 30 THEN avg(y) " + _w('394 PRECEDING', '365 PRECEDING') + " END, 0) - 1.0")} AS rolling_30_yoy_growth
    FROM v_panel_long""", "v_panel_long"))
def fe_yoy_growth(cat):
    """Three YoY growth ratios per (series, target)."""
    return FE.yoy_growth(_long(cat))


@register("fe_era_weights", W(f"""
    SELECT {D('Date')} AS Date, {R("CASE WHEN year(Date) BETWEEN 1996 AND 1999 THEN 1.0 ELSE 0.01 END")} AS weight
    FROM v_sales""", "v_sales"))
def fe_era_weights(cat):
    """Era sample weights: 1.0 inside the clean era, 0.01 elsewhere."""
    return FE.era_weights(_dates(cat), 1996, 1999)


@register("fe_quarter_boost", W(f"""
    SELECT {D('Date')} AS Date, {R("CASE WHEN year(Date) BETWEEN 1996 AND 1999 THEN 1.0 ELSE 0.01 END * CASE WHEN quarter(Date) = 4 THEN 3.0 ELSE 1.0 END")} AS weight
    FROM v_sales""", "v_sales"))
def fe_quarter_boost(cat):
    """Era weights x3 inside the specialist's quarter (Q4 here)."""
    return FE.quarter_boost(FE.era_weights(_dates(cat), 1996, 1999), 4)


_MP = """(SELECT s.month, s.revenue, s.orders, g.signups, i.stockout_rate, i.fill_rate FROM
            (SELECT order_month AS month, coalesce(sum(net_revenue), 0.0) AS revenue, count(DISTINCT order_id) AS orders
             FROM v_order_fact GROUP BY 1) s
          LEFT JOIN (SELECT CAST(date_trunc('month', signup_date) AS DATE) AS month, count(*) AS signups
                     FROM v_customer_fact GROUP BY 1) g USING (month)
          LEFT JOIN (SELECT snapshot_month AS month, avg(stockout_flag) AS stockout_rate, avg(fill_rate) AS fill_rate
                     FROM v_inventory_fact GROUP BY 1) i USING (month))"""


@register("fe_monthly_panel", W(f"""
    SELECT {D('month')} AS month, {R('revenue')} AS revenue, orders, signups, {R('stockout_rate')} AS stockout_rate,
           {R('fill_rate')} AS fill_rate FROM {_MP}""", "v_order_fact", "v_customer_fact", "v_inventory_fact"))
def fe_monthly_panel(cat):
    """Monthly revenue, orders, signups, stockout rate, fill rate."""
    of = FX.order_fact(cat)
    return FE.monthly_panel(of, FX.customer_fact(cat), FX.inventory_fact(cat))


@register("fe_monthly_features", W(f"""
    SELECT {D('month')} AS month, {R('revenue')} AS revenue, orders, signups, {R('stockout_rate')} AS stockout_rate,
           {R('fill_rate')} AS fill_rate, CAST(year(month) AS BIGINT) AS year, CAST(month(month) AS BIGINT) AS month_num,
           CAST(quarter(month) AS BIGINT) AS quarter, {R('lag(revenue) OVER (ORDER BY month)')} AS rev_lag_1,
           {R('CASE WHEN count(revenue) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 3 THEN avg(revenue) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END')} AS rev_lag_3_avg,
           lag(orders) OVER (ORDER BY month) AS orders_lag_1
    FROM {_MP}""", "v_order_fact", "v_customer_fact", "v_inventory_fact"))
def fe_monthly_features(cat):
    """year, month number, quarter, lag-1s and 3-month mean shifted by one (no backfill)."""
    of = FX.order_fact(cat)
    return FE.monthly_features(FE.monthly_panel(of, FX.customer_fact(cat), FX.inventory_fact(cat)))
