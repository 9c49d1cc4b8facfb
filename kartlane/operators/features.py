"""Time-series feature operators on a daily panel.

Panel shape: ``(series_id, Date, <targets...>)`` wide, or long
``(series_id, target, Date, y)``.  All lag / rolling windows partition by
``(series_id, target)`` and order by Date; the panel is first aggregated to
one row per (series, day) on a gap-free spine, so rows per window partition
are bounded by the calendar length, not the raw data volume.

Calendar / holiday / promo / Tet features depend on the date only; they are
computed with column expressions and broadcast range joins against literal
tables (bounded size).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartlane.functions.exprs import days_in_month, last_friday_of_november, weekday_mon0
from kartlane.operators.joins import nearest_event, range_join_promo
from kartlane.operators.windows import expanding_mean, lag, shifted_rolling
from kartlane.sources.inline import (EVENT_CENTERS, FIXED_HOLIDAYS, PROMO_SCHEDULE, TET_SENTINEL,
                                     TET_DATES, TET_WINDOW_DAYS, promo_instances, tet_table)

TARGETS = ["Revenue", "COGS"]
LAGS = [1, 7, 14, 30, 365]
ROLLING_WINDOWS = [7, 30, 90, 365]
TAU = 2 * math.pi


def to_long(panel: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    keys = [c for c in panel.columns if c not in targets]
    return panel.unpivot(keys, targets, "target", "y")


# -- calendar ------------------------------------------------------------------------
def calendar_basic(df: DataFrame, d: str = "Date") -> DataFrame:
    """14 calendar columns + start / end flags (ISO week, Monday = 0)."""
    c = F.col(d)
    mend = c == F.last_day(c)
    return df.withColumns({
        "year": F.year(c), "quarter": F.quarter(c), "month": F.month(c),
        "weekofyear": F.weekofyear(c), "dayofyear": F.dayofyear(c), "dayofmonth": F.dayofmonth(c),
        "dayofweek": weekday_mon0(c),
        "is_weekend": (weekday_mon0(c) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(c) == 1).cast("int"),
        "is_month_end": mend.cast("int"),
        "is_quarter_start": ((F.dayofmonth(c) == 1) & (F.month(c) % 3 == 1)).cast("int"),
        "is_quarter_end": (mend & (F.month(c) % 3 == 0)).cast("int"),
        "is_year_start": ((F.dayofmonth(c) == 1) & (F.month(c) == 1)).cast("int"),
        "is_year_end": ((F.dayofmonth(c) == 31) & (F.month(c) == 12)).cast("int"),
    })


CYCLES = {"dayofweek": 7, "dayofyear": 366, "month": 12, "weekofyear": 53}


def cyclical(df: DataFrame) -> DataFrame:
    cols = {}
    for c, period in CYCLES.items():
        ang = F.lit(TAU) * F.col(c) / F.lit(float(period))
        cols[f"{c}_sin"] = F.sin(ang)
        cols[f"{c}_cos"] = F.cos(ang)
    return df.withColumns(cols)


# -- lag / rolling (long panel) --------------------------------------------------------
def lag_rolling(long: DataFrame) -> DataFrame:
    """Lags 1/7/14/30/365 and shifted rolling mean/std/min/max over 7/30/90/365
    with min_periods = max(2, n // 3), per (series_id, target)."""
    p, o = ["series_id", "target"], "Date"
    cols = {f"lag_{k}": lag("y", p, o, k) for k in LAGS}
    for n in ROLLING_WINDOWS:
        mp = max(2, n // 3)
        for fn in ("mean", "std", "min", "max"):
            cols[f"roll_{fn}_{n}"] = shifted_rolling("y", p, o, n, "avg" if fn == "mean" else fn, mp)
    cols["expanding_mean"] = expanding_mean("y", p, o, 30)
    return long.withColumns(cols)


def cross_target_lags(panel: DataFrame) -> DataFrame:
    """gross margin and COGS/Revenue ratio of the previous day (wide panel)."""
    p, o = ["series_id"], "Date"
    r1, c1 = lag("Revenue", p, o, 1), lag("COGS", p, o, 1)
    return panel.withColumns({"gross_margin_lag_1": r1 - c1,
                              "cogs_to_revenue_lag_1": c1 / F.nullif(r1, F.lit(0.0))})


def feature_kinds() -> dict[str, tuple[str, int | None, str | None]]:
    """``(kind, days, target)`` of each name that the one-step feature operators give."""
    out: dict[str, tuple[str, int | None, str | None]] = {}
    for t in TARGETS:
        out |= {f"{t}_lag_{k}": ("lag", k, t) for k in LAGS}
        out |= {f"{t}_roll_{fn}_{n}": (f"rolling_{fn}", n, t) for n in ROLLING_WINDOWS for fn in ("mean", "std", "min", "max")}
        out[f"{t}_expanding_mean"] = ("expanding_mean", None, t)
    out |= {"gross_margin_lag_1": ("margin", 1, None), "cogs_to_revenue_lag_1": ("cost_ratio", 1, None)}
    out |= {c: ("calendar", None, None) for c in ("year", "quarter", "month", "weekofyear", "dayofyear", "dayofmonth", "dayofweek", "is_weekend")}
    out |= {f"is_{p}_{e}": ("period_edge", None, None) for p in ("month", "quarter", "year") for e in ("start", "end")}
    return out | {f"{c}_{f}": ("cycle", period, None) for c, period in CYCLES.items() for f in ("sin", "cos")}


# -- build_features: calendar-only featurisation (81 columns) ---------------------------
REGIME_YEAR = 1997  # the workload's regime year, 2019, moved by 22 years like the other eras of the test data


def calendar_final(df: DataFrame, d: str = "Date", t0: str = "2020-01-01", regime_year: int = REGIME_YEAR) -> DataFrame:
    c = F.col(d)
    dim = days_in_month(c)
    base = {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dow": weekday_mon0(c),
        "doy": F.dayofyear(c), "quarter": F.quarter(c), "is_weekend": (weekday_mon0(c) >= 5).cast("int"),
        "days_to_eom": dim - F.dayofmonth(c), "days_from_som": F.dayofmonth(c) - 1, "dim": dim,
    }
    out = df.withColumns(base)
    edge = {}
    for k in (1, 2, 3):
        edge[f"is_last{k}"] = (F.col("days_to_eom") <= k - 1).cast("int")
        edge[f"is_first{k}"] = (F.col("days_from_som") <= k - 1).cast("int")
    t_days = F.datediff(c, F.lit(t0).cast("date"))
    edge.update({"t_days": t_days, "t_years": t_days / F.lit(365.25),
                 "regime_pre2019": (F.col("year") < regime_year).cast("int"),
                 "regime_2019": (F.col("year") == regime_year).cast("int"),
                 "regime_post2019": (F.col("year") > regime_year).cast("int")})
    return out.withColumns(edge)


def fourier_calendar(df: DataFrame) -> DataFrame:
    cols = {}
    for k in (1, 2, 3, 4, 5):
        a = F.lit(TAU * k) * F.col("doy") / F.lit(365.25)
        cols[f"sin_y{k}"], cols[f"cos_y{k}"] = F.sin(a), F.cos(a)
    for k in (1, 2):
        a = F.lit(TAU * k) * F.col("dow") / F.lit(7.0)
        cols[f"sin_w{k}"], cols[f"cos_w{k}"] = F.sin(a), F.cos(a)
    for k in (1, 2):
        a = F.lit(TAU * k) * (F.col("day") - 1) / F.col("dim")
        cols[f"sin_m{k}"], cols[f"cos_m{k}"] = F.sin(a), F.cos(a)
    return df.withColumns(cols)


def fixed_holidays(df: DataFrame) -> DataFrame:
    return df.withColumns({f"hol_{n}": ((F.col("month") == m) & (F.col("day") == dd)).cast("int")
                           for m, dd, n in FIXED_HOLIDAYS})


def tet_features(spark, df: DataFrame, d: str = "Date") -> DataFrame:
    """Signed days to the nearest Tet within +-45 (else 999) and five flags."""
    known = F.year(d).between(min(TET_DATES), max(TET_DATES)) | F.col(d).isNull()
    df = df.withColumn(d, F.when(known, F.col(d)).otherwise(
        F.raise_error(F.concat(F.lit("no Lunar New Year is listed for "), F.col(d).cast("string"))).cast("date")))
    out = nearest_event(df, d, tet_table(spark), "tet_date", TET_WINDOW_DAYS, TET_SENTINEL, "tet_days_diff")
    x = F.col("tet_days_diff")
    return out.withColumns({
        "tet_in_7": (F.abs(x) <= 7).cast("int"), "tet_in_14": (F.abs(x) <= 14).cast("int"),
        "tet_before_7": ((x >= -7) & (x < 0)).cast("int"), "tet_after_7": ((x > 0) & (x <= 7)).cast("int"),
        "tet_on": (x == 0).cast("int"),
    })


def black_friday(df: DataFrame, d: str = "Date") -> DataFrame:
    """Last Friday of November (not the 4th)."""
    c = F.col(d)
    return df.withColumn("hol_black_friday", (c == last_friday_of_november(F.year(c))).cast("int"))


def promo_windows(spark, df: DataFrame, d: str = "Date", flags_only: bool = False) -> DataFrame:
    """6 campaigns x (in, since, until, disc); -1 sentinels outside, NULL discount -> 0.

    Instances span year-1 .. year+1 of the dates (31 Dec wrap); a broadcast
    range join finds covering instances; a conditional max folds them per
    day.  If two instances of one campaign covered a day the later start wins
    (the workload's loop overwrites in year order).
    """
    dates = df.select(d).distinct()
    inst = promo_instances(spark, dates, d)
    hits = range_join_promo(dates, d, inst)
    aggs = []
    for name, *_ in PROMO_SCHEDULE:
        is_c = F.col("campaign") == name
        pick = F.max_by(F.struct(F.datediff(F.col(d), F.col("start_date")).alias("since"),
                                 F.datediff(F.col("end_date"), F.col(d)).alias("until"),
                                 F.col("discount").alias("disc")),
                        F.when(is_c, F.col("start_date")))
        aggs.append(F.max(is_c.cast("int")).alias(f"promo_{name}"))
        if not flags_only:
            aggs.append(pick.alias(f"_p_{name}"))
    per_day = hits.groupBy(d).agg(*aggs)
    out = df.join(per_day, d, "left")
    cols = {}
    for name, *_ in PROMO_SCHEDULE:
        cols[f"promo_{name}"] = F.coalesce(F.col(f"promo_{name}"), F.lit(0))
        if not flags_only:
            on = cols[f"promo_{name}"] == 1
            cols[f"promo_{name}_since"] = F.when(on, F.col(f"_p_{name}.since").cast("double")).otherwise(-1.0)
            cols[f"promo_{name}_until"] = F.when(on, F.col(f"_p_{name}.until").cast("double")).otherwise(-1.0)
            cols[f"promo_{name}_disc"] = F.when(on, F.col(f"_p_{name}.disc")).otherwise(0.0)
    out = out.withColumns(cols)
    return out.drop(*[f"_p_{n}" for n, *_ in PROMO_SCHEDULE])


def build_features(spark, dates: DataFrame, d: str = "Date") -> DataFrame:
    """Calendar-only featurisation: 81 features from the date alone."""
    f = calendar_final(dates, d)
    f = fourier_calendar(f)
    f = fixed_holidays(f)
    f = tet_features(spark, f, d)
    f = black_friday(f, d)
    f = promo_windows(spark, f, d)
    return f.withColumn("is_odd_year", F.col("year") % 2)


FEATURE_GROUPS = {
    "calendar": ["year", "month", "day", "dow", "doy", "quarter", "is_weekend", "days_to_eom", "days_from_som", "dim"],
    "edges": [f"is_{e}{k}" for k in (1, 2, 3) for e in ("last", "first")],
    "trend": ["t_days", "t_years", "regime_pre2019", "regime_2019", "regime_post2019"],
}


# -- event features (v2) ---------------------------------------------------------------
def events_v2(df: DataFrame, d: str = "Date") -> DataFrame:
    m, dd = F.month(d), F.dayofmonth(d)
    return df.withColumns({
        "event_new_year": (((m == 12) & (dd >= 29)) | ((m == 1) & (dd <= 5))).cast("int"),
        "event_tet_like": (((m == 1) & (dd >= 20)) | ((m == 2) & (dd <= 10))).cast("int"),
        "event_valentine": ((m == 2) & dd.between(10, 15)).cast("int"),
        "event_womens_day": ((m == 3) & dd.between(5, 9)).cast("int"),
        "event_mid_year_sale": (((m == 6) & (dd >= 15)) | ((m == 7) & (dd <= 7))).cast("int"),
        "event_back_to_school": ((m == 8) | ((m == 9) & (dd <= 10))).cast("int"),
        "event_9_9": ((m == 9) & dd.between(7, 11)).cast("int"),
        "event_10_10": ((m == 10) & dd.between(8, 12)).cast("int"),
        "event_11_11": ((m == 11) & dd.between(9, 13)).cast("int"),
        "event_12_12": ((m == 12) & dd.between(10, 14)).cast("int"),
        "event_christmas_year_end": ((m == 12) & (dd >= 20)).cast("int"),
        "event_payday": ((dd >= 25) | (dd <= 5)).cast("int"),
    })


def event_distance(df: DataFrame, d: str = "Date") -> DataFrame:
    doy = F.dayofyear(d)
    return df.withColumns({f"days_to_{n}": F.least(F.abs(doy - c), F.lit(366) - F.abs(doy - c))
                           for n, c in EVENT_CENTERS.items()})


FOURIER_PERIODS = [7, 30.5, 365.25]
FOURIER_K = [1, 2, 3]


def fourier_trend(df: DataFrame, start_col: str = "data_start", d: str = "Date") -> DataFrame:
    """sin/cos k=1..3 on days since the series start for periods 7, 30.5, 365.25."""
    idx = F.datediff(F.col(d), F.col(start_col))
    cols = {"days_from_start": idx}
    for p in FOURIER_PERIODS:
        lab = str(p).replace(".", "_")
        for k in FOURIER_K:
            a = F.lit(TAU * k) * idx / F.lit(float(p))
            cols[f"sin_{lab}_{k}"], cols[f"cos_{lab}_{k}"] = F.sin(a), F.cos(a)
    return df.withColumns(cols)


# -- baseline lags and YoY (long panel) ---------------------------------------------
def baseline_lags(long: DataFrame) -> DataFrame:
    """lag 364/365/371 and shifted rolling means 7/30/90 (min_periods = n)."""
    p, o = ["series_id", "target"], "Date"
    cols = {f"lag_{k}": lag("y", p, o, k) for k in (364, 365, 371)}
    for n in (7, 30, 90):
        cols[f"rolling_{n}"] = shifted_rolling("y", p, o, n, "avg", n)
    return long.withColumns(cols)


def yoy_growth(long: DataFrame) -> DataFrame:
    """lag364/lag728 - 1, lag365/lag730 - 1, rolling30 / rolling30 a year earlier - 1."""
    from kartlane.operators.windows import rolling
    p, o = ["series_id", "target"], "Date"
    r30 = shifted_rolling("y", p, o, 30, "avg", 30)
    r30_ly = rolling("y", p, o, -394, -365, "avg", 30)
    return long.withColumns({
        "yoy_lag_364_growth": lag("y", p, o, 364) / F.nullif(lag("y", p, o, 728), F.lit(0.0)) - 1.0,
        "yoy_lag_365_growth": lag("y", p, o, 365) / F.nullif(lag("y", p, o, 730), F.lit(0.0)) - 1.0,
        "rolling_30_yoy_growth": r30 / F.nullif(r30_ly, F.lit(0.0)) - 1.0,
    })


def era_weights(df: DataFrame, lo: int, hi: int, d: str = "Date") -> DataFrame:
    """Sample weight 1.0 inside the clean era [lo, hi], 0.01 elsewhere."""
    y = F.year(d)
    return df.withColumn("weight", F.when((y >= lo) & (y <= hi), F.lit(1.0)).otherwise(F.lit(0.01)))


def quarter_boost(df: DataFrame, quarter: int, boost: float = 3.0, d: str = "Date") -> DataFrame:
    return df.withColumn("weight", F.when(F.quarter(d) == quarter, F.col("weight") * boost).otherwise(F.col("weight")))


# -- monthly panel ----------------------------------------------------------------------
def monthly_panel(order_fact: DataFrame, cust_fact: DataFrame, inv_fact: DataFrame) -> DataFrame:
    """Monthly revenue, orders, signups, stockout rate and fill rate (left onto sales months)."""
    from kartlane.functions.exprs import month_trunc
    s = (order_fact.groupBy(month_trunc("order_date").alias("month"))
         .agg(F.coalesce(F.sum("net_revenue"), F.lit(0.0)).alias("revenue"),
              F.count_distinct("order_id").alias("orders")))
    g = cust_fact.groupBy(month_trunc("signup_date").alias("month")).agg(F.count(F.lit(1)).alias("signups"))
    i = (inv_fact.groupBy(F.col("snapshot_month").alias("month"))
         .agg(F.avg("stockout_flag").alias("stockout_rate"), F.avg("fill_rate").alias("fill_rate")))
    return s.join(g, "month", "left").join(i, "month", "left")


def monthly_features(panel: DataFrame, backfill: bool = False) -> DataFrame:
    """year, month_num, quarter, rev_lag_1, rev_lag_3_avg (3-month mean shifted 1), orders_lag_1.

    One series: the window has no partition key but runs over the monthly
    table (one row per month).  ``backfill`` reproduces the workload's bfill
    (which leaks later rows into the first ones); default leaves NULLs.
    """
    from pyspark.sql import Window
    w = Window.orderBy("month")
    f = panel.withColumns({
        "year": F.year("month"), "month_num": F.month("month"), "quarter": F.quarter("month"),
        "rev_lag_1": F.lag("revenue", 1).over(w),
        "rev_lag_3_avg": F.when(F.count("revenue").over(w.rowsBetween(-3, -1)) >= 3,
                                F.avg("revenue").over(w.rowsBetween(-3, -1))),
        "orders_lag_1": F.lag("orders", 1).over(w),
    })
    if backfill:
        wf = w.rowsBetween(0, Window.unboundedFollowing)
        f = f.withColumns({c: F.first(c, ignorenulls=True).over(wf)
                           for c in ("signups", "stockout_rate", "fill_rate", "rev_lag_1", "rev_lag_3_avg",
                                     "orders_lag_1")})
    return f
