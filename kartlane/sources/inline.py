"""Literal dimension tables (bounded by construction, safe to broadcast).

Every table here has a size fixed by the constants below times the number of
calendar years the data spans (a few dozen rows), never by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the surveyed workload for identical features.
# ---------------------------------------------------------------------------
# Lunar New Year (Tet) dates by year, without a gap: public calendar dates.
# Dates outside these years raise an error (``features.tet_features``).
TET_DATES = {
    1994: "1994-02-10", 1995: "1995-01-31", 1996: "1996-02-19", 1997: "1997-02-07",
    1998: "1998-01-28", 1999: "1999-02-16", 2000: "2000-02-05", 2001: "2001-01-24",
    2002: "2002-02-12", 2003: "2003-02-01", 2004: "2004-01-22", 2005: "2005-02-09",
    2006: "2006-01-29", 2007: "2007-02-17", 2008: "2008-02-07", 2009: "2009-01-26",
    2010: "2010-02-14", 2011: "2011-02-03", 2012: "2012-01-23",
    2013: "2013-02-10", 2014: "2014-01-31", 2015: "2015-02-19",
    2016: "2016-02-08", 2017: "2017-01-28", 2018: "2018-02-16",
    2019: "2019-02-05", 2020: "2020-01-25", 2021: "2021-02-12",
    2022: "2022-02-01", 2023: "2023-01-22", 2024: "2024-02-10",
    2025: "2025-01-29", 2026: "2026-02-17", 2027: "2027-02-06", 2028: "2028-01-26",
}

# (name, start month, start day, duration days, discount or None, recurrence)
PROMO_SCHEDULE = [
    ("spring_sale", 3, 18, 30, 12, "yearly"),
    ("mid_year", 6, 23, 29, 18, "yearly"),
    ("fall_launch", 8, 30, 32, 10, "yearly"),
    ("year_end", 11, 18, 45, 20, "yearly"),
    ("urban_blowout", 7, 30, 33, None, "odd"),
    ("rural_special", 1, 30, 30, 15, "odd"),
]

# (month, day, name)
FIXED_HOLIDAYS = [
    (1, 1, "new_year"), (3, 8, "womens_day"),
    (4, 30, "reunification"), (5, 1, "labor_day"),
    (9, 2, "national_day"), (10, 20, "vn_womens_day"),
    (11, 11, "dd_1111"), (12, 12, "dd_1212"),
    (12, 24, "christmas_eve"), (12, 25, "christmas"),
]

# Day-of-year centres of recurring retail events (circular distance, mod 366).
EVENT_CENTERS = {
    "new_year": 1, "tet_like": 32, "valentine": 45, "womens_day": 67,
    "mid_year_sale": 181, "back_to_school": 244, "9_9": 252, "10_10": 283,
    "11_11": 315, "12_12": 346, "christmas_year_end": 359,
}

# Second-purchase timing milestones (days) and retention milestones (months).
TIMING_MILESTONES = [7, 14, 30, 60, 90, 180, 365, 730, 1095, 1460]
RETENTION_MILESTONES = [0, 1, 3, 6, 12]
TET_WINDOW_DAYS = 45
TET_SENTINEL = 999


def tet_table(spark: SparkSession) -> DataFrame:
    rows = [(y, d) for y, d in sorted(TET_DATES.items())]
    return (spark.createDataFrame(rows, "tet_year int, tet_date string")
            .select("tet_year", F.col("tet_date").cast("date").alias("tet_date")))


def campaigns_table(spark: SparkSession) -> DataFrame:
    rows = [(n, m, d, dur, None if disc is None else float(disc), rec)
            for n, m, d, dur, disc, rec in PROMO_SCHEDULE]
    return spark.createDataFrame(
        rows, "campaign string, start_month int, start_day int, duration int, discount double, recurrence string")


def promo_instances(spark: SparkSession, dates: DataFrame, date_col: str) -> DataFrame:
    """Expand the yearly schedule over [min year - 1, max year + 1] of ``dates``.

    One aggregate row -> exploded year list (tens of rows) x 6 campaigns.
    Odd-only campaigns skip even years; the wrap across 31 Dec is carried by
    start + duration.
    """
    years = (dates.agg(F.min(F.year(date_col)).alias("y0"), F.max(F.year(date_col)).alias("y1"))
             .select(F.explode(F.sequence(F.col("y0") - 1, F.col("y1") + 1)).alias("promo_year")))
    inst = years.crossJoin(F.broadcast(campaigns_table(spark)))
    inst = inst.filter((F.col("recurrence") != "odd") | (F.col("promo_year") % 2 == 1))
    start = F.make_date("promo_year", "start_month", "start_day")
    return inst.select("campaign", "promo_year", start.alias("start_date"),
                       F.date_add(start, F.col("duration")).alias("end_date"),
                       F.coalesce("discount", F.lit(0.0)).alias("discount"))


def promotions_schedule(spark: SparkSession, dates: DataFrame, date_col: str) -> DataFrame:
    """promotions table shaped like the workload's master data."""
    inst = promo_instances(spark, dates, date_col)
    return inst.select(
        F.concat_ws("_", "campaign", F.col("promo_year").cast("string")).alias("promo_id"),
        F.col("campaign").alias("promo_name"),
        F.when(F.col("discount") > 0, F.lit("percentage")).otherwise(F.lit("fixed")).alias("promo_type"),
        F.when(F.col("discount") > 0, F.col("discount")).otherwise(F.lit(50.0)).alias("discount_value"),
        "start_date", "end_date",
        F.lit(None).cast("string").alias("applicable_category"),
        F.lit(None).cast("string").alias("promo_channel"),
        F.lit(0).alias("stackable_flag"),
        F.lit(None).cast("double").alias("min_order_value"),
    )


def fold_table(spark: SparkSession, val_year: int) -> DataFrame:
    """Temporal folds A/B/C relative to a validation year (workload: 2022).

    A: train <= Y-1 end, validate year Y.  B: one year earlier.
    C: train <= mid Y-1, validate the 12 months from July Y-1.
    """
    y = val_year
    rows = [
        ("A", f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31"),
        ("B", f"{y - 2}-12-31", f"{y - 1}-01-01", f"{y - 1}-12-31"),
        ("C", f"{y - 1}-06-30", f"{y - 1}-07-01", f"{y}-06-30"),
    ]
    df = spark.createDataFrame(rows, "fold string, train_end string, val_start string, val_end string")
    return df.select("fold", *[F.col(c).cast("date").alias(c) for c in ("train_end", "val_start", "val_end")])
