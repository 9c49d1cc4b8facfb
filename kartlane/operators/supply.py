"""Supply-side analyses (stockout heatmap, risk matrix, fill vs demand) and the
monthly overview, plus daily-series profiles used before forecasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartlane.functions.exprs import era_label, month_trunc, period_label, weekday_mon0
from kartlane.operators.aggregates import histogram
from kartlane.operators.joins import date_spine

PERIOD_CUT_YEAR = 1998          # workload: 2018 on its 2012-2022 data; test data spans 1995-2001
ERA_BOUNDS = (1997, 1999, 2000)  # workload: 2014, 2019, 2020 on 2012-2022


def stockout_heatmap(inv_fact: DataFrame, cut: int = PERIOD_CUT_YEAR) -> DataFrame:
    """Mean stockout flag by category x period x month (long form)."""
    f = inv_fact.withColumn("period", period_label("year", cut))
    return (f.groupBy("category", "period", "month")
            .agg(F.avg("stockout_flag").alias("stockout_rate")))


def stockout_heatmap_wide(inv_fact: DataFrame, cut: int = PERIOD_CUT_YEAR) -> DataFrame:
    """category x (period, month) matrix; explicit pivot values on the concatenated label."""
    f = stockout_heatmap(inv_fact, cut).withColumn(
        "period_month", F.concat_ws("_", "period", F.lpad(F.col("month").cast("string"), 2, "0")))
    labels = [f"{p}_{m:02d}" for p in ("Past", "Recent") for m in range(1, 13)]
    return f.groupBy("category").pivot("period_month", labels).agg(F.first("stockout_rate"))


def risk_cells(inv_fact: DataFrame) -> DataFrame:
    return (inv_fact.groupBy("category", "segment")
            .agg(F.avg("stockout_flag").alias("stockout_rate"), F.avg("overstock_flag").alias("overstock_rate"),
                 F.sum("units_sold").alias("total_volume")))


def risk_matrix(inv_fact: DataFrame) -> DataFrame:
    """Cells vs the medians of the cells -> quadrant label.

    High = strictly above the cell median.  Medians come from a one-row
    aggregate over the (category x segment) cell table, broadcast.
    """
    cells = risk_cells(inv_fact)
    med = cells.agg(F.median("stockout_rate").alias("median_stockout_rate"),
                    F.median("overstock_rate").alias("median_overstock_rate"))
    j = cells.crossJoin(F.broadcast(med))
    hs = F.col("stockout_rate") > F.col("median_stockout_rate")
    ho = F.col("overstock_rate") > F.col("median_overstock_rate")
    quad = (F.when(hs & ~ho, F.lit("UNDER-STOCKED")).when(hs & ho, F.lit("POOR PLANNING"))
            .when(~hs & ~ho, F.lit("HEALTHY")).otherwise(F.lit("OVER-STOCKED")))
    return j.withColumn("quadrant", quad)


def risk_distribution(inv_fact: DataFrame, bins: int = 15) -> DataFrame:
    """Mean / median of the cell rates and a 15-bin histogram for each rate, long form."""
    cells = risk_cells(inv_fact)
    long = cells.unpivot(["category", "segment"], ["stockout_rate", "overstock_rate"], "metric", "rate")
    stats = long.groupBy("metric").agg(F.avg("rate").alias("mean_rate"), F.median("rate").alias("median_rate"))
    h = histogram(long, "rate", bins, keys=["metric"])
    return h.join(stats, "metric", "left")


def fill_vs_demand(inv_fact: DataFrame) -> DataFrame:
    c = (inv_fact.groupBy("category")
         .agg(F.sum("units_sold").alias("total_units_sold"), F.avg("fill_rate").alias("avg_fill_rate"),
              F.avg("stockout_days").alias("avg_stockout_days")))
    med = c.agg(F.median("total_units_sold").alias("median_units_sold"),
                F.median("avg_fill_rate").alias("median_fill_rate"))
    j = c.crossJoin(F.broadcast(med))
    hd = F.col("total_units_sold") > F.col("median_units_sold")
    hf = F.col("avg_fill_rate") > F.col("median_fill_rate")
    lab = (F.when(hd & hf, F.lit("HIGH DEMAND / LOW SUPPLY RISK"))
           .when(~hd & hf, F.lit("LOW DEMAND / LOW SUPPLY RISK"))
           .when(hd & ~hf, F.lit("HIGH DEMAND / SUPPLY CONSTRAINT"))
           .otherwise(F.lit("LOW DEMAND / LOW PRIORITY")))
    return j.withColumn("quadrant", lab)


def overview_monthly(cust_fact: DataFrame, order_fact: DataFrame, inv_fact: DataFrame) -> DataFrame:
    """Monthly signups, orders, net sales and stockout prevalence on one month spine."""
    s = cust_fact.groupBy(month_trunc("signup_date").alias("month")).agg(F.count(F.lit(1)).alias("signups"))
    o = (order_fact.groupBy(month_trunc("order_date").alias("month"))
         .agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("net_revenue"), F.lit(0.0)).alias("net_sales")))
    i = inv_fact.groupBy(F.col("snapshot_month").alias("month")).agg(
        F.avg("stockout_flag").alias("stockout_prevalence"))
    months = s.select("month").unionByName(o.select("month")).unionByName(i.select("month")).filter(
        F.col("month").isNotNull())
    spine = date_spine(months, "month", "month", unit="month")
    return (spine.join(s, "month", "left").join(o, "month", "left").join(i, "month", "left"))


# -- daily series profiles ---------------------------------------------------------
def month_shape_by_year(sales: DataFrame) -> DataFrame:
    return (sales.groupBy(F.year("Date").alias("year"), F.month("Date").alias("month"))
            .agg(F.avg("Revenue").alias("avg_revenue")))


def dow_dom_profile(sales: DataFrame) -> DataFrame:
    """Average revenue by weekday (Mon=0) and by day of month, as one long table."""
    dow = (sales.groupBy(weekday_mon0("Date").alias("key")).agg(F.avg("Revenue").alias("avg_revenue"))
           .withColumn("profile", F.lit("dayofweek")))
    dom = (sales.groupBy(F.dayofmonth("Date").alias("key")).agg(F.avg("Revenue").alias("avg_revenue"))
           .withColumn("profile", F.lit("day")))
    return dow.unionByName(dom).select("profile", "key", "avg_revenue")


def odd_even_profile(sales: DataFrame) -> DataFrame:
    return (sales.groupBy((F.year("Date") % 2).alias("is_odd_year"), F.month("Date").alias("month"))
            .agg(F.avg("Revenue").alias("avg_revenue")))


def quarterly_cogs_ratio(sales: DataFrame) -> DataFrame:
    q = (sales.groupBy(F.year("Date").alias("year"), F.quarter("Date").alias("quarter"))
         .agg(F.sum("Revenue").alias("revenue"), F.sum("COGS").alias("cogs")))
    return q.withColumn("margin", F.col("cogs") / F.nullif(F.col("revenue"), F.lit(0.0)))


def daily_profit(sales: DataFrame) -> DataFrame:
    p = F.col("Revenue") - F.col("COGS")
    return sales.select("Date", p.alias("profit"), (p >= 0).alias("is_profitable"))


def era_distribution(sales: DataFrame, bins: int = 50, bounds=ERA_BOUNDS) -> DataFrame:
    """Revenue density histogram per era (bins over each era's own range)."""
    e = sales.withColumn("era", era_label(F.year("Date"), bounds))
    return histogram(e, "Revenue", bins, keys=["era"], density=True)
