"""Business queries: quick-answer set, seasonality, product / category views,
returns, shipments, payments and inventory summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlane.functions.exprs import (fdiv, label_concat, margin_ratio, month_name, month_trunc,
                                      promo_used, day_diff)
from kartlane.operators.windows import prev_in_key, running_sum

SIZES = ["S", "M", "L", "XL"]


# -- quick-answer set --------------------------------------------------------------
def inter_order_gap(orders: DataFrame) -> DataFrame:
    """Median days between a customer's consecutive orders (same-day gaps = 0 kept)."""
    o = orders.select("customer_id", "order_id", "order_date")
    prev = prev_in_key(o, "customer_id", "order_date", "order_id", "_prev")
    gaps = prev.select(day_diff("order_date", "_prev").alias("gap")).filter(F.col("gap").isNotNull())
    return gaps.agg(F.median("gap").alias("median_inter_order_gap_days"),
                    F.count(F.lit(1)).alias("gaps"))


def segment_margin(products: DataFrame) -> DataFrame:
    return (products.groupBy("segment")
            .agg(F.avg(margin_ratio("price", "cogs")).alias("gross_margin_ratio")))


def return_reasons(returns: DataFrame, products: DataFrame, category: str) -> DataFrame:
    r = returns.join(products.select("product_id", "category"), "product_id", "left")
    return (r.filter(F.col("category") == category)
            .groupBy("return_reason").agg(F.count(F.lit(1)).alias("returns")))


def bounce_by_source(web_traffic: DataFrame) -> DataFrame:
    return web_traffic.groupBy("traffic_source").agg(F.avg("bounce_rate").alias("mean_bounce_rate"))


def promo_usage(items: DataFrame) -> DataFrame:
    used = promo_used("promo_id", "promo_id_2")
    return items.agg(F.count_if(used).alias("promo_rows"), F.count(F.lit(1)).alias("total_rows"),
                     (fdiv(F.count_if(used), F.count(F.lit(1))) * 100.0).alias("promo_usage_percent"))


def orders_per_age_group(customers: DataFrame, orders: DataFrame) -> DataFrame:
    c = customers.select("customer_id", "age_group").distinct()
    j = c.join(orders.select("order_id", "customer_id"), "customer_id", "left")
    g = j.groupBy("age_group").agg(F.count("order_id").alias("total_orders"),
                                   F.count_distinct("customer_id").alias("total_customers"))
    return g.withColumn("avg_orders_per_customer", fdiv("total_orders", "total_customers"))


def region_revenue_alloc(orders: DataFrame, geography: DataFrame, sales: DataFrame) -> DataFrame:
    """Daily revenue allocated to regions by their share of the day's orders."""
    og = orders.select("order_date", "zip").join(geography.select("zip", "region"), "zip", "left")
    per_region = og.groupBy("order_date", "region").agg(F.count(F.lit(1)).alias("region_orders"))
    per_day = og.groupBy("order_date").agg(F.count(F.lit(1)).alias("total_orders"))
    share = per_region.join(per_day, "order_date", "left").withColumn(
        "order_share", fdiv("region_orders", "total_orders"))
    s = sales.select(F.col("Date").alias("order_date"), "Revenue")
    alloc = share.join(s, "order_date", "inner").withColumn(
        "estimated_region_revenue", F.col("order_share") * F.col("Revenue"))
    return alloc.groupBy("region").agg(F.sum("estimated_region_revenue").alias("estimated_region_revenue"))


def cancelled_methods(orders: DataFrame) -> DataFrame:
    return (orders.filter(F.col("order_status") == "cancelled")
            .groupBy("payment_method").agg(F.count(F.lit(1)).alias("cancelled_orders")))


def return_rate_by_size(returns: DataFrame, items: DataFrame, products: DataFrame, spark) -> DataFrame:
    """Return rows / item rows per size, forced onto the S/M/L/XL key set (missing -> 0)."""
    ps = products.select("product_id", "size")
    r = returns.join(ps, "product_id", "left").groupBy("size").agg(F.count(F.lit(1)).alias("return_rows"))
    i = items.join(ps, "product_id", "left").groupBy("size").agg(F.count(F.lit(1)).alias("item_rows"))
    keys = spark.createDataFrame([(s,) for s in SIZES], "size string")
    out = (F.broadcast(keys).join(r, "size", "left").join(i, "size", "left")
           .select("size", F.coalesce("return_rows", F.lit(0)).alias("return_rows"),
                   F.coalesce("item_rows", F.lit(0)).alias("item_rows")))
    return out.withColumn("return_rate", fdiv("return_rows", "item_rows"))


def value_by_installments(payments: DataFrame) -> DataFrame:
    return payments.groupBy("installments").agg(F.avg("payment_value").alias("mean_payment_value"))


def answer_sheet(parts: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One best label per question: (frame, label col, metric col, 'max'|'min')."""
    rows = []
    for q, (df, label, metric, how) in parts.items():
        pick = F.max_by if how == "max" else F.min_by
        # tie-break on the label so the answer is deterministic
        rows.append(df.agg(F.lit(q).alias("question"),
                           pick(F.col(label).cast("string"),
                                F.struct(F.col(metric), F.col(label).cast("string"))).alias("answer")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# -- customers and cohorts ------------------------------------------------------------
def cohort_summary(customers: DataFrame) -> DataFrame:
    """Monthly new customers by signup cohort, signup year, cumulative total.

    The running total is over the cohort-month table (one row per month), so
    the un-partitioned window sees a calendar-bounded number of rows.
    """
    c = customers.withColumn("cohort_date", month_trunc("signup_date")).filter(F.col("cohort_date").isNotNull())
    g = c.groupBy("cohort_date").agg(F.count_distinct("customer_id").alias("new_customers"))
    return g.select("cohort_date", "new_customers", F.year("cohort_date").alias("signup_year"),
                    running_sum("new_customers", [], "cohort_date").alias("cumulative_customers"))


def yearly_growth(customers: DataFrame) -> DataFrame:
    cs = cohort_summary(customers)
    y = cs.groupBy("signup_year").agg(F.sum("new_customers").alias("new_customers"))
    w = Window.orderBy("signup_year")      # one row per year
    prev = F.lag("new_customers").over(w)
    return y.withColumn("yoy_new_customer_change_pct",
                        F.col("new_customers").cast("double") / F.nullif(prev.cast("double"), F.lit(0.0)) - 1.0)


def channel_mix(customers: DataFrame) -> DataFrame:
    return (customers.withColumn("acquisition_channel", F.coalesce("acquisition_channel", F.lit("Missing")))
            .groupBy("acquisition_channel").agg(F.count_distinct("customer_id").alias("customers")))


# -- seasonality ---------------------------------------------------------------------
def revenue_seasonality(order_rev: DataFrame) -> DataFrame:
    """Year x month orders, revenue, cogs, gross margin (flagship)."""
    s = order_rev.select("order_id", "order_date", "net_revenue", "item_cogs")
    g = (s.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month"),
                   month_name("order_date").alias("month_name"))
         .agg(F.count_distinct("order_id").alias("orders"),
              F.coalesce(F.sum("net_revenue"), F.lit(0.0)).alias("revenue"),
              F.coalesce(F.sum("item_cogs"), F.lit(0.0)).alias("cogs")))
    return g.withColumn("gross_margin", F.col("revenue") - F.col("cogs"))


def product_seasonality(item_vals: DataFrame, orders: DataFrame) -> DataFrame:
    i = item_vals.join(orders.select("order_id", "order_date"), "order_id", "left")
    g = (i.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month"),
                   month_name("order_date").alias("month_name"), "category", "segment")
         .agg(F.sum("quantity").alias("quantity"), F.sum("net_item_value").alias("revenue"),
              F.sum("item_cogs").alias("cogs")))
    return g.withColumn("gross_margin", F.col("revenue") - F.col("cogs"))


def seasonal_profile(seasonal: DataFrame) -> DataFrame:
    return (seasonal.groupBy("month", "month_name")
            .agg(F.avg("revenue").alias("avg_revenue"), F.median("revenue").alias("median_revenue"),
                 F.avg("orders").alias("avg_orders"), F.avg("gross_margin").alias("avg_gross_margin")))


def product_month_profile(prod_seasonal: DataFrame) -> DataFrame:
    p = prod_seasonal.withColumn("product_group", label_concat("category", "segment"))
    return (p.groupBy("month", "month_name", "product_group")
            .agg(F.avg("revenue").alias("avg_revenue"), F.avg("quantity").alias("avg_quantity")))


def product_month_wide(profile: DataFrame) -> DataFrame:
    """product_group x month (1..12) of average revenue; explicit pivot values."""
    return profile.groupBy("product_group").pivot("month", list(range(1, 13))).agg(F.first("avg_revenue"))


def category_sales(item_vals: DataFrame) -> DataFrame:
    g = (item_vals.groupBy("category", "segment")
         .agg(F.sum("quantity").alias("quantity"), F.sum("net_item_value").alias("revenue"),
              F.sum("item_cogs").alias("cogs")))
    return g.withColumn("gross_margin", F.col("revenue") - F.col("cogs"))


def monthly_orders(order_rev: DataFrame) -> DataFrame:
    g = (order_rev.groupBy(month_trunc("order_date").alias("month_start"))
         .agg(F.count_distinct("order_id").alias("orders"),
              F.coalesce(F.sum("net_revenue"), F.lit(0.0)).alias("revenue"),
              F.coalesce(F.sum("item_cogs"), F.lit(0.0)).alias("cogs")))
    return g.withColumn("gross_margin", F.col("revenue") - F.col("cogs"))


def returns_summary(returns: DataFrame) -> DataFrame:
    return (returns.groupBy("return_reason")
            .agg(F.count("return_id").alias("return_rows"), F.sum("return_quantity").alias("returned_units"),
                 F.sum("refund_amount").alias("refund_amount")))


def shipment_lag(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """Ship / delivery lag per shipment (key lookup of the order date)."""
    s = shipments.join(orders.select("order_id", "order_date"), "order_id", "left")
    return s.select("order_id", day_diff("ship_date", "order_date").alias("ship_lag_days"),
                    day_diff("delivery_date", "ship_date").alias("delivery_lag_days"), "shipping_fee")


def payment_summary(payments: DataFrame) -> DataFrame:
    return (payments.groupBy("payment_method")
            .agg(F.count("order_id").alias("payment_rows"), F.sum("payment_value").alias("payment_value"),
                 F.avg("installments").alias("avg_installments")))


# -- inventory -------------------------------------------------------------------------
def inventory_status(inventory: DataFrame) -> DataFrame:
    m = inventory.withColumn("snapshot_month", month_trunc("snapshot_date"))
    # products are counted apart: beside a distinct count every product of a month would have medians of its own
    products = (m.groupBy("snapshot_month", "product_id").agg(F.lit(1).alias("_one"))
                .groupBy(F.col("snapshot_month").alias("_month")).agg(F.count("product_id").alias("unique_products")))
    g = (m.groupBy("snapshot_month")
         .agg(F.count(F.lit(1)).alias("product_month_rows"),
              F.sum("stockout_flag").alias("stockout_product_months"),
              F.sum("overstock_flag").alias("overstock_product_months"),
              F.sum("reorder_flag").alias("reorder_product_months"),
              F.sum("stockout_days").alias("total_stockout_days"),
              F.avg("stockout_days").alias("avg_stockout_days"),
              F.avg("fill_rate").alias("avg_fill_rate"), F.median("fill_rate").alias("median_fill_rate"),
              F.avg("days_of_supply").alias("avg_days_of_supply"),
              F.median("days_of_supply").alias("median_days_of_supply"),
              F.avg("sell_through_rate").alias("avg_sell_through_rate"),
              F.avg("stock_on_hand").alias("avg_stock_on_hand"),
              F.sum("units_received").alias("total_units_received"),
              F.sum("units_sold").alias("total_units_sold")))
    g = g.join(products, F.col("snapshot_month").eqNullSafe(F.col("_month"))).drop("_month")
    n = "product_month_rows"
    return g.withColumns({
        "stockout_product_month_rate": fdiv("stockout_product_months", n),
        "overstock_product_month_rate": fdiv("overstock_product_months", n),
        "reorder_product_month_rate": fdiv("reorder_product_months", n),
        "stockout_days_per_product_month": fdiv("total_stockout_days", n),
    })


def lost_units(inventory: DataFrame) -> DataFrame:
    """Category fill rate and implied lost demand: lost = u*(1-f)/f for f > 0.

    Two fill definitions are returned: the unit-weighted fill Σu/Σ(u+lost)
    (``unit_weighted_fill_rate``) and the fill-weighted-by-units Σ(u·f)/Σu
    (``units_weighted_avg_fill_rate``).
    """
    f = F.when(F.col("fill_rate") > 0, F.col("fill_rate"))
    inv = inventory.withColumn("lost_unit_sold_proxy", F.col("units_sold") * (F.lit(1.0) - f) / f)
    products = (inv.groupBy("category", "product_id").agg(F.lit(1).alias("_one"))     # apart, as above
                .groupBy(F.col("category").alias("_category")).agg(F.count("product_id").alias("unique_products")))
    g = (inv.groupBy("category")
         .agg(F.count(F.lit(1)).alias("product_month_rows"),
              F.sum("stockout_flag").alias("stockout_product_months"),
              F.sum("stockout_days").alias("total_stockout_days"),
              F.avg("fill_rate").alias("avg_fill_rate"), F.median("fill_rate").alias("median_fill_rate"),
              F.sum("units_sold").alias("total_units_sold"),
              F.coalesce(F.sum("lost_unit_sold_proxy"), F.lit(0.0)).alias("lost_unit_sold_proxy"),
              fdiv(F.sum(F.col("units_sold") * F.col("fill_rate")), F.sum("units_sold")).alias(
                  "units_weighted_avg_fill_rate")))
    g = g.join(products, F.col("category").eqNullSafe(F.col("_category"))).drop("_category")
    g = g.withColumn("estimated_unconstrained_units", F.col("total_units_sold") + F.col("lost_unit_sold_proxy"))
    return g.withColumns({
        "lost_unit_sold_proxy_share": fdiv("lost_unit_sold_proxy", "estimated_unconstrained_units"),
        "unit_weighted_fill_rate": fdiv("total_units_sold", "estimated_unconstrained_units"),
        "stockout_product_month_rate": fdiv("stockout_product_months", "product_month_rows"),
    })


def stock_by_group(inventory: DataFrame) -> DataFrame:
    g = (inventory.groupBy("category", "segment")
         .agg(F.count(F.lit(1)).alias("product_month_rows"),
              F.sum("stockout_flag").alias("stockout_product_months"),
              F.sum("overstock_flag").alias("overstock_product_months"),
              F.avg("fill_rate").alias("avg_fill_rate"), F.avg("days_of_supply").alias("avg_days_of_supply"),
              F.sum("units_sold").alias("total_units_sold")))
    return g.withColumns({
        "stockout_product_month_rate": fdiv("stockout_product_months", "product_month_rows"),
        "overstock_product_month_rate": fdiv("overstock_product_months", "product_month_rows"),
    })


def stockout_examples(inventory: DataFrame) -> DataFrame:
    return inventory.filter(F.col("stockout_flag") == 1).select(
        "snapshot_date", "product_id", "product_name", "category", "segment", "stockout_days",
        "units_sold", "stock_on_hand", "fill_rate")


def category_unit_share(inventory: DataFrame) -> DataFrame:
    """Share of units and of lost units per category, Σ(u·f)/Σu, ratio to the runner-up."""
    lu = lost_units(inventory).select("category", "total_units_sold", "lost_unit_sold_proxy",
                                      "units_weighted_avg_fill_rate")
    w_all = Window.partitionBy()          # one row per category
    w_rank = Window.orderBy(F.desc("total_units_sold"), F.asc("category"))
    out = lu.withColumns({
        "unit_share": fdiv("total_units_sold", F.sum("total_units_sold").over(w_all)),
        "lost_unit_share": fdiv("lost_unit_sold_proxy", F.sum("lost_unit_sold_proxy").over(w_all)),
        "units_rank": F.row_number().over(w_rank),
    })
    return out.withColumn("units_ratio_to_next",
                          fdiv("total_units_sold", F.lead("total_units_sold").over(w_rank)))
