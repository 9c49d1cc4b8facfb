"""The 14 retail tables, derived by Spark from the driver's star schema.

Each builder is a lazy projection / aggregation over the Parquet scans, so
column pruning and predicate pushdown reach the files.  Joins are left to
Catalyst + AQE: none is forced to broadcast, because every table here grows
with the scale factor (AQE turns a join into a broadcast at run time only
when the measured side is under ``spark.sql.autoBroadcastJoinThreshold``).

Mapping (one line per table):
  customers   <- customer      products  <- part       geography <- nation+region
  orders      <- orders        order_items <- lineitem payments  <- orders
  shipments   <- lineitem by order            returns   <- lineitem flag R
  reviews     <- lineitem flag A (+orders)    inventory <- lineitem by (part, month)
  sales       <- daily net revenue / cogs on a gap-free date spine
  web_traffic <- events by (day, type)        promotions <- yearly schedule
  sample_submission <- the 548 days after the last sales day
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartlane.functions.exprs import r4
from kartlane.sources.inline import promotions_schedule

# Fixed label lists used to derive categorical stand-in columns.
SIZES = ["S", "M", "L", "XL"]
AGE_GROUPS = ["18-24", "25-34", "35-44", "45-54", "55+"]
GENDERS = ["female", "male", "other"]
COLORS = ["red", "blue", "green", "black", "white"]
DEVICES = ["desktop", "mobile", "tablet"]
SOURCES = ["organic_search", "paid_search", "social_media", "email_campaign", "referral", "direct"]
RETURN_REASONS = ["defective", "wrong_size", "changed_mind", "not_as_described", "late_delivery"]
STATUS_MAP = {"F": "delivered", "O": "returned", "P": "cancelled"}
FORECAST_HORIZON_DAYS = 548


def pick(labels: list[str], idx: Column) -> Column:
    """labels[idx] with a 0-based integer column (JVM-side, no UDF)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (idx + 1).cast("int"))


def customers(cat) -> DataFrame:
    c = cat.raw("customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("customer_id"),
        F.col("c_nationkey").cast("bigint").alias("zip"),
        F.concat(F.lit("City-"), F.col("c_nationkey").cast("string")).alias("city"),
        F.date_add(F.lit("1994-06-01").cast("date"), (k * 37 % 2400).cast("int")).alias("signup_date"),
        F.when(k % 43 == 0, F.lit(None).cast("string")).otherwise(pick(GENDERS, k % 3)).alias("gender"),
        F.when(k % 41 == 0, F.lit(None).cast("string")).otherwise(pick(AGE_GROUPS, k % 5)).alias("age_group"),
        F.when(k % 37 == 0, F.lit(None).cast("string"))
         .when(k % 53 == 0, F.lit(" "))
         .otherwise(F.col("c_mktsegment")).alias("acquisition_channel"),
    )


def products(cat) -> DataFrame:
    p = cat.raw("part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("segment"),
        pick(SIZES, F.col("p_size") % 4).alias("size"),
        pick(COLORS, F.col("p_partkey") % 5).alias("color"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_retailprice") * F.lit(0.6)).alias("cogs"),
    )


def geography(cat) -> DataFrame:
    n = cat.raw("nation")
    r = cat.raw("region")
    return (n.join(r, n.n_regionkey == r.r_regionkey, "inner")
            .select(F.col("n_nationkey").cast("bigint").alias("zip"),
                    F.concat(F.lit("City-"), F.col("n_nationkey").cast("string")).alias("city"),
                    F.col("r_name").alias("region"),
                    F.col("n_name").alias("district")))


def _status(c: Column) -> Column:
    out = None
    for code, label in STATUS_MAP.items():
        out = (F.when(c == code, F.lit(label)) if out is None else out.when(c == code, F.lit(label)))
    return out


def orders(cat) -> DataFrame:
    o = cat.raw("orders")
    cust = cat.raw("customer").select(F.col("c_custkey"), F.col("c_nationkey").cast("bigint").alias("zip"))
    k = F.col("o_orderkey")
    base = o.select(
        k.alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        _status(F.col("o_orderstatus")).alias("order_status"),
        F.col("o_orderpriority").alias("payment_method"),
        pick(DEVICES, k % 3).alias("device_type"),
        pick(SOURCES, k % 6).alias("order_source"),
    )
    # zip comes from the customer's nation (a key lookup, left join keeps all orders)
    return (base.join(cust, base.customer_id == cust.c_custkey, "left")
            .select("order_id", "order_date", "customer_id", "zip", "order_status",
                    "payment_method", "device_type", "order_source"))


def orders_slim(cat) -> DataFrame:
    """orders without the zip lookup, for queries that never read zip."""
    o = cat.raw("orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        _status(F.col("o_orderstatus")).alias("order_status"),
        F.col("o_orderpriority").alias("payment_method"),
        pick(DEVICES, k % 3).alias("device_type"),
        pick(SOURCES, k % 6).alias("order_source"),
    )


def order_items(cat) -> DataFrame:
    li = cat.raw("lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
        F.when(F.col("l_discount") >= F.lit(0.06),
               F.concat(F.lit("PROMO-"), (F.col("l_suppkey") % 10).cast("string"))).alias("promo_id"),
        F.when(F.col("l_tax") >= F.lit(0.07),
               F.concat(F.lit("PROMO-"), (F.col("l_suppkey") % 7 + 10).cast("string"))).alias("promo_id_2"),
    )


def payments(cat) -> DataFrame:
    o = cat.raw("orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_totalprice").alias("payment_value"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("installments"),
    )


def shipments(cat) -> DataFrame:
    li = cat.raw("lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.min(F.col("l_shipdate").cast("date")).alias("ship_date"),
                 F.date_add(F.max(F.col("l_shipdate").cast("date")), 3).alias("delivery_date"),
                 (F.count(F.lit(1)).cast("double") * F.lit(5.0)).alias("shipping_fee")))


def _line_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("l_orderkey").cast("string"), F.lit("-"),
                    F.col("l_linenumber").cast("string"))


def returns(cat) -> DataFrame:
    li = cat.raw("lineitem").filter(F.col("l_returnflag") == "R")
    return li.select(
        _line_id("RET-").alias("return_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.date_add(F.col("l_shipdate").cast("date"), 10).alias("return_date"),
        pick(RETURN_REASONS, F.col("l_suppkey") % 5).alias("return_reason"),
        F.col("l_quantity").cast("bigint").alias("return_quantity"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("refund_amount"),
    )


def reviews(cat) -> DataFrame:
    li = cat.raw("lineitem").filter(F.col("l_returnflag") == "A")
    o = cat.raw("orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    return j.select(
        _line_id("REV-").alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_custkey").alias("customer_id"),
        F.date_add(F.col("l_shipdate").cast("date"), 14).alias("review_date"),
        (F.col("l_linenumber") % 5 + 1).cast("bigint").alias("rating"),
        F.lit("ok").alias("review_title"),
    )


def inventory(cat, by_month: bool = False) -> DataFrame:
    """A row for each product and month with sales; ``by_month``: dealt by month before the columns are derived."""
    li = cat.raw("lineitem")
    d = F.col("l_shipdate").cast("date")
    monthly = (li.groupBy(F.col("l_partkey").alias("product_id"),
                          F.last_day(d).alias("snapshot_date"))
               .agg(F.sum("l_quantity").cast("bigint").alias("units_sold")))
    # the join and the dealing move a product's sales and names alone; all else is derived from these
    p = cat.raw("part").select(F.col("p_partkey"), F.col("p_name").alias("product_name"),
                               F.col("p_type").alias("category"), F.col("p_brand").alias("segment"))
    rows = monthly.join(p, monthly.product_id == p.p_partkey, "left").drop("p_partkey")
    if by_month:
        rows = rows.hint("rebalance", "snapshot_date")
    m = F.year("snapshot_date").cast("bigint") * 12 + F.month("snapshot_date").cast("bigint")
    pid = F.col("product_id")
    soh = (pid * 11 + m * 3) % 120
    stockout = F.when((pid + m) % 4 == 0, (pid * 5 + m) % 15 + 1).otherwise(F.lit(0).cast("bigint"))
    inv = rows.select(
        "product_id", "snapshot_date", "units_sold", "product_name", "category", "segment",
        soh.alias("stock_on_hand"),
        (F.col("units_sold") + (pid * 7 + m * 13) % 40).alias("units_received"),
        stockout.alias("stockout_days"),
    )
    dos = inv.stock_on_hand.cast("double") * F.lit(30.0) / (inv.units_sold + 1).cast("double")
    inv = inv.select(
        "*",
        dos.alias("days_of_supply"),
        (F.lit(1.0) - inv.stockout_days.cast("double") / F.lit(30.0)).alias("fill_rate"),
        (inv.units_sold.cast("double") / (inv.units_sold + inv.stock_on_hand).cast("double")).alias("sell_through_rate"),
        F.when(inv.stockout_days > 0, 1).otherwise(0).alias("stockout_flag"),
        F.when(dos > 60.0, 1).otherwise(0).alias("overstock_flag"),
        F.when(inv.stock_on_hand < 20, 1).otherwise(0).alias("reorder_flag"),
        F.year("snapshot_date").alias("year"),
        F.month("snapshot_date").alias("month"),
    )
    return inv.select("snapshot_date", "product_id", "stock_on_hand", "units_received", "units_sold",
                      "stockout_days", "days_of_supply", "fill_rate", "stockout_flag", "overstock_flag",
                      "reorder_flag", "sell_through_rate", "product_name", "category", "segment",
                      "year", "month")


def item_values(cat) -> DataFrame:
    """order_items + product cogs with gross / net / cogs per line (expr_item_values)."""
    from kartlane.functions.exprs import item_value_columns
    items = cat.table("order_items")
    prod = cat.table("products").select("product_id", "category", "segment", "cogs")
    return item_value_columns(items.join(prod, "product_id", "left"))


def sales(cat) -> DataFrame:
    """Daily Revenue / COGS on a gap-free spine (missing day -> 0)."""
    from kartlane.operators.joins import date_spine
    o = orders_slim(cat).select("order_id", "order_date")
    iv = item_values(cat).select("order_id", "net_item_value", "item_cogs")
    daily = (iv.join(o, "order_id", "inner")
             .groupBy(F.col("order_date").alias("Date"))
             .agg(F.sum("net_item_value").alias("Revenue"), F.sum("item_cogs").alias("COGS")))
    spine = date_spine(o, "order_date", "Date")
    # stored like the source CSV: money at fixed decimals, so equal days compare equal
    return (spine.join(daily, "Date", "left")
            .select("Date", r4(F.coalesce("Revenue", F.lit(0.0))).alias("Revenue"),
                    r4(F.coalesce("COGS", F.lit(0.0))).alias("COGS")))


def sales_panel(cat, by: str = "segment") -> DataFrame:
    """Long panel (series_id, Date, Revenue, COGS); series = market segment or region.

    Each series gets its own gap-free spine between the global first and
    last order day, so row-based windows (lags, rolling) are valid.
    """
    from kartlane.operators.joins import date_spine
    o = orders_slim(cat).select("order_id", "order_date", "customer_id")
    cust = cat.raw("customer")
    if by == "segment":
        key = cust.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("series_id"))
    else:
        nat = cat.raw("nation").select("n_nationkey", "n_regionkey")
        key = (cust.join(nat, cust.c_nationkey == nat.n_nationkey, "inner")
               .select(F.col("c_custkey").alias("customer_id"),
                       F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("series_id")))
    iv = item_values(cat).select("order_id", "net_item_value", "item_cogs")
    daily = (iv.join(o, "order_id", "inner").join(key, "customer_id", "inner")
             .groupBy("series_id", F.col("order_date").alias("Date"))
             .agg(F.sum("net_item_value").alias("Revenue"), F.sum("item_cogs").alias("COGS")))
    # series keys come from the data: no broadcast hint, AQE sizes the cross join at run time
    spine = date_spine(o, "order_date", "Date").crossJoin(key.select("series_id").distinct())
    return (spine.join(daily, ["series_id", "Date"], "left")
            .select("series_id", "Date", r4(F.coalesce("Revenue", F.lit(0.0))).alias("Revenue"),
                    r4(F.coalesce("COGS", F.lit(0.0))).alias("COGS")))


def sample_submission(cat) -> DataFrame:
    """Forecast template: the horizon days after the last sales day, zero-filled."""
    o = orders_slim(cat).select("order_date")
    bounds = o.agg(F.max("order_date").alias("last"))
    return (bounds.select(F.explode(F.sequence(F.date_add("last", 1),
                                               F.date_add("last", FORECAST_HORIZON_DAYS),
                                               F.expr("interval 1 day"))).alias("Date"))
            .select("Date", F.lit(0.0).alias("Revenue"), F.lit(0.0).alias("COGS")))


def web_traffic(cat) -> DataFrame:
    ev = cat.raw("events").select(F.col("ts").cast("date").alias("date"), "user_id", "event_type",
                                  "event_id", "value")
    per_user = (ev.groupBy("date", "event_type", "user_id").agg(F.count(F.lit(1)).alias("n")))
    bounce = (per_user.groupBy("date", "event_type")
              .agg((F.count_if(F.col("n") == 1).cast("double") / F.count(F.lit(1)).cast("double")).alias("bounce_rate")))
    agg = (ev.groupBy("date", "event_type")
           .agg(F.count(F.lit(1)).alias("sessions"),
                F.count_distinct("user_id").alias("unique_visitors"),
                F.sum(F.col("event_id") % 5 + 1).alias("page_views"),
                F.avg("value").alias("avg_session_duration_sec")))
    return (agg.join(bounce, ["date", "event_type"], "inner")
            .select("date", "sessions", "unique_visitors", "page_views", "bounce_rate",
                    "avg_session_duration_sec", F.col("event_type").alias("traffic_source")))


def promotions(cat) -> DataFrame:
    o = orders_slim(cat).select("order_date")
    return promotions_schedule(cat.spark, o, "order_date")


BUILDERS = {
    "customers": customers,
    "products": products,
    "geography": geography,
    "orders": orders,
    "orders_slim": orders_slim,
    "order_items": order_items,
    "payments": payments,
    "shipments": shipments,
    "returns": returns,
    "reviews": reviews,
    "inventory": inventory,
    "sales": sales,
    "sample_submission": sample_submission,
    "web_traffic": web_traffic,
    "promotions": promotions,
    "item_values": item_values,
    "sales_panel": sales_panel,
}
