"""Fact-table builders: order, customer, cohort activity, activation, inventory.

Shape of every builder: pre-aggregate each child table to one row per key
(map-side partial aggregation absorbs hot keys), then chain left joins onto
the spine so the grain stays 1:1.  No per-customer windows: first / second
order dates come from counts by customer and day, so a customer holding a third
of all orders is combined in the map tasks and never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartlane.functions.exprs import day_diff, month_diff, month_trunc, safe_divide, fdiv, days_in_month
from kartlane.operators.aggregates import mode_ref
from kartlane.session import discard, scratch, written

# ---------------------------------------------------------------------------
# FIXED VALUES - output schemas of the five fact tables (names and order).
# ---------------------------------------------------------------------------
ORDER_FACT_COLUMNS = [
    "order_id", "order_date", "order_month", "customer_id", "zip", "order_status",
    "payment_method_recorded", "device_type", "order_source", "distinct_products",
    "total_quantity", "total_order_value", "total_discount_amount", "net_revenue",
    "net_revenue_proxy", "payment_gap_vs_net_revenue", "total_cogs", "gross_margin",
    "discount_rate", "gross_margin_rate", "payment_value", "installments", "ship_date",
    "delivery_date", "shipping_fee", "ship_lead_time_days", "delivery_lead_time_days",
    "return_records_count", "returned_products_count", "returned_units_count",
    "total_refund_amount", "first_return_date", "last_return_date", "days_to_first_return",
    "refund_to_revenue_ratio", "reviews_count", "reviewed_products_count", "avg_review_rating",
    "first_review_date", "latest_review_date", "days_to_first_review",
]

CUSTOMER_FACT_COLUMNS = [
    "customer_id", "zip", "city", "signup_date", "gender", "age_group", "acquisition_channel",
    "first_order_date", "second_order_date", "last_order_date", "customer_tenure_days",
    "days_since_last_order", "days_from_signup_to_first_order", "days_to_second_order",
    "orders_count", "delivered_orders_count", "returned_orders_count", "cancelled_orders_count",
    "shipped_orders_count", "distinct_products_count", "total_quantity", "total_order_value",
    "total_discount_amount", "net_revenue", "net_revenue_proxy", "payment_gap_vs_net_revenue",
    "total_cogs", "gross_margin", "total_payment_value", "avg_payment_installments",
    "total_shipping_fee", "avg_order_value", "avg_items_per_order", "preferred_payment_method",
    "preferred_device_type", "preferred_order_source", "return_records_count",
    "returned_units_count", "total_refund_amount", "last_return_date", "return_rate_orders",
    "refund_to_revenue_ratio", "reviews_count", "avg_review_rating", "latest_review_date",
    "review_rate_orders",
]

COHORT_ACTIVITY_COLUMNS = [
    "customer_id", "first_order_cohort_month", "signup_cohort_month", "order_month",
    "cohort_index", "acquisition_channel", "orders_count", "total_order_value", "net_revenue",
    "net_revenue_proxy", "gross_margin", "active_month_flag", "payment_gap_vs_net_revenue",
]

ACTIVATION_COLUMNS = [
    "customer_id", "signup_date", "signup_cohort_month", "first_order_date", "second_order_date",
    "activation_month", "months_to_activation", "days_signup_to_first_order",
    "signup_before_first_order_flag", "activated_flag", "repeat_order_flag", "num_orders",
    "acquisition_channel", "net_revenue",
]

INVENTORY_FACT_COLUMNS = [
    "product_id", "snapshot_date", "snapshot_month", "year", "month", "product_name", "category",
    "segment", "stock_on_hand", "units_received", "units_sold", "net_units_change",
    "available_units", "stockout_days", "stockout_rate_days", "days_of_supply", "fill_rate",
    "sell_through_rate", "stockout_flag", "overstock_flag", "reorder_flag",
]


def sum0(c: str) -> F.Column:
    """pandas ``sum``: an all-NULL group sums to 0, not NULL."""
    return F.coalesce(F.sum(c), F.lit(0))


# -- order level ----------------------------------------------------------------
def order_revenue(cat) -> DataFrame:
    """build_order_revenue: per-order items/gross/discount/net/cogs, left onto orders."""
    iv = cat.table("item_values")
    per_order = (iv.groupBy("order_id")
                 .agg(F.sum("quantity").alias("items"),
                      F.sum("gross_item_value").alias("gross_revenue"),
                      F.coalesce(F.sum("discount_amount"), F.lit(0.0)).alias("discount"),
                      F.sum("net_item_value").alias("net_revenue"),
                      F.sum("item_cogs").alias("item_cogs")))
    # orders without the zip lookup: no revenue consumer reads zip, and Catalyst
    # cannot drop a left join it does not know to be key-unique
    return cat.table("orders_slim").join(per_order, "order_id", "left")


def order_item_fact(cat) -> DataFrame:
    iv = cat.table("item_values").withColumn(
        "discount_amount", F.coalesce(F.col("discount_amount"), F.lit(0.0)))
    # an order's few lines meet once, for the products and for the sums
    f = (iv.select("order_id", "product_id", "quantity", "gross_item_value", "discount_amount", "item_cogs")
         .repartition("order_id").withColumn("net_item_value", F.col("gross_item_value") - F.col("discount_amount"))
         .groupBy("order_id")
         .agg(F.count_distinct("product_id").alias("distinct_products"),
              F.sum("quantity").alias("total_quantity"),
              F.sum("gross_item_value").alias("gross_revenue"),
              F.sum("discount_amount").alias("total_discount_amount"),
              F.sum("net_item_value").alias("net_revenue"),
              F.sum("item_cogs").alias("total_cogs")))
    return f.withColumn("gross_margin", F.col("net_revenue") - F.col("total_cogs"))


def order_level(cat, items: DataFrame | None = None, shipments: DataFrame | None = None) -> DataFrame:
    """orders LEFT items-agg LEFT payments LEFT shipments; recorded payment method."""
    pay = cat.table("payments").withColumnRenamed("payment_method", "payment_method_payment")
    out = (cat.table("orders")
           .join(items if items is not None else order_item_fact(cat), "order_id", "left")
           .join(pay, "order_id", "left")
           .join(shipments if shipments is not None else cat.table("shipments"), "order_id", "left"))
    return out.withColumn("payment_method_recorded",
                          F.coalesce("payment_method_payment", "payment_method"))


def order_returns(cat) -> DataFrame:
    return (cat.table("returns").groupBy("order_id")
            .agg(F.count_distinct("return_id").alias("return_records_count"),
                 F.count_distinct("product_id").alias("returned_products_count"),
                 F.sum("return_quantity").alias("returned_units_count"),
                 F.sum("refund_amount").alias("total_refund_amount"),
                 F.min("return_date").alias("first_return_date"),
                 F.max("return_date").alias("last_return_date")))


def order_reviews(cat) -> DataFrame:
    return (cat.table("reviews").groupBy("order_id")
            .agg(F.count_distinct("review_id").alias("reviews_count"),
                 F.count_distinct("product_id").alias("reviewed_products_count"),
                 F.avg("rating").alias("avg_review_rating"),
                 F.min("review_date").alias("first_review_date"),
                 F.max("review_date").alias("latest_review_date")))


def order_fact(cat, items: DataFrame | None = None, shipments: DataFrame | None = None,
               returned: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """All measures of an order; aggregates of its lines that are already written stand for themselves."""
    f = (order_level(cat, items, shipments)
         .join(returned if returned is not None else order_returns(cat), "order_id", "left")
         .join(reviewed if reviewed is not None else order_reviews(cat), "order_id", "left"))
    counts = ["return_records_count", "returned_products_count", "returned_units_count",
              "reviews_count", "reviewed_products_count"]
    f = f.withColumns({
        "order_month": month_trunc("order_date"),
        "ship_lead_time_days": day_diff("ship_date", "order_date"),
        "delivery_lead_time_days": day_diff("delivery_date", "order_date"),
        "days_to_first_return": day_diff("first_return_date", "order_date"),
        "days_to_first_review": day_diff("first_review_date", "order_date"),
        "total_order_value": F.col("gross_revenue"),
        "net_revenue_proxy": F.col("payment_value"),
        "payment_gap_vs_net_revenue": F.col("payment_value") - F.col("net_revenue"),
        "discount_rate": safe_divide("total_discount_amount", "gross_revenue"),
        "gross_margin_rate": safe_divide("gross_margin", "net_revenue"),
        "refund_to_revenue_ratio": safe_divide("total_refund_amount", "net_revenue"),
        **{c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts},
    })
    return f.select(*ORDER_FACT_COLUMNS)


def order_fact_in_steps(cat, write=written) -> DataFrame:
    """``write(order_fact)``, every aggregate of lines being written before: each takes its shuffles with it when it is done."""
    with scratch() as put:
        return write(order_fact(cat, *[put(f) for f in (order_item_fact(cat), cat.table("shipments"), order_returns(cat), order_reviews(cat))]))


# -- customer level -------------------------------------------------------------
def customer_order_dates(cat) -> DataFrame:
    """Dates of a customer's first and second order, in (date, order id) order.

    Orders are counted by customer and day first, so a customer with a third of
    all orders is spread over days and collapses in the map-side combine; the
    per-customer step sees at most one row a calendar day. A day with two orders
    holds both the first and the second.
    """
    days = (cat.table("orders_slim").filter(F.col("order_date").isNotNull()).groupBy("customer_id", "order_date")
            .agg(F.count(F.lit(1)).alias("_n")))
    two = F.slice(F.sort_array(F.collect_list(F.struct("order_date", "_n"))), 1, 2)
    return (days.groupBy("customer_id").agg(two.alias("_d"))
            .select("customer_id", F.col("_d")[0]["order_date"].alias("first_order_date"),
                    F.when(F.col("_d")[0]["_n"] > 1, F.col("_d")[0]["order_date"])
                    .otherwise(F.get("_d", F.lit(1))["order_date"]).alias("second_order_date")))


def customer_items(cat) -> DataFrame:
    items = cat.table("order_items").select("order_id", "product_id", "quantity")
    o = cat.table("orders_slim").select("order_id", "customer_id")
    return (items.join(o, "order_id", "left").groupBy("customer_id")
            .agg(F.count_distinct("product_id").alias("distinct_products_count"),
                 F.sum("quantity").alias("total_quantity")))


def customer_orders(cat, level: DataFrame | None = None) -> DataFrame:
    ol = level if level is not None else order_level(cat)
    st = F.col("order_status")
    agg = (ol.groupBy("customer_id")
           .agg(F.max("order_date").alias("last_order_date"),
                F.count_if(st == "delivered").alias("delivered_orders_count"),
                F.count_if(st == "returned").alias("returned_orders_count"),
                F.count_if(st == "cancelled").alias("cancelled_orders_count"),
                F.count("ship_date").alias("shipped_orders_count"),
                sum0("gross_revenue").alias("gross_revenue"),
                sum0("total_discount_amount").alias("total_discount_amount"),
                sum0("net_revenue").alias("net_revenue"),
                sum0("total_cogs").alias("total_cogs"),
                sum0("gross_margin").alias("gross_margin"),
                sum0("payment_value").alias("total_payment_value"),
                F.avg("installments").alias("avg_payment_installments"),
                sum0("shipping_fee").alias("total_shipping_fee"),
                F.avg("net_revenue").alias("avg_order_value"),
                F.avg("total_quantity").alias("avg_items_per_order")))
    # the orders are counted apart, so that the sums are combined before their shuffle
    orders = (ol.groupBy("customer_id", "order_id").agg(F.count(F.lit(1)).alias("_n"))
              .groupBy("customer_id").agg(F.count("order_id").alias("orders_count")))
    agg = agg.join(orders, "customer_id", "left")
    for src, dst in [("payment_method_recorded", "preferred_payment_method"),
                     ("device_type", "preferred_device_type"),
                     ("order_source", "preferred_order_source")]:
        agg = agg.join(mode_ref(ol, ["customer_id"], src, dst), "customer_id", "left")
    return agg


def customer_returns(cat, ofact: DataFrame | None = None) -> DataFrame:
    """Returns of a customer's orders, from the order fact where it is given."""
    if ofact is not None:
        back = ofact.filter("return_records_count > 0")
        return (back.groupBy("customer_id")
                .agg(F.sum("return_records_count").alias("return_records_count"),
                     F.sum("returned_units_count").alias("returned_units_count"),
                     F.sum("total_refund_amount").alias("total_refund_amount"),
                     F.max("last_return_date").alias("last_return_date")))
    per_order = (cat.table("returns").groupBy("order_id")
                 .agg(F.count_distinct("return_id").alias("_recs"),
                      F.sum("return_quantity").alias("_units"),
                      F.sum("refund_amount").alias("_refund"),
                      F.max("return_date").alias("_latest")))
    o = cat.table("orders_slim").select("order_id", "customer_id")
    return (per_order.join(o, "order_id", "left").groupBy("customer_id")
            .agg(F.sum("_recs").alias("return_records_count"),
                 F.sum("_units").alias("returned_units_count"),
                 F.sum("_refund").alias("total_refund_amount"),
                 F.max("_latest").alias("last_return_date")))


def customer_reviews(cat) -> DataFrame:
    return (cat.table("reviews").groupBy("customer_id")
            .agg(F.count_distinct("review_id").alias("reviews_count"),
                 F.avg("rating").alias("avg_review_rating"),
                 F.max("review_date").alias("latest_review_date")))


def customer_fact(cat, ofact: DataFrame | None = None, put=lambda part: part) -> DataFrame:
    """All measures of a customer; an order fact that is already written stands for its order and return level.

    ``put`` may write the aggregates of a customer before they are joined.
    """
    level = ofact.withColumn("gross_revenue", F.col("total_order_value")) if ofact is not None else None
    end = cat.table("orders_slim").agg(F.max("order_date").alias("_analysis_end"))
    f = (cat.table("customers")
         .join(put(customer_order_dates(cat)), "customer_id", "left")
         .join(put(customer_orders(cat, level)), "customer_id", "left")
         .join(put(customer_items(cat)), "customer_id", "left")
         .join(put(customer_returns(cat, ofact)), "customer_id", "left")
         .join(put(customer_reviews(cat)), "customer_id", "left")
         .crossJoin(F.broadcast(end)))
    f = f.withColumns({
        "customer_tenure_days": day_diff("last_order_date", "first_order_date"),
        "days_since_last_order": day_diff("_analysis_end", "last_order_date"),
        "days_from_signup_to_first_order": day_diff("first_order_date", "signup_date"),
        "days_to_second_order": day_diff("second_order_date", "first_order_date"),
        "total_order_value": F.col("gross_revenue"),
        "net_revenue_proxy": F.col("total_payment_value"),
        "payment_gap_vs_net_revenue": F.col("total_payment_value") - F.col("net_revenue"),
        "reviews_count": F.coalesce("reviews_count", F.lit(0)).cast("bigint"),
    })
    f = f.withColumns({
        "return_rate_orders": fdiv("returned_orders_count", "orders_count"),
        "review_rate_orders": fdiv("reviews_count", "orders_count"),
        "refund_to_revenue_ratio": safe_divide("total_refund_amount", "net_revenue"),
    })
    return f.select(*CUSTOMER_FACT_COLUMNS)


def customer_fact_in_steps(cat, ofact: DataFrame, write=written) -> DataFrame:
    """``write(customer_fact)`` on a written order fact, each aggregate of a customer being written before."""
    with scratch() as put:
        return write(customer_fact(cat, ofact, put))


# -- cohort / activation / inventory ---------------------------------------------
def cohort_activity(cat, ofact: DataFrame | None = None, cfact: DataFrame | None = None) -> DataFrame:
    of = (ofact if ofact is not None else order_fact(cat)).select(
        "customer_id", "order_id", "order_month", "total_order_value", "net_revenue",
        "net_revenue_proxy", "gross_margin")
    cf = (cfact if cfact is not None else customer_fact(cat)).select(
        "customer_id", "signup_date", "first_order_date", "acquisition_channel")
    # orders are summed by customer and month before the customers are joined; a month of a customer meets in one task
    sums = ["total_order_value", "net_revenue", "net_revenue_proxy", "gross_margin"]
    months = (of.repartition("customer_id", "order_month").groupBy("customer_id", "order_month", "order_id")
              .agg(*[sum0(c).alias(c) for c in sums])
              .groupBy("customer_id", "order_month")
              .agg(F.count("order_id").alias("orders_count"), *[sum0(c).alias(c) for c in sums]))
    b = months.join(cf, "customer_id", "left").withColumns({
        "first_order_cohort_month": month_trunc("first_order_date"),
        "signup_cohort_month": month_trunc("signup_date"),
    }).withColumn("cohort_index", month_diff("order_month", "first_order_cohort_month"))
    g = (b.groupBy("customer_id", "first_order_cohort_month", "signup_cohort_month", "order_month",
                   "cohort_index", "acquisition_channel")     # NULL keys kept (dropna=False)
         .agg(F.max("orders_count").alias("orders_count"),     # a repeated customer repeats the same orders
              *[F.sum(c).alias(c) for c in sums]))
    g = g.withColumns({"active_month_flag": F.lit(1),
                       "payment_gap_vs_net_revenue": F.col("net_revenue_proxy") - F.col("net_revenue")})
    return g.select(*COHORT_ACTIVITY_COLUMNS)


def activation(cat, cfact: DataFrame | None = None) -> DataFrame:
    cf = cfact if cfact is not None else customer_fact(cat)
    a = cf.select("customer_id", "signup_date", "first_order_date", "second_order_date",
                  "acquisition_channel", "orders_count", "days_from_signup_to_first_order", "net_revenue")
    a = a.withColumns({
        "signup_cohort_month": month_trunc("signup_date"),
        "activation_month": month_trunc("first_order_date"),
    })
    a = a.withColumns({
        "months_to_activation": month_diff("activation_month", "signup_cohort_month"),
        "activated_flag": F.col("first_order_date").isNotNull().cast("int"),
        "repeat_order_flag": F.col("second_order_date").isNotNull().cast("int"),
        "num_orders": F.coalesce("orders_count", F.lit(0)).cast("bigint"),
        "days_signup_to_first_order": F.col("days_from_signup_to_first_order"),
        "signup_before_first_order_flag": F.coalesce(F.col("days_from_signup_to_first_order") >= 0,
                                                     F.lit(False)).cast("int"),
    })
    return a.select(*ACTIVATION_COLUMNS)


def inventory_fact(cat, by_month: bool = False) -> DataFrame:
    """Product-month inventory; ``by_month``: a month's rows meet in tasks of bounded size, before any column is derived."""
    if by_month and cat.derived("inventory"):
        from kartlane.sources.standins import inventory
        inv = inventory(cat, by_month=True)
    else:
        inv = cat.table("inventory")
        inv = inv.hint("rebalance", "snapshot_date") if by_month else inv
    f = inv.withColumns({
        "snapshot_month": month_trunc("snapshot_date"),
        "stockout_rate_days": fdiv("stockout_days", days_in_month("snapshot_date")),
        "available_units": F.col("stock_on_hand") + F.col("units_sold"),
        "net_units_change": F.col("units_received") - F.col("units_sold"),
    })
    return f.select(*INVENTORY_FACT_COLUMNS)


def fact_quality(cat) -> DataFrame:
    """rows / unique keys / duplicate keys / with / without activity for five facts.

    The order and customer facts are written once for the others built on them, the customer fact being
    one of them. Keys are counted by one partial aggregate on the key, not by an expanded distinct, and
    each fact's row is written by itself: no two facts have their shuffles on disk together.
    """
    of = order_fact_in_steps(cat)
    cf = customer_fact_in_steps(cat, of)
    ca, ac, pi = cohort_activity(cat, of, cf), activation(cat, cf), inventory_fact(cat)

    def one(name, df, keys, active):
        by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(active).alias("yes"), F.count_if(~active).alias("no"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return by_key.agg(F.lit(name).alias("table"), total("n").alias("rows"), F.count(F.lit(1)).alias("unique_key"),
                          (total("n") - F.count(F.lit(1))).alias("duplicate_key_rows"),
                          total("yes").alias("records_with_activity"), total("no").alias("records_without_activity"))
    parts = [
        one("order_fact_table", of, ["order_id"], F.col("order_id").isNotNull()),
        one("customer_fact_table", cf, ["customer_id"], F.coalesce("orders_count", F.lit(0)) > 0),
        one("customer_cohort_activity_fact", ca, ["customer_id", "order_month"], F.col("active_month_flag") == 1),
        one("signup_activation_fact", ac, ["customer_id"], F.col("activated_flag") == 1),
        one("product_month_inventory_fact", pi, ["product_id", "snapshot_month"], F.col("product_id").isNotNull()),
    ]
    out = written(parts[0])
    for p in parts[1:]:
        out = out.unionByName(written(p))
    discard(of, cf)
    return out
