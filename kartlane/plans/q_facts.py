"""Fact-table queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kartlane.operators import facts as FX
from kartlane.plans.oracle import select_final as S, with_views as W
from kartlane.plans.registry import register


@register("fact_order_revenue", W(S("v_orev", ["order_id", "order_date", "customer_id", "order_status",
                                               "items", "gross_revenue", "discount", "net_revenue", "item_cogs"]).replace(
    "FROM v_orev", """FROM (SELECT o.*, a.* EXCLUDE (order_id) FROM v_orders_slim o LEFT JOIN (
        SELECT order_id, sum(quantity) AS items, sum(gross_item_value) AS gross_revenue,
               coalesce(sum(discount_amount), 0.0) AS discount, sum(net_item_value) AS net_revenue,
               sum(item_cogs) AS item_cogs FROM v_item_values GROUP BY order_id) a USING (order_id))"""),
    "v_orders_slim", "v_item_values"))
def fact_order_revenue(cat):
    """build_order_revenue: per-order items, gross, discount, net, cogs left onto orders."""
    return FX.order_revenue(cat).select("order_id", "order_date", "customer_id", "order_status", "items",
                                        "gross_revenue", "discount", "net_revenue", "item_cogs")


@register("fact_order_item", W(S("v_order_item_fact", ["order_id", "distinct_products", "total_quantity",
                                                       "gross_revenue", "total_discount_amount", "net_revenue",
                                                       "total_cogs", "gross_margin"]), "v_order_item_fact"))
def fact_order_item(cat):
    """Per-order distinct products, quantity, gross, discount, net, cogs, margin."""
    return FX.order_item_fact(cat)


@register("fact_order_level", W(S("v_order_level", ["order_id", "customer_id", "payment_method_recorded",
                                                    "net_revenue", "payment_value", "installments", "ship_date",
                                                    "delivery_date", "shipping_fee"]), "v_order_level"))
def fact_order_level(cat):
    """orders LEFT items LEFT payments LEFT shipments with recorded payment method."""
    return FX.order_level(cat).select("order_id", "customer_id", "payment_method_recorded", "net_revenue",
                                      "payment_value", "installments", "ship_date", "delivery_date",
                                      "shipping_fee")


@register("fact_order_returns", W(S("v_order_returns", ["order_id", "return_records_count",
                                                       "returned_products_count", "returned_units_count",
                                                       "total_refund_amount", "first_return_date",
                                                       "last_return_date"]), "v_order_returns"))
def fact_order_returns(cat):
    """Return records, products, units, refund, first/last date per order."""
    return FX.order_returns(cat)


@register("fact_order_reviews", W(S("v_order_reviews", ["order_id", "reviews_count", "reviewed_products_count",
                                                       "avg_review_rating", "first_review_date",
                                                       "latest_review_date"]), "v_order_reviews"))
def fact_order_reviews(cat):
    """Reviews, reviewed products, average rating, first/last review per order."""
    return FX.order_reviews(cat)


@register("fact_order", W(S("v_order_fact", FX.ORDER_FACT_COLUMNS), "v_order_fact"))
def fact_order(cat):
    """41-column order fact table."""
    return FX.order_fact(cat)


@register("fact_customer_order_dates", W(S("v_customer_order_dates", ["customer_id", "first_order_date",
                                                                     "second_order_date"]),
                                         "v_customer_order_dates"))
def fact_customer_order_dates(cat):
    """First and second order date per customer in (date, order_id) order."""
    return FX.customer_order_dates(cat)


@register("fact_customer_items", W(S("v_customer_items", ["customer_id", "distinct_products_count",
                                                         "total_quantity"]), "v_customer_items"))
def fact_customer_items(cat):
    """Distinct products and quantity per customer."""
    return FX.customer_items(cat)


_CO = ["customer_id", "last_order_date", "orders_count", "delivered_orders_count", "returned_orders_count",
       "cancelled_orders_count", "shipped_orders_count", "gross_revenue", "total_discount_amount",
       "net_revenue", "total_cogs", "gross_margin", "total_payment_value", "avg_payment_installments",
       "total_shipping_fee", "avg_order_value", "avg_items_per_order", "preferred_payment_method",
       "preferred_device_type", "preferred_order_source"]


@register("fact_customer_orders", W(S("v_customer_orders", _CO), "v_customer_orders"))
def fact_customer_orders(cat):
    """19 lifetime order metrics per customer incl. three tie-aware modes."""
    return FX.customer_orders(cat).select(*_CO)


@register("agg_mode_tiebreak", W(S("v_mode_pay", ["customer_id", "preferred_payment_method"]), "v_mode_pay"))
def agg_mode_tiebreak(cat):
    """Most frequent payment method per customer; ties -> smallest of all values."""
    from kartlane.operators.aggregates import mode_ref
    return mode_ref(FX.order_level(cat), ["customer_id"], "payment_method_recorded", "preferred_payment_method")


@register("fact_customer_returns", W(S("v_customer_returns", ["customer_id", "return_records_count",
                                                             "returned_units_count", "total_refund_amount",
                                                             "last_return_date"]), "v_customer_returns"))
def fact_customer_returns(cat):
    """Two-level return aggregation: per order, then per customer (agg_two_level)."""
    return FX.customer_returns(cat)


@register("fact_customer_reviews", W(S("v_customer_reviews", ["customer_id", "reviews_count",
                                                             "avg_review_rating", "latest_review_date"]),
                                     "v_customer_reviews"))
def fact_customer_reviews(cat):
    """Reviews, average rating, latest review per customer."""
    return FX.customer_reviews(cat)


@register("fact_customer", W(S("v_customer_fact", FX.CUSTOMER_FACT_COLUMNS), "v_customer_fact"))
def fact_customer(cat):
    """46-column customer fact table."""
    return FX.customer_fact(cat)


@register("fact_cohort_activity", W(S("v_cohort_activity", FX.COHORT_ACTIVITY_COLUMNS), "v_cohort_activity"))
def fact_cohort_activity(cat):
    """Customer x month activity with cohort index (NULL keys kept)."""
    return FX.cohort_activity(cat)


@register("fact_activation", W(S("v_activation", FX.ACTIVATION_COLUMNS), "v_activation"))
def fact_activation(cat):
    """Signup -> activation fact: months/days to first order, flags, orders."""
    return FX.activation(cat)


@register("fact_product_month_inventory", W(S("v_inventory_fact", FX.INVENTORY_FACT_COLUMNS),
                                            "v_inventory_fact"))
def fact_product_month_inventory(cat):
    """Product-month inventory fact: stockout rate per day, available units, net change."""
    return FX.inventory_fact(cat)


@register("dq_fact_quality", W("""
    SELECT 'order_fact_table' AS "table", count(*) AS rows, count(DISTINCT order_id) AS unique_key,
           count(*) - count(DISTINCT order_id) AS duplicate_key_rows,
           count(*) FILTER (WHERE order_id IS NOT NULL) AS records_with_activity,
           count(*) FILTER (WHERE order_id IS NULL) AS records_without_activity FROM v_order_fact
    UNION ALL
    SELECT 'customer_fact_table', count(*), count(DISTINCT customer_id), count(*) - count(DISTINCT customer_id),
           count(*) FILTER (WHERE coalesce(orders_count, 0) > 0),
           count(*) FILTER (WHERE coalesce(orders_count, 0) <= 0) FROM v_customer_fact
    UNION ALL
    SELECT 'customer_cohort_activity_fact', count(*), count(DISTINCT (customer_id, order_month)),
           count(*) - count(DISTINCT (customer_id, order_month)),
           count(*) FILTER (WHERE active_month_flag = 1), count(*) FILTER (WHERE active_month_flag <> 1)
    FROM v_cohort_activity
    UNION ALL
    SELECT 'signup_activation_fact', count(*), count(DISTINCT customer_id), count(*) - count(DISTINCT customer_id),
           count(*) FILTER (WHERE activated_flag = 1), count(*) FILTER (WHERE activated_flag <> 1)
    FROM v_activation
    UNION ALL
    SELECT 'product_month_inventory_fact', count(*), count(DISTINCT (product_id, snapshot_month)),
           count(*) - count(DISTINCT (product_id, snapshot_month)),
           count(*) FILTER (WHERE product_id IS NOT NULL), count(*) FILTER (WHERE product_id IS NULL)
    FROM v_inventory_fact""", "v_order_fact", "v_customer_fact", "v_cohort_activity", "v_activation",
    "v_inventory_fact"))
def dq_fact_quality(cat):
    """rows, unique keys, duplicates, active / inactive for the five facts."""
    return FX.fact_quality(cat)


_FACT_VIEWS = {"order_fact_table": "v_order_fact", "customer_fact_table": "v_customer_fact",
               "customer_cohort_activity_fact": "v_cohort_activity", "signup_activation_fact": "v_activation",
               "product_month_inventory_fact": "v_inventory_fact"}


@register("snk_facts", W(" UNION ALL ".join(f"SELECT '{n}' AS fact, count(*) AS rows FROM {v}" for n, v in _FACT_VIEWS.items()),
                         *_FACT_VIEWS.values()))
def snk_facts(cat):
    """Write the five facts as Parquet (month-partitioned where useful), read back; rows of each."""
    from kartlane.plans.reports import output_root, read_version, write_facts
    import uuid
    # each fact is written once, in its place, and the facts built on it read it there
    order, customer = "order_fact_table", "customer_fact_table"
    facts = {order: lambda write, done: FX.order_fact_in_steps(cat, write),
             customer: lambda write, done: FX.customer_fact_in_steps(cat, done[order], write),
             "customer_cohort_activity_fact": lambda write, done: write(FX.cohort_activity(cat, done[order], done[customer])),
             "signup_activation_fact": lambda write, done: write(FX.activation(cat, done[customer])),
             "product_month_inventory_fact": lambda write, done: write(FX.inventory_fact(cat, by_month=True), dealt=True)}
    root = f"{output_root(cat.spark)}/facts_{uuid.uuid4().hex[:8]}"
    write_facts(facts, root)
    parts = [df.agg(F.lit(n).alias("fact"), F.count(F.lit(1)).alias("rows")) for n, df in read_version(cat.spark, root).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
