"""Business queries with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kartlane.functions.exprs import r4
from kartlane.operators import business as B
from kartlane.operators.facts import order_revenue
from kartlane.plans.oracle import D, R, select_final as S, with_views as W
from kartlane.plans.registry import register

RETURN_CATEGORY = "STANDARD"


@register("q_revenue_seasonality", W(S("v_rev_seasonality", ["year", "month", "month_name", "orders", "revenue",
                                                             "cogs", "gross_margin"]), "v_rev_seasonality"))
def q_revenue_seasonality(cat):
    """Year x month orders, revenue, COGS, gross margin (flagship: scan, join, agg, dates)."""
    return B.revenue_seasonality(order_revenue(cat))


@register("q_inter_order_gap", W(f"""
    SELECT {R('median(gap)')} AS median_inter_order_gap_days, count(*) AS gaps FROM (
      SELECT date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id),
                       order_date) AS gap FROM v_orders_slim) WHERE gap IS NOT NULL""", "v_orders_slim"))
def q_inter_order_gap(cat):
    """Median days between consecutive orders of a customer (skew-safe bucketed lag)."""
    return B.inter_order_gap(cat.table("orders_slim"))


@register("q_segment_margin", W(f"""
    SELECT segment, {R('avg((price - cogs) / nullif(price, 0))')} AS gross_margin_ratio
    FROM v_products GROUP BY segment""", "v_products"))
def q_segment_margin(cat):
    """Mean per-product margin ratio by segment."""
    return B.segment_margin(cat.table("products"))


@register("q_return_reasons", W(f"""
    SELECT return_reason, count(*) AS returns FROM v_returns r LEFT JOIN v_products p USING (product_id)
    WHERE p.category = '{RETURN_CATEGORY}' GROUP BY return_reason""", "v_returns", "v_products"))
def q_return_reasons(cat):
    """Return-reason counts within one category."""
    return B.return_reasons(cat.table("returns"), cat.table("products"), RETURN_CATEGORY)


@register("q_bounce_by_source", W(f"""
    SELECT traffic_source, {R('avg(bounce_rate)')} AS mean_bounce_rate FROM v_web_traffic GROUP BY 1""",
    "v_web_traffic"))
def q_bounce_by_source(cat):
    """Mean bounce rate by traffic source."""
    return B.bounce_by_source(cat.table("web_traffic"))


@register("q_promo_usage", W(f"""
    SELECT count(*) FILTER (WHERE promo_id IS NOT NULL OR promo_id_2 IS NOT NULL) AS promo_rows,
           count(*) AS total_rows,
           {R("CAST(count(*) FILTER (WHERE promo_id IS NOT NULL OR promo_id_2 IS NOT NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0")} AS promo_usage_percent
    FROM v_order_items""", "v_order_items"))
def q_promo_usage(cat):
    """Share of order lines carrying any promo (A + B - A and B)."""
    return B.promo_usage(cat.table("order_items"))


@register("q_orders_per_age_group", W(f"""
    SELECT age_group, count(order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
           {R("CAST(count(order_id) AS DOUBLE) / nullif(CAST(count(DISTINCT customer_id) AS DOUBLE), 0)")} AS avg_orders_per_customer
    FROM (SELECT DISTINCT customer_id, age_group FROM v_customers) c LEFT JOIN v_orders_slim o USING (customer_id)
    GROUP BY age_group""", "v_customers", "v_orders_slim"))
def q_orders_per_age_group(cat):
    """Orders per customer by age group, NULL group kept."""
    return B.orders_per_age_group(cat.table("customers"), cat.table("orders_slim"))


@register("q_region_revenue_alloc", W(f"""
    SELECT region, {R('sum(order_share * Revenue)')} AS estimated_region_revenue FROM (
      SELECT r.order_date, r.region, CAST(r.n AS DOUBLE) / nullif(CAST(t.n AS DOUBLE), 0) AS order_share
      FROM (SELECT order_date, region, count(*) AS n FROM v_orders LEFT JOIN v_geography USING (zip) GROUP BY 1, 2) r
      LEFT JOIN (SELECT order_date, count(*) AS n FROM v_orders GROUP BY 1) t USING (order_date)) s
    JOIN v_sales ON s.order_date = v_sales.Date GROUP BY region""", "v_orders", "v_geography", "v_sales"))
def q_region_revenue_alloc(cat):
    """Daily revenue allocated to region by order share, summed."""
    return B.region_revenue_alloc(cat.table("orders"), cat.table("geography"), cat.table("sales"))


@register("q_cancelled_methods", W("""
    SELECT payment_method, count(*) AS cancelled_orders FROM v_orders_slim WHERE order_status = 'cancelled'
    GROUP BY 1""", "v_orders_slim"))
def q_cancelled_methods(cat):
    """Payment-method counts of cancelled orders."""
    return B.cancelled_methods(cat.table("orders_slim"))


@register("q_return_rate_by_size", W(f"""
    SELECT k.size, coalesce(r.n, 0) AS return_rows, coalesce(i.n, 0) AS item_rows,
           {R("CAST(coalesce(r.n, 0) AS DOUBLE) / nullif(CAST(coalesce(i.n, 0) AS DOUBLE), 0)")} AS return_rate
    FROM (VALUES ('S'), ('M'), ('L'), ('XL')) k(size)
    LEFT JOIN (SELECT p.size, count(*) AS n FROM v_returns LEFT JOIN v_products p USING (product_id) GROUP BY 1) r USING (size)
    LEFT JOIN (SELECT p.size, count(*) AS n FROM v_order_items LEFT JOIN v_products p USING (product_id) GROUP BY 1) i USING (size)
    """, "v_returns", "v_order_items", "v_products"))
def q_return_rate_by_size(cat):
    """Return rows / item rows for S, M, L, XL (reindexed, missing -> 0)."""
    return B.return_rate_by_size(cat.table("returns"), cat.table("order_items"), cat.table("products"), cat.spark)


@register("q_value_by_installments", W(f"""
    SELECT installments, {R('avg(payment_value)')} AS mean_payment_value FROM v_payments GROUP BY 1""",
    "v_payments"))
def q_value_by_installments(cat):
    """Mean payment value by installments."""
    return B.value_by_installments(cat.table("payments"))


def _answer_sql(q, body, label, metric, how):
    order = "DESC" if how == "max" else "ASC"
    return (f"SELECT '{q}' AS question, (SELECT CAST({label} AS VARCHAR) FROM ({body}) "
            f"ORDER BY {metric} {order} NULLS LAST, CAST({label} AS VARCHAR) {order} LIMIT 1) AS answer")


_ANS = [
    ("Q1_median_inter_order_gap_days", f"""SELECT {R('median(gap)')} AS gap, 1 AS m FROM (
      SELECT date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id),
                       order_date) AS gap FROM v_orders_slim) WHERE gap IS NOT NULL""", "gap", "m", "max"),
    ("Q5_promo_usage_percent", f"""SELECT {R("CAST(count(*) FILTER (WHERE promo_id IS NOT NULL OR promo_id_2 IS NOT NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0")} AS p,
      1 AS m FROM v_order_items""", "p", "m", "max"),
    ("Q6_best_age_group", """SELECT age_group, CAST(count(order_id) AS DOUBLE) / nullif(CAST(count(DISTINCT customer_id) AS DOUBLE), 0) AS m
      FROM (SELECT DISTINCT customer_id, age_group FROM v_customers) c LEFT JOIN v_orders_slim o USING (customer_id)
      GROUP BY age_group""", "age_group", "m", "max"),
    ("Q7_top_region_estimated_revenue", """SELECT region, sum(order_share * Revenue) AS m FROM (
      SELECT r.order_date, r.region, CAST(r.n AS DOUBLE) / nullif(CAST(t.n AS DOUBLE), 0) AS order_share
      FROM (SELECT order_date, region, count(*) AS n FROM v_orders LEFT JOIN v_geography USING (zip) GROUP BY 1, 2) r
      LEFT JOIN (SELECT order_date, count(*) AS n FROM v_orders GROUP BY 1) t USING (order_date)) s
      JOIN v_sales ON s.order_date = v_sales.Date GROUP BY region""", "region", "m", "max"),
    ("Q9_highest_return_rate_size", """SELECT k.size, CAST(coalesce(r.n, 0) AS DOUBLE) / nullif(CAST(coalesce(i.n, 0) AS DOUBLE), 0) AS m
      FROM (VALUES ('S'), ('M'), ('L'), ('XL')) k(size)
      LEFT JOIN (SELECT p.size, count(*) AS n FROM v_returns LEFT JOIN v_products p USING (product_id) GROUP BY 1) r USING (size)
      LEFT JOIN (SELECT p.size, count(*) AS n FROM v_order_items LEFT JOIN v_products p USING (product_id) GROUP BY 1) i USING (size)""",
     "size", "m", "max"),
    ("Q2_best_segment", "SELECT segment, avg((price - cogs) / nullif(price, 0)) AS m FROM v_products GROUP BY 1",
     "segment", "m", "max"),
    ("Q3_top_return_reason", f"SELECT return_reason, count(*) AS m FROM v_returns LEFT JOIN v_products USING (product_id) "
     f"WHERE category = '{RETURN_CATEGORY}' GROUP BY 1", "return_reason", "m", "max"),
    ("Q4_lowest_bounce_source", "SELECT traffic_source, avg(bounce_rate) AS m FROM v_web_traffic GROUP BY 1",
     "traffic_source", "m", "min"),
    ("Q8_top_cancelled_payment_method", "SELECT payment_method, count(*) AS m FROM v_orders_slim "
     "WHERE order_status = 'cancelled' GROUP BY 1", "payment_method", "m", "max"),
    ("Q10_best_installments", "SELECT installments, avg(payment_value) AS m FROM v_payments GROUP BY 1",
     "installments", "m", "max"),
]


@register("q_answer_sheet", W(" UNION ALL ".join(_answer_sql(*a) for a in _ANS),
                              "v_products", "v_returns", "v_web_traffic", "v_orders_slim", "v_payments", "v_order_items",
                              "v_customers", "v_orders", "v_geography", "v_sales"))
def q_answer_sheet(cat):
    """Best label per question via max_by / min_by (argmax / argmin)."""
    gap = B.inter_order_gap(cat.table("orders_slim"))
    promo = B.promo_usage(cat.table("order_items"))
    parts = {
        "Q1_median_inter_order_gap_days": (gap.select(r4("median_inter_order_gap_days").alias("gap"), F.lit(1).alias("m")),
                                           "gap", "m", "max"),
        "Q5_promo_usage_percent": (promo.select(r4("promo_usage_percent").alias("p"), F.lit(1).alias("m")), "p", "m", "max"),
        "Q6_best_age_group": (B.orders_per_age_group(cat.table("customers"), cat.table("orders_slim")), "age_group",
                              "avg_orders_per_customer", "max"),
        "Q7_top_region_estimated_revenue": (B.region_revenue_alloc(cat.table("orders"), cat.table("geography"),
                                                                   cat.table("sales")),
                                            "region", "estimated_region_revenue", "max"),
        "Q9_highest_return_rate_size": (B.return_rate_by_size(cat.table("returns"), cat.table("order_items"),
                                                              cat.table("products"), cat.spark),
                                        "size", "return_rate", "max"),
        "Q2_best_segment": (B.segment_margin(cat.table("products")), "segment", "gross_margin_ratio", "max"),
        "Q3_top_return_reason": (B.return_reasons(cat.table("returns"), cat.table("products"), RETURN_CATEGORY),
                                 "return_reason", "returns", "max"),
        "Q4_lowest_bounce_source": (B.bounce_by_source(cat.table("web_traffic")), "traffic_source",
                                    "mean_bounce_rate", "min"),
        "Q8_top_cancelled_payment_method": (B.cancelled_methods(cat.table("orders_slim")), "payment_method",
                                            "cancelled_orders", "max"),
        "Q10_best_installments": (B.value_by_installments(cat.table("payments")), "installments",
                                  "mean_payment_value", "max"),
    }
    return B.answer_sheet(parts)


@register("q_cohort_summary", W(S("v_cohorts", ["cohort_date", "new_customers", "signup_year",
                                               "cumulative_customers"]), "v_cohorts"))
def q_cohort_summary(cat):
    """Monthly new customers, signup year, running total."""
    return B.cohort_summary(cat.table("customers"))


@register("q_yearly_growth", W(f"""
    SELECT CAST(signup_year AS BIGINT) AS signup_year, CAST(n AS BIGINT) AS new_customers,
           {R("CAST(n AS DOUBLE) / nullif(CAST(lag(n) OVER (ORDER BY signup_year) AS DOUBLE), 0) - 1.0")} AS yoy_new_customer_change_pct
    FROM (SELECT signup_year, sum(new_customers) AS n FROM v_cohorts GROUP BY 1)""", "v_cohorts"))
def q_yearly_growth(cat):
    """Yearly new customers and YoY % change."""
    return B.yearly_growth(cat.table("customers"))


@register("q_channel_mix", W("""
    SELECT coalesce(acquisition_channel, 'Missing') AS acquisition_channel, count(DISTINCT customer_id) AS customers
    FROM v_customers GROUP BY 1""", "v_customers"))
def q_channel_mix(cat):
    """Distinct customers per acquisition channel, NULL -> 'Missing'."""
    return B.channel_mix(cat.table("customers"))


_PS = ["year", "month", "month_name", "category", "segment", "quantity", "revenue", "cogs", "gross_margin"]


@register("q_product_seasonality", W(S("v_prod_seasonality", _PS), "v_prod_seasonality"))
def q_product_seasonality(cat):
    """Year x month x category x segment quantity, revenue, cogs, margin."""
    return B.product_seasonality(cat.table("item_values"), cat.table("orders_slim"))


@register("q_seasonal_profile", W(f"""
    SELECT CAST(month AS BIGINT) AS month, month_name, {R('avg(revenue)')} AS avg_revenue,
           {R('median(revenue)')} AS median_revenue, {R('avg(orders)')} AS avg_orders,
           {R('avg(gross_margin)')} AS avg_gross_margin FROM v_rev_seasonality GROUP BY 1, 2""",
    "v_rev_seasonality"))
def q_seasonal_profile(cat):
    """Mean / median revenue across years by calendar month."""
    return B.seasonal_profile(B.revenue_seasonality(order_revenue(cat)))


@register("q_product_month_profile", W(f"""
    SELECT product_group, {', '.join(f"{R(f'max(avg_revenue) FILTER (WHERE month = {m})')} AS \"{m}\"" for m in range(1, 13))}
    FROM (SELECT month, category || ' / ' || segment AS product_group, avg(revenue) AS avg_revenue
          FROM v_prod_seasonality GROUP BY 1, 2) GROUP BY product_group""", "v_prod_seasonality"))
def q_product_month_profile(cat):
    """Average revenue by product group x month, wide (explicit pivot values 1..12)."""
    prof = B.product_month_profile(B.product_seasonality(cat.table("item_values"), cat.table("orders_slim")))
    return B.product_month_wide(prof)


@register("q_category_sales", W(f"""
    SELECT category, segment, CAST(sum(quantity) AS BIGINT) AS quantity, {R('sum(net_item_value)')} AS revenue,
           {R('sum(item_cogs)')} AS cogs, {R('sum(net_item_value) - sum(item_cogs)')} AS gross_margin
    FROM v_item_values GROUP BY 1, 2""", "v_item_values"))
def q_category_sales(cat):
    """Quantity, revenue, cogs, margin by category and segment."""
    return B.category_sales(cat.table("item_values"))


@register("q_monthly_orders", W(f"""
    SELECT {D("CAST(date_trunc('month', order_date) AS DATE)")} AS month_start, count(DISTINCT order_id) AS orders,
           {R('coalesce(sum(net_revenue), 0.0)')} AS revenue, {R('coalesce(sum(item_cogs), 0.0)')} AS cogs,
           {R('coalesce(sum(net_revenue), 0.0) - coalesce(sum(item_cogs), 0.0)')} AS gross_margin
    FROM v_orev GROUP BY 1""", "v_orev"))
def q_monthly_orders(cat):
    """Monthly orders, revenue, cogs, gross margin."""
    return B.monthly_orders(order_revenue(cat))


@register("q_returns_summary", W(f"""
    SELECT return_reason, count(return_id) AS return_rows, sum(return_quantity)::BIGINT AS returned_units,
           {R('sum(refund_amount)')} AS refund_amount FROM v_returns GROUP BY 1""", "v_returns"))
def q_returns_summary(cat):
    """Rows, units, refund by return reason."""
    return B.returns_summary(cat.table("returns"))


@register("q_shipment_lag", W("""
    SELECT s.order_id, date_diff('day', o.order_date, s.ship_date) AS ship_lag_days,
           date_diff('day', s.ship_date, s.delivery_date) AS delivery_lag_days, """ + R("s.shipping_fee") + """ AS shipping_fee
    FROM v_shipments s LEFT JOIN v_orders_slim o USING (order_id)""", "v_shipments", "v_orders_slim"))
def q_shipment_lag(cat):
    """Ship and delivery lag per shipment (order date by key lookup)."""
    return B.shipment_lag(cat.table("shipments"), cat.table("orders_slim"))


@register("q_payment_summary", W(f"""
    SELECT payment_method, count(order_id) AS payment_rows, {R('sum(payment_value)')} AS payment_value,
           {R('avg(installments)')} AS avg_installments FROM v_payments GROUP BY 1""", "v_payments"))
def q_payment_summary(cat):
    """Rows, value, average installments by payment method."""
    return B.payment_summary(cat.table("payments"))
