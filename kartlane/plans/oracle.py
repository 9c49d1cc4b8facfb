"""DuckDB SQL twins of the stand-in tables (for the correctness oracle).

The driver registers the raw Parquet tables as views; each oracle query is
``WITH <stand-ins it needs> <body>``.  Stand-ins are prefixed ``v_`` so they
never shadow the raw views they read.
"""

from __future__ import annotations

from kartlane.sources.inline import TET_DATES
from kartlane.sources.standins import FORECAST_HORIZON_DAYS

# (dependencies, body)
STANDINS: dict[str, tuple[list[str], str]] = {
    "v_customers": ([], """
        SELECT c_custkey AS customer_id,
               CAST(c_nationkey AS BIGINT) AS zip,
               'City-' || CAST(c_nationkey AS VARCHAR) AS city,
               DATE '1994-06-01' + CAST(c_custkey * 37 % 2400 AS INTEGER) AS signup_date,
               CASE WHEN c_custkey % 43 = 0 THEN NULL
                    ELSE ['female', 'male', 'other'][c_custkey % 3 + 1] END AS gender,
               CASE WHEN c_custkey % 41 = 0 THEN NULL
                    ELSE ['18-24', '25-34', '35-44', '45-54', '55+'][c_custkey % 5 + 1] END AS age_group,
               CASE WHEN c_custkey % 37 = 0 THEN NULL
                    WHEN c_custkey % 53 = 0 THEN ' '
                    ELSE c_mktsegment END AS acquisition_channel
        FROM customer"""),
    "v_products": ([], """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
               p_brand AS segment, ['S', 'M', 'L', 'XL'][p_size % 4 + 1] AS size,
               ['red', 'blue', 'green', 'black', 'white'][p_partkey % 5 + 1] AS color,
               p_retailprice AS price, p_retailprice * 0.6::DOUBLE AS cogs
        FROM part"""),
    "v_geography": ([], """
        SELECT CAST(n_nationkey AS BIGINT) AS zip, 'City-' || CAST(n_nationkey AS VARCHAR) AS city,
               r_name AS region, n_name AS district
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "v_orders_slim": ([], """
        SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
               o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'returned'
                                  WHEN 'P' THEN 'cancelled' END AS order_status,
               o_orderpriority AS payment_method,
               ['desktop', 'mobile', 'tablet'][o_orderkey % 3 + 1] AS device_type,
               ['organic_search', 'paid_search', 'social_media', 'email_campaign', 'referral',
                'direct'][o_orderkey % 6 + 1] AS order_source
        FROM orders"""),
    "v_orders": (["v_orders_slim"], """
        SELECT o.order_id, o.order_date, o.customer_id, CAST(c.c_nationkey AS BIGINT) AS zip,
               o.order_status, o.payment_method, o.device_type, o.order_source
        FROM v_orders_slim o LEFT JOIN customer c ON o.customer_id = c.c_custkey"""),
    "v_order_items": ([], """
        SELECT l_orderkey AS order_id, l_partkey AS product_id,
               CAST(l_quantity AS BIGINT) AS quantity,
               l_extendedprice / l_quantity AS unit_price,
               l_extendedprice * l_discount AS discount_amount,
               CASE WHEN l_discount >= 0.06::DOUBLE THEN 'PROMO-' || CAST(l_suppkey % 10 AS VARCHAR) END AS promo_id,
               CASE WHEN l_tax >= 0.07::DOUBLE THEN 'PROMO-' || CAST(l_suppkey % 7 + 10 AS VARCHAR) END AS promo_id_2
        FROM lineitem"""),
    "v_item_values": (["v_order_items", "v_products"], """
        SELECT i.*, p.category, p.segment, p.cogs,
               i.quantity * i.unit_price AS gross_item_value,
               i.quantity * i.unit_price - coalesce(i.discount_amount, 0.0) AS net_item_value,
               i.quantity * p.cogs AS item_cogs
        FROM v_order_items i LEFT JOIN v_products p USING (product_id)"""),
    "v_payments": ([], """
        SELECT o_orderkey AS order_id, o_orderpriority AS payment_method,
               o_totalprice AS payment_value,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS installments
        FROM orders"""),
    "v_shipments": ([], """
        SELECT l_orderkey AS order_id, min(CAST(l_shipdate AS DATE)) AS ship_date,
               max(CAST(l_shipdate AS DATE)) + 3 AS delivery_date,
               CAST(count(*) AS DOUBLE) * 5.0::DOUBLE AS shipping_fee
        FROM lineitem GROUP BY l_orderkey"""),
    "v_returns": ([], """
        SELECT 'RET-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS return_id,
               l_orderkey AS order_id, l_partkey AS product_id,
               CAST(l_shipdate AS DATE) + 10 AS return_date,
               ['defective', 'wrong_size', 'changed_mind', 'not_as_described', 'late_delivery'][l_suppkey % 5 + 1] AS return_reason,
               CAST(l_quantity AS BIGINT) AS return_quantity,
               l_extendedprice * (1 - l_discount) AS refund_amount
        FROM lineitem WHERE l_returnflag = 'R'"""),
    "v_reviews": ([], """
        SELECT 'REV-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS review_id,
               l_orderkey AS order_id, l_partkey AS product_id, o.o_custkey AS customer_id,
               CAST(l_shipdate AS DATE) + 14 AS review_date,
               CAST(l_linenumber % 5 + 1 AS BIGINT) AS rating, 'ok' AS review_title
        FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE l_returnflag = 'A'"""),
    "v_inventory_base": ([], """
        SELECT l_partkey AS product_id, last_day(CAST(l_shipdate AS DATE)) AS snapshot_date,
               CAST(sum(l_quantity) AS BIGINT) AS units_sold
        FROM lineitem GROUP BY 1, 2"""),
    "v_inventory": (["v_inventory_base"], """
        SELECT snapshot_date, product_id, stock_on_hand, units_received, units_sold, stockout_days,
               days_of_supply, fill_rate, stockout_flag, overstock_flag, reorder_flag,
               sell_through_rate, product_name, category, segment, year, month
        FROM (
          SELECT b.*, p.p_name AS product_name, p.p_type AS category, p.p_brand AS segment,
                 CAST(year(snapshot_date) AS INTEGER) AS year, CAST(month(snapshot_date) AS INTEGER) AS month,
                 (product_id * 11 + m * 3) % 120 AS stock_on_hand,
                 units_sold + (product_id * 7 + m * 13) % 40 AS units_received,
                 CASE WHEN (product_id + m) % 4 = 0 THEN (product_id * 5 + m) % 15 + 1 ELSE 0 END AS stockout_days,
                 CAST((product_id * 11 + m * 3) % 120 AS DOUBLE) * 30.0::DOUBLE / CAST(units_sold + 1 AS DOUBLE) AS days_of_supply,
                 1.0::DOUBLE - CAST(CASE WHEN (product_id + m) % 4 = 0 THEN (product_id * 5 + m) % 15 + 1 ELSE 0 END AS DOUBLE) / 30.0::DOUBLE AS fill_rate,
                 CAST(units_sold AS DOUBLE) / CAST(units_sold + (product_id * 11 + m * 3) % 120 AS DOUBLE) AS sell_through_rate,
                 CASE WHEN (product_id + m) % 4 = 0 THEN 1 ELSE 0 END AS stockout_flag,
                 CASE WHEN CAST((product_id * 11 + m * 3) % 120 AS DOUBLE) * 30.0::DOUBLE / CAST(units_sold + 1 AS DOUBLE) > 60.0::DOUBLE THEN 1 ELSE 0 END AS overstock_flag,
                 CASE WHEN (product_id * 11 + m * 3) % 120 < 20 THEN 1 ELSE 0 END AS reorder_flag
          FROM (SELECT *, CAST(year(snapshot_date) AS BIGINT) * 12 + CAST(month(snapshot_date) AS BIGINT) AS m
                FROM v_inventory_base) b
          LEFT JOIN part p ON b.product_id = p.p_partkey)"""),
    "v_promotions": ([], """
        SELECT campaign || '_' || CAST(y AS VARCHAR) AS promo_id, campaign AS promo_name,
               CASE WHEN coalesce(disc, 0) > 0 THEN 'percentage' ELSE 'fixed' END AS promo_type,
               CASE WHEN coalesce(disc, 0) > 0 THEN CAST(disc AS DOUBLE) ELSE 50.0::DOUBLE END AS discount_value,
               CAST(make_date(y, sm, sd) AS DATE) AS start_date, CAST(make_date(y, sm, sd) + dur AS DATE) AS end_date,
               CAST(NULL AS VARCHAR) AS applicable_category, CAST(NULL AS VARCHAR) AS promo_channel,
               CAST(0 AS INTEGER) AS stackable_flag, CAST(NULL AS DOUBLE) AS min_order_value
        FROM (SELECT unnest(range(CAST(min(year(o_orderdate)) - 1 AS BIGINT),
                                  CAST(max(year(o_orderdate)) + 2 AS BIGINT))) AS y FROM orders) yrs
        CROSS JOIN (VALUES ('spring_sale', 3, 18, 30, 12.0, 'yearly'), ('mid_year', 6, 23, 29, 18.0, 'yearly'),
          ('fall_launch', 8, 30, 32, 10.0, 'yearly'), ('year_end', 11, 18, 45, 20.0, 'yearly'),
          ('urban_blowout', 7, 30, 33, NULL, 'odd'), ('rural_special', 1, 30, 30, 15.0, 'odd'))
          camp(campaign, sm, sd, dur, disc, rec)
        WHERE rec <> 'odd' OR y % 2 = 1"""),
    "v_sample_submission": (["v_orders_slim"], f"""
        SELECT CAST(unnest(generate_series(max(order_date) + 1, max(order_date) + {FORECAST_HORIZON_DAYS},
                                           INTERVAL 1 DAY)) AS DATE) AS Date,
               0.0::DOUBLE AS Revenue, 0.0::DOUBLE AS COGS FROM v_orders_slim"""),
    "v_sales": (["v_item_values", "v_orders_slim"], """
        SELECT s.Date, CAST(round(CAST(coalesce(d.Revenue, 0.0) AS DECIMAL(38, 9)), 4) AS DOUBLE) AS Revenue,
               CAST(round(CAST(coalesce(d.COGS, 0.0) AS DECIMAL(38, 9)), 4) AS DOUBLE) AS COGS
        FROM (SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS Date
              FROM v_orders_slim) s
        LEFT JOIN (SELECT o.order_date AS Date, sum(i.net_item_value) AS Revenue, sum(i.item_cogs) AS COGS
                   FROM v_item_values i JOIN v_orders_slim o USING (order_id) GROUP BY 1) d USING (Date)"""),
    "v_web_traffic": ([], """
        SELECT a.date, a.sessions, a.unique_visitors, a.page_views, b.bounce_rate,
               a.avg_session_duration_sec, a.event_type AS traffic_source
        FROM (SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS sessions,
                     count(DISTINCT user_id) AS unique_visitors,
                     CAST(sum(event_id % 5 + 1) AS BIGINT) AS page_views,
                     avg(value) AS avg_session_duration_sec
              FROM events GROUP BY 1, 2) a
        JOIN (SELECT date, event_type,
                     CAST(count(*) FILTER (WHERE n = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS bounce_rate
              FROM (SELECT CAST(ts AS DATE) AS date, event_type, user_id, count(*) AS n
                    FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) b
        USING (date, event_type)"""),
}


def with_views(body: str, *names: str, overrides: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first.

    ``overrides`` swaps the body of a stand-in (e.g. a filtered orders table)
    for every CTE built on it.
    """
    overrides = overrides or {}
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in STANDINS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({overrides.get(n, STANDINS[n][1])})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        # the body has its own CTEs: append them after the stand-ins
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


def R(expr: str, digits: int = 4) -> str:
    """SQL twin of ``exprs.r4``: snap through DECIMAL(38,9), round, back to DOUBLE."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


def D(expr: str) -> str:
    """Date -> ISO text (twin of finalize's date formatting)."""
    return f"strftime({expr}, '%Y-%m-%d')"


def I(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def mode_sql(src: str, key: str, col: str, out: str) -> str:
    """Most-frequent value per key; a tie at the top returns the smallest of all values."""
    return f"""
        SELECT {key}, CASE WHEN n_top > 1 THEN min_all ELSE top_value END AS {out} FROM (
          SELECT {key}, count(*) FILTER (WHERE n = max_n) AS n_top, min(v) AS min_all,
                 min(v) FILTER (WHERE n = max_n) AS top_value
          FROM (SELECT {key}, v, n, max(n) OVER (PARTITION BY {key}) AS max_n
                FROM (SELECT {key}, {col} AS v, count(*) AS n FROM {src}
                      WHERE {col} IS NOT NULL GROUP BY 1, 2))
          GROUP BY {key})"""


# Fact-table fragments (shared CTE library for the fact and analysis oracles).
STANDINS.update({
    "v_order_item_fact": (["v_item_values"], """
        SELECT order_id, count(DISTINCT product_id) AS distinct_products,
               sum(quantity) AS total_quantity, sum(gross_item_value) AS gross_revenue,
               sum(coalesce(discount_amount, 0.0)) AS total_discount_amount,
               sum(net_item_value) AS net_revenue, sum(item_cogs) AS total_cogs,
               sum(net_item_value) - sum(item_cogs) AS gross_margin
        FROM v_item_values GROUP BY order_id"""),
    "v_order_level": (["v_orders", "v_order_item_fact", "v_payments", "v_shipments"], """
        SELECT o.*, f.distinct_products, f.total_quantity, f.gross_revenue, f.total_discount_amount,
               f.net_revenue, f.total_cogs, f.gross_margin,
               p.payment_method AS payment_method_payment, p.payment_value, p.installments,
               s.ship_date, s.delivery_date, s.shipping_fee,
               coalesce(p.payment_method, o.payment_method) AS payment_method_recorded
        FROM v_orders o LEFT JOIN v_order_item_fact f USING (order_id)
        LEFT JOIN v_payments p USING (order_id) LEFT JOIN v_shipments s USING (order_id)"""),
    "v_order_returns": (["v_returns"], """
        SELECT order_id, count(DISTINCT return_id) AS return_records_count,
               count(DISTINCT product_id) AS returned_products_count,
               sum(return_quantity) AS returned_units_count, sum(refund_amount) AS total_refund_amount,
               min(return_date) AS first_return_date, max(return_date) AS last_return_date
        FROM v_returns GROUP BY order_id"""),
    "v_order_reviews": (["v_reviews"], """
        SELECT order_id, count(DISTINCT review_id) AS reviews_count,
               count(DISTINCT product_id) AS reviewed_products_count, avg(rating) AS avg_review_rating,
               min(review_date) AS first_review_date, max(review_date) AS latest_review_date
        FROM v_reviews GROUP BY order_id"""),
    "v_order_fact": (["v_order_level", "v_order_returns", "v_order_reviews"], """
        SELECT l.order_id, l.order_date, CAST(date_trunc('month', l.order_date) AS DATE) AS order_month,
               l.customer_id, l.zip, l.order_status, l.payment_method_recorded, l.device_type, l.order_source,
               l.distinct_products, l.total_quantity, l.gross_revenue AS total_order_value,
               l.total_discount_amount, l.net_revenue, l.payment_value AS net_revenue_proxy,
               l.payment_value - l.net_revenue AS payment_gap_vs_net_revenue, l.total_cogs, l.gross_margin,
               l.total_discount_amount / nullif(l.gross_revenue, 0) AS discount_rate,
               l.gross_margin / nullif(l.net_revenue, 0) AS gross_margin_rate,
               l.payment_value, l.installments, l.ship_date, l.delivery_date, l.shipping_fee,
               date_diff('day', l.order_date, l.ship_date) AS ship_lead_time_days,
               date_diff('day', l.order_date, l.delivery_date) AS delivery_lead_time_days,
               CAST(coalesce(r.return_records_count, 0) AS BIGINT) AS return_records_count,
               CAST(coalesce(r.returned_products_count, 0) AS BIGINT) AS returned_products_count,
               CAST(coalesce(r.returned_units_count, 0) AS BIGINT) AS returned_units_count,
               r.total_refund_amount, r.first_return_date, r.last_return_date,
               date_diff('day', l.order_date, r.first_return_date) AS days_to_first_return,
               r.total_refund_amount / nullif(l.net_revenue, 0) AS refund_to_revenue_ratio,
               CAST(coalesce(v.reviews_count, 0) AS BIGINT) AS reviews_count,
               CAST(coalesce(v.reviewed_products_count, 0) AS BIGINT) AS reviewed_products_count,
               v.avg_review_rating, v.first_review_date, v.latest_review_date,
               date_diff('day', l.order_date, v.first_review_date) AS days_to_first_review
        FROM v_order_level l LEFT JOIN v_order_returns r USING (order_id)
        LEFT JOIN v_order_reviews v USING (order_id)"""),
    "v_customer_order_dates": (["v_orders_slim"], """
        SELECT customer_id, max(order_date) FILTER (WHERE rk = 1) AS first_order_date,
               max(order_date) FILTER (WHERE rk = 2) AS second_order_date
        FROM (SELECT customer_id, order_date,
                     row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS rk
              FROM v_orders_slim) GROUP BY customer_id"""),
    "v_customer_items": (["v_order_items", "v_orders_slim"], """
        SELECT o.customer_id, count(DISTINCT i.product_id) AS distinct_products_count,
               sum(i.quantity) AS total_quantity
        FROM v_order_items i LEFT JOIN v_orders_slim o USING (order_id) GROUP BY o.customer_id"""),
    "v_mode_pay": (["v_order_level"], mode_sql("v_order_level", "customer_id", "payment_method_recorded",
                                               "preferred_payment_method")),
    "v_mode_dev": (["v_order_level"], mode_sql("v_order_level", "customer_id", "device_type",
                                               "preferred_device_type")),
    "v_mode_src": (["v_order_level"], mode_sql("v_order_level", "customer_id", "order_source",
                                               "preferred_order_source")),
    "v_customer_orders": (["v_order_level", "v_mode_pay", "v_mode_dev", "v_mode_src"], """
        SELECT a.*, mp.preferred_payment_method, md.preferred_device_type, ms.preferred_order_source
        FROM (SELECT customer_id, max(order_date) AS last_order_date,
                     count(DISTINCT order_id) AS orders_count,
                     count(*) FILTER (WHERE order_status = 'delivered') AS delivered_orders_count,
                     count(*) FILTER (WHERE order_status = 'returned') AS returned_orders_count,
                     count(*) FILTER (WHERE order_status = 'cancelled') AS cancelled_orders_count,
                     count(ship_date) AS shipped_orders_count,
                     coalesce(sum(gross_revenue), 0) AS gross_revenue,
                     coalesce(sum(total_discount_amount), 0) AS total_discount_amount,
                     coalesce(sum(net_revenue), 0) AS net_revenue,
                     coalesce(sum(total_cogs), 0) AS total_cogs,
                     coalesce(sum(gross_margin), 0) AS gross_margin,
                     coalesce(sum(payment_value), 0) AS total_payment_value,
                     avg(installments) AS avg_payment_installments,
                     coalesce(sum(shipping_fee), 0) AS total_shipping_fee,
                     avg(net_revenue) AS avg_order_value, avg(total_quantity) AS avg_items_per_order
              FROM v_order_level GROUP BY customer_id) a
        LEFT JOIN v_mode_pay mp USING (customer_id) LEFT JOIN v_mode_dev md USING (customer_id)
        LEFT JOIN v_mode_src ms USING (customer_id)"""),
    "v_customer_returns": (["v_returns", "v_orders_slim"], """
        SELECT o.customer_id, sum(recs) AS return_records_count, sum(units) AS returned_units_count,
               sum(refund) AS total_refund_amount, max(latest) AS last_return_date
        FROM (SELECT order_id, count(DISTINCT return_id) AS recs, sum(return_quantity) AS units,
                     sum(refund_amount) AS refund, max(return_date) AS latest
              FROM v_returns GROUP BY order_id) r
        LEFT JOIN v_orders_slim o USING (order_id) GROUP BY o.customer_id"""),
    "v_customer_reviews": (["v_reviews"], """
        SELECT customer_id, count(DISTINCT review_id) AS reviews_count, avg(rating) AS avg_review_rating,
               max(review_date) AS latest_review_date
        FROM v_reviews GROUP BY customer_id"""),
    "v_customer_fact": (["v_customers", "v_customer_order_dates", "v_customer_orders", "v_customer_items",
                         "v_customer_returns", "v_customer_reviews", "v_orders_slim"], """
        SELECT c.customer_id, c.zip, c.city, c.signup_date, c.gender, c.age_group, c.acquisition_channel,
               d.first_order_date, d.second_order_date, o.last_order_date,
               date_diff('day', d.first_order_date, o.last_order_date) AS customer_tenure_days,
               date_diff('day', o.last_order_date, e.analysis_end) AS days_since_last_order,
               date_diff('day', c.signup_date, d.first_order_date) AS days_from_signup_to_first_order,
               date_diff('day', d.first_order_date, d.second_order_date) AS days_to_second_order,
               o.orders_count, o.delivered_orders_count, o.returned_orders_count, o.cancelled_orders_count,
               o.shipped_orders_count, i.distinct_products_count, i.total_quantity,
               o.gross_revenue AS total_order_value, o.total_discount_amount, o.net_revenue,
               o.total_payment_value AS net_revenue_proxy,
               o.total_payment_value - o.net_revenue AS payment_gap_vs_net_revenue,
               o.total_cogs, o.gross_margin, o.total_payment_value, o.avg_payment_installments,
               o.total_shipping_fee, o.avg_order_value, o.avg_items_per_order,
               o.preferred_payment_method, o.preferred_device_type, o.preferred_order_source,
               r.return_records_count, r.returned_units_count, r.total_refund_amount, r.last_return_date,
               CAST(o.returned_orders_count AS DOUBLE) / nullif(CAST(o.orders_count AS DOUBLE), 0) AS return_rate_orders,
               r.total_refund_amount / nullif(o.net_revenue, 0) AS refund_to_revenue_ratio,
               CAST(coalesce(v.reviews_count, 0) AS BIGINT) AS reviews_count, v.avg_review_rating,
               v.latest_review_date,
               CAST(coalesce(v.reviews_count, 0) AS DOUBLE) / nullif(CAST(o.orders_count AS DOUBLE), 0) AS review_rate_orders
        FROM v_customers c
        LEFT JOIN v_customer_order_dates d USING (customer_id)
        LEFT JOIN v_customer_orders o USING (customer_id)
        LEFT JOIN v_customer_items i USING (customer_id)
        LEFT JOIN v_customer_returns r USING (customer_id)
        LEFT JOIN v_customer_reviews v USING (customer_id)
        CROSS JOIN (SELECT max(order_date) AS analysis_end FROM v_orders_slim) e"""),
    "v_cohort_activity": (["v_order_fact", "v_customer_fact"], """
        SELECT customer_id, first_order_cohort_month, signup_cohort_month, order_month,
               (year(order_month) - year(first_order_cohort_month)) * 12
                 + (month(order_month) - month(first_order_cohort_month)) AS cohort_index,
               acquisition_channel, count(DISTINCT order_id) AS orders_count,
               coalesce(sum(total_order_value), 0) AS total_order_value,
               coalesce(sum(net_revenue), 0) AS net_revenue,
               coalesce(sum(net_revenue_proxy), 0) AS net_revenue_proxy,
               coalesce(sum(gross_margin), 0) AS gross_margin, 1 AS active_month_flag,
               coalesce(sum(net_revenue_proxy), 0) - coalesce(sum(net_revenue), 0) AS payment_gap_vs_net_revenue
        FROM (SELECT f.customer_id, f.order_id, f.order_month, f.total_order_value, f.net_revenue,
                     f.net_revenue_proxy, f.gross_margin, c.acquisition_channel,
                     CAST(date_trunc('month', c.first_order_date) AS DATE) AS first_order_cohort_month,
                     CAST(date_trunc('month', c.signup_date) AS DATE) AS signup_cohort_month
              FROM v_order_fact f LEFT JOIN v_customer_fact c USING (customer_id))
        GROUP BY ALL"""),
    "v_activation": (["v_customer_fact"], """
        SELECT customer_id, signup_date, CAST(date_trunc('month', signup_date) AS DATE) AS signup_cohort_month,
               first_order_date, second_order_date,
               CAST(date_trunc('month', first_order_date) AS DATE) AS activation_month,
               (year(first_order_date) - year(signup_date)) * 12
                 + (month(first_order_date) - month(signup_date)) AS months_to_activation,
               days_from_signup_to_first_order AS days_signup_to_first_order,
               CASE WHEN days_from_signup_to_first_order >= 0 THEN 1 ELSE 0 END AS signup_before_first_order_flag,
               CASE WHEN first_order_date IS NOT NULL THEN 1 ELSE 0 END AS activated_flag,
               CASE WHEN second_order_date IS NOT NULL THEN 1 ELSE 0 END AS repeat_order_flag,
               CAST(coalesce(orders_count, 0) AS BIGINT) AS num_orders, acquisition_channel, net_revenue
        FROM v_customer_fact"""),
    "v_inventory_fact": (["v_inventory"], """
        SELECT product_id, snapshot_date, CAST(date_trunc('month', snapshot_date) AS DATE) AS snapshot_month,
               year, month, product_name, category, segment, stock_on_hand, units_received, units_sold,
               units_received - units_sold AS net_units_change, stock_on_hand + units_sold AS available_units,
               stockout_days,
               CAST(stockout_days AS DOUBLE) / nullif(CAST(day(last_day(snapshot_date)) AS DOUBLE), 0) AS stockout_rate_days,
               days_of_supply, fill_rate, sell_through_rate, stockout_flag, overstock_flag, reorder_flag
        FROM v_inventory"""),
})


# Column-name -> output class for the SQL finalisation (twin of ``finalize``,
# which is type-driven on the Spark side; the harness checks both agree).
DATE_COLS = set("""order_date order_month ship_date delivery_date first_return_date last_return_date
first_review_date latest_review_date signup_date first_order_date second_order_date last_order_date
first_order_cohort_month signup_cohort_month activation_month snapshot_date snapshot_month Date date
cohort_date month_start cohort_month return_date review_date start_date end_date""".split())
DOUBLE_COLS = set("""total_order_value total_discount_amount net_revenue net_revenue_proxy
payment_gap_vs_net_revenue total_cogs gross_margin discount_rate gross_margin_rate payment_value
shipping_fee total_refund_amount refund_to_revenue_ratio avg_review_rating total_payment_value
avg_payment_installments total_shipping_fee avg_order_value avg_items_per_order return_rate_orders
review_rate_orders stockout_rate_days days_of_supply fill_rate sell_through_rate gross_revenue discount
item_cogs revenue cogs Revenue COGS""".split())
INT_COLS = set("""distinct_products total_quantity installments ship_lead_time_days
delivery_lead_time_days return_records_count returned_products_count returned_units_count
days_to_first_return reviews_count reviewed_products_count days_to_first_review customer_tenure_days
days_since_last_order days_from_signup_to_first_order days_to_second_order orders_count
delivered_orders_count returned_orders_count cancelled_orders_count shipped_orders_count
distinct_products_count cohort_index active_month_flag months_to_activation days_signup_to_first_order
signup_before_first_order_flag activated_flag repeat_order_flag num_orders year month
stock_on_hand units_received units_sold net_units_change available_units stockout_days stockout_flag
overstock_flag reorder_flag items rows unique_key duplicate_key_rows records_with_activity
records_without_activity""".split())


def select_final(view: str, cols: list[str], where: str = "", dates=(), doubles=(), ints=()) -> str:
    """SELECT list applying D / R / I per column name (twin of ``finalize``)."""
    parts = []
    for c in cols:
        if c in DATE_COLS or c in dates:
            parts.append(f"{D(c)} AS {c}")
        elif c in DOUBLE_COLS or c in doubles:
            parts.append(f"{R(c)} AS {c}")
        elif c in INT_COLS or c in ints:
            parts.append(f"{I(c)} AS {c}")
        else:
            parts.append(c)
    return f"SELECT {', '.join(parts)} FROM {view} {where}"


STANDINS.update({
    "v_orev": (["v_orders", "v_item_values"], """
        SELECT o.*, a.items, a.gross_revenue, a.discount, a.net_revenue, a.item_cogs
        FROM v_orders o LEFT JOIN (
          SELECT order_id, sum(quantity) AS items, sum(gross_item_value) AS gross_revenue,
                 coalesce(sum(discount_amount), 0.0) AS discount, sum(net_item_value) AS net_revenue,
                 sum(item_cogs) AS item_cogs FROM v_item_values GROUP BY order_id) a USING (order_id)"""),
    "v_rev_seasonality": (["v_orev"], """
        SELECT year(order_date) AS year, month(order_date) AS month, strftime(order_date, '%b') AS month_name,
               count(DISTINCT order_id) AS orders, coalesce(sum(net_revenue), 0.0) AS revenue,
               coalesce(sum(item_cogs), 0.0) AS cogs,
               coalesce(sum(net_revenue), 0.0) - coalesce(sum(item_cogs), 0.0) AS gross_margin
        FROM v_orev GROUP BY 1, 2, 3"""),
    "v_prod_seasonality": (["v_item_values", "v_orders_slim"], """
        SELECT year(o.order_date) AS year, month(o.order_date) AS month,
               strftime(o.order_date, '%b') AS month_name, i.category, i.segment,
               sum(i.quantity) AS quantity, sum(i.net_item_value) AS revenue, sum(i.item_cogs) AS cogs,
               sum(i.net_item_value) - sum(i.item_cogs) AS gross_margin
        FROM v_item_values i LEFT JOIN v_orders_slim o USING (order_id) GROUP BY ALL"""),
    "v_cohorts": (["v_customers"], """
        SELECT cohort_date, new_customers, year(cohort_date) AS signup_year,
               sum(new_customers) OVER (ORDER BY cohort_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 AS cumulative_customers
        FROM (SELECT CAST(date_trunc('month', signup_date) AS DATE) AS cohort_date,
                     count(DISTINCT customer_id) AS new_customers
              FROM v_customers WHERE signup_date IS NOT NULL GROUP BY 1)"""),
})
DOUBLE_COLS.update("""gross_margin avg_revenue median_revenue avg_orders avg_gross_margin avg_quantity
mean_bounce_rate promo_usage_percent avg_orders_per_customer estimated_region_revenue return_rate
mean_payment_value gross_margin_ratio yoy_new_customer_change_pct refund_amount payment_value_sum
avg_installments avg_stockout_days avg_fill_rate median_fill_rate avg_days_of_supply median_days_of_supply
avg_sell_through_rate avg_stock_on_hand stockout_product_month_rate overstock_product_month_rate
reorder_product_month_rate stockout_days_per_product_month lost_unit_sold_proxy units_weighted_avg_fill_rate
estimated_unconstrained_units lost_unit_sold_proxy_share unit_weighted_fill_rate unit_share lost_unit_share
units_ratio_to_next median_inter_order_gap_days shipping_fee""".split())
INT_COLS.update("""quantity orders new_customers signup_year cumulative_customers customers returns promo_rows total_rows
total_orders total_customers cancelled_orders return_rows item_rows returned_units payment_rows
product_month_rows unique_products stockout_product_months overstock_product_months reorder_product_months
total_stockout_days total_units_received total_units_sold gaps ship_lag_days delivery_lag_days
units_rank""".split())


def hist_sql(src: str, x: str, bins: int, keys: list[str], density: bool = False) -> str:
    """SQL twin of ``aggregates.histogram``."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    dens = ""
    if density:
        part = f"PARTITION BY {k}" if keys else ""
        dens = (f", CAST(printf('%.6e', CAST(cnt AS DOUBLE) / nullif(CAST(sum(cnt) OVER ({part}) AS DOUBLE) * (hi - lo), 0)) "
                "AS DOUBLE) AS density")
    return f"""
    SELECT {kc}bin, {R('lo')} AS lo, {R('hi')} AS hi, cnt AS count{dens} FROM (
      SELECT {kc}bin, _lo + CAST(bin - 1 AS DOUBLE) * ((_hi - _lo) / {float(bins)!r}) AS lo,
             _lo + CAST(bin AS DOUBLE) * ((_hi - _lo) / {float(bins)!r}) AS hi, count(*) AS cnt
      FROM (SELECT {kc}_lo, _hi,
                   CAST(CASE WHEN _hi = _lo THEN 1
                        ELSE least(floor({float(bins)!r} * (_x - _lo) / (_hi - _lo)) + 1, {bins}) END AS BIGINT) AS bin
            FROM (SELECT {kc}CAST({x} AS DOUBLE) AS _x FROM {src} WHERE {x} IS NOT NULL) a
            {'JOIN' if keys else 'CROSS JOIN'} (SELECT {kc}min(CAST({x} AS DOUBLE)) AS _lo, max(CAST({x} AS DOUBLE)) AS _hi
                  FROM {src} {('GROUP BY ' + k) if keys else ''}) b {('USING (' + k + ')') if keys else ''})
      GROUP BY ALL)"""


STANDINS.update({
    "v_sales_panel": (["v_item_values", "v_orders_slim"], """
        SELECT s.series_id, s.Date,
               CAST(round(CAST(coalesce(d.Revenue, 0.0) AS DECIMAL(38, 9)), 4) AS DOUBLE) AS Revenue,
               CAST(round(CAST(coalesce(d.COGS, 0.0) AS DECIMAL(38, 9)), 4) AS DOUBLE) AS COGS
        FROM (SELECT k.series_id, c.Date FROM
                (SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS Date
                 FROM v_orders_slim) c
                CROSS JOIN (SELECT DISTINCT c_mktsegment AS series_id FROM customer) k) s
        LEFT JOIN (SELECT cu.c_mktsegment AS series_id, o.order_date AS Date, sum(i.net_item_value) AS Revenue,
                          sum(i.item_cogs) AS COGS
                   FROM v_item_values i JOIN v_orders_slim o USING (order_id)
                   JOIN customer cu ON o.customer_id = cu.c_custkey GROUP BY 1, 2) d USING (series_id, Date)"""),
    "v_panel_long": (["v_sales_panel"], """
        SELECT series_id, 'Revenue' AS target, Date, Revenue AS y FROM v_sales_panel
        UNION ALL SELECT series_id, 'COGS', Date, COGS FROM v_sales_panel"""),
    "v_tet": ([], "SELECT CAST(d AS DATE) AS tet_date FROM (VALUES " + ", ".join(
        f"('{v}')" for v in TET_DATES.values()) + ") t(d)"),
})
