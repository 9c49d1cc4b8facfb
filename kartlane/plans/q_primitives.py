"""Primitive operators, one registered query per ID.

Where a primitive is exactly the core of a composite query, the ID is an
alias of that query (same Spark builder, same SQL twin); the rest are small
queries over the stand-in tables.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kartlane.functions import exprs as X
from kartlane.operators import aggregates as A
from kartlane.operators import facts as FX
from kartlane.operators import joins as J
from kartlane.plans.oracle import D, R, with_views as W
from kartlane.plans.registry import REGISTRY, register

# -- aliases onto composite queries that are built around the primitive ------------------
ALIASES = {
    "join_multi_left_chain": "fact_order_level", "join_full_outer": "dq_payment_proxy_check",
    "join_key_lookup": "q_shipment_lag", "join_spine_left": "dq_snapshot_coverage",
    "join_range_promo": "fe_promo_regressors", "join_nearest_event": "fe_tet",
    "join_calibration_factor": "fc_apply_calibration", "agg_named_multi": "q_inventory_status",
    "agg_ratio_of_sums": "q_channel_grouped", "agg_two_level": "fact_customer_returns",
    "agg_weighted_fill": "q_lost_units", "win_lag_diff": "q_inter_order_gap", "win_pct_change": "q_yearly_growth",
    "win_cumsum": "q_cohort_summary", "win_cum_share": "q_revenue_concentration", "win_lags": "fe_lag_rolling",
    "win_rolling_stats": "fe_lag_rolling", "win_rolling_full": "fe_baseline_lags",
    "win_rolling_offset": "fe_yoy_growth", "win_expanding_mean": "fe_lag_rolling",
    "win_rolling3_shift": "fe_monthly_features", "topk_nlargest_share": "q_concentration_snapshot",
    "topk_threshold_cross": "q_concentration_snapshot", "set_difference": "dq_missing_dates",
    "shape_pivot": "q_product_month_profile", "shape_pivot_rank": "fact_customer_order_dates",
    "shape_unstack_two": "q_stockout_heatmap_wide", "shape_melt": "q_channel_rates_long",
    "shape_reindex_fill": "q_return_rate_by_size", "expr_threshold_relabel": "q_channel_grouped",
    "flt_promo_used": "q_promo_usage", "flt_equality": "q_return_reasons",
    "expr_combine_first": "fact_order_level", "expr_period_label": "q_stockout_heatmap",
    "expr_bucket_cap": "q_retention_month_of_year", "expr_era_label": "q_era_distribution",
"expr_clip": "fc_calibration_factors", "udaf_most_frequent": "agg_mode_tiebreak",
    "udf_nearest_tet": "fe_tet", "udf_black_friday": "fe_black_friday", "udf_get_era": "q_era_distribution",
    "udf_calibration_factor": "fc_apply_calibration", "udf_share_transform": "agg_share_within_group",
    "udaf_pred_count": "agg_conditional_count",
}


def _proj(name, doc, build, sql):
    build.__doc__ = doc
    register(name, sql)(build)


# -- expressions ---------------------------------------------------------------------------
_proj("expr_item_values", "Gross, net and cost value of every order line.",
      lambda cat: cat.table("item_values").select("order_id", "product_id", "quantity", "gross_item_value",
                                                  "net_item_value", "item_cogs"),
      W(f"SELECT order_id, product_id, quantity, {R('gross_item_value')} AS gross_item_value, "
        f"{R('net_item_value')} AS net_item_value, {R('item_cogs')} AS item_cogs FROM v_item_values", "v_item_values"))

_proj("expr_discount_formula", "percentage: qty*price*value/100; fixed: qty*value (promo type by promo slot).",
      lambda cat: cat.table("order_items").select(
          "order_id", "product_id",
          X.discount_formula(F.when(F.col("promo_id").isNotNull(), F.lit("percentage"))
                             .when(F.col("promo_id_2").isNotNull(), F.lit("fixed")),
                             F.lit(10.0), "quantity", "unit_price").alias("formula_discount")),
      W(f"""SELECT order_id, product_id, {R('''CASE WHEN promo_id IS NOT NULL THEN quantity * unit_price * 10.0 / 100.0
                                                  WHEN promo_id_2 IS NOT NULL THEN quantity * 10.0 END''')} AS formula_discount
            FROM v_order_items""", "v_order_items"))

_proj("expr_safe_divide", "units sold per unit on hand, NULL when stock is 0 (never raises under ANSI).",
      lambda cat: cat.table("inventory").select("product_id", "snapshot_date",
                                                X.fdiv("units_sold", "stock_on_hand").alias("sold_per_stock")),
      W(f"""SELECT product_id, {D('snapshot_date')} AS snapshot_date,
                   {R('CAST(units_sold AS DOUBLE) / nullif(CAST(stock_on_hand AS DOUBLE), 0)')} AS sold_per_stock
            FROM v_inventory""", "v_inventory"))

_proj("expr_margin_ratio", "(price - cogs) / price per product and absolute margin.",
      lambda cat: cat.table("products").select("product_id", X.margin_ratio("price", "cogs").alias("margin_ratio"),
                                               (F.col("price") - F.col("cogs")).alias("margin")),
      W(f"""SELECT product_id, {R('(price - cogs) / nullif(price, 0)')} AS margin_ratio, {R('price - cogs')} AS margin
            FROM v_products""", "v_products"))

_proj("expr_fill_default", "blank / NULL channel -> 'Missing', NULL age group -> 'Unknown'.",
      lambda cat: cat.table("customers").select("customer_id", X.fill_label("acquisition_channel").alias("channel"),
                                                F.coalesce("age_group", F.lit("Unknown")).alias("age_group")),
      W("""SELECT customer_id, coalesce(nullif(trim(acquisition_channel), ''), 'Missing') AS channel,
                  coalesce(age_group, 'Unknown') AS age_group FROM v_customers""", "v_customers"))


def _calendar(cat):
    o = cat.table("orders_slim").select("order_id", "customer_id", "order_date")
    c = cat.table("customers").select("customer_id", "signup_date")
    j = o.join(c, "customer_id", "left")
    return j.select("order_id", X.month_trunc("order_date").alias("month_start"),
                    X.month_diff("order_date", "signup_date").alias("months_since_signup"),
                    X.day_diff("order_date", "signup_date").alias("days_since_signup"),
                    X.month_name("order_date").alias("month_name"),
                    X.days_in_month("order_date").alias("days_in_month"),
                    X.is_month_end("order_date").alias("is_month_end"))


_CAL_SQL = W(f"""SELECT o.order_id, {D("CAST(date_trunc('month', o.order_date) AS DATE)")} AS month_start,
    CAST((year(o.order_date) - year(c.signup_date)) * 12 + month(o.order_date) - month(c.signup_date) AS BIGINT) AS months_since_signup,
    CAST(date_diff('day', c.signup_date, o.order_date) AS BIGINT) AS days_since_signup,
    strftime(o.order_date, '%b') AS month_name, CAST(day(last_day(o.order_date)) AS BIGINT) AS days_in_month,
    o.order_date = last_day(o.order_date) AS is_month_end
    FROM v_orders_slim o LEFT JOIN v_customers c USING (customer_id)""", "v_orders_slim", "v_customers")
for _n in ("expr_month_trunc", "expr_month_diff", "expr_day_diff", "expr_month_name", "expr_days_in_month"):
    _proj(_n, "Calendar expressions on orders vs signup: month start, calendar month diff, day diff, "
              "month name, month length, month-end test.", _calendar, _CAL_SQL)

_proj("expr_log_exp", "log target and exp back on positive daily revenue (log models filter y > 0).",
      lambda cat: cat.table("sales").filter(F.col("Revenue") > 0).select(
          "Date", F.log("Revenue").alias("log_revenue"), F.exp(F.log("Revenue")).alias("revenue_back")),
      W(f"SELECT {D('Date')} AS Date, {R('ln(Revenue)')} AS log_revenue, {R('exp(ln(Revenue))')} AS revenue_back "
        "FROM v_sales WHERE Revenue > 0", "v_sales"))

_proj("expr_label_concat", "category + ' / ' + segment product-group label.",
      lambda cat: cat.table("products").select("product_id", X.label_concat("category", "segment").alias("product_group")),
      W("SELECT product_id, category || ' / ' || segment AS product_group FROM v_products", "v_products"))

_proj("expr_map_lookup", "order status -> display label through a literal map (broadcast, 3 rows).",
      lambda cat: cat.table("orders_slim").join(F.broadcast(cat.spark.createDataFrame(
          [("delivered", "Delivered"), ("returned", "Returned"), ("cancelled", "Cancelled")],
          "order_status string, status_label string")), "order_status", "left").select("order_id", "status_label"),
      W("""SELECT order_id, m.status_label FROM v_orders_slim LEFT JOIN (VALUES ('delivered', 'Delivered'),
           ('returned', 'Returned'), ('cancelled', 'Cancelled')) m(order_status, status_label) USING (order_status)""",
        "v_orders_slim"))

# -- filters / projections --------------------------------------------------------------------
_proj("flt_between", "Inclusive date range filter (one quarter of orders).",
      lambda cat: cat.table("orders_slim").filter(F.col("order_date").between(
          F.lit("1998-01-01").cast("date"), F.lit("1998-03-31").cast("date"))).select("order_id", "order_date"),
      W(f"SELECT order_id, {D('order_date')} AS order_date FROM v_orders_slim "
        "WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'", "v_orders_slim"))

_proj("flt_in_list", "isin on a literal list of statuses.",
      lambda cat: cat.table("orders_slim").filter(F.col("order_status").isin("returned", "cancelled"))
      .select("order_id", "order_status"),
      W("SELECT order_id, order_status FROM v_orders_slim WHERE order_status IN ('returned', 'cancelled')",
        "v_orders_slim"))

_proj("flt_any_negative", "Rows where any of four inventory quantities is negative (OR-reduction).",
      lambda cat: cat.table("inventory").filter(X.any_negative("stock_on_hand", "units_received", "units_sold",
                                                               "days_of_supply")).select("product_id", "snapshot_date"),
      W(f"SELECT product_id, {D('snapshot_date')} AS snapshot_date FROM v_inventory WHERE stock_on_hand < 0 "
        "OR units_received < 0 OR units_sold < 0 OR days_of_supply < 0", "v_inventory"))

_proj("flt_dropna_subset", "Drop customers NULL in any of gender / age group / channel.",
      lambda cat: cat.table("customers").dropna(subset=["gender", "age_group", "acquisition_channel"])
      .select("customer_id"),
      W("SELECT customer_id FROM v_customers WHERE gender IS NOT NULL AND age_group IS NOT NULL "
        "AND acquisition_channel IS NOT NULL", "v_customers"))

_proj("prj_reorder_subset", "Fixed output column list (reordered projection of payments).",
      lambda cat: cat.table("payments").select("installments", "order_id", "payment_method"),
      W("SELECT installments, order_id, payment_method FROM v_payments", "v_payments"))

SAMPLE_ROWS = 5000  # the sample's size is the feature here

_proj("prj_sample_rows", "Deterministic sample of SAMPLE_ROWS rows: order by md5(key), key (same rows in any engine).",
      lambda cat: cat.table("orders_slim").select("order_id", "order_status")
      .orderBy(F.md5(F.col("order_id").cast("string")), "order_id").limit(SAMPLE_ROWS),
      W(f"SELECT order_id, order_status FROM v_orders_slim ORDER BY md5(CAST(order_id AS VARCHAR)), order_id LIMIT {SAMPLE_ROWS}",
        "v_orders_slim"))

# -- joins ----------------------------------------------------------------------------------------
_proj("join_left_lookup", "Order lines LEFT JOIN projected products (category, cogs).",
      lambda cat: J.left_lookup(cat.table("order_items").select("order_id", "product_id", "quantity"),
                                cat.table("products"), "product_id", ["category", "cogs"]),
      W(f"SELECT i.order_id, i.product_id, i.quantity, p.category, {R('p.cogs')} AS cogs FROM v_order_items i "
        "LEFT JOIN v_products p USING (product_id)", "v_order_items", "v_products"))

_proj("join_inner", "Orders INNER JOIN shipments (shipped orders only).",
      lambda cat: cat.table("orders_slim").join(cat.table("shipments"), "order_id", "inner")
      .select("order_id", "order_status", "ship_date"),
      W(f"SELECT order_id, order_status, {D('ship_date')} AS ship_date FROM v_orders_slim JOIN v_shipments "
        "USING (order_id)", "v_orders_slim", "v_shipments"))

_proj("join_anti_fk", "Order lines whose product is absent from products (left anti on distinct keys).",
      lambda cat: J.anti_fk(cat.table("order_items"), "product_id", cat.table("products"), "product_id")
      .agg(F.count(F.lit(1)).alias("orphans")),
      W("SELECT count(*) AS orphans FROM v_order_items WHERE product_id IS NOT NULL AND product_id NOT IN "
        "(SELECT product_id FROM v_products WHERE product_id IS NOT NULL)", "v_order_items", "v_products"))

_proj("join_semi_flag", "Customer membership flag: has any returned line.",
      lambda cat: J.semi_flag(cat.table("customers").select("customer_id"),
                              cat.table("returns").join(cat.table("orders_slim"), "order_id").select("customer_id"),
                              "customer_id", "has_return"),
      W("""SELECT customer_id, customer_id IN (SELECT o.customer_id FROM v_returns r JOIN v_orders_slim o USING (order_id))
           AS has_return FROM v_customers""", "v_customers", "v_returns", "v_orders_slim"))

_proj("join_indicator", "Left join with both / left_only marker, counted.",
      lambda cat: J.with_indicator(cat.table("orders_slim").select("order_id"), cat.table("shipments"), "order_id")
      .groupBy("_merge").agg(F.count(F.lit(1)).alias("orders")),
      W("""SELECT CASE WHEN s.order_id IS NOT NULL THEN 'both' ELSE 'left_only' END AS _merge, count(*) AS orders
           FROM v_orders_slim o LEFT JOIN (SELECT DISTINCT order_id FROM v_shipments) s USING (order_id) GROUP BY 1""",
        "v_orders_slim", "v_shipments"))

_proj("join_suffix", "Orders LEFT JOIN payments with the clashing column suffixed.",
      lambda cat: cat.table("orders_slim").select("order_id", "payment_method").join(
          J.suffix_columns(cat.table("payments").select("order_id", "payment_method"), ["order_id"], "_payment"),
          "order_id", "left"),
      W("SELECT o.order_id, o.payment_method, p.payment_method AS payment_method_payment FROM v_orders_slim o "
        "LEFT JOIN v_payments p USING (order_id)", "v_orders_slim", "v_payments"))

_proj("join_scalar_broadcast", "Every order compared with the global last order day (one-row aggregate, broadcast).",
      lambda cat: J.with_scalars(cat.table("orders_slim").select("order_id", "order_date"),
                                 cat.table("orders_slim").agg(F.max("order_date").alias("_end")))
      .select("order_id", F.datediff("_end", "order_date").alias("days_before_end")),
      W("SELECT order_id, CAST(date_diff('day', order_date, (SELECT max(order_date) FROM v_orders_slim)) AS BIGINT) "
        "AS days_before_end FROM v_orders_slim", "v_orders_slim"))

_proj("join_lag_self", "Revenue 364 days earlier via an equi self-join on the shifted date.",
      lambda cat: J.lag_by_date(cat.table("sales").select("Date", "Revenue"), [], "Date", "Revenue", 364,
                                "revenue_lag_364"),
      W(f"SELECT {D('a.Date')} AS Date, {R('a.Revenue')} AS Revenue, {R('b.Revenue')} AS revenue_lag_364 "
        "FROM v_sales a LEFT JOIN v_sales b ON b.Date + 364 = a.Date", "v_sales"))

_proj("join_forecast_template", "Forecast template LEFT JOIN last-year actuals (t - 365).",
      lambda cat: cat.table("sample_submission").select("Date").join(
          cat.table("sales").select(F.date_add("Date", 365).alias("Date"), F.col("Revenue").alias("revenue_ly")),
          "Date", "left"),
      W(f"SELECT {D('t.Date')} AS Date, {R('s.Revenue')} AS revenue_ly FROM (SELECT CAST(unnest(generate_series("
        "max(order_date) + 1, max(order_date) + 548, INTERVAL 1 DAY)) AS DATE) AS Date FROM v_orders_slim) t "
        "LEFT JOIN v_sales s ON s.Date + 365 = t.Date", "v_sales", "v_orders_slim"))

# -- aggregates -----------------------------------------------------------------------------------
_proj("agg_conditional_count", "Orders per month by status via count_if.",
      lambda cat: cat.table("orders_slim").groupBy(X.month_trunc("order_date").alias("month_start")).agg(
          *[F.count_if(F.col("order_status") == s).alias(f"{s}_orders") for s in ("delivered", "returned", "cancelled")]),
      W(f"SELECT {D(chr(67) + 'AST(date_trunc(' + chr(39) + 'month' + chr(39) + ', order_date) AS DATE)')} AS month_start, "
        + ", ".join(f"count(*) FILTER (WHERE order_status = '{s}') AS {s}_orders"
                    for s in ("delivered", "returned", "cancelled")) + " FROM v_orders_slim GROUP BY 1", "v_orders_slim"))

_proj("agg_distinct", "Distinct customers and products per month.",
      lambda cat: cat.table("orders_slim").join(cat.table("order_items"), "order_id").groupBy(
          X.month_trunc("order_date").alias("month_start")).agg(
          F.count_distinct("customer_id").alias("customers"), F.count_distinct("product_id").alias("products")),
      W(f"SELECT {D(chr(67) + 'AST(date_trunc(' + chr(39) + 'month' + chr(39) + ', order_date) AS DATE)')} AS month_start, "
        "count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products "
        "FROM v_orders_slim JOIN v_order_items USING (order_id) GROUP BY 1", "v_orders_slim", "v_order_items"))

_proj("agg_global_row", "One-row totals of the order fact.",
      lambda cat: FX.order_fact(cat).agg(F.count(F.lit(1)).alias("orders"),
                                         F.sum("net_revenue").alias("net_revenue"),
                                         F.avg("total_quantity").alias("avg_items"),
                                         F.max("order_date").alias("last_order_date")),
      W(f"SELECT count(*) AS orders, {R('sum(net_revenue)')} AS net_revenue, {R('avg(total_quantity)')} AS avg_items, "
        f"{D('max(order_date)')} AS last_order_date FROM v_order_fact", "v_order_fact"))

_proj("agg_value_counts", "Frequency table of order source (NULL kept), descending.",
      lambda cat: A.value_counts(cat.table("orders_slim"), "order_source", "orders"),
      W("SELECT order_source, count(*) AS orders FROM v_orders_slim GROUP BY 1", "v_orders_slim"))

_proj("agg_median_quantiles", "Exact p25/p50/p75/p90/p95/p99 and IQR of order net revenue.",
      lambda cat: __import__("kartlane.operators.windows", fromlist=["x"]).exact_percentiles(
          FX.order_fact(cat), "net_revenue", {f"p{int(round(p * 100))}": p for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)})
      .withColumn("iqr", F.col("p75") - F.col("p25")),
      W("SELECT " + ", ".join(f"{R(f'quantile_cont(net_revenue, {p})')} AS p{int(round(p * 100))}"
                              for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
        + f", {R('quantile_cont(net_revenue, 0.75) - quantile_cont(net_revenue, 0.25)')} AS iqr FROM v_order_fact",
        "v_order_fact"))

_GP = {f"p{int(round(q * 100))}": q for q in (0.25, 0.5, 0.9, 0.99)}
_proj("agg_grouped_percentiles", "Exact p25/p50/p90/p99 of three order values by status, all groups and columns in one rank search.",
      lambda cat: __import__("kartlane.operators.percentiles", fromlist=["x"]).exact(
          FX.order_fact(cat), ["order_status"], ["net_revenue", "shipping_fee", "payment_value"], _GP),
      W(" UNION ALL ".join(f"""SELECT order_status, '{c}' AS "column", count({c}) AS count, """
                           + ", ".join(f"{R(f'quantile_cont({c}, {q})')} AS {n}" for n, q in _GP.items())
                           + " FROM v_order_fact GROUP BY 1" for c in ("net_revenue", "shipping_fee", "payment_value")), "v_order_fact"))

_proj("agg_describe_percentiles", "describe(percentiles 1/5/50/95/99) of shipment lags and fee, long form.",
      lambda cat: A.describe_long(
          __import__("kartlane.operators.business", fromlist=["x"]).shipment_lag(
              cat.table("shipments"), cat.table("orders_slim")), ["ship_lag_days", "delivery_lag_days", "shipping_fee"]),
      W(" UNION ALL ".join(
          f"""SELECT '{c}' AS "column", count(x) AS count, {R('avg(x)')} AS mean, {R('stddev_samp(x)')} AS std,
              {R('min(x)')} AS min, {R('quantile_cont(x, 0.01)')} AS p1, {R('quantile_cont(x, 0.05)')} AS p5,
              {R('quantile_cont(x, 0.5)')} AS p50, {R('quantile_cont(x, 0.95)')} AS p95,
              {R('quantile_cont(x, 0.99)')} AS p99, {R('max(x)')} AS max
              FROM (SELECT CAST({e} AS DOUBLE) AS x FROM v_shipments s LEFT JOIN v_orders_slim o USING (order_id))"""
          for c, e in (("ship_lag_days", "date_diff('day', o.order_date, s.ship_date)"),
                       ("delivery_lag_days", "date_diff('day', s.ship_date, s.delivery_date)"),
                       ("shipping_fee", "s.shipping_fee"))), "v_shipments", "v_orders_slim"))

_CM = ["payment_value", "net_revenue", "gross_revenue"]
_proj("agg_corr_matrix", "Pearson correlation of payment / net / gross revenue for every pair.",
      lambda cat: A.corr_matrix(__import__("kartlane.operators.quality", fromlist=["x"]).payment_proxy_check(
          FX.order_revenue(cat), cat.table("payments")), _CM),
      W(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS corr FROM ("
                           "SELECT p.payment_value, r.net_revenue, r.gross_revenue FROM (SELECT order_id, "
                           "sum(net_item_value) AS net_revenue, sum(gross_item_value) AS gross_revenue FROM v_item_values "
                           "GROUP BY 1) r RIGHT JOIN v_orders_slim o USING (order_id) FULL OUTER JOIN (SELECT order_id, "
                           "sum(payment_value) AS payment_value FROM v_payments GROUP BY 1) p USING (order_id))"
                           for a in _CM for b in _CM), "v_item_values", "v_orders_slim", "v_payments"))
REGISTRY["agg_corr"] = REGISTRY["agg_corr_matrix"].__class__(
    "agg_corr", REGISTRY["agg_corr_matrix"].build, REGISTRY["agg_corr_matrix"].sql, "Pairwise Pearson correlation.")

_proj("agg_histogram", "80-bin histogram of order net revenue.",
      lambda cat: A.histogram(FX.order_fact(cat), "net_revenue", 80),
      W(__import__("kartlane.plans.oracle", fromlist=["x"]).hist_sql("v_order_fact", "net_revenue", 80, []),
        "v_order_fact"))

_proj("agg_share_within_group", "Category share of yearly revenue (x / group sum window).",
      lambda cat: (__import__("kartlane.operators.business", fromlist=["x"]).product_seasonality(
          cat.table("item_values"), cat.table("orders_slim")).groupBy("year", "category")
          .agg(F.sum("revenue").alias("revenue"))
          .withColumn("share", A.share_within("revenue", ["year"]))),
      W(f"""SELECT CAST(year AS BIGINT) AS year, category, {R('revenue')} AS revenue,
                   {R('revenue / nullif(sum(revenue) OVER (PARTITION BY year), 0)')} AS share
            FROM (SELECT year, category, sum(revenue) AS revenue FROM v_prod_seasonality GROUP BY 1, 2)""",
        "v_prod_seasonality"))

_proj("agg_argmax_group", "Best and worst category by revenue per year (max_by / min_by).",
      lambda cat: (__import__("kartlane.operators.business", fromlist=["x"]).product_seasonality(
          cat.table("item_values"), cat.table("orders_slim")).groupBy("year", "category")
          .agg(F.sum("revenue").alias("revenue")).groupBy("year")
          .agg(F.max_by("category", F.struct("revenue", "category")).alias("best_category"),
               F.min_by("category", F.struct("revenue", "category")).alias("worst_category"))),
      W("""SELECT CAST(year AS BIGINT) AS year, arg_max(category, revenue) AS best_category,
                  arg_min(category, revenue) AS worst_category
           FROM (SELECT year, category, sum(revenue) AS revenue FROM v_prod_seasonality GROUP BY 1, 2) GROUP BY 1""",
        "v_prod_seasonality"))

# -- windows / sorts / sets -----------------------------------------------------------------------
_proj("win_row_number", "Order sequence number per customer by (date, order id); hot-key safe "
                        "(month buckets + per-customer month prefix).",
      lambda cat: __import__("kartlane.operators.windows", fromlist=["x"]).row_number_in_key(
          cat.table("orders_slim").select("customer_id", "order_id", "order_date"), "customer_id", "order_date",
          "order_id", "order_rank").select("order_id", "order_rank"),
      W("SELECT order_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS order_rank "
        "FROM v_orders_slim", "v_orders_slim"))

_proj("win_backfill", "Monthly features with backfilled leading NULLs (first non-null of the rest).",
      lambda cat: __import__("kartlane.operators.features", fromlist=["x"]).monthly_features(
          __import__("kartlane.operators.features", fromlist=["x"]).monthly_panel(
              FX.order_fact(cat), FX.customer_fact(cat), FX.inventory_fact(cat)), backfill=True)
      .select("month", "rev_lag_1", "orders_lag_1"),
      W(f"""SELECT {D('month')} AS month,
            {R('first(rl IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS rev_lag_1,
            first(ol IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS orders_lag_1
            FROM (SELECT month, lag(revenue) OVER (ORDER BY month) AS rl, lag(orders) OVER (ORDER BY month) AS ol FROM
                  (SELECT order_month AS month, coalesce(sum(net_revenue), 0.0) AS revenue,
                          count(DISTINCT order_id) AS orders FROM v_order_fact GROUP BY 1))""", "v_order_fact"))

_proj("win_group_head", "Top 3 products by revenue within each category (row_number <= 3).",
      lambda cat: __import__("kartlane.operators.windows", fromlist=["x"]).group_head(
          cat.table("item_values").groupBy("category", "product_id").agg(F.sum("net_item_value").alias("revenue")),
          ["category"], [F.desc("revenue"), F.asc("product_id")], 3),
      W(f"""SELECT category, product_id, {R('revenue')} AS revenue FROM (
              SELECT category, product_id, sum(net_item_value) AS revenue,
                     row_number() OVER (PARTITION BY category ORDER BY sum(net_item_value) DESC, product_id) AS rn
              FROM v_item_values GROUP BY 1, 2) WHERE rn <= 3""", "v_item_values"))

_proj("win_duplicate_flag", "Later duplicates of (product, snapshot) flagged by row_number > 1, counted.",
      lambda cat: cat.table("inventory").withColumn(
          "dup", __import__("kartlane.operators.windows", fromlist=["x"]).duplicate_flag(
              ["product_id", "snapshot_date"], ["units_sold"])).agg(F.count_if("dup").alias("duplicate_rows")),
      W("SELECT count(*) - count(DISTINCT (product_id, snapshot_date)) AS duplicate_rows FROM v_inventory",
        "v_inventory"))

_proj("sort_multi_mixed", "Category sales ordered by revenue desc, category asc.",
      lambda cat: __import__("kartlane.operators.business", fromlist=["x"]).category_sales(cat.table("item_values"))
      .orderBy(F.desc("revenue"), F.asc("category"), F.asc("segment")).select("category", "segment", "revenue"),
      W(f"SELECT category, segment, {R('sum(net_item_value)')} AS revenue FROM v_item_values GROUP BY 1, 2 "
        "ORDER BY sum(net_item_value) DESC, category, segment", "v_item_values"))

_proj("topk_head", "Top 10 customers by net revenue (TakeOrderedAndProject).",
      lambda cat: FX.order_fact(cat).groupBy("customer_id").agg(F.sum("net_revenue").alias("net_revenue"))
      .orderBy(F.desc("net_revenue"), "customer_id").limit(10),
      W(f"SELECT customer_id, {R('sum(net_revenue)')} AS net_revenue FROM v_order_fact GROUP BY 1 "
        "ORDER BY sum(net_revenue) DESC NULLS LAST, customer_id LIMIT 10", "v_order_fact"))

_proj("set_union_all", "Signup, order and return events unioned by name into one activity table, counted.",
      lambda cat: cat.table("customers").select(F.col("signup_date").alias("event_date"), F.lit("signup").alias("kind"))
      .unionByName(cat.table("orders_slim").select(F.col("order_date").alias("event_date"), F.lit("order").alias("kind")))
      .unionByName(cat.table("returns").select(F.col("return_date").alias("event_date"), F.lit("return").alias("kind")))
      .groupBy("kind").agg(F.count(F.lit(1)).alias("events")),
      W("""SELECT kind, count(*) AS events FROM (SELECT 'signup' AS kind FROM v_customers UNION ALL
           SELECT 'order' FROM v_orders_slim UNION ALL SELECT 'return' FROM v_returns) GROUP BY 1""",
        "v_customers", "v_orders_slim", "v_returns"))

_proj("set_distinct", "Distinct (customer, order month) pairs.",
      lambda cat: cat.table("orders_slim").select("customer_id", X.month_trunc("order_date").alias("order_month"))
      .distinct(),
      W(f"SELECT DISTINCT customer_id, {D(chr(67) + 'AST(date_trunc(' + chr(39) + 'month' + chr(39) + ', order_date) AS DATE)')} "
        "AS order_month FROM v_orders_slim", "v_orders_slim"))


def _register_aliases():
    for new, old in ALIASES.items():
        if new in REGISTRY or old not in REGISTRY:
            continue
        q = REGISTRY[old]
        REGISTRY[new] = q.__class__(new, q.build, q.sql, f"{q.doc} (primitive {new}; same plan as {old})",
                                    q.significant)


_register_aliases()
