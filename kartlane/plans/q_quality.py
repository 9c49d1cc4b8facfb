"""Data-quality queries with oracle SQL."""

from __future__ import annotations

from kartlane.operators import quality as Q
from kartlane.operators.facts import order_revenue
from kartlane.plans.oracle import D, R, with_views as W
from kartlane.plans.registry import register
from kartlane.sources.catalog import DATE_COLUMNS, FOREIGN_KEYS, KEY_COLUMNS, SCHEMAS

PROFILED = ["sales", "customers", "geography", "products", "inventory", "web_traffic", "order_items",
            "orders", "payments", "reviews", "returns", "shipments", "promotions", "sample_submission"]

def _cols(t):
    return [tuple(x.strip().split(" ")) for x in SCHEMAS[t].split(",")]


def _tables(cat):
    return {n: cat.table(n) for n in PROFILED}


_TS_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, count(*) AS rows, CAST({len(_cols(t))} AS BIGINT) AS columns,
        CAST({' + '.join(f'(count(*) - count("{c}"))' for c, _ in _cols(t))} AS BIGINT) AS missing_cells,
        {R(f"coalesce(CAST({' + '.join(f'(count(*) - count({chr(34)}{c}{chr(34)}))' for c, _ in _cols(t))} AS DOUBLE) / nullif(CAST(count(*) * {len(_cols(t))} AS DOUBLE), 0), 0.0)")} AS missing_pct,
        count(*) - count(DISTINCT ({', '.join(f'"{c}"' for c, _ in _cols(t))})) AS duplicate_rows
        FROM v_{t}""" for t in PROFILED)


@register("dq_table_summary", W(_TS_SQL, *[f"v_{t}" for t in PROFILED]))
def dq_table_summary(cat):
    """table_summary: rows, columns, missing cells/%, duplicate rows per table."""
    return Q.table_summary(_tables(cat))


def _col_sql(t, c, dtype):
    q = f'"{c}"'
    if dtype == "double":
        num, txt, disp = (f"CAST({q} AS DOUBLE)", "CAST(NULL AS VARCHAR)",
                          f"CAST(CAST(CAST({q} AS DECIMAL(38,9)) AS DECIMAL(38,4)) AS VARCHAR)")
    elif dtype in ("bigint", "int"):
        num, txt, disp = f"CAST({q} AS DOUBLE)", "CAST(NULL AS VARCHAR)", f"CAST({q} AS VARCHAR)"
    elif dtype == "date":
        num, txt, disp = "CAST(NULL AS DOUBLE)", f"strftime({q}, '%Y-%m-%d')", f"strftime({q}, '%Y-%m-%d')"
    else:
        num, txt, disp = "CAST(NULL AS DOUBLE)", q, q
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{dtype}' AS dtype,
        count({q}) AS non_null, count(*) - count({q}) AS missing,
        {R(f'CAST(count(*) - count({q}) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0)')} AS missing_pct,
        (SELECT count(*) FROM (SELECT DISTINCT {num} AS n, {txt} AS x FROM v_{t} WHERE {q} IS NOT NULL)) AS "unique",
        coalesce((SELECT string_agg(d, ', ' ORDER BY n NULLS FIRST, x NULLS FIRST, d) FROM (
            SELECT n, x, min(d) AS d FROM (SELECT {num} AS n, {txt} AS x, {disp} AS d FROM v_{t}
                                           WHERE {q} IS NOT NULL) GROUP BY n, x
            ORDER BY n NULLS FIRST, x NULLS FIRST LIMIT 3)), '') AS sample_values
        FROM v_{t}"""


@register("dq_column_summary", W(" UNION ALL ".join(_col_sql(t, c, d) for t in PROFILED for c, d in _cols(t)),
                                 *[f"v_{t}" for t in PROFILED]))
def dq_column_summary(cat):
    """column_summary: dtype, non-null, missing, %, unique, 3 smallest distinct values."""
    return Q.column_summary(_tables(cat))


_MISS_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name,
        CAST({' + '.join(f'(count(*) - count("{c}"))' for c, _ in _cols(t))} AS BIGINT) AS missing_cells,
        CAST(count(*) * {len(_cols(t))} AS BIGINT) AS cells FROM v_{t}""" for t in PROFILED)


@register("dq_missing_by_table", W(
    f"SELECT table_name, missing_cells, cells, {R('CAST(missing_cells AS DOUBLE) / nullif(CAST(cells AS DOUBLE), 0)')} "
    f"AS missing_pct FROM ({_MISS_SQL})", *[f"v_{t}" for t in PROFILED]))
def dq_missing_by_table(cat):
    """Missing % per table re-aggregated from the column profile."""
    return Q.missing_by_table(Q.column_summary(_tables(cat)))


@register("dq_duplicate_keys", W(" UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{", ".join(k)}' AS key_columns, count(*) AS rows,
        count(*) - count(DISTINCT ({", ".join(k)})) AS duplicate_key_rows,
        {R(f"coalesce(CAST(count(*) - count(DISTINCT ({', '.join(k)})) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0)")} AS duplicate_key_pct
        FROM v_{t}""" for t, k in KEY_COLUMNS.items()), *[f"v_{t}" for t in KEY_COLUMNS]))
def dq_duplicate_keys(cat):
    """duplicate_key_report over the keyed tables."""
    return Q.duplicate_key_report({n: cat.table(n) for n in KEY_COLUMNS})


@register("dq_relationships", W(" UNION ALL ".join(
    f"""SELECT '{lt}.{lc}' AS left_key, '{rt}.{rc}' AS right_key, count(*) AS checked_rows,
        count(*) FILTER (WHERE {lc} NOT IN (SELECT {rc} FROM v_{rt} WHERE {rc} IS NOT NULL)) AS unmatched_rows,
        {R(f"coalesce(CAST(count(*) FILTER (WHERE {lc} NOT IN (SELECT {rc} FROM v_{rt} WHERE {rc} IS NOT NULL)) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0)")} AS unmatched_pct
        FROM v_{lt} WHERE {lc} IS NOT NULL""" for lt, lc, rt, rc in FOREIGN_KEYS),
    *sorted({f"v_{x}" for lt, _, rt, _ in FOREIGN_KEYS for x in (lt, rt)})))
def dq_relationships(cat):
    """relationship_checks: 11 FK links via left-anti joins."""
    names = {x for lt, _, rt, _ in FOREIGN_KEYS for x in (lt, rt)}
    return Q.relationship_checks({n: cat.table(n) for n in names})


_DC = [(t, c) for t, cols in DATE_COLUMNS.items() if t in PROFILED for c in cols]


@register("dq_date_coverage", W(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS date_column, {D(f'min({c})')} AS min_date, {D(f'max({c})')} AS max_date, "
    f"count(*) - count({c}) AS missing_dates FROM v_{t}" for t, c in _DC), *sorted({f"v_{t}" for t, _ in _DC})))
def dq_date_coverage(cat):
    """date_coverage: min / max / missing per date column."""
    return Q.date_coverage({t: cat.table(t) for t, _ in _DC})


@register("dq_channel_nullness", W(f"""
    SELECT 'acquisition_channel' AS column_name, count(*) AS rows,
           count(*) FILTER (WHERE acquisition_channel IS NULL) AS missing_rows,
           count(*) FILTER (WHERE trim(acquisition_channel) = '') AS blank_rows,
           count(*) FILTER (WHERE acquisition_channel IS NULL OR trim(acquisition_channel) = '') AS missing_or_blank_rows,
           {R("CAST(count(*) FILTER (WHERE acquisition_channel IS NULL OR trim(acquisition_channel) = '') AS DOUBLE) / CAST(count(*) AS DOUBLE)")} AS missing_or_blank_pct,
           count(DISTINCT acquisition_channel) AS unique_non_null_channels
    FROM v_customers""", "v_customers"))
def dq_channel_nullness(cat):
    """acquisition_channel_nullness: missing, blank, both, %, distinct channels."""
    return Q.channel_nullness(cat.table("customers"))


@register("dq_snapshot_coverage", W(f"""
    SELECT {D('s.snapshot_month')} AS snapshot_month, m.product_month_rows IS NOT NULL AS has_snapshot,
           CAST(coalesce(m.snapshot_dates, 0) AS BIGINT) AS snapshot_dates,
           CAST(coalesce(m.product_month_rows, 0) AS BIGINT) AS product_month_rows,
           CAST(coalesce(m.unique_products, 0) AS BIGINT) AS unique_products,
           CAST(coalesce(m.dups, 0) AS BIGINT) AS duplicate_product_snapshot_rows
    FROM (SELECT CAST(unnest(generate_series(min(date_trunc('month', snapshot_date)),
                                             max(date_trunc('month', snapshot_date)), INTERVAL 1 MONTH)) AS DATE)
                 AS snapshot_month FROM v_inventory) s
    LEFT JOIN (SELECT CAST(date_trunc('month', snapshot_date) AS DATE) AS snapshot_month,
                      count(DISTINCT snapshot_date) AS snapshot_dates, count(*) AS product_month_rows,
                      count(DISTINCT product_id) AS unique_products,
                      count(*) - count(DISTINCT (product_id, snapshot_date)) AS dups
               FROM v_inventory GROUP BY 1) m USING (snapshot_month)""", "v_inventory"))
def dq_snapshot_coverage(cat):
    """inventory_snapshot_coverage on a full month spine."""
    return Q.snapshot_coverage(cat.table("inventory"))


_RULES_SQL = {
    "snapshot_date_is_month_end": "snapshot_date <> last_day(snapshot_date)",
    "year_matches_snapshot_date": "year <> year(snapshot_date)",
    "month_matches_snapshot_date": "month <> month(snapshot_date)",
    "stockout_flag_matches_stockout_days": "(stockout_flag = 1) <> (stockout_days > 0)",
    "stockout_days_within_month_length": "stockout_days < 0 OR stockout_days > day(last_day(snapshot_date))",
    "fill_rate_between_0_and_1": "NOT (fill_rate BETWEEN 0 AND 1)",
    "sell_through_rate_between_0_and_1": "NOT (sell_through_rate BETWEEN 0 AND 1)",
    "nonnegative_quantity_metrics": "stock_on_hand < 0 OR units_received < 0 OR units_sold < 0 OR days_of_supply < 0",
    "product_attributes_match_products": "p.product_id IS NULL OR coalesce(i.product_name <> p.product_name, TRUE) "
                                         "OR coalesce(i.category <> p.category, TRUE) OR coalesce(i.segment <> p.segment, TRUE)",
}


def _inv_checks_sql(with_products: bool) -> str:
    parts = []
    for i, (name, desc) in enumerate(Q.INVENTORY_RULES):
        if name == "product_attributes_match_products" and not with_products:
            continue
        if name == "unique_product_month_snapshot":
            bad = "count(*) - count(DISTINCT (i.product_id, i.snapshot_date))"
        else:
            bad = f"count(*) FILTER (WHERE coalesce({_RULES_SQL[name]}, TRUE))"
        src = ("v_inventory i LEFT JOIN v_products p ON i.product_id = p.product_id" if with_products
               else "v_inventory i")
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS rule_order, '{name}' AS check_name, ({bad}) = 0 AS passed,
            count(*) AS rows_checked, CAST({bad} AS BIGINT) AS invalid_rows,
            {R(f'coalesce(CAST({bad} AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0)')} AS invalid_pct,
            '{desc}' AS description FROM {src}""")
    return " UNION ALL ".join(parts)


@register("dq_inventory_checks", W(_inv_checks_sql(True), "v_inventory", "v_products"))
def dq_inventory_checks(cat):
    """inventory_schema_quality_checks: 10 rules incl. product attribute match."""
    return Q.inventory_checks(cat.table("inventory"), cat.table("products"))


@register("dq_inventory_checks_alias", W(_inv_checks_sql(False), "v_inventory"))
def dq_inventory_checks_alias(cat):
    """Compatibility wrapper: the 9 rules without the products table."""
    return Q.inventory_checks(cat.table("inventory"))


_OREV = """(SELECT o.order_id, a.net_revenue, a.gross_revenue FROM v_orders_slim o LEFT JOIN (
            SELECT order_id, sum(net_item_value) AS net_revenue, sum(gross_item_value) AS gross_revenue
            FROM v_item_values GROUP BY order_id) a USING (order_id))"""
_PCHK = f"""(SELECT coalesce(r.order_id, p.order_id) AS order_id, r.net_revenue, r.gross_revenue, p.payment_value,
             p.payment_value - r.net_revenue AS payment_minus_net_revenue,
             p.payment_value - r.gross_revenue AS payment_minus_gross_revenue
             FROM {_OREV} r FULL OUTER JOIN (SELECT order_id, sum(payment_value) AS payment_value
                                             FROM v_payments GROUP BY order_id) p USING (order_id))"""


@register("dq_payment_proxy_check", W(
    f"SELECT order_id, {R('net_revenue')} AS net_revenue, {R('gross_revenue')} AS gross_revenue, "
    f"{R('payment_value')} AS payment_value, {R('payment_minus_net_revenue')} AS payment_minus_net_revenue, "
    f"{R('payment_minus_gross_revenue')} AS payment_minus_gross_revenue FROM {_PCHK}",
    "v_orders_slim", "v_item_values", "v_payments"))
def dq_payment_proxy_check(cat):
    """Order-level payment vs net / gross revenue differences (full outer join)."""
    return Q.payment_proxy_check(order_revenue(cat), cat.table("payments")).select(
        "order_id", "net_revenue", "gross_revenue", "payment_value", "payment_minus_net_revenue",
        "payment_minus_gross_revenue")


@register("dq_payment_proxy_summary", W(f"""
    SELECT count(*) FILTER (WHERE payment_value IS NOT NULL AND net_revenue IS NOT NULL) AS orders_compared,
           {R("corr(CASE WHEN net_revenue IS NOT NULL THEN payment_value END, CASE WHEN payment_value IS NOT NULL THEN net_revenue END)")} AS corr_payment_net_revenue,
           {R("CAST(count(*) FILTER (WHERE abs(payment_minus_net_revenue) <= 0.01) AS DOUBLE) / CAST(count(*) AS DOUBLE)")} AS exact_or_near_match_pct,
           {R("avg(payment_minus_net_revenue)")} AS mean_difference,
           {R("quantile_cont(payment_minus_net_revenue, 0.5)")} AS median_difference,
           {R("max(abs(payment_minus_net_revenue))")} AS max_abs_difference
    FROM {_PCHK}""", "v_orders_slim", "v_item_values", "v_payments"))
def dq_payment_proxy_summary(cat):
    """payment_revenue_proxy_summary: compared, corr, share within 0.01, diff stats."""
    return Q.payment_proxy_summary(order_revenue(cat), cat.table("payments"))


@register("dq_missing_dates", W(f"""
    SELECT {D('d')} AS order_date FROM (
      SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS d
      FROM v_orders_slim) WHERE d NOT IN (SELECT order_date FROM v_orders_slim)""", "v_orders_slim"))
def dq_missing_dates(cat):
    """Calendar days without any order (calendar minus observed days)."""
    return Q.missing_dates(cat.table("orders_slim").select("order_date"), "order_date")


@register("dq_series_guards", W(f"""
    SELECT count(*) AS rows, count(*) FILTER (WHERE Date IS NULL) AS null_dates,
           count(Date) - count(DISTINCT Date) AS duplicate_dates,
           count(*) FILTER (WHERE Revenue IS NULL) AS null_Revenue, count(*) FILTER (WHERE COGS IS NULL) AS null_COGS,
           {D('min(Date)')} AS first_date, {D('max(Date)')} AS last_date,
           CAST(date_diff('day', min(Date), max(Date)) + 1 - count(DISTINCT Date) AS BIGINT) AS gap_days
    FROM v_sales""", "v_sales"))
def dq_series_guards(cat):
    """Daily series guards: null / duplicate dates, null targets, gaps (0 expected)."""
    return Q.series_guards(cat.table("sales"), "Date", ["Revenue", "COGS"])


# report -> the registered query with the same rows
REPORT_QUERIES = {
    "eda_table_summary": "dq_table_summary", "eda_column_summary": "dq_column_summary",
    "eda_duplicate_key_report": "dq_duplicate_keys", "eda_relationship_checks": "dq_relationships",
    "eda_date_coverage": "dq_date_coverage", "eda_customer_acquisition_channel_nullness": "dq_channel_nullness",
    "eda_customer_cohorts": "q_cohort_summary", "eda_revenue_seasonality": "q_revenue_seasonality",
    "eda_product_seasonality": "q_product_seasonality", "eda_inventory_status_summary": "q_inventory_status",
    "eda_inventory_category_fill_rate_lost_unit_proxy": "q_lost_units",
    "eda_inventory_snapshot_coverage": "dq_snapshot_coverage",
    "eda_inventory_schema_quality_checks": "dq_inventory_checks", "eda_payment_revenue_proxy": "dq_payment_proxy_summary",
}


DERIVED = ["inventory", "reviews", "shipments", "orders", "sales", "web_traffic"]   # no plain projections of the driver's tables


@register("snk_reports")
def snk_reports(cat):
    """write_eda_reports: the EDA report tables written by name; returns name + row count."""
    import uuid
    from pyspark.sql import functions as F
    from kartlane.plans.reports import output_root, read_version, write_reports
    from kartlane.session import scratch
    from kartlane.operators.business import revenue_seasonality, cohort_summary
    from kartlane.operators.business import inventory_status, lost_units, product_seasonality
    root = f"{output_root(cat.spark)}/reports_{uuid.uuid4().hex[:8]}"
    # what takes a join or an aggregate of the lines is derived once for all reports
    with scratch() as put:
        cat = cat.derive({n: put(cat.table(n)) for n in DERIVED if cat.derived(n)})
        tables = _tables(cat)
        orev = put(order_revenue(cat))
        reports = {
            "eda_column_summary": Q.column_summary(tables),
            "eda_date_coverage": Q.date_coverage(tables),
            "eda_customer_acquisition_channel_nullness": Q.channel_nullness(cat.table("customers")),
            "eda_product_seasonality": product_seasonality(cat.table("item_values"), cat.table("orders_slim")),
            "eda_inventory_status_summary": inventory_status(cat.table("inventory")),
            "eda_inventory_category_fill_rate_lost_unit_proxy": lost_units(cat.table("inventory")),
            "eda_table_summary": Q.table_summary(tables),
            "eda_duplicate_key_report": Q.duplicate_key_report({n: cat.table(n) for n in KEY_COLUMNS}),
            "eda_relationship_checks": Q.relationship_checks({n: cat.table(n) for n in PROFILED}),
            "eda_customer_cohorts": cohort_summary(cat.table("customers")),
            "eda_revenue_seasonality": revenue_seasonality(orev),
            "eda_inventory_snapshot_coverage": Q.snapshot_coverage(cat.table("inventory")),
            "eda_inventory_schema_quality_checks": Q.inventory_checks(cat.table("inventory"), cat.table("products")),
            "eda_payment_revenue_proxy": Q.payment_proxy_summary(orev, cat.table("payments")),
        }
        write_reports(reports, root)
    parts = [df.agg(F.lit(n).alias("report"), F.count(F.lit(1)).alias("rows")) for n, df in read_version(cat.spark, root).items()]
    return Q.union_all(parts)
