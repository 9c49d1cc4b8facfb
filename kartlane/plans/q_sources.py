"""Sources: catalog reads, load-all, projected scans, inline dims, spines."""

from __future__ import annotations

from pyspark.sql import functions as F

from kartlane.plans.oracle import D, I, R, with_views
from kartlane.plans.registry import register
from kartlane.sources.catalog import TABLE_NAMES
from kartlane.sources.inline import promotions_schedule

_STANDIN_COLS = {
    "customers": "customer_id, zip, city, {signup_date}, gender, age_group, acquisition_channel",
    "products": "product_id, product_name, category, segment, size, color, {price}, {cogs}",
    "geography": "zip, city, region, district",
    "orders": "order_id, {order_date}, customer_id, zip, order_status, payment_method, device_type, order_source",
    "order_items": "order_id, product_id, quantity, {unit_price}, {discount_amount}, promo_id, promo_id_2",
    "payments": "order_id, payment_method, {payment_value}, installments",
    "shipments": "order_id, {ship_date}, {delivery_date}, {shipping_fee}",
    "returns": "return_id, order_id, product_id, {return_date}, return_reason, return_quantity, {refund_amount}",
    "reviews": "review_id, order_id, product_id, customer_id, {review_date}, rating, review_title",
    "inventory": ("{snapshot_date}, product_id, stock_on_hand, units_received, units_sold, stockout_days, "
                  "{days_of_supply}, {fill_rate}, CAST(stockout_flag AS BIGINT) AS stockout_flag, "
                  "CAST(overstock_flag AS BIGINT) AS overstock_flag, CAST(reorder_flag AS BIGINT) AS reorder_flag, "
                  "{sell_through_rate}, product_name, category, segment, CAST(year AS BIGINT) AS year, "
                  "CAST(month AS BIGINT) AS month"),
    "sales": "{Date}, {Revenue}, {COGS}",
    "sample_submission": "{Date}, {Revenue}, {COGS}",
    "promotions": ("promo_id, promo_name, promo_type, {discount_value}, {start_date}, {end_date}, applicable_category, "
                   "promo_channel, CAST(stackable_flag AS BIGINT) AS stackable_flag, {min_order_value}"),
    "web_traffic": ("{date}, sessions, unique_visitors, page_views, {bounce_rate}, {avg_session_duration_sec}, "
                    "traffic_source"),
}
_DATES = {"signup_date", "order_date", "ship_date", "delivery_date", "return_date", "review_date",
          "snapshot_date", "Date", "date", "start_date", "end_date"}


def _select_list(spec: str) -> str:
    import re

    def sub(m):
        c = m.group(1)
        return f"{D(c)} AS {c}" if c in _DATES else f"{R(c)} AS {c}"
    return re.sub(r"\{(\w+)\}", sub, spec)


def _make_table_query(name: str):
    def build(cat):
        return cat.table(name)
    build.__doc__ = f"Stand-in table {name} read through the catalog (src_read_table)."
    sql = with_views(f"SELECT {_select_list(_STANDIN_COLS[name])} FROM v_{name}", f"v_{name}")
    register(f"src_table_{name}", sql)(build)


for _n in _STANDIN_COLS:
    _make_table_query(_n)


@register("src_read_table", with_views(
    f"SELECT order_id, {D('order_date')} AS order_date, customer_id, order_status FROM v_orders_slim",
    "v_orders_slim"))
def src_read_table(cat):
    """read_table('orders') projected: column pruning reaches the scan."""
    return cat.table("orders_slim").select("order_id", "order_date", "customer_id", "order_status")


_LOAD_ALL = list(TABLE_NAMES)


@register("src_load_all", with_views(
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM v_{n}" for n in _LOAD_ALL),
    *[f"v_{n}" for n in _LOAD_ALL]))
def src_load_all(cat):
    """load_all_tables: every retail table as a lazy frame; one row count each."""
    tables = cat.load_all()
    parts = [tables[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n in _LOAD_ALL]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("src_projected_scan", with_views(
    f"SELECT order_id, {D('order_date')} AS order_date, {R('payment_value')} AS payment_value "
    "FROM v_orders_slim JOIN v_payments USING (order_id, payment_method)", "v_orders_slim", "v_payments"))
def src_projected_scan(cat):
    """Schema'd read + select with explicit date columns."""
    return (cat.table("orders_slim").join(cat.table("payments"), ["order_id", "payment_method"], "inner")
            .select("order_id", "order_date", "payment_value"))


@register("src_inline_dim", f"""
    WITH yrs AS (SELECT unnest(range(CAST(min(year(o_orderdate)) - 1 AS BIGINT),
                                     CAST(max(year(o_orderdate)) + 2 AS BIGINT))) AS y FROM orders),
    camp(campaign, sm, sd, dur, disc, rec) AS (VALUES
      ('spring_sale', 3, 18, 30, 12.0, 'yearly'), ('mid_year', 6, 23, 29, 18.0, 'yearly'),
      ('fall_launch', 8, 30, 32, 10.0, 'yearly'), ('year_end', 11, 18, 45, 20.0, 'yearly'),
      ('urban_blowout', 7, 30, 33, NULL, 'odd'), ('rural_special', 1, 30, 30, 15.0, 'odd'))
    SELECT campaign || '_' || CAST(y AS VARCHAR) AS promo_id, campaign AS promo_name,
           CASE WHEN coalesce(disc, 0) > 0 THEN 'percentage' ELSE 'fixed' END AS promo_type,
           {R("CASE WHEN coalesce(disc, 0) > 0 THEN disc ELSE 50.0 END")} AS discount_value,
           {D("make_date(y, sm, sd)")} AS start_date,
           {D("make_date(y, sm, sd) + dur")} AS end_date,
           CAST(NULL AS VARCHAR) AS applicable_category, CAST(NULL AS VARCHAR) AS promo_channel,
           CAST(0 AS BIGINT) AS stackable_flag, CAST(NULL AS DOUBLE) AS min_order_value
    FROM yrs CROSS JOIN camp WHERE rec <> 'odd' OR y % 2 = 1""")
def src_inline_dim(cat):
    """Literal promotion schedule expanded over the data's years (promotions)."""
    return promotions_schedule(cat.spark, cat.table("orders_slim"), "order_date")


@register("src_date_spine", with_views(
    f"SELECT {D('Date')} AS Date, {R('Revenue')} AS Revenue, {R('COGS')} AS COGS FROM v_sales", "v_sales"))
def src_date_spine(cat):
    """Gap-free daily spine left-joined to daily revenue (sales)."""
    return cat.table("sales")


@register("src_derived_scan", with_views(
    f"SELECT order_id, {D('order_date')} AS order_date, {D('order_month')} AS order_month, customer_id, "
    f"{R('net_revenue')} AS net_revenue, {I("date_diff('day', order_month, order_date)")} AS day_of_month0 FROM v_order_fact",
    "v_order_fact"))
def src_derived_scan(cat):
    """Write the order fact as Parquet in the shared checkpoint folder and re-read it."""
    from kartlane.plans.reports import write_and_read_fact
    return write_and_read_fact(cat)



# faults that ``src_read_files`` writes into the files: (table, column, text, rows it stands in)
_FAULTS = [("orders", "order_date", "n/a", "order_id % 97 = 3"), ("orders", "customer_id", "12x", "order_id % 89 = 5"),
           ("payments", "payment_value", "1,5", "order_id % 101 = 7"), ("customers", "signup_date", "1994", "customer_id % 37 = 2"),
           ("shipments", "ship_date", "1995-02-30", "order_id % 103 = 1"), ("products", "price", "free", "product_id % 41 = 4")]


def _faulty(table):
    own = [w for t, _, _, w in _FAULTS if t == table]
    return " OR ".join(f"coalesce({w}, false)" for w in own) if own else "false"


@register("src_read_files", with_views(
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, 'clean' AS what, NULL AS reason, count(*) FILTER (WHERE NOT ({_faulty(n)})) AS rows FROM v_{n}"
                       for n in _LOAD_ALL)
    + "".join(f" UNION ALL SELECT * FROM (SELECT '{t}', '{c}', '" + ("not a date" if "date" in c else "not a bigint" if c.endswith("_id") else "not a double")
              + f"', count(*) AS rows FROM v_{t} WHERE {w}) WHERE rows > 0" for t, c, _, w in _FAULTS), *[f"v_{n}" for n in _LOAD_ALL]))
def src_read_files(cat):
    """The 14 tables written as CSV with planted faults and read back: clean rows, and quarantined ones by column and reason."""
    import uuid
    from kartlane.plans.reports import output_root
    from kartlane.sources.catalog import SCHEMAS, read_checked
    root = f"{output_root(cat.spark)}/files_{uuid.uuid4().hex[:8]}"
    parts = []
    for n in _LOAD_ALL:
        names = [f.name for f in cat.spark.createDataFrame([], SCHEMAS[n]).schema.fields]
        df = cat.table(n).select(*names).select(*[F.col(c).cast("string") for c in names])
        for t, c, text, where in _FAULTS:
            if t == n:
                df = df.withColumn(c, F.when(F.coalesce(F.expr(where.replace("order_id", "cast(order_id as bigint)")), F.lit(False)), F.lit(text)).otherwise(F.col(c)))
        df.write.option("header", True).csv(f"{root}/{n}.csv")
        parts.append(read_checked(cat.spark, n, f"{root}/{n}.csv").counts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
