"""Supply-side, inventory and daily-series profile queries with oracle SQL."""

from __future__ import annotations

from kartlane.operators import business as B
from kartlane.operators import facts as FX
from kartlane.operators import supply as SP
from kartlane.plans.oracle import D, R, hist_sql, select_final as S, with_views as W
from kartlane.plans.registry import register


def _sh(a, b):
    return R(f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)")


_INV_STATUS = f"""
    SELECT snapshot_month, product_month_rows, unique_products, stockout_product_months, overstock_product_months,
           reorder_product_months, total_stockout_days, {R('avg_stockout_days')} AS avg_stockout_days,
           {R('avg_fill_rate')} AS avg_fill_rate, {R('median_fill_rate')} AS median_fill_rate,
           {R('avg_days_of_supply')} AS avg_days_of_supply, {R('median_days_of_supply')} AS median_days_of_supply,
           {R('avg_sell_through_rate')} AS avg_sell_through_rate, {R('avg_stock_on_hand')} AS avg_stock_on_hand,
           total_units_received, total_units_sold,
           {_sh('stockout_product_months', 'product_month_rows')} AS stockout_product_month_rate,
           {_sh('overstock_product_months', 'product_month_rows')} AS overstock_product_month_rate,
           {_sh('reorder_product_months', 'product_month_rows')} AS reorder_product_month_rate,
           {_sh('total_stockout_days', 'product_month_rows')} AS stockout_days_per_product_month
    FROM (SELECT {D("CAST(date_trunc('month', snapshot_date) AS DATE)")} AS snapshot_month,
                 count(*) AS product_month_rows, count(DISTINCT product_id) AS unique_products,
                 sum(stockout_flag)::BIGINT AS stockout_product_months, sum(overstock_flag)::BIGINT AS overstock_product_months,
                 sum(reorder_flag)::BIGINT AS reorder_product_months, sum(stockout_days)::BIGINT AS total_stockout_days,
                 avg(stockout_days) AS avg_stockout_days, avg(fill_rate) AS avg_fill_rate,
                 median(fill_rate) AS median_fill_rate, avg(days_of_supply) AS avg_days_of_supply,
                 median(days_of_supply) AS median_days_of_supply, avg(sell_through_rate) AS avg_sell_through_rate,
                 avg(stock_on_hand) AS avg_stock_on_hand, sum(units_received)::BIGINT AS total_units_received,
                 sum(units_sold)::BIGINT AS total_units_sold
          FROM v_inventory GROUP BY 1)"""


@register("q_inventory_status", W(_INV_STATUS, "v_inventory"))
def q_inventory_status(cat):
    """15 monthly inventory metrics + 4 rates."""
    return B.inventory_status(cat.table("inventory"))


_LOST = """(SELECT category, count(*) AS product_month_rows, count(DISTINCT product_id) AS unique_products,
                   sum(stockout_flag)::BIGINT AS stockout_product_months, sum(stockout_days)::BIGINT AS total_stockout_days,
                   avg(fill_rate) AS avg_fill_rate, median(fill_rate) AS median_fill_rate,
                   sum(units_sold)::BIGINT AS total_units_sold,
                   coalesce(sum(units_sold * (1.0 - CASE WHEN fill_rate > 0 THEN fill_rate END)
                                / CASE WHEN fill_rate > 0 THEN fill_rate END), 0.0) AS lost_unit_sold_proxy,
                   sum(units_sold * fill_rate) / nullif(CAST(sum(units_sold) AS DOUBLE), 0) AS units_weighted_avg_fill_rate
            FROM v_inventory GROUP BY category)"""


@register("q_lost_units", W(f"""
    SELECT category, product_month_rows, unique_products, stockout_product_months, total_stockout_days,
           {R('avg_fill_rate')} AS avg_fill_rate, {R('median_fill_rate')} AS median_fill_rate, total_units_sold,
           {R('lost_unit_sold_proxy')} AS lost_unit_sold_proxy,
           {R('units_weighted_avg_fill_rate')} AS units_weighted_avg_fill_rate,
           {R('total_units_sold + lost_unit_sold_proxy')} AS estimated_unconstrained_units,
           {R('lost_unit_sold_proxy / nullif(total_units_sold + lost_unit_sold_proxy, 0)')} AS lost_unit_sold_proxy_share,
           {R('total_units_sold / nullif(total_units_sold + lost_unit_sold_proxy, 0)')} AS unit_weighted_fill_rate,
           {_sh('stockout_product_months', 'product_month_rows')} AS stockout_product_month_rate
    FROM {_LOST}""", "v_inventory"))
def q_lost_units(cat):
    """Per category lost units u(1-f)/f, unconstrained units, both fill definitions."""
    return B.lost_units(cat.table("inventory"))


@register("q_stock_by_group", W(f"""
    SELECT category, segment, count(*) AS product_month_rows, sum(stockout_flag)::BIGINT AS stockout_product_months,
           sum(overstock_flag)::BIGINT AS overstock_product_months, {R('avg(fill_rate)')} AS avg_fill_rate,
           {R('avg(days_of_supply)')} AS avg_days_of_supply, sum(units_sold)::BIGINT AS total_units_sold,
           {_sh('sum(stockout_flag)', 'count(*)')} AS stockout_product_month_rate,
           {_sh('sum(overstock_flag)', 'count(*)')} AS overstock_product_month_rate
    FROM v_inventory GROUP BY 1, 2""", "v_inventory"))
def q_stock_by_group(cat):
    """Stockout / overstock rates by category x segment."""
    return B.stock_by_group(cat.table("inventory"))


@register("q_stockout_examples", W(f"""
    SELECT {D('snapshot_date')} AS snapshot_date, product_id, product_name, category, segment, stockout_days,
           units_sold, stock_on_hand, {R('fill_rate')} AS fill_rate FROM v_inventory WHERE stockout_flag = 1""",
    "v_inventory"))
def q_stockout_examples(cat):
    """Flagged stockout rows, projected."""
    return B.stockout_examples(cat.table("inventory"))


@register("q_category_unit_share", W(f"""
    SELECT category, total_units_sold, {R('lost_unit_sold_proxy')} AS lost_unit_sold_proxy,
           {R('units_weighted_avg_fill_rate')} AS units_weighted_avg_fill_rate,
           {_sh('total_units_sold', 'sum(total_units_sold) OVER ()')} AS unit_share,
           {R('lost_unit_sold_proxy / nullif(sum(lost_unit_sold_proxy) OVER (), 0)')} AS lost_unit_share,
           row_number() OVER (ORDER BY total_units_sold DESC, category) AS units_rank,
           {_sh('total_units_sold', 'lead(total_units_sold) OVER (ORDER BY total_units_sold DESC, category)')} AS units_ratio_to_next
    FROM {_LOST}""", "v_inventory"))
def q_category_unit_share(cat):
    """Share of units and lost units per category, fill weighted by units, ratio to runner-up."""
    return B.category_unit_share(cat.table("inventory"))


_PER = f"CASE WHEN year >= {SP.PERIOD_CUT_YEAR} THEN 'Recent' ELSE 'Past' END"


@register("q_stockout_heatmap", W(f"""
    SELECT category, {_PER} AS period, CAST(month AS BIGINT) AS month, {R('avg(stockout_flag)')} AS stockout_rate
    FROM v_inventory_fact GROUP BY 1, 2, 3""", "v_inventory_fact"))
def q_stockout_heatmap(cat):
    """Mean stockout flag by category x period x month (long)."""
    return SP.stockout_heatmap(FX.inventory_fact(cat))


@register("q_stockout_heatmap_wide", W(
    "SELECT category, " + ", ".join(
        f"{R(f'max(r) FILTER (WHERE pm = {chr(39)}{p}_{m:02d}{chr(39)})')} AS \"{p}_{m:02d}\""
        for p in ("Past", "Recent") for m in range(1, 13)) + f"""
    FROM (SELECT category, {_PER} || '_' || lpad(CAST(month AS VARCHAR), 2, '0') AS pm, avg(stockout_flag) AS r
          FROM v_inventory_fact GROUP BY 1, 2) GROUP BY category""", "v_inventory_fact"))
def q_stockout_heatmap_wide(cat):
    """Heatmap matrix: category x (period, month), pivot on the concatenated label."""
    return SP.stockout_heatmap_wide(FX.inventory_fact(cat))


_CELLS = """(SELECT category, segment, avg(stockout_flag) AS stockout_rate, avg(overstock_flag) AS overstock_rate,
                    sum(units_sold)::BIGINT AS total_volume FROM v_inventory_fact GROUP BY 1, 2)"""


@register("q_risk_matrix", W(f"""
    SELECT category, segment, {R('stockout_rate')} AS stockout_rate, {R('overstock_rate')} AS overstock_rate,
           total_volume, {R('ms')} AS median_stockout_rate, {R('mo')} AS median_overstock_rate,
           CASE WHEN stockout_rate > ms AND NOT overstock_rate > mo THEN 'UNDER-STOCKED'
                WHEN stockout_rate > ms AND overstock_rate > mo THEN 'POOR PLANNING'
                WHEN NOT stockout_rate > ms AND NOT overstock_rate > mo THEN 'HEALTHY'
                ELSE 'OVER-STOCKED' END AS quadrant
    FROM {_CELLS} c CROSS JOIN (SELECT median(stockout_rate) AS ms, median(overstock_rate) AS mo FROM {_CELLS}) m""",
    "v_inventory_fact"))
def q_risk_matrix(cat):
    """Stockout / overstock rate and volume by category x segment with quadrant label."""
    return SP.risk_matrix(FX.inventory_fact(cat))


_LONG = f"""(SELECT category, segment, 'stockout_rate' AS metric, stockout_rate AS rate FROM {_CELLS}
             UNION ALL SELECT category, segment, 'overstock_rate', overstock_rate FROM {_CELLS})"""


@register("q_risk_distribution", W(f"""
    SELECT h.*, {R('s.mean_rate')} AS mean_rate, {R('s.median_rate')} AS median_rate
    FROM ({hist_sql(_LONG, 'rate', 15, ['metric'])}) h
    LEFT JOIN (SELECT metric, avg(rate) AS mean_rate, median(rate) AS median_rate FROM {_LONG} GROUP BY 1) s
    USING (metric)""", "v_inventory_fact"))
def q_risk_distribution(cat):
    """Mean / median and 15-bin histogram of the risk-cell rates."""
    return SP.risk_distribution(FX.inventory_fact(cat))


@register("q_fill_vs_demand", W(f"""
    SELECT category, total_units_sold, {R('avg_fill_rate')} AS avg_fill_rate,
           {R('avg_stockout_days')} AS avg_stockout_days, {R('mu')} AS median_units_sold, {R('mf')} AS median_fill_rate,
           CASE WHEN total_units_sold > mu AND avg_fill_rate > mf THEN 'HIGH DEMAND / LOW SUPPLY RISK'
                WHEN NOT total_units_sold > mu AND avg_fill_rate > mf THEN 'LOW DEMAND / LOW SUPPLY RISK'
                WHEN total_units_sold > mu AND NOT avg_fill_rate > mf THEN 'HIGH DEMAND / SUPPLY CONSTRAINT'
                ELSE 'LOW DEMAND / LOW PRIORITY' END AS quadrant
    FROM (SELECT category, sum(units_sold)::BIGINT AS total_units_sold, avg(fill_rate) AS avg_fill_rate,
                 avg(stockout_days) AS avg_stockout_days FROM v_inventory_fact GROUP BY 1) c
    CROSS JOIN (SELECT median(total_units_sold) AS mu, median(avg_fill_rate) AS mf FROM (
                  SELECT category, sum(units_sold) AS total_units_sold, avg(fill_rate) AS avg_fill_rate
                  FROM v_inventory_fact GROUP BY 1)) m""", "v_inventory_fact"))
def q_fill_vs_demand(cat):
    """Units, average fill, stockout days by category with median quadrant label."""
    return SP.fill_vs_demand(FX.inventory_fact(cat))


@register("q_overview_monthly", W(f"""
    SELECT {D('s.month')} AS month, sg.signups, o.orders, {R('o.net_sales')} AS net_sales,
           {R('i.stockout_prevalence')} AS stockout_prevalence
    FROM (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM (
            SELECT CAST(date_trunc('month', signup_date) AS DATE) AS month FROM v_customer_fact
            UNION ALL SELECT order_month FROM v_order_fact UNION ALL SELECT snapshot_month FROM v_inventory_fact)) s
    LEFT JOIN (SELECT CAST(date_trunc('month', signup_date) AS DATE) AS month, count(*) AS signups
               FROM v_customer_fact GROUP BY 1) sg USING (month)
    LEFT JOIN (SELECT order_month AS month, count(*) AS orders, coalesce(sum(net_revenue), 0.0) AS net_sales
               FROM v_order_fact GROUP BY 1) o USING (month)
    LEFT JOIN (SELECT snapshot_month AS month, avg(stockout_flag) AS stockout_prevalence
               FROM v_inventory_fact GROUP BY 1) i USING (month)""",
    "v_customer_fact", "v_order_fact", "v_inventory_fact"))
def q_overview_monthly(cat):
    """Monthly signups, orders, sales, stockout prevalence on one month spine."""
    of = FX.order_fact(cat)
    return SP.overview_monthly(FX.customer_fact(cat), of, FX.inventory_fact(cat))


@register("q_month_shape_by_year", W(f"""
    SELECT CAST(year(Date) AS BIGINT) AS year, CAST(month(Date) AS BIGINT) AS month, {R('avg(Revenue)')} AS avg_revenue
    FROM v_sales GROUP BY 1, 2""", "v_sales"))
def q_month_shape_by_year(cat):
    """Monthly average revenue by year (year x month matrix in long form)."""
    return SP.month_shape_by_year(cat.table("sales"))


@register("q_dow_dom_profile", W(f"""
    SELECT 'dayofweek' AS profile, CAST(isodow(Date) - 1 AS BIGINT) AS key, {R('avg(Revenue)')} AS avg_revenue
    FROM v_sales GROUP BY 2
    UNION ALL
    SELECT 'day', CAST(day(Date) AS BIGINT), {R('avg(Revenue)')} FROM v_sales GROUP BY 2""", "v_sales"))
def q_dow_dom_profile(cat):
    """Average revenue by weekday (Mon=0) and by day of month."""
    return SP.dow_dom_profile(cat.table("sales"))


@register("q_odd_even_profile", W(f"""
    SELECT CAST(year(Date) % 2 AS BIGINT) AS is_odd_year, CAST(month(Date) AS BIGINT) AS month,
           {R('avg(Revenue)')} AS avg_revenue FROM v_sales GROUP BY 1, 2""", "v_sales"))
def q_odd_even_profile(cat):
    """Average revenue by year parity x month."""
    return SP.odd_even_profile(cat.table("sales"))


@register("q_quarterly_cogs_ratio", W(f"""
    SELECT CAST(year(Date) AS BIGINT) AS year, CAST(quarter(Date) AS BIGINT) AS quarter, {R('sum(Revenue)')} AS revenue,
           {R('sum(COGS)')} AS cogs, {R('sum(COGS) / nullif(sum(Revenue), 0)')} AS margin
    FROM v_sales GROUP BY 1, 2""", "v_sales"))
def q_quarterly_cogs_ratio(cat):
    """Quarterly COGS / Revenue ratio (second half of the odd/even profile)."""
    return SP.quarterly_cogs_ratio(cat.table("sales"))


@register("q_daily_profit", W(f"""
    SELECT {D('Date')} AS Date, {R('Revenue - COGS')} AS profit, Revenue - COGS >= 0 AS is_profitable
    FROM v_sales""", "v_sales"))
def q_daily_profit(cat):
    """Revenue - COGS per day and its sign."""
    return SP.daily_profit(cat.table("sales"))


_ERA = "(SELECT CASE WHEN year(Date) < {0} THEN 'early' WHEN year(Date) < {1} THEN 'growth' " \
       "WHEN year(Date) < {2} THEN 'transition' ELSE 'recent' END AS era, Revenue FROM v_sales)".format(*SP.ERA_BOUNDS)


@register("q_era_distribution", W(hist_sql(_ERA, "Revenue", 50, ["era"], density=True), "v_sales"),
          significant=("density",))
def q_era_distribution(cat):
    """Revenue density histogram (50 bins) per era."""
    return SP.era_distribution(cat.table("sales"))
