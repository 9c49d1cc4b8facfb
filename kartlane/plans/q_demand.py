"""Demand-side queries."""

from __future__ import annotations

from kartlane.operators import demand as DM
from kartlane.operators import facts as FX
from kartlane.plans.oracle import D, R, with_views as W
from kartlane.plans.registry import register

def _cf(cat):
    return FX.customer_fact(cat)


def _facts(cat):
    of, cf = FX.order_fact(cat), FX.customer_fact(cat)
    return cf, of, FX.cohort_activity(cat, of, cf)


_CNT = """(SELECT count(DISTINCT customer_id) AS total,
                  count(*) FILTER (WHERE coalesce(orders_count, 0) >= 1) AS ordered,
                  count(*) FILTER (WHERE coalesce(orders_count, 0) = 1) AS one_time,
                  count(*) FILTER (WHERE coalesce(orders_count, 0) >= 2) AS repeat FROM v_customer_fact)"""


def _sh(a, b):
    return R(f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)")


@register("q_funnel", W(f"""
    SELECT CAST(stage_order AS BIGINT) AS stage_order, stage, parent_stage, CAST(customers AS BIGINT) AS customers,
           {_sh('customers', 'parent')} AS share_of_parent, {_sh('customers', 'total')} AS share_of_all_customers
    FROM (SELECT c.total, v.* FROM {_CNT} c, LATERAL (VALUES
           (1, 'All Customers', CAST(NULL AS VARCHAR), c.total, c.total),
           (2, 'No Order', 'All Customers', c.total - c.ordered, c.total),
           (3, 'Ordered Customers', 'All Customers', c.ordered, c.total),
           (4, 'One-time Buyers', 'Ordered Customers', c.one_time, c.ordered),
           (5, 'Repeat Buyers', 'Ordered Customers', c.repeat, c.ordered)) v(stage_order, stage, parent_stage, customers, parent))
    """, "v_customer_fact"))
def q_funnel(cat):
    """All -> no order / ordered -> one-time / repeat with parent and total shares."""
    return DM.funnel(_cf(cat))


@register("q_funnel_links", W(f"""
    SELECT source, target, CAST(customers AS BIGINT) AS customers, CAST(source_customers AS BIGINT) AS source_customers,
           {_sh('customers', 'source_customers')} AS share_of_parent, {_sh('customers', 'total')} AS share_of_all_customers
    FROM (SELECT c.total, v.* FROM {_CNT} c, LATERAL (VALUES
           ('All Customers', 'Ordered Customers', c.ordered, c.total),
           ('Ordered Customers', 'One-time Buyers', c.one_time, c.ordered),
           ('Ordered Customers', 'Repeat Buyers', c.repeat, c.ordered),
           ('All Customers', 'No Order', c.total - c.ordered, c.total)) v(source, target, customers, source_customers))
    """, "v_customer_fact"))
def q_funnel_links(cat):
    """Source -> target link table of the funnel."""
    return DM.funnel_links(_cf(cat))


@register("q_leakage", W(f"""
    SELECT leakage_point, leakage_definition, CAST(leakage_customers AS BIGINT) AS leakage_customers,
           base_population, CAST(base_customers AS BIGINT) AS base_customers,
           {_sh('leakage_customers', 'base_customers')} AS normalized_leakage_rate,
           {_sh('leakage_customers', 'total')} AS share_of_all_customers,
           {R("round_even(CAST(leakage_customers AS DOUBLE) / nullif(CAST(base_customers AS DOUBLE), 0) * 1000.0, 1)")} AS customers_per_1k_base
    FROM (SELECT c.total, v.* FROM {_CNT} c, LATERAL (VALUES
           ('No Order', 'Signed up, but has no order so far', c.total - c.ordered, 'All Customers', c.total),
           ('One-time Buyers', 'Bought once and has not come back', c.one_time, 'Ordered Customers', c.ordered))
          v(leakage_point, leakage_definition, leakage_customers, base_population, base_customers))
    """, "v_customer_fact"))
def q_leakage(cat):
    """Normalised leakage rate per leakage point, and per 1k of its base."""
    return DM.leakage(_cf(cat))


@register("dq_funnel_checks", W(f"""
    SELECT {_sh("count(*) FILTER (WHERE c.customer_id IS NOT NULL)", "count(*)")} AS customer_order_join_coverage_pct,
           count(*) FILTER (WHERE c.customer_id IS NULL) AS orders_with_missing_customer_dim_key,
           (SELECT count(*) FILTER (WHERE signup_date IS NULL) FROM v_customer_fact) AS customers_with_missing_signup_date,
           (SELECT {_sh("count(*) FILTER (WHERE signup_date IS NULL)", "count(*)")} FROM v_customer_fact) AS customers_with_missing_signup_date_pct,
           (SELECT total - ordered FROM {_CNT}) AS no_order_customers_count,
           (SELECT {_sh("total - ordered", "total")} FROM {_CNT}) AS no_order_customers_pct,
           (SELECT ordered FROM {_CNT}) AS ordered_customers_count,
           (SELECT one_time FROM {_CNT}) AS one_time_buyers_count,
           (SELECT repeat FROM {_CNT}) AS repeat_buyers_count,
           (SELECT one_time + repeat = ordered FROM {_CNT}) AS buyer_split_reconciles_flag
    FROM v_order_fact o LEFT JOIN (SELECT DISTINCT customer_id FROM v_customer_fact) c USING (customer_id)
    """, "v_customer_fact", "v_order_fact"))
def dq_funnel_checks(cat):
    """Order->customer join coverage, missing signup, buyer split reconciles."""
    cf, of, _ = _facts(cat)
    return DM.funnel_checks(cf, of)


@register("dq_cohort_anchor", W(f"""
    SELECT count(*) AS customers_with_orders, count(first_order_date) AS customers_with_first_order,
           count(*) FILTER (WHERE signup_date IS NULL) AS missing_signup_date,
           count(*) FILTER (WHERE first_order_date < signup_date) AS signup_after_first_order,
           {_sh("count(*) FILTER (WHERE first_order_date < signup_date)", "count(*)")} AS pct_signup_after_first_order
    FROM v_customer_fact""", "v_customer_fact"))
def dq_cohort_anchor(cat):
    """Share of customers whose first order precedes signup (NULL dates -> false)."""
    return DM.cohort_anchor(_cf(cat))


_SIZES = """(SELECT CAST(date_trunc('month', first_order_date) AS DATE) AS cohort_month,
                    count(DISTINCT customer_id) AS cohort_size
             FROM v_customer_fact WHERE first_order_date IS NOT NULL GROUP BY 1)"""
_RET = f"""(SELECT a.cohort_month, a.cohort_index, a.active_customers, s.cohort_size,
                   CAST(a.active_customers AS DOUBLE) / nullif(CAST(s.cohort_size AS DOUBLE), 0) AS retention_rate,
                   strftime(a.cohort_month, '%b') AS cohort_start_month
            FROM (SELECT first_order_cohort_month AS cohort_month, cohort_index,
                         count(DISTINCT customer_id) AS active_customers
                  FROM v_cohort_activity GROUP BY 1, 2) a LEFT JOIN {_SIZES} s USING (cohort_month))"""


@register("q_cohort_sizes", W(f"SELECT {D('cohort_month')} AS cohort_month, cohort_size FROM {_SIZES}",
                              "v_customer_fact"))
def q_cohort_sizes(cat):
    """First-order cohort sizes by month."""
    return DM.cohort_sizes(_cf(cat))


@register("q_retention", W(f"""
    SELECT {D('cohort_month')} AS cohort_month, CAST(cohort_index AS BIGINT) AS cohort_index, active_customers,
           cohort_size, {R('retention_rate')} AS retention_rate, cohort_start_month FROM {_RET}""",
    "v_cohort_activity", "v_customer_fact"))
def q_retention(cat):
    """Cohort month x index active customers / cohort size."""
    cf, _, act = _facts(cat)
    return DM.retention(cf, act)


_BUCK = f"""(SELECT *, CASE WHEN cohort_index < 24 THEN CAST(cohort_index AS VARCHAR) ELSE '24+' END AS cohort_index_bucket,
                    least(cohort_index, 24) AS bucket_order FROM {_RET})"""


@register("q_retention_month_of_year", W(f"""
    SELECT CAST(month(cohort_month) AS BIGINT) AS month_of_year, cohort_start_month, cohort_index_bucket,
           CAST(bucket_order AS BIGINT) AS bucket_order, {R('avg(retention_rate)')} AS mean_retention_rate,
           count(DISTINCT cohort_month) AS cohorts
    FROM {_BUCK} GROUP BY 1, 2, 3, 4""", "v_cohort_activity", "v_customer_fact"))
def q_retention_month_of_year(cat):
    """Mean retention by first-order month-of-year x index bucket (0..23, 24+)."""
    cf, _, act = _facts(cat)
    return DM.retention_month_of_year(DM.retention(cf, act))


@register("q_retention_month_of_year_wide", W(
    "SELECT month_of_year, " + ", ".join(
        f"{R(f'max(m) FILTER (WHERE cohort_index_bucket = {chr(39)}{b}{chr(39)})')} AS \"{b}\""
        for b in [str(i) for i in range(24)] + ["24+"]) + f"""
    FROM (SELECT CAST(month(cohort_month) AS BIGINT) AS month_of_year, cohort_index_bucket, avg(retention_rate) AS m
          FROM {_BUCK} GROUP BY 1, 2) GROUP BY month_of_year""", "v_cohort_activity", "v_customer_fact"))
def q_retention_month_of_year_wide(cat):
    """Wide heatmap view: month-of-year x 25 buckets (explicit pivot values)."""
    cf, _, act = _facts(cat)
    return DM.retention_wide(DM.retention_month_of_year(DM.retention(cf, act)), ["month_of_year"])


@register("q_retention_year", W(f"""
    SELECT CAST(year(cohort_month) AS BIGINT) AS cohort_year, cohort_index_bucket,
           CAST(bucket_order AS BIGINT) AS bucket_order, {R('avg(retention_rate)')} AS mean_retention_rate,
           count(DISTINCT cohort_month) AS cohorts
    FROM {_BUCK} GROUP BY 1, 2, 3""", "v_cohort_activity", "v_customer_fact"))
def q_retention_year(cat):
    """Mean retention by cohort year x index bucket."""
    cf, _, act = _facts(cat)
    return DM.retention_year(DM.retention(cf, act))


@register("q_retention_milestones", W(f"""
    SELECT {D('cohort_month')} AS cohort_month, CAST(first(cohort_size) AS BIGINT) AS cohort_size,
           {', '.join(f"{R(f'max(retention_rate) FILTER (WHERE cohort_index = {m})')} AS m{m}" for m in (0, 1, 3, 6, 12))}
    FROM {_RET} GROUP BY cohort_month""", "v_cohort_activity", "v_customer_fact"))
def q_retention_milestones(cat):
    """m0, m1, m3, m6, m12 retention per cohort month."""
    cf, _, act = _facts(cat)
    return DM.retention_milestones(DM.retention(cf, act))


_RB = """(SELECT customer_id, first_order_date, second_order_date, coalesce(orders_count, 0) AS orders_count,
                 (coalesce(orders_count, 0) >= 2 OR second_order_date IS NOT NULL) AS is_candidate,
                 date_diff('day', first_order_date, second_order_date) AS gap,
                 (coalesce(orders_count, 0) >= 2 OR second_order_date IS NOT NULL)
                   AND coalesce(date_diff('day', first_order_date, second_order_date) > 0, FALSE) AS is_valid_repeater
          FROM v_customer_fact WHERE first_order_date IS NOT NULL)"""


@register("q_second_purchase_curve", W(f"""
    SELECT CAST(m.d AS BIGINT) AS days_since_first_order,
           (SELECT count(*) FROM {_RB} WHERE is_valid_repeater AND gap <= m.d) AS repeaters,
           {_sh(f"(SELECT count(*) FROM {_RB} WHERE is_valid_repeater AND gap <= m.d)",
                f"(SELECT count(*) FROM {_RB} WHERE is_valid_repeater)")} AS repeaters_share
    FROM (VALUES (7), (14), (30), (60), (90), (180), (365), (730), (1095), (1460)) m(d)""", "v_customer_fact"))
def q_second_purchase_curve(cat):
    """Cumulative share of valid repeaters within 7..1460 days of the first order."""
    return DM.second_purchase_curve(_cf(cat), cat.spark)


@register("q_gap_summary", W(f"""
    SELECT count(*) AS repeat_buyers_candidates, count(*) FILTER (WHERE gap > 0) AS valid_repeat_gaps_used,
           count(*) FILTER (WHERE NOT coalesce(gap > 0, FALSE)) AS removed_invalid_zero_or_negative_gap,
           {R("quantile_cont(gap, 0.5) FILTER (WHERE gap > 0)")} AS median_days,
           {R("quantile_cont(gap, 0.75) FILTER (WHERE gap > 0) - quantile_cont(gap, 0.25) FILTER (WHERE gap > 0)")} AS iqr_days,
           {R("quantile_cont(gap, 0.75) FILTER (WHERE gap > 0)")} AS p75_days,
           {R("quantile_cont(gap, 0.9) FILTER (WHERE gap > 0)")} AS p90_days
    FROM {_RB} WHERE is_candidate""", "v_customer_fact"))
def q_gap_summary(cat):
    """Repeat-gap candidates, valid, removed, median, IQR, p75, p90."""
    return DM.gap_summary(_cf(cat))


_ELIG = f"""(SELECT b.*, e.p90, e.analysis_end_date,
                    date_diff('day', b.first_order_date, e.analysis_end_date) >= e.p90 AS eligible
             FROM {_RB} b CROSS JOIN (
               SELECT (SELECT quantile_cont(gap, 0.9) FILTER (WHERE gap > 0) FROM {_RB} WHERE is_candidate) AS p90,
                      (SELECT max(order_date) FROM v_order_fact) AS analysis_end_date) e)"""


@register("q_p90_window_check", W(f"""
    SELECT {D('first(analysis_end_date)')} AS analysis_end_date, {R('first(p90)')} AS p90_gap_days,
           count(*) AS purchasers_total, count(*) FILTER (WHERE eligible) AS purchasers_eligible_for_p90_window,
           {_sh("count(*) FILTER (WHERE eligible)", "count(*)")} AS eligible_share,
           {R("avg(CAST(is_valid_repeater AS DOUBLE))")} AS repeat_rate_all_purchasers,
           {R("avg(CASE WHEN eligible THEN CAST(is_valid_repeater AS DOUBLE) END)")} AS repeat_rate_p90_eligible_only
    FROM {_ELIG}""", "v_customer_fact", "v_order_fact"))
def q_p90_window_check(cat):
    """Eligibility (observable window >= p90 gap) and repeat rates all / eligible."""
    cf, of, _ = _facts(cat)
    return DM.p90_window_check(cf, of)


@register("q_cohort_window_check", W(f"""
    SELECT {D('g.m')} AS first_order_cohort_month, purchasers, eligible_for_p90_window, valid_repeaters,
           {_sh('eligible_for_p90_window', 'purchasers')} AS eligibility_rate,
           {_sh('valid_repeaters', 'purchasers')} AS repeat_rate_observed,
           {_sh('valid_repeaters', 'eligible_for_p90_window')} AS repeat_rate_eligible_only,
           {_sh('elig_rep', 'eligible_for_p90_window')} AS repeat_rate_eligible_corrected,
           CAST(h.mx AS BIGINT) AS max_observed_cohort_index
    FROM (SELECT CAST(date_trunc('month', first_order_date) AS DATE) AS m, count(DISTINCT customer_id) AS purchasers,
                 count(*) FILTER (WHERE eligible) AS eligible_for_p90_window,
                 count(*) FILTER (WHERE is_valid_repeater) AS valid_repeaters,
                 count(*) FILTER (WHERE eligible AND is_valid_repeater) AS elig_rep
          FROM {_ELIG} GROUP BY 1) g
    LEFT JOIN (SELECT first_order_cohort_month AS m, max(cohort_index) AS mx FROM v_cohort_activity GROUP BY 1) h
    USING (m)""", "v_customer_fact", "v_order_fact", "v_cohort_activity"))
def q_cohort_window_check(cat):
    """Per-cohort eligibility and repeat rates (workload + corrected variant) and horizon."""
    cf, of, act = _facts(cat)
    return DM.cohort_window_check(cf, of, act)


_CH = """(SELECT acquisition_channel_clean, count(DISTINCT customer_id) AS customer_count,
                 count(*) FILTER (WHERE oc > 0) AS purchaser_count,
                 count(*) FILTER (WHERE oc >= 2) AS repeat_customer_count
          FROM (SELECT customer_id, coalesce(nullif(trim(acquisition_channel), ''), 'Unknown') AS acquisition_channel_clean,
                       coalesce(orders_count, 0) AS oc FROM v_customer_fact) GROUP BY 1)"""
_THR = "(SELECT greatest(50, CAST(floor(count(DISTINCT customer_id) * 0.01) AS BIGINT)) AS t FROM v_customer_fact)"


def _rates_sql():
    return (f"{_sh('repeat_customer_count', 'purchaser_count')} AS repeat_rate, "
            f"{_sh('purchaser_count', 'customer_count')} AS order_rate, "
            f"{_sh('repeat_customer_count', 'customer_count')} AS repeat_rate_all_customers")


@register("q_channel_stats", W(f"""
    SELECT acquisition_channel_clean, customer_count, purchaser_count, repeat_customer_count, {_rates_sql()},
           purchaser_count - repeat_customer_count AS one_time_customer_count FROM {_CH}""", "v_customer_fact"))
def q_channel_stats(cat):
    """Purchasers, repeaters, one-timers and three rates per acquisition channel."""
    return DM.channel_stats(_cf(cat))


@register("q_small_channels", W(f"""
    SELECT acquisition_channel_clean, customer_count, purchaser_count, repeat_customer_count,
           {_sh('repeat_customer_count', 'purchaser_count')} AS repeat_rate
    FROM {_CH} WHERE customer_count < (SELECT t FROM {_THR})""", "v_customer_fact"))
def q_small_channels(cat):
    """Channels under max(50, 1% of customers)."""
    return DM.small_channels(_cf(cat))


_GRP = f"""(SELECT CASE WHEN customer_count >= (SELECT t FROM {_THR}) THEN acquisition_channel_clean ELSE 'Other' END
                   AS channel_grouped, sum(customer_count)::BIGINT AS customer_count,
                   sum(purchaser_count)::BIGINT AS purchaser_count,
                   sum(repeat_customer_count)::BIGINT AS repeat_customer_count,
                   sum(purchaser_count - repeat_customer_count)::BIGINT AS one_time_customer_count
            FROM {_CH} GROUP BY 1)"""


@register("q_channel_grouped", W(f"""
    SELECT channel_grouped, customer_count, purchaser_count, repeat_customer_count, one_time_customer_count,
           {_rates_sql()} FROM {_GRP}""", "v_customer_fact"))
def q_channel_grouped(cat):
    """Small channels folded into 'Other'; rates recomputed from sums."""
    return DM.channel_grouped(_cf(cat))


@register("q_channel_overall", W(f"""
    SELECT {_sh('sum(purchaser_count)', 'sum(customer_count)')} AS overall_order_rate,
           {_sh('sum(repeat_customer_count)', 'sum(purchaser_count)')} AS overall_repeat_rate FROM {_GRP}""",
    "v_customer_fact"))
def q_channel_overall(cat):
    """Overall order and repeat rates across grouped channels."""
    return DM.channel_overall(_cf(cat))


@register("q_channel_rates_long", W(f"""
    SELECT channel_grouped, customer_count, purchaser_count, repeat_customer_count, metric, {R('rate')} AS rate FROM (
      SELECT channel_grouped, customer_count, purchaser_count, repeat_customer_count, 'Customer -> Ordered' AS metric,
             CAST(purchaser_count AS DOUBLE) / nullif(CAST(customer_count AS DOUBLE), 0) AS rate FROM {_GRP}
      UNION ALL
      SELECT channel_grouped, customer_count, purchaser_count, repeat_customer_count, 'Ordered -> Repeat',
             CAST(repeat_customer_count AS DOUBLE) / nullif(CAST(purchaser_count AS DOUBLE), 0) FROM {_GRP})""",
    "v_customer_fact"))
def q_channel_rates_long(cat):
    """order_rate / repeat_rate melted to long form with display labels."""
    return DM.channel_rates_long(_cf(cat))


@register("dq_channel_missingness", W(f"""
    SELECT count(DISTINCT customer_id) AS customers_total,
           count(*) FILTER (WHERE coalesce(trim(acquisition_channel), '') = '') AS missing_or_blank_channel_customers,
           {_sh("count(*) FILTER (WHERE coalesce(trim(acquisition_channel), '') = '')", "count(*)")} AS missing_or_blank_channel_pct
    FROM v_customer_fact""", "v_customer_fact"))
def dq_channel_missingness(cat):
    """Customers with a missing or blank acquisition channel."""
    return DM.channel_missingness(_cf(cat))


_RBASE = """(SELECT customer_id, coalesce(orders_count, 0) AS orders_count, coalesce(net_revenue_proxy, 0.0) AS revenue
             FROM v_customer_fact WHERE first_order_date IS NOT NULL)"""


def _curve_sql(name, col):
    return f"""SELECT '{name}' AS curve, customer_id, rk AS rank, {_sh('rk', 'n')} AS cum_customer_share,
                      {R('cv / nullif(tot, 0)')} AS cum_value_share
               FROM (SELECT customer_id, row_number() OVER (ORDER BY CAST({col} AS DOUBLE) DESC, customer_id) AS rk,
                            sum(CAST({col} AS DOUBLE)) OVER (ORDER BY CAST({col} AS DOUBLE) DESC, customer_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cv,
                            count(*) OVER () AS n, sum(CAST({col} AS DOUBLE)) OVER () AS tot
                     FROM {_RBASE} WHERE revenue > 0)"""


@register("q_revenue_concentration", W(_curve_sql("revenue", "revenue") + " UNION ALL " +
                                       _curve_sql("orders", "orders_count"), "v_customer_fact"))
def q_revenue_concentration(cat):
    """Cumulative customer / revenue (and order-count) share curves — bucketed global rank."""
    return DM.revenue_concentration(_cf(cat))


@register("q_concentration_snapshot", W(f"""
    SELECT first(n) AS customers_in_curve,
           {', '.join(f"{R(f'sum(revenue) FILTER (WHERE rk <= greatest(1, CAST(round_even(n * {p / 100.0!r}, 0) AS BIGINT))) / first(tot)')} AS top_{p}pct_revenue_share" for p in (1, 5, 10, 20))},
           {', '.join(f"{R(f'CAST(min(rk) FILTER (WHERE cv / tot >= {s / 100.0!r}) AS DOUBLE) / CAST(first(n) AS DOUBLE)')} AS customer_share_for_{s}pct_revenue" for s in (50, 75, 90))},
           (SELECT count(*) FROM {_RBASE} WHERE revenue <= 0) AS excluded_non_positive_revenue_customers
    FROM (SELECT customer_id, revenue,
                 row_number() OVER (ORDER BY revenue DESC, customer_id) AS rk,
                 sum(revenue) OVER (ORDER BY revenue DESC, customer_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cv,
                 count(*) OVER () AS n, sum(revenue) OVER () AS tot
          FROM {_RBASE} WHERE revenue > 0) r""", "v_customer_fact"))
def q_concentration_snapshot(cat):
    """Top 1/5/10/20 % revenue shares and customer share needed for 50/75/90 %."""
    return DM.concentration_snapshot(_cf(cat))


@register("dq_revenue_consistency", W(f"""
    SELECT 'net_revenue_proxy' AS revenue_metric_used, {R('sum(revenue)')} AS total_revenue_customer_fact,
           {R('sum(ofr)')} AS total_revenue_order_fact, {R('abs(sum(revenue) - sum(ofr))')} AS absolute_total_gap,
           {R('median(abs(revenue - ofr))')} AS median_abs_customer_gap,
           {R('quantile_cont(abs(revenue - ofr), 0.95)')} AS p95_abs_customer_gap,
           count(*) FILTER (WHERE abs(revenue - ofr) > 1) AS customers_with_abs_gap_gt_1
    FROM (SELECT b.*, coalesce(o.ofr, 0.0) AS ofr FROM {_RBASE} b LEFT JOIN (
            SELECT customer_id, sum(net_revenue_proxy) AS ofr FROM v_order_fact GROUP BY 1) o USING (customer_id))""",
    "v_customer_fact", "v_order_fact"))
def dq_revenue_consistency(cat):
    """Customer-fact vs order-fact revenue per customer: totals, median / p95 gaps."""
    cf, of, _ = _facts(cat)
    return DM.revenue_consistency(cf, of)
