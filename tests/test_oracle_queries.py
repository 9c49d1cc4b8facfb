"""Spark result == DuckDB twin (exact, after the shared rounding) on sf0.001.

A cross-section of every family; the full sweep is ``python tests/oracle_check.py``.
"""

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "src_table_orders", "src_table_inventory", "src_load_all", "fact_order", "fact_customer",
    "fact_cohort_activity", "agg_mode_tiebreak", "dq_column_summary", "dq_relationships",
    "dq_inventory_checks", "q_revenue_seasonality", "q_inter_order_gap", "q_funnel", "q_retention",
    "q_concentration_snapshot", "q_channel_grouped", "q_risk_matrix", "q_era_distribution",
    "fe_lag_rolling", "fe_tet", "fe_promo_windows", "fc_mean_364_366", "fc_calibration_factors",
    "fc_scale_calibration", "ev_metrics",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF)
    assert compare(name, sdf, con, E.oracle_sql()[name]) is None


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "revenue" in df.columns


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
