"""Plans and settings that keep time and memory in step with the input."""

import datetime

from pyspark.sql import functions as F

from kartlane.operators import quality as Q
from kartlane.session import BYTES_A_TASK, shuffle_by_size


def plan_of(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_column_summary_counts_cells_in_one_shared_exchange(spark):
    day = datetime.date(2001, 2, 3)
    rows = [(i % 7, float(i % 5) - 2, f"same-prefix-{i % 9}", day + datetime.timedelta(i % 2), None) for i in range(200)]
    rows += [(None, float("nan"), "", None, None), (None, -0.0, "\u00e9", None, None)]
    df = spark.createDataFrame(rows, "a bigint, b double, c string, d date, e int").repartition(4)
    out = Q.column_summary({"t": df, "u": df.limit(1).select("c"), "none": df.limit(0)})
    got = {(r.table_name, r.column_name): r for r in out.collect()}
    assert len(got) == 6
    a, b, c, d, e = (got["t", x] for x in "abcde")
    assert (a.dtype, a.non_null, a.missing, a.unique, a.sample_values) == ("bigint", 200, 2, 7, "0, 1, 2")
    assert (b.non_null, b.unique, b.sample_values) == (202, 6, "-2.0000, -1.0000, 0.0000")
    assert (c.unique, c.sample_values) == (11, ", same-prefix-0, same-prefix-1")
    assert (d.dtype, d.non_null, d.missing, d.unique, d.sample_values) == ("date", 200, 2, 2, "2001-02-03, 2001-02-04")
    assert (e.non_null, e.missing, e.unique, e.sample_values, e.missing_pct) == (0, 202, 0, "", 1.0)
    plan = plan_of(out)
    assert "SortAggregate" not in plan and "ReusedExchange" in plan
    assert plan.count("Expand") == 2     # the cells of each table with rows once


def test_snapshot_coverage_expands_no_rows(spark):
    inv = spark.createDataFrame([(1, "2001-01-31"), (1, "2001-01-31"), (1, "2001-01-30"), (2, "2001-01-31"), (None, "2001-01-31"),
                                 (None, "2001-01-31"), (3, "2001-03-31"), (4, None)], "product_id bigint, d string")
    out = Q.snapshot_coverage(inv.select("product_id", F.col("d").cast("date").alias("snapshot_date")))
    rows = [tuple(r)[1:] for r in sorted(out.collect())]
    assert rows == [(True, 2, 6, 2, 2), (False, 0, 0, 0, 0), (True, 1, 1, 1, 0)]
    assert "Expand" not in plan_of(out)


def test_shuffles_grow_with_the_input(spark):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(k) for k in keys]
    try:
        shuffle_by_size(spark, 1000)
        assert [spark.conf.get(k) for k in keys] == before
        shuffle_by_size(spark, 100 * BYTES_A_TASK + 1)
        assert spark.conf.get(keys[0]) == "101" and spark.conf.get(keys[1]) == f"{BYTES_A_TASK}b"
        shuffle_by_size(spark, 50 * BYTES_A_TASK)
        assert spark.conf.get(keys[0]) == "101"
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_facts_are_built_on_the_written_order_fact(spark, cat):
    from kartlane.operators import facts as FX
    from kartlane.session import written
    of = written(FX.order_fact(cat))
    whole, built = FX.customer_fact(cat), FX.customer_fact(cat, of)
    assert whole.columns == built.columns

    def rows(df):
        return sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert rows(whole) == rows(built)
    assert plan_of(built).count("FileScan parquet") < plan_of(whole).count("FileScan parquet")


def test_items_of_an_order_are_shuffled_once(spark, cat):
    from kartlane.operators import facts as FX
    plan = plan_of(FX.order_item_fact(cat))
    assert plan.count("hashpartitioning(order_id") == 1 and plan.count("Exchange hashpartitioning(order_id#") == 1


def test_table_summary_shuffles_one_number_for_all_missing_cells(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", None), (None, "1", 2.0), (1, None, 2.0)], "a bigint, b string, c double")
    out = Q.table_summary({"t": df, "none": df.limit(0)})
    got = {r.table_name: tuple(r)[1:] for r in out.collect()}
    assert got == {"t": (4, 3, 4, 4 / 12, 1), "none": (0, 3, 0, 0.0, 0)}
    plan = plan_of(Q.table_summary({"t": df}))
    assert "partial_count(a" not in plan and "partial_count(b" not in plan and "partial_sum(missing" in plan


def scratch_tables(spark):
    import glob

    from kartlane.session import checkpoint_dir
    return set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/tables/*"))


def test_facts_are_written_once_and_leave_no_scratch_tables(spark, cat):
    from kartlane.plans.registry import load_all_plans
    before = scratch_tables(spark)
    rows = {r.fact: r.rows for r in load_all_plans()["snk_facts"].build(cat).collect()}
    assert rows["order_fact_table"] == cat.table("orders_slim").count() and len(rows) == 5
    assert scratch_tables(spark) == before


def test_fact_quality_keeps_no_fact(spark, cat):
    from kartlane.operators import facts as FX
    before = scratch_tables(spark)
    out = FX.fact_quality(cat)
    left = [spark.read.parquet(t) for t in scratch_tables(spark) - before]
    assert all(t.count() == 1 and "rows" in t.columns for t in left)
    assert len(out.collect()) == 5 and "hashpartitioning(order_id" not in plan_of(out)


def test_facts_in_steps_equal_those_in_one(spark, cat):
    import math

    from kartlane.operators import facts as FX

    def same(x, y, *keys):
        assert x.columns == y.columns and x.dtypes == y.dtypes
        x, y = (df.orderBy(*keys).collect() for df in (x, y))
        alike = lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6) if isinstance(a, float) and isinstance(b, float) else a == b
        return len(x) == len(y) > 100 and all(alike(a, b) for r, q in zip(x, y) for a, b in zip(r, q))
    of = FX.order_fact_in_steps(cat)
    assert same(of, FX.order_fact(cat), "order_id")
    assert same(FX.customer_fact_in_steps(cat, of), FX.customer_fact(cat), "customer_id")
    assert same(FX.inventory_fact(cat, by_month=True), FX.inventory_fact(cat), "product_id", "snapshot_date")
    own = cat.derive({"inventory": cat.table("inventory").limit(3)})
    assert FX.inventory_fact(own, by_month=True).count() == 3


def test_products_are_counted_apart_from_medians(spark):
    from kartlane.operators import business as B
    rows = [(1, "2001-01-31", "a", 0.5), (1, "2001-01-31", "a", 0.7), (2, "2001-01-31", None, 0.1), (None, "2001-01-31", "a", 0.2), (3, None, None, 1.0)]
    inv = spark.createDataFrame(rows, "product_id bigint, d string, category string, fill_rate double").select("*", F.col("d").cast("date").alias("snapshot_date"))
    for c in ("stock_on_hand", "units_received", "units_sold", "stockout_days", "stockout_flag", "overstock_flag", "reorder_flag"):
        inv = inv.withColumn(c, F.lit(3))
    inv = inv.withColumns({c: F.col("fill_rate") for c in ("days_of_supply", "sell_through_rate")})
    months, groups = B.inventory_status(inv), B.lost_units(inv)
    assert {r.snapshot_month and r.snapshot_month.month: (r.product_month_rows, r.unique_products) for r in months.collect()} == {1: (4, 2), None: (1, 1)}
    assert {r.category: (r.product_month_rows, r.unique_products) for r in groups.collect()} == {"a": (3, 1), None: (2, 2)}
    for df in (months, groups):     # a median is kept for each group, not for each product of it
        assert not [x for x in plan_of(df).splitlines() if "percentile" in x and "keys=" in x and "product_id" in x.split("functions=")[0]]
        assert "distinct" not in plan_of(df)


def test_reports_derive_the_inventory_once(spark, cat, monkeypatch):
    from kartlane.plans.registry import load_all_plans
    before, put = scratch_tables(spark), []
    from kartlane import session
    monkeypatch.setattr(session, "written", lambda df, f=session.written: put.append(df.columns) or f(df))
    out = load_all_plans()["snk_reports"].build(cat).collect()
    assert len(out) == 14 and scratch_tables(spark) == before
    assert sum("snapshot_date" in c for c in put) == 1 and sum("review_id" in c for c in put) == 1
