"""Hand-made micro-frames for the semantic rules (ties, NULL groups, zero
denominators, short windows, promo wrap, Tet window edges, last Friday,
concentration ranks, weighted median, closed-form blends)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kartlane.functions import exprs as X
from kartlane.operators import aggregates as A
from kartlane.operators import forecast as FC
from kartlane.operators import windows as WN
from kartlane.operators.joins import nearest_event
from kartlane.operators.windows import prev_in_key


def D(s):
    return dt.date.fromisoformat(s)


def test_mode_tie_returns_min_of_all_values(spark):
    df = spark.createDataFrame(
        [(1, "b"), (1, "c"), (1, "b"), (1, "c"), (1, "a"),     # b,c tie at 2 -> min of all = a
         (2, "b"), (2, "b"), (2, "c")],                         # b wins outright
        "k int, v string")
    got = {r.k: r.m for r in A.mode_ref(df, ["k"], "v", "m").collect()}
    assert got == {1: "a", 2: "b"}


def test_sum_of_all_null_group_is_zero_mean_null(spark):
    from kartlane.operators.facts import sum0
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, x double")
    r = {row.k: (row.s, row.m) for row in df.groupBy("k").agg(sum0("x").alias("s"), F.avg("x").alias("m")).collect()}
    assert r[1] == (0.0, None) and r[2] == (3.0, 3.0)


def test_safe_divide_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    got = [r.q for r in df.select(X.fdiv("a", "b").alias("q")).collect()]
    assert got == [None, None, 1.5]


def test_round_half_up_is_engine_neutral(spark):
    df = spark.createDataFrame([(0.00015,), (2.5e-5,), (123.45675,)], "x double")
    got = [r.r for r in df.select(X.r4("x").alias("r")).collect()]
    assert got == [0.0002, 0.0, 123.4568]


def test_rolling_min_periods_and_shift(spark):
    rows = [("s", "Revenue", D("2000-01-01") + dt.timedelta(days=i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id string, target string, Date date, y double")
    out = df.withColumn("m", WN.shifted_rolling("y", ["series_id", "target"], "Date", 7, "avg", 3)).orderBy("Date")
    m = [r.m for r in out.collect()]
    assert m[:3] == [None, None, None]          # fewer than 3 previous values
    assert m[3] == pytest.approx(1.0)           # mean of 0,1,2
    assert m[9] == pytest.approx(sum(range(2, 9)) / 7)


def test_prev_in_key_matches_plain_lag_across_buckets(spark):
    rows = [(1, 10, D("2000-01-31")), (1, 11, D("2000-02-01")), (1, 12, D("2000-02-01")),
            (1, 13, D("2000-05-03")), (2, 20, D("2000-03-01"))]
    df = spark.createDataFrame(rows, "c int, o int, d date")
    got = {r.o: r.p for r in prev_in_key(df, "c", "d", "o", "p").collect()}
    assert got == {10: None, 11: D("2000-01-31"), 12: D("2000-02-01"), 13: D("2000-02-01"), 20: None}


def test_tet_window_edges(spark):
    from kartlane.sources.inline import tet_table
    tet = D("2000-02-05")
    days = [tet + dt.timedelta(days=k) for k in (-46, -45, 0, 45, 46)]
    df = spark.createDataFrame([(d,) for d in days], "Date date")
    got = {r.Date: r.x for r in nearest_event(df, "Date", tet_table(spark), "tet_date", 45, 999, "x").collect()}
    assert [got[d] for d in days] == [999, -45, 0, 45, 999]


def test_last_friday_of_november(spark):
    df = spark.createDataFrame([(2001,), (2018,), (1999,)], "y int")
    got = {r.y: r.d for r in df.select("y", X.last_friday_of_november("y").alias("d")).collect()}
    assert got == {2001: D("2001-11-30"), 2018: D("2018-11-30"), 1999: D("1999-11-26")}


def test_promo_wraps_year_end_and_odd_years(spark):
    from kartlane.operators.features import promo_windows
    days = [D("1998-12-31"), D("1999-01-01"), D("1999-01-02"), D("1999-02-01"), D("2000-02-01")]
    df = spark.createDataFrame([(d,) for d in days], "Date date")
    got = {r.Date: r for r in promo_windows(spark, df).collect()}
    # year_end starts 18 Nov, lasts 45 days -> covers 1 Jan and 2 Jan of the next year
    assert got[D("1999-01-01")].promo_year_end == 1 and got[D("1999-01-02")].promo_year_end == 1
    assert got[D("1999-01-02")].promo_year_end_until == 0.0
    # rural_special (30 Jan, odd years only)
    assert got[D("1999-02-01")].promo_rural_special == 1 and got[D("2000-02-01")].promo_rural_special == 0
    assert got[D("2000-02-01")].promo_rural_special_since == -1.0


def test_global_rank_cumsum_equals_plain_window(spark):
    vals = [(i, float(v)) for i, v in enumerate([5, 3, 3, 9, 1, 7, 7, 2, 8, 0.5])]
    df = spark.createDataFrame(vals, "k int, v double")
    got = {r.k: (r.rank, r.cum_value) for r in WN.global_rank_cumsum(df, "v", "k", n_buckets=3).collect()}
    order = sorted(vals, key=lambda t: (-t[1], t[0]))
    cum = 0.0
    for i, (k, v) in enumerate(order, start=1):
        cum += v
        assert got[k][0] == i and got[k][1] == pytest.approx(cum)


def test_weighted_median_scale_is_argmin_mae(spark):
    y = [10.0, 20.0, 30.0, 55.0]
    p = [10.0, 10.0, 20.0, 25.0]
    rows = [("s", "Revenue", D("2000-01-01") + dt.timedelta(days=i), y[i], p[i]) for i in range(4)]
    df = spark.createDataFrame(rows, "series_id string, target string, Date date, y double, blend double")
    c = FC.scale_calibration(df, "blend", lo=0.0, hi=10.0).first().scale
    grid = [i / 1000 for i in range(500, 3000)]
    best = min(grid, key=lambda g: sum(abs(a - g * b) for a, b in zip(y, p)))
    mae = lambda g: sum(abs(a - g * b) for a, b in zip(y, p))
    assert mae(c) <= mae(best) + 1e-9


def test_alpha_closed_form_matches_scan(spark):
    rows = []
    for i in range(20):
        d = D("2000-01-01") + dt.timedelta(days=i)
        b, s = 100 + i, 120 + 2 * i
        rows.append(("s", "Revenue", d, 0.3 * s + 0.7 * b + (i % 3), float(s), float(b)))
    df = spark.createDataFrame(rows, "series_id string, target string, Date date, y double, spec double, base double")
    a = FC.alpha_tuning(df, "spec", "base").first().alpha
    sse = lambda al: sum((r[3] - (al * r[4] + (1 - al) * r[5])) ** 2 for r in rows)
    best = min([0.05 + i * 0.0001 for i in range(8001)], key=sse)
    assert abs(a - best) < 1e-3


def test_simplex_weights_nonnegative_and_sum_to_one(spark):
    rows = []
    for i in range(60):
        x1, x2, x3 = math.sin(i), math.cos(i), (i % 7) / 7
        rows.append(("s", "Revenue", x1, x2, x3, 0.6 * x1 + 0.4 * x3))
    df = spark.createDataFrame(rows, "series_id string, target string, a double, b double, c double, y double")
    w = FC.simplex_weights(FC.gram(df, ["a", "b", "c"]), 3).first()
    ws = [w.w0, w.w1, w.w2]
    assert all(v >= 0 for v in ws) and sum(ws) == pytest.approx(1.0)
    assert ws[0] == pytest.approx(0.6, abs=1e-6) and ws[2] == pytest.approx(0.4, abs=1e-6)


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    h = {r.bin: r["count"] for r in A.histogram(df, "x", 5).collect()}
    assert sum(h.values()) == 11 and h[5] == 3      # 8, 9, 10 (max folded into bin 5)


def test_row_number_in_key_matches_plain_window(spark):
    rows = [(1, 10, D("2000-01-31")), (1, 11, D("2000-02-01")), (1, 12, D("2000-02-01")),
            (1, 13, D("2000-05-03")), (2, 20, D("2000-03-01")), (2, 21, D("1999-12-31"))]
    df = spark.createDataFrame(rows, "c int, o int, d date")
    got = {r.o: r.rk for r in WN.row_number_in_key(df, "c", "d", "o", "rk").collect()}
    assert got == {10: 1, 11: 2, 12: 3, 13: 4, 21: 1, 20: 2}


def test_global_rank_with_heavy_ties(spark):
    vals = [(i, 5.0 if i % 3 else float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(vals, "k long, v double")
    got = {r.k: (r.rank, r.cum_value) for r in WN.global_rank_cumsum(df, "v", "k", n_buckets=4).collect()}
    cum = 0.0
    for i, (k, v) in enumerate(sorted(vals, key=lambda t: (-t[1], t[0])), start=1):
        cum += v
        assert got[k][0] == i and got[k][1] == pytest.approx(cum)


def test_column_summary_approx_agrees_with_exact(cat):
    from kartlane.operators import quality as Q
    t = {"orders": cat.table("orders"), "products": cat.table("products")}
    ex = {(r.table_name, r.column_name): r for r in Q.column_summary(t).collect()}
    ap = {(r.table_name, r.column_name): r for r in Q.column_summary_approx(t).collect()}
    assert ex.keys() == ap.keys()
    for k, r in ex.items():
        a = ap[k]
        assert (a.non_null, a.missing, a.sample_values) == (r.non_null, r.missing, r.sample_values)
        assert abs(a.unique - r.unique) <= max(2, 0.08 * r.unique)
