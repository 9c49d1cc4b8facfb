"""Window and fact operators on skewed values, hot keys and missing keys."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import functions as F

from kartlane.operators import facts as FX
from kartlane.operators import windows as W


def test_value_buckets_of_a_long_tail_are_even(spark):
    v = np.random.default_rng(1).lognormal(0, 2, 20_000)
    v[:6000] = 5.0                                   # a third of all rows share one value
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k bigint, v double")
    values = df.groupBy("v").count()
    b = W._bucketed(values, "v", "b", W._quantiles(values, "v", 64))
    assert b.groupBy("b").count().agg(F.max("count")).first()[0] < 0.05 * values.count()
    hot = W._bucketed(df.where("v = 5").withColumn("k", F.col("k").cast("double")), "k", "b", W._quantiles(df, "k", 64))
    assert hot.groupBy("b").count().agg(F.max("count")).first()[0] < 0.1 * 6000
    got = W.global_rank_cumsum(df, "v", "k", n_buckets=64).select("k", "rank", "cum_value").collect()
    order = sorted(range(len(v)), key=lambda i: (-v[i], i))
    total, want = 0.0, {}
    for r, i in enumerate(order):
        total += v[i]
        want[i] = (r + 1, total)
    assert all(r.rank == want[r.k][0] and abs(r.cum_value - want[r.k][1]) < 1e-6 * total for r in got) and len(got) == len(v)


def test_rows_without_a_key_date_or_value_stay(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2020, 1, 5), 1), (None, d(2020, 1, 6), 2), (1, None, 3), (1, d(2020, 3, 1), 4)],
                               "k bigint, day date, id bigint")
    assert W.row_number_in_key(df, "k", "day", "id", "n").count() == 4
    prev = {r.id: r.p for r in W.prev_in_key(df, "k", "day", "id", "p").collect()}
    assert len(prev) == 4 and prev[4] == d(2020, 1, 5)
    vals = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "k bigint, v double")
    got = {r.k: r["rank"] for r in W.global_rank_cumsum(vals, "v", "k").collect()}
    assert got == {1: 2, 2: None, 3: 1}


class _Orders:
    def __init__(self, df):
        self.df = df

    def table(self, name):
        assert name == "orders_slim"
        return self.df


def test_first_and_second_order_of_a_hot_customer(spark):
    d = datetime.date(2020, 1, 1)
    day = lambda n: d + datetime.timedelta(days=n)
    rows = [(i, 7, day(3 + i % 400)) for i in range(3000)] + [(5000, 8, day(9)), (5001, 8, day(9)), (5002, 8, day(4)), (5003, 9, day(1))]
    o = spark.createDataFrame(rows, "order_id bigint, customer_id bigint, order_date date")
    out = FX.customer_order_dates(_Orders(o))
    got = {r.customer_id: (r.first_order_date, r.second_order_date) for r in out.collect()}
    assert got == {7: (day(3), day(3)), 8: (day(4), day(9)), 9: (day(1), None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_exact_percentiles(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.lognormal(0, 2, 5000), np.full(2500, 1.5)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    want = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.999, "e": 1.0}
    got = W.exact_percentiles(df, "x", want, n_buckets=32).first()
    assert all(abs(got[k] - np.quantile(v, p)) < 1e-9 * max(1, abs(got[k])) for k, p in want.items())
    assert W.exact_percentiles(df.where("x is null"), "x", want).first()["b"] is None


def test_grouped_percentiles_of_a_hot_group(spark):
    """Two thirds of all rows in one group, ties, nulls, NaN, a null key; intervals are cut until none is longer than the limit."""
    import numpy as np
    from kartlane.operators import percentiles as P
    r = np.random.default_rng(3)
    rows = [("hot", float(v), float(round(v, 1))) for v in r.lognormal(size=6000)]
    rows += [("small", float(v), None) for v in r.normal(size=301)] + [(None, 1.5, 2.0), (None, -0.0, 0.0), ("one", 7.0, float("nan")), ("flat", 2.0, 3.0), ("flat", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, z double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    seen = []
    cut = P.cut_lineage
    P.cut_lineage = lambda d: seen.append(cut(d)) or seen[-1]
    try:
        got = {(g.k, g.column): g for g in P.exact(df, ["k"], ["x", "z"], probs, limit=40).collect()}
    finally:
        P.cut_lineage = cut
    for k in ("hot", "small", None, "one", "flat"):
        for i, c in enumerate("xz", 1):
            v = [q[i] for q in rows if q[0] == k and q[i] is not None and q[i] == q[i]]
            assert ((k, c) in got) == bool(v)
            if v:
                g = got[k, c]
                assert g["count"] == len(v) and np.allclose([g[p] for p in probs], np.quantile(v, list(probs.values())), rtol=1e-12)
    last = seen[-1]                                              # what is ordered in the end: short intervals
    assert last.groupBy("k", "column", "part").count().agg({"count": "max"}).first()[0] <= 40 and len(seen) >= 5
    d = P.describe(df, [], ["x"], {"m": 0.5}).first()
    v = [q[1] for q in rows]
    assert np.allclose([d["mean"], d["std"], d["min"], d["m"], d["max"]], [np.mean(v), np.std(v, ddof=1), min(v), np.median(v), max(v)])
    assert P.exact(df.where("k = 'no'"), ["k"], ["x"], probs).count() == 0
