"""Boosting, recursion, simplex weights, out-of-fold predictions, the final blend, the forecast sink."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartlane.operators import boosting as B
from kartlane.operators import evaluate as EV
from kartlane.operators import features as FE
from kartlane.operators import forecast as FC
from kartlane.operators import linear
from kartlane.operators import mlmodels as ML
from kartlane.operators import panel_models as PM
from kartlane.operators import quality as Q

D0 = datetime.date(1996, 1, 1)


def seasonal(spark, n=500):
    r = np.random.default_rng(5)
    rows = []
    for i in range(n):
        d = D0 + datetime.timedelta(days=i)
        rows.append((d, d.weekday(), d.month, float(100 + 20 * (d.weekday() >= 5) + 5 * d.month + r.normal(scale=2))))
    return spark.createDataFrame(rows, "Date date, dow int, month int, label double")


FAST = B.Settings(rounds=400, step=0.3, depth=3, patience=6, holdout=60)


def _boosted(df, settings, until="1997-04-01"):
    d = df.withColumn("s", F.lit("one"))
    old, new = d.where(F.col("Date") < until), d.where(F.col("Date") >= until)
    models = B.fit(linear.design(old, ["s"], ["dow", "month"], F.col("label"), keep=("Date",)), ["s"], settings)
    seen = linear.design(new.withColumn("y", F.col("label")), ["s"], ["dow", "month"], keep=("Date", "y"))
    return old, models, B.predict(seen, models, ["s"])


def test_boosting_reports_its_rounds_and_beats_a_naive_forecast(spark):
    old, _, p = _boosted(seasonal(spark), FAST)
    p = p.cache()
    mae, naive, best, hit = p.agg(F.avg(F.abs(F.col("y") - F.col("prediction"))),
                                  F.avg(F.abs(F.col("y") - F.lit(old.agg(F.avg("label")).first()[0]))),
                                  F.max("best_iteration"), F.max("limit_hit")).first()
    assert mae < 0.6 * naive and 1 <= best < 394 and not hit
    _, _, p = _boosted(seasonal(spark), FAST.but(rounds=3, step=0.01, depth=2))
    assert {(r.limit_hit, r.best_iteration <= 3) for r in p.collect()} == {(True, True)}   # the limit cut the search off, and that is reported
    assert _boosted(seasonal(spark, 30), FAST.but(holdout=25), "1996-01-25")[2].count() == 6          # too few rows for a holdout


def _toy(n=400, p=12):
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=(n, p - 4)), r.integers(0, 2, (n, 4))]).astype(float)
    return x, np.sin(2 * x[:, 0]) + 0.5 * x[:, p - 1] + 0.1 * r.normal(size=n), r.random(n) + 0.5


def test_boosting_goes_on_as_one_long_fit():
    x, t, w = _toy()
    s = B.Settings(rounds=60, step=0.1, depth=4, leaf=5, l2=1.0, rows=0.8, columns=0.5, every=5)
    one, two = B.Boosting(x, t, w, s), B.Boosting(x, t, w, s)
    one.go_on(60)
    for k in (1, 4, 25, 30):
        two.go_on(k)
    assert np.array_equal(one.residual, two.residual) and len(two.trees) == 60
    code = one.bins.code(x)
    assert np.allclose(one.base + s.step * sum(B.value(f, code) for f in one.trees), t - one.residual)
    other = B.Boosting(x, t, w, s.but(seed=7))
    other.go_on(60)
    assert not np.array_equal(one.residual, other.residual)
    for f, _, _ in one.trees:                                   # each tree keeps to its own draw of half the columns
        assert len(set(f[f >= 0].tolist())) <= 6
    assert len({tuple(sorted(set(f[f >= 0].tolist()))) for f, _, _ in one.trees}) > 10
    assert (one.residual ** 2).mean() < 0.1 * t.var()


def test_a_tree_is_the_best_split_and_its_leaves_are_shrunken_means():
    x, t, w = _toy()
    s = B.Settings(rounds=1, step=1.0, depth=1, leaf=10, l2=2.0, bins=1000)
    b = B.Boosting(x, t, w, s)
    r = b.residual.copy()
    b.go_on(1)
    best = max(((r * w)[m].sum() ** 2 / (w[m].sum() + 2) + (r * w)[~m].sum() ** 2 / (w[~m].sum() + 2), j, v)
               for j in range(x.shape[1]) for v in np.unique(x[:, j])[:-1] for m in [x[:, j] <= v] if m.sum() >= 10 and (~m).sum() >= 10)
    m = x[:, best[1]] <= best[2]
    want = np.where(m, (r * w)[m].sum() / (w[m].sum() + 2), (r * w)[~m].sum() / (w[~m].sum() + 2))
    assert np.allclose(r - b.residual, want)


def test_the_search_ends_patience_rounds_after_the_best():
    x, t, w = _toy()
    best, hit, losses = B.search(x, t, w, np.arange(len(t)), B.Settings(rounds=500, step=0.3, depth=4, patience=15, holdout=100))
    assert not hit and len(losses) == best + 15 and losses[best - 1] == min(losses)


# --- the recursive baseline

def _loop(weights, factor, past, days):
    vals = past[::-1].tolist()
    for i in range(days):
        x = [vals[-k] for k in FC.BASELINE_LAGS] + [sum(vals[-n:]) / n for n in FC.BASELINE_ROLLS]
        vals.append(max(factor[i] * sum(a * b for a, b in zip(weights, x)), 0.0))
    return np.array(vals[-days:])


def test_the_recursion_without_steps_equals_the_loop():
    r = np.random.default_rng(8)
    weights = FC.DEFAULT_BASELINE_WEIGHTS
    w, past = ML.lag_weights(weights), 100 + 20 * r.random(371)
    for days in (1, 30, 548, 900):
        assert np.allclose(ML.horizon_matrix(w, days) @ past, _loop(weights, np.ones(days), past, days), rtol=1e-9)
        factor = 0.8 + 0.4 * r.random(days)
        assert np.allclose(ML.calibrated_horizon(w, factor, past), _loop(weights, factor, past, days), rtol=1e-9)


def test_the_recursion_of_a_panel(spark):
    rows = [(s, "Revenue", D0 + datetime.timedelta(days=i), float(50 + i % 7 + 10 * (s == "b"))) for s in ("a", "b") for i in range(800)]
    rows += [("short", "Revenue", D0, 3.0)]
    long = spark.createDataFrame(rows, "series_id string, target string, Date date, y double")
    plain = ML.recursive_linear(None, horizon_days=40, calibrated=False, long=long).collect()
    assert {(r.series_id, r.skipped) for r in plain} == {("a", False), ("b", False), ("short", True)} and len(plain) == 81
    past = np.array([x[3] for x in rows[:800]][::-1][:371])
    got = [r.yhat for r in sorted(plain, key=lambda r: (r.series_id, str(r.Date))) if r.series_id == "a"]
    assert np.allclose(got, _loop(FC.DEFAULT_BASELINE_WEIGHTS, np.ones(40), past, 40))
    tuned = ML.recursive_linear(None, horizon_days=40, long=long).where("series_id = 'a'").orderBy("Date").collect()
    cal = FC.baseline_raw(FE.baseline_lags(long))
    fac = FC.calibration_factors(cal, F.col("pred").isNotNull()).where("series_id = 'a'").collect()
    month, day = {r.month: r.factor for r in fac if r.level == "month"}, {(r.month, r.dayofweek): r.factor for r in fac if r.level != "month"}
    f = [month.get(r.Date.month, 1.0) * day.get((r.Date.month, r.Date.weekday()), 1.0) for r in tuned]
    assert np.allclose([r.yhat for r in tuned], _loop(FC.DEFAULT_BASELINE_WEIGHTS, f, past, 40))


# --- simplex weights

def test_simplex_weights_meet_the_optimality_conditions():
    r = np.random.default_rng(4)
    for m, n in ((1, 30), (5, 60), (40, 200), (40, 25)):         # the last one is singular
        x = r.normal(size=(n, m)) + r.normal(size=(n, 1))
        y = x[:, 0] * 0.7 + r.normal(size=n) * 0.1 + (x[:, m // 2] * 0.3)
        G, c = x.T @ x, x.T @ y
        w = FC.simplex_solve(G, c)
        slope = G @ w - c
        level = slope[w > 1e-9].max()
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
        assert (slope >= level - 1e-6 * np.abs(c).max()).all() and np.ptp(slope[w > 1e-9]) < 1e-6 * np.abs(c).max()


def test_the_grid_holds_every_point_once_and_finds_the_best(spark):
    g = [tuple(r) for r in FC.simplex_grid(spark, 3, 4).collect()]
    assert len(g) == len(set(g)) == 15 and all(sum(x) == 4 for x in g)
    r = np.random.default_rng(6)
    x = r.normal(size=(80, 3))
    y = x @ [0.5, 0.25, 0.25] + 0.01 * r.normal(size=80)
    df = spark.createDataFrame([("s", "t", *map(float, a), float(b)) for a, b in zip(x, y)], "series_id string, target string, a double, b double, c double, y double")
    got = FC.simplex_weights_grid(FC.gram(df, ["a", "b", "c"]), 3, 4).first()
    assert (got.w0, got.w1, got.w2) == (0.5, 0.25, 0.25) and got.rmse == pytest.approx(np.sqrt(((y - x @ [0.5, 0.25, 0.25]) ** 2).mean()))


# --- horizon blocks

def test_block_features_know_nothing_of_their_horizon(spark):
    r = np.random.default_rng(1)
    y = r.random(1500)
    def frame(values):  # noqa: E306
        return spark.createDataFrame([("s", "t", D0 + datetime.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                                     "series_id string, target string, Date date, y double")
    for _, least in PM.BLOCKS:
        f, cols = PM.block_features(frame(y), least)
        changed, _ = PM.block_features(frame(np.where(np.arange(1500) > 1400 - least, 9.0, y)), least)
        day = D0 + datetime.timedelta(days=1400)
        assert f.where(F.col("Date") <= day).select("Date", *cols).exceptAll(changed.where(F.col("Date") <= day).select("Date", *cols)).count() == 0
        assert any(c == f"known_{least}" for c in cols) and f.where(F.col("Date") == day).select(*cols).dropna().count() == 1


def test_final_blend(spark):
    rows = [("Revenue", datetime.date(2002, 2, 1), 10.0, 20.0, 30.0, 40.0), ("COGS", datetime.date(2002, 8, 1), 1.0, 2.0, 3.0, 4.0),
            ("COGS", datetime.date(2002, 8, 2), 1.0, None, 3.0, 4.0)]
    m = spark.createDataFrame(rows, "target string, Date date, ridge double, structural double, base double, specialist double")
    got = {(r.target, r.Date.day): r.yhat for r in ML.blend_members(m).collect()}
    assert got["Revenue", 1] == pytest.approx(1.26 * (0.1 * 10 + 0.1 * 20 + 0.8 * (0.6 * 40 + 0.4 * 30)))
    assert got["COGS", 1] == pytest.approx(1.32 * (0.1 * 1 + 0.1 * 2 + 0.8 * 4))       # third quarter: specialists only
    assert got["COGS", 2] is None


class _Template:
    def __init__(self, spark, days):
        self.spark = spark
        self.df = spark.createDataFrame([(d, 0.0, 0.0) for d in days], "Date date, Revenue double, COGS double")

    def table(self, name):
        assert name == "sample_submission"
        return self.df


def test_the_sink_fails_on_a_gap_and_keeps_the_template_order(spark, tmp_path):
    days = [datetime.date(2002, 1, d) for d in (1, 2, 3)]
    cat = _Template(spark, days)
    full = spark.createDataFrame([(d, 1.234 * i - 1, 2.0) for i, d in enumerate(days)], "Date date, Revenue double, COGS double")
    rows = ML.forecast_sink(cat, full, f"{tmp_path}/a").orderBy("Date").collect()
    assert [tuple(r) for r in rows] == [("2002-01-01", 0.0, 2.0), ("2002-01-02", 0.23, 2.0), ("2002-01-03", 1.47, 2.0)]
    with pytest.raises(Exception, match="no Revenue forecast for 2002-01-03"):
        ML.forecast_sink(cat, full.where("Date < '2002-01-03'"), f"{tmp_path}/b")


def test_a_component_without_a_value_leaves_none(spark):
    p = spark.createDataFrame([("m", "s", "Revenue", D0, 2.0), ("k", "s", "Revenue", D0, None), ("m", "z", "Revenue", D0, 3.0),
                               ("k", "z", "Revenue", D0, 5.0)], "model string, series_id string, target string, Date date, yhat double")
    w = spark.createDataFrame([("m", "Revenue", 0.5), ("k", "Revenue", 0.5)], "model string, target string, w double")
    assert {r.series_id: r.yhat for r in FC.combine_components(p, w).collect()} == {"s": None, "z": 4.0}


def test_driver_labels_tell_the_operator(spark):
    f = ["Revenue_lag_7", "COGS_roll_mean_30", "Revenue_expanding_mean", "month_sin", "cogs_to_revenue_lag_1", "is_month_end", "what"]
    got = [tuple(r) for r in EV.driver_labels(spark.createDataFrame([(x,) for x in f], "feature string")).orderBy("feature").collect()]
    assert got == sorted([("Revenue_lag_7", "lag", 7, "Revenue"), ("COGS_roll_mean_30", "rolling_mean", 30, "COGS"), ("Revenue_expanding_mean", "expanding_mean", None, "Revenue"),
                          ("month_sin", "cycle", 12, None), ("cogs_to_revenue_lag_1", "cost_ratio", 1, None), ("is_month_end", "period_edge", None, None), ("what", "other", None, None)])


def test_every_one_step_feature_has_a_kind(cat):
    assert set(PM.lag_rows(cat)[1]) == set(FE.feature_kinds())


def test_out_of_fold_predictions_use_the_past_alone(spark, cat):
    """Values after a fold's training days change none of its forecasts but the one-step ones."""
    names = ("seasonal_naive", "ridge_log", "quarter_ridge")
    oof = PM.out_of_fold(cat, names)
    b = oof.where("fold = 'B'").groupBy("model").agg(F.min("Date"), F.max("Date"), F.count_distinct("series_id", "target")).collect()
    assert {(str(r[1]), str(r[2]), r[3]) for r in b} == {("1999-01-01", "1999-12-31", 12)} and len(b) == 3
    later = cat.derive({"sales_panel": cat.table("sales_panel").withColumn("Revenue", F.when(F.year("Date") >= 1999, 5.0).otherwise(F.col("Revenue")))})
    both = oof.where("fold = 'B' and series_id <> 'total'").join(
        PM.out_of_fold(later, names).withColumnRenamed("yhat", "other"), ["model", "fold", "series_id", "target", "Date"])
    assert both.count() > 5000 and both.where("abs(yhat - other) > 1e-9 * abs(yhat)").count() == 0
    wide = PM.side_by_side(oof, names)
    assert wide.columns == ["fold", "series_id", "target", "Date", "y", *names] and wide.count() == wide.dropna(subset=list(names)).count()


def test_every_inventory_rule_acts(spark):
    d = datetime.date
    schema = ("snapshot_date date, product_id bigint, stock_on_hand bigint, units_received bigint, units_sold bigint, "
              "stockout_days bigint, days_of_supply double, fill_rate double, stockout_flag int, overstock_flag int, reorder_flag int, "
              "sell_through_rate double, product_name string, category string, segment string, year int, month int")
    good = [d(2020, 1, 31), 1, 5, 5, 5, 0, 1.0, 0.5, 0, 0, 0, 0.5, "n", "c", "s", 2020, 1]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(pid, **change):
        return tuple({**dict(zip(names, good)), "product_id": pid, **change}.values())
    rows = [row(1), row(1), row(2, snapshot_date=d(2020, 1, 30)), row(3, year=2019), row(4, month=2), row(5, stockout_flag=1),
            row(6, stockout_days=40, stockout_flag=1), row(7, fill_rate=1.5), row(8, sell_through_rate=-0.1), row(9, units_sold=-1),
            row(10, product_name="other"), row(11, fill_rate=None)]
    inv = spark.createDataFrame(rows, schema)
    prod = spark.createDataFrame([(i, "n", "c", "s") for i in range(1, 12)],
                                 "product_id bigint, product_name string, category string, segment string")
    out = Q.inventory_checks(inv, prod)
    name = next(c for c, t in out.dtypes if t == "string")
    count = next(c for c in out.columns if "invalid" in c and not c.endswith("pct"))
    bad = {r[name]: r[count] for r in out.collect()}
    assert bad == {"snapshot_date_is_month_end": 1, "year_matches_snapshot_date": 1, "month_matches_snapshot_date": 1,
                   "unique_product_month_snapshot": 1, "stockout_flag_matches_stockout_days": 1,
                   "stockout_days_within_month_length": 1, "fill_rate_between_0_and_1": 2, "sell_through_rate_between_0_and_1": 1,
                   "nonnegative_quantity_metrics": 1, "product_attributes_match_products": 1}
