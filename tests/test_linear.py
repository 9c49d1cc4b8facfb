"""Grouped normal equations and coordinate descent against closed forms."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import functions as F

from kartlane.operators import linear
from kartlane.operators import panel_models as PM


def frame(spark, groups, partitions=7):
    """Groups of unlike size (the first holds two thirds of all rows), offsets and scales far apart, one column twice another."""
    r = np.random.default_rng(2)
    rows, data = [], {}
    for g in range(groups):
        n = 2000 if not g else 60 + g
        x = r.normal(size=(n, 4)) * [1, 200, 0.01, 1] + [0, 1e6, 5, 0]
        x[:, 3] = 2 * x[:, 0]
        y, w = x[:, :3] @ [3.0 + g, 0.01, 40.0] + r.normal(size=n), r.random(n) + 0.1
        data[f"g{g}"] = (x, y, w)
        rows += [(f"g{g}", g % 3, *map(float, a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    rows += [("g0", 0, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("g0", 0, 1.0, 1.0, 1.0, 1.0, None, 1.0), ("g0", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0),
             ("g0", 0, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), ("none", 1, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "k string, j int, a double, b double, c double, d double, y double, w double").repartition(partitions), data


def test_least_squares_of_many_groups_in_one_job(spark):
    df, data = frame(spark, 12)
    fitted = linear.fit(linear.design(df, ["k", "j"], list("abcd"), F.col("y"), F.col("w")), ["k", "j"]).collect()
    assert len(fitted) == 12                                     # a group without a whole row has no model
    for m in fitted:
        x, y, w = data[m.k]
        s = np.sqrt(w)[:, None]
        want = np.linalg.lstsq(np.column_stack([(x[:, :3] - x[:, :3].mean(0)), np.ones(len(y))]) * s, y * s[:, 0], rcond=None)[0]
        assert m.n == len(y) and m.coef[3] == 0                  # the second of two dependent columns is left out
        assert np.allclose(m.coef[:3], want[:3], rtol=1e-7)
        assert np.isclose(m.intercept + np.dot(m.coef[:3], x[:, :3].mean(0)), want[3], rtol=1e-9)


def test_ridge_is_the_closed_form_on_standardised_columns(spark):
    df, data = frame(spark, 3)
    for m in linear.fit(linear.design(df, ["k"], list("abc"), F.col("y")), ["k"], 10.0).collect():
        if m.k == "none":
            continue
        x, y, _ = data[m.k]
        if m.k == "g0":                                          # here the row of weight 0 counts
            x, y = np.vstack([x, [1.0, 1, 1, 1]]), np.append(y, 1.0)
        z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
        beta = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
        assert np.allclose(np.array(m.coef) * x[:, :3].std(0), beta, rtol=1e-7)
        assert np.isclose(m.intercept + np.dot(m.coef, x[:, :3].mean(0)), y.mean())


def test_moments_do_not_depend_on_the_partitions(spark):
    df, _ = frame(spark, 5)
    def get(parts):  # noqa: E306
        d = linear.design(df.repartition(parts), ["k"], list("abc"), F.col("y"))
        return {r.k: np.array([r.n, r.weight, *r.mean, *r.cross]) for r in linear.moments(d, ["k"]).collect()}
    one, many = get(1), get(23)
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k], rtol=1e-10) for k in one)
    empty = linear.design(df.where("k = 'nobody'"), ["k"], list("abc"), F.col("y"))
    assert linear.fit(empty, ["k"]).count() == 0


def test_predictions_are_a_join(spark):
    df, data = frame(spark, 2)
    models = linear.fit(linear.design(df, ["k"], list("abc"), F.col("y")), ["k"])
    p = linear.predict(linear.design(df.where("k = 'g1'"), ["k"], list("abc"), keep=("y",)), models, ["k"]).collect()
    x, y, _ = data["g1"]
    b = np.linalg.lstsq(np.column_stack([x[:, :3], np.ones(len(y))]), y, rcond=None)[0]
    assert np.allclose(sorted(r.prediction for r in p), sorted(np.column_stack([x[:, :3], np.ones(len(y))]) @ b), rtol=1e-6)


def test_a_planted_changepoint_is_found_and_unused_ones_are_zero(spark):
    r = np.random.default_rng(11)
    days, rows = 1400, []
    for s, at in (("early", 0.32), ("late", 0.64), ("straight", None)):
        t = np.arange(days) / (days - 1)
        level = 3 + 0.5 * t + (0 if at is None else 2.5 * np.maximum(t - at, 0)) + 0.2 * np.sin(2 * np.pi * np.arange(days) / 365.25) + 0.02 * r.normal(size=days)
        rows += [(s, "Revenue", datetime.date(1997, 1, 1) + datetime.timedelta(days=i), float(np.exp(v)), "train" if i < days - 100 else "valid") for i, v in enumerate(level)]
    df = spark.createDataFrame(rows, "series_id string, target string, Date date, y double, role string")
    doy = F.dayofyear("Date")
    for k in (1, 2, 3, 4, 5):
        df = df.withColumns({f"sin_y{k}": F.sin(2 * np.pi * k * doy / 365.25), f"cos_y{k}": F.cos(2 * np.pi * k * doy / 365.25)})
    for k in (1, 2):
        df = df.withColumns({f"sin_w{k}": F.sin(2 * np.pi * k * F.weekday("Date") / 7), f"cos_w{k}": F.cos(2 * np.pi * k * F.weekday("Date") / 7)})
    models, p = PM.structural(df, keys=PM.SERIES)
    hinges = {m.series_id: np.array(m.coef[1:1 + PM.CHANGEPOINTS]) for m in models.collect()}
    knots = PM.CHANGEPOINT_RANGE * np.arange(1, PM.CHANGEPOINTS + 1) / PM.CHANGEPOINTS
    scale = (days - 1) / (days - 101)                            # time runs from 0 to 1 over the training days
    for s, at in (("early", 0.32), ("late", 0.64)):
        used = np.abs(hinges[s]) > 0.3
        assert 1 <= used.sum() <= 3 and (np.abs(knots[used] - at * scale) < 0.05).all() and abs(hinges[s].sum() - 2.5 / scale) < 0.4
        assert (hinges[s] == 0).sum() >= 15
    assert (hinges["straight"] == 0).sum() >= 20 and np.abs(hinges["straight"]).sum() < 0.2
    error = p.groupBy("series_id").agg(F.avg(F.abs(F.log("yhat") - F.log("y"))).alias("e")).collect()
    assert all(r.e < 0.1 for r in error)
