"""Splits, metrics and model selection on a long forecast table.

Forecast tables are long: ``(model, series_id, target, Date, y, yhat)``.
Metrics are plain aggregates per (model, target) — MAE, RMSE, R² — plus an
"average" row per model, so any number of series / models is one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlane.functions.exprs import fdiv


def holdout_year(df: DataFrame, year: int, d: str = "Date") -> DataFrame:
    """role = train (< year) / valid (== year); later rows dropped."""
    y = F.year(d)
    return (df.withColumn("role", F.when(y < year, F.lit("train")).when(y == year, F.lit("valid")))
            .filter(F.col("role").isNotNull()))


def temporal_folds(df: DataFrame, folds: DataFrame, d: str = "Date") -> DataFrame:
    """(fold, role) per row from a fold table of date bounds (broadcast, 3 rows)."""
    f = F.broadcast(folds)
    j = df.crossJoin(f)
    role = (F.when(F.col(d) <= F.col("train_end"), F.lit("train"))
            .when(F.col(d).between(F.col("val_start"), F.col("val_end")), F.lit("valid")))
    return j.withColumn("role", role).filter(F.col("role").isNotNull()).drop("train_end", "val_start", "val_end")


def expanding_split(dates: DataFrame, n_splits: int = 5, test_size: int = 365, d: str = "Date") -> DataFrame:
    """TimeSeriesSplit(n_splits, test_size) bounds: fold k tests the k-th of the last
    n_splits blocks of ``test_size`` rows and trains on everything before it.

    Rows are numbered from the end (one row per date, calendar-bounded);
    the output is one row per fold.
    """
    w = Window.orderBy(F.desc(d))          # one row per calendar day
    r = dates.select(d).distinct().withColumn("_rev", F.row_number().over(w) - 1)
    r = r.filter(F.col("_rev") < n_splits * test_size).withColumn(
        "fold", F.lit(n_splits) - F.floor(F.col("_rev") / test_size).cast("int"))
    val = r.groupBy("fold").agg(F.min(d).alias("valid_start"), F.max(d).alias("valid_end"),
                                F.count(F.lit(1)).alias("valid_rows"))
    bounds = dates.agg(F.min(d).alias("train_start"))
    counts = dates.select(d).distinct()
    tr = (val.crossJoin(F.broadcast(bounds)).join(counts, F.col(d) < F.col("valid_start"), "left")
          .groupBy("fold", "train_start", "valid_start", "valid_end", "valid_rows")
          .agg(F.max(d).alias("train_end"), F.count(d).alias("train_rows")))
    return tr.select("fold", "train_start", "train_end", "valid_start", "valid_end", "train_rows", "valid_rows")


def ratio_split(df: DataFrame, ratio: float = 0.8, order: str = "month") -> DataFrame:
    """First int(ratio*n) rows (chronological) train, rest test."""
    w = Window.orderBy(order)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = df.withColumn("_rn", F.row_number().over(w)).crossJoin(F.broadcast(n))
    return r.withColumn("role", F.when(F.col("_rn") <= F.floor(F.col("_n") * ratio), F.lit("train"))
                        .otherwise(F.lit("test"))).drop("_rn", "_n")


def metrics(fc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R² per (model, target) over rows with both y and yhat, + 'average' row."""
    keys = keys or ["model"]
    e = fc.filter(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    ybar = e.groupBy(*keys, "target").agg(F.avg("y").alias("_ybar"))
    j = e.join(ybar, keys + ["target"], "inner")
    m = (j.groupBy(*keys, "target")
         .agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("MAE"),
              F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("RMSE"),
              (F.lit(1.0) - fdiv(F.sum((F.col("y") - F.col("yhat")) ** 2),
                                 F.sum((F.col("y") - F.col("_ybar")) ** 2))).alias("R2")))
    avg = m.groupBy(*keys).agg(F.lit("average").alias("target"), F.avg("MAE").alias("MAE"),
                               F.avg("RMSE").alias("RMSE"), F.avg("R2").alias("R2"))
    return m.unionByName(avg)


def leaderboard(metric_tables: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """Union of per-model metrics; average rows ranked by RMSE (model name breaks ties), within each ``by``."""
    u = metric_tables[0]
    for t in metric_tables[1:]:
        u = u.unionByName(t)
    avg = u.filter(F.col("target") == "average")
    w = Window.partitionBy(*(by or [])).orderBy("RMSE", "model")       # one row per model
    return avg.withColumn("rank", F.row_number().over(w))


def best_model(metric_table: DataFrame, by: list[str] | None = None) -> DataFrame:
    avg = metric_table.filter(F.col("target") == "average")
    return avg.groupBy(*(by or [])).agg(F.min_by("model", F.struct("RMSE", "model")).alias("best_model"),
                                        F.min("RMSE").alias("best_rmse"))


def driver_labels(importance: DataFrame, feature_col: str = "feature") -> DataFrame:
    """``kind, window_days, of_target`` of each feature: which operator makes it, over how many days, of which target.

    The names are those that the feature operators give (``features.feature_kinds``).
    """
    from kartlane.operators.features import feature_kinds
    kinds = importance.sparkSession.createDataFrame(
        [(n, *k) for n, k in feature_kinds().items()], f"`{feature_col}` string, kind string, window_days int, of_target string")
    # a row for each name the operators can give
    return (importance.join(F.broadcast(kinds), feature_col, "left")
            .withColumn("kind", F.coalesce("kind", F.lit("other"))))


def importance_share(imp: DataFrame, top_k: int | None = None) -> DataFrame:
    """importance / sum per (model, target) and rank; optional top-k per group."""
    w = Window.partitionBy("model", "target")
    out = imp.withColumns({
        "importance_share": fdiv("importance", F.sum("importance").over(w)),
        "rank": F.row_number().over(w.orderBy(F.desc("importance"), F.asc("feature"))),
    })
    return out.filter(F.col("rank") <= top_k) if top_k else out
