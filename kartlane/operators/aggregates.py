"""Aggregation operators beyond plain ``groupBy().agg``.

All are partial/final hash aggregates (map-side combine), so a hot key is
pre-aggregated in every map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartlane.functions.exprs import fdiv


def mode_ref(df: DataFrame, keys: list[str], value: str, out_col: str) -> DataFrame:
    """Most frequent non-null value per group, with the workload's tie rule.

    If two or more values share the top count, the result is the smallest
    of *all* the group's values (not only the tied ones); otherwise the
    single most frequent value.  Two aggregations, no window, no collect:
    (keys, value) counts -> per key the largest and the smallest value at the
    top count (they differ exactly on a tie) and the minimum of all values.
    """
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    # Largest and smallest value among those at the top count: they differ
    # exactly when the top count is tied.
    per_key = (counts.groupBy(*keys)
               .agg(F.max_by(F.col(value), F.struct("_n", F.col(value))).alias("_hi"),
                    F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias("_lo"),
                    F.min(value).alias("_min_all")))
    return per_key.select(*keys, F.when(F.col("_hi") != F.col("_lo"), F.col("_min_all"))
                          .otherwise(F.col("_hi")).alias(out_col))


def value_counts(df: DataFrame, col_name: str, out_col: str = "count") -> DataFrame:
    """Frequency table including NULL, descending count then key."""
    return (df.groupBy(col_name).agg(F.count(F.lit(1)).alias(out_col))
            .orderBy(F.desc(out_col), F.asc_nulls_first(col_name)))


def describe_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """count/mean/std/min/p1/p5/p50/p95/p99/max per column, long form: all columns in one rank search."""
    from kartlane.operators.percentiles import describe
    return describe(df, [], cols, {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation for every ordered pair (pairwise complete rows)."""
    aggs = []
    for a in cols:
        for b in cols:
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                 F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")))
    one = df.agg(F.array(*aggs).alias("_m"))
    return one.select(F.inline("_m"))


def histogram(df: DataFrame, c: str, bins: int, keys: list[str] | None = None,
              density: bool = False) -> DataFrame:
    """Fixed-width bins between the (per-group) min and max.

    Like ``width_bucket``, the maximum lands in bin n+1; ``least`` folds it
    into n as numpy does.  Output: keys, bin (1..n), lo, hi, count [, density].
    """
    keys = keys or []
    x = F.col(c).cast("double")
    bounds = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = df.select(*keys, x.alias("_x")).filter(F.col("_x").isNotNull())
    j = j.join(bounds, keys, "inner") if keys else j.crossJoin(F.broadcast(bounds))
    # bin = floor(n * (x - lo) / (hi - lo)) + 1, the maximum folded into bin n
    raw = F.floor(F.lit(float(bins)) * (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))) + 1
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(F.least(raw, F.lit(bins)))
    counted = (j.groupBy(*keys, b.alias("bin"), "_lo", "_hi")
               .agg(F.count(F.lit(1)).alias("count")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    out = counted.select(*keys, "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("lo"),
                         (F.col("_lo") + F.col("bin") * width).alias("hi"), "count")
    if density:
        from pyspark.sql import Window
        tot = F.sum("count").over(Window.partitionBy(*keys)) if keys else F.sum("count").over(Window.partitionBy())
        out = out.withColumn("density", fdiv(F.col("count"), tot * (F.col("hi") - F.col("lo"))))
    return out


def share_within(c: str, keys: list[str]) -> Column:
    """x / sum(x) over the group (transform-style share)."""
    from pyspark.sql import Window
    return fdiv(F.col(c), F.sum(c).over(Window.partitionBy(*keys)))
