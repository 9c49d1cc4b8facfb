"""Window operators.

Two families:

* panel windows over ``(series_id, target)`` partitions of an already
  aggregated daily/monthly series — rows per partition are bounded by the
  calendar (thousands), not by the data volume;
* global orderings (cumulative shares, ranks over all customers), which a
  plain ``Window.orderBy`` would run in ONE task.  Those use value buckets:
  bucket totals -> running offset over the (small) bucket table -> window
  inside each bucket.  Same ranks and sums as the global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(c: str, part: list[str], order: str, lo: int, hi: int, fn: str = "avg",
            min_periods: int | None = None) -> Column:
    """Row-based rolling stat over [lo, hi] rows with a pandas min_periods guard."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(lo, hi)
    f = {"avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[fn]
    val = f(F.col(c)).over(w)
    need = (hi - lo + 1) if min_periods is None else min_periods
    return F.when(F.count(F.col(c)).over(w) >= need, val)


def shifted_rolling(c: str, part: list[str], order: str, n: int, fn: str = "avg",
                    min_periods: int | None = None) -> Column:
    """``shift(1).rolling(n, min_periods)``: rows t-n .. t-1."""
    return rolling(c, part, order, -n, -1, fn, min_periods)


def expanding_mean(c: str, part: list[str], order: str, min_periods: int) -> Column:
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.count(F.col(c)).over(w) >= min_periods, F.avg(F.col(c)).over(w))


def lag(c: str, part: list[str], order: str, k: int) -> Column:
    return F.lag(F.col(c), k).over(Window.partitionBy(*part).orderBy(order))


def backfill(c: str, part: list[str], order: str) -> Column:
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return F.first(F.col(c), ignorenulls=True).over(w)


def running_sum(c: str, part: list[str], order) -> Column:
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col(c)).over(w)


def pct_change(c: str, part: list[str], order: str) -> Column:
    prev = lag(c, part, order, 1)
    return F.col(c).cast("double") / F.nullif(prev.cast("double"), F.lit(0.0)) - F.lit(1.0)


def group_head(df: DataFrame, part: list[str], order: list[Column], k: int) -> DataFrame:
    """Top-k rows per group (row_number <= k), unique tie-break expected in ``order``."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _bucketed(df: DataFrame, c: str, out: str, splits: list[float]) -> DataFrame:
    """``out`` = number of ``splits`` at or below column ``c`` (binary search in the JVM; ``c`` not null)."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer
    edges = [-float("inf"), *splits, float("inf")]
    return Bucketizer(splits=edges, inputCol=c, outputCol="_e").transform(df).withColumn(out, F.col("_e").cast("int")).drop("_e")


def _quantiles(df: DataFrame, c: str, n: int) -> list[float]:
    """At most ``n - 1`` increasing split points of about equal row counts (a bounded sketch, one row to the driver)."""
    got = df.agg(F.percentile_approx(c, [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted({float(x) for x in got or []})


def global_rank_cumsum(df: DataFrame, value: str, tiebreak: str, n_buckets: int = 256,
                       descending: bool = True) -> DataFrame:
    """Global rank (1..N) and running sum of ``value`` ordered by value then key.

    Equivalent to ``row_number()`` / running ``sum`` over an un-partitioned
    window, without a one-task window and without a hot task for skewed values
    or a value that many rows share:

    1. distinct values with their row counts (partial aggregation collapses
       ties, however many rows share a value);
    2. offsets over the distinct values by quantile buckets, so that a long
       tail fills buckets evenly: bucket totals -> prefix over the bucket table
       (<= ``n_buckets`` rows) -> window inside each bucket;
    3. rank inside a value by quantile buckets of the numeric ``tiebreak`` over
       all rows: counts per (value, key bucket) -> prefix per value over
       <= ``n_buckets`` rows -> row_number inside (value, key bucket).  Inside a
       tie the running sum is offset + rank * value.

    Adds ``rank``, ``cum_value``, ``n_total`` and ``value_total``.  Rows without a
    value keep their place in the result and have none of the four.
    """
    from kartlane.session import cut_lineage
    # written once: the split points, the totals and the rows are all read from it
    base = cut_lineage(df.withColumns({"_v": F.col(value).cast("double"), "_k": F.col(tiebreak).cast("double")}))
    nulls, base = base.filter(F.col("_v").isNull()), base.filter(F.col("_v").isNotNull())
    vals = base.groupBy("_v").agg(F.count(F.lit(1)).alias("_vn"))
    stats = vals.agg(F.sum("_vn").alias("n_total"), F.sum(F.col("_v") * F.col("_vn")).alias("value_total"))
    vb = _bucketed(vals, "_v", "_b", _quantiles(vals, "_v", n_buckets))
    if descending:
        vb = vb.withColumn("_b", -F.col("_b"))
    vsum = F.col("_v") * F.col("_vn")
    btab = vb.groupBy("_b").agg(F.sum("_vn").alias("_bn"), F.sum(vsum).alias("_bs"))
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)        # <= n_buckets rows
    btab = btab.select("_b", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_pn"),
                       F.coalesce(F.sum("_bs").over(wb), F.lit(0.0)).alias("_ps"))
    wv = (Window.partitionBy("_b").orderBy(F.desc("_v") if descending else F.asc("_v"))
          .rowsBetween(Window.unboundedPreceding, -1))
    vb = (vb.join(F.broadcast(btab), "_b", "inner")
          .withColumn("_off_n", F.col("_pn") + F.coalesce(F.sum("_vn").over(wv), F.lit(0)))
          .withColumn("_off_s", F.col("_ps") + F.coalesce(F.sum(vsum).over(wv), F.lit(0.0)))
          .select("_v", "_off_n", "_off_s"))
    rows = base.join(vb, "_v", "inner")     # nothing needs the join key's partitioning: AQE may split a hot value
    rows = _bucketed(rows, "_k", "_kb", _quantiles(base, "_k", n_buckets))
    ktab = rows.groupBy("_v", "_kb").agg(F.count(F.lit(1)).alias("_kn"))
    wk = Window.partitionBy("_v").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)  # <= n_buckets rows
    ktab = ktab.select("_v", "_kb", F.coalesce(F.sum("_kn").over(wk), F.lit(0)).alias("_kp"))
    rows = rows.join(ktab, ["_v", "_kb"], "inner")
    wr = Window.partitionBy("_v", "_kb").orderBy(F.asc(tiebreak))
    within = F.col("_kp") + F.row_number().over(wr)
    out = (rows.withColumn("rank", F.col("_off_n") + within)
           .withColumn("cum_value", F.col("_off_s") + within * F.col("_v"))
           .crossJoin(F.broadcast(stats))   # one row
           .select(*df.columns, "n_total", "value_total", "rank", "cum_value"))
    none = nulls.select(*df.columns, F.lit(None).cast("bigint").alias("n_total"), F.lit(None).cast("double").alias("value_total"),
                        F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("double").alias("cum_value"))
    return out.unionByName(none)


def exact_percentiles(df: DataFrame, c: str, probs: dict[str, float], n_buckets: int = 256) -> DataFrame:
    """One row of interpolated exact percentiles ``name -> p`` of column ``c``, without one task that holds all values.

    Two passes over the distinct values: bucket counts (at most ``n_buckets``
    rows to the driver) tell which buckets hold the wanted ranks, and only those
    buckets are ordered.  ``percentiles.exact`` does this for many groups and columns.
    """
    import math

    from kartlane.session import cut_lineage
    vals = cut_lineage(df.select(F.col(c).cast("double").alias("_v")).filter("_v is not null").groupBy("_v")
                       .agg(F.count(F.lit(1)).alias("_n")))
    vals = _bucketed(vals, "_v", "_b", _quantiles(vals, "_v", n_buckets))
    sizes = {r["_b"]: r["n"] for r in vals.groupBy("_b").agg(F.sum("_n").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return df.agg(*[F.max(F.lit(None).cast("double")).alias(k) for k in probs])
    before, at = {}, 0
    for b in sorted(sizes):
        before[b], at = at, at + sizes[b]
    ranks = {r for p in probs.values() for r in (math.floor((total - 1) * p), math.ceil((total - 1) * p))}
    need = sorted({max(b for b in before if before[b] <= r) for r in ranks})
    w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.create_map(*[F.lit(x) for b in need for x in (b, before[b])])
    part = vals.filter(F.col("_b").isin(need)).withColumn("_c", F.sum("_n").over(w) + F.element_at(offset, F.col("_b")))

    def value(r):  # the least value that has more than r values up to itself
        return F.min(F.when(F.col("_c") > r, F.col("_v")))

    out = []
    for k, p in probs.items():
        x = (total - 1) * p
        lo, hi = value(math.floor(x)), value(math.ceil(x))
        out.append((lo + (hi - lo) * F.lit(x - math.floor(x))).alias(k))
    return part.agg(*out)


def prev_in_key(df: DataFrame, key: str, date_col: str, tiebreak: str, out_col: str,
                bucket: str = "month") -> DataFrame:
    """Previous ``date_col`` of the same ``key`` in (date, tiebreak) order.

    ``lag`` over ``partitionBy(key)`` puts a hot key (one customer with a
    third of all orders) into one task.  Here the window runs per
    (key, time bucket); the first row of a bucket takes the last date of the
    key's previous non-empty bucket from a bucket-level table whose rows per
    key are bounded by the calendar.
    """
    b = F.trunc(F.col(date_col), bucket) if bucket in ("month", "year") else F.col(date_col)
    t = df.withColumn("_bk", b)
    w_in = Window.partitionBy(key, "_bk").orderBy(date_col, tiebreak)
    t = t.withColumn("_prev_in", F.lag(F.col(date_col)).over(w_in))
    last = t.groupBy(key, "_bk").agg(F.max(F.col(date_col)).alias("_last"))
    w_b = Window.partitionBy(key).orderBy("_bk")
    last = last.select(key, "_bk", F.lag("_last").over(w_b).alias("_prev_bucket_last"))
    return (_null_safe(t, last, [key, "_bk"])
            .withColumn(out_col, F.coalesce("_prev_in", "_prev_bucket_last"))
            .drop("_bk", "_prev_in", "_prev_bucket_last"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null, so that rows without a key or date stay."""
    r = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    return left.join(r, on, "inner").drop(*[f"_r_{i}" for i in range(len(keys))])


def duplicate_flag(keys: list[str], order: list) -> Column:
    """True for every row after the first of its key (pandas ``duplicated``)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1


def row_number_in_key(df: DataFrame, key: str, date_col: str, tiebreak: str, out_col: str,
                      bucket: str = "month") -> DataFrame:
    """``row_number()`` over (key ORDER BY date, tiebreak) without a per-key partition.

    Rank = the key's row count in earlier time buckets (prefix over a
    bucket-level table, bounded by the calendar) + row_number inside
    (key, bucket).  A key with a third of all rows is spread over its buckets.
    """
    t = df.withColumn("_bk", F.trunc(F.col(date_col), bucket))
    counts = t.groupBy(key, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w_b = Window.partitionBy(key).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_bk", F.coalesce(F.sum("_n").over(w_b), F.lit(0)).alias("_before"))
    w_in = Window.partitionBy(key, "_bk").orderBy(date_col, tiebreak)
    return (_null_safe(t, counts, [key, "_bk"])
            .withColumn(out_col, F.col("_before") + F.row_number().over(w_in))
            .drop("_bk", "_before"))
