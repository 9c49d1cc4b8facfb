"""Exact percentiles of all groups and columns at once, whatever the size of a group.

Cells are counted by value first, which collapses ties in the map tasks. The
wanted ranks are then closed in: each interval of values that holds one is cut at
approximate quantiles of its values (a sketch of fixed size), running counts over
the at most ``WAYS`` parts tell which part holds the rank, and only those
parts go on. When no interval has more than ``limit`` distinct values, each is
ordered in a task of its own. A group of a third of all rows takes a round more, not a longer task.

Nulls and NaN are no values. Interpolation is linear between the two ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlane.session import cut_lineage

WAYS, ACCURACY, LIMIT = 64, 2000, 100_000


def cells(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``keys, column, v``: one row a value."""
    d = df.select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("v")) for i, c in enumerate(cols)])
    # 0.0 and -0.0 are one value
    return (d.select(*keys, F.explode(pairs).alias("_x")).select(*keys, F.col("_x.column").alias("column"), (F.col("_x.v") + 0.0).alias("v"))
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def exact(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """``keys, column, count`` and one column a name of ``probs``; a group without values in a column has no row."""
    group = [*keys, "column"]
    on = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
    counted = cut_lineage(cells(df, keys, cols).groupBy(*group, "v").agg(F.count("*").alias("n")))
    totals = cut_lineage(counted.groupBy(*group).agg(F.sum("n").alias("count")))
    ranks = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(float(q)).alias("q")) for p, q in probs.items()])
    pos = F.col("_p.q") * (F.col("count") - 1)
    wanted = (totals.withColumn("_p", F.explode(ranks)).select(*group, F.col("_p.name").alias("name"), pos.alias("pos"))
              .select(*group, "name", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("at")))
    wanted = cut_lineage(wanted.select(*group, "name", "pos", (F.col("at") + 1).cast("bigint").alias("rank")))
    active = counted.withColumns({"part": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")})
    # one number a round
    while (active.groupBy(*group, "part").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0) > limit:
        cuts = [i / WAYS for i in range(1, WAYS)]
        bounds = active.groupBy(*group, "part").agg(F.percentile_approx("v", cuts, ACCURACY).alias("b"))
        cut = active.alias("a").join(bounds.alias("b"), [*on("a", "b"), F.col("a.part") == F.col("b.part")]).select("a.*", "b.b")
        cut = cut.withColumn("sub", F.size(F.filter("b", lambda x: x < F.col("v")))).drop("b")
        held = cut.groupBy(*group, "part", "before", "sub").agg(F.sum("n").alias("n"))
        running = Window.partitionBy(*group, "part").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)   # at most WAYS rows
        held = held.withColumn("low", F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0)))
        kept = (held.alias("h").join(wanted.alias("w"), [*on("h", "w"), F.col("w.rank") > F.col("h.low"), F.col("w.rank") <= F.col("h.low") + F.col("h.n")])
                .select(*[f"h.{c}" for c in group], "h.part", "h.sub", "h.low").distinct())
        active = cut_lineage(
            cut.alias("c").join(kept.alias("k"), [*on("c", "k"), F.col("c.part") == F.col("k.part"), F.col("c.sub") == F.col("k.sub")])
            .select(*[f"c.{c}" for c in group], "c.v", "c.n", (F.col("c.part") * WAYS + F.col("c.sub")).alias("part"), F.col("k.low").alias("before")))
    within = Window.partitionBy(*group, "part").orderBy("v")
    ends = active.withColumn("end", F.col("before") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    found = (ends.alias("e").join(wanted.alias("w"), [*on("e", "w"), F.col("w.rank") <= F.col("e.end"), F.col("w.rank") > F.col("e.end") - F.col("e.n")])
             .select(*[f"e.{c}" for c in group], "w.name", "w.pos", "w.rank", "e.v")
             .groupBy(*group, "name", "pos").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high")))
    value = F.col("low") + (F.col("pos") - F.floor("pos")) * (F.col("high") - F.col("low"))
    found = found.select(*group, "name", value.alias("value"))
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == p, F.col("value"))).alias(p) for p in probs])
    return totals.alias("t").join(wide.alias("f"), on("t", "f")).select(*[f"t.{c}" for c in group], "t.count", *[f"f.{p}" for p in probs])


def describe(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """``keys, column, count, mean, std, min, <probs>, max`` in one pass over the cells and the rank search."""
    group = [*keys, "column"]
    plain = cells(df, keys, cols).groupBy(*group).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    p = exact(df, keys, cols, probs, limit)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}")) for c in group]
    return p.alias("p").join(plain.alias("d"), same).select(*[f"p.{c}" for c in group], "p.count", "d.mean", "d.std", "d.min", *[f"p.{q}" for q in probs], "d.max")
