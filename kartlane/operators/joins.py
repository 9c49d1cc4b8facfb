"""Join operators.

Broadcast policy: only inline/literal dimensions and one-row scalar
aggregates are broadcast explicitly — their size is bounded by construction.
Everything derived from data is joined on keys and left to AQE, which
measures the real side sizes at run time and switches to a broadcast hash
join only below ``spark.sql.autoBroadcastJoinThreshold``; above it the
sort-merge join (with skew-split of hot partitions) is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup(fact: DataFrame, dim: DataFrame, on, cols: list[str] | None = None) -> DataFrame:
    """fact LEFT JOIN projected dim (join_left_lookup)."""
    keys = [on] if isinstance(on, str) else list(on)
    right = dim.select(*keys, *(cols or [c for c in dim.columns if c not in keys]))
    return fact.join(right, keys, "left")


def anti_fk(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
    """Rows of ``left`` with a non-null ``lcol`` absent from ``right.rcol``."""
    l = left.select(F.col(lcol).alias("_k")).filter(F.col("_k").isNotNull())
    r = right.select(F.col(rcol).alias("_k")).filter(F.col("_k").isNotNull())
    return l.join(r, "_k", "left_anti")


def semi_flag(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Membership flag column: left join to the distinct right keys."""
    r = right.select(key).distinct().withColumn(flag, F.lit(True))
    return left.join(r, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def with_indicator(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a pandas-style ``_merge`` marker (both / left_only)."""
    r = right.select(key).distinct().withColumn("_hit", F.lit(1))
    return (left.join(r, key, "left")
            .withColumn("_merge", F.when(F.col("_hit").isNotNull(), F.lit("both")).otherwise(F.lit("left_only")))
            .drop("_hit"))


def suffix_columns(df: DataFrame, keep: list[str], suffix: str) -> DataFrame:
    """Rename every non-key column with a suffix before a clashing join."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def date_spine(dates: DataFrame, date_col: str, out_col: str = "date", unit: str = "day") -> DataFrame:
    """Gap-free calendar between min and max of ``date_col``.

    A one-row aggregate is exploded; the spine length is bounded by the
    calendar span, not the data volume.
    """
    step = F.expr("interval 1 day") if unit == "day" else F.expr("interval 1 month")
    lo = F.min(date_col) if unit == "day" else F.trunc(F.min(date_col), "month")
    hi = F.max(date_col) if unit == "day" else F.trunc(F.max(date_col), "month")
    return (dates.agg(lo.alias("_lo"), hi.alias("_hi"))
            .select(F.explode(F.sequence("_lo", "_hi", step)).alias(out_col)))


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (join_scalar_broadcast).

    The right side is a global aggregate -> exactly one row, broadcast.
    """
    return df.crossJoin(F.broadcast(scalars))


def range_join_promo(days: DataFrame, date_col: str, instances: DataFrame) -> DataFrame:
    """Days x promo instances with ``date BETWEEN start AND end`` (join_range_promo).

    ``instances`` is the expanded yearly schedule (years x 6 rows) -> broadcast
    nested-loop join with a range condition; output is one row per
    (day, covering instance).
    """
    inst = F.broadcast(instances)
    cond = (F.col(date_col) >= F.col("start_date")) & (F.col(date_col) <= F.col("end_date"))
    return days.join(inst, cond, "inner")


def nearest_event(days: DataFrame, date_col: str, events: DataFrame, event_col: str,
                  window: int, sentinel: int, out_col: str) -> DataFrame:
    """Signed days to the nearest event within +-window, else the sentinel.

    Broadcast range join on |datediff| <= window against a literal event list,
    ``min_by(diff, abs(diff))`` per day (ties: the earlier event, i.e. the
    positive difference comes after the negative one in |.|, smallest first).
    """
    ev = F.broadcast(events.select(F.col(event_col).alias("_ev")))
    diff = F.datediff(F.col(date_col), F.col("_ev"))
    cand = (days.select(date_col).distinct()
            .join(ev, F.abs(F.datediff(F.col(date_col), F.col("_ev"))) <= window, "inner")
            .select(date_col, diff.alias("_d")))
    best = (cand.groupBy(date_col)
            .agg(F.min_by("_d", F.struct(F.abs("_d"), F.col("_d"))).alias(out_col)))
    return (days.join(best, date_col, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(sentinel))))


def lag_by_date(df: DataFrame, keys: list[str], date_col: str, value_col: str,
                days: int, out_col: str) -> DataFrame:
    """Value at date - k days via an equi self-join on the shifted date (join_lag_self).

    Joins on (keys, date) — no window, so a long series is spread over many
    tasks by the hash of (series, date) rather than held by one task.
    """
    shifted = df.select(*keys, F.date_add(F.col(date_col), days).alias(date_col),
                        F.col(value_col).alias(out_col))
    return df.join(shifted, keys + [date_col], "left")
