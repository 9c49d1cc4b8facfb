"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

A builder takes a ``Catalog`` and returns a lazy DataFrame.  ``finalize``
gives every registered result one stable, engine-neutral shape: integral
types widened to bigint, doubles rounded half-up at 4 decimals, dates as ISO
text (the oracle SQL does the same with ``R``/``D``/``I`` from ``oracle``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartlane.functions.exprs import r4


@dataclass
class Query:
    name: str
    build: Callable
    sql: str | None
    doc: str = ""
    significant: tuple[str, ...] = ()  # small numbers: rounded to 7 significant digits instead of 4 decimals


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, significant: tuple[str, ...] = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip(), significant)
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 4, significant: tuple[str, ...] = ()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = (F.format_string("%.6e", c.cast("double")).cast("double") if f.name in significant
                 else r4(c.cast("double"), digits))
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all_plans() -> dict[str, Query]:
    # importing the plan modules fills REGISTRY
    from kartlane.plans import (q_sources, q_quality, q_facts, q_business, q_demand,  # noqa: F401
                                q_supply, q_features, q_forecast, q_primitives)
    # the reports are the rows of other queries: their row counts are the sink's twin
    REGISTRY["snk_reports"].sql = " UNION ALL ".join(
        f"SELECT '{report}' AS report, count(*) AS rows FROM ({REGISTRY[name].sql})"
        for report, name in q_quality.REPORT_QUERIES.items())
    return REGISTRY
