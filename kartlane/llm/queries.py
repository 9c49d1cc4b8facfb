"""The registered queries ``op1_...`` to ``op13_...``, with SQL twins where SQL can say them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query name -> (module of this package, function(spark, sf_dir))
NAMES = {
    "op1_url_filter": ("q_native", "op1"),
    "op2_pq_dedup": ("q_arrow", "op2"),
    "op3_jaccard": ("q_arrow", "op3"),
    "op4_warc": ("q_arrow", "op4"),
    "op5_bpe": ("q_arrow", "op5"),
    "op6_quality": ("q_arrow", "op6"),
    "op7_html": ("q_arrow", "op7"),
    "op8_packing": ("q_arrow", "op8"),
    "op9_toxicity": ("q_arrow", "op9"),
    "op10_simhash": ("q_native", "op10"),
    "op11_licenses": ("q_arrow", "op11"),
    "op12_hard_negatives": ("q_arrow", "op12"),
    "op13_collocations": ("q_arrow", "op13"),
}


def _runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .common import bounded_batches
        bounded_batches(spark)
        module, function = NAMES[name]
        return getattr(importlib.import_module(f"{__package__}.{module}"), function)(spark, sf_dir)
    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    from . import sql
    return dict(sql.ORACLE)
