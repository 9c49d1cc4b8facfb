"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash, url_filter


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per page; a page's outcome is its document's label (number in the path), good = quality and not toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = (spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id")
              .agg(F.min(F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(),
                                ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))).alias("good")))
    number = F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') as bigint)")
    outcomes = pages.select("url", number.alias("doc_id")).join(labels, "doc_id", "left").select("url", "good")
    return url_filter.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
