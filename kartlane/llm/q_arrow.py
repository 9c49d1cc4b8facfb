"""Queries of the operators that run numpy or library code in Arrow tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard
    return jaccard.near_duplicates(documents(spark, sf_dir), words=4, num=85, den=100)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    return (warc.round_trip(pages(spark, sf_dir))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import htmltext
    return htmltext.extract(pages(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pq
    return pq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses
    return licenses.summary(licenses.matches(documents(spark, sf_dir)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hardneg
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations
    return collocations.collocations(documents(spark, sf_dir))
