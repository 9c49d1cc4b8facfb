"""Training-corpus pipeline: toxicity, quality, near duplicates, packing.

Each stage reads everything that the stage before it kept; all but the last
return the columns of ``documents``, whatever these are. Defined results: every
row is a document of its own to the near-duplicate stage, judged by its text
alone; of linked rows the one of the least id stays (an arbitrary one of those
that repeat it), and a row without an id only if no row of its group has one.
Rows without text link with nothing and stay. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartlane.llm import jaccard, packing, quality, toxicity
from kartlane.llm.common import bounded_batches, materialize
from kartlane.llm.q_arrow import labels, tokenizer_path

BROADCAST_ROWS = 1_000_000  # row keys that may be broadcast (8 MB); beyond, a shuffled join


def _whole(docs: DataFrame) -> DataFrame:
    """Each row with all its columns in one struct, so that their names clash with nothing."""
    return docs.select(F.struct("*").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not predict to be toxic."""
    bounded_batches(spark)
    model, coef = toxicity.train(docs, labels(spark, sf_dir))
    return toxicity.score(_whole(docs), model, coef, ["row"], "row.text").where("score < 0.5").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network predicts to be good."""
    bounded_batches(spark)
    net, coef = quality.train(docs, labels(spark, sf_dir))
    return quality.score(_whole(docs), net, coef, ["row"], "row.text").where("score >= 0.5").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group linked by five-word shingles at a Jaccard index of 0.8."""
    bounded_batches(spark)
    # the key alone tells rows apart; the whole row is written beside it, its text being read from there
    rows = materialize(_whole(docs).select(F.monotonically_increasing_id().alias("key"), "row"))
    kept = materialize(jaccard.first_rows(rows.select("key", "row.doc_id", "row.text"), words=5, num=80, den=100))
    small = kept.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(kept) if small else kept, "key", "left_semi").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents, in sequences of at most 4096 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", one_of_each), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
