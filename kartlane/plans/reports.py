"""Sinks: report tables, fact tables, run metadata, forecast file, as versions that appear whole or not at all.

All writes go under the session's shared checkpoint folder (or an explicit
output root) — never a machine-local temp dir on a cluster.
"""

from __future__ import annotations

import json
import uuid
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartlane.session import checkpoint_dir, shuffles_removed


def output_root(spark, root: str | None = None) -> str:
    return (root or checkpoint_dir(spark)).rstrip("/")


def commit(frames: dict, root: str, fmt: str = "parquet", partition: dict[str, str] | None = None) -> dict[str, str]:
    """Write all frames as one new version below ``root``; returns name -> path.

    A frame may be a function ``(write, done)`` instead, which makes it from the tables of the
    version that are ``done`` and calls ``write`` on it (with ``dealt`` where rows of a folder
    have met already). Each write takes its shuffles with it.

    The frames go to a folder of their own, are read back and summed up (rows, and a
    digest of all cells), and the last step writes the manifest, a single row in a folder
    named by the version. Readers take the newest manifest, so a write that fails on
    the way leaves the version before as it was; its own files are never looked at.
    """
    spark = next((f.sparkSession for f in frames.values() if isinstance(f, DataFrame)), None) or SparkSession.active()
    last = latest(spark, root)
    version = (last["version"] if last else 0) + 1
    folder = f"{root}/data/{version:08d}-{uuid.uuid4().hex[:8]}"
    tables, done = {}, {}

    def write(df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
        path = f"{folder}/{name}"
        by = (partition or {}).get(name)
        # a month's rows meet before they are written, in tasks of bounded size: else every task has a file of every month
        w = (df if dealt else df.hint("rebalance", by)).write.partitionBy(by) if by else df.write
        with shuffles_removed(spark):
            (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
        out = _read(spark, path, fmt, df.schema)
        rows, digest = summed(out)
        tables[name] = {"path": path, "rows": rows, "digest": digest, "schema": df.schema.json()}
        return out

    for name, df in frames.items():
        put = partial(write, name=name)
        done[name] = put(df) if isinstance(df, DataFrame) else df(put, done)
    manifest = json.dumps({"version": version, "format": fmt, "tables": tables}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{root}/manifests/{version:08d}-{uuid.uuid4().hex[:8]}")
    return {n: t["path"] for n, t in tables.items()}


def summed(df: DataFrame) -> tuple[int, str]:
    """Rows, and the sum of their hashes: the same whatever their order."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("s")).first()
    return r.n, str(r.s or 0)


def latest(spark, root: str) -> dict | None:
    """The newest whole manifest below ``root``, or None."""
    try:
        # one row a version
        found = [json.loads(r.value) for r in spark.read.option("wholetext", True).text(f"{root}/manifests/*").collect()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return max(found, key=lambda m: m["version"], default=None)


def read_version(spark, root: str, check: bool = False) -> dict[str, DataFrame]:
    """The tables of the newest version; with ``check`` their rows and digests are compared with the manifest."""
    manifest = latest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no version below {root}")
    out = {}
    for name, t in manifest["tables"].items():
        out[name] = _read(spark, t["path"], manifest["format"], T.StructType.fromJson(json.loads(t["schema"])))
        if check and summed(out[name]) != (t["rows"], t["digest"]):
            raise ValueError(f"{name} is not what version {manifest['version']} says")
    return out


def _read(spark, path: str, fmt: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def write_reports(reports: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """write_eda_reports: all reports as one version; returns name -> path."""
    return commit(reports, root, fmt)


def write_facts(facts: dict, root: str) -> dict[str, str]:
    """All fact tables as one version of Parquet; month-grained facts partitioned by month."""
    return commit(facts, root, partition={"customer_cohort_activity_fact": "order_month", "product_month_inventory_fact": "snapshot_month"})


def write_run_metadata(spark, meta: dict, root: str) -> str:
    """One-row JSON record of parameters / weights / scores."""
    path = f"{root}/run_metadata"
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "meta string") \
        .write.mode("overwrite").text(path)
    return path


def write_and_read_fact(cat) -> DataFrame:
    """Derived scan: order fact written as Parquet, read back with typed dates."""
    from kartlane.operators.facts import order_fact
    root = output_root(cat.spark)
    path = f"{root}/order_fact_{uuid.uuid4().hex[:8]}"
    order_fact(cat).write.mode("overwrite").parquet(path)
    back = cat.spark.read.parquet(path)
    return back.select("order_id", "order_date", "order_month", "customer_id", "net_revenue",
                       F.datediff("order_date", "order_month").alias("day_of_month0"))
