"""Sinks: reports as files, and the scan's state as a table that is replaced whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report


def write_report(findings: DataFrame, path: str, kind: str) -> None:
    """csv, json (a line per finding), sarif (one document) or parquet, in a folder."""
    if kind == "csv":
        report.csv_lines(findings).select(F.col("line").alias("value")).write.text(path)
    elif kind == "json":
        report.json_rows(findings).select(F.col("json").alias("value")).write.text(path)
    elif kind == "sarif":
        report.sarif_report(findings).select(F.col("json").alias("value")).coalesce(1).write.text(path)
    elif kind == "parquet":
        findings.write.parquet(path)
    else:
        raise ValueError(f"no such kind of report: {kind}")


def replace_state(spark: SparkSession, state: DataFrame, path: str) -> None:
    """Writes beside the table and renames, so that readers see the old state or the new one. state may read the old table."""
    beside = f"{path}.{uuid.uuid4().hex}"
    state.write.parquet(beside)
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    if fs.exists(old):
        fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)
