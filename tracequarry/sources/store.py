"""Runs of findings kept as Parquet, nested columns included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one file of a partition takes at most.
FILE_ROWS = 2_000_000


def write_run(findings: DataFrame, path: str, by: str = "project_id") -> None:
    """Writes findings, replacing those of the same projects and leaving the others.

    Rows are spread over tasks by project and a salt of eight, so a project that holds most rows
    is written by several tasks and a small one to few files.
    """
    (
        findings.repartition(by, F.pmod(F.xxhash64("id"), F.lit(8)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", FILE_ROWS)
        .partitionBy(by)
        .parquet(path)
    )


def read_findings(spark: SparkSession, path: str, latest_only: bool = False, by: str = "project_id") -> DataFrame:
    """All stored findings, whatever columns their runs had; with latest_only those of each project's greatest run_id."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if not latest_only:
        return rows
    latest = rows.groupBy(by).agg(F.max("run_id").alias("run_id"))
    return rows.join(latest, [by, "run_id"], "left_semi")


def union_versions(*tables: DataFrame) -> DataFrame:
    """Tables of different versions below each other; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def export_json(findings: DataFrame, path: str) -> None:
    """JSON lines, nested lists as such."""
    findings.write.mode("overwrite").json(path)
