"""Distributions and summaries of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["critical", "high", "medium", "low"]


def severity_distribution(findings: DataFrame, group: str) -> DataFrame:
    """Counts of the four severities in each group, zeros included, as columns."""
    return findings.groupBy(group).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))


def top_values(findings: DataFrame, value: str, n: int = 5) -> DataFrame:
    """The most frequent values with their counts, equal ones by value; a top-n report."""
    return findings.where(F.col(value) != "").groupBy(value).agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), value).limit(n)


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def validation_summary(findings: DataFrame) -> DataFrame:
    """Per weakness and in total (cwe null): findings, demoted, structurally demoted, rate of demotion.

    A finding is demoted if its status is likely_false_positive, structurally if its notes
    begin with 'structural validation:'.
    """
    demoted = F.col("status") == "likely_false_positive"
    structural = F.startswith("notes", F.lit("structural validation:"))
    rows = findings.rollup("cwe").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(demoted).alias("demoted"),
        F.count_if(demoted & structural).alias("structurally_demoted"),
        F.count_if(~demoted & structural).alias("structurally_confirmed"),
    )
    rate = F.round(F.col("demoted").cast("decimal(18,6)") / F.col("findings").cast("decimal(18,6)"), 4).cast("double")
    return rows.withColumn("rate", rate)


def report_verdict(status: Column, notes: Column) -> Column:
    """What a report says of a finding's validation."""
    return (
        F.when(status == "likely_false_positive", "likely_fp")
        .when(F.startswith(notes, F.lit("structural validation:")), "confirmed")
        .otherwise("suspicious")
    )


def without_false_positives(findings: DataFrame) -> DataFrame:
    return findings.where("status <> 'likely_false_positive'")


def list_findings(findings: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    """The findings with the highest priority, of one severity if given: filtered first, then limited."""
    kept = findings.where(F.col("severity") == severity) if severity else findings
    return kept.orderBy(F.desc("priority"), "run_id", "id").limit(limit)


def latest_run(findings: DataFrame) -> DataFrame:
    """The findings of the run with the greatest id."""
    last = findings.agg(F.max("run_id").alias("run_id"))
    return findings.join(F.broadcast(last), "run_id", "left_semi")


def tool_status(results: DataFrame) -> DataFrame:
    """Results and files by tool."""
    return results.groupBy("tool").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("file").alias("files"))
