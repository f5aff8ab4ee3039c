"""Findings in words, and the hook for verdicts from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.analytics import SEVERITIES, severity_distribution
from tracequarry.operators.correlate import CWE_NAMES, lookup


def percent(share: Column) -> Column:
    return F.concat(F.round(share.cast("decimal(18,6)") * 100, 0).cast("int").cast("string"), F.lit("%"))


def narrative(findings: DataFrame) -> Column:
    """One sentence each on what, where and by which tools. Reads title, severity, confidence, file, line, function, cwe, tools."""
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    function = F.when(F.col("function") != "", F.col("function")).otherwise("an unnamed function")
    by = F.when(F.size("tools") > 0, F.array_join("tools", ", ")).otherwise("no tool")
    known = lookup(F.col("cwe"), CWE_NAMES, "Unknown CWE")
    return F.concat(
        "title", F.lit(" ("), "severity", F.lit(", "), percent(F.col("confidence")), F.lit(" confidence) at "), place, F.lit(" in "), function,
        F.lit("; "), "cwe", F.lit(" "), known, F.lit("; reported by "), by, F.lit("."),
    )


def run_summaries(findings: DataFrame, group: str) -> DataFrame:
    """(group, summary): numbers of findings by severity in words, one row per group."""
    dist = severity_distribution(findings, group)
    counts = F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), F.col(s).cast("string")) for s in SEVERITIES])
    urgent = F.col("critical") + F.col("high")
    note = F.when(urgent > 0, F.concat(urgent.cast("string"), F.lit(" need review first"))).otherwise("none is high or critical")
    return dist.select(group, F.concat(F.col("total").cast("string"), F.lit(" candidate findings ("), counts, F.lit("); "), note, F.lit(".")).alias("summary"))


def candidates(findings: DataFrame, least: str = "medium", limit: int = 200) -> DataFrame:
    """The findings to be judged from outside: of that severity at least, the highest priorities first."""
    wanted = SEVERITIES[: SEVERITIES.index(least) + 1]
    return findings.where(F.col("severity").isin(wanted)).orderBy(F.desc("priority"), "id").limit(limit)


def parse_verdicts(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(id, verdict, confidence_override, reason) of JSON answers, also within a fenced block; unreadable ones give no row.

    Verdicts other than confirmed, suspicious and likely_fp are suspicious.
    """
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    items = F.from_json(bare, "array<struct<id: string, verdict: string, confidence_override: double, reason: string>>")
    each = answers.select(F.explode(items).alias("v")).where("v.id is not null")
    verdict = F.when(F.col("v.verdict").isin("confirmed", "suspicious", "likely_fp"), F.col("v.verdict")).otherwise("suspicious")
    return each.select("v.id", verdict.alias("verdict"), "v.confidence_override", "v.reason")


def apply_outside(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings after verdicts by finding_no: false positives demoted, confidence never raised."""
    given = verdicts.groupBy("id").agg(F.min(F.struct("verdict", "confidence_override", "reason")).alias("v"))
    joined = findings.join(given.withColumnRenamed("id", "finding_no"), "finding_no", "left")
    lowered = F.least("confidence", F.coalesce(F.col("v.confidence_override").cast("decimal(18,6)"), F.col("confidence")))
    status = F.when(F.col("v.verdict") == "likely_fp", "likely_false_positive").otherwise(F.col("status"))
    return joined.withColumns({"confidence": lowered, "status": status}).drop("v")


def payload(findings: DataFrame) -> Column:
    """A finding as the JSON object that is handed out for a verdict. Reads the columns of staged and scored findings."""
    return F.to_json(
        F.struct(
            F.col("id"), "title", "category", "cwe", F.initcap("severity").alias("severity"), F.col("confidence").cast("double").alias("confidence"), F.col("priority").alias("priority_score"),
            "file", "line", "function", "tools", "reachability", "controllability",
        )
    )


def parse_challenges(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(id, verdict, reason) of a second outside pass that tries to disprove findings: JSON lists or objects, also within a fenced block.

    Verdicts other than confirmed_fp, challenged and survives are survives; unreadable answers give no row.
    """
    bare = F.regexp_extract(text, r"(?s)(\[.*\]|\{.*\})", 1)
    listed = F.when(F.startswith(bare, F.lit("{")), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)
    each = answers.select(F.explode(F.from_json(listed, "array<struct<id: string, verdict: string, reason: string>>")).alias("v")).where("v.id <> ''")
    verdict = F.when(F.col("v.verdict").isin("confirmed_fp", "challenged"), F.col("v.verdict")).otherwise("survives")
    return each.select("v.id", verdict.alias("verdict"), F.coalesce("v.reason", F.lit("")).alias("reason"))


def apply_challenges(findings: DataFrame, challenges: DataFrame) -> DataFrame:
    """Findings after the second pass by finding_no: disproven ones demoted, challenged ones noted with a doubt.

    doubts and notes grow by what was said; findings without a challenge stay as they are.
    """
    given = challenges.groupBy("id").agg(F.min(F.struct("verdict", "reason")).alias("c"))
    joined = findings.join(given.withColumnRenamed("id", "finding_no"), "finding_no", "left")
    fp, doubted = F.col("c.verdict") == "confirmed_fp", F.col("c.verdict") == "challenged"
    said = F.when(fp, F.concat(F.lit("disproven from outside: "), "c.reason")).when(doubted, F.concat(F.lit("challenged from outside: "), "c.reason"))
    return joined.withColumns(
        {
            "status": F.when(fp, "likely_false_positive").otherwise(F.col("status")),
            "doubts": F.when(said.isNotNull(), F.array_union("doubts", F.array(said))).otherwise(F.col("doubts")),
            "notes": F.when(said.isNotNull(), F.concat_ws(" | ", F.when(F.col("notes") != "", F.col("notes")), said)).otherwise(F.col("notes")),
        }
    ).drop("c")
