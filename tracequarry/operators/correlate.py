"""From candidate findings to ranked ones: fingerprints, merging, scores and ids.

Scores are computed in decimal and rounded before they become doubles, so that they do not
depend on the order of additions. Groups are aggregated with partial results before the
shuffle; ids within a group come from a range partitioning, so a group of any size is numbered
by many tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import clean
from tracequarry.functions.regexes import has
from tracequarry.operators.ordering import rank_within

# Fixed values
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}
REACH_BONUS = {"high": "0.15", "medium": "0.08", "low": "0.03"}
CONTROL_BONUS = {"high": "0.15", "medium": "0.08"}
BUCKETS = {
    "memory-safety": ["CWE-119", "CWE-120", "CWE-131", "CWE-416", "CWE-415"],
    "integer-safety": ["CWE-190"],
    "null-safety": ["CWE-476"],
    "resource-management": ["CWE-401", "CWE-404"],
    "deserialization": ["CWE-502"],
    "input-validation": ["CWE-20"],
    "error-handling": ["CWE-252"],
}
CWE_NAMES = {
    "CWE-119": "Improper Restriction of Operations within the Bounds of a Memory Buffer",
    "CWE-120": "Buffer Copy without Checking Size of Input",
    "CWE-131": "Incorrect Calculation of Buffer Size",
    "CWE-190": "Integer Overflow or Wraparound",
    "CWE-401": "Missing Release of Memory after Effective Lifetime",
    "CWE-404": "Improper Resource Shutdown or Release",
    "CWE-415": "Double Free",
    "CWE-416": "Use After Free",
    "CWE-457": "Use of Uninitialized Variable",
    "CWE-476": "NULL Pointer Dereference",
    "CWE-502": "Deserialization of Untrusted Data",
    "CWE-563": "Assignment to Variable without Use",
    "CWE-697": "Incorrect Comparison",
    "CWE-823": "Use of Out-of-range Pointer Offset",
    "CWE-1164": "Unnecessary Code",
    "CWE-0": "Uncategorized",
}
BASE_SEVERITY = {
    "CWE-416": "high", "CWE-415": "high", "CWE-120": "high", "CWE-190": "medium", "CWE-476": "medium",
    "CWE-119": "medium", "CWE-401": "low", "CWE-404": "low", "CWE-457": "medium", "CWE-502": "high",
}
INPUT_SOURCES = {
    "network": r"\b(recv|recvfrom|accept|read.*socket|inet_|htons|ntohs)\b",
    "filesystem": r"\b(fopen|open|fread|read)\b",
    "environment": r"\b(getenv|environ)\b",
    "cli": r"\b(argv|getopt|argp)\b",
    "ipc": r"\b(shmget|mmap|pipe|fork|msgget|semget)\b",
}
CONTROL_OF_SOURCE = {
    "network": "high", "ipc": "high", "cli": "high", "filesystem": "medium", "environment": "medium",
    "configuration": "medium", "library_api": "low", "internal": "low",
}


#: What there is one merged finding of; a fingerprint holds all of it but the run.
GROUP = ["run_id", "file", "line", "cwe"]


def dec(value: str | int) -> Column:
    return F.lit(Decimal(str(value)))


def lookup(col: Column, values: dict, default) -> Column:
    """A constant table as a CASE expression."""
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def stage(findings: DataFrame, once: bool = True) -> DataFrame:
    """The findings table in one form: one row per id (as often as it is there, without `once`), enumerations, paths, weaknesses and tools normalised.

    Missing text is '', a missing line or confidence 0, a missing enumeration 'unknown'
    (severity: 'medium', status: 'new'), a missing weakness CWE-0. has_flow and has_chain tell of a
    data flow and a call chain that aren't empty.
    """
    f = F.col
    text = lambda c: F.coalesce(F.regexp_replace(f(c), r"^\s+|\s+$", ""), F.lit(""))
    listed = lambda c: (F.coalesce(F.json_array_length(c), F.lit(0)) > 0) if c in findings.columns else F.lit(False)
    kind = lambda c, default="unknown": F.coalesce(clean.word(f(c)), F.lit(default))
    # Long texts become flags before the shuffle by id, all else is normalised after it.
    flags = [listed("dataflow").alias("has_flow"), listed("call_chain").alias("has_chain")]
    rows = findings.where("id is not null").select("*", *flags)
    rows = rows.dropDuplicates(["id"]) if once else rows
    return rows.select(
        "id", "run_id", "finding_id", text("title").alias("title"), kind("category").alias("category"),
        F.coalesce(clean.cwe(f("cwe")), F.lit("CWE-0")).alias("cwe"), kind("severity", "medium").alias("severity"),
        F.coalesce(clean.share(f("confidence")), F.lit(0.0)).cast("decimal(18,6)").alias("confidence"),
        F.coalesce(clean.posix_path(f("file_path")), F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"),
        text("function_name").alias("function"), clean.tool_list(f("tools")).alias("tools"), kind("reachability").alias("reachability"),
        kind("controllability").alias("controllability"), kind("status", "new").alias("status"), text("notes").alias("notes"),
        "has_flow", "has_chain",
    )


def fingerprint(file: Column, line: Column, function: Column, cwe: Column, title: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the joined parts; null parts count as ''."""
    parts = [file, line.cast("string"), function, cwe, F.lower(F.regexp_replace(title, r"^\s+|\s+$", ""))]
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def _union(arrays: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(arrays))))


def deduplicate(staged: DataFrame) -> DataFrame:
    """One finding per run and fingerprint: the first by id, tools united, confidence raised by the copies."""
    keyed = staged.withColumn("fp", fingerprint(*[F.col(c) for c in ("file", "line", "function", "cwe", "title")]))
    base = F.struct(*[c for c in staged.columns if c not in ("run_id", "tools")])
    grouped = keyed.groupBy("run_id", "fp").agg(F.min_by(base, "id").alias("b"), _union("tools").alias("tools"), F.count(F.lit(1)).cast("int").alias("copies"))
    raised = F.least(F.col("confidence") + F.least(dec("0.15") * (F.col("copies") - 1), dec("0.3")), dec(1)).cast("decimal(18,6)")
    return grouped.select("run_id", "fp", "copies", "b.*", "tools").withColumn("confidence", raised)


def merge(findings: DataFrame) -> DataFrame:
    """One finding per run, file, line and weakness: the most confident (first by id), tools united."""
    base = F.struct(*[c for c in findings.columns if c not in (*GROUP, "tools")])
    grouped = findings.groupBy(*GROUP).agg(
        F.max_by(base, F.struct("confidence", -F.col("id"))).alias("b"), _union("tools").alias("tools"), F.count(F.lit(1)).cast("int").alias("merged")
    )
    raised = F.least(F.col("confidence") + F.least(dec("0.1") * (F.col("merged") - 1), dec("0.25")), dec(1)).cast("decimal(18,6)")
    return grouped.select(*GROUP, "merged", "b.*", "tools").withColumn("confidence", raised)


def adjusted(confidence: Column, tools: Column, doubts: Column, evidence: Column, reachability: Column) -> Column:
    """Confidence after the bonuses and penalties for the numbers of tools, doubts and evidence and for reachability.

    Clamped to [0, 1] after each step, in this order, and rounded to three places.
    """
    c = confidence.cast("decimal(18,6)")
    c = F.when(tools >= 3, F.least(c + dec("0.15"), dec(1))).when(tools >= 2, F.least(c + dec("0.10"), dec(1))).otherwise(c)
    c = F.when(doubts > 0, F.greatest(c - F.least(dec("0.1") * doubts, dec("0.3")), dec(0))).otherwise(c)
    c = F.when(evidence > 0, F.least(c + F.least(dec("0.05") * evidence, dec("0.15")), dec(1))).otherwise(c)
    c = F.when(reachability == "high", F.least(c + dec("0.05"), dec(1))).when(reachability == "low", F.greatest(c - dec("0.05"), dec(0))).otherwise(c)
    return F.round(c, 3).cast("decimal(18,6)")


def priority(severity: Column, confidence: Column, reachability: Column, controllability: Column, tools: Column) -> Column:
    """Score from 0 to 10, rounded to one place."""
    weight = lookup(severity, {k: Decimal(v) for k, v in SEVERITY_WEIGHT.items()}, Decimal(1))
    reach = lookup(reachability, {k: Decimal(v) for k, v in REACH_BONUS.items()}, Decimal("0.00"))
    control = lookup(controllability, {k: Decimal(v) for k, v in CONTROL_BONUS.items()}, Decimal("0.00"))
    raw = weight * dec("2.5") * confidence + (reach + control + F.least(dec("0.05") * tools, dec("0.15"))) * 10
    return F.round(F.least(raw, dec(10)), 1).cast("double")


def bucket(cwe: Column) -> Column:
    return lookup(cwe, {c: name for name, cwes in BUCKETS.items() for c in cwes}, "general")


def input_source(text: Column) -> Column:
    """Which boundary a line of code reads from, the first that fits; 'unknown' for none."""
    out = F.lit("unknown")
    for name, pattern in reversed(INPUT_SOURCES.items()):
        out = F.when(has(text, pattern), F.lit(name)).otherwise(out)
    return out


def control_level(source: Column) -> Column:
    return lookup(F.lower(source), CONTROL_OF_SOURCE, "unknown")


def evidence_of(findings: DataFrame) -> DataFrame:
    """(id, evidence_type, evidence_source, detail): one row for each tool of a finding, rules apart, one for a data flow, one for a call chain."""
    row = lambda kind, source, detail: F.struct(kind.alias("evidence_type"), source.alias("evidence_source"), detail.alias("detail"))

    def tool(t):
        rule = F.startswith(t, F.lit("rule:"))
        return row(F.when(rule, "custom_rule").otherwise("static_analyzer"), t, F.concat(F.when(rule, "Matched by custom rule: ").otherwise("Detected by "), t))

    marker = lambda flag, kind, detail: F.when(F.col(flag), row(F.lit(kind), F.lit(""), F.lit(detail)))
    markers = F.array_compact(F.array(marker("has_flow", "dataflow", "Dataflow path identified"), marker("has_chain", "call_graph", "Call chain identified")))
    return findings.select("id", F.explode(F.concat(F.transform("tools", tool), markers)).alias("e")).select("id", "e.*")


def score(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds bucket, adjusted confidence and priority; evidence counts once by type and source.

    A status of likely_false_positive is one doubt.
    """
    counted = evidence.where("finding_id is not null").select("finding_id", "evidence_type", "evidence_source").distinct().groupBy("finding_id").agg(F.count(F.lit(1)).cast("int").alias("n_evidence"))
    return _scored(findings.join(counted, findings["id"] == counted["finding_id"], "left").drop(counted["finding_id"]))


def _scored(counted: DataFrame) -> DataFrame:
    doubts = (F.col("status") == "likely_false_positive").cast("int")
    n = F.size("tools")
    return (
        counted.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
        .withColumn("confidence", adjusted(F.col("confidence"), n, doubts, F.col("n_evidence"), F.col("reachability")))
        .withColumns({"bucket": bucket(F.col("cwe")), "priority": priority(F.col("severity"), F.col("confidence"), F.col("reachability"), F.col("controllability"), n)})
    )


def group_evidence(staged: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, file, line, cwe, n_evidence): different evidence of all findings of each merged group."""
    member = staged.select(*GROUP, F.col("id").alias("finding_id"))
    brought = evidence.where("finding_id is not null").select("finding_id", "evidence_type", "evidence_source").join(member, "finding_id")
    return brought.select(*GROUP, "evidence_type", "evidence_source").distinct().groupBy(*GROUP).agg(F.count(F.lit(1)).cast("int").alias("n_evidence"))


def united_evidence(staged: DataFrame, merged: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence with the id of the merged finding that its own finding became part of.

    A fingerprint holds file, line and weakness, so deduplication and merging keep a row in the
    group of these. Evidence of findings that are in no run is left out.
    """
    kept = merged.select(*GROUP, F.col("id").alias("_kept"))
    member = staged.select(*GROUP, F.col("id").alias("finding_id"))
    brought = evidence.where("finding_id is not null").select("finding_id", "evidence_type", "evidence_source")
    return brought.join(member, "finding_id").join(kept, GROUP).select(F.col("_kept").alias("finding_id"), "evidence_type", "evidence_source")


def ranked(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The whole way: staged findings deduplicated, merged, scored by the evidence of all copies, ranked within their run and numbered."""
    every_row, staged = (stage(findings, once).where("run_id is not null") for once in (False, True))
    # Copies are combined before each shuffle, as one file and line, or none, may hold very many of them.
    scored = _scored(merge(deduplicate(staged)).join(group_evidence(every_row, evidence), GROUP, "left"))
    sizes = findings.where("run_id is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    placed = rank_within(scored, "run_id", [F.desc("priority"), F.asc("id")], sizes)
    return placed.withColumn("finding_no", F.format_string("F-%05d", "rank"))
