"""The whole analysis of source files and scanner outputs as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.operators import correlate as C
from tracequarry.operators import rules, structure, taint, validate
from tracequarry.operators.ordering import rank_within
from tracequarry.session import cut
from tracequarry.sources.code import vendored_hint
from tracequarry.sources.scanners import PARSERS


@dataclass
class Config:
    """Which rules run (all by default), how strict validation is, how many lines a snippet shows around its own."""

    rules: list[str] = field(default_factory=lambda: list(rules.REGISTRY))
    strict: bool = False
    around: int = 15

    @classmethod
    def of(cls, given: dict) -> Config:
        """From a mapping; unknown keys are ignored."""
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})


def _shaped(found: DataFrame, order: int | str, *more: str) -> DataFrame:
    """Findings of one origin as `correlate` reads them; ids follow the order of origins."""
    first = F.lit(order) if isinstance(order, int) else F.col(order)
    code = F.xxhash64("file", "line", "title", "nth").bitwiseAND(F.lit(2**48 - 1))
    return found.select(
        (first.cast("long") * F.lit(2**48) + code).alias("id"), F.lit(1).cast("long").alias("run_id"), "title", "category", "cwe", "severity",
        F.col("confidence").cast("decimal(18,6)").alias("confidence"), "file", "line", "function", "tools", F.lit("unknown").alias("reachability"),
        F.lit("unknown").alias("controllability"), F.lit("new").alias("status"), "notes", *more,
    )


def candidates(files: DataFrame, outputs: dict[str, DataFrame] | None = None, config: Config | None = None) -> DataFrame:
    """Rule findings of files and the findings of captured scanner outputs, by tool name, in one form."""
    config = config or Config()
    out = _shaped(rules.rule_findings(files, config.rules).withColumn("function", F.lit("")), "rule_ord")
    for k, (tool, captured) in enumerate(sorted((outputs or {}).items())):
        parsed = PARSERS[tool](captured).select("*", F.array("tool").alias("tools"), F.lit("").alias("notes"), F.xxhash64("cwe", "severity", "function").alias("nth"))
        out = out.unionByName(_shaped(parsed, len(rules.REGISTRY) + k))
    return out


def _alone(hits: DataFrame) -> DataFrame:
    """Taint hits that no rule covers, as merged findings; their sink, tainted names and flow are bound already."""
    found = taint.standalone(hits, "sink", "tainted", "flow").withColumns({"nth": F.xxhash64("function", "tainted"), "notes": F.lit("")})
    shaped = _shaped(found, len(rules.REGISTRY) + len(PARSERS), "sink", "tainted", "flow")
    one = F.lit(1).cast("int")
    return shaped.withColumns({"fp": C.fingerprint(*[F.col(c) for c in ("file", "line", "function", "cwe", "title")]), "copies": one, "merged": one})


def analyse(files: DataFrame, outputs: dict[str, DataFrame] | None = None, config: Config | None = None) -> DataFrame:
    """Ranked findings with function, snippet, vendor folder, taint, call chain and verdict.

    files: file, text; outputs: captured scanner outputs by tool name (`PARSERS`), each with a
    column payload. Candidates are deduplicated and merged, bound to taint, joined by the taint
    hits that no rule covers, placed in their functions, validated against the lines around them,
    given the call chain from an entry point of the files, then scored and numbered.
    """
    config = config or Config()
    merged = C.merge(C.deduplicate(candidates(files, outputs, config)))
    hits = cut(taint.taint_hits(taint.tainted_functions(files)))
    placed = structure.enrich(taint.bind(merged, hits).unionByName(_alone(hits)).withColumnRenamed("flow", "dataflow").drop("controllability"), files, config.around)
    alone = F.col("category") == taint.CATEGORY
    control = F.when(alone, "high").otherwise(taint.controllability(F.col("tainted"), F.col("guarded")))
    bound = placed.withColumns(
        {"controllability": control, "vendor_source": vendored_hint(F.col("file")), "attack_surface": taint.surface(F.col("tainted")), "taint_info": taint.told(F.col("guarded"))}
    ).drop("guarded")
    applied = validate.apply_verdicts(validate.verdicts(bound.withColumn("flow", F.col("dataflow")), config.strict)).drop("lines", "at", "flow")
    reached = structure.reach(applied, files)
    n = F.size("tools")
    confidence = C.adjusted(F.col("confidence"), n, F.size("doubts"), F.when(alone, 0).otherwise(n), F.col("reachability"))
    scored = reached.withColumn("confidence", confidence).withColumns(
        {"bucket": C.bucket(F.col("cwe")), "priority": C.priority(F.col("severity"), F.col("confidence"), F.col("reachability"), F.col("controllability"), n)}
    )
    return rank_within(scored, "run_id", [F.desc("priority"), F.asc("file"), F.asc("line"), F.asc("id")]).withColumn("finding_no", F.format_string("F-%05d", "rank"))
