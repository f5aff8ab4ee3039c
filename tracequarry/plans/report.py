"""Reports, rows per run and format in parts: totals, validation, weaknesses, and all findings by rank with what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.analytics import SEVERITIES, report_verdict, severity_distribution
from tracequarry.operators.correlate import CWE_NAMES, lookup

#: Findings that a part of a report lists.
LISTED = 500
FORMATS = ("json", "markdown", "html")
#: What a report says of a finding, in this order.
FIELDS = (
    "rank", "finding_no", "title", "category", "severity", "cwe", "weakness", "file", "line", "function", "confidence", "score", "verdict", "status",
    "tools", "reachability", "controllability", "evidence", "notes", "snippet", "flow", "chain",
)
TEXTS = ("snippet", "flow", "chain")


def _escape(col):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def _totals(ranked: DataFrame) -> DataFrame:
    """A row per run: counts by severity, of demoted and structurally confirmed findings, and of each weakness."""
    demoted = F.col("status") == "likely_false_positive"
    confirmed = ~demoted & F.startswith("notes", F.lit("structural validation:"))
    judged = ranked.groupBy("run_id").agg(F.count_if(demoted).alias("demoted"), F.count_if(confirmed).alias("confirmed"))
    by_cwe = ranked.groupBy("run_id", "cwe").agg(F.count(F.lit(1)).alias("findings"))
    cwes = by_cwe.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("cwe", "findings"))).alias("cwes"))
    return severity_distribution(ranked, "run_id").join(judged, "run_id").join(cwes, "run_id")


def _json(within) -> Column:
    listing, whole = F.to_json("findings"), F.to_json(F.struct("run_id", "total", *SEVERITIES, "demoted", "confirmed", "cwes"))
    head = F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(',"findings":['))
    return within(head, ",", F.substring(listing, F.lit(2), F.length(listing) - 2), "]}")


def _markdown(within, counts: Column) -> Column:
    def item(f):
        first = F.format_string("## %s %s\n- %s, %s %s, score %.1f, %s\n- %s:%d", f["finding_no"], f["title"], f["severity"], f["cwe"], f["weakness"], f["score"], f["verdict"], f["file"], f["line"])
        known = {"tools": F.array_join(f["tools"], ", "), "evidence": F.array_join(f["evidence"], ", "), "flow": f["flow"], "chain": f["chain"], "notes": f["notes"]}
        said = [F.when(v != "", F.concat(F.lit(f"\n- {k}: "), v)).otherwise("") for k, v in known.items()]
        return F.concat(first, *said, F.when(f["snippet"] != "", F.concat(F.lit("\n```\n"), f["snippet"], F.lit("\n```"))).otherwise(""))

    judged = F.format_string("%d demoted, %d confirmed; ", "demoted", "confirmed")
    cwes = F.array_join(F.transform("cwes", lambda c: F.format_string("%s %d", c["cwe"], c["findings"])), ", ")
    head = F.concat(F.format_string("# Run %d\n%d findings: ", "run_id", "total"), counts, F.lit("\n"), judged, cwes, F.lit("\n"))
    return within(head, "\n", F.array_join(F.transform("findings", item), "\n"), "")


def _html(within, counts: Column) -> Column:
    def cell(f):
        place = F.concat(f["file"], F.lit(":"), f["line"].cast("string"))
        shown = [f["finding_no"], _escape(f["title"]), f["severity"], f["cwe"], F.format_string("%.1f", f["score"]), f["verdict"], _escape(place), F.concat(F.lit("<pre>"), _escape(f["snippet"]), F.lit("</pre>"))]
        return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *shown), F.lit("</td></tr>"))

    head = F.concat(F.format_string("<html><body><h1>Run %d</h1><p>", "run_id"), counts, F.format_string("; %d demoted, %d confirmed</p><table>", "demoted", "confirmed"))
    return within(head, "", F.array_join(F.transform("findings", cell), ""), "</table></body></html>")


def reports(ranked: DataFrame, formats: tuple[str, ...] = FORMATS, listed: int = LISTED, evidence: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(run_id, format, part, text) from ranked findings, all of them; joined in order the parts of a report are its text.

    evidence: finding_id, evidence_type, evidence_source; texts: id, snippet, flow, chain.
    A part, numbered from 0, lists `listed` findings, so no run is gathered in one group.
    """
    shown = ranked.withColumns(
        {
            "part": F.floor((F.col("rank") - 1) / listed).cast("int"), "verdict": report_verdict(F.col("status"), F.col("notes")), "score": F.col("priority"),
            "weakness": lookup(F.col("cwe"), CWE_NAMES, "Unknown CWE"), "confidence": F.col("confidence").cast("double"),
        }
    )
    none = F.array().cast("array<string>")
    if evidence is None:
        shown = shown.withColumn("evidence", none)
    else:
        kind = F.concat(F.coalesce("evidence_type", F.lit("")), F.lit(":"), F.coalesce("evidence_source", F.lit("")))
        brought = evidence.groupBy(F.col("finding_id").alias("id")).agg(F.array_sort(F.collect_set(kind)).alias("evidence"))
        shown = shown.join(brought, "id", "left").withColumn("evidence", F.coalesce("evidence", none))
    if texts is not None:
        shown = shown.join(texts.select("id", *TEXTS), "id", "left")
    known = lambda c: F.coalesce(c, F.lit("")) if texts is not None else F.lit("")
    shown = shown.withColumns({c: known(c) for c in TEXTS})
    joined = shown.groupBy("run_id", "part").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("findings")).join(_totals(ranked), "run_id")
    counts = F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in SEVERITIES])
    start, end = F.col("part") == 0, F.col("part") == F.floor((F.col("total") - 1) / listed)
    within = lambda head, sep, body, tail: F.concat(F.when(start, head).otherwise(F.lit(sep)), body, F.when(end, tail).otherwise(""))
    text = {"json": _json(within), "markdown": _markdown(within, counts), "html": _html(within, counts)}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), text[f].alias("text")) for f in formats])).alias("r")
    return joined.select("run_id", "part", each).select("run_id", "r.format", "part", "r.text")


def write_reports(ranked: DataFrame, path: str, formats: tuple[str, ...] = FORMATS) -> dict[str, Exception]:
    """A folder per format, parts in Parquet rows. A failing format does not keep the others; the errors are returned by format."""
    failed = {}
    for f in formats:
        try:
            reports(ranked, (f,)).write.mode("overwrite").parquet(f"{path}/{f}")
        except Exception as error:
            failed[f] = error
    return failed
