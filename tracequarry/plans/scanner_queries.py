"""Queries that write scanner results as each tool's native output, parse it, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.operators import analytics as A
from tracequarry.session import cut, table
from tracequarry.sources import scanners as N

COLUMNS = ["result_id", "title", "category", "cwe", "severity", "confidence", "file", "line", "function", "tool"]


def _once(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "scanner_results").where("result_id is not null").dropDuplicates(["result_id"])


def _results(rows: DataFrame, tool: str) -> DataFrame:
    f = F.col
    return rows.where(N.tool_name(f("tool")) == tool).select(
        "result_id", F.coalesce("check_id", F.lit("")).alias("check"), F.coalesce("reported_path", F.lit("")).alias("path"), "line_no",
        F.coalesce("msg", F.lit("")).alias("msg"), "weakness", F.upper(F.coalesce("level", F.lit(""))).alias("level"),
    )


def native_output(rows: DataFrame, tool: str) -> DataFrame:
    """(result_id, payload): each result as the tool would print it."""
    f, s = F.col, F.struct
    place = s(f("path").alias("file"), f("line_no").alias("line"))
    if tool == "semgrep":
        extra = s(f("msg").alias("message"), f("level").alias("severity"), s(F.when(f("weakness").isNotNull(), F.array("weakness")).alias("cwe")).alias("metadata"))
        body = F.to_json(s(F.array(s(f("check").alias("check_id"), "path", s(f("line_no").alias("line")).alias("start"), extra.alias("extra"))).alias("results")))
    elif tool == "flawfinder":
        body = F.to_json(F.array(s(f("path").alias("fname"), f("line_no").alias("line"), f("check").alias("name"), f("level").try_cast("int").alias("level"), f("weakness").alias("cwe"), f("msg").alias("context"))))
    elif tool == "codeql":
        at = s(s(s(f("path").alias("uri")).alias("artifactLocation"), s(f("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
        body = F.to_json(s(F.array(s(F.array(s(f("check").alias("ruleId"), s(f("msg").alias("text")).alias("message"), F.array(at).alias("locations"))).alias("results"))).alias("runs")))
    elif tool == "clang-analyzer":
        step = s(F.lit("call").alias("kind"), s(F.concat(F.lit("called/"), "path").alias("file"), (f("line_no") + 1).alias("line")).alias("location"))
        body = F.to_json(s(F.array(s(f("msg").alias("description"), place.alias("location"), F.when(f("line_no") % 2 == 0, F.array(step)).alias("path"))).alias("diagnostics")))
    elif tool == "clang-tidy":
        at = s(f("path").alias("File"), f("line_no").alias("FileLine"))
        as_json = F.to_json(s(F.array(s(F.lit("warning").alias("DiagnosticType"), f("check").alias("DiagnosticName"), f("msg").alias("DiagnosticMessage"), at.alias("DiagnosticLocation"))).alias("diagnostics")))
        body = F.when(f("result_id") % 2 == 0, as_json).otherwise(F.format_string("%s:%d:1: warning: %s [%s]", "path", "line_no", "msg", "check"))
    else:
        esc = lambda c: F.replace(F.replace(F.replace(F.replace(f(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        body = F.format_string(
            '<results><errors><error id="%s" severity="%s" msg="%s"><location file="%s" line="%d"/></error></errors></results>', esc("check"), F.lower("level"), esc("msg"), esc("path"), "line_no"
        )
    return rows.select("result_id", body.alias("payload"))


def captured(spark, sf_dir) -> dict[str, DataFrame]:
    """The outputs that the queries below parse, by tool: results as their tools print them and all documents as logs."""
    logs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", F.col("text").alias("payload"))
    rows = cut(_once(spark, sf_dir))
    return {tool: logs if tool == "sanitizer" else native_output(_results(rows, tool), tool) for tool in N.PARSERS}


def _query(tool: str):
    def query(spark, sf_dir):
        return N.PARSERS[tool](native_output(_results(_once(spark, sf_dir), tool), tool)).select(*COLUMNS)

    return query


#: What a runtime would report, by id modulo their number.
RUNTIME_ERRORS = [
    "ERROR: AddressSanitizer: heap-use-after-free on address", "ERROR: AddressSanitizer: attempting double-free on", "ERROR: AddressSanitizer: heap-buffer-overflow on address",
    "ERROR: AddressSanitizer: stack-buffer-overflow on address", "ERROR: AddressSanitizer: global-buffer-overflow on address", "ERROR: AddressSanitizer: SEGV on unknown address",
    "WARNING: MemorySanitizer: use-of-uninitialized-value", "runtime error: signed integer overflow", "SUMMARY: LeakSanitizer: 8 byte(s) leaked", "all tests passed",
]


def runtime_logs(spark, sf_dir) -> DataFrame:
    """(doc_id, payload): the log of a run that fails at the place of each finding; doc_id is the finding's id below 0."""
    rows = table(spark, sf_dir, "findings").where("id is not null").dropDuplicates(["id"])
    said = F.get(F.array(*map(F.lit, RUNTIME_ERRORS)), (F.col("id") % len(RUNTIME_ERRORS)).cast("int"))
    frame = F.format_string("\n    #0 0x%s in %s %s:%d", F.lower(F.hex("id")), F.coalesce("function_name", F.lit("fn")), F.coalesce("file_path", F.lit("")), F.coalesce("line", F.lit(0)))
    return rows.select((-F.col("id")).alias("doc_id"), F.concat(F.lit("=="), F.col("id").cast("string"), F.lit("=="), said, frame).alias("payload"))


def q_parse_sanitizer(spark, sf_dir):
    logs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", F.col("text").alias("payload"))
    return N.parse_sanitizer(logs.unionByName(runtime_logs(spark, sf_dir))).select("doc_id", *COLUMNS[1:])


def q_tool_status(spark, sf_dir):
    rows = table(spark, sf_dir, "scanner_results").where("result_id is not null").dropDuplicates(["result_id"])
    return A.tool_status(rows.select(F.coalesce(N.tool_name(F.col("tool")), F.lit("unknown")).alias("tool"), F.col("reported_path").alias("file")))


def q_adaptive_timeout(spark, sf_dir):
    files = table(spark, sf_dir, "findings").where("run_id is not null").groupBy("run_id").agg(F.countDistinct("file_path").alias("files"))
    return files.select("run_id", "files", N.adaptive_timeout(F.col("files") * 100, 600).alias("seconds"))


_TOOL = """case when starts_with(b, 'clangtidy') then 'clang-tidy' when starts_with(b, 'clanganalyzer') or b = 'scanbuild' then 'clang-analyzer' when starts_with(b, 'codeql') then 'codeql'
  when starts_with(b, 'cppcheck') then 'cppcheck' when starts_with(b, 'flawfinder') then 'flawfinder' when starts_with(b, 'semgrep') then 'semgrep' end"""
_ROWS = f"""with r as (select *, {_TOOL} as t, coalesce(check_id, '') as ch, coalesce(reported_path, '') as p, coalesce(msg, '') as m, upper(coalesce(level, '')) as lv
  from (select distinct *, regexp_replace(lower(tool), '[^a-z]', '', 'g') as b from scanner_results where result_id is not null))"""


def _sql(tool: str, title: str, cwe: str, severity: str, confidence: float, file: str = "p", line: str = "line_no") -> str:
    return (
        f"{_ROWS} select result_id, left({title}, 200) as title, '{tool}' as category, {cwe} as cwe, {severity} as severity, cast({confidence} as double) as confidence, "
        f"{file} as file, cast({line} as int) as line, '' as function, '{tool}' as tool from r where t = '{tool}'"
    )


def _map(col: str, values: dict, default: str) -> str:
    return f"case {col} " + " ".join(f"when {k if isinstance(k, int) else repr(k)} then '{v}'" for k, v in values.items()) + f" else '{default}' end"


_KINDS = ", ".join(
    "case when regexp_matches(text, '{}') then {{'title': '{} (via address sanitizer)', 'cwe': '{}', 'severity': '{}'}} end".format(p, t, c, s) for p, c, s, t in N.SANITIZER_KINDS
)
_TIDY = lambda n: f"regexp_extract(printf('%s:%d:1: warning: %s [%s]', p, line_no, m, ch), '{N.TIDY_LINE}', {n})"
_ERRORS = ", ".join(map(repr, RUNTIME_ERRORS))
_LOGS = (
    f"select -id, '==' || id || '==' || [{_ERRORS}][id % {len(RUNTIME_ERRORS)} + 1] || printf('%s    #0 0x%s in %s %s:%d', chr(10), lower(to_hex(id)), coalesce(function_name, 'fn'), coalesce(file_path, ''), coalesce(line, 0)) "
    "from (select distinct id, function_name, file_path, line from findings where id is not null)"
)
_FRAME = lambda n: f"regexp_extract(text, '{N.FRAME}', {n})"
QUERIES = {
    "q_parse_semgrep": (_query("semgrep"), _sql("semgrep", "ch || ': ' || m", "coalesce(weakness, 'CWE-0')", _map("lv", N.SEMGREP_SEVERITY, "medium"), 0.7)),
    "q_parse_flawfinder": (_query("flawfinder"), _sql("flawfinder", "ch || ': ' || m", "coalesce(weakness, 'CWE-0')", _map("coalesce(try_cast(lv as int), 0)", N.FLAWFINDER_LEVEL, "medium"), 0.5)),
    "q_parse_codeql": (_query("codeql"), _sql("codeql", "ch || ': ' || m", _map("ch", N.CODEQL_CWE, "CWE-0"), "'medium'", 0.8)),
    "q_parse_clang": (
        _query("clang-analyzer"),
        _sql("clang-analyzer", "m", "'CWE-0'", "'medium'", 0.75, "case when line_no % 2 = 0 then 'called/' || p else p end", "case when line_no % 2 = 0 then line_no + 1 else line_no end"),
    ),
    "q_parse_clang_tidy": (_query("clang-tidy"), _sql("clang-tidy", f"case when result_id % 2 = 0 then m else {_TIDY(4)} end", f"case when result_id % 2 = 0 then {_map('ch', N.CLANG_TIDY_CWE, 'CWE-0')} else {_map(_TIDY(5), N.CLANG_TIDY_CWE, 'CWE-0')} end", "'medium'", 0.7)),
    "q_parse_cppcheck": (_query("cppcheck"), _sql("cppcheck", "ch || ': ' || m", _map("ch", N.CPPCHECK_CWE, "CWE-0"), _map("lower(lv)", N.CPPCHECK_SEVERITY, "medium"), 0.6)),
    "q_parse_sanitizer": (
        q_parse_sanitizer,
        f"""select doc_id, k.title, case when k.cwe in ('CWE-190', 'CWE-457') then 'logic' else 'memory-safety' end as category, k.cwe, k.severity, cast(0.95 as double) as confidence,
          case when {_FRAME(2)} <> '' then {_FRAME(2)} else 'runtime' end as file, coalesce(try_cast({_FRAME(3)} as int), 0) as line, {_FRAME(1)} as function, 'sanitizer-address' as tool
          from (select doc_id, text, unnest([{_KINDS}]) as k from (select doc_id, text from documents where doc_id is not null and text is not null union all {_LOGS})) where k is not null""",
    ),
    "q_tool_status": (q_tool_status, f"{_ROWS} select coalesce(t, 'unknown') as tool, count(*) as results, count(distinct reported_path) as files from r group by 1"),
    "q_adaptive_timeout": (
        q_adaptive_timeout,
        "select run_id, files, cast(case when files * 100 >= 5000 then least(600, 180) when files * 100 >= 1000 then least(600, 300) else 600 end as int) as seconds "
        "from (select run_id, count(distinct file_path) as files from findings where run_id is not null group by 1)",
    ),
}
