"""Outputs of external scanners as findings.

Each parser takes a table with a text column `payload` (one captured output a row) and returns
its other columns beside one row per reported issue: title, category, cwe, severity,
confidence, file, line, function, tool. Unreadable outputs give no row. Everything is parsed
by built-in JSON, XML and regular-expression functions where the rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.regexes import has
from tracequarry.operators.correlate import lookup

# Fixed values
TITLE_LENGTH = 200
SEMGREP_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
FLAWFINDER_LEVEL = {0: "low", 1: "low", 2: "medium", 3: "medium", 4: "high", 5: "high"}
CPPCHECK_SEVERITY = {"error": "high", "warning": "medium", "style": "low", "performance": "medium", "portability": "low", "information": "low"}
CPPCHECK_CWE = {
    "memleak": "CWE-401",
    "resourceLeak": "CWE-404",
    "uninitvar": "CWE-457",
    "uninitMemberVar": "CWE-457",
    "bufferAccessOutOfBounds": "CWE-119",
    "possibleBufferAccessOutOfBounds": "CWE-119",
    "nullPointer": "CWE-476",
    "nullPointerRedundantCheck": "CWE-476",
    "doubleFree": "CWE-415",
    "uselessAssignmentArg": "CWE-563",
    "unusedFunction": "CWE-1164",
}
CLANG_TIDY_CWE = {
    "bugprone-sizeof-expression": "CWE-131",
    "bugprone-suspicious-string-compare": "CWE-697",
    "bugprone-unsafe-functions": "CWE-242",
    "cert-err33-c": "CWE-252",
    "misc-redundant-expression": "CWE-1164",
    "modernize-use-nullptr": "CWE-476",
    "performance-unnecessary-copy": "CWE-398",
}
CODEQL_CWE = {
    "cpp/unsafe-strncat": "CWE-120",
    "cpp/overflowing-snprintf": "CWE-120",
    "cpp/overflow-buffer": "CWE-119",
    "cpp/use-of-pointer-arithmetic": "CWE-823",
    "cpp/missing-check": "CWE-476",
}
TIDY_LINE = r"(?m)^(.+?):(\d+):(\d+):\s+warning:\s+(.+?)\s+\[(.+?)\]"
SANITIZER_KINDS = [
    (r"(?i)heap-use-after-free", "CWE-416", "high", "Use-after-free detected at runtime"),
    (r"(?i)double-free", "CWE-415", "high", "Double-free detected at runtime"),
    (r"(?i)heap-buffer-overflow", "CWE-787", "high", "Heap buffer overflow detected at runtime"),
    (r"(?i)stack-buffer-overflow", "CWE-121", "high", "Stack buffer overflow detected at runtime"),
    (r"(?i)global-buffer-overflow", "CWE-123", "high", "Global buffer overflow detected at runtime"),
    (r"(?i)SEGV|AddressSanitizer: (?:SEGV|access-violation)", "CWE-120", "medium", "AddressSanitizer detected an invalid memory access"),
    (r"(?i)use-of-uninitialized-value|MemorySanitizer", "CWE-457", "medium", "Uninitialized value use detected at runtime"),
    (r"(?i)runtime error:", "CWE-190", "medium", "UndefinedBehaviorSanitizer runtime error"),
    (r"(?i)SUMMARY:.*LeakSanitizer|leak(s)? (detected|of)", "CWE-401", "low", "Memory leak detected at runtime"),
]
FRAME = r"#\d+\s+0x[0-9a-f]+\s+in\s+(\w+)\s+([\w./-]+\.(?:c|cpp|cc)):(\d+)"


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _rows(df: DataFrame, tool: str, confidence: float, title: Column, cwe: Column, severity: Column, file: Column, line: Column, function: Column | None = None) -> DataFrame:
    keep = [c for c in df.columns if c not in ("payload", "x", "_data")]
    return df.select(
        *keep,
        F.substring(title, 1, TITLE_LENGTH).alias("title"), F.lit(tool).alias("category"), cwe.alias("cwe"), severity.alias("severity"), F.lit(confidence).alias("confidence"),
        _text(file).alias("file"), F.coalesce(line.cast("int"), F.lit(0)).alias("line"), (_text(function) if function is not None else F.lit("")).alias("function"), F.lit(tool).alias("tool"),
    )


def _each(df: DataFrame, schema: str, items: str) -> DataFrame:
    """One row per item of the parsed output, as x."""
    return df.withColumn("_data", F.from_json("payload", schema)).withColumn("x", F.explode(F.expr(items))).where("x is not null")


def parse_semgrep(outputs: DataFrame) -> DataFrame:
    """results[]: severity of the extra part, the first weakness of a list or the only one."""
    schema = (
        "results array<struct<check_id: string, path: string, start: struct<line: int>, message: string, severity: string, "
        "extra: struct<message: string, severity: string, metadata: struct<cwe: string>>>>"
    )
    each = _each(outputs, schema, "_data.results")
    given = F.col("x.extra.metadata.cwe")
    cwe = F.coalesce(F.when(F.startswith(given, F.lit("[")), F.get(F.from_json(given, "array<string>"), F.lit(0))).otherwise(given), F.lit("CWE-0"))
    severity = lookup(F.upper(F.coalesce("x.extra.severity", "x.severity", F.lit("WARNING"))), SEMGREP_SEVERITY, "medium")
    title = F.concat(_text(F.col("x.check_id")), F.lit(": "), F.coalesce("x.extra.message", "x.message", F.lit("")))
    return _rows(each, "semgrep", 0.7, title, cwe, severity, F.col("x.path"), F.col("x.start.line"))


def parse_flawfinder(outputs: DataFrame) -> DataFrame:
    """A list of hits with a level from 0 to 5."""
    each = _each(outputs, "array<struct<fname: string, line: int, name: string, level: int, cwe: string, context: string>>", "_data")
    title = F.concat(_text(F.col("x.name")), F.lit(": "), _text(F.col("x.context")))
    severity = lookup(F.coalesce("x.level", F.lit(0)), FLAWFINDER_LEVEL, "medium")
    return _rows(each, "flawfinder", 0.5, title, F.coalesce("x.cwe", F.lit("CWE-0")), severity, F.col("x.fname"), F.col("x.line"))


def parse_codeql(outputs: DataFrame) -> DataFrame:
    """SARIF runs[].results[] that have a location; the first one counts."""
    place = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>"
    each = _each(outputs, f"runs array<struct<results: array<struct<ruleId: string, message: struct<text: string>, locations: array<{place}>>>>>", "flatten(transform(_data.runs, r -> r.results))")
    each = each.where(F.size("x.locations") > 0)
    at = F.get("x.locations", F.lit(0))["physicalLocation"]
    title = F.concat(_text(F.col("x.ruleId")), F.lit(": "), _text(F.col("x.message.text")))
    return _rows(each, "codeql", 0.8, title, lookup(F.col("x.ruleId"), CODEQL_CWE, "CWE-0"), F.lit("medium"), at["artifactLocation"]["uri"], at["region"]["startLine"])


def parse_clang(outputs: DataFrame) -> DataFrame:
    """A list of diagnostics, or objects that hold one or a list of them; the last call step gives the place."""
    place = "struct<file: string, line: int>"
    one = f"struct<description: string, location: {place}, path: array<struct<kind: string, location: {place}>>>"
    payload, nested = F.col("payload"), F.col("_d")
    items = F.when(F.startswith(F.ltrim(payload), F.lit("[")), F.from_json(payload, "array<string>")).otherwise(F.array(payload))
    held = outputs.withColumn("_i", F.explode(items)).withColumn("_d", F.coalesce(F.get_json_object("_i", "$.diagnostics"), F.col("_i")))
    each = held.withColumn("x", F.explode(F.when(F.startswith(F.ltrim(nested), F.lit("[")), F.from_json(nested, f"array<{one}>")).otherwise(F.array(F.from_json(nested, one))))).drop("_i", "_d")
    each = each.where("x is not null and (x.description is not null or x.location is not null)")
    calls = F.filter("x.path", lambda s: s["kind"] == "call")
    last = F.try_element_at(calls, F.lit(-1))["location"]
    return _rows(
        each, "clang-analyzer", 0.75, F.coalesce("x.description", F.lit("Unknown issue")), F.lit("CWE-0"), F.lit("medium"),
        F.coalesce(last["file"], "x.location.file"), F.coalesce(last["line"], "x.location.line"),
    )


def parse_clang_tidy(outputs: DataFrame) -> DataFrame:
    """JSON diagnostics of type warning; of an output that is no JSON, its warning lines."""
    schema = (
        "diagnostics array<struct<DiagnosticType: string, DiagnosticName: string, DiagnosticMessage: string, "
        "DiagnosticLocation: struct<File: string, FileLine: int, FunctionName: string>>>"
    )
    is_json = F.try_parse_json(F.col("payload")).isNotNull()
    each = _each(outputs.where(is_json), schema, "_data.diagnostics").where("x.DiagnosticType = 'warning'")
    warned = _rows(
        each, "clang-tidy", 0.7, _text(F.col("x.DiagnosticMessage")), lookup(F.col("x.DiagnosticName"), CLANG_TIDY_CWE, "CWE-0"), F.lit("medium"),
        F.col("x.DiagnosticLocation.File"), F.col("x.DiagnosticLocation.FileLine"), F.col("x.DiagnosticLocation.FunctionName"),
    )
    text = outputs.where(~is_json).withColumn("x", F.explode(F.regexp_extract_all("payload", F.lit(TIDY_LINE), F.lit(0))))
    part = lambda n: F.regexp_extract("x", TIDY_LINE, n)
    return warned.unionAll(_rows(text, "clang-tidy", 0.7, part(4), lookup(part(5), CLANG_TIDY_CWE, "CWE-0"), F.lit("medium"), part(1), part(2)))


def parse_cppcheck(outputs: DataFrame) -> DataFrame:
    """XML <error> elements with their first <location>."""
    place = "location array<struct<_file: string, _line: int, _function: string>>"
    schema = f"errors struct<error: array<struct<_id: string, _severity: string, _msg: string, {place}>>>, error array<struct<_id: string, _severity: string, _msg: string, {place}>>"
    each = outputs.withColumn("_data", F.from_xml("payload", schema)).withColumn("x", F.explode(F.coalesce("_data.errors.error", "_data.error")))
    at = F.get("x.location", F.lit(0))
    title = F.concat(_text(F.col("x._id")), F.lit(": "), _text(F.col("x._msg")))
    severity = lookup(F.lower(F.coalesce("x._severity", F.lit("information"))), CPPCHECK_SEVERITY, "medium")
    return _rows(each, "cppcheck", 0.6, title, lookup(F.col("x._id"), CPPCHECK_CWE, "CWE-0"), severity, at["_file"], at["_line"], at["_function"])


def parse_sanitizer(outputs: DataFrame, kind: str = "address") -> DataFrame:
    """One row per kind of error that a runtime log names; the first stack frame is the place, 'runtime' without one."""
    text = F.col("payload")
    kinds = [
        F.when(has(text, p), F.struct(F.lit(title).alias("title"), F.lit(cwe).alias("cwe"), F.lit(severity).alias("severity")))
        for p, cwe, severity, title in SANITIZER_KINDS
    ]
    frame = lambda n: F.regexp_extract(text, FRAME, n)
    each = outputs.withColumns({"x": F.explode(F.array_compact(F.array(*kinds)))})
    file = F.when(frame(2) != "", frame(2)).otherwise("runtime")
    found = _rows(
        each, f"sanitizer-{kind}", 0.95, F.concat("x.title", F.lit(f" (via {kind} sanitizer)")), F.col("x.cwe"), F.col("x.severity"), file, frame(3).try_cast("int"), frame(1)
    )
    return found.withColumn("category", F.when(F.col("cwe").isin("CWE-190", "CWE-457"), "logic").otherwise("memory-safety"))


PARSERS = {
    "semgrep": parse_semgrep, "flawfinder": parse_flawfinder, "codeql": parse_codeql, "clang-analyzer": parse_clang,
    "clang-tidy": parse_clang_tidy, "cppcheck": parse_cppcheck, "sanitizer": parse_sanitizer,
}


def adaptive_timeout(files: Column, default: int) -> Column:
    """Seconds that a scanner may take: at most 180 from 5,000 files on, 300 from 1,000 on."""
    return F.when(files >= 5000, F.least(F.lit(default), F.lit(180))).when(files >= 1000, F.least(F.lit(default), F.lit(300))).otherwise(F.lit(default))


def tool_name(col: Column) -> Column:
    """A scanner's name in any spelling."""
    bare = F.regexp_replace(F.lower(col), "[^a-z]", "")
    return (
        F.when(F.startswith(bare, F.lit("clangtidy")), "clang-tidy").when(F.startswith(bare, F.lit("clanganalyzer")) | (bare == "scanbuild"), "clang-analyzer")
        .when(F.startswith(bare, F.lit("codeql")), "codeql").when(F.startswith(bare, F.lit("cppcheck")), "cppcheck")
        .when(F.startswith(bare, F.lit("flawfinder")), "flawfinder").when(F.startswith(bare, F.lit("semgrep")), "semgrep")
    )
