"""Validators: whether the source around a candidate finding bears it out.

A validator is a decision table: conditions over named features, tried in order, each with a
verdict. Features are regular expressions over windows of lines or facts of the finding. The
conditions are SQL text, evaluated by Spark here and by any SQL engine elsewhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import patterns as P
from tracequarry.functions.regexes import every, every_dynamic, first, has, has_dynamic, strip_comments

FP, SUSPICIOUS, CONFIRMED = "likely_fp", "suspicious", "confirmed"

# Fixed values
ATTACKER_TAGS = ["network", "packet", "socket", "ipc", "plugin", "privileged", "privileged_service", "remote"]
TAG = r"\(([a-z_]+)\)"
INDEX_INTO = r"used as (?:an\s+)?index\s+(?:into|for|on)\s+[`']?([A-Za-z_]\w*)"
LEAK_POINTER = r"\b([A-Za-z_]\w*)\s*=\s*\b(?:malloc|calloc|realloc)\s*\("
LEAK_RELEASE = r"\b(?:free|realloc|fclose|freeaddrinfo)\s*\(\s*([A-Za-z_]\w*)\b"
LEAK_LINE = r"\b(?:malloc|calloc|realloc|alloca)\s*\("
DEREF = r"(?:^|[^&\w])([A-Za-z_]\w*)\s*(?:\[[^\]]*\]|\.|->)"
ASSERTED = r"assert\s*\(\s*([A-Za-z_]\w*)\s*\)"
CONST_BOUND = r"\b(?:for|while|if)\s*\([^;{}]{0,90}?\b[A-Za-z_]\w*\s*(?:<|<=)\s*(0x[0-9a-fA-F]+|\d+)\b"
SIZEOF_BOUND = r"\b(?:for|while|if)\s*\([^;{}]{0,90}?\b[A-Za-z_]\w*\s*(?:<|<=)\s*sizeof\s*\(\s*[A-Za-z_]\w*\s*\)"
FIXED_ARRAY = r"\b([A-Za-z_]\w*)\s*\[\s*\d+\s*\]\s*[=;{]"
TITLE_POINTER = r"pointer '([A-Za-z_]\w*)' freed at line (\d+)"
NULLED = r"\b([A-Za-z_]\w*)\s*=\s*(?:NULL|nullptr|0|new\s+[A-Za-z_]+)"
RELEASED = r"\b(?:free|delete|Free)\s*\(\s*[A-Za-z_]\w*\s*\)"
RISKY = r"\b(malloc|calloc|realloc|open|fopen|socket|read|write|connect|bind|listen|accept|setuid|setgid)\s*\("
FORMAT_ARG = r"(?i)\b(?:printf|vprintf|sprintf|vsprintf|fprintf|vfprintf|snprintf|vsnprintf|syslog)\s*\(\s*([^,)]+)"
CONST_FORMAT = r"""^[A-Z][A-Z0-9_]*$|^"[^"]*"$|^[A-Za-z_]\w*\.[a-z]+$|^ctx->"""
PROBES = ["malloc", "calloc", "realloc", "read", "write", "open", "fopen", "socket"]
#: feature: (where, lines around, without comments, pattern). where: window, line (the flagged one), snippet, both (snippet and line).
FEATURES = {
    "bounded": ("both", 0, False, r"(?i)\b(strncpy|strncat|snprintf|bcopy|memcpy_s|strlcpy|strlcat|vsnprintf|memcpy|memmove|heap-buffer-overflow|__builtin___memcpy_chk)\s*\("),
    "raw": ("both", 0, False, r"(?i)\b(strcpy|strcat|sprintf|wcscpy|vsprintf|gets|scanf)\s*\("),
    "size_guard": ("window", 80, True, r"\bif\s*\([^)]*(?:<=|>=|<|>)\s*[^)]*\)|\b(?:sizeof|strlen|strnlen)\s*\("),
    "sizeof_bound": ("window", 80, True, SIZEOF_BOUND),
    "safe_exec": ("snippet", 0, False, r"\b(execv|execvp|execve|execvpe|posix_spawn|fexecve)\s*\("),
    "raw_exec": ("snippet", 0, False, r"\b(system|popen|execl|execlp|execle)\s*\("),
    "interpolated": ("snippet", 0, False, r"%(s|d|f|u|x|ld|p)|[+][^)]*[A-Za-z_]*\]|f?printf|vsprintf"),
    "alloc": ("both", 0, False, r"\b(malloc|calloc|realloc|kmalloc|kzalloc|vmalloc)\s*\("),
    "literal_size": ("line", 0, False, r"^\s*[A-Za-z_]\w*\s*\*\s*\d+\s*$|^\s*\d+\s*\*\s*\d+\s*$"),
    "literal_factor": ("line", 0, False, r"[A-Za-z_]\w*\s*\*\s*\d+|\d+\s*\*\s*[A-Za-z_]\w*"),
    "security_use": ("window", 80, False, r"(?i)\b(encrypt|decrypt|sign|verify|sha|aes|rsa|ssl|tls|keygen|derive|PBKDF|HKDF|password|credential|token|seed)\b"),
    "weak_prng": ("snippet", 0, False, r"\b(rand|srand|random|rand_r|random_r)\b"),
    "overflow_guard": ("window", 80, False, r"(?i)\b(if|while)\s*\([^)]*(SIZE_MAX|UINT_MAX|INT_MAX|LONG_MAX|LLONG_MAX|PTRDIFF_MAX)[^)]*\)"),
    "checked_math": ("window", 80, False, r"(?i)\b(__builtin_mul_overflow|__builtin_add_overflow|__builtin_sub_overflow|CheckOverflow|safe_mul|safe_add|MulSaturate)\b"),
    "literal_product": ("snippet", 0, False, r"\*\s*\d+\b|\d+\s*\*"),
    "consumed": ("window", 6, True, r"(?i)\b(?:if|while)\s*\([^)]*(?:==|!=|<|>)\s*[^)]*\)|\b(?:r\w*)\s*[!=]=\s*-?\d+\b|\b(?:err|rc|ret|res|status)\w*\s*=\s*\w+\s*\("),
    "privileged": ("window", 6, True, r"\b(setuid|setgid|connect|bind|listen|accept)\s*\("),
    "rand_call": ("window", 40, True, r"\b(rand|random|srand|lrand48|mrand48|drand48|rand_r)\s*\("),
    "secret_use": ("window", 40, True, r"(?i)\b(token|nonce|salt|key|password|passwd|signature|secret|cookie|session|csrf|hmac|hash|otp)\b"),
    "depth_limit": ("window", 60, True, r"(?i)\b(depth|level|recursion(?:_depth)?|remaining|limit|max(?:_?depth)?|count)\b\s*[:,+\-<>=/(]|\b(MAX_)?DEPTH\b|\bNEST\b"),
    "terminates": ("window", 60, True, r"(?i)\bif\s*\([^)]*(?:==|!=|<|>|<=|>=)\s*[^)]*\)\s*\{?\s*return|\b(?:next|right|left|child|link)\s*(?:->|\.)?\w*\s*!=?\s*NULL?\b"),
    "bounded_sink": ("window", 20, True, r"(?i)\b(strncpy|strncat|snprintf|vsnprintf|memcpy_s|strlcpy|strlcat|memcpy|bcopy)\s*\("),
    "length_check": ("window", 20, True, r"\b(?:strnlen|strlen|sizeof)\s*\(|\bif\s*\([^)]*(?:<|>|<=|>=)\s*[^)]*\)"),
}

#: validator: weaknesses it knows, and its decision table. `strict` is a feature, too.
VALIDATORS = {
    "memory-leak": (["CWE-401"], [("leak_var = ''", SUSPICIOUS), ("leak_freed", FP), ("leak_given >= 2", SUSPICIOUS), ("true", CONFIRMED)]),
    "null-deref": (["CWE-476"], [("deref_var = ''", SUSPICIOUS), ("deref_guarded", FP), ("deref_asserted", SUSPICIOUS), ("true", CONFIRMED)]),
    "array-index": (
        ["CWE-787", "CWE-125"],
        [
            ("not flow and ctrl_low", FP), ("ambient", FP), ("const_bound is not null and ctrl_low", FP), ("sizeof_bound and ctrl_low", FP),
            ("fits_array", FP), ("strict and not attacker and flow", FP), ("attacker and coalesce(const_bound, 0) = 0 and not sizeof_bound", CONFIRMED), ("true", SUSPICIOUS),
        ],
    ),
    "buffer-overflow": (
        ["CWE-120", "CWE-121", "CWE-122"],
        [("not raw", SUSPICIOUS), ("(not flow and ctrl_low) or ambient", FP), ("strict and not attacker and flow", FP), ("attacker and not size_guard", CONFIRMED), ("true", SUSPICIOUS)],
    ),
    "command-injection": (["CWE-78"], [("safe_exec", FP), ("raw_exec and interpolated", CONFIRMED), ("true", SUSPICIOUS)]),
    "alloc-overflow": (
        ["CWE-120", "CWE-190", "CWE-195"],
        [
            ("not alloc", SUSPICIOUS), ("literal_size and (not flow or ctrl_low or ambient)", FP), ("literal_factor and (ambient or (not flow and ctrl_low))", FP),
            ("flow and ambient", FP), ("strict and flow and not attacker and ctrl_low", FP), ("attacker and flow", CONFIRMED), ("true", SUSPICIOUS),
        ],
    ),
    "use-after-free": (
        ["CWE-416"],
        [
            ("uaf_var = ''", SUSPICIOUS), ("uaf_nulled", FP), ("not uaf_deref and uaf_released", FP), ("not uaf_deref and uaf_named and uaf_null_check", FP),
            ("not uaf_deref and not uaf_named", FP), ("not uaf_deref", SUSPICIOUS), ("uaf_freed_before", CONFIRMED), ("true", SUSPICIOUS),
        ],
    ),
    "crypto-misuse": (["CWE-338", "CWE-327", "CWE-798"], [("cwe = 'CWE-798' and security_use", CONFIRMED), ("cwe <> 'CWE-798' and weak_prng and security_use", CONFIRMED), ("true", SUSPICIOUS)]),
    "integer-overflow": (["CWE-190", "CWE-191"], [("overflow_guard", FP), ("checked_math or literal_product", SUSPICIOUS), ("true", CONFIRMED)]),
    "format-string": (["CWE-134"], [("attacker", CONFIRMED), ("ambient", FP), ("const_format", FP), ("strict and not flow", FP), ("true", SUSPICIOUS)]),
    "resource-result": (["CWE-252"], [("consumed", FP), ("probe_call and (strict or not privileged)", FP), ("privileged", CONFIRMED), ("true", SUSPICIOUS)]),
    "weak-random": (["CWE-338"], [("not rand_call or secret_use", SUSPICIOUS), ("true", FP)]),
    "recursion": (["CWE-674"], [("terminates", FP), ("true", SUSPICIOUS)]),
    "input-validation": (["CWE-20"], [("ambient", FP), ("bounded_sink and length_check", FP), ("strict and not flow", FP), ("true", SUSPICIOUS)]),
}


#: Which texts the features that aren't in FEATURES read.
READS = {
    "w80": ["leak_var", "leak_freed", "leak_given", "deref_var"],
    "w80s": ["const_bound", "fits_array"],
    "w40": ["deref_guarded", "deref_asserted"],
}


def weaknesses_for(*names: str) -> list[str]:
    """The weaknesses whose validators ask for any of these features."""
    asks = lambda rows: any(re.search(rf"\b{n}\b", c) for c, _ in rows for n in names)
    return sorted({cwe for cwes, rows in VALIDATORS.values() if asks(rows) for cwe in cwes})


def _for(names: list[str] | str, value: Column) -> Column:
    """A feature, worked out only for the weaknesses that need it."""
    return F.when(F.col("cwe").isin(weaknesses_for(*([names] if isinstance(names, str) else names))), value)


def _readers(around: int, bare: bool, others: list[str]) -> list[str]:
    return [n for n, (where, k, b, _) in FEATURES.items() if where == "window" and (k, b) == (around, bare)] + others


def window(around: int) -> Column:
    """The lines so far around the flagged one, joined."""
    start = F.greatest(F.col("at") - around, F.lit(1))
    return F.array_join(F.slice("lines", start, F.col("at") - start + around + 1), "\n")


def _flagged() -> Column:
    return F.coalesce(F.get("lines", F.col("at") - 1), F.lit(""))


def features(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds the features to findings with context.

    df: cwe, title, snippet, lines (array, the source around), at (which of them is flagged, from
    1), line (its number in the file), flow (array of the data-flow steps' descriptions),
    controllability.
    """
    tags = F.array_distinct(F.flatten(F.transform("flow_steps", lambda d: every(d, TAG))))
    known = df.withColumns({"snippet": F.coalesce("snippet", F.lit("")), "flow_steps": F.coalesce("flow", F.array().cast("array<string>"))}).withColumns(
        {"tags": F.filter(tags, lambda t: t != "line"), "flagged": _flagged(),
            "w80": _for(_readers(80, False, READS["w80"]), window(80)),
            "w80s": _for(_readers(80, True, READS["w80s"]), strip_comments(window(80))),
            "w40": _for(_readers(40, False, READS["w40"]), window(40)),
        }
    )
    attacker = F.arrays_overlap("tags", F.array(*map(F.lit, ATTACKER_TAGS)))
    known = known.withColumns(
        {
            "strict": F.lit(strict),
            "flow": F.size("flow_steps") > 0,
            "attacker": attacker,
            "ambient": (F.size("tags") > 0) & ~attacker,
            "ctrl_low": F.coalesce(F.lower("controllability").isin("low", "unknown"), F.lit(True)),
        }
    )
    texts = {"snippet": F.col("snippet"), "line": F.col("flagged"), "both": F.concat("snippet", F.lit("\n"), "flagged")}

    def found(where, around, bare, pattern):
        if where == "window":
            text = {(80, False): F.col("w80"), (80, True): F.col("w80s"), (40, False): F.col("w40")}.get((around, bare)) if (around, bare) in ((80, False), (80, True), (40, False)) else strip_comments(window(around))
        else:
            text = texts[where]
        return has(text, pattern)

    known = known.withColumns({name: _for(name, found(*spec)) for name, spec in FEATURES.items()})
    w80, w40 = F.col("w80"), F.col("w40")
    # Leak: the allocated pointer, whether it is released, how often it is assigned.
    source = F.when(F.col("snippet") != "", F.col("snippet")).otherwise(w80)
    by_line = F.when(has(F.col("flagged"), LEAK_LINE), first(F.col("flagged"), r"([A-Za-z_]\w*)\s*=")).otherwise("")
    known = known.withColumn("leak_var", _for(READS["w80"][:3], F.when(first(source, LEAK_POINTER) != "", first(source, LEAK_POINTER)).otherwise(by_line)))
    # Null dereference: the pointer, a guard or an assertion near it.
    known = known.withColumn("deref_var", _for("deref_var", F.when(has(F.col("snippet"), DEREF), first(F.col("snippet"), DEREF)).otherwise(first(w80, DEREF))))
    var = F.col("deref_var")
    guard = (r"if\s*(?:\(|UNLIKELY\s*\()\s*[!]?\s*\(?\s*", var, r"\s*(?:==|!=|\)|,)|if\s*[!(]\s*", var, r"\s*\)")
    # Array index: the array, a constant bound, a declared size that holds it.
    into = F.filter(F.transform(F.reverse("flow_steps"), lambda d: first(d, INDEX_INTO)), lambda x: x != "")
    declared = first(F.col("w80s"), FIXED_ARRAY)
    known = known.withColumns(
        {
            "array_var": _for("fits_array", F.coalesce(F.get(into, F.lit(0)), F.when(declared != "", declared))),
            "const_bound": _for("const_bound", whole_number(first(F.col("w80s"), CONST_BOUND))),
            "uaf_var": first(F.col("title"), TITLE_POINTER),
            "uaf_start": first(F.col("title"), TITLE_POINTER, 2).try_cast("int"),
            "risky_call": _for("probe_call", F.when(has(F.col("snippet"), RISKY), first(F.col("snippet"), RISKY)).otherwise(first(strip_comments(window(6)), RISKY))),
            "format_arg": _for("const_format", F.trim(first(strip_comments(F.col("flagged")), FORMAT_ARG))),
            "before": _for(["uaf_nulled", "uaf_freed_before"], F.array_join(F.slice("lines", F.greatest(F.col("at") - 80, F.lit(1)), F.greatest(F.col("at") - F.greatest(F.col("at") - 80, F.lit(1)), F.lit(0))), "\n")),
        }
    )
    sizes = every_dynamic(F.col("w80s"), 1, r"\b", F.col("array_var"), r"\s*\[\s*(\d+)\s*\]\s*[=;{]")
    ptr, flagged = F.col("uaf_var"), F.col("flagged")
    deref = has_dynamic(flagged, r"\b", ptr, r"\s*(?:->|\[|\.)|\*\s*", ptr, r"\b") | F.exists(
        every_dynamic(flagged, 1, r"\b([A-Za-z_]\w*)\s*\(\s*", ptr, r"\s*[,)]"), lambda c: ~c.isin(P.NOT_CALLEES)
    )
    null_check = (first(flagged, P.NULL_CHECK) == ptr) | (first(flagged, P.NULL_EQUAL) == ptr) | has_dynamic(flagged, r"\b(?:if|while|assert)\s*\(\s*!?\s*", ptr, r"\s*\)")
    late = {
        "leak_freed": F.array_contains(every(w80, LEAK_RELEASE), F.col("leak_var")),
        "leak_given": F.size(every_dynamic(w80, 0, r"\b", F.col("leak_var"), r"\s*=\s*")),
        "deref_guarded": has_dynamic(w40, *guard),
        "deref_asserted": F.contains(first(w40, ASSERTED, 0), var) & has(w40, ASSERTED),
        "fits_array": F.coalesce(F.exists(sizes, lambda s: s.try_cast("long") >= F.col("const_bound")), F.lit(False)),
        "uaf_nulled": F.array_contains(every(F.col("before"), NULLED), ptr),
        "uaf_deref": deref,
        "uaf_named": has_dynamic(flagged, r"\b", ptr, r"\b"),
        "uaf_released": has(flagged, RELEASED),
        "uaf_null_check": null_check,
        "uaf_freed_before": has(F.col("before"), RELEASED) | F.coalesce(F.col("uaf_start") < F.col("line"), F.lit(False)),
        "probe_call": F.lower("risky_call").isin(PROBES),
        "const_format": (F.col("format_arg") != "") & has(F.col("format_arg"), CONST_FORMAT),
    }
    return known.withColumns({name: _for(name, value) for name, value in late.items()})


def whole_number(text: Column) -> Column:
    """The number that digits, or 0x and hexadecimal ones, stand for; null for none and beyond 64 bits."""
    return F.when(F.startswith(text, F.lit("0x")), F.when(F.length(text) <= 17, F.conv(F.substring(text, F.lit(3), F.lit(16)), 16, 10)).try_cast("long")).otherwise(text.try_cast("long"))


def verdicts(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds `outcomes` (validator, verdict of each that knows the weakness) and `verdict`, the most cautious.

    likely_fp comes before suspicious before confirmed; without an outcome it is suspicious.
    """

    def outcome(name: str, cwes: list[str], table: list[tuple[str, str]]) -> Column:
        decided = F.lit(SUSPICIOUS)
        for condition, verdict in reversed(table):
            decided = F.when(F.expr(condition), F.lit(verdict)).otherwise(decided)
        return F.when(F.col("cwe").isin(cwes), F.struct(F.lit(name).alias("validator"), decided.alias("verdict")))

    judged = features(df, strict).withColumn("outcomes", F.array_compact(F.array(*[outcome(n, *v) for n, v in VALIDATORS.items()])))
    said = F.transform("outcomes", lambda o: o["verdict"])
    worst = F.when(F.array_contains(said, FP), FP).when(F.array_contains(said, SUSPICIOUS) | (F.size("outcomes") == 0), SUSPICIOUS).otherwise(CONFIRMED)
    return judged.select(*[c for c in df.columns], "outcomes", worst.alias("verdict"))


def apply_verdicts(findings: DataFrame) -> DataFrame:
    """Status, indicators and notes after validation: likely false positives are demoted and keep the validators' names."""
    demoted = F.col("verdict") == FP
    names = F.array_join(F.transform(F.filter("outcomes", lambda o: o["verdict"] == F.col("verdict")), lambda o: o["validator"]), ", ")
    note = F.when(F.col("verdict") != SUSPICIOUS, F.concat(F.lit("structural validation: "), names))
    return findings.withColumns(
        {
            "status": F.when(demoted, "likely_false_positive").otherwise(F.col("status")),
            "doubts": F.when(demoted, F.transform(F.filter("outcomes", lambda o: o["verdict"] == FP), lambda o: o["validator"])).otherwise(F.array().cast("array<string>")),
            "notes": F.concat_ws(" | ", F.when(F.col("notes") != "", F.col("notes")), note),
        }
    )


def from_snippets(findings: DataFrame) -> DataFrame:
    """Findings with the context that `features` reads, taken from their own numbered snippets and JSON data flow.

    findings: id, cwe, title, source_snippet, line, dataflow, controllability, status, notes. The
    flagged line is the one marked >>>; a snippet without one has no source.
    """
    numbered = F.filter(F.split(F.coalesce("source_snippet", F.lit("")), "\n"), lambda t: has(t, r"^[ \t]*(?:>>>)?[ \t]*[0-9]+ \|"))
    marked = findings.withColumn("_n", numbered).withColumn("at", F.array_position(F.transform("_n", lambda t: has(t, r"^[ \t]*>>>")), True).cast("int"))
    code = F.transform("_n", lambda t: F.regexp_replace(t, r"^[ \t]*(?:>>>)?[ \t]*[0-9]+ \| ?", ""))
    steps = F.from_json("dataflow", "array<struct<variable: string, location: string, description: string>>")
    return marked.select(
        "id", "cwe", "title", F.col("source_snippet").alias("snippet"), F.when(F.col("at") > 0, code).otherwise(F.array(F.lit(""))).alias("lines"),
        F.greatest("at", F.lit(1)).alias("at"), "line", F.transform(steps, lambda s: F.coalesce(s["description"], F.lit(""))).alias("flow"), "controllability", "status", "notes",
    )
