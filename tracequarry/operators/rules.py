"""The detection rules: selections and row frames over the lines of source files.

A file is one row that holds its lines in order, so a rule that looks some lines back or ahead
takes a slice of them, and all rules run in one pass over the scan, without a shuffle, a sort
or a Python worker. Each rule is an expression from the array of lines to an array of hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import patterns as P
from tracequarry.functions.regexes import after, every, every_dynamic, extract_dynamic, first, has, has_dynamic, strip_comments

T = P.TITLES


def _hit(line: Column, title: str | Column, severity: str | Column, confidence: float | Column, notes: str | Column = "") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        line.cast("int").alias("line"), lit(title).alias("title"), lit(severity).alias("severity"),
        lit(confidence).cast("double").alias("confidence"), lit(notes).alias("notes"),
    )


def _say(title: str, *values: Column) -> Column:
    return F.format_string(T[title], *values)


def _comment(text: Column) -> Column:
    return has(text, P.COMMENT_LINE)


def _calls(lines: Column) -> Column:
    """The lines that can hold a call, comments apart, with their (0-based) places: what most rules look at."""
    return F.array_compact(F.transform(lines, lambda t, i: F.when(F.contains(t, F.lit("(")) & ~_comment(t), F.struct(t.alias("t"), i.alias("i")))))


def _each(rule: Callable[[Column, Column], Column]) -> Column:
    """Hits of a rule that gives one hit or null for each line with a call."""
    return F.array_compact(F.transform("_calls", lambda c: rule(c["t"], c["i"])))


def _each_with(lines: Column, mark: Callable[[Column], Column], rule: Callable[[Column, Column], Column]) -> Column:
    """The same for the lines that fulfil a cheap condition."""
    return F.array_compact(F.transform(lines, lambda t, i: F.when(mark(t) & ~_comment(t), rule(t, i))))


def _back(lines: Column, i: Column, k: int) -> Column:
    """The lines from k before the (0-based) i-th to it."""
    start = F.greatest(i + 1 - k, F.lit(1))
    return F.slice(lines, start, i + 2 - start)


def _ahead(lines: Column, i: Column, k: int) -> Column:
    """The k lines after the (0-based) i-th."""
    return F.slice(lines, i + 2, F.lit(k))


def crypto_misuse(lines: Column) -> Column:
    def rule(t, i):
        return (
            F.when(has(t, r"^\s*/\*"), F.lit(None))
            .when(has(t, P.WEAK_HASH), _hit(i + 1, T["hash"], "low", 0.45))
            .when(has(t, P.WEAK_CIPHER), _hit(i + 1, T["cipher"], "medium", 0.5))
            .when(has(t, P.HARDCODED_KEY) | has(t, P.HARDCODED_STRING), _hit(i + 1, T["secret"], "high", 0.6))
            .when(has(t, P.SRAND_TIME), _hit(i + 1, T["seed"], "medium", 0.5))
            .when(has(t, P.WEAK_RAND), _hit(i + 1, T["prng"], "low", 0.35))
        )

    return _each_with(lines, lambda t: has(t, r"(?i)md5|sha1|des|rc4|blowfish|bf_|cast|aes_encrypt|char|rand"), rule)


def _literal_follows(t: Column, call: str) -> Column:
    return has(after(t, call), r"^\s*" + P.QUOTED)


def command_injection(lines: Column) -> Column:
    def rule(t, i):
        literal = _literal_follows(t, P.SHELL_SINK)
        return F.when(
            has(t, P.SHELL_SINK),
            F.when(~literal, _hit(i + 1, T["shell"], "high", 0.45)).when(has(t, P.SHELL_USER), _hit(i + 1, T["shell-user"], "medium", 0.4)),
        )

    return _each(rule)


def format_string(lines: Column) -> Column:
    return _each(lambda t, i: F.when(has(t, P.PRINTF_SINK) & ~has(t, P.SAFE_FORMAT) & ~has(t, P.LITERAL_FORMAT), _hit(i + 1, T["format"], "high", 0.5)))


def path_hijacking(lines: Column) -> Column:
    def rule(t, i):
        value = F.when(F.contains(t, F.lit("=")), F.regexp_extract(t, "(?s)^[^=]*=(.*)$", 1)).otherwise(F.lit(""))
        return F.array(
            F.when(has(t, P.PATH_CALL) & ~_literal_follows(t, P.PATH_CALL), _hit(i + 1, T["path-call"], "medium", 0.4)),
            F.when((has(t, P.PATH_SET) | has(t, P.PATH_ASSIGN)) & ~has(value, r"^\s*" + P.QUOTED), _hit(i + 1, T["path-set"], "medium", 0.45)),
        )

    return F.array_compact(F.flatten(_each_with(lines, lambda t: F.contains(t, F.lit("(")) | F.contains(t, F.lit("PATH")), rule)))


def path_traversal(lines: Column) -> Column:
    def rule(t, i):
        up = has(t, P.TRAVERSAL)
        return F.when(
            has(t, P.OPENER) & (has(t, P.PATH_USER) | (up & ~has(t, P.QUOTED))),
            _hit(i + 1, T["traversal"], "high", F.when(up, 0.5).otherwise(0.4)),
        )

    return _each(rule)


def unchecked_length(lines: Column) -> Column:
    def rule(t, i):
        guarded = F.exists(_back(lines, i, 7), lambda x: has(x, P.LENGTH_GUARD))
        return F.when(has(t, P.LENGTH_SINK) & ~guarded, _hit(i + 1, _say("length", first(t, P.LENGTH_SINK)), "medium", 0.4))

    return _each(rule)


def unsafe_deserialization(lines: Column) -> Column:
    return _each(lambda t, i: F.when(has(t, P.DESERIALIZER), _hit(i + 1, _say("dangerous", first(t, P.DESERIALIZER)), "high", 0.5)))


def untrusted_input(lines: Column) -> Column:
    def rule(t, i):
        var = first(t, P.ASSIGNED)
        used = F.exists(_ahead(lines, i, 15), lambda x: has(x, P.INPUT_SINK) & has_dynamic(x, r"\b", var, r"\b"))
        return F.when(has(t, P.INPUT_SOURCE) & (var != "") & used, _hit(i + 1, _say("input", var, first(t, P.INPUT_SOURCE)), "medium", 0.5))

    return _each(rule)


def null_deref(lines: Column) -> Column:
    def rule(t, i):
        var = first(t, P.ASSIGNED_CALL)
        checked = F.exists(
            _ahead(lines, i, 5),
            lambda x: F.contains(x, F.lit("if")) & has_dynamic(x, r"if\s*\(\s*(?:", var, r"\s*(?:!=|==\s*NULL|\bnot\s+null)|!", var, ")"),
        )
        return F.when(has(t, P.NULL_ALLOC) & (var != "") & ~checked, _hit(i + 1, _say("null", var, first(t, P.NULL_ALLOC)), "medium", 0.4))

    return _each(rule)


HEAD = r"^[ \t]*(?:[A-Za-z_][\w \t\*:<>&~,]*[ \t\*:&~])?([A-Za-z_]\w*)[ \t]*\([^;{}]*\)\s*(?:const\s*)?(\{.*)?$"


def functions_in(lines: Column) -> Column:
    """array<struct<name, head, start, end>> of a file's function definitions, in order.

    A definition is a line that begins with words (types, scopes with '::', templates) and
    NAME(...), its brace there or at the beginning of the next line; NAME is no control word. It ends with the line on which the
    braces opened since are closed, or with the file. All definitions are followed in one pass
    with a running depth over the lines that hold braces or a head.
    """
    braces = lambda t: F.length(F.replace(t, F.lit("}"), F.lit(""))) - F.length(F.replace(t, F.lit("{"), F.lit("")))

    def event(t, i):
        name, here = first(t, HEAD), first(t, HEAD, 2) != ""
        below = has(F.coalesce(F.get(lines, i + 1), F.lit("")), r"^\s*\{")
        likely = F.contains(t, F.lit("(")) & (F.contains(t, F.lit("{")) | below)
        brace = F.when(here, i + 1).when(below, i + 2)
        is_head = likely & (name != "") & ~name.isin(P.CONTROL_WORDS) & brace.isNotNull()
        head = F.when(is_head, F.struct(name.alias("name"), (i + 1).cast("int").alias("head"), brace.cast("int").alias("start")))
        some = F.contains(t, F.lit("{")) | F.contains(t, F.lit("}")) | is_head
        return F.when(some, F.struct((i + 1).cast("int").alias("n"), braces(t).cast("int").alias("net"), head.alias("f")))

    events = F.array_compact(F.transform(lines, event))
    # The state: the depth, functions still open with the depth they began at, those whose end is known.
    kind = "array<struct<start: int, base: int, head: int, name: string>>"
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast(kind).alias("open"), F.array().cast("array<struct<head: int, name: string, start: int, end: int>>").alias("done"))

    def step(s, e):
        # A function counts from its brace on, which may be on the line after its head.
        fresh = lambda f, base: F.struct(f["start"].alias("start"), base.cast("int").alias("base"), f["head"].alias("head"), f["name"].alias("name"))
        started = F.when(e["f"].isNotNull(), F.concat(s["open"], F.array(fresh(e["f"], s["depth"] + F.when(e["f"]["start"] > e["n"], e["net"]).otherwise(0))))).otherwise(s["open"])
        depth = (s["depth"] + e["net"]).cast("int")
        over = lambda f: (f["start"] <= e["n"]) & (depth <= f["base"])
        ended = F.transform(F.filter(started, over), lambda f: F.struct(f["head"], f["name"], f["start"], e["n"].alias("end")))
        return F.struct(depth.alias("depth"), F.filter(started, lambda f: ~over(f)).alias("open"), F.when(F.size(ended) > 0, F.concat(s["done"], ended)).otherwise(s["done"]).alias("done"))

    def finish(s):
        rest = F.transform(s["open"], lambda f: F.struct(f["head"], f["name"], f["start"], F.size(lines).alias("end")))
        return F.transform(F.array_sort(F.concat(s["done"], rest)), lambda f: F.struct(f["name"], f["head"], f["start"], f["end"]))

    return F.aggregate(events, zero, step, finish)


def race_condition(lines: Column) -> Column:
    paired = lambda t: F.array(first(t, P.SIGNAL_CALL), first(t, P.SIGNAL_DECL))
    named = F.flatten(F.transform(F.filter(lines, lambda t: F.contains(t, F.lit("(")) & (F.contains(F.lower(t), F.lit("signal")) | F.contains(t, F.lit("static")))), paired))
    handlers = F.array_distinct(F.filter(named, lambda n: n != ""))

    def calls(f):
        body = F.slice(lines, f["start"], f["end"] - f["start"] + 1)
        at = lambda t, i: F.transform(every(t, P.NOT_SIGNAL_SAFE), lambda c: _hit(f["start"] + i, _say("race", c, f["name"]), "medium", 0.5))
        return F.flatten(F.transform(body, at))

    hit = F.flatten(F.transform(F.filter("_functions", lambda f: F.array_contains(handlers, f["name"])), calls))
    none = F.array().cast("array<struct<line: int, title: string, severity: string, confidence: double, notes: string>>")
    return F.when(F.size(handlers) > 0, hit).otherwise(none)


def _last_of(events: Column) -> Column:
    """array<struct<var, line>> with the last line of each variable."""
    names = F.array_distinct(F.transform(events, lambda e: e["var"]))
    last = lambda v: F.array_max(F.transform(F.filter(events, lambda e: e["var"] == v), lambda e: e["line"]))
    return F.transform(names, lambda v: F.struct(v.alias("var"), last(v).alias("line")))


def _events(wanted: Callable[[Column], Column], var: str) -> Column:
    row = lambda c: F.when(wanted(c["t"]) & (first(c["t"], var) != ""), F.struct(first(c["t"], var).alias("var"), (c["i"] + 1).alias("line")))
    return F.array_compact(F.transform("_calls", row))


def _never(events: Column, ended: Column, title: str) -> Column:
    """Hits for the variables of the events that no ending names: an anti-join within the file."""
    left = F.filter(_last_of(events), lambda e: ~F.array_contains(ended, e["var"]))
    return F.transform(left, lambda e: _hit(e["line"], _say(title, e["var"], e["line"]), "low", 0.35))


def resource_lifecycle(lines: Column) -> Column:
    opened = _events(lambda t: has(t, rf"\b(?:{'|'.join(P.RESOURCES)})\s*\("), P.ASSIGNED)
    ends = sorted(set(P.RESOURCES.values()))
    closing = lambda c: F.array(*[F.when(has(c["t"], rf"\b{e}\s*\("), first(c["t"], rf"{e}\s*\(\s*(\w+)")) for e in ends])
    return _never(opened, F.array_compact(F.flatten(F.transform("_calls", closing))), "resource")


def stack_recursion(lines: Column) -> Column:
    functions = F.col("_functions")

    def recursive(f):
        body = F.slice(lines, f["head"], f["end"] - f["head"] + 1)
        calls = F.aggregate(body, F.lit(0), lambda n, t: n + F.size(every_dynamic(t, 0, r"\b", f["name"], r"\s*\(")))
        return (calls > 1) & ~F.exists(body, lambda t: has(t, P.RECURSION_GUARD))

    # Of definitions of one name the last counts.
    last = lambda f: ~F.exists(functions, lambda g: (g["name"] == f["name"]) & (g["head"] > f["head"]))
    return F.transform(F.filter(functions, lambda f: last(f) & recursive(f)), lambda f: _hit(f["head"], _say("recursion", f["name"]), "medium", 0.55))


def toctou(lines: Column) -> Column:
    def rule(t, i):
        given = F.regexp_replace(first(after(t, P.CHECK_CALL), r"^\s*([^,)]+)"), r"""^[\s]+|[\s]+$""", "")
        given = F.regexp_replace(given, r"""^["']+|["']+$""", "")
        soon = F.slice(lines, i + 1, F.lit(15))
        used = F.exists(soon, lambda x: has(x, P.USE_CALL) & has_dynamic(x, r"\b\Q", given, r"\E\b"))
        return F.when(has(t, P.CHECK_CALL) & has(given, P.PLAIN_ARGUMENT) & used, _hit(i + 1, _say("toctou", given), "medium", 0.5))

    return _each(rule)


def unchecked_return(lines: Column) -> Column:
    def rule(t, i):
        plain = ~has(t, r"^\s*while") & ~F.contains(t, F.lit("=")) & ~F.contains(t, F.lit("if"))
        return F.when(has(t, P.RETURN_CALL) & plain, _hit(i + 1, _say("return", first(t, P.RETURN_CALL)), "low", 0.35))

    return _each(rule)


def buffer_overflow(lines: Column) -> Column:
    def rule(t, i):
        guarded = F.exists(_back(lines, i, 9), lambda x: has(x, P.COPY_GUARD))
        severity, confidence = F.when(guarded, "low").otherwise("high"), F.when(guarded, 0.3).otherwise(0.6)
        sinks = [F.when(has(t, rf"\b{s}\s*\("), F.lit(s)) for s in P.COPY_SINKS]
        hits = F.transform(F.array_compact(F.array(*sinks)), lambda s: _hit(i + 1, _say("copy", s), severity, confidence))
        return hits

    return F.flatten(_each(rule))


def double_free(lines: Column) -> Column:
    at = lambda c: F.when(F.contains(c["t"], F.lit("ree")), F.transform(every(c["t"], P.FREED), lambda p: F.struct(p.alias("var"), (c["i"] + 1).alias("line"))))
    frees = F.flatten(F.array_compact(F.transform("_calls", at)))

    def pointer(v):
        return F.struct(v.alias("var"), F.transform(F.filter(frees, lambda e: e["var"] == v), lambda e: e["line"]).alias("at"))

    def reported(p):
        start, end = F.array_min(p["at"]), F.array_max(p["at"])
        rest = lambda t: extract_dynamic(t, 1, "^.*", p["var"], r"\s*=(.*)$")
        given = lambda t: F.contains(t, F.lit("=")) & has_dynamic(t, p["var"], r"\s*=") & ~F.contains(rest(t), F.lit("free"))
        return (F.size(p["at"]) > 1) & ~F.exists(F.slice(lines, start + 1, end - start), given)

    pointers = F.filter(F.transform(F.array_distinct(F.transform(frees, lambda e: e["var"])), pointer), reported)
    named = lambda p: _say("double-free", p["var"], F.array_join(F.transform(p["at"], lambda x: x.cast("string")), ", "))
    return F.transform(pointers, lambda p: _hit(F.array_max(p["at"]), named(p), "medium", 0.45))


def integer_overflow(lines: Column) -> Column:
    def rule(t, i):
        a, b = first(t, P.PRODUCT, 1), first(t, P.PRODUCT, 2)
        checked = F.exists(_back(lines, i, 4), lambda x: has(x, P.OVERFLOW_WORD))
        plain = (a != b) & ~has(a, P.NUMBER) & ~has(b, P.NUMBER)
        return F.when(
            has(t, P.PRODUCT),
            F.when(has(t, P.SIZE_ALLOC), _hit(i + 1, T["size"], "medium", 0.45)).when(~checked & plain, _hit(i + 1, _say("product", a, b), "low", 0.3)),
        )

    return _each_with(lines, lambda t: F.contains(t, F.lit("*")) & F.contains(t, F.lit("=")), rule)


def memory_leak(lines: Column) -> Column:
    freed = _events(lambda t: has(t, P.LEAK_FREE), P.LEAK_FREED)
    return _never(_events(lambda t: has(t, P.LEAK_ALLOC), P.ASSIGNED_CALL), F.transform(freed, lambda e: e["var"]), "leak")


def sign_conversion(lines: Column) -> Column:
    def rule(t, i):
        size = first(t, P.SIZE_CALL)
        before = extract_dynamic(t, 1, r"^(.*?)\b(?:int|long|short|ssize_t|off_t)\s+", size, r"\b")
        odd = F.array_contains(every(t, P.SIGNED_VAR), size) & ~F.contains(before, F.lit("unsigned"))
        return F.when(
            has(t, P.SIGNED_VAR),
            F.when(has(t, P.TO_UNSIGNED), _hit(i + 1, T["sign"], "medium", 0.45)).when((size != "") & odd, _hit(i + 1, _say("sign-size", size), "low", 0.4)),
        )

    return _each(rule)


def _dereferenced(text: Column, ptr: Column) -> Column:
    """ptr->x, ptr[i], ptr.x, *ptr, or ptr as the first argument of a call."""
    direct = has_dynamic(text, r"\b", ptr, r"\s*(?:->|\[|\.)|\*\s*", ptr, r"\b")
    callees = every_dynamic(text, 1, r"\b([A-Za-z_]\w*)\s*\(\s*", ptr, r"\s*[,)]")
    return direct | F.exists(callees, lambda c: ~c.isin(P.NOT_CALLEES))


def use_after_free(lines: Column) -> Column:
    freed = lambda t, i: F.transform(F.array_distinct(every(strip_comments(t), P.FREED_NAME)), lambda p: F.struct(p.alias("ptr"), (i + 1).alias("at")))
    frees = F.flatten(F.array_compact(F.transform(lines, lambda t, i: F.when(F.contains(t, F.lit("ree")), freed(t, i)))))
    braces = lambda t: F.length(F.replace(t, F.lit("}"), F.lit(""))) - F.length(F.replace(t, F.lit("{"), F.lit("")))

    def scan(f):
        def step(s, raw):
            depth, n, text = (s["depth"] + braces(raw)).cast("int"), (s["n"] + 1).cast("int"), strip_comments(raw)
            named = F.contains(text, f["ptr"]) & ~has(text, P.FREE_LINE)
            over = (depth <= 0) & has(raw, r"^\s*\}")
            found = named & _dereferenced(text, f["ptr"])
            state = lambda done, hit: F.struct(depth.alias("depth"), n.alias("n"), F.lit(done).alias("done"), hit.cast("int").alias("hit"))
            none = F.lit(0)
            moved = (
                F.when(over, state(True, none))
                .when(named & has_dynamic(text, r"\b", f["ptr"], r"\s*="), state(True, none))
                .when(found, state(True, n))
                .otherwise(state(False, none))
            )
            return F.when(s["done"], s).otherwise(moved)

        zero = F.struct(F.lit(0).alias("depth"), f["at"].cast("int").alias("n"), F.lit(False).alias("done"), F.lit(0).alias("hit"))
        return F.struct(f["ptr"].alias("ptr"), f["at"].alias("at"), F.aggregate(F.slice(lines, f["at"] + 1, F.lit(400)), zero, step, lambda s: s["hit"]).alias("hit"))

    used = F.filter(F.transform(frees, scan), lambda x: x["hit"] > 0)
    return F.transform(used, lambda x: _hit(x["hit"], _say("use", x["ptr"], x["at"]), "medium", 0.5, F.format_string("freed at line %d", x["at"])))


_BODIES = [
    crypto_misuse, command_injection, format_string, path_hijacking, path_traversal, unchecked_length, unsafe_deserialization,
    untrusted_input, null_deref, race_condition, resource_lifecycle, stack_recursion, toctou, unchecked_return, buffer_overflow,
    double_free, integer_overflow, memory_leak, sign_conversion, use_after_free,
]

#: name -> (order, weakness, category, expression); rules of one's own are added with `register`.
REGISTRY: dict[str, tuple[int, str, str, Callable[[Column], Column]]] = {
    name: (k, cwe, category, body) for k, ((name, cwe, category), body) in enumerate(zip(P.RULES, _BODIES, strict=True))
}


def register(name: str, cwe: str, category: str, body: Callable[[Column], Column]) -> None:
    """Adds a rule: `body` turns an array of lines into an array of hits as `hit` makes them."""
    REGISTRY[name] = (len(REGISTRY), cwe, category, body)


hit = _hit


def catalogue(spark) -> DataFrame:
    rows = [(k, name, cwe, category) for name, (k, cwe, category, _) in REGISTRY.items()]
    return spark.createDataFrame(rows, "ord int, name string, cwe string, category string")


def rule_findings(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Candidate findings of the named rules (all by default) in files (file, text).

    Columns: rule, rule_ord, file, line, nth (among the rule's hits in the file), title, category,
    cwe, severity, confidence, tools, notes. A file without text gives none.
    """
    ready = files.where("text is not null").select("file", F.split("text", "\n", -1).alias("lines")).withColumns({"_calls": _calls(F.col("lines")), "_functions": functions_in(F.col("lines"))})
    chosen = [(n, *REGISTRY[n]) for n in (names or REGISTRY)]

    def tagged(name: str, order: int, cwe: str, category: str, body: Callable[[Column], Column]) -> Column:
        known = [F.lit(name).alias("rule"), F.lit(order).alias("rule_ord"), F.lit(cwe).alias("cwe"), F.lit(category).alias("category")]
        return F.transform(body(F.col("lines")), lambda h, k: F.struct(*known, k.alias("nth"), h.alias("h")))

    arrays = [tagged(*rule) for rule in chosen]
    found = ready.select("file", F.explode(F.concat(*arrays)).alias("x"))
    return found.select(
        "x.rule", "x.rule_ord", "file", "x.h.line", "x.nth", "x.h.title", "x.category", "x.cwe", "x.h.severity", "x.h.confidence",
        F.array(F.concat(F.lit("rule:"), F.col("x.rule"))).alias("tools"), "x.h.notes",
    )
