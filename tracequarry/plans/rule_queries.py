"""A query for each detection rule over the lines of all documents, with its SQL."""

from __future__ import annotations

from tracequarry.functions import patterns as P
from tracequarry.operators import rules
from tracequarry.plans import corpus
from tracequarry.sources import code
from tracequarry.session import table

COLUMNS = ["file", "line", "title", "severity", "confidence", "notes"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


def x(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {_q(pattern)}, {group})"


def rest(text: str, call: str) -> str:
    """What follows the first match of a pattern that has one group."""
    return f"regexp_extract({text}, {_q('(?s)' + call + '(.*)$')}, 2)"


CODE = f"""
files as (select printf('doc-%d.c', doc_id) as file, string_split(text, chr(10)) as ls from documents where doc_id is not null and text is not null),
every_line as (select file, unnest(ls) as t, unnest(range(1, len(ls) + 1)) as line from files),
code as (select * from every_line where not {m('t', P.COMMENT_LINE)})
"""
LITERAL_START = r"^\s*" + P.QUOTED


def _rows(body: str, line: str, title: str, severity: str, confidence: str, where: str, notes: str = "''") -> str:
    return (
        f"select file, cast({line} as int) as line, {title} as title, {severity} as severity, "
        f"cast({confidence} as double) as confidence, {notes} as notes from {body} where {where}"
    )


def _say(key: str, *values: str) -> str:
    return f"printf({_q(P.TITLES[key])}, {', '.join(values)})"


def _t(key: str) -> str:
    return _q(P.TITLES[key])


def _frame(flag: str, before: int, after: int = 0) -> str:
    """Whether a flag holds on some line of the frame around each line; lines that are comments count, too."""
    frame = f"rows between {before} preceding and {after} following" if after else f"rows between {before} preceding and current row"
    return f"(select *, max(cast({flag} as int)) over (partition by file order by line {frame}) as near from every_line)"


def _crypto() -> str:
    kinds = [("hash", P.WEAK_HASH, "low", 0.45), ("cipher", P.WEAK_CIPHER, "medium", 0.5), ("secret", None, "high", 0.6), ("seed", P.SRAND_TIME, "medium", 0.5), ("prng", P.WEAK_RAND, "low", 0.35)]
    when = lambda p: m("t", p) if p else f"({m('t', P.HARDCODED_KEY)} or {m('t', P.HARDCODED_STRING)})"
    kind = "case " + " ".join(f"when {when(p)} then {k}" for k, (_, p, _, _) in enumerate(kinds)) + " end"
    pick = lambda f: "case kind " + " ".join(f"when {k} then {f(v)}" for k, v in enumerate(kinds)) + " end"
    body = f"(select *, {kind} as kind from code where not {m('t', r'^' + chr(92) + 's*/' + chr(92) + '*')})"
    return _rows(body, "line", pick(lambda v: _t(v[0])), pick(lambda v: _q(v[2])), pick(lambda v: str(v[3])), "kind is not null")


def _later(first: int, last: int, where: str) -> str:
    """Whether one of the lines so far ahead of c fulfils the condition on n."""
    return f"exists (select 1 from every_line n where n.file = c.file and n.line between c.line + {first} and c.line + {last} and {where})"


def _sql() -> dict[str, str]:
    literal = lambda call: m(rest("t", call), LITERAL_START)
    out = {"crypto-misuse": _crypto()}
    out["command-injection"] = _rows(
        f"(select *, {literal(P.SHELL_SINK)} as lit from code where {m('t', P.SHELL_SINK)})", "line",
        f"case when lit then {_t('shell-user')} else {_t('shell')} end", "case when lit then 'medium' else 'high' end",
        "case when lit then 0.4 else 0.45 end", f"not lit or {m('t', P.SHELL_USER)}",
    )
    out["format-string"] = _rows("code", "line", _t("format"), "'high'", "0.5", f"{m('t', P.PRINTF_SINK)} and not {m('t', P.SAFE_FORMAT)} and not {m('t', P.LITERAL_FORMAT)}")
    value = "regexp_extract(t, '(?s)^[^=]*=(.*)$', 1)"
    out["path-hijacking"] = (
        _rows("code", "line", _t("path-call"), "'medium'", "0.4", f"{m('t', P.PATH_CALL)} and not {literal(P.PATH_CALL)}")
        + " union all "
        + _rows("code", "line", _t("path-set"), "'medium'", "0.45", f"({m('t', P.PATH_SET)} or {m('t', P.PATH_ASSIGN)}) and not {m(value, LITERAL_START)}")
    )
    up = m("t", P.TRAVERSAL)
    out["path-traversal"] = _rows("code", "line", _t("traversal"), "'high'", f"case when {up} then 0.5 else 0.4 end", f"{m('t', P.OPENER)} and ({m('t', P.PATH_USER)} or ({up} and not {m('t', P.QUOTED)}))")
    out["unchecked-length"] = _rows(_frame(m("t", P.LENGTH_GUARD), 7), "line", _say("length", x("t", P.LENGTH_SINK)), "'medium'", "0.4", f"near = 0 and {m('t', P.LENGTH_SINK)} and not {m('t', P.COMMENT_LINE)}")
    out["unsafe-deserialization"] = _rows("code", "line", _say("dangerous", x("t", P.DESERIALIZER)), "'high'", "0.5", m("t", P.DESERIALIZER))
    word = r"concat('\b', var, '\b')"
    out["untrusted-input"] = _rows(
        f"(select *, {x('t', P.ASSIGNED)} as var from code where {m('t', P.INPUT_SOURCE)}) c", "line", _say("input", "var", x("t", P.INPUT_SOURCE)), "'medium'", "0.5",
        "var <> '' and " + _later(1, 15, f"{m('n.t', P.INPUT_SINK)} and regexp_matches(n.t, {word})"),
    )
    check = r"concat('if\s*\(\s*(?:', var, '\s*(?:!=|==\s*NULL|\bnot\s+null)|!', var, ')')"
    out["null-deref"] = _rows(
        f"(select *, {x('t', P.ASSIGNED_CALL)} as var from code where {m('t', P.NULL_ALLOC)}) c", "line", _say("null", "var", x("t", P.NULL_ALLOC)), "'medium'", "0.4",
        "var <> '' and not " + _later(1, 5, f"regexp_matches(n.t, {check})"),
    )
    unsafe = _q(P.NOT_SIGNAL_SAFE)
    out["race-condition"] = _rows(
        f"""(select f.file, n.line, f.name, unnest(regexp_extract_all(n.t, {unsafe}, 1)) as call from functions f
          join (select distinct file, h from (select file, {x('t', P.SIGNAL_CALL)} as h from every_line union all select file, {x('t', P.SIGNAL_DECL)} from every_line) where h <> '') s
            on s.file = f.file and s.h = f.name
          join every_line n on n.file = f.file and n.line between f.start and f.finish)""",
        "line", _say("race", "call", "name"), "'medium'", "0.5", "true",
    )
    opened = rf"\b(?:{'|'.join(P.RESOURCES)})\s*\("
    closers = " union all ".join(f"select file, {x('t', rf'{e}' + chr(92) + 's*' + chr(92) + '(' + chr(92) + 's*(' + chr(92) + 'w+)')} as var from code where {m('t', rf'\b{e}' + chr(92) + 's*' + chr(92) + '(')}" for e in sorted(set(P.RESOURCES.values())))
    out["resource-lifecycle"] = _rows(
        f"(select file, {x('t', P.ASSIGNED)} as var, max(line) as line from code where {m('t', opened)} group by 1, 2) c", "line", _say("resource", "var", "line"), "'low'", "0.35",
        f"var <> '' and not exists (select 1 from ({closers}) n where n.file = c.file and n.var = c.var)",
    )
    out["stack-recursion"] = _rows(
        f"""(select f.file, f.name, f.head as line, sum(len(regexp_extract_all(n.t, concat('\\b', f.name, '\\s*\\(')))) as calls, bool_or({m('n.t', P.RECURSION_GUARD)}) as guarded
          from (select *, row_number() over (partition by file, name order by head desc) as k from functions) f
          join every_line n on n.file = f.file and n.line between f.head and f.finish where k = 1 group by 1, 2, 3)""",
        "line", _say("recursion", "name"), "'medium'", "0.55", "calls > 1 and not guarded",
    )
    given = rf"""regexp_replace(regexp_replace(regexp_extract({rest('t', P.CHECK_CALL)}, '^\s*([^,)]+)', 1), '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g')"""
    out["toctou"] = _rows(
        f"(select *, {given} as arg from code where {m('t', P.CHECK_CALL)}) c", "line", _say("toctou", "arg"), "'medium'", "0.5",
        f"{m('arg', P.PLAIN_ARGUMENT)} and " + _later(0, 14, rf"{m('n.t', P.USE_CALL)} and regexp_matches(n.t, concat('\b\Q', arg, '\E\b'))"),
    )
    out["unchecked-return"] = _rows("code", "line", _say("return", x("t", P.RETURN_CALL)), "'low'", "0.35", rf"{m('t', P.RETURN_CALL)} and not regexp_matches(t, '^\s*while') and not contains(t, '=') and not contains(t, 'if')")
    sinks = ", ".join(f"case when {m('t', chr(92) + 'b' + s + chr(92) + 's*' + chr(92) + '(')} then '{s}' end" for s in P.COPY_SINKS)
    out["buffer-overflow"] = _rows(
        f"(select file, line, near, unnest([{sinks}]) as sink from {_frame(m('t', P.COPY_GUARD), 9)} where contains(t, '(') and not {m('t', P.COMMENT_LINE)})", "line",
        _say("copy", "sink"), "case when near = 1 then 'low' else 'high' end", "case when near = 1 then 0.3 else 0.6 end", "sink is not null",
    )
    out["double-free"] = _rows(
        f"""(select file, var, min(line) as lo, max(line) as line, string_agg(cast(line as varchar), ', ' order by line) as spots from (
            select file, line, unnest(regexp_extract_all(t, {_q(P.FREED)}, 1)) as var from code) group by 1, 2 having count(*) > 1) c""",
        "line", _say("double-free", "var", "spots"), "'medium'", "0.45",
        r"not exists (select 1 from every_line n where n.file = c.file and n.line between c.lo + 1 and c.line and regexp_matches(n.t, concat(var, '\s*=')) "
        r"and not contains(regexp_extract(n.t, concat('^.*', var, '\s*=(.*)$'), 1), 'free'))",
    )
    a, b = x("t", P.PRODUCT, 1), x("t", P.PRODUCT, 2)
    out["integer-overflow"] = _rows(
        f"(select *, {a} as a, {b} as b, {m('t', P.SIZE_ALLOC)} as sized from {_frame(m('t', P.OVERFLOW_WORD), 4)} where {m('t', P.PRODUCT)} and not {m('t', P.COMMENT_LINE)})", "line",
        f"case when sized then {_t('size')} else {_say('product', 'a', 'b')} end", "case when sized then 'medium' else 'low' end", "case when sized then 0.45 else 0.3 end",
        f"sized or (near = 0 and a <> b and not {m('a', P.NUMBER)} and not {m('b', P.NUMBER)})",
    )
    out["memory-leak"] = _rows(
        f"(select file, {x('t', P.ASSIGNED_CALL)} as var, max(line) as line from code where {m('t', P.LEAK_ALLOC)} group by 1, 2) c", "line", _say("leak", "var", "line"), "'low'", "0.35",
        f"var <> '' and not exists (select 1 from code n where n.file = c.file and {m('n.t', P.LEAK_FREE)} and {x('n.t', P.LEAK_FREED)} = c.var)",
    )
    signed = rf"regexp_extract(t, concat('^(.*?)\b(?:int|long|short|ssize_t|off_t)\s+', size, '\b'), 1)"
    out["sign-conversion"] = _rows(
        f"(select *, {x('t', P.SIZE_CALL)} as size, {m('t', P.TO_UNSIGNED)} as cast_ from code where {m('t', P.SIGNED_VAR)})", "line",
        f"case when cast_ then {_t('sign')} else {_say('sign-size', 'size')} end", "case when cast_ then 'medium' else 'low' end", "case when cast_ then 0.45 else 0.4 end",
        f"cast_ or (size <> '' and list_contains(regexp_extract_all(t, {_q(P.SIGNED_VAR)}, 1), size) and not contains({signed}, 'unsigned'))",
    )
    strip = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)/\*.*?\*/', '', 'g'), '"(?:[^"\\]|\\.)*"', '""', 'g'), '''(?:[^''\\]|\\.)*''', '''''', 'g'), '//.*', '', 'g')"""
    keywords = ", ".join(map(_q, P.NOT_CALLEES))
    deref = (
        r"(regexp_matches(n.s, concat('\b', ptr, '\s*(?:->|\[|\.)|\*\s*', ptr, '\b')) or "
        rf"len(list_filter(regexp_extract_all(n.s, concat('\b([A-Za-z_]\w*)\s*\(\s*', ptr, '\s*[,)]'), 1), lambda k: k not in ({keywords}))) > 0)"
    )
    out["use-after-free"] = _rows(
        f"""(select file, ptr, start, arg_min(event, line) as event, min(line) as line from (
            select f.file, f.ptr, f.line as start, n.line, case
                when sum(n.opens) over (partition by f.file, f.ptr, f.line order by n.line) <= 0 and regexp_matches(n.t, '^\\s*}}') then 'over'
                when {m('n.s', P.FREE_LINE)} then null
                when regexp_matches(n.s, concat('\\b', ptr, '\\s*=')) then 'given'
                when {deref} then 'used' end as event
            from (select distinct file, line, unnest(regexp_extract_all(s, {_q(P.FREED_NAME)}, 1)) as ptr from bare) f
            join bare n on n.file = f.file and n.line between f.line + 1 and f.line + 400)
          where event is not null group by 1, 2, 3)""",
        "line", _say("use", "ptr", "start"), "'medium'", "0.5", "event = 'used'", "printf('freed at line %d', start)",
    )
    bare = f"bare as (select *, {strip} as s, len(replace(t, '}}', '')) - len(replace(t, '{{', '')) as opens from every_line)"
    out["bare"] = bare
    return out


_CONTROL = ", ".join(map(_q, P.CONTROL_WORDS))
FUNCTIONS = f"""
depths as (
  select *, sum(len(replace(t, '}}', '')) - len(replace(t, '{{', ''))) over (partition by file order by line) as depth,
    lead(t) over (partition by file order by line) as next_t,
    count(*) over (partition by file) as total
  from every_line
), heads as (
  select file, line as head, {x('t', rules.HEAD)} as name, total,
    case when {x('t', rules.HEAD, 2)} <> '' then line when regexp_matches(next_t, '^\\s*\\{{') then line + 1 end as start
  from depths where contains(t, '(') and {m('t', rules.HEAD)}
), functions as (
  select h.file, h.head, h.name, h.start, coalesce(min(d.line), any_value(h.total)) as finish
  from (select h.*, coalesce(p.depth, 0) as base from heads h left join depths p on p.file = h.file and p.line = h.start - 1
        where h.start is not null and h.name <> '' and h.name not in ({_CONTROL})) h
  left join depths d on d.file = h.file and d.line >= h.start and d.depth <= h.base
  group by 1, 2, 3, 4
)
"""


#: Rules of which documents have few or no hits; they also look at the files written from events.
RARE = ["untrusted-input", "race-condition", "stack-recursion", "sign-conversion", "double-free"]


def all_files(spark, sf_dir):
    """Documents and the files written from events."""
    return code.document_files(table(spark, sf_dir, "documents")).unionByName(corpus.event_files(spark, sf_dir))


def _query(name: str):
    def query(spark, sf_dir):
        files = all_files(spark, sf_dir) if name in RARE else code.document_files(table(spark, sf_dir, "documents"))
        return rules.rule_findings(files, [name]).select(*COLUMNS)

    return query


BODIES = _sql()
WITH = f"with recursive {CODE}, {BODIES['bare']}, {FUNCTIONS}"
_DOCUMENTS = "from documents where doc_id is not null and text is not null"
WITH_ALL = WITH.replace(_DOCUMENTS, f"{_DOCUMENTS} union all {corpus.FILES_SQL}")
QUERIES = {f"q_rule_{name.replace('-', '_')}": (_query(name), f"{WITH_ALL if name in RARE else WITH} {BODIES[name]}") for name, _, _ in P.RULES}
