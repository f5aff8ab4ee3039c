"""Queries over source texts and code structure, and over validated findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import patterns as P
from tracequarry.functions.regexes import has
from tracequarry.operators import correlate as C
from tracequarry.operators import rules
from tracequarry.operators import structure as S
from tracequarry.operators import validate as V
from tracequarry.plans.finding_queries import _CWE, _text
from tracequarry.plans.rule_queries import BODIES, CODE, WITH, WITH_ALL, _q, all_files, m, x
from tracequarry.session import table
from tracequarry.sources import code

#: SQL for the places: every line on which any rule has a hit.
PLACES = "select distinct file, line from (" + " union all ".join(f"select file, line from ({body})" for body in (BODIES[name] for name, _, _ in P.RULES)) + ")"


def _files(spark, sf_dir):
    return code.document_files(table(spark, sf_dir, "documents"))


def _places(spark, sf_dir):
    """Where any rule has a hit, each line once."""
    return rules.rule_findings(_files(spark, sf_dir)).select("file", "line").distinct()


def q_lines(spark, sf_dir):
    lines = code.lines(_files(spark, sf_dir))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"), F.count_if(has(F.col("text"), P.COMMENT_LINE)).alias("comments"))


def q_functions(spark, sf_dir):
    return S.functions(_files(spark, sf_dir)).select("file", "name", "head", "start", F.col("end").alias("finish"))


def q_function_at(spark, sf_dir):
    return S.function_at(_places(spark, sf_dir), S.functions(_files(spark, sf_dir)))


def q_snippet(spark, sf_dir):
    return S.snippets(_places(spark, sf_dir), _files(spark, sf_dir))


def q_call_edges(spark, sf_dir):
    return S.call_edges(all_files(spark, sf_dir))


def q_call_edges_cross(spark, sf_dir):
    return S.call_edges(all_files(spark, sf_dir), cross_file=True)


def q_entry_points_together(spark, sf_dir):
    return S.entry_points(S.functions(all_files(spark, sf_dir)), together=True)


def q_entry_points(spark, sf_dir):
    return S.entry_points(S.functions(_files(spark, sf_dir)))


def _chains(spark, sf_dir):
    owner = table(spark, sf_dir, "runs").select(F.col("id").alias("run_id"), "project_id").distinct()
    return table(spark, sf_dir, "findings").select("run_id", "call_chain").join(owner, "run_id")


def _graph(spark, sf_dir):
    edges = S.chain_edges(_chains(spark, sf_dir), "project_id", "call_chain")
    nodes = edges.select("project_id", F.explode(F.array("src", "dst")).alias("name")).withColumn("ord", F.lit(0))
    return edges, S.entry_points(nodes, "project_id")


def q_chain_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


def q_callers(spark, sf_dir):
    called = S.callers(_graph(spark, sf_dir)[0], "project_id")
    return called.withColumn("callers", F.array_join("callers", ","))


def q_reachable(spark, sf_dir):
    return S.reachable(*_graph(spark, sf_dir), "project_id")


def q_shortest_path(spark, sf_dir):
    return S.paths_from(*_graph(spark, sf_dir), "project_id").withColumn("path", F.array_join("path", " > "))


def q_call_chains(spark, sf_dir):
    edges, entries = _graph(spark, sf_dir)
    chains = S.call_chains(edges, entries, "project_id")
    return chains.select("project_id", "node", F.array_join("chain", " > ").alias("chain"), S.reach_level(F.size("chain"), F.col("node")).alias("level"))


_CHAIN = "array<struct<function: string, file: string, line: int>>"


def q_reach_level(spark, sf_dir):
    rows = table(spark, sf_dir, "findings").where("id is not null").dropDuplicates(["id"])
    length = F.coalesce(F.size(F.from_json("call_chain", _CHAIN)), F.lit(0))
    return rows.select("id", S.reach_level(F.greatest(length, F.lit(0)), F.coalesce("function_name", F.lit(""))).alias("level"))


def q_describe_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "findings").where("id is not null and call_chain is not null").dropDuplicates(["id"])
    return rows.select("id", S.describe_chain(F.from_json("call_chain", _CHAIN)).alias("text"))


def q_vendored(spark, sf_dir):
    rows = table(spark, sf_dir, "findings").where("id is not null and file_path is not null").dropDuplicates(["id"])
    return rows.select("id", code.vendored(F.col("file_path")).alias("vendored"), code.vendored_hint(F.col("file_path")).alias("hint"))


def q_project_profile(spark, sf_dir):
    owner = table(spark, sf_dir, "runs").select(F.col("id").alias("run_id"), "project_id").distinct()
    return code.project_profile(table(spark, sf_dir, "findings").select("run_id", "file_path").join(owner, "run_id"), "project_id", "file_path")


def q_trust_lines(spark, sf_dir):
    lines = code.lines(_files(spark, sf_dir))
    return lines.groupBy("file", C.input_source(F.col("text")).alias("input")).agg(F.count(F.lit(1)).alias("lines"))


def q_code_traits(spark, sf_dir):
    return code.code_traits(_files(spark, sf_dir))


def q_signature(spark, sf_dir):
    return S.signatures(_places(spark, sf_dir), _files(spark, sf_dir))


def _context(spark, sf_dir):
    findings = table(spark, sf_dir, "findings")
    staged = C.stage(findings).select("id", "cwe", "title", "controllability", "status", "notes", "line")
    texts = findings.where("id is not null").dropDuplicates(["id"]).select("id", "source_snippet", "dataflow")
    return V.from_snippets(staged.join(texts, "id"))


def _validator(name: str, strict: bool = False):
    def query(spark, sf_dir):
        rows = V.verdicts(_context(spark, sf_dir).where(F.col("cwe").isin(V.VALIDATORS[name][0])), strict)
        own = F.get(F.filter("outcomes", lambda o: o["validator"] == name), F.lit(0))
        return rows.select("id", own["verdict"].alias("verdict"))

    return query


def q_verdicts(spark, sf_dir):
    return V.verdicts(_context(spark, sf_dir)).select("id", "cwe", "verdict", F.size("outcomes").alias("validators"))


def q_apply_verdicts(spark, sf_dir):
    return V.apply_verdicts(V.verdicts(_context(spark, sf_dir))).select("id", "status", F.array_join("doubts", ",").alias("doubts"), "notes")


_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?s)/\*.*?\*/', '', 'g'), '"(?:[^"\\]|\\.)*"', '""', 'g'), '''(?:[^''\\]|\\.)*''', '''''', 'g'), '//.*', '', 'g')"""


def _strip(text: str) -> str:
    return _STRIP.replace("{t}", text)


def _window(around: int, bare: bool) -> str:
    text = f"array_to_string(list_slice(lines, greatest(pos - {around}, 1), pos + {around}), chr(10))"
    return _strip(text) if bare else text


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_q(pattern)}, 1)"


def _dyn(text: str, *parts: str) -> str:
    """Alternating constant patterns and names of columns."""
    joined = ", ".join(_q(p) if i % 2 == 0 else p for i, p in enumerate(parts))
    return f"regexp_matches({text}, concat({joined}))"


def _feature(where: str, around: int, bare: bool, pattern: str) -> str:
    text = _window(around, bare) if where == "window" else {"snippet": "snippet", "line": "flagged", "both": "concat(snippet, chr(10), flagged)"}[where]
    return m(text, pattern)


_NUMBERED = r"'^[ \t]*(?:>>>)?[ \t]*[0-9]+ \|'"
_ATTACKERS = "[" + ", ".join(map(_q, V.ATTACKER_TAGS)) + "]"
_w80, _w80s, _w40, _w6s = _window(80, False), _window(80, True), _window(40, False), _window(6, True)
_BEFORE = "array_to_string(list_slice(lines, greatest(pos - 80, 1), pos - 1), chr(10))"
_KEYWORDS = ", ".join(map(_q, P.NOT_CALLEES))


def _context_sql(strict: bool) -> str:
    return rf"""
with base as (
  select distinct id, case when {_CWE} <> '' then 'CWE-' || {_CWE} else 'CWE-0' end as cwe, {_text('title')} as title, coalesce(source_snippet, '') as snippet, line,
    lower(trim(controllability)) as ctrl, dataflow, {_text('notes')} as notes, coalesce(nullif({_text('lower(status)')}, ''), 'new') as status,
    list_filter(string_split(coalesce(source_snippet, ''), chr(10)), lambda t: regexp_matches(t, {_NUMBERED})) as n
  from findings where id is not null
), placed as (select *, coalesce(list_position(list_transform(n, lambda t: regexp_matches(t, '^[ \t]*>>>')), true), 0) as p from base),
shaped as (
  select *, greatest(p, 1) as pos, case when p > 0 then list_transform(n, lambda t: regexp_replace(t, '^[ \t]*(?:>>>)?[ \t]*[0-9]+ \| ?', '')) else [''] end as lines,
    case when dataflow is null then [] else list_transform(cast(dataflow as json[]), lambda s: coalesce(json_extract_string(s, '$.description'), '')) end as steps
  from placed
), marked as (
  select *, coalesce(lines[pos], '') as flagged, list_filter(list_distinct(flatten(list_transform(steps, lambda d: {_all('d', V.TAG)}))), lambda t: t <> 'line') as tags from shaped
), known as (
  select id, cwe, title, snippet, lines, pos, flagged, steps, line, status, notes, {'true' if strict else 'false'} as strict, len(steps) > 0 as flow, list_has_any(tags, {_ATTACKERS}) as attacker,
    len(tags) > 0 and not list_has_any(tags, {_ATTACKERS}) as ambient, coalesce(ctrl in ('low', 'unknown', ''), true) as ctrl_low,
    {', '.join(f'{_feature(*spec)} as {name}' for name, spec in V.FEATURES.items())},
    case when {x("case when snippet <> '' then snippet else " + _w80 + " end", V.LEAK_POINTER)} <> '' then {x("case when snippet <> '' then snippet else " + _w80 + " end", V.LEAK_POINTER)}
      when {m('flagged', V.LEAK_LINE)} then {x('flagged', r'([A-Za-z_]\w*)\s*=')} else '' end as leak_var,
    case when {m('snippet', V.DEREF)} then {x('snippet', V.DEREF)} else {x(_w80, V.DEREF)} end as deref_var,
    coalesce(list_filter(list_transform(list_reverse(steps), lambda d: {x('d', V.INDEX_INTO)}), lambda v: v <> '')[1], nullif({x(_w80s, V.FIXED_ARRAY)}, '')) as array_var,
    try_cast({x(_w80s, V.CONST_BOUND)} as bigint) as const_bound, {x('title', V.TITLE_POINTER)} as uaf_var, try_cast({x('title', V.TITLE_POINTER, 2)} as int) as uaf_start,
    case when {m('snippet', V.RISKY)} then {x('snippet', V.RISKY)} else {x(_w6s, V.RISKY)} end as risky_call, trim({x(_strip('flagged'), V.FORMAT_ARG)}) as format_arg, {_BEFORE} as before_
  from marked
), full_ as (
  select *, list_contains({_all(_w80, V.LEAK_RELEASE)}, leak_var) as leak_freed, len(regexp_extract_all({_w80}, concat('\b', leak_var, '\s*=\s*'))) as leak_given,
    {_dyn(_w40, r'if' + chr(92) + r's*(?:\(|UNLIKELY\s*\()\s*[!]?\s*\(?\s*', 'deref_var', r'\s*(?:==|!=|\)|,)|if\s*[!(]\s*', 'deref_var', r'\s*\)')} as deref_guarded,
    {m(_w40, V.ASSERTED)} and contains({x(_w40, V.ASSERTED, 0)}, deref_var) as deref_asserted,
    coalesce(len(list_filter(regexp_extract_all({_w80s}, concat('\b', array_var, '\s*\[\s*(\d+)\s*\]\s*[=;{{]'), 1), lambda s: try_cast(s as bigint) >= const_bound)) > 0, false) as fits_array,
    list_contains({_all('before_', V.NULLED)}, uaf_var) as uaf_nulled,
    {_dyn('flagged', r'\b', 'uaf_var', r'\s*(?:->|\[|\.)|\*\s*', 'uaf_var', r'\b')}
      or len(list_filter(regexp_extract_all(flagged, concat('\b([A-Za-z_]\w*)\s*\(\s*', uaf_var, '\s*[,)]'), 1), lambda k: k not in ({_KEYWORDS}))) > 0 as uaf_deref,
    {_dyn('flagged', r'\b', 'uaf_var', r'\b')} as uaf_named, {m('flagged', V.RELEASED)} as uaf_released,
    {x('flagged', P.NULL_CHECK)} = uaf_var or {x('flagged', P.NULL_EQUAL)} = uaf_var or {_dyn('flagged', r'\b(?:if|while|assert)\s*\(\s*!?\s*', 'uaf_var', r'\s*\)')} as uaf_null_check,
    {m('before_', V.RELEASED)} or coalesce(uaf_start < line, false) as uaf_freed_before, lower(risky_call) in ({', '.join(map(_q, V.PROBES))}) as probe_call,
    format_arg <> '' and {m('format_arg', V.CONST_FORMAT)} as const_format
  from known
), judged as (
  select *, {', '.join(f"case when cwe in ({', '.join(map(_q, cwes))}) then case {' '.join(f'when {c} then {_q(v)}' for c, v in rows)} end end as {_column(name)}" for name, (cwes, rows) in V.VALIDATORS.items())}
  from full_
), said as (select *, list_filter([{', '.join(_column(n) for n in V.VALIDATORS)}], lambda v: v is not null) as verdicts_ from judged)
"""


def _column(name: str) -> str:
    return "v_" + name.replace("-", "_")


_VERDICT = "case when list_contains(verdicts_, 'likely_fp') then 'likely_fp' when list_contains(verdicts_, 'suspicious') or len(verdicts_) = 0 then 'suspicious' else 'confirmed' end"
_NAMES = lambda verdict: f"list_filter([{', '.join(f'case when {_column(n)} = {verdict} then {_q(n)} end' for n in V.VALIDATORS)}], lambda v: v is not null)"

_GRAPH = """
with recursive owners as (select distinct id as run_id, project_id from runs),
steps as (
  select project_id, list_filter(list_transform(cast(call_chain as json[]), lambda s: json_extract_string(s, '$.function')), lambda n: n is not null and n <> '') as n
  from findings join owners using (run_id) where call_chain is not null
), edges as (select distinct project_id, src, dst from (select project_id, unnest(n[:-2]) as src, unnest(n[2:]) as dst from steps where len(n) > 1) where src <> dst)
"""
_HINTED = "(" + " or ".join(f"contains(lower(name), '{h}')" for h in S.ENTRY_HINTS) + ")"


def _entries(source: str, group: str) -> str:
    return f"""
named as (select {group}, name, min(ord) as ord, case when name = 'main' then 0 when {_HINTED} then 1 else 2 end as kind from ({source}) group by 1, 2),
numbered as (select *, min(kind) over (partition by {group}) as best, row_number() over (partition by {group}, kind order by ord, name) as nth from named),
entries as (select {group}, name, cast(nth as int) as nth from numbered where kind = best and (kind = 0 or nth <= case when kind = 1 then 16 else 8 end))
"""


_CHAIN_ENTRIES = _entries("select project_id, unnest([src, dst]) as name, 0 as ord from edges", "project_id")
_LEVEL = (
    "case when n > 4 then 'low' when n > 2 then 'medium' when n > 0 then 'high' when "
    + " or ".join(f"contains(lower(coalesce(function_name, '')), '{w}')" for w in S.REACH_WORDS)
    + " then 'high' else 'unknown' end"
)
_CHAIN_LEVEL = _LEVEL.replace("n > ", "len(c) > ").replace("coalesce(function_name, '')", "node")
#: A shortest path from each entry to each node, of equally short ones the least.
_WALK = """walk(project_id, entry, node, path) using key (project_id, entry, node) as (select project_id, name, name, [name] from entries
  union select w.project_id, w.entry, e.dst, min(list_append(w.path, e.dst)) from walk w join edges e on e.project_id = w.project_id and e.src = w.node
    where not exists (select 1 from recurring.walk r where r.project_id = w.project_id and r.entry = w.entry and r.node = e.dst) group by 1, 2, 3)"""
_VENDOR = "[" + ", ".join(map(_q, code.VENDOR_DIRS)) + "]"
_P = "lower(file_path)"
_SUFFIX = f"regexp_extract({_P}, '\\.([^./]+)$', 1)"
_BASE = f"regexp_extract({_P}, '[^/]*$')"
QUERIES = {
    "q_lines": (q_lines, f"with {CODE} select file, count(*) as lines, cast(sum(length(t)) as bigint) as chars, count(*) filter ({m('t', P.COMMENT_LINE)}) as comments from every_line group by 1"),
    "q_functions": (q_functions, f"{WITH} select file, name, head, start, finish from functions"),
    "q_function_at": (
        q_function_at,
        f"""{WITH}, places as ({PLACES}), hits as (
          select p.file, p.line, arg_max(f.finish, f.start) as finish, arg_max(f.name, f.start) as name from places p
          left join functions f on f.file = p.file and f.start <= p.line group by 1, 2)
          select file, line, case when finish >= line then name else '' end as function from hits""",
    ),
    "q_snippet": (
        q_snippet,
        f"""{WITH}, places as ({PLACES}) select p.file, p.line, string_agg(printf('%s %4d | %s', case when n.line = p.line then '>>>' else '   ' end, n.line, n.t), chr(10) order by n.line) as snippet
          from places p join every_line n on n.file = p.file and n.line between p.line - 15 and p.line + 15 group by 1, 2""",
    ),
    "q_call_edges": (
        q_call_edges,
        f"""{WITH_ALL}, calls as (select f.file, f.name as src, unnest({_all('n.t', S.CALL)}) as dst from functions f join every_line n on n.file = f.file and n.line between f.head and f.finish)
          select distinct c.file, c.src, c.dst from calls c join functions d on d.file = c.file and d.name = c.dst where c.src <> c.dst""",
    ),
    "q_call_edges_cross": (
        q_call_edges_cross,
        f"""{WITH_ALL}, calls as (select f.file, f.name as src, unnest({_all('n.t', S.CALL)}) as dst from functions f join every_line n on n.file = f.file and n.line between f.head and f.finish)
          select distinct file, src, dst from calls where src <> dst and dst in (select name from functions)""",
    ),
    "q_entry_points_together": (
        q_entry_points_together,
        f"""{WITH_ALL}, named as (select file, name, min(head) as ord, case when name = 'main' or {_HINTED} then 0 else 2 end as kind from functions group by 1, 2),
          numbered as (select *, min(kind) over (partition by file) as best, row_number() over (partition by file, kind order by ord, name) as nth from named)
          select file, name, cast(nth as int) as nth from numbered where kind = best and (kind = 0 or nth <= 16)""",
    ),
    "q_entry_points": (q_entry_points, f"{WITH}, {_entries('select file, name, head as ord from functions', 'file')} select * from entries"),
    "q_chain_edges": (q_chain_edges, f"{_GRAPH} select * from edges"),
    "q_callers": (q_callers, f"{_GRAPH} select project_id, dst as function, string_agg(src, ',' order by src) as callers from edges group by 1, 2"),
    "q_reachable": (
        q_reachable,
        f"""{_GRAPH}, {_CHAIN_ENTRIES}, walk(project_id, node, depth) using key (project_id, node) as (select project_id, name, 0 from entries
          union select w.project_id, e.dst, min(w.depth) + 1 from walk w join edges e on e.project_id = w.project_id and e.src = w.node
            where not exists (select 1 from recurring.walk r where r.project_id = w.project_id and r.node = e.dst) group by 1, 2)
          select project_id, node, depth from walk""",
    ),
    "q_shortest_path": (q_shortest_path, f"{_GRAPH}, {_CHAIN_ENTRIES}, {_WALK} select project_id, entry, node, cast(len(path) - 1 as int) as depth, array_to_string(path, ' > ') as path from walk"),
    "q_call_chains": (
        q_call_chains,
        f"""{_GRAPH}, {_CHAIN_ENTRIES}, {_WALK}, firsts as (
          select w.project_id, node, arg_min(path, nth) as c from walk w join entries n on n.project_id = w.project_id and n.name = w.entry group by 1, 2)
          select project_id, node, array_to_string(c, ' > ') as chain, {_CHAIN_LEVEL} as level from firsts""",
    ),
    "q_reach_level": (q_reach_level, f"select id, {_LEVEL} as level from (select distinct id, function_name, coalesce(json_array_length(cast(call_chain as json)), 0) as n from findings where id is not null)"),
    "q_describe_chain": (
        q_describe_chain,
        """select id, case when len(s) = 0 then 'No call chain available' else array_to_string(list_transform(s, lambda e: '  ' || json_extract_string(e, '$.function') || '('
          || case when coalesce(json_extract_string(e, '$.file'), '') <> '' then json_extract_string(e, '$.file') || ':' || json_extract_string(e, '$.line') else '' end || ')'), ' ->' || chr(10)) end as text
          from (select distinct id, call_chain, cast(call_chain as json[]) as s from findings where id is not null and call_chain is not null)""",
    ),
    "q_vendored": (
        q_vendored,
        f"""select id, list_has_any(string_split({_P}, '/'), {_VENDOR}) as vendored,
          coalesce(list_filter(string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/'), lambda d: list_contains({_VENDOR}, lower(d)))[1] || ' (vendored/third-party)', '') as hint
          from (select distinct id, file_path from findings where id is not null and file_path is not null)""",
    ),
    "q_project_profile": (
        q_project_profile,
        f"""select *, case when cpp_files > c_files then 'C++' when c_files > 0 then 'C' else 'unknown' end as language from (
          select project_id, count(*) as files, count(*) filter ({_SUFFIX} in ('c', 'cc', 'cxx')) as c_files, count(*) filter ({_SUFFIX} in ('cpp', 'hpp', 'hxx', 'hh')) as cpp_files,
            count(*) filter ({_SUFFIX} = 'h') as header_files, count(*) filter ({_SUFFIX} in ('so', 'dylib', 'dll')) as shared_libraries, count(*) filter ({_SUFFIX} = 'a') as static_libraries,
            count(*) filter (list_has_any(string_split({_P}, '/'), {_VENDOR})) as vendored_files, bool_or(regexp_matches({_P}, 'test|spec|check')) as has_tests,
            case max(case when {_BASE} = 'cmakelists.txt' then 4 when {_BASE} = 'meson.build' then 3 when {_BASE} in ('configure', 'configure.ac') then 2 when {_BASE} = 'makefile' then 1 else 0 end)
              when 4 then 'cmake' when 3 then 'meson' when 2 then 'autotools' when 1 then 'make' else 'unknown' end as build_system
          from (select distinct project_id, file_path from findings join (select distinct id as run_id, project_id from runs) using (run_id) where file_path is not null and project_id is not null) group by 1)""",
    ),
    "q_trust_lines": (
        q_trust_lines,
        f"with {CODE} select file, case {' '.join(f'when {m(chr(116), p)} then {_q(n)}' for n, p in C.INPUT_SOURCES.items())} else 'unknown' end as input, count(*) as lines from every_line group by 1, 2",
    ),
    "q_code_traits": (
        q_code_traits,
        "select printf('doc-%d.c', doc_id) as file, "
        + ", ".join("(" + " or ".join(f"contains(text, '{w}')" for w in words) + f") as {kind}" for kind, words in code.TRAITS.items())
        + " from documents where doc_id is not null and text is not null",
    ),
    "q_signature": (
        q_signature,
        rf"""{WITH}, places as ({PLACES}), near as (
          select p.file, p.line, n.line as pos, regexp_replace(n.t, '^\s+|\s+$', '', 'g') as s from places p join every_line n on n.file = p.file and n.line between p.line - 29 and p.line),
          sigs as (select file, line, arg_max(s, pos) as signature from near where contains(s, '(') and {m('s', S.SIGNATURE)} group by 1, 2)
          select p.file, p.line, coalesce(signature, '') as signature from places p left join sigs h on h.file = p.file and h.line = p.line""",
    ),
    "q_verdicts": (q_verdicts, f"{_context_sql(False)} select id, cwe, {_VERDICT} as verdict, cast(len(verdicts_) as int) as validators from said"),
    "q_apply_verdicts": (
        q_apply_verdicts,
        f"""{_context_sql(False)} select id, case when v = 'likely_fp' then 'likely_false_positive' else status end as status, case when v = 'likely_fp' then array_to_string(fps, ',') else '' end as doubts,
          concat_ws(' | ', nullif(notes, ''), case v when 'likely_fp' then 'structural validation: ' || array_to_string(fps, ', ') when 'confirmed' then 'structural validation: ' || array_to_string(oks, ', ') end) as notes
          from (select id, status, notes, {_VERDICT} as v, {_NAMES("'likely_fp'")} as fps, {_NAMES("'confirmed'")} as oks from said)""",
    ),
    **{
        f"q_validate_{name.replace('-', '_')}": (_validator(name), f"{_context_sql(False)} select id, {_column(name)} as verdict from said where {_column(name)} is not null")
        for name in V.VALIDATORS
    },
    **{
        f"q_validate_{name.replace('-', '_')}_strict": (_validator(name, True), f"{_context_sql(True)} select id, {_column(name)} as verdict from said where {_column(name)} is not null")
        for name, (_, rows) in V.VALIDATORS.items()
        if any("strict" in c for c, _ in rows)
    },
}
