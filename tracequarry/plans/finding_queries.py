"""Queries over the findings table: correlation, scoring, ranking and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.operators import analytics as A
from tracequarry.operators import correlate as C
from tracequarry.operators import narrate
from tracequarry.session import table

_WORD = r"nullif(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '')"


def _case(col: str, values: dict, default: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "case " + col + " " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in values.items()) + f" else {default} end"


def posix_sql(col: str) -> str:
    path = rf"regexp_replace(trim({col}), '\\', '/', 'g')"
    path = rf"regexp_replace({path}, '(?i)^file://+', '/')"
    path = rf"regexp_replace({path}, '/(?:\./|/)+', '/', 'g')"
    path = rf"regexp_replace({path}, '^(?:\./)+', '')"
    up = "case when b[1] = '..' and len(a) > 0 and a[-1] not in ('', '..') then a[:-2] else list_concat(a, b) end"
    walked = f"array_to_string(list_reduce(list_transform(string_split(p, '/'), lambda s: [s]), lambda a, b: {up}), '/')"
    return f"nullif(list_transform([{path}], lambda p: case when contains(p, '/..') then {walked} else p end)[1], '')"


def tools_sql(col: str) -> str:
    return rf"""list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce({col}, '')), '[\[\]"'']', '', 'g'), '[,;]'), lambda t: trim(t)), lambda t: t <> '')))"""


_CWE = r"regexp_extract(cwe, '(?i)^\s*(?:cwe)?[\s_:-]*0*([1-9][0-9]*)\b', 1)"
_text = lambda c: rf"coalesce(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"
_kind = lambda c, d="unknown": f"coalesce({_WORD.format(c=c)}, '{d}')"
STAGED = f"""
staged as (
  select id, run_id, finding_id, {_text('title')} as title, {_kind('category')} as category,
    case when {_CWE} <> '' then 'CWE-' || {_CWE} else 'CWE-0' end as cwe, {_kind('severity', 'medium')} as severity,
    cast(coalesce(case when confidence between 0 and 1 then confidence when confidence > 1 and confidence <= 100 then confidence / 100 end, 0) as decimal(18,6)) as confidence,
    coalesce({posix_sql('file_path')}, '') as file, coalesce(line, 0) as line, {_text('function_name')} as "function", {tools_sql('tools')} as tools,
    {_kind('reachability')} as reachability, {_kind('controllability')} as controllability, {_kind('status', 'new')} as status, {_text('notes')} as notes
  from (select distinct * from findings where id is not null)
)"""
DEDUPED = r"""
keyed as (
  select *, substring(sha256(concat_ws('|', file, cast(line as varchar), "function", cwe, lower(regexp_replace(title, '^\s+|\s+$', '', 'g')))), 1, 16) as fp
  from staged where run_id is not null
), firsts as (
  select *, row_number() over (partition by run_id, fp order by id) as k, count(*) over (partition by run_id, fp) as n from keyed
), united as (
  select run_id, fp, list_sort(list_distinct(flatten(list(tools)))) as tools from keyed group by 1, 2
), deduped as (
  select f.* exclude (tools, confidence, k, n), cast(n as int) as copies, u.tools,
    cast(least(confidence + least(0.15 * (n - 1), 0.3), 1) as decimal(18,6)) as confidence
  from firsts f join united u on u.run_id = f.run_id and u.fp = f.fp where k = 1
)"""
MERGED = """
best as (
  select *, row_number() over (partition by run_id, file, line, cwe order by confidence desc, id) as k, count(*) over (partition by run_id, file, line, cwe) as n from deduped
), together as (
  select run_id, file, line, cwe, list_sort(list_distinct(flatten(list(tools)))) as tools from deduped group by 1, 2, 3, 4
), merged as (
  select b.* exclude (tools, confidence, k, n), cast(n as int) as merged, t.tools,
    cast(least(confidence + least(0.1 * (n - 1), 0.25), 1) as decimal(18,6)) as confidence
  from best b join together t on t.run_id = b.run_id and t.file = b.file and t.line = b.line and t.cwe = b.cwe where k = 1
)"""


#: The evidence of every copy under the id of the finding that it was merged into.
BROUGHT = """
brought as (
  select m.id as finding_id, e.evidence_type, e.evidence_source
  from evidence e join keyed k on k.id = e.finding_id join merged m on m.run_id = k.run_id and m.file = k.file and m.line = k.line and m.cwe = k.cwe
)"""


def _scored(source: str, evidence: str = "evidence") -> str:
    return f"""
counts as (select finding_id as fid, count(*) as n_evidence from (select distinct finding_id, evidence_type, evidence_source from {evidence} where finding_id is not null) group by 1),
s0 as (select s.*, coalesce(n_evidence, 0) as n_evidence, len(tools) as nt, cast(status = 'likely_false_positive' as int) as nd from {source} s left join counts on fid = id),
s1 as (select *, case when nt >= 3 then least(confidence + 0.15, 1) when nt >= 2 then least(confidence + 0.10, 1) else confidence end as c1 from s0),
s2 as (select *, case when nd > 0 then greatest(c1 - least(0.1 * nd, 0.3), 0) else c1 end as c2 from s1),
s3 as (select *, case when n_evidence > 0 then least(c2 + least(0.05 * n_evidence, 0.15), 1) else c2 end as c3 from s2),
s4 as (select *, case reachability when 'high' then least(c3 + 0.05, 1) when 'low' then greatest(c3 - 0.05, 0) else c3 end as c4 from s3),
scored as (
  select * exclude (confidence, nt, nd, c1, c2, c3, c4), cast(round(c4, 3) as decimal(18,6)) as confidence,
    {_case('cwe', {c: n for n, cs in C.BUCKETS.items() for c in cs}, "'general'")} as bucket,
    cast(round(least({_case('severity', C.SEVERITY_WEIGHT, '1')} * 2.5 * cast(round(c4, 3) as decimal(18,6))
      + ({_case('reachability', {k: float(v) for k, v in C.REACH_BONUS.items()}, '0.00')} + {_case('controllability', {k: float(v) for k, v in C.CONTROL_BONUS.items()}, '0.00')} + least(0.05 * nt, 0.15)) * 10, 10), 1) as double) as priority
  from s4
)"""


RANKED = """
ranked as (select *, row_number() over (partition by run_id order by priority desc, id) as rank from scored)"""


def _staged(spark, sf_dir):
    return C.stage(table(spark, sf_dir, "findings"))


def _in_runs(spark, sf_dir):
    return _staged(spark, sf_dir).where("run_id is not null")


def _plain(df, *cols):
    """Flat columns for comparison: lists joined, decimals as doubles."""
    return df.select(*[F.array_join(c, ",").alias(c) if c == "tools" else F.col(c).cast("double").alias(c) if c == "confidence" else c for c in cols])


def _list(*cols):
    return ", ".join("array_to_string(tools, ',') as tools" if c == "tools" else "cast(confidence as double) as confidence" if c == "confidence" else f'"{c}"' for c in cols)


STAGE_COLS = ("id", "run_id", "title", "category", "cwe", "severity", "confidence", "file", "line", "function", "tools", "reachability", "controllability", "status")
DEDUP_COLS = ("run_id", "fp", "copies", "id", "title", "cwe", "severity", "confidence", "file", "line", "tools")
MERGE_COLS = ("run_id", "file", "line", "cwe", "merged", "id", "fp", "title", "confidence", "tools")
SCORE_COLS = ("id", "bucket", "n_evidence", "confidence", "priority")


def q_stage(spark, sf_dir):
    return _plain(_staged(spark, sf_dir), *STAGE_COLS)


def q_fingerprint(spark, sf_dir):
    return _staged(spark, sf_dir).select("id", C.fingerprint(*[F.col(c) for c in ("file", "line", "function", "cwe", "title")]).alias("fp"))


def q_dedupe(spark, sf_dir):
    return _plain(C.deduplicate(_in_runs(spark, sf_dir)), *DEDUP_COLS)


def q_merge(spark, sf_dir):
    return _plain(C.merge(C.deduplicate(_in_runs(spark, sf_dir))), *MERGE_COLS)


def q_score(spark, sf_dir):
    return _plain(C.score(_staged(spark, sf_dir), table(spark, sf_dir, "evidence")), *SCORE_COLS)


def _ranked(spark, sf_dir):
    return C.ranked(table(spark, sf_dir, "findings"), table(spark, sf_dir, "evidence"))


def q_rank_ids(spark, sf_dir):
    return _ranked(spark, sf_dir).select("run_id", "id", "priority", "finding_no")


def q_ranked_findings(spark, sf_dir):
    return _plain(_ranked(spark, sf_dir), "run_id", "finding_no", "id", "title", "bucket", "cwe", "severity", "confidence", "priority", "tools")


def q_collect_evidence(spark, sf_dir):
    return C.evidence_of(_staged(spark, sf_dir))


def q_classify(spark, sf_dir):
    cwe = F.col("cwe")
    return _staged(spark, sf_dir).select(
        "id", C.bucket(cwe).alias("bucket"), C.lookup(cwe, C.CWE_NAMES, "Unknown CWE").alias("cwe_name"), C.lookup(cwe, C.BASE_SEVERITY, "medium").alias("base_severity"),
        F.initcap("severity").alias("severity_label"),
    )


def q_controllability(spark, sf_dir):
    surface = F.coalesce(F.lower(F.regexp_replace("attack_surface", r"^\s+|\s+$", "")), F.lit(""))
    rows = table(spark, sf_dir, "findings").where("id is not null").dropDuplicates(["id"])
    return rows.select("id", surface.alias("surface"), C.control_level(surface).alias("level"))


def q_trust_boundary(spark, sf_dir):
    rows = table(spark, sf_dir, "findings").where("id is not null and source_snippet is not null").dropDuplicates(["id"])
    return rows.select("id", F.explode(F.split("source_snippet", "\n", -1)).alias("t")).groupBy("id").agg(
        F.count_if(C.input_source(F.col("t")) == "network").alias("network"), F.count_if(C.input_source(F.col("t")) == "filesystem").alias("filesystem"),
        F.count_if(C.input_source(F.col("t")) == "unknown").alias("unknown"),
    )


def q_severity_dist(spark, sf_dir):
    return A.severity_distribution(_in_runs(spark, sf_dir), "run_id")


def q_conf_buckets(spark, sf_dir):
    return _staged(spark, sf_dir).groupBy("run_id", A.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("findings"))


def q_top_cwes(spark, sf_dir):
    return A.top_values(_staged(spark, sf_dir), "cwe")


def q_top_files(spark, sf_dir):
    return A.top_values(_staged(spark, sf_dir), "file")


def q_validation_summary(spark, sf_dir):
    return A.validation_summary(_staged(spark, sf_dir))


def q_report_verdict(spark, sf_dir):
    return _staged(spark, sf_dir).select("id", A.report_verdict(F.col("status"), F.col("notes")).alias("verdict"))


def q_drop_fp(spark, sf_dir):
    return A.without_false_positives(_staged(spark, sf_dir)).select("id", "status")


def q_list_findings(spark, sf_dir):
    scored = C.score(_in_runs(spark, sf_dir), table(spark, sf_dir, "evidence"))
    return A.list_findings(scored, "high").select("run_id", "id", "title", "priority")


def q_latest_findings(spark, sf_dir):
    scored = C.score(A.latest_run(_in_runs(spark, sf_dir)), table(spark, sf_dir, "evidence"))
    return A.list_findings(scored, limit=100).select("run_id", "id", "title", "priority")


def q_ai_payload(spark, sf_dir):
    scored = C.score(_staged(spark, sf_dir), table(spark, sf_dir, "evidence"))
    return scored.select("id", narrate.payload(scored).alias("payload"))


def q_show_finding(spark, sf_dir):
    return _staged(spark, sf_dir).where("finding_id = 'F-00001'").select("run_id", "id", "title", "cwe", "severity")


def _with(*parts: str) -> str:
    return "with " + ", ".join(p.strip() for p in parts) + " "


_SRC = "case " + " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in C.INPUT_SOURCES.items()) + " else 'unknown' end"
_FULL = _with(STAGED, DEDUPED, MERGED, BROUGHT, _scored("merged", "brought"), RANKED)
_LISTED = lambda c: f"coalesce(json_array_length(case when json_valid({c}) then cast({c} as json) end), 0) > 0"
QUERIES = {
    "q_stage": (q_stage, _with(STAGED) + f"select {_list(*STAGE_COLS)} from staged"),
    "q_fingerprint": (q_fingerprint, _with(STAGED, DEDUPED.replace(" where run_id is not null", "")) + "select id, fp from keyed"),
    "q_dedupe": (q_dedupe, _with(STAGED, DEDUPED) + f"select {_list(*DEDUP_COLS)} from deduped"),
    "q_merge": (q_merge, _with(STAGED, DEDUPED, MERGED) + f"select {_list(*MERGE_COLS)} from merged"),
    "q_score": (q_score, _with(STAGED, _scored("staged")) + f"select {_list(*SCORE_COLS)} from scored"),
    "q_rank_ids": (q_rank_ids, _FULL + "select run_id, id, priority, printf('F-%05d', rank) as finding_no from ranked"),
    "q_ranked_findings": (q_ranked_findings, _FULL + f"select {_list('run_id', 'id', 'title', 'bucket', 'cwe', 'severity', 'confidence', 'priority', 'tools')}, printf('F-%05d', rank) as finding_no from ranked"),
    "q_collect_evidence": (
        q_collect_evidence,
        _with(STAGED) + """select id, case when starts_with(tool, 'rule:') then 'custom_rule' else 'static_analyzer' end as evidence_type, tool as evidence_source,
          case when starts_with(tool, 'rule:') then 'Matched by custom rule: ' else 'Detected by ' end || tool as detail from (select id, unnest(tools) as tool from staged)"""
        + f"""
          union all select distinct id, 'dataflow', '', 'Dataflow path identified' from findings where id is not null and {_LISTED('dataflow')}
          union all select distinct id, 'call_graph', '', 'Call chain identified' from findings where id is not null and {_LISTED('call_chain')}""",
    ),
    "q_classify": (
        q_classify,
        _with(STAGED) + f"""select id, {_case('cwe', {c: n for n, cs in C.BUCKETS.items() for c in cs}, "'general'")} as bucket, {_case('cwe', C.CWE_NAMES, "'Unknown CWE'")} as cwe_name,
          {_case('cwe', C.BASE_SEVERITY, "'medium'")} as base_severity, upper(severity[1]) || severity[2:] as severity_label from staged""",
    ),
    "q_controllability": (
        q_controllability,
        rf"""select distinct id, coalesce(lower(regexp_replace(attack_surface, '^\s+|\s+$', '', 'g')), '') as surface,
          {_case("coalesce(lower(regexp_replace(attack_surface, '^" + chr(92) + "s+|" + chr(92) + "s+$', '', 'g')), '')", C.CONTROL_OF_SOURCE, "'unknown'")} as level from findings where id is not null""",
    ),
    "q_trust_boundary": (
        q_trust_boundary,
        f"""select id, count(*) filter (s = 'network') as network, count(*) filter (s = 'filesystem') as filesystem, count(*) filter (s = 'unknown') as unknown
          from (select id, {_SRC} as s from (select id, unnest(string_split(source_snippet, chr(10))) as t from (select distinct id, source_snippet from findings where id is not null and source_snippet is not null))) group by 1""",
    ),
    "q_severity_dist": (
        q_severity_dist,
        _with(STAGED) + "select run_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in A.SEVERITIES) + ", count(*) as total from staged where run_id is not null group by 1",
    ),
    "q_conf_buckets": (q_conf_buckets, _with(STAGED) + "select run_id, case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as bucket, count(*) as findings from staged group by 1, 2"),
    "q_top_cwes": (q_top_cwes, _with(STAGED) + "select cwe, count(*) as findings from staged where cwe <> '' group by 1 order by 2 desc, 1 limit 5"),
    "q_top_files": (q_top_files, _with(STAGED) + "select file, count(*) as findings from staged where file <> '' group by 1 order by 2 desc, 1 limit 5"),
    "q_validation_summary": (
        q_validation_summary,
        _with(STAGED) + """select cwe, count(*) as findings, count(*) filter (d) as demoted, count(*) filter (d and s) as structurally_demoted, count(*) filter (not d and s) as structurally_confirmed,
          cast(round(count(*) filter (d) / cast(count(*) as double), 4) as double) as rate
          from (select cwe, status = 'likely_false_positive' as d, starts_with(notes, 'structural validation:') as s from staged) group by rollup (cwe)""",
    ),
    "q_report_verdict": (q_report_verdict, _with(STAGED) + "select id, case when status = 'likely_false_positive' then 'likely_fp' when starts_with(notes, 'structural validation:') then 'confirmed' else 'suspicious' end as verdict from staged"),
    "q_drop_fp": (q_drop_fp, _with(STAGED) + "select id, status from staged where status <> 'likely_false_positive'"),
    "q_list_findings": (q_list_findings, _with(STAGED, _scored("staged")) + "select run_id, id, title, priority from scored where run_id is not null and severity = 'high' order by priority desc, run_id, id limit 50"),
    "q_latest_findings": (q_latest_findings, _with(STAGED, _scored("staged")) + "select run_id, id, title, priority from scored where run_id = (select max(run_id) from staged) order by priority desc, run_id, id limit 100"),
    "q_ai_payload": (
        q_ai_payload,
        _with(STAGED, _scored("staged"))
        + """select id, cast(to_json({'id': id, 'title': title, 'category': category, 'cwe': cwe, 'severity': upper(severity[1]) || severity[2:], 'confidence': cast(confidence as double), 'priority_score': priority,
          'file': file, 'line': line, 'function': "function", 'tools': tools, 'reachability': reachability, 'controllability': controllability}) as varchar) as payload from scored""",
    ),
    "q_show_finding": (q_show_finding, _with(STAGED) + "select run_id, id, title, cwe, severity from staged where finding_id = 'F-00001'"),
}
