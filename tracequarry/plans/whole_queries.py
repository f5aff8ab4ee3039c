"""Queries over taint, reports, narratives, streams and the whole pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracequarry.functions import patterns as P
from tracequarry.operators import correlate as C
from tracequarry.operators import narrate, rules, taint
from tracequarry.operators.analytics import SEVERITIES
from tracequarry.plans import pipeline, report
from tracequarry.plans.code_queries import _files
from tracequarry.plans.finding_queries import _FULL, STAGED, _with
from tracequarry.plans.rule_queries import BODIES, WITH, _q, all_files, m
from tracequarry.plans.scanner_queries import captured
from tracequarry.session import cut, shared_folder, table
from tracequarry.streaming import findings as stream


def q_taint_seed(spark, sf_dir):
    return taint.seeds(_files(spark, sf_dir))


def q_taint_closure(spark, sf_dir):
    rows = taint.tainted_functions(all_files(spark, sf_dir))
    return rows.select("file", "function", "head", F.explode("tainted").alias("t")).select("file", "function", "head", "t.*")


def q_return_taint(spark, sf_dir):
    rows = taint.returns_taint(taint.tainted_functions(all_files(spark, sf_dir)))
    return rows.withColumn("sources", F.array_join("sources", ","))


def q_sink_match(spark, sf_dir):
    hits = taint.taint_hits(taint.tainted_functions(all_files(spark, sf_dir)))
    return hits.select("file", "function", "line", "sink", "cwe", F.array_join("tainted", ",").alias("tainted"))


def q_taint_standalone(spark, sf_dir):
    return taint.standalone(taint.taint_hits(taint.tainted_functions(all_files(spark, sf_dir)))).withColumn("tools", F.array_join("tools", ","))


def q_pipeline(spark, sf_dir):
    done = pipeline.analyse(_files(spark, sf_dir), captured(spark, sf_dir))
    return done.select("finding_no", "file", "line", "function", "cwe", "severity", F.col("confidence").cast("double").alias("confidence"), "priority", "verdict", "status", "reachability", "controllability", "attack_surface", "taint_info", F.array_join("tools", ",").alias("tools"))


def q_reports(spark, sf_dir):
    findings, evidence = table(spark, sf_dir, "findings"), table(spark, sf_dir, "evidence")
    ranked = cut(C.ranked(findings, evidence))
    staged = C.stage(findings).where("run_id is not null")
    texts = findings.where("id is not null").select("id", F.col("source_snippet").alias("snippet"), F.col("dataflow").alias("flow"), F.col("call_chain").alias("chain"))
    kept = texts.join(ranked.select("id"), "id", "left_semi").dropDuplicates(["id"])
    return report.reports(ranked, evidence=C.united_evidence(staged, ranked, evidence), texts=kept)


def q_narratives(spark, sf_dir):
    staged = C.stage(table(spark, sf_dir, "findings"))
    return staged.select("id", narrate.narrative(staged).alias("text"))


def q_run_summaries(spark, sf_dir):
    return narrate.run_summaries(C.stage(table(spark, sf_dir, "findings")).where("run_id is not null"), "run_id")


def q_list_rules(spark, sf_dir):
    hits = rules.rule_findings(_files(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("findings"))
    return rules.catalogue(spark).join(hits.withColumnRenamed("rule", "name"), "name", "left").select("ord", "name", "cwe", "category", F.coalesce("findings", F.lit(0)).alias("findings"))


def q_stream_severity(spark, sf_dir):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    counts = stream.severity_counts(stream.read_stream(spark, f"{sf_dir}/findings.parquet"))
    stream.run_available(counts, f"{folder}/counts", f"{folder}/state")
    return spark.read.parquet(f"{folder}/counts")


_SEV = " || ', ' || ".join(f"'{s}=' || count(*) filter (severity = '{s}')" for s in ("critical", "high", "medium", "low"))
_NAME = "case cwe " + " ".join(f"when '{k}' then '{v}'" for k, v in C.CWE_NAMES.items()) + " else 'Unknown CWE' end"
_WEAKNESS = "case cwe " + " ".join(f"when '{k}' then '{v}'" for k, v in C.CWE_NAMES.items()) + " else 'Unknown CWE' end"
_OBJECT = ", ".join(f"'{k}': {k if k != 'function' else chr(34) + k + chr(34)}" for k in report.FIELDS)
_ESCAPED = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
_SAID = " || ".join(f"case when {v} <> '' then chr(10) || '- {k}: ' || {v} else '' end" for k, v in (("tools", "array_to_string(tools, ', ')"), ("evidence", "array_to_string(evidence, ', ')"), ("flow", "flow"), ("chain", "chain"), ("notes", "notes")))
_COUNTS = " || ', ' || ".join(f"'{s} ' || {s}" for s in SEVERITIES)
_REPORTS = f"""{_FULL}, said as (select finding_id as fid, list_sort(list(distinct coalesce(evidence_type, '') || ':' || coalesce(evidence_source, ''))) as evidence from brought group by 1),
texts as (select distinct id as tid, coalesce(source_snippet, '') as snippet, coalesce(dataflow, '') as flow, coalesce(call_chain, '') as chain from findings where id is not null),
f as (
  select * replace (cast(confidence as double) as confidence, coalesce(evidence, []) as evidence), priority as score, printf('F-%05d', rank) as finding_no, cast((rank - 1) // {report.LISTED} as int) as part, {_WEAKNESS} as weakness,
    case when status = 'likely_false_positive' then 'likely_fp' when starts_with(notes, 'structural validation:') then 'confirmed' else 'suspicious' end as verdict
  from ranked left join said on fid = id join texts on tid = id
), parts as (
  select run_id, part, string_agg(cast(to_json({{{_OBJECT}}}) as varchar), ',' order by rank) as js,
    string_agg(printf('## %s %s%s- %s, %s %s, score %.1f, %s%s- %s:%d', finding_no, title, chr(10), severity, cwe, weakness, score, verdict, chr(10), file, line) || {_SAID}
      || case when snippet <> '' then chr(10) || '```' || chr(10) || snippet || chr(10) || '```' else '' end, chr(10) order by rank) as md,
    string_agg('<tr><td>' || concat_ws('</td><td>', finding_no, {_ESCAPED('title')}, severity, cwe, printf('%.1f', score), verdict, {_ESCAPED("file || ':' || line")}, '<pre>' || {_ESCAPED('snippet')} || '</pre>') || '</td></tr>', '' order by rank) as ht
  from f group by 1, 2
), totals as (
  select run_id, {', '.join(f"count(*) filter (severity = '{s}') as {s}" for s in SEVERITIES)}, count(*) as total, count(*) filter (status = 'likely_false_positive') as demoted, count(*) filter (verdict = 'confirmed') as confirmed from f group by 1
), cwes as (select run_id, list({{'cwe': cwe, 'findings': n}} order by cwe) as cwes from (select run_id, cwe, count(*) as n from f group by 1, 2) group by 1),
whole as (
  select *, part = 0 as start_, part = (total - 1) // {report.LISTED} as end_, {_COUNTS} as counts,
    cast(to_json({{'run_id': run_id, 'total': total, {', '.join(f"'{s}': {s}" for s in SEVERITIES)}, 'demoted': demoted, 'confirmed': confirmed, 'cwes': cwes}}) as varchar) as head
  from parts join totals using (run_id) join cwes using (run_id)
)
select run_id, 'json' as format, part, case when start_ then head[:-2] || ',"findings":[' else ',' end || js || case when end_ then ']}}' else '' end as text from whole
union all select run_id, 'markdown', part, case when start_ then printf('# Run %d%s%d findings: ', run_id, chr(10), total) || counts || chr(10) || printf('%d demoted, %d confirmed; ', demoted, confirmed)
  || array_to_string(list_transform(cwes, lambda c: printf('%s %d', c.cwe, c.findings)), ', ') || chr(10) else chr(10) end || md from whole
union all select run_id, 'html', part, case when start_ then printf('<html><body><h1>Run %d</h1><p>', run_id) || counts || printf('; %d demoted, %d confirmed</p><table>', demoted, confirmed) else '' end
  || ht || case when end_ then '</table></body></html>' else '' end from whole
"""
_HITS = " union all ".join(f"select {_q(name)} as rule from ({BODIES[name]})" for name, _, _ in P.RULES)
_RULES = ", ".join(f"({k}, {_q(name)}, {_q(cwe)}, {_q(category)})" for k, (name, cwe, category) in enumerate(P.RULES))
QUERIES = {
    "q_taint_seed": (
        q_taint_seed,
        rf"""{WITH}, sig as (select f.file, f.name as function, unnest(string_split(regexp_extract(n.t, '\((.*)\)', 1), ',')) as p from functions f join every_line n on n.file = f.file and n.line = f.head),
          named as (select file, function, regexp_extract(p, '([A-Za-z_]\w*)[^A-Za-z_]*$', 1) as param from sig)
          select file, function, param from named where param not in ('', 'void') and ({m('function', taint.NETWORK_FUNCTION)} or {m('param', taint.SOURCE_NAME)})""",
    ),
    "q_taint_closure": (q_taint_closure, None),
    "q_return_taint": (q_return_taint, None),
    "q_sink_match": (q_sink_match, None),
    "q_taint_standalone": (q_taint_standalone, None),
    "q_pipeline": (q_pipeline, None),
    "q_reports": (q_reports, _REPORTS),
    "q_narratives": (
        q_narratives,
        _with(STAGED)
        + f"""select id, title || ' (' || severity || ', ' || cast(cast(round(confidence * 100) as int) as varchar) || '% confidence) at ' || file || ':' || line || ' in '
          || case when "function" <> '' then "function" else 'an unnamed function' end || '; ' || cwe || ' ' || {_NAME} || '; reported by '
          || case when len(tools) > 0 then array_to_string(tools, ', ') else 'no tool' end || '.' as text from staged""",
    ),
    "q_run_summaries": (
        q_run_summaries,
        _with(STAGED)
        + f"""select run_id, count(*) || ' candidate findings (' || {_SEV} || '); ' || case when count(*) filter (severity in ('critical', 'high')) > 0
          then count(*) filter (severity in ('critical', 'high')) || ' need review first' else 'none is high or critical' end || '.' as summary from staged where run_id is not null group by 1""",
    ),
    "q_list_rules": (q_list_rules, f"{WITH}, hits as ({_HITS}), rules(ord, name, cwe, category) as (values {_RULES}) select ord, name, cwe, category, count(rule) as findings from rules left join hits on rule = name group by 1, 2, 3, 4"),
    "q_stream_severity": (
        q_stream_severity,
        r"""select date_trunc('day', created_at)::timestamp as start, nullif(regexp_replace(lower(severity), '^\s+|\s+$', '', 'g'), '') as severity, count(*) as findings
          from (select distinct id, created_at, severity from findings where id is not null and created_at is not null) group by 1, 2""",
    ),
}
