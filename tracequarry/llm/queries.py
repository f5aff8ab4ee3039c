"""The queries of the training-data operators, with their SQL where SQL can state them."""

from pyspark.sql import functions as F

from tracequarry.llm import bpe, matching, packing, splitting, survivors, topn
from tracequarry.plans.changes import FINGERPRINT_SQL
from tracequarry.plans.finding_queries import posix_sql
from tracequarry.session import table


def p1_found(spark, sf_dir):
    return topn.top_findings(table(spark, sf_dir, "findings")).select("run_id", "id")


P1_SQL = """
select run_id, id from (
  select run_id, id, row_number() over (partition by run_id order by priority_score desc, id) as k
  from (select distinct run_id, id, priority_score from findings
        where run_id is not null and id is not null and priority_score between 0 and 10 and not isnan(priority_score)))
where k <= 10
"""


def p2_found(spark, sf_dir):
    return survivors.best_representatives(table(spark, sf_dir, "findings"), values=False)


_P2_RANKED = rf"""
with f as (
  select distinct run_id, id, {FINGERPRINT_SQL} as fingerprint, created_at, source_snippet,
    case when confidence between 0 and 1 then confidence when confidence > 1 and confidence <= 100 then confidence / 100 end as c,
    len(list_distinct(regexp_extract_all(lower(coalesce(tools, '')), '[a-z][a-z0-9:_-]*'))) as n,
    len(list_filter(string_split(coalesce(source_snippet, ''), chr(10)), lambda x: regexp_matches(x, '^[ \t]*(>>>)?[ \t]*[0-9]+ \|'))) as s
  from findings where run_id is not null and id is not null
), r as (
  select *, count(*) over g as size,
    row_number() over (partition by run_id, fingerprint order by c desc nulls last, n desc, created_at desc nulls last, id) as k,
    row_number() over (partition by run_id, fingerprint order by s desc, c desc nulls last, n desc, created_at desc nulls last, id) as ks
  from f where fingerprint is not null window g as (partition by run_id, fingerprint)
)
"""
_P2_IDS = "run_id, fingerprint, max(case when k = 1 then id end) as keep_id, max(case when ks = 1 then case when s > 0 then id else 0 end end) as snippet_id"
P2_SQL = f"{_P2_RANKED} select {_P2_IDS} from r where size > 1 group by run_id, fingerprint"
P2_SURVIVORS_SQL = f"""{_P2_RANKED} select {_P2_IDS}, max(case when k = 1 then c end) as confidence, max(case when ks = 1 and s > 0 then source_snippet end) as source_snippet
from r where size > 1 group by run_id, fingerprint"""


def p2_survivors(spark, sf_dir):
    return survivors.best_representatives(table(spark, sf_dir, "findings"))


def p2_judged(spark, sf_dir):
    findings, runs = table(spark, sf_dir, "findings"), table(spark, sf_dir, "runs")
    best = survivors.best_representatives(findings, runs, values=False)
    return best.select("run_id", "fingerprint", *[F.array_join(k, "\n" if k == "lines" else ",").alias(k) for k in survivors.FIELDS])


def p2_sources(spark, sf_dir):
    return survivors.source_quality(table(spark, sf_dir, "findings"), table(spark, sf_dir, "runs"))


def _tables(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


P5_TABLES = ("scanner_results", "findings", "runs", "projects", "cwe_catalog")


def p5_found(spark, sf_dir):
    return matching.match_results(*_tables(spark, sf_dir, *P5_TABLES), exact=True).select("result_id", "fingerprint")


_NUMBER = r"try_cast(regexp_extract({c}, '(?i)^\s*(?:cwe)?[\s_:-]*0*([1-9][0-9]*)\b', 1) as int)"
_PROJECT = r"regexp_replace(lower(trim({c})), '-(?:main|master|trunk|v?[0-9]+(?:\.[0-9]+)*)$', '')"
_BEFORE = "regexp_extract(left('/' || r.path, greatest(length(r.path) - length(d.path), 0)), '[^/]*$')"
P5_SQL = rf"""
with cat as (select distinct {_NUMBER.format(c='cwe')} as cwe, family from cwe_catalog),
proj as (select distinct id as project_id, lower(trim(root_path)) as root, {_PROJECT.format(c='project_name')} as project from projects),
own as (select distinct id as run_id, project_id from runs where id is not null and project_id is not null),
d0 as (
  select project_id, fp, min(case when trim(file_path) <> '' then file_path end) as raw, min(case when line > 0 then line end) as line, min(number) as cwe
  from (select *, {FINGERPRINT_SQL} as fp, {_NUMBER.format(c='cwe')} as number from findings) join own using (run_id) where fp is not null group by 1, 2
), d1 as (
  select project_id, fp, line, family, root, project, lower({posix_sql('raw')}) as p from d0 join cat using (cwe) left join proj using (project_id) where raw is not null and line is not null
), d as (select *, case when starts_with(p, root || '/') then substr(p, length(root) + 2) else ltrim(p, '/') end as path from d1),
r0 as (
  select result_id, min(reported_path) as raw, min(line_no) as line, {_NUMBER.format(c='min(weakness)')} as cwe, min(msg) as msg
  from scanner_results where result_id is not null and line_no > 0 and reported_path is not null group by 1
), r1 as (
  select r0.*, family, regexp_replace(lower({posix_sql('raw')}), '^(?:[a-z]:)?/*(?:\.\.?/+)*', '') as path,
    list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce(msg, ''), '''[^'']*''|\([^)]*\)|\[[^\]]*\]', ' ', 'g')), '[^a-z]+'), lambda w: length(w) > 1)) as words
  from r0 left join cat using (cwe)
), sizes as (select family, count(*) as n from r1 where family is not null and len(words) > 0 group by 1),
gains as (select family, word, ln((count(*) + 0.5) / 0.5) as gain from (select family, unnest(words) as word from r1 where family is not null) group by 1, 2),
scored as (
  select result_id, g.family, round(sum(gain) + ln(any_value(n)) + any_value(k) * ln(0.5 / (any_value(n) + 1)), 9) as score
  from (select result_id, len(words) as k, unnest(words) as word from r1 where family is null) o join gains g using (word) join sizes z on z.family = g.family group by 1, 2
), told as (select result_id, arg_max(family, (score, family)) as told from scored group by 1),
r as (select result_id, path, line, coalesce(family, told) as family from r1 left join told using (result_id) where path is not null),
pairs as (
  select r.result_id, d.fp, row_number() over (partition by r.result_id order by abs(r.line - d.line), d.project_id, d.fp) as k
  from r join d on d.family = r.family and regexp_extract(d.path, '[^/]*$') = regexp_extract(r.path, '[^/]*$') and abs(r.line - d.line) <= 3
  where (ends_with('/' || r.path, '/' || d.path) and ({_BEFORE} = '' or {_PROJECT.format(c=_BEFORE)} in (d.project, regexp_extract(d.root, '[^/]*$'))))
    or ends_with('/' || d.path, '/' || r.path)
)
select result_id, fp as fingerprint from pairs where k = 1
"""


def p5_matches(spark, sf_dir):
    return matching.match_results(*_tables(spark, sf_dir, *P5_TABLES))


def p6_ids(spark, sf_dir):
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


#: Production sizes in tokens: a container, and the pieces of texts with what neighbours share.
CAPACITY, LIMIT, OVERLAP = 4096, 512, 64


def p7_containers(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), CAPACITY)


def p8_pieces(spark, sf_dir):
    return splitting.split_documents(table(spark, sf_dir, "documents"), LIMIT, OVERLAP)


QUERIES = {
    "p1_found": (p1_found, P1_SQL),
    "p2_found": (p2_found, P2_SQL),
    "p2_survivors": (p2_survivors, P2_SURVIVORS_SQL),
    "p2_judged": (p2_judged, None),
    "p2_sources": (p2_sources, None),
    "p5_found": (p5_found, P5_SQL),
    "p5_matches": (p5_matches, None),
    "p6_ids": (p6_ids, None),
    "p7_containers": (p7_containers, None),
    "p8_pieces": (p8_pieces, None),
}
