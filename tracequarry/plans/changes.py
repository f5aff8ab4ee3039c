"""Queries over snapshots and export files (problems 3 and 4), with their SQL."""

from tracequarry.operators import drift, snapshots
from tracequarry.session import table

FINGERPRINT_SQL = (
    r"case when regexp_extract(lower(fingerprint), '^\s*(?:sha256:|0x)?([0-9a-f]{16})(?:[0-9a-f]{48})?\s*$', 1) not in "
    r"('', '0000000000000000', 'ffffffffffffffff') then "
    r"regexp_extract(lower(fingerprint), '^\s*(?:sha256:|0x)?([0-9a-f]{16})(?:[0-9a-f]{48})?\s*$', 1) end"
)


def p3_found(spark, sf_dir):
    return snapshots.finding_changes(table(spark, sf_dir, "findings"), table(spark, sf_dir, "runs"))


P3_SQL = rf"""
with done as (
  select distinct id as run_id, project_id, run_ts,
    nullif(regexp_extract(lower(commit_hash), '^\s*(?:\S*-g)?([0-9a-f]{{7,40}})\s*$', 1), '') as h
  from runs
  where regexp_matches(lower(status), '^\s*completed\s*$') and run_ts is not null and project_id is not null and id is not null
), led as (select *, lead(h) over (partition by project_id order by run_ts, run_id) as h2 from done),
snap as (
  select run_id, project_id, row_number() over (partition by project_id order by run_ts, run_id) as n from led
  where not coalesce(starts_with(h, h2) or starts_with(h2, h), false)
), state as (
  select run_id, fp, arg_min(s, id) as s from (
    select run_id, id, {FINGERPRINT_SQL} as fp,
      regexp_replace(lower(coalesce(severity, '')), '^\s+|\s+$', '', 'g') || '/' || regexp_replace(lower(coalesce(status, '')), '^\s+|\s+$', '', 'g') as s
    from findings where run_id is not null)
  where fp is not null group by run_id, fp
), pairs as (select a.run_id as old_id, b.run_id as new_id from snap a join snap b on a.project_id = b.project_id and b.n = a.n + 1),
old as (select new_id, fp, s from pairs join state on state.run_id = old_id),
new as (select new_id, fp, s from pairs join state on state.run_id = new_id)
select coalesce(old.new_id, new.new_id) as run_id, coalesce(old.fp, new.fp) as fingerprint,
  case when old.fp is null then 'added' when new.fp is null then 'removed' else 'changed' end as change
from old full join new on old.new_id = new.new_id and old.fp = new.fp
where old.s is distinct from new.s
"""


def p3_runs(spark, sf_dir):
    return snapshots.snapshot_runs(table(spark, sf_dir, "runs"))


P3_RUNS_SQL = rf"""
with done as (
  select distinct id as run_id, project_id, run_ts,
    nullif(regexp_extract(lower(commit_hash), '^\s*(?:\S*-g)?([0-9a-f]{{7,40}})\s*$', 1), '') as h
  from runs
  where regexp_matches(lower(status), '^\s*completed\s*$') and run_ts is not null and project_id is not null and id is not null
), led as (select *, lead(h) over (partition by project_id order by run_ts, run_id) as h2 from done)
select run_id, project_id,
  cast(row_number() over (partition by project_id order by run_ts, run_id) as int) as snap,
  cast(count(*) over (partition by project_id) as int) as snaps,
  lead(run_id) over (partition by project_id order by run_ts, run_id) as next_run_id
from led where not coalesce(starts_with(h, h2) or starts_with(h2, h), false)
"""


def p4_found(spark, sf_dir):
    return p4_changes(spark, sf_dir).select("file_id", "field_name", "change")


def p4_changes(spark, sf_dir):
    return drift.schema_changes(table(spark, sf_dir, "finding_exports"))


def p4_alternatives(spark, sf_dir):
    return drift.new_alternatives(table(spark, sf_dir, "finding_exports"))


def p4_table(spark, sf_dir):
    wide = drift.unified_table(table(spark, sf_dir, "finding_exports"))
    return wide.select("file_id", "line_no", *drift.FIELDS, *[f"{f}_tag" for f in drift.FIELDS])


_FIELD_CASE = "case " + " ".join(
    f"when last in ({', '.join(map(repr, names))}) then '{field}'" for field, names in drift.FIELDS.items()
) + " end"

_P4_WALK = rf"""
with recursive lines as (
  select distinct file_id, line_no, cast(payload as json) as j from finding_exports
  where file_id is not null and json_valid(payload) and json_type(payload) = 'OBJECT'
), walk as (
  select file_id, line_no, k as path, json_extract(j, '$."' || k || '"') as v
  from (select *, unnest(json_keys(j)) as k from lines)
  union all
  select file_id, line_no, path || '.' || k, json_extract(v, '$."' || k || '"')
  from (select *, unnest(json_keys(v)) as k from walk where json_type(v) = 'OBJECT')
), named as (
  select *, replace(replace(lower(regexp_extract(path, '[^.]*$')), '_', ''), '-', '') as last,
    case when json_type(v) = 'ARRAY' then list_distinct(list_filter([json_type(x) for x in cast(v as json[])], lambda t: t <> 'NULL')) end as types
  from walk
), alternatives as (
  select file_id, line_no, path, v, {_FIELD_CASE} as field_name,
    case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'NULL' then null
      when 'ARRAY' then case when json_array_length(v) = 0 then null when types = ['VARCHAR'] then 'list of strings' when types = ['OBJECT'] then 'list of objects' else 'mixed list' end
      else 'number' end as tag
  from named
)
"""
_P4_FILES = """
files as (
  select file_id, min(feed) as feed, min(exported_at) as t_at from finding_exports
  where feed is not null and exported_at is not null and file_id is not null group by 1
), paired as (select feed, file_id, lag(file_id) over (partition by feed order by t_at, file_id) as was from files)
"""
_P4_VALUES = (
    _P4_WALK
    + """
, vals as (
  select * from alternatives a where field_name is not null and tag is not null and not (tag = 'object' and exists (
    select 1 from alternatives i where i.file_id = a.file_id and i.line_no is not distinct from a.line_no and i.field_name = a.field_name and starts_with(i.path, a.path || '.')))
)
"""
)

P4_CHANGES_SQL = (
    _P4_VALUES
    + f"""
, unions as (
  select file_id, field_name, string_agg(distinct path, ',' order by path) as paths, string_agg(distinct tag, ',' order by tag) as tags,
    list_sort(list(distinct path || ' ' || tag)) as pairs
  from vals group by 1, 2
), {_P4_FILES},
each as (
  select feed, p.file_id, f.field_name, a.paths as ap, a.tags as a_t, b.paths as bp, b.tags as b_t, a.pairs as a_p, b.pairs as b_p,
    list_filter(a.pairs, lambda x: list_contains(list_transform(b.pairs, lambda y: split_part(y, ' ', 1)), split_part(x, ' ', 1))) as a_s,
    list_filter(b.pairs, lambda x: list_contains(list_transform(a.pairs, lambda y: split_part(y, ' ', 1)), split_part(x, ' ', 1))) as b_s
  from (select * from paired where was is not null) p
  cross join (values ('attack_surface'), ('vendor_source'), ('dataflow')) f(field_name)
  left join unions a on a.file_id = was and a.field_name = f.field_name
  left join unions b on b.file_id = p.file_id and b.field_name = f.field_name
)
select feed, file_id, field_name, 'added' as change, cast(null as varchar) as before, bp as after from each where ap is null and bp is not null
union all select feed, file_id, field_name, 'removed', ap, null from each where ap is not null and bp is null
union all select feed, file_id, field_name, 'renamed', ap, bp from each where ap <> bp
union all select feed, file_id, field_name, 'retyped', a_t, b_t from each where a_t <> b_t
union all select feed, file_id, field_name, 'retyped', array_to_string(a_p, ','), array_to_string(b_p, ',') from each where a_t = b_t and a_s <> b_s
"""
)

P4_ALTERNATIVES_SQL = (
    _P4_WALK
    + f"""
, seen as (select distinct file_id, path, tag, field_name from alternatives where tag is not null), {_P4_FILES}
select feed, s.file_id, path, tag, field_name from seen s join paired p on p.file_id = s.file_id and was is not null
where not exists (select 1 from seen b where b.file_id = was and b.path = s.path and b.tag = s.tag)
"""
)

_SORTED = "'{{' || array_to_string(list_transform(list_sort(json_keys(o)), lambda k: '\"' || k || '\":' || cast(json_extract(o, '$.\"' || k || '\"') as varchar)), ',') || '}}'".replace("{{", "{").replace("}}", "}")
P4_TABLE_SQL = (
    _P4_VALUES
    + f"""
, texts as (
  select file_id, line_no, field_name, tag, row_number() over (partition by file_id, line_no, field_name order by path) as k,
    case tag when 'string' then json_extract_string(v, '$') when 'list of strings' then array_to_string(cast(v as varchar[]), ' > ')
      when 'list of objects' then '[' || array_to_string(list_transform(cast(v as json[]), lambda o: {_SORTED}), ',') || ']' else cast(v as varchar) end as t
  from vals
)
select file_id, line_no, {', '.join(f"max(t) filter (field_name = '{f}') as {f}, max(tag) filter (field_name = '{f}') as {f}_tag" for f in drift.FIELDS)}
from texts where k = 1 group by 1, 2
"""
)

P4_FOUND_SQL = "select file_id, field_name, change from (" + P4_CHANGES_SQL + ")"

#: name: (query, SQL or None)
QUERIES = {
    "p3_found": (p3_found, P3_SQL),
    "p3_runs": (p3_runs, P3_RUNS_SQL),
    "p4_found": (p4_found, P4_FOUND_SQL),
    "p4_changes": (p4_changes, P4_CHANGES_SQL),
    "p4_alternatives": (p4_alternatives, P4_ALTERNATIVES_SQL),
    "p4_table": (p4_table, P4_TABLE_SQL),
}
