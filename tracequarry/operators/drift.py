"""Fields that change name, place and type between the files of a feed.

Every path of every file keeps the type tags it occurred with (a tagged union); the branches
are converted into one table, and differences between neighbouring files reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.ordering import neighbour, rank_within
from tracequarry.session import cut

#: Which names mean a field: without letter case, '_' and '-', the last step of a path.
FIELDS = {
    "attack_surface": ["attacksurface", "entrysurface", "exposure", "surface"],
    "vendor_source": ["vendorsource", "thirdparty", "vendor", "vendored", "vendoredfrom"],
    "dataflow": ["dataflow", "flow", "flowsteps", "taintpath", "steps"],
}
TAGS = ["string", "boolean", "list of strings", "list of objects", "number", "object", "mixed list"]
#: Levels of objects opened by one expression; deeper ones go on from where it ended.
LEVELS = 3


def type_tag(kind: Column, value: Column) -> Column:
    """The branch of the union that a VARIANT of this schema belongs to; null for null and empty lists.

    A list is one of strings or of objects if all its items but nulls are, else a mixed one.
    """
    return (
        F.when(kind == "STRING", F.lit("string"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind == "ARRAY<STRING>", F.lit("list of strings"))
        .when(kind.startswith("ARRAY<OBJECT"), F.lit("list of objects"))
        .when((kind == "VOID") | ((kind == "ARRAY<VOID>") & (F.to_json(value) == "[]")), F.lit(None))
        .when(kind.startswith("ARRAY"), F.lit("mixed list"))
        .when(kind.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("number"))
    )


def object_depth(lines: DataFrame, payload: str = "payload", least: int = LEVELS) -> int:
    """How deep objects lie in objects in the lines at most, `least` if no deeper; one scan without parsing.

    Braces and brackets outside strings are followed where many nest; objects in lists do not
    count, nor do lines that leave some open, since they can't be read.
    """
    count = F.length(payload) - F.length(F.replace(payload, F.lit("{"), F.lit("")))
    marks = F.regexp_replace(payload, r'"(?:[^"\\]|\\.)*+"|[^{}\[\]]', "")
    left = F.translate(marks, "[]", "")
    for _ in range(least):
        left = F.replace(left, F.lit("{}"), F.lit(""))

    def step(s, c):
        lists = s["lists"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        now = s["now"] + F.when(lists > 0, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), lists.alias("lists"), F.greatest(s["most"], now).alias("most"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("lists"), F.lit(0).alias("most"))
    followed = F.aggregate(F.split("marks", ""), zero, step, lambda s: F.when((s["now"] == 0) & (s["lists"] == 0), s["most"]))
    nested = lines.where(count > least).select(marks.alias("marks"), left.alias("left")).where("left <> ''")
    return max(least, nested.agg(F.max(followed)).first()[0] or 0)


def json_leaves(lines: DataFrame, payload: str = "payload", wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per path and value of each JSON object line: the line's columns, path, value, tag.

    Objects are opened however deep they lie, their names joined with dots, and give a row
    themselves, too; lists are leaves. Unreadable lines, lines that are no object, null values
    and empty lists give no row. `wanted` tells by a path which rows to keep. Each line is
    parsed once; the depth of the whole table tells how often what is left has to be opened.
    """
    keep = [c for c in lines.columns if c != payload]
    opened = lambda value: F.coalesce(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<struct<key: string, value: variant>>"))
    named = lambda prefix, e: F.struct(F.concat(prefix, e["key"]).alias("path"), e["value"].alias("value"))
    rows = lines.select(*keep, F.lit("").alias("_p"), F.try_parse_json(payload).alias("_v"))
    rounds = -(-object_depth(lines, payload) // LEVELS)
    out = None
    for k in range(rounds):
        arrays = [F.transform(opened(F.col("_v")), lambda e: named(F.col("_p"), e))]
        opening = rows
        for depth in range(LEVELS):
            opening = opening.withColumn(f"_l{depth}", arrays[-1])
            inner = lambda x: F.transform(opened(x["value"]), lambda e: named(F.concat(x["path"], F.lit(".")), e))
            arrays.append(F.flatten(F.transform(f"_l{depth}", inner)))
        levels = [F.col(f"_l{depth}") for depth in range(LEVELS)]
        found = F.concat(*[level if wanted is None else F.filter(level, lambda x: wanted(x["path"])) for level in levels])
        each = opening.select(*keep, F.explode(found).alias("_x")).select(*keep, "_x.path", "_x.value", F.schema_of_variant("_x.value").alias("_kind"))
        each = each.withColumn("tag", type_tag(F.col("_kind"), F.col("value"))).drop("_kind").where("tag is not null")
        out = each if out is None else out.unionAll(each)
        if k + 1 < rounds:
            rest = F.filter(levels[-1], lambda x: F.startswith(F.schema_of_variant(x["value"]), F.lit("OBJECT")))
            rows = cut(opening.select(*keep, F.explode(rest).alias("_x")).select(*keep, F.concat("_x.path", F.lit(".")).alias("_p"), F.to_json("_x.value").alias("_j")))
            rows = rows.select(*keep, "_p", F.try_parse_json("_j").alias("_v"))
    return out


def _last_step(path: Column) -> Column:
    return F.translate(F.lower(F.substring_index(path, ".", -1)), "_-", "")


def canonical_field(path: Column, fields: dict[str, list[str]] = FIELDS) -> Column:
    """The field that a path names, by its last step; null for other paths."""
    names = F.create_map(*[F.lit(x) for field, names in fields.items() for name in names for x in (name, field)])
    return F.try_element_at(names, _last_step(path))


def is_field(path: Column, fields: dict[str, list[str]] = FIELDS) -> Column:
    """Whether a path names any of the fields."""
    return _last_step(path).isin([name for names in fields.values() for name in names])


def _around(field: Column, value: Column, fields: dict[str, list[str]]) -> Column:
    """Whether an object holds, at any depth, something that is named like the field: then it is part of its name."""
    spelt = lambda names: "|".join("[_-]*".join(n) for n in names)
    holds = lambda names: F.to_json(value).rlike(rf'(?i)(?<!\\)"[_-]*(?:{spelt(names)})[_-]*":')
    out = F.lit(False)
    for name, names in fields.items():
        out = F.when(field == name, holds(names)).otherwise(out)
    return out


def field_values(exports: DataFrame, fields: dict[str, list[str]] = FIELDS) -> DataFrame:
    """file_id, line_no, field_name, path, tag, value of every value of the fields.

    An object is a value only if it isn't around another one of the same field.
    """
    lines = exports.select("file_id", "line_no", "payload").where(F.col("file_id").isNotNull())
    values = json_leaves(lines, wanted=lambda p: is_field(p, fields)).withColumn("field_name", canonical_field(F.col("path"), fields))
    return values.where((F.col("tag") != "object") | ~_around(F.col("field_name"), F.col("value"), fields))


def files_in_order(exports: DataFrame) -> DataFrame:
    """(file_id, feed, exported_at, rank): the files of each feed by (exported_at, file_id).

    A file without a feed or a time is none.
    """
    files = exports.dropna(subset=["file_id", "feed", "exported_at"]).groupBy("file_id").agg(F.min("feed").alias("feed"), F.min("exported_at").alias("exported_at"))
    return rank_within(files, "feed", [F.asc("exported_at"), F.asc("file_id")])


def schema_changes(exports: DataFrame, fields: dict[str, list[str]] = FIELDS) -> DataFrame:
    """(feed, file_id, field_name, change, before, after) from each file of a feed to the next.

    Of every file and field the (path, tag) alternatives are kept. added and removed: the field
    has values only in the later or earlier file. In both: renamed if the sets of paths differ,
    retyped if the sets of tags do or those of a path that both have; before and after list
    paths or tags (with their paths where the tags alone are the same). A file without a
    readable line has no fields. Repeated rows don't matter as only sets are kept; a file
    without a feed or a time is none.
    """
    unions = field_values(exports, fields).groupBy("file_id", "field_name").agg(F.array_sort(F.collect_set(F.struct("path", "tag"))).alias("pairs"))
    per_file = unions.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "pairs"))).alias("now"))
    paired = neighbour(files_in_order(exports).join(per_file, "file_id", "left"), "feed", -1, {"was": "now"}).where("rank > 1")
    each = paired.select("feed", "file_id", "was", "now", F.explode(F.array(*map(F.lit, fields))).alias("field_name")).select(
        "feed", "file_id", "field_name", F.expr("was[field_name]").alias("a"), F.expr("now[field_name]").alias("b")
    )
    only = lambda c, part: F.array_sort(F.array_distinct(F.transform(c, lambda x: x[part])))
    each = each.withColumns({"ap": only("a", "path"), "bp": only("b", "path"), "at": only("a", "tag"), "bt": only("b", "tag")})
    shared = lambda c: F.filter(c, lambda x: F.array_contains("ap", x["path"]) & F.array_contains("bp", x["path"]))
    text = lambda c: F.array_join(c, ",")
    full = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["path"], x["tag"])), ",")
    event = lambda what, a, b: F.struct(F.lit(what).alias("change"), a.alias("before"), b.alias("after"))
    none, col = F.lit(None).cast("string"), F.col
    both = col("a").isNotNull() & col("b").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(col("a").isNull() & col("b").isNotNull(), event("added", none, text("bp"))),
            F.when(col("a").isNotNull() & col("b").isNull(), event("removed", text("ap"), none)),
            F.when(both & (col("ap") != col("bp")), event("renamed", text("ap"), text("bp"))),
            F.when(both & (col("at") != col("bt")), event("retyped", text("at"), text("bt"))).when(
                both & (shared("a") != shared("b")), event("retyped", full("a"), full("b"))
            ),
        )
    )
    return each.select("feed", "file_id", "field_name", F.explode(found).alias("e")).select("feed", "file_id", "field_name", "e.*")


def new_alternatives(exports: DataFrame, fields: dict[str, list[str]] = FIELDS) -> DataFrame:
    """(feed, file_id, path, tag, field_name): what a file of a feed has at some path and the file before it had not.

    All paths are looked at; field_name is null where no field claims the path, so that a name
    that `fields` doesn't know yet comes to light. The first file of a feed reports nothing.
    Alternatives meet by file, path and tag, so that files of any number of paths are spread.
    """
    lines = exports.select("file_id", "payload").where(F.col("file_id").isNotNull())
    seen = cut(json_leaves(lines).select("file_id", "path", "tag").distinct())
    files = neighbour(files_in_order(exports), "feed", -1, {"was": "file_id"}).where("rank > 1").select("feed", "file_id", "was")
    fresh = seen.join(files, "file_id").join(seen.withColumnRenamed("file_id", "was"), ["was", "path", "tag"], "left_anti")
    return fresh.select("feed", "file_id", "path", "tag", canonical_field(F.col("path"), fields).alias("field_name"))


def unified_table(exports: DataFrame, fields: dict[str, list[str]] = FIELDS) -> DataFrame:
    """One row per file and line, each field as text next to its typed branches.

    Columns: file_id, line_no and for each field F: F (canonical text: strings as they are,
    lists of strings joined with ' > ', anything else as JSON), F_tag, the branches F_boolean,
    F_number, F_strings, F_objects and F_json (object or mixed list), null unless the value is
    of that type, and F_more. Lines with none of the fields are left out. Where a line gives a
    field more than once, the value with the least path comes first and F_more lists the
    others as (path, text, tag). Repeated rows count once.
    """
    strings = F.expr("try_variant_get(value, '$', 'array<string>')")
    objects = F.transform(F.expr("try_variant_get(value, '$', 'array<variant>')"), lambda v: F.to_json(v))
    tag, json = F.col("tag"), F.to_json("value")
    text = (
        F.when(tag == "list of strings", F.array_join(strings, " > "))
        .when(tag == "list of objects", F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")))
        .when(tag == "string", F.expr("try_variant_get(value, '$', 'string')"))
        .otherwise(json)
    )
    branches = {
        "boolean": F.when(tag == "boolean", F.expr("try_variant_get(value, '$', 'boolean')")),
        "number": F.when(tag == "number", F.expr("try_variant_get(value, '$', 'double')")),
        "strings": F.when(tag == "list of strings", strings),
        "objects": F.when(tag == "list of objects", objects),
        "json": F.when(tag.isin("object", "mixed list"), json),
    }
    row = F.struct("path", text.alias("text"), "tag", *[c.alias(b) for b, c in branches.items()])
    typed = field_values(exports, fields).select("file_id", "line_no", "field_name", row.alias("v"))
    wide = typed.groupBy("file_id", "line_no").agg(*[F.array_sort(F.collect_set(F.when(F.col("field_name") == f, F.col("v")))).alias(f"_{f}") for f in fields])
    cols = []
    for f in fields:
        first = F.get(f"_{f}", F.lit(0))
        cols += [first["text"].alias(f), first["tag"].alias(f"{f}_tag"), *[first[b].alias(f"{f}_{b}") for b in branches]]
        more = F.transform(F.slice(f"_{f}", 2, F.greatest(F.size(f"_{f}"), F.lit(1))), lambda v: F.struct(v["path"], v["text"], v["tag"]))
        cols.append(more.alias(f"{f}_more"))
    return wide.select("file_id", "line_no", *cols)
