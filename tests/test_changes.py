"""Snapshot differences and schema drift against brute force and hand-made cases."""

import datetime
import json
import random

from pyspark.sql import functions as F

from tracequarry.operators import drift, snapshots

RUNS = "id long, project_id long, commit_hash string, run_ts timestamp_ntz, status string, extra string"
FINDINGS = "id long, run_id long, fingerprint string, severity string, status string, h string"


def day(n):
    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_snapshot_runs(spark):
    full = "abcdef1234" + "0" * 30
    rows = [
        (1, 1, full, day(1), "completed", "x"),
        (2, 1, "ABCDEF1 ", day(2), " Completed", "x"),  # the same commit again: only the last stays
        (3, 1, None, day(3), "completed", "x"),
        (4, 1, None, day(4), "COMPLETED", "x"),  # no hash equals none
        (5, 1, "v1-2-gabcdef12", day(5), "completed", "x"),
        (6, 1, full, day(6), "failed", "x"),
        (7, 1, full, day(7), "completed", "x"),
        (7, 1, full, day(7), "completed", "x"),
        (8, 2, full, day(1), "completed", "x"),
        (9, 2, full, None, "completed", "x"),
        (10, None, full, day(1), "completed", "x"),
        (11, 2, "", None, None, "x"),
    ]
    got = {(r.run_id, r.project_id, r.snap, r.snaps, r.next_run_id) for r in snapshots.snapshot_runs(spark.createDataFrame(rows, RUNS)).collect()}
    assert got == {(2, 1, 1, 4, 3), (3, 1, 2, 4, 4), (4, 1, 3, 4, 7), (7, 1, 4, 4, None), (8, 2, 1, 1, None)}


def test_changes_against_sets(spark):
    random.seed(5)
    runs = [(r, r % 3, None, day(r // 3), "completed", "") for r in range(1, 25)]
    fps = [f"{k:016x}" for k in range(1, 9)]
    rows, state = [], {}
    for r in range(1, 25):
        for fp in fps:
            if r not in (9, 10) and random.random() < 0.6:
                sev, st = random.choice(["high", "low"]), random.choice(["new", "old"])
                state[r, fp] = (sev, st)
                rows.append((len(rows), r, random.choice([fp, fp.upper(), "sha256:" + fp, fp + "0" * 48]), random.choice([sev, sev.upper() + " "]), st, "h"))
    rows += [(len(rows), None, fps[0], "high", "new", "h"), (len(rows) + 1, 3, None, "high", "new", "h"), (len(rows) + 2, 99, fps[0], "x", "y", "h")]
    rows += random.sample(rows, 30)
    want = set()
    for p in range(3):
        own = sorted(r for r, q, *_ in runs if q == p)
        for a, b in zip(own, own[1:], strict=False):
            for fp in fps:
                x, y = state.get((a, fp)), state.get((b, fp))
                if x != y:
                    want.add((b, fp, "added" if x is None else "removed" if y is None else "changed"))
    got = snapshots.finding_changes(spark.createDataFrame(rows, FINDINGS), spark.createDataFrame(runs, RUNS)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_changes_of_empty_tables(spark):
    assert snapshots.finding_changes(spark.createDataFrame([], FINDINGS), spark.createDataFrame([], RUNS)).count() == 0


EXPORTS = "file_id long, feed string, exported_at timestamp_ntz, line_no int, payload string, path string"


def exports(spark, files):
    rows = []
    for file_id, feed, at, lines in files:
        for n, line in enumerate(lines, 1):
            rows.append((file_id, feed, day(at), n, line if line is None or isinstance(line, str) else json.dumps(line), "x"))
    return spark.createDataFrame(rows, EXPORTS)


def test_schema_changes(spark):
    df = exports(
        spark,
        [
            (5, "f", 1, [{"attack_surface": "net", "surface_count": 3, "vendor": None, "dataflow": []}, "{broken", None, "", "[1]", '"text"']),
            (2, "f", 2, [{"attackSurface": ["net"], "origin": {"vendored": True}}]),
            (9, "f", 3, ["# nothing"]),
            (7, "f", 4, [{"attackSurface": [{"kind": "net"}]}, {"flow": "a -> b"}]),
            (8, "f", 5, [{"attackSurface": [{"kind": "cli"}]}, {"flow": ["a", "b"]}, {"vendor_tool": "x"}]),
            (3, "g", 1, [{"attack_surface": "net"}]),
            (4, "g", None, [{"dataflow": "x"}]),
            (6, None, 1, [{"dataflow": "x"}]),
        ],
    )
    df = df.unionAll(df)
    got = {(r.file_id, r.field_name, r.change, r.before, r.after) for r in drift.schema_changes(df).collect()}
    assert got == {
        (2, "attack_surface", "renamed", "attack_surface", "attackSurface"),
        (2, "attack_surface", "retyped", "string", "list of strings"),
        (2, "vendor_source", "added", None, "origin.vendored"),
        (9, "attack_surface", "removed", "attackSurface", None),
        (9, "vendor_source", "removed", "origin.vendored", None),
        (7, "attack_surface", "added", None, "attackSurface"),
        (7, "dataflow", "added", None, "flow"),
        (8, "dataflow", "retyped", "string", "list of strings"),
    }


def test_unified_table(spark):
    df = exports(spark, [(1, "f", 1, [{"surface": "net", "third_party": False}, {"taint": {"attack_surface": [{"b": 1, "a": "x"}]}, "trace": {"steps": ["p", "q"]}}, {"line": 3}])])
    got = {r.line_no: r for r in drift.unified_table(df.unionAll(df)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].attack_surface, got[1].vendor_source, got[1].vendor_source_boolean, got[1].vendor_source_tag) == ("net", "false", False, "boolean")
    assert (got[2].attack_surface, got[2].attack_surface_tag) == ('[{"a":"x","b":1}]', "list of objects")
    assert (got[2].dataflow, got[2].dataflow_strings, got[2].dataflow_objects) == ("p > q", ["p", "q"], None)


def test_empty_exports_and_very_long_values(spark):
    assert drift.schema_changes(spark.createDataFrame([], EXPORTS)).count() == 0
    df = exports(spark, [(1, "f", 1, [{"dataflow": "x" * 300_000}]), (2, "f", 2, [{"dataflow": ["y"] * 20_000}])])
    assert [(r.field_name, r.change) for r in drift.schema_changes(df).collect()] == [("dataflow", "retyped")]
    assert drift.unified_table(df).agg(F.max(F.length("dataflow"))).first()[0] == 300_000


def nested(depth, inner):
    for k in range(depth):
        inner = {f"n{k}": inner}
    return inner


def test_fields_at_any_depth(spark):
    """Depths on both sides of every round of opening."""
    for depth in (3, 4, 5, 8, 13):
        df = exports(spark, [(1, "f", 1, [nested(depth, {"dataflow": "x"})]), (2, "f", 2, [nested(depth, {"dataflow": ["x"]})])])
        got = [(r.field_name, r.change, r.before, r.after) for r in drift.schema_changes(df).collect()]
        assert got == [("dataflow", "retyped", "string", "list of strings")], depth
        assert {r.dataflow for r in drift.unified_table(df).collect()} == {"x"}
        assert len(drift.unified_table(df).collect()) == 2


def test_every_type_is_a_value(spark):
    values = [5, "y", {"kind": "net"}, [1, "a"], [None], {}, True, None, [], ["a", None]]
    df = exports(spark, [(k, "f", k, [{"vendor": v}]) for k, v in enumerate(values)])
    got = [(r.file_id, r.change, r.before, r.after) for r in drift.schema_changes(df).orderBy("file_id").collect()]
    assert got == [
        (1, "retyped", "number", "string"),
        (2, "retyped", "string", "object"),
        (3, "retyped", "object", "mixed list"),
        (5, "retyped", "mixed list", "object"),
        (6, "retyped", "object", "boolean"),
        (7, "removed", "vendor", None),
        (9, "added", None, "vendor"),
    ]
    rows = {r.file_id: r for r in drift.unified_table(df).collect()}
    assert (rows[0].vendor_source, rows[0].vendor_source_number) == ("5", 5.0)
    assert rows[2].vendor_source_json == '{"kind":"net"}' and rows[3].vendor_source == '[1,"a"]'
    assert set(rows) == {0, 1, 2, 3, 4, 5, 6, 9}


def test_an_object_around_a_field_is_part_of_its_name(spark):
    df = exports(spark, [(1, "f", 1, [{"dataflow": {"steps": ["a"], "n": 1}}]), (2, "f", 2, [{"dataflow": {"n": 1, "said": '"steps": 1'}}])])
    got = {(r.change, r.before, r.after) for r in drift.schema_changes(df).collect()}
    assert got == {("renamed", "dataflow.steps", "dataflow"), ("retyped", "list of strings", "object")}


def test_types_that_change_places(spark):
    a, b = {"attack_surface": "x", "x": {"attack_surface": True}}, {"attack_surface": True, "x": {"attack_surface": "x"}}
    df = exports(spark, [(1, "f", 1, [a]), (2, "f", 2, [b])])
    got = [(r.change, r.before, r.after) for r in drift.schema_changes(df).collect()]
    assert got == [("retyped", "attack_surface string,x.attack_surface boolean", "attack_surface boolean,x.attack_surface string")]
    both = drift.unified_table(df).where("file_id = 1").first()
    assert both.attack_surface == "x" and [(m.path, m.text, m.tag) for m in both.attack_surface_more] == [("x.attack_surface", "true", "boolean")]


def test_new_alternatives_show_unknown_names(spark):
    df = exports(spark, [(1, "f", 1, [{"surface": "net", "n": 1}]), (2, "f", 2, [{"entry_area": "net", "n": "1"}, {"deep": {"flow": []}}]), (3, "g", 1, [{"z": 1}])])
    got = {(r.file_id, r.path, r.tag, r.field_name) for r in drift.new_alternatives(df.unionAll(df)).collect()}
    assert got == {(2, "entry_area", "string", None), (2, "n", "string", None), (2, "deep", "object", None)}
    assert drift.new_alternatives(spark.createDataFrame([], EXPORTS)).count() == 0
