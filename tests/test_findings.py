"""Cleaning, correlation, validation and summaries on small tables."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import clean
from tracequarry.operators import analytics, correlate, narrate, ordering, validate
from tracequarry.plans import report
from tracequarry.sources import code, scanners, store
from tracequarry.streaming import findings as stream


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("expression", "value", "expected"),
    [
        (clean.fingerprint, " 00AF3c9d12345678\t", "00af3c9d12345678"),
        (clean.fingerprint, "sha256:00af3c9d12345678", "00af3c9d12345678"),
        (clean.fingerprint, "00af3c9d12345678" + "ab" * 24, "00af3c9d12345678"),
        (clean.fingerprint, "0" * 16, None),
        (clean.fingerprint, "n/a", None),
        (clean.fingerprint, None, None),
        (clean.commit, " ABCDEF1 ", "abcdef1"),
        (clean.commit, "v1.2-30-g12345678", "12345678"),
        (clean.commit, "", None),
        (clean.cwe, "cwe_0120", "CWE-120"),
        (clean.cwe, "CWE-22: path", "CWE-22"),
        (clean.cwe, "unknown", None),
        (clean.tool_list, '["B", "a"]', ["a", "b"]),
        (clean.tool_list, "b; a,b,", ["a", "b"]),
        (clean.tool_list, None, []),
        (clean.posix_path, ".\\src\\..\\lib//x/./a.c", "lib/x/a.c"),
        (clean.posix_path, " ", None),
        (clean.posix_path, "a/b/c/d/e/../../../../../x", "x"),
        (clean.posix_path, "../../x/../y/.git/../z.c", "../../y/z.c"),
        (clean.posix_path, "/../a/./..b/c..d/x", "/../a/..b/c..d/x"),
        (clean.word, "  High\t", "high"),
        (clean.source_lines, ">>>  3 | a\n    4 | b\nx\n12 | c\r\n-- | --", 3),
        (clean.source_lines, None, 0),
    ],
)
def test_clean(spark, expression, value, expected):
    assert one(spark, expression, value) == expected


@pytest.mark.parametrize(("value", "expected"), [(0.5, 0.5), (80.0, 0.8), (1.0, 1.0), (-1.0, None), (101.0, None), (float("nan"), None), (None, None)])
def test_share(spark, value, expected):
    assert one(spark, clean.share, value, "double") == expected


FINDING = (
    "id long, run_id long, finding_id string, title string, category string, cwe string, severity string, confidence double, file_path string, line int, function_name string, "
    "tools string, reachability string, controllability string, status string, notes string"
)


def staged(spark, *rows):
    base = dict(run_id=1, finding_id="F-1", title="T", category="c", cwe="CWE-120", severity="high", confidence=0.5, file_path="a.c", line=3, function_name="f", tools="x", reachability=None, controllability=None, status="new", notes=None)
    return correlate.stage(spark.createDataFrame([tuple(({"id": k} | base | r).values()) for k, r in enumerate(rows, 1)], FINDING))


def test_fingerprint(spark):
    got = staged(spark, {"title": " Big Copy "}, {"file_path": None, "line": None}).select(
        "id", correlate.fingerprint(*[F.col(c) for c in ("file", "line", "function", "cwe", "title")]).alias("fp")
    )
    got = {r.id: r.fp for r in got.collect()}
    assert got == {1: hashlib.sha256(b"a.c|3|f|CWE-120|big copy").hexdigest()[:16], 2: hashlib.sha256(b"|0|f|CWE-120|t").hexdigest()[:16]}


def test_dedupe_and_merge(spark):
    rows = staged(spark, {"tools": "b"}, {"tools": "a", "confidence": 0.9}, {"tools": "c"}, {"title": "Other", "confidence": 0.6}, {"run_id": 2})
    once = correlate.deduplicate(rows)
    got = {(r.run_id, r.id): (float(r.confidence), r.tools, r.copies) for r in once.collect()}
    assert got == {(1, 1): (0.8, ["a", "b", "c"], 3), (1, 4): (0.6, ["x"], 1), (2, 5): (0.5, ["x"], 1)}
    merged = {(r.run_id, r.id): (float(r.confidence), r.tools, r.merged) for r in correlate.merge(once).collect()}
    assert merged == {(1, 1): (0.9, ["a", "b", "c", "x"], 2), (2, 5): (0.5, ["x"], 1)}


def test_scores(spark):
    c = lambda *v: spark.range(1).select(correlate.adjusted(*[F.lit(x) for x in v]).alias("x")).first().x
    assert float(c(0.95, 3, 0, 0, "unknown")) == 1.0
    assert float(c(0.5, 2, 1, 4, "high")) == 0.7
    assert float(c(0.1, 1, 5, 0, "low")) == 0.0
    p = lambda *v: spark.range(1).select(correlate.priority(*[F.lit(x) for x in v]).alias("x")).first().x
    assert p("critical", 1.0, "high", "high", 3) == 10.0
    assert p("low", 0.5, "unknown", "unknown", 1) == 1.8
    assert p("medium", 0.4, "medium", "medium", 0) == 3.6


@pytest.mark.parametrize("most", [0, 100, 500_000])
def test_rank_within_matches_a_plain_sort(spark, monkeypatch, most):
    monkeypatch.setattr(ordering, "WINDOW_ROWS", most)
    rows = [(k % 3 if k % 7 else None, k, (k * 37) % 10) for k in range(500)]
    got = {r.id: r.rank for r in ordering.rank_within(spark.createDataFrame(rows, "g int, id int, s int").repartition(5), "g", [F.desc("s"), F.asc("id")]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r[1]: k for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), 1)}
    assert got == want


CONTEXT = "id long, cwe string, title string, snippet string, lines array<string>, at int, line int, flow array<string>, controllability string"


@pytest.mark.parametrize(
    ("cwe", "lines", "at", "snippet", "flow", "level", "title", "expected"),
    [
        ("CWE-401", ["p = malloc(3);", "free(p);"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-401", ["p = malloc(3);"], 1, "", [], "low", "", "confirmed"),
        ("CWE-401", ["x();"], 1, "", [], "low", "", "suspicious"),
        ("CWE-476", ["if (!p) return;", "p->x = 1;"], 2, "p->x = 1;", [], "low", "", "likely_fp"),
        ("CWE-476", ["p->x = 1;"], 1, "p->x = 1;", [], "low", "", "confirmed"),
        ("CWE-787", ["b[i] = 1;"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-787", ["b[i] = 1;"], 1, "", ["(network)"], "high", "", "confirmed"),
        ("CWE-787", ["while (i < 8)", "b[i] = 1;"], 2, "", ["(network)"], "low", "", "likely_fp"),
        ("CWE-121", ["strcpy(a, b);"], 1, "", ["x (socket)"], "high", "", "confirmed"),
        ("CWE-121", ["strcpy(a, b);"], 1, "", ["x (cli)"], "high", "", "likely_fp"),
        ("CWE-121", ["memcpy(a, b, n);"], 1, "", [], "low", "", "suspicious"),
        ("CWE-78", ["x"], 1, "execv(a, b)", [], "low", "", "likely_fp"),
        ("CWE-78", ["x"], 1, 'sprintf(c, "%s", u); system(c)', [], "low", "", "confirmed"),
        ("CWE-195", ["p = malloc(n * 4);"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-195", ["p = malloc(n * m);"], 1, "", ["(ipc)"], "high", "", "confirmed"),
        ("CWE-416", ["free(p);", "p->x();"], 2, "", [], "low", "pointer 'p' freed at line 1 then", "confirmed"),
        ("CWE-416", ["free(p);", "p = NULL;", "p->x();"], 3, "", [], "low", "pointer 'p' freed at line 1 then", "likely_fp"),
        ("CWE-416", ["x"], 1, "", [], "low", "no pointer", "suspicious"),
        ("CWE-798", ["password = 1"], 1, "", [], "low", "", "confirmed"),
        ("CWE-191", ["if (a > SIZE_MAX)", "b = a * c;"], 2, "b = a * c;", [], "low", "", "likely_fp"),
        ("CWE-191", ["b = a * c;"], 1, "b = a * c;", [], "low", "", "confirmed"),
        ("CWE-134", ["printf(FMT_X);"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-134", ["printf(msg);"], 1, "", ["(network)"], "low", "", "confirmed"),
        ("CWE-252", ["read(fd);", "if (x == 1)"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-252", ["setuid(0);"], 1, "", [], "low", "", "confirmed"),
        ("CWE-338", ["x = rand();"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-338", ["token = rand();"], 1, "", [], "low", "", "suspicious"),
        ("CWE-674", ["if (n == 0) return 1;"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-20", ["snprintf(a, sizeof(a), b);"], 1, "", [], "low", "", "likely_fp"),
        ("CWE-20", ["strcpy(a, b);"], 1, "", [], "low", "", "suspicious"),
        ("CWE-415", ["free(p);"], 1, "", [], "low", "", "suspicious"),
    ],
)
def test_verdict(spark, cwe, lines, at, snippet, flow, level, title, expected):
    df = spark.createDataFrame([(1, cwe, title, snippet, lines, at, at, flow, level)], CONTEXT)
    assert validate.verdicts(df).first().verdict == expected


def test_strict_verdict_and_application(spark):
    df = spark.createDataFrame([(1, "CWE-20", "", None, ["strcpy(a, b);"], 1, 1, None, None)], CONTEXT)
    judged = validate.verdicts(df, strict=True)
    applied = validate.apply_verdicts(judged.withColumns({"status": F.lit("new"), "notes": F.lit("seen")})).first()
    assert (applied.status, applied.doubts, applied.notes) == ("likely_false_positive", ["input-validation"], "seen | structural validation: input-validation")


def test_parsers(spark):
    def parsed(parser, *payloads):
        return [tuple(r)[1:] for r in parser(spark.createDataFrame(list(enumerate(payloads)), "k int, payload string")).collect()]

    assert parsed(scanners.parse_semgrep, '{"results": [{"check_id": "a", "path": "p.c", "start": {"line": 3}, "extra": {"message": "m", "severity": "error", "metadata": {"cwe": ["CWE-1"]}}}]}', "no json", None, '{"results": []}') == [
        ("a: m", "semgrep", "CWE-1", "high", 0.7, "p.c", 3, "", "semgrep")
    ]
    assert parsed(scanners.parse_clang, '[{"diagnostics": {"description": "d", "location": {"file": "a.c", "line": 1}}}]', '{"description": "e", "location": {"file": "b.c", "line": 2}, "path": [{"kind": "call", "location": {"file": "c.c", "line": 9}}]}') == [
        ("d", "clang-analyzer", "CWE-0", "medium", 0.75, "a.c", 1, "", "clang-analyzer"),
        ("e", "clang-analyzer", "CWE-0", "medium", 0.75, "c.c", 9, "", "clang-analyzer"),
    ]
    assert parsed(scanners.parse_clang_tidy, "x.c:4:2: warning: use nullptr [modernize-use-nullptr]\nx.c:5:1: note: no")[0][:6] == ("use nullptr", "clang-tidy", "CWE-476", "medium", 0.7, "x.c")
    assert parsed(scanners.parse_cppcheck, '<results><errors><error id="memleak" severity="error" msg="m &lt;x&gt;"><location file="f.c" line="7"/><location file="g.c" line="8"/></error></errors></results>') == [
        ("memleak: m <x>", "cppcheck", "CWE-401", "high", 0.6, "f.c", 7, "", "cppcheck")
    ]
    log = "ERROR: AddressSanitizer: heap-use-after-free\n    #0 0x1f in go src/a.c:12\n"
    assert parsed(scanners.parse_sanitizer, log, "fine") == [("Use-after-free detected at runtime (via address sanitizer)", "memory-safety", "CWE-416", "high", 0.95, "src/a.c", 12, "go", "sanitizer-address")]


def test_summaries_reports_and_store(spark, tmp_path):
    rows = correlate.merge(correlate.deduplicate(staged(spark, {"title": "<b>"}, {"severity": "LOW ", "line": 9}, {"run_id": 2, "status": "likely_false_positive", "cwe": None}, {"tools": None, "line": 11})))
    evidence = spark.createDataFrame([(1, 1, "t", "s", None), (2, 1, "t", "s", "again"), (3, None, "t", "s", "")], "id long, finding_id long, evidence_type string, evidence_source string, detail string")
    scored = correlate.score(rows, evidence)
    assert {r.id: r.n_evidence for r in scored.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    dist = {r.run_id: (r.high, r.low, r.total) for r in analytics.severity_distribution(rows, "run_id").collect()}
    assert dist == {1: (2, 1, 3), 2: (1, 0, 1)}
    total = next(r for r in analytics.validation_summary(rows).collect() if r.cwe is None)
    assert (total.findings, total.demoted, total.rate) == (4, 1, 0.25)
    ranked = ordering.rank_within(scored, "run_id", [F.desc("priority"), F.asc("id")]).withColumn("finding_no", F.format_string("F-%05d", "rank"))
    texts = {(r.run_id, r.format): r.text for r in report.reports(ranked).collect()}
    assert len(texts) == 6 and "&lt;b&gt;" in texts[1, "html"] and "<b>" in texts[1, "markdown"] and '"total":3' in texts[1, "json"]
    assert narrate.run_summaries(rows, "run_id").where("run_id = 2").first().summary == "1 candidate findings (critical=0, high=1, medium=0, low=0); 1 need review first."
    answers = spark.createDataFrame([('```json\n[{"id": "F-00001", "verdict": "likely_fp", "confidence_override": 0.1}]\n```',), ("none",)], "answer string")
    judged = narrate.apply_outside(ranked.where("run_id = 1"), narrate.parse_verdicts(answers))
    assert {(r.finding_no, r.status) for r in judged.collect()} >= {("F-00001", "likely_false_positive"), ("F-00002", "new")}
    path = str(tmp_path / "store")
    store.write_run(ranked.withColumn("project_id", F.col("run_id")), path)
    store.write_run(ranked.where("run_id = 2").withColumn("project_id", F.col("run_id")).withColumn("extra", F.lit(1)), path)
    kept = store.read_findings(spark, path)
    assert kept.count() == 4 and kept.where("extra = 1").count() == 1
    assert store.read_findings(spark, path, latest_only=True).count() == 4
    assert store.union_versions(rows.select("id"), rows.select("id", "cwe")).count() == 8


def test_evidence_has_markers_for_flows_and_chains(spark):
    rows = [(1, '["x", "rule:y"]', '[{"variable": "v", "location": "a.c:1", "description": "d"}]', None), (2, "x", "[]", '[{"function": "main", "file": "", "line": 0}]'), (3, None, None, "")]
    cells = [c.split()[0] for c in FINDING.split(", ")]
    given = spark.createDataFrame(rows, "id long, tools string, dataflow string, call_chain string")
    kinds = dict(c.split() for c in FINDING.split(", "))
    full = given.withColumns({c: F.lit(None).cast(kinds[c]) for c in cells if c not in given.columns})
    got = {(r.id, r.evidence_type, r.evidence_source) for r in correlate.evidence_of(correlate.stage(full)).collect()}
    assert got == {(1, "static_analyzer", "x"), (1, "custom_rule", "rule:y"), (1, "dataflow", ""), (2, "static_analyzer", "x"), (2, "call_graph", "")}


def test_reports_list_all_findings_in_parts(spark):
    rows = correlate.merge(correlate.deduplicate(staged(spark, *[{"line": k, "title": f"t{k}"} for k in range(60)], {"run_id": 2})))
    evidence = spark.createDataFrame([], "id long, finding_id long, evidence_type string, evidence_source string, detail string")
    ranked = ordering.rank_within(correlate.score(rows, evidence), "run_id", [F.desc("priority"), F.asc("id")]).withColumn("finding_no", F.format_string("F-%05d", "rank"))
    parts = report.reports(ranked, listed=25).orderBy("part").collect()
    assert [(r.part, r.format) for r in parts if r.run_id == 1 and r.format == "json"] == [(0, "json"), (1, "json"), (2, "json")]
    text = lambda run, kind: "".join(r.text for r in parts if (r.run_id, r.format) == (run, kind))
    whole = json.loads(text(1, "json"))
    assert (whole["total"], [f["finding_no"] for f in whole["findings"]]) == (60, [f"F-{k:05d}" for k in range(1, 61)])
    assert text(1, "markdown").count("\n## ") == 60 and text(1, "html").count("<tr>") == 60 and text(1, "html").endswith("</html>")
    assert json.loads(text(2, "json"))["total"] == 1 and "".join(r.text for r in report.reports(ranked).where("run_id = 1 and format = 'markdown'").collect()) == text(1, "markdown")


def test_reports_tell_what_is_known_and_a_failing_format_keeps_no_other(spark, tmp_path):
    rows = correlate.merge(correlate.deduplicate(staged(spark, {"line": 3, "title": "<t>"}, {"line": 9, "title": "u"})))
    schema = "id long, finding_id long, evidence_type string, evidence_source string, detail string"
    evidence = spark.createDataFrame([(1, r.id, "tool", "semgrep", "") for r in rows.collect()] * 2, schema)
    texts = spark.createDataFrame([(rows.orderBy("line").first().id, ">>> 3 | a < b", "[flow]", None)], "id long, snippet string, flow string, chain string")
    ranked = ordering.rank_within(correlate.score(rows, evidence), "run_id", [F.asc("line")]).withColumn("finding_no", F.format_string("F-%05d", "rank"))
    said = {r.format: r.text for r in report.reports(ranked, evidence=evidence, texts=texts).collect()}
    whole = json.loads(said["json"])
    first, second = whole["findings"]
    assert (first["evidence"], first["snippet"], first["flow"], first["chain"]) == (["tool:semgrep"], ">>> 3 | a < b", "[flow]", "")
    assert second["snippet"] == "" and whole["cwes"][0]["findings"] == 2 and (whole["demoted"], whole["confirmed"]) == (0, 0)
    assert "- evidence: tool:semgrep" in said["markdown"] and "a < b" in said["markdown"] and "a &lt; b" in said["html"] and "&lt;t&gt;" in said["html"]
    failed = report.write_reports(ranked, str(tmp_path), ("json", "nothing", "html"))
    assert list(failed) == ["nothing"] and spark.read.parquet(str(tmp_path / "html")).count() == 1


def test_merged_findings_unite_the_evidence_of_their_copies(spark):
    base = dict(run_id=1, finding_id="F-1", title="T", category="c", cwe="CWE-120", severity="high", confidence=0.5, file_path="a.c", line=3, function_name="f", tools="x", reachability=None, controllability=None, status="new", notes=None)
    rows = [base, base, base | {"title": "Other", "confidence": 0.9}, base | {"line": 9}, base | {"run_id": 2}, base | {"run_id": None}]
    findings = spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows, 1)], FINDING)
    given = [(1, "t", "s"), (1, "t", "s"), (2, "t", "s"), (2, "t", "u"), (3, "w", None), (5, "t", "s"), (6, "t", "z"), (99, "t", "q"), (None, "t", "q")]
    evidence = spark.createDataFrame([(k, *e, None) for k, e in enumerate(given)], "id long, finding_id long, evidence_type string, evidence_source string, detail string")
    got = {r.id: (r.n_evidence, r.merged) for r in correlate.ranked(findings, evidence).collect()}
    assert got == {3: (3, 2), 4: (0, 1), 5: (1, 1)}


def test_file_tree_and_profile(spark, tmp_path):
    for name, text in {"src/a b.c": "int x;\n", "src/B.CPP": "y", ".git/c.c": "z", "d.txt": "t"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = code.read_tree(spark, str(tmp_path))
    assert {(r.file, r.text) for r in files.collect()} == {("src/a b.c", "int x;\n"), ("src/B.CPP", "y")}
    assert code.read_tree(spark, str(tmp_path), limit=1).count() == 1
    assert [(r.line, r.text) for r in code.lines(files.where("text like 'int%'")).collect()] == [(1, "int x;"), (2, "")]
    paths = spark.createDataFrame([(1, "src/a.c"), (1, "src/a.c"), (1, "deps/z.cpp"), (1, "CMakeLists.txt"), (1, "Makefile"), (1, "tests/t.h"), (2, None)], "g int, p string")
    row = code.project_profile(paths, "g", "p").first()
    assert (row.files, row.c_files, row.cpp_files, row.header_files, row.vendored_files, row.has_tests, row.build_system, row.language) == (5, 1, 1, 1, 1, True, "cmake", "C")


def test_stream_counts_each_finding_once(spark, tmp_path):
    t = datetime.datetime
    rows = [(1, t(2024, 1, 1, 5), "High "), (1, t(2024, 1, 1, 5), "High "), (2, t(2024, 1, 1, 9), "high"), (3, t(2024, 1, 2), None), (4, None, "low")]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, severity string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    want = {(r.start, r.severity, r.findings) for r in stream.severity_counts(df).collect()}
    assert want == {(t(2024, 1, 1), "high", 2), (t(2024, 1, 2), None, 1)}
    stream.run_available(stream.severity_counts(stream.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.start, r.severity, r.findings) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_stream_of_many_files_out_of_time_order(spark, tmp_path):
    t = datetime.datetime
    batches = [[(1, t(2025, 2, 1), "high"), (2, t(2025, 2, 2), "low")], [(3, t(2023, 1, 5), "high"), (2, t(2025, 2, 2), "low")], [(4, t(2024, 6, 1), "low"), (1, t(2025, 2, 1), "high")]]
    for rows in batches:
        spark.createDataFrame(rows, "id long, created_at timestamp_ntz, severity string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(t(2025, 2, 1), "high", 1), (t(2025, 2, 2), "low", 1), (t(2023, 1, 5), "high", 1), (t(2024, 6, 1), "low", 1)}
    counts = stream.severity_counts(stream.read_stream(spark, str(tmp_path / "in"), 1))
    stream.run_available(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.start, r.severity, r.findings) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_checkpoints_on_a_cluster_need_a_shared_folder():
    from types import SimpleNamespace as Fake

    from tracequarry import session

    unset = Fake(isEmpty=lambda: True)
    context = Fake(master="spark://host:7077", _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Fake(sparkContext=context, conf=Fake(get=lambda *_: None)))


def test_a_hot_key_meets_a_table_too_large_to_broadcast(spark, monkeypatch):
    from tracequarry import session

    monkeypatch.setattr(session, "broadcast_if_small", lambda df, most: df)
    rows = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(200)], "run int, k int")
    other = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "run int, said string")
    got = session.join_on_hot_key(rows, other, "run", "k").collect()
    assert len(got) == len({r.k for r in got}) == sum(1 for k in range(200) if k % 2 == 0 or k % 3 < 2)


def test_second_pass_from_outside(spark):
    rows = spark.createDataFrame([("F-1", "new", ["a"], ""), ("F-2", "new", [], "n"), ("F-3", "new", [], ""), ("F-4", "new", [], "")], "finding_no string, status string, doubts array<string>, notes string")
    answers = spark.createDataFrame(
        [('```json\n[{"id": "F-1", "verdict": "confirmed_fp", "reason": "guarded"}, {"id": "F-2", "verdict": "challenged", "reason": "bounded"}]\n```',), ('{"id": "F-3", "verdict": "maybe"}',), ("no",), (None,)],
        "answer string",
    )
    got = {r.finding_no: (r.status, r.doubts, r.notes) for r in narrate.apply_challenges(rows, narrate.parse_challenges(answers)).collect()}
    assert got == {
        "F-1": ("likely_false_positive", ["a", "disproven from outside: guarded"], "disproven from outside: guarded"),
        "F-2": ("new", ["challenged from outside: bounded"], "n | challenged from outside: bounded"),
        "F-3": ("new", [], ""),
        "F-4": ("new", [], ""),
    }


def test_bounds_in_either_notation(spark):
    df = spark.createDataFrame([("64",), ("0x40",), ("",), ("0xffffffffffffffffff",), ("99999999999999999999",)], "t string")
    assert [r[0] for r in df.select(validate.whole_number(F.col("t"))).collect()] == [64, 64, None, None, None]
