"""Top rows, survivors and matching against brute force and hand-made cases."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import compare, connect
from tests.test_queries import SF
from tracequarry.llm import matching, survivors, topn

ROWS = "run_id long, id long, priority_score double, g string, s string, i string, cell int"


def best(rows, n):
    by = {}
    for run, i, score, *_ in rows:
        if run is not None and i is not None and score is not None and not math.isnan(score):
            by.setdefault(run, {})[i] = max(score, by.get(run, {}).get(i, -math.inf))
    return {(run, i, s) for run, own in by.items() for i, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n]}


@pytest.mark.parametrize(("n", "cells"), [(1, 2), (3, 64), (10, 4)])
def test_top_n_against_a_sort(spark, n, cells):
    random.seed(n)
    rows = []
    for run in range(12):
        for _ in range([0, 1, n, n + 1, 40, 400][run % 6]):
            score = random.choice([random.random() * 10, float(round(random.random() * 3)), 5.0, -0.0, 1e-300, 10.0])
            rows.append((run, random.choice([1, -1]) * random.randrange(2**62), score, "g", "s", "i", 1))
    rows += [(20, k, 7.0, "g", "s", "i", 1) for k in range(300)]  # all equal: ids alone decide
    rows += [(None, 1, 5.0, "", "", "", 0), (3, None, 5.0, "", "", "", 0), (3, 5, None, "", "", "", 0), (3, 6, math.nan, "", "", "", 0)]
    rows += random.sample(rows, 100)
    got = topn.top_n_per_group(spark.createDataFrame(rows, ROWS), "run_id", "priority_score", "id", n, cells).collect()
    want = best(rows, n)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_top_findings_takes_scores_from_0_to_10_alone(spark):
    rows = [(1, 1, 10.5, "", "", "", 0), (1, 2, 10.0, "", "", "", 0), (1, 3, -1.0, "", "", "", 0), (2, 4, math.nan, "", "", "", 0), (1, 5, 0.0, "", "", "", 0)]
    got = topn.top_findings(spark.createDataFrame(rows, ROWS)).collect()
    assert {(r.run_id, r.id) for r in got} == {(1, 2), (1, 5)}
    assert topn.top_findings(spark.createDataFrame([], ROWS)).count() == 0


def test_ids_far_apart_and_next_to_each_other(spark):
    ids = [-(2**63), 2**63 - 1, 0, 1, 2**62, 2**62 + 1, 2**62 + 2]
    rows = [(1, i, 4.0, "", "", "", 0) for i in ids]
    for n in range(1, 7):
        got = topn.top_n_per_group(spark.createDataFrame(rows, ROWS), "run_id", "priority_score", "id", n, 3).collect()
        assert {r.id for r in got} == set(sorted(ids)[:n])


def passes(monkeypatch):
    """Counts the writes of `topn`: two before and after the passes each, one a pass."""
    calls = []
    real = topn.cut
    monkeypatch.setattr(topn, "cut", lambda df: calls.append(1) or real(df))
    return lambda: len(calls) - 3


def test_codes_keep_the_order_of_numbers(spark):
    numbers = [-math.inf, -1e308, -2.5, -1.0, -1e-300, -5e-324, 0.0, 5e-324, 2.2e-308, 1e-300, 0.1, 1.0, 1.0000000000000002, 2.5, 1e308, math.inf]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    rows = df.select("x", topn.ordered_bits(df.x).alias("c")).select("x", "c", topn.number_of(F.col("c")).alias("back")).orderBy("c").collect()
    assert [r.x for r in rows] == [r.back for r in rows] == numbers and len({r.c for r in rows}) == len(numbers)
    zero = spark.createDataFrame([(-0.0,), (0.0,)], "x double")
    assert zero.select(topn.ordered_bits(F.col("x"))).distinct().count() == 1


@pytest.mark.parametrize("scores", [[10.0 ** (-3 * k) for k in range(100)], [float(2**k) for k in range(0, 1000, 10)], [math.inf, -math.inf, 1e308, -1e308, 0.0] + [math.inf] * 40])
def test_passes_are_bounded_whatever_the_scores(spark, monkeypatch, scores):
    rows = [(run, k * (2**56 if run else 1), x, "", "", "", 0) for run in (0, 1) for k, x in enumerate(scores)]
    count = passes(monkeypatch)
    got = topn.top_n_per_group(spark.createDataFrame(rows, ROWS), "run_id", "priority_score", "id", 3).collect()
    assert {tuple(r) for r in got} == best(rows, 3)
    assert count() <= 22


def test_groups_beyond_the_broadcast_in_parts(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 5)
    monkeypatch.setattr(topn, "HOT_ROWS", 40)
    random.seed(8)
    rows = [(0 if random.random() < 0.4 else random.randrange(60), k, float(random.randrange(12)), "", "", "", 0) for k in range(1500)]
    got = topn.top_n_per_group(spark.createDataFrame(rows, ROWS), "run_id", "priority_score", "id", 4).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == best(rows, 4)


def test_many_groups_and_one_of_a_million_rows(spark):
    """More groups than are broadcast, and a group of a million rows among them."""
    small = spark.range(600_000).selectExpr("id div 3 as g", "id as i", "cast(id % 7 as double) as x")
    large = spark.range(1_000_000).selectExpr("-1L as g", "id + 1000000 as i", "cast(id % 1000 as double) as x")
    got = topn.top_n_per_group(small.unionAll(large), "g", "x", "i", 2).cache()
    assert got.count() == 400_002
    assert sorted(r.i for r in got.where("g = -1").collect()) == [1_000_999, 1_001_999]
    window = small.selectExpr("g", "i", "row_number() over (partition by g order by x desc, i) as k").where("k <= 2").select("g", "i")
    assert got.where("g >= 0").select("g", "i").exceptAll(window).count() == 0


F_SCHEMA = (
    "id long, run_id long, fingerprint string, confidence double, tools string, created_at timestamp_ntz, source_snippet string, model string, pattern int, p double, "
    "cwe string, attack_surface string, dataflow string, call_chain string, source string, field string"
)
RUNS = "id long, profile string, field string, value string"
FP = "00112233445566aa"


def finding(i, run=1, fp=FP, conf=0.5, tools="a", day=1, snippet=None, cwe="CWE-120", surface=None, flow=None, chain=None):
    return (i, run, fp, conf, tools, None if day is None else datetime.datetime(2024, 1, day), snippet, "m", 1, 0.5, cwe, surface, flow, chain, "s", "f")


def of_runs(spark, *rows):
    return spark.createDataFrame([(*r, "f", "v") for r in rows], RUNS)


def test_best_representatives(spark):
    rows = [
        finding(1, conf=0.8, tools="a,b", snippet="1 | x"),
        finding(2, conf=80.0, tools="A;b;c", day=None, snippet=">>> 1 | x\n  2 | y\nsee z"),
        finding(3, fp="sha256:" + FP.upper(), conf=None, tools=None, snippet="no line"),
        finding(4, conf=80.0, tools='["c", "B", "a"]', day=2, snippet="1 | x\n2 | y"),
        finding(5, run=2, conf=None, tools=""),
        finding(6, run=2, conf=None, tools=None, day=None),
        finding(7, run=3),
        finding(8, run=3, fp="0" * 16),
        finding(9, run=3, fp=None),
        finding(10, run=None),
        finding(11, run=4, day=3, snippet="1 | a"),
        finding(12, run=4, day=3, snippet="9 | b"),
    ]
    runs = of_runs(spark, (1, "deep"), (1, "deep"), (2, None), (9, "quick"), (None, "quick"))
    got = {(r.run_id, r.fingerprint): r for r in survivors.best_representatives(spark.createDataFrame(rows + rows, F_SCHEMA), runs).collect()}
    assert {k: (r.keep_id, r.snippet_id) for k, r in got.items()} == {(1, FP): (4, 4), (2, FP): (5, 0), (4, FP): (11, 11)}
    top = got[1, FP]
    assert (top.confidence, top.source_snippet) == (0.8, "1 | x\n2 | y")
    assert set(top.tools) <= {"a", "b", "c"} and top.tools
    assert (got[2, FP].confidence, got[2, FP].tools, got[2, FP].source_snippet) == (None, [], None)
    plain = survivors.best_representatives(spark.createDataFrame(rows + rows, F_SCHEMA)).collect()
    assert {tuple(r) for r in plain} == {tuple(r)[: len(plain[0])] for r in got.values()}


def test_survivors_of_an_empty_table(spark):
    assert survivors.best_representatives(spark.createDataFrame([], F_SCHEMA)).count() == 0
    empty = spark.createDataFrame([], F_SCHEMA)
    assert survivors.source_quality(empty, of_runs(spark)).count() == 0
    assert survivors.best_representatives(empty, of_runs(spark)).count() == 0


def reference_em(facts, prior, rounds):
    """The same model without Spark, fact by fact."""
    sources = {s for f in facts for s, _ in f}
    quality, truth = {s: (0.7, 0.8) for s in sources}, 0.5
    for _ in range(rounds):
        ps = []
        for f in facts:
            odds = math.log(truth / (1 - truth))
            for s, o in f:
                x, y = quality[s]
                odds += math.log(x / (1 - y)) if o else math.log((1 - x) / y)
            ps.append(1 / (1 + math.exp(-odds)))
        new = {}
        for s in sources:
            mine = [(p, o) for p, f in zip(ps, facts, strict=True) for t, o in f if t == s]
            a, b = prior.sensitivity, prior.specificity
            new[s] = ((sum(p for p, o in mine if o) + a[0]) / (sum(p for p, _ in mine) + sum(a)), (sum(1 - p for p, o in mine if not o) + b[0]) / (sum(1 - p for p, _ in mine) + sum(b)))
        truth = (sum(ps) + prior.truth[0]) / (len(ps) + sum(prior.truth))
        quality = new
    return quality, truth


def test_quality_model_against_a_plain_one(spark):
    random.seed(2)
    facts = [[(s, random.random() < {"a": 0.9, "b": 0.5, "c": 0.2}[s]) for s in "abc" if random.random() < 0.8] for _ in range(200)]
    facts = [f for f in facts if f]
    df = spark.createDataFrame([(f,) for f in facts], "pattern array<struct<source: string, o: boolean>>")
    model = survivors.quality_model(df, rounds=6, tol=0.0)
    quality, truth = reference_em(facts, survivors.Prior(), 6)
    for m in model:
        assert (m["sensitivity"], m["specificity"]) == pytest.approx(quality[m["source"]])
        assert m["truth"] == pytest.approx(truth)


def test_judged_values_recover_planted_truth(spark):
    """Two good sources and a bad one: values that only the bad one gives are dropped, the others kept."""
    random.seed(4)
    facts, true = [], []
    for _ in range(600):
        t = random.random() < 0.5
        facts.append([("good1", random.random() < (0.9 if t else 0.05)), ("good2", random.random() < (0.85 if t else 0.05)), ("bad", random.random() < 0.5)])
        true.append(t)
    df = spark.createDataFrame([(f,) for f in facts], "pattern array<struct<source: string, o: boolean>>")
    model = {m["source"]: m for m in survivors.quality_model(df, rounds=30, tol=1e-6)}
    assert model["good1"]["sensitivity"] > 0.8 and model["good1"]["specificity"] > 0.85
    assert abs(model["bad"]["sensitivity"] - (1 - model["bad"]["specificity"])) < 0.15
    right = 0
    for f, t in zip(facts, true, strict=True):
        odds = math.log(model["bad"]["truth"] / (1 - model["bad"]["truth"]))
        for s, o in f:
            x, y = model[s]["sensitivity"], model[s]["specificity"]
            odds += math.log(x / (1 - y)) if o else math.log((1 - x) / y)
        right += (odds > 0) == t
    assert right / len(facts) > 0.93


def test_survivors_keep_planted_truth(spark):
    """Rows with a flow name the true values, those without also false ones: what stays is nearly all true, and nearly all of it."""
    random.seed(5)
    rows, truth = [], {}
    tools, weaknesses = [f"tool{k}" for k in range(8)], [f"CWE-{k}" for k in range(100, 108)]
    for g in range(250):
        fp = f"{g + 1:016x}"
        true = set(random.sample(tools, 3))
        truth[fp] = (true, random.choice(weaknesses))
        for k in range(4):
            good = k < 3
            said = {t for t in true if random.random() < (0.9 if good else 0.3)} | {t for t in tools if t not in true and random.random() < (0.02 if good else 0.5)}
            cwe = truth[fp][1] if random.random() < (0.95 if good else 0.2) else random.choice(weaknesses)
            marks = {"flow": '[{"a": 1}]' if k != 1 else None, "chain": '[{"a": 1}]' if k in (1, 2) else None} if good else {}
            rows.append(finding(len(rows), 1, fp, tools=",".join(sorted(said)), cwe=cwe, **marks))
    got = survivors.best_representatives(spark.createDataFrame(rows, F_SCHEMA), of_runs(spark, (1, "deep"))).collect()
    assert len(got) == 250
    kept = [(t in truth[r.fingerprint][0]) for r in got for t in r.tools]
    found = sum(t in r.tools for r in got for t in truth[r.fingerprint][0])
    assert sum(kept) / len(kept) > 0.93 and found / 750 > 0.97
    right = [c == truth[r.fingerprint][1] for r in got for c in r.weaknesses]
    assert sum(right) / len(right) > 0.85 and sum(right) / 250 > 0.97
    quality = {m.source: m for m in survivors.source_quality(spark.createDataFrame(rows, F_SCHEMA), of_runs(spark, (1, "deep"))).collect()}
    assert quality["tools/deep+flow"].specificity > 0.9 > 0.7 > quality["tools/deep"].specificity


def test_values_judged_by_a_source_that_does_not_know_the_field(spark):
    """A row without snippet lines withholds none; lines of all rows build one text."""
    rows = [finding(1, snippet="  1 | a\n>>>  2 | b"), finding(2, snippet="2 | b\n3 | c", flow='[{"a": 1}]'), finding(3, tools=None, surface=" CLI ")]
    got = survivors.best_representatives(spark.createDataFrame(rows, F_SCHEMA), of_runs(spark), threshold=0.0).collect()
    assert [r.lines for r in got] == [["1 | a", "2 | b", "3 | c"]] and got[0].surfaces == ["cli"] and got[0].weaknesses == ["CWE-120"]


R_SCHEMA = "result_id long, tool string, check_id string, reported_path string, line_no int, col_no int, weakness string, msg string, level string, path string, family string"
P_SCHEMA = "id long, project_name string, root_path string, block int"
RUN_SCHEMA = "id long, project_id long, defect int"
D_SCHEMA = "id long, run_id long, fingerprint string, file_path string, line int, cwe string, tools string, nth int, chunk int"
CATALOG = [("CWE-120", "bounds"), ("CWE-787", "bounds"), ("CWE-416", "lifetime")]


def matched(spark, results, findings, exact=True):
    tables = (
        spark.createDataFrame([(*r, "x", "y") for r in results], R_SCHEMA),
        spark.createDataFrame([(k, *f, 1, 2) for k, f in enumerate(findings)], D_SCHEMA),
        spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 2, 0)], RUN_SCHEMA),
        spark.createDataFrame([(1, "Alpha", "/srv/alpha", 0), (2, "beta", "/srv/beta", 0)], P_SCHEMA),
        spark.createDataFrame(CATALOG, "cwe string, family string"),
    )
    return matching.match_results(*tables, exact=exact)


def result(i, path, line, weakness="CWE-120", msg="copy too long", tool="codeql"):
    return (i, tool, "c", path, line, 0, weakness, msg, "high")


def test_matches(spark):
    findings = [
        (1, "a" * 16, "src/core/alpha_map.c", 50, "CWE-787", "codeql"),
        (1, "A" * 16, "/srv/alpha/src/core/alpha_map.c", 50, "cwe_0787", "rule:x"),
        (1, "b" * 16, "src\\core\\alpha_map.c", 58, "CWE-120", None),
        (2, "c" * 16, "vendor/zlib/inflate.c", 10, "416", "semgrep"),
        (1, "d" * 16, None, 10, "416", "semgrep"),
        (None, "e" * 16, "src/core/alpha_map.c", 52, "CWE-120", ""),
        (1, "n/a", "src/core/alpha_map.c", 90, "CWE-120", ""),
    ]
    results = [
        result(1, "C:\\jobs\\7\\ALPHA-1.2\\src\\core\\ALPHA_MAP.C", 53),
        result(1, "C:\\jobs\\7\\ALPHA-1.2\\src\\core\\ALPHA_MAP.C", 53),
        result(2, "core/alpha_map.c", 56, "120: long text"),
        result(3, "alpha_map.c", 54),  # four lines off either
        result(4, "/home/x/gamma/src/core/alpha_map.c", 50),  # another project
        result(5, "tests/alpha_map.c", 50),  # another folder
        result(6, "src/core/alpha_map.c", 50, "CWE-416"),  # another family
        result(7, "file:///ci/beta-main/vendor/zlib/inflate.c", 9, None, "memory is read after release"),
        result(8, "../beta/./vendor/zlib/inflate.c", 12, "CWE-416", "memory is read after release"),
        result(9, None, 12),
        result(10, "vendor/zlib/inflate.c", None),
        result(11, "vendor/zlib/inflate.c", 10, "", None),
        result(12, "", 10),
    ]
    got = {(r.result_id, r.fingerprint) for r in matched(spark, results, findings).collect()}
    assert got == {(1, "a" * 16), (2, "b" * 16), (7, "c" * 16), (8, "c" * 16)}


def test_no_rows_no_matches(spark):
    assert matched(spark, [], []).count() == 0


def test_near_pairs_against_all_pairs(spark):
    random.seed(6)
    words = ["map", "maps", "pool", "cache", "stream", "parse"]
    names = [f"{random.choice(words)}_{random.choice(words)}{random.choice(['', '1', '12'])}.c" for _ in range(120)]
    findings = [(1, f"{k + 1:016x}", f"src/{n}", random.randrange(1, 120), random.choice(["CWE-120", "CWE-416"]), "codeql") for k, n in enumerate(names)]
    results = [result(k, f"src/{random.choice(names)}", random.randrange(1, 120), random.choice(["CWE-120", "CWE-416", "CWE-787"])) for k in range(150)]
    r = matching.reports(spark.createDataFrame([(*x, "x", "y") for x in results], R_SCHEMA), spark.createDataFrame(CATALOG, "cwe string, family string")).cache()
    d = matching.defects(
        spark.createDataFrame([(k, *f, 1, 2) for k, f in enumerate(findings)], D_SCHEMA), spark.createDataFrame([(1, 1, 0)], RUN_SCHEMA),
        spark.createDataFrame([(1, "a", "/srv/a", 0)], P_SCHEMA), spark.createDataFrame(CATALOG, "cwe string, family string"),
    ).cache()
    ones = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = set()
    for x in r.collect():
        for y in d.collect():
            for decoy in (False, True):
                away = abs(x.line + (matching.DECOY_SHIFT if decoy else 0) - y.line)
                if x.family == y.family and away <= matching.REACH and ones(x.b_name0, y.b_name0) + ones(x.b_name1, y.b_name1) <= matching.RADIUS:
                    want.add((x.result_id, decoy, y.defect))
    got = matching.near_pairs(r, d).collect()
    assert len(got) == len({(g.result_id, g.decoy, g.defect) for g in got})
    assert {(g.result_id, g.decoy, g.defect) for g in got} == want and len(want) > 30


def test_pooled_rates_never_fall():
    assert matching.pooled([(1, 4.0, 1.0), (2, 4.0, 3.0), (3, 4.0, 1.0), (5, 2.0, 2.0)]) == [(1, 0.25), (2, 0.5), (3, 0.5), (5, 1.0)]
    assert matching.pooled([]) == []


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.split("_")[0] in ("p1", "p2", "p5", "p6", "p7", "p8")])
def test_query(spark, con, name):
    good, said = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert good is not False, said
