"""Rules on snippets of our own, with expectations worked out by hand."""

import pytest

from tracequarry.operators import rules, structure, taint
from tracequarry.plans import pipeline


def hits(spark, rule, text):
    files = spark.createDataFrame([("a.c", text)], "file string, text string")
    return sorted((r.line, r.severity, r.confidence) for r in rules.rule_findings(files, [rule]).collect())


CASES = [
    ("crypto-misuse", "x = md5(a);\n// md5\n/* md5 */\nsrand(time(NULL));\nn = rand();\nEVP_des();", [(1, "low", 0.45), (4, "medium", 0.5), (5, "low", 0.35), (6, "medium", 0.5)]),
    ("crypto-misuse", 'char api_key[] = "abcdef";\nchar iv[4] = {0x1, 0x2, 0x3, 0x4};', [(1, "high", 0.6), (2, "high", 0.6)]),
    ("command-injection", 'system("ls");\nsystem(cmd);\nsystem("ls", argv);\npopen (x, "r");', [(2, "high", 0.45), (3, "medium", 0.4), (4, "high", 0.45)]),
    ("format-string", 'printf("%d", a);\nprintf(a);\nprintf("hi\\n");\nprintf("", a);', [(2, "high", 0.5), (3, "high", 0.5)]),
    ("path-hijacking", 'execvp(a, b);\nexecl("/bin/ls", x);\nsetenv("PATH", p, 1);\nPATH = "/bin";', [(1, "medium", 0.4), (3, "medium", 0.45)]),
    ("path-traversal", 'fopen("a.txt", "r");\nfopen(path, "r");\nopen(x + "../");\nopen(q, 0);', [(2, "high", 0.4)]),
    ("unchecked-length", "if (n < 4)\n\n\n\n\n\n\nmemcpy(a, b, n);\nmemcpy(a, b, n);", [(9, "medium", 0.4)]),
    ("unsafe-deserialization", "dlopen(x);\neval (y);", [(1, "high", 0.5), (2, "high", 0.5)]),
    ("untrusted-input", "v = getenv(x);\nputs(v);\nstrcpy(d, v);\nw = read(fd);\nq();", [(1, "medium", 0.5)]),
    ("null-deref", "p = malloc(4);\nif (!p) return;\nq = strdup(s);\n\n\n\n\n\nif (q == NULL) x;", [(3, "medium", 0.4)]),
    ("null-deref", "p = malloc(4);\n\n\n\n\nif (p != NULL) x;", []),
    ("race-condition", "static void on_sig(int s)\n{\n  printf(x);\n  done = 1;\n  free(y);\n}\nsignal(SIGINT, on_sig);", [(3, "medium", 0.5), (5, "medium", 0.5)]),
    ("resource-lifecycle", "f = fopen(p);\nfclose(f);\nd = open(p);\ns = socket(a);\nclose(s);", [(3, "low", 0.35)]),
    ("stack-recursion", "int f(int n) {\n  return f(n - 1);\n}\nint g(int n) {\n  if (n > 0) return g(n - 1);\n}\nint h() {\n  return 1;\n}", [(1, "medium", 0.55)]),
    ("toctou", "if (access(name, R_OK) == 0)\n  fd = open(name);\nstat(a + b);\nopen(a);", [(1, "medium", 0.5)]),
    ("unchecked-return", "read(fd, b, n);\nx = read(fd);\nif (read(fd)) y;\nwhile (read(fd));\nsetuid(0);", [(1, "low", 0.35), (5, "low", 0.35)]),
    ("buffer-overflow", "strcpy(a, b);\nif (n < sizeof(a))\nmemcpy(a, b, n);\n// strcpy(a, b);", [(1, "high", 0.6), (3, "low", 0.3)]),
    ("double-free", "free(p);\nx();\nfree(p);\nfree(q);\nq = 0;\nfree(q);", [(3, "medium", 0.45)]),
    ("integer-overflow", "p = malloc(n * 4);\ns = a * b;\nt = a * 3;\nif (a > SIZE_MAX)\nu = a * c;", [(1, "medium", 0.45), (2, "low", 0.3)]),
    ("memory-leak", "p = malloc(4);\nfree(p);\nq = strdup(s);\nf = fopen(x);\nfclose(f);", [(3, "low", 0.35), (4, "low", 0.35)]),
    ("sign-conversion", "int n = (size_t) m;\nssize_t read(int fd, x)\nint k;", [(1, "medium", 0.45), (2, "low", 0.4)]),
    ("use-after-free", "free(p);\nif (!p) return;\np->x = 1;\nfree(q);\nq = NULL;\nq->y = 2;", [(3, "medium", 0.5)]),
    ("use-after-free", "void f() {\n  free(p);\n}\nuse(p);", []),
]


@pytest.mark.parametrize(("rule", "text", "expected"), CASES)
def test_rule(spark, rule, text, expected):
    assert hits(spark, rule, text) == expected


def test_all_rules_at_once_and_edge_texts(spark):
    files = spark.createDataFrame(
        [("a.c", ""), ("b.c", None), ("c.c", "strcpy(a, b);"), ("d.c", "x" * 200_000), ("e.c", '"' + '\\"' * 30_000 + '"\nfree(p); "' + "\\\\" * 20_000)], "file string, text string"
    )
    found = rules.rule_findings(files).collect()
    assert {(r.file, r.rule) for r in found} == {("c.c", "buffer-overflow")}
    assert found[0].title == "Unsafe call to 'strcpy': potential buffer overflow"
    assert found[0].tools == ["rule:buffer-overflow"]


def test_own_rule(spark):
    from pyspark.sql import functions as F

    rules.register("todo", "CWE-546", "style", lambda lines: F.array_compact(F.transform(lines, lambda t, i: F.when(t.contains("TODO"), rules.hit(i + 1, "Left to do", "low", 0.1)))))
    try:
        assert hits(spark, "todo", "a\nTODO b") == [(2, "low", 0.1)]
    finally:
        del rules.REGISTRY["todo"]


SOURCE = """int helper(int a)
{
  return a;
}

static char *parse_header(char *line, int n) {
  char *copy;
  copy = line;
  if (n > 3) {
    helper(n);
  }
  strcpy(out, copy);
  table[n] = 1;
  p = malloc(n * 8);
}
"""


def test_functions_edges_and_snippets(spark):
    files = spark.createDataFrame([("a.c", SOURCE), ("b.c", "no code"), ("c.c", None)], "file string, text string")
    got = [(f.name, f.head, f.start, f.end) for f in structure.functions(files).orderBy("head").collect()]
    assert got == [("helper", 1, 2, 4), ("parse_header", 6, 6, 15)]
    assert [tuple(r) for r in structure.call_edges(files).collect()] == [("a.c", "parse_header", "helper")]
    places = spark.createDataFrame([("a.c", 3, "x"), ("a.c", 5, "y"), ("a.c", 12, "z"), ("b.c", 1, "w")], "file string, line int, k string")
    at = {r.k: r.function for r in structure.function_at(places, structure.functions(files)).collect()}
    assert at == {"x": "helper", "y": "", "z": "parse_header", "w": ""}
    shown = {r.k: r.snippet for r in structure.snippets(places, files, 1).collect()}
    assert shown["x"] == "       2 | {\n>>>    3 |   return a;\n       4 | }"
    assert shown["w"] == ">>>    1 | no code"


def test_entry_points(spark):
    rows = [("f", "zeta", 0), ("f", "init_all", 1), ("f", "run_loop", 2), ("g", "a", 0), ("g", "main", 5), ("h", "b", 1), ("h", "c", 0)]
    found = structure.entry_points(spark.createDataFrame(rows, "file string, name string, ord int")).collect()
    assert sorted(map(tuple, found)) == [("f", "init_all", 1), ("f", "run_loop", 2), ("g", "main", 1), ("h", "b", 2), ("h", "c", 1)]


def test_paths_against_breadth_first_search(spark):
    import random
    from collections import deque

    random.seed(3)
    edges = {(g, f"n{random.randrange(12)}", f"n{random.randrange(12)}") for g in (1, 2) for _ in range(22)}
    edges = [e for e in edges if e[1] != e[2]]
    entries = [(1, "n0", 1), (1, "n5", 2), (2, "n1", 1)]
    df = structure.paths_from(spark.createDataFrame(edges, "g int, src string, dst string"), spark.createDataFrame(entries, "g int, name string, nth int"), "g")
    got = {(r.g, r.entry, r.node): (r.depth, r.path) for r in df.collect()}
    want = {}
    for g, entry, _ in entries:
        best, queue = {entry: [entry]}, deque([entry])
        while queue:
            layer = {}
            for node in queue:
                for dst in (d for h, s, d in edges if (h, s) == (g, node) and d not in best):
                    layer[dst] = min(layer.get(dst, ["~"]), [*best[node], dst])
            best |= layer
            queue = deque(layer)
        want |= {(g, entry, n): (len(p) - 1, p) for n, p in best.items()}
    assert got == want
    e, n = spark.createDataFrame(edges, "g int, src string, dst string"), spark.createDataFrame(entries, "g int, name string, nth int")
    near = {}
    for (g, _, node), (depth, _) in want.items():
        near[g, node] = min(depth, near.get((g, node), depth))
    assert {(r.g, r.node): r.depth for r in structure.reachable(e, n, "g").collect()} == near
    chains = {}
    for g, entry, _ in reversed(entries):
        chains |= {(g, node): path for (h, start, node), (_, path) in want.items() if (h, start) == (g, entry)}
    assert {(r.g, r.node): r.chain for r in structure.call_chains(e, n, "g").collect()} == chains


def test_long_chains_are_followed_to_their_end(spark):
    edges = [(1, f"n{k}", f"n{k + 1}") for k in range(80)] + [(1, "n80", "n0")]
    e, n = spark.createDataFrame(edges, "g int, src string, dst string"), spark.createDataFrame([(1, "n0", 1)], "g int, name string, nth int")
    assert {(r.node, r.depth) for r in structure.reachable(e, n, "g").collect()} == {(f"n{k}", k) for k in range(81)}


def test_taint(spark):
    files = spark.createDataFrame([("a.c", SOURCE)], "file string, text string")
    functions = taint.tainted_functions(files)
    marked = {(r.function, t.var, t.line, t.hint) for r in functions.collect() for t in r.tainted}
    want = {("line", 0), ("n", 0), ("copy", 8), ("out", 12), ("p", 14)}
    assert marked == {("parse_header", var, line, "network") for var, line in want}
    found = {(r.line, r.sink, r.cwe, tuple(r.tainted)) for r in taint.taint_hits(functions).collect()}
    assert found == {(12, "strcpy", "CWE-120", ("copy",)), (14, "alloc_overflow", "CWE-120", ("n",))}
    assert {tuple(r) for r in taint.seeds(files).collect()} == {("a.c", "parse_header", "line"), ("a.c", "parse_header", "n")}


def test_return_taint_traits_and_signatures(spark):
    from tracequarry.sources import code

    files = spark.createDataFrame([("a.c", SOURCE), ("b.c", None), ("c.c", "")], "file string, text string")
    back = {r.function: (r.possible, r.sources) for r in taint.returns_taint(taint.tainted_functions(files)).collect()}
    assert back == {"helper": (False, []), "parse_header": (True, [])}
    traits = {r.file: (r.network, r.parser, r.ipc, r.privileged) for r in code.code_traits(files).collect()}
    assert traits == {"a.c": (False, True, False, False), "c.c": (False, False, False, False)}
    places = spark.createDataFrame([("a.c", 9), ("a.c", 3), ("c.c", 1)], "file string, line int")
    above = {(r.file, r.line): r.signature for r in structure.signatures(places, files).collect()}
    assert above == {("a.c", 9): "static char *parse_header(char *line, int n) {", ("a.c", 3): "int helper(int a)", ("c.c", 1): ""}


def test_taint_index_and_rounds():
    calls, assigns = taint.take_apart("a = getenv(x);\nb = tab[a];\nsprintf(buf2, fmt, b);\nif (a == b) f(g(h), i);\n", 10)
    assert assigns == [("a", "getenv(x)", 10), ("b", "tab[a]", 11)]
    assert [(c, args, n) for c, args, n in calls] == [("sprintf", ["buf2", "fmt", "b"], 12), ("if", ["a == b"], 13), ("f", ["g(h", "i"], 13)]
    assert taint.close_over("work", [], calls, assigns) == [("a", 10, "environment"), ("b", 11, "network"), ("buf2", 12, "network")]


def test_pipeline(spark):
    files = spark.createDataFrame([("vendor/a.c", SOURCE), ("b.c", "")], "file string, text string")
    done = pipeline.analyse(files).orderBy("rank").collect()
    assert [r.finding_no for r in done] == [f"F-{k:05d}" for k in range(1, len(done) + 1)]
    assert [r.priority for r in done] == sorted((r.priority for r in done), reverse=True)
    copy = next(r for r in done if r.cwe == "CWE-120")
    assert (copy.function, copy.line, copy.controllability, copy.vendor_source) == ("parse_header", 12, "low", "vendor (vendored/third-party)")
    assert ">>>   12 |" in copy.snippet and all(0 <= r.confidence <= 1 and 0 <= r.priority <= 10 for r in done)
    assert pipeline.Config.of({"rules": ["toctou"], "unknown": 1}).rules == ["toctou"]


def test_heads_with_scopes_and_templates(spark):
    text = "void Foo::run(int n) {\n}\nstd::vector<int> made(int n)\n{\n}\nconst Map<K, V> &Box<T>::get(int a) const {\n}\nFoo::~Foo() {\n}\nint x = a < b ? f(1) : g(2);\nif (a < b) {\n}\n"
    found = structure.functions(spark.createDataFrame([("a.cc", text)], "file string, text string")).orderBy("ord").collect()
    assert [(r.name, r.head, r.end) for r in found] == [("run", 1, 2), ("made", 3, 5), ("get", 6, 7), ("Foo", 8, 9)]


PROJECTS = {
    "copy.c": ("CWE-120", "void keep_name(const char *input, int user_data) {\n    char room[16];\n    memcpy(room, input, user_data);\n    puts(room);\n}"),
    "after.c": ("CWE-416", "int main(void) {\n    struct item *it = malloc(sizeof(*it));\n    if (!it) return 1;\n    free(it);\n    return it->count;\n}"),
    "twice.c": ("CWE-415", "int main(void) {\n    char *text = malloc(8);\n    free(text);\n    puts(\"gone\");\n    free(text);\n    return 0;\n}"),
    "size.c": ("CWE-190", "char *make_grid(int rows, int width) {\n    size_t room = rows * width;\n    char *grid = malloc(room);\n    return grid;\n}"),
    "null.c": ("CWE-476", "int main(void) {\n    struct item *it = malloc(sizeof(struct item));\n    it->count = 4;\n    return it->count;\n}"),
    "clean.c": (None, "int add(int a, int b) {\n    return a + b;\n}"),
}


def test_what_each_project_shows_survives_the_pipeline(spark):
    files = spark.createDataFrame([(f, text) for f, (_, text) in PROJECTS.items()], "file string, text string")
    done = pipeline.analyse(files).collect()
    left = {(r.file, r.cwe) for r in done if r.status != "likely_false_positive"}
    assert {(f, cwe) for f, (cwe, _) in PROJECTS.items() if cwe} <= left
    assert not [r for r in done if r.file == "clean.c"]
    bound = next(r for r in done if r.file == "copy.c" and r.cwe == "CWE-120")
    assert (bound.attack_surface, bound.taint_info) == ("network", "tainted sink memcpy at keep_name:3; tainted args: user_data; source: network")


def test_pipeline_has_chains_standalone_taint_and_scanner_outputs(spark, monkeypatch):
    more = "static int deep(int n) {\n  strcpy(a, b);\n}\n\nint main(int argc) {\n  deep(argc);\n}\n\nint far(int z) {\n  strcpy(c, d);\n}\n"
    files = spark.createDataFrame([("a.c", SOURCE), ("m.c", more), ("b.c", "")], "file string, text string")
    log = "ERROR: AddressSanitizer: heap-use-after-free\n"
    hit = '{"results": [{"check_id": "k%d", "path": "", "start": {"line": %d}, "extra": {"message": "m", "metadata": {"cwe": ["CWE-78"]}}}]}'
    outputs = {
        "semgrep": spark.createDataFrame([(hit % (k, k),) for k in range(40)], "payload string"),
        "sanitizer": spark.createDataFrame([(log,), (log + "    #0 0x1f in go m.c:2\n",)], "payload string"),
    }
    monkeypatch.setattr(structure, "LISTED", 10)
    done = pipeline.analyse(files, outputs).collect()
    by = {(r.file, r.line, r.cwe): r for r in done}
    assert len(by) == len(done) and {r.finding_no for r in done} == {f"F-{k:05d}" for k in range(1, len(done) + 1)}
    assert [(by["m.c", k, "CWE-120"].reachability, by["m.c", k, "CWE-120"].call_chain) for k in (2, 10)] == [("high", ["main", "deep"]), ("unknown", [])]
    assert by["m.c", 2, "CWE-120"].priority == by["m.c", 10, "CWE-120"].priority + 1.9
    alone = [r for r in done if r.tools == ["taint:alloc_overflow"]]
    assert [(r.file, r.line, r.function, r.category, r.controllability, r.tainted) for r in alone] == [("a.c", 14, "parse_header", "taint", "high", ["n"])]
    assert ("runtime", 0, "CWE-416") in by and by["m.c", 2, "CWE-416"].function == "go" and ">>>    2 |" in by["m.c", 2, "CWE-416"].snippet
    assert sum(r.file == "" and r.tools == ["semgrep"] for r in done) == 40


def test_flow_steps_carry_their_own_hints(spark):
    text = "int one(int z) {\n  v = getenv(x);\n  printf(v);\n  system(v);\n}\n\nint parse_it(int q) {\n  printf(q);\n  t = tab[q];\n  system(q);\n}\n"
    files = spark.createDataFrame([("a.c", text)], "file string, text string")
    flows = {(r.line, r.sink): r.flow for r in taint.taint_hits(taint.tainted_functions(files)).collect()}
    assert flows[4, "system"] == ["'v' becomes tainted at this line (environment)", "system reached with tainted data"]
    assert flows[9, "array_index"] == ["'q' enters parse_it (network)", "tainted value used as index into 'tab'"]
    done = {(r.line, r.cwe): r for r in pipeline.analyse(files).collect()}
    assert done[4, "CWE-78"].dataflow == flows[4, "system"] and done[10, "CWE-78"].dataflow == ["'q' enters parse_it (network)", "system reached with tainted data"]


def test_places_of_all_rules_get_function_snippet_and_signature(spark, tmp_path):
    from tracequarry.plans import code_queries as Q

    text = "static int go(int n) {\n  read(fd, b, n);\n  strcpy(a, b);\n  strcpy(a, gets(b)); system(cmd);\n}\n\nsystem(cmd);\nq = 1;"
    lines, places = text.split("\n"), (2, 3, 4, 7)
    spark.createDataFrame([(7, text), (8, None), (9, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lambda query, column: sorted((r.file, r.line, r[column]) for r in query(spark, str(tmp_path)).collect())
    numbered = lambda at: "\n".join(f"{'>>>' if k == at else '   '} {k:4d} | {t}" for k, t in enumerate(lines, 1))
    assert got(Q.q_function_at, "function") == [("doc-7.c", k, "go" if k < 6 else "") for k in places]
    assert got(Q.q_snippet, "snippet") == [("doc-7.c", k, numbered(k)) for k in places]
    assert got(Q.q_signature, "signature") == [("doc-7.c", k, lines[0]) for k in places]
