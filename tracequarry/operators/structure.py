"""Functions, calls and paths: what encloses a line, who calls whom, what an entry point reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import patterns as P
from tracequarry.functions.regexes import every, has
from tracequarry.operators.rules import functions_in
from tracequarry.session import broadcast_if_small, cut, width

# Fixed values
ENTRY_HINTS = ["main", "exit", "hook", "dispatch", "poll", "loop", "event", "handle", "init"]
REACH_WORDS = ["handler", "process", "parse", "main", "entry"]
#: No set has more entry points (see `entry_points`).
ENTRIES = 16
#: Findings of a file that meet its text as one list; a file with more has several lists.
LISTED = 500
CALL = r"\b(\w+)\s*\("
SIGNATURE = r"^(static\s+|extern\s+|inline\s+)*(void|int|char|unsigned|size_t|ssize_t|bool|float|double|const\s+\w+|struct\s+\w+|enum\s+\w+|\w+\s*\*)"


def with_lines(files: DataFrame) -> DataFrame:
    return files.where("text is not null").select("file", F.split("text", "\n", -1).alias("lines"))


def functions(files: DataFrame) -> DataFrame:
    """(file, ord, name, head, start, end): one row per function definition, without a shuffle."""
    return with_lines(files).select("file", F.posexplode(functions_in(F.col("lines"))).alias("ord", "f")).select("file", "ord", "f.*")


def function_at(places: DataFrame, functions_: DataFrame) -> DataFrame:
    """Adds `function`: the name of the last definition that starts up to the line, if the line is within it; else ''.

    places: file, line and more. An equi-join on the file with the range as a residual.
    """
    spans = functions_.select("file", "name", "start", "end")
    hit = places.select("file", "line").distinct().join(spans, "file").where("start <= line")
    last = hit.groupBy("file", "line").agg(F.max_by(F.struct("name", "end"), F.struct("start", "end")).alias("_f"))
    name = F.when(F.col("_f.end") >= F.col("line"), F.col("_f.name")).otherwise(F.lit(""))
    return places.join(last, ["file", "line"], "left").withColumn("function", F.coalesce(name, F.lit(""))).drop("_f")


def snippet(lines: Column, line: Column, around: int = 15) -> Column:
    """The lines around a line, numbered, the line itself marked; '' where there is none."""
    start = F.greatest(line - around, F.lit(1))
    mark = lambda n: F.when(n == line, ">>>").otherwise("   ")
    rows = F.transform(F.slice(lines, start, F.greatest(line + around - start + 1, F.lit(0))), lambda t, i: F.format_string("%s %4d | %s", mark(i + start), i + start, t))
    return F.coalesce(F.array_join(rows, "\n"), F.lit(""))


def snippets(places: DataFrame, files: DataFrame, around: int = 15) -> DataFrame:
    """Adds `snippet` to places (file, line and more)."""
    return places.join(with_lines(files), "file", "left").withColumn("snippet", snippet(F.col("lines"), F.col("line"), around)).drop("lines")


def signature_above(lines: Column, line: Column, reach: int = 30) -> Column:
    """The nearest line, from the given one up to `reach` lines upwards, that begins like a declaration and has a parenthesis; '' for none."""
    start = F.greatest(line - reach + 1, F.lit(1))
    near = F.transform(F.reverse(F.slice(lines, start, F.greatest(line - start + 1, F.lit(0)))), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.coalesce(F.get(F.filter(near, lambda t: F.contains(t, F.lit("(")) & has(t, SIGNATURE)), F.lit(0)), F.lit(""))


def signatures(places: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `signature` to places (file, line and more)."""
    return places.join(with_lines(files), "file", "left").withColumn("signature", signature_above(F.col("lines"), F.col("line"))).drop("lines")


def enrich(findings: DataFrame, files: DataFrame, around: int = 15, window: int = 80) -> DataFrame:
    """Findings (file, line and more) with what their file says of them, in one join with the texts.

    Adds snippet, lines (those up to `window` around), at (the finding's place among them, from
    1, or 0 without a line), guarded (a size guard within 15 lines) and, where it is missing or '', function (see
    `function_at`). A file's findings meet its text as lists of some LISTED, so no text is
    repeated for each of them and no file that many findings name is gathered in one list.
    """
    findings = cut(findings if "function" in findings.columns else findings.withColumn("function", F.lit("")))
    own = [c for c in findings.columns if c != "file"]
    tasks = width(findings.sparkSession)
    hot = broadcast_if_small(findings.groupBy("file").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LISTED))
    parts = F.pmod(F.xxhash64(*own), F.ceil(F.coalesce("_n", F.lit(1)) / LISTED)).alias("_part")
    nested = findings.join(hot, "file", "left").select("file", F.struct(*own).alias("_f"), parts).repartition(tasks, "file", "_part").groupBy("file", "_part").agg(F.collect_list("_f").alias("_f"))
    joined = nested.join(with_lines(files.repartition(tasks, "file")), "file", "left").withColumn("_d", functions_in(F.col("lines")))
    lines = F.col("lines")

    def told(f):
        line = f["line"]
        near = lambda k: (F.greatest(line - k, F.lit(1)), F.greatest(line + k - F.greatest(line - k, F.lit(1)) + 1, F.lit(0)))
        last = F.try_element_at(F.filter("_d", lambda d: d["start"] <= line), F.lit(-1))
        return F.struct(
            *[f[c].alias(c) for c in own if c != "function"],
            F.when(F.coalesce(f["function"], F.lit("")) != "", f["function"]).otherwise(F.coalesce(F.when(last["end"] >= line, last["name"]), F.lit(""))).alias("function"),
            snippet(lines, line, around).alias("snippet"),
            F.coalesce(F.slice(lines, *near(window)), F.array().cast("array<string>")).alias("lines"),
            F.greatest(line - near(window)[0] + 1, F.lit(0)).alias("at"),
            F.coalesce(F.exists(F.slice(lines, *near(15)), lambda t: has(t, P.SIZE_GUARD)), F.lit(False)).alias("guarded"),
        )

    return joined.select("file", F.explode(F.transform("_f", told)).alias("_f")).select("file", "_f.*")


def call_edges(files: DataFrame, cross_file: bool = False) -> DataFrame:
    """(file, src, dst): calls in a function's body of other functions defined in the same file, each once.

    With `cross_file` of functions defined in any of the files; the names called meet the names
    defined, each once, in a join.
    """
    ready = with_lines(files).withColumn("fs", functions_in(F.col("lines"))).where(F.size("fs") > (0 if cross_file else 1))
    names = F.transform("fs", lambda f: f["name"])

    def calls(f):
        body = F.slice("lines", f["head"], f["end"] - f["head"] + 1)
        called = F.array_distinct(F.flatten(F.transform(body, lambda t: every(t, CALL))))
        known = called if cross_file else F.array_intersect(called, names)
        return F.transform(F.array_except(known, F.array(f["name"])), lambda d: F.struct(f["name"].alias("src"), d.alias("dst")))

    edges = ready.select("file", F.explode(F.array_distinct(F.flatten(F.transform("fs", calls)))).alias("e")).select("file", "e.src", "e.dst")
    if not cross_file:
        return edges
    defined = functions(files).select(F.col("name").alias("dst")).distinct()
    return edges.join(broadcast_if_small(defined), "dst", "left_semi").select("file", "src", "dst")


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, entries) of files as one set: (files, src, dst) and (files, name, nth), functions known by their name.

    `files` is a constant. The entries are those of `entry_points` in order of file and
    definition; only the first are kept before they are numbered, so no task sorts all names.
    """
    one = F.lit(0).alias("files")
    edges = call_edges(files).select(one, "src", "dst").distinct()
    low = F.lower("name")
    kind = F.when(F.col("name") == "main", 0).when(F.greatest(*[F.contains(low, F.lit(h)) for h in ENTRY_HINTS]), 1).otherwise(2)
    named = functions(files).groupBy("name").agg(F.min(F.struct("file", "ord")).alias("ord"))
    first_ = named.orderBy(kind, "ord", "name").limit(ENTRIES)
    return edges, entry_points(first_.select(one, "name", "ord"), "files")


def chain_edges(chains: DataFrame, group: str, chain: str) -> DataFrame:
    """(group, src, dst), each once: neighbours in call chains given as JSON lists of {function, file, line}."""
    steps = F.transform(F.from_json(chain, "array<struct<function: string, file: string, line: int>>"), lambda s: s["function"])
    named = F.filter(steps, lambda n: n.isNotNull() & (n != ""))
    pairs = F.arrays_zip(F.slice("n", 1, F.greatest(F.size("n") - 1, F.lit(0))).alias("src"), F.slice("n", 2, F.size("n")).alias("dst"))
    return chains.select(group, named.alias("n")).where(F.size("n") > 1).select(group, F.explode(pairs).alias("e")).select(group, "e.src", "e.dst").where("src <> dst").distinct()


def entry_points(functions_: DataFrame, group: str = "file", most: int = 16, some: int = 8, together: bool = False) -> DataFrame:
    """(group, name, nth): functions named main; else the first `most` whose names hint at an entry; else the first `some`.

    With `together` main and all whose names hint at an entry; else the first `most`.
    functions_: group, name, ord (order of definition).
    """
    low = F.lower("name")
    hinted = F.greatest(*[F.contains(low, F.lit(h)) for h in ENTRY_HINTS])
    kind = F.when((F.col("name") == "main") | (hinted & F.lit(together)), 0).when(hinted, 1).otherwise(2)
    some = most if together else some
    named = functions_.groupBy(group, "name").agg(F.min("ord").alias("ord")).withColumn("kind", kind)
    best = Window.partitionBy(group)
    nth = Window.partitionBy(group, "kind").orderBy("ord", "name")
    ranked = named.withColumns({"best": F.min("kind").over(best), "nth": F.row_number().over(nth)})
    cap = F.when(F.col("kind") == 0, F.lit(2**31 - 1)).when(F.col("kind") == 1, most).otherwise(some)
    return ranked.where((F.col("kind") == F.col("best")) & (F.col("nth") <= cap)).select(group, "name", "nth")


def callers(edges: DataFrame, group: str) -> DataFrame:
    """(group, function, callers): the functions that call it, in order."""
    return edges.groupBy(group, F.col("dst").alias("function")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


#: Rounds of a closure after which what was reached is written as one table, so that plans stay short.
ROUNDS = 8


def _closure(edges: DataFrame, start: DataFrame, key: list[str], step, better: list[str]) -> DataFrame:
    """`start` and everything that steps along the edges reach, however far: a row per key, the best by `better`.

    Breadth first over all groups at once: each round joins the rows that are new or became
    better with the edges (`step` turns a row and its edge into the next row) and keeps those
    that beat what was reached before. Each round is written, so a lost executor costs no more
    than a round; it ends when nothing gets better.
    """
    least = F.min(F.struct(*better)).alias("_b")
    reached = frontier = cut(start.groupBy(*key).agg(least).select(*key, "_b.*"))
    for k in range(1, 2**31):
        found = step(frontier.join(edges, [key[0], "node"])).groupBy(*key).agg(least)
        known = reached.groupBy(*key).agg(least.alias("_old")) if k > 1 else reached.select(*key, F.struct(*better).alias("_old"))
        fresh = found.join(known, key, "left").where("_old is null or _b < _old")
        frontier = cut(fresh.select(*key, "_b.*"))
        if frontier.isEmpty():
            break
        reached = reached.unionAll(frontier)
        if k % ROUNDS == 0:
            reached = cut(reached.groupBy(*key).agg(least).select(*key, "_b.*"))
    return reached.groupBy(*key).agg(least).select(*key, "_b.*")


def _outgoing(edges: DataFrame, group: str) -> DataFrame:
    return cut(edges.select(group, F.col("src").alias("node"), "dst").distinct())


def paths_from(edges: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """(group, entry, node, depth, path): a shortest path from each entry to every node it reaches; of equally short ones the least.

    There are as many rows as entries times nodes; `reachable` and `call_chains` need one a node.
    """
    start = entries.select(group, F.col("name").alias("entry"), F.col("name").alias("node"), F.lit(0).alias("depth"), F.array("name").alias("path"))
    step = lambda j: j.select(group, "entry", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
    return _closure(_outgoing(edges, group), start, [group, "entry", "node"], step, ["depth", "path"])


def reachable(edges: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """(group, node, depth): every node that some entry reaches, with its least distance."""
    start = entries.select(group, F.col("name").alias("node"), F.lit(0).alias("depth"))
    step = lambda j: j.select(group, F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
    return _closure(_outgoing(edges, group), start, [group, "node"], step, ["depth"])


def call_chains(edges: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """(group, node, chain): a shortest path from the first entry, in their order, that has one.

    All nodes of such a path have the same first entry, so one path a node is carried along.
    """
    start = entries.select(group, F.col("name").alias("node"), "nth", F.lit(0).alias("depth"), F.array("name").alias("chain"))
    step = lambda j: j.select(group, F.col("dst").alias("node"), "nth", (F.col("depth") + 1).alias("depth"), F.concat("chain", F.array("dst")).alias("chain"))
    return _closure(_outgoing(edges, group), start, [group, "node"], step, ["nth", "depth", "chain"]).select(group, "node", "chain")


def reach_level(chain_length: Column, function: Column) -> Column:
    """high for chains of up to 2, medium up to 4, low beyond; without a chain high by the function's name, else unknown."""
    hinted = F.greatest(*[F.contains(F.lower(function), F.lit(w)) for w in REACH_WORDS])
    return (
        F.when(chain_length > 4, "low").when(chain_length > 2, "medium").when(chain_length > 0, "high")
        .when(F.coalesce(hinted, F.lit(False)), "high").otherwise("unknown")
    )


def reach(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with call_chain, from an entry point of the files to the finding's function, and the reachability by its length.

    Without a chain reachability stays as it is and call_chain is empty.
    """
    edges, entries = call_graph(files)
    entries = cut(entries)
    found = cut(call_chains(edges, entries, "files"))
    chains = broadcast_if_small(found.select(F.col("node").alias("function"), F.col("chain").alias("call_chain")))
    level = F.when(F.size("call_chain") > 0, reach_level(F.size("call_chain"), F.col("function"))).otherwise(F.col("reachability"))
    return findings.join(chains, "function", "left").withColumns({"reachability": level, "call_chain": F.coalesce("call_chain", F.array().cast("array<string>"))})


def describe_chain(chain: Column) -> Column:
    """A chain of {function, file, line} as text."""
    place = lambda s: F.when(F.coalesce(s["file"], F.lit("")) != "", F.concat(s["file"], F.lit(":"), s["line"].cast("string"))).otherwise("")
    steps = F.transform(chain, lambda s: F.concat(F.lit("  "), s["function"], F.lit("("), place(s), F.lit(")")))
    return F.when(F.size(chain) > 0, F.array_join(steps, " ->\n")).otherwise("No call chain available")


def describe_dataflow(steps: Column) -> Column:
    """Steps of {variable, location{file, line}, description} as text."""
    at = lambda s: F.when(F.coalesce(s["location"]["file"], F.lit("")) != "", F.concat(s["location"]["file"], F.lit(":"), s["location"]["line"].cast("string"))).otherwise("")
    rows = F.transform(steps, lambda s: F.concat(F.lit("  "), s["variable"], F.lit(" ("), at(s), F.lit("): "), F.coalesce(s["description"], F.lit(""))))
    return F.when(F.size(steps) > 0, F.array_join(rows, "\n")).otherwise("No dataflow available")
