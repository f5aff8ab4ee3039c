"""Scanner results tied to the findings that describe the same defect, without a shared key.

Each attribute becomes a bit vector of fixed length from its q-grams. Pairs of different file
names within `RADIUS` bits of each other are found exactly by multi-index hashing: the vector is
cut into RADIUS + 2 chunks, at least two of which such a pair has in common. Results then meet
findings in equi-joins by name, weakness family and block of lines: those of the projects that
a step of the path names, and one of each kind of all others, so that neither common names nor
many projects make the pairs grow faster than the input. Candidates are scored by
field-weighted Dice similarity; the score is turned into a confidence by the rate at which the
same search finds candidates for results moved to other lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import clean
from tracequarry.session import broadcast_if_small, cut, join_on_hot_key

RADIUS = 3
REACH = 3
#: Lines a block of the join key spans; a result looks into the one or two blocks in its reach.
BLOCK = 16
#: What each field's agreement counts.
WEIGHTS = {"name": 4.0, "place": 4.0, "project": 2.0, "lines": 2.0, "weakness": 1.5, "tool": 0.5}
#: Lines that decoys are moved by, far beyond REACH.
DECOY_SHIFT = 41
_BINS = 100
#: Pairs of near names (some 100 bytes) up to which they are broadcast.
BROADCAST_NAMES = 20_000


def _bare(text: Column) -> Column:
    """Letters and digits in lower case, marked at both ends."""
    return F.concat(F.lit("^"), F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), F.lit("$"))


def gram_places(bare: str, width: int, q: int = 2) -> Column:
    """The bits that the q-grams of a column of bare texts set in a vector of that width; none for null."""
    at = F.sequence(F.lit(1), F.greatest(F.length(bare) - q + 1, F.lit(1)))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(F.col(bare), i, F.lit(q))), F.lit(width)).cast("int"))


def as_word(places: Column) -> Column:
    """A 64-bit word with these bits set, each taken modulo 64; 0 for null."""
    mark = lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x))
    return F.coalesce(F.aggregate(places, F.lit(0).cast("long"), mark), F.lit(0).cast("long"))


def _texts(df: DataFrame, tools: Column) -> DataFrame:
    """Adds the bare file name, folder and tools, of which the vectors are made."""
    return df.withColumns({"name": _bare(F.regexp_extract("path", "[^/]*$", 0)), "place": _bare(F.regexp_extract("path", "([^/]+)/[^/]*$", 1)), "tools": _bare(tools)})


def _with_name_vector(df: DataFrame) -> DataFrame:
    """Adds the bit vector of the file's name, 128 bits."""
    half = lambda k: as_word(F.filter("_h", lambda x: x < 64 if k == 0 else x >= 64))
    return df.withColumn("_h", gram_places("name", 128)).withColumns({"b_name0": half(0), "b_name1": half(1)}).drop("_h")


def _bare_path(path: Column) -> Column:
    """Lower case, forward slashes, without drive, scheme and leading steps."""
    p = F.lower(clean.posix_path(path))
    return F.regexp_replace(p, r"^(?:[a-z]:)?/*(?:\.\.?/+)*", "")


def project_word(name: Column) -> Column:
    """A directory as the name of a project: without a version or branch behind it."""
    return F.regexp_replace(F.lower(F.trim(name)), r"-(?:main|master|trunk|v?[0-9]+(?:\.[0-9]+)*)$", "")


def families(catalog: DataFrame) -> DataFrame:
    return catalog.select(clean.cwe_number(F.col("cwe")).alias("cwe"), "family").where("cwe is not null").dropDuplicates(["cwe"])


def defects(findings: DataFrame, runs: DataFrame, projects: DataFrame, catalog: DataFrame) -> DataFrame:
    """`known_defects` with the vectors of their names."""
    return _with_name_vector(known_defects(findings, runs, projects, catalog))


def known_defects(findings: DataFrame, runs: DataFrame, projects: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per project and fingerprint: path in the project, line, cwe, family and the texts of `_texts`.

    Path, line and weakness are those of the least row that has all three usable, else the least
    usable ones; the tools are those of the longest list. Rows meet once, by project and
    fingerprint, after partial aggregation.
    """
    f = F.col
    owner = runs.select(f("id").alias("run_id"), "project_id").where("run_id is not null and project_id is not null").distinct()
    known = projects.select(f("id").alias("project_id"), F.lower(F.trim("root_path")).alias("root"), project_word(f("project_name")).alias("project"))
    rows = findings.where("run_id is not null").select(
        "run_id",
        clean.fingerprint(f("fingerprint")).alias("fingerprint"),
        F.when(F.trim("file_path") != "", f("file_path")).alias("path"),
        F.when(f("line") > 0, f("line")).alias("line"),
        clean.cwe_number(f("cwe")).alias("cwe"),
        "tools",
    )
    grouped = (
        rows.where("fingerprint is not null")
        .join(broadcast_if_small(owner), "run_id")
        .groupBy("project_id", "fingerprint")
        .agg(
            F.min(F.when(f("path").isNotNull() & f("line").isNotNull() & f("cwe").isNotNull(), F.struct("path", "line", "cwe"))).alias("row"),
            *[F.min(c).alias(c) for c in ("path", "line", "cwe")],
            F.max(F.struct(F.length("tools").alias("n"), "tools"))["tools"].alias("tools"),
        )
        .select("project_id", "fingerprint", "tools", *[F.coalesce(f("row")[c], f(c)).alias(c) for c in ("path", "line", "cwe")])
        .dropna(subset=["path", "line", "cwe"])
        .join(families(catalog), "cwe")
        .join(broadcast_if_small(known.dropDuplicates(["project_id"])), "project_id", "left")
    )
    path, root = F.lower(clean.posix_path(f("path"))), F.concat("root", F.lit("/"))
    shaped = grouped.withColumn("path", path).withColumn(
        "path", F.when(F.startswith("path", root), F.substring(f("path"), F.length(root) + 1, F.length("path"))).otherwise(F.ltrim(f("path"), F.lit("/")))
    )
    return _texts(shaped.dropna(subset=["path"]), F.array_join(clean.tool_list(f("tools")), " ")).withColumn("defect", F.monotonically_increasing_id())


def told_families(rows: DataFrame) -> DataFrame:
    """(result_id, told): the family that the words of msg tell where the weakness gives none.

    Naive Bayes over words, counted over all results whose weakness is known. rows: result_id,
    family (null if not known), words.
    """
    said = rows.where(F.size("words") > 0)
    known = said.where("family is not null")
    sizes = known.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    counts = known.select("family", F.explode("words").alias("word")).groupBy("family", "word").agg(F.log((F.count(F.lit(1)) + 0.5) / 0.5).alias("gain"))
    open_ = said.where("family is null").select("result_id", F.size("words").alias("k"), F.explode("words").alias("word"))
    scored = (
        open_.join(counts, "word")
        .groupBy("result_id", "family", "k")
        .agg(F.sum("gain").alias("gain"))
        .join(sizes, "family")
        .withColumn("score", F.round(F.col("gain") + F.log("n") + F.col("k") * F.log(0.5 / (F.col("n") + 1)), 9))
    )
    return scored.groupBy("result_id").agg(F.max(F.struct("score", "family")).alias("best")).select("result_id", F.col("best.family").alias("told"))


def reports(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """`usable_reports` with the vectors of their names."""
    return _with_name_vector(usable_reports(results, catalog))


def usable_reports(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per scanner result that has a file, a line and a family, with the texts of `_texts`."""
    f = F.col
    quoted = r"'[^']*'|\([^)]*\)|\[[^\]]*\]"
    words = F.filter(F.array_distinct(F.split(F.lower(F.regexp_replace("msg", quoted, " ")), "[^a-z]+")), lambda w: F.length(w) > 1)
    rows = cut(
        results.where("result_id is not null and line_no > 0 and reported_path is not null")
        .groupBy("result_id")
        .agg(*[F.min(c).alias(c) for c in ("reported_path", "line_no", "weakness", "msg", "tool")])
        .withColumn("cwe", clean.cwe_number(f("weakness")))
        .join(families(catalog), "cwe", "left")
        .select("result_id", _bare_path(f("reported_path")).alias("path"), f("line_no").alias("line"), "cwe", "family", "tool", words.alias("words"))
    )
    whole = rows.drop("words").join(told_families(rows), "result_id", "left").withColumn("family", F.coalesce("family", "told"))
    return _texts(whole.dropna(subset=["path", "family"]), f("tool")).drop("tool", "told")


def named_projects(reports_: DataFrame, projects: DataFrame) -> DataFrame:
    """(result_id, project_id): projects whose name, or whose root's last step, is a step of a result's path."""
    f = F.col
    roots = projects.select(f("id").alias("project_id"), F.regexp_extract(F.lower(F.trim("root_path")), "[^/]*$", 0).alias("step"))
    known = projects.select(f("id").alias("project_id"), project_word(f("project_name")).alias("step")).unionAll(roots)
    known = broadcast_if_small(cut(known.where("project_id is not null and step <> ''").distinct()))
    steps = F.array_distinct(F.transform(F.slice(F.reverse(F.split("path", "/")), F.lit(2), F.size(F.split("path", "/"))), project_word))
    return reports_.select("result_id", F.explode(steps).alias("step")).join(known, "step").select("result_id", "project_id").distinct()


def _chunks(a: str, b: str) -> list[Column]:
    """The RADIUS + 2 chunks of the name's vector: two of 26 bits in either word, and what is left of both."""
    part = lambda c, at: F.shiftrightunsigned(c, at).bitwiseAND(F.lit(2**26 - 1))
    rest = F.shiftrightunsigned(a, 52).bitwiseOR(F.shiftleft(F.shiftrightunsigned(b, 52), 12))
    return [part(a, 0), part(a, 26), part(b, 0), part(b, 26), rest]


def near_names(reports_: DataFrame, defects_: DataFrame) -> DataFrame:
    """(name, d_name, alike): pairs of different names of results and of findings, RADIUS bits apart at most, and their Dice similarity.

    Such a pair is found by every two chunks that it shares and kept by the first two alone.
    Names are few beside rows, so however many rows have a short name with empty chunks, it
    meets the other short names once.
    """
    both = [(i, j) for i in range(RADIUS + 2) for j in range(i + 1, RADIUS + 2)]

    def keyed(df: DataFrame, *names: str) -> DataFrame:
        coded = _with_name_vector(df.select("name").distinct()).toDF(*names)
        chunks = _chunks(*names[1:])
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), chunks[i].alias("x"), chunks[j].alias("y")) for k, (i, j) in enumerate(both)])).alias("k")
        return cut(coded).select(*names, keys).select(*names, "k.*")

    c = F.col
    ones = lambda a, b: F.bit_count(a) + F.bit_count(b)
    same = [x == y for x, y in zip(_chunks("r0", "r1"), _chunks("d0", "d1"), strict=True)]
    first = F.coalesce(*[F.when(same[i] & same[j], k) for k, (i, j) in enumerate(both)])
    apart = ones(c("r0").bitwiseXOR(c("d0")), c("r1").bitwiseXOR(c("d1")))
    alike = 2.0 * ones(c("r0").bitwiseAND(c("d0")), c("r1").bitwiseAND(c("d1"))) / (ones(c("r0"), c("r1")) + ones(c("d0"), c("d1")))
    pairs = keyed(reports_, "name", "r0", "r1").join(keyed(defects_, "d_name", "d0", "d1"), ["nth", "x", "y"])
    return pairs.where((apart <= RADIUS) & (c("nth") == first)).select("name", "d_name", alike.alias("alike"))


def near_pairs(reports_: DataFrame, defects_: DataFrame, *more: str, names: DataFrame | None = None) -> DataFrame:
    """(result_id, decoy, defect, away, alike): pairs of a family at most REACH lines apart whose names differ in RADIUS bits at most.

    `more` names columns in which both are equal, too; `names` may hold the near names of both
    tables. Only keys and lines are shuffled. Each result is also sought as a decoy, moved by
    DECOY_SHIFT lines.
    """
    line = F.col("line")
    block = lambda x: F.floor(x / BLOCK).cast("int")
    seek = F.explode(F.array(F.struct(F.lit(False).alias("decoy"), line.alias("at")), F.struct(F.lit(True).alias("decoy"), (line + DECOY_SHIFT).alias("at")))).alias("x")
    names = cut(near_names(reports_, defects_)) if names is None else names
    r = (
        join_on_hot_key(reports_.select("result_id", "family", "name", "line", *more), names, "name", "result_id", most=BROADCAST_NAMES)
        .select("result_id", "family", "d_name", "alike", seek, *more)
        .select("result_id", "family", "d_name", "alike", "x.*", *more)
        .withColumn("block", F.explode(F.sequence(block(F.col("at") - REACH), block(F.col("at") + REACH))))
    )
    d = defects_.select("defect", "family", "line", block(line).alias("block"), F.col("name").alias("d_name"), *more)
    away = F.abs(F.col("at") - F.col("line"))
    return r.join(d, ["d_name", "family", "block", *more]).where(away <= REACH).select("result_id", "decoy", "defect", away.alias("away"), "alike")


def kinds(defects_: DataFrame) -> DataFrame:
    """Of defects that differ in project and fingerprint alone, which no score tells apart, the one that wins a tie."""
    kind = ["path", "line", "family", "cwe", "tools"]
    best = F.max_by(F.struct("defect", "name"), F.struct(-F.col("project_id"), "fingerprint")).alias("best")
    return defects_.groupBy(*kind).agg(best).select(*kind, "best.*")


def scored_pairs(reports_: DataFrame, defects_: DataFrame, owners: DataFrame) -> DataFrame:
    """The near pairs with both sides' attributes and their field-weighted Dice score.

    A result meets all defects of the projects that its path names (`owners`), and one of each
    kind of all projects.
    """
    names = cut(near_names(reports_, defects_))
    owned = near_pairs(reports_.join(owners, "result_id"), defects_, "project_id", names=names).withColumn("owned", F.lit(True))
    other = near_pairs(reports_, kinds(defects_), names=names).withColumn("owned", F.lit(False))
    named = lambda df, side, keep: df.select(*keep, *[F.col(c).alias(f"{side}_{c}") for c in ("path", "cwe", "place", "tools")])
    owning = owners.select("result_id").distinct().withColumn("owning", F.lit(True))
    told = named(reports_.join(owning, "result_id", "left"), "r", ["result_id", "owning"])
    pairs = owned.unionAll(other).join(told, "result_id").join(named(defects_, "d", ["defect", "project_id", "fingerprint", "project", "root"]), "defect")
    c = F.col
    fields = {
        "name": c("alike"),
        "place": dice("r_place", "d_place"),
        # No evidence where the result names no project.
        "project": F.when(c("owned"), 1.0).when(c("owning"), 0.0).otherwise(0.5),
        # Dice of the two sets of lines within REACH, and of the sets {family} or {family, cwe}.
        "lines": F.greatest(F.lit(0.0), 1.0 - c("away") / (2 * REACH + 1)),
        "weakness": F.when(c("r_cwe").isNull(), 2.0 / 3).when(c("r_cwe") == c("d_cwe"), 1.0).otherwise(0.5),
        "tool": dice("r_tools", "d_tools"),
    }
    score = sum((w * fields[k] for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return pairs.select("result_id", "decoy", "project_id", "fingerprint", "project", "root", "r_path", "d_path", F.round(score, 6).alias("score")).withColumn("same", same_file())


def dice(a: str, b: str) -> Column:
    """Dice similarity of two texts' vectors of 64 bits; 0.5 (no evidence) where either is empty."""
    x, y = as_word(gram_places(a, 64)), as_word(gram_places(b, 64))
    alike = 2.0 * F.bit_count(x.bitwiseAND(y)) / (F.bit_count(x) + F.bit_count(y))
    none = lambda c: F.col(c).isNull() | (F.col(c) == "^$")
    return F.when(none(a) | none(b), 0.5).when(F.col(a) == F.col(b), 1.0).otherwise(alike)


def same_file() -> Column:
    """Whether one path ends with the other at a step, what lies before it being the project."""
    r, d = F.concat(F.lit("/"), "r_path"), F.concat(F.lit("/"), "d_path")
    before = F.regexp_extract(F.substring(r, F.lit(1), F.length(r) - F.length(d)), "[^/]*$", 0)
    owner = (before == "") | (project_word(before) == F.col("project")) | (project_word(before) == F.regexp_extract("root", "[^/]*$", 0))
    return F.coalesce((F.endswith(r, d) & owner) | F.endswith(d, r), F.lit(False))


def pooled(bins: list[tuple[int, float, float]]) -> list[tuple[int, float]]:
    """(bin, rate) that never falls as bins rise, from (bin, trials, successes): pool adjacent violators.

    There are at most _BINS + 1 bins, however many results.
    """
    blocks: list[list] = []
    for b, trials, hits in bins:
        blocks.append([[b], trials, hits])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return [(b, hits / trials) for bs, trials, hits in blocks for b in bs]


def match_results(results: DataFrame, findings: DataFrame, runs: DataFrame, projects: DataFrame, catalog: DataFrame, exact: bool = False) -> DataFrame:
    """(result_id, project_id, fingerprint, score, confidence): the best match of each scanner result.

    Of a result's candidates that of the highest score stays, equal ones by project and
    fingerprint. confidence: the share of matches of about that score which are of the same
    file of the same project, less the share that chance brings, as the decoys tell it, made
    never to fall as the score rises. With `exact`, candidates must be of the
    same file of the same project. Results without a usable path, line or family, and
    fingerprints without one, match nothing; repeated rows count once; empty tables give an
    empty table.
    """
    reports_, defects_ = cut(usable_reports(results, catalog)), cut(known_defects(findings, runs, projects, catalog))
    near = scored_pairs(reports_, defects_, cut(named_projects(reports_, projects)))
    if exact:
        near = near.where("same")
    best = cut(
        near.groupBy("result_id", "decoy")
        .agg(F.max_by(F.struct("project_id", "fingerprint", "score", "same"), F.struct("score", (-F.col("project_id")).alias("p"), "fingerprint")).alias("m"))
        .select("result_id", "decoy", "m.*", F.floor(F.col("m.score") * _BINS).cast("int").alias("bin"))
    )
    chance, found = F.count_if(F.col("decoy") & F.col("same")), F.count_if(~F.col("decoy") & F.col("same"))
    counts = best.groupBy("bin").agg(F.count_if(~F.col("decoy")), found, chance).orderBy("bin").collect()
    rates = pooled([(b, hits + 1.0, max(0.0, same - decoys)) for b, hits, same, decoys in counts])
    rate = results.sparkSession.createDataFrame(rates, "bin int, confidence double")
    return best.where(~F.col("decoy")).join(F.broadcast(rate), "bin").select("result_id", "project_id", "fingerprint", "score", "confidence")
