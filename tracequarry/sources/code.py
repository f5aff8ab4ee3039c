"""Source texts as tables: files, their lines, and what a file listing tells of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.session import spread

# Fixed values
RULE_EXTENSIONS = ["c", "cpp", "cc", "cxx", "h", "hpp"]
CALLGRAPH_EXTENSIONS = ["c", "cpp", "cc"]
VENDOR_DIRS = ["3rdparty", "third_party", "third-party", "vendor", "vendored", "external", "deps", "contrib", "lib", "libs", "extern", "thirdparty", "bundled"]

TRAITS = {
    "network": ["socket", "recv", "send", "bind", "listen", "accept", "connect"],
    "parser": ["parse", "tokenizer", "lexer", "decoder", "deserialize"],
    "ipc": ["pipe", "shmget", "mmap", "fork", "msgget"],
    "privileged": ["setuid", "setgid", "sudo", "capability", "privilege"],
}


def code_traits(files: DataFrame) -> DataFrame:
    """(file, network, parser, ipc, privileged): whether the whole text holds one of the words of each kind."""
    held = lambda words: F.greatest(*[F.contains("text", F.lit(w)) for w in words])
    return files.where("text is not null").select("file", *[held(words).alias(kind) for kind, words in TRAITS.items()])


def read_tree(spark: SparkSession, root: str, extensions: list[str] = RULE_EXTENSIONS, limit: int | None = None) -> DataFrame:
    """(file, text) of the source files under a folder, paths relative to it.

    Extensions in any letter case; paths with a part that begins with a dot are left out. With
    `limit` only so many files, the first by path.
    """
    base = root.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .withColumn("file", F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^(?:file:/*)?/*" + base.lstrip("/"), ""))
        .where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(extensions) & ~F.col("file").rlike(r"(^|/)\."))
        .select("file", F.decode("content", "UTF-8").alias("text"))
    )
    return files.orderBy("file").limit(limit) if limit else files


def document_files(documents: DataFrame) -> DataFrame:
    """(file, text) of every document that has an id and a text."""
    return spread(documents.where("doc_id is not null and text is not null").select(F.format_string("doc-%d.c", "doc_id").alias("file"), "text"))


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text), lines numbered from 1; a text that ends with a line feed has an empty last line."""
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")


def vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, VENDOR_DIRS)))


def vendored_hint(path: Column) -> Column:
    """'<folder> (vendored/third-party)' by the first vendor folder above the file; empty for none."""
    parts = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    hit = F.get(F.filter(parts, lambda p: F.lower(p).isin(VENDOR_DIRS)), F.lit(0))
    return F.coalesce(F.concat(hit, F.lit(" (vendored/third-party)")), F.lit(""))


def project_profile(paths: DataFrame, group: str, path: str) -> DataFrame:
    """Counts and shares of a project's files, its build system and whether it has tests.

    One aggregation with partial counts. The suffix decides the kind: c, cc, cxx count as C,
    cpp, hpp, hxx, hh as C++, h as a header.
    """
    p = F.lower(F.col(path))
    suffix = F.regexp_extract(p, r"\.([^./]+)$", 1)
    name = F.regexp_extract(p, r"[^/]*$", 0)
    counted = paths.where(F.col(group).isNotNull() & F.col(path).isNotNull()).select(group, path).distinct().groupBy(group).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(suffix.isin("c", "cc", "cxx")).alias("c_files"),
        F.count_if(suffix.isin("cpp", "hpp", "hxx", "hh")).alias("cpp_files"),
        F.count_if(suffix == "h").alias("header_files"),
        F.count_if(suffix.isin("so", "dylib", "dll")).alias("shared_libraries"),
        F.count_if(suffix == "a").alias("static_libraries"),
        F.count_if(vendored(p)).alias("vendored_files"),
        F.bool_or(p.rlike("test|spec|check")).alias("has_tests"),
        F.max(F.when(name == "cmakelists.txt", 4).when(name == "meson.build", 3).when(name.isin("configure", "configure.ac"), 2).when(name == "makefile", 1).otherwise(0)).alias("_build"),
    )
    build = F.element_at(F.array(*map(F.lit, ["unknown", "make", "autotools", "meson", "cmake"])), F.col("_build") + 1)
    language = F.when(F.col("cpp_files") > F.col("c_files"), "C++").when(F.col("c_files") > 0, "C").otherwise("unknown")
    return counted.withColumns({"build_system": build, "language": language}).drop("_build")
