"""Session helpers: a tuned local session and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracequarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "1000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir. Whether files of tables no longer used are
    removed is the session's spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    Where none is set, a local session gets a temporary one, removed when Python ends; on a
    cluster that is an error, as a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a slim table (some 50 bytes a row) is sent to every executor.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast if counting shows no more than so many rows; else joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Copies of each row of a table too large to broadcast, so that a hot key on the other side is split.
SALTS = 16


def join_on_hot_key(rows: DataFrame, other: DataFrame, key: str | list[str], within: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` with what `other`, few rows a key, says of `key`, of which one value may hold a third of all rows.

    `other` is broadcast if counting shows `most` rows at most; else rows of a key are split by
    `within` over SALTS tasks, each with a copy of the key's rows.
    """
    key = [key] if isinstance(key, str) else key
    small = broadcast_if_small(other, most)
    if small is not other:
        return rows.join(small, key, how)
    salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(within), F.lit(SALTS)).cast("int")).join(salted, [*key, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many tasks as there are cores, for costly work on rows of few large files.

    Where the scan gives enough tasks, which is the case for large tables, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def width(spark: SparkSession) -> int:
    """Tasks for costly work after a shuffle: a number that adaptive execution leaves as it is."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
