"""Findings as a stream of files: repeated rows dropped, counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import clean


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files of a findings table, existing ones first; the table is a folder or one file."""
    table = spark.read.parquet(path)
    some = table.select("_metadata.file_path").first()
    folder, _, name = path.rstrip("/").rpartition("/")
    single = some is not None and some[0].rstrip("/").endswith("/" + name)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def severity_counts(findings: DataFrame, window: str = "1 day") -> DataFrame:
    """Findings per window of created_at and severity; works on a stream and on a table.

    An id counts once, however late it comes again, and no row is left out for its time, as files
    come in any order; so a stream remembers all ids. Rows without a time are in no window.
    """
    rows = findings.where("created_at is not null and id is not null").select("id", F.col("created_at").cast("timestamp").alias("at"), clean.word(F.col("severity")).alias("severity")).dropDuplicates(["id"])
    return rows.groupBy(F.window("at", window).alias("w"), "severity").agg(F.count(F.lit(1)).alias("findings")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "severity", "findings")


def run_available(counts: DataFrame, target: str, checkpoint: str) -> None:
    """Runs the stream over what is there and writes the counts as Parquet; restarts go on from the checkpoint.

    Each batch writes, under its number, only the windows whose counts it changed, late rows'
    among them; a batch that is run again replaces its own. At the end they are merged.
    """
    changes, written = f"{checkpoint}/changes", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")
        written.append(number)

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start().awaitTermination()
    if written:
        latest(counts.sparkSession, changes).write.mode("overwrite").parquet(target)


def latest(spark: SparkSession, changes: str, key: tuple[str, ...] = ("start", "severity"), value: str = "findings") -> DataFrame:
    """The counts after the last batch: of each window what the latest batch that touched it says."""
    return spark.read.parquet(changes).groupBy(*key).agg(F.max_by(value, "batch").alias(value))
