"""What changed between full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import clean
from tracequarry.operators.ordering import neighbour, rank_within
from tracequarry.session import cut, join_on_hot_key


def snapshot_runs(runs: DataFrame) -> DataFrame:
    """The snapshots of each project: (run_id, project_id, snap, snaps, next_run_id).

    Completed runs with a time and a project count, repeated rows once, in order of
    (run_ts, id). Of neighbours that scan the same commit only the last stays; a missing hash
    equals none, an abbreviated hash equals the one it begins.
    """
    order = [F.asc("run_ts"), F.asc("run_id")]
    done = (
        runs.where(clean.word(F.col("status")) == "completed")
        .select(F.col("id").alias("run_id"), "project_id", "run_ts", clean.commit(F.col("commit_hash")).alias("hash"))
        .dropna(subset=["run_id", "project_id", "run_ts"])
        .dropDuplicates(["run_id"])
    )
    beside = neighbour(rank_within(done, "project_id", order), "project_id", 1, {"after": "hash"})
    last = beside.where(~clean.same_commit(F.col("hash"), F.col("after"))).select("run_id", "project_id", "run_ts")
    placed = neighbour(rank_within(last, "project_id", order), "project_id", 1, {"next_run_id": "run_id"})
    sizes = placed.groupBy("project_id").agg(F.max("rank").alias("snaps"))
    return placed.join(sizes, "project_id").select("run_id", "project_id", F.col("rank").cast("int").alias("snap"), F.col("snaps").cast("int").alias("snaps"), "next_run_id")


def diff_snapshots(rows: DataFrame, snapshots: DataFrame, key: str, state: list[Column], prefer: str = "id") -> DataFrame:
    """Changes of `key` from snapshot to snapshot: (run_id, key, change).

    rows: run_id, key and whatever `state` and `prefer` read; each run's rows are its full
    state. Where a run has several rows of a key, the one with the least `prefer` states it.
    change is added, removed or changed, and run_id the later of the two snapshots. Every key
    is windowed by its snapshot's index: a differing hash beside the row before is a change,
    a gap in the index a removal and a later addition. Snapshots without rows count, since
    the index runs over `snapshots`; null keys and rows of other runs never count. The work
    is one shuffle by (project, key), so a run that holds most rows is spread over all tasks;
    the snapshots, a row a run, are broadcast, or beyond a bound met by run and part of the keys.
    """
    hashed = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in state])
    usable = rows.where(F.col(key).isNotNull() & F.col("run_id").isNotNull()).select("run_id", F.col(key), hashed.alias("h"), F.col(prefer).alias("p"))
    placed = (
        join_on_hot_key(usable, cut(snapshots), "run_id", key)
        .groupBy("project_id", F.col(key), "snap", "run_id", "next_run_id", "snaps")
        .agg(F.min_by("h", "p").alias("h"))
    )
    along = Window.partitionBy("project_id", key).orderBy("snap")
    seen = placed.withColumns(
        {"before": F.lag("snap").over(along), "h_before": F.lag("h").over(along), "after": F.lead("snap").over(along)}
    )
    beside = F.coalesce(F.col("before") == F.col("snap") - 1, F.lit(False))
    followed = F.coalesce(F.col("after") == F.col("snap") + 1, F.lit(False))
    change = lambda run, what: F.struct(F.col(run).alias("run_id"), F.lit(what).alias("change"))
    events = F.array(
        F.when((F.col("snap") > 1) & ~beside, change("run_id", "added")),
        F.when(beside & (F.col("h") != F.col("h_before")), change("run_id", "changed")),
        F.when((F.col("snap") < F.col("snaps")) & ~followed, change("next_run_id", "removed")),
    )
    return seen.select(F.col(key), F.explode(F.array_compact(events)).alias("e")).select("e.run_id", key, "e.change")


def finding_changes(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Fingerprints that are new, gone or altered in each snapshot of a project."""
    rows = findings.select("run_id", "id", clean.fingerprint(F.col("fingerprint")).alias("fingerprint"), "severity", "status")
    state = [clean.word(F.col("severity")), clean.word(F.col("status"))]
    return diff_snapshots(rows, snapshot_runs(runs), "fingerprint", state)
