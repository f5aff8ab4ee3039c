"""Order within groups of any size: ranks and neighbours without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.session import broadcast_if_small, cut


#: Rows of a group that one task sorts at most.
WINDOW_ROWS = 200_000


def rank_within(df: DataFrame, group: str, order: list[Column], sizes: DataFrame | None = None) -> DataFrame:
    """Adds `rank`, 1 for the first row of each group in a total order.

    Groups of up to WINDOW_ROWS rows are numbered by a window, one shuffle by group; larger
    ones, which a count finds, by many tasks (`ranked_by_range`). sizes (group, n) may give
    bounds of the groups' sizes that cost less to find; where they show no larger group,
    nothing is written. Else the rows are written once, as they are both counted and numbered.
    """
    numbered = lambda some: some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    if sizes is not None and sizes.where(F.col("n") > WINDOW_ROWS).isEmpty():
        return numbered(df)
    rows = cut(df)
    hot = cut(rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WINDOW_ROWS).select("_g"))
    if hot.isEmpty():
        return numbered(rows)
    is_hot = F.col(group).eqNullSafe(F.col("_g"))
    small = broadcast_if_small(hot)
    return numbered(rows.join(small, is_hot, "left_anti")).unionByName(ranked_by_range(rows.join(small, is_hot, "left_semi"), group, order))


def ranked_by_range(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The same for groups of any size.

    Rows are range-partitioned by group and order; each partition numbers its rows of a group,
    and the counts of the partitions before it are added. They are written before, as sampling
    the bounds reads them twice, and after, as the bounds may differ in every run.
    """
    ranged = cut(df).repartitionByRange(F.col(group).asc_nulls_first(), *order)
    rows = cut(ranged.withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", group).orderBy(*order)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = broadcast_if_small(offsets.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_before"))
    numbered = rows.withColumn("_k", F.row_number().over(local))
    return (
        numbered.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
        .withColumn("rank", F.col("_k") + F.col("_before"))
        .drop("_part", "_k", "_g", "_p", "_before")
    )


def neighbour(ranked: DataFrame, group: str, step: int, columns: dict[str, str], rank: str = "rank") -> DataFrame:
    """Adds columns of the row `step` ranks further on in its group, null where there is none.

    columns: new name -> column. A join on (group, rank), of which each value occurs once, so a
    large group is spread over all tasks where a window would sort it in one.
    """
    other = ranked.select(group, (F.col(rank) - step).alias(rank), *[F.col(c).alias(n) for n, c in columns.items()])
    return ranked.join(other, [group, rank], "left")
