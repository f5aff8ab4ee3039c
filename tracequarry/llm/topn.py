"""The N best rows of every group, by bisecting all groups' cutoffs at once.

A row's code is its score, as 64 bits in the order of the numbers, followed by its identifier,
64 bits turned round so that the smaller one is higher. Codes are compared as wholes; each pass
cuts the interval that still holds a group's cutoff into cells of its next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.session import broadcast_if_small, cut

#: Midpoints laid over each group's interval in one pass (a power of two), and the open groups
#: up to which the table of intervals (some 60 bytes a group) is broadcast.
CELLS = 64
BROADCAST_GROUPS = 100_000
#: Beyond those, rows meet their group's interval by shuffle, a group of more rows in several parts.
HOT_ROWS = 1_000_000
_LEAST = -(2**63)


def ordered_bits(number: Column) -> Column:
    """A double as a long of the same order, from -Infinity to Infinity; -0.0 equals 0.0."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def _cell(cells: int) -> Column:
    """A row's cell: the next bits of its code after those that both ends of its group's interval share."""
    bits = max(1, cells.bit_length() - 1)
    pick = lambda a, b: F.when(F.col("s_lo") < F.col("s_hi"), F.col(a)).otherwise(F.col(b))
    differ = F.length(F.bin(pick("s_lo", "t_lo").bitwiseXOR(pick("s_hi", "t_hi"))))
    moved = F.call_function("shiftrightunsigned", pick("s", "t").bitwiseXOR(F.lit(_LEAST)), F.greatest(differ - bits, F.lit(0)))
    return moved.bitwiseAND(F.lit(2**bits - 1)).cast("int")


class Coded:
    """Rows g, s, t (group and both halves of the code) that can meet a small row of each group."""

    def __init__(self, base: DataFrame):
        ends = [f(c).alias(f"{c}_{e}") for c in ("s", "t") for f, e in ((F.min, "lo"), (F.max, "hi"))]
        self.ends = ends
        self.rows = base.persist()
        self.groups = cut(self.rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), *ends))
        self.parted = self.groups.count() > BROADCAST_GROUPS
        if self.parted:
            hot = self.groups.where(F.col("c") > HOT_ROWS).select("g", F.ceil(F.col("c") / HOT_ROWS).alias("parts"))
            part = F.pmod(F.xxhash64("t"), F.coalesce("parts", F.lit(1))).alias("part")
            self.whole, self.rows = self.rows, self.rows.join(broadcast_if_small(hot), "g", "left").select("g", "s", "t", part).repartition("g", "part").persist()

    def meet(self, state: DataFrame, size: int) -> DataFrame:
        """The rows with their group's columns of `state`, which has c, the group's size.

        A state of few groups is broadcast. A larger one is shuffled to where the rows already
        lie, by group and part, so that no task holds more than about HOT_ROWS rows of a group.
        """
        if size <= BROADCAST_GROUPS or not self.parted:
            return self.rows.join(F.broadcast(state), "g")
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / HOT_ROWS) - 1)).alias("part")
        return self.rows.join(state.select("*", parts), ["g", "part"])

    def close(self) -> None:
        self.rows.unpersist()
        if self.parted:
            self.whole.unpersist()


def cutoffs(rows: Coded, n: int, cells: int = CELLS) -> DataFrame:
    """(g, size, s_cut, t_cut): exactly min(n, size) rows of group g have s > s_cut, or s = s_cut and t >= t_cut.

    (g, t) is unique. Each pass counts every open group's rows above the midpoints of its
    interval, goes on with the one cell that holds the cutoff, narrowed to the codes that occur
    in it, and closes the groups for which the rows above a midpoint are as many as still
    needed. A pass settles a cell's bits of the code at least, so 64 cells need 22 passes at
    most, whatever the scores. Counts are combined before the shuffle (at most `cells` rows a
    group and task), so a group of any size never meets in one task.
    """
    whole, ends = rows.groups, rows.ends
    done = [whole.where(F.col("c") <= n).select("g", F.col("c").alias("size"), F.col("s_lo").alias("s_cut"), F.lit(_LEAST).alias("t_cut"))]
    state = whole.where(F.col("c") > n).select("g", F.col("c").alias("size"), F.lit(n).cast("long").alias("need"), "s_lo", "s_hi", "t_lo", "t_hi")
    down = Window.partitionBy("g").orderBy(F.desc("cell"))
    while opened := state.count():
        inside = rows.meet(state, opened).where("s between s_lo and s_hi and t between t_lo and t_hi")
        counted = inside.withColumn("by_id", F.col("s_lo") == F.col("s_hi")).groupBy("g", "size", _cell(cells).alias("cell"), "need", "by_id").agg(F.count(F.lit(1)).alias("c"), *ends)
        hit = (
            counted.withColumn("upto", F.sum("c").over(down))
            .where((F.col("upto") - F.col("c") < F.col("need")) & (F.col("upto") >= F.col("need")))
            .withColumn("need", F.col("need") - F.col("upto") + F.col("c"))
        )
        hit = cut(hit.select("g", "size", "need", "by_id", "c", "s_lo", "s_hi", "t_lo", "t_hi"))
        last = F.when(F.col("by_id"), F.col("t_lo")).otherwise(F.lit(_LEAST))
        done.append(hit.where("need = c").select("g", "size", F.col("s_lo").alias("s_cut"), last.alias("t_cut")))
        state = hit.where("need < c").select("g", "size", "need", "s_lo", "s_hi", "t_lo", "t_hi")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def top_n_per_group(rows: DataFrame, group: str, score: str, ident: str, n: int, cells: int = CELLS) -> DataFrame:
    """(group, ident, score) of the n rows of each group with the highest score, smaller ident first.

    Rows without group, ident or score (null or NaN) never count, infinite scores do; rows
    repeated with the same ident count once (with their highest score, should they differ). A
    group of fewer rows keeps them all; an empty table gives an empty table; other columns are
    not looked at.
    """
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    once = (
        rows.where(F.col(group).isNotNull() & F.col(ident).isNotNull() & usable)
        .groupBy(F.col(group).alias("g"), F.col(ident).cast("long").alias("i"))
        .agg(F.max(F.col(score).cast("double")).alias("x"))
    )
    coded = Coded(once.select("g", ordered_bits(F.col("x")).alias("s"), F.bitwise_not("i").alias("t")))
    limits = cut(cutoffs(coded, n, cells))
    kept = cut(coded.meet(limits, limits.count()).where("s > s_cut or (s = s_cut and t >= t_cut)").select("g", "s", F.bitwise_not("t").alias("i")))
    coded.close()
    return kept.select(F.col("g").alias(group), F.col("i").alias(ident), number_of(F.col("s")).alias(score))


def number_of(code: Column) -> Column:
    """The double of an `ordered_bits` code."""
    bits = F.when(code >= 0, code).otherwise(code.bitwiseXOR(F.lit(2**63 - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The findings of each run with the highest priority_score; only numbers from 0 to 10 are scores."""
    return top_n_per_group(findings.where(F.col("priority_score").between(0.0, 10.0)), "run_id", "priority_score", "id", n)
