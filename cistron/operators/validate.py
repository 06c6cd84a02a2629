"""Validation of scores against measurements: rank correlation with ties, and its interval by a Poisson bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpoint

#: Replicates of the bootstrap, the share of them outside the interval, and the most that a row counts in one.
REPLICATES, OUTSIDE, MOST = 40, 0.1, 6


def average_ranks(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, rank): mean rank, from 1, of all rows with each value, within its group. Null values have none.

    Equal values are counted first, so a tie is one row however many rows it has. Values are dealt in ranges, added up within
    a range, and a range goes on from the counts of the ranges before it: no task sorts a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = checkpoint(counts.repartitionByRange(group, value).withColumn("_range", F.spark_partition_id()))  # fixes the ranges
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_range").agg(F.sum("_n").alias("_all")).select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    both = placed.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return both.select(group, value, (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))


def _poisson(ident: Column, replicate: Column) -> Column:
    """How often a row counts in a replicate: Poisson with mean 1, from a hash of the two."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", ident.cast("string"), replicate.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    return sum((F.when(number >= sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)), 1).otherwise(0) for n in range(MOST)), F.lit(0))


def _correlation(w: Column, x: Column, y: Column) -> Column:
    """Of rows that count w times; null if one of the two doesn't vary."""
    n, a, b = F.nullif(F.sum(w), F.lit(0.0)), F.sum(w * x), F.sum(w * y)
    variance = (F.sum(w * x * x) - a * a / n) * (F.sum(w * y * y) - b * b / n)
    return F.when(variance > 1e-9, (F.sum(w * x * y) - a * b / n) / F.sqrt(variance))


def rank_correlation(rows: DataFrame, group: str, ident: str, score: str, measured: str, replicates: int = REPLICATES) -> DataFrame:
    """(group, n, spearman, low, high): rank correlation of two columns, and the bounds between which replicates lie.

    Rows with a null in either don't count. Replicates weigh rows at random by their ident and keep ranks, so that all of them
    take one pass; low and high are the means of the replicates that are `OUTSIDE` / 2 from either end and their neighbours.
    """
    rows = rows.select(group, ident, score, measured).where(F.col(score).isNotNull() & F.col(measured).isNotNull())
    for column, name in ((score, "_x"), (measured, "_y")):
        ranks = average_ranks(rows.select(group, F.col(column).cast("double").alias("_v")), group, "_v").select(F.col(group).alias("_g"), F.col("_v"), F.col("rank").alias(name))
        rows = rows.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & (F.col(column).cast("double") == F.col("_v"))).drop("_g", "_v")
    ranked = checkpoint(rows.select(group, ident, "_x", "_y"))  # numbers only
    whole = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), _correlation(F.lit(1.0), F.col("_x"), F.col("_y")).alias("spearman"))
    drawn = ranked.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.groupBy(group, "_b").agg(_correlation(_poisson(F.col(ident), F.col("_b")).cast("double"), F.col("_x"), F.col("_y")).alias("r"))
    edge = max(1, round(replicates * OUTSIDE / 2))
    ends = drawn.groupBy(F.col(group).alias("_g")).agg(F.sort_array(F.collect_list("r")).alias("r"))  # a bounded number
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    out = whole.join(ends, F.col(group).eqNullSafe(F.col("_g")))
    some = F.size("r") >= 2 * edge
    return out.select(group, "n", "spearman", F.when(some, mean(F.slice("r", 1, 2 * edge))).alias("low"), F.when(some, mean(F.slice("r", F.size("r") - 2 * edge + 1, 2 * edge))).alias("high"))
