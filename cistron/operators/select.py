"""Diversity-aware selection: the best of each group, then by score and distance from what is selected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.sequence import let
from ..storage import checkpoint


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _first(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group, by aggregation, so that a large group isn't sorted by one task."""
    least = rows.groupBy(group).agg(F.min(F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), F.struct(*(c for c in rows.columns if c != group)).alias("row"))).alias("best"))
    return least.select(group, "best.row.*")


def topk_diverse(rows: DataFrame, group: str, score: str, features: list[str], burden: str, ident: str, k: int = K.TOP_K, alpha: float = K.ALPHA) -> DataFrame:
    """(group, rank, ident): first the least `burden` among scores close to the best, then the greatest
    alpha * z(score) + (1 - alpha) * distance to the nearest selected row, features z-scaled within the group.

    Ties go to the least ident. Each of the k rounds carries every row's distance to the nearest selected one forward, so
    it compares with the last pick alone; rounds are cut in the shared folder.
    """
    stats = [f(c).alias(f"_{n}_{c}") for c in dict.fromkeys([score, *features]) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    per_group = rows.groupBy(group).agg(F.max(score).alias("_top"), *stats)
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(K.LEAST_STD))
    left = rows.join(per_group, group).select(
        group, F.col(ident).alias("ident"), z(score).alias("z"), F.array(*map(z, features)).alias("v"), F.col(burden).cast("double").alias("burden"), (F.col(score) >= F.col("_top") - K.TIE_BAND).alias("close")
    )
    left = checkpoint(left)
    picked = checkpoint(_first(left.where("close").select(group, "ident", "burden", "v"), group, [F.col("burden"), F.col("ident")]))
    out = [picked.select(group, F.lit(1).alias("rank"), F.col("ident").alias(ident))]
    left = left.select(group, "ident", "z", "v", F.lit(float("inf")).alias("near"))
    for rank in range(2, k + 1):
        last = picked.select(group, F.col("v").alias("w"), F.col("ident").alias("taken"))
        left = left.join(last, group).where("ident <> taken")
        left = checkpoint(left.select(group, "ident", "z", "v", F.least("near", distance(F.col("v"), F.col("w"))).alias("near")))
        value = F.round(alpha * F.col("z") + (1 - alpha) * F.col("near"), 9)
        picked = checkpoint(_first(left.select(group, "ident", "v", value.alias("value")), group, [-F.col("value"), F.col("ident")]))
        out.append(picked.select(group, F.lit(rank).alias("rank"), F.col("ident").alias(ident)))
    return reduce(DataFrame.unionByName, out)


def best_quartile(values: Column) -> Column:
    """Mean of the least quarter of an array, of one value at least; null if it is empty."""
    part = lambda v: F.slice(F.array_sort(v), 1, F.greatest(F.lit(1), F.floor(F.size(v) / 4).cast("int")))
    mean = lambda p: F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.size(p).cast("double"))
    return let(let(values, part), mean)


def topk_rows(candidates: DataFrame, features: list[str], group: str = "protein", ident: str = "cand_id", k: int = K.TOP_K, alpha: float = K.ALPHA) -> DataFrame:
    """The selected candidates with their rank: (group, rank, source, score, z_nat, cai, gc, sites, selfcomp, seq).

    candidates: those columns but rank, `ident` and the features; the first pick has the shortest duplex.
    """
    candidates = checkpoint(candidates)
    picked = topk_diverse(candidates, group, "score", features, "selfcomp", ident, k, alpha)
    out = candidates.join(picked.select(ident, "rank"), ident)
    return out.select(group, "rank", "source", "score", "z_nat", "cai", "gc", "sites", "selfcomp", "seq")


def not_selected(rows: DataFrame, selected: DataFrame, ident: str) -> DataFrame:
    return rows.join(selected.select(ident), ident, "left_anti")
