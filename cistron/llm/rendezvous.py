"""Rendezvous hashing: each record goes to the shard with the best weighted score of (record key, shard).

The score of shard s for key k is -w[s] / ln(u(k, s)), u from a 64-bit hash, so a shard gets rows in proportion to
its weight, and one more shard only takes rows into itself. Everything is a column expression; only the key, the size
and the checksum are shuffled, never a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-ranges of a shard whose rows are numbered by one task each; their counts (shards x SLICES rows) give the offsets.
SLICES = 1024
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard in which `key` belongs; a null key is a key like others."""
    if not weights or min(weights) <= 0:
        raise ValueError("one positive weight for each shard is needed")

    def score(s: int, w: float) -> Column:
        # 52 bits of the hash and a half as a number in (0, 1): no more, or the greatest would round to 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 12).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)
        return F.lit(-float(w)) / F.log(u)

    best = F.greatest(*(F.struct(score(s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights))) if len(weights) > 1 else F.struct(F.lit(0).alias("shard"))
    return (-best["shard"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: shard, a gapless slot from 0 within the shard, and its shard among `grown`.

    A null text counts as empty (checksum 0, 16 bytes); a null id is a key of its own. Equal rows get one slot each, in
    no fixed order among themselves. A text of any length is only measured. Other columns of `docs` are not looked at. No
    rows give no rows.
    """
    key = F.col(doc_id)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        key.alias("doc_id"),
        (F.length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        F.pmod(F.xxhash64(key, F.crc32(body), F.length(body)), F.lit(SLICES)).cast("int").alias("slice"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    counts = rows.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within))
    # starts has len(weights) * SLICES rows at most, whatever the input
    return numbered.join(F.broadcast(starts), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard"
    )
