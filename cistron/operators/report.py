"""Summaries and comparison tables, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint

METRICS = ("n", "z_nat", "cai", "gc", "clean", "selfcomp", "mfe", "tai")


def refine_summary(rows: DataFrame, group: str = "protein") -> DataFrame:
    """Starts, gains and penalties before and after refinement, by group."""
    sums = [F.sum(c).alias(f"{c}_sum") for c in ("sites_start", "sites_end", "hp4_start", "hp4_end")]
    mean = F.round(F.avg("delta"), 3).alias("delta_mean")
    return rows.groupBy(group).agg(F.count("lam_start").alias("n_starts"), mean, F.round(F.max("delta"), 3).alias("delta_max"), *sums, F.sum("hard_pass_end").alias("hard_pass")).orderBy(group)


def compare_stats(rows: DataFrame, engine: str = "engine") -> DataFrame:
    """Number of rows and means of the metrics by engine; nulls don't count."""
    means = {"z_nat": F.avg("z_nat"), "cai": F.avg("cai"), "gc": F.avg("gc"), "clean": 100 * F.avg(F.col("clean").cast("double")), "selfcomp": F.avg("selfcomp"), "mfe": F.avg("mfe"), "tai": F.avg("tai")}
    return rows.groupBy(engine).agg(F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in means.items()))


def compare_pivot(stats: DataFrame, engines: list[str], engine: str = "engine") -> DataFrame:
    """A row for each metric, a column for each engine."""
    long = stats.select(engine, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))).alias("x"))
    return long.select(engine, "x.*").groupBy("metric").pivot(engine, engines).agg(F.first("value"))


def repair_report(rows: DataFrame) -> DataFrame:
    """Of repaired rows: how many, mean longest duplex before and after, mean and least change of score."""
    delta = F.col("score_after") - F.col("score_before")
    return rows.where("n_swaps > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("selfcomp_before").alias("before_mean"), F.avg("selfcomp_after").alias("after_mean"), F.avg(delta).alias("delta_mean"), F.min(delta).alias("delta_min"))


def with_columns_appended(rows: DataFrame, added: DataFrame, path: str, key: str) -> DataFrame:
    """rows with the columns of `added` after their own, written to a new path; never to one that rows come from."""
    new = [c for c in added.columns if c == key or c not in rows.columns]
    out = rows.join(added.select(*new), key, "left")
    out.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def of_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(F.col("source") == source)


def union_schema(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Rows of all parts under the union of their columns, with the part's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(label, F.lit(name)) for name, df in parts.items()))


def write_tsv(rows: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Tab-separated files with a header; with `fields`, only those and in that order. Never to a path that rows come from."""
    (rows.select(*fields) if fields else rows).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_resumable(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Add to a Parquet table what it doesn't have yet, by the keys (null is a key like others); the rows that were added.

    The rows are fixed by a checkpoint, so that what is returned is what was written. Keys keep their types, as they stay
    columns of the files.
    """
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        known = spark.read.schema(rows.schema).parquet(path).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        rows = rows.join(known, same, "left_anti")
    rows = checkpoint(rows)
    rows.write.mode("append").parquet(path)
    return rows


def formatted(value: Column) -> Column:
    """Three decimals, a dash for null."""
    return F.when(value.isNull(), "-").otherwise(F.format_number(value, 3))
