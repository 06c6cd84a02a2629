"""Corpus statistics: codon pairs, their smoothed log-likelihood, and calibration of metrics against the corpus.

Codon pairs are counted within each task before they are added up. A pair table has 4,096 numbers, so it goes to all tasks
as one array, and what is measured by it needs no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codon as C
from ..functions import constants as K
from ..functions import letters as L
from ..functions.sequence import codon_pairs
from ..storage import checkpoint


def pair_rows(seqs: DataFrame, seq: str = "cds") -> DataFrame:
    """(seq_id, pair): all codon pairs of each sequence."""
    return seqs.select("seq_id", F.explode(codon_pairs(F.col(seq))).alias("pair"))


def pair_counts(seqs: DataFrame, seq: str = "cds") -> DataFrame:
    """(pair, n) over all sequences: counts of each task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = np.zeros(64 * 64, np.int64), Counter()
        for batch in batches:
            for part in L.portions(batch.column(0)):
                t = L.Texts(part)
                row, pair = t.pairs()
                known += np.bincount(pair[pair >= 0], minlength=64 * 64)
                # pairs with other letters, which a coding sequence doesn't have
                place = np.arange(len(row)) - np.searchsorted(row, row)
                for r, p in zip(row[pair < 0].tolist(), place[pair < 0].tolist(), strict=True):
                    other[part[r].as_py()[3 * p : 3 * p + 6]] += 1
        at = np.flatnonzero(known).tolist()
        pairs = [C.ALL[i // 64] + C.ALL[i % 64] for i in at] + list(other)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array([*known[at].tolist(), *other.values()], pa.int64())], names=["pair", "n"])

    return seqs.select(F.col(seq).alias("seq")).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def total_pairs(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def mono_frequencies(counts: DataFrame) -> DataFrame:
    """(codon, n, f): codons by the pairs they are in; each pair counts for both of its codons."""
    both = counts.select(F.explode(F.array(F.substring("pair", 1, 3), F.substring("pair", 4, 3))).alias("codon"), "n")
    mono = both.groupBy("codon").agg(F.sum("n").alias("n"))
    return mono.crossJoin(F.broadcast(mono.agg(F.sum("n").alias("all")))).select("codon", "n", (F.col("n") / F.col("all")).alias("f"))


def _as_array(values: DataFrame, value: str) -> tuple[np.ndarray, int]:
    """`value` of (pair, n, value) rows, 4,096 at most, by the pair's number, NaN for pairs without; and the sum of n over all rows."""
    place = C.number(F.substring("pair", 1, 3)) * 64 + C.number(F.substring("pair", 4, 3))
    valid = (C.number(F.substring("pair", 1, 3)) >= 0) & (C.number(F.substring("pair", 4, 3)) >= 0)
    rows = values.groupBy(F.when(valid, place).alias("at")).agg(F.sum("n").alias("n"), F.first(F.col(value).cast("double")).alias("v")).collect()
    out = np.full(64 * 64, np.nan)
    for r in rows:
        if r["at"] is not None:
            out[r["at"]] = np.nan if r["v"] is None else r["v"]
    return out, sum(r["n"] for r in rows)


def mean_log_probability(counts: DataFrame) -> Callable[[Column], Column]:
    """Of a sequence: the mean smoothed log-probability of its pairs by the counts; 0 without pairs."""
    n, total = _as_array(counts, "n")
    logs = np.log((np.nan_to_num(n) + 1) / (total + K.PAIR_VOCABULARY))
    return lambda s: C.mean_by_pair(s, logs, float(np.log(1 / (total + K.PAIR_VOCABULARY))))


def with_naturalness(seqs: DataFrame, counts: DataFrame, seq: str = "cds") -> DataFrame:
    """seqs and nat, as mean_log_probability() gives it."""
    return seqs.withColumn("nat", mean_log_probability(counts)(F.col(seq)))


def naturalness(seqs: DataFrame, counts: DataFrame, seq: str = "cds") -> DataFrame:
    """(seq_id, nat)."""
    return with_naturalness(seqs.select("seq_id", seq), counts, seq).select("seq_id", "nat")


def codon_pair_bias(seqs: DataFrame, counts: DataFrame, seq: str = "cds") -> DataFrame:
    """(seq_id, cpb): mean log ratio of a pair's frequency and its codons'; pairs that the corpus lacks don't count."""
    counts = checkpoint(counts)
    mono = mono_frequencies(counts)
    total = counts.agg(F.sum("n").alias("total"))
    left, right = (mono.select(F.col("codon").alias(c), F.col("f").alias(f)) for c, f in (("a", "fa"), ("b", "fb")))
    scores = counts.select(F.substring("pair", 1, 3).alias("a"), F.substring("pair", 4, 3).alias("b"), "pair", "n")
    scores = scores.join(F.broadcast(left), "a").join(F.broadcast(right), "b").crossJoin(F.broadcast(total))
    scores = scores.select("pair", "n", F.log((F.col("n") / F.col("total")) / (F.col("fa") * F.col("fb"))).alias("cps"))
    return seqs.select("seq_id", C.mean_by_pair(F.col(seq), _as_array(scores, "cps")[0]).alias("cpb"))


def measured(seqs: DataFrame, counts: DataFrame | None = None, seq: str = "cds", more: Callable[[L.Together], dict[str, int]] = lambda s: {}) -> DataFrame:
    """seqs and cai, tai, nat against the counts (by default of the sequences themselves), and `more` measures of the same look."""
    nat = mean_log_probability(counts if counts is not None else pair_counts(seqs, seq))
    return seqs.withColumns(L.together(F.col(seq), lambda s: {"nat": nat(s), "cai": C.cai(s), "tai": C.tai(s)} | more(s)))


def calibration(rows: DataFrame) -> DataFrame:
    """One row: mean and population deviation of nat, cai and (where defined) tai, and how many tai there are."""
    parts = [f(c).alias(f"{c}_{n}") for c in ("nat", "cai", "tai") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return rows.agg(*parts, F.count("tai").alias("tai_n"))


def save_calibration(stats: DataFrame, path: str) -> None:
    """One row of statistics as Parquet, to score other tables with."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    stats = spark.read.parquet(path)
    if stats.count() != 1:
        raise ValueError("a calibration is one row")
    return stats


def z_scores(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows and z_nat, z_cai, z_tai (an undefined tai counts as 0) against one row of statistics; null where those don't vary."""
    z = lambda x, c: F.try_divide(x - F.col(f"{c}_mean"), F.nullif(F.col(f"{c}_std"), F.lit(0.0)))
    out = rows.crossJoin(F.broadcast(stats))
    out = out.withColumn("z_nat", z(F.col("nat"), "nat")).withColumn("z_cai", z(F.col("cai"), "cai"))
    return out.withColumn("z_tai", z(F.coalesce("tai", F.lit(0.0)), "tai")).drop(*stats.columns)


def group_z(rows: DataFrame, group: str, column: str) -> DataFrame:
    """rows and z_<column> within each group, with a floor under the deviation. Means come from one aggregate of each group."""
    stats = rows.groupBy(group).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    z = (F.col(column) - F.col("_mean")) / F.greatest("_std", F.lit(K.LEAST_STD))
    return rows.join(stats, group).withColumn(f"z_{column}", z).drop("_mean", "_std")


def codon_histogram(seqs: DataFrame, seq: str = "cds") -> DataFrame:
    """(seq_id, aa, codon, n)."""
    rows = seqs.select("seq_id", F.explode(C.codons(F.col(seq))).alias("codon"))
    return rows.groupBy("seq_id", "codon").agg(F.count(F.lit(1)).alias("n")).select("seq_id", C.amino(F.col("codon")).alias("aa"), "codon", "n")


def longest_per_gene(rows: DataFrame, gene: str, cds: str, order: str) -> DataFrame:
    """The longest sequence of each gene, the first one by `order` among equals."""
    return rows.groupBy(gene).agg(F.max_by(cds, F.struct(F.length(cds), -F.col(order))).alias(cds))


def native_starts(corpus: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein, seq): of each protein's gene the longest sequence, if it translates to the protein.

    corpus: (row_id, gene_symbol, cds); proteins: (protein, gene_symbol, aa).
    """
    best = longest_per_gene(corpus.join(proteins.select("gene_symbol").distinct(), "gene_symbol", "left_semi"), "gene_symbol", "cds", "row_id")
    trimmed = best.withColumn("seq", F.regexp_replace("cds", f"({'|'.join(K.STOPS)})$", ""))
    return trimmed.join(proteins, "gene_symbol").where(C.check_translate(F.col("seq"), F.col("aa"))).select("protein", "seq")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`. Keys meet by 128-bit digests, and no group is sorted."""
    digest = [F.md5(F.col(k).cast("string")).alias(f"_{i}") for i, k in enumerate(keys)]
    least = rows.groupBy(*digest).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return least.select("_row.*")
