"""The jobs as queries over whole tables, each run twice into one new folder, and the SQL to which they are held."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cistron.functions import constants as K
from cistron.plans import sql as Q
from cistron.plans.queries import rounded, topk_sql, widened
from cistron.storage import scratch

from . import corpus_intake, delivery


def job1_corpus_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences taken in by two runs of the stream, the second of which finds nothing new."""
    folder = scratch(spark, "job1")
    for _ in range(2):
        out = corpus_intake.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return widened(rounded(out.withColumn("cds_md5", F.md5("cds")).drop("batch", "cds", "digest")))


def job2_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after two runs into one folder."""
    folder = scratch(spark, "job2")
    for _ in range(2):
        out = delivery.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out")
    return widened(rounded(out.withColumn("cds_md5", F.md5("cds")).drop("cds")))


def _intake_sql() -> str:
    c = corpus_intake.DEFAULTS
    low, high = c["gc_window"]
    broken = {
        "length": f"length < {c['least_length']}",
        "gc": f"NOT gc BETWEEN {c['gc'][0]} AND {c['gc'][1]}",
        "gc_window": f"lo < {low} OR hi > {high}",
        "sites": f"sites > {c['most_sites']}",
        "runs": f"long_runs > {c['most_long_runs']}",
    }
    reasons = f"concat_ws(',', {', '.join(f"CASE WHEN {w} THEN '{n}' END" for n, w in broken.items())})"
    return f"""WITH {Q.SEQS}, {Q.CODON}, {Q.CDS_CODONS}, {Q.CAI}, {Q.slide('cds')},
m AS (SELECT seqs.*, length(cds) AS length, {Q.gc('cds')} AS gc, lo, hi, {Q.sites('cds')} AS sites, {Q.runs('cds', 5)} AS long_runs, cai,
  min(seq_id) OVER (PARTITION BY source, cds) AS first_id FROM seqs JOIN cai USING (seq_id) JOIN slide USING (seq_id)),
r AS (SELECT *, {reasons} AS reasons FROM m)
SELECT CASE WHEN first_id < seq_id THEN 'duplicate' WHEN reasons <> '' THEN 'rejected' ELSE 'accepted' END AS verdict, grp, seq_id, source, first_id, reasons, length::BIGINT AS length,
  round(gc, 6) AS gc, round(lo, 6) AS gc_low, round(hi, 6) AS gc_high, sites::BIGINT AS sites, long_runs::BIGINT AS long_runs, round(cai, 6) AS cai, md5(cds) AS cds_md5 FROM r"""


def _delivery_sql() -> str:
    c = delivery.DEFAULTS
    parts = ("z_nat", "z_cai", "z_tai", "cai", "tai", "gc")
    numbers = ", ".join(f"round({p}, 6) AS {p}" for p in parts)
    return topk_sql(
        c["score"],
        f"length(cds) BETWEEN {c['least_length']} AND {c['most_length']}",
        f"{Q.slide('cds')}, {Q.urich('cds')}",
        f"SELECT s.grp, s.rank, s.seq_id, source, round({c['score']}, 6) AS score, {numbers}, round(lo, 6) AS gc_low, round(hi, 6) AS gc_high, sites::BIGINT AS sites, hp4::BIGINT AS hp4, hp5::BIGINT AS hp5, urich::BIGINT AS urich, "
        f"(sites = 0 AND hp5 = 0)::BIGINT AS clean, round(0.6 * cai + 0.4 * coalesce(tai, 0), 3) AS te_comp, md5(cds) AS cds_md5 "
        f"FROM s{K.TOP_K} s JOIN scored USING (seq_id) JOIN slide USING (seq_id) JOIN urich USING (seq_id)",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_corpus_intake, job2_delivery)}


def oracle_sql() -> dict[str, str]:
    return {"job1_corpus_intake": _intake_sql(), "job2_delivery": _delivery_sql()}
