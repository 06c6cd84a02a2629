"""Chooses the sequences to order for each protein and reports on them.

    python jobs/delivery.py --documents DIR --out DIR [--config jobs/delivery.json]

All sequences are measured and calibrated against themselves. Those that a rule rules out are left aside; from the others
each group gets its best ones, by score and by distance from those chosen already. `out` gets

* board/, Parquet by group: the chosen sequences with rank, scores and a scorecard;
* orders/, tab-separated by group: what a manufacturer needs of them;
* report/, JSON by kind: the chosen ones of each group beside all of its sequences.

A second run on the same tables writes the same rows in place of the first ones.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cistron.functions import codon as C
from cistron.functions import constants as K
from cistron.functions import sequence as S
from cistron.operators import corpus, score, select
from cistron.sources.sequences import derived
from cistron.storage import checkpoint, ship

log = logging.getLogger("delivery")

DEFAULTS = {"top": K.TOP_K, "alpha": K.ALPHA, "least_length": 60, "most_length": 30_000, "score": "score_v25"}
#: By which chosen sequences are to differ.
FEATURES = ["cai", "gc", "enc", "upa", "hp_max", "sites"]
BOARD = "grp string, rank int, seq_id long, source string, score double, z_nat double, z_cai double, z_tai double, cai double, tai double, gc double, gc_low double, gc_high double, sites int, hp4 int, hp5 int, urich int, clean int, te_comp double, cds string"


def configured(given: dict | None) -> dict:
    """Defaults and what is given besides; unknown names are an error."""
    if unknown := set(given or {}) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = DEFAULTS | (given or {})
    if out["top"] < 1 or out["score"] not in ("score_v2", "score_v25"):
        raise ValueError("top is 1 at least, score is score_v2 or score_v25")
    return out


def scored(documents: DataFrame) -> DataFrame:
    """Numbers of all sequences (of repeated ids the least sequence counts), calibrated against all of them; no texts."""
    rows = derived(documents).where("seq_id is not null")
    rows = rows.groupBy("seq_id").agg(F.min(F.struct("cds", "grp", "source")).alias("row")).select("seq_id", "row.grp", "row.source", "row.cds")
    s = F.col("cds")
    rows = score.with_scores(rows)
    rows = rows.withColumns({"length": F.length(s), "enc": C.enc(s), "upa": S.dinuc_odds(s, "T", "A"), "hp_max": S.max_run(s, "ACGT").cast("double"), "clean": S.clean_flag(s)})
    return checkpoint(rows.drop("cds", "raw"))


def board(documents: DataFrame, numbers: DataFrame, config: dict) -> DataFrame:
    """The chosen sequences of each group with their scorecards."""
    able = numbers.where(F.col("length").between(config["least_length"], config["most_length"]))
    picked = select.topk_diverse(able.withColumn("score", F.col(config["score"])), "grp", "score", FEATURES, "hp4", "seq_id", config["top"], config["alpha"])
    chosen = numbers.join(picked.select("seq_id", "rank"), "seq_id")
    texts = derived(documents).join(picked.select("seq_id"), "seq_id", "left_semi").groupBy("seq_id").agg(F.min("cds").alias("cds"))
    s = F.col("cds")
    card = {"score": F.col(config["score"]), "gc_low": S.gc_slide_min(s), "gc_high": S.gc_slide_max(s), "urich": S.urich_count(s), "te_comp": score.te_composite(F.col("cai"), F.col("tai"))}
    columns = [c.split() for c in BOARD.split(", ")]
    return chosen.join(texts, "seq_id").withColumns(card).select(*(F.col(c).cast(t).alias(c) for c, t in columns))


def report(numbers: DataFrame, chosen: DataFrame) -> DataFrame:
    """(kind, grp, n, and means): all sequences and the chosen ones of each group."""
    means = ("z_nat", "cai", "tai", "gc", "sites", "clean")
    both = [df.select("grp", *means).withColumn("kind", F.lit(kind)) for kind, df in (("all", numbers), ("chosen", chosen))]
    return both[0].unionByName(both[1]).groupBy("kind", "grp").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in means))


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> DataFrame:
    """Write board, orders and report; returns the board as written."""
    config = configured(config)
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    numbers = scored(docs)
    log.info("%d sequences measured from %s", numbers.count(), documents)
    board(docs, numbers, config).write.mode("overwrite").partitionBy("grp").parquet(f"{out}/board")
    chosen = spark.read.schema(BOARD).parquet(f"{out}/board")
    order = chosen.select("grp", "rank", "seq_id", F.length("cds").alias("length"), "cds")
    order.write.mode("overwrite").partitionBy("grp").csv(f"{out}/orders", sep="\t", header=True)
    report(numbers, chosen).write.mode("overwrite").partitionBy("kind").json(f"{out}/report")
    log.info("%d sequences chosen; written: %s/board, orders, report", chosen.count(), out)
    return chosen


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(given.config).read_text())
    spark = SparkSession.builder.appName("delivery").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        ship(spark)
        run(spark, given.documents, given.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
