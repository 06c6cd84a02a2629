"""Takes new coding sequences into a corpus: a stream of files, run until nothing is new.

    python jobs/corpus_intake.py --documents DIR --out DIR --checkpoint DIR [--config jobs/corpus_intake.json]

Each new file's texts become sequences. A sequence that its source already has is a duplicate of the first one, one that
breaks a manufacturing rule is rejected with the reasons, all others are accepted. `out` gets

* sequences/, Parquet by batch, verdict and group: every sequence taken, with what was measured;
* pairs/, Parquet by batch: codon pairs of the accepted sequences;
* usage/, Parquet by first codon: pairs of the whole corpus, with share and log ratio to what their codons let expect.

What is new is known by the stream's checkpoint. A batch that is repeated after a failure writes the same partitions again,
and compares with earlier batches alone, so the corpus is the same as without the failure. Of the corpus so far only the
digests are read; codon pairs are added up from counts of each batch.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cistron.functions import codon as C
from cistron.functions import constants as K
from cistron.functions import sequence as S
from cistron.operators import corpus
from cistron.sources.sequences import derived
from cistron.storage import ship

log = logging.getLogger("corpus_intake")

DEFAULTS = {"least_length": 60, "gc": [0.3, 0.7], "gc_window": [0.2, 0.8], "most_sites": 0, "most_long_runs": 0, "files_per_batch": 500, "max_file_age": "3650d"}
SEQUENCES = "batch long, verdict string, grp string, seq_id long, source string, cds string, digest string, first_id long, reasons string, length int, gc double, gc_low double, gc_high double, sites int, long_runs int, cai double"
PAIRS = "batch long, pair string, n long"


def configured(given: dict | None) -> dict:
    """Defaults and what is given besides; unknown names are an error."""
    if unknown := set(given or {}) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return DEFAULTS | (given or {})


def judged(rows: DataFrame, config: dict) -> DataFrame:
    """What is measured of each sequence, and the rules that it breaks, comma-joined in their order."""
    s = F.col("cds")
    measures = {"length": F.length(s), "gc": S.gc_content(s), "gc_low": S.gc_slide_min(s), "gc_high": S.gc_slide_max(s), "sites": S.motif_count(s), "long_runs": S.n_hp5(s), "cai": C.cai(s)}
    rows = rows.withColumns(measures)
    low, high = config["gc_window"]
    broken: dict[str, Column] = {
        "id": F.col("seq_id").isNull(),
        "length": F.col("length") < config["least_length"],
        "gc": ~F.col("gc").between(*config["gc"]),
        "gc_window": (F.col("gc_low") < low) | (F.col("gc_high") > high),
        "sites": F.col("sites") > config["most_sites"],
        "runs": F.col("long_runs") > config["most_long_runs"],
    }
    return rows.withColumn("reasons", F.concat_ws(",", *(F.when(c, n) for n, c in broken.items())))


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is at a path so far, no rows if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _known(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    """First sequences of each source and digest in earlier batches."""
    if not batch:
        return None
    rows = written(spark, f"{out}/sequences", SEQUENCES).where((F.col("batch") < batch) & (F.col("verdict") != "duplicate") & F.col("seq_id").isNotNull())
    return rows.select(F.col("source").alias("k_source"), F.col("digest").alias("k_digest"), F.col("seq_id").alias("known_id"))


def _same(source: str, digest: str) -> Column:
    return F.col("source").eqNullSafe(F.col(source)) & (F.col("digest") == F.col(digest))


def verdicts(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows with first_id, the first sequence like each in its source, and verdict.

    Of sequences that come together the least id is the first. A row that is repeated with its id counts once; rows without
    id are rejected, each by itself.
    """
    rows = rows.withColumn("digest", F.sha2("cds", 256))
    firsts = rows.where("seq_id is not null").groupBy(F.col("source").alias("f_source"), F.col("digest").alias("f_digest")).agg(F.min("seq_id").alias("least_id"))
    own = F.when(F.col("seq_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("own", own).dropDuplicates(["seq_id", "source", "digest", "own"]).drop("own")
    rows = rows.join(firsts, _same("f_source", "f_digest"), "left")
    if known is not None:
        rows = rows.join(known, _same("k_source", "k_digest"), "left")
    else:
        rows = rows.withColumn("known_id", F.lit(None).cast("long"))
    first = F.coalesce("known_id", "least_id")
    later = F.col("known_id").isNotNull() | (F.col("least_id") < F.col("seq_id"))
    verdict = F.when(F.col("seq_id").isNotNull() & later, "duplicate").when(F.col("reasons") != "", "rejected").otherwise("accepted")
    return rows.withColumn("first_id", F.when(F.col("seq_id").isNotNull(), first)).withColumn("verdict", verdict)


def take(rows: DataFrame, batch: int, out: str, config: dict) -> dict[str, int]:
    """One batch of documents into `out`; how many sequences got which verdict."""
    spark = rows.sparkSession
    columns = [c.split()[0] for c in SEQUENCES.split(", ")]
    made = verdicts(judged(derived(rows), config), _known(spark, out, batch)).withColumn("batch", F.lit(batch))
    write = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
    write(made.select(*columns), "sequences", "batch", "verdict", "grp")
    taken = written(spark, f"{out}/sequences", SEQUENCES).where(F.col("batch") == batch)
    write(corpus.pair_counts(taken.where("verdict = 'accepted'")).withColumn("batch", F.lit(batch)), "pairs", "batch")
    return {r.verdict: r["count"] for r in taken.groupBy("verdict").count().collect()}  # three rows at most


def usage(spark: SparkSession, out: str) -> DataFrame:
    """(first, second, n, share, log_ratio) of the corpus' codon pairs, 4,096 rows at most."""
    counts = written(spark, f"{out}/pairs", PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))
    mono = corpus.mono_frequencies(counts)
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.select(F.substring("pair", 1, 3).alias("first"), F.substring("pair", 4, 3).alias("second"), "n").crossJoin(F.broadcast(total))
    for side in ("first", "second"):
        rows = rows.join(F.broadcast(mono.select(F.col("codon").alias(side), F.col("f").alias(f"f_{side}"))), side)
    share = F.col("n") / F.col("total")
    return rows.select("first", "second", "n", share.alias("share"), F.log(share / (F.col("f_first") * F.col("f_second"))).alias("log_ratio"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new in `documents`, then return all sequences taken so far."""
    config, counts = configured(config), []

    def each(rows: DataFrame, batch: int) -> None:
        found = take(rows, batch, out, config)
        counts.append(sum(found.values()))
        log.info("batch %d: %d sequences read from %s, written to %s/sequences: %s", batch, sum(found.values()), documents, out, dict(sorted(found.items())))

    # a path may be a folder or one file; columns are those of the files
    files = {"recursiveFileLookup": "true"}
    schema = spark.read.options(**files).parquet(documents).schema
    stream = spark.readStream.schema(schema).options(**files, maxFilesPerTrigger=config["files_per_batch"], maxFileAge=config["max_file_age"]).parquet(documents)
    query = stream.select("doc_id", "text", "lang", "source").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("%d new batches, %d sequences", len(counts), sum(counts))
    if counts:
        usage(spark, out).write.mode("overwrite").partitionBy("first").parquet(f"{out}/usage")
        log.info("written: %s/usage", out)
    return written(spark, f"{out}/sequences", SEQUENCES)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(given.config).read_text())
    spark = SparkSession.builder.appName("corpus_intake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        ship(spark)
        run(spark, given.documents, given.out, given.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
