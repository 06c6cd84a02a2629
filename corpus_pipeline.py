"""Raw documents to sampled token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cistron.llm import cotraining, decontaminate, line_chunks, ngram_join, sentencepiece_sampling
from cistron.llm.common import checkpoint, columns, free_name, quoted, read
from cistron.llm.queries import model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps, all columns as they were; see cotraining.score() for nulls and ties."""
    into, keep = free_name(docs, "quality"), free_name(docs, "keep")
    return cotraining.score(docs, read(spark, sf_dir, "labels"), into=into, keep=keep).where(F.col(quoted(keep))).select(*columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of lines that occur earlier; n_chars is that of the text that is left.

    A null text stays null with its n_chars; a document all of whose lines occur earlier stays, with what is left of it.
    """
    out, row = line_chunks.deduplicate(docs), F.col("row")
    made = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), row["n_chars"].cast("long"))}
    return out.select(*((made[c] if c in made else row.getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 0.8 join (five-word shingles), the one with the smallest id.

    A document without words stays. Rows of one id, or without one, are documents of their own, by the digest of their
    text; a null id comes last. Of rows with equal id and text one stays.
    """
    digest = decontaminate.digest_of(F.col("text"))
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        late = checkpoint(_late(docs))
        few = late.count() <= ngram_join.WANTED
        return docs.join(F.broadcast(late) if few else late, "doc_id", "left_anti").select(*columns(docs))
    # numbers in order of id and digest; fixed by the checkpoint
    ids = docs.select(F.col("doc_id").alias("id"), digest.alias("digest")).distinct().orderBy(F.col("id").asc_nulls_last(), "digest")
    ids = checkpoint(ids.withColumn("node", F.monotonically_increasing_id()))
    packed = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"), digest.alias("digest"))
    named = checkpoint(packed.join(ids, packed["id"].eqNullSafe(ids["id"]) & (packed["digest"] == ids["digest"])).select("node", "row", "body").dropDuplicates(["node"]))
    late = checkpoint(_late(named.select(F.col("node").alias("doc_id"), F.col("body").alias("text"))))
    left = named.join(late, named["node"] == late["doc_id"], "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _late(docs: DataFrame) -> DataFrame:
    """Ids of documents that are not the first of their group."""
    return ngram_join.cluster(docs, size=5, share=(80, 100)).where("doc_id <> component_id").select("doc_id").distinct()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; a null or empty text stays."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"), size=10)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two different sampled segmentations of each document, decoded again and compared with the text; none of a null text."""
    return sentencepiece_sampling.encode(docs, model(spark), k=2, decoded=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]
#: SQL can't express the classifier and the sampling.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is cut off in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
