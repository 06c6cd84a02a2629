"""Queries of this subpackage by name, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, cotraining, decontaminate, line_chunks, ngram_join, pii_surrogates, rendezvous, rlz_dedup, sentencepiece_sampling, spotsigs, suffix_dedup, token_counts
from .common import read

#: Public vocabulary file, read on the driver alone; the setting spark.cistron.pieceModel names another one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def model(spark: SparkSession) -> str:
    return spark.conf.get("spark.cistron.pieceModel", MODEL)


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two different sampled segmentations of each document, decoded again and compared with the text."""
    return sentencepiece_sampling.encode(read(spark, sf_dir, "documents"), model(spark), k=2, decoded=True).withColumnRenamed("id", "doc_id")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with surrogates, and the number of entities in it."""
    return pii_surrogates.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogate key 1")


def op3_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities of good quality of each document, by either view and by both."""
    out = cotraining.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "quality.*", "keep")


def op4_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.deduplicate(read(spark, sf_dir, "documents"), window=13)


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.assign(read(spark, sf_dir, "documents"), [1.0] * 40, [1.0] * 41)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read(spark, sf_dir, "documents"), length=100)


def op7_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, their likeness to the edited text's and the next document's, and the group of near copies in the table."""
    docs = read(spark, sf_dir, "documents")
    return spotsigs.compare_with_next(docs, spotsigs.near_groups(docs))


def op8_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated chunks of lines."""
    out = line_chunks.deduplicate(read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_runs", "kept_sha256")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(read(spark, sf_dir, "documents"), size=4, share=(85, 100))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), model(spark), limit=4096).withColumnRenamed("id", "doc_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.summarize(conversation_repair.damage(conversations), conversations)


def queries() -> dict[str, Query]:
    own = (
        op1_sentencepiece_sampling,
        op2_pii_surrogates,
        op3_cotrained_quality,
        op4_rlz_substring_dedup,
        op5_rendezvous_sharding,
        op6_suffix_array_dedup,
        op7_spotsigs_fingerprints,
        op8_line_chunk_dedup,
        op9_ngram_jaccard_join,
        op10_benchmark_decontamination,
        op11_token_counts,
        op12_conversation_repair,
    )
    return {f.__name__: f for f in own}


SQL = {
    "op4_rlz_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM (SELECT doc_id, p FROM win JOIN first USING (k) WHERE least < doc_id), range(0, 13) AS r(j)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op9_ngram_jaccard_join": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT edges.y, reach.root FROM reach JOIN edges ON edges.x = reach.doc_id WHERE reach.root < edges.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
""",
    "op10_benchmark_decontamination": """
WITH items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, p, p + 9), ' ') AS k, least(len(w), 10) AS n
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, grams.n, item FROM grams JOIN win USING (k)),
words AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hits), range(0, 10) AS r(j) WHERE j < n GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
