"""Sequence tables: derived ones for tests and benchmarks, and readers of the supported file formats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import letters as L

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 7)[:26]


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, grp, source, raw, cds): each whole text as a nucleotide sequence of whole codons.

    ASCII letters become bases cyclically; cds has no stop codon (TAA, TAG, TGA become CAA, CAG, CGA).
    """
    return derived(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def derived(docs: DataFrame) -> DataFrame:
    """The sequences of from_documents() for documents at hand, also for those of a stream; a null text is an empty sequence.

    Rows are dealt anew, as a file's row group, however large, is read by one task. The text deals as well as the id, so
    that rows without an id are spread, too.
    """
    rows, text = docs.repartition("doc_id", "text"), F.col("text")
    made = {"raw": L.column("string", _bases, once=True)(text), "cds": L.column("string", lambda t: _sense(L.Texts(_bases(t))), once=True)(text)}
    return rows.select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("grp"), "source", *(c.alias(n) for n, c in made.items()))


_TABLE = np.zeros(256, dtype=np.uint8)
for _letter, _base in zip(ALPHABET, BASES, strict=True):
    _TABLE[[ord(_letter), ord(_letter.lower())]] = ord(_base)
_STOPS = np.array([c in K.STOPS for c in [*L.CODONS, ""]])


def _bases(t: L.Texts) -> pa.Array:
    """ASCII letters as bases, less what is over whole codons."""
    made = _TABLE[t.letters]
    keep = made > 0
    upto = np.concatenate(([0], np.cumsum(keep)))
    start, end = upto[t.start], upto[t.start + t.length]
    made, over = made[keep], (end - start) % 3
    whole = np.ones(len(made), dtype=bool)
    whole[L.spread(end - over, over)] = False
    return t.strings(whole, made, np.zeros(t.n, dtype=bool), start, end - start)


def _sense(t: L.Texts) -> pa.Array:
    """Whole codons, stop codons with C in front."""
    letters = t.letters.copy()
    stop = L.spread(t.start, t.n_codons, 3)[_STOPS[t.numbers]]
    letters[stop] = ord("C")
    return t.strings(np.ones(len(letters), dtype=bool), letters)


def codon_dimension(spark: SparkSession) -> DataFrame:
    """(codon, aa, freq, aa_max): the 64 codons in DNA letters."""
    return spark.createDataFrame([(c, K.AMINO[c], K.FREQ[c], K.AMINO_MAX[K.AMINO[c]]) for c in sorted(K.AMINO)], "codon string, aa string, freq double, aa_max double")


def synonym_dimension(spark: SparkSession) -> DataFrame:
    """(codon, alt): each sense codon with each other codon of its amino acid."""
    return spark.createDataFrame([(c, a) for v in K.SYNONYMS.values() for c in v for a in v if a != c], "codon string, alt string")


def scan_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows with a header; empty fields are null."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True)


def scan_trna(spark: SparkSession, path: str) -> DataFrame:
    """(anticodon, copies) from a commented tab-separated file; TCA, which reads a stop codon, is left out."""
    return spark.read.csv(path, schema="anticodon string, copies double", sep="\t", header=True, comment="#").where("anticodon <> 'TCA'")


def scan_codon_table(spark: SparkSession, path: str, with_stops: bool = True) -> DataFrame:
    """(codon, aa, freq, aa_max) from codon,aa,freq lines; others are skipped; 64 codons there must be."""
    rows = spark.read.csv(path, schema="codon string, aa string, f string")
    rows = rows.select(F.upper(F.trim("codon")).alias("codon"), F.trim("aa").alias("aa"), F.expr("try_cast(trim(f) as double)").alias("freq"))
    rows = rows.where("length(codon) = 3 and freq is not null")
    if (n := rows.select("codon").distinct().count()) != 64:
        raise ValueError(f"the codon table has {n} codons, not 64")
    best = rows.groupBy("aa").agg(F.max("freq").alias("aa_max"))
    out = rows.join(F.broadcast(best), "aa").select("codon", "aa", "freq", "aa_max")  # 21 rows
    return out if with_stops else out.where("aa <> '*'")


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(gene_symbol, cds) with cds in DNA letters."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("gene_symbol", F.translate(F.upper("cds"), "U", "T").alias("cds"))


def scan_protein(spark: SparkSession, path: str) -> DataFrame:
    """(protein, aa): a text file for each protein, without white space; the name is the file's."""
    rows = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return rows.select(name.alias("protein"), F.regexp_replace("value", r"\s", "").alias("aa"))


def list_proteins(spark: SparkSession, path: str) -> DataFrame:
    return scan_protein(spark, path).select("protein").orderBy("protein")


def scan_coefficients(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(codon, ...): per-codon coefficients; columns: name of each by the file's name for it."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.upper("codon").alias("codon"), *(F.col(f"`{c}`").cast("double").alias(name) for c, name in columns.items()))
