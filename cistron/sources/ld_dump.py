"""Parser of line-oriented folding dumps.

A dump has markers of proteins (@@PROTEIN name) and of settings (@@LAMBDA number), after each of which come a sequence, a
structure and their scores, among other lines. A record ends at the next marker or the end of the file and counts if its
setting is a number and it has a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "protein string, lam double, seq string, structure_reported string, mfe_reported double, cai_reported double, seq_id string"


def scan_ld_dump(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse(rows)


def parse(files: DataFrame) -> DataFrame:
    """Records of (file, value) rows, one for each file."""
    number = r"(-?[\d.]+)"
    energy = rf"(?m)^mRNA folding free energy:[ \t]*{number}[ \t]*kcal/mol;[ \t]*mRNA CAI:[ \t]*{number}"
    blocks = files.select("file", F.posexplode(F.split("value", r"(?m)^@@PROTEIN")).alias("p", "of_protein"))
    name = F.when(F.col("p") > 0, F.trim(F.regexp_extract("of_protein", r"^([^\r\n]*)", 1))).otherwise(F.lit(""))
    runs = blocks.select("file", "p", name.alias("protein"), F.posexplode(F.split("of_protein", r"(?m)^@@LAMBDA")).alias("r", "body")).where("r > 0")

    def last(pattern: str, group: int) -> Column:
        """Of the last line that matches; null without one."""
        found = F.regexp_extract_all("body", F.lit(pattern), F.lit(group))
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), found), -1)

    out = runs.select(
        "protein",
        F.trim(F.regexp_extract("body", r"^([^\r\n]*)", 1)).try_cast("double").alias("lam"),
        F.upper(last(r"(?m)^mRNA sequence:[ \t]*([AUGCaucg]+)", 1)).alias("seq"),
        F.coalesce(last(r"(?m)^mRNA structure:[ \t]*([().]+)", 1), F.lit("")).alias("structure_reported"),
        last(energy, 1).try_cast("double").alias("mfe_reported"),
        last(energy, 2).try_cast("double").alias("cai_reported"),
    )
    ident = F.concat(F.lit("LD_len"), F.length("protein"), F.lit("_lam"), F.col("lam").cast("string"))
    return out.where("lam is not null and seq is not null").withColumn("seq_id", ident)
