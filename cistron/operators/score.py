"""Design scores: calibrated naturalness and codon usage, less manufacturing penalties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import letters as L
from ..functions import sequence as S
from ..storage import checkpoint
from . import corpus


def with_scores(seqs: DataFrame, counts: DataFrame | None = None, stats: DataFrame | None = None, seq: str = "cds", more: Callable[[L.Together], dict[str, int]] = lambda s: {}, keep: bool = True) -> DataFrame:
    """seqs and nat, cai, tai, their z scores, sites, hp4, hp5, gc, penalty, score_v2 and score_v25, and `more` measures.

    keep: with the sequences, which are most of what is written where the scores are calibrated against the rows themselves.
    """
    rows = corpus.measured(seqs, counts, seq, lambda s: {"sites": S.motif_count(s), "hp4": S.n_hp4(s), "hp5": S.n_hp5(s), "gc": S.gc_content(s)} | more(s))
    rows = rows if keep else rows.drop(seq)
    if stats is None:
        rows = checkpoint(rows)  # measured once, for the calibration and for the scores
    rows = corpus.z_scores(rows, stats if stats is not None else corpus.calibration(rows))
    rows = rows.withColumn("penalty", K.W_SITE * F.col("sites") + K.W_HP4 * F.col("hp4") + K.W_HP5 * F.col("hp5") + S.gc_penalty(F.col("gc")))
    rows = rows.withColumn("score_v2", F.col("z_nat") + F.col("z_cai") - F.col("penalty"))
    return rows.withColumn("score_v25", F.col("score_v2") + K.W_TAI * F.col("z_tai"))


def design_score(rows: DataFrame, mode: str = "v2.5", expr: Column | None = None, stab: Column | None = None) -> Column:
    """v2.5 (with tRNA adaptation), v2 (without), or v1 (of two predicted heads, given as columns)."""
    if mode == "v2.5":
        return F.col("score_v25")
    if mode == "v2":
        return F.col("score_v2")
    if expr is None or stab is None:
        raise ValueError("v1 needs the columns of the predicted heads")
    return K.W_EXPR * expr + K.W_STAB * stab - F.col("penalty")


def gates_ok(new: str, base: str) -> Column:
    """Whether the metrics with prefix `new` are acceptable beside those with prefix `base`."""
    n, b = (lambda c: F.col(f"{new}{c}")), (lambda c: F.col(f"{base}{c}"))
    return (
        (n("score_v2") >= b("score_v2") - K.GATE_SCORE)
        & (n("z_nat") >= b("z_nat") - K.GATE_NAT)
        & (n("cai") >= b("cai") - K.GATE_CAI)
        & (n("sites") <= b("sites"))
        & (n("hp5") <= b("hp5"))
        & n("gc").between(K.GC_LO, K.GC_HI)
    )


def rank_in_groups(rows: DataFrame, group: str = "grp", score: str = "score_v25", tie: str = "seq_id") -> DataFrame:
    """rows and place, from 1 for the best score of each group.

    A large group is not one task's: rows are dealt in ranges of (group, score), numbered within each range, and a range's
    numbers go on from the counts of the ranges before it. The checkpoint fixes the ranges.
    """
    order = [F.col(group), F.round(score, 9).desc(), F.col(tie)]
    dealt = checkpoint(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_range").orderBy(*order[1:])
    numbered = dealt.withColumn("_place", F.row_number().over(within))
    both = numbered.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return both.withColumn("place", (F.col("_start") + F.col("_place")).cast("int")).drop("_range", "_place", "_group", "_at", "_start")


def immune_flag(duplex: Column, urich: Column, length: Column, cpg: Column) -> Column:
    """0 to 4: long duplexes count twice, medium ones, U-rich windows and CpG once each."""
    by_duplex = F.when(duplex >= K.DUPLEX_HIGH, 2).when(duplex >= K.DUPLEX_MED, 1).otherwise(0)
    rich = urich * F.lit(1000.0) / F.greatest(length, F.lit(1)) >= K.URICH_PER_KB
    return by_duplex + rich.cast("int") + (cpg >= K.CPG_HIGH).cast("int")


def te_composite(cai: Column, tai: Column) -> Column:
    return F.round(0.6 * cai + 0.4 * F.coalesce(tai, F.lit(0.0)), 3)


def initiation_composite(seq: Column, accessibility: Column, dg: Column) -> Column:
    """Of the start's accessibility and energy and a G at index 6; null without the former two."""
    g = (F.substring(seq, 7, 1) == "G").cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.round(0.5 * F.least(F.greatest(accessibility, zero), one) + 0.4 * (1 - F.least(F.greatest(-dg, zero) / 20.0, one)) + 0.1 * g, 3)


#: What a model makes of the columns of a feature vector: a column expression or one over a pandas UDF.
Head = Callable[[dict[str, Column]], Column]


def predicted(features: dict[str, Column], heads: dict[str, Head]) -> dict[str, Column]:
    """A column for each head."""
    return {name: head(features) for name, head in heads.items()}


def half_life(features: dict[str, Column], decay: dict[str, Head]) -> Column:
    """Mean of the decay heads to one decimal; null without heads."""
    made = list(predicted(features, decay).values())
    if not made:
        return F.lit(None).cast("double")
    return F.round(sum(made[1:], made[0]) / F.lit(float(len(made))), 1)


def linear_head(weights: dict[str, float], bias: float = 0.0) -> Head:
    """A linear model as columns, so that it stays in the JVM."""
    return lambda features: sum((F.lit(w) * features[n].cast("double") for n, w in weights.items()), F.lit(bias))


def scorecard(scored: DataFrame, cpb: DataFrame, duplex: DataFrame, folding: DataFrame | None = None, seq: str = "cds", halflife: Column | None = None) -> DataFrame:
    """The columns of the scorecard for rows of with_scores().

    cpb: (seq_id, cpb); duplex: (seq_id, near); folding: (seq_id, dg_start45, acc_aug30, unpaired) of some backend;
    halflife: what half_life() makes of decay heads. Without folding or heads their columns are null.
    """
    rows = scored.join(cpb, "seq_id").join(duplex.select("seq_id", F.col("near").alias("dsrna_bp")), "seq_id")
    if folding is None:
        null = F.lit(None).cast("double")
        rows = rows.withColumns({"dg_start45": null, "acc_aug30": null, "unpaired": null})
    else:
        rows = rows.join(folding.select("seq_id", "dg_start45", "acc_aug30", "unpaired"), "seq_id", "left")
    s = F.col(seq)
    return rows.select(
        "seq_id",
        F.round(F.col("z_nat") + F.col("z_cai"), 2).alias("expr_z"),
        te_composite(F.col("cai"), F.col("tai")).alias("te_comp"),
        initiation_composite(s, F.col("acc_aug30"), F.col("dg_start45")).alias("init_comp"),
        F.round("dg_start45", 2).alias("dg_start45"),
        F.round("acc_aug30", 3).alias("acc_aug30"),
        F.round(1 - F.col("unpaired"), 3).alias("pairing_prob"),
        F.round("tai", 3).alias("tai"),
        F.round("cpb", 3).alias("cpb"),
        F.round(S.gc_slide_max(s), 3).alias("gc_w60_max"),
        F.round(S.gc_slide_min(s), 3).alias("gc_w60_min"),
        "dsrna_bp",
        (halflife if halflife is not None else F.lit(None).cast("double")).alias("halflife_pct"),
        immune_flag(F.col("dsrna_bp"), S.urich_count(s), F.length(s), S.dinuc_odds(s, "C", "G")).alias("immune_flag"),
    )
