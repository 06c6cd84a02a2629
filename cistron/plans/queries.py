"""Queries by name over the derived sequences, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codon as C
from ..functions import constants as K
from ..functions import letters as L
from ..functions import sequence as S
from ..operators import corpus, duplex, features, folding, report, score, search, select, structure, validate
from ..sources import ld_dump, sequences
from ..sources.sequences import codon_dimension, from_documents, synonym_dimension
from ..storage import checkpoint, scratch, write_file
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Rounds of refinement before repair.
PIPELINE_ROUNDS = 25


def add(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(f(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if text:
            SQL[name] = text.replace("::INT ", "::BIGINT ").replace("::INT)", "::BIGINT)").replace("::INT,", "::BIGINT,")
        return f

    return keep


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as long, as the SQL gives them."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "decimal(20,0)") else F.col(c) for c, t in df.dtypes))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, in which the engines agree."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scalar(name: str, columns: Callable[[Column, Column], dict[str, Column]], texts: dict[str, str], more: str = "", joins: str = "") -> None:
    """A query that computes columns of each sequence, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = columns(F.col("raw"), F.col("cds"))
        return widened(rounded(from_documents(spark, sf_dir).select("seq_id", *(c.alias(n) for n, c in made.items()))))

    numbers = {n: f"round({t}, 6)" if t.endswith("::DOUBLE") else t for n, t in texts.items()}
    body = ", ".join(f"{t.removesuffix('::INT') + '::BIGINT' if t.endswith('::INT') else t} AS {n}" for n, t in numbers.items())
    QUERIES[name] = run
    SQL[name] = f"WITH {Q.SEQS}{', ' + more if more else ''} SELECT seqs.seq_id, {body} FROM seqs {joins}"


RNA = "translate(upper(raw), 'T', 'U')"
scalar("comp_normalize_rna", lambda raw, cds: {"rna": S.normalize_rna(raw)}, {"rna": RNA})
scalar("comp_to_dna", lambda raw, cds: {"dna": S.to_dna(S.normalize_rna(raw))}, {"dna": "raw"})
scalar("comp_revcomp_rna", lambda raw, cds: {"rc": S.revcomp_rna(S.normalize_rna(raw))}, {"rc": f"reverse(translate({RNA}, 'AUGC', 'UACG'))"})
scalar("comp_revcomp_dna", lambda raw, cds: {"rc": S.revcomp_dna(raw)}, {"rc": "reverse(translate(raw, 'ACGT', 'TGCA'))"})
scalar("comp_codon_split", lambda raw, cds: {"codons": F.array_join(S.codons(raw), " ")}, {"codons": "array_to_string(regexp_extract_all(raw, '...'), ' ')"})
scalar("comp_codon_split_keep_tail", lambda raw, cds: {"codons": F.array_join(S.pieces(F.expr("substr(raw, 2)"), 3, True), " ")}, {"codons": "array_to_string(regexp_extract_all(substr(raw, 2), '.{1,3}'), ' ')"})
scalar("comp_motif_count", lambda raw, cds: {"sites": S.motif_count(raw)}, {"sites": Q.sites("raw")})
scalar("comp_donor_count", lambda raw, cds: {"donors": S.donor_count(raw)}, {"donors": Q.sites("raw", K.DONORS)})
scalar("comp_gc_content", lambda raw, cds: {"gc": S.gc_content(raw)}, {"gc": f"{Q.gc('raw')}::DOUBLE"})
scalar("comp_gc_slide", lambda raw, cds: {"gc_max": S.gc_slide_max(raw), "gc_min": S.gc_slide_min(raw)}, {"gc_max": "hi::DOUBLE", "gc_min": "lo::DOUBLE"}, Q.slide("raw"), "JOIN slide USING (seq_id)")
scalar("comp_max_homopolymer", lambda raw, cds: {f"hp_max_{b.lower()}": S.max_run(raw, b) for b in "ACGT"}, {f"hp_max_{b.lower()}": Q.max_run("raw", b) for b in "ACGT"})
scalar("comp_hp_max_run", lambda raw, cds: {"hp_max": S.max_run(raw, "ACGT")}, {"hp_max": Q.max_run("raw", "ACGT")})
scalar("comp_n_hp4", lambda raw, cds: {"hp4": S.n_hp4(raw)}, {"hp4": Q.runs("raw", 4)})
scalar("comp_n_hp5", lambda raw, cds: {"hp5": S.n_hp5(raw)}, {"hp5": Q.runs("raw", 5)})
scalar("comp_urich_count", lambda raw, cds: {"urich6": S.urich_count(raw)}, {"urich6": "urich"}, Q.urich("raw"), "JOIN urich USING (seq_id)")
scalar("comp_dinuc_odds", lambda raw, cds: {"upa": S.dinuc_odds(raw, "T", "A"), "cpg": S.dinuc_odds(raw, "C", "G")}, {"upa": f"{Q.odds('raw', 'T', 'A')}::DOUBLE", "cpg": f"{Q.odds('raw', 'C', 'G')}::DOUBLE"})
scalar(
    "comp_seq_features",
    lambda raw, cds: S.seq_features(raw),
    {"seq_len": "length(raw)", "gc_global": f"{Q.gc('raw')}::DOUBLE", "gc_slide60_max": "hi::DOUBLE", "gc_slide60_min": "lo::DOUBLE", "upa_odds": f"{Q.odds('raw', 'T', 'A')}::DOUBLE", "cpg_odds": f"{Q.odds('raw', 'C', 'G')}::DOUBLE"}
    | {f"hp_max_{n}": Q.max_run("raw", b) for n, b in zip("acgu", "ACGT", strict=True)}
    | {"urich6_count": "urich"},
    f"{Q.slide('raw')}, {Q.urich('raw')}",
    "JOIN slide USING (seq_id) JOIN urich USING (seq_id)",
)
scalar("comp_trim_stop", lambda raw, cds: {"trimmed": S.trim_stop(raw)}, {"trimmed": "regexp_replace(raw, '(TAA|TAG|TGA)$', '')"})
_GC_OK, _SLIDE_OK = f"{Q.gc('raw')} BETWEEN 0.3 AND 0.7", "lo >= 0.2 AND hi <= 0.8"
_RUN_OK = "NOT regexp_matches(raw, 'A{4}|C{4}|G{4}|T{4}')"
scalar("rule_gc_global", lambda raw, cds: {"ok": S.rule_features(raw)["rule_gc_global_pass"]}, {"ok": f"({_GC_OK})::INT"})
scalar("rule_gc_slide", lambda raw, cds: {"ok": S.rule_features(raw)["rule_gc_slide_pass"]}, {"ok": f"({_SLIDE_OK})::INT"}, Q.slide("raw"), "JOIN slide USING (seq_id)")
scalar("rule_homopolymer", lambda raw, cds: {"ok": S.rule_features(raw)["rule_homopolymer_pass"]}, {"ok": f"({_RUN_OK})::INT"})
scalar(
    "rules_all_pass",
    lambda raw, cds: S.rule_features(raw),
    {"rule_gc_global_pass": f"({_GC_OK})::INT", "rule_gc_slide_pass": f"({_SLIDE_OK})::INT", "rule_homopolymer_pass": f"({_RUN_OK})::INT", "restriction_site_count": Q.sites("raw"), "cryptic_donor_count": Q.sites("raw", K.DONORS), "urich6_count": "urich", "rules_all_pass": f"({_GC_OK} AND {_SLIDE_OK} AND {_RUN_OK} AND {Q.sites('raw')} = 0)::INT"},
    f"{Q.slide('raw')}, {Q.urich('raw')}",
    "JOIN slide USING (seq_id) JOIN urich USING (seq_id)",
)
scalar("hard_ok", lambda raw, cds: {"ok": S.hard_ok(raw)}, {"ok": f"(length(raw) > 0 AND {_GC_OK} AND (length(raw) <= 60 OR ({_SLIDE_OK})) AND {Q.runs('raw', 5)} = 0)::INT"}, Q.slide("raw"), "JOIN slide USING (seq_id)")
scalar("clean_flag", lambda raw, cds: {"clean": S.clean_flag(raw)}, {"clean": f"({Q.sites('raw')} = 0 AND {Q.runs('raw', 5)} = 0)::INT"})
scalar("score_penalties", lambda raw, cds: {"penalty": S.penalties(raw)}, {"penalty": f"({K.W_SITE} * {Q.sites('raw')} + {K.W_HP4} * {Q.runs('raw', 4)} + {K.W_HP5} * {Q.runs('raw', 5)} + {Q.gc_penalty(Q.gc('raw'))})::DOUBLE"})

_PROTEIN = "(SELECT seqs.seq_id, coalesce(string_agg(aa, '' ORDER BY p), '') AS aa FROM seqs LEFT JOIN (SELECT * FROM rc JOIN codon ON rc.c = codon.codon) x USING (seq_id) GROUP BY seqs.seq_id)"
_RC = f"{Q.CODON}, {Q.RAW_CODONS}, protein AS {_PROTEIN}"
scalar("codon_translate_a", lambda raw, cds: {"aa": C.translate_a(raw)}, {"aa": "regexp_extract(aa, '^[^*]*')"}, _RC, "JOIN protein USING (seq_id)")
scalar("codon_translate_b", lambda raw, cds: {"aa": C.translate_b(raw)}, {"aa": "regexp_extract(aa, '^[^*]*')"}, _RC, "JOIN protein USING (seq_id)")
scalar("codon_check_translate", lambda raw, cds: {"ok": C.check_translate(cds, C.translate_a(raw))}, {"ok": "NOT contains(aa, '*')"}, _RC, "JOIN protein USING (seq_id)")
scalar("codon_stop_codon", lambda raw, cds: {"last": C.stop_codon(raw)}, {"last": "right(raw, 3)"})
_BEST = Q.values("best", "aa, b", sorted(K.BEST.items()))
scalar(
    "codon_back_translate_cai_max",
    lambda raw, cds: {"start": C.back_translate(C.translate_a(cds))},
    {"start": "start"},
    f"{Q.CODON}, {_BEST}, {Q.CDS_CODONS}, made AS (SELECT seqs.seq_id, coalesce(string_agg(b, '' ORDER BY p), '') AS start FROM seqs LEFT JOIN (SELECT * FROM cc JOIN codon ON cc.c = codon.codon JOIN best USING (aa)) x USING (seq_id) GROUP BY seqs.seq_id)",
    "JOIN made USING (seq_id)",
)
scalar("codon_cai", lambda raw, cds: {"cai": C.cai(cds)}, {"cai": "cai::DOUBLE"}, f"{Q.CODON}, {Q.CDS_CODONS}, {Q.CAI}", "JOIN cai USING (seq_id)")
scalar(
    "codon_cai_excl_stop",
    lambda raw, cds: {"cai": C.cai_excl_stop(raw)},
    {"cai": "cai::DOUBLE"},
    f"{Q.CODON}, {Q.RAW_CODONS}, x AS (SELECT seqs.seq_id, coalesce(pow(2, avg(log2(freq / aa_max))), 0) AS cai FROM seqs LEFT JOIN (SELECT * FROM rc JOIN codon ON rc.c = codon.codon WHERE NOT (p = n AND aa = '*')) y USING (seq_id) GROUP BY seqs.seq_id)",
    "JOIN x USING (seq_id)",
)
scalar("codon_gc3", lambda raw, cds: {"gc3": C.gc3(raw)}, {"gc3": "gc3::DOUBLE"}, f"{Q.RAW_CODONS}, g AS (SELECT seqs.seq_id, coalesce(avg((right(c, 1) IN ('G', 'C'))::INT), 0) AS gc3 FROM seqs LEFT JOIN rc USING (seq_id) GROUP BY seqs.seq_id)", "JOIN g USING (seq_id)")
scalar("codon_enc", lambda raw, cds: {"enc": C.enc(raw)}, {"enc": "enc::DOUBLE"}, f"{Q.CODON}, {Q.RAW_CODONS}, {Q.ENC}", "JOIN enc USING (seq_id)")
scalar("codon_tai", lambda raw, cds: {"tai": C.tai(cds)}, {"tai": "tai::DOUBLE"}, f"{Q.WEIGHT}, {Q.CDS_CODONS}, {Q.TAI}", "JOIN tai USING (seq_id)")
#: Coefficients by a rule, in place of a table of measurements: of codon number k, k * step % 64 / 64, for some codons.
COEFFICIENTS = {name: {c: k * step % 64 / 64 for k, c in enumerate(C.ALL) if k % 7 != 3} for name, step in (("opt_293T", 5), ("opt_hela", 11), ("opt_rpe", 23), ("opt_293T_orfome", 29), ("opt_k562_orfome", 37), ("opt_k562_slam", 43))}
_COEF = Q.values("coef", "codon, " + ", ".join(COEFFICIENTS), [(c, *(COEFFICIENTS[n][c] for n in COEFFICIENTS)) for c in sorted(COEFFICIENTS["opt_rpe"])])
scalar(
    "score_feature_vec",
    lambda raw, cds: C.feature_vector(cds, COEFFICIENTS),
    {n: f"coalesce({n}, 0)::DOUBLE" for n in COEFFICIENTS} | {"cai": "cai::DOUBLE", "gc_global": f"{Q.gc('cds')}::DOUBLE", "gc3": "gc3::DOUBLE", "enc": "enc::DOUBLE", "cds_len": "length(cds)"},
    f"{Q.CODON}, {_COEF}, {Q.CDS_CODONS}, {Q.CDS_CODONS.replace('cc AS', 'rc AS')}, {Q.CAI}, {Q.ENC}, g AS (SELECT seq_id, avg((right(c, 1) IN ('G', 'C'))::INT) AS gc3 FROM cc GROUP BY seq_id), "
    f"o AS (SELECT seq_id, {', '.join(f'avg({n}) AS {n}' for n in COEFFICIENTS)} FROM cc JOIN coef ON cc.c = coef.codon GROUP BY seq_id)",
    "JOIN cai USING (seq_id) JOIN enc USING (seq_id) LEFT JOIN g USING (seq_id) LEFT JOIN o USING (seq_id)",
)


def seqs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark, sf_dir)


@add("comp_pair_iter", f"WITH {Q.SEQS}, {Q.CDS_CODONS}, {Q.PAIRS} SELECT seq_id, pair, count(*) AS n FROM pairs GROUP BY ALL")
def comp_pair_iter(spark, sf_dir):
    return corpus.pair_rows(seqs_of(spark, sf_dir)).groupBy("seq_id", "pair").agg(F.count(F.lit(1)).alias("n"))


@add("corpus_pair_count", f"WITH {Q.SEQS}, {Q.CDS_CODONS}, {Q.PAIRS}, {Q.COUNTS} SELECT * FROM counts")
def corpus_pair_count(spark, sf_dir):
    return corpus.pair_counts(seqs_of(spark, sf_dir))


@add("corpus_total_pairs", f"WITH {Q.SEQS}, {Q.CDS_CODONS}, {Q.PAIRS}, {Q.COUNTS} SELECT total::BIGINT AS total FROM total")
def corpus_total_pairs(spark, sf_dir):
    return corpus.total_pairs(corpus.pair_counts(seqs_of(spark, sf_dir)))


_MONO = "mono AS (SELECT codon, sum(n) AS n FROM (SELECT left(pair, 3) AS codon, n FROM counts UNION ALL SELECT right(pair, 3), n FROM counts) GROUP BY codon)"


@add("corpus_mono_freq", f"WITH {Q.SEQS}, {Q.CDS_CODONS}, {Q.PAIRS}, {Q.COUNTS}, {_MONO} SELECT codon, n::BIGINT AS n, round(n / (2.0 * total), 6) AS f FROM mono, total")
def corpus_mono_freq(spark, sf_dir):
    return rounded(corpus.mono_frequencies(corpus.pair_counts(seqs_of(spark, sf_dir))))


@add("corpus_naturalness", f"WITH {Q.SEQS}, {Q.CDS_CODONS}, {Q.PAIRS}, {Q.COUNTS}, {Q.NAT} SELECT seq_id, round(nat, 6) AS nat FROM nat")
def corpus_naturalness(spark, sf_dir):
    seqs = seqs_of(spark, sf_dir)
    return rounded(corpus.naturalness(seqs, corpus.pair_counts(seqs)))


@add(
    "corpus_cpb",
    f"WITH {Q.SEQS}, {Q.CDS_CODONS}, {Q.PAIRS}, {Q.COUNTS}, {_MONO}, cps AS (SELECT pair, ln((c.n / total) / ((a.n / (2.0 * total)) * (b.n / (2.0 * total)))) AS cps FROM counts c JOIN mono a ON a.codon = left(pair, 3) JOIN mono b ON b.codon = right(pair, 3), total) "
    "SELECT seqs.seq_id, round(coalesce(avg(cps), 0), 6) AS cpb FROM seqs LEFT JOIN (SELECT * FROM pairs JOIN cps USING (pair)) x USING (seq_id) GROUP BY seqs.seq_id",
)
def corpus_cpb(spark, sf_dir):
    seqs = seqs_of(spark, sf_dir)
    return rounded(corpus.codon_pair_bias(seqs, corpus.pair_counts(seqs)))


@add("corpus_stats", f"WITH {Q.MEASURED} SELECT {', '.join(f'round({c}_{n}, 6) AS {c}_{n}' for c in ('nat', 'cai', 'tai') for n in ('mean', 'std'))}, tai_n FROM stats")
def corpus_stats(spark, sf_dir):
    return rounded(corpus.calibration(corpus.measured(seqs_of(spark, sf_dir))))


@add("corpus_codon_hist", f"WITH {Q.SEQS}, {Q.CODON}, {Q.CDS_CODONS} SELECT seq_id, aa, codon, count(*) AS n FROM cc JOIN codon ON cc.c = codon.codon GROUP BY ALL")
def corpus_codon_hist(spark, sf_dir):
    return corpus.codon_histogram(seqs_of(spark, sf_dir))


@add("corpus_z_scores", f"WITH {Q.SCORED} SELECT seq_id, round(z_nat, 6) AS z_nat, round(z_cai, 6) AS z_cai, round(z_tai, 6) AS z_tai FROM scored")
def corpus_z_scores(spark, sf_dir):
    # measured once, for the calibration and for the scores
    rows = checkpoint(corpus.measured(seqs_of(spark, sf_dir).select("seq_id", "cds")).drop("cds"))
    return rounded(corpus.z_scores(rows, corpus.calibration(rows)).select("seq_id", "z_nat", "z_cai", "z_tai"))


_METRICS = ("z_nat", "z_cai", "cai", "gc", "penalty", "score_v2", "score_v25")


@add("score_metrics", f"WITH {Q.SCORED} SELECT seq_id, sites, hp4, hp5, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM scored")
def score_metrics(spark, sf_dir):
    return rounded(score.with_scores(seqs_of(spark, sf_dir).select("seq_id", "cds"), keep=False).select("seq_id", "sites", "hp4", "hp5", *_METRICS))


@add("score_design_v1", f"WITH {Q.SCORED} SELECT seq_id, round({K.W_EXPR} * nat + {K.W_STAB} * cai - penalty, 6) AS score FROM scored")
def score_design_v1(spark, sf_dir):
    """Two heads stand in for models that aren't at hand."""
    rows = score.with_scores(seqs_of(spark, sf_dir).select("seq_id", "cds"), keep=False)
    return rounded(rows.select("seq_id", score.design_score(rows, "v1", F.col("nat"), F.col("cai")).alias("score")))


@add("score_rank_by_group", f"WITH {Q.SCORED} SELECT seq_id, grp, round(score_v25, 6) AS score_v25, row_number() OVER (PARTITION BY grp ORDER BY round(score_v25, 9) DESC, seq_id)::INT AS place FROM scored")
def score_rank_by_group(spark, sf_dir):
    rows = score.with_scores(seqs_of(spark, sf_dir).select("seq_id", "grp", "cds"), keep=False).select("seq_id", "grp", "score_v25")
    return rounded(score.rank_in_groups(rows).select("seq_id", "grp", "score_v25", "place"))


@add(
    "score_gates_ok",
    f"WITH {Q.SCORED}, b AS (SELECT grp, arg_min(struct_pack(s := score_v2, n := z_nat, c := cai, t := sites, h := hp5), seq_id) AS b FROM scored GROUP BY grp) "
    f"SELECT seq_id, (score_v2 >= b.s - {K.GATE_SCORE} AND z_nat >= b.n - {K.GATE_NAT} AND cai >= b.c - {K.GATE_CAI} AND sites <= b.t AND hp5 <= b.h AND gc BETWEEN {K.GC_LO} AND {K.GC_HI}) AS ok FROM scored JOIN b USING (grp)",
)
def score_gates_ok(spark, sf_dir):
    """Each sequence beside the first of its group."""
    rows = score.with_scores(seqs_of(spark, sf_dir).select("seq_id", "grp", "cds"), keep=False)
    names = ("score_v2", "z_nat", "cai", "sites", "hp5", "gc")
    base = rows.groupBy("grp").agg(*(F.min_by(c, "seq_id").alias(f"base_{c}") for c in names))
    both = rows.select("seq_id", "grp", *(F.col(c).alias(f"new_{c}") for c in names)).join(base, "grp")
    return both.select("seq_id", score.gates_ok("new_", "base_").alias("ok"))


def _spearman_sql() -> str:
    u = "('0x' || left(md5(seq_id || ':' || b), 8))::BIGINT / 4294967296.0"
    times = " + ".join(f"({u} >= {sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))!r})::INT" for n in range(validate.MOST))
    n = lambda w: f"nullif(sum({w}), 0)"
    both = lambda w, p, q: f"(sum({w} * {p} * {q}) - sum({w} * {p}) * sum({w} * {q}) / {n(w)})"
    r = lambda w: f"CASE WHEN {both(w, 'x', 'x')} * {both(w, 'y', 'y')} > 1e-9 THEN {both(w, 'x', 'y')} / sqrt({both(w, 'x', 'x')} * {both(w, 'y', 'y')}) END"
    edge = max(1, round(validate.REPLICATES * validate.OUTSIDE / 2))
    rank = lambda c: f"rank() OVER (PARTITION BY grp ORDER BY {c}) + (count(*) OVER (PARTITION BY grp, {c}) - 1) / 2.0"
    return (
        f"WITH {Q.SCORED}, v AS (SELECT seq_id, grp, round(score_v25, 6) AS s, quality FROM scored JOIN labels ON doc_id = seq_id WHERE quality IS NOT NULL), k AS (SELECT seq_id, grp, {rank('s')} AS x, {rank('quality')} AS y FROM v), "
        f"e AS (SELECT grp, count(*) AS n, {r('1.0')} AS spearman FROM k GROUP BY grp), d AS (SELECT *, ({times})::DOUBLE AS w FROM k, range({validate.REPLICATES}) AS t(b)), "
        f"p AS (SELECT grp, b, {r('w')} AS r FROM d GROUP BY grp, b), l AS (SELECT grp, list_sort(list(r) FILTER (r IS NOT NULL)) AS r FROM p GROUP BY grp) "
        f"SELECT grp, n, round(spearman, 6) AS spearman, CASE WHEN len(r) >= {2 * edge} THEN round(list_avg(r[1:{2 * edge}]), 6) END AS low, CASE WHEN len(r) >= {2 * edge} THEN round(list_avg(r[len(r) - {2 * edge - 1}:len(r)]), 6) END AS high FROM e JOIN l USING (grp)"
    )


@add("val_spearman", _spearman_sql())
def val_spearman(spark, sf_dir):
    """Rank correlation of the design score with the label of each language's sequences, and its interval."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("seq_id"), F.col("quality").cast("double").alias("quality"))
    rows = score.with_scores(seqs_of(spark, sf_dir).select("seq_id", "grp", "cds"), keep=False).select("seq_id", "grp", F.round("score_v25", 6).alias("s"))
    return rounded(validate.rank_correlation(rows.join(labels, "seq_id"), "grp", "seq_id", "s", "quality"))


@add("sel_zscore_group", f"WITH {Q.SCORED} SELECT seq_id, grp, round((score_v2 - avg(score_v2) OVER w) / greatest(stddev_pop(score_v2) OVER w, {K.LEAST_STD}), 6) AS z FROM scored WINDOW w AS (PARTITION BY grp)")
def sel_zscore_group(spark, sf_dir):
    rows = score.with_scores(seqs_of(spark, sf_dir).select("seq_id", "grp", "cds"), keep=False).select("seq_id", "grp", "score_v2")
    return rounded(corpus.group_z(rows, "grp", "score_v2").select("seq_id", "grp", F.col("z_score_v2").alias("z")))


@add("sel_longest_cds", f"WITH {Q.SEQS} SELECT source AS gene, arg_max(cds, (length(cds), -seq_id)) AS cds FROM (SELECT seqs.*, source FROM seqs) GROUP BY source".replace("SELECT seqs.*, source FROM seqs", "SELECT cds, seq_id, source FROM seqs"))
def sel_longest_cds(spark, sf_dir):
    return corpus.longest_per_gene(seqs_of(spark, sf_dir).withColumnRenamed("source", "gene"), "gene", "cds", "seq_id")


@add("sel_dedup_first", f"WITH {Q.SEQS} SELECT seq_id, source FROM (SELECT seq_id, source, row_number() OVER (PARTITION BY source, regexp_replace(raw, '(TAA|TAG|TGA)$', '') ORDER BY seq_id) AS n FROM seqs) WHERE n = 1")
def sel_dedup_first(spark, sf_dir):
    rows = seqs_of(spark, sf_dir).withColumn("trimmed", S.trim_stop(F.col("raw")))
    return corpus.first_of(rows, ["source", "trimmed"], ["seq_id"]).select("seq_id", "source")


_FEATURES = ["cai", "gc", "enc", "upa", "hp_max", "sites"]


def _pool(spark, sf_dir) -> DataFrame:
    more = lambda s: {"enc": C.enc(s), "upa": S.dinuc_odds(s, "T", "A"), "hp_max": S.max_run(s, "ACGT")}
    seqs = seqs_of(spark, sf_dir).select("seq_id", "grp", "cds", (F.col("cds") != "").alias("full"))
    rows = score.with_scores(seqs, more=more, keep=False).where("full").withColumn("hp_max", F.col("hp_max").cast("double"))
    return rows.select("seq_id", "grp", "score_v2", "hp4", *_FEATURES)


def topk_sql(score: str = "score_v2", where: str = "cds <> ''", more: str = "", final: str = f"SELECT grp, rank, seq_id FROM s{K.TOP_K}") -> str:
    """The selection of topk_diverse() by `score` from sequences of which `where` holds; `more` CTEs for the final SELECT."""
    z = ", ".join(f"({c} - avg({c}) OVER w) / greatest(stddev_pop({c}) OVER w, {K.LEAST_STD})" for c in _FEATURES)
    text = (
        f"WITH {Q.SCORED}, {Q.CDS_CODONS.replace('cc AS', 'rc AS')}, {Q.ENC}, "
        f"pool AS MATERIALIZED (SELECT seq_id, grp, {score}, hp4, cai, gc, sites, enc, {Q.odds('cds', 'T', 'A')} AS upa, {Q.max_run('cds', 'ACGT')} AS hp_max FROM scored JOIN enc USING (seq_id) WHERE {where}), "
        f"zz AS MATERIALIZED (SELECT seq_id, grp, hp4, {score} >= max({score}) OVER w - {K.TIE_BAND} AS close, ({score} - avg({score}) OVER w) / greatest(stddev_pop({score}) OVER w, {K.LEAST_STD}) AS z, [{z}] AS v FROM pool WINDOW w AS (PARTITION BY grp)), "
        "p1 AS MATERIALIZED (SELECT grp, arg_min(seq_id, (hp4, seq_id)) AS seq_id FROM zz WHERE close GROUP BY grp), s1 AS MATERIALIZED (SELECT grp, seq_id, 1::BIGINT AS rank FROM p1)"
    )
    for k in range(2, K.TOP_K + 1):
        text += (
            f", d{k} AS MATERIALIZED (SELECT a.grp, a.seq_id, round({K.ALPHA} * a.z + {1 - K.ALPHA} * min(list_distance(a.v, b.v)), 9) AS val FROM zz a JOIN s{k - 1} s ON s.grp = a.grp JOIN zz b ON b.seq_id = s.seq_id AND b.grp = s.grp "
            f"WHERE NOT EXISTS (FROM s{k - 1} t WHERE t.seq_id = a.seq_id) GROUP BY a.grp, a.seq_id, a.z), s{k} AS MATERIALIZED (FROM s{k - 1} UNION ALL SELECT grp, arg_min(seq_id, (-val, seq_id)), {k} FROM d{k} GROUP BY grp)"
        )
    return f"{text}{', ' + more if more else ''} {final}"


@add("sel_topk_diverse", topk_sql())
def sel_topk_diverse(spark, sf_dir):
    return select.topk_diverse(_pool(spark, sf_dir), "grp", "score_v2", _FEATURES, "hp4", "seq_id")


@add(
    "sel_best_quartile",
    f"WITH {Q.SEQS}, g AS (SELECT seq_id, list_sort(list_transform(regexp_extract_all(cds, '.{{10}}'), lambda b: {Q.letters('b', 'GC')} / 10.0)) AS l FROM seqs) "
    "SELECT seq_id, round(list_avg(l[1:greatest(1, len(l) // 4)]), 6) AS q25 FROM g",
)
def sel_best_quartile(spark, sf_dir):
    profile = F.transform(S.pieces(F.col("cds"), 10), lambda b: S.letters(b, "GC") / F.lit(10.0))
    return rounded(seqs_of(spark, sf_dir).select("seq_id", select.best_quartile(profile).alias("q25")))


_SYN = Q.values("syn", "codon, alt", [(c, a) for v in K.SYNONYMS.values() for c in v for a in v if a != c])


@add("join_synonyms", f"WITH {Q.CODON} SELECT a.codon, b.codon AS alt FROM codon a JOIN codon b ON a.aa = b.aa AND a.codon <> b.codon WHERE a.aa <> '*'")
def join_synonyms(spark, sf_dir):
    dim = codon_dimension(spark).where("aa <> '*'").select("codon", "aa")
    return dim.join(dim.select(F.col("codon").alias("alt"), "aa"), "aa").where("codon <> alt").select("codon", "alt")


@add("join_wobble", f"WITH {Q.CODON}, {Q.values('trna', 'anticodon, copies', sorted(K.COPIES.items()))}, {Q.values('wobble', 'a, b, s', [(a, b, s) for (a, b), s in K.PENALTY.items()])} SELECT codon.codon, round(sum((1 - s) * copies)::DOUBLE, 6) AS weight FROM codon JOIN trna ON reverse(translate(right(anticodon, 2), 'ACGT', 'TGCA')) = left(codon.codon, 2) JOIN wobble ON a = CASE WHEN left(anticodon, 1) = 'A' THEN 'I' ELSE left(anticodon, 1) END AND b = right(codon.codon, 1) WHERE aa <> '*' AND s < 1 GROUP BY codon.codon")
def join_wobble(spark, sf_dir):
    """Supply of tRNAs by sense codon, from the gene copies and the wobble table."""
    trna = spark.createDataFrame(sorted(K.COPIES.items()), "anticodon string, copies double")
    wobble = spark.createDataFrame([(a, b, s) for (a, b), s in K.PENALTY.items()], "first string, third string, s double").where("s < 1")
    tail = F.reverse(F.translate(F.substring("anticodon", 2, 2), "ACGT", "TGCA"))
    first = F.when(F.substring("anticodon", 1, 1) == "A", "I").otherwise(F.substring("anticodon", 1, 1))
    codons = codon_dimension(spark).where("aa <> '*'").select("codon", F.substring("codon", 1, 2).alias("head"), F.substring("codon", 3, 1).alias("third"))
    rows = trna.select(tail.alias("head"), first.alias("first"), "copies").join(codons, "head").join(wobble, ["first", "third"])
    return rounded(rows.groupBy("codon").agg(F.sum((1 - F.col("s")) * F.col("copies")).alias("weight")))


@add("search_variants_all", f"WITH {Q.SEQS}, {_SYN}, {Q.RAW_CODONS}, stop AS (SELECT seq_id, min(p) AS stop FROM rc WHERE c IN ('TAA', 'TAG', 'TGA') GROUP BY seq_id) SELECT rc.seq_id, (p - 1)::INT AS at, c AS codon, alt FROM rc JOIN syn ON rc.c = syn.codon LEFT JOIN stop USING (seq_id) WHERE stop IS NULL OR p < stop")
def search_variants_all(spark, sf_dir):
    return search.variants(seqs_of(spark, sf_dir), synonym_dimension(spark), "raw")


def _scorer(seqs: DataFrame, with_tai: bool) -> search.Scorer:
    counts = checkpoint(corpus.pair_counts(seqs))  # 4,096 rows
    return search.Scorer.of(counts, corpus.calibration(corpus.measured(seqs, counts)), with_tai)


@add("search_refine")
def search_refine(spark, sf_dir):
    """Steepest ascent of every sequence, eight rounds; no SQL (iterated argmax)."""
    seqs = seqs_of(spark, sf_dir)
    return rounded(search.refine(seqs, _scorer(seqs, True)))


@add("search_repair")
def search_repair(spark, sf_dir):
    """Repair of the longest duplexes of every sequence; no SQL (iterated argmin over rescans)."""
    seqs = seqs_of(spark, sf_dir)
    return rounded(search.repair(seqs, _scorer(seqs, False)))


@add("search_pipeline")
def search_pipeline(spark, sf_dir):
    """Refine, then repair each sequence; metrics before and after, as candidates for selection."""
    seqs = seqs_of(spark, sf_dir).where("cds <> ''")
    refined = search.refine(seqs, _scorer(seqs, True), PIPELINE_ROUNDS).select("seq_id", F.col("refined").alias("cds"), "score_start", F.col("score_end").alias("refined_score"), "n_moves")
    repaired = search.repair(refined, _scorer(seqs, False)).drop("score_before").withColumnRenamed("score_after", "repair_score")
    out = refined.join(repaired, "seq_id").select("seq_id", "score_start", "refined_score", "n_moves", "n_swaps", "selfcomp_before", "selfcomp_after", "repair_score", C.cai(F.col("cds")).alias("cai_pre"), S.motif_count(F.col("cds")).alias("sites_pre"), S.n_hp4(F.col("cds")).alias("hp4_pre"), S.n_hp5(F.col("cds")).alias("hp5_pre"), S.gc_content(F.col("cds")).alias("gc_pre"), F.col("repaired").alias("seq"))
    return rounded(out)


@add("search_start_two", f"WITH {Q.SEQS}, {Q.CODON}, {_BEST}, {Q.CDS_CODONS}, made AS (SELECT seq_id, string_agg(b, '' ORDER BY p) AS seq FROM cc JOIN codon ON cc.c = codon.codon JOIN best USING (aa) GROUP BY seq_id), pool AS (SELECT seq_id, 'native' AS source, cds AS seq FROM seqs WHERE cds <> '' UNION ALL SELECT seq_id, 'cai', seq FROM made) SELECT seq_id, source, length(seq) AS len, round({Q.gc('seq')}, 6) AS gc, {Q.sites('seq')} AS sites, {Q.runs('seq', 5)} AS hp5 FROM pool")
def search_start_two(spark, sf_dir):
    """Two of the starts for each sequence, as it is and by the most frequent codons, with their measured sites and runs."""
    seqs = seqs_of(spark, sf_dir).where("cds <> ''")
    seqs = seqs.select("seq_id", F.col("cds").alias("native"), C.back_translate(C.translate_a(F.col("cds"))).alias("cai"))
    # both are measured as columns of one row, so that a sequence is derived once
    kinds = ("native", "cai")
    sides = [{"len": F.length(c)} | L.together(F.col(c), lambda s: {"gc": S.gc_content(s), "sites": S.motif_count(s), "hp5": S.n_hp5(s)}) for c in kinds]
    both = F.array(*(F.struct(F.lit(c).alias("source"), *(v.alias(n) for n, v in side.items())) for c, side in zip(kinds, sides, strict=True)))
    return rounded(seqs.select("seq_id", F.explode(both).alias("x")).select("seq_id", "x.*"))


_GENES = f"cdsaa AS (SELECT seqs.seq_id, source, cds, coalesce(string_agg(aa, '' ORDER BY p), '') AS aa FROM seqs LEFT JOIN (SELECT * FROM cc JOIN codon ON cc.c = codon.codon) x USING (seq_id) GROUP BY seqs.seq_id, source, cds)"


def _proteins(seqs: DataFrame) -> DataFrame:
    """(protein, gene_symbol, aa): of each source its longest sequence's protein, of a source of an even length its first one's."""
    aa = C.translate_a(F.col("cds"))
    rows = seqs.select("seq_id", "source", "cds", aa.alias("aa"))
    best = rows.groupBy("source").agg(F.max_by("aa", F.struct(F.length("cds"), -F.col("seq_id"))).alias("longest"), F.min_by("aa", "seq_id").alias("first"))
    return best.select(F.concat(F.lit("p-"), "source").alias("protein"), F.col("source").alias("gene_symbol"), F.when(F.length("source") % 2 == 0, F.col("first")).otherwise(F.col("longest")).alias("aa"))


@add(
    "join_native",
    f"WITH {Q.SEQS}, {Q.CODON}, {Q.CDS_CODONS}, {_GENES}, best AS (SELECT source, arg_max(cds, (length(cds), -seq_id)) AS cds, arg_max(aa, (length(cds), -seq_id)) AS longest, arg_min(aa, seq_id) AS first FROM cdsaa GROUP BY source) "
    "SELECT 'p-' || source AS protein, cds AS seq FROM best WHERE longest = CASE WHEN length(source) % 2 = 0 THEN first ELSE longest END",
)
def join_native(spark, sf_dir):
    """Of each gene the longest sequence, kept if it translates to the gene's protein."""
    seqs = seqs_of(spark, sf_dir)
    corpus_rows = seqs.select(F.col("seq_id").alias("row_id"), F.col("source").alias("gene_symbol"), "cds")
    return corpus.native_starts(corpus_rows, _proteins(seqs))


@add("search_start_pool")
def search_start_pool(spark, sf_dir):
    """Three starts for each sequence's protein, with their length, GC, sites and runs; no SQL (a beam makes the clean ones)."""
    seqs = seqs_of(spark, sf_dir).where("cds <> ''")
    proteins = seqs.select("seq_id", C.translate_a(F.col("cds")).alias("aa"))
    pool = search.start_pool(proteins, seqs.select("seq_id", F.col("cds").alias("seq")))
    seq = F.col("seq")
    measured = L.together(seq, lambda s: {"gc": S.gc_content(s), "sites": S.motif_count(s), "hp5": S.n_hp5(s)})
    return rounded(pool.select("seq_id", "source", F.length(seq).alias("len"), *(c.alias(n) for n, c in measured.items()), F.md5(seq).alias("seq_md5")))


@add("search_variants_breaking")
def search_variants_breaking(spark, sf_dir):
    """Swaps that break a pair of a near-longest duplex, for every sequence; no SQL (arms come from the scan)."""
    return search.breaking(seqs_of(spark, sf_dir))


@add("sel_topk_candidates")
def sel_topk_candidates(spark, sf_dir):
    """Top candidates of each group from two starts of each sequence, first the one with the shortest duplex; no SQL (the scan)."""
    seqs = seqs_of(spark, sf_dir).where("cds <> ''")
    native = seqs.select("seq_id", "grp", F.lit("native").alias("source"), "cds")
    best = seqs.select("seq_id", "grp", F.lit("cai").alias("source"), C.back_translate(C.translate_a(F.col("cds"))).alias("cds"))
    pool = native.unionByName(best).withColumn("start_id", F.col("seq_id")).withColumn("seq_id", 2 * F.col("seq_id") + F.when(F.col("source") == "cai", 1).otherwise(0))
    counts = checkpoint(corpus.pair_counts(seqs))
    scored = score.with_scores(pool, counts, checkpoint(corpus.calibration(corpus.measured(seqs.select("seq_id", "cds"), counts))))
    scored = checkpoint(scored.withColumns({"enc": C.enc(F.col("cds")), "upa": S.dinuc_odds(F.col("cds"), "T", "A"), "hp_max": S.max_run(F.col("cds"), "ACGT").cast("double")}))
    rows = scored.join(duplex.selfcomp_scan(scored, "cds").select("seq_id", F.col("near").alias("selfcomp")), "seq_id")
    rows = rows.select(F.col("grp").alias("protein"), F.col("seq_id").alias("cand_id"), "source", F.col("score_v2").alias("score"), "z_nat", "cai", "gc", "sites", "selfcomp", F.col("cds").alias("seq"), "enc", "upa", "hp_max")
    return rounded(select.topk_rows(rows, _FEATURES))


@add("dup_selfcomp_scan")
def dup_selfcomp_scan(spark, sf_dir):
    """Longest exact and near-perfect duplex of every sequence; no SQL (stateful extension of each seed)."""
    return duplex.selfcomp_scan(seqs_of(spark, sf_dir), "cds")


@add("dup_scan_duplexes")
def dup_scan_duplexes(spark, sf_dir):
    return duplex.scan_duplexes(seqs_of(spark, sf_dir), "cds")


@add(
    "dup_join_seed_rc",
    f"WITH {Q.SEQS}, km AS (SELECT seq_id, i, cds[i + 1:i + 10] AS k FROM (SELECT seq_id, cds, unnest(range(0, length(cds) - 9)) AS i FROM seqs WHERE length(cds) >= 10)) "
    "SELECT a.seq_id, count(*) AS n_seeds FROM km a JOIN km b ON a.seq_id = b.seq_id AND b.k = reverse(translate(a.k, 'ACGT', 'TGCA')) AND b.i - a.i >= 13 GROUP BY a.seq_id",
)
def dup_join_seed_rc(spark, sf_dir):
    return duplex.seed_pairs(seqs_of(spark, sf_dir), seq="cds").groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_seeds"))


@add("rep_scorecard")
def rep_scorecard(spark, sf_dir):
    """The scorecard of every sequence, all of which is folded, window by window; the half-life, which needs a model, is null."""
    seqs = seqs_of(spark, sf_dir).where("cds <> ''").select("seq_id", "cds")
    counts = checkpoint(corpus.pair_counts(seqs))
    return score.scorecard(score.with_scores(seqs, counts), corpus.codon_pair_bias(seqs, counts), duplex.selfcomp_scan(seqs, "cds"), folding.folding(seqs, every=True))


@add("rep_immune_flag_scan")
def rep_immune_flag_scan(spark, sf_dir):
    """The flag with each sequence's longest duplex; no SQL (the scan)."""
    seqs = seqs_of(spark, sf_dir)
    rows = seqs.select("seq_id", "cds").join(duplex.selfcomp_scan(seqs, "cds").select("seq_id", "near"), "seq_id")
    s = F.col("cds")
    return rows.select("seq_id", "near", score.immune_flag(F.col("near"), S.urich_count(s), F.length(s), S.dinuc_odds(s, "C", "G")).alias("flag"))


_DUPLEX = "(length(cds) % 40)"
_IMMUNE = f"(CASE WHEN {_DUPLEX} >= {K.DUPLEX_HIGH} THEN 2 WHEN {_DUPLEX} >= {K.DUPLEX_MED} THEN 1 ELSE 0 END + (urich * 1000.0 / greatest(length(cds), 1) >= {K.URICH_PER_KB})::INT + ({Q.odds('cds', 'C', 'G')} >= {K.CPG_HIGH})::INT)"
scalar("rep_immune_flag", lambda raw, cds: {"flag": score.immune_flag(F.length(cds) % 40, S.urich_count(cds), F.length(cds), S.dinuc_odds(cds, "C", "G"))}, {"flag": f"{_IMMUNE}::BIGINT"}, Q.urich("cds"), "JOIN urich USING (seq_id)")
scalar("rep_te_comp", lambda raw, cds: {"te_comp": score.te_composite(C.cai(cds), C.tai(cds))}, {"te_comp": "round(0.6 * cai + 0.4 * coalesce(tai, 0), 3)"}, f"{Q.CODON}, {Q.WEIGHT}, {Q.CDS_CODONS}, {Q.CAI}, {Q.TAI}", "JOIN cai USING (seq_id) JOIN tai USING (seq_id)")
scalar("rep_init_comp", lambda raw, cds: {"init_comp": score.initiation_composite(cds, S.gc_content(cds), -20.0 * S.gc_content(raw))}, {"init_comp": f"round(0.5 * {Q.gc('cds')} + 0.4 * (1 - {Q.gc('raw')}) + 0.1 * (substr(cds, 7, 1) = 'G')::INT, 3)"})


@add("search_refine_main")
def search_refine_main(spark, sf_dir):
    """A folding dump refined: records, without repeats and stops, refined and summed up; no SQL (iterated argmax)."""
    seqs = seqs_of(spark, sf_dir).where("cds <> ''")
    records = seqs.select(F.col("grp").alias("protein"), (F.col("seq_id") % 5 / 2.0).alias("lam"), F.col("raw").alias("seq"), F.col("seq_id").alias("row_id"))
    return rounded(search.refine_records(records, _scorer(seqs, True)))


@add("rep_m2_refined")
def rep_m2_refined(spark, sf_dir):
    """Summary of a refinement of all sequences; no SQL (iterated argmax)."""
    return report.refine_summary(QUERIES["search_refine_main"](spark, sf_dir))


def _refined_like(spark, sf_dir) -> DataFrame:
    """raw as start and cds as end of a refinement, by language: the summary's SQL; rep_m2_refined has a real one."""
    return seqs_of(spark, sf_dir).select(
        F.col("grp").alias("protein"), F.lit(0.0).alias("lam_start"), F.round(S.gc_content(F.col("cds")) - S.gc_content(F.col("raw")), 4).alias("delta"), S.motif_count(F.col("raw")).alias("sites_start"), S.motif_count(F.col("cds")).alias("sites_end"), S.n_hp4(F.col("raw")).alias("hp4_start"), S.n_hp4(F.col("cds")).alias("hp4_end"), S.clean_flag(F.col("cds")).alias("hard_pass_end")
    )


@add(
    "rep_m2_summary",
    f"WITH {Q.SEQS} SELECT grp AS protein, count(*) AS n_starts, round(avg(round({Q.gc('cds')} - {Q.gc('raw')}, 4)), 3) AS delta_mean, round(max(round({Q.gc('cds')} - {Q.gc('raw')}, 4)), 3) AS delta_max, sum({Q.sites('raw')})::BIGINT AS sites_start_sum, sum({Q.sites('cds')})::BIGINT AS sites_end_sum, "
    f"sum({Q.runs('raw', 4)})::BIGINT AS hp4_start_sum, sum({Q.runs('cds', 4)})::BIGINT AS hp4_end_sum, sum(({Q.sites('cds')} = 0 AND {Q.runs('cds', 5)} = 0)::INT)::BIGINT AS hard_pass FROM seqs GROUP BY grp",
)
def rep_m2_summary(spark, sf_dir):
    return report.refine_summary(_refined_like(spark, sf_dir))


def _compared(spark, sf_dir, scan: bool = False) -> DataFrame:
    """What is compared, by language. The SQL takes the longest run of one base for the duplex, which it can't scan for."""
    more = lambda s: {"run": S.max_run(s, "ACGT")}
    rows = score.with_scores(seqs_of(spark, sf_dir).select("seq_id", "grp", "cds"), more=more, keep=scan)
    if scan:
        rows = rows.join(duplex.selfcomp_scan(rows, "cds").select("seq_id", F.col("near").alias("selfcomp")), "seq_id")
    else:
        rows = rows.withColumn("selfcomp", F.col("run"))
    return rows.select(F.col("grp").alias("engine"), "z_nat", "cai", "gc", ((F.col("sites") == 0) & (F.col("hp5") == 0)).cast("int").alias("clean"), "selfcomp", F.lit(None).cast("double").alias("mfe"), "tai")


_COMPARED = f"cmp AS (SELECT grp AS engine, count(*) AS n, avg(z_nat) AS z_nat, avg(cai) AS cai, avg(gc) AS gc, 100 * avg((sites = 0 AND hp5 = 0)::INT) AS clean, avg({Q.max_run('cds', 'ACGT')}) AS selfcomp, NULL::DOUBLE AS mfe, avg(tai) AS tai FROM scored GROUP BY grp)"


@add("rep_compare_stats", f"WITH {Q.SCORED}, {_COMPARED} SELECT engine, n, {', '.join(f'round({c}, 6) AS {c}' for c in report.METRICS[1:])} FROM cmp")
def rep_compare_stats(spark, sf_dir):
    return rounded(report.compare_stats(_compared(spark, sf_dir)))


@add("rep_compare_scan")
def rep_compare_scan(spark, sf_dir):
    """The comparison with the mean longest duplex of each engine; no SQL (the scan). mfe takes a folding backend."""
    return rounded(report.compare_stats(_compared(spark, sf_dir, scan=True)))


@add("rep_compare_pivot", f"WITH {Q.SCORED}, {_COMPARED} " + " UNION ALL ".join("SELECT '%s' AS metric, %s FROM cmp" % (m, ", ".join(f"round(max(CASE WHEN engine = '{e}' THEN {m} END), 6)::DOUBLE AS {e}" for e in ("de", "en", "es", "fr"))) for m in report.METRICS))
def rep_compare_pivot(spark, sf_dir):
    return rounded(report.compare_pivot(report.compare_stats(_compared(spark, sf_dir)), ["de", "en", "es", "fr"]))


@add("rep_console_table", f"WITH {Q.SCORED}, {_COMPARED} SELECT engine, format('{{:.3f}}', z_nat) AS z_nat, format('{{:.3f}}', cai) AS cai, '-' AS mfe FROM cmp")
def rep_console_table(spark, sf_dir):
    """Three decimals, a dash for null, as text."""
    stats = report.compare_stats(_compared(spark, sf_dir))
    return stats.select("engine", *(report.formatted(F.round(c, 6) + F.lit(1e-9) * F.signum(c)).alias(c) if c != "mfe" else report.formatted(F.col(c)).alias(c) for c in ("z_nat", "cai", "mfe")))


@add("rep_repair_report")
def rep_repair_report(spark, sf_dir):
    return rounded(report.repair_report(QUERIES["search_repair"](spark, sf_dir)))


@add("rep_union_schema", f"WITH {Q.SEQS} SELECT seq_id, 'a' AS pool, length(raw) AS len, NULL::DOUBLE AS gc FROM seqs UNION ALL SELECT seq_id, 'b', NULL, round({Q.gc('cds')}, 6) FROM seqs")
def rep_union_schema(spark, sf_dir):
    seqs = seqs_of(spark, sf_dir)
    parts = {"a": seqs.select("seq_id", F.length("raw").alias("len")), "b": seqs.select("seq_id", S.gc_content(F.col("cds")).alias("gc"))}
    return rounded(report.union_schema(parts, "pool"))


def _brackets(spark, sf_dir) -> DataFrame:
    """Dot-bracket strings: bases as signs, so that pairs of all three kinds occur."""
    return seqs_of(spark, sf_dir).select("seq_id", F.translate(F.regexp_replace(F.regexp_replace("cds", "AC", "["), "GT", "]"), "ACGT", ".().").alias("structure"))


_DB = """db AS (SELECT seq_id, translate(replace(replace(cds, 'AC', '['), 'GT', ']'), 'ACGT', '.().') AS ss FROM seqs),
ch AS (SELECT seq_id, q - 1 AS p, substr(ss, q, 1) AS c FROM (SELECT seq_id, ss, unnest(range(1, length(ss) + 1)) AS q FROM db)),
st AS (SELECT seq_id, p, CASE WHEN c IN ('(', ')') THEN 1 ELSE 2 END AS kind, CASE WHEN c IN ('(', '[') THEN 1 ELSE -1 END AS d FROM ch WHERE c <> '.'),
dp AS (SELECT *, sum(d) OVER (PARTITION BY seq_id, kind ORDER BY p) + (d < 0)::INT AS depth FROM st),
nx AS (SELECT *, lead(p) OVER w AS j, lead(d) OVER w AS n FROM dp WINDOW w AS (PARTITION BY seq_id, kind, depth ORDER BY p)),
prs AS (SELECT seq_id, p AS i, j FROM nx WHERE d = 1 AND n = -1),
hx AS (SELECT seq_id, min(i) AS i, count(*) AS length FROM (SELECT seq_id, i, i + j AS s, i - row_number() OVER (PARTITION BY seq_id, i + j ORDER BY i) AS run FROM prs) GROUP BY seq_id, s, run)"""


@add("struct_parse_db", f"WITH {Q.SEQS}, {_DB} SELECT seq_id, i::BIGINT AS i, j::BIGINT AS j FROM prs")
def struct_parse_db(spark, sf_dir):
    return structure.parse_db(_brackets(spark, sf_dir))


@add("struct_helix_lengths", f"WITH {Q.SEQS}, {_DB} SELECT seq_id, i::BIGINT AS i, length FROM hx")
def struct_helix_lengths(spark, sf_dir):
    return structure.helices(_brackets(spark, sf_dir))


@add("struct_features", f"WITH {Q.SEQS}, {_DB} SELECT db.seq_id, round(2 * coalesce(sum(h.length), 0) / greatest(length(ss), 1), 6)::DOUBLE AS paired_fraction, coalesce(max(h.length), 0)::BIGINT AS longest_helix, count(CASE WHEN h.length >= 8 THEN 1 END)::BIGINT AS n_helices8 FROM db LEFT JOIN hx h USING (seq_id) GROUP BY db.seq_id, ss")
def struct_features(spark, sf_dir):
    return rounded(structure.helix_features(_brackets(spark, sf_dir)))


@add("struct_fold_windows")
def struct_fold_windows(spark, sf_dir):
    """Least energy, structure and mean unpaired probability of every window of every sequence; no SQL (dynamic programming)."""
    rows = folding.fold_windows(folding.cut(seqs_of(spark, sf_dir)))
    return rounded(rows.withColumn("unpaired", structure.mean(F.col("unpaired"))))


@add("struct_fold_none", f"WITH {Q.SEQS} SELECT seq_id, NULL::DOUBLE AS mfe, 'none' AS structure_backend FROM seqs")
def struct_fold_none(spark, sf_dir):
    return structure.fold(seqs_of(spark, sf_dir), None).select("seq_id", "mfe", "structure_backend")


@add("struct_windows", f"WITH {Q.SEQS} SELECT seq_id, CASE WHEN length(cds) <= 150 THEN 1 ELSE (greatest(length(cds) - 200, 0) // 500) + 1 END AS n_windows FROM seqs")
def struct_windows(spark, sf_dir):
    return seqs_of(spark, sf_dir).select("seq_id", F.size(structure.windows(F.col("cds"))).alias("n_windows"))


@add("io_ld_dump", f"WITH {Q.SEQS} SELECT grp AS protein, translate(cds, 'T', 'U') AS seq, 0.5::DOUBLE AS lam, -1.5::DOUBLE AS mfe_reported, 0.75::DOUBLE AS cai_reported FROM seqs WHERE cds <> ''")
def io_ld_dump(spark, sf_dir):
    """Each sequence written out as a dump of its own, and read back."""
    text = F.concat(F.lit("@@PROTEIN "), F.col("grp"), F.lit("\n@@LAMBDA 0.5\nj=0j=1\nmRNA sequence:  "), F.translate("cds", "T", "U"), F.lit("\nmRNA structure: ...\nmRNA folding free energy: -1.50 kcal/mol; mRNA CAI: 0.750\n@@LAMBDA x\nmRNA sequence: AUG\n"))
    files = seqs_of(spark, sf_dir).select(F.col("seq_id").cast("string").alias("file"), text.alias("value"))
    return ld_dump.parse(files).select("protein", "seq", "lam", "mfe_reported", "cai_reported")


_TABLE_LINES = "\ufeff#,,\n" + "\n".join(f"{c.replace('T', 'U')},{a},{K.FREQ[c]}" for c, a in sorted(K.AMINO.items())) + "\nbad,line\n"


@add("scan_codon_table", f"WITH {Q.CODON} SELECT translate(codon, 'T', 'U') AS codon, aa, freq::DOUBLE AS freq, aa_max::DOUBLE AS aa_max FROM codon")
def scan_codon_table(spark, sf_dir):
    """A written table of codons, read by the reader."""
    return sequences.scan_codon_table(spark, write_file(spark, scratch(spark, "codons") + ".csv", _TABLE_LINES))


@add("scan_codon_table_2", f"WITH {Q.CODON} SELECT translate(codon, 'T', 'U') AS codon, aa, freq::DOUBLE AS freq, aa_max::DOUBLE AS aa_max FROM codon WHERE aa <> '*'")
def scan_codon_table_2(spark, sf_dir):
    return sequences.scan_codon_table(spark, write_file(spark, scratch(spark, "codons") + ".csv", _TABLE_LINES), with_stops=False)


@add("scan_trna", f"WITH {Q.values('trna', 'anticodon, copies', sorted(K.COPIES.items()))} SELECT anticodon, copies::DOUBLE AS copies FROM trna")
def scan_trna(spark, sf_dir):
    """A written table with comments and the anticodon of a stop, read by the reader."""
    lines = "\ufeff# gene copies\n# by anticodon\nanticodon\tcopies\n" + "\n".join(f"{a}\t{n}" for a, n in sorted(K.COPIES.items())) + "\nTCA\t1\n"
    return sequences.scan_trna(spark, write_file(spark, scratch(spark, "trna") + ".tsv", lines))


@add("scan_coefficients", f"WITH {_COEF} SELECT codon, opt_293T::DOUBLE AS opt_293T, opt_rpe::DOUBLE AS opt_rpe FROM coef")
def scan_coefficients(spark, sf_dir):
    """Two of the written columns of coefficients, under other names."""
    names = {"293T_endo": "opt_293T", "HeLa_endo": "opt_hela", "RPE_endo": "opt_rpe"}
    lines = "codon," + ",".join(names) + "\n" + "\n".join(f"{c.lower()}," + ",".join(repr(COEFFICIENTS[n][c]) for n in names.values()) for c in sorted(COEFFICIENTS["opt_rpe"]))
    return sequences.scan_coefficients(spark, write_file(spark, scratch(spark, "coef") + ".csv", lines), {"293T_endo": "opt_293T", "RPE_endo": "opt_rpe"})


@add("derived_sequences", f"WITH {Q.SEQS} SELECT seq_id, grp, source, raw, cds FROM seqs")
def derived_sequences(spark, sf_dir):
    return seqs_of(spark, sf_dir)


@add("scan_corpus", f"WITH {Q.SEQS} SELECT source AS gene_symbol, cds FROM seqs WHERE source IS NOT NULL AND cds <> ''")
def scan_corpus(spark, sf_dir):
    """The sequences in RNA letters, written as a corpus and read by the reader."""
    path = scratch(spark, "corpus")
    rows = seqs_of(spark, sf_dir).where("source is not null and cds <> ''")
    report.write_tsv(rows.select(F.col("source").alias("gene_symbol"), F.lower(F.translate("cds", "T", "U")).alias("cds"), "seq_id"), path, ["gene_symbol", "cds"])
    return sequences.scan_corpus(spark, path)


@add("scan_tsv", f"WITH {Q.SEQS} SELECT seq_id, grp, round({Q.gc('raw')}, 6) AS gc FROM seqs")
def scan_tsv(spark, sf_dir):
    """Written with fixed fields, extra columns left out, and read with a schema."""
    path = scratch(spark, "rows")
    report.write_tsv(seqs_of(spark, sf_dir).select("seq_id", "grp", "raw", S.gc_content(F.col("raw")).alias("gc")), path, ["seq_id", "grp", "gc"])
    return rounded(sequences.scan_tsv(spark, path, "seq_id long, grp string, gc double"))


def _protein_files(spark) -> str:
    folder = scratch(spark, "proteins")
    for a in sorted(K.SYNONYMS):
        write_file(spark, f"{folder}/p{a}.txt", f"M{a}\n {a * 3}\t{a}\n")
    return folder


_PROTEIN_ROWS = Q.values("p", "protein, aa", [(f"p{a}", f"M{a * 5}") for a in sorted(K.SYNONYMS)])


@add("scan_protein", f"WITH {_PROTEIN_ROWS} SELECT protein, aa FROM p")
def scan_protein(spark, sf_dir):
    return sequences.scan_protein(spark, _protein_files(spark))


@add("list_proteins", f"WITH {_PROTEIN_ROWS} SELECT protein FROM p")
def list_proteins(spark, sf_dir):
    return sequences.list_proteins(spark, _protein_files(spark))


@add("scan_demo_limit", f"WITH {_PROTEIN_ROWS} SELECT protein FROM p ORDER BY protein LIMIT 1")
def scan_demo_limit(spark, sf_dir):
    """The first protein alone, as a demonstration takes it."""
    return sequences.list_proteins(spark, _protein_files(spark)).limit(1)


@add("io_resumable", f"WITH {Q.SEQS} SELECT seq_id, grp, 1 + (seq_id % 3 <> 0)::INT AS run FROM seqs")
def io_resumable(spark, sf_dir):
    """Written in two runs, the second of which adds what the first left out."""
    rows, path = seqs_of(spark, sf_dir).select("seq_id", "grp"), scratch(spark, "resumed")
    report.write_resumable(rows.where("seq_id % 3 = 0").withColumn("run", F.lit(1)), path, ["seq_id", "grp"])
    report.write_resumable(rows.withColumn("run", F.lit(2)), path, ["seq_id", "grp"])
    return spark.read.parquet(path)


@add("io_saved_calibration", f"WITH {Q.SCORED} SELECT seq_id, round(z_nat, 6) AS z_nat, round(z_cai, 6) AS z_cai FROM scored")
def io_saved_calibration(spark, sf_dir):
    """Scores by a calibration that was written and read again."""
    rows, path = checkpoint(corpus.measured(seqs_of(spark, sf_dir).select("seq_id", "cds")).drop("cds")), scratch(spark, "calibration")
    corpus.save_calibration(corpus.calibration(rows), path)
    return rounded(corpus.z_scores(rows, corpus.load_calibration(spark, path)).select("seq_id", "z_nat", "z_cai"))


@add("io_appended_columns", f"WITH {Q.SEQS} SELECT seq_id, grp, length(raw) AS len, round({Q.gc('cds')}, 6) AS gc FROM seqs")
def io_appended_columns(spark, sf_dir):
    seqs = seqs_of(spark, sf_dir)
    added = seqs.select("seq_id", S.gc_content(F.col("cds")).alias("gc"), F.lit("not taken").alias("grp"))
    return rounded(report.with_columns_appended(seqs.select("seq_id", "grp", F.length("raw").alias("len")), added, scratch(spark, "appended"), "seq_id"))


@add("filter_source", f"WITH {Q.SEQS} SELECT seq_id FROM seqs WHERE source = (SELECT min(source) FROM seqs)")
def filter_source(spark, sf_dir):
    seqs = seqs_of(spark, sf_dir)
    return report.of_source(seqs, seqs.agg(F.min("source")).first()[0]).select("seq_id")


@add("sel_not_selected", f"WITH {Q.SEQS} SELECT seq_id FROM seqs WHERE seq_id % 7 <> 0")
def sel_not_selected(spark, sf_dir):
    seqs = seqs_of(spark, sf_dir)
    return select.not_selected(seqs.select("seq_id"), seqs.where("seq_id % 7 = 0"), "seq_id")


scalar(
    "codon_features",
    lambda raw, cds: C.codon_features(cds),
    {"cai": "cai::DOUBLE", "cai_excl_stop": "cai::DOUBLE", "gc3": "coalesce(gc3, 0)::DOUBLE", "enc": "enc::DOUBLE"},
    f"{Q.CODON}, {Q.CDS_CODONS}, {Q.CDS_CODONS.replace('cc AS', 'rc AS')}, {Q.CAI}, {Q.ENC}, g AS (SELECT seq_id, avg((right(c, 1) IN ('G', 'C'))::INT) AS gc3 FROM cc GROUP BY seq_id)",
    "JOIN cai USING (seq_id) JOIN enc USING (seq_id) LEFT JOIN g USING (seq_id)",
)
scalar("rule_gc_slide_wide", lambda raw, cds: {"ok": S.rule_features(raw, slide_lo=0.3, slide_hi=0.6)["rule_gc_slide_pass"]}, {"ok": "(lo >= 0.3 AND hi <= 0.6)::INT"}, Q.slide("raw"), "JOIN slide USING (seq_id)")
scalar("struct_mean", lambda raw, cds: {"m": structure.mean(F.transform(S.pieces(cds, 10), lambda b: S.letters(b, "GC") / F.lit(10.0)))}, {"m": f"coalesce(list_avg(list_transform(regexp_extract_all(cds, '.{{10}}'), lambda b: {Q.letters('b', 'GC')} / 10.0)), 0)::DOUBLE"})
scalar("struct_mfe_unpaired", lambda raw, cds: {"open": F.aggregate(structure.mfe_unpaired(F.translate(cds, "ACGT", ".().")), F.lit(0.0), lambda a, x: a + x)}, {"open": f"{Q.letters('cds', 'AT')}::DOUBLE"})
_DECAY = {"decay_293T": {"cai": -1.5, "gc3": 2.0}, "decay_hela": {"gc_global": 4.0}, "decay_rpe": {"cds_len": 0.01}, "decay_k562_slam": {"enc": 0.25}}
scalar(
    "score_half_life",
    lambda raw, cds: {"halflife_pct": score.half_life(C.feature_vector(cds, {}), {n: score.linear_head(w, 1.0) for n, w in _DECAY.items()})},
    {"halflife_pct": f"round((4 + -1.5 * cai + 2.0 * coalesce(gc3, 0) + 4.0 * {Q.gc('cds')} + 0.01 * length(cds) + 0.25 * enc) / 4.0, 1)"},
    f"{Q.CODON}, {Q.CDS_CODONS}, {Q.CDS_CODONS.replace('cc AS', 'rc AS')}, {Q.CAI}, {Q.ENC}, g AS (SELECT seq_id, avg((right(c, 1) IN ('G', 'C'))::INT) AS gc3 FROM cc GROUP BY seq_id)",
    "JOIN cai USING (seq_id) JOIN enc USING (seq_id) LEFT JOIN g USING (seq_id)",
)


@add("features_all")
def features_all(spark, sf_dir):
    """The feature table of every sequence; structure needs a folding backend, the duplex scan has no SQL."""
    none = F.lit(None).cast("double")
    rows = seqs_of(spark, sf_dir).select("seq_id", "source", none.alias("lam"), C.translate_a(F.col("cds")).alias("aa"), "cds", none.alias("mfe_reported"), F.lit(0.75).alias("cai_reported"))
    return rounded(features.featurize(rows))
