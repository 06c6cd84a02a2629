"""Hand-made cases of the column functions."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cistron.functions import codon as C
from cistron.functions import constants as K
from cistron.functions import sequence as S
from cistron.operators import corpus, features, report, score, search, select, structure
from cistron.sources import ld_dump
from cistron.sources.sequences import scan_codon_table, scan_protein, scan_trna, scan_tsv


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "s string").select(build(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("build", "value", "expected"),
    [
        (S.gc_content, "", 0.0),
        (S.gc_content, "GATC", 0.5),
        (C.cai, "", 0.0),
        (C.cai, "AT", 0.0),
        (S.codons, "ATGAA", ["ATG"]),
        (S.codon_pairs, "ATGAAACCC", ["ATGAAA"]),
        (S.codon_pairs, "ATGAAACCCG", ["ATGAAA", "AAACCC"]),
        (S.codon_pairs, "ATGAAA", []),
        (lambda s: S.codon_pairs(s, include_last_pair=True), "ATGAAA", ["ATGAAA"]),
        (S.n_hp4, "AAAAACGGGGT", 2),
        (S.n_hp5, "AAAAACGGGGT", 1),
        (S.motif_count, "GAATTCGAATTC", 2),
        (S.motif_count, "GCGGCCGCGGCCGC", 1),
        (C.tai, "TAA", None),
        (C.translate_a, "ATGNNNAAA", "M"),
        (C.translate_b, "ATGNNNAAA", None),
        (C.translate_b, "ATGTAANNN", "M"),
        (C.stop_codon, "ATGTAAC", "TAA"),
        (C.back_translate, "MW", "ATGTGG"),
        (C.back_translate, "M?", None),
        (S.max_run, None, None),
        (S.revcomp_dna, "ACGN", "NCGT"),
        (S.revcomp_rna, "AUGC", "GCAU"),
        (S.urich_count, "UUUUUUU", 2),
        (S.urich_count, "UUUU", 0),
        (S.trim_stop, "ATGTAA", "ATG"),
        (S.hard_ok, "", 0),
        (C.enc, "ATG", 20.0),
        (S.gc_slide_max, "GC" * 20, 1.0),
    ],
)
def test_column(spark, build, value, expected):
    if build is S.max_run:
        build = lambda s: F.when(s.isNotNull(), S.max_run(s, "A"))
    got = one(spark, value, build)
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_golden_cai(spark):
    assert one(spark, "AUGAACGAUACGGAGGCGAUC", lambda s: C.cai(S.to_dna(s))) == pytest.approx(0.69470, abs=1e-5)


def test_weights():
    assert K.MAX_WEIGHT == 34 and K.WEIGHT["GCA"] == 34 and K.WEIGHT["TGC"] == 29 and K.WEIGHT["GCC"] == 26
    assert len(K.AMINO) == 64 and len(K.WEIGHT) == 61 and len(K.COPIES) == 61


def test_ld_dump(spark, tmp_path):
    text = "noise\n@@PROTEIN MG\n@@LAMBDA 0.5\nj=0\nmRNA sequence:  augGGC\nmRNA structure: (..).\nmRNA folding free energy: -3.20 kcal/mol; mRNA CAI: 0.784\n@@LAMBDA x\nmRNA sequence: AUG\n@@PROTEIN MA\n@@LAMBDA 1\nmRNA sequence: AUGGCC\n@@LAMBDA 2\n"
    (tmp_path / "d.txt").write_text(text)
    rows = sorted(ld_dump.scan_ld_dump(spark, str(tmp_path)).collect())
    assert [(r.protein, r.lam, r.seq) for r in rows] == [("MA", 1.0, "AUGGCC"), ("MG", 0.5, "AUGGGC")]
    assert rows[1].mfe_reported == -3.2 and rows[1].cai_reported == 0.784 and rows[1].structure_reported == "(..)." and rows[1].seq_id == "LD_len2_lam0.5"
    assert rows[0].mfe_reported is None


def test_scans(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿#,,\n" + "\n".join(f"{c},{a},{K.FREQ[c]}" for c, a in K.AMINO.items()))
    table = scan_codon_table(spark, str(tmp_path / "c.csv"))
    assert table.count() == 64 and {r.codon: r.aa_max for r in table.collect()}["CTA"] == 0.41
    assert scan_codon_table(spark, str(tmp_path / "c.csv"), with_stops=False).count() == 61
    (tmp_path / "bad.csv").write_text("AAA,K,1\n")
    with pytest.raises(ValueError, match="64"):
        scan_codon_table(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.tsv").write_text("﻿# note\nanticodon\tcopies\nAAC\t9\nTCA\t1\n")
    assert [tuple(r) for r in scan_trna(spark, str(tmp_path / "t.tsv")).collect()] == [("AAC", 9.0)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.txt").write_text("MK\nLV \n")
    assert [tuple(r) for r in scan_protein(spark, str(tmp_path / "p")).collect()] == [("x", "MKLV")]
    (tmp_path / "r.tsv").write_text("a\tb\n1\t\n")
    assert tuple(scan_tsv(spark, str(tmp_path / "r.tsv"), "a int, b double").first()) == (1, None)


def test_structure(spark):
    df = spark.createDataFrame([(1, "((..[))]"), (2, ""), (3, None), (4, "(()"), (5, ".((((((((...)))))))).")], "seq_id long, structure string")
    pairs = sorted(map(tuple, structure.parse_db(df).collect()))
    assert [(i, j) for s, i, j in pairs if s == 1] == [(0, 6), (1, 5), (4, 7)]
    assert [(i, j) for s, i, j in pairs if s == 4] == [(1, 2)]
    features = {r.seq_id: r for r in structure.helix_features(df).collect()}
    assert features[5].longest_helix == 8 and features[5].n_helices8 == 1 and features[2].longest_helix == 0


def test_helices_of_rows_are_those_of_pairs(spark):
    """Beside pairs and helices as rows; nothing is shuffled."""
    some = ["((..[))]", "", None, "(()", ".((((((((...)))))))).", "))((", "()()(((...)))", "([{}])" * 9, "((((((((((..))))))))))[[..]]", "((é..))"]
    df = spark.createDataFrame(list(enumerate(some)), "seq_id long, structure string").repartition(2)
    pairs = structure.parse_db(df)
    lengths: dict[int, list[int]] = {}
    for r in structure.helix_lengths(pairs).collect():
        lengths.setdefault(r.seq_id, []).append(r.length)
    made = structure.helix_features(df)
    for r in made.collect():
        own = lengths.get(r.seq_id, [])
        assert r.paired_fraction == pytest.approx(2 * sum(own) / max(1, len(some[r.seq_id] or ""))) and r.longest_helix == max(own, default=0) and r.n_helices8 == sum(n >= 8 for n in own)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert structure.helix_features(spark.createDataFrame([(None, "(...)")], "seq_id long, structure string")).first().longest_helix == 0


def test_pairs_and_helices_of_repeated_ids(spark):
    """As windows over rows of an id have them, ids repeated and null included; strings are shuffled, no row for a letter is."""
    some = [(1, "((..[))]"), (2, "(((...)))"), (2, "(((...)))"), (3, "(((..)))"), (3, ".[[..]]."), (None, "((..))"), (4, None), (5, ""), (6, "((((..))))((..))"), (7, "([{}])")]
    df = spark.createDataFrame(some, "seq_id long, structure string")
    chars = df.select("seq_id", F.posexplode(F.regexp_extract_all(F.coalesce("structure", F.lit("")), F.lit("(?s)."), F.lit(0))).alias("at", "c"))
    kind = F.ceil(F.nullif(F.position(F.col("c"), F.lit("()[]{}")), F.lit(0)) / 2)
    step = chars.select("seq_id", "at", kind.alias("kind"), F.when(F.col("c").isin("(", "[", "{"), 1).otherwise(-1).alias("d")).where("kind is not null")
    depth = step.withColumn("depth", F.sum("d").over(Window.partitionBy("seq_id", "kind").orderBy("at")) + F.when(F.col("d") < 0, 1).otherwise(0))
    same = Window.partitionBy("seq_id", "kind", "depth").orderBy("at")
    pairs = depth.withColumn("j", F.lead("at").over(same)).withColumn("next", F.lead("d").over(same)).where("d = 1 and next = -1").select("seq_id", F.col("at").alias("i"), "j")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(structure.parse_db(df)) == rows(pairs) and pairs.count() > 12
    made = structure.helices(df)
    assert rows(made) == rows(structure.helix_lengths(pairs))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert structure.helices(df.where("seq_id > 99")).collect() == []


class Flat:
    """A backend that pairs nothing, and knows no profile of sequences with a G in front."""

    def mfe(self, seq):
        return "." * len(seq), -float(len(seq))

    def unpaired(self, seq):
        return None if seq.startswith("G") else [0.25 + 0.5 * (i % 2) for i in range(len(seq))]


def test_folding(spark):
    rows = [(1, "ATG" * 20), (2, None), (3, "ATGC" * 900), (4, "GTG" * 30), (5, "AT")]
    seqs = spark.createDataFrame(rows, "seq_id long, cds string")
    folded = {r.seq_id: r for r in structure.fold(seqs, Flat()).collect()}
    assert folded[1].mfe == -60.0 and folded[1].acc_aug30 == 0.5 and folded[1].dg_start45 == -45.0 and folded[2].mfe is None
    assert folded[3].profile is None and len(folded[3].sampled_profiles) == 7 and folded[4].unpaired is None and folded[1].unpaired == 0.5
    got = {r.seq_id: r for r in structure.structure_features(seqs, Flat()).collect()}
    assert got[1].open_start45 == pytest.approx((22 * 0.75 + 23 * 0.25) / 45) and got[1].mean_unpaired == 0.5 and got[1].mean_unpaired_q25 == 0.25 and got[1].ensemble_ok == 1
    assert got[3].mean_unpaired == 0.5 and got[3].mean_unpaired_q25 is None and got[3].ensemble_ok == 0 and got[3].mfe_per_nt == -1.0
    assert got[4].ensemble_ok == 0 and got[4].open_start45 == 1.0 and got[2].open_start45 is None and got[1].longest_helix == 0
    fast = structure.structure_features(seqs, Flat(), fast=True)
    assert "mean_unpaired" not in fast.columns and {r.seq_id: r for r in fast.collect()}[1].open_start45 == got[1].open_start45
    assert {r.seq_id: r.open_start45 for r in structure.structure_features(seqs, None).collect()} == dict.fromkeys(range(1, 6))


def test_featurize(spark):
    rows = [(1, "s", 0.5, "MK", "ATGAAATAA", -3.0, 0.5), (2, None, None, None, "", None, None)]
    df = spark.createDataFrame(rows, "seq_id long, source string, lam double, aa string, cds string, mfe_reported double, cai_reported double")
    got = {r.seq_id: r for r in features.featurize(df, Flat()).collect()}
    assert got[1].translate_ok == 1 and got[1].stop_codon == "TAA" and got[1].protein_len == 2 and got[1].delta_mfe == -6.0 and got[1].delta_cai == pytest.approx(got[1].cai - 0.5)
    assert got[2].translate_ok is None and got[2].delta_mfe is None and got[2].seq_len == 0 and len(got[1]) == 42


def test_numbers(spark):
    some = ["AAA", "TTT", "ACG", "NNN", "AAN", "acg", "", "\x00AA", "A\x00A"]
    df = spark.createDataFrame([(c,) for c in some], "c string")
    assert [r.n for r in df.select(C.number(F.col("c")).alias("n")).collect()][:5] == [0, 63, 6, -1, -1]
    pairs = df.select(C.pair_numbers(F.lit("AAATTTNNNACGACG")).alias("p")).first().p
    assert pairs == [63, -1, -1] and df.select(C.pair_numbers(F.lit("AAATTT"), True).alias("p")).first().p == [63]


def test_naturalness_of_other_letters(spark):
    seqs = spark.createDataFrame([(1, "AAATTTAAATTT"), (2, "NNNAAATTTAAA"), (3, ""), (4, "AAA")], "seq_id long, cds string")
    counts = corpus.pair_counts(seqs.where("seq_id = 1"))  # AAATTT, TTTAAA
    got = {r.seq_id: r.nat for r in corpus.naturalness(seqs, counts).collect()}
    seen, none = math.log(2 / 4098), math.log(1 / 4098)
    assert got[1] == pytest.approx(seen) and got[2] == pytest.approx((none + seen) / 2) and got[3] == got[4] == 0.0


def test_ranks_of_a_large_group(spark):
    df = spark.range(3000).selectExpr("id seq_id", "if(id % 10 = 0, 'b', if(id % 10 = 1, null, 'a')) grp", "double(id % 37) score_v25").repartition(7)
    got = score.rank_in_groups(df).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r.grp == g), key=lambda r: (-r.score_v25, r.seq_id))
        assert [r.place for r in mine] == list(range(1, len(mine) + 1)) and mine


def test_resumable(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("1", None, 5), (None, "x", 6)], "k string, l string, v int")
    assert report.write_resumable(first, path, ["k", "l"]).count() == 2
    more = spark.createDataFrame([("1", None, 9), (None, "x", 9), ("2", "x", 7), (None, None, 8)], "k string, l string, v int")
    assert sorted(r.v for r in report.write_resumable(more, path, ["k", "l"]).collect()) == [7, 8]
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [5, 6, 7, 8] and spark.read.parquet(path).schema["k"].dataType.simpleString() == "string"


def test_topk(spark):
    rows = [("g", i, float(i % 7), float(i % 3), float(i * i % 11)) for i in range(40)] + [("h", 99, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, id long, s double, x double, y double")
    got = sorted(map(tuple, select.topk_diverse(df, "g", "s", ["x", "y"], "x", "id").collect()))
    import statistics as st

    pool = [r for r in rows if r[0] == "g"]
    z = lambda k: [(r[k] - st.mean(p[k] for p in pool)) / max(1e-9, st.pstdev([p[k] for p in pool])) for r in pool]
    zs, zx, zy = z(2), z(3), z(4)
    top = max(r[2] for r in pool)
    picked = [min((i for i, r in enumerate(pool) if r[2] >= top - 0.5), key=lambda i: (pool[i][3], i))]
    while len(picked) < 5:
        near = {i: min(((zx[i] - zx[s]) ** 2 + (zy[i] - zy[s]) ** 2) ** 0.5 for s in picked) for i in range(40) if i not in picked}
        picked.append(min(near, key=lambda i: (-round(0.5 * zs[i] + 0.5 * near[i], 9), i)))
    assert got == [("g", k + 1, i) for k, i in enumerate(picked)] + [("h", 1, 99)]


def test_synonyms_keep_proteins():
    assert all(K.AMINO[search._CODONS[a]] == K.AMINO[c] for c, alts in zip(search._CODONS, search._ALT, strict=True) for a in alts)
