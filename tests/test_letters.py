"""Columns over Arrow arrays beside plain versions, row by row."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cistron.functions import codon as C
from cistron.functions import letters as L
from cistron.functions import sequence as S
from cistron.operators import corpus, score
from cistron.plans import queries
from cistron.sources.sequences import BASES, derived, from_documents
from pyspark.sql import functions as F

TEXTS = ["ATGAAACCCTAAGG", "", None, "é\U0001f600ATGNAA", "acgtACGT", "A" * 70, "GTAAGTAAGT" * 9, "GAATTCGAATTC", "GCGGCCGCGGCCGC", "TTTTTTTAATT", "TAATAGTGA", "GC" * 45 + "AT" * 40]


@pytest.fixture(params=[1, 1 << 21])
def rows(spark, request, monkeypatch):
    """Also with portions of one row."""
    monkeypatch.setattr(L, "TOGETHER", request.param)
    return spark.createDataFrame(list(enumerate(TEXTS)), "seq_id long, s string").repartition(2)


def test_columns_are_those_of_single_rows(rows):
    s = F.col("s")
    made = {"gc": S.gc_content(s), "hi": S.gc_slide_max(s), "lo": S.gc_slide_min(s), "run": S.max_run(s, "AT"), "hp4": S.n_hp4(s), "sites": S.motif_count(s), "donors": S.donor_count(s), "rich": S.urich_count(s), "odds": S.dinuc_odds(s, "T", "A"), "cai": C.cai(s), "aa": C.translate_a(s), "strict": C.translate_b(s), "last": C.stop_codon(s)}
    for r in rows.select("s", *(c.alias(n) for n, c in made.items())).collect():
        if r.s is None:
            assert r.gc is None and r.hi is None and r.rich is None and r.cai is None and r.aa is None and r.run == 0 and r["last"] == ""
            continue
        t, whole = r.s, [r.s[i : i + 3] for i in range(0, len(r.s) - 2, 3)]
        strong = [b in "GC" for b in t]
        assert r.gc == pytest.approx(sum(strong) / max(1, len(t))) and r["last"] == (whole[-1] if whole else "")
        windows = [sum(strong[p : p + 60]) / 60 for p in range(0, len(t) - 59, 10)] if len(t) > 60 else [r.gc]
        assert (r.hi, r.lo) == (pytest.approx(max(windows)), pytest.approx(min(windows)))
        assert r.run == max((len(x) for x in re.findall("A+|T+", t)), default=0) and r.hp4 == len(re.findall("A{4,}|C{4,}|G{4,}|T{4,}", t))
        assert r.sites == sum(t.count(m) for m in S.K.MOTIFS) and r.donors == sum(t.count(m) for m in S.K.DONORS)
        assert r.rich == sum(sum(b in "UT" for b in t[p : p + 6]) >= 4 for p in range(len(t) - 5))
        expected = t.count("T") * t.count("A") / max(1, len(t))
        assert r.odds == pytest.approx(t.count("TA") / expected if len(t) > 1 and expected else 0.0)
        aa = "".join(S.K.AMINO.get(c, "?") for c in whole)
        head = re.match("[^*]*", aa)[0]
        assert r.aa == re.match("[^*?]*", aa)[0] and r.strict == (None if "?" in head else head)
        assert (r.cai is None) == ("?" in aa)


def test_derived_sequences_and_pairs(rows, spark):
    docs = rows.select(F.col("seq_id").alias("doc_id"), F.col("s").alias("text"), F.lit("x").alias("lang"), F.lit("y").alias("source"))
    for r in derived(docs).collect():
        dna = "".join(BASES[ord(c.upper()) - 65] for c in TEXTS[r.seq_id] or "" if c.isascii() and c.isalpha())
        raw = dna[: len(dna) - len(dna) % 3]
        assert r.raw == raw and r.cds == "".join("C" + c[1:] if c in S.K.STOPS else c for c in (raw[i : i + 3] for i in range(0, len(raw), 3)))
    want: dict[str, int] = {}
    for t in TEXTS:
        for i in range(max(0, -((6 - len(t or "")) // 3))):
            want[t[3 * i : 3 * i + 6]] = want.get(t[3 * i : 3 * i + 6], 0) + 1
    assert dict(map(tuple, corpus.pair_counts(rows, "s").collect())) == want


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A file of one row group is read by one task, but not measured by one, whether its rows have ids or not."""
    letters = np.random.default_rng(5).choice(list("ACGTacgtxyz"), (400, 20_000))
    for ids in (range(400), [None] * 400):
        docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": ["".join(r) for r in letters], "lang": ["x"] * 400, "source": ["y"] * 400})
        pq.write_table(docs, tmp_path / "documents.parquet", row_group_size=400)
        dealt = from_documents(spark, str(tmp_path)).where("length(cds) > 0").groupBy(F.spark_partition_id()).count().collect()
        assert sum(n for _, n in dealt) == 400 and len(dealt) > 1 and max(n for _, n in dealt) < 200


def test_sequences_are_derived_once(spark):
    """What is measured of a sequence, or filters by it, doesn't derive it again, and no filter goes before the dealing."""
    docs = spark.createDataFrame([(1, "acgt" * 9, "x", "y")], "doc_id long, text string, lang string, source string")
    rows = derived(docs).where("cds <> ''").select("seq_id", *C.codon_features(F.col("cds")).values(), S.n_hp5(F.col("raw")), S.gc_content(F.col("raw")))
    best = derived(docs).select(C.back_translate(C.translate_a(F.col("cds"))).alias("s")).select(S.gc_content(F.col("s")), S.n_hp5(F.col("s")))
    for made, nested in ((rows, "run(run("), (best, "run(run(run(")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert nested not in plan and plan.index("hashpartitioning") > plan.rindex("run(")


def test_slices_of_arrays():
    some = pa.array(["xx", "ATG", None, "ATGé", ""]).slice(1)
    t = L.Texts(some)
    assert t.length.tolist() == [3, 0, 4, 0] and t.null.tolist() == [False, True, False, False] and t.numbers.tolist() == [14, 14]
    assert L.Texts(some.slice(0, 0)).n == 0 and L.spread(np.array([5, 0, 9]), np.array([2, 0, 1]), 3).tolist() == [5, 8, 9]


def test_scores_walk_no_array_letter_by_letter(spark):
    """No lambda over the codons of a row is left in the plan of the scores."""
    rows = spark.createDataFrame([(1, "g", "ATGAAACCC"), (2, "g", "ATGGGGCCCAAA")], "seq_id long, grp string, cds string")
    made = score.with_scores(rows, corpus.pair_counts(rows), corpus.calibration(corpus.measured(rows)))
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_measures_taken_together_are_those_taken_alone(rows):
    """One look at the letters gives what each measure gives by itself, nulls and all."""
    every = lambda s: {"gc": S.gc_content(s), "hi": S.gc_slide_max(s), "hp4": S.n_hp4(s), "sites": S.motif_count(s), "odds": S.dinuc_odds(s, "T", "A"), "cai": C.cai(s), "tai": C.tai(s), "enc": C.enc(s), "aa": C.translate_b(s)}
    made = [rows.select("seq_id", *(c.alias(n) for n, c in f(F.col("s"), every).items())) for f in (L.together, lambda s, f: f(s))]
    assert made[0].schema == made[1].schema and sorted(map(str, made[0].collect())) == sorted(map(str, made[1].collect()))
    assert rows.where("false").select(L.together(F.col("s"), every)["gc"].alias("gc")).collect() == []


def test_scores_look_at_a_sequence_once_and_leave_it(spark):
    """Scores come from one function over the letters; where no one asks for the sequences, they aren't written with the scores."""
    rows = spark.createDataFrame([(1, "g", "ATGAAACCC"), (2, "g", "ATGGGGCCCAAA")], "seq_id long, grp string, cds string")
    counts = corpus.pair_counts(rows)
    made = score.with_scores(rows, counts, corpus.calibration(corpus.measured(rows)), more=lambda s: {"enc": C.enc(s)}, keep=False)
    looks = [p for p in made._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in p and "cds" in p]
    assert looks and all(p.count("run(cds") == 1 for p in looks)
    scored = score.with_scores(rows, counts, keep=False)
    assert "cds" not in scored.columns and "cds" not in scored._jdf.queryExecution().executedPlan().toString()
    kept = score.with_scores(rows, counts).orderBy("seq_id")
    assert "cds" in kept.columns and kept.drop("cds").collect() == scored.orderBy("seq_id").collect()


def test_both_starts_come_from_one_derivation(spark, tmp_path):
    docs = spark.createDataFrame([(1, "acgt" * 9, "x", "y"), (2, "", "x", "y")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.QUERIES["search_start_two"](spark, str(tmp_path))
    assert made._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert sorted((r.seq_id, r.source, r.len) for r in made.collect()) == [(1, "cai", 36), (1, "native", 36)]
