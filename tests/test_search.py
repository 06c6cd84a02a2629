"""Search and duplexes beside plain versions of their rules."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cistron import catalog
from cistron.functions import constants as K
from cistron.operators import duplex, report, search, select
from cistron.plans import queries

RNG = np.random.default_rng(5)
SCORER = search.Scorer(np.log(RNG.random((64, 64)) / 4096), (-9.0, 0.3), (0.7, 0.05), (0.3, 0.05))
PAIR = {"A": "T", "T": "A", "G": "C", "C": "G"}


def grown(seq, i, j, k, budget):
    x1, x2, y1, y2, spent = i, i + k - 1, j, j + k - 1, 0
    while True:
        moved = False
        for side in ("in", "out"):
            a, b = (x2 + 1, y1 - 1) if side == "in" else (x1 - 1, y2 + 1)
            if (side == "in" and b <= a) or (side == "out" and (a < 0 or b >= len(seq))):
                continue
            match = PAIR.get(seq[a]) == seq[b]
            if match or spent < budget:
                spent += not match
                moved = True
                x1, x2, y1, y2 = (x1, a, b, y2) if side == "in" else (a, x2, y1, b)
        if not moved:
            return x1, x2, y1, y2


def all_arms(seq, k, budget):
    n = len(seq)
    back = lambda s: "".join(PAIR[c] for c in reversed(s))
    return {grown(seq, i, j, k, budget) for i in range(n - k + 1) for j in range(i + k + 3, n - k + 1) if seq[j : j + k] == back(seq[i : i + k])}


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=10, max_size=40), st.text("ACGT", max_size=6), st.integers(0, 60))
def test_scan_is_all_extensions(half, loop, flip):
    seq = half + loop + "".join(PAIR[c] for c in reversed(half))
    seq = seq[:flip] + "A" + seq[flip + 1 :]
    codes = duplex.codes_of(seq)
    arms = all_arms(seq, 10, 2)
    best = max((b - a + 1 for a, b, _, _ in arms), default=0)
    scan = duplex.Scan(codes)
    assert scan.best == best and set(map(tuple, scan.arms.tolist())) == arms
    _, exact, near = duplex.longest(codes)
    assert near == best and near >= exact and (exact == 0 or exact >= 10)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["AT", "GC", "ACGT", "AAAT", "CAG", "G"]), min_size=8, max_size=30), st.text("ACGTN", min_size=20, max_size=40), st.integers(0, 30), st.integers(0, 2))
def test_reach_is_the_walk(parts, rest, place, budget):
    """Arms found from mismatches are those of the walk, with and without three bases replaced."""
    half = "".join(parts)
    codes = duplex.codes_of(half + rest[:5] + "".join(PAIR[c] for c in reversed(half)) + rest)
    found = list(duplex.seeds(codes, 6))
    if not found:
        return
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    bases = np.tile(np.array([0, 2, 1]), (len(i), 1))
    new = codes.copy()
    new[place : place + 3] = [0, 2, 1]
    fits = (new[i[:, None] + np.arange(6)] + new[j[:, None] + 5 - np.arange(6)] == 3).all(axis=1) & (new[i[:, None] + np.arange(6)] < 4).all(axis=1)
    for now, some, swapped in ((codes, np.ones(len(i), bool), None), (new, fits, (np.full(int(fits.sum()), place), bases[fits]))):
        if some.any():
            walked = [grown("".join("ACGTN"[b] for b in now), a, b, 6, budget) for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True)]
            x1, x2 = duplex.reach(codes, i[some], j[some], 6, budget, swapped)
            assert list(zip(x1.tolist(), x2.tolist(), strict=True)) == [w[:2] for w in walked]


@pytest.mark.parametrize("chunk", [8, 1 << 18])
def test_sequences_side_by_side(chunk, monkeypatch):
    """Scans of sequences together are each as by itself, with seeds in small chunks too."""
    monkeypatch.setattr(duplex, "CHUNK", chunk)
    rng = np.random.default_rng(12)
    arm = lambda n: "".join(rng.choice(list("ACGT"), n))
    back = lambda s: "".join(PAIR[c] for c in reversed(s))
    halves = [arm(n) for n in (10, 12, 40, 90)]
    some = [h + arm(d) + back(h) for h in halves for d in (0, 3, 7)] + ["", "ACG", "AT" * 60, "N" * 30, "GC" * 20 + "n" + "at" * 15, arm(400), arm(9) + halves[0]]
    for _, n, codes, start, length in duplex.side_by_side(pa.array([*some, None])):
        assert n == len(some) + 1
        found = duplex.longest_of(codes, start, length)
        best, row, arms = duplex.spans_of(codes, start, length)
        for r, s in enumerate(some):
            assert tuple(found[:, r].tolist()) == duplex.longest(duplex.codes_of(s))
            one = duplex.spans(duplex.codes_of(s))
            assert best[r] == one[0] and arms[row == r].tolist() == one[1].tolist()


def test_seed_pairs_of_repeated_ids(spark, monkeypatch):
    """Rows with one id meet as the join of their k-mers has them, nulls and other letters have none; only sequences are shuffled."""
    monkeypatch.setattr(duplex, "BESIDE", 64)
    one = "ACGTTGCAACTTTAAAGTTGCAACGT"
    rows = [(1, one), (2, "GGGGGGGGGGAAA"), (2, "A" * 20 + "CCCCCCCCCC"), (None, one), (3, None), (4, one.lower()), (5, "AT" * 30), (6, "ACGTNNNNNN" * 4)]
    df = spark.createDataFrame(rows, "seq_id long, raw string")
    a = duplex.kmers(df)
    b = a.select("seq_id", F.reverse(F.translate("kmer", "ACGT", "TGCA")).alias("kmer"), F.col("at").alias("j"))
    want = sorted(tuple(r) for r in a.join(b, ["seq_id", "kmer"]).where("j - at >= 13").select("seq_id", "at", "j").collect())
    got = duplex.seed_pairs(df)
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} == {1, 2, 5}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_merged_runs():
    runs = duplex.merged(np.array([1, 1, 0, 1, 1]), np.array([5, 0, 0, 3, 9]), np.array([6, 4, 9, 3, 9]))
    assert [r.tolist() for r in runs] == [[0, 1, 1], [0, 0, 9], [9, 6, 9]]
    cut = duplex.without((np.array([0, 1]), np.array([0, 5]), np.array([9, 6])), np.array([3, 8]), np.array([4, 9]))
    assert sorted(zip(*(c.tolist() for c in cut), strict=True)) == [(0, 0, 2), (0, 5, 9), (1, 5, 6)]


@pytest.mark.parametrize("kind", ["hairpin", "periodic", "stop", "two"])
def test_best_swap_is_the_rule(kind, monkeypatch):
    """Among all swaps that break a pair: gates, then the shortest duplex, then the score, then the first."""
    monkeypatch.setattr(search, "FIRST", 2)
    plain = search.Scorer(SCORER.pair_log, (-9.0, 3.0), (0.7, 0.5), None)
    rng = np.random.default_rng(len(kind))
    sense = [x for x in range(64) if search._SENSE[x]]
    compared = 0
    for _ in range(6):
        half = rng.choice(sense, 9)
        back = lambda h: search.codon_numbers("".join(PAIR[b] for b in reversed(search._letters(h))))
        c = np.concatenate([half, rng.choice(sense, 3), back(half), rng.choice(sense, 20)])
        if kind == "periodic":
            c = search.codon_numbers("AT" * 36 + search._letters(rng.choice(sense, 10)) + "GCAT" * 6)
        elif kind == "stop":
            c = np.insert(c, 5, search._NUMBER["TAA"])
        elif kind == "two":
            c = np.concatenate([c, c])
        scan = duplex.Scan(search._BASES[c].ravel())
        base = search._metrics(c, plain)
        options = []
        for i, x in search.variants_breaking(c, scan.near_best()):
            d = c.copy()
            d[i] = x
            m, length = search._metrics(d, plain), duplex.Scan(search._BASES[d].ravel()).best
            if length < scan.best and search._within_gates(m, base):
                options.append(((length, -round(m[0], 9), i, x), d))
        got = search.best_swap(c, plain, scan, base)
        want = min(options, key=lambda o: o[0], default=None)
        assert (got is None) == (want is None)
        if want:
            compared += 1
            assert got[0] == want[0][0] and got[1].tolist() == want[1].tolist()
    assert compared or kind == "periodic"


def test_spacing():
    arm = "ACGTTGCAAC"
    back = "".join(PAIR[c] for c in reversed(arm))
    assert duplex.longest(duplex.codes_of(arm + "TTT" + back))[1] >= 10
    assert duplex.longest(duplex.codes_of("A" * 22)) == (0, 0, 0)


def test_all_scores_are_full_scores():
    for n in (1, 2, 3, 40):
        c = RNG.choice([x for x in range(64) if search._SENSE[x]], n)
        at, alt, value = search.all_scores(c, SCORER, n)
        for i, a, v in zip(at, alt, value, strict=True):
            d = c.copy()
            d[i] = a
            assert v == pytest.approx(search.score(d, SCORER), abs=1e-9)


def test_refine_and_repair_keep_the_protein():
    protein = lambda c: [K.AMINO[search._CODONS[x]] for x in c]
    half = RNG.choice([x for x in range(64) if search._SENSE[x]], 12)
    back = np.concatenate([half, [0], search.codon_numbers("".join(PAIR[b] for b in reversed(search._letters(half))))])
    stops = np.flatnonzero(~search._SENSE[back])
    back[stops] = 0
    refined, start, end, moves = search.refine_one(back, SCORER, 5)
    assert end >= start and moves <= 5 and protein(refined) == protein(back)
    plain = search.Scorer(SCORER.pair_log, SCORER.nat, SCORER.cai, None)
    fixed, swaps, before, after, s0, s1 = search.repair_one(back, plain)
    assert after <= before and protein(fixed) == protein(back) and (swaps == 0 or s1 >= s0 - K.GATE_SCORE - 1e-9)


@pytest.mark.parametrize("scorer", [SCORER, search.Scorer(SCORER.pair_log, (-9.0, 0.0), (0.7, 0.5), None)])
def test_refined_side_by_side(scorer):
    """Sequences together are each as by itself: lengths down to none, stops, motifs, runs over codons, other rounds."""
    rng = np.random.default_rng(8)
    some = [rng.integers(0, 64, n) if n % 2 else rng.choice(np.flatnonzero(search._SENSE), n) for n in (0, 1, 2, 3, 4, 7, 30, 61, 200, 64)]
    some += [search.codon_numbers(s) for s in ("GAATTCGAATTC" * 5, "GCGGCCGCGGCCGCA", "AAAAAAAAATTTTTTGGG" * 4, "TAA", "GGTCTCAAAAAAAGGATCC")]
    n = np.array([len(c) for c in some])
    for rounds in (1, 25):
        out, start, end, moves = search.refine_many(np.concatenate(some), n, scorer, rounds)
        for c, z, m, s, e, k in zip(some, np.cumsum(n), n, start, end, moves, strict=True):
            want = search.refine_one(c, scorer, rounds)
            assert out[z - m : z].tolist() == want[0].tolist() and k == want[3]
            assert (s, e) == (pytest.approx(want[1], abs=1e-9), pytest.approx(want[2], abs=1e-9))
    assert moves.max() > 3


def test_refine_frame(spark):
    df = spark.createDataFrame([(1, "ATGAAACCC"), (2, None), (3, "ATGNNN"), (4, "")], "seq_id long, cds string")
    got = {r.seq_id: r for r in search.refine(df, SCORER).collect()}
    assert got[1].n_moves >= 0 and got[2].refined is None and got[3].refined is None and got[4].refined == ""


def test_repair_is_registered_and_refines_to_the_end(spark, monkeypatch):
    """The three queries on repair are in the registry; the pipeline refines for up to 25 rounds."""
    assert {"search_repair", "search_pipeline", "rep_repair_report"} <= set(catalog.queries())
    seqs = spark.createDataFrame([(1, "g", "s", "ATGGCTGCTGCTTAA", "ATGGCTGCTGCT")], "seq_id long, grp string, source string, raw string, cds string")
    seen = []
    refine = search.refine
    monkeypatch.setattr(queries, "seqs_of", lambda *_: seqs)
    monkeypatch.setattr(search, "refine", lambda s, scorer, rounds=8, seq="cds": seen.append(rounds) or refine(s, scorer, rounds, seq))
    assert catalog.queries()["search_pipeline"](spark, "").count() == 1 and seen == [25]


def test_clean_start():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300):
        aa = "".join(rng.choice(sorted(K.SYNONYMS), n))
        seq = search.clean_start(aa)
        assert "".join(K.AMINO[seq[i : i + 3]] for i in range(0, len(seq), 3)) == aa
        assert not any(m in seq for m in K.MOTIFS)
        assert all(0.3 <= sum(b in "GC" for b in seq[i : i + 60]) / 60 <= 0.7 for i in range(len(seq) - 59))
    # without constraints in the way it takes the best codons; a constraint that can't be kept is broken
    assert search.clean_start("MKL") == "ATGAAGCTG" and search.clean_start("M?") is None
    assert len(search.clean_start("K" * 40)) == 120 and search.clean_start("EF") != "GAATTC"


def test_start_pool(spark):
    proteins = spark.createDataFrame([(1, "MEFK"), (2, None), (3, "M?")], "seq_id long, aa string")
    native = spark.createDataFrame([(1, "ATGGAATTTAAA"), (2, None)], "seq_id long, seq string")
    got = {(r.seq_id, r.source): r.seq for r in search.start_pool(proteins, native).collect()}
    assert set(got) == {(1, "clean"), (1, "native"), (1, "cai")} and got[1, "cai"] == "ATGGAGTTCAAG" and got[1, "native"] == "ATGGAATTTAAA"


def test_breaking(spark):
    """All swaps beside the rule spelt out: codons from an arm's first base to the one before its last, that unpair a base."""
    half = "ATGGCCAAGCTGTCA"
    seq = half + "AAACCCAAA" + "".join(PAIR[b] for b in reversed(half))
    codes = duplex.codes_of(seq)
    arms = duplex.spans(codes)[1]
    want = set()
    for x1, x2, y1, y2 in arms.tolist():
        for a, b in ((x1, x2), (y1, y2)):
            for i in range(a // 3, min((b - 1) // 3, len(seq) // 3 - 1) + 1):
                codon = seq[3 * i : 3 * i + 3]
                for alt in K.SYNONYMS.get(K.AMINO[codon], []):
                    new = seq[: 3 * i] + alt + seq[3 * i + 3 :]
                    for u1, u2, v1, v2 in arms.tolist():
                        if alt != codon and any(PAIR[new[p]] != seq[u1 + v2 - p] for p in range(3 * i, 3 * i + 3) if u1 <= p <= u2 or v1 <= p <= v2):
                            want.add((1, i, alt))
    df = spark.createDataFrame([(1, seq), (2, None), (3, ""), (4, "ATGNNN")], "seq_id long, cds string")
    assert set(map(tuple, search.breaking(df).collect())) == want and want


def test_refined_records(spark):
    rows = [("p", 0.5, "augaaagcugcu", 1), ("p", 1.0, "AUGAAAGCUGCUUAA", 2), ("p", 2.0, "AUGGCU", 3), ("q", 0.5, "AUGAAAGCUGCU", 4)]
    df = spark.createDataFrame(rows, "protein string, lam double, seq string, row_id long")
    got = {r.row_id: r for r in search.refine_records(df, SCORER).collect()}
    assert set(got) == {1, 3, 4} and got[1].cds_len == 12 and got[1].lam_start == 0.5
    assert got[1].cds_refined == got[4].cds_refined and got[1].delta == pytest.approx(got[1].score_end - got[1].score_start, abs=2e-4) and got[1].delta >= 0


def test_repair_report(spark):
    rows = [(1, 2, 20, 12, 1.0, 1.5), (2, 0, 9, 9, 0.0, 0.0), (3, 1, 16, 14, 2.0, 1.9)]
    df = spark.createDataFrame(rows, "seq_id long, n_swaps int, selfcomp_before int, selfcomp_after int, score_before double, score_after double")
    r = report.repair_report(df).first()
    assert (r.n, r.before_mean, r.after_mean) == (2, 18.0, 13.0) and r.delta_mean == pytest.approx(0.2) and r.delta_min == pytest.approx(-0.1)


def test_topk_candidates(spark):
    """First the shortest duplex among close scores, then diversity; ranks and fields of the selection."""
    rows = [("p", i, "s", 5.0 - 0.1 * i, 0.0, 0.5, 0.5, 0, 20 - i, f"ATG{i}", float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "protein string, cand_id long, source string, score double, z_nat double, cai double, gc double, sites int, selfcomp int, seq string, x double")
    got = sorted(select.topk_rows(df, ["x"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and got[0].seq == "ATG5" and got[0].selfcomp == 15 and got[0].__fields__ == ["protein", "rank", "source", "score", "z_nat", "cai", "gc", "sites", "selfcomp", "seq"]


def plain_clean(aa):
    """The beam for one protein, partial sequences one by one."""
    full, beam = (1 << K.GC_WINDOW) - 1, [(0.0, "", 0, "")]
    for k, a in enumerate(aa):
        best = {}
        for value, tail, bits, made in beam:
            for c in K.SYNONYMS[a]:
                b = (bits << 3) | sum((x in "GC") << (2 - i) for i, x in enumerate(c))
                bad = sum(m in tail + c and m not in tail for m in K.MOTIFS)
                bad += sum(3 * k + 3 - d >= K.GC_WINDOW and not 18 <= (b >> d & full).bit_count() <= 42 for d in range(3))
                key, v = ((tail + c)[-7:], b & (full << 2 | 3)), value + float(search.C._LOG_W[c]) - search.BROKEN * bad
                if key not in best or v > best[key][0]:
                    best[key] = (v, *key, made + c)
        each = {}
        for x in sorted(best.values(), key=lambda x: -x[0]):
            each.setdefault((x[2] & full).bit_count(), x)
        beam = list(each.values())[: search.BEAM]
    return beam[0][3]


@pytest.mark.parametrize("apart", [1, 1000])
def test_clean_starts_side_by_side(spark, monkeypatch, apart):
    """Many proteins beside the plain beam, ties and broken constraints included; a step serves all of them."""
    monkeypatch.setattr(search, "_APART", apart)
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list(letters), n)) for letters in (sorted(K.SYNONYMS), "SRLAPG", "KNFIY") for n in (1, 2, 3, 19, 20, 21, 64, 90)]
    made += ["K" * 70, "G" * 70, "EF" * 30, "", "", "SR" * 40]
    steps, by_value = [], search._by_value
    monkeypatch.setattr(search, "_by_value", lambda *x: steps.append(1) or by_value(*x))
    got = search._clean(search.pa.array([*made, None, "M?", "é"])).to_pylist()
    assert got == [*map(plain_clean, made), None, None, None]
    assert apart == 1 or len(steps) == max(map(len, made))
    assert search._clean(search.pa.array([], search.pa.string())).to_pylist() == []


def test_like_sequences_are_repaired_once(spark, monkeypatch, tmp_path):
    """Rows with one sequence go to one task and are walked once there; each row has its result."""
    half = "ATGGCCAAGCTGTCA"
    long = half + "AAACCCAAA" + "".join(PAIR[b] for b in reversed(half))
    repair_one = search.repair_one

    def counted(c, *more):
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text(search._letters(c))
        return repair_one(c, *more)

    monkeypatch.setattr(search, "repair_one", counted)
    rows = [(i, (long, long + "GCT", "ATGAAACCC", "", None, "ATGNNN")[i % 6]) for i in range(60)]
    plain = search.Scorer(SCORER.pair_log, (-9.0, 3.0), (0.7, 0.5), None)
    got = {r.seq_id: r for r in search.repair(spark.createDataFrame(rows, "seq_id long, cds string"), plain).collect()}
    assert sorted(f.read_text() for f in tmp_path.iterdir()) == [long, long + "GCT"] and len(got) == 60
    for i, s in rows:
        if s in (None, "ATGNNN"):
            assert got[i].repaired is None and got[i].n_swaps is None
        else:
            want = repair_one(search.codon_numbers(s), plain)
            assert (got[i].repaired, *got[i][2:5]) == (search._letters(want[0]), *want[1:4]) and (got[i].score_before, got[i].score_after) == (pytest.approx(want[4]), pytest.approx(want[5]))


def test_stretches_of_seeds():
    """Runs of seeds from sorted numbers are those of merged()."""
    rng = np.random.default_rng(6)
    i, j = rng.integers(0, 20, 150), rng.integers(20, 40, 150)
    seeds = np.unique(np.stack([i + j, i], axis=1), axis=0)
    want = duplex.merged(seeds[:, 0], seeds[:, 1], seeds[:, 1])
    mixed = rng.permutation(seeds[:, 0] * 40 + seeds[:, 1])
    assert [x.tolist() for x in duplex.stretches([mixed[:70], mixed[70:]], 40)] == [x.tolist() for x in want]
    assert [len(x) for x in duplex.stretches([], 40)] == [0, 0, 0]


def test_proteins_of_like_length_are_taken_together(spark, monkeypatch, tmp_path):
    """A portion has proteins of like length, so that few steps serve a long one alone; like proteins are walked once."""
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(sorted(K.SYNONYMS), n)) for n in [3, 90, 5, 80, 4, 85, 6, 95] * 4]
    rows = [(i, (made + made[:8] + [None, "M?", ""])[i]) for i in range(43)]
    clean = search._clean

    def counted(strings):
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text(" ".join(s for s in strings.to_pylist() if s and s != "M?"))
        return clean(strings)

    monkeypatch.setattr(search, "_clean", counted)
    monkeypatch.setattr(search, "ABREAST", 100)
    got = {r.seq_id: r.seq for r in search.clean_starts(spark.createDataFrame(rows, "seq_id long, aa string").repartition(3)).collect()}
    assert got == {i: None if s in (None, "M?") else clean(search.pa.array([s]))[0].as_py() for i, s in rows}
    portions = [f.read_text().split() for f in tmp_path.iterdir()]
    # once in a portion; a portion's end may part like ones
    assert {p for some in portions for p in some} == set(made) and all(len(some) == len(set(some)) for some in portions)
    # short ones are together, and a long one is with no shorter ones but its task's last short ones
    assert all([len(p) for p in some] == sorted(len(p) for p in some) for some in portions)
    assert sum(min(map(len, some)) < 7 and max(map(len, some)) > 79 for some in portions if some) <= 4
