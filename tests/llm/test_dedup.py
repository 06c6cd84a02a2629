import hashlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from cistron.llm import components, line_chunks, ngram_join, queries, rlz_dedup, suffix_dedup
from cistron.llm.common import alike, find
from cistron.llm.hashing import grams, span_hashes

from .conftest import LAST, LOWER, by, thue_morse, words


def ided(rows):
    return [(LAST if i is None else i, t) for i, t in rows]


def back(i):
    return LAST if i is None else i


@pytest.mark.parametrize("block_bytes", [400, 4000, 1 << 20])
def test_rlz(docs, rows, block_bytes):
    first, want = {}, []
    for i, t in ided(rows):
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    for i, t in ided(rows):
        w = words(t)
        gone = {k + d for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for d in range(13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [(back(r.doc_id), *r[1:]) for r in rlz_dedup.deduplicate(docs, block_bytes=block_bytes).collect()]
    assert by(got) == by(want) and sum(w[2] for w in want) > 0


def test_rlz_text_and_empty(docs, empty):
    assert rlz_dedup.deduplicate(empty).collect() == []
    out = rlz_dedup.deduplicate(docs, with_text=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)
    with pytest.raises(ValueError):
        rlz_dedup.deduplicate(docs, window=13, gram=5)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 50, 200):
        for k in (1, 2, 250):
            c = rng.integers(1, k + 1, n)
            assert suffix_dedup.suffix_array(c).tolist() == sorted(range(n), key=lambda i: c[i:].tolist())  # noqa: B023


@pytest.mark.parametrize("block_bytes", [400, 4000, 1 << 20])
def test_suffix(docs, rows, block_bytes):
    seen, want = set(), []
    for i, t in sorted(ided(rows), key=lambda r: (r[0], r[1] is None, r[1] or "")):
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        spans = sum(k - 1 not in gone for k in gone)
        want.append((i, len(b), len(gone), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    got = [(back(r.doc_id), *r[1:]) for r in suffix_dedup.deduplicate(docs, block_bytes=block_bytes).collect()]
    assert by(got) == by(want) and sum(w[2] for w in want) > 0


def test_suffix_empty(empty):
    assert suffix_dedup.deduplicate(empty).collect() == []


def line_hash(line):
    b = np.frombuffer(line.encode(), np.uint8)
    return span_hashes(b, np.array([0]), np.array([len(b)]))[0]


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_lines(docs, rows, block_bytes):
    seen, want = set(), []
    for i, t in sorted(ided(rows), key=lambda r: (r[0], r[1] is None, (r[1] or "").encode())):
        if t is None:
            want.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        hit = [False] + [int(g) >> 16 for g in grams(np.array([line_hash(x) for x in lines]), 2)]
        hit = [False] + [h % 4 == 0 for h in hit[1:]]
        chunks, now = [], []
        for k, x in enumerate(lines):
            now.append(x)
            if (hit[k] and not hit[k - 1]) or len(now) == 64 or k == len(lines) - 1:
                chunks.append(now)
                now = []
        kept, gone = [], 0
        for c in chunks:
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
                if len(c) > 1:
                    seen.add(tuple(c))
        want.append((i, "\n".join(kept), len(lines), gone))
    got = [(back(r.row.doc_id), r.text, r.n_lines, r.n_removed_lines) for r in line_chunks.deduplicate(docs, fine=False, block_bytes=block_bytes).collect()]
    assert by(got) == by(want) and sum(w[3] for w in want) > 0


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_line_runs(docs, rows, block_bytes):
    """Every line of a run of two or more that occurs earlier goes, wherever chunk boundaries would be."""
    order = sorted(ided(rows), key=lambda r: (r[0], r[1] is None, (r[1] or "").encode()))
    texts = [[] if t is None else t.split("\n") for _, t in order]
    want = []
    for d, (i, t) in enumerate(order):
        lines, gone = texts[d], set()
        for k in range(len(lines) - 1):
            pair = lines[k : k + 2]
            before = any(x[j : j + 2] == pair for x in texts[:d] for j in range(len(x) - 1))
            if before or any(lines[j : j + 2] == pair for j in range(k - 1)):
                gone |= {k, k + 1}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((i, t if t is None else kept, len(lines), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = line_chunks.deduplicate(docs, block_bytes=block_bytes).collect()
    got = [(back(r.row.doc_id), r.text, r.n_lines, r.n_removed_lines, r.n_removed_runs, r.kept_sha256) for r in out]
    assert by(got) == by(want) and sum(w[3] for w in want) > 0


def test_most_lines_go_by_their_chunks(spark):
    """Of long copies whole chunks go; lines that are left only at their ends."""
    copy = [f"line {k}" for k in range(400)]
    rows = [(d, "\n".join([f"own {d}", *copy, f"end {d}"])) for d in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in line_chunks.deduplicate(frame, block_bytes=2000).collect():
        assert (r.n_removed_lines, r.n_removed_runs) == ((400, 1) if r.row.doc_id else (0, 0))
        assert r.n_removed_chunks > 50 if r.row.doc_id else r.n_removed_chunks == 0
    some = {r.row.doc_id: r.n_removed_lines for r in line_chunks.deduplicate(frame, fine=False, block_bytes=2000).collect()}
    assert all(380 < some[d] <= 400 for d in range(1, 5))


def test_lines_of_a_passage(spark):
    """Passages of two to four lines in foreign text, which hold no whole chunk as a rule."""
    passages = {n: [f"passage {n} line {k}" for k in range(n)] for n in (2, 3, 4)}
    rows = [(10 * n + d, "\n".join([f"own {n} {d} a", *passages[n], f"own {n} {d} b"])) for n in passages for d in range(9)]
    op8 = queries.op8_line_chunk_dedup
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "read", lambda *_: frame)
        got = {r.doc_id: r.n_removed_lines for r in op8(spark, "").collect()}
    assert got == {10 * n + d: n if d else 0 for n in passages for d in range(9)}


def test_line_runs_empty(empty):
    assert line_chunks.deduplicate(empty).collect() == []


def test_lines_empty(empty):
    assert line_chunks.deduplicate(empty).collect() == []


@pytest.mark.parametrize(("size", "share"), [(4, 85), (5, 80), (1, 60)])
def test_join(docs, rows, size, share):
    ids = [i for i, _ in ided(rows)]
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    want = [(i, len(sets[k]), least[find(k)]) for k, i in enumerate(ids)]
    got = [(back(a), n, back(c)) for a, n, c in map(tuple, ngram_join.cluster(docs, size, (share, 100)).collect())]
    assert by(got) == by(want)


def test_join_large_group(spark):
    """More near copies than a small group has, and no link among some of them."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:3] + [f"n{k}"] * (k % 30) + base[3 + k % 30 :])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.cluster(df, 4, (85, 100)).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(97)} for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert got == root


def test_join_sends_sets_of_single_ids_once(spark, monkeypatch):
    """With no id twice, sets aren't dealt out to find repeats, and a pair is held against its sets once."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:3] + [f"n{k}"] * (k % 30) + base[3 + k % 30 :])) for k in range(90)]
    links, cut, seen, plans = ngram_join._links, ngram_join.checkpoint, [], []

    def checkpoint(df):
        if df.columns == ["node", "members"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    def recorded(docs, homes, pairs, *rest):
        seen.extend(map(tuple, pairs.collect()))
        return links(docs, homes, pairs, *rest)

    monkeypatch.setattr(ngram_join, "checkpoint", checkpoint)
    monkeypatch.setattr(ngram_join, "_links", recorded)
    got = {r.doc_id: r.component_id for r in ngram_join.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect()}
    assert len(got) == 90 and seen and len(seen) == len(set(seen))
    assert plans and not any("first(members" in p for p in plans)
    plans.clear()
    twice = [*rows, (7, rows[8][1]), (7, rows[7][1])]
    again = ngram_join.cluster(spark.createDataFrame(twice, "doc_id long, text string"), 4, (85, 100)).collect()
    assert len(again) == 92 and all("first(members" in p for p in plans)


def test_words_that_polynomials_confuse(spark):
    """Different long words are different in windows, shingles, lines and bytes."""
    tail = " one two three four five six seven eight nine ten eleven twelve"
    x, y = thue_morse(2048)
    frame = spark.createDataFrame([(1, x + tail), (2, y + tail)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in rlz_dedup.deduplicate(frame).collect()} == {1: 0, 2: 0}
    pair = spark.createDataFrame([(1, f"{x} b c d"), (2, f"{y} b c d")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.cluster(pair, 4, (85, 100)).collect()} == {1: 1, 2: 2}
    assert len(set(span_hashes(np.frombuffer((x + y).encode(), np.uint8), np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2


def test_pairs_with_one_hash():
    """Places of pairs (hash, check) when different checks share a hash."""
    h, c = np.array([5, 7, 5, 5, 7], np.uint64), np.array([1, 1, 2, 1, 1], np.uint64)
    first, group, count = alike(h, c)
    assert [(h[first[g]], c[first[g]]) for g in group] == list(zip(h, c, strict=True)) and sorted(count.tolist()) == [1, 2, 2]
    known, checks = np.array([5, 5, 7], np.uint64), np.array([9, 2, 1], np.uint64)
    assert find(h, c, known, checks).tolist() == [-1, 2, 1, -1, 2]
    data = np.frombuffer(b"abcabdabc", np.uint8)
    told = suffix_dedup.told_apart(np.zeros(3, np.uint64), data, np.array([0, 3, 6]), np.array([3, 3, 3]), np.zeros(3, np.int64))
    assert told[0] == told[2] != told[1]


def test_many_links(spark):
    """The state of a graph is a sum that doesn't overflow."""
    edges = spark.range(20_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components._state(edges)[0] == 20_000_000


def test_lines_with_odd_column_names(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc", 5, 6), (2, "a\nb\nd", 7, 8)], "doc_id long, text string, `my col` int, `a.b` int")
    got = {r.row.doc_id: (r.text, r.row["my col"], r.row["a.b"]) for r in line_chunks.deduplicate(frame).collect()}
    assert got == {1: ("a\nb\nc", 5, 6), 2: ("d", 7, 8)}


def test_join_empty(empty):
    assert ngram_join.cluster(empty).collect() == []
