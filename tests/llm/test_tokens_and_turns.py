"""Token counts held to the library, repaired conversations to a search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from cistron.llm import conversation_repair as cr
from cistron.llm import queries, token_counts
from cistron.llm.queries import MODEL

from .conftest import by

SF = "/root/testdata/sf0.001"

# --- 11


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_are_the_librarys(spark, docs, rows, library):
    odd = [None, "", " ", "   ", "a▁b", "▁", "<s> </s> <unk> <0x0A> [INST]", "\n\n\t\r\n x", "don't, \"etc.\" ...x!? y", "日本語テキスト and​more 😀😀\U0010ffff", "\x00\x01", "x" * 5000, "ab " * 3000, " " * 4000 + "z", "İstanbul ﬁ é ", "http://a.b/c?d=e&f=1_2"]
    given = rows + [(1000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, n_tokens string").repartition(3)
    out = token_counts.count(df, MODEL, limit=100).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in given]
    assert by([tuple(r)[:4] for r in out]) == by(want)
    assert all(r.n_direct <= r.n_pretokens <= r.n_tokens for r in out) and sum(r.n_direct for r in out) > 0


def test_counts_of_the_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op11_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out} == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in docs.items()}


def test_counts_over_windows(library, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", ",", "\n", "Ünï", "日", "."]) for _ in range(3000))
    monkeypatch.setattr(token_counts, "WINDOW", 64)
    counting = token_counts.Counting(token_counts.Proof.of(MODEL))
    assert counting.count(text)[0] == len(library.encode(text))
    assert counting.count("x" * 700 + " y")[0] == len(library.encode("x" * 700 + " y"))


def test_shortcuts_are_single_tokens(library):
    proof = token_counts.Proof.of(MODEL)
    starting = [p for p in sorted(proof.direct) if p.startswith("▁") and len(p) > 1]
    assert len(starting) > 10_000 and all(len(library.encode(p[1:])) == 1 for p in starting)


def test_counts_of_no_rows(empty):
    assert token_counts.count(empty, MODEL).collect() == []


# --- 12

WHITE = " \t\n\x0b\f\r"


def damaged(rows):
    """By the rule, plainly."""
    one = lambda x: " " if x is None else str(x)
    out = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = one(role), one(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def plainly(rows):
    """Numbers and the cheapest, then least, edits of one conversation's (turn, role, text) by a search over all of them."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][: cr.HEAD].encode(), hashlib.sha256(r[2].encode()).digest())
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, put):
        """(cost, edits, roles) of all that follows; state is the last role's initial."""
        out = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if put < 3:
            c, e, r = best(i, after, put + 1)
            out.append((c + 5, "I" + e, (after, *r)))
        if i < len(rows):
            c, e, r = best(i + 1, state, 0)
            out.append((c + 2, "D" + e, ("", *r)))
            if faults[i] not in ("blank", "duplicate"):
                extra, own = 5 * (faults[i] == "truncated"), rows[i][1][:1]
                if own == after or own == "s" and state == "":
                    c, e, r = best(i + 1, own, 0)
                    out.append((c + extra, "K" + e, (own, *r)))
                c, e, r = best(i + 1, after, 0)
                out.append((c + extra + 1, "R" + e, (after, *r)))
        return min(out, default=(10**9, "", ()))

    cost, audit, roles = best(0, "", 0)
    names, left, lines = {"u": "user", "a": "assistant"}, iter(rows), []
    for e, r in zip(audit, roles, strict=True):
        _, role, text = next(left) if e != "I" else (None, "", "")
        if e != "D":
            lines.append(f"{role if e == 'K' else names[r]}:{text}")
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows, ids):
    groups = {}
    for c, *rest in rows:
        groups.setdefault(c, []).append(tuple(rest))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: plainly(groups[c]) if c in groups else none for c in ids}


def found(df):
    out = df.collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def invented(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Hi there.", "ok?", "cut off", " ", "", "Yes!\n", "more . text", "Stop.", None, "x" * 70 + ".", "x" * 70 + "!"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "assistant", "System"]
    out = []
    for c in [None, *range(conversations)]:
        out += [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(most))]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_against_all_edits(spark):
    rows = invented(5, 150, 9)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", head string, tag int").repartition(3)
    assert found(cr.summarize(cr.damage(df), df)) == expected(damaged(rows), {r[0] for r in rows})


def test_repair_in_pieces(spark, monkeypatch):
    """Conversations cut anywhere, by rows and by batches, with many repeated rows."""
    rows = invented(8, 30, 40) + [(7, 3, "user", "same?")] * 90 + [(7, t, "user", "same?") for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    monkeypatch.setattr(cr, "PIECE", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = found(cr.summarize(df, df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = lambda x: " " if x is None else x
    assert got == expected([(c, t, one(r), one(x)) for c, t, r, x in rows], {r[0] for r in rows})


def test_repaired_rows_are_what_is_hashed(spark):
    rows = spark.createDataFrame(invented(9, 40, 8), SCHEMA)
    edits = cr.repair(rows).collect()
    for c, want in found(cr.summarize(rows)).items():
        own = sorted((e for e in edits if e.conv_id == c), key=lambda e: e.step)
        assert [e.step for e in own] == list(range(len(own))) and "".join(e.edit for e in own) == want[6]
        kept = [e for e in own if e.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[0] for e in kept))
        assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in kept).encode()).hexdigest() == want[7]


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_conversation_repair(spark, SF)) == expected(damaged(rows), {r[0] for r in rows})


def test_repair_of_long_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "y" * 3_000_000 + "?"), (1, 1, "assistant", ("z. " * 900_000).strip())], SCHEMA)
    assert found(cr.summarize(df))[1][5:7] == (0, "KK")
    none = df.limit(0)
    assert found(cr.summarize(cr.damage(none), none)) == {} and cr.repair(none).collect() == []
    assert found(cr.summarize(none, df.select(F.col("conv_id").cast("int")))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
