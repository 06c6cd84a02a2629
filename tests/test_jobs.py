"""The jobs on small files: growing input, repeated runs, failures between, odd rows, command line."""

import json
import logging
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cistron.operators import corpus
from jobs import corpus_intake, delivery

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string"
#: Letters that become GCT, AAG and so on: A, E, I .. are A; B, F .. C; C, G .. G; D, H .. T.
TEXT = {"A": "A", "C": "B", "G": "C", "T": "D"}


def text_of(dna):
    return "".join(TEXT[b] for b in dna)


def good(n, k=0):
    """A clean sequence of n codons, different for different k."""
    cycle = ["GCT", "AAG", "CTG", "GAT", "ACC", "CAA", "TGG", "GTC"]
    return "".join(cycle[(i * (k % 7 + 1) + k + i // 5) % 8] for i in range(n))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode(mode).parquet(str(path))


@pytest.fixture
def place(tmp_path):
    return {"documents": str(tmp_path / "in"), "out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


def taken(df):
    return {r.seq_id: (r.batch, r.verdict, r.first_id, r.reasons) for r in df.collect()}


FIRST = [
    (1, text_of(good(40)), "en", "a"),
    (2, text_of(good(40)), "en", "a"),  # again in its source
    (3, text_of(good(40)), "en", "b"),  # not in this one
    (4, text_of("GAATTC" * 20), "de", "a"),
    (5, text_of("GC" * 90), "de", "a"),
    (6, None, "de", "a"),
]
SECOND = [(7, text_of(good(40)), "fr", "a"), (0, text_of(good(40)), "fr", "b"), (8, text_of(good(50, 3)), None, None), (9, text_of(good(50, 3)), None, None), (10, text_of("GAATTC" * 20), "de", "a")]


def test_intake_of_growing_input(spark, place, caplog):
    write(spark, FIRST, place["documents"])
    with caplog.at_level(logging.INFO, logger="corpus_intake"):
        got = taken(corpus_intake.run(spark, **place))
    assert got[1] == (0, "accepted", 1, "") and got[2][1:3] == ("duplicate", 1) and got[3][1:3] == ("accepted", 3)
    assert got[4][1] == "rejected" and "sites" in got[4][3] and got[5][3].startswith("gc") and got[6][3] == "length,gc,gc_window"
    assert "6 sequences read" in caplog.text and "'rejected': 3" in caplog.text
    before = rows_of(spark.read.parquet(place["out"] + "/sequences"))
    assert rows_of(corpus_intake.run(spark, **place).select(*spark.read.parquet(place["out"] + "/sequences").columns)) == before  # nothing is new
    write(spark, SECOND, place["documents"])
    caplog.clear()
    with caplog.at_level(logging.INFO, logger="corpus_intake"):
        got = taken(corpus_intake.run(spark, **place))
    assert "batch 1: 5 sequences read" in caplog.text and "1 new batches, 5 sequences" in caplog.text
    assert {i: got[i][0] for i in (1, 6, 7, 10)} == {1: 0, 6: 0, 7: 1, 10: 1}
    # what came first stays the first one, whatever the ids
    assert got[7][1:3] == ("duplicate", 1) and got[0][1:3] == ("duplicate", 3) and got[10][1:3] == ("duplicate", 4)
    assert got[8][1:3] == ("accepted", 8) and got[9][1:3] == ("duplicate", 8)


def test_usage_is_that_of_all_accepted(spark, place):
    write(spark, FIRST, place["documents"])
    corpus_intake.run(spark, **place)
    write(spark, SECOND, place["documents"])
    out = corpus_intake.run(spark, **place)
    want = {r.pair: r.n for r in corpus.pair_counts(out.where("verdict = 'accepted'")).collect()}
    table = spark.read.parquet(place["out"] + "/usage").collect()
    assert {r.first + r.second: r.n for r in table} == want and abs(sum(r.share for r in table) - 1) < 1e-9


def test_a_batch_that_failed_is_taken_again(spark, place, monkeypatch):
    """Whatever of a batch was written before a failure, the next run gives what an undisturbed one gives."""
    write(spark, FIRST, place["documents"])
    corpus_intake.run(spark, **place)
    write(spark, SECOND, place["documents"])
    take = corpus_intake.take

    def failing(rows, batch, out, config):
        take(rows, batch, out, config)
        raise OSError("lost")

    monkeypatch.setattr(corpus_intake, "take", failing)
    with pytest.raises(Exception, match="lost"):
        corpus_intake.run(spark, **place)
    monkeypatch.setattr(corpus_intake, "take", take)
    again = rows_of(corpus_intake.run(spark, **place))
    quiet = {k: v + "-quiet" if k != "documents" else v for k, v in place.items()}
    shutil.copytree(place["documents"], (copy := place["documents"] + "-copy"))
    shutil.rmtree(copy)
    write(spark, FIRST, copy)
    corpus_intake.run(spark, **(quiet | {"documents": copy}))
    write(spark, SECOND, copy)
    assert rows_of(corpus_intake.run(spark, **(quiet | {"documents": copy}))) == again


def test_intake_of_odd_rows(spark, place):
    """Rows without id, repeated rows, many copies, an empty table, other columns."""
    rows = [(None, text_of(good(30)), "en", "a"), (None, text_of(good(30)), "en", "a"), (5, text_of(good(30)), "en", "a"), (5, text_of(good(30)), "en", "a"), (6, "", "en", None)]
    rows += [(100 + k, text_of(good(30, 2)), "en", "hot") for k in range(300)]
    spark.createDataFrame(rows, DOCS).withColumns({"verdict": F.lit("x"), "batch": F.lit("y")}).write.parquet(place["documents"])
    out = corpus_intake.run(spark, **place)
    got = out.groupBy("verdict", "source").count().collect()
    assert {(r.verdict, r.source): r["count"] for r in got} == {("rejected", "a"): 2, ("accepted", "a"): 1, ("rejected", None): 1, ("accepted", "hot"): 1, ("duplicate", "hot"): 299}
    assert {r.reasons for r in out.where("seq_id is null").collect()} == {"id"}
    none = {k: v + "-none" for k, v in place.items()}
    write(spark, [], none["documents"])
    assert [corpus_intake.run(spark, **none).count() for _ in range(2)] == [0, 0]


def test_intake_in_small_batches(spark, place):
    for k in range(3):
        write(spark, [(10 * k + i, text_of(good(40, i)), "en", "a") for i in range(2)], place["documents"])
    got = taken(corpus_intake.run(spark, **place, config={"files_per_batch": 1}))
    assert {b for b, *_ in got.values()} == {0, 1, 2} and sorted(v for _, v, *_ in got.values()) == ["accepted"] * 2 + ["duplicate"] * 4
    with pytest.raises(ValueError, match="unknown"):
        corpus_intake.configured({"least": 1})


def test_delivery_twice_and_after_changes(spark, place, tmp_path):
    rows = [(i, text_of(good(40 + i % 5, i)), "en" if i % 2 else "de", "a") for i in range(24)] + [(50, None, "en", "a"), (None, text_of(good(50)), "en", "a"), (3, text_of(good(43, 3)), "en", "a")]
    write(spark, rows, place["documents"])
    first = rows_of(delivery.run(spark, place["documents"], place["out"], {"top": 3}))
    assert rows_of(delivery.run(spark, place["documents"], place["out"], {"top": 3})) == first
    board = spark.read.schema(delivery.BOARD).parquet(place["out"] + "/board")
    assert sorted((r.grp, r["rank"]) for r in board.collect()) == [(g, k) for g in ("de", "en") for k in (1, 2, 3)]
    assert all(r.seq_id not in (None, 50) and len(r.cds) >= 60 for r in board.collect())
    orders = spark.read.csv(place["out"] + "/orders", sep="\t", header=True)
    assert {(r.grp, int(r.seq_id), r.cds) for r in orders.collect()} == {(r.grp, r.seq_id, r.cds) for r in board.collect()}
    n = {(r.kind, r.grp): r.n for r in spark.read.json(place["out"] + "/report").collect()}
    assert n == {("all", "en"): 13, ("all", "de"): 12, ("chosen", "en"): 3, ("chosen", "de"): 3}
    # a group that is gone leaves nothing behind
    write(spark, [r for r in rows if r[2] == "en"], str(tmp_path / "less"))
    assert {r.grp for r in delivery.run(spark, str(tmp_path / "less"), place["out"], {"top": 3}).collect()} == {"en"}
    with pytest.raises(ValueError, match="top"):
        delivery.configured({"top": 0})


@pytest.mark.parametrize("job", ["corpus_intake", "delivery"])
def test_command_line(spark, place, tmp_path, job):
    write(spark, FIRST, place["documents"])
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"least_length": 30}))
    given = [f"--{k}={place[k]}" for k in ("documents", "out", *(["checkpoint"] if job == "corpus_intake" else []))]
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), *given, f"--config={config}"], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "written" in done.stderr and spark.read.parquet(place["out"] + ("/sequences" if job == "corpus_intake" else "/board")).count() > 0


def test_jobs_have_their_config_files():
    assert corpus_intake.configured(json.loads((ROOT / "jobs/corpus_intake.json").read_text())) == corpus_intake.DEFAULTS
    assert delivery.configured(json.loads((ROOT / "jobs/delivery.json").read_text())) == delivery.DEFAULTS
