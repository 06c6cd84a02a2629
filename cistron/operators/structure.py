"""Secondary structure: pair maps and helices from dot-bracket strings, and profiles from unpaired probabilities.

Whole sequences are folded by a backend, an object with mfe(seq) -> (structure, energy) and unpaired(seq) -> list of
probabilities; without one, what depends on whole folds is null. Windows are folded by `folding`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import letters as L
from .duplex import by_id

#: Longest sequence folded whole, local and start windows, and sampled windows of longer ones.
FOLD_MOST, LOCAL, START, ACCESS, WINDOW, STRIDE = 3000, 150, 45, 30, 200, 500


class Backend(Protocol):
    def mfe(self, seq: str) -> tuple[str, float]: ...

    def unpaired(self, seq: str) -> list[float]: ...


def parse_db(structures: DataFrame, column: str = "structure") -> DataFrame:
    """(seq_id, i, j): paired places from 0, i < j, of each dot-bracket string.

    Brackets of one kind and depth pair with their neighbours. Rows with one id, where there are some, count as one string's,
    each with places of its own. Only strings are shuffled.
    """
    return _by_id(structures, column, "j", lambda g, i, j: (g, i, j))


def helices(structures: DataFrame, column: str = "structure") -> DataFrame:
    """helix_lengths() of parse_db(), without pairs as rows between them."""

    def stacked(g: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((i, i + j, g))
        g, i, total = g[order], i[order], (i + j)[order]
        head = np.flatnonzero(np.insert((np.diff(g) != 0) | (np.diff(total) != 0), 0, True)) if len(g) else g
        run = i - (np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g)))))
        order = np.lexsort((i, run, total, g))
        g, i, total, run = (x[order] for x in (g, i, total, run))
        head = np.flatnonzero(np.insert((np.diff(g) != 0) | (np.diff(total) != 0) | (np.diff(run) != 0), 0, True)) if len(g) else g
        return g[head], i[head], np.diff(np.append(head, len(g))) if len(g) else g

    return _by_id(structures, column, "length", stacked)


def _by_id(structures: DataFrame, column: str, last: str, of: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """(seq_id, i, `last`): what `of` makes of the pairs (number of the id, i, j) of dot-bracket strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in by_id(batches):
            t = L.Texts(rows.column("seq").combine_chunks())
            found = _pairs(t, group)
            g, i, value = of(*found)
            first = np.flatnonzero(np.insert(group[1:] != group[:-1], 0, True))
            ids = rows.column("seq_id").combine_chunks().take(pa.array(first[g]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(i.astype(np.int32)), pa.array(value.astype(np.int32))], names=["seq_id", "i", last])

    n = int(structures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = structures.select(F.col("seq_id").cast("long").alias("seq_id"), F.col(column).alias("seq"))
    return rows.repartition(n, "seq_id").sortWithinPartitions("seq_id").mapInArrow(run, f"seq_id long, i int, {last} int")


def helix_lengths(pairs: DataFrame) -> DataFrame:
    """(seq_id, i, length): stacks of pairs (i, j), (i + 1, j - 1), ... by their first place."""
    w = Window.partitionBy("seq_id", F.col("i") + F.col("j")).orderBy("i")
    runs = pairs.withColumn("run", F.col("i") - F.row_number().over(w)).withColumn("sum", F.col("i") + F.col("j"))
    return runs.groupBy("seq_id", "sum", "run").agg(F.min("i").alias("i"), F.count(F.lit(1)).cast("int").alias("length")).select("seq_id", "i", "length")


def _pairs(t: L.Texts, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, i, j) of dot-bracket strings, places within their rows; rows of one group, which follow each other, count as one string's."""
    kind = np.zeros(256, np.int64)
    for k, both in enumerate(("()", "[]", "{}"), 1):
        kind[list(both.encode())] = k
    at = np.flatnonzero(kind[t.letters])
    row, step = np.searchsorted(t.start + t.length, at, side="right"), np.where(np.isin(t.letters[at], list(b"([{")), 1, -1)
    several = len(group) > 0 and int(group[-1]) + 1 < len(group)
    found = [np.zeros((3, 0), np.int64)]
    for k in (1, 2, 3):
        own = kind[t.letters[at]] == k
        p, g, d = at[own] - t.start[row[own]], group[row[own]], step[own]
        if several:
            order = np.lexsort((p, g))
            p, g, d = p[order], g[order], d[order]
        upto = np.cumsum(d)
        if several and len(p):  # equal places of a group count together
            end = np.flatnonzero(np.append((np.diff(p) != 0) | (np.diff(g) != 0), True))
            upto = np.repeat(upto[end], np.diff(end, prepend=-1))
        before = np.concatenate(([0], np.cumsum(d)))[np.searchsorted(g, g)]
        depth = upto - before + (d < 0)
        order = np.lexsort((p, depth, g))
        p, g, d, depth = p[order], g[order], d[order], depth[order]
        pair = np.flatnonzero((d[:-1] == 1) & (d[1:] == -1) & (g[:-1] == g[1:]) & (depth[:-1] == depth[1:]))
        found.append(np.stack([g[pair], p[pair], p[pair + 1]]))
    return tuple(np.concatenate(found, axis=1))


def _helices(t: L.Texts) -> pa.Array:
    """Number of pairs, longest helix and helices of eight or more of each dot-bracket string, by the rules of the two functions above."""
    r, i, j = _pairs(t, np.arange(t.n))
    total = i + j
    order = np.lexsort((i, total, r))
    r, i, total = r[order], i[order], total[order]
    head = np.flatnonzero(np.insert((np.diff(r) != 0) | (np.diff(total) != 0) | (np.diff(i) != 1), 0, True)) if len(r) else r
    length = np.diff(np.append(head, len(r))) if len(r) else r
    longest = np.zeros(t.n, np.int64)
    np.maximum.at(longest, r[head], length)
    columns = (np.bincount(r, minlength=t.n), longest, np.bincount(r[head][length >= 8], minlength=t.n))
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["pairs", "longest", "n8"])


def helix_features(structures: DataFrame, column: str = "structure") -> DataFrame:
    """(seq_id, paired_fraction, longest_helix, n_helices8) of each row, without a shuffle; zeros for a row without id."""
    n = F.greatest(F.length(F.coalesce(column, F.lit(""))), F.lit(1))
    rows = structures.select("seq_id", n.alias("n"), L.column("struct<pairs: int, longest: int, n8: int>", _helices)(F.col(column)).alias("h"))
    of = lambda c: F.when(F.col("seq_id").isNotNull(), F.col(f"h.{c}")).otherwise(0)
    return rows.select("seq_id", (2 * of("pairs") / F.col("n")).alias("paired_fraction"), of("longest").alias("longest_helix"), of("n8").alias("n_helices8"))


def windows(seq: Column, longest: int = LOCAL, every: bool = False) -> Column:
    """The whole sequence, or windows of WINDOW letters every STRIDE if it is longer than `longest`.

    every: windows one after the other, so that each place is in one; the last may be shorter.
    """
    n = F.length(seq)
    last, stride = (n - 1, WINDOW) if every else (n - WINDOW, STRIDE)
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(n <= longest, F.array(seq)).otherwise(F.transform(starts, lambda p: F.substr(seq, p + 1, F.lit(WINDOW))))


def mean(values: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def openness(local: Column, whole: Column, sampled: Column) -> dict[str, Column]:
    """Mean unpaired probability of the start (of the local fold), of all, and of the least quarter.

    local: profile of the first LOCAL letters; whole: of the sequence, null for one over FOLD_MOST letters; sampled: profiles
    of the windows of such a longer one. Structs of (values, ensemble), ensemble 0 where values come from one structure.
    Null without a backend.
    """
    from .select import best_quartile

    every = F.transform(sampled, lambda p: mean(p["values"]))
    return {
        "open_start45": F.when(local.isNotNull(), mean(F.slice(local["values"], 1, START))),
        "mean_unpaired": F.when(whole.isNotNull(), mean(whole["values"])).when(sampled.isNotNull(), mean(every)),
        "mean_unpaired_q25": F.when(whole.isNotNull(), best_quartile(whole["values"])),
        "ensemble_ok": F.when(whole.isNotNull(), whole["ensemble"]).when(sampled.isNotNull(), F.lit(0)),
    }


def mfe_features(rows: DataFrame) -> DataFrame:
    """rows of fold() and mfe_per_nt, paired_fraction, longest_helix, n_helices8; null where nothing is folded."""
    helices = helix_features(rows.where("structure is not null").select("seq_id", "structure"))
    out = rows.join(helices, "seq_id", "left")
    return out.withColumn("mfe_per_nt", F.try_divide(F.col("mfe"), F.length("structure").cast("double")))


def structure_features(seqs: DataFrame, backend: Backend | None, seq: str = "cds", fast: bool = False) -> DataFrame:
    """(seq_id, mfe, mfe_per_nt, paired_fraction, longest_helix, n_helices8, open_start45, ...) of all sequences.

    fast leaves out profiles of whole sequences and the duplex scan.
    """
    from . import duplex

    rows = mfe_features(fold(seqs, backend, seq, fast))
    opened = openness(F.col("local_profile"), F.col("profile"), F.col("sampled_profiles"))
    names = ["open_start45"] if fast else list(opened)
    out = rows.select("seq_id", "mfe", "mfe_per_nt", "paired_fraction", "longest_helix", "n_helices8", *(opened[n].alias(n) for n in names))
    if fast:
        return out
    scan = duplex.selfcomp_scan(seqs, seq).select("seq_id", F.col("exact").alias("selfcomp_max_exact"), F.col("near").alias("selfcomp_max_near"))
    return out.join(scan, "seq_id")


def mfe_unpaired(structure: Column) -> Column:
    """1 for each unpaired place of a dot-bracket string, else 0."""
    return F.transform(F.regexp_extract_all(structure, F.lit("(?s)."), F.lit(0)), lambda c: (c == ".").cast("double"))


_PROFILE = "struct<values: array<double>, ensemble: int>"
_FOLDED = {"structure": "string", "mfe": "double", "dg_start45": "double", "acc_aug30": "double", "unpaired": "double", "local_profile": _PROFILE, "profile": _PROFILE, "sampled_profiles": f"array<{_PROFILE}>"}


def fold(seqs: DataFrame, backend: Backend | None, seq: str = "cds", fast: bool = False) -> DataFrame:
    """(seq_id, structure, mfe, dg_start45, acc_aug30, unpaired, profiles, structure_backend) by the backend; null without one.

    dg_start45: energy of the first START letters; acc_aug30: mean of the first ACCESS of a profile of the first LOCAL ones;
    unpaired: mean over windows(). A profile that the backend doesn't give (fewer than 5 letters) is that of the structure,
    1 for each unpaired place. Whole profiles are of sequences of up to FOLD_MOST letters, longer ones are sampled.
    """
    if backend is None:
        return seqs.select("seq_id", *(F.lit(None).cast(t).alias(c) for c, t in _FOLDED.items()), F.lit("none").alias("structure_backend"))

    def of_structure(structure: str) -> list[float]:
        return [float(c == ".") for c in structure]

    def profile(s: str) -> dict:
        known = backend.unpaired(s) if 5 <= len(s) <= FOLD_MOST else None
        return {"values": of_structure(backend.mfe(s)[0]) if known is None else known, "ensemble": int(known is not None)}

    def average(values: list[float]) -> float:
        return sum(values) / len(values) if values else 0.0

    def one(s: str | None) -> tuple:
        if not s:
            return (None,) * len(_FOLDED)
        rna = s.upper().replace("T", "U")
        structure, energy = backend.mfe(rna)
        local = profile(rna[: max(LOCAL, START)])
        parts = [rna] if len(rna) <= LOCAL else [rna[p : p + WINDOW] for p in range(0, max(1, len(rna) - WINDOW + 1), STRIDE)]
        sampled = [profile(p) for p in parts] if not fast else []
        unpaired = average([average(p["values"]) for p in sampled]) if sampled and len(rna) >= 5 and all(p["ensemble"] for p in sampled) else None
        short = len(rna) <= FOLD_MOST
        return structure, energy, backend.mfe(rna[:START])[1], average(local["values"][:ACCESS]), unpaired, local, profile(rna) if short and not fast else None, sampled if not short and not fast else None

    profile_type = pa.struct([("values", pa.list_(pa.float64())), ("ensemble", pa.int32())])
    types = (pa.string(), *(pa.float64(),) * 4, profile_type, profile_type, pa.list_(profile_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(s) for s in batch.column("seq").to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), *columns, pa.array([type(backend).__name__] * len(rows))], names=["seq_id", *_FOLDED, "structure_backend"])

    ddl = ", ".join(f"{c} {t}" for c, t in _FOLDED.items())
    return seqs.select("seq_id", F.col(seq).alias("seq")).mapInArrow(run, f"seq_id long, {ddl}, structure_backend string")
