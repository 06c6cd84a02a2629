"""Column expressions on codons. A codon's place in a table is its number in base four, so a lookup is one array access.

What takes all codons of a sequence goes over Arrow arrays, many sequences at once (see `letters`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import letters as L
from .sequence import codons, let

ALL = L.CODONS


#: All codons in order of their numbers; no codon holds the character between them.
_IN_ORDER = "\x00".join(ALL)


def number(codon: Column) -> Column:
    """0 to 63 of a codon in DNA letters; -1 if it has others."""
    return F.shiftright(F.position(codon, F.lit(_IN_ORDER)) - 1, 2)


def table(values: dict[str, object], kind: str) -> Column:
    return F.array(*(F.lit(values.get(c)).cast(kind) for c in ALL))


def lookup(codon: Column, values: dict[str, object], kind: str = "double") -> Column:
    return F.get(table(values, kind), number(codon))


def amino(codon: Column) -> Column:
    return lookup(codon, K.AMINO, "string")


_LOG_W = {c: math.log2(K.FREQ[c] / K.AMINO_MAX[K.AMINO[c]]) for c in K.FREQ}
_LOG_TAI = {c: math.log(max(w / K.MAX_WEIGHT, 1e-12)) for c, w in K.WEIGHT.items()}


_W_TABLE, _TAI_TABLE = L.by_codon(_LOG_W), L.by_codon(_LOG_TAI)
_AMINO_TABLE = np.array([ord(K.AMINO.get(c, "?")) for c in [*ALL, ""]], dtype=np.uint8)
_STOP_TABLE = np.array([c in K.STOPS for c in [*ALL, ""]])
_GC3_TABLE = np.array([c[2:] in ("G", "C") for c in [*ALL, ""]], dtype=float)


def _usage(t: L.Texts, without_stop: bool) -> np.ma.MaskedArray:
    row, numbers, n = t.codon_row, t.numbers, t.n_codons
    if without_stop:
        stop = np.zeros(t.n, dtype=bool)
        stop[n > 0] = _STOP_TABLE[numbers[(t.first + n - 1)[n > 0]]]
        keep = np.ones(len(numbers), dtype=bool)
        keep[(t.first + n - 1)[stop]] = False
        row, numbers, n = row[keep], numbers[keep], n - stop
    with np.errstate(invalid="ignore", divide="ignore"):
        value = 2.0 ** (t.sums(row, _W_TABLE[numbers]) / n)
    return L.masked(np.where(n == 0, 0.0, value), t.null | ((n > 0) & np.isnan(value)))


def cai(s: Column) -> Column:
    """Codon adaptation index over all codons, start and stop as well; 0 without codons, null if a codon is unknown."""
    return L.column("double", lambda t: _usage(t, False))(s)


def cai_excl_stop(s: Column) -> Column:
    return L.column("double", lambda t: _usage(t, True))(s)


def gc3(s: Column) -> Column:
    def share(t: L.Texts) -> np.ma.MaskedArray:
        return L.masked(t.sums(t.codon_row, _GC3_TABLE[t.numbers]) / np.maximum(t.n_codons, 1), t.null)

    return L.column("double", share)(s)


def _known_mean(t: L.Texts, row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each row's values that aren't NaN, 0 without any, and whether there are none."""
    there = ~np.isnan(values)
    n = np.bincount(row, there, t.n)
    return t.sums(row, np.where(there, values, 0.0)) / np.maximum(n, 1), n == 0


def tai(s: Column) -> Column:
    """Geometric mean of the sense codons' tRNA supply relative to the greatest one; null without sense codons."""

    def supply(t: L.Texts) -> np.ma.MaskedArray:
        mean, none = _known_mean(t, t.codon_row, _TAI_TABLE[t.numbers])
        return L.masked(np.exp(mean), none)

    return L.column("double", supply)(s)


def stop_codon(s: Column) -> Column:
    """The last whole codon, empty without one."""
    whole = F.length(s) - F.length(s) % 3
    return F.coalesce(F.when(whole > 0, F.substr(s, whole - 2, F.lit(3))), F.lit(""))


def _translated(t: L.Texts, strict: bool) -> pa.Array:
    letters = _AMINO_TABLE[t.numbers]
    end = t.first + t.n_codons
    first = lambda hit: np.minimum(np.append(np.flatnonzero(hit), len(letters))[np.searchsorted(np.flatnonzero(hit), t.first)], end)
    until = first(letters == ord("*"))
    other = first(letters == ord("?"))
    null = t.null | (other < until) if strict else t.null
    until = until if strict else np.minimum(until, other)
    keep = np.arange(len(letters)) < np.repeat(until, t.n_codons)
    return t.strings(keep, letters, null, t.first, t.n_codons)


def translate_a(s: Column) -> Column:
    """Amino acids up to the first stop or unknown codon."""
    return L.column("string", lambda t: _translated(t, False))(s)


def translate_b(s: Column) -> Column:
    """Amino acids up to the first stop; null if an unknown codon comes before."""
    return L.column("string", lambda t: _translated(t, True))(s)


def check_translate(s: Column, protein: Column) -> Column:
    return F.coalesce(translate_b(s) == F.upper(protein), F.lit(False))


_BEST_TABLE = np.zeros((256, 3), dtype=np.uint8)
for _a, _c in K.BEST.items():
    _BEST_TABLE[ord(_a)] = list(_c.encode())


def back_translate(aa: Column) -> Column:
    """Each amino acid by its most frequent codon; null if one is unknown."""

    def best(t: L.Texts) -> pa.Array:
        letters = _BEST_TABLE[t.letters]
        unknown = t.total(letters[:, 0] == 0) > 0
        return t.strings(np.ones(letters.size, dtype=bool), letters.ravel(), t.null | unknown, 3 * t.start, 3 * t.length)

    return L.column("string", best, once=True)(aa)


def mean_coefficient(s: Column, values: dict[str, float]) -> Column:
    """Mean of a per-codon coefficient over the codons that have one; 0 if none has."""
    table = L.by_codon(values)
    return L.column("double", lambda t: _known_mean(t, t.codon_row, table[t.numbers])[0])(s)


def mean_by_pair(s: Column, table: np.ndarray, missing: float | None = None) -> Column:
    """Mean over a sequence's pairs of their values by number; pairs without one (NaN) count as `missing`, or not at all.

    0 without pairs; the last pair doesn't count.
    """
    full = np.append(table if missing is None else np.where(np.isnan(table), missing, table), np.nan if missing is None else missing)

    def mean(t: L.Texts) -> np.ndarray:
        row, pair = t.pairs()
        return _known_mean(t, row, full[pair])[0]

    return L.column("double", mean)(s)


def enc(s: Column) -> Column:
    """Effective number of codons after Wright: homozygosity of each amino acid, averaged by size of its family."""
    return L.column("double", _enc)(s)


def _enc(t: L.Texts) -> np.ndarray:
    counts = np.bincount(t.codon_row * 65 + t.numbers, minlength=t.n * 65).reshape(t.n, 65).astype(float)
    families: dict[int, list[np.ndarray]] = {}
    for codons_of in (v for v in K.SYNONYMS.values() if len(v) > 1):
        some = counts[:, [ALL.index(c) for c in codons_of]]
        n = some.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            squares = sum(((some[:, k] / n) ** 2 for k in range(some.shape[1])), np.zeros(t.n))
            value = np.where(n == 1, 1.0, (n * squares - 1) / (n - 1))
        families.setdefault(len(codons_of), []).append(np.where(n == 0, np.nan, value))
    out = np.full(t.n, 2.0)
    for size, weight in ((2, 9.0), (3, 1.0), (4, 5.0), (6, 3.0)):
        values = families.get(size, [])
        there = sum((~np.isnan(v) for v in values), np.zeros(t.n))
        mean = sum((np.nan_to_num(v) for v in values), np.zeros(t.n)) / np.maximum(there, 1)
        out += weight / np.maximum(np.where(there == 0, 1.0, mean), 1e-6)
    return np.minimum(out, 61.0)


def codon_features(s: Column) -> dict[str, Column]:
    return {"cai": cai(s), "cai_excl_stop": cai_excl_stop(s), "gc3": gc3(s), "enc": enc(s)}


def pair_numbers(s: Column, include_last_pair: bool = False) -> Column:
    """64 * first + second of each pair of neighbouring codons, -1 if one has other letters; the last pair only if asked for."""
    n = F.greatest(F.floor(F.length(s) / 3).cast("int") - 1 if include_last_pair else F.ceil((F.length(s) - 6) / 3).cast("int"), F.lit(0))
    numbers = F.transform(codons(s), number)
    return let(numbers, lambda c: F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: F.when((x < 0) | (y < 0), -1).otherwise(x * 64 + y)))


def feature_vector(s: Column, coefficients: dict[str, dict[str, float]]) -> dict[str, Column]:
    """Mean coefficients by name, then cai, gc_global, gc3, enc and cds_len."""
    from .sequence import gc_content

    def measures(t: L.Together) -> dict[str, int]:
        out = {name: mean_coefficient(t, values) for name, values in coefficients.items()}
        return out | {"cai": cai(t), "gc_global": gc_content(t), "gc3": gc3(t), "enc": enc(t)}

    return L.together(s, measures) | {"cds_len": F.length(s)}
