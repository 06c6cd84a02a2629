"""Column expressions on nucleotide strings. All are linear in the length: pieces come from one regular expression.

What looks at each letter goes over Arrow arrays, many sequences at once (see `letters`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import letters as L


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda would compute what it captures for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_rna(s: Column) -> Column:
    return F.translate(F.upper(s), "T", "U")


def to_dna(s: Column) -> Column:
    return F.translate(F.upper(s), "U", "T")


def revcomp_rna(s: Column) -> Column:
    """Other letters stay."""
    return F.reverse(F.translate(s, "AUGC", "UACG"))


def revcomp_dna(s: Column) -> Column:
    """Other letters become N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGT]", "N"), "ACGT", "TGCA"))


def pieces(s: Column, n: int, tail: bool = False) -> Column:
    """Consecutive pieces of n letters; a shorter last one only with `tail`."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{{1 if tail else n},{n}}}"), F.lit(0))


def codons(s: Column) -> Column:
    return pieces(s, 3)


def codon_pairs(s: Column, include_last_pair: bool = False) -> Column:
    """Overlapping pairs of neighbouring codons; the last pair of a whole number of codons counts only if asked for."""
    n = F.greatest(F.floor(F.length(s) / 3).cast("int") - 1 if include_last_pair else F.ceil((F.length(s) - 6) / 3).cast("int"), F.lit(0))
    return let(codons(s), lambda c: F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: F.concat(x, y)))


def motif_count(s: Column, motifs: Sequence[str] = K.MOTIFS) -> Column:
    """Occurrences of each motif that don't overlap, from the left."""
    return L.column("int", lambda t: L.masked(sum(t.count(m) for m in motifs), t.null))(s)


def donor_count(s: Column) -> Column:
    return motif_count(s, K.DONORS)


def letters(s: Column, some: str) -> Column:
    return F.length(s) - F.length(F.translate(s, some, ""))


def _gc(t: L.Texts) -> np.ndarray:
    return t.total(t.of("GC")) / np.maximum(t.length, 1)


def gc_content(s: Column) -> Column:
    """0 for an empty sequence."""
    return L.column("double", lambda t: L.masked(_gc(t), t.null))(s)


def _gc_slide(s: Column, window: int, step: int, best: np.ufunc) -> Column:
    """Greatest or least GC content of the whole windows; of the whole sequence if it isn't longer than one."""
    if window % step:
        raise ValueError("the step divides the window")

    def slide(t: L.Texts) -> np.ma.MaskedArray:
        out, long = _gc(t), np.flatnonzero(t.length > window)
        if len(long):
            upto = np.concatenate(([0], np.cumsum(t.of("GC"))))
            many = t.length[long] // step - (window // step - 1)
            at = L.spread(t.start[long], many, step)
            out[long] = best.reduceat(upto[at + window] - upto[at], np.cumsum(many) - many) / float(window)
        return L.masked(out, t.null)

    return L.column("double", slide)(s)


def gc_slide_max(s: Column, window: int = K.GC_WINDOW, step: int = K.GC_STEP) -> Column:
    return _gc_slide(s, window, step, np.maximum)


def gc_slide_min(s: Column, window: int = K.GC_WINDOW, step: int = K.GC_STEP) -> Column:
    return _gc_slide(s, window, step, np.minimum)


def max_run(s: Column, bases: str) -> Column:
    """Longest run of one of the bases."""

    def longest(t: L.Texts) -> np.ndarray:
        row, letter, length = t.runs
        out, some = np.zeros(t.n, np.int64), np.isin(letter, list(bases.encode()))
        np.maximum.at(out, row[some], length[some])
        return out

    return L.column("int", longest)(s)


def run_count(s: Column, least: int) -> Column:
    """Number of maximal runs of one base with `least` letters or more."""

    def many(t: L.Texts) -> np.ma.MaskedArray:
        row, letter, length = t.runs
        return L.masked(np.bincount(row[(length >= least) & (L.CODE[letter] < 4)], minlength=t.n), t.null)

    return L.column("int", many)(s)


def n_hp4(s: Column) -> Column:
    return run_count(s, 4)


def n_hp5(s: Column) -> Column:
    return run_count(s, 5)


def urich_count(s: Column, k: int = 6, least: int = 4) -> Column:
    """Windows of k letters with `least` U (or T) or more."""

    def rich(t: L.Texts) -> np.ma.MaskedArray:
        upto = np.concatenate(([0], np.cumsum(t.of("UT"))))
        many = np.maximum(t.length - k + 1, 0)
        at = L.spread(t.start, many)
        return L.masked(np.bincount(np.repeat(np.arange(t.n), many)[upto[at + k] - upto[at] >= least], minlength=t.n), t.null)

    return L.column("int", rich)(s)


def dinuc_odds(s: Column, a: str, b: str) -> Column:
    """Observed over expected number of a followed by b; 0 where none is expected."""

    def odds(t: L.Texts) -> np.ma.MaskedArray:
        expected = t.total(t.of(a)).astype(float) * t.total(t.of(b)) / np.maximum(t.length, 1)
        none = (t.length < 2) | (expected == 0)
        return L.masked(np.where(none, 0.0, t.count(a + b) / np.where(none, 1.0, expected)), t.null)

    return L.column("double", odds)(s)


def trim_stop(s: Column) -> Column:
    return F.regexp_replace(s, f"({'|'.join(K.STOPS)})$", "")


def seq_features(s: Column) -> dict[str, Column]:
    return {
        "seq_len": F.length(s),
        "gc_global": gc_content(s),
        "gc_slide60_max": gc_slide_max(s),
        "gc_slide60_min": gc_slide_min(s),
        "upa_odds": dinuc_odds(s, "T", "A"),
        "cpg_odds": dinuc_odds(s, "C", "G"),
        "hp_max_a": max_run(s, "A"),
        "hp_max_c": max_run(s, "C"),
        "hp_max_g": max_run(s, "G"),
        "hp_max_u": max_run(s, "T"),
        "urich6_count": urich_count(s),
    }


def rule_features(s: Column, gc_lo: float = K.GC_LO, gc_hi: float = K.GC_HI, slide_lo: float = K.SLIDE_LO, slide_hi: float = K.SLIDE_HI, window: int = K.GC_WINDOW, run: int = K.RULE_RUN) -> dict[str, Column]:
    """Flags and counts of the manufacturing rules; donors and U-rich windows don't gate."""
    ok_gc = gc_content(s).between(gc_lo, gc_hi)
    ok_slide = (gc_slide_min(s, window) >= slide_lo) & (gc_slide_max(s, window) <= slide_hi)
    ok_run = ~s.rlike("|".join(f"{b}{{{run + 1},}}" for b in "ACGT"))
    return {
        "rule_gc_global_pass": ok_gc.cast("int"),
        "rule_gc_slide_pass": ok_slide.cast("int"),
        "rule_homopolymer_pass": ok_run.cast("int"),
        "restriction_site_count": motif_count(s),
        "cryptic_donor_count": donor_count(s),
        "urich6_count": urich_count(s),
        "rules_all_pass": (ok_gc & ok_slide & ok_run & (motif_count(s) == 0)).cast("int"),
    }


def hard_ok(s: Column) -> Column:
    """GC, sliding GC (of sequences longer than a window) and runs within the hard limits; an empty sequence fails."""
    slide = (F.length(s) <= K.GC_WINDOW) | ((gc_slide_min(s) >= K.SLIDE_LO) & (gc_slide_max(s) <= K.SLIDE_HI))
    return ((F.length(s) > 0) & gc_content(s).between(K.GC_LO, K.GC_HI) & slide & (n_hp5(s) == 0)).cast("int")


def clean_flag(s: Column) -> Column:
    return ((motif_count(s) == 0) & (n_hp5(s) == 0)).cast("int")


def gc_penalty(gc: Column) -> Column:
    return F.lit(K.W_GC) * (F.greatest(F.lit(0.0), gc - K.GC_HI) + F.greatest(F.lit(0.0), K.GC_LO - gc))


def penalties(s: Column) -> Column:
    return K.W_SITE * motif_count(s) + K.W_HP4 * n_hp4(s) + K.W_HP5 * n_hp5(s) + gc_penalty(gc_content(s))
