"""Search over synonymous variants: all single-codon variants, steepest ascent, and repair of duplexes.

A swap of one codon changes two codon pairs at most, one term of either codon index and the penalties of its
neighbourhood. `variants` lists the swaps as rows; `refine` moves many sequences at once, `repair` walks each by itself, both
in Arrow batches and from such differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codon as C
from ..functions import constants as K
from ..functions import letters as L
from . import duplex

_CODONS = C.ALL
_NUMBER = {c: i for i, c in enumerate(_CODONS)}
_ALT = [[_NUMBER[a] for a in K.SYNONYMS[K.AMINO[c]] if a != c] if K.AMINO[c] != "*" else [] for c in _CODONS]
_ALTS = np.array([(a + [-1] * 5)[:5] for a in _ALT])
_N_ALT = np.array([len(a) for a in _ALT])
_LOG_W = np.array([C._LOG_W[c] for c in _CODONS])
_LOG_TAI = np.array([C._LOG_TAI.get(c, 0.0) for c in _CODONS])
_SENSE = np.array([K.AMINO[c] != "*" for c in _CODONS])
_BASES = np.array(list(product(range(4), repeat=3)), dtype=np.int64)
_MOTIFS = [np.array(["ACGT".index(b) for b in m]) for m in K.MOTIFS]


def variants(seqs: DataFrame, synonyms: DataFrame, seq: str = "cds") -> DataFrame:
    """(seq_id, at, codon, alt): each other codon for each codon before the first stop; `at` from 0."""
    codons = C.codons(F.col(seq))
    stop = F.array_position(F.transform(codons, lambda c: c.isin(*K.STOPS)), True).cast("int")
    sense = F.when(stop > 0, F.slice(codons, 1, stop - 1)).otherwise(codons)
    rows = seqs.select("seq_id", F.posexplode(sense).alias("at", "codon"))
    return rows.join(F.broadcast(synonyms), "codon").select("seq_id", "at", "codon", "alt")  # 61 codons


@dataclass
class Scorer:
    """Corpus statistics as arrays; `tai` off gives the score without tRNA adaptation."""

    pair_log: np.ndarray
    nat: tuple[float, float]
    cai: tuple[float, float]
    tai: tuple[float, float] | None
    names: tuple[str, ...] = field(default=("nat", "cai", "tai"))

    @staticmethod
    def of(counts: DataFrame, stats: DataFrame, with_tai: bool = True) -> Scorer:
        """From the pair table (4,096 rows at most) and the one row of calibration."""
        total, n = 0, np.zeros((64, 64))
        for pair, k in counts.collect():
            n[_NUMBER[pair[:3]], _NUMBER[pair[3:]]] = k
            total += k
        s = stats.first()
        tai = (s["tai_mean"], s["tai_std"]) if with_tai else None
        return Scorer(np.log((n + 1) / (total + K.PAIR_VOCABULARY)), (s["nat_mean"], s["nat_std"]), (s["cai_mean"], s["cai_std"]), tai)

    def parts(self, c: np.ndarray) -> tuple[float, int, float, int, float, int]:
        """Sum and number of terms of naturalness, codon adaptation and tRNA adaptation of codon numbers."""
        pairs = max(0, len(c) - 2)  # the last pair doesn't count
        sense = c[_SENSE[c]]
        return float(self.pair_log[c[:pairs], c[1 : pairs + 1]].sum()), pairs, float(_LOG_W[c].sum()), len(c), float(_LOG_TAI[sense].sum()), len(sense)

    def z(self, nat, cai, tai) -> np.ndarray:
        scale = lambda v, m: (v - m[0]) / m[1] if m[1] else np.zeros_like(v)
        out = scale(np.asarray(nat), self.nat) + scale(np.asarray(cai), self.cai)
        return out + K.W_TAI * scale(np.asarray(tai), self.tai) if self.tai else out


def _sites(s: np.ndarray) -> int:
    """Motifs of a sequence of base numbers, each counted without overlaps."""
    total, short = 0, s.astype(np.uint8)
    is_base = [short == b for b in range(4)]
    for m in _MOTIFS:
        last = len(s) - len(m) + 1
        if last <= 0:
            continue
        hit = is_base[m[0]][:last].copy()
        for d in range(1, len(m)):
            hit &= is_base[m[d]][d : last + d]
        end = -1
        for p in np.flatnonzero(hit).tolist():
            if p >= end:
                total, end = total + 1, p + len(m)
    return total


def _runs(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    length = np.diff(np.flatnonzero(np.concatenate(([True], np.diff(s) != 0, [True]))))
    return int((length >= 4).sum()), int((length >= 5).sum())


def _gc_penalty(gc: np.ndarray) -> np.ndarray:
    return K.W_GC * (np.maximum(0, gc - K.GC_HI) + np.maximum(0, K.GC_LO - gc))


def _neighbourhood(s: np.ndarray, at: np.ndarray, alt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Change in sites and in the weighted number of runs by each swap."""
    letters = np.full(len(s) + 2 * _WIDTH, 4, dtype=np.uint8)
    letters[_WIDTH : _WIDTH + len(s)] = s
    sites, runs = np.zeros(len(at), np.int64), np.zeros(len(at))
    for a in range(0, len(at), _PART):
        v = slice(a, a + _PART)
        was = letters[3 * at[v] + np.arange(2 * _WIDTH + 3)[:, None]]
        now = was.copy()
        now[_WIDTH : _WIDTH + 3] = _BASES8[alt[v]].T
        sites[v], hp4, hp5 = (x - y for x, y in zip(_around(now), _around(was), strict=True))
        runs[v] = K.W_HP4 * hp4 + K.W_HP5 * hp5
    return sites, runs


def score(c: np.ndarray, scorer: Scorer) -> float:
    return _metrics(c, scorer)[0]


def all_scores(c: np.ndarray, scorer: Scorer, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, other codon and score of each single swap before codon `limit`, by place, then codon."""
    return all_metrics(c, scorer, limit)[:3]


def all_metrics(c: np.ndarray, scorer: Scorer, limit: int, some: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Place, other codon, score, scaled naturalness, codon adaptation, sites and GC of each single swap before codon `limit`.

    some: places and other codons of the swaps that are asked for, by default all.
    """
    if some is None:
        many = _N_ALT[c[:limit]]
        at = np.repeat(np.arange(len(many)), many)
        alt = _ALTS[c[at], L.spread(np.zeros(len(many), np.int64), many)]
    else:
        at, alt = some
    if not len(at):
        return at, alt, *np.zeros((5, 0))
    s = _BASES[c].ravel()
    nat, pairs, cai, nc, tai, nt = scorer.parts(c)
    old = c[at]
    right, left = at < pairs, (at > 0) & (at - 1 < pairs)
    after, before = c[np.minimum(at + 1, len(c) - 1)], c[np.maximum(at - 1, 0)]
    nat = nat + np.where(right, scorer.pair_log[alt, after] - scorer.pair_log[old, after], 0) + np.where(left, scorer.pair_log[before, alt] - scorer.pair_log[before, old], 0)
    cai = cai + _LOG_W[alt] - _LOG_W[old]
    tai = tai + _LOG_TAI[alt] - _LOG_TAI[old]
    sites, runs = _neighbourhood(s, at, alt)
    hp4, hp5 = _runs(s)
    gc = (_STRONG_IN[c].sum() + _STRONG_IN[alt] - _STRONG_IN[old]) / len(s)
    z = scorer.z(nat / max(1, pairs), 2 ** (cai / nc), np.exp(tai / max(1, nt)))
    sites = _sites(s) + sites
    value = z - K.W_SITE * sites - (K.W_HP4 * hp4 + K.W_HP5 * hp5 + runs) - _gc_penalty(gc)
    z_nat = (nat / max(1, pairs) - scorer.nat[0]) / scorer.nat[1] if scorer.nat[1] else np.zeros_like(value)
    return at, alt, value, z_nat, 2 ** (cai / nc), sites, gc


def refine_one(c: np.ndarray, scorer: Scorer, rounds: int) -> tuple[np.ndarray, float, float, int]:
    """Steepest ascent: the best swap of each round, the first among equals, while it gains."""
    stops = np.flatnonzero(~_SENSE[c])
    limit = int(stops[0]) if len(stops) else len(c)
    c, moves = c.copy(), 0
    start = now = score(c, scorer)
    for _ in range(rounds):
        at, alt, value = all_scores(c, scorer, limit)
        if not len(at):
            break
        j = int(np.argmax(np.round(value, 9)))
        if value[j] <= now + K.LEAST_GAIN:
            break
        c[at[j]] = alt[j]
        now = score(c, scorer)
        moves += 1
    return c, start, now, moves


def codon_numbers(seq: str) -> np.ndarray | None:
    """Null if the sequence has other letters; a tail of less than a codon is left out."""
    codes = duplex.codes_of(seq)
    if (codes > 3).any():
        return None
    codes = codes[: len(codes) - len(codes) % 3].reshape(-1, 3)
    return codes @ np.array([16, 4, 1])


def _letters(c: np.ndarray) -> str:
    return "".join(_CODONS[x] for x in c.tolist())


_BASES8, _STRONG_IN = _BASES.astype(np.uint8), np.isin(_BASES, (1, 2)).sum(axis=1)
_CODON_LETTERS = np.array([list(c.encode()) for c in _CODONS], dtype=np.uint8)
#: Letters on either side of a codon that tell what a swap does to motifs; codons of sequences refined side by side; swaps looked at together.
_WIDTH, SIDE_BY_SIDE, _PART = max(map(len, _MOTIFS)) - 1, 1 << 17, 1 << 15


class Together:
    """Sequences side by side, with what each swap of a codon changes; after a move only the swaps near it are looked at again."""

    def __init__(self, c: np.ndarray, n: np.ndarray, scorer: Scorer) -> None:
        self.c, self.n, self.scorer = c.astype(np.int64), n, scorer
        self.first = np.cumsum(n) - n
        self.row = np.repeat(np.arange(len(n)), n)
        self.pairs = np.maximum(n - 2, 0)
        self.place = np.arange(len(c)) - self.first[self.row]
        limit, stops = n.copy(), np.flatnonzero(~_SENSE[self.c])
        np.minimum.at(limit, self.row[stops], self.place[stops])
        # letters, with others between sequences
        self.at_letter = _WIDTH + 3 * np.arange(len(c)) + _WIDTH * self.row
        self.letters = np.full(3 * len(c) + _WIDTH * (len(n) + 1), 4, dtype=np.uint8)
        self.letters[self.at_letter[:, None] + np.arange(3)] = _BASES8[self.c]
        self.many = np.where(self.place < limit[self.row], _N_ALT[self.c], 0)
        self.begin = np.cumsum(self.many) - self.many
        self.at = np.repeat(np.arange(len(c)), self.many)
        self.which = np.arange(len(self.at)) - self.begin[self.at]
        self.alt = np.zeros(len(self.at), np.int64)
        self.nat_by, self.cai_by, self.tai_by = np.zeros((3, len(self.at)))
        self.sites_by, self.hp4_by, self.hp5_by, self.strong_by = np.zeros((4, len(self.at)), np.int8)
        self._look(np.arange(len(self.at)))
        self._sum()

    def _sum(self) -> None:
        rows, c = len(self.n), self.c
        ahead = np.flatnonzero(self.place < self.pairs[self.row])
        self.nat = np.bincount(self.row[ahead], self.scorer.pair_log[c[ahead], c[np.minimum(ahead + 1, max(0, len(c) - 1))]], rows)
        self.cai, self.tai = np.bincount(self.row, _LOG_W[c], rows), np.bincount(self.row, np.where(_SENSE[c], _LOG_TAI[c], 0.0), rows)
        self.n_tai, self.strong = np.bincount(self.row, _SENSE[c], rows), np.bincount(self.row, _STRONG_IN[c], rows)
        t = L.Texts(self.strings())
        self.sites = sum(t.count(m) for m in K.MOTIFS)
        run_row, _, length = t.runs
        self.hp4, self.hp5 = (np.bincount(run_row[length >= least], minlength=rows) for least in (4, 5))

    def strings(self) -> pa.Array:
        offsets = np.append(3 * self.first, 3 * len(self.c)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_CODON_LETTERS[self.c])))

    def _look(self, swaps: np.ndarray) -> None:
        pair, c = self.scorer.pair_log, self.c
        for a in range(0, len(swaps), _PART):
            v = swaps[a : a + _PART]
            at = self.at[v]
            old = c[at]
            self.alt[v] = alt = _ALTS[old, self.which[v]]
            place, pairs = self.place[at], self.pairs[self.row[at]]
            after, before = c[np.minimum(at + 1, len(c) - 1)], c[np.maximum(at - 1, 0)]
            right, left = place < pairs, (place > 0) & (place - 1 < pairs)
            self.nat_by[v] = np.where(right, pair[alt, after] - pair[old, after], 0) + np.where(left, pair[before, alt] - pair[before, old], 0)
            self.cai_by[v], self.tai_by[v], self.strong_by[v] = _LOG_W[alt] - _LOG_W[old], _LOG_TAI[alt] - _LOG_TAI[old], _STRONG_IN[alt] - _STRONG_IN[old]
            was = self.letters[self.at_letter[at] + np.arange(-_WIDTH, _WIDTH + 3)[:, None]]
            now = was.copy()
            now[_WIDTH : _WIDTH + 3] = _BASES8[alt].T
            self.sites_by[v], self.hp4_by[v], self.hp5_by[v] = (x - y for x, y in zip(_around(now), _around(was), strict=True))

    def values(self) -> np.ndarray:
        """Score of each swap."""
        row = self.row[self.at]
        per = lambda x: x[row]
        z = self.scorer.z((per(self.nat) + self.nat_by) / per(np.maximum(1, self.pairs)), np.exp2((per(self.cai) + self.cai_by) / per(self.n)), np.exp((per(self.tai) + self.tai_by) / per(np.maximum(1, self.n_tai))))
        held = K.W_SITE * self.sites + K.W_HP4 * self.hp4 + K.W_HP5 * self.hp5
        moved = K.W_SITE * self.sites_by + K.W_HP4 * self.hp4_by + K.W_HP5 * self.hp5_by
        return z - per(held) - moved - _gc_penalty((per(self.strong) + self.strong_by) / per(3 * self.n))

    def scores(self) -> np.ndarray:
        cai = np.where(self.n > 0, np.exp2(self.cai / np.maximum(1, self.n)), 0.0)
        tai = np.where(self.n_tai > 0, np.exp(self.tai / np.maximum(1, self.n_tai)), 0.0)
        z = self.scorer.z(self.nat / np.maximum(1, self.pairs), cai, tai)
        return z - K.W_SITE * self.sites - K.W_HP4 * self.hp4 - K.W_HP5 * self.hp5 - _gc_penalty(self.strong / np.maximum(1, 3 * self.n))

    def move(self, swaps: np.ndarray) -> None:
        """Make these swaps, one of a sequence at most."""
        at = self.at[swaps]
        self.c[at] = self.alt[swaps]
        self.letters[self.at_letter[at, None] + np.arange(3)] = _BASES8[self.c[at]]
        reach = -(-_WIDTH // 3)
        near = at[:, None] + np.arange(-reach, reach + 1)
        near = near[(near >= 0) & (near < len(self.c)) & (self.row[np.clip(near, 0, len(self.c) - 1)] == self.row[at, None])]
        self._look(L.spread(self.begin[near], self.many[near]))
        self._sum()


def _around(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of letters around a codon (letter, swap), how many motifs on the codon and runs of four and five; what ends further off is alike for all."""
    is_base = [w == b for b in range(4)]
    sites, hp4, hp5 = np.zeros((3, w.shape[1]), np.int8)
    for m in _MOTIFS:
        for p in range(_WIDTH - len(m) + 1, _WIDTH + 3):
            hit = is_base[m[0]][p].copy()
            for d in range(1, len(m)):
                hit &= is_base[m[d]][p + d]
            sites += hit
    cells = w[_WIDTH - 5 : _WIDTH + 8]
    same = (cells[1:] == cells[:-1]) & (cells[1:] < 4)
    for p in range(len(same) - 2):
        hit = same[p] & same[p + 1] & same[p + 2]
        if p:
            hit &= ~same[p - 1]
        hp4 += hit
        if p + 3 < len(same):
            hp5 += hit & same[p + 3]
    return sites, hp4, hp5


def refine_many(c: np.ndarray, n: np.ndarray, scorer: Scorer, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """refine_one() of sequences side by side, `n` codons each: codons, score before and after, moves."""
    out, moves, of = c.copy(), np.zeros(len(n), np.int64), np.arange(len(n))
    now = Together(c, n, scorer) if len(n) else None
    start = now.scores() if now else np.zeros(0)
    end = start.copy()
    for _ in range(rounds):
        if now is None or not len(now.at):
            break
        value = now.values()
        rounded = np.round(value, 9)
        row = now.row[now.at]
        head = np.flatnonzero(np.insert(row[1:] != row[:-1], 0, True))
        best = np.repeat(np.maximum.reduceat(rounded, head), np.diff(np.append(head, len(row))))
        chosen = np.flatnonzero(rounded == best)
        chosen = chosen[np.insert(row[chosen][1:] != row[chosen][:-1], 0, True)]
        chosen = chosen[value[chosen] > end[of[row[chosen]]] + K.LEAST_GAIN]
        if not len(chosen):
            break
        moved = row[chosen]
        now.move(chosen)
        scores = now.scores()
        moves[of[moved]] += 1
        end[of[moved]] = scores[moved]
        begin = np.cumsum(n) - n
        out[L.spread(begin[of[moved]], now.n[moved])] = now.c[L.spread(now.first[moved], now.n[moved])]
        if 2 * now.n[moved].sum() < len(now.c):  # those that are done are left aside
            now, of = Together(now.c[L.spread(now.first[moved], now.n[moved])], now.n[moved], scorer), of[moved]
    return out, start, end, moves


def _parsed(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codon numbers, how many of each string, whether it is null or has other letters), as codon_numbers()."""
    t = L.Texts(strings)
    codes = duplex._CODE[t.letters & 0xDF]
    bad = t.null | (t.total((codes > 3) | (t.letters < 64)) > 0)
    n = np.where(bad, 0, t.length // 3)
    return codes[(L.spread(t.start, n, 3)[:, None] + np.arange(3))] @ np.array([16, 4, 1]), n, bad


def refine(seqs: DataFrame, scorer: Scorer, rounds: int = K.REFINE_ROUNDS, seq: str = "cds") -> DataFrame:
    """(seq_id, refined, score_start, score_end, n_moves). A null sequence or one with other letters gives nulls."""
    held = seqs.sparkSession.sparkContext.broadcast(scorer)  # 4,096 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for part in L.portions(batch.column("seq"), 3 * SIDE_BY_SIDE):
                c, n, bad = _parsed(part)
                out, start, end, moves = refine_many(c, n, held.value, rounds)
                offsets = np.append(0, 3 * np.cumsum(n)).astype(np.int64)
                made = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_CODON_LETTERS[out]))).cast(pa.string())
                columns = [pa.compute.if_else(pa.array(~bad), made, None), *(pa.array(x, t, mask=bad) for x, t in ((start, pa.float64()), (end, pa.float64()), (moves.astype(np.int32), pa.int32())))]
                yield pa.RecordBatch.from_arrays([batch.column("seq_id").slice(a, len(n)), *columns], names=["seq_id", "refined", "score_start", "score_end", "n_moves"])
                a += len(n)

    return duplex.dealt(seqs, seq).mapInArrow(run, "seq_id long, refined string, score_start double, score_end double, n_moves int")


#: Partial sequences that clean_starts() carries on, and what a broken constraint costs; codons of proteins side by side.
BEAM, BROKEN, ABREAST = 16, 1000.0, 1 << 21
_GC_FEWEST, _GC_MOST = int(np.ceil(K.GC_LO * K.GC_WINDOW - 1e-9)), int(K.GC_HI * K.GC_WINDOW + 1e-9)
_AMINOS = np.full(256, -1, dtype=np.int8)
_AMINOS[[ord(a) for a in K.SYNONYMS]] = range(len(K.SYNONYMS))
#: Codons of each amino acid, 64 beyond the last one; by codon, 64 among them: share in the score, strong bases as bits.
_SYN = np.array([([_NUMBER[c] for c in v] + [64] * 6)[:6] for v in K.SYNONYMS.values()])
_N_SYN = (_SYN < 64).sum(axis=1)
_SHARE = np.append(_LOG_W, -np.inf)
_STRONG = np.append(np.isin(_BASES, (1, 2)) @ np.array([4, 2, 1]), 0).astype(np.uint64)
_LAST, _WINDOW, _HELD = 7, np.uint64((1 << K.GC_WINDOW) - 1), np.uint64((1 << K.GC_WINDOW + 2) - 1)
#: By four letters, half of each as bits beside those of a window.
_HALVES = sum((np.arange(256) >> 2 * k + 1 & 1).astype(np.uint64) << np.uint64(K.GC_WINDOW - 1 + k) for k in range(4))
#: Proteins from which on those of like codons are taken by themselves; before, one step serves all.
_APART = 256


@cache
def _new_motifs(n: int) -> np.ndarray:
    """Motifs that a codon after `n` letters (the last `_LAST` at most) brings, by the number of those letters and the codon's."""
    s = np.arange(1 << 2 * (_LAST + 3))
    out = np.zeros(len(s), np.uint8)
    for m in _MOTIFS:
        code = int(m @ 4 ** np.arange(len(m))[::-1])
        at = [p for p in range(_LAST - n, _LAST + 4 - len(m))]
        hit = [(s >> 2 * (_LAST + 3 - p - len(m)) & (1 << 2 * len(m)) - 1) == code for p in at]
        none = np.zeros(len(s), bool)
        within = np.logical_or.reduce([none, *(h for h, p in zip(hit, at, strict=True) if p + len(m) <= _LAST)])
        out += np.logical_or.reduce([none, *hit]) & ~within
    return out


def clean_codons(aa: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Codon numbers of proteins side by side, `n` amino acids each, by usage, without motifs and with the GC of each window within bounds.

    A beam over codons for each protein, each partial sequence with its last letters and the strong bases of its last window; a
    constraint that can't be kept is broken as seldom as the beam finds. All proteins that reach so far take a codon together.
    Of equal last letters and strong bases the best goes on; then the best of each number of strong bases first, so that
    some leave room for what comes. Equal scores go by the first that had those letters and bases.
    """
    begin, rows = np.cumsum(n) - n, np.argsort(-n, kind="stable")
    begin, lengths = begin[rows], n[rows]
    value = np.full((len(n), BEAM), -np.inf)
    value[:, 0] = 0.0
    tail, bits = np.zeros((len(n), BEAM), np.int32), np.zeros((len(n), BEAM), np.uint64)
    parents, codons = [], []
    for k in range(int(lengths[0]) if len(n) else 0):
        active = int(np.searchsorted(-lengths, -k))
        own = aa[begin[:active] + k]
        many = _N_SYN[own]
        groups = [(np.flatnonzero(many == m), m) for m in np.unique(many).tolist()] if active >= _APART else [(np.arange(active), int(many.max()))]
        parent, codon = np.zeros((2, active, BEAM), np.uint8)
        for g, m in groups:
            syn = _SYN[own[g], :m]
            letters = (tail[g][:, :, None] << 6) | (syn & 63).astype(np.int32)[:, None, :]
            strong = ((bits[g][:, :, None] << np.uint64(3)) | _STRONG[syn][:, None, :]) & _HELD
            broken = _new_motifs(min(3 * k, _LAST))[letters]
            in_window = np.bitwise_count(strong & _WINDOW)
            for d in range(3):
                if 3 * k + 3 - d >= K.GC_WINDOW:
                    some = np.bitwise_count(strong >> np.uint64(d) & _WINDOW) if d else in_window
                    broken += (some < _GC_FEWEST) | (some > _GC_MOST)
            v = value[g][:, :, None] + _SHARE[syn][:, None, :] - BROKEN * broken
            order = _by_value(v, value[g], tail[g], bits[g])
            # as one row of numbers for all proteins, which is quicker to take from
            cells = order.shape[1]
            order += cells * np.arange(len(g))[:, None]
            v, letters, strong = (x.ravel() for x in (v, letters & (1 << 2 * _LAST) - 1, strong))
            sorted_v, number = v.take(order), in_window.ravel().take(order).astype(np.uint64)
            seen = np.bitwise_or.accumulate(np.uint64(1) << number, axis=1)
            kept = sorted_v > -np.inf
            kept[:, 1:] &= seen[:, :-1] >> number[:, 1:] & np.uint64(1) == 0
            rank = np.cumsum(kept, axis=1)
            kept &= rank <= BEAM
            from_ = order[kept]
            row = from_ // cells
            slot, from_in = g[row] * BEAM + rank[kept] - 1, from_ - row * cells
            value[g] = -np.inf
            for to, made in ((value, v), (tail, letters), (bits, strong)):
                to.ravel()[slot] = made.take(from_)
            parent.ravel()[slot] = from_in // m
            codon.ravel()[slot] = syn.ravel().take(row * m + from_in % m)
        parents.append(parent)
        codons.append(codon)
    out, slot = np.zeros(len(aa), np.uint8), np.zeros(len(n), np.int64)
    for k in range(len(parents) - 1, -1, -1):
        at = np.arange(len(parents[k]))
        out[begin[at] + k] = codons[k][at, slot[at]]
        slot[at] = parents[k][at, slot[at]]
    return out


def _by_value(v: np.ndarray, value: np.ndarray, tail: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of each row by falling score; equal ones by the first place with the same last letters and strong bases, then by place.

    v: scores by partial sequence and codon; the others are those of the partial sequences. With one codon more, those are alike
    that have four last letters and the bases of a window in common: bases tell half of a letter.
    """
    alike = bits & np.uint64((1 << K.GC_WINDOW - 1) - 1) | _HALVES.take(tail & 255)
    alike[value == -np.inf] = 1 << 63
    flat = -v.reshape(len(v), -1)
    order = np.argsort(flat, axis=1, kind="stable")
    same = np.sort(alike, axis=1)
    rows = np.flatnonzero(((same[:, 1:] == same[:, :-1]) & (same[:, 1:] < 1 << 63)).any(axis=1))
    if len(rows):
        first = (alike[rows, :, None] == alike[rows, None, :]).argmax(axis=2)
        key = (first[:, :, None] * v.shape[2] + np.arange(v.shape[2])).reshape(len(rows), -1)
        order[rows] = np.lexsort((key, flat[rows]), axis=1)
    return order


def _clean(strings: pa.Array) -> pa.Array:
    t = L.Texts(strings)
    aa = _AMINOS[t.letters]
    bad = t.null | (t.total(aa < 0) > 0)
    n = np.where(bad, 0, t.length)
    codons = clean_codons(aa[L.spread(t.start, n)], n)
    offsets = np.append(0, 3 * np.cumsum(n)).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_CODON_LETTERS[codons])))
    return pa.compute.if_else(pa.array(~bad), made, None).cast(pa.string())


def clean_start(aa: str) -> str | None:
    """clean_codons() of one protein. Null if a letter is no amino acid."""
    return _clean(pa.array([aa], pa.string()))[0].as_py()


def clean_starts(proteins: DataFrame, aa: str = "aa") -> DataFrame:
    """(seq_id, seq) by clean_codons(), null for a null protein.

    As a step serves all proteins that reach so far, those of like length are taken together, and like ones once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for part in L.portions(batch.column("seq"), ABREAST):
                part = part.dictionary_encode()
                made = _clean(part.dictionary).take(part.indices)
                yield pa.RecordBatch.from_arrays([batch.column("seq_id").slice(a, len(part)), made], names=["seq_id", "seq"])
                a += len(part)

    return duplex.dealt(proteins, aa, alike=True).mapInArrow(run, "seq_id long, seq string")


def start_pool(proteins: DataFrame, native: DataFrame, aa: str = "aa") -> DataFrame:
    """(seq_id, source, seq): three starts for each protein, clean, native (where there is one) and by the best codons.

    proteins: (seq_id, aa); native: (seq_id, seq), as corpus.native_starts() finds them.
    """
    best = proteins.select("seq_id", C.back_translate(F.col(aa)).alias("seq"))
    parts = {"clean": clean_starts(proteins, aa), "native": native.select("seq_id", "seq"), "cai": best}
    named = [df.where("seq is not null").select("seq_id", F.lit(name).alias("source"), "seq") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def refine_records(records: DataFrame, scorer: Scorer, rounds: int = K.REFINE_ROUNDS) -> DataFrame:
    """Refined records of a folding dump, a row for each different sequence of a protein (without its stop codon).

    records: (protein, lam, seq, row_id). (row_id, protein, lam_start, cds_len, n_moves, score_start, score_end, delta, sites,
    runs and the hard gate before and after, cds_refined).
    """
    from ..functions import sequence as S
    from . import corpus

    rows = records.withColumn("cds", S.trim_stop(S.to_dna(F.col("seq"))))
    rows = corpus.first_of(rows, ["protein", "cds"], ["row_id"]).select(F.col("row_id").alias("seq_id"), "protein", "lam", "cds")
    out = rows.join(refine(rows, scorer, rounds), "seq_id")
    a, z = F.col("cds"), F.col("refined")
    counts = {f"{n}_{at}": f(s) for n, f in (("sites", S.motif_count), ("hp4", S.n_hp4), ("hp5", S.n_hp5)) for at, s in (("start", a), ("end", z))}
    return out.select(
        F.col("seq_id").alias("row_id"), "protein", F.col("lam").alias("lam_start"), F.length("cds").alias("cds_len"), "n_moves", F.round("score_start", 4).alias("score_start"), F.round("score_end", 4).alias("score_end"),
        F.round(F.col("score_end") - F.col("score_start"), 4).alias("delta"), *(c.alias(n) for n, c in counts.items()), S.hard_ok(z).alias("hard_pass_end"), z.alias("cds_refined"),
    )


def breaking(seqs: DataFrame, seq: str = "cds") -> DataFrame:
    """(seq_id, at, alt): swaps of codons at the arms of near-longest duplexes that break a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for part in L.portions(batch.column("seq"), duplex.BESIDE):
                c, n, _ = _parsed(part)
                first = np.cumsum(n) - n
                _, row, arms = duplex.spans_of(_BASES[c].ravel(), 3 * first, 3 * n)
                place, alt = _breaking(c, arms + 3 * first[row, None])
                own = np.searchsorted(first + n, place, side="right")
                ids = batch.column("seq_id").slice(a, len(n)).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([ids, pa.array((place - first[own]).astype(np.int32)), pa.array(_CODONS).take(pa.array(alt))], names=["seq_id", "at", "alt"])
                a += len(n)

    return duplex.dealt(seqs, seq).mapInArrow(run, "seq_id long, at int, alt string")


def _breaking(c: np.ndarray, arms: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """variants_breaking() as places and codons; also of sequences side by side, with places among all letters."""
    codes = _BASES[c].ravel()
    edge = np.zeros(len(c) + 2, dtype=np.int64)
    for a, b in ((arms[:, 0], arms[:, 1]), (arms[:, 2], arms[:, 3])):
        np.add.at(edge, np.maximum(a // 3, 0), 1)
        np.add.at(edge, np.minimum((b - 1) // 3, len(c) - 1) + 1, -1)
    touched = np.cumsum(edge)[: len(c)] > 0
    touched = touched & only if only is not None else touched
    found = [np.zeros(0, np.int64)]
    for some in np.array_split(arms, max(1, -(-int((arms[:, 1] - arms[:, 0] + 1).sum()) // duplex.CHUNK))):
        for low, high in ((some[:, 0], some[:, 1]), (some[:, 2], some[:, 3])):
            many = high // 3 - low // 3 + 1
            at, arm = L.spread(low // 3, many), np.repeat(np.arange(len(some)), many)
            arm, at = arm[touched[at]], at[touched[at]]
            x1, x2, y1, y2 = (some[arm, k, None] for k in range(4))
            p = 3 * at[:, None] + np.arange(3)
            q = x1 + y2 - p
            inside = ((x1 <= p) & (p <= x2) & (y1 <= q) & (q <= y2)) | ((y1 <= p) & (p <= y2) & (x1 <= q) & (q <= x2))
            partner = codes[np.where(inside, q, 0)]
            for slot in range(_ALTS.shape[1]):
                alt = _ALTS[c[at], slot]
                broken = (alt >= 0) & (inside & (partner + _BASES[alt] != 3)).any(axis=1)
                found.append(np.unique(at[broken]) * 8 + slot)
    keys = np.unique(np.concatenate(found))
    return keys // 8, _ALTS[c[keys // 8], keys % 8]


def variants_breaking(c: np.ndarray, arms: np.ndarray, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Swaps of codons at the arms that break a pair (or find it broken). The codon of an arm's last base counts unless it starts there.

    only: whether each codon is of interest.
    """
    return list(zip(*(x.tolist() for x in _breaking(c, arms, only)), strict=True))


def _metrics(c: np.ndarray, scorer: Scorer) -> tuple[float, float, float, int, int, float]:
    """Score, scaled naturalness, codon adaptation, sites, runs of five and GC."""
    s = _BASES[c].ravel()
    nat, pairs, cai, n, tai, n_tai = scorer.parts(c)
    nat, cai, tai = nat / max(1, pairs), 2 ** (cai / n) if n else 0.0, np.exp(tai / n_tai) if n_tai else 0.0
    sites, (hp4, hp5), gc = _sites(s), _runs(s), _STRONG_IN[c].sum() / max(1, len(s))
    value = scorer.z(nat, cai, tai) - K.W_SITE * sites - K.W_HP4 * hp4 - K.W_HP5 * hp5 - _gc_penalty(gc)
    return float(value), (nat - scorer.nat[0]) / scorer.nat[1] if scorer.nat[1] else 0.0, cai, sites, hp5, float(gc)


def _within_gates(m: tuple, base: tuple, slack: float = 0.0):
    kept = (m[0] >= base[0] - K.GATE_SCORE - slack) & (m[1] >= base[1] - K.GATE_NAT - slack) & (m[2] >= base[2] - K.GATE_CAI - slack)
    return kept & (m[3] <= base[3]) & (m[4] <= base[4]) & (K.GC_LO - slack <= m[5]) & (m[5] <= K.GC_HI + slack)


#: Swaps that are looked at together: first so many, then more, with a run of seeds each up to so many pairs.
FIRST, TOGETHER = 16, 1 << 20


def best_swap(c: np.ndarray, scorer: Scorer, scan: duplex.Scan, base: tuple) -> tuple[int, np.ndarray] | None:
    """Longest duplex and codons after the swap, within the gates, that leaves the shortest one.

    Among equals the best score wins (to nine decimals), then the first. Only swaps that shorten the longest duplex count. Those
    of codons that leave one of that length as it is are out at once. Gates are tried before any duplex is followed, on
    numbers that are taken from differences; swaps come by falling score, so each must be shorter than the best before.
    """
    now, rest = scan.best, scan.untouched()
    places, others = _breaking(c, scan.near_best(), rest < now)
    if not len(places):
        return None
    chosen = np.stack([places, others], axis=1)
    limit = int(np.flatnonzero(~_SENSE[c])[0]) if not _SENSE[c].all() else len(c)
    known = places < limit
    value, z_nat, cai, sites, gc = (np.zeros(len(places)) for _ in range(5))
    for x, part in zip((value, z_nat, cai, sites, gc), all_metrics(c, scorer, limit, (places[known], others[known]))[2:], strict=True):
        x[known] = part
    passed = _within_gates((value, z_nat, cai, sites, base[4], gc), base, 1e-6)

    def swapped(i: int, x: int) -> np.ndarray:
        d = c.copy()
        d[i] = x
        return d

    for j in np.flatnonzero(~known).tolist():  # behind a stop codon: no scores from differences
        m = _metrics(swapped(*chosen[j].tolist()), scorer)
        value[j], passed[j] = m[0], _within_gates(m, base)
    chosen, value = chosen[passed], np.round(value[passed], 9)
    chosen = chosen[np.lexsort((chosen[:, 1], chosen[:, 0], -value))]
    best, most = None, now - 1
    a, step = 0, FIRST
    while a < len(chosen):
        part = chosen[a : a + min(step, max(1, TOGETHER // max(1, len(scan.total))))]
        a, step = a + len(part), 4 * step
        part = part[rest[part[:, 0]] <= most]
        length = scan.after(part[:, 0], _BASES[part[:, 1]], rest[part[:, 0]], most)
        # the shortest that all gates let pass, the first of these; later ones must be shorter
        for j in np.argsort(length, kind="stable").tolist():
            if length[j] > most:
                break
            if _within_gates(_metrics(d := swapped(*part[j].tolist()), scorer), base):
                best, most = (int(length[j]), d), int(length[j]) - 1
                break
    return best


def repair_one(c: np.ndarray, scorer: Scorer, rounds: int = K.REPAIR_ROUNDS) -> tuple[np.ndarray, int, int, int, float, float]:
    """Break the longest duplex swap by swap within the gates, until it is short enough.

    Codons, swaps, longest duplex before and after, score before and after.
    """
    base = _metrics(c, scorer)
    scan = duplex.Scan(_BASES[c].ravel())
    before = now = scan.best
    if before < K.REPAIR_LEAST:
        return c, 0, before, before, base[0], base[0]
    swaps = 0
    for _ in range(rounds):
        found = best_swap(c, scorer, scan, base)
        if found is None:
            break
        now, c = found
        swaps += 1
        if now <= K.REPAIR_AIM:
            break
        scan = duplex.Scan(_BASES[c].ravel())
    return c, swaps, before, now, base[0], score(c, scorer)


def repair(seqs: DataFrame, scorer: Scorer, rounds: int = K.REPAIR_ROUNDS, seq: str = "cds") -> DataFrame:
    """(seq_id, repaired, n_swaps, selfcomp_before, selfcomp_after, score_before, score_after); scorer without tRNA adaptation."""
    if scorer.tai is not None:
        raise ValueError("repair is scored without tRNA adaptation")
    held = seqs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        names = ["seq_id", "repaired", "n_swaps", "selfcomp_before", "selfcomp_after", "score_before", "score_after"]
        for batch in batches:
            a = 0
            for part in L.portions(batch.column("seq"), duplex.BESIDE):
                # like sequences are repaired once
                part = part.dictionary_encode()
                every, n, bad = _parsed(part.dictionary)
                first = np.cumsum(n) - n
                longest = duplex.longest_of(_BASES[every].ravel(), 3 * first, 3 * n)[2].tolist()
                out: list[tuple] = []
                for f, m, none, before in zip(first.tolist(), n.tolist(), bad.tolist(), longest, strict=True):
                    c = every[f : f + m]
                    if none:
                        out.append((None,) * 6)
                    elif before < K.REPAIR_LEAST:  # as repair_one() would find
                        out.append((_letters(c), 0, before, before, *(score(c, held.value),) * 2))
                    else:
                        out.append((lambda r: (_letters(r[0]), *r[1:]))(repair_one(c, held.value, rounds)))
                of = part.indices
                yield pa.RecordBatch.from_arrays([batch.column("seq_id").slice(a, len(part)), *(pa.array([r[k] for r in out], t).take(of) for k, t in enumerate(types))], names=names)
                a += len(part)

    return duplex.dealt(seqs, seq, alike=True).mapInArrow(run, "seq_id long, repaired string, n_swaps int, selfcomp_before int, selfcomp_after int, score_before double, score_after double")
