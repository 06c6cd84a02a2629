"""Self-complementary duplexes within a sequence.

A seed is a k-mer whose reverse complement starts at least k + 3 further on. Sequences lie side by side in a task, so their
seeds come from one sort. Extension goes alternately one base towards the loop and one outwards, matches for free and
mismatches on one shared budget; it is one vectorised loop over all seeds of a sequence (Arrow batches), as seeds of
repetitive sequences are many and each needs its own walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import letters as L

_CODE = np.full(256, 4, dtype=np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _i
_CODE[ord("U")] = 3
#: Seeds extended at once; letters of sequences side by side.
CHUNK, BESIDE = 1 << 18, 1 << 18
#: Steps that seeds are walked; what grows on is found from its mismatches, for so many totals of opposite places at once.
STEPS, TOTALS = 48, 256
#: Cells that a swap takes from the mismatches at most, and one more; seeds followed at once; mismatches kept for a sequence.
SWAPPED, ABREAST, KEPT = 7, 1 << 14, 1 << 24
#: Runs whose duplexes are followed first after swaps, by rank.
FIRST_RUNS = (2, 16, 128)


def kmers(seqs: DataFrame, k: int = K.SEED, seq: str = "raw") -> DataFrame:
    """(seq_id, at, kmer): all k-mers and their places from 0."""
    rows = seqs.select("seq_id", F.posexplode(F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))).alias("at", "kmer"))
    return rows.where(F.col("kmer").rlike("^[ACGT]+$"))


def seed_pairs(seqs: DataFrame, k: int = K.SEED, gap: int = K.GAP, seq: str = "raw") -> DataFrame:
    """(seq_id, i, j): places of a k-mer and of its reverse complement, i < j, at least k + gap apart.

    Rows with one id, where there are some, count as one sequence's, each with places of its own. Only sequences are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in by_id(batches):
            ids = rows.column("seq_id").to_numpy()
            t = L.Texts(rows.column("seq").combine_chunks())
            for row, i, j in seeds_of(t.codes, t.start, t.length, group, k, gap):
                for a in range(0, len(i), CHUNK):
                    z = slice(a, a + CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[z]]), pa.array(i[z].astype(np.int32)), pa.array(j[z].astype(np.int32))], names=["seq_id", "i", "j"])

    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seqs.select(F.col("seq_id").cast("long").alias("seq_id"), F.col(seq).alias("seq")).where("seq_id is not null and seq is not null")
    return rows.repartition(n, "seq_id").sortWithinPartitions("seq_id").mapInArrow(run, "seq_id long, i int, j int")


def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows (seq_id, seq) in order of their ids, such that none parts from others of its id, and the number of each row's id; null is an id, too."""

    def numbers(rows: pa.Table) -> np.ndarray:
        ids = rows.column("seq_id")
        null, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        return np.cumsum(np.insert((ids[1:] != ids[:-1]) | (null[1:] != null[:-1]), 0, False))

    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        group = numbers(rows)
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(rows.column("seq")), 0).to_numpy())
        fresh = np.flatnonzero(np.insert(group[1:] != group[:-1], 0, True))
        a = 0
        for z in fresh[1:].tolist():
            if z == fresh[-1] or size[z - 1] - (size[a - 1] if a else 0) >= BESIDE:
                yield rows.slice(a, z - a), group[a:z] - group[a]
                a = z
        rest = rows.slice(a)
    if rest is not None:
        yield rest, numbers(rest)


def seeds_of(codes: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, k: int = K.SEED, gap: int = K.GAP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, i, j) of all seeds of sequences side by side, places within their rows, in chunks; rows of one group meet each other."""
    many = np.maximum(length - k + 1, 0)
    if not many.any():
        return
    at, row = L.spread(start, many), np.repeat(np.arange(len(start)), many)
    n = len(codes) - k + 1
    forward, back, clean = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, dtype=bool)
    for d in range(k):
        now = codes[d : d + n].astype(np.int64)
        forward = forward * 4 + now
        back += (3 - now) << (2 * d)
        clean &= now < 4
    some = clean[at]
    at, row = at[some], row[some]
    own = group[row] << (2 * k)
    place = at - start[row]
    order = np.argsort(own + forward[at], kind="stable")
    keys = (own + forward[at])[order]
    # sought in order of the keys of what is sought, so that neighbours are near in memory
    seek = own + back[at]
    ranked = np.argsort(seek, kind="stable")
    first, last = (np.empty(len(at), np.int64) for _ in range(2))
    first[ranked], last[ranked] = (np.searchsorted(keys, seek[ranked], side=s) for s in ("left", "right"))
    count = last - first
    ends = np.cumsum(count)
    a = 0
    while a < len(at):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
        one = np.repeat(np.arange(a, z), count[a:z])
        other = order[L.spread(first[a:z], count[a:z])]
        far = place[other] - place[one] >= k + gap
        if far.any():
            yield row[one[far]], place[one[far]], place[other[far]]
        a = z


def codes_of(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.upper().encode("latin-1", "replace"), dtype=np.uint8)]


def seeds(codes: np.ndarray, k: int = K.SEED, gap: int = K.GAP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all seeds, in chunks."""
    n = len(codes) - k + 1
    if len(codes) < 2 * k + gap:
        return
    forward, back = np.zeros((2, n), dtype=np.int64)
    clean = np.ones(n, dtype=bool)
    for d in range(k):
        forward = forward * 4 + codes[d : d + n]
        back = back + (3 - codes[d : d + n]) * 4**d
        clean &= codes[d : d + n] < 4
    places = np.flatnonzero(clean)
    order = places[np.argsort(forward[places], kind="stable")]
    keys = forward[order]
    # of each place, the places further on whose k-mer is the reverse complement
    first, last = (np.searchsorted(keys, back[places], side=s) for s in ("left", "right"))
    count = last - first
    a = 0
    ends = np.cumsum(count)
    while a < len(places):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
        c = count[a:z]
        i = np.repeat(places[a:z], c)
        within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        j = order[np.repeat(first[a:z], c) + within]
        far = j - i >= k + gap
        if far.any():
            yield i[far], j[far]
        a = z


def telling(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the seeds within one run of matching bases the first, the middle and the last.

    How much of the budget a seed's walk spends towards the loop only grows from the first to the last seed of a run, and
    from a seed in the middle one mismatch goes to either side; so these three reach whatever the others do.
    """
    order = np.lexsort((i, i + j))
    i, j = i[order], j[order]
    head = np.flatnonzero(np.insert((np.diff(i + j) != 0) | (np.diff(i) != 1), 0, True)) if len(i) else i
    last = np.append(head[1:], len(i)) - 1 if len(i) else i
    pick = np.unique(np.concatenate([head, last, (head + last) // 2]))
    return i[pick], j[pick]


def extend(
    codes: np.ndarray, i: np.ndarray, j: np.ndarray, k: int = K.SEED, budget: int = K.MISMATCHES, swapped: tuple[np.ndarray, np.ndarray] | None = None, limit: int | None = None, within: tuple[np.ndarray, np.ndarray] | None = None, known: Misses | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arms (x1, x2, y1, y2) that each seed grows into; a seed whose arms are longer than `limit` may stop early.

    swapped: for each seed a place, and three bases that stand there in place of the sequence's. within: for each seed the first
    and the last place of its sequence, if several lie side by side. known: for reach().
    """
    n = len(codes)
    low, high = within if within is not None else (np.zeros(len(i), np.int64), np.full(len(i), n - 1))
    padded = np.concatenate([codes, np.array([4, 4], dtype=np.int64)])
    x1, x2, y1, y2 = i.copy(), i + k - 1, j.copy(), j + k - 1
    spent = np.zeros(len(i), dtype=np.int64)
    live = np.arange(len(i))

    def base(p: np.ndarray) -> np.ndarray:
        if swapped is None:
            return padded[p]
        inside = p - swapped[0][live]
        own = (inside >= 0) & (inside < 3)
        out = padded[p]
        out[own] = swapped[1][live[own], inside[own]]
        return out

    def pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        one = base(p)
        return (one < 4) & (one + base(q) == 3)

    for _ in range(STEPS if limit is None or limit <= 2 * STEPS else 0):
        if not len(live):
            break
        a, b = x2[live] + 1, y1[live] - 1
        room = (b > a) & (a < n)
        match = room & pairs(np.where(room, a, n), np.where(room, b, n))
        pay = room & ~match & (spent[live] < budget)
        inward = match | pay
        x2[live[inward]] += 1
        y1[live[inward]] -= 1
        spent[live[pay]] += 1
        a, b = x1[live] - 1, y2[live] + 1
        room = (a >= low[live]) & (b <= high[live])
        match = room & pairs(np.where(room, a, n), np.where(room, b, n))
        pay = room & ~match & (spent[live] < budget)
        outward = match | pay
        x1[live[outward]] -= 1
        y2[live[outward]] += 1
        spent[live[pay]] += 1
        go = inward | outward
        if limit is not None:
            go &= x2[live] - x1[live] < limit
        live = live[go]
    if len(live):
        some = None if swapped is None else (swapped[0][live], swapped[1][live])
        if within is None:
            x1[live], x2[live] = reach(codes, i[live], j[live], k, budget, some, known)
        for a, z in sorted(set(zip(low[live].tolist(), high[live].tolist(), strict=True))) if within is not None else ():
            own = live[low[live] == a]
            x1[own], x2[own] = (x + a for x in reach(codes[a : z + 1], i[own] - a, j[own] - a, k, budget, None))
        total = i[live] + j[live] + k - 1
        y1[live], y2[live] = total - x2[live], total - x1[live]
    return x1, x2, y1, y2


class Misses:
    """Mismatches of stretches of opposite places, by their total and in order; of some totals."""

    def __init__(self, codes: np.ndarray, totals: np.ndarray) -> None:
        n = len(codes)
        self.totals, self.wide = totals, n + 1
        # bases, and their partners from the sequence's end on: what is opposite lies side by side
        own, partner = codes.astype(np.uint8), np.where(codes > 3, 9, 3 - codes).astype(np.uint8)[::-1].copy()
        lows, highs = np.maximum(0, totals - n + 1), (totals - 1) // 2
        begin = np.concatenate(([0], np.cumsum(highs - lows + 1)))
        differs = np.empty(begin[-1], dtype=bool)
        for s, low, high, b in zip(totals.tolist(), lows.tolist(), highs.tolist(), begin.tolist(), strict=False):
            np.not_equal(own[low : high + 1], partner[n - 1 - s + low : n - s + high], out=differs[b : b + high - low + 1])
        self.keys = np.flatnonzero(differs)
        self.bounds = np.searchsorted(self.keys, begin)
        # places, each total's beyond those of the one before
        self.keys += np.repeat(np.arange(len(totals)) * self.wide + lows - begin[:-1], np.diff(self.bounds))

    def near(self, low: np.ndarray, high: np.ndarray, more: int) -> None:
        """Keep those from `low` to `high` of each total, and so many on either side."""
        lift = np.arange(len(self.totals)) * self.wide
        first = np.maximum(self.bounds[:-1], np.searchsorted(self.keys, lift + low) - more)
        end = np.minimum(self.bounds[1:], np.searchsorted(self.keys, lift + high) + more)
        self.keys = self.keys[L.spread(first, end - first)]
        self.bounds = np.concatenate(([0], np.cumsum(end - first)))

    @staticmethod
    def of(codes: np.ndarray, total: np.ndarray, first: np.ndarray, last: np.ndarray, k: int, budget: int) -> Misses | None:
        """Those that the seeds of runs in order of their totals meet, also after a swap; none if they are too many to keep."""
        head = np.flatnonzero(np.insert(total[1:] != total[:-1], 0, True)) if len(total) else total
        totals, low, high = total[head], np.minimum.reduceat(first, head) if len(head) else head, np.maximum.reduceat(last, head) + k if len(head) else head
        parts, size = [], 0
        for a in range(0, len(totals), TOTALS):
            part = Misses(codes, totals[a : a + TOTALS])
            part.near(low[a : a + TOTALS], high[a : a + TOTALS], budget + SWAPPED)
            part.keys += a * part.wide
            parts.append(part)
            size += len(part.keys)
            if size > KEPT:
                return None
        if not parts:
            return None
        parts[0].totals, parts[0].keys = totals, np.concatenate([p.keys for p in parts])
        parts[0].bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.bounds) for p in parts]))))
        return parts[0]

    def arms(self, codes: np.ndarray, row: np.ndarray, at: np.ndarray, k: int, budget: int, swapped: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(x1, x2) of seeds by their totals' rows and places."""
        n, none = len(codes), np.int64(1) << 40
        t, lift = self.totals[row], row * self.wide
        low, high = np.maximum(0, t - n + 1), (t - 1) // 2
        steps = np.arange(budget + SWAPPED)[:, None]
        if swapped is not None:
            first, bases = swapped[0], swapped[1].T
            cells = np.concatenate([first + steps[:3], t - first - steps[:3]])
            fits = (cells >= low) & (cells <= high)
            inside = cells - first
            one = np.where((inside >= 0) & (inside < 3), np.take_along_axis(bases, np.clip(inside, 0, 2), 0), codes[np.where(fits, cells, 0)])
            # opposite places of the first three cells are the last three
            opposite = t - cells
            inside = opposite - first
            other = np.where((inside >= 0) & (inside < 3), np.take_along_axis(bases, np.clip(inside, 0, 2), 0), codes[np.where(fits, opposite, 0)])
            fits &= (one > 3) | (one + other != 3)
        sides = []
        for inward in (True, False):
            # distances to the next mismatches from the seed's last or first place
            begin = np.searchsorted(self.keys, lift + (at + k if inward else at))
            want = begin + steps if inward else begin - 1 - steps
            ok = want < self.bounds[row + 1] if inward else want >= self.bounds[row]
            p = self.keys.take(want, mode="clip") - lift if len(self.keys) else np.zeros(want.shape, np.int64)
            if swapped is not None:
                for cell in (p, t - p):
                    ok &= (cell < first) | (cell > first + 2)
                p, ok = np.concatenate([p, cells]), np.concatenate([ok, fits])
            gap = p - (at + k - 1) if inward else at - p
            gap[~ok | (gap <= 0)] = none
            found = []
            for left in range(budget, -1, -1):
                found.append(gap.min(axis=0))
                if left:
                    gap[gap == found[-1]] = none  # a cell may be on both arms of the swap
            sides.append(np.stack(found))
        towards, outwards = sides
        # in order of their distances, those towards the loop first among equals, the first ones are paid for
        paid = []
        for own, others, late in ((towards[:budget], outwards[:budget], 0), (outwards[:budget], towards[:budget], 1)):
            rank = np.arange(budget)[:, None] + (others[None] < own[:, None] + late).sum(axis=1)
            paid.append(((rank < budget) & (own < none)).sum(axis=0, keepdims=True))
        inside, outside = paid
        x2 = np.minimum(at + k - 1 + np.take_along_axis(towards, inside, 0)[0], high + 1) - 1
        return np.maximum(at - np.take_along_axis(outwards, outside, 0)[0], low - 1) + 1, x2


def reach(codes: np.ndarray, i: np.ndarray, j: np.ndarray, k: int, budget: int, swapped: tuple[np.ndarray, np.ndarray] | None, known: Misses | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same arms without walking: (x1, x2) from the next mismatches on either side, for seeds that grow long.

    A walk meets them in order of their distances, those towards the loop first among equals, and pays for the first ones.
    known: the mismatches of some totals, near their seeds.
    """
    total = i + j + k - 1
    x1, x2 = np.empty_like(i), np.empty_like(i)

    def follow(misses: Misses, seed: np.ndarray, row: np.ndarray) -> None:
        for a in range(0, len(seed), ABREAST):
            some, own = seed[a : a + ABREAST], row[a : a + ABREAST]
            x1[some], x2[some] = misses.arms(codes, own, i[some], k, budget, None if swapped is None else (swapped[0][some], swapped[1][some]))

    rest = np.arange(len(i))
    if known is not None:
        row = np.minimum(np.searchsorted(known.totals, total), len(known.totals) - 1)
        hit = known.totals[row] == total
        follow(known, np.flatnonzero(hit), row[hit])
        rest = np.flatnonzero(~hit)
    totals, of = np.unique(total[rest], return_inverse=True)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(0, len(totals) + TOTALS, TOTALS))
    for a, (low, high) in zip(range(0, len(totals), TOTALS), zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), strict=True):
        own = order[low:high]
        follow(Misses(codes, totals[a : a + TOTALS]), rest[own], of[own] - a)
    return x1, x2


def longest(codes: np.ndarray, k: int = K.SEED, budget: int = K.MISMATCHES) -> tuple[int, int, int]:
    """Number of seeds, longest exact and longest near-perfect duplex; zeros without seeds."""
    count = exact = near = 0
    for i, j in seeds(codes, k):
        count += len(i)
        i, j = telling(i, j)
        x1, x2, _, _ = extend(codes, i, j, k, 0)
        exact = max(exact, int((x2 - x1).max()) + 1)
        x1, x2, _, _ = extend(codes, i, j, k, budget)
        near = max(near, int((x2 - x1).max()) + 1)
    return count, exact, near


def grown(codes: np.ndarray, start: np.ndarray, length: np.ndarray, budgets: tuple[int, ...], k: int = K.SEED) -> Iterator[tuple[np.ndarray, int, list[tuple[np.ndarray, ...]]]]:
    """(row, number of seeds, arms by budget) of sequences side by side, in chunks: of the telling seeds, places within all codes."""
    for row, i, j in seeds_of(codes, start, length, np.arange(len(start)), k):
        count = np.bincount(row, minlength=len(start))
        # totals of opposite places differ between sequences, as those are apart
        i, j = telling(i + start[row], j + start[row])
        row = np.searchsorted(start + length, i, side="right")
        within = start[row], start[row] + length[row] - 1
        yield row, count, [extend(codes, i, j, k, b, within=within) for b in budgets]


def longest_of(codes: np.ndarray, start: np.ndarray, length: np.ndarray, k: int = K.SEED, budget: int = K.MISMATCHES) -> np.ndarray:
    """longest() of sequences side by side: (3, sequence)."""
    out = np.zeros((3, len(start)), np.int64)
    for row, count, arms in grown(codes, start, length, (0, budget), k):
        out[0] += count
        for best, (x1, x2, _, _) in zip(out[1:], arms, strict=True):
            np.maximum.at(best, row, x2 - x1 + 1)
    return out


def spans_of(codes: np.ndarray, start: np.ndarray, length: np.ndarray, k: int = K.SEED, budget: int = K.MISMATCHES, near: int = K.REPAIR_NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spans() of sequences side by side: longest duplex of each; row and arms of those near it, in order."""
    best, kept = np.zeros(len(start), np.int64), np.zeros((0, 5), np.int64)
    for row, _, ((x1, x2, y1, y2),) in grown(codes, start, length, (budget,), k):
        np.maximum.at(best, row, x2 - x1 + 1)
        kept = np.concatenate([kept, np.stack([row, *(x - start[row] for x in (x1, x2, y1, y2))], axis=1)])
        kept = np.unique(kept[kept[:, 2] - kept[:, 1] + 1 >= np.maximum(k, best[kept[:, 0]] - near)], axis=0)
    kept = kept[kept[:, 2] - kept[:, 1] + 1 >= np.maximum(k, best[kept[:, 0]] - near)]
    return best, kept[:, 0], kept[:, 1:]


def spans(codes: np.ndarray, k: int = K.SEED, budget: int = K.MISMATCHES, near: int = K.REPAIR_NEAR) -> tuple[int, np.ndarray]:
    """Longest duplex, and the different arms (x1, x2, y1, y2) of those at most `near` shorter."""
    best, kept = 0, np.zeros((0, 4), dtype=np.int64)
    for i, j in seeds(codes, k):
        arms = np.stack(extend(codes, *telling(i, j), k, budget), axis=1)
        length = arms[:, 1] - arms[:, 0] + 1
        best = max(best, int(length.max()))
        kept = np.unique(np.concatenate([kept, arms[length >= max(k, best - near)]]), axis=0)
    return best, kept[kept[:, 1] - kept[:, 0] + 1 >= max(k, best - near)]


def dealt(seqs: DataFrame, seq: str, alike: bool = False) -> DataFrame:
    """(seq_id, seq) over all shuffle partitions: what follows is much work on little data, so they aren't coalesced.

    alike: by length, rows with one sequence next to each other, for work that is done once for all of them.
    """
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seqs.select("seq_id", F.col(seq).alias("seq"))
    return rows.repartition(n, "seq").sortWithinPartitions(F.length("seq"), "seq") if alike else rows.repartition(n, "seq_id")


def merged(*runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (..., first, last) with those joined that overlap or touch and are alike in all else."""
    *keys, first, last = runs
    if not len(first):
        return runs
    order = np.lexsort((first, *keys[::-1]))
    keys, first, last = [k[order] for k in keys], first[order], last[order]
    fresh = np.insert(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]), 0, True)
    # the furthest end so far, within equal keys: keys lifted above any place
    lift = (np.cumsum(fresh) - 1) * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + lift)
    head = np.flatnonzero(fresh | np.insert(first[1:] + lift[1:] > reach[:-1] + 1, 0, True))
    return *(k[head] for k in keys), first[head], np.maximum.reduceat(last, head)


def stretches(found: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merged() of seeds (total, first place, first place), each as one number: total times n and place."""
    if not found:
        return (np.zeros(0, np.int64),) * 3
    seed = np.sort(np.concatenate(found))
    head = np.flatnonzero(np.insert(np.diff(seed) != 1, 0, True) | (seed % n == 0))
    last = np.append(head[1:], len(seed)) - 1
    return seed[head] // n, seed[head] % n, seed[last] % n


def without(runs: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (..., first, last) less the places from `low` to `high`, one of each for each run."""
    *keys, first, last = runs
    apart = (high < low) | (high < first) | (low > last)
    parts = [(apart, first, last), (~apart & (first < low), first, low - 1), (~apart & (last > high), high + 1, last)]
    return *(np.concatenate([k[m] for m, _, _ in parts]) for k in keys), np.concatenate([a[m] for m, a, _ in parts]), np.concatenate([b[m] for m, _, b in parts])


class Scan:
    """All duplexes of a sequence, kept so that the effects of many swaps are found together.

    Bases p and total - p are opposite. A run is a stretch of seeds with one total, by the places of its first and last; it is
    told by three of them, see telling(). What a run's duplexes read are two stretches of the sequence; a swap elsewhere
    leaves them as they are.
    """

    def __init__(self, codes: np.ndarray, k: int = K.SEED, budget: int = K.MISMATCHES) -> None:
        self.codes, self.k, self.budget = codes, k, budget
        self.total, self.first, self.last = stretches([(i + j) * len(codes) + i for i, j in seeds(codes, k)], len(codes))
        runs = len(self.total)
        self.known = Misses.of(codes, self.total + k - 1, self.first, self.last, k, budget) if runs > FIRST_RUNS[-1] else None
        i = np.concatenate([self.first, (self.first + self.last) // 2, self.last])
        self.arms = np.stack(extend(codes, i, np.tile(self.total, 3) - i, k, budget, known=self.known), axis=1)
        self.length = self.arms[:, 1] - self.arms[:, 0] + 1
        self.best = int(self.length.max()) if runs else 0
        by_run = self.arms.reshape(3, runs, 4)
        self.longest = self.length.reshape(3, runs).max(axis=0, initial=0)
        low, high = by_run.min(axis=0, initial=len(codes)), by_run.max(axis=0, initial=-1)
        self.read = low[:, 0] - 1, high[:, 1] + 1, low[:, 2] - 1, high[:, 3] + 1

    def near_best(self, near: int = K.REPAIR_NEAR) -> np.ndarray:
        """The different arms of duplexes at most `near` shorter than the longest."""
        return np.unique(self.arms[self.length >= max(self.k, self.best - near)], axis=0)

    def untouched(self) -> np.ndarray:
        """For each codon, the longest duplex that a swap of it leaves as it is."""
        n = len(self.codes) // 3
        out, left = np.zeros(n, dtype=np.int64), np.arange(n)
        for r in np.argsort(-self.longest, kind="stable").tolist():
            if not len(left):
                break
            a1, z1, a2, z2 = (x[r] for x in self.read)
            hit = ((3 * left + 2 >= a1) & (3 * left <= z1)) | ((3 * left + 2 >= a2) & (3 * left <= z2))
            out[left[~hit]] = self.longest[r]
            left = left[hit]
        return out

    def after(self, at: np.ndarray, bases: np.ndarray, untouched: np.ndarray, limit: int) -> np.ndarray:
        """Longest duplex after each swap of codon `at` for `bases` (swap, 3); of those beyond `limit` any value beyond it.

        untouched: by swap, what it leaves as it is.
        """
        out = untouched.copy()
        # what is left of the longest duplexes is enough to rule most swaps out
        for most in FIRST_RUNS:
            if most < len(self.total):
                left = np.flatnonzero(out <= limit)
                self._follow(at[left], bases[left], self._cut(at[left], self.by_length[:most]), limit, left, out)
        left = np.flatnonzero(out <= limit)
        runs = self._cut(at[left], np.arange(len(self.total)))
        made = self._made(at[left], bases[left])
        self._follow(at[left], bases[left], merged(*(np.concatenate(x) for x in zip(runs, made, strict=True))), limit, left, out)
        return out

    def _cut(self, at: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, ...]:
        """(swap, total, first, last): of the runs that read a swap's codon, the seeds beside it."""
        a1, z1, a2, z2 = (x[among] for x in self.read)
        p = 3 * at[:, None]
        swap, run = np.nonzero(((p + 2 >= a1) & (p <= z1)) | ((p + 2 >= a2) & (p <= z2)))
        run = among[run]
        runs: tuple[np.ndarray, ...] = (swap, self.total[run], self.first[run], self.last[run])
        p = 3 * at[swap]
        runs = without(runs, p - self.k + 1, p + 2)
        p = 3 * at[runs[0]]
        return without(runs, runs[1] - p - 2, runs[1] - p + self.k - 1)

    def _made(self, at: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, ...]:
        """The seeds on each swap's codon as it is afterwards, as runs of one."""
        n, k = len(self.codes), self.k
        w = (3 * at[:, None] + np.arange(1 - k, 3)).ravel()
        swap = np.repeat(np.arange(len(at)), k + 2)
        fits = (w >= 0) & (w + k <= n)
        w, swap = w[fits], swap[fits]
        cells = w[:, None] + np.arange(k)
        inside = cells - 3 * at[swap, None]
        new = np.where((inside >= 0) & (inside < 3), bases[swap[:, None], np.clip(inside, 0, 2)], self.codes[cells])
        places, keys = self.index
        back = ((3 - new) * 4 ** np.arange(k)).sum(axis=1)
        a, z = (np.searchsorted(keys, back, side=s) for s in ("left", "right"))
        count = np.where((new > 3).any(axis=1), 0, z - a)
        own = np.repeat(np.arange(len(w)), count)
        other = places[np.repeat(a, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
        far = np.abs(other - w[own]) >= k + K.GAP
        own, other = own[far], other[far]
        i = np.minimum(w[own], other)
        return swap[own], w[own] + other, i, i

    def _follow(self, at: np.ndarray, bases: np.ndarray, runs: tuple[np.ndarray, ...], limit: int, rows: np.ndarray, out: np.ndarray) -> None:
        """Raise out[rows] to the longest duplexes of these runs."""
        swap, total, first, last = runs
        i = np.concatenate([first, (first + last) // 2, last])
        swap = np.tile(swap, 3)
        x1, x2, _, _ = extend(self.codes, i, np.tile(total, 3) - i, self.k, self.budget, (3 * at[swap], bases[swap]), limit, known=self.known)
        np.maximum.at(out, rows[swap], x2 - x1 + 1)

    @cached_property
    def by_length(self) -> np.ndarray:
        return np.argsort(-self.longest, kind="stable")

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all k-mers, ordered by their numbers, and these."""
        n = max(0, len(self.codes) - self.k + 1)
        number, clean = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for d in range(self.k):
            number = number * 4 + self.codes[d : d + n]
            clean &= self.codes[d : d + n] < 4
        places = np.flatnonzero(clean)
        places = places[np.argsort(number[places], kind="stable")]
        return places, number[places]


def side_by_side(strings: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, codes, start, length) of portions of an array, codes as codes_of() gives them; null is empty."""
    a = 0
    for part in L.portions(strings, BESIDE):
        t = L.Texts(part)
        codes = np.where(t.letters < 64, 4, _CODE[t.letters & 0xDF])
        yield a, t.n, codes, t.start, t.length
        a += t.n


def selfcomp_scan(seqs: DataFrame, seq: str = "raw", k: int = K.SEED, budget: int = K.MISMATCHES) -> DataFrame:
    """(seq_id, n_seed_pairs, exact, near): a null or short sequence has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, *some in side_by_side(batch.column("seq")):
                found = longest_of(*some, k, budget)
                columns = [pa.array(found[c].astype(t.to_pandas_dtype()), t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("seq_id").slice(a, n), *columns], names=["seq_id", "n_seed_pairs", "exact", "near"])

    return dealt(seqs, seq).mapInArrow(run, "seq_id long, n_seed_pairs long, exact int, near int")


def scan_duplexes(seqs: DataFrame, seq: str = "raw") -> DataFrame:
    """(seq_id, best, length, x1, x2, y1, y2): a row for each different duplex close to the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, *some in side_by_side(batch.column("seq")):
                best, row, arms = spans_of(*some)
                table = np.column_stack([best[row], arms[:, 1] - arms[:, 0] + 1, arms]).astype(np.int32)
                names = ["seq_id", "best", "length", "x1", "x2", "y1", "y2"]
                ids = batch.column("seq_id").slice(a, n).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(table[:, c]) for c in range(6))], names=names)

    return dealt(seqs, seq).mapInArrow(run, "seq_id long, best int, length int, x1 int, x2 int, y1 int, y2 int")
