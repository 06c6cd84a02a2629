"""Words, n-grams and minimizers of whole blocks of documents, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes of short words are 64-bit polynomials over random byte
codes, those of grams polynomials over the words' hashes, taken from prefix sums, so that a gram of any length costs a few
operations. Polynomials modulo 2**64 are weak on long periodic strings whatever their codes; longer spans are hashed by XXH3.
What decides by hashes alone takes a second one, over other codes, besides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32
_ODD = 0x9E3779B97F4A7C15
_SLICE = 1 << 17
#: Bytes of a span that a polynomial serves.
SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
OTHER_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 2**64)):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(_SLICE * 2, 1 << (n - 1).bit_length()))


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and each document's first word (one more at the end)."""
    inside = ~separator[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False, quick: bool = False) -> np.ndarray:
    """A hash of the bytes of each span; spans are ascending.

    second: another one, independent of the first. quick: polynomials for long spans too, where bytes are compared later.
    """
    out, codes = np.empty(len(starts), dtype=np.uint64), OTHER_CODES if second else BYTE_CODES
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SLICE, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(codes[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s = starts[a:b] - lo
        out[a:b] = (sums[ends[a:b] - lo] - sums[s]) * down[s]
        a = b
    out = mix(out)
    if not quick and len(long := np.flatnonzero(ends - starts > SHORT)):
        view = memoryview(np.ascontiguousarray(data))
        seed = int(second)
        out[long] = [xxhash.xxh3_64_intdigest(view[s:e], seed) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive codes, by the first one's place; len(codes) - n + 1 of them."""
    count = max(0, len(codes) - n + 1)
    out = np.empty(count, dtype=np.uint64)
    for a in range(0, count, _SLICE):
        b = min(count, a + _SLICE)
        up, down = powers(b - a + n)
        sums = np.zeros(b - a + n, dtype=np.uint64)
        np.cumsum(codes[a : b + n - 1] * up[: b - a + n - 1], out=sums[1:])
        out[a:b] = (sums[n : n + b - a] - sums[: b - a]) * down[: b - a]
    return mix(out)


def inner(firsts: np.ndarray, n: int) -> np.ndarray:
    """Places at which n units of one document start; firsts: each document's first unit, and the end."""
    count = int(firsts[-1])
    ok = np.zeros(count + 1, dtype=np.int8)
    fits = np.diff(firsts) >= n
    np.add.at(ok, firsts[:-1][fits], 1)
    np.add.at(ok, firsts[1:][fits] - n + 1, -1)
    return np.cumsum(ok[:-1]).astype(bool)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def owners(keys: np.ndarray, valid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each valid place i: i and the leftmost place of the smallest (in the upper 32 bits) of the n keys from i on."""
    places, out = np.flatnonzero(valid), []
    count = max(0, len(keys) - n + 1)
    for a in range(0, count, _SLICE):
        b = min(count, a + _SLICE)
        part = (keys[a : b + n - 1] & np.uint64(0xFFFFFFFF00000000)) | np.arange(b - a + n - 1, dtype=np.uint64)
        out.append((sliding_min(part, n) & np.uint64(0xFFFFFFFF)).astype(np.int64)[valid[a:b]] + a)
    return places, np.concatenate(out) if out else places[:0]


def runs(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last place of each run of consecutive places with one owner."""
    if not len(places):
        return owner, places, places
    head = np.insert((np.diff(owner) != 0) | (np.diff(places) != 1), 0, True)
    first = np.flatnonzero(head)
    return owner[first], places[first], places[np.append(first[1:], len(places)) - 1]
