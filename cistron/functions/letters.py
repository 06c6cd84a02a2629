"""Column expressions over Arrow arrays of strings: the letters of many rows as one numpy array, so that no step is a row's own.

Sums over a row's letters or codons are taken from left to right, as an aggregate over an array takes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text looked at together; a longer string is by itself.
TOGETHER = 1 << 21
CODE = np.full(256, 4, dtype=np.uint8)
CODE[list(b"ACGT")] = range(4)
#: Number of a codon with other letters than A, C, G and T.
UNKNOWN = 64
CODONS = ["".join(c) for c in product("ACGT", repeat=3)]


def by_codon(values: dict[str, float]) -> np.ndarray:
    """Values by codon number, NaN for those without."""
    return np.array([values.get(c, np.nan) for c in [*CODONS, ""]])


class Texts:
    """Strings as letters side by side; null counts as empty. Letters beyond ASCII are one each, and none of the known ones."""

    def __init__(self, strings: pa.Array) -> None:
        self.n = len(strings)
        self.null = strings.is_null().to_numpy(zero_copy_only=False)
        strings = strings.fill_null("") if strings.null_count else strings
        _, offsets, data = strings.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(strings.type) else np.int32)[strings.offset : strings.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, np.int64)
        self.letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        if len(self.letters) and self.letters.max() > 127:
            lead = (self.letters & 0xC0) != 0x80
            at, self.letters = np.concatenate(([0], np.cumsum(lead)))[at], self.letters[lead]
        self.start, self.length = at[:-1], np.diff(at)

    @cached_property
    def codes(self) -> np.ndarray:
        return CODE[self.letters]

    @cached_property
    def n_codons(self) -> np.ndarray:
        return self.length // 3

    @cached_property
    def first(self) -> np.ndarray:
        """Place of each row's first codon among all codons."""
        return np.cumsum(self.n_codons) - self.n_codons

    @cached_property
    def numbers(self) -> np.ndarray:
        """Numbers of all whole codons, row after row."""
        if (self.length % 3).any():
            at = spread(self.start, self.n_codons, 3)
            a, b, c = (self.codes[at + d] for d in range(3))
        else:
            a, b, c = self.codes.reshape(-1, 3).T
        return np.where((a | b | c) > 3, UNKNOWN, (a << 4) + (b << 2) + c).astype(np.uint8)

    @cached_property
    def codon_row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_codons)

    def pairs(self, include_last_pair: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the pairs of neighbouring codons, -1 if one has other letters; of `corpus`' rule on the last pair."""
        many = np.maximum(self.n_codons - 1 if include_last_pair else -((6 - self.length) // 3), 0)
        at = spread(self.first, many)
        one, other = self.numbers[at].astype(np.int64), self.numbers[at + 1]
        return np.repeat(np.arange(self.n), many), np.where((one == UNKNOWN) | (other == UNKNOWN), -1, one * 64 + other)

    def sums(self, row: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, self.n)

    def total(self, hits: np.ndarray) -> np.ndarray:
        """Number of hits (a flag by letter) in each row."""
        upto = np.concatenate(([0], np.cumsum(hits)))
        return upto[self.start + self.length] - upto[self.start]

    def of(self, some: str) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(some.encode())] = True
        return table[self.letters]

    def count(self, motif: str) -> np.ndarray:
        """Occurrences in each row that don't overlap, from the left."""
        m, last = motif.encode(), len(self.letters) - len(motif) + 1
        if last <= 0:
            return np.zeros(self.n, np.int64)
        found = self.letters[:last] == m[0]
        for d in range(1, len(m)):
            found &= self.letters[d : last + d] == m[d]
        at = np.flatnonzero(found)
        row = np.searchsorted(self.start, at, side="right") - 1
        whole = at + len(m) <= self.start[row] + self.length[row]
        at, row = at[whole], row[whole]
        if (np.diff(at) < len(m)).any():
            kept, end = [], -1
            for p, r in zip(at.tolist(), row.tolist(), strict=True):
                if p >= end:
                    kept.append(r)
                    end = p + len(m)
            row = np.array(kept, np.int64)
        return np.bincount(row, minlength=self.n)

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, letter, length) of the stretches of one letter."""
        if not len(self.letters):
            return (np.zeros(0, np.int64),) * 3
        fresh = np.concatenate(([True], self.letters[1:] != self.letters[:-1]))
        fresh[self.start[self.length > 0]] = True
        at = np.flatnonzero(fresh)
        many = np.diff(np.searchsorted(at, np.append(self.start, len(self.letters))))
        return np.repeat(np.arange(self.n), many), self.letters[at], np.diff(np.append(at, len(self.letters)))

    def strings(self, keep: np.ndarray, letters: np.ndarray, null: np.ndarray | None = None, start: np.ndarray | None = None, length: np.ndarray | None = None) -> pa.Array:
        """Of the letters side by side those to keep, as strings of their rows."""
        upto = np.concatenate(([0], np.cumsum(keep)))
        start, length = (self.start, self.length) if start is None else (start, length)
        offsets = np.append(upto[start], upto[-1]).astype(np.int64) if self.n else np.zeros(1, np.int64)
        made = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters[keep])))
        null = self.null if null is None else null
        return pa.compute.if_else(pa.array(~null), made, None) if null.any() else made


def spread(start: np.ndarray, many: np.ndarray, step: int = 1) -> np.ndarray:
    """start, start + step, ... of each row, as often as `many` says."""
    return np.repeat(start - step * (np.cumsum(many) - many), many) + step * np.arange(int(many.sum()))


def portions(strings: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Consecutive slices of some TOGETHER bytes, or `most`."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(strings), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    a = 0
    while a < len(strings):
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + (most or TOGETHER), side="right")))
        yield strings.slice(a, z - a)
        a = z


#: What a function gives for the strings of a portion, one value for each.
Measure = Callable[[Texts], pa.Array | np.ndarray | np.ma.MaskedArray]
_KINDS = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "struct<pairs: int, longest: int, n8: int>": pa.struct([(c, pa.int32()) for c in ("pairs", "longest", "n8")])}


def _array(kind: str, out: pa.Array | np.ndarray | np.ma.MaskedArray) -> pa.Array:
    if isinstance(out, np.ma.MaskedArray):
        out = pa.array(out.data, mask=np.ma.getmaskarray(out))
    return (out if isinstance(out, pa.Array) else pa.array(out)).cast(_KINDS[kind])


class Together:
    """A column of which several measures are taken at once: functions made by column() take it in a column's place, in together()."""

    def __init__(self) -> None:
        self.measures: list[tuple[str, Measure]] = []

    def add(self, kind: str, f: Measure) -> int:
        self.measures.append((kind, f))
        return len(self.measures) - 1


def together(s: Column, measures: Callable[[Together], dict[str, int]]) -> dict[str, Column]:
    """The named measures as columns, all from one look at each portion: what one finds of the letters serves the others."""
    some = Together()
    names = measures(some)
    kinds = [kind for kind, _ in some.measures]
    fields = [f"_{i}" for i in range(len(kinds))]

    def run(strings: pa.Array) -> pa.Array:
        parts = []
        for part in portions(strings):
            t = Texts(part)
            parts.append(pa.StructArray.from_arrays([_array(kind, f(t)) for kind, f in some.measures], fields))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, _KINDS[k]) for n, k in zip(fields, kinds, strict=True)]))

    made = F.arrow_udf(run, f"struct<{', '.join(f'{n}: {k}' for n, k in zip(fields, kinds, strict=True))}>")(s)
    return {name: made.getField(fields[i]) for name, i in names.items()}


def column(kind: str, f: Measure, once: bool = False) -> Callable[[Column], Column]:
    """f as a function of a column: what it gives for each row, with masked values as null.

    once: not computed anew in each column made of it, nor by a filter before rows are dealt out. Spark counts a Python
    function as cheap and does both, unless it is declared not to be deterministic.
    """

    def run(strings: pa.Array) -> pa.Array:
        parts = [_array(kind, f(Texts(part))) for part in portions(strings)]
        return pa.concat_arrays(parts) if parts else pa.array([], _KINDS[kind])

    def of(s: Column) -> Column:
        if isinstance(s, Together):
            return s.add(kind, f)
        made = F.arrow_udf(run, kind)
        return (made.asNondeterministic() if once else made)(s)

    return of


def masked(values: np.ndarray, null: np.ndarray) -> np.ma.MaskedArray:
    return np.ma.MaskedArray(values, null)
