"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of two consecutive lines ends a chunk where it hits a residue, so that lines put in or taken out
move boundaries only near by. A chunk of several lines that also occurs earlier (in a smaller id, or before in its
document) is removed, after its bytes were compared with the first ones.

Of repeated passages, chunks at their ends hold foreign lines too and stay. These, like all that stays, are cut again as
finely as can be: every line ends a chunk, which reaches to the line after it, so that it has several. So each run of two
lines or more that occurs earlier goes as a whole, most of it by its chunks, its ends by such pairs. A pair within a
removed chunk occurs earlier as part of it; these are neither sent nor compared.

Blocks exchange the hashes of chunks and pairs; bytes move only for those that several blocks hold, once for each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, block_count, cogrouped, deltas, grouped, in_blocks, is_in, kept_texts, ordered, pack, split_by, summed, unpack, unsigned
from .hashing import grams, inner, mix, span_hashes
from .suffix_dedup import _REPLY, _REPLY_DDL, _ROUTED, _ROUTED_DDL, _rows, _shared

NEWLINE = 0x0A
#: What a reply to a block is about: hashes that other blocks have too, chunks that go, pairs that go.
SHARED, CHUNKS, PAIRS = 0, 1, 2


class _Units:
    """Stretches of lines of a block: first and last line, bytes, document; hashes of those that have several lines."""

    def __init__(self, b: _Lines, first: np.ndarray, last: np.ndarray) -> None:
        self.data, self.first, self.last = b.data, first, last
        # order of lines matters: a unit's bytes include line ends
        self.begin, self.end = b.starts[first], b.ends[last]
        self.doc = np.searchsorted(b.firsts, first, side="right") - 1
        self.many = np.flatnonzero(last > first)
        self.hashes = np.zeros(0, np.uint64)

    def bytes_of(self, unit: int) -> bytes:
        return self.data[self.begin[unit] : self.end[unit]].tobytes()

    def leaders(self, among: np.ndarray) -> np.ndarray:
        """For each of the units with these places in `many`: the first unit of the block with the same bytes."""
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(self.bytes_of(c), c) for c in self.many[among]], dtype=np.int64)

    def gone(self, late: np.ndarray) -> np.ndarray:
        """Units that repeat an earlier one of the block, or whose first one here `late` names; one that overlaps it stays."""
        leader = np.arange(len(self.first))
        _, group, count = np.unique(self.hashes, return_inverse=True, return_counts=True)
        places = np.flatnonzero(count[group] > 1)
        leader[self.many[places]] = self.leaders(places)
        return (self.last[leader] < self.first) | late[leader]


class _Lines:
    """Lines of a block's documents, in chunks and in pairs."""

    def __init__(self, table: pa.Table, lines: int, most: int) -> None:
        self.given, self.ids, self.data, self.offsets = ordered(table)
        newline = np.flatnonzero(self.data == NEWLINE)
        self.count = np.diff(np.searchsorted(newline, self.offsets)) + 1  # an empty text is one empty line
        self.firsts = np.concatenate(([0], np.cumsum(self.count)))
        self.starts, self.ends = np.empty((2, int(self.firsts[-1])), dtype=np.int64)
        self.head, tail = np.zeros((2, len(self.starts)), dtype=bool)
        self.head[self.firsts[:-1]] = True
        tail[self.firsts[1:] - 1] = True
        self.starts[self.head], self.starts[~self.head] = self.offsets[:-1], newline + 1
        self.ends[tail], self.ends[~tail] = self.offsets[1:], newline
        codes, n = span_hashes(self.data, self.starts, self.ends), len(self.starts)
        two = grams(codes, 2)
        # a line ends a chunk if the hash of it and the one before hits, and that of the line before doesn't
        hit = np.zeros(n, dtype=bool)
        hit[1:] = (two >> np.uint64(16)) % np.uint64(lines) == 0
        hit[self.head] = False
        final = hit & ~np.insert(hit[:-1], 0, False) if n else hit
        begin = self.head | np.insert(final[:-1], 0, True)[:n]
        begin |= (np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))) % most == 0
        first = np.flatnonzero(begin)
        self.chunks = _Units(self, first, np.append(first[1:], n)[: len(first)] - 1)
        self.chunks.hashes = mix(span_hashes(self.data, self.chunks.begin[self.chunks.many], self.chunks.end[self.chunks.many]))
        first = np.flatnonzero(inner(self.firsts, 2))
        self.pairs = _Units(self, first, first + 1)
        self.pairs.hashes = two[first]
        self.chunk_of = np.cumsum(begin) - 1

    def within(self, gone: np.ndarray) -> np.ndarray:
        """Pairs that lie in one of the chunks that go."""
        a, z = self.chunk_of[self.pairs.first], self.chunk_of[self.pairs.last]
        return (a == z) & gone[a]


class Cut:
    """How a block's texts are cut; fine: also in pairs of lines."""

    def __init__(self, lines: int, most: int, fine: bool) -> None:
        self.lines, self.most, self.fine = lines, most, fine

    def __call__(self, table: pa.Table) -> _Lines:
        return _Lines(table, self.lines, self.most)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(20)) % np.uint64(buckets)


def _index(cut: Cut, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = cut(table)
        hashes = np.unique(np.concatenate([b.chunks.hashes, b.pairs.hashes] if cut.fine else [b.chunks.hashes]))
        return _rows(_ROUTED, [(x, key[0].as_py(), 0, pack(hashes[i])) for x, i in split_by(_bucket(hashes, buckets), buckets)])

    return run


def _replies(replies: pa.Table, kind: int) -> list[list[np.ndarray]]:
    return [unpack(p) for k, p in zip(replies.column("kind").to_pylist(), replies.column("payload").to_pylist(), strict=True) if k == kind]


def _late(units: _Units, replies: pa.Table, kind: int) -> np.ndarray:
    late = np.zeros(len(units.first), dtype=bool)
    for p in _replies(replies, kind):
        late[summed(*p).astype(np.int64)] = True
    return late


def _send(cut: Cut, buckets: int, kind: int):
    """The bytes of chunks or pairs that other blocks may hold too, different ones once, by bucket."""

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = cut(table)
        units = b.chunks if kind == CHUNKS else b.pairs
        parts = [p[0].astype(np.uint64) for p in _replies(replies, SHARED)]
        places = np.flatnonzero(is_in(units.hashes, np.sort(np.concatenate(parts)))) if parts else np.zeros(0, np.int64)
        first = np.unique(units.leaders(places))
        if kind == PAIRS and len(first):
            within = b.within(b.chunks.gone(_late(b.chunks, replies, CHUNKS)))
            first = first[~within[first]]
        at = np.searchsorted(units.many, first)
        ids, rows = unsigned(b.ids)[units.doc[first]], []
        for bucket, i in split_by(_bucket(units.hashes[at], buckets), buckets):
            text = np.frombuffer(b"".join(units.bytes_of(c) for c in first[i]), dtype=np.uint8)
            rows.append((bucket, key[0].as_py(), kind, pack(*deltas(ids[i]), *deltas(first[i]), (units.end - units.begin)[first[i]], text)))
        return _rows(_ROUTED, rows)

    return run


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Of units with the same bytes the one in the smallest document stays; to the other blocks, which units go."""
    parts = [unpack(x) for x in table.column("payload").to_pylist()]
    least: dict[bytes, int] = {}
    held = []
    for p in parts:
        ids, ends, text = summed(p[0], p[1]).tolist(), np.cumsum(p[4]).tolist(), p[5].astype(np.uint8).tobytes()
        chunks = [text[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        for i, c in zip(ids, chunks, strict=True):
            if i < least.get(c, i + 1):
                least[c] = i
        held.append((ids, chunks))
    rows = []
    for block, p, (ids, chunks) in zip(table.column("block").to_pylist(), parts, held, strict=True):
        late = [least[c] < i for i, c in zip(ids, chunks, strict=True)]
        if any(late):
            rows.append((block, pack(*deltas(summed(p[2], p[3])[np.array(late)]))))
    return _rows(_REPLY, rows)


def _remove(cut: Cut):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = cut(table)
        gone = b.chunks.gone(_late(b.chunks, replies, CHUNKS))
        cover = np.zeros(len(b.starts) + 1, dtype=np.int64)
        spans = [(b.chunks, gone)]
        if cut.fine:
            spans.append((b.pairs, b.pairs.gone(_late(b.pairs, replies, PAIRS) | b.within(gone))))
        for units, some in spans:
            np.add.at(cover, units.first[some], 1)
            np.subtract.at(cover, units.last[some] + 1, 1)
        keep = np.cumsum(cover[:-1]) == 0
        texts = list(kept_texts(b.data, b.starts, b.ends, b.firsts, keep, NEWLINE))
        order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])
        table = table.take(order)
        nulls = np.asarray(table.column("text").combine_chunks().is_null())
        n = len(b.ids)
        of_line = np.repeat(np.arange(n), b.count)
        ran = ~keep & (b.head | np.insert(keep[:-1], 0, True)[: len(keep)])
        count = lambda lines: np.bincount(of_line, weights=lines, minlength=n).astype(np.int64)
        chunks = np.bincount(b.chunks.doc, weights=gone, minlength=n).astype(np.int64)
        return pa.table(
            {
                "row": table.column("row"),
                "text": pa.array([t.decode() for t in texts], pa.string(), mask=nulls),
                "n_lines": pa.array(np.where(nulls, 0, b.count), pa.int64()),
                "n_removed_lines": pa.array(count(~keep), pa.int64()),
                "n_removed_chunks": pa.array(chunks, pa.int64()),
                "n_removed_runs": pa.array(count(ran), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
        )

    return run


def deduplicate(docs: DataFrame, lines: int = 4, most: int = 64, fine: bool = True, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove multi-line chunks (`lines` lines on average, `most` at most) whose bytes occur earlier in the corpus.

    fine: what stays is cut again into pairs of lines, so that every run of two lines or more that occurs earlier goes.

    (row, text, n_lines, n_removed_lines, n_removed_chunks, n_removed_runs, kept_sha256): `row` is a struct of all columns but
    the text, as they were, whatever their names; runs are stretches of removed lines. A null text stays null and has no
    lines; an empty one has one. The first occurrence of each line stays, single lines are never removed, and a chunk or
    pair that overlaps its only earlier occurrence stays. A null id comes after all others; rows of one id are ordered by
    text. A repeated row of several lines is left empty. A text longer than a block is a block of its own. No rows give
    no rows.
    """
    cut, n = Cut(lines, most, fine), block_count(docs, text, block_bytes)
    whole = in_blocks(docs, n, doc_id, text, whole=True)
    blocks = whole.groupBy("block")

    def told(df: DataFrame, kind: int) -> DataFrame:
        return df.select("block", F.lit(kind).alias("kind"), "payload")

    units = blocks.applyInArrow(grouped(_index(cut, n)), _ROUTED_DDL)
    shared = told(units.groupBy("bucket").applyInArrow(grouped(_shared), _REPLY_DDL), SHARED)
    sent = blocks.cogroup(shared.groupBy("block")).applyInArrow(cogrouped(_send(cut, n, CHUNKS)), _ROUTED_DDL)
    late = told(sent.groupBy("bucket").applyInArrow(grouped(_compare), _REPLY_DDL), CHUNKS)
    if fine:
        known = shared.unionByName(late)
        sent = blocks.cogroup(known.groupBy("block")).applyInArrow(cogrouped(_send(cut, n, PAIRS)), _ROUTED_DDL)
        late = late.unionByName(told(sent.groupBy("bucket").applyInArrow(grouped(_compare), _REPLY_DDL), PAIRS))
    numbers = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_runs")]
    result = T.StructType([whole.schema["row"], T.StructField("text", T.StringType()), *numbers, T.StructField("kept_sha256", T.StringType())])
    return blocks.cogroup(late.groupBy("block")).applyInArrow(cogrouped(_remove(cut)), result)
