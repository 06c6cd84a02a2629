"""Substring deduplication on bytes with suffix arrays by the difference-cover algorithm.

A suffix array over the bytes of a whole corpus needs several sorts of records many times its size. Here the suffixes
are dealt out first, so that suffixes with a common prefix of `length` bytes meet: the anchor of a suffix is, of all
32-byte grams in its first `length` bytes, the one with the least hash, and equal prefixes have equal anchors. A suffix
whose anchor occurs once in the corpus repeats nothing. For the others each task sorts the suffixes of its anchors:
triples at places 1 and 2 modulo 3 are named by rank, the names are sorted by recursion, the remaining suffixes are
merged in, and adjacent prefixes of `length` bytes are compared.

What holds in one block (equal surroundings of an anchor) is settled there and sent once, so that a passage that a third
of all documents hold costs a task one record for each block. Hashes bring together; bytes are compared before any goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, cogrouped, deltas, grouped, in_blocks, is_in, ordered, pack, split_by, summed, unpack, unsigned
from .hashing import BYTE_CODES, grams, inner, mix, owners, runs, span_hashes

#: Smaller blocks than for words: a block's arrays have several numbers for each byte.
BLOCK_BYTES = 4 << 20
_ROUTED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("payload", pa.binary())])
_ROUTED_DDL = "bucket int, block int, kind int, payload binary"
_REPLY_DDL = "block int, payload binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _names(*parts: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 0 of tuples of numbers below 2**32, and how many there are."""
    name = parts[0].astype(np.uint64)
    for p in parts[1:]:
        if name.size and int(name.max()) >= 1 << 32:
            name = np.unique(name, return_inverse=True)[1].astype(np.uint64)
        name = (name << np.uint64(32)) | p.astype(np.uint64)
    values, inverse = np.unique(name, return_inverse=True)
    return inverse.astype(np.int64), len(values)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of `codes` (numbers from 1 on) in order, by the difference cover {1, 2} modulo 3."""
    n = len(codes)
    if n < 2:
        return np.arange(n)
    s = np.concatenate([codes.astype(np.int64), np.zeros(3, np.int64)])
    one = np.arange((n + 2) // 3) * 3 + 1  # with a place at the end if n % 3 is 1, which parts the two halves
    sample = np.concatenate([one, np.arange(n // 3) * 3 + 2])
    names, count = _names(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(names) if count == len(sample) else suffix_array(names + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    key = (s[rest] << 32) | rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((s[ones] << 32) | rank[ones + 1], key)
    pairs, _ = _names(np.concatenate([s[twos], s[rest]]), np.concatenate([s[twos + 1], s[rest + 1]]))
    before += np.searchsorted((pairs[: len(twos)] << 32) | rank[twos + 2], (pairs[len(twos) :] << 32) | rank[rest + 2])
    out, free = np.empty(n, dtype=np.int64), np.ones(n, dtype=bool)
    at = before + np.arange(len(rest))
    out[at] = rest
    free[at] = False
    out[free] = sampled
    return out


def equal_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes at each place of `left` and of `right` are the same."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    step = 1 << 14
    parts = [(view[left[a : a + step]] == view[right[a : a + step]]).all(axis=1) for a in range(0, len(left), step)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def same_spans(data: np.ndarray, left: np.ndarray, right: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Whether the spans of these widths at `left` and `right` have the same bytes."""
    out, ends, a = np.ones(len(left), dtype=bool), np.cumsum(widths), 0
    while a < len(left):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), side="right")))
        w = widths[a:z]
        within = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        differs = data[np.repeat(left[a:z], w) + within] != data[np.repeat(right[a:z], w) + within]
        out[a:z] = np.add.reduceat(differs, np.cumsum(w) - w) == 0
        a = z
    return out


def told_apart(around: np.ndarray, data: np.ndarray, begin: np.ndarray, widths: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hashes of surroundings, changed for those that differ from the first ones with the same hash."""
    around = around.copy()
    while True:
        _, first, group = np.unique(around, return_index=True, return_inverse=True)
        leader = first[group]
        of = np.flatnonzero(leader != np.arange(len(around)))
        ok = (widths[of] == widths[leader[of]]) & (anchor[of] == anchor[leader[of]])
        ok[ok] = same_spans(data, begin[of[ok]], begin[leader[of[ok]]], widths[of[ok]])
        if ok.all():
            return around
        around[of[~ok]] = mix(around[of[~ok]] + np.uint64(1))


class _Block:
    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        self.given, self.ids, self.data, self.offsets = ordered(table)
        hashes = grams(BYTE_CODES[self.data], gram)
        self.anchor, self.first, self.last = runs(*owners(hashes, inner(self.offsets, length)[: len(hashes)], length - gram + 1))
        self.hashes = hashes[self.anchor]


def _index(length: int, gram: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes = np.unique(_Block(table, length, gram).hashes)
        cut = split_by((hashes >> np.uint64(20)) % np.uint64(buckets), buckets)
        return _rows(_ROUTED, [(b, key[0].as_py(), 0, pack(hashes[i])) for b, i in cut])

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """To each block, those of its anchors that other blocks hold too."""
    blocks, parts = table.column("block").to_pylist(), [unpack(x)[0].astype(np.uint64) for x in table.column("payload").to_pylist()]
    hashes, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    order = order[np.append(same, False) | np.insert(same, 0, False)]
    return _rows(_REPLY, [(blocks[k], pack(hashes[order[i]])) for k, i in split_by(of[order], len(parts))])


def _surroundings(length: int, gram: int, buckets: int):
    """The bytes around each repeated anchor, different ones once, by bucket; equal ones in the block are decided."""

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(table, length, gram)
        shared = [unpack(x)[0].astype(np.uint64) for x in replies.column("payload").to_pylist()]
        _, group, count = np.unique(b.hashes, return_inverse=True, return_counts=True)
        elsewhere = is_in(b.hashes, np.sort(np.concatenate(shared))) if shared else np.zeros(len(b.hashes), dtype=bool)
        at = np.flatnonzero((count[group] > 1) | elsewhere)
        begin, end = b.first[at], b.last[at] + length
        around = mix(span_hashes(b.data, begin, end, quick=True) ^ (b.anchor[at] - begin).astype(np.uint64))
        around = told_apart(around, b.data, begin, end - begin, b.anchor[at] - begin)
        first = np.unique(around, return_index=True)[1]
        again = np.ones(len(at), dtype=bool)
        again[first] = False
        here = key[0].as_py()
        rows = [(here % buckets, here, 1, pack(*deltas(begin[again]), end[again] - begin[again]))] if again.any() else []
        # one kind of surroundings, in this block alone: all but the first are decided
        first.sort()
        _, kinds, many = np.unique(group[at[first]], return_inverse=True, return_counts=True)
        send = first[elsewhere[at[first]] | (many[kinds] > 1)] if len(first) else first
        doc = np.searchsorted(b.offsets, begin[send], side="right") - 1
        ids = unsigned(b.ids)[doc]
        for bucket, i in split_by((b.hashes[at[send]] >> np.uint64(20)) % np.uint64(buckets), buckets):
            j = send[i]
            widths = end[j] - begin[j]
            within = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
            text = b.data[np.repeat(begin[j], widths) + within]
            rows.append((bucket, here, 0, pack(b.hashes[at[j]], *deltas(ids[i]), *deltas(begin[j]), widths, around[j], b.anchor[at[j]] - begin[j], text)))
        return _rows(_ROUTED, rows)

    return run


def _sort(length: int):
    """Find the windows that start earlier elsewhere; to each block the byte ranges to remove."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, sent = [], []
        for block, kind, payload in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "payload")), strict=True):
            if kind == 1:
                rows.append((block, payload))
            else:
                sent.append((block, unpack(payload)))
        if not sent:
            return _rows(_REPLY, rows)
        anchor = np.concatenate([p[0].astype(np.uint64) for _, p in sent])
        ids = np.concatenate([summed(p[1], p[2]) for _, p in sent])
        at = np.concatenate([summed(p[3], p[4]).astype(np.int64) for _, p in sent])
        widths = np.concatenate([p[5] for _, p in sent])
        around = np.concatenate([p[6].astype(np.uint64) for _, p in sent])
        offset = np.concatenate([p[7] for _, p in sent])
        text = np.concatenate([p[8] for _, p in sent]).astype(np.uint8)
        of = np.repeat(np.arange(len(sent)), [len(p[0]) for _, p in sent])
        begin = np.cumsum(widths) - widths
        around = told_apart(around, text, begin, widths, offset)
        # equal surroundings: all but the first of them go
        order = np.lexsort((at, ids, around))
        fresh = np.insert(around[order][1:] != around[order][:-1], 0, True)
        gone = order[~fresh]
        cut_of, cut_at, cut_width = [of[gone]], [at[gone]], [widths[gone]]
        lead = order[fresh]
        _, group, count = np.unique(anchor[lead], return_inverse=True, return_counts=True)
        lead = lead[count[group] > 1]
        if len(lead):
            w = widths[lead]
            end = np.cumsum(w + 1)
            start = end - w - 1
            codes = np.ones(int(end[-1]), dtype=np.int64)
            inside = np.arange(len(codes)) - np.repeat(start, w + 1)
            real = inside < np.repeat(w, w + 1)
            codes[real] = text[(np.repeat(begin[lead], w + 1) + inside)[real]].astype(np.int64) + 2
            piece = np.repeat(np.arange(len(lead)), w + 1)
            order = suffix_array(codes)
            order = order[inside[order] + length <= w[piece[order]]]
            plain = np.maximum(codes - 2, 0).astype(np.uint8)
            same = equal_prefixes(plain, order[:-1], order[1:], length)
            cls = np.cumsum(np.insert(~same, 0, True))
            where = lead[piece[order]]
            place = at[where] + inside[order]
            by = np.lexsort((place, ids[where], cls))
            late = by[np.insert(cls[by][1:] == cls[by][:-1], 0, False)]
            # later windows, next to each other in one piece, as one range
            late = late[np.lexsort((place[late], piece[order[late]]))]
            p, q = piece[order[late]], place[late]
            head = np.flatnonzero(np.insert((np.diff(p) != 0) | (np.diff(q) != 1), 0, True)) if len(late) else late
            tail = np.append(head[1:], len(late)) - 1 if len(late) else late
            cut_of.append(of[where[late[head]]])
            cut_at.append(q[head])
            cut_width.append(q[tail] - q[head] + length)
        cut_of, cut_at, cut_width = (np.concatenate(x) for x in (cut_of, cut_at, cut_width))
        for k, i in split_by(cut_of, len(sent)):
            i = i[np.argsort(cut_at[i])]
            rows.append((sent[k][0], pack(*deltas(cut_at[i]), cut_width[i])))
        return _rows(_REPLY, rows)

    return run


def _remove(with_text: bool):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        given, _, data, offsets = ordered(table)
        mark = np.zeros(len(data) + 1, dtype=np.int32)
        for base, steps, widths in map(unpack, replies.column("payload").to_pylist()):
            begin = summed(base, steps).astype(np.int64)
            np.add.at(mark, begin, 1)
            np.subtract.at(mark, begin + widths, 1)
        gone = np.cumsum(mark)[:-1] > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        starts[firsts] = gone[firsts]
        removed, begun = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (gone, starts))
        kept = data[~gone].tobytes()
        bounds = offsets - removed
        texts = [kept[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [given, *(pa.array(np.diff(x), pa.int64()) for x in (offsets, removed, begun)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(texts, pa.binary()))
            names.append("kept")
        return pa.table(columns, names=names)

    return run


def deduplicate(docs: DataFrame, length: int = 100, gram: int = 32, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts earlier, in a smaller id or before in the document.

    One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes. A null
    text is empty. Matches don't cross documents. A null id comes after all others; rows of one id are ordered by text, so
    of equal rows the first one keeps its bytes. A text longer than a block is a block of its own. Other columns are not
    read. No rows give no rows.
    """
    if not 1 <= gram < length:
        raise ValueError("gram must be shorter than length")
    n = block_count(docs, text, block_bytes)
    blocks = in_blocks(docs, n, doc_id, text).groupBy("block")
    anchors = blocks.applyInArrow(grouped(_index(length, gram, n)), _ROUTED_DDL)
    shared = anchors.groupBy("bucket").applyInArrow(grouped(_shared), _REPLY_DDL)
    around = blocks.cogroup(shared.groupBy("block")).applyInArrow(cogrouped(_surroundings(length, gram, n)), _ROUTED_DDL)
    ranges = around.groupBy("bucket").applyInArrow(grouped(_sort(length)), _REPLY_DDL)
    result = RESULT + (", kept binary" if with_text else "")
    return blocks.cogroup(ranges.groupBy("block")).applyInArrow(cogrouped(_remove(with_text)), result).where(F.col("n_bytes").isNotNull())
