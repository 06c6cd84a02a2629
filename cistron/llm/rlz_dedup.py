"""Substring deduplication by relative Lempel-Ziv parsing against reference blocks.

Every block of documents is a reference block. Its index holds the anchors of its texts: of each run of consecutive
7-word grams inside a 13-word window the one with the least hash, so that equal windows have equal anchors. The parse

1. indexes the anchors of all blocks and finds, for each anchor that more than one document holds, its first document;
2. factors each document greedily from left to right: a factor goes on as long as the next anchor lies at the same
   distance in the same reference. Anchors of a factor touch or overlap, so all of its words are equal to the
   reference's; a factor of `window` words or more is a duplicate span;
3. checks what lies at factor boundaries: windows around repeated anchors that no factor holds whole are looked up
   among the same windows of all other blocks.

A block first settles what it can by itself and names an anchor or a window once, so that a text which a third of
all documents hold costs one record for each block, not one for each document. Equal means equal in two independent hashes,
96 bits in all, of words each of which has two hashes of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, alike, block_count, cogrouped, deltas, find, grouped, in_blocks, kept_texts, ordered, pack, split_by, summed, unpack, unsigned
from .hashing import grams, inner, owners, span_hashes, spans

_ROUTED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_ROUTED_DDL = "bucket int, block int, kind int, payload binary"
_REPLY_DDL = "block int, kind int, payload binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Block:
    """A block's words, windows and anchors. Rows are by (id, text): each phase sees the same places."""

    def __init__(self, table: pa.Table, window: int, gram: int) -> None:
        self.given, self.ids, self.data, self.offsets = ordered(table)
        self.starts, self.ends, self.firsts = spans(self.data, self.offsets)
        self.window, self.gram = window, gram
        self.codes = span_hashes(self.data, self.starts, self.ends)
        self.seconds = span_hashes(self.data, self.starts, self.ends, second=True)
        self.grams = grams(self.codes, gram)
        #: places at which a window starts, and the place of its anchor
        self.places, self.owner = owners(self.grams, inner(self.firsts, window), window - gram + 1)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.firsts))
        self.anchors = np.unique(self.owner)

    def checks(self, n: int, at: np.ndarray) -> np.ndarray:
        """32 bits of the second hash of the n words from each of these places on."""
        return (grams(self.seconds, n)[at] >> np.uint64(32)) if len(at) else np.zeros(0, np.uint64)

    def anchor_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.grams[self.anchors], self.checks(self.gram, self.anchors)

    def window_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return (grams(self.codes, self.window)[self.places] if len(self.places) else np.zeros(0, np.uint64)), self.checks(self.window, self.places)


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate([p[j].astype(np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64) for j in range(len(parts[0]) if parts else 2)]


def _index(window: int, gram: int, buckets: int):
    """Each anchor of a block once, with its first document and place there, by bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = _Block(table, window, gram)
        hashes, checks = b.anchor_hashes()
        first = np.sort(alike(hashes, checks)[0])
        hashes, checks, at = hashes[first], checks[first], b.anchors[first]
        doc = b.doc[at] if len(at) else at
        rows = []
        for bucket, i in split_by((hashes >> np.uint64(20)) % np.uint64(buckets), buckets):
            rows.append((bucket, key[0].as_py(), 0, pack(hashes[i], checks[i], *deltas(unsigned(b.ids[doc[i]])), at[i] - b.firsts[doc[i]])))
        return _rows(_ROUTED, rows)

    return run


def _first_holders(key: tuple, table: pa.Table) -> pa.Table:
    """For each anchor that several blocks hold: the first document and the place there, to each of those blocks."""
    blocks, parts = table.column("block").to_pylist(), [unpack(x) for x in table.column("payload").to_pylist()]
    hashes, checks = _joined([p[:2] for p in parts])
    ids = np.concatenate([summed(p[2], p[3]) for p in parts])
    at = np.concatenate([p[4] for p in parts])
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    _, group, count = alike(hashes, checks)
    order = np.flatnonzero(count[group] > 1)
    order = order[np.lexsort((at[order], ids[order], group[order]))]
    fresh = np.insert(group[order][1:] != group[order][:-1], 0, True)[: len(order)]
    leader = order[fresh][np.cumsum(fresh) - 1] if len(order) else order
    rows = [(blocks[k], 0, pack(hashes[order[i]], checks[order[i]], ids[leader[i]], at[leader[i]])) for k, i in split_by(of[order], len(parts))]
    return _rows(_REPLY, rows)


def _parse(window: int, gram: int, buckets: int):
    """Greedy factors of each document, then its boundary windows, by bucket."""

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(table, window, gram)
        if not len(b.places):
            return _rows(_ROUTED, [])
        hashes, checks = b.anchor_hashes()
        doc = b.doc[b.anchors]
        ids = unsigned(b.ids)[doc]
        place = b.anchors - b.firsts[doc]
        # the first holder inside the block, then, where other blocks hold the anchor, the first of all
        first, group, count = alike(hashes, checks)
        ref_id, ref_at = ids[first][group], place[first][group]
        known = count[group] > 1
        elsewhere = np.zeros(len(hashes), dtype=bool)
        parts = [unpack(x) for x in replies.column("payload").to_pylist()]
        if parts:
            h, c, i, a = _joined(parts)
            order = np.argsort(h)
            h, c, i, a = h[order], c[order], i[order], a[order].astype(np.int64)
            j = find(hashes, checks, h, c)
            elsewhere = j >= 0
            ref_id[elsewhere], ref_at[elsewhere] = i[j[elsewhere]], a[j[elsewhere]]
        matched = (known | elsewhere) & (ref_id < ids)
        # a factor goes on to the next anchor of the document if that has the same reference at the same distance
        on = np.zeros(len(hashes), dtype=bool)
        on[1:] = matched[1:] & matched[:-1] & (doc[1:] == doc[:-1]) & (ref_id[1:] == ref_id[:-1]) & (place[1:] - ref_at[1:] == place[:-1] - ref_at[:-1]) & (place[1:] - place[:-1] <= gram)
        heads = np.flatnonzero(matched & ~on)
        tails = np.flatnonzero(matched & ~np.append(on[1:], False))
        begin, end = b.anchors[heads], b.anchors[tails] + gram
        long = end - begin >= window
        inside = np.zeros(len(b.grams) + gram + 1, dtype=np.int32)
        np.add.at(inside, begin[long], 1)
        np.add.at(inside, end[long] - window + 1, -1)
        factored = np.cumsum(inside)[b.places] > 0
        # boundary windows: around a repeated anchor, in no factor
        repeated = np.zeros(len(b.grams), dtype=np.int8)
        repeated[b.anchors[known]] = 1
        repeated[b.anchors[elsewhere]] = 2
        state = repeated[b.owner]
        open_ = (state > 0) & ~factored
        w, window_checks = (x[open_] for x in b.window_hashes())
        window_doc, shared = b.doc[b.places[open_]], state[open_] == 2
        first, group, _ = alike(w, window_checks)
        ahead = b.ids[window_doc[first]][group] < b.ids[window_doc]
        removed = factored.copy()
        removed[np.flatnonzero(open_)[ahead]] = True
        rows = [(key[0].as_py() % buckets, key[0].as_py(), 1, pack(*deltas(np.flatnonzero(removed))))]
        send = np.sort(first[shared[first]])
        for bucket, i in split_by((w[send] >> np.uint64(20)) % np.uint64(buckets), buckets):
            rows.append((bucket, key[0].as_py(), 0, pack(w[send[i]], window_checks[send[i]], *deltas(unsigned(b.ids[window_doc[send[i]]])))))
        return _rows(_ROUTED, rows)

    return run


def _boundaries(key: tuple, table: pa.Table) -> pa.Table:
    """To each block, the windows that a smaller document of another block holds; decisions pass through."""
    rows, sent = [], []
    for block, kind, payload in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "payload")), strict=True):
        if kind == 1:
            rows.append((block, 1, payload))
        else:
            sent.append((block, unpack(payload)))
    if sent:
        hashes, checks = _joined([p[:2] for _, p in sent])
        ids = np.concatenate([summed(p[2], p[3]) for _, p in sent])
        of = np.repeat(np.arange(len(sent)), [len(p[0]) for _, p in sent])
        _, group, count = alike(hashes, checks)
        order = np.argsort(group, kind="stable")
        least = np.minimum.reduceat(ids[order], np.cumsum(count) - count)[group]
        late = np.flatnonzero(ids > least)
        rows += [(sent[k][0], 0, pack(hashes[late[i]], checks[late[i]])) for k, i in split_by(of[late], len(sent))]
    return _rows(_REPLY, rows)


def _remove(window: int, gram: int, with_text: bool):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(table, window, gram)
        gone = np.zeros(len(b.starts) + 1, dtype=np.int32)
        kinds, payloads = replies.column("kind").to_pylist(), [unpack(x) for x in replies.column("payload").to_pylist()]
        at = [summed(*p).astype(np.int64) for k, p in zip(kinds, payloads, strict=True) if k == 1]
        hit = [p for k, p in zip(kinds, payloads, strict=True) if k == 0]
        windows = np.concatenate([*at, np.zeros(0, np.int64)])
        if hit:
            h, c = _joined(hit)
            order = np.argsort(h)
            windows = np.concatenate([windows, np.flatnonzero(find(*b.window_hashes(), h[order], c[order]) >= 0)])
        begin = b.places[np.unique(windows)]
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + window, -1)
        keep = np.cumsum(gone[:-1]) == 0
        n_words = np.diff(b.firsts)
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        n_kept = kept_before[b.firsts[1:]] - kept_before[b.firsts[:-1]]
        texts = list(kept_texts(b.data, b.starts, b.ends, b.firsts, keep))
        columns = [b.given, pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array([t.decode() for t in texts], pa.string()))
            names.append("kept_text")
        return pa.table(columns, names=names)

    return run


def deduplicate(docs: DataFrame, window: int = 13, gram: int = 7, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document with a smaller id.

    One row for each document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text. A null or empty
    text has no words (the hash is that of no bytes). A null id comes after all others. Rows of one id are one
    document's parts: none removes words of another. Repeated rows count each by itself. A text longer than a block is a
    block of its own. Other columns are not read. No rows give no rows.
    Needs 2 * gram > window, so that anchors of a factor leave no word between them.
    """
    if not window // 2 < gram <= window:
        raise ValueError("gram must be over half of window, and not over it")
    n = block_count(docs, text, block_bytes)
    blocks = in_blocks(docs, n, doc_id, text).groupBy("block")
    anchors = blocks.applyInArrow(grouped(_index(window, gram, n)), _ROUTED_DDL)
    holders = anchors.groupBy("bucket").applyInArrow(grouped(_first_holders), _REPLY_DDL)
    parsed = blocks.cogroup(holders.groupBy("block")).applyInArrow(cogrouped(_parse(window, gram, n)), _ROUTED_DDL)
    decided = parsed.groupBy("bucket").applyInArrow(grouped(_boundaries), _REPLY_DDL)
    result = RESULT + (", kept_text string" if with_text else "")
    return blocks.cogroup(decided.groupBy("block")).applyInArrow(cogrouped(_remove(window, gram, with_text)), result).where(F.col("n_words").isNotNull())
