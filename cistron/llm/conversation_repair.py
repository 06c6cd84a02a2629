"""Repair of the structure of conversations by the cheapest edits, as a dynamic programme over tensors.

A conversation should read (system)? (user assistant)+, or be empty. Each row is kept, given another role or deleted, and
rows without text are put in; costs are named below. Of the cheapest edits those stay whose initials, in order, come
first in ASCII.

The programme's state is what stands last in the repaired conversation: nothing, system, user or assistant. Conversations are
bucketed by length and laid side by side, time first: a step of numpy updates the costs of all states of all conversations
of a bucket for one row, from the last row to the first, and keeps them; a second walk, forwards, reads the edits off.

A conversation of any length is cut into pieces of `PIECE` rows. Of a piece that isn't a whole conversation the costs from each
state at its start to each at its end are a 4 x 4 table; a walk over a conversation's tables, from the last, tells each
piece what its end costs, and its edits are found for each of the four states in which it may begin. So long
conversations are dealt out over tasks like short ones; texts aren't needed for any of this, only one byte for a row.

Texts move once, to their conversation. What comes out of a conversation (its edits in order, one hash over all) is sequential, so
one task reads it from end to end, in batches, and never holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, pack, quoted, release, unpack

WHITE = " \t\n\x0b\f\r"
ENDS = ".!?"
#: Costs of the edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Rows in one piece of a conversation.
PIECE = 256
#: Characters of a text by which rows of equal turn and role are ordered before their digests.
HEAD = 64
#: Edits in one batch of results.
ROWS = 4096

# states, and codes of roles: 0 nothing (another role), 1 system, 2 user, 3 assistant
STEP = np.array([2, 2, 3, 2])  # the role that may follow, besides a first system
ROLES = {2: "user", 3: "assistant"}
#: Cost of ending in a state: what is missing is put in.
END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
NEVER = 1 << 40
CODE, BLANK, CUT, LATER = 3, 4, 8, 16
#: Roles put in before a row, by code.
ADDED = ((), (2,), (3,), (2, 3), (3, 2))

_KEY = ("turn", "role", "head", "digest")
_STATS = ("blank", "duplicate", "truncated", "illegal")


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows with faults chosen by crc32(`conv_id:turn`) % 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 gives it twice, 4 makes
    it a user's. A null in the key, role or text is one space; ids and turns stay null. No rows give no rows.
    """
    one = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one(conv_id), F.lit(":"), one(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(quoted(conv_id)).alias("conv_id"), F.col(quoted(turn)).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), fault.alias("fault"))
    body = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    rows = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), times.alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def summarize(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of `rows`, and of `ids` if given: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    `audit` has the edits' initials in order, the hash is over the repaired rows `role:text` joined by newlines. gaps: turns
    missing between the least and the greatest, nulls aside. A conversation without rows has zeros and an empty audit.
    Else as repair().
    """
    rows = _named(rows)
    kind = rows.schema["conv_id"].dataType
    numbers = [T.StructField(c, T.LongType()) for c in ("gaps", *_STATS, "cost")]
    result = T.StructType([T.StructField("conv_id", kind), *numbers, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _walked(rows, ids).mapInArrow(_digests, result)


def repair(rows: DataFrame) -> DataFrame:
    """All edits in order: (conv_id, step long, edit string, role string, text string); deleted rows have what they had.

    `rows` has conv_id, turn, role and text. A conversation's rows are taken by turn, nulls first; of equal turn by role, then by
    the text's first `HEAD` characters, then by its SHA-256. Repeated rows count, the later ones as duplicates. A null role
    or text is one space; a null conv_id is a conversation of its own. Roles other than system, user and assistant are told by
    their first letter; a row of none of these can't be kept. Blank rows and duplicates are deleted. Other columns are
    left out; no rows give no rows.
    """
    rows = _named(rows)
    result = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("step", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    return _walked(rows, None).mapInArrow(_rewritten, result)


def _named(rows: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    return rows.select("*", F.substring("text", 1, HEAD).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _kind() -> Column:
    """A row's role code and its faults but repetition."""
    initial, rest = F.substring("role", 1, 1), F.rtrim("text", F.lit(WHITE))
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    blank = rest == ""
    return code + F.when(blank, BLANK).when(~F.substring(rest, -1, 1).isin(*ENDS), CUT).otherwise(0)


def _walked(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Pieces with their edits, each before its rows, conversations one after another."""
    # one row for equal ones: however often a row is repeated, all but its first copy are deleted
    slim = rows.groupBy("conv_id", *_KEY, _kind().alias("kind")).agg(F.count(F.lit(1)).alias("copies"))
    firsts = slim.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("without"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.when(F.col("without"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    slim = slim.join(firsts, same).select("conv_id", *_KEY, (F.col("kind") + F.when(later & (F.col("kind").bitwiseAND(BLANK) == 0), LATER).otherwise(0)).cast("int").alias("kind"), "copies")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *_KEY)]
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    key = [T.StructField("conv_id", rows.schema["conv_id"].dataType), *(rows.schema[c] for c in _KEY)]
    cut = T.StructType([*key, *(T.StructField(c, T.BinaryType()) for c in ("kinds", "table", "told"))])
    pieces = checkpoint(slim.mapInArrow(_pieces, cut).withColumn("at", F.monotonically_increasing_id()))
    part = pieces.where("table is not null")
    ends = part.select("conv_id", "at", "table").repartition("conv_id").sortWithinPartitions("conv_id", F.col("at").desc()).mapInArrow(_ends, "piece long, end binary")
    part = part.join(ends, F.col("at") == F.col("piece")).select("conv_id", *_KEY, "kinds", "end", "told").mapInArrow(_traced, T.StructType([*key, T.StructField("told", T.BinaryType())]))
    told = pieces.where("table is null").select("conv_id", *_KEY, "told").unionByName(part)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in _KEY]
    out = told.select("conv_id", *_KEY, F.lit(1).alias("tag"), "told", F.lit(None).cast("string").alias("text"))
    out = out.unionByName(rows.select("conv_id", *_KEY, F.lit(2).alias("tag"), F.lit(None).cast("binary").alias("told"), "text"))
    if ids is not None:
        ids = ids.select(F.col("conv_id").cast(rows.schema["conv_id"].dataType)).distinct()
        out = out.unionByName(ids.select("conv_id", *none, F.lit(0).alias("tag"), F.lit(None).cast("binary").alias("told"), F.lit(None).cast("string").alias("text")))
    out = out.repartition("conv_id").sortWithinPartitions(*order, "tag")
    return out.select("conv_id", "tag", "told", "role", "text")


class Bucket:
    """Pieces of like length side by side: costs of all states before each row, and edits read off them."""

    def __init__(self, kinds: list[np.ndarray]) -> None:
        self.sizes = np.array([len(k) for k in kinds])
        self.steps, self.lanes = int(self.sizes.max()), len(kinds)
        self.kinds = np.zeros((self.steps, self.lanes), dtype=np.uint8)
        for i, k in enumerate(kinds):
            self.kinds[: len(k), i] = k
        self.live = np.arange(self.steps)[:, None] < self.sizes

    def options(self, t: int, after: np.ndarray) -> tuple[np.ndarray, ...]:
        """Costs by (lane, state, end) of deleting row t, of keeping it and of giving it the role that may follow."""
        kind = self.kinds[t][:, None, None]
        code = kind & CODE
        stays = np.where(kind & (BLANK | LATER), NEVER, np.where(kind & CUT, TRUNCATED, 0))
        move = after[:, STEP]
        keep = np.where(code == STEP[None, :, None], move, NEVER)
        keep[:, 0] = np.where(code[:, 0] == 1, after[:, 1], keep[:, 0])
        return after + DELETE, keep + stays, move + stays + REROLE

    def costs(self, end: np.ndarray) -> np.ndarray:
        """(row, lane, state, end): cheapest way from before each row to the ends, whose costs are `end` (lane, state, end)."""
        out = np.empty((self.steps + 1, *end.shape), dtype=np.int64)
        out[-1] = end
        for t in range(self.steps - 1, -1, -1):
            best = np.minimum.reduce(self.options(t, out[t + 1]))
            for _ in range(2):  # at most two rows are put in before one
                best = np.minimum(best, INSERT + best[:, STEP])
            out[t] = np.where(self.live[t][:, None, None], np.minimum(best, NEVER), out[t + 1])
        return out

    def edits(self, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, lane, begin) and (lane, begin): edits from each state at the start, and the states in which they end.

        An edit is a place of `ADDED` times 4, and 0 deleted, 1 kept, 2 made a user's, 3 made an assistant's.
        """
        lane = np.arange(self.lanes)[:, None]
        out = np.zeros((self.steps, *state.shape), dtype=np.uint8)
        for t in range(self.steps):
            here = costs[t, :, :, 0]
            delete, keep, _ = (x[:, :, 0] for x in self.options(t, costs[t + 1]))
            live, added = self.live[t][:, None], np.zeros(state.shape, dtype=np.uint8)
            for _ in range(2):
                most = here[lane, state]
                put = live & (delete[lane, state] != most) & (INSERT + here[lane, STEP[state]] == most)
                added = np.where(put, np.where(added, added + 2, STEP[state] - 1), added).astype(np.uint8)
                state = np.where(put, STEP[state], state)
            most = here[lane, state]
            gone, kept = delete[lane, state] == most, keep[lane, state] == most
            out[t] = 4 * added + np.where(gone, 0, np.where(kept, 1, STEP[state]))
            state = np.where(~live | gone, state, np.where(kept, (self.kinds[t] & CODE)[:, None], STEP[state]))
        return out, state


def buckets(kinds: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Bucket]]:
    """Pieces by the power of 2 above their length."""
    size = np.array([int(len(k) - 1).bit_length() for k in kinds])
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield at, Bucket([kinds[i] for i in at])


def _solved(kinds: list[np.ndarray], end: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each piece's (begin, row) edits, the states in which they end and their costs, with costs `end` (piece, state) of what follows."""
    out: list = [None] * len(kinds)
    for at, b in buckets(kinds):
        costs = b.costs(end[at][:, :, None])
        edits, last = b.edits(costs, np.tile(begin, (len(at), 1)))
        spent = costs[0, :, begin, 0].T - np.take_along_axis(end[at], last, 1)
        for j, i in enumerate(at):
            out[i] = edits[: b.sizes[j], j].T, last[j], spent[j]
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as pieces: those that are whole conversations with their edits, of others the costs from state to state.

    The first and the last conversation of a batch may go on in another one.
    """
    legal = np.zeros((4, 4), dtype=bool)
    legal[[1, 2, 3], [2, 3, 2]] = True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id")
        given = ids.fill_null(ids.drop_null()[0]) if ids.null_count < n else pa.array(np.zeros(n, dtype=np.int64))
        fresh = np.ones(n, dtype=bool)
        if n > 1:
            nulls = np.asarray(ids.is_null())
            differ = np.asarray(pc.not_equal(given[1:], given[:-1]).to_numpy(zero_copy_only=False), dtype=bool)
            fresh[1:] = differ | (nulls[1:] != nulls[:-1])
        run = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        first = np.flatnonzero((np.arange(n) - starts[run]) % PIECE == 0)
        bounds = np.append(first, n)
        sizes = np.diff(np.append(starts, n))[run[first]]
        whole = (sizes <= PIECE) & (run[first] > 0) & (run[first] < run[-1])
        kind = np.asarray(batch.column("kind")).astype(np.uint8)
        copies = np.asarray(batch.column("copies"), dtype=np.int64)
        turn = batch.column("turn")
        timed, turns = np.asarray(turn.is_valid()), np.asarray(turn.fill_null(0), dtype=np.int64)
        kinds = [kind[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        told: list[bytes] = []
        for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            k, c, at = kinds[i], copies[a:z], turns[a:z][timed[a:z]]
            blank, late, cut = (k & BLANK) > 0, (k & LATER) > 0, (k & CUT) > 0
            again = np.where(blank, 0, np.where(late, c, c - 1)).sum()
            code = k & CODE
            stats = [c[blank].sum(), again, (cut & ~late).sum(), (c - 1).sum() + (~legal[code[:-1], code[1:]]).sum(), DELETE * (c - 1).sum(), code[0], code[-1]]
            span = [at[0], at[-1], 1 + (at[1:] != at[:-1]).sum()] if len(at) else [0, 0, 0]
            told.append(np.array([*stats, *span], dtype=np.int64).tobytes() + pack(c.astype(np.uint64)))
        tables: list[bytes | None] = [None] * len(kinds)
        own = np.flatnonzero(whole)
        for i, (edits, last, spent) in zip(own, _solved([kinds[i] for i in own], np.tile(END, (len(own), 1)), np.array([0])), strict=True):
            told[i] = _telling(edits, last, spent, told[i])
        parts = np.flatnonzero(~whole)
        same = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
        for at, b in buckets([kinds[i] for i in parts]):
            table = b.costs(np.tile(same, (len(at), 1, 1)))[0]
            for j, i in enumerate(parts[at]):
                tables[i] = table[j].tobytes()
        heads = batch.take(pa.array(first))
        yield pa.RecordBatch.from_arrays(
            [*(heads.column(c) for c in ("conv_id", *_KEY)), pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(tables, pa.binary()), pa.array(told, pa.binary())],
            ["conv_id", *_KEY, "kinds", "table", "told"],
        )


def _telling(edits: np.ndarray, last: np.ndarray, spent: np.ndarray, stats: bytes) -> bytes:
    """Edits for one or four states at the start, the states in which they end, their costs, then the piece's numbers."""
    return np.array([*edits.shape], dtype=np.int64).tobytes() + last.astype(np.int64).tobytes() + spent.astype(np.int64).tobytes() + edits.tobytes() + stats


class _Told:
    """What a piece says: edits by the state at its start, and numbers."""

    def __init__(self, data: bytes) -> None:
        begins, rows = np.frombuffer(data, dtype=np.int64, count=2).tolist()
        self.last, self.spent = np.frombuffer(data, dtype=np.int64, count=2 * begins, offset=16).reshape(2, begins).tolist()
        at = 16 * (1 + begins)
        self.edits = [data[at + i * rows : at + (i + 1) * rows] for i in range(begins)]
        at += begins * rows
        *stats, self.least, self.most, self.turns = np.frombuffer(data, dtype=np.int64, count=10, offset=at).tolist()
        self.stats, self.extra, self.head, self.tail = stats[:4], stats[4], stats[5], stats[6]
        self.copies = unpack(data[at + 80 :])[0].tolist()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the end of each piece costs, from the last piece of each conversation to the first."""
    now: object = batches  # no id
    end = END
    for batch in batches:
        out = []
        for conv, table in zip(batch.column("conv_id").to_pylist(), batch.column("table").to_pylist(), strict=True):
            if conv != now:
                now, end = conv, END
            out.append(end.tobytes())
            end = np.minimum((np.frombuffer(table, dtype=np.int64).reshape(4, 4) + end).min(axis=1), NEVER)
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(out, pa.binary())], ["piece", "end"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of parts of conversations, for each state at their start."""
    for batch in batches:
        kinds = [np.frombuffer(k, dtype=np.uint8) for k in batch.column("kinds").to_pylist()]
        if not kinds:
            continue
        end = np.array([np.frombuffer(e, dtype=np.int64) for e in batch.column("end").to_pylist()])
        told = [_telling(*x, t) for x, t in zip(_solved(kinds, end, np.arange(4)), batch.column("told").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", *_KEY)), pa.array(told, pa.binary())], ["conv_id", *_KEY, "told"])


class _Conversation:
    """Numbers of a conversation as its pieces come, and its state."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.state, self.cost, self.stats = conv_id, 0, 0, [0, 0, 0, 0]
        self.tail = self.least = self.most = None
        self.turns = self.place = self.left = 0
        self.edits, self.copies = b"", []

    def add(self, p: _Told) -> None:
        begin = self.state if len(p.edits) > 1 else 0
        self.edits, self.copies, self.place = p.edits[begin], p.copies, 0
        self.state, self.cost = p.last[begin], self.cost + p.spent[begin] + p.extra
        self.stats = [a + b for a, b in zip(self.stats, p.stats, strict=True)]
        if self.tail is not None and (self.tail, p.head) not in ((1, 2), (2, 3), (3, 2)):
            self.stats[3] += 1
        self.tail = p.tail
        if p.turns:
            self.turns += p.turns - (self.most == p.least)
            self.least, self.most = p.least if self.least is None else self.least, p.most

    @property
    def gaps(self) -> int:
        return self.most - self.least + 1 - self.turns if self.turns else 0

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edits up to the next row, this one included."""
        if self.left:  # another copy
            self.left -= 1
            yield "D", role, text
            return
        code = self.edits[self.place]
        self.left = self.copies[self.place] - 1
        self.place += 1
        for r in ADDED[code >> 2]:
            yield "I", ROLES[r], ""
        op = code & 3
        yield "DKRR"[op], ROLES.get(op, role), text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        """What is put in at the end."""
        while self.state in (1, 2):
            self.state = int(STEP[self.state])
            self.cost += INSERT
            yield "I", ROLES[self.state], ""


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, Iterator[tuple[str, str, str]] | None]]:
    """Each conversation with the edits of each row and, at the last, with None."""
    now = None
    for batch in batches:
        release()
        given = [batch.column(c).to_pylist() for c in ("conv_id", "tag", "told", "role")]
        for conv, tag, told, role, text in zip(*given, batch.column("text"), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    yield now, now.rest()
                    yield now, None
                now = _Conversation(conv)
            if tag == 1:
                now.add(_Told(told))
            elif tag == 2:
                yield now, now.row(role, text.as_py())
    if now is not None:
        yield now, now.rest()
        yield now, None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    audit, whole, lines = bytearray(), hashlib.sha256(), 0
    names = ["gaps", *_STATS, "cost", "audit", "repaired_sha256"]

    def out(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *names])

    kind = None

    def known() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv_id").type
            yield b

    held = 0
    for c, edits in _conversations(known()):
        if edits is None:
            rows.append((c.conv_id, c.gaps, *c.stats, c.cost, audit.decode(), whole.hexdigest()))
            held += len(audit)
            audit, whole, lines = bytearray(), hashlib.sha256(), 0
            if len(rows) >= ROWS or held > 8 << 20:
                yield out(kind)
                rows, held = [], 0
            continue
        for edit, role, text in edits:
            audit += edit.encode()
            if edit != "D":
                whole.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
    if rows:
        yield out(kind)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    kind, held, step = None, 0, 0

    def out() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "step", "edit", "role", "text"])

    def known() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv_id").type
            yield b

    for c, edits in _conversations(known()):
        if edits is None:
            step = 0
            continue
        for edit, role, text in edits:
            rows.append((c.conv_id, step, edit, role, text))
            step += 1
            held += len(text)
        if len(rows) >= ROWS or held > 8 << 20:
            yield out()
            rows, held = [], 0
    if rows:
        yield out()
