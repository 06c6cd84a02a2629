"""Quality classification by co-training of two views.

One view is the content (shares of bytes and of pairs of bytes, and a few numbers about words and lines), the other what
is known about a document apart from its text (language, source, recorded size). Each view's logistic regression starts
from the labelled rows; over the rounds each gives the documents of which it is surest, with its guess as label, to the
other's training rows. Of held-out labelled rows one half then calibrates either view, the other half the combination, which scores all documents.

Labelled rows are a bounded sample on the driver (MOST_LABELLED, the least hashes of their ids). Unlabelled ones are all
of the table: their features are counted once and kept packed, each round scores them all, the surest are found by counts
over the whole table, and models are fitted from sums of moments, gradients and curvatures of the rows given so far.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, pack, quoted, release, slices, unpack, utf8
from .hashing import span_hashes, spans

#: Labelled rows from which the models are fitted, at most; the share of them held out for calibration.
MOST_LABELLED, HELD_OUT = 6000, 0.25
#: Labelled rows of either class without which nothing is told apart.
LEAST = 5
#: Weight of a row that the other view labelled; tasks over such rows, at least.
GIVEN_WEIGHT, PARTS = 0.3, 12
#: Given rows of one task, at most; so many tasks' sums are added up by one.
PART_ROWS, FAN_IN = 50_000, 32
#: Steps of one fit, at most; it has converged when a step promises less than this share of the loss (of 1 at least).
MOST_STEPS, CONVERGED = 60, 1e-5
ROUNDS, SURE, EACH, RIDGE = 4, 0.95, 0.05, 5.0
PAIRS, SLOTS, SIZES = 512, 32, 24
N_STATS = 9
N_TEXT, N_META = 256 + PAIRS + N_STATS, 2 * SLOTS + SIZES
SCORE = T.StructType([T.StructField(p, T.DoubleType()) for p in ("p_text", "p_meta", "p_quality")])


def _pair_slots() -> np.ndarray:
    codes = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (codes >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)


_SLOT_OF = _pair_slots()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: log size, shares of words, different words, words like the one before, lines, different lines, capitals, letters."""
    n = np.diff(offsets)
    docs = len(n)
    some = np.maximum(n, 1)

    def counted(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])

    def different(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        keys = np.unique((codes >> np.uint64(24)) | (doc.astype(np.uint64) << np.uint64(40)))
        return np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=docs)

    starts, ends, firsts = spans(data, offsets)
    words = np.diff(firsts)
    codes, doc = span_hashes(data, starts, ends), np.repeat(np.arange(docs), words)
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    newline = np.zeros(256, dtype=bool)
    newline[0x0A] = True
    line_starts, line_ends, line_firsts = spans(data, offsets, newline)
    lines = np.diff(line_firsts)
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    return np.stack(
        [
            np.log1p(n),
            words / some,
            different(codes, doc) / np.maximum(words, 1),
            np.bincount(doc[again], minlength=docs) / np.maximum(words, 1),
            lines / np.maximum(words, 1),
            different(span_hashes(data, line_starts, line_ends), np.repeat(np.arange(docs), lines)) / np.maximum(lines, 1),
            counted(upper) / some,
            counted(letter) / some,
            (n == 0).astype(float),
        ],
        axis=1,
    )


def counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text: how often each byte and each slot of pairs occurs."""
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        part = data[a:z].astype(np.int64)
        yield np.concatenate([np.bincount(part, minlength=256), np.bincount(_SLOT_OF[part[:-1] * 256 + part[1:]], minlength=PAIRS)])


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(offsets), 1)[:, None]
    shares = np.array(list(counts(data, offsets)), dtype=np.float64).reshape(len(n), 256 + PAIRS) / n
    return np.concatenate([shares, statistics(data, offsets)], axis=1)


def meta_slots(lang: pa.Array, source: pa.Array, size: pa.Array) -> np.ndarray:
    """One of SLOTS for each of language and source (by a hash of the value; null has its own), one of SIZES for the size."""
    out = np.zeros((len(size), 3), dtype=np.uint8)
    for k, column in enumerate((lang, source)):
        data, offsets = utf8(column)
        empty = np.asarray(column.is_null())
        slot = (span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(SLOTS - 1)).astype(np.int64) if len(data) else np.zeros(len(column), np.int64)
        out[:, k] = k * SLOTS + np.where(empty, SLOTS - 1, slot)
    values = np.asarray(size.fill_null(-1), dtype=np.float64)
    slot = np.where(values < 0, SIZES - 1, np.minimum(np.log2(np.maximum(values, 0) + 1), SIZES - 2)).astype(np.int64)
    out[:, 2] = 2 * SLOTS + slot
    return out


def one_hot(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), N_META))
    out[np.arange(len(slots))[:, None], slots] = 1
    return out


def meta_features(lang: pa.Array, source: pa.Array, size: pa.Array) -> np.ndarray:
    return one_hot(meta_slots(lang, source, size))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    weights: np.ndarray
    bias: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray | None = None) -> Logistic:
        mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
        scale[scale < 1e-9] = np.inf
        weight = np.ones(len(x)) if weight is None else weight
        penalty = np.full(x.shape[1] + 1, ridge)
        penalty[-1] = 1e-6
        b = np.zeros(x.shape[1] + 1)
        for _ in range(12):
            gradient, curve = penalty * b, np.diag(penalty)
            for i in range(0, len(x), 512):  # no copy of all rows
                part = slice(i, i + 512)
                z = np.concatenate([(x[part] - mean) / scale, np.ones((len(x[part]), 1))], axis=1)
                p = _sigmoid(z @ b)
                gradient += z.T @ (weight[part] * (p - y[part]))
                curve += (z.T * (weight[part] * np.maximum(p * (1 - p), 1e-4))) @ z
            step = np.linalg.solve(curve, gradient)
            b -= step * min(1.0, 10.0 / max(1e-12, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-5:
                break
        w = b[:-1] / scale
        return Logistic(w, float(b[-1] - mean @ w))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    mix: tuple[float, float, float]

    def score(self, data: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array, size: pa.Array) -> tuple[np.ndarray, ...]:
        """Calibrated probabilities of either view and of both."""
        n = np.maximum(np.diff(offsets), 1)
        w = self.text.weights
        total = np.zeros(len(data) + 1)
        gain = w[:256][data]
        gain[:-1] += w[256 : 256 + PAIRS][_SLOT_OF[data[:-1].astype(np.int64) * 256 + data[1:]]]
        full = offsets[1:][np.diff(offsets) > 0]
        gain[full - 1] = w[:256][data[full - 1]]  # no pair across documents
        np.cumsum(gain, out=total[1:])
        z = np.diff(total[offsets]) / n + statistics(data, offsets) @ w[256 + PAIRS :] + self.text.bias
        t = self.text_scale[0] * z + self.text_scale[1]
        m = self.meta_scale[0] * self.meta.logit(meta_features(lang, source, size)) + self.meta_scale[1]
        return _sigmoid(t), _sigmoid(m), _sigmoid(self.mix[0] * t + self.mix[1] * m + self.mix[2])


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate logits; targets are drawn in a little, so that clean data keep finite logits."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    f = Logistic.fit(z[:, None], target, 1e-3)
    return max(float(f.weights[0]), 0.0), f.bias


def _moments(x: np.ndarray) -> np.ndarray:
    """Sums and sums of squares, and the number of rows."""
    x = x.astype(np.float64)
    return np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])


def _sums(x: np.ndarray, y: np.ndarray, weight: float, mean: np.ndarray, scale: np.ndarray, b: np.ndarray, curved: bool) -> tuple[np.ndarray, ...]:
    """Gradient of the loss over these rows with the loss at its end, and, if asked for, curvature."""
    gradient, curve = np.zeros(len(b) + 1), np.zeros((len(b), len(b)) if curved else (0, 0))
    for i in range(0, len(x), 512):  # no copy of all rows
        z = np.concatenate([(x[i : i + 512] - mean) / scale, np.ones((len(x[i : i + 512]), 1))], axis=1)
        t, labels = z @ b, y[i : i + 512]
        p = _sigmoid(t)
        gradient[:-1] += weight * (z.T @ (p - labels))
        gradient[-1] += weight * float((np.logaddexp(0, t) - labels * t).sum())
        if curved:
            z = z.astype(np.float32)  # only steers the steps
            curve += (z.T * (weight * np.maximum(p * (1 - p), 1e-4)).astype(np.float32)) @ z
    return (gradient, curve) if curved else (gradient,)


def _decoded(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views of packed rows."""
    fixed = 4 * N_STATS + 3
    stats = np.frombuffer(b"".join(p[: 4 * N_STATS] for p in payloads), dtype=np.float32).reshape(-1, N_STATS)
    slots = np.frombuffer(b"".join(p[4 * N_STATS : fixed] for p in payloads), dtype=np.uint8).reshape(-1, 3)
    some = np.array([unpack(zlib.decompress(p[fixed:]))[0] for p in payloads], dtype=np.float32).reshape(-1, 256 + PAIRS)
    return np.concatenate([some / np.maximum(some[:, :256].sum(axis=1), 1)[:, None], stats], axis=1), one_hot(slots)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, order, x): features of each row, packed, without its text."""
    for batch in (part for whole in batches for part in slices(whole)):
        data, offsets = utf8(batch.column("text"))
        stats = statistics(data, offsets).astype(np.float32)
        slots = meta_slots(*(batch.column(c) for c in ("lang", "source", "size")))
        x = [s.tobytes() + m.tobytes() + zlib.compress(pack(c), 1) for s, m, c in zip(stats, slots, counts(data, offsets), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("order"), pa.array(x, pa.binary())], names=["id", "order", "x"])
    release()


def _sortable(z: np.ndarray) -> np.ndarray:
    """Numbers in single precision as integers of 32 bits in the same order."""
    bits = z.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.int64)


def _keys(z: np.ndarray, order: np.ndarray, c: int) -> np.ndarray:
    """Ascending from the surest of class c, among equals by `order`; -1 where not sure."""
    z = np.where(z == 0, 0.0, z if c == 0 else -z)
    return np.where(_sigmoid(-z) >= SURE, (_sortable(z) << 31) | ((order >> 33) & 0x7FFFFFFF), -1)


#: Either view's model and by (view, class) the last key that counts as surest, of one round.
Round = tuple[list[Logistic], list[list[int]]]


def _scored(models: list[Logistic]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                order = np.asarray(part.column("order"))
                for k, x in enumerate(_decoded(part.column("x").to_pylist())):
                    z = models[k].logit(x.astype(np.float64))
                    for c in (0, 1):
                        keys = _keys(z, order, c)
                        keys = keys[keys >= 0]
                        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys), 2 * k + c), pa.int32()), "key": pa.array(keys, pa.int64())})
        release()

    return run


def _given(history: list[Round]):
    """The rows that either view has given to the other so far; what a row was given first stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                order = np.asarray(part.column("order"))
                views = [x.astype(np.float64) for x in _decoded(part.column("x").to_pylist())]
                labels = np.full((2, part.num_rows), -1, dtype=np.int32)
                for models, last in history:
                    for k in (0, 1):
                        z, to = models[k].logit(views[k]), labels[1 - k]
                        for c in (1, 0):
                            keys = _keys(z, order, c)
                            to[(keys >= 0) & (keys <= last[k][c]) & (to < 0)] = c
                some = np.flatnonzero((labels >= 0).any(axis=0))
                yield pa.RecordBatch.from_pydict({"x": part.column("x").take(pa.array(some)), "text": pa.array(labels[0][some]), "meta": pa.array(labels[1][some])})
        release()

    return run


@dataclass
class Pool:
    """All unlabelled rows: (order, x), counted."""

    rows: DataFrame
    size: int

    def surest(self, models: list[Logistic], most: list[list[int]]) -> list[list[int]]:
        """By view and class the key of the last of the `most` surest rows (-1: none), by counts of digits of the keys."""
        keys = checkpoint(self.rows.mapInArrow(_scored(models), "kind int, key long"))
        prefix, left, done = [0] * 4, [most[k][c] for k in (0, 1) for c in (0, 1)], {}
        for shift in (48, 32, 16, 0):
            todo = [i for i in range(4) if i not in done]
            if not todo:
                break
            match = [(F.col("kind") == i) & ((F.shiftright("key", shift + 16) == prefix[i]) if shift < 48 else F.lit(True)) for i in todo]
            wanted = match[0]
            for m in match[1:]:
                wanted = wanted | m
            bins = keys.where(wanted).groupBy("kind", F.shiftright("key", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n")).toArrow()
            kind, place, n = (np.asarray(bins.column(c)) for c in ("kind", "bin", "n"))
            for i in todo:
                at = np.flatnonzero(kind == i)
                at = at[np.argsort(place[at])]
                total = np.cumsum(n[at])
                k = int(np.searchsorted(total, left[i]))
                if left[i] <= 0 or not len(at):
                    done[i] = -1
                elif k >= len(at) or total[k] == left[i] or not shift:  # whole digits; equal keys stay together
                    done[i] = (int(place[at[min(k, len(at) - 1)]]) + 1 << shift) - 1
                else:
                    prefix[i], left[i] = int(place[at[k]]), left[i] - (int(total[k - 1]) if k else 0)
        return [[done[2 * k + c] for c in (0, 1)] for k in (0, 1)]

    def given(self, history: list[Round]) -> DataFrame:
        # a round gives EACH of the rows at most for either view and class
        most = 2 * 2 * len(history) * EACH * self.size
        return checkpoint(self.rows.mapInArrow(_given(history), "x binary, text int, meta int").repartition(max(PARTS, math.ceil(most / PART_ROWS))))


_SUMS = "view int, at int, sums binary"


def _total(key: tuple, table: pa.Table) -> pa.Table:
    """Sum of packed arrays; curvatures are in single precision."""
    kind = np.float32 if key[1].as_py() else np.float64
    total = sum(np.frombuffer(s.as_buffer(), dtype=kind).astype(np.float64) for s in table.column("sums")).astype(kind)
    release()
    return pa.table({"view": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _added(given: DataFrame, add: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> list[list[np.ndarray]]:
    """By view the sums of what add(view, features, labels) returns for parts of the given rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[list[np.ndarray] | None] = [None, None]
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                views = _decoded(part.column("x").to_pylist())
                for k, name in enumerate(("text", "meta")):
                    y = np.asarray(part.column(name))
                    more = add(k, views[k][y >= 0], y[y >= 0].astype(np.float64))
                    sums[k] = [a + b for a, b in zip(sums[k], more, strict=True)] if sums[k] else list(more)
        for k, some in enumerate(sums):
            for j, a in enumerate(some or []):
                half = a[np.triu_indices(len(a))].astype(np.float32) if a.ndim == 2 else a  # symmetric
                yield pa.RecordBatch.from_pydict({"view": pa.array([k], pa.int32()), "at": pa.array([j], pa.int32()), "sums": pa.array([half.tobytes()], pa.binary())})

    out: list[dict[int, np.ndarray]] = [{}, {}]
    # added up in a tree, so that the driver gets one of each kind
    rows, parts = given.mapInArrow(run, _SUMS), given.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        rows = rows.groupBy("view", "at", F.pmod(F.xxhash64("sums"), F.lit(parts)).alias("part")).applyInArrow(_total, _SUMS)
    rows = rows.groupBy("view", "at").applyInArrow(_total, _SUMS).toArrow()
    for k, j, sums in zip(*(rows.column(c) for c in ("view", "at", "sums")), strict=True):
        out[k.as_py()][j.as_py()] = np.frombuffer(sums.as_buffer(), dtype=np.float32 if j.as_py() else np.float64).astype(np.float64)
    del rows
    release()
    for view in out:
        if 1 in view:
            n = (math.isqrt(8 * len(view[1]) + 1) - 1) // 2
            full = np.zeros((n, n))
            full[np.triu_indices(n)] = view[1]
            view[1] = full + np.triu(full, 1).T
    return [[view[j] for j in sorted(view)] for view in out]


def _fit_views(views: list[np.ndarray], y: np.ndarray, ridge: float, given: DataFrame | None, start: list[Logistic]) -> list[Logistic]:
    """Both views' regressions, on labelled rows here and given ones there, from `start` on."""

    def total(add) -> list[list[np.ndarray]]:
        more = _added(given, lambda k, x, labels: add(k, x, labels, GIVEN_WEIGHT)) if given is not None else [[], []]
        own = [add(k, x, y, 1.0) for k, x in enumerate(views)]
        return [[a + b for a, b in zip(o, m, strict=True)] if m else list(o) for o, m in zip(own, more, strict=True)]

    mean, scale, b, penalty, going = [], [], [], [], [True, True]
    for k, (moments,) in enumerate(total(lambda k, x, labels, weight: (_moments(x),))):
        n, at = views[k].shape[1], moments[-1]
        mean.append(moments[:n] / at)
        deviation = np.sqrt(np.maximum(moments[n : 2 * n] / at - mean[k] ** 2, 0))
        varies = deviation >= 1e-9
        scale.append(np.where(varies, deviation, np.inf))
        w = np.where(varies, start[k].weights, 0.0)
        b.append(np.append(w * np.where(varies, deviation, 0.0), start[k].bias + mean[k] @ w))
        penalty.append(np.append(np.full(n, ridge), 1e-6))
    best: list[tuple[float, np.ndarray]] = [(np.inf, v) for v in b]
    # a curvature is kept as long as steps with it halve; gradients are small, curvatures are not
    curves: list[np.ndarray | None] = [None, None]
    size, promised = [np.inf, np.inf], [np.inf, np.inf]
    for _ in range(MOST_STEPS):
        now, curved = list(going), [c is None for c in curves]

        def add(k, x, labels, weight, now=now, curved=curved):
            return _sums(x, labels, weight, mean[k], scale[k], b[k], curved[k]) if now[k] else (np.zeros(1),)

        for k, sums in enumerate(total(add)):
            if not now[k]:
                continue
            gradient = sums[0]
            if curved[k]:
                curves[k] = sums[1]
            loss = gradient[-1] + 0.5 * float(penalty[k] @ (b[k] * b[k]))
            least, at = best[k]
            if loss > least + 1e-9 * abs(least):  # too far
                step = (b[k] - at) / 2
                b[k] = at + step
                curves[k] = None
                promised[k] /= 2
            else:
                best[k] = (loss, b[k])
                slope = gradient[:-1] + penalty[k] * b[k]
                step = -np.linalg.solve(curves[k] + np.diag(penalty[k]), slope)
                promised[k] = -0.5 * float(slope @ step)
                step *= min(1.0, 10.0 / max(1e-12, float(np.abs(step).max())))
                b[k] = b[k] + step
                if np.abs(step).max() > 0.5 * size[k]:
                    curves[k] = None
                size[k] = float(np.abs(step).max())
            going[k] = np.abs(step).max() >= 1e-4 and promised[k] > CONVERGED * max(1.0, best[k][0])
        if not any(going):
            break
    else:
        warnings.warn(f"a fit of the quality classifier stopped after {MOST_STEPS} steps", stacklevel=2)
    b = [at for _, at in best]  # never a step that was too far
    weights = [v[:-1] / s for v, s in zip(b, scale, strict=True)]
    return [Logistic(w, float(v[-1] - m @ w)) for w, v, m in zip(weights, b, mean, strict=True)]


def train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Callable[[], Pool], rounds: int = ROUNDS) -> Model:
    """Fit both views in turns. y: 0 or 1; the rows of the pool have no label."""
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        share = (float(y.sum()) + 1) / (len(y) + 1)  # no two classes to tell apart: all get the prior
        flat = float(np.log(share / max(1 - share, 1e-3)))
        return Model(Logistic(np.zeros(N_TEXT), 0.0), Logistic(np.zeros(N_META), 0.0), (0.0, flat), (0.0, flat), (0.5, 0.5, 0.0))
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):  # of either class; rows come in order of a hash
        held[np.flatnonzero(y == c)[:: round(1 / HELD_OUT)]] = True
    mixing = np.zeros(len(y), dtype=bool)  # every other one of these
    for c in (0, 1):
        mixing[np.flatnonzero(held & (y == c))[1::2]] = True
    calibrating = held & ~mixing
    views, more = [text[~held], meta[~held]], pool()
    models = _fit_views(views, y[~held], RIDGE, None, [Logistic(np.zeros(N_TEXT), 0.0), Logistic(np.zeros(N_META), 0.0)])
    most = [math.ceil(EACH * share * more.size) for share in (1 - y.mean(), y.mean())]
    history: list[Round] = []
    for _ in range(rounds):
        history.append((models, more.surest(models, [most, most])))
        models = _fit_views(views, y[~held], RIDGE, more.given(history), models)
    scales = [_platt(m.logit(x[calibrating]), y[calibrating]) for m, x in zip(models, (text, meta), strict=True)]
    both = np.stack([a * m.logit(x[mixing]) + b for (a, b), m, x in zip(scales, models, (text, meta), strict=True)], axis=1)
    mix = Logistic.fit(both, y[mixing], 1.0)
    return Model(models[0], models[1], scales[0], scales[1], (float(mix.weights[0]), float(mix.weights[1]), mix.bias))


@F.arrow_udf(T.BinaryType())
def _features(text: pa.Array) -> pa.Array:
    return pa.array([r.tobytes() for r in text_features(*utf8(text)).astype(np.float32)], pa.binary())


def _sampled(docs: DataFrame, ids: DataFrame, text: str) -> pa.Table:
    """Features and what is known of the documents with these ids (a bounded number), one row for each id.

    Of several rows of one id that with the least hash of its text counts, so that no repeated id reaches the driver.
    """
    own = [F.col(c) for c in ("lang", "source", "size")]
    least = F.min_by(F.struct("text", *own), F.xxhash64("text", *own))
    rows = docs.join(F.broadcast(ids.select("id")), "id", "left_semi").groupBy("id").agg(least.alias("row")).join(F.broadcast(ids), "id")
    return rows.select("order", "label", _features("row.text").alias("x"), "row.lang", "row.source", "row.size").limit(MOST_LABELLED).toArrow()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, source: str, size: str, label: str, rounds: int = ROUNDS) -> Model:
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    order = F.xxhash64("id", F.lit("order")).alias("order")
    some = known.select("id", "label", order).orderBy("order", "id").limit(MOST_LABELLED)
    t = _sampled(rows, some, text).sort_by("order")
    x = np.frombuffer(utf8(t.column("x"))[0].tobytes(), dtype=np.float32).reshape(-1, N_TEXT)
    meta = meta_features(*(t.column(c).combine_chunks() for c in ("lang", "source", "size")))
    y = np.array(t.column("label").to_pylist(), dtype=np.float64)

    def pool() -> Pool:
        # rows without id, which no label can have, are dealt by their order; packed before the join, so that no text moves
        order = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id", F.lit("order")))
        packed = rows.select(F.col("id").cast("long").alias("id"), order.alias("order"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "size")
        packed = packed.mapInArrow(_packed, "id long, order long, x binary").withColumn("key", F.coalesce("id", "order"))
        mine = known.select(F.col("id").cast("long").alias("key"), F.lit(True).alias("has_id"))
        out = packed.select("key", F.col("id").isNotNull().alias("has_id"), "order", "x").join(mine, ["key", "has_id"], "left_anti").select("order", "x")
        out = checkpoint(out)
        return Pool(out, out.count())

    return train(x, meta, y, pool, rounds)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", size: str = "n_chars", label: str = "quality", rounds: int = ROUNDS, threshold: float = 0.5, into: str = "quality", keep: str = "keep") -> DataFrame:
    """`docs` and a struct column `quality` (p_text, p_meta, p_quality) and `keep`; own columns of these names are replaced.

    A document is kept if its probability of good quality is `threshold` or more. A null text counts as empty, nulls of
    the other view are values of their own. Labels other than 0 and 1 and without id don't count, of several for one id
    the least does; of several rows with one labelled id one counts, that with the least hash. Of documents of which a
    view is equally sure the one with the smaller hash of its id is handed over first. Without `LEAST` labels of either class
    all documents get the labels' share. Repeated rows get equal scores. A text of any length is read whole. No rows give no
    rows. `into` and `keep` name the new columns.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, lang, source, size, label, rounds))

    @F.arrow_udf(SCORE)
    def scored(t: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        release()
        parts, step = [], 1 << 9
        for i in range(0, len(t), step):
            data, offsets = utf8(t.slice(i, step))
            parts.append(model.value.score(data, offsets, a.slice(i, step), b.slice(i, step), c.slice(i, step)))
        p = [np.concatenate([x[k] for x in parts]) if parts else np.zeros(0) for k in range(3)]
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in p], names=["p_text", "p_meta", "p_quality"])

    out = docs.drop(into, keep).withColumn(into, scored(F.col(text), F.col(lang).cast("string"), F.col(source).cast("string"), F.col(size).cast("long")))
    return out.withColumn(keep, F.col(quoted(into))["p_quality"] >= threshold)
