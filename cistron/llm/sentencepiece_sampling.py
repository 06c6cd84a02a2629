"""SentencePiece encoding by sampling without replacement, and decoding.

The pieces of the vocabulary that match a text form a lattice; a segmentation is a path through it, with probability in
proportion to the product of its pieces' weights. Adding independent Gumbel noise to the log-probabilities of all
segmentations and taking the k largest gives k different samples without replacement. The search is an A* over prefixes
of segmentations: the backward sums of the lattice give each prefix the log-probability of all its completions, from
which its largest perturbed completion is drawn, given that of its parent; so bounds are exact and segmentations come
off the queue in order. A prefix taken off is followed to its end in one go (the child that keeps the parent's value is
drawn in proportion to its probability), and of the siblings left behind, as one group for each place, only the few
best can ever come off, so only these are queued.

No piece joins a mark of space to what is before it, so a lattice falls into words; different words of a batch have
their backward sums taken once. Noise is a hash of (seed, row key, sample, place): it depends on nothing else.

Decoding gives back what was encoded, byte by byte: a mark of space that a text itself has is encoded as its bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices
from .hashing import mix, powers

SPACE_MARK = "▁"
#: Stands for a mark of space in a text; no character has this code.
OWN_MARK = 0x110000
#: Bytes of text in one batch (one document at least).
BATCH_BYTES = 1 << 18
_RESULT = [("sample", T.IntegerType()), ("n_pieces", T.IntegerType()), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("log_inclusion", T.DoubleType()), ("ids", T.ArrayType(T.IntegerType()))]
_CHECKED = [("decoded_sha256", T.StringType()), ("round_trip", T.BooleanType())]


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their log weights, and the ids of the 256 bytes (-1: none)."""

    pieces: tuple[str, ...]
    weights: tuple[float, ...]
    byte_ids: tuple[int, ...]
    plain: tuple[bool, ...]

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        """From a SentencePiece model with byte fallback.

        A BPE model scores a piece by its rank alone; its weight is Zipf's, the inverse of the rank.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        pieces, plain, byte_ids, weights = [], [], [-1] * 256, []
        for i in ids:
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            usual = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            pieces.append(piece)
            plain.append(usual)
            weights.append(-float(np.log(2.0 - score)) if score <= 0 else 0.0)
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        if sp.encode("  a  bé") and sp.decode(sp.encode("  a  bé")) != "  a  bé":
            raise ValueError("the model changes texts before encoding")
        lowest = min(w for w, p in zip(weights, plain, strict=True) if p)
        weights = [w if p else lowest for w, p in zip(weights, plain, strict=True)]
        return Vocabulary(tuple(pieces), tuple(weights), tuple(byte_ids), tuple(plain))


class Lattice:
    """The vocabulary as tables: character codes, pieces by hash of their characters, all prefixes of pieces."""

    def __init__(self, v: Vocabulary, alpha: float) -> None:
        self.v = v
        usual = [i for i, ok in enumerate(v.plain) if ok]
        self.longest = max(len(v.pieces[i]) for i in usual)
        self.known = np.zeros(OWN_MARK + 1, dtype=bool)
        self.known[[ord(v.pieces[i]) for i in usual if len(v.pieces[i]) == 1]] = True
        if any(SPACE_MARK in v.pieces[i].lstrip(SPACE_MARK) for i in usual):
            raise ValueError("a piece has a mark of space after another character")
        # whether a longer piece starts so, by hash: a set of prefixes with the id of the piece or -1
        ids: dict[str, int] = {}
        for i in usual:
            for n in range(1, len(v.pieces[i])):
                ids.setdefault(v.pieces[i][:n], -1)
        for i in usual:
            ids[v.pieces[i]] = i
        text = np.frombuffer("".join(ids).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(p) for p in ids])
        sums, down = prefix_sums(text)
        starts = ends - [len(p) for p in ids]
        self.hashes = (sums[ends] - sums[starts]) * down[starts]
        self.ids = np.array(list(ids.values()), dtype=np.int32)
        self.bits = max(16, int(len(ids)).bit_length() + 4)
        self.first = np.full(1 << self.bits, -1, dtype=np.int32)
        slot = self.slot(self.hashes)
        self.first[slot[::-1]] = np.arange(len(ids))[::-1]
        left = np.flatnonzero(self.first[slot] != np.arange(len(ids)))
        self.crowded = np.zeros(1 << self.bits, dtype=bool)  # slots that hold one of several
        self.crowded[slot[left]] = True
        order = np.argsort(self.hashes[left])
        self.more, self.more_at = self.hashes[left][order], left[order]
        self.weights = np.array(v.weights) * alpha
        self.byte_ids = np.array(v.byte_ids, dtype=np.int32)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place in the tables of each hash, -1 if it is none of a prefix."""
        slot = self.slot(h)
        at = self.first[slot]
        miss = (at < 0) | (self.hashes[at] != h)
        at[miss] = -1
        j = np.flatnonzero(miss & self.crowded[slot])
        if len(j):
            k = np.minimum(np.searchsorted(self.more, h[j]), len(self.more) - 1)
            hit = self.more[k] == h[j]
            at[j[hit]] = self.more_at[k[hit]]
        return at

    def edges(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges of the words' lattices by node (a character's place), longest first: first edge of each node, length, id,
        cumulative probability, probability."""
        n = len(text)
        sums, down = prefix_sums(text)
        end_of = np.repeat(ends, ends - starts)
        alive = np.arange(n)
        nodes, lengths, ids = [], [], []
        strange = ~self.known[text]
        nodes.append(np.flatnonzero(strange))
        lengths.append(1)
        ids.append(np.full(len(nodes[0]), -1, dtype=np.int32))
        alive = alive[~strange]
        for width in range(1, self.longest + 1):
            alive = alive[alive + width <= end_of[alive]]
            at = self.find((sums[alive + width] - sums[alive]) * down[alive])
            alive, at = alive[at >= 0], at[at >= 0]
            real = self.ids[at] >= 0
            nodes.append(alive[real])
            lengths.append(width)
            ids.append(self.ids[at[real]])
            if not len(alive):
                break
        # edges by node, longer pieces first, without sorting: each width's edges take the next free places of their nodes
        count = np.zeros(n + 1, dtype=np.int64)
        for at in nodes:
            count[at] += 1
        first = np.concatenate(([0], np.cumsum(count[:n])))
        free = first[:-1].copy()
        length, piece = np.empty(first[-1], dtype=np.int32), np.empty(first[-1], dtype=np.int32)
        for at, width, ident in zip(nodes[::-1], lengths[::-1], ids[::-1], strict=True):
            place = free[at]
            length[place], piece[place] = width, ident
            free[at] += 1
        count = count[:n]
        node = np.repeat(np.arange(n, dtype=np.int32), count)
        score = np.where(piece >= 0, self.weights[piece], 0.0)
        # backward sums, by distance from the end of the word
        left = end_of - np.arange(n)
        by_node = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        count_by, head_by = count[by_node], np.concatenate(([0], np.cumsum(count[by_node])))
        edge_by = np.arange(first[-1]) + np.repeat(first[:-1][by_node] - head_by[:-1], count_by)
        target = (node + length)[edge_by]
        score_by = score[edge_by]
        total = np.zeros(n + 1)
        is_end = np.zeros(n + 1, dtype=bool)
        is_end[ends] = True
        open_ = ~is_end[target]
        steps = np.flatnonzero(np.append(np.diff(left[by_node], prepend=0) != 0, True)) if n else np.zeros(1, np.int64)
        p_by = np.empty(len(score_by))
        for a, z in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            lo, hi = head_by[a], head_by[z]
            v = score_by[lo:hi] + np.where(open_[lo:hi], total[target[lo:hi]], 0.0)
            head = head_by[a:z] - lo
            top = np.maximum.reduceat(v, head)
            e = np.exp(v - np.repeat(top, count_by[a:z]))
            mass = np.add.reduceat(e, head)
            total[by_node[a:z]] = top + np.log(mass)
            p_by[lo:hi] = e / np.repeat(mass, count_by[a:z])
        p = np.empty(len(p_by))
        p[edge_by] = p_by
        # in whole numbers of 2**-40, so that other words of the batch leave no rounding
        run = np.cumsum((p * 2.0**40).astype(np.int64))
        run -= np.repeat(np.concatenate(([0], run))[first[:-1]], count)
        run = run * 2.0**-40
        run[first[1:] - 1] = 2.0  # a uniform number always stops there
        sure = np.flatnonzero(p == 1.0)
        p[sure[count[node[sure]] > 1]] = 1 - 2.0**-53  # only a lone edge has no siblings
        return first, length, piece, run, p


#: Codes of the characters below 2**16; those of others are computed.
CODES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
#: Least log of an exponential number that uniform() can give: its greatest number is 1 - 2**-54.
LEAST_NOISE = float(np.log(-np.log1p(-(2.0**-54))))


def prefix_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    codes = CODES[text] if not len(text) or int(text.max()) < len(CODES) else mix(text.astype(np.uint64) + np.uint64(1))
    np.cumsum(codes * up[: len(text)], out=sums[1:])
    return sums, down


PLACE = np.uint64(0xD6E8FEB86659FD93)


def place_key(sample: int, place: np.ndarray, salt: int) -> np.ndarray:
    """What sample and place add to a row key; linear in the place."""
    return np.uint64((sample * 4 + salt + 1) * 0x9E3779B97F4A7C15 % 2**64) + place.astype(np.uint64) * PLACE


def uniform_of(h: np.ndarray) -> np.ndarray:
    return ((mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(key: np.ndarray, sample: int, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) by row key, sample and place."""
    return uniform_of(key + place_key(sample, place, salt))


class _Search:
    """Perturbed A* over the segmentations of a batch of texts."""

    def __init__(self, lattice: Lattice, texts: list[str], keys: np.ndarray, k: int) -> None:
        self.lattice, self.k, self.keys = lattice, k, keys
        marked = [SPACE_MARK + t if t else "" for t in texts]
        self.text = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).copy()
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in marked]))).astype(np.int64)
        n = len(self.text)
        self.text[self.text == ord(SPACE_MARK)] = OWN_MARK
        self.text[self.text == 0x20] = ord(SPACE_MARK)
        self.text[self.offsets[:-1][np.diff(self.offsets) > 0]] = ord(SPACE_MARK)
        mark, strange = self.text == ord(SPACE_MARK), ~lattice.known[self.text]
        start = strange.copy()
        start[1:] |= (mark[1:] & ~mark[:-1]) | strange[:-1]
        start[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n)
        sums, down = prefix_sums(self.text)
        hashes = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        one, word = self.different(hashes)
        width = (self.ends - self.starts)[one]
        self.word_end = np.cumsum(width)
        self.node_of = (self.word_end - width)[word]  # of the first character of each word
        within = np.arange(int(width.sum())) - np.repeat(self.word_end - width, width)
        self.first, self.length, self.piece, self.run, self.p = lattice.edges(self.text[np.repeat(self.starts[one], width) + within], self.word_end - width, self.word_end)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, self.offsets)))

    def different(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind, and each word's kind; equal hashes count only with equal characters."""
        _, one, word = np.unique(hashes, return_index=True, return_inverse=True)
        width = self.ends - self.starts
        alike = width == width[one][word]
        if alike.all():
            of = np.flatnonzero(one[word] != np.arange(len(word)))  # the others are their own kind's first ones
            w = width[of]
            at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w - self.starts[of], w)
            shift = np.repeat(self.starts[one][word[of]] - self.starts[of], w)
            if (self.text[at] == self.text[at + shift]).all():
                return one, word
        kinds: dict[bytes, int] = {}
        word = np.array([kinds.setdefault(self.text[a:z].tobytes(), len(kinds)) for a, z in zip(self.starts, self.ends, strict=True)], dtype=np.int64)
        return np.unique(word, return_index=True)[1], word

    def walk(self, edge: np.ndarray, at: np.ndarray, node: np.ndarray, end: np.ndarray, doc: np.ndarray, sample: int) -> None:
        """Draw edges from the given places to the ends of their words; edge: by character, the edge taken there."""
        key = self.keys[doc] + place_key(sample, -self.offsets[doc], 0)
        while len(at):
            u = uniform_of(key + at.astype(np.uint64) * PLACE)
            e = self.first[node]
            over = np.flatnonzero(u > self.run[e])
            while len(over):
                e[over] += 1
                over = over[u[over] > self.run[e[over]]]
            edge[at] = e
            step = self.length[e]
            at, node = at + step, node + step
            more = at < end
            if not more.all():
                at, node, end, key = at[more], node[more], end[more], key[more]

    def noise(self, doc: int, sample: int, places: np.ndarray) -> np.ndarray:
        """Logs of exponential numbers."""
        key = self.keys[doc : doc + 1]
        return np.log(-np.log(uniform(key, sample, places - self.offsets[doc], 1)))

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Logs of the probabilities of the edges' siblings together."""
        with np.errstate(divide="ignore"):
            return np.log1p(-self.p[edges])

    def queue(self, heap: list, doc: int, sample: int, g: float, places: np.ndarray, edges: np.ndarray, before: np.ndarray) -> None:
        """Queue the groups of siblings left behind at these places; only as many as can still come off.

        A group's log of an exponential number over its probability is LEAST_NOISE - before at least, which only grows,
        so places from which on this is beyond the best ones so far need no noise.
        """
        room, n = self.k, len(places)
        if n > 64 + room:
            v = self.noise(doc, sample, places[:64]) - before[:64] - self.rest(edges[:64])
            worst = np.partition(v, room - 1)[room - 1]
            n = max(64, int(np.searchsorted(-before, worst - LEAST_NOISE, side="right"))) if worst < np.inf else n
        places, edges, before = places[:n], edges[:n], before[:n]
        v = self.noise(doc, sample, places) - before - self.rest(edges)
        keep = np.argpartition(v, room)[:room] if len(v) > room else np.arange(len(v))
        for j in keep:
            if v[j] < np.inf:
                heapq.heappush(heap, (float(np.logaddexp(-g, v[j])), sample, int(places[j]), (int(edges[j]),), float(before[j])))

    def run_all(self) -> Iterator[tuple[int, int, float, float, np.ndarray]]:
        """(document, sample, log-probability, perturbed, edges by place) for the k samples, and the bound for the next."""
        docs, n = len(self.offsets) - 1, len(self.text)
        start = uniform(self.keys, 0, np.zeros(docs), 3)
        gumbel = -np.log(-np.log(start))
        heaps: list[list] = [[] for _ in range(docs)]
        self.taken: list[np.ndarray] = []
        self.found: list[list[tuple[float, float]]] = [[] for _ in range(docs)]
        for sample in range(self.k):
            edge = np.full(n, -1, dtype=np.int32)
            if sample == 0:
                self.walk(edge, self.starts.copy(), self.node_of.copy(), self.ends, self.doc, 0)
                tasks = [(d, float(gumbel[d]), int(self.offsets[d]), 0.0, ()) for d in range(docs)]
            else:
                tasks, at, node, end, doc = [], [], [], [], []
                for d in range(docs):
                    if not heaps[d]:
                        continue
                    minus, source, place, out, before = heapq.heappop(heaps[d])
                    a = self.offsets[d]
                    edge[a:place] = self.taken[source][a:place]
                    w = int(np.searchsorted(self.starts, place, side="right")) - 1
                    here = int(self.node_of[w] + place - self.starts[w])
                    e = self.other(here, out, float(uniform(self.keys[d : d + 1], sample, np.array([place - a]), 0)[0]))
                    edge[place] = e
                    step = int(self.length[e])
                    if place + step < self.ends[w]:
                        at.append([place + step])
                        node.append([here + step])
                        end.append([self.ends[w]])
                        doc.append([d])
                    z = int(np.searchsorted(self.starts, self.offsets[d + 1]))
                    at.append(self.starts[w + 1 : z])
                    node.append(self.node_of[w + 1 : z])
                    end.append(self.ends[w + 1 : z])
                    doc.append(np.full(z - w - 1, d))
                    tasks.append((d, -minus, place, before, out))
                if at:
                    self.walk(edge, *(np.concatenate(x).astype(np.int64) for x in (at, node, end, doc)), sample)
            self.taken.append(edge)
            places = np.flatnonzero(edge >= 0)
            edges = edge[places]
            value = np.log(self.p[edges])
            bounds = np.searchsorted(places, self.offsets)
            for d, g, place, before, out in tasks:
                a, z = int(bounds[d]), int(bounds[d + 1])
                total = float(value[a:z].sum())
                self.found[d].append((total, g))
                if a == z:
                    continue
                p = a if not out else a + int(np.searchsorted(places[a:z], place))
                ahead = before + np.concatenate(([0.0], np.cumsum(value[p : z - 1])))
                if out:
                    # what is left at the place where this sample parted from its source
                    gone = (*out, int(edges[p]))
                    w = int(np.searchsorted(self.starts, place, side="right")) - 1
                    here = int(self.node_of[w] + place - self.starts[w])
                    left = [e for e in range(int(self.first[here]), int(self.first[here + 1])) if e not in gone]
                    if left:
                        mass = before + float(np.log(self.p[left].sum() + 1e-300))
                        noise = float(self.noise(d, sample, places[p : p + 1])[0])
                        heapq.heappush(heaps[d], (float(np.logaddexp(-g, noise - mass)), sample, place, gone, before))
                    p, ahead = p + 1, ahead[1:]
                self.queue(heaps[d], d, sample, g, places[p:z], edges[p:z], ahead)
        self.bound = np.array([-h[0][0] if h else -np.inf for h in heaps])

    def other(self, node: int, out: tuple[int, ...], u: float) -> int:
        """An edge of the node that is not among `out`, in proportion to probability."""
        left = [e for e in range(int(self.first[node]), int(self.first[node + 1])) if e not in out]
        p = np.cumsum(self.p[left])
        return left[int(np.searchsorted(p, u * p[-1]).clip(0, len(left) - 1))]

    def ids(self, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents' samples of this number, one after the other, and the documents' bounds in them."""
        places = np.flatnonzero(self.taken[sample] >= 0)
        out = self.piece[self.taken[sample][places]]
        bounds = np.searchsorted(places, self.offsets)
        strange = np.flatnonzero(out < 0)
        if len(strange):
            codes = [(SPACE_MARK if c == OWN_MARK else chr(c)).encode() for c in self.text[places[strange]].tolist()]
            width = np.ones(len(out), dtype=np.int64)
            width[strange] = [len(c) for c in codes]
            ends = np.concatenate(([0], np.cumsum(width)))
            wide = np.repeat(out, width)
            wide[np.flatnonzero(wide < 0)] = self.lattice.byte_ids[np.frombuffer(b"".join(codes), dtype=np.uint8)]
            out, bounds = wide, ends[bounds]
        return out, bounds


def log_inclusion(log_prob: float, bound: float) -> float:
    """Log of the probability that a segmentation's perturbed log-probability is above the bound."""
    if bound == -np.inf:
        return 0.0
    x = log_prob - bound
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def _encode(vocabulary, k: int, alpha: float, decoded: bool):
    def sampled(lattice: Lattice, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, keys = batch.column("text").to_pylist(), np.asarray(batch.column("key")).view(np.uint64)
        rows = [i for i, t in enumerate(texts) if t is not None]
        if not rows:
            return
        search = _Search(lattice, [texts[i] for i in rows], mix(keys[rows]), k)
        search.run_all()
        for sample in range(k):
            has = [j for j in range(len(rows)) if len(search.found[j]) > sample]
            if not has:
                continue
            flat, bounds = search.ids(sample)
            count = np.diff(bounds)[has]
            found = [search.found[j][sample] for j in has]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(flat, pa.int32()))
            out = {
                "id": batch.column("id").take(pa.array([rows[j] for j in has])),
                "sample": pa.array([sample + 1] * len(has), pa.int32()),
                "n_pieces": pa.array(count, pa.int32()),
                "log_prob": pa.array([f[0] for f in found], pa.float64()),
                "perturbed": pa.array([f[1] for f in found], pa.float64()),
                "log_inclusion": pa.array([log_inclusion(f[0], search.bound[j]) for f, j in zip(found, has, strict=True)], pa.float64()),
                "ids": lists,
            }
            if decoded:
                back = lattice.decoder.texts(lists)
                out["decoded_sha256"] = pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())
                out["round_trip"] = pa.array([b == texts[rows[j]].encode() for b, j in zip(back, has, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        lattice = Lattice(vocabulary.value, alpha)
        lattice.decoder = Decoder(vocabulary.value)
        for batch in batches:
            for part in slices(batch, most=BATCH_BYTES):
                yield from sampled(lattice, part)
        del lattice
        release()

    return run


def encode(docs: DataFrame, model_file: str, k: int = 2, alpha: float = 0.3, seed: int = 0, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """k different sampled segmentations of each text: id, sample from 1, n_pieces, log_prob, perturbed, log_inclusion, ids.

    Samples come by falling perturbed log-probability; fewer than k if a text has no more segmentations (an empty one has
    one, without pieces). log_inclusion is the log of the probability that a segmentation is above the first one left
    out. alpha flattens (0) or keeps (1) the distribution. Noise follows from `seed` and the id alone, so rows of one id and
    text get equal samples; a null id is an id. A null text has no rows. Nothing is shuffled; other columns are not read.
    A long text is searched whole, in memory in proportion to its length. No rows give no rows.

    decoded: each sample's ids are decoded again; decoded_sha256 is of the bytes that come out, round_trip says whether
    they are the text's.
    """
    if k < 1:
        raise ValueError("k is 1 at least")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))  # of the model's size, read on the driver
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("key"), F.col(text).alias("text"))
    result = T.StructType([rows.schema["id"], *(T.StructField(c, t) for c, t in _RESULT + _CHECKED * decoded)])
    return rows.mapInArrow(_encode(vocabulary, k, alpha, decoded), result)


class Decoder:
    """Bytes of each piece: a mark of space is a space, a byte piece its byte, a control piece nothing."""

    def __init__(self, v: Vocabulary) -> None:
        out = [p.replace(SPACE_MARK, " ").encode() if ok else b"" for p, ok in zip(v.pieces, v.plain, strict=True)]
        for byte, i in enumerate(v.byte_ids):
            out[i] = bytes([byte])
        self.pieces = pa.array(out, pa.large_binary())

    def texts(self, ids: pa.ListArray) -> list[bytes | None]:
        """The bytes that each list of ids stands for, less the space that encoding put first; null for a null list."""
        flat = self.pieces.take(ids.flatten())
        _, where, data = flat.buffers()
        where = np.frombuffer(where, dtype=np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        count = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64)
        bounds = where[np.concatenate(([0], np.cumsum(count)))].tolist()
        data, known = data.to_pybytes() if data is not None else b"", np.asarray(pc.is_valid(ids)).tolist()
        return [data[a + (a < z and data[a : a + 1] == b" ") : z] if ok else None for a, z, ok in zip(bounds[:-1], bounds[1:], known, strict=True)]


def _decode(vocabulary, at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            back = decoder.texts(batch.column(at))
            texts = [None if b is None else b.decode("utf-8", "replace") for b in back]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
        release()

    return run


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """`encoded` and a column `decoded`, the text of its `ids`; an own column of that name is replaced.

    Null ids give null, an empty list the empty text; control pieces give nothing. Bytes that are no UTF-8, which encoding
    never gives, become replacement characters.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode(vocabulary, ids), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
