"""Similarity join of documents on word shingles, with adaptive multi-match prefixes.

Shingles have one global order, rare ones first, by counts estimated over all documents. Two sets with the asked-for
Jaccard similarity share l shingles among the first n - ceil(t n) + l of each, for any l. A longer prefix asks for more
shared shingles, so it leaves fewer pairs to verify: each document takes its l by the candidates that its plain prefix
is expected to meet, and a pair must meet the smaller of the two documents' l.

Equal sets are one node from the start. A shingle that few nodes have yields all of their pairs; one that many have
yields each node's pairs with a few leaders, and, once the links found so far are joined into components, the pairs
that lie in different components. So large groups of copies cost as many pairs as they have members, and no link
between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, block_count, checkpoint, grouped, is_in, pack, release, slices, split_by, tidy, unpack, utf8
from .components import components
from .hashing import ASCII_LOWER, grams, mix, span_hashes, spans

#: Counters of the estimate of document frequencies (4 MB as broadcast, whatever the input), in PARTS rows for each task.
COUNTERS, PARTS, SALTS = 1 << 20, 256, 64
#: Shared prefix shingles asked for: at least, at most; one more for each doubling of the expected candidates beyond COST.
LEAST, MOST, COST = 3, 8, 64
#: Nodes that share a shingle and are all paired; in larger groups each is paired with LEADERS of them first.
SMALL, LEADERS = 8, 2
#: Ids in a broadcast set of wanted documents; beyond, a shuffle join does the same.
WANTED = 1_000_000
#: A class of set sizes is as wide as so many steps of the asked-for similarity.
CLASS_STEPS = 4


def ceil_share(n, share: tuple[int, int]):
    return -(-n * share[0] // share[1])


#: Distinct 64-bit hashes of the members of each text's set, ascending, from the texts' bytes, their offsets and a seed.
Sets = Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]]


def shingles(size: int) -> Sets:
    """Sets of `size`-word shingles, A-Z lower-cased; with fewer words, the whole sequence as one."""

    def sets(data: np.ndarray, offsets: np.ndarray, seed: int) -> list[np.ndarray]:
        data = ASCII_LOWER[data]
        starts, ends, firsts = spans(data, offsets)
        codes = span_hashes(data, starts, ends) ^ np.uint64(seed)
        hashes, out = grams(codes, size), []
        for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if z - a >= size:
                out.append(np.unique(hashes[a : z - size + 1]))
            else:
                out.append(mix(grams(codes[a:z], z - a)) if z > a else codes[:0])
        return out

    return sets


class _Batch:
    """Each document's set, with its key (a hash of the set) and a second hash."""

    def __init__(self, text: pa.Array, sets: Sets, seed: int) -> None:
        self.sets = sets(*utf8(text), seed)
        counts = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.all = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.all ^ np.uint64(c))))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        end = np.cumsum(counts)
        self.n = counts
        self.key, self.check = (mix(s[end] - s[end - counts] + counts.astype(np.uint64)).view(np.int64) for s in sums)


_FACTS_DDL = "kind int, id long, n long, key long, check long, part int, salt int, payload binary"
_FACTS = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("part", pa.int32()), ("salt", pa.int32()), ("payload", pa.binary())])


def _facts(sets: Sets, seed: int):
    """One row for each document, and each task's counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, salt = np.zeros(COUNTERS, dtype=np.int64), 0
        for batch in (part for whole in batches for part in slices(whole)):
            b = _Batch(batch.column("text"), sets, seed)
            for a in range(0, len(b.all), 1 << 20):
                counters += np.bincount((b.all[a : a + (1 << 20)] >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
            if len(b.key):
                salt = int(b.key[0]) % SALTS
            none = pa.nulls(len(b.n), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b.n)), pa.int32()), batch.column("id"), pa.array(b.n), pa.array(b.key), pa.array(b.check), none, none, pa.nulls(len(b.n), pa.binary())], schema=_FACTS)
        if counters.any():
            parts = [pack(p) for p in counters.reshape(PARTS, -1)]
            longs = [pa.nulls(PARTS, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array([1] * PARTS, pa.int32()), *longs, pa.array(range(PARTS), pa.int32()), pa.array([salt] * PARTS, pa.int32()), pa.array(parts, pa.binary())], schema=_FACTS)
        del counters
        release()

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // PARTS, dtype=np.int64)
    for p in table.column("payload").to_pylist():
        total += unpack(p)[0].astype(np.int64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([pack(total)], pa.binary())})


def _estimate(facts: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by the upper 20 bits of their hash."""
    rows = facts.where("kind = 1").groupBy("part", "salt").applyInArrow(_add, "part int, payload binary").groupBy("part").applyInArrow(_add, "part int, payload binary")
    out = np.zeros((PARTS, COUNTERS // PARTS), dtype=np.int64)
    for part, payload in rows.collect():  # COUNTERS numbers
        out[part] = unpack(bytes(payload))[0].astype(np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def length_class(n: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Class of each set size, and whether larger sets of the next class can be similar.

    Bounds grow by CLASS_STEPS times the share, so sets that are similar lie in one class or in neighbouring ones.
    """
    ratio = share[1] / share[0]
    width = max(ratio**CLASS_STEPS, 2.0)
    cls = np.floor(np.log(np.maximum(n, 1)) / np.log(width) + 1e-9).astype(np.int64)
    return cls, n * ratio * (1 + 1e-9) >= width ** (cls + 1)


def _prefixes(sets: Sets, seed: int, share: tuple[int, int], buckets: int, estimate, by_length: bool):
    """(bucket, payload): the prefix members of each different set, once for each task.

    by_length: a member meets only sets of its class of sizes; a set near a class's upper end is a guest in the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = estimate.value
        usual = int(np.median(counts))
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            b = _Batch(batch.column("text"), sets, seed)
            token, node, n_of, place, asked = [], [], [], [], []
            for s, n, key in zip(b.sets, b.n.tolist(), b.key.tolist(), strict=True):
                if not n or key in seen:
                    continue
                seen.add(key)
                need = ceil_share(n, share)
                plain = n - need + 1
                count = counts[(s >> np.uint64(44)).astype(np.int64)].astype(np.int64)
                order = np.argsort(count, kind="stable")
                cost = int(np.maximum(count[order[:plain]] - usual, 0).sum())
                ask = min(max(LEAST, min(MOST, LEAST + (1 + cost // COST).bit_length() - 1)), need)
                take = order[: plain + ask - 1]
                token.append(s[take])
                node.append(np.full(len(take), key, dtype=np.int64))
                n_of.append(np.full(len(take), n, dtype=np.int64))
                place.append(np.arange(len(take)))
                asked.append(np.full(len(take), ask, dtype=np.int64))
            if token:
                token, node, n_of, place, asked = (np.concatenate(x) for x in (token, node, n_of, place, asked))
                if by_length:
                    cls, guest = length_class(n_of, share)
                    of = np.concatenate([np.arange(len(token)), np.flatnonzero(guest)])
                    cls = np.concatenate([cls, cls[guest] + 1]).astype(np.uint64)
                    token, node, n_of, place, asked = mix(token[of] + (cls + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), node[of], n_of[of], place[of], asked[of]
                cut = split_by((token >> np.uint64(4)) % np.uint64(buckets), buckets)
                rows = [pack(token[i], node[i].view(np.uint64), n_of[i], place[i], asked[i]) for _, i in cut]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    return run


_PAIRS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("need", pa.int64()), ("strict", pa.int64()), ("lead", pa.int64()), ("token", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])
_PAIRS_DDL = "kind int, a long, b long, shared long, need long, strict long, lead long, token long, n long, place long"


def _candidates(share: tuple[int, int]):
    """Pairs of nodes and how many prefix shingles of this bucket they share, of those how many strictly first ones, and of
    these how many of large groups (kind 0); members of large groups by their strictly first shingles (1) and by any (2)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        release()
        parts = [unpack(p) for p in table.column("payload").to_pylist()]
        token, node = (np.concatenate([p[j].astype(np.uint64) for p in parts]) for j in (0, 1))
        n, place, asked = (np.concatenate([p[j] for p in parts]) for j in (2, 3, 4))
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        order = order[np.lexsort((node[order], place[order], token[order]))]
        fresh = np.insert((token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1]), 0, True)[: len(order)]
        order = order[fresh]  # one set met by several tasks
        token, node, n, place, asked = (x[order] for x in (token, node, n, place, asked))
        head = np.flatnonzero(np.insert(token[1:] != token[:-1], 0, True)[: len(token)])
        count = np.diff(np.append(head, len(token)))
        left, right = [], []
        rank = np.arange(len(token)) - np.repeat(head, count)
        of = np.repeat(count, count)
        # all pairs of small groups, by distance; in large ones pairs with the leaders, which have the shingle earliest:
        # those have the fewest rarer ones, so they are nearest to what the group was copied from
        for d in range(1, SMALL):
            i = np.flatnonzero((of <= SMALL) & (rank + d < of))
            left.append(i)
            right.append(i + d)
        for leader in range(LEADERS):
            i = np.flatnonzero((of > SMALL) & (rank > leader))
            left.append(i - rank[i] + leader)
            right.append(i)
        left, right = np.concatenate(left), np.concatenate(right)
        swap = node[left].view(np.int64) > node[right].view(np.int64)
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        need = np.minimum(asked[left], asked[right])
        low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        # for sets of these sizes, `inter` are in common; the first n - inter + l of each then share l, for any l
        inter = ceil_share(n[left] + n[right], (share[0], share[0] + share[1]))
        ok = (low * share[1] >= high * share[0]) & (place[left] < n[left] - inter + need) & (place[right] < n[right] - inter + need)
        left, right, need, inter = left[ok], right[ok], need[ok], inter[ok]
        by = np.lexsort((node[right], node[left]))
        left, right, need, inter = left[by], right[by], need[by], inter[by]
        fresh = np.insert((node[left][1:] != node[left][:-1]) | (node[right][1:] != node[right][:-1]), 0, True)[: len(left)]
        at = np.flatnonzero(fresh)
        shared = np.diff(np.append(at, len(left)))
        strict = (place[left] <= n[left] - inter) & (place[right] <= n[right] - inter)
        strict, lead = (np.add.reduceat(x.astype(np.int64), at) if len(at) else at for x in (strict, strict & (of[left] > SMALL)))
        a, b = (node[x[at]].view(np.int64) for x in (left, right))
        big = np.flatnonzero((of > SMALL) & (place <= n - ceil_share(n, share)))
        within = np.unique(node[of > SMALL]).view(np.int64)
        zero, none, other = (np.zeros(len(x), dtype=np.int64) for x in (big, at, within))
        columns = [
            np.concatenate(x)
            for x in (
                (none, zero + 1, other + 2),
                (a, node[big].view(np.int64), within),
                (b, zero, other),
                *((c, zero, other) for c in (shared, need[at], strict, lead)),
                *((none, c, other) for c in (token[big].view(np.int64), n[big], place[big])),
            )
        ]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)

    return run


def _sets(sets: Sets, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            b = _Batch(batch.column("text"), sets, seed)
            yield pa.RecordBatch.from_arrays([pa.array(b.key), pa.array([s.tobytes() for s in b.sets], pa.binary())], names=["node", "members"])

    return run


def similar(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two ascending sets have the asked-for Jaccard similarity.

    Their sizes bound it from above, and counting ends where the rest can't make up for what is missing.
    """
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if len(few) * share[1] < len(many) * share[0]:
        return False
    need, inter, step = ceil_share(len(few) + len(many), (share[0], sum(share))), 0, 512
    for a in range(0, len(few), step):
        inter += int(is_in(few[a : a + step], many).sum())
        if inter + max(0, len(few) - a - step) < need:
            return False
    return True


def _verify(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                ok.append(similar(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)), share))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(docs: DataFrame, homes: DataFrame, pairs: DataFrame, of: Sets, seed: int, share: tuple[int, int], single: bool) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar; homes: (key, home), a document of each node.

    single: no two rows have one id, so the rows of the wanted ids are the wanted sets, each once.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = checkpoint(nodes.join(homes, "key").select(F.col("home").alias("id"), "key"))
    few = wanted.count() <= WANTED
    ids = wanted.select("id").distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = texts.select("text").mapInArrow(_sets(of, seed), "node long, members binary")
    if not single:
        sets = sets.join(wanted.select(F.col("key").alias("node")), "node", "left_semi").dropDuplicates(["node"])
    sets = checkpoint(sets)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return checkpoint(both.select("a", "b", "x", "y").mapInArrow(_verify(share), "a long, b long"))


def _split(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the large groups that lie in several components, with their roots."""
    rooted = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = checkpoint(rooted.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("token"))
    return checkpoint(rooted.join(split, "token", "left_semi"))


def _across(large: DataFrame, share: tuple[int, int]) -> DataFrame | None:
    """Pairs of one group, of different components, that sizes and places leave possible."""
    if large.isEmpty():
        return None
    x, y = (large.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "place", "root"))) for s in "xy")
    inter = f"ceil((n_x + n_y) * {share[0]} / {sum(share)})"
    pairs = x.join(y, "token").where(
        f"node_x < node_y and root_x <> root_y and least(n_x, n_y) * {share[1]} >= greatest(n_x, n_y) * {share[0]} and place_x <= n_x - {inter} and place_y <= n_y - {inter}"
    )
    return checkpoint(pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")))


def _between(pairs: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Those of the pairs whose sides both are in large groups, in different components."""
    for side in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    pairs = checkpoint(pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    if pairs.isEmpty():
        return None
    members = members.distinct()
    for side in "ab":
        pairs = pairs.join(members.select(F.col("node").alias(side)), side, "left_semi")
    return pairs.select("a", "b")


def cluster(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when share[1] * intersection >= share[0] * union.

    A document's set has its distinct `size`-word shingles, A-Z lower-cased; with fewer words, the whole sequence as one.
    component_id is the smallest id that links reach, its own included. A null or empty text has an empty set and no
    links. A null id is above all others (and stays null if alone); rows of one id are documents of their own. Repeated
    rows are equal documents. A text of any length is one set, read whole. Other columns are not read. No rows give no
    rows.
    """
    return cluster_sets(docs, shingles(size), share, doc_id, text, seed=seed).withColumnRenamed("n_members", "n_shingles")


def cluster_sets(docs: DataFrame, of: Sets, share: tuple[int, int], doc_id: str = "doc_id", text: str = "text", by_length: bool = False, seed: int = 0) -> DataFrame:
    """(doc_id, n_members, component_id) as cluster() gives it, of any sets. by_length: partitioned by set size besides."""
    if not 0 < share[0] <= share[1]:
        raise ValueError("share is a similarity over 0, up to 1")
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text).alias("text"))
    facts = checkpoint(docs.mapInArrow(_facts(of, seed), _FACTS_DDL))
    own = facts.where("kind = 0").select("id", "n", "key", "check")
    nodes = own.where("n > 0").groupBy("key").agg(F.min("id").alias("home"), (F.min("check") != F.max("check")).alias("mixed"))
    nodes = checkpoint(nodes)
    if not nodes.where("mixed").isEmpty():  # two different sets with one 64-bit key
        if seed >= 3:
            raise RuntimeError("different sets have equal keys under four seeds; join fewer documents at once")
        return cluster_sets(docs, of, share, "id", "text", by_length, seed + 1).withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID))).withColumn("component_id", F.nullif("component_id", F.lit(LAST_ID)))
    homes = nodes.select("key", "home")
    single = own.groupBy("id").count().where("count > 1").isEmpty()
    estimate = docs.sparkSession.sparkContext.broadcast(_estimate(facts))
    buckets = block_count(docs)
    prefixes = docs.select("text").mapInArrow(_prefixes(of, seed, share, buckets, estimate, by_length), "bucket int, payload binary")
    found = checkpoint(prefixes.groupBy("bucket").applyInArrow(grouped(_candidates(share)), _PAIRS_DDL))
    sums = found.where("kind = 0").groupBy("a", "b").agg(*(f(c).alias(c) for f, c in ((F.sum, "shared"), (F.min, "need"), (F.sum, "strict"), (F.sum, "lead"))))
    sums = checkpoint(sums)
    tidy(docs.sparkSession)
    # enough in common, or one of the strictly first shingles with the leader of a large group
    tried = F.expr("shared >= need or lead > 0")
    first = sums.where(tried).select("a", "b")
    links = _links(docs, homes, first, of, seed, share, single)
    roots = components(links)
    # A link that was not tried has a shingle among the strictly first ones of both in common, and at least one of a large
    # group further on. Either the former is of a large group as well, or it is of a small one and both are in large ones.
    large = found.where("kind = 1").select("token", F.col("a").alias("node"), "n", "place")
    members = found.where("kind = 2").select(F.col("a").alias("node"))
    tidy(docs.sparkSession)
    # each step is cut off, as what it leaves is little
    rest = [_across(_split(large, roots), share), _between(sums.where(~tried & (F.col("strict") > 0)).select("a", "b"), members, roots)]
    rest = [r for r in rest if r is not None]
    if rest:
        rest = (rest[0].union(rest[1]) if len(rest) > 1 else rest[0]).distinct()
        rest = checkpoint(rest.join(first, ["a", "b"], "left_anti"))  # what was tried in vain isn't tried again
        links = links.union(_links(docs, homes, rest, of, seed, share, single))
        roots = components(links)
    tidy(docs.sparkSession)
    reach = roots.join(homes.withColumnRenamed("key", "node"), "node")
    least = reach.groupBy("root").agg(F.min("home").alias("component_id"))
    named = reach.join(least, "root").select(F.col("node").alias("key"), "component_id")
    named = homes.join(named, "key", "left").select("key", F.coalesce("component_id", "home").alias("component_id"))
    out = own.join(named, (own["key"] == named["key"]) & (own["n"] > 0), "left")
    last = F.lit(LAST_ID)
    return out.select(F.nullif("id", last).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "id"), last).alias("component_id"))
