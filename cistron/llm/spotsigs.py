"""SpotSigs fingerprints: chains of content words that follow common words.

Common words of prose (the anchors) are the places where a signature starts; it has the anchor and the next CHAIN
content words, so boilerplate without prose leaves few signatures. A fingerprint is the set of a text's signatures;
fingerprints are compared by Jaccard similarity, which their lengths bound from above: sets whose lengths are too far
apart for the asked-for similarity are passed over, and a comparison ends where the rest can't reach it.

near_groups() joins all fingerprints: they are partitioned by length, so that similar ones are in one class of lengths or
in neighbouring ones, met by their rarest signatures within a class, and compared by pruned Jaccard. Equal fingerprints are
one from the start, signatures that many have are met through leaders and components (see ngram_join).

For the likeness to the next document, documents go to ranges of ids of equal size, each with a copy of the first
document of the range after it; a text is shuffled once, compressed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ngram_join
from .common import BLOCK_BYTES, LAST_ID, block_count, checkpoint, grouped, is_in, release, slices
from .hashing import ASCII_LOWER, mix, span_hashes, spans

#: Anchors: very common words of English, German, French and Spanish, lower-case.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his if in is it its not of on or she that the their they this to was we were which will with you",
    "als am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht sich sie sind um und von war wie wir zu zum zur",
    "au aux avec ce ces cette dans des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous",
    "al como con de del el ella en era es esta este fue ha hay la las lo los más me mi muy no o para pero por que se ser si sin son su sus un una y ya",
)
#: Content words in a signature, at most.
CHAIN = 3
#: Ranges of ids cut by one list of bounds; the ranges of a larger table are cut within those.
MOST_BOUNDS = 1000
#: First ids of ranges that are broadcast; more are joined by a shuffle.
MOST_HEADS = 100_000
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, near_group long"


def _codes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(np.frombuffer(b"".join(words), dtype=np.uint8), ends - [len(w) for w in words], ends)


_COMMON = np.unique(_codes(sorted({w.encode() for line in ANCHORS for w in line.split()})))


def _chains(codes: np.ndarray, starts: np.ndarray, rest: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word at each place of `starts` and the next CHAIN words of `rest` before `end`, and whether one is."""
    k = np.searchsorted(rest, starts, side="right")
    padded = np.concatenate([rest, np.full(CHAIN, np.iinfo(np.int64).max)])
    out = mix(codes[starts])
    some = padded[k] < end
    for j in range(CHAIN):
        at = padded[k + j]
        word = np.where(at < end, codes[np.minimum(at, len(codes) - 1)], np.uint64(0))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out, some


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all texts and the text of each.

    A text without any signature, but with words, has all of its words as anchors.
    """
    docs = len(offsets) - 1
    data = ASCII_LOWER[data]
    starts, ends, firsts = spans(data, offsets, _BREAK)
    codes = span_hashes(data, starts, ends)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    common = is_in(codes, _COMMON)
    doc = np.repeat(np.arange(docs), np.diff(firsts))
    places = np.flatnonzero(common)
    hashes, some = _chains(codes, places, np.flatnonzero(~common), firsts[1:][doc[places]])
    hashes, of = hashes[some], doc[places[some]]
    bare = (np.bincount(of, minlength=docs) == 0)[doc]
    if bare.any():
        places = np.flatnonzero(bare)
        more, _ = _chains(codes, places, np.arange(len(codes)), firsts[1:][doc[places]])
        hashes, of = np.concatenate([hashes, more]), np.concatenate([of, doc[places]])
    return hashes, of


def signature_sets(data: np.ndarray, offsets: np.ndarray, seed: int) -> list[np.ndarray]:
    """Each text's distinct signatures as ascending 64-bit numbers, for the join."""
    hashes, of = _hashes(data, offsets)
    if seed:
        hashes = mix(hashes + np.uint64(seed))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.insert((hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]), 0, True)[: len(of)]
    hashes, of = hashes[fresh], of[fresh]
    bounds = np.searchsorted(of, np.arange(len(offsets)))
    return [hashes[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def near_groups(docs: DataFrame, share: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_members, component_id): documents whose fingerprints have this Jaccard similarity or more are linked.

    component_id is the smallest id that links reach; a text without signatures is linked with nothing. Nulls, repeated
    rows and empty tables as in ngram_join.cluster().
    """
    return ngram_join.cluster_sets(docs, signature_sets, share, doc_id, text, by_length=True)


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct signatures of each text as ascending 32-bit numbers."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    hashes, of = _hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    packed = np.unique((of.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    bounds = np.searchsorted(packed, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def fingerprint(signature: np.ndarray) -> str:
    """Number of signatures and the signatures, in hexadecimal."""
    return f"{len(signature):x}:{signature.astype('>u4').tobytes().hex()}"


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two ascending sets, 0 if below `least`; two empty sets are equal."""
    few, many = sorted((x, y), key=len)
    if not len(many):
        return 1.0
    if len(few) < least * len(many) or not len(few):
        return 0.0
    # in blocks: give up when all of what is left in common can't reach `least`
    inter, step = 0, max(256, len(few)) if least == 0 else 256
    for a in range(0, len(few), step):
        inter += int(is_in(few[a : a + step], many).sum())
        best = inter + max(0, len(few) - a - step)
        if best < least * (len(few) + len(many) - best):
            return 0.0
    value = inter / (len(few) + len(many) - inter)
    return value if value >= least else 0.0


def edit(text: str, after: str) -> str:
    """The last half of the code points replaced by as many first ones of `after`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed; ranges as they are."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in (part for whole in batches for part in slices(whole)):
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        body = [codec.compress(t, asbytes=True) for t in texts]
        columns = [*(batch.column(c) for c in ("part", "id", "copy")), pa.array([len(t) for t in texts], pa.int64()), pa.array(body, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "id", "copy", "size", "body"])
    release()


def _range(key: tuple, table: pa.Table) -> pa.Table:
    """Fingerprints of one range of ids, whose last text is a copy of the next range's first one; `copy` 2 are groups."""
    groups = table.filter(pc.equal(table.column("copy"), 2))
    group_of = dict(zip(groups.column("id").to_pylist(), groups.column("near").to_pylist(), strict=True))
    table = table.filter(pc.less(table.column("copy"), 2))
    codec = pa.Codec("zstd")
    texts = [codec.decompress(b, decompressed_size=n, asbytes=True) for b, n in zip(table.column("body").to_pylist(), table.column("size").to_pylist(), strict=True)]
    table = table.append_column("text", pa.array(texts, pa.large_binary()))
    table = table.take(pc.sort_indices(table, sort_keys=[("copy", "ascending"), ("id", "ascending"), ("text", "ascending")]))
    texts = [t.decode() for t in table.column("text").to_pylist()]
    n = pc.sum(pc.equal(table.column("copy"), 0)).as_py() or 0
    edited = [edit(a, b).encode() for a, b in zip(texts[:n], texts[1 : n + 1], strict=True)]
    own = signatures([t.encode() for t in texts[: n + 1]])
    changed = signatures(edited)
    ids = table.column("id").slice(0, n)
    return pa.table(
        {
            "doc_id": ids,
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            "fingerprint": pa.array([fingerprint(s) for s in own[:n]], pa.string()),
            "edited_fingerprint": pa.array([fingerprint(s) for s in changed], pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own[:n], changed, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own[:n], own[1 : n + 1], strict=True)], pa.float64()),
            "n_signatures": pa.array([len(s) for s in own[:n]], pa.int64()),
            "near_group": pa.array([group_of.get(i) for i in ids.to_pylist()], pa.int64()),
        }
    )


def _cut(rows: DataFrame, ranges: int) -> Callable[[DataFrame], DataFrame]:
    """What adds `part` to rows with an id: ranges of ids of about equal weight, in order of the ids.

    A table of more than MOST_BOUNDS ranges is cut in two steps. Bounds are rows, fixed by checkpoints as quantiles aren't
    the same when taken again.
    """
    none = F.array().cast("array<bigint>")
    coarse = min(MOST_BOUNDS, ranges)
    fine = -(-ranges // coarse)

    def bounds(df, n: int) -> DataFrame:
        shares = [k / n for k in range(1, n)]
        return checkpoint(df.agg((F.coalesce(F.array_distinct(F.percentile_approx("id", shares, 20 * n)), none) if shares else none).alias("bounds")))

    place = F.size(F.filter("bounds", lambda b: b <= F.col("id"))).cast("long")
    first = bounds(rows, coarse)  # one row
    by_first = lambda df: df.crossJoin(F.broadcast(first)).withColumn("part", place).drop("bounds")
    if fine == 1:
        return by_first
    second = bounds(by_first(rows).groupBy("part"), fine)  # MOST_BOUNDS rows at most
    return lambda df: by_first(df).join(F.broadcast(second), "part").withColumn("part", F.col("part") * fine + place).drop("bounds")


def _ranges_before(heads: DataFrame) -> DataFrame:
    """(id, to): of each range's first id, the range before it; of the first range the last one.

    Ranges are numbered within groups of as many as there are groups, so that no task has all of them.
    """
    last = heads.agg(F.max("part").alias("last"))
    most = last.first()["last"]
    group = F.floor(F.col("part") / (math.isqrt(most) + 1)).alias("group")
    within = Window.partitionBy("group").orderBy("part")
    rows = heads.select("id", "part", group).withColumn("to", F.lag("part").over(within))
    ends = rows.groupBy("group").agg(F.max("part").alias("end"))  # the root of the number of ranges
    ends = ends.select("group", F.coalesce(F.lag("end").over(Window.orderBy("group")), F.lit(most)).alias("end"))
    return rows.join(ends, "group").select("id", F.coalesce("to", "end").alias("to"))


def compare_with_next(docs: DataFrame, groups: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness, and that to the next document.

    The edited text has its last floor(n / 2) code points replaced by as many first ones of the next document by id (after
    the last comes the first). A null or empty text is empty; likeness of two empty fingerprints is 1. A null id comes
    last; rows of one id are ordered by text. A single document is its own next one. A text of any length is read whole.
    Other columns are not read. No rows give no rows.

    groups: what near_groups() returns of the same documents; near_group is then the document's component_id (of rows of
    one id the least).
    """
    last_id = F.lit(LAST_ID)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), last_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = _cut(docs, block_count(docs, "text", block_bytes))
    rows = cut(docs)
    # the first document of each range, and the range before it (of the first one the last)
    heads = checkpoint(rows.groupBy("part").agg(F.min("id").alias("id")))
    if heads.isEmpty():
        return docs.sparkSession.createDataFrame([], RESULT)
    few = heads.count() <= MOST_HEADS
    firsts = rows.select("id", "text", "part").join(F.broadcast(heads.select("id")) if few else heads.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    to = _ranges_before(heads)
    copies = firsts.join(to, "id").select("id", "text", F.col("to").alias("part"), F.lit(1).alias("copy"))
    both = rows.select("id", "text", "part", F.lit(0).alias("copy")).unionByName(copies)
    both = both.mapInArrow(_packed, "part long, id long, copy int, size long, body binary").withColumn("near", F.lit(None).cast("long"))
    if groups is not None:
        named = groups.groupBy(F.coalesce("doc_id", last_id).alias("id")).agg(F.min(F.coalesce("component_id", last_id)).alias("near"))
        both = both.unionByName(cut(named).withColumn("copy", F.lit(2)), allowMissingColumns=True)
    out = both.groupBy("part").applyInArrow(grouped(_range), RESULT)
    return out.withColumns({c: F.nullif(c, last_id) for c in ("doc_id", "near_group")})
