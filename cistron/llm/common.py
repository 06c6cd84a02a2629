"""What the operators of this subpackage share: checkpoints, blocks of documents and packed arrays."""

from __future__ import annotations

import ctypes
import gc
import math
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside the operators: such rows come after all others.
LAST_ID = 2**63 - 1
#: Text bytes in one block of documents; a block is what one Python call holds (one document at least).
BLOCK_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that spark.checkpoint.dir names.

    Without that setting an own folder serves where executors share the driver's machine; elsewhere it is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Between rounds: what no round needs any more becomes garbage, on which Spark's cleaner removes shuffle files and checkpoints."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until `df` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def grouped(run: Callable) -> Callable:
    """A function on groups that gives its freed memory back when it ends."""

    def f(key, table):
        out = run(key, table)
        release()
        return out

    return f


def cogrouped(run: Callable) -> Callable:
    def f(key, left, right):
        out = run(key, left, right)
        release()
        return out

    return f


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks so that one holds about `block_bytes` of text, from the exact size of the whole table."""
    total, rows = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    return max(1, math.ceil(((total or 0) + 64 * rows) / block_bytes))


def in_blocks(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(block, id, text): a document's block follows from its id alone, so each phase finds the same blocks.

    whole: with all other columns in a struct `row`, so that no name clashes.
    """
    key = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(blocks)).cast("int")
    rest = [F.struct(*(F.col(quoted(c)) for c in docs.columns if c != text)).alias("row")] if whole else []
    return docs.select(key.alias("block"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), *rest)


def ordered(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows by (id, text): ids as given, ids with nulls as LAST_ID, the texts' bytes, their offsets."""
    release()
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])
    table = table.take(order)
    given = table.column("id").combine_chunks()
    ids = np.asarray(given.fill_null(LAST_ID), dtype=np.int64)
    data, offsets = utf8(table.column("text"))
    return given, ids, data, offsets


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings (null: empty)."""
    column = column.cast(pa.large_binary())
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.fill_null(b"")
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Give freed memory back to the system: Python workers stay between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of one column, one row at least."""
    release()
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, z - a)
        a = z


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in the narrowest type that holds it."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(k for k in "BHIQ" if top < 1 << (8 * struct.calcsize(f"={k}")))
        out += [struct.pack("=cI", kind.encode(), len(a)), a.astype(np.dtype(kind.replace("I", "u4").replace("Q", "u8").replace("H", "u2").replace("B", "u1"))).tobytes()]
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        kind, n = struct.unpack_from("=cI", payload, at)
        at += 5
        width = struct.calcsize(f"={kind.decode()}")
        out.append(np.frombuffer(payload, dtype=f"u{width}", count=n, offset=at).astype(np.uint64 if width == 8 else np.int64))
        at += n * width
    return out


def unsigned(ids: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def deltas(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as the first one and differences, for pack()."""
    return ascending[:1], np.diff(ascending, prepend=ascending[:1])


def summed(base: np.ndarray, differences: np.ndarray) -> np.ndarray:
    """The numbers that deltas() took apart."""
    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64) + base.astype(np.uint64) if len(base) else np.zeros(0, np.uint64)


def split_by(bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Indices of each bucket's elements in their order, for the buckets that have some."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[bounds[b] : bounds[b + 1]]) for b in np.flatnonzero(np.diff(bounds))]


def alike(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, group and size of equal pairs (hash, check), as np.unique gives them; groups in order of the hash."""
    _, first, group, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if len(hashes) and (checks != checks[first][group]).any():  # different ones with one hash
        order = np.lexsort((checks, hashes))
        fresh = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
        rank = np.empty(len(hashes), dtype=np.int64)
        rank[order] = np.cumsum(np.insert(fresh, 0, False))
        _, first, group, count = np.unique(rank, return_index=True, return_inverse=True, return_counts=True)
    return first, group, count


def find(hashes: np.ndarray, checks: np.ndarray, known: np.ndarray, known_checks: np.ndarray) -> np.ndarray:
    """Place of each pair (hash, check) in a table with ascending hashes, -1 if it has none."""
    at, out = np.searchsorted(known, hashes), np.full(len(hashes), -1, dtype=np.int64)
    left = np.flatnonzero(at < len(known))
    while len(left):
        left = left[known[at[left]] == hashes[left]]
        hit = known_checks[at[left]] == checks[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < len(known)]
    return out


def is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """values in the ascending array `among`, without sorting `values`."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def kept_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, keep: np.ndarray, gap: int = 0x20) -> Iterator[bytes]:
    """Each document's kept units (words or lines, each followed by a byte that is none), joined by the byte `gap`."""
    data = data.copy()
    mark = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(mark, starts[keep], 1)
    np.subtract.at(mark, ends[keep], 1)
    mask = np.cumsum(mark)[:-1] > 0
    kept = np.flatnonzero(keep)
    bounds = np.searchsorted(kept, firsts)  # kept units before each document
    last = np.zeros(len(kept), dtype=bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    gaps = ends[kept[~last]]
    mask[gaps] = True
    data[gaps] = gap
    out = data[mask].tobytes()
    sizes = np.concatenate(([0], np.cumsum((ends - starts)[kept])))
    lengths = np.concatenate(([0], np.cumsum(np.diff(sizes[bounds]) + np.maximum(np.diff(bounds) - 1, 0))))
    for a, z in zip(lengths[:-1], lengths[1:], strict=True):
        yield out[a:z]
