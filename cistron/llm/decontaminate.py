"""Benchmark decontamination by a broadcast hash set of normalised test n-grams. Column expressions only.

Each distinct window of the test items is filed under its anchor, the longest of its words. The words of a document
are looked up in the set of anchors inside the scan; only the few places that hold one are unfolded, joined with the
windows of that anchor and verified word by word. Texts are never shuffled: what moves is one row of counts for each
document and for each verified occurrence, under the document's id and a digest of its text, so that a task that runs
again finds the same groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, columns, quoted

#: A run of letters, digits and non-ASCII characters, after A-Z became a-z; and the same before that.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows in one broadcast set. Larger benchmarks are matched in as many passes over the documents as they need.
WINDOWS_AT_ONCE = 100_000
#: Digests in a broadcast set of texts to remove or cut; beyond, a shuffle join does the same.
DIGESTS = 1_000_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def windows_of(bench: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, anchor_at, anchor): each item's windows; an item of fewer words is one window, of none has none."""
    words = F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(WORD), F.lit(0))
    items = bench.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("all"))
    items = items.where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words"))
    # longest word, leftmost among equals: the greatest (length, -place)
    best = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"))))
    windows = windows.distinct().withColumn("anchor_at", -best["at"])
    return windows.withColumn("anchor", F.get("words", F.col("anchor_at")))


def _occurrences(docs: DataFrame, windows: DataFrame, anchors: list[str], size: int, first: bool) -> DataFrame:
    """(id, digest, n_words, whole, start, length, items): verified occurrences; on the first pass a row for each document.

    Places of a document: those whose word, fully lower-cased, is an anchor, fully lower-cased; the test of the
    whole window follows with A-Z alone lower-cased, so nothing is lost or added.
    """
    w = F.col("all")
    hit = lambda x: F.lower(x).isin(*anchors) if anchors else F.lit(False)
    places = F.filter(F.transform(w, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())
    around = lambda i: F.struct(i.alias("at"), F.greatest(i - (size - 1), F.lit(0)).alias("from"), F.transform(F.slice(w, F.greatest(i - (size - 2), F.lit(1)), F.least(i, F.lit(size - 1)) + size), ascii_lower).alias("near"))
    found = F.transform(places, around)
    # a null place stands for the document as a whole
    rows = docs.select(*_GROUP, F.explode(F.concat(F.array(F.get(found, F.lit(-1))), found) if first else found).alias("p"))
    rows = rows.select(*_GROUP, F.col("p").isNull().alias("whole"), "p.at", "p.from", "p.near", F.get("p.near", F.col("p.at") - F.col("p.from")).alias("anchor"))
    joined = rows.join(F.broadcast(windows), "anchor", "left")
    begin = F.col("at") - F.col("anchor_at") - F.col("from") + 1
    fits = (begin >= 1) & (F.slice("near", F.greatest(begin, F.lit(1)), F.size("words")) == F.col("words"))
    ok = F.coalesce(fits, F.lit(False))
    out = joined.select(*_GROUP, "whole", F.when(ok, F.col("at") - F.col("anchor_at")).alias("start"), F.when(ok, F.size("words")).alias("length"), F.when(ok, F.col("items")).alias("items"))
    return out.where("whole or start is not null")


_GROUP = ("id", "digest", "n_words")


def digest_of(text: Column) -> Column:
    """128 bits and the length: what stands for a text; the empty string for a null one."""
    return F.concat_ws(":", F.when(text.isNotNull(), F.md5(text)), F.octet_length(text))


def matches(docs: DataFrame, bench: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of documents: doc_id, digest, n_words, hits (ascending distinct word places) and items (distinct)."""
    if size < 1:
        raise ValueError("a window has one word at least")
    found = windows_of(bench, size, item_id, item_text).groupBy("words", "anchor_at", "anchor").agg(F.collect_set("item").alias("items"))
    n = found.count()
    passes = max(1, -(-n // WINDOWS_AT_ONCE))
    if passes > 1:
        found = found.withColumn("pass", F.pmod(F.xxhash64("words"), F.lit(passes)))  # so that no anchor's windows are one pass
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_ANY_CASE), F.lit(0))
    base = docs.select(F.col(doc_id).alias("id"), digest_of(F.col(text)).alias("digest"), words.alias("all")).withColumn("n_words", F.size("all"))
    parts = []
    for k in range(passes):
        windows = (found.where(F.col("pass") == k) if passes > 1 else found).drop("pass")
        # as many words as one pass has windows at most
        anchors = [r[0] for r in windows.select(F.lower("anchor")).distinct().collect()]
        parts.append(_occurrences(base, windows, anchors, size, k == 0))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # before the shuffle one row for each different document and occurrence; equal rows are one group and counted
    span = F.when(F.col("start").isNotNull(), F.struct("start", "length"))
    per_doc = rows.groupBy(*_GROUP).agg(F.count_if("whole").cast("int").alias("copies"), F.collect_set(span).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    out = per_doc.select(F.col("id").alias("doc_id"), "digest", "n_words", hits.alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"), "copies")
    return out.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copies", "copy")


def report(docs: DataFrame, bench: DataFrame, size: int = 10, **names: str) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a window of `size` consecutive item words (shorter items are one window).
    Null and empty texts have no words, null and empty items no windows; an empty benchmark hits nothing. A null item id
    counts as the empty string. Repeated documents are reported each by itself. A text of any length is read whole. Other
    columns are not read. No rows give no rows.
    """
    m = matches(docs, bench, size, **names)
    return m.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, bench: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns as they were, that hold no window. A null or empty text stays."""
    bad = checkpoint(_hit_texts(docs, bench, size, text, item_id, item_text).select("digest").distinct())
    few = bad.count() <= DIGESTS
    packed = docs.select(F.struct(*columns(docs)).alias("row"), digest_of(F.col(quoted(text))).alias("digest"))
    kept = packed.join(F.broadcast(bad) if few else bad, "digest", "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def remove_spans(docs: DataFrame, bench: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with hit words cut out of the text; the other words and what stands between words stay."""
    bad = checkpoint(_hit_texts(docs, bench, size, text, item_id, item_text).groupBy("digest").agg(F.first("hits").alias("hits")))
    few = bad.count() <= DIGESTS // 10
    packed = docs.select(F.struct(*columns(docs)).alias("row"), F.col(quoted(text)).alias("body"), digest_of(F.col(quoted(text))).alias("digest"))
    both = packed.join(F.broadcast(bad) if few else bad, "digest", "left")
    words = F.regexp_extract_all("body", F.lit(WORD_ANY_CASE), F.lit(0))
    gaps = F.split("body", WORD_ANY_CASE, -1)
    kept = F.transform(gaps, lambda g, i: F.concat(g, F.when((i < F.size(words)) & ~F.array_contains("hits", i), F.get(words, i)).otherwise(F.lit(""))))
    cut = F.when(F.col("hits").isNull(), F.col("body")).otherwise(F.array_join(kept, ""))
    return both.select(*((cut if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _hit_texts(docs: DataFrame, bench: DataFrame, size: int, text: str, item_id: str, item_text: str) -> DataFrame:
    """(digest, hits) of texts that hold a window; equal texts are one."""
    own = docs.select(F.lit(0).alias("id"), F.col(quoted(text)).alias("body")).where("body is not null")
    return matches(own, bench, size, doc_id="id", text="body", item_id=item_id, item_text=item_text).where(F.size("hits") > 0)
