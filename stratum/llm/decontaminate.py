"""Benchmark decontamination: word windows of a benchmark's items are found in documents (DataFrame functions only).

A-Z count as a-z, words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A window is n consecutive words of an item, or all
of a shorter one. Every window is a 64-bit hash of its words' hashes and a SHA-256 digest: rows of a fixed size, so
their number bounds what is broadcast. Documents are scanned once: each word is hashed, each place in a document looks its
window's hash up in the broadcast hash set, and a hit is verified by the digest of its words inside the same join.
Texts and words never leave the task; what is written is a row for each document and one for each verified hit.
A set of more than BROADCAST_WINDOWS windows is dealt to several scans by its hashes.

Defined cases: a null or empty text has no words and is not hit; an item without words has no window; repeated rows of the
benchmark, and items with the same id, are one item; an item with a null id marks words but is not listed; null, tied and
repeated ids of documents are rows of their own; an empty table on either side gives no hits; columns of other names,
also such as this module uses, are carried along by `decontaminate`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_once, free_name, materialize

#: Windows of one scan's hash set at most: a hash, a digest and a number, about 100 bytes each.
BROADCAST_WINDOWS = 1_000_000
#: Rows of (window, item) that are broadcast at most; more are shuffled.
BROADCAST_ITEMS = 1_000_000
BREAK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is fast and may be used where all letters are ASCII.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, f"[{BREAK}]+", -1), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _digest(words: Column) -> Column:
    """Words hold no space, so that their joined text tells them apart."""
    return F.unhex(F.sha2(F.array_join(words, " ").cast("binary"), 256))


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables of the different windows (window, size, hash, digest) and of their items (window, item)."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("words"))
    size = F.least(F.lit(n), F.size("words"))
    placed = items.select("item", "words", size.alias("size"), F.posexplode("words").alias("pos", "_")).where(F.col("pos") <= F.size("words") - F.col("size"))
    window = F.slice("words", F.col("pos") + 1, F.col("size"))
    every = materialize(placed.select("item", "size", F.xxhash64(_hashes(window)).alias("hash"), _digest(window).alias("digest")).distinct(), "benchmark-windows")
    different = every.select("size", "hash", "digest").distinct().withColumn("window", F.monotonically_increasing_id())
    different = materialize(different, "different-windows")
    members = every.where("item IS NOT NULL").join(different, ["size", "hash", "digest"]).select("window", "item")
    return different, materialize(members, "window-items")


def _scan(docs: DataFrame, windows: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """row, id, text_hash, n_words, pos and the window found there: verified hits, and for each document its first place."""
    text = F.col(f"`{text_col}`").cast("string")
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    tokens = tokens.select("*", _hashes(F.col("words")).alias("hashes"))
    # Outer: a document without words keeps a row. Words are carried by reference up to the joins, and no further.
    places = tokens.select("*", F.posexplode_outer("hashes").alias("pos", "_"))
    for size in sizes:
        known = F.broadcast(windows.where(F.col("size") == size).select(F.col("hash").alias(f"_h{size}"), F.col("digest").alias(f"_d{size}"), F.col("window").alias(f"_w{size}")))
        here = F.when(F.col("pos") <= F.size("hashes") - size, F.xxhash64(F.slice("hashes", F.col("pos") + 1, size)))
        places = places.withColumn("_here", here)
        same = _digest(F.slice("words", F.col("pos") + 1, size)) == F.col(f"_d{size}")
        places = places.join(known, (F.col("_here") == F.col(f"_h{size}")) & same, "left")
    found = F.array(*(F.struct(F.lit(size).alias("size"), F.col(f"_w{size}").alias("window")) for size in sizes)) if sizes else F.expr("CAST(array() AS array<struct<size: int, window: bigint>>)")
    any_hit = F.coalesce(*(F.col(f"_w{size}") for size in sizes)).isNotNull() if sizes else F.lit(False)
    kept = places.where(F.col("pos").isNull() | (F.col("pos") == 0) | any_hit)
    kept = kept.select("row", "id", "text_hash", F.size("words").cast("long").alias("n_words"), "pos", F.explode_outer(F.filter(found, lambda x: x["window"].isNotNull())).alias("hit"))
    return kept.select("row", "id", "text_hash", "n_words", "pos", "hit.size", "hit.window")


def find_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """Written rows of `_scan` for all windows, in as many scans as the bound `most` asks for."""
    counts = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # n rows at most
    scans = max(1, -(-sum(counts.values()) // most))
    out = None
    for k in range(scans):
        part = windows.where(F.pmod("hash", F.lit(scans)) == k) if scans > 1 else windows
        one = _scan(docs, part, sorted(counts), id_col, text_col)
        out = one if out is None else out.unionByName(one.where("window IS NOT NULL"))
    return materialize(out, "window-hits")


def _covered(hits: DataFrame, key: list[str]) -> DataFrame:
    """hits with the stretch [fresh, fresh_end) of words that no hit before them, by place, covers."""
    earlier = Window.partitionBy(*key).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("size")
    covered = F.coalesce(F.max(end).over(earlier), F.lit(0))
    return hits.select("*", F.greatest("pos", covered).alias("fresh"), end.alias("fresh_end"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_words, n_hit (words in verified windows), n_items, items_sha256 (of the sorted
    ids of items, joined by commas), contaminated, items."""
    windows, members = benchmark_windows(benchmark, n, item_col, item_text_col)
    marked = find_windows(docs, windows, id_col, text_col)
    fresh = F.when(F.col("window").isNotNull(), F.greatest(F.col("fresh_end") - F.col("fresh"), F.lit(0))).otherwise(0)
    rows = _covered(marked, ["row"]).groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.sum(fresh).cast("long").alias("n_hit"))
    few = members.count() <= BROADCAST_ITEMS
    pairs = marked.where("window IS NOT NULL").select("row", "window").distinct().join(F.broadcast(members) if few else members, "window").select("row", "item").distinct()
    listed = pairs.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    items = F.coalesce("items", F.expr("CAST(array() AS array<string>)"))
    out = rows.join(listed, "row", "left")
    return out.select("id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without what is hit: remove='documents' leaves out hit documents; 'spans' takes hit words out of their text,
    each with the separators before it. Texts that are not hit stay as they are, nulls too."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'.")
    windows, _ = benchmark_windows(benchmark, n, item_col, item_text_col)
    hits = find_windows(docs, windows, id_col, text_col).where("window IS NOT NULL")
    hits = hits.select("id", "text_hash", "pos", "size").distinct()
    mark = free_name(docs.columns, "text_hash")
    rows = docs.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    if remove == "documents":
        gone = hits.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        return rows.join(gone, rows[f"`{id_col}`"].eqNullSafe(gone["_id"]) & (rows[mark] == gone["_hash"]), "left_anti").drop(mark)
    stretches = _covered(hits, ["id", "text_hash"]).where("fresh_end > fresh")
    stretches = stretches.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.struct("fresh", "fresh_end"))).alias("_spans"))
    stretches = materialize(stretches, "hit-spans")
    out = rows.join(stretches, rows[f"`{id_col}`"].eqNullSafe(stretches["_id"]) & (rows[mark] == stretches["_hash"]), "left")
    text = F.col(f"`{text_col}`").cast("string")
    # A word with what stands before it; what stands behind the last word stays.
    pieces = F.regexp_extract_all(text, F.lit(f"[{BREAK}]*[^{BREAK}]+"), F.lit(0))
    tail = F.regexp_extract(text, f"[{BREAK}]*\\z", 0)
    gone = F.flatten(F.transform(stretches["_spans"], lambda s: F.sequence(s["fresh"], s["fresh_end"] - 1)))
    left = bound_once(pieces, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone), lambda k: F.get(p, k)), ""))
    cleaned = F.when(stretches["_spans"].isNull(), F.col(f"`{text_col}`")).otherwise(F.concat(left, tail))
    return out.select(*(cleaned.alias(c) if c == text_col else rows[f"`{c}`"] for c in docs.columns))
