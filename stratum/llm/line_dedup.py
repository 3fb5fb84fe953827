"""Removal of boilerplate lines by the number of distinct sites that show them (DataFrame functions only).

Every line is a pair of hashes. Sites are counted by a HyperLogLog sketch for each line hash, merged by aggregation, so
a line of any number of documents is small before it is shuffled. Only where a sketch's estimate is so near the
threshold that its error could decide, the exact number of distinct sites is counted, after (line, site) pairs are made
distinct map-side. Lines shown by at least `sites` sites are removed from every document.

One slim table of line hashes is written, so texts are split once and shuffled once. Tables of lines are joined by
Spark, which broadcasts a written one under the session's limit and shuffles others, splitting skewed partitions.

Lines are compared without the white space around them; lines of white space only are kept and not counted. Defined
cases: a null text counts as empty; a null site is no site; null and tied ids are told apart by their text, and rows
that tie in both have the same lines; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_once, free_name, materialize

#: Sketches have 2**LG_K registers; their standard error is 1.04 / sqrt(2**LG_K).
LG_K = 12
SPACE = " \t\x0b\x0c\r\n"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _line_hashes(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, text_hash, site, pos, a, b of each line that is not white space."""
    text = F.col(f"`{text_col}`").cast("string")
    trimmed = F.transform(_lines(text), lambda x: F.btrim(x, F.lit(SPACE)))
    hashed = F.transform(trimmed, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(f"`{site_col}`").cast("string").alias("site"), F.posexplode_outer(hashed).alias("pos", "line"))
    return rows.where("line IS NOT NULL").select("id", "text_hash", "site", "pos", "line.a", "line.b")


def boilerplate_lines(lines: DataFrame, sites: int) -> DataFrame:
    """(a, b) of the lines (a, b, site) that at least `sites` distinct sites show."""
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("site").alias("times"))
    seen = sketched.where(F.col("times") >= sites).select("a", "b", F.hll_sketch_estimate("sketch").alias("estimate"))
    margin = 1 + math.ceil(4 * 1.04 / math.sqrt(1 << LG_K) * sites)
    seen = materialize(seen.where(F.col("estimate") >= sites - margin), "line-sites")
    far = seen.where(F.col("estimate") > sites + margin).select("a", "b")
    near = seen.where(F.col("estimate") <= sites + margin).select("a", "b")
    pairs = lines.where("site IS NOT NULL").join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct()
    return far.unionByName(pairs.groupBy("a", "b").count().where(F.col("count") >= sites).select("a", "b"))


def remove_boilerplate(docs: DataFrame, sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of the text, and two columns more: n_lines and n_removed."""
    n_lines, n_removed = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_removed")
    mark = free_name(docs.columns, "text_hash")
    lines = materialize(_line_hashes(docs, id_col, text_col, site_col), "lines")
    common = materialize(boilerplate_lines(lines, sites), "boilerplate")
    hits = lines.join(common, ["a", "b"], "left_semi").groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("pos").alias("_gone"))
    hits = materialize(hits, "line-hits")
    text = F.col(f"`{text_col}`")
    rows = docs.withColumn(mark, F.xxhash64(text.cast("string")))
    # Shuffled whatever its size: what a run moves then follows its input.
    out = rows.join(hits.hint("merge"), rows[f"`{id_col}`"].eqNullSafe(hits["_id"]) & (rows[mark] == hits["_hash"]), "left")
    # Positions come in ascending order from the sequence, so the lines stay in their order.
    left = bound_once(_lines(text), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), hits["_gone"]), lambda k: F.get(lines, k)), "\n"))
    cleaned = F.when(hits["_gone"].isNull(), text).otherwise(left)
    return out.select(
        *(cleaned.alias(c) if c == text_col else rows[f"`{c}`"] for c in docs.columns),
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias(n_lines),
        F.coalesce(F.size(hits["_gone"]), F.lit(0)).cast("long").alias(n_removed),
    )
