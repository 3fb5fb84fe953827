"""Exact dedup of whole texts, with frequent texts split off (DataFrame functions only).

Texts are equal when they are identical after each run of [\\x20\\x09-\\x0D] is replaced by one space. One slim
table of digests is written. A Misra-Gries summary over it (DataFrame.freqItems) names every digest that holds
more than `support` of the rows, and perhaps others; exact counts verify the names. The verified winners are at
most 1/support rows, so they are broadcast and their rows settled map-side, without a shuffle of the hot groups.
All other groups hold at most `support` of the rows: they are counted map-side and joined to their rows by digest.

Defined cases: a null text counts as empty; among equal texts the smallest id stays, a null id comes after all
others; rows that tie in both text and id are one group, and exactly one of them stays; an empty table gives
an empty result; other columns, whatever their names, are carried along by `drop_exact_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

SUPPORT = 0.001


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normal_text(text).cast("binary"), 256)


def heavy_hitters(digests: DataFrame, column: str, support: float = SUPPORT) -> DataFrame:
    """Every value of column with more than support of the rows, and up to 1/support in all: (column)."""
    found = digests.stat.freqItems([column], support)
    return found.select(F.explode(f"{column}_freqItems").alias(column))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each row of docs: id, digest (lowercase hex), keep_id, group_size, kept."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("digest"))
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "exact-digests")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    named = F.broadcast(heavy_hitters(slim, "digest", support))
    winners = slim.join(named, "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    winners = materialize(winners, "exact-winners")  # 1/support rows at most
    hot = slim.join(F.broadcast(winners), "digest").select("id", "digest", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))
    rest = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Counted map-side and joined back, so that no group has to fit one task.
    groups = rest.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    rest = rest.join(groups, "digest").select("id", "digest", "row", "first", "group_size")
    return hot.unionByName(rest.select("id", "digest", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """docs without the rows that are copies of a row that stays; columns as they were."""
    groups = exact_groups(docs, id_col, text_col, support).where("group_size > 1")
    groups = materialize(groups.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")), "exact-drop")
    digest, known = free_name(docs.columns, "text_sha256"), free_name(docs.columns, "copy_number")
    rows = docs.withColumn(digest, text_digest(F.col(f"`{text_col}`")))
    gone, tied = groups.where("NOT _kept"), groups.where("_kept AND _n > 1")
    match = lambda g: rows[f"`{id_col}`"].eqNullSafe(g["_id"]) & (rows[digest] == g["_digest"])
    # Shuffled whatever its size: what a run moves then follows its input.
    gone, tied = gone.hint("merge"), tied.hint("merge")
    out = rows.join(gone, match(gone), "left_anti")
    if not tied.isEmpty():  # rows that tie in id and text: one of them stays
        several = out.join(tied, match(tied), "left_semi")
        one = several.withColumn(known, F.row_number().over(Window.partitionBy(f"`{id_col}`", digest).orderBy(digest))).where(F.col(known) == 1).drop(known)
        out = out.join(tied, match(tied), "left_anti").unionByName(one)
    return out.drop(digest)
