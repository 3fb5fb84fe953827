"""Importance resampling towards a target distribution of hashed word features.

Features are all runs of 1 to n consecutive words, joined by one space; a feature's bucket is its bytes' crc32 modulo the
number of buckets. One scan of a text keeps the running zlib states of its last n starts in a ring: each word extends
every state by a space and itself, opens a state of its own, and all states are emitted. What a scan emits is written,
two bytes a feature (four beyond 65,536 buckets); counts and weights are read from there, so no text is scanned twice.

A bucket's gain is floor(1000 * ln(ratio)), the ratio that of the smoothed frequencies in the target and in docs; a
document's weight is the floored mean of its features' gains. Gumbel noise from a hash of the id turns weights into
scores whose highest are a sample without replacement. Counts are arrays of buckets in each task, summed by bucket; the
gains, a number for each bucket, are all that passes through the driver. Ranks come from a range partitioning by score.

Defined cases: a null or empty text has no features, weight 0, and is never eligible if words are asked for; a null id is
hashed as an empty text and comes last among ties; rows that tie in score and id are ranked in some order, each
with a rank of its own; an empty target has no counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import number_rows
from .common import free_name, materialize, text_blocks

#: A-Z to a-z; [0-9a-z] and all bytes from 0x80 are word bytes, others become spaces.
_FOLD = bytes(c + 32 if chr(c) in string.ascii_uppercase else c if c >= 0x80 or chr(c) in string.ascii_lowercase + string.digits else 32 for c in range(256))


def crc_ring(words: list[bytes], n: int) -> list[int]:
    """The crc32 of every run of 1 to n words joined by spaces, by where the runs end; of one end the longest first."""
    out: list[int] = []
    ring: list[int] = []
    for word in words:
        if len(ring) == n:
            del ring[0]
        if ring:
            more = b" " + word
            ring = [crc32(more, state) for state in ring]
        ring.append(crc32(word))
        out += ring
    return out


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def feature_buckets(docs: DataFrame, n: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written row for each row of docs: row, id (text), n_words, n_features and the packed buckets of its features."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, flat, offsets in text_blocks(batch, 3):
                # Texts follow each other without a space, so each is folded and cut by itself.
                folded, words, found, ends = flat.tobytes().translate(_FOLD), [], [], [0]
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = folded[a:b].split()
                    words.append(len(own))
                    found += crc_ring(own, n)
                    ends.append(len(found))
                packed = (np.fromiter(found, np.int64, len(found)) % buckets).astype(_kind(buckets))
                bounds = np.asarray(ends, np.int64)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds * packed.itemsize), pa.py_buffer(packed)]).cast(pa.binary())
                columns = [batch.column(k).slice(at, end - at) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(np.diff(bounds)), binary], names=["row", "id", "text_hash", "n_words", "n_features", "buckets"])

    return materialize(slim.mapInArrow(scan, "row long, id string, text_hash long, n_words long, n_features long, buckets binary"), "feature-buckets")


def bucket_counts(features: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): how many features are in each bucket that has any. A task sends a row for each of its buckets at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            # The texts of a batch are counted together: all buckets for each document would be most of the work.
            packed = b"".join(x.as_buffer() for x in batch.column(0))
            total += np.bincount(np.frombuffer(packed, _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    counted = features.where("n_features > 0").select("buckets").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Of each bucket; 0 where no document has a feature in it."""
    rows = source.join(target, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")).collect()  # a row for each bucket at most
    all_s, all_t = sum(r["s"] for r in rows), target.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    gains = np.zeros(buckets, np.int64)
    for r in rows:
        ratio = float(r["t"] + 1) * float(all_s + buckets) / (float(r["s"] + 1) * float(all_t + buckets))
        gains[r["bucket"]] = math.floor(1000 * math.log(ratio))
    return gains


def importance_scores(
    docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text",
) -> DataFrame:
    """A row for each row of docs: id (text), text_hash, n_words, n_features, weight, score, rank.

    Of the documents with at least min_words words, percent of them (rounded down) are drawn: those with the highest
    scores, ranked from 1, ties by ascending id; others have no rank.
    """
    features = feature_buckets(docs, n, buckets, id_col, text_col)
    aims = feature_buckets(target, n, buckets, target_id_col, target_text_col)
    source = materialize(bucket_counts(features, buckets, "s"), "source-counts")
    gains = bucket_gains(source, materialize(bucket_counts(aims, buckets, "t"), "target-counts"), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(4).to_numpy()
            total = [int(gains[np.frombuffer(x.as_buffer(), _kind(buckets))].sum()) for x in batch.column(5)]
            weights = np.asarray(total, np.int64) // np.maximum(lengths, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(weights)], names=["row", "id", "text_hash", "n_words", "n_features", "weight"])

    weighed = features.mapInArrow(weigh, "row long, id string, text_hash long, n_words long, n_features long, weight long")
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    uniform = (hashed.cast("double") + 0.5) / 4294967296.0
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("long"))
    number = docs.schema[id_col].dataType.simpleString()
    scored = materialize(scored.select("*", (F.col("n_words") >= min_words).alias("_in"), (-F.col("score")).alias("_down"), F.col("id").isNull().alias("_no_id"), F.col("id").cast(number).alias("_id")), "scores")
    drawn = percent * scored.where("_in").count() // 100
    numbered = number_rows(scored.where("_in"), ["_down", "_no_id", "_id", "row"], "_number")
    columns = ["id", "text_hash", "n_words", "n_features", "weight", "score"]
    ranked = numbered.select(*columns, F.when(F.col("_number") < drawn, F.col("_number") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where("NOT _in").select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of docs with all their columns, in no order. Rows that tie in id and text are drawn together."""
    drawn = importance_scores(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    drawn = materialize(drawn.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "drawn")
    mark = free_name(docs.columns, "text_hash")
    rows = docs.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    return rows.join(drawn, rows[f"`{id_col}`"].cast("string").eqNullSafe(drawn["_id"]) & (rows[mark] == drawn["_hash"]), "left_semi").drop(mark)
