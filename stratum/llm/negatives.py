"""Hard negatives for contrastive training: for each anchor and positive, the best rows of other labels inside a band.

Vectors are scaled to integers, so scores (inner products) are exact and ties are true ties. Anchors are held against all
rows in blocks: rows are dealt to slices, and each block of anchors meets each slice; a task holds one block of either at
a time. Of each anchor and block all scores are computed and sorted by score and id. A first pass keeps an anchor's
best rows of its own label, merged over blocks; a second one finds, by binary search, where scores come under a
positive's upper limit, and reads the next different-label rows as long as they are above the lower limit. What is
merged over blocks is a few rows for each anchor and block.

Defined cases: rows with a null label or vector, or with a null or non-finite component take no part; vectors of
different lengths are not compared; a null id is never an anchor unless the caller says so, and comes after all other ids
among ties; repeated rows are rows of their own, in an order that is fixed once they are written; an anchor
without positives, a positive without negatives, and an empty table give no rows; a component whose scaled value
leaves no room for 64-bit scores stops the query with a message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block of rows or of anchors.
BLOCK_ROWS = 4096
#: Rows of a slice of the table and of a group of anchors at most.
SLICE_ROWS = 1 << 16
_BLOCK = "slice int, dim int, n int, vectors binary, ids binary, no_id binary, labels binary, rows binary"
_LAST = np.iinfo(np.int64).max


def valid_vectors(data: DataFrame, anchor: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Written rows that take part: row, id, label, is_anchor, vector (of integers)."""
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    x = F.col(f"`{vector_col}`")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = data.where(F.col(f"`{label_col}`").isNotNull() & x.isNotNull() & ~bad)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), whole.alias("vector"))
    return materialize(rows, "vectors")


def _packed(rows: DataFrame, slices: int, extra: list[str] | None = None) -> DataFrame:
    """Rows dealt to slices and packed to blocks of one slice and vector length, sorted by id; extra: array columns."""
    extra = extra or []
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")).withColumn("dim", F.size("vector"))
    dealt = dealt.repartition(slices, "slice").sortWithinPartitions("slice", "dim", F.col("id").asc_nulls_last(), "row")
    dealt = dealt.select("slice", "dim", "id", "label", "row", "vector", *extra)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                for s in range(a, b, BLOCK_ROWS):
                    part = batch.slice(s, min(BLOCK_ROWS, b - s))
                    ids = part.column(2)
                    flat = part.column(5).flatten().to_numpy()
                    if len(flat) and len(flat) // part.num_rows * int(np.abs(flat).max()) ** 2 >= 1 << 62:
                        raise ValueError("scaled components are too large for 64-bit scores")
                    small = np.int16 if not len(flat) or np.abs(flat).max() < 1 << 15 else np.int64
                    values = [flat.astype(small), ids.fill_null(_LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(3).to_numpy(), part.column(4).to_numpy()]
                    arrays = [pa.array([int(keys[0, a])], pa.int32()), pa.array([int(keys[1, a])], pa.int32()), pa.array([part.num_rows], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)]
                    for k, name in enumerate(extra, 6):
                        lists = part.column(k)
                        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                        arrays += [pa.array([counts.tobytes()], pa.binary()), pa.array([lists.flatten().to_numpy().astype(np.int64).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*(c.split()[0] for c in _BLOCK.split(", ")), *(f"{name}_{kind}" for name in extra for kind in ("n", "flat"))])

    schema = _BLOCK + "".join(f", {name}_n binary, {name}_flat binary" for name in extra)
    return dealt.mapInArrow(pack, schema)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, exact: in floating point where every partial sum fits its mantissa."""
    bound = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)


class _Block:
    def __init__(self, record: dict, prefix: str = ""):
        dim, n = record[prefix + "dim"], record[prefix + "n"]
        raw = record[prefix + "vectors"]
        self.vectors = np.frombuffer(raw, np.int16 if len(raw) == 2 * dim * n else np.int64).astype(np.int64).reshape(n, dim)
        self.ids, self.labels, self.rows = (np.frombuffer(record[prefix + k], np.int64) for k in ("ids", "labels", "rows"))
        self.no_id = np.frombuffer(record[prefix + "no_id"], bool)
        self.n = n


def _meetings(anchors: DataFrame, rows: DataFrame, slices: int, groups: int) -> DataFrame:
    """Every block of anchors with every block of rows, by slice of rows and group of anchors.

    Each side is copied for the other's parts: groups of anchors for a row, slices for an anchor. Both counts follow from
    SLICE_ROWS, and a part meets another in one task.
    """
    named = lambda df, p: df.select("slice", *(F.col(c).alias(p + c) for c in df.columns if c != "slice"))
    left = named(anchors, "a_").withColumnRenamed("slice", "group").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = named(rows, "r_").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    on = (left["slice"] == right["slice"]) & (left["group"] == right["group"]) & (left["a_dim"] == right["r_dim"])
    # Blocks are few and large: the shuffle that brings a pair of parts together is stated, not left to a broadcast.
    return left.join(right.hint("merge"), on).drop("slice", "group")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block, dict]]:
    for batch in batches:
        for k in range(batch.num_rows):
            record = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            yield _Block(record, "a_"), _Block(record, "r_"), record


def _by_score(scores: np.ndarray) -> np.ndarray:
    """Places in descending order of score, ties by id: rows of a block stand in the order of their ids."""
    return np.lexsort((np.arange(len(scores)), -scores))


def _positives(meetings: DataFrame, most: int) -> DataFrame:
    """anchor_row, score, id and row of an anchor's best rows of its own label, by block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, _ in _each(batches):
            parts = []
            for label in np.intersect1d(a.labels, r.labels):
                mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(r.labels == label)
                scores = _scores(a.vectors[mine], r.vectors[theirs])
                for k, i in enumerate(mine):
                    order = _by_score(scores[k])
                    order = order[r.rows[theirs[order]] != a.rows[i]][:most]
                    at = theirs[order]
                    parts.append((np.full(len(at), a.rows[i]), scores[k][order], at))
            if parts:
                anchor, score, at = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(score), pa.array(r.ids[at], mask=r.no_id[at]), pa.array(r.rows[at])], names=["anchor_row", "score", "id", "row"])

    found = meetings.mapInArrow(find, "anchor_row long, score long, id long, row long")
    best = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def _negatives(meetings: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """anchor_row, place (of the positive), score, id and row of its best rows inside the band, by block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, record in _each(batches):
            counts, flat = np.frombuffer(record["a_scores_n"], np.int64), np.frombuffer(record["a_scores_flat"], np.int64)
            ends = np.cumsum(counts)
            scores = _scores(a.vectors, r.vectors)
            parts = []
            for i in range(a.n):
                order = _by_score(scores[i])
                order = order[r.labels[order] != a.labels[i]]
                falling = -scores[i][order]
                for place, positive in enumerate(flat[ends[i] - counts[i] : ends[i]].tolist()):
                    upper, lower = high * positive // 100, -(-low * positive // 100)
                    first = np.searchsorted(falling, -upper, "left")
                    end = min(first + most, np.searchsorted(falling, -lower, "right"))
                    at = order[first:end]
                    if len(at):
                        parts.append((np.full(len(at), a.rows[i]), np.full(len(at), place), scores[i][at], at))
            if parts:
                anchor, place, score, at = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(place, pa.int32()), pa.array(score), pa.array(r.ids[at], mask=r.no_id[at]), pa.array(r.rows[at])], names=["anchor_row", "place", "score", "id", "row"])

    found = meetings.mapInArrow(find, "anchor_row long, place int, score long, id long, row long")
    best = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def hard_negatives(
    data: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors. An anchor's positives are its `positives` highest-scored other rows of its label; the
    negatives of each are the first `negatives` different-label rows with low * positive_score <= 100 * score <= high *
    positive_score, ranked from 1 by descending score, ties by smaller id.
    """
    rows = valid_vectors(data, anchor, scale, id_col, vector_col, label_col)
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_anchor"), 1))).first()
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Slices are as many as there are tasks, as long as they are not tiny, and more where they would be large.
    slices = max(-(-n // SLICE_ROWS), min(tasks, -(-n // 1024)), 1)
    groups = max(-(-n_anchors // SLICE_ROWS), 1)
    blocks = materialize(_packed(rows, slices), "row-blocks")
    anchors = rows.where("is_anchor")
    found = materialize(_positives(_meetings(_packed(anchors, groups), blocks, slices, groups), positives), "positives")
    scores = found.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    blocked = materialize(_packed(anchors.join(scores, "row"), groups, ["scores"]), "anchor-blocks")
    mined = _negatives(_meetings(blocked, blocks, slices, groups), negatives, low, high)
    of = found.select("anchor_row", (F.col("place") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    who = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    out = mined.join(of, ["anchor_row", "place"]).join(who, "anchor_row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
