"""Best-fit packing of documents into sequences, by exact complements.

A document is its ids and an end id. Only one longer than a sequence is cut, into whole sequences behind a first piece
with the rest. Packing needs lengths only, and there are at most `capacity` different ones: so the plan is made on the
driver from the histogram of lengths, whatever the number of documents, and says for each run of pieces of one length
which sequences they go to. An index of sums says for the gap behind the largest length left which single, pair or triple
of lengths fills it exactly; that combination is consumed as often as the counts allow. Lengths without such a complement
are residuals: the largest length that fits goes into the gap (the best fit), and the smaller gap is looked up again.

Pieces are numbered by a range partitioning over (length, id, piece), so a length that a third of all pieces share is
no hot key, and each piece finds its place by binary search in the plan.

Defined cases: a null text counts as empty and is one end id; null ids are numbered first; rows that tie in their id
are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import number_rows
from .byte_tokens import ByteTokens
from .common import materialize, text_arrays

CAPACITY, END_ID = 2048, 0


class SumIndex:
    """Sums of one, two and three lengths, under counts of how many pieces of each length are left.

    Singles are the counts themselves. For every sum, `larger` holds the larger length of the pair that can be taken
    most often (-1: no pair is left), and a triple is a single whose rest to the sum has a pair. Counts only fall, so a sum
    that has lost its pairs never gets one again, and an entry is looked at anew only when it is asked for.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.larger = np.full(len(counts), -1, np.int64)
        for total in range(2, len(counts)):
            self._find(total)

    def _times(self, total: int, left: np.ndarray) -> np.ndarray:
        """How often each pair (total - a, a), a = 1, 2, ..., can be taken."""
        a = np.arange(1, total // 2 + 1)
        times = np.minimum(left[a], left[total - a])
        if total % 2 == 0:
            times[-1] = left[total // 2] // 2
        return times

    def _find(self, total: int) -> None:
        times = self._times(total, self.left)
        k = int(np.argmax(times))
        self.larger[total] = total - k - 1 if times[k] > 0 else -1

    def _pair(self, total: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """A pair with that sum, besides the lengths already taken."""
        if total < 2 or self.larger[total] < 0:
            return None
        self._find(total)
        a = int(self.larger[total])
        if a < 0:
            return None
        if taken.count(a) or taken.count(total - a):  # the counts may not hold both
            left = self.left.copy()
            np.subtract.at(left, list(taken), 1)
            times = self._times(total, np.maximum(left, 0))
            k = int(np.argmax(times))
            return (total - k - 1, k + 1) if times[k] > 0 else None
        return a, total - a

    def complement(self, gap: int, taken: tuple[int, ...] = (), widest: int = 3) -> tuple[int, ...] | None:
        """Up to `widest` (1 to 3) lengths whose sum is exactly gap, besides those taken; none for a gap of 0."""
        if gap == 0:
            return ()
        if self.left[gap] > taken.count(gap):
            return (gap,)
        if widest == 1:
            return None
        if found := self._pair(gap, taken):
            return found
        if widest == 2:
            return None
        for c in np.flatnonzero((self.left[1:gap] > 0) & (self.larger[gap - 1 : 0 : -1] >= 0))[::-1] + 1:
            c = int(c)
            if self.left[c] > taken.count(c) and (found := self._pair(gap - c, (*taken, c))):
                return (c, *found)
        return None

    def largest(self, most: int, taken: tuple[int, ...]) -> int:
        """The largest length up to most of which a piece is left, or 0."""
        for length in np.flatnonzero(self.left[: most + 1])[::-1]:
            if self.left[length] > taken.count(int(length)):
                return int(length)
        return 0

    def take(self, pattern: tuple[int, ...]) -> int:
        """Takes a pattern as often as the counts allow; returns how often."""
        lengths, need = np.unique(pattern, return_counts=True)
        times = int((self.left[lengths] // need).min())
        self.left[lengths] -= need * times
        return times


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths that share a sequence, and how many sequences are filled so; counts[l]: pieces of length l.

    Where pieces over half a sequence abound, pairs and triples use up small pieces of which each could close a sequence
    of its own; so a plan that consumes only single complements is made too, and the one with fewer sequences is taken.
    """
    return min((_patterns(counts, capacity, widest) for widest in (3, 1)), key=lambda plan: sum(n for _, n in plan))


def _patterns(counts: np.ndarray, capacity: int, widest: int) -> list[tuple[tuple[int, ...], int]]:
    sums = SumIndex(counts)
    patterns: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while sums.left[length] > 0 and (found := sums.complement(capacity - length, (length,), widest)) is not None:
            pattern = (length, *found)
            patterns.append((pattern, sums.take(pattern)))
    while length := sums.largest(capacity, ()):  # residuals: the best fit, then the smaller gap is looked up
        pattern = (length,)
        while gap := capacity - sum(pattern):
            more = sums.complement(gap, pattern, widest)
            if more is None:
                best = sums.largest(gap, pattern)
                if not best:
                    break
                more = (best,)
            pattern += more
        patterns.append((pattern, sums.take(pattern)))
    return [(tuple(sorted(pattern, reverse=True)), times) for pattern, times in patterns]


@dataclass(frozen=True)
class Plan:
    """Runs of piece numbers, in order of (length, id, piece): where each begins, its length, how many pieces of it
    each sequence takes, the first sequence, and the first one's offset in it."""

    begins: np.ndarray
    length: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.begins, number, "right") - 1
        at = number - self.begins[run]
        return self.sequence[run] + at // self.each[run], self.offset[run] + at % self.each[run] * self.length[run]


def make_plan(counts: np.ndarray, capacity: int) -> Plan:
    next_number = np.concatenate(([0], np.cumsum(counts)))[:-1]
    runs, sequences = [], 0
    for pattern, times in plan_patterns(counts, capacity):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            runs.append((int(next_number[length]), length, each, sequences, offset))
            next_number[length] += each * times
            offset += each * length
        sequences += times
    table = np.asarray(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every row's ids: id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(slim.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens.at(tokenizer_path)
        for batch in batches:
            for at, end, texts in text_arrays(batch, 1):
                ids, bounds = tokens.encode(texts)
                length = np.diff(bounds) + 1
                pieces = -(-length // capacity)
                first = length - (pieces - 1) * capacity
                row = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                size = np.where(piece == 0, first[row], capacity)
                ended = np.insert(ids, bounds[1:], end_id).astype("<u4")
                base = (bounds[:-1] + np.arange(len(texts)))[row] + start
                cuts = [ended[a:b].tobytes() for a, b in zip(base, base + size)]
                columns = [batch.column(0).slice(at, end - at).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                if with_ids:
                    flat = np.frombuffer(b"".join(cuts), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return slim.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with the sequence and the offset in it that each goes to."""
    # Written first: a range partitioning looks at its input twice.
    numbered = number_rows(materialize(pieces, "pieces"), ["length", "id", "piece", "ids_crc32"], "number")
    counts = np.zeros(capacity + 1, np.int64)
    for row in numbered.groupBy("length").count().collect():  # as many rows as there are lengths
        counts[row["length"]] = row["count"]
    plan = make_plan(counts, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(number: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = numbered.withColumn("place", place("number"))
    return placed.select("id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place_pieces(token_pieces(docs, tokenizer_path, capacity, end_id, False, id_col, text_col), capacity)


def packed_sequences(docs: DataFrame, places: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the offset at which each piece begins.

    Wants ids that name a row each. A sequence has at most `capacity` ids, so no group is large.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, True, id_col, text_col).drop("length", "ids_crc32", "start")
    joined = pieces.join(places.select("id", "piece", "sequence_id", "offset"), ["id", "piece"])
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = joined.groupBy("sequence_id").agg(one.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("begins"))
