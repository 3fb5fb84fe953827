"""Sharding by a keyed permutation of global row numbers: a reproducible shuffle whose places can be computed.

Rows are numbered 0..n-1 in the order of their id. A balanced Feistel network over 2k bits, with 4**k >= n, permutes
the numbers; a number that lands outside 0..n-1 walks on along its cycle until it lands inside, which is again a
permutation of 0..n-1. Permuted number p goes to shard p % shards, slot p // shards: counts of shards are at most one
apart, slots have no gaps, and `row_of` inverts the place without any table.

Defined cases: a null text counts as no bytes; null ids are numbered first; rows that tie in their id are numbered
by their text's crc and size, and beyond that in any order (they are the same row); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import number_rows

ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    mask, keys = _U((1 << bits) - 1), _mix(np.arange(ROUNDS, dtype=np.uint64) + _U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    left, right = x >> _U(bits), x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left + key) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key) & mask)
    return (left << _U(bits)) | right


def permute(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Where each of numbers, all in 0..n-1, lands in the permutation of 0..n-1; back: the inverse."""
    bits, out = _half_bits(n), np.asarray(numbers).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        out[walking] = _rounds(out[walking], bits, seed, back)
        walking = walking[out[walking] >= _U(n)]
    return out.astype(np.int64)


def row_of(shard: np.ndarray, slot: np.ndarray, shards: int, n: int, seed: int = 0) -> np.ndarray:
    """The global row number in a slot of a shard."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The place of each row of docs: id, size (UTF-8 bytes and 16), text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slim = number_rows(slim, ["id", "text_crc32", "size"])
    n = slim.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = slim.withColumn("place", place("row_number"))
    return placed.select("id", "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))
