"""What the text operators share: written intermediate tables, names, Arrow blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete_path, materialize, shared_path, written  # noqa: F401  the operators take them from here

#: Bytes of text that a task handles at once in flat arrays (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row. A column that stands inside the lambda of a higher-order function
    is computed again for every element; the lambda's own argument is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, or wanted with underscores if the caller's columns (in any case) have that name."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def text_blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch's text column into blocks of some bytes: (first row, end row, UTF-8 bytes, offsets from 0).

    Nulls count as empty texts.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, flat[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def text_arrays(batch: pa.RecordBatch, column: int, limit: int = 2 * BLOCK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """The same blocks, larger, as Arrow arrays without nulls: (first row, end row, texts)."""
    texts = batch.column(column).cast(pa.string()).fill_null("")
    for at, end, _, _ in text_blocks(batch, column, limit):
        yield at, end, texts.slice(at, end - at)


def text_lists(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """The same blocks as Python strings: (first row, end row, texts)."""
    for at, end, _, _ in text_blocks(batch, column, limit):
        yield at, end, [t or "" for t in batch.column(column).slice(at, end - at).to_pylist()]
