"""Quality rules: bands of compression ratios, of whole texts and of fixed chunks.

A ratio is the zstandard-compressed size over the size in bytes. Repeating text compresses to little, noise hardly at
all, and short texts compress worse than long ones, so the limits of a text depend on its length: the band of the
largest `from_bytes` not above it holds. A text is rejected when its whole ratio is outside its band, or when more than
`bad_chunks` of its bytes lie in chunks outside the band of their own length.

Where the default limits come from: `high` lies above the labelled good texts of sf0.1 (quality 1, base rules passed, even
doc_id: 1,608 rows; the odd ones test it) and 99 % of slices of licences and readmes, and below noise of 8-letter words as
soon as the length lets it: 6 bits a letter (base64) from 200 bytes, 4.7 bits (a-z) from 1,500, 4 bits (hex) from 3,000.
Shorter noise compresses like prose and stays. `low` lies at about the 1 % quantile of slices of Python's library, which
compress far better than prose; README has the misses and false rejections. The entropy of letters is that of ASCII, so
texts and chunks with more than a quarter of other bytes (other scripts) are held against `high_other`.

Defined cases: a null text counts as empty; an empty text, or one shorter than the first band, has no ratio to fail
(the base rules judge it); rows are judged one by one, so ties and repeated rows make no difference; an empty table gives
an empty result; a new column gets underscores behind its name where a kept column has that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_blocks
from .textscan import HEAD, Scan, repeated, run_starts, salted, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Band:
    from_bytes: int
    low: float
    high: float
    high_other: float


@dataclass(frozen=True)
class CompressionLimits:
    """Bands by length in bytes, in ascending order. chunk: bytes of the fixed chunks."""

    bands: tuple[Band, ...] = (
        Band(100, 0.45, 0.97, 0.97), Band(150, 0.42, 0.95, 0.97), Band(200, 0.40, 0.90, 0.97), Band(300, 0.37, 0.84, 0.85), Band(450, 0.34, 0.78, 0.85),
        Band(700, 0.31, 0.70, 0.85), Band(1000, 0.28, 0.66, 0.75), Band(1500, 0.25, 0.60, 0.75), Band(2000, 0.25, 0.58, 0.75), Band(3000, 0.25, 0.525, 0.75),
        Band(4000, 0.22, 0.51, 0.70), Band(6000, 0.22, 0.49, 0.70), Band(8000, 0.22, 0.47, 0.70), Band(16000, 0.20, 0.45, 0.66), Band(40000, 0.20, 0.43, 0.66),
    )
    chunk: int = 2048
    bad_chunks: float = 0.25
    level: int = 3


def _bands(limits: CompressionLimits, size: np.ndarray, ratio: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which ratios are outside the band of their size; other: bytes that are not ASCII."""
    at = np.searchsorted([b.from_bytes for b in limits.bands], size, "right") - 1
    low, high, high_other = (np.asarray([getattr(b, k) for b in limits.bands]) for k in ("low", "high", "high_other"))
    return (at >= 0) & ((ratio < low[at]) | (ratio > np.where(4 * other > size, high_other[at], high[at])))


def compression(flat: np.ndarray, offsets: np.ndarray, limits: CompressionLimits) -> dict[str, np.ndarray]:
    """ratio (NaN without bytes), bad_chunk_share and outside_band of each text."""
    press, data, n = zstandard.ZstdCompressor(level=limits.level), memoryview(np.ascontiguousarray(flat)), len(offsets) - 1
    size = np.diff(offsets)
    others = np.concatenate(([0], np.cumsum(flat >= 128)))
    ratio = np.full(n, np.nan)
    for k in np.flatnonzero(size):
        ratio[k] = len(press.compress(data[offsets[k] : offsets[k + 1]])) / size[k]
    pieces = -(-size // limits.chunk)
    of = np.repeat(np.arange(n), pieces)
    start = offsets[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * limits.chunk
    end = np.minimum(start + limits.chunk, offsets[of + 1])
    each = np.asarray([len(press.compress(data[a:b])) for a, b in zip(start, end)], float)
    bad = _bands(limits, end - start, each / np.maximum(1, end - start), others[end] - others[start])
    share = np.bincount(of, weights=(end - start) * bad, minlength=n) / np.maximum(1, size)
    return {"ratio": ratio, "bad_chunk_share": share, "outside_band": _bands(limits, size, ratio, np.diff(others[offsets])) | (share > limits.bad_chunks)}


def base_counts(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of words, of characters in words, of symbols, of repeated lines and of words in repeated 8-word windows."""
    scan = Scan(flat, offsets)
    n_words = np.diff(scan.word_offsets)
    start, end, of = scan.lines()
    has_word = np.searchsorted(scan.word_start, end) > np.searchsorted(scan.word_start, start)
    start, end, of = start[has_word], end[has_word], of[has_word]
    again = repeated(salted(scan.hashes(start, end), of), "first")
    starts, of_run = run_starts(scan.word_offsets, 8)
    words = scan.words()
    twice = starts[repeated(salted(windows(words, 8)[starts], of_run), False)] if len(starts) else starts
    edge = np.zeros(len(words) + 9, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 8, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[: len(words)] > 0)))
    return {
        "n_words": n_words,
        "word_chars": scan.count(scan.solid & HEAD[flat]),
        "n_symbols": scan.count(SYMBOLS[flat]),
        "n_dup_lines": np.bincount(of[again], minlength=scan.n),
        "n_repeat_words": covered[scan.word_offsets[1:]] - covered[scan.word_offsets[:-1]],
    }


def base_failed(n: dict[str, np.ndarray]) -> np.ndarray:
    return (n["n_words"] < 20) | (100 * n["n_repeat_words"] > 30 * n["n_words"])


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, compression_ratio double, bad_chunk_share double"


def judge_texts(df: DataFrame, keep: list[str], text_col: str = "text", limits: CompressionLimits = CompressionLimits()) -> DataFrame:
    """The columns of keep, then the counts, ratios and verdicts on each row's text."""
    names = [f"_c{k}" for k in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, flat, offsets in text_blocks(batch, len(names)):
                n, found = base_counts(flat, offsets), compression(flat, offsets, limits)
                failed = base_failed(n)
                new = [pa.array(n[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                new += [pa.array(failed), pa.array(~failed & ~found["outside_band"]), pa.array(found["ratio"], from_pandas=True), pa.array(found["bad_chunk_share"])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, end - at) for k in range(len(names))), *new], names=[*names, *(x.split()[0] for x in VERDICT.split(", "))])

    out = rows.mapInArrow(judge, ", ".join([*(f"{n} {kinds[n]}" for n in names), VERDICT]))
    taken = list(keep)
    for name in (x.split()[0] for x in VERDICT.split(", ")):
        taken.append(free_name(taken, name))
    return out.toDF(*taken)


def keep_good(docs: DataFrame, text_col: str = "text", limits: CompressionLimits = CompressionLimits()) -> DataFrame:
    """docs without the rows whose text the rules reject; columns as they were. Only texts go to Python, only verdicts back."""

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        batch, found = pa.RecordBatch.from_arrays([texts], names=["text"]), []
        for _, _, flat, offsets in text_blocks(batch, 0):
            n, outside = base_counts(flat, offsets), compression(flat, offsets, limits)["outside_band"]
            found.append(~base_failed(n) & ~outside)
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(good(F.col(f"`{text_col}`").cast("string")))
