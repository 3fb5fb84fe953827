"""Least squares over rolling windows of rows, at a cost that does not grow with the window.

A series is cut into blocks as long as the window. A window then is the end of one block and the beginning of the next, so
its sums are one suffix sum and one prefix sum: no differences of long running sums, and nothing is added up twice.
Both are taken about the mean of the later block, so that large or drifting levels do not cancel digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _products(v: np.ndarray) -> np.ndarray:
    """Of rows of p numbers: the numbers, and their products i <= j."""
    p = v.shape[-1]
    i, j = np.triu_indices(p)
    return np.concatenate((v, v[..., i] * v[..., j]), axis=-1)


def window_sums(values: np.ndarray, length: int, centred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, over the last `length` rows: their number, the reference taken off, and the sums of `_products`."""
    m, p = values.shape
    size = min(length, m)
    blocks = -(-m // size)
    padded = np.zeros((blocks * size, p))
    padded[:m] = values
    shaped = padded.reshape(blocks, size, p)
    reference = np.zeros((blocks, 1, p))
    if centred:
        count = np.full(blocks, size)
        count[-1] = m - (blocks - 1) * size
        reference[:, 0] = shaped.sum(axis=1) / count[:, None]
    sums = np.cumsum(_products(shaped - reference), axis=1).reshape(blocks * size, -1)[:m]
    at = np.arange(m)
    first = np.maximum(at - length + 1, 0)
    two = np.flatnonzero(first % size) if blocks > 1 else at[:0]
    if len(two):
        before = _products(shaped[:-1] - reference[1:])
        suffix = np.cumsum(before[:, ::-1], axis=1)[:, ::-1].reshape((blocks - 1) * size, -1)
        sums[two] += suffix[first[two]]
    return at - first + 1, np.repeat(reference[:, 0], size, axis=0)[:m], sums


def window_fits(values: np.ndarray, length: int, least: int, intercept: bool) -> np.ndarray:
    """Coefficients (the constant first) of the last column on the others over the last `length` rows; NaN with fewer than
    `least` rows or a singular window."""
    m, p = values.shape
    k = p - 1
    out = np.full((m, k + intercept), np.nan)
    if not m:
        return out
    n, reference, sums = window_sums(values, length, intercept)
    first, second = sums[:, :p], np.zeros((m, p, p))
    i, j = np.triu_indices(p)
    second[:, i, j] = second[:, j, i] = sums[:, p:]
    size = np.einsum("mii->mi", second)[:, :k]
    if intercept:
        second = second - first[:, :, None] * first[:, None, :] / n[:, None, None]
    spread = np.einsum("mii->mi", second)[:, :k]
    solid = (n >= least) & (spread > 1e-13 * size).all(axis=1)
    at = np.flatnonzero(solid)
    scale = np.sqrt(spread[at])
    inner = second[at, :k, :k] / scale[:, :, None] / scale[:, None, :]
    cross = second[at, :k, k] / scale
    if k > 1:
        full = np.linalg.eigvalsh(inner)[:, 0] > 1e-13
        at, scale, inner, cross = at[full], scale[full], inner[full], cross[full]
        slope = np.linalg.solve(inner, cross[:, :, None])[:, :, 0] / scale if len(at) else np.zeros((0, k))
    else:
        slope = cross / scale
    out[at, intercept:] = slope
    if intercept:
        mean = first[at] / n[at, None] + reference[at]
        out[at, 0] = mean[:, k] - (mean[:, :k] * slope).sum(axis=1)
    return out


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; NULL equals NULL."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    both = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return both | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def stream_fits(keys: int, length: int, least: int, intercept: bool):
    """A function for mapInArrow: of sorted rows (key columns, id, date, halo, regressors, y) those that are no halo, with
    id, date and coef. A series may go on over batches: what is carried are its last length - 1 complete rows."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        carried: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            series = [batch.column(c) for c in range(keys + 1)]
            cuts = np.flatnonzero(np.logical_or.reduce([_changes(c) for c in series])) + 1 if batch.num_rows > 1 else []
            values = np.column_stack([c.cast(pa.float64()).fill_null(np.nan).to_numpy() for c in batch.columns[keys + 3 :]])
            full = ~np.isnan(values).any(axis=1)
            coef = np.full((batch.num_rows, values.shape[1] - 1 + intercept), np.nan)
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                now = [c[int(a)].as_py() for c in series] if a == 0 or b == batch.num_rows else None
                own = np.flatnonzero(full[a:b]) + a
                rows = values[own]
                if a == 0 and last is not None and now == last:
                    rows = np.concatenate((carried, rows))
                coef[own] = window_fits(rows, length, least, intercept)[len(rows) - len(own) :]
                if b == batch.num_rows:
                    last, carried = now, rows[max(0, len(rows) - length + 1) :]
            shown = pc.invert(batch.column(keys + 2))
            flat = pa.array(coef.reshape(-1), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * coef.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(keys), batch.column(keys + 1), lists], names=["_id", "_date", "_coef"]).filter(shown)

    return fit
