"""Least squares of groups as mergeable orthogonal factors: stable for large means and nearly collinear regressors.

A factor of some rows [x1 .. xk y] holds their number, their means and the triangle R of a QR decomposition of the rows less
those means. Factors of two sets of rows merge: their triangles, with a row for how far apart the means lie, are
decomposed again. Nothing is squared, so no digits are lost to large means or to a bad condition. Each task reduces its
rows to one factor for each group and sends those; a second step merges them as a stream, sorted by group, so a group
of any size costs a task one factor for each task before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task gathers before it decomposes them, and groups whose factors it holds at once.
GATHERED, HELD = 1 << 17, 1 << 14
_EPS = np.finfo(float).eps
#: Least ratio of the singular values of regressors, each of length 1, that are not collinear.
COLLINEAR = 1e-13


class Factors:
    """Of many groups, in the order of their codes: rows and complete rows, means (groups, p), triangles (groups, p, p)."""

    def __init__(self, rows: np.ndarray, n: np.ndarray, means: np.ndarray, r: np.ndarray):
        self.rows, self.n, self.means, self.r = rows, n, means, r

    @classmethod
    def of_rows(cls, code: np.ndarray, values: np.ndarray, groups: int, centred: bool) -> Factors:
        """values: rows of numbers; a row with a missing one only counts."""
        full = ~np.isnan(values).any(axis=1)
        rows = np.bincount(code, minlength=groups)
        code, values = code[full], values[full]
        order = np.argsort(code, kind="stable")
        code, values = code[order], values[order]
        n = np.bincount(code, minlength=groups)
        p = values.shape[1]
        means, r = np.zeros((groups, p)), np.zeros((groups, p, p))
        some, start = np.flatnonzero(n), (np.cumsum(n) - n)
        if len(some) and centred:
            means[some] = np.add.reduceat(values, start[some]) / n[some, None]
            values = values - means[code]
            rest = np.add.reduceat(values, start[some]) / n[some, None]  # what the first means have missed
            means[some] += rest
            moved = np.zeros_like(means)
            moved[some] = rest
            values = values - moved[code]
        for g in some:
            r[g] = _triangle(values[start[g] : start[g] + n[g]])
        return cls(rows, n, means, r)

    @classmethod
    def merged(cls, code: np.ndarray, parts: Factors, groups: int, centred: bool) -> Factors:
        """Factors of groups from those of parts of them."""
        order = np.argsort(code, kind="stable")
        code, rows, n, means, r = code[order], parts.rows[order], parts.n[order], parts.means[order], parts.r[order]
        p = means.shape[1]
        count = np.bincount(code, minlength=groups)
        start = np.cumsum(count) - count
        out = cls(np.zeros(groups, np.int64), np.zeros(groups, np.int64), np.zeros((groups, p)), np.zeros((groups, p, p)))
        for g in np.flatnonzero(count):
            own = slice(start[g], start[g] + count[g])
            out.rows[g], out.n[g] = rows[own].sum(), n[own].sum()
            used = np.flatnonzero(n[own]) + start[g]
            if len(used) == 1:
                out.means[g], out.r[g] = means[used[0]], r[used[0]]
            elif len(used):
                stacked = r[used].reshape(-1, p)
                if centred:
                    first = means[used[0]]
                    mean = first + ((means[used] - first) * n[used, None]).sum(axis=0) / out.n[g]
                    stacked = np.concatenate((stacked, (means[used] - mean) * np.sqrt(n[used])[:, None]))
                    out.means[g] = mean
                out.r[g] = _triangle(stacked)
        return out

    def solve(self, intercept: bool) -> dict[str, np.ndarray]:
        """Coefficients (the constant first), standard errors, R2 and adjusted R2 of each group; NaN where undefined.

        Regressors that are collinear beyond machine precision get the least-norm solution.
        """
        p = self.r.shape[1]
        k = p - 1
        inner, cross, rest = self.r[:, :k, :k], self.r[:, :k, k], self.r[:, k, k] ** 2
        n, mx, my = self.n.astype(float), self.means[:, :k], self.means[:, k]
        size = k + intercept
        whole, right = np.zeros((len(n), size, size)), np.zeros((len(n), size))
        whole[:, intercept:, intercept:], right[:, intercept:] = inner, cross
        if intercept:
            root = np.sqrt(n)
            whole[:, 0, 0], whole[:, 0, 1:], right[:, 0] = root, root[:, None] * mx, root * my
        beta, se = np.full((len(n), size), np.nan), np.full((len(n), size), np.nan)
        has = np.flatnonzero(n > 0)
        if len(has) and size:
            length = np.linalg.norm(whole[has], axis=1)
            length[length == 0] = 1
            values = np.linalg.svd(whole[has] / length[:, None, :], compute_uv=False)
            solid = (values[:, -1] > COLLINEAR * values[:, 0]) & (n[has] >= size)
            for full in (True, False):
                at = has[solid == full]
                if not len(at):
                    continue
                if full:
                    # The regressors by themselves, each of length 1: means do not enter.
                    scale = np.linalg.norm(inner[at], axis=1)
                    scale[scale == 0] = 1
                    inverse = np.linalg.inv(inner[at] / scale[:, None, :]) / scale[:, :, None] if k else np.zeros((len(at), 0, 0))
                    slope = np.einsum("gij,gj->gi", inverse, cross[at])
                    spread = (inverse**2).sum(axis=2)
                    if intercept:
                        beta[at, 0] = my[at] - (mx[at] * slope).sum(axis=1)
                        first = 1 / n[at] + (np.einsum("gi,gij->gj", mx[at], inverse) ** 2).sum(axis=1)
                        spread = np.concatenate((first[:, None], spread), axis=1)
                    beta[at, intercept:] = slope
                else:
                    inverse = np.stack([np.linalg.pinv(whole[g], rcond=_EPS * max(n[g], size)) for g in at])
                    beta[at] = np.einsum("gij,gj->gi", inverse, right[at])
                    spread = (inverse**2).sum(axis=2)
                    left = right[at] - np.einsum("gij,gj->gi", whole[at], beta[at])
                    rest[at] = rest[at] + (left**2).sum(axis=1)
                with np.errstate(all="ignore"):
                    dof = n[at] - size
                    se[at] = np.sqrt(spread * (rest[at] / np.where(dof > 0, dof, np.nan))[:, None])
        with np.errstate(all="ignore"):
            total = (cross**2).sum(axis=1) + self.r[:, k, k] ** 2
            r2 = 1 - rest / np.where(total > 0, total, np.nan)
            dof = n - size
            adjusted = 1 - (1 - r2) * (n - 1 if intercept else n) / np.where(dof > 0, dof, np.nan)
        return {"coef": beta, "se": se, "r2": r2, "adj_r2": adjusted}


def _triangle(rows: np.ndarray) -> np.ndarray:
    p = rows.shape[1]
    out = np.zeros((p, p))
    # Columns of one length each: a large one then hides no digits of a small one.
    scale = np.abs(rows).max(axis=0, initial=0)
    scale[scale == 0] = 1
    r = np.linalg.qr(rows / scale, mode="r")
    out[: len(r)] = r * scale
    return out


def _codes(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's combination of keys, NULL being a key like others, and a row of each combination."""
    code = np.zeros(n, np.int64)
    for c in columns:
        own = pc.dictionary_encode(c, null_encoding="encode")
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _record(keys: list[pa.Array], f: Factors, names: list[str]) -> pa.RecordBatch:
    p = f.means.shape[1]
    lists = lambda a, w: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * w), pa.array(a.reshape(-1)))
    return pa.RecordBatch.from_arrays([*keys, pa.array(f.rows), pa.array(f.n), lists(f.means, p), lists(f.r.reshape(len(f.n), -1), p * p)], names=names)


def _factors_of(columns: list[pa.Array], p: int) -> Factors:
    number = lambda c: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
    rows, n, means, r = map(number, columns)
    return Factors(rows.to_numpy(), n.to_numpy(), means.flatten().to_numpy().reshape(-1, p), r.flatten().to_numpy().reshape(-1, p, p))


def group_fits(data: DataFrame, keys: list[str], y: Column, xs: list[Column], intercept: bool) -> DataFrame:
    """keys, _rows, _n (complete rows), _fit (coef, se, r2, adj_r2): a row for each group. xs: without the constant."""
    p, k = len(xs) + 1, len(keys)
    named = [f"_k{i}" for i in range(k)]
    values = [c.cast("double").alias(f"_v{i}") for i, c in enumerate([*xs, y])]
    slim = data.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, named)), *values)
    kinds = [slim.schema[n] for n in named]
    factor = T.StructType([*kinds, T.StructField("_rows", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_means", T.ArrayType(T.DoubleType())), T.StructField("_r", T.ArrayType(T.DoubleType()))])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # factors of this task so far
        waiting: list[pa.RecordBatch] = []

        def gather() -> None:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            columns = [table.column(i).combine_chunks() for i in range(k)]
            code, first = _codes(columns, table.num_rows)
            numbers = np.column_stack([table.column(i).cast(pa.float64()).fill_null(np.nan).to_numpy() for i in range(k, k + p)])
            f = Factors.of_rows(code, numbers, len(first), intercept)
            held.append(_record([c.take(pa.array(first)) for c in columns], f, factor.names))

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= GATHERED:
                gather()
                if sum(b.num_rows for b in held) > HELD:
                    yield from _merge(held, k, p, intercept, factor.names)
                    held.clear()
        if waiting:
            gather()
        if held:
            yield from _merge(held, k, p, intercept, factor.names)

    fit = "coef array<double>, se array<double>, r2 double, adj_r2 double"
    solved = T.StructType([*kinds, factor["_rows"], factor["_n"], *T._parse_datatype_string(fit).fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(record: pa.RecordBatch) -> pa.RecordBatch:
            f = _factors_of(record.columns[k:], p)
            s = f.solve(intercept)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1), from_pandas=True))
            return pa.RecordBatch.from_arrays([*record.columns[: k + 2], lists(s["coef"]), lists(s["se"]), pa.array(s["r2"], from_pandas=True), pa.array(s["adj_r2"], from_pandas=True)], names=solved.names)

        last: list[pa.RecordBatch] = []
        for batch in batches:
            for record in _merge([*last, batch], k, p, intercept, factor.names):
                # The last group may go on in the next batch.
                last = [record.slice(record.num_rows - 1)]
                if record.num_rows > 1:
                    yield put(record.slice(0, record.num_rows - 1))
        if not (k or last):  # the whole table is a group, even without rows
            zeros = Factors(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, p)), np.zeros((1, p, p)))
            last = [_record([], zeros, factor.names)]
        for record in last:
            yield put(record)

    parts = slim.mapInArrow(reduced, factor)
    parts = parts.repartition(*named).sortWithinPartitions(*named) if keys else parts.repartition(1)
    out = parts.mapInArrow(finish, solved)
    return out.select(*(F.col(n).alias(c) for n, c in zip(named, keys)), "_rows", "_n", F.struct("coef", "se", "r2", "adj_r2").alias("_fit"))


def _merge(records: list[pa.RecordBatch], k: int, p: int, centred: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Factors of equal keys made one; groups in the order in which they come first."""
    table = pa.Table.from_batches(records)
    if not table.num_rows:
        return
    columns = [table.column(i).combine_chunks() for i in range(k)]
    code, first = _codes(columns, table.num_rows)
    place = np.argsort(np.argsort(first))
    f = Factors.merged(place[code], _factors_of(table.columns[k:], p), len(first), centred)
    yield _record([c.take(pa.array(np.sort(first))) for c in columns], f, names)
