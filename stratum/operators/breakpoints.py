"""Breakpoints of a sorting variable, and the portfolio of each row."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import inner_name, require_columns, table_function
from ..functions.quantile import distribution, distribution_quantiles, linspace, quantiles
from ..options import check_breakpoint_options, roles

#: Added to every breakpoint but the first. It only moves a breakpoint of 0, which 0 itself then stays below.
SHIFT, TOP_SHIFT = 1e-20, 1e-15


def _probabilities(options: dict) -> list[float]:
    check_breakpoint_options(options)
    n, percentiles = options["n_portfolios"], options["percentiles"]
    if (n is None) == (percentiles is None):
        raise ValueError("n_portfolios and percentiles: name one of them, not both.")
    if n is not None:
        if n <= 1:
            raise ValueError("A sort makes at least two portfolios.")
        return linspace(int(n) + 1)
    return [0.0, *map(float, percentiles), 1.0]


def _add_to_last(values: Column, by: float) -> Column:
    n = F.size(values)
    return F.concat(F.slice(values, F.lit(1), n - 1), F.array(F.element_at(values, -1) + by))


def _smooth(values: DataFrame, groups: list[str], plain: DataFrame, n: int) -> DataFrame:
    """Breakpoints where rows bunch at an edge: inner ones are spread over the values that are not bunched.

    plain: groups and _b, the n + 1 plain breakpoints. A bunched lower edge is one with b0 = b1, an upper one with
    b[n-1] = b[n]. What lies strictly inside is taken again, with n - 1 or n equally spaced probabilities.
    """
    low, high = F.col("_b")[0] == F.col("_b")[1], F.col("_b")[n - 1] == F.col("_b")[n]
    edged = plain.withColumn("_low", low).withColumn("_high", high)
    joined = values.join(edged.drop("_least", "_most"), groups) if groups else values.join(F.broadcast(edged.drop("_least", "_most")), F.lit(True))
    x, b = F.col("_x"), F.col("_b")
    inside = (F.when(F.col("_low"), x > b[0]).otherwise(True)) & (F.when(F.col("_low") & F.col("_high"), x < b[n]).when(F.col("_high"), x < b[n - 1]).otherwise(True))
    kept = joined.where((F.col("_low") | F.col("_high")) & inside).select(*groups, "_x", "_n")
    # The running counts again, of what is left.
    again = distribution(kept.withColumnRenamed("_n", "_times"), groups, "_x", "_times")
    both = distribution_quantiles(again, groups, linspace(n - 1), "_both") if n > 2 else None
    one = distribution_quantiles(again, groups, linspace(n), "_one")
    out = edged  # with _least and _most
    for part in [p for p in (both, one) if p is not None]:
        out = out.join(part, groups, "left") if groups else out.join(F.broadcast(part), F.lit(True), "left")
    if both is None:
        out = out.withColumn("_both", F.array().cast("array<double>"))
    made = (
        F.when(F.col("_low") & F.col("_high"), F.concat(F.array(b[0]), _add_to_last(F.col("_both"), TOP_SHIFT), F.array(b[n])))
        .when(F.col("_low"), F.concat(F.array(b[0]), F.col("_one")))
        .when(F.col("_high"), F.concat(_add_to_last(F.col("_one"), TOP_SHIFT), F.array(b[n])))
        .otherwise(b)
    )
    return out.select(*groups, made.alias("_b"), "_least", "_most")


def _breakpoints(data: DataFrame, sorting_variable: str, options: dict, role: dict, groups: list[str]) -> DataFrame:
    """groups, breakpoints, _least and _most of each group with a value: one row in all without groups.

    One pass over data counts the distinct values and, among them, the rows of the universe; with a size threshold
    another one finds the cut-offs first.
    """
    probs = _probabilities(options)
    rows, universe = data, F.lit(True)
    if options["breakpoints_exchanges"] is not None:
        require_columns(data, [role["exchange"]])
        names = options["breakpoints_exchanges"]
        universe = F.coalesce(F.col(role["exchange"]).isin([names] if isinstance(names, str) else list(names)), F.lit(False))
    if (threshold := options["breakpoints_min_size_threshold"]) is not None:
        size = role["mktcap_lag"]
        require_columns(data, [size])
        cut = quantiles(data.where(universe), groups, size, [threshold], "_cut")
        rows = data.join(cut, groups, "left") if groups else data.join(F.broadcast(cut), F.lit(True), "left")
        universe = universe & F.coalesce(F.col(size) > F.col("_cut")[0], F.lit(False))
    values = distribution(rows.withColumn("_times", universe.cast("long")), groups, sorting_variable, "_times")
    found = distribution_quantiles(values, groups, probs, "_b", ends=True)
    if options["smooth_bunching"]:
        if options["percentiles"] is not None:
            warnings.warn("smooth_bunching replaces 'percentiles' by equally spaced ones where values bunch.", stacklevel=4)
        found = _smooth(values.where("_n > 0"), groups, found, len(probs) - 1)
    shifted = F.transform(F.col("_b"), lambda x, k: F.when(k == 0, x).otherwise(x + SHIFT))
    return found.select(*groups, shifted.alias("breakpoints"), "_least", "_most")


@table_function
def compute_breakpoints(data: DataFrame, sorting_variable: str, breakpoint_options: dict, data_options: dict | None = None, by: list[str] | None = None) -> DataFrame:
    """The columns of by, and an ascending array `breakpoints`: one row for each group (one in all without by).

    The universe is what the options' exchanges and size threshold leave (sizes strictly above the threshold's
    quantile among those exchanges). A group with an empty universe, or with NULLs only, has NULL breakpoints.
    """
    groups = list(by or [])
    require_columns(data, [sorting_variable, *groups])
    found = _breakpoints(data, sorting_variable, breakpoint_options, roles(data_options), groups).drop("_least", "_most")
    if not groups:
        return found.groupBy().agg(F.first("breakpoints").alias("breakpoints"))
    return data.where(" AND ".join(f"`{g}` IS NOT NULL" for g in groups)).select(*groups).distinct().join(found, groups, "left")


def _called_breakpoints(data: DataFrame, groups: list[str], sorting_variable: str, options: dict, role: dict, function: Callable) -> DataFrame:
    """Breakpoints by a caller's function of one group's pandas table (without the grouping columns)."""
    schema = T.StructType([*(data.schema[g] for g in groups), T.StructField("breakpoints", T.ArrayType(T.DoubleType()))])

    def of_group(table: pd.DataFrame) -> pd.DataFrame:
        made = np.asarray(function(table.drop(columns=groups), sorting_variable, options, role), float)
        return pd.DataFrame({**{g: [table[g].iloc[0]] for g in groups}, "breakpoints": [None if np.isnan(made).any() else made.tolist()]})

    keys = groups or [F.lit(0)]
    return data.groupBy(*keys).applyInPandas(of_group, schema)


def bucket(value: Column, breakpoints: Column) -> Column:
    """1 plus the number of inner breakpoints not above value, as a double."""
    inner = F.slice(breakpoints, F.lit(2), F.greatest(F.size(breakpoints) - 2, F.lit(0)))
    return F.when(value.isNotNull() & breakpoints.isNotNull(), (F.lit(1) + F.size(F.filter(inner, lambda b: b <= value))).cast("double"))


@table_function
def assign_portfolio(data: DataFrame, sorting_variable: str, breakpoint_options: dict | None = None, breakpoint_function: Callable | None = None, data_options: dict | None = None, by: list[str] | None = None, new_column: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """data with one column more: each row's portfolio, 1.0 to n, within its group of by.

    A group with at most one distinct value puts all its rows, NULLs too, into 1.0. A group without breakpoints has
    NULL, as have NULL values elsewhere. Buckets are closed on the left; a value on equal inner breakpoints goes above them.
    source: the table to take breakpoints from, if data is the same rows with more columns.
    """
    role, groups = roles(data_options), list(by or [])
    new = new_column or role["portfolio"]
    require_columns(data, [sorting_variable, *groups])
    source = data if source is None else source
    if breakpoint_function is None:
        points = _breakpoints(source, sorting_variable, breakpoint_options, role, groups)
    else:
        called = _called_breakpoints(source, groups, sorting_variable, breakpoint_options, role, breakpoint_function)
        ends = source.groupBy(*groups).agg(F.min(sorting_variable).alias("_least"), F.max(sorting_variable).alias("_most"))
        points = ends.join(called, groups, "left") if groups else ends.join(F.broadcast(called), F.lit(True), "left")
    b, constant = inner_name("b"), inner_name("constant")
    points = points.select(*groups, F.col("breakpoints").alias(b), (F.col("_least") == F.col("_most")).alias(constant))
    joined = data.join(points, groups, "left") if groups else data.join(F.broadcast(points), F.lit(True), "left")
    # A group without any value has no row in points.
    label = F.when(F.coalesce(F.col(constant), F.lit(True)), F.lit(1.0)).otherwise(bucket(F.col(sorting_variable), F.col(b)))
    return joined.select(*(f"`{c}`" for c in data.columns if c != new), label.alias(new))
