"""Values over rolling calendar windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import inner_name, require_columns, table_function
from ..functions.calendar import BUCKETS
from ..functions.panes import PaneAggregate, over_panes
from ..options import roles


@table_function
def compute_rolling_value(data: DataFrame, f: str | Column | Callable[[pd.DataFrame], float], period: str = "month", periods: int = 12, min_obs: int | None = None, data_options: dict | None = None, by: list[str] | None = None, new_column: str = "rolling_value") -> DataFrame:
    """data with one column more: f over the rows of the last `periods` months, quarters or years, within groups of by.

    A row's window holds all rows of its own calendar period, later ones too, and of the periods before it. Rows with a
    NULL in any column are left out; a window with fewer than min_obs (default: periods) rows gives NULL. f is an SQL
    aggregate (text or Column), or a function of a pandas table, which needs more time. Arithmetic of sums, counts,
    averages, extremes, variances and deviations is merged from one partial aggregate for each group and period
    (functions/panes.py). For other aggregates and functions a row is sent to all periods whose windows hold it.
    """
    if period not in BUCKETS:
        raise ValueError("period must be 'month', 'quarter' or 'year'.")
    if not isinstance(periods, int) or isinstance(periods, bool) or periods < 1:
        raise ValueError("periods takes a whole number above 0.")
    least = periods if min_obs is None else min_obs
    if not isinstance(least, int) or isinstance(least, bool) or least < 1:
        raise ValueError("min_obs must be a positive integer.")
    date, groups = roles(data_options)["date"], list(by or [])
    require_columns(data, [date, *groups])
    if not isinstance(data.schema[date].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"The column '{date}' must hold dates.")
    bucket = inner_name("bucket")
    keyed = data.withColumn(bucket, BUCKETS[period](F.col(date)))
    enough, value = inner_name("enough"), inner_name("value")
    panes = None if callable(f) and not isinstance(f, Column) else PaneAggregate.of(f, data)
    if panes:
        whole = F.lit(True)
        for c in data.columns:
            whole &= F.col(f"`{c}`").isNotNull()
        made = over_panes(keyed, groups, bucket, whole, panes, periods, lambda x, rows: F.when(rows >= least, x), value)
        return _join(keyed, made, [*groups, bucket], value).select(*(f"`{c}`" for c in data.columns), F.col(value).alias(new_column))
    anchors = keyed.select(*groups, bucket).distinct()
    spread = keyed.dropna().withColumn(bucket, F.explode(F.sequence(F.col(bucket), F.col(bucket) + periods - 1)))
    if callable(f) and not isinstance(f, Column):
        schema = T.StructType([*(spread.schema[g] for g in [*groups, bucket]), T.StructField(value, T.DoubleType())])
        columns = list(data.columns)

        def of_window(rows: pd.DataFrame) -> pd.DataFrame:
            out = {k: [rows[k].iloc[0]] for k in [*groups, bucket]}
            return pd.DataFrame(out | {value: [float(f(rows[columns].sort_values(date))) if len(rows) >= least else None]})

        made = spread.groupBy(*groups, bucket).applyInPandas(of_window, schema)
    else:
        made = spread.groupBy(*groups, bucket).agg((F.expr(f) if isinstance(f, str) else f).alias(value), F.count(F.lit(1)).alias(enough))
        made = made.select(*groups, bucket, F.when(F.col(enough) >= least, F.col(value)).alias(value))
    windows = _join(anchors, made, [*groups, bucket], value)
    return _join(keyed, windows, [*groups, bucket], value).select(*(f"`{c}`" for c in data.columns), F.col(value).alias(new_column))


def _join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    other = {k: inner_name("key") for k in keys}
    right = right.select(*(F.col(k).alias(n) for k, n in other.items()), value)
    on = F.lit(True)
    for k, n in other.items():
        on &= left[k].eqNullSafe(right[n])
    return left.join(right, on, "left").drop(*other.values())
