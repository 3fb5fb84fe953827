"""Tables at the library's edge: Spark or pandas in, Spark or pandas out."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_backend = "spark"


def set_backend(backend: str) -> None:
    """What public functions return: 'spark' (lazy) or 'pandas' (collected)."""
    global _backend
    if backend not in ("spark", "pandas"):
        raise ValueError("backend must be 'spark' or 'pandas'.")
    _backend = backend


def get_backend() -> str:
    return _backend


def as_spark(data: DataFrame | pd.DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """A Spark table in which missing doubles are NULL, never NaN: NaN would join, sort and count as a value."""
    if isinstance(data, pd.DataFrame):
        session = spark or SparkSession.getActiveSession()
        if session is None:
            raise ValueError("a pandas table needs an active SparkSession")
        data = session.createDataFrame(data)
    floats = {f.name for f in data.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return data.select(*(F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in data.columns)) if floats else data


def table_function(f: Callable) -> Callable:
    """Turns pandas arguments into Spark tables and, under the pandas backend, the result into a pandas table."""

    @functools.wraps(f)
    def wrapped(*args, **kwargs):
        turn = lambda x: as_spark(x) if isinstance(x, (pd.DataFrame, DataFrame)) else x
        out = f(*map(turn, args), **{k: turn(v) for k, v in kwargs.items()})
        if _backend == "pandas":
            if isinstance(out, dict):
                return {k: v.toPandas() if isinstance(v, DataFrame) else v for k, v in out.items()}
            return out.toPandas() if isinstance(out, DataFrame) else out
        return out

    return wrapped


def inner_name(name: str) -> str:
    """A column name for a step's own use that no caller's column has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def require_columns(data: DataFrame, columns: Iterable[str], message: str = "Missing columns: {}.") -> None:
    missing = [c for c in columns if c not in data.columns]
    if missing:
        raise ValueError(message.format(", ".join(missing)))


def require_new_columns(data: DataFrame, names: Iterable[str]) -> None:
    """Reserved names that the caller's table must not have."""
    taken = [n for n in names if n in data.columns]
    if taken:
        raise ValueError(f"The data already has the column(s) {', '.join(taken)}, which this function creates.")


def null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str], suffix: str = "") -> Column:
    """Equality of key columns in which NULL equals NULL."""
    condition = F.lit(True)
    for k in keys:
        condition &= left[k].eqNullSafe(right[k + suffix])
    return condition
