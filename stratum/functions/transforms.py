"""Transformations of time series and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stationary(x: Column, code: int, order: Window) -> Column:
    """The usual codes of macro panels: 1 level, 2 and 3 first and second difference, 4 log, 5 and 6 differences of
    the log, 7 difference of the growth rate. The log of what is not positive is NULL."""
    before = lambda c: F.lag(c).over(order)
    twice = lambda c: c - 2 * F.lag(c, 1).over(order) + F.lag(c, 2).over(order)
    log = F.ln(x)
    if code == 1:
        return x
    if code == 2:
        return x - before(x)
    if code == 3:
        return twice(x)
    if code == 4:
        return log
    if code == 5:
        return log - before(log)
    if code == 6:
        return twice(log)
    if code == 7:
        last, older = F.lag(x, 1).over(order), F.lag(x, 2).over(order)
        return F.try_divide(x, last) - F.try_divide(last, older)
    raise ValueError(f"Unknown transformation code: {code}.")


def transform_series(data: DataFrame, codes: dict[str, int], by: list[str] | None = None, date: str = "date") -> DataFrame:
    """data with each column of codes transformed, in the order of dates within groups of by."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(date)
    return data.select(*(stationary(F.col(f"`{c}`").cast("double"), codes[c], order).alias(c) if c in codes else F.col(f"`{c}`") for c in data.columns))


def holding_period_return(discount: Column, date: Column, daily: bool = False) -> Column:
    """The return of a month (or day) from a bill's annual discount rate: 90-day bills before July 2001, 28-day ones since."""
    days = F.when(date < "2001-07-01", 90.0).otherwise(28.0)
    whole = discount * days / 360 / (1 - discount * days / 360)
    if daily:
        power = F.when(date < "2001-07-01", F.lit(1.0) / 63).otherwise(F.lit(1.0) / 20)
    else:
        power = F.when(date < "2001-07-01", F.lit(1.0) / 3).otherwise(F.lit(365.0) / (28 * 12))
    return F.pow(1 + whole, power) - 1
