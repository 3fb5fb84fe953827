"""Offsets and buckets of calendar dates."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = {
    "month": lambda d: F.year(d) * 12 + F.month(d),
    "quarter": lambda d: F.year(d) * 4 + F.quarter(d),
    "year": lambda d: F.year(d),
}


@dataclass(frozen=True)
class Offset:
    """Calendar months, then days. A month's last day is the last in a shorter month."""

    months: int = 0
    days: int = 0

    def after(self, date: Column) -> Column:
        return F.date_add(F.add_months(date, self.months), self.days)

    def before(self, date: Column) -> Column:
        return F.date_sub(F.add_months(date, -self.months), self.days)

    def equals(self, other: Offset) -> bool:
        """Whether both lead from 2020-01-01 to the same day."""
        start = pd.Timestamp(2020, 1, 1)
        place = lambda o: start + pd.DateOffset(months=o.months) + pd.Timedelta(days=o.days)
        return place(self) == place(other)


def months(n: int) -> Offset:
    return Offset(months=n)


def years(n: int) -> Offset:
    return Offset(months=12 * n)


def to_offset(x: object) -> Offset:
    """An Offset, a number of days, a timedelta of whole days, or a pandas DateOffset of years, months, weeks and days."""
    if isinstance(x, Offset):
        return x
    if isinstance(x, int) and not isinstance(x, bool):
        return Offset(days=x)
    if isinstance(x, (pd.Timedelta, datetime.timedelta)):
        if x.seconds or x.microseconds:
            raise ValueError("lags must be whole days.")
        return Offset(days=x.days)
    if isinstance(x, pd.DateOffset) and set(kinds := x.kwds) <= {"years", "months", "weeks", "days"}:
        return Offset(months=12 * kinds.get("years", 0) + kinds.get("months", 0), days=7 * kinds.get("weeks", 0) + kinds.get("days", 0))
    raise ValueError("A lag must be a number of days, a Timedelta, a DateOffset or an Offset.")


def months_between_starts(first: Column, last: Column) -> Column:
    """Whole months from first to last, at least 0: a month counts once its day is reached."""
    whole = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) - F.when(F.day(last) < F.day(first), 1).otherwise(0)
    return F.greatest(whole, F.lit(0))
