"""Bounds of dates that a caller asks for."""

from __future__ import annotations

import calendar
import datetime
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_date(text: str, is_end: bool = False) -> datetime.date:
    """YYYY-MM-DD, YYYYMMDD, or a month: YYYYMM or YYYY-MM are its first day, or its last for an end."""
    if m := re.fullmatch(r"(\d{4})-?(\d{2})", str(text)):
        year, month = int(m[1]), int(m[2])
        return datetime.date(year, month, calendar.monthrange(year, month)[1] if is_end else 1)
    try:
        return datetime.date.fromisoformat(str(text)[:10])
    except ValueError:
        raise ValueError(f"Not a date: {text!r}.") from None


def date_bounds(start: str | None, end: str | None) -> tuple[datetime.date | None, datetime.date | None]:
    low, high = start and parse_date(start), end and parse_date(end, True)
    if low and high and low > high:
        raise ValueError("'start_date' cannot be after 'end_date'.")
    return low or None, high or None


def between_dates(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    """Rows from start to end, both included; a missing bound is open."""
    low, high = date_bounds(start, end)
    if low:
        df = df.where(F.col(column) >= F.lit(low))
    return df.where(F.col(column) <= F.lit(high)) if high else df
