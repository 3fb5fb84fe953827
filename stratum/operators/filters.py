"""Which observations enter a portfolio sort."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..frames import require_columns, table_function
from ..functions.quantile import quantiles
from ..options import check_filter_options, check_flag, filter_options as make_options, roles

FINANCIALS, UTILITIES = (6000, 6799), (4900, 4999)


@table_function
def filter_sorting_data(data: DataFrame, filter_options: dict | None = None, data_options: dict | None = None, quiet: bool = True) -> DataFrame:
    """data after the filters of filter_options, in their fixed order.

    SIC ranges keep rows without a code; all other filters drop rows in which their column is NULL. The size filter's
    cutoff is, for each date, a quantile of the market values of NYSE rows that passed the filters before it; dates
    without such rows go. With quiet=False the plan runs once; each filter's losses are observed on the way and warned of.
    """
    options, role = filter_options if filter_options is not None else make_options(), roles(data_options)
    check_filter_options(options)
    check_flag(quiet, "quiet")
    need = lambda name, what: require_columns(data, [role[name]], f"The data needs the column {{}} for {what}.")
    out, first = data, Observation()
    watched = data if quiet else data.observe(first, F.count(F.lit(1)).alias("n"))
    steps: list[tuple[str, Observation]] = []

    def keep(label: str, step: Callable[[DataFrame], DataFrame]) -> None:
        nonlocal out, watched
        out = step(out)
        if not quiet:
            steps.append((label, Observation()))
            watched = step(watched).observe(steps[-1][1], F.count(F.lit(1)).alias("n"))

    def outside(low: int, high: int) -> Callable[[DataFrame], DataFrame]:
        code = F.col(role["siccd"])
        return lambda df: df.where(code.isNull() | ~code.between(low, high))

    if options["exclude_financials"]:
        need("siccd", "exclude_financials")
        keep("financial firms", outside(*FINANCIALS))
    if options["exclude_utilities"]:
        need("siccd", "exclude_utilities")
        keep("utilities", outside(*UTILITIES))
    if options["min_stock_price"] is not None:
        need("price", "min_stock_price")
        keep("a low price", lambda df: df.where(F.col(role["price"]) >= options["min_stock_price"]))
    if options["min_size_quantile"] is not None:
        for name in ("mktcap_lag", "exchange", "date"):
            need(name, "min_size_quantile")
        date, size = role["date"], role["mktcap_lag"]
        cutoffs = quantiles(out.where(F.col(role["exchange"]) == "NYSE"), [date], size, [options["min_size_quantile"]], "_cutoff")
        keep("a small size", lambda df: df.join(cutoffs, date).where(F.col(size) >= F.col("_cutoff")[0]).select(*(f"`{c}`" for c in data.columns)))
    if options["min_listing_age"] is not None:
        need("listing_age", "min_listing_age")
        keep("a short listing", lambda df: df.where(F.col(role["listing_age"]) >= options["min_listing_age"]))
    for option, name, label in (("exclude_negative_book_equity", "be", "no positive book equity"), ("exclude_negative_earnings", "earnings", "no positive earnings")):
        if options[option]:
            need(name, option)
            keep(label, lambda df, name=name: df.where(F.col(role[name]) > 0))
    if steps:
        watched.count()
        before = first.get["n"]
        for label, seen in steps:
            left = seen.get["n"]
            if left < before:
                warnings.warn(f"Removed {before - left} observation(s) with {label}.", stacklevel=3)
            before = left
    return out
