"""Returns of sorted portfolios, and the spreads between them."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import require_columns, require_new_columns, table_function
from ..functions.quantile import quantiles
from ..options import SORT_METHODS, check_breakpoint_options, check_filter_options, check_flag, is_number, roles
from .breakpoints import assign_portfolio
from .filters import filter_sorting_data

EW, VW, CAPPED = "ret_excess_ew", "ret_excess_vw", "ret_excess_vw_capped"


def _summarise(data: DataFrame, keys: list[str], ret: str, weight: str, capped: str, least_size: int) -> DataFrame:
    """Row counts and returns of groups. Rows without a return count in n and in the sums of weights."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    r = F.col(ret)
    sums = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), total(r).alias("_r"), total(F.col(weight)).alias("_w"), total(F.col(capped)).alias("_c"), total(r * F.col(weight)).alias("_rw"), total(r * F.col(capped)).alias("_rc"))
    enough = lambda x: F.when(F.col("_n") >= least_size, x)
    share = lambda a, b: enough(F.col(a) / F.nullif(F.col(b), F.lit(0.0)))
    return sums.select(*keys, F.col("_n"), share("_rw", "_w").alias(VW), enough(F.col("_r") / F.col("_n")).alias(EW), share("_rc", "_c").alias(CAPPED))


def _most_portfolios(options: dict) -> int:
    return int(options["n_portfolios"]) if options["n_portfolios"] is not None else len(options["percentiles"]) + 1


def _window_year(date: Column, month: int) -> Column:
    return F.when(F.month(date) >= month, F.year(date)).otherwise(F.year(date) - 1)


def _hold(data: DataFrame, assigned: DataFrame, labels: list[str], date: str, id: str, month: int) -> DataFrame:
    """Each row gets the labels that its id had in the last rebalancing month."""
    held = assigned.select(F.col(id).alias("_id"), F.year(date).alias("_year"), *labels)
    on = (data[id] == held["_id"]) & (_window_year(data[date], month) == held["_year"])
    return data.join(held, on, "left").drop("_id", "_year")


@table_function
def compute_portfolio_returns(
    data: DataFrame, sorting_variables: str | list[str], sorting_method: str, rebalancing_month: int | None = None,
    breakpoint_options_main: dict | None = None, breakpoint_options_secondary: dict | None = None,
    breakpoint_function_main: Callable | None = None, breakpoint_function_secondary: Callable | None = None,
    min_portfolio_size: int = 1, cap_weight: float = 0.8, data_options: dict | None = None, quiet: bool = True,
) -> DataFrame:
    """Returns of every portfolio on every date: portfolio, date, and equal-, value- and capped-value-weighted returns.

    Bivariate sorts order by the first variable within (dependent) or beside (independent) buckets of the second, and
    average over the second's. With a rebalancing month, portfolios are formed in it and held for a year. Portfolios
    without rows on a date have NULL returns. Without market values only equal-weighted returns are given. A weight is
    capped at the date's cap_weight quantile of weights. Rows without a return still count as rows (and weights).

    Where no row is in the rebalancing month there is nothing to hold: the plan fails when it runs. quiet=False looks at
    the data at once (which runs parts of the plan): it raises a ValueError for that, and warns of an empty panel and of
    missing returns.
    """
    check_flag(quiet, "quiet")
    role = roles(data_options)
    variables = [sorting_variables] if isinstance(sorting_variables, str) else list(sorting_variables or [])
    if not variables:
        raise ValueError("A sort needs a sorting variable.")
    if sorting_method not in SORT_METHODS:
        raise ValueError(f"sorting_method is one of {', '.join(SORT_METHODS)}.")
    two = sorting_method != "univariate"
    if two and breakpoint_options_secondary is None:
        warnings.warn("The second sort takes the options of the first, as it has none.", stacklevel=3)
    if not is_number(cap_weight) or not 0 <= cap_weight <= 1:
        raise ValueError(f"cap_weight takes a number from 0 to 1, not {cap_weight!r}.")
    id, date, ret, weight = role["id"], role["date"], role["ret_excess"], role["mktcap_lag"]
    require_columns(data, [*variables, id, date, ret])
    if rebalancing_month is not None and not 1 <= rebalancing_month <= 12:
        raise ValueError("rebalancing_month is the number of a month, 1 to 12.")
    if not two and len(variables) > 1:
        raise ValueError("A univariate sort has one sorting variable.")
    if two and len(variables) != 2:
        raise ValueError("A bivariate sort has two sorting variables.")
    capped = f"{weight}_capped"
    require_new_columns(data, [capped, "_main", "_secondary"])
    unweighted = weight not in data.columns
    if unweighted:
        data = data.withColumn(weight, F.lit(1.0))
    dates = data.select(date).where(F.col(date).isNotNull()).distinct()
    complete = plain = used = data.dropna(subset=variables)
    caps = quantiles(used, [date], weight, [cap_weight], "_cap")
    w = F.col(weight)
    used = used.join(caps, date, "left").withColumn(capped, F.when(w.isNull(), 0.0).otherwise(F.least(w, F.col("_cap")[0]))).withColumn(weight, F.coalesce(w.cast("double"), F.lit(0.0))).drop("_cap")

    month = (lambda df: df) if rebalancing_month is None else (lambda df: df.where(F.month(date) == rebalancing_month))
    formed, plain = month(used), month(plain)
    assign = assign_portfolio.__wrapped__
    main, second = (breakpoint_options_main, breakpoint_function_main), (breakpoint_options_secondary or breakpoint_options_main, breakpoint_function_secondary)
    if not two:
        labels, formed = ["_main"], assign(formed, variables[0], *main, role, [date], "_main", plain)
    else:
        labels = ["_main", "_secondary"]
        formed = assign(formed, variables[1], *second, role, [date], "_secondary", plain)
        if sorting_method == "bivariate-dependent":
            formed = assign(formed, variables[0], *main, role, [date, "_secondary"], "_main")
        else:
            formed = assign(formed, variables[0], *main, role, [date], "_main", plain)
    placed = formed if rebalancing_month is None else _hold(used, formed, labels, date, id, rebalancing_month)
    placed = placed.dropna(subset=labels)
    if two:
        cells = _summarise(placed, ["_main", "_secondary", date], ret, weight, capped, 0)
        enough = lambda x: F.when(F.sum("_n") >= min_portfolio_size, F.avg(x)).alias(x)
        returns = cells.groupBy("_main", date).agg(enough(VW), enough(EW), enough(CAPPED))
    else:
        returns = _summarise(placed, ["_main", date], ret, weight, capped, min_portfolio_size).drop("_n")

    absent = f"No row is in the rebalancing month {rebalancing_month}."
    if not quiet:
        if plain.isEmpty() and complete.isEmpty():
            warnings.warn("Returning an empty panel: no row has all sorting variables.", stacklevel=3)
        elif rebalancing_month is not None and plain.isEmpty():
            raise ValueError(absent)
    if rebalancing_month is not None:
        in_month = F.when(F.month(date) == rebalancing_month, F.col(date))
        first = complete.agg(F.min(in_month).alias("_first"), F.count(date).alias("_rows"))
        known = F.when(F.col("_first").isNull() & (F.col("_rows") > 0), F.raise_error(absent)).otherwise(F.col("_first"))
        first = first.select(known.alias("_first"))
        dates = dates.join(F.broadcast(first), F.col(date) >= F.col("_first")).drop("_first")
    # All portfolios there can be on all dates, then without those that no date has.
    most = _most_portfolios(breakpoint_options_main) if breakpoint_function_main is None else None
    if most:
        panel = dates.withColumn("_main", F.explode(F.sequence(F.lit(1), F.lit(most)).cast("array<double>")))
        panel = panel.join(returns.withColumn("_there", F.lit(True)), [date, "_main"], "left")
        panel = panel.withColumn("_there", F.max("_there").over(Window.partitionBy("_main"))).where("_there")
    else:
        portfolios = returns.select("_main").distinct()
        panel = dates.crossJoin(F.broadcast(portfolios)).join(returns, [date, "_main"], "left")
    columns = [EW] if unweighted else [VW, EW, CAPPED]
    if not quiet and (missing := panel.where(F.col(EW).isNull()).count()):
        warnings.warn(
            f"{missing} returns are missing, of portfolios with fewer than {min_portfolio_size} rows on a date.", stacklevel=3
        )
    return panel.select(F.col("_main").alias(role["portfolio"]), date, *columns)


@table_function
def compute_long_short_returns(data: DataFrame, direction: str = "top_minus_bottom", data_options: dict | None = None) -> DataFrame:
    """date and, for each column whose name contains ret_excess, the top portfolio's return less the bottom one's.

    Top and bottom are the largest and the smallest portfolio with a row on the date; a date with one portfolio has NULL.
    """
    if direction not in ("top_minus_bottom", "bottom_minus_top"):
        raise ValueError("direction must be 'top_minus_bottom' or 'bottom_minus_top'.")
    role = roles(data_options)
    date, portfolio = role["date"], role["portfolio"]
    require_columns(data, [date, portfolio])
    columns = [c for c in data.columns if "ret_excess" in c]
    p = F.col(portfolio)
    # A return counts where it is the label's first that is not NULL; labels have one row a date.
    rows = data.groupBy(date, portfolio).agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns))
    ends = rows.groupBy(date).agg(F.min(p).alias("_low"), F.max(p).alias("_high"), *(F.max_by(c, p).alias(f"_top_{c}") for c in columns), *(F.min_by(c, p).alias(f"_bottom_{c}") for c in columns))
    sign = 1 if direction == "top_minus_bottom" else -1
    spread = lambda c: F.when(F.col("_low") < F.col("_high"), sign * (F.col(f"_top_{c}") - F.col(f"_bottom_{c}"))).alias(c)
    return ends.select(date, *map(spread, columns))


@table_function
def implement_portfolio_sort(
    data: DataFrame, sorting_variables: str | list[str], sorting_method: str, portfolio_sort_options: dict,
    rebalancing_month: int | None = None, breakpoint_function_main: Callable | None = None,
    breakpoint_function_secondary: Callable | None = None, min_portfolio_size: int = 1, cap_weight: float = 0.8,
    data_options: dict | None = None, quiet: bool = True,
) -> DataFrame:
    """filter_sorting_data, then compute_portfolio_returns, as the bundle of options says."""
    wanted = {"filter_options", "breakpoint_options_main", "breakpoint_options_secondary"}
    if not isinstance(portfolio_sort_options, dict) or not wanted <= portfolio_sort_options.keys():
        raise ValueError("Make these options with portfolio_sort_options(...).")
    chosen = portfolio_sort_options
    check_breakpoint_options(chosen["breakpoint_options_main"])
    if chosen["filter_options"] is not None:
        check_filter_options(chosen["filter_options"])
        data = filter_sorting_data.__wrapped__(data, chosen["filter_options"], data_options, quiet)
    return compute_portfolio_returns.__wrapped__(
        data, sorting_variables, sorting_method, rebalancing_month, chosen["breakpoint_options_main"],
        chosen["breakpoint_options_secondary"], breakpoint_function_main, breakpoint_function_secondary, min_portfolio_size,
        cap_weight, data_options, quiet,
    )


