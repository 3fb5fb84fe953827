"""Factor files: whitespace, zipped or plain CSV."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import check_jkp_selection
from .dates import between_dates

#: What a provider writes for a missing value.
MISSING = (-99.99, -999.0)


def snake_case(name: str) -> str:
    """A column's name in lower case with underscores."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name.strip())
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z]+", "_", name)).strip("_").lower()


def width_date(text: Column) -> Column:
    """A date from its digits: eight are a day, six a month's first day, four a year's last day."""
    t = F.trim(text)
    year = t.substr(1, 4).try_cast("int")
    month, day = t.substr(5, 2).try_cast("int"), t.substr(7, 2).try_cast("int")
    n = F.length(t)
    return F.when(n == 8, F.make_date(year, month, day)).when(n == 6, F.make_date(year, month, F.lit(1))).when(n == 4, F.make_date(year, F.lit(12), F.lit(31)))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """content of the files of a path; they are read by Spark, one to a task."""
    return spark.read.format("binaryFile").load(path).select("content")


def zipped_lines(zips: DataFrame) -> DataFrame:
    """name and lines (an array) of every file inside zip archives, the first column of zips."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in archive.namelist():
                        lines = archive.read(name).decode("latin-1").splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([lines])], names=["name", "lines"])

    return zips.mapInArrow(unpack, "name string, lines array<string>")


def first_table(lines: list[str], least: int = 800) -> list[list[str]]:
    """The first table of a file: of the blocks that empty lines part, the first with at least so many characters."""
    blocks = re.split(r"\n\s*\n", "\n".join(x.rstrip() for x in lines))
    block = next((b for b in blocks if len(b) >= least), None)
    if block is None:
        raise ValueError("The file has no table.")
    rows = [[c.strip() for c in r.split(",")] for r in block.strip("\n").split("\n")]
    start = next(k for k, r in enumerate(rows) if len(r) > 1)
    return rows[start:]


def _tables(zips: DataFrame, parse: Callable[[list[str]], list[list[str]]]) -> DataFrame:
    """row (from 0) and cells of the table that parse finds in each file of the zip archives."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in batch.column(0).to_pylist():
                cells = parse(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cells)), pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["row", "cells"]
                )

    return zipped_lines(zips).select("lines").mapInArrow(cut, "row long, cells array<string>")


def _dated(table: DataFrame, names: list[str], dates: str) -> DataFrame:
    """Rows with a cell for every name, whose first cell is a date, as columns of text."""
    rows = table.where((F.size("cells") == len(names)) & F.col("cells")[0].rlike(dates))
    return rows.select(*(F.col("cells")[k].alias(n) for k, n in enumerate(names)))


def read_french_factors(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None, least: int = 800) -> DataFrame:
    """The factors of the zipped file at a path."""
    return french_factors(archives(spark, path), start_date, end_date, least)


def french_factors(zips: DataFrame, start_date: str | None = None, end_date: str | None = None, least: int = 800) -> DataFrame:
    """The first table of a zipped factor file (`content` of zips): date and returns as fractions, `-rf` named `_excess` and rf risk_free.

    Missing-value marks are taken out before the division by 100, so percentages are recognised too.
    """
    table = _tables(zips, lambda lines: first_table(lines, least))
    names = ["date", *table.where("row = 0").first()["cells"][1:]]  # the header decides the plan
    names = [n or str(k) for k, n in enumerate(names)]
    raw = _dated(table, names, r"^(\d{4}|\d{6}|\d{8})$")
    tidy = lambda n: {"rf": "risk_free"}.get(n.lower(), re.sub(r"-rf$", "_excess", n.lower()))
    value = lambda n: F.when(~(x := F.trim(F.col(f"`{n}`")).try_cast("double")).isin(*MISSING), x / 100).alias(tidy(n))
    return between_dates(raw.select(width_date(F.col("date")).alias("date"), *(value(n) for n in names[1:])), start_date, end_date)


def read_french_breakpoints(spark: SparkSession, path: str, momentum: bool = False) -> DataFrame:
    """A zipped breakpoint file: date, the counts before the bins, and one column for each 5-percent bin."""
    skipped = 3 if momentum else 1
    table = _tables(archives(spark, path), lambda lines: [[c.strip() for c in x.split(",")] for x in lines[skipped:]])
    dates = r"^(\d{4}|\d{6})$"
    width = len(table.where(F.col("cells")[0].rlike(dates)).orderBy("row").first()["cells"])  # decides the plan
    counts = ["nonpositive", "positive"] if (width - 1) % 20 == 2 else ["count"]
    names = ["date", *counts, *(f"p{5 * k}" for k in range(1, width - len(counts)))]
    raw = _dated(table, names, dates)
    number = lambda n: F.when(~(x := F.col(n).try_cast("double")).isin(*MISSING), x).alias(n)
    return raw.select(width_date(F.col("date")).alias("date"), *(number(n) for n in names[1:]))


def read_q_factors(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Factors of the q model: date from year, month or quarter, and day; returns as fractions."""
    raw = spark.read.csv(path, header=True, mode="DROPMALFORMED")
    low = {c.lower(): c for c in raw.columns}
    part = lambda n: F.col(f"`{low[n]}`").try_cast("int")
    if "date" in low:
        day, used = F.coalesce(F.try_to_timestamp(F.col(low["date"])).cast("date"), width_date(F.col(low["date"]))), {"date"}
    elif "month" in low:
        day, used = F.make_date(part("year"), part("month"), part("day") if "day" in low else F.lit(1)), {"year", "month", "day"}
    elif "quarter" in low:
        day, used = F.make_date(part("year"), part("quarter") * 3 - 2, F.lit(1)), {"year", "quarter"}
    else:
        day, used = F.make_date(part("year"), F.lit(1), F.lit(1)), {"year"}
    name = lambda c: {"f": "risk_free", "mkt": "mkt_excess"}.get(n := c.lower().removeprefix("r_"), n)
    columns = [(F.col(f"`{c}`").try_cast("double") / 100).alias(name(c)) for k, c in low.items() if k not in used]
    return between_dates(raw.select(day.alias("date"), *columns), start_date, end_date)


def read_characteristic_portfolios(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Open asset pricing portfolios: month, and returns as fractions, with names in snake case."""
    raw = spark.read.csv(path, header=True)
    date = next(c for c in raw.columns if c.lower() == "date")
    values = [(F.col(f"`{c}`").try_cast("double") / 100).alias(snake_case(c)) for c in raw.columns if c != date]
    return between_dates(raw.select(F.trunc(F.to_date(date), "MM").alias("date"), *values), start_date, end_date)


def read_liquidity_factors(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Aggregate liquidity: lines of month and values, comments behind %; -99 is missing."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("%") & (F.trim("value") != "")).select(words.alias("w"))
    number = lambda k: F.nullif(F.col("w")[k].try_cast("double"), F.lit(-99.0))
    out = rows.select(width_date(F.col("w")[0]).alias("date"), number(1).alias("agg_liquidity"), number(2).alias("innovations"), number(3).alias("traded_liquidity"))
    return between_dates(out, start_date, end_date)


def read_mispricing_factors(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Mispricing factors, by month or day."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    date = raw.columns[0]
    names = {"mktrf": "mkt_excess", "smb": "smb", "mgmt": "mgmt", "perf": "perf", "rf": "risk_free"}
    values = [F.col(f"`{c}`").try_cast("double").alias(names.get(c.lower(), c.lower())) for c in raw.columns[1:]]
    return between_dates(raw.select(width_date(F.col(f"`{date}`")).alias("date"), *values), start_date, end_date)


def read_global_factors(
    spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None, monthly: bool = True,
    manifest: str | None = None, dataset: str = "factors", region: str | None = None, selector: str | None = None,
) -> DataFrame:
    """Global factor data (CSV): `na` is missing, monthly dates are moved to their month's first day, pf is a whole number.

    manifest: a saved manifest, in which the region must have the selector, in the frequency asked for.
    """
    if manifest is not None:
        check_jkp_selection(spark, manifest, dataset, region or "", selector or "", "monthly" if monthly else "daily")
    raw = spark.read.csv(path, header=True, nullValue="na", inferSchema=True)
    date = "date" if "date" in raw.columns else "eom"
    day = F.to_date(date)
    out = raw.withColumn(date, F.trunc(day, "MM") if monthly else day)
    if "pf" in out.columns:
        out = out.withColumn("pf", F.col("pf").cast("int"))
    return between_dates(out, start_date, end_date, date)


def read_risk_free(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    return between_dates(spark.read.parquet(path).withColumn("date", F.col("date").cast("date")), start_date, end_date)


def read_trades_by_day(spark: SparkSession, path: str, start_date: str = "2007-06-27", end_date: str = "2007-07-27") -> DataFrame:
    """A dataset in folders date=YYYY-MM-DD; only the folders of the days asked for are read."""
    return between_dates(spark.read.parquet(path).withColumn("date", F.col("date").cast("date")), start_date, end_date)


#: Values of a grid's settings when a filter doesn't name them. None: the setting is missing.
GRID_DEFAULTS = {"min_size_quantile": 0.2, "exclude_financials": False, "exclude_utilities": False, "exclude_negative_earnings": False, "sorting_variable_lag": "6m", "rebalancing": "monthly", "n_portfolios_main": 10, "sorting_method": "univariate", "n_portfolios_secondary": None, "breakpoints_exchanges": "NYSE", "breakpoints_min_size_threshold": None, "weighting_scheme": "VW"}


def filter_factor_grid(grid: DataFrame, fill_all: bool = False, defaults: dict | None = None, **wanted: object) -> DataFrame:
    """The grid's rows with the settings asked for. A list takes any of its values; None takes the setting's filter away;
    settings not named have their defaults, unless fill_all."""
    unknown = [k for k in wanted if k not in grid.columns]
    if unknown:
        raise ValueError(f"Unknown filters: {', '.join(unknown)}.")
    if wanted.get("sorting_method", "univariate") not in (None, "univariate") and wanted.get("n_portfolios_secondary") is None:
        raise ValueError("'n_portfolios_secondary' is needed for bivariate sorts.")
    out = grid.withColumn("sorting_variable", F.regexp_replace("sorting_variable", "^sv_", ""))
    chosen = {k: v for k, v in (defaults or GRID_DEFAULTS).items() if k in grid.columns and k not in wanted} if not fill_all else {}
    for column, value in chosen.items():
        out = out.where(F.col(column).isNull() if value is None else F.col(column) == value)
    for column, value in wanted.items():
        if value is None:
            continue
        values = [x.removeprefix("sv_") if column == "sorting_variable" else x for x in (value if isinstance(value, (list, tuple)) else [value])]
        out = out.where(F.col(column).isin(*values))
    return out


def read_factor_library(spark: SparkSession, returns_path: str, grid: DataFrame, ids: list[int] | None = None, start_date: str | None = None, end_date: str | None = None, **filters: object) -> DataFrame:
    """Factor returns with their settings. Folders sorting_variable=/sorting_variable_lag= are pruned by the grid's rows.

    The settings asked for, with and without their prefix, become partition filters, so that no other folder is read; a
    setting of the grid without a folder is an error.
    """
    if ids is not None and filters:
        raise ValueError("'ids' excludes other filters.")
    kept = grid.where(F.col("id").isin(*ids)) if ids is not None else filter_factor_grid(grid, **filters)
    returns = spark.read.parquet(returns_path)
    folders = [c for c in ("sorting_variable", "sorting_variable_lag") if c in returns.columns and c in kept.columns]
    keys = ["id", *folders]
    plain = lambda c: F.regexp_replace(c, "^sv_", "")
    if "sorting_variable" in keys:
        kept = kept.withColumn("sorting_variable", plain("sorting_variable"))
    if folders:
        there = _folders(returns, folders)
        wanted = {tuple(str(x) for x in r) for r in kept.select(*folders).distinct().collect()}  # settings, not rows
        if there and (missing := wanted - {tuple(x.removeprefix("sv_") if c == "sorting_variable" else x for c, x in zip(folders, f)) for f in there}):
            raise ValueError(f"No returns in the library for {sorted(missing)}.")
        for k, c in enumerate(folders):
            values = {w[k] for w in wanted}
            values |= {f"sv_{v}" for v in values} if c == "sorting_variable" else set()
            returns = returns.where(F.col(c).cast("string").isin(*sorted(values)))
    if "sorting_variable" in keys:
        returns = returns.withColumn("sorting_variable", plain("sorting_variable"))
    return between_dates(returns.join(kept, keys), start_date, end_date)


def _folders(returns: DataFrame, names: list[str]) -> set[tuple[str, ...]]:
    """The values of the folder columns that exist, from the list of files that Spark has; empty if they are no folders."""
    found = [[re.search(rf"/{n}=([^/]+)/", f) for n in names] for f in returns.inputFiles()]
    return {tuple(unquote(m[1]) for m in f) for f in found if all(f)}
