"""Monthly and daily stock panels from security tables, in their newer (CIZ) and older (SIZ) formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import inner_name, table_function
from ..functions.calendar import months_between_starts
from ..operators.validity import join_validity
from .codes import exchange, exchange_of_number, industry

#: Common stocks of US corporations, traded on the three exchanges.
COMMON_STOCK = """
sharetype = 'NS' AND securitytype = 'EQTY' AND securitysubtype = 'COM' AND usincflg = 'Y' AND issuertype IN ('ACOR', 'CORP')
AND primaryexch IN ('N', 'A', 'Q') AND conditionaltype IN ('RW', 'NW') AND tradingstatusflg = 'A'
"""
#: Delisting codes for which a missing delisting return is taken as -30 %, besides 551 to 574.
PERFORMANCE_CODES = (500, 520, 580, 584)


def with_names(stocks: DataFrame, names: DataFrame, start: str, end: str, date: str = "date", only: str | None = None) -> DataFrame:
    """stocks with the columns of the names row whose validity interval holds the date; NULL keys match nothing."""
    kept = names.where(only) if only else names
    kept = kept.select("permno", start, end, *(c for c in kept.columns if c not in {"permno", start, end, *stocks.columns}))
    return join_validity(stocks, kept, "permno", date, start, end)


def lagged_month(panel: DataFrame, column: str, new: str) -> DataFrame:
    """panel, of first days of months, with a column's value of the calendar month before; a gap gives NULL.

    Where a security has several rows in the month before, a row comes out for each. One window by security, so what panel
    is made from runs once.
    """
    before = inner_name("before")
    month = F.year("date") * 12 + F.month("date")
    last = Window.partitionBy("permno").orderBy(month).rangeBetween(-1, -1)
    known = F.col("permno").isNotNull() & F.col("date").isNotNull()
    found = panel.withColumn(before, F.when(known, F.collect_list(F.struct(F.col(column).alias(new))).over(last)))
    return found.withColumn(before, F.explode_outer(before)).select(*(f"`{c}`" for c in panel.columns), F.col(before)[new].alias(new))


def _excess(panel: DataFrame, risk_free: DataFrame, ret: str = "ret") -> DataFrame:
    free = risk_free.select("date", "risk_free")
    return panel.join(free, "date", "left").withColumn("ret_excess", F.col(ret) - F.col("risk_free")).drop("risk_free")


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def _adjusted_price(price: Column, factor: Column) -> Column:
    return _finite(F.try_divide(F.abs(F.nullif(price.cast("double"), F.lit(0.0))), factor.cast("double")))


MONTHLY = "permno date calculation_date ret shrout prc primaryexch siccd mthvol listing_age mktcap mktcap_lag exchange industry ret_excess".split()


@table_function
def crsp_monthly(stocks: DataFrame, risk_free: DataFrame) -> DataFrame:
    """The monthly panel of the newer format.

    stocks: permno, date, ret, shrout, prc, primaryexch, siccd, first_crsp_date, and others, which are kept; common
    stocks only (COMMON_STOCK). Shares come in thousands; market values are in millions.
    """
    first = F.col("first_crsp_date")
    day = F.col("date").cast("date")
    out = stocks if "calculation_date" in stocks.columns else stocks.withColumn("calculation_date", day)
    out = out.withColumn("date", F.trunc(day, "MM")).withColumn("shrout", F.col("shrout") * 1000)
    out = out.withColumn("listing_age", months_between_starts(first, F.col("date"))).withColumn("mktcap", F.nullif(F.col("shrout") * F.col("prc") / 1e6, F.lit(0.0)))
    out = lagged_month(out, "mktcap", "mktcap_lag").withColumn("exchange", exchange(F.col("primaryexch"))).withColumn("industry", industry(F.col("siccd")))
    out = _excess(out, risk_free).dropna(subset=["ret_excess", "mktcap"])
    return out.select(*(c for c in MONTHLY if c in out.columns), *(c for c in out.columns if c not in {*MONTHLY, "first_crsp_date"}))


def delisting_return(ret: Column, dlret: Column, code: Column) -> Column:
    """A return that takes account of a delisting in its month."""
    assumed = F.when(code.isin(*PERFORMANCE_CODES) | code.between(551, 574), F.lit(-0.3)).when(code == 100, ret).otherwise(F.lit(-1.0))
    return F.when(code.isNull(), ret).when(dlret.isNotNull(), dlret).otherwise(assumed)


@table_function
def crsp_monthly_v1(stocks: DataFrame, delistings: DataFrame, first_dates: DataFrame, risk_free: DataFrame) -> DataFrame:
    """The monthly panel of the older format: stocks has altprc, cfacpr, exchcd, siccd; delistings dlstdt, dlret, dlstcd."""
    day = F.col("date").cast("date")
    out = stocks.withColumn("calculation_date", day).withColumn("date", F.trunc(day, "MM")).withColumn("shrout", F.col("shrout") * 1000)
    gone = delistings.select("permno", F.trunc("dlstdt", "MM").alias("date"), F.col("dlret"), F.col("dlstcd"))
    out = out.join(gone, ["permno", "date"], "left").join(first_dates.select("permno", "first_crsp_date"), "permno", "left")
    out = out.withColumn("listing_age", months_between_starts(F.col("first_crsp_date"), F.col("date")))
    out = out.withColumn("mktcap", F.nullif(F.abs(F.col("shrout") * F.col("altprc")) / 1e6, F.lit(0.0)))
    out = lagged_month(out, "mktcap", "mktcap_lag").withColumn("exchange", exchange_of_number(F.col("exchcd"))).withColumn("industry", industry(F.col("siccd")))
    out = out.withColumn("ret_adj", delisting_return(F.col("ret"), F.col("dlret"), F.col("dlstcd"))).withColumn("prc_adj", _adjusted_price(F.col("altprc"), F.col("cfacpr")))
    return _excess(out, risk_free, "ret_adj").drop("dlret", "dlstcd", "first_crsp_date").dropna(subset=["ret_excess", "mktcap"])


def nasdaq_volume(volume: Column, nasdaq: Column, date: Column) -> Column:
    """Volume without NASDAQ's double counting: a divisor that fell from 2 to 1 in three steps; -99 is no volume."""
    v = F.nullif(volume.cast("double"), F.lit(-99.0))
    divisor = F.when(date < "2001-02-01", 2.0).when(date < "2002-01-01", 1.8).when(date < "2004-01-01", 1.6).otherwise(1.0)
    return F.when(nasdaq, v / divisor).otherwise(v)


@table_function
def crsp_daily(stocks: DataFrame, risk_free: DataFrame, adjust_volume: bool = False) -> DataFrame:
    """The daily panel of the newer format: rows with a return, and their excess over the risk-free rate.

    adjust_volume adds prc_adj, by the running product of dlyfacprc, and vol_adj.
    """
    out = _excess(stocks.dropna(subset=["permno", "date", "ret"]), risk_free)
    if not adjust_volume:
        return out
    running = Window.partitionBy("permno").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("cfacpr", F.product(F.col("dlyfacprc")).over(running)).withColumn("prc_adj", _adjusted_price(F.col("dlyprc"), F.col("cfacpr")))
    return out.withColumn("vol_adj", nasdaq_volume(F.col("dlyvol"), F.col("primaryexch") == "Q", F.col("date")))


@table_function
def crsp_daily_v1(stocks: DataFrame, delistings: DataFrame, risk_free: DataFrame, end_date: str, adjust_volume: bool = False) -> DataFrame:
    """The daily panel of the older format. A delisting return replaces the day's return, or makes a row of its own
    where the day has none; rows after the last delisting (or end_date) go."""
    gone = delistings.select("permno", F.col("dlstdt").alias("date"), F.col("dlret")).dropna()
    joined = stocks.join(gone, ["permno", "date"], "left")
    alone = gone.join(stocks.select("permno", "date"), ["permno", "date"], "left_anti")
    rows = joined.unionByName(alone, allowMissingColumns=True).withColumn("ret", F.coalesce("dlret", "ret")).drop("dlret")
    last = gone.groupBy("permno").agg(F.max("date").alias("_last"))
    rows = rows.join(last, "permno", "left").where(F.col("date") <= F.coalesce("_last", F.lit(end_date).cast("date"))).drop("_last")
    out = _excess(rows, risk_free)
    if not adjust_volume:
        return out
    return out.withColumn("prc_adj", _adjusted_price(F.col("prc"), F.col("cfacpr"))).withColumn("vol_adj", nasdaq_volume(F.col("vol"), F.col("exchcd") == 3, F.col("date")))


@table_function
def ccm_links(links: DataFrame, as_of: str) -> DataFrame:
    """Primary links of securities and accounts; one without an end lasts to as_of."""
    kept = links.where("linktype IN ('LU', 'LC') AND linkprim IN ('P', 'C')") if {"linktype", "linkprim"} <= set(links.columns) else links
    return kept.select("permno", "gvkey", "linkdt", F.coalesce("linkenddt", F.lit(as_of).cast("date")).alias("linkenddt"))


@table_function
def add_gvkey(panel: DataFrame, links: DataFrame) -> DataFrame:
    """panel with the gvkey whose link holds the date; two valid links give two rows."""
    link = links.where("gvkey IS NOT NULL").select("permno", "gvkey", "linkdt", "linkenddt")
    return join_validity(panel, link, "permno", "date", "linkdt", "linkenddt", "left")
