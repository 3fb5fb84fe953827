"""From raw vendor tables to panels in one call: validity joins, samples of securities, first dates, links."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import require_columns, table_function
from ..sources.dates import between_dates, date_bounds
from . import accounting, bonds, stocks

#: Share codes of common stocks in the older format; the last day it has.
SHARE_CODES, LAST_OF_OLDER = (10, 11), "2024-12-31"
#: What an adjustment of volume needs, in the newer and the older format.
VOLUME_COLUMNS = {"v2": ("dlyprc", "dlyvol", "dlyfacprc", "primaryexch"), "v1": ("prc", "vol", "cfacpr", "exchcd")}
DATASETS = ("crsp_monthly", "crsp_daily", "compustat_annual", "compustat_quarterly", "ccm_links", "fisd", "trace_enhanced")


def _named(df: DataFrame, names: dict[str, str], more: list[str]) -> DataFrame:
    """Columns of df by their new names, and more by their own."""
    require_columns(df, [*names.values(), *more])
    return df.select(*(F.col(old).alias(new) for new, old in names.items()), *(c for c in more if c not in names))


def _common(names: DataFrame, version: str, keep: list[str]) -> DataFrame:
    """The name intervals of common stocks with the columns of keep."""
    if version == "v2":
        return names.where(stocks.COMMON_STOCK).select("permno", "secinfostartdt", "secinfoenddt", *keep)
    return names.where(F.col("shrcd").isin(*SHARE_CODES)).select("permno", "namedt", "nameendt", *keep)


@table_function
def crsp_monthly_raw(
    returns: DataFrame, names: DataFrame, risk_free: DataFrame, start_date: str | None = None, end_date: str | None = None,
    additional_columns: list[str] | None = None,
) -> DataFrame:
    """The monthly panel of the newer format from its raw tables.

    returns: permno, mthcaldt, mthret, shrout, mthprc; names: permno, secinfostartdt, secinfoenddt and the columns that
    stocks.COMMON_STOCK asks for, siccd. A month is taken where a name interval of a common stock holds its day; the first
    date of a security is that of its first interval of any kind. Extra columns come from either table.
    """
    more = list(additional_columns or [])
    of_names = [c for c in more if c not in returns.columns and c not in ("primaryexch", "siccd")]
    base = {"permno": "permno", "date": "mthcaldt", "ret": "mthret", "shrout": "shrout", "prc": "mthprc"}
    rows = between_dates(_named(returns, base, [c for c in more if c in returns.columns]), start_date, end_date)
    kept = _common(names, "v2", ["primaryexch", "siccd", *of_names])
    rows = stocks.with_names(rows, kept, "secinfostartdt", "secinfoenddt")
    first = names.groupBy("permno").agg(F.min("secinfostartdt").alias("first_crsp_date"))
    rows = rows.join(first, "permno", "left")
    return stocks.crsp_monthly.__wrapped__(rows, risk_free)


@table_function
def crsp_monthly_v1_raw(
    returns: DataFrame, names: DataFrame, delistings: DataFrame, risk_free: DataFrame, start_date: str | None = None,
    end_date: str | None = None, additional_columns: list[str] | None = None,
) -> DataFrame:
    """The monthly panel of the older format from its raw tables.

    returns: permno, date, ret, shrout, altprc, cfacpr; names: permno, namedt, nameendt, shrcd, exchcd, siccd;
    delistings: permno, dlstdt, dlret, dlstcd.
    """
    base = {c: c for c in ("permno", "date", "ret", "shrout", "altprc", "cfacpr")}
    rows = between_dates(_named(returns, base, list(additional_columns or [])), start_date, end_date)
    rows = stocks.with_names(rows, _common(names, "v1", ["exchcd", "siccd"]), "namedt", "nameendt")
    first = names.groupBy("permno").agg(F.min("namedt").alias("first_crsp_date"))
    return stocks.crsp_monthly_v1.__wrapped__(rows, delistings, first, risk_free)


@table_function
def crsp_daily_raw(
    returns: DataFrame, names: DataFrame, risk_free: DataFrame, start_date: str | None = None, end_date: str | None = None,
    delistings: DataFrame | None = None, version: str = "v2", additional_columns: list[str] | None = None,
    adjust_volume: bool = False,
) -> DataFrame:
    """The daily panel from raw tables of either format; the older one needs the delistings.

    Extra columns come from the daily table or else from the names.
    """
    more = list(additional_columns or [])
    if adjust_volume and not set(VOLUME_COLUMNS[version]) <= set(more):
        raise ValueError(f"adjust_volume needs the extra columns {', '.join(VOLUME_COLUMNS[version])}.")
    newer = version == "v2"
    base = {"permno": "permno", "date": "dlycaldt" if newer else "date", "ret": "dlyret" if newer else "ret"}
    own = [c for c in more if c in returns.columns]
    rows = between_dates(_named(returns, base, own), start_date, end_date)
    rows = rows.withColumn("date", F.col("date").cast("date"))
    securities = rows.select("permno").distinct()
    kept = _common(names, version, [c for c in more if c not in own])
    rows = stocks.with_names(rows, kept, *(("secinfostartdt", "secinfoenddt") if newer else ("namedt", "nameendt")))
    if newer:
        out = stocks.crsp_daily.__wrapped__(rows, risk_free, adjust_volume)
        return out.drop("dlyvol", "dlyprc", "dlyfacprc") if adjust_volume else out
    if delistings is None:
        raise ValueError("The older format needs the table of delistings.")
    rows = rows.dropna(subset=["permno", "date", "ret"])
    # Delistings of all securities with a row in the span count, of common stock or not.
    held = delistings.join(securities, "permno", "left_semi")
    return stocks.crsp_daily_v1.__wrapped__(rows, held, risk_free, end_date or LAST_OF_OLDER, adjust_volume)


def load_raw(
    dataset: str, tables: Mapping[str, DataFrame], start_date: str | None = None, end_date: str | None = None,
    version: str = "v2", additional_columns: list[str] | None = None, add_ccm_links: bool = False,
    adjust_volume: bool = False, cusips: list[str] | None = None, as_of: str | None = None, only_usd: bool = False,
) -> DataFrame:
    """A panel of the security, accounting or bond data, from tables by name.

    crsp_monthly, crsp_daily: returns, names, risk_free (and delistings for v1; ccm_links for add_ccm_links);
    compustat_annual, compustat_quarterly: reports; ccm_links: links; fisd: issues, issuers; trace_enhanced: trades, of
    which those of the given 9-character CUSIPs are taken. as_of: the day to which links without an end last.
    """
    if dataset.startswith("wrds_"):
        warnings.warn("Names with the prefix 'wrds_' are older ones.", DeprecationWarning, stacklevel=2)
        dataset = dataset.removeprefix("wrds_")
    if dataset not in DATASETS:
        raise ValueError(f"{dataset!r} is not one of {', '.join(DATASETS)}.")
    if version not in ("v1", "v2"):
        raise ValueError("version is 'v1' or 'v2'.")
    if adjust_volume and dataset != "crsp_daily":
        raise ValueError("adjust_volume goes with 'crsp_daily' only.")
    _, end = date_bounds(start_date, end_date)
    older = version == "v1" and dataset.startswith("crsp")
    if older and end and str(end) > LAST_OF_OLDER:
        raise ValueError(f"Version 'v1' ends on {LAST_OF_OLDER}.")
    needed = {
        "crsp_monthly": ["returns", "names", "risk_free"] + ["delistings"] * older,
        "crsp_daily": ["returns", "names", "risk_free"] + ["delistings"] * older,
        "ccm_links": ["links"],
        "fisd": ["issues", "issuers"],
        "trace_enhanced": ["trades"],
    }.get(dataset, ["reports"])
    needed += ["ccm_links"] * add_ccm_links
    if missing := [t for t in needed if t not in tables]:
        raise ValueError(f"{dataset} needs the tables {', '.join(missing)}.")
    bounds = {"start_date": start_date, "end_date": end_date, "additional_columns": additional_columns}
    t = tables
    if dataset == "crsp_monthly" and older:
        out = crsp_monthly_v1_raw(t["returns"], t["names"], t["delistings"], t["risk_free"], **bounds)
    elif dataset == "crsp_monthly":
        out = crsp_monthly_raw(t["returns"], t["names"], t["risk_free"], **bounds)
    elif dataset == "crsp_daily":
        more = {"delistings": t.get("delistings"), "version": version, "adjust_volume": adjust_volume}
        out = crsp_daily_raw(t["returns"], t["names"], t["risk_free"], **bounds, **more)
    elif dataset == "ccm_links":
        out = stocks.ccm_links(t["links"], as_of or "9999-12-31")
    elif dataset == "fisd":
        out = bonds.fisd_bonds(t["issues"], t["issuers"], additional_columns)
    elif dataset == "trace_enhanced":
        trades = between_dates(bonds.trades_of(t["trades"], cusips), start_date, end_date, "trd_exctn_dt")
        out = bonds.process_trace_data(trades)
    else:
        reports = between_dates(t["reports"], start_date, end_date, "datadate")
        if dataset == "compustat_annual":
            out = accounting.compustat_annual(reports, only_usd)
        else:
            out = accounting.compustat_quarterly(reports, only_usd, additional_columns)
    if add_ccm_links:
        out = stocks.add_gvkey(out, stocks.ccm_links(t["ccm_links"], as_of or "9999-12-31"))
    return out
