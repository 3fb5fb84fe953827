"""One door to all datasets."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from . import factors, macro, markets, pseudo
from .catalog import ALIASES, frequency, is_legacy_type, parse_type, resolve_domain


def load_data(
    spark: SparkSession, domain: str, dataset: str | None = None, path: str | dict[str, str] | None = None,
    start_date: str | None = None, end_date: str | None = None, tables: dict[str, DataFrame] | None = None, **more: object,
) -> DataFrame:
    """A dataset in its normal form. path: where the provider's file, or files by name, were put; nothing is fetched.

    The first argument may also be a type, such as factors_ff_3_monthly. Raw security, accounting and bond data come in
    `tables`, from any Spark source (JDBC, Parquet), and go through stratum.plans.raw.load_raw with the other options.
    """
    if dataset is None and domain not in ALIASES and is_legacy_type(domain):
        warnings.warn(f"{domain!r} is a type; name a domain and a dataset.", DeprecationWarning, stacklevel=2)
        domain, dataset = parse_type(domain)
    domain = resolve_domain(domain)
    bounds = {"start_date": start_date, "end_date": end_date}
    if domain == "Pseudo Data":
        return pseudo.pseudo_data(spark, dataset or "crsp_monthly", **{k: v for k, v in bounds.items() if v}, **more)
    if domain == "WRDS":
        if tables is None:
            raise ValueError("'tables' must hold the raw tables, read with Spark.")
        from ..plans.raw import load_raw

        return load_raw(dataset or "", tables, start_date, end_date, **more)
    if path is None:
        raise ValueError("'path' must name the dataset's file.")
    name = (dataset or "").lower()
    if domain == "Fama-French":
        if "breakpoints" in name:
            return factors.read_french_breakpoints(spark, path, momentum="prior" in name)
        return factors.read_french_factors(spark, path, **bounds, **more)
    if domain == "Global Q":
        return factors.read_q_factors(spark, path, **bounds)
    if domain == "Goyal-Welch":
        return macro.macro_predictors(spark.read.csv(path, header=True), frequency(name), **bounds)
    if domain == "Index Constituents":
        return markets.index_constituents(spark.read.csv(path, header=True), dataset or "", **more)
    if domain == "FRED":
        if name in ("fred-md", "fred-qd"):
            return macro.macro_vintages(spark, path, **more) if isinstance(path, dict) else macro.macro_panel(spark.read.csv(path, header=True), **more)
        return macro.read_series(spark, path if isinstance(path, dict) else {dataset: path}, **bounds)
    if domain == "Stock Prices":
        return markets.read_stock_prices(spark, path, **bounds)
    if domain == "Open Source Asset Pricing":
        return factors.read_characteristic_portfolios(spark, path, **bounds)
    if domain == "Global Factor Data":
        return factors.read_global_factors(spark, path, **bounds, **more)
    if domain == "Pastor-Stambaugh":
        return factors.read_liquidity_factors(spark, path, **bounds)
    if domain == "Stambaugh-Yuan":
        return factors.read_mispricing_factors(spark, path, **bounds)
    if name == "risk_free":
        return factors.read_risk_free(spark, path, **bounds)
    if name == "high_frequency_sp500":
        return factors.read_trades_by_day(spark, path, **{k: v for k, v in bounds.items() if v})
    if name == "factor_library_grid":
        return spark.read.parquet(path)
    if name == "factor_library":
        return factors.read_factor_library(spark, path, **bounds, **more)
    raise ValueError(f"Unsupported dataset: {dataset!r}.")
