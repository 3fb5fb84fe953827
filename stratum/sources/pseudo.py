"""Pseudo data with the schemas of the real panels: the same for a seed and number of assets, however it is partitioned.

Every number is a hash of seed, asset, date and name, so no generator has a state to share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Shares of industries and exchanges, and the SIC codes of each industry.
INDUSTRIES = [
    ("Agriculture", 0.00319, 100, 999),
    ("Construction", 0.0113, 1500, 1799),
    ("Finance", 0.185, 6000, 6799),
    ("Manufacturing", 0.339, 1800, 3999),
    ("Mining", 0.0508, 1000, 1499),
    ("Public", 0.0779, 9000, 9999),
    ("Retail", 0.0620, 5200, 5999),
    ("Services", 0.169, 7000, 8999),
    ("Transportation", 0.0493, 4000, 4899),
    ("Utilities", 0.0180, 4900, 4999),
    ("Wholesale", 0.0357, 5000, 5199),
]
EXCHANGES = [("AMEX", 0.113), ("NASDAQ", 0.671), ("NYSE", 0.216)]


def uniform(seed: int, name: str, *keys: str) -> Column:
    """A number in (0, 1)."""
    bits = F.xxhash64(F.lit(seed), F.lit(name), *keys)
    return (F.shiftrightunsigned(bits, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, name: str, *keys: str) -> Column:
    radius = F.sqrt(-2 * F.ln(uniform(seed, f"{name} radius", *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, f"{name} angle", *keys))


def _drawn(u: Column, shares: list[tuple[str, float]]) -> Column:
    total, at, out = sum(s for _, s in shares), 0.0, None
    for name, share in shares[:-1]:
        at += share / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(shares[-1][0])


def identifiers(spark: SparkSession, n_assets: int = 1000, seed: int = 1234) -> DataFrame:
    """permno, permco, gvkey, exchange, industry, siccd of each asset; all datasets share them."""
    out = spark.range(1, n_assets + 1).select(F.col("id").alias("permno"), F.col("id").alias("permco"), F.lpad((F.col("id") + 10000).cast("string"), 6, "0").alias("gvkey"))
    out = out.withColumn("exchange", _drawn(uniform(seed, "exchange", "permno"), EXCHANGES)).withColumn("industry", _drawn(uniform(seed, "industry", "permno"), [(n, s) for n, s, _, _ in INDUSTRIES]))
    low = F.create_map(*(F.lit(x) for n, _, a, _ in INDUSTRIES for x in (n, a)))[F.col("industry")]
    high = F.create_map(*(F.lit(x) for n, _, _, b in INDUSTRIES for x in (n, b)))[F.col("industry")]
    return out.withColumn("siccd", (low + F.floor(uniform(seed, "siccd", "permno") * (high - low + 1))).cast("int"))


def _over(ids: DataFrame, start: str, end: str, step: str, weekdays: bool = False) -> DataFrame:
    """Each asset on each date."""
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"INTERVAL {step}"))
    out = ids.withColumn("date", F.explode(dates))
    return out.where(F.weekday("date") < 5) if weekdays else out


def crsp_monthly(spark: SparkSession, start: str, end: str, n_assets: int = 1000, seed: int = 1234) -> DataFrame:
    s, keys = seed + 1, ("permno", "date")
    rows = _over(identifiers(spark, n_assets, seed), start, end, "1 MONTH")
    rows = rows.withColumn("shrout", 1000 * (1 + 49 * uniform(s, "shrout", *keys))).withColumn("prc", 1 + 999 * uniform(s, "prc", *keys)).withColumn("ret", 0.008 + 0.1 * normal(s, "ret", *keys))
    order = Window.partitionBy("permno").orderBy("date")
    rows = rows.withColumn("mktcap", F.col("shrout") * F.col("prc") / 1000).withColumn("mktcap_lag", F.lag("mktcap").over(order)).withColumn("listing_age", F.row_number().over(order) - 1)
    letter = F.when(F.col("exchange") == "NYSE", "N").when(F.col("exchange") == "AMEX", "A").otherwise("Q")
    excess = F.greatest(F.col("ret") - 0.004 * uniform(s, "free", *keys), F.lit(-1.0))
    return rows.select("permno", "date", F.last_day("date").alias("calculation_date"), "ret", "shrout", "prc", letter.alias("primaryexch"), "siccd", "listing_age", "mktcap", "mktcap_lag", "exchange", "industry", excess.alias("ret_excess"))


def crsp_daily(spark: SparkSession, start: str, end: str, n_assets: int = 1000, seed: int = 1234) -> DataFrame:
    s, keys = seed + 2, ("permno", "date")
    rows = _over(identifiers(spark, n_assets, seed), start, end, "1 DAY", weekdays=True).withColumn("ret", 0.0004 + 0.02 * normal(s, "ret", *keys))
    return rows.select("permno", "date", "ret", F.greatest(F.col("ret") - 0.0002 * uniform(s, "free", *keys), F.lit(-1.0)).alias("ret_excess"))


def _grown(rows: DataFrame, seed: int, mean: float, deviation: float, name: str) -> DataFrame:
    running = Window.partitionBy("gvkey").orderBy("datadate").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, 100 * F.exp(F.sum(mean + deviation * normal(seed, name, "gvkey", "datadate")).over(running)))


#: Items of the annual accounts as ranges of shares of assets.
ITEMS = {"seq": (0.2, 0.6), "lt": (0.3, 0.7), "txditc": (0.0, 0.03), "pstk": (0.0, 0.02), "sale": (0.5, 1.5), "cogs": (0.2, 0.8), "xint": (0.0, 0.05), "xsga": (0.05, 0.3), "ib": (-0.05, 0.15), "capx": (0.0, 0.1), "oancf": (-0.05, 0.2)}


def compustat_annual(spark: SparkSession, start: str, end: str, n_assets: int = 1000, seed: int = 1234) -> DataFrame:
    s = seed + 4
    ids = identifiers(spark, n_assets, seed)
    rows = _over(ids, f"{start[:4]}-12-31", end, "1 YEAR").withColumnRenamed("date", "datadate")
    rows = _grown(rows, s, 0.05, 0.3, "at")
    for item, (low, high) in ITEMS.items():
        rows = rows.withColumn(item, F.col("at") * (low + (high - low) * uniform(s, item, "gvkey", "datadate")))
    be = F.col("seq") + F.col("txditc") - F.col("pstk")
    rows = rows.withColumn("be", F.when(be > 0, be)).withColumn("op", (F.col("sale") - F.col("cogs") - F.col("xsga") - F.col("xint")) / F.col("be"))
    rows = rows.withColumn("at_lag", F.lag("at").over(Window.partitionBy("gvkey").orderBy("datadate"))).withColumn("inv", F.col("at") / F.col("at_lag") - 1)
    return rows.select("gvkey", F.trunc("datadate", "MM").alias("date"), "datadate", "at", *ITEMS, "be", "op", "at_lag", "inv")


def compustat_quarterly(spark: SparkSession, start: str, end: str, n_assets: int = 1000, seed: int = 1234) -> DataFrame:
    s = seed + 3
    rows = _over(identifiers(spark, n_assets, seed), f"{start[:4]}-03-01", end, "3 MONTH").withColumn("datadate", F.last_day("date"))
    rows = _grown(rows, s, 0.012, 0.15, "atq")
    return rows.select("gvkey", "date", "datadate", "atq", (F.col("atq") * (0.2 + 0.4 * uniform(s, "ceqq", "gvkey", "datadate"))).alias("ceqq"))


def ccm_links(spark: SparkSession, n_assets: int = 1000, seed: int = 1234) -> DataFrame:
    ids = identifiers(spark, n_assets, seed)
    return ids.select("permno", "gvkey", F.lit("1925-12-31").cast("date").alias("linkdt"), F.lit("2099-12-31").cast("date").alias("linkenddt"))


DATASETS = {"crsp_monthly": crsp_monthly, "crsp_daily": crsp_daily, "compustat_annual": compustat_annual, "compustat_quarterly": compustat_quarterly}


def pseudo_data(spark: SparkSession, dataset: str, start_date: str = "2000-01-01", end_date: str = "2020-12-31", n_assets: int = 1000, seed: int = 1234) -> DataFrame:
    import warnings

    warnings.warn("Pseudo data are random numbers and of no use for research.", stacklevel=2)
    if dataset == "ccm_links":
        return ccm_links(spark, n_assets, seed)
    if dataset not in DATASETS:
        raise ValueError(f"Unsupported pseudo dataset: {dataset!r}.")
    return DATASETS[dataset](spark, start_date, end_date, n_assets, seed)
