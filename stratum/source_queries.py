"""Queries of the readers: each writes what a provider would publish, made from the tables, and reads it back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query, rounded
from .shared import shared_path
from .sources import factors, macro, markets

#: Orders and customers by month, and two numbers made from them that stand for percentages.
_MONTHS = """WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1),
m AS (SELECT date, n, c, n % 97 - 40 AS a, c % 89 / 8e0 AS b FROM s)"""


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc("o_orderdate", "MM").alias("date")
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(month)
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c"))
    return counts.select("date", "n", "c", (F.col("n") % 97 - 40).alias("a"), (F.col("c") % 89 / 8.0).alias("b"))


def _csv(table: DataFrame) -> str:
    path = shared_path(table.sparkSession, "source")
    table.write.csv(path, header=True)
    return path


def _digits(day: str = "date") -> Column:
    return F.date_format(day, "yyyyMM")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


@query(f"""{_MONTHS} SELECT date, round(CASE WHEN n % 5 <> 0 THEN a / 1e2 END, 8) AS mkt_excess, round(b / 100, 8) AS smb, 0.0025e0 AS risk_free
FROM m WHERE date >= DATE '1996-01-01'""")
def french_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zipped file with words above, the monthly table, and a second table below; some hundred lines."""
    value = F.when(F.col("n") % 5 == 0, "-99.99").otherwise(_text("a"))
    lines = _months(spark, sf_dir).select(F.concat_ws(",   ", _digits(), value, _text("b"), F.lit("0.25")).alias("line"))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0).to_pylist():
                text = "\n".join(["Made from orders.", "", ",Mkt-RF,SMB,RF", *rows, "", " Annual Factors", ",Mkt-RF,SMB,RF", "1995, 1, 1, 1"])
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as archive:
                    archive.writestr("factors.csv", text)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], names=["content"])

    archives = lines.agg(F.sort_array(F.collect_list("line")).alias("lines")).mapInArrow(zipped, "content binary")
    return rounded(factors.french_factors(archives, "1996-01-01"), "mkt_excess", "smb")


@query(f"{_MONTHS} SELECT date, 0.003e0 AS risk_free, round(a / 1e2, 8) AS mkt_excess, round(b / 100, 8) AS me FROM m WHERE date <= DATE '2000-12-31'")
def q_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _months(spark, sf_dir)
    raw = months.select(F.year("date").alias("year"), F.month("date").alias("month"), F.lit("0.3").alias("R_F"), F.col("a").alias("R_MKT"), F.col("b").alias("R_ME"))
    return rounded(factors.read_q_factors(spark, _csv(raw), end_date="2000-12"), "risk_free", "mkt_excess", "me")


@query(f"""{_MONTHS} SELECT date, 'ORDERS' AS series, CASE WHEN n % 7 <> 0 THEN CAST(n AS DOUBLE) END AS value FROM m
UNION ALL SELECT date, 'BUYERS', CAST(c AS DOUBLE) FROM m""")
def fred_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _months(spark, sf_dir)
    orders = months.select(F.col("date").alias("observation_date"), F.when(F.col("n") % 7 == 0, ".").otherwise(_text("n")).alias("ORDERS"))
    return macro.read_series(spark, {"ORDERS": _csv(orders), "BUYERS": _csv(months.select("date", F.col("c").alias("BUYERS")))})


@query(f"""{_MONTHS} SELECT 'S' || k AS symbol, date, CASE WHEN n % 3 <> 0 THEN CAST(n AS DOUBLE) END AS volume, CAST(a AS DOUBLE) AS open,
a - 1e0 AS low, a + 1e0 AS high, b AS close, b + k AS adjusted_close FROM m, range(1, 4) AS r(k) WHERE date BETWEEN DATE '1995-06-01' AND DATE '2000-06-30'""")
def stock_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response for each symbol, with parallel arrays of its days; a fourth response has no data."""
    symbols = _months(spark, sf_dir).crossJoin(F.broadcast(spark.range(1, 4).withColumnRenamed("id", "k")))  # three symbols
    c = F.col
    volume = F.when(c("n") % 3 != 0, c("n")).alias("volume")
    day = F.struct("date", volume, c("a").alias("open"), (c("a") - 1).alias("low"), (c("a") + 1).alias("high"), c("b").alias("close"), (c("b") + c("k")).alias("adjclose"))
    days = symbols.groupBy("k").agg(F.sort_array(F.collect_list(day)).alias("d"))
    quote = F.struct(*(c(f"d.{x}").alias(x) for x in ("volume", "open", "low", "high", "close")))
    indicators = F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.col("d.adjclose").alias("adjclose"))).alias("adjclose"))
    times = F.transform("d.date", lambda x: F.unix_timestamp(x.cast("timestamp")))
    result = F.struct(F.struct(F.concat(F.lit("S"), _text("k")).alias("symbol")).alias("meta"), times.alias("timestamp"), indicators.alias("indicators"))
    keep = {"ignoreNullFields": "false"}
    responses = days.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), keep).alias("value"))
    none = spark.range(1).select(F.lit('{"chart": {"result": null}}').alias("value"))
    return markets.stock_prices(responses.unionByName(none), "1995-06-01", "2000-06-30")


@query(f"{_MONTHS} SELECT date, round(a / 1e2, 8) AS book_to_market, round(b / 100, 8) AS size10 FROM m")
def characteristic_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _months(spark, sf_dir).select(F.last_day("date").alias("date"), F.col("a").alias("BookToMarket"), F.col("b").alias("Size10"))
    return rounded(factors.read_characteristic_portfolios(spark, _csv(raw)), "book_to_market", "size10")


@query(f"""{_MONTHS} SELECT date, CAST(a AS DOUBLE) AS agg_liquidity, b AS innovations, CASE WHEN n % 5 <> 0 THEN n / 1e2 END AS traded_liquidity
FROM m WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def liquidity_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    traded = F.when(F.col("n") % 5 == 0, "-99").otherwise((F.col("n") / 100).cast("string"))
    lines = _months(spark, sf_dir).select(F.concat_ws("\t ", _digits(), _text("a"), _text("b"), traded).alias("value"))
    path = shared_path(spark, "source")
    lines.unionByName(spark.createDataFrame([("% Month\tlevels\tinnovations\ttraded",), ("",)], "value string")).write.text(path)
    return factors.read_liquidity_factors(spark, path, "1996-01", "1999-12")


@query(f"{_MONTHS} SELECT date, CAST(a AS DOUBLE) AS mkt_excess, b AS smb, CAST(c AS DOUBLE) AS mgmt, n / 1e2 AS perf, 0.5e0 AS risk_free FROM m")
def mispricing_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    raw = _months(spark, sf_dir).select(_digits().alias("YYYYMM"), c("a").alias("MKTRF"), c("b").alias("SMB"), c("c").alias("MGMT"), (c("n") / 100).alias("PERF"), F.lit(0.5).alias("RF"))
    return factors.read_mispricing_factors(spark, _csv(raw))


@query(f"{_MONTHS} SELECT 'usa' AS location, date, CASE WHEN n % 5 <> 0 THEN b / 100 END AS ret, CAST(n % 3 AS INT) AS pf FROM m WHERE date >= DATE '1997-01-01'")
def global_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ret = F.when(F.col("n") % 5 == 0, "na").otherwise((F.col("b") / 100).cast("string"))
    raw = _months(spark, sf_dir).select(F.lit("usa").alias("location"), F.last_day("date").alias("date"), ret.alias("ret"), (F.col("n") % 3).cast("double").alias("pf"))
    return factors.read_global_factors(spark, _csv(raw), start_date="1997-01-01")


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CAST(ts AS DATE) AS date FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def trades_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "source")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_date("ts").alias("date"))
    rows.repartition("date").write.partitionBy("date").parquet(path)
    return factors.read_trades_by_day(spark, path, "2024-01-05", "2024-01-20")


#: Sorts by three variables, with two lags and two numbers of portfolios each.
_GRID = """g AS (SELECT i AS id, 'v' || i % 3 AS sorting_variable, CASE WHEN i % 2 = 0 THEN '6m' ELSE '1m' END AS sorting_variable_lag,
CASE WHEN i < 6 THEN 5 ELSE 10 END AS n_portfolios_main, 'univariate' AS sorting_method FROM range(12) AS r(i))"""


@query(f"""{_MONTHS}, {_GRID} SELECT g.id, date, b + g.id AS ret, sorting_variable, sorting_variable_lag, CAST(n_portfolios_main AS INT) AS n_portfolios_main
FROM m, g WHERE sorting_variable IN ('v0', 'v2') AND sorting_variable_lag = '6m' AND n_portfolios_main = 10 AND date >= DATE '1998-01-01'""")
def factor_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns in folders of variable and lag; settings that are not asked for have their defaults."""
    i = F.col("id")
    variable, lag = F.concat(F.lit("sv_v"), (i % 3).cast("string")), F.when(i % 2 == 0, "6m").otherwise("1m")
    numbers = F.when(i < 6, 5).otherwise(10).alias("n_portfolios_main")
    grid = spark.range(12).select("id", variable.alias("sorting_variable"), lag.alias("sorting_variable_lag"), numbers, F.lit("univariate").alias("sorting_method"))
    keys = ["sorting_variable", "sorting_variable_lag"]
    rows = _months(spark, sf_dir).crossJoin(F.broadcast(grid)).select("id", "date", (F.col("b") + i).alias("ret"), *keys)  # twelve settings
    path = shared_path(spark, "source")
    rows.repartition(*keys).write.partitionBy(*keys).parquet(path)
    out = factors.read_factor_library(spark, path, grid, start_date="1998-01-01", sorting_variable=["v0", "sv_v2"])
    return out.select("id", "date", "ret", *keys, "n_portfolios_main")
