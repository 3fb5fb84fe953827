"""Index constituents and daily stock prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dates import between_dates

# Each exchange's name in the files, the suffix of its listings' symbols, and its currency (else none, and USD).
EXCHANGES = [
    ("Xetra", ".DE", "EUR"),
    ("Deutsche Börse AG", ".DE", "EUR"),
    ("Boerse Berlin", ".BE", "EUR"),
    ("Borsa Italiana", ".MI", "EUR"),
    ("Nyse Euronext - Euronext Paris", ".PA", "EUR"),
    ("Euronext Amsterdam", ".AS", "EUR"),
    ("Nasdaq Omx Helsinki Ltd.", ".HE", "EUR"),
    ("Singapore Exchange", ".SI", "SGD"),
    ("Asx - All Markets", ".AX", "AUD"),
    ("London Stock Exchange", ".L", "GBP"),
    ("SIX Swiss Exchange", ".SW", "CHF"),
    ("Tel Aviv Stock Exchange", ".TA", "ILS"),
    ("Tokyo Stock Exchange", ".T", "JPY"),
    ("Hong Kong Stock Exchange", ".HK", "HKD"),
    ("Toronto Stock Exchange", ".TO", "CAD"),
    ("Euronext Brussels", ".BR", "EUR"),
    ("Euronext Lisbon", ".LS", "EUR"),
    ("Bovespa", ".SA", "BRL"),
    ("Mexican Stock Exchange", ".MX", "MXN"),
    ("Stockholm Stock Exchange", ".ST", "SEK"),
    ("Oslo Stock Exchange", ".OL", "NOK"),
    ("Johannesburg Stock Exchange", ".J", "ZAR"),
    ("Korea Exchange", ".KS", "KRW"),
    ("Shanghai Stock Exchange", ".SS", "CNY"),
    ("Shenzhen Stock Exchange", ".SZ", "CNY"),
]
HEADERS = {"symbol": ("Ticker", "Emittententicker"), "name": ("Name",), "location": ("Location", "Standort"), "exchange": ("Exchange", "Börse"), "kind": ("Asset Class", "Anlageklasse")}
CHART = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<volume:array<double>,open:array<double>,low:array<double>,high:array<double>,close:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>"


def _mapped(column: Column, values: dict[str, str], otherwise: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, column), F.lit(otherwise))


def index_constituents(raw: DataFrame, index_name: str = "", blacklist: tuple[str, ...] = ()) -> DataFrame:
    """Shares among a fund's holdings: symbol, name, location, exchange, currency; German or English headers."""
    names = {c.strip(): c for c in raw.columns}
    pick = lambda role: next((F.trim(F.col(f"`{names[h]}`")) for h in HEADERS[role] if h in names), None)
    kind = pick("kind")
    rows = raw.where(kind.isin("Equity", "Aktien")) if kind is not None else raw
    out = rows.select(*(F.coalesce(pick(r), F.lit("")).alias(r) for r in ("symbol", "name", "location", "exchange")))
    out = out.where((F.col("symbol") != "") & (F.col("name") != "") & ~F.col("symbol").isin(*blacklist or ("",)))
    tight = F.regexp_replace(F.lower("name"), " ", "")
    if index_name:
        out = out.where(~F.lower("name").contains(index_name.lower()) & ~tight.contains(index_name.lower().replace(" ", "")))
    out = out.where(~F.lower("name").rlike(r"\bcash\b"))
    symbol = F.when(F.col("name") == "NATIONAL BANK OF CANADA", "NA").otherwise(F.regexp_replace("symbol", "[ /]", "-"))
    suffix = _mapped(F.col("exchange"), {n: x for n, x, _ in EXCHANGES}, "")
    return out.select(F.regexp_replace(F.concat(symbol, suffix), r"\.\.", ".").alias("symbol"), "name", "location", "exchange", _mapped(F.col("exchange"), {n: c for n, _, c in EXCHANGES}, "USD").alias("currency"))


def stock_prices(responses: DataFrame, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Daily prices from chart responses (a column `value` of JSON): parallel arrays become rows; a response without data has none."""
    result = F.from_json("value", CHART)["chart"]["result"][0]
    quote, adjusted = F.col("r.indicators.quote")[0], F.col("r.indicators.adjclose")[0]["adjclose"]
    rows = responses.select(result.alias("r")).where("r.timestamp IS NOT NULL")
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), *(quote[c].alias(c) for c in ("volume", "open", "low", "high", "close")), adjusted.alias("adjusted_close"))
    rows = rows.select(F.col("r.meta.symbol").alias("symbol"), F.explode(zipped).alias("z"))
    out = rows.select("symbol", F.timestamp_seconds("z.t").cast("date").alias("date"), *(F.col(f"z.{c}").alias(c) for c in ("volume", "open", "low", "high", "close", "adjusted_close")))
    return between_dates(out, start_date, end_date)


def read_stock_prices(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    return stock_prices(spark.read.text(path, wholetext=True), start_date, end_date)
