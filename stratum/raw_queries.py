"""Queries of the pipelines that begin at raw vendor tables, and of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.quantile import linspace, trim, winsorize
from .operators.breakpoints import compute_breakpoints
from .operators.summary import create_summary_statistics
from .options import breakpoint_options
from .pipeline_queries import _AGE, _INDUSTRY, FREE, risk_free
from .plans.raw import load_raw
from .queries import DAILY, PANEL, daily, lerp_sql, panel, query, rounded, sorted_sql, written_panel
from .shared import materialize
from .sources import macro, markets

_COMMON = {
    "sharetype": "NS", "securitytype": "EQTY", "securitysubtype": "COM", "usincflg": "Y", "issuertype": "CORP",
    "conditionaltype": "RW", "tradingstatusflg": "A",
}
#: A security's names: an interval to 1996, and one from 1997 in which every fifth is a fund.
_SPLIT, _LAST = "1996-12-31", "2001-06-30"


def _first() -> Column:
    return F.make_date((F.lit(1990) + F.col("permno") % 3).cast("int"), F.lit(5), F.lit(20))


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _names(data: DataFrame) -> DataFrame:
    """The intervals of the newer format."""
    short = F.when(F.col("exchange") == "NASDAQ", "Q").otherwise(F.substring("exchange", 1, 1))
    firms = materialize(data.select("permno", short.alias("primaryexch"), "siccd").distinct(), "firms")
    firms = firms.select("*", *(F.lit(v).alias(k) for k, v in _COMMON.items()))
    early = firms.withColumn("secinfostartdt", _first()).withColumn("secinfoenddt", _day(_SPLIT))
    later = firms.withColumn("secinfostartdt", F.date_add(_day(_SPLIT), 1)).withColumn("secinfoenddt", _day(_LAST))
    later = later.withColumn("securitytype", F.when(F.col("permno") % 5 == 0, "FUND").otherwise("EQTY"))
    return early.unionByName(later)


_RAW = f"""s AS (SELECT permno, date, ret_excess AS ret, be + 60 AS shrout, prc_adj AS prc, siccd, exchange,
  make_date(1990 + CAST(permno % 3 AS INT), 5, 20) AS first FROM panel WHERE CAST(date + 9 AS DATE) <= DATE '{_SPLIT}' OR (permno % 5 <> 0 AND CAST(date + 9 AS DATE) <= DATE '{_LAST}'))"""


@query(
    f"""WITH {PANEL}, {FREE}, {_RAW}, m AS (SELECT *, nullif(shrout * 1000 * prc / 1e6, 0) AS mktcap FROM s)
SELECT m.permno, m.date, CAST(m.date + 9 AS DATE) AS calculation_date, {_AGE.format("m.first").replace("(date)", "(m.date)")} AS listing_age,
  round(m.mktcap, 8) AS mktcap, round(b.mktcap, 8) AS mktcap_lag, m.exchange, {_INDUSTRY.replace("siccd", "m.siccd")} AS industry, round(m.ret - risk_free, 8) AS ret_excess
FROM m LEFT JOIN m b ON b.permno = m.permno AND CAST(b.date + INTERVAL 1 MONTH AS DATE) = m.date LEFT JOIN free ON free.date = m.date
WHERE m.ret - risk_free IS NOT NULL AND m.mktcap IS NOT NULL"""
)
def crsp_monthly_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, c = written_panel(spark, sf_dir, "permno date ret_excess prc_adj be exchange siccd"), F.col
    returns = data.select(
        "permno", F.date_add("date", 9).alias("mthcaldt"), c("ret_excess").alias("mthret"), (c("be") + 60).alias("shrout"),
        c("prc_adj").alias("mthprc"),
    )
    out = load_raw("crsp_monthly", {"returns": returns, "names": _names(data), "risk_free": risk_free(data)})
    wanted = "permno date calculation_date listing_age mktcap mktcap_lag exchange industry ret_excess".split()
    return rounded(out.select(*wanted), "mktcap", "mktcap_lag", "ret_excess")


@query(
    f"""WITH {PANEL}, {FREE}, {_RAW}, g AS (SELECT permno, date, CASE WHEN permno % 2 = 0 THEN 0.125e0 END AS dlret,
  CAST(400 + permno * 13 % 200 AS INT) AS code FROM panel WHERE listing_age = 20),
j AS (SELECT s.*, dlret, code FROM s LEFT JOIN g USING (permno, date))
SELECT j.permno, j.date, {_AGE.format("j.first").replace("(date)", "(j.date)")} AS listing_age, round(CASE WHEN code IS NULL THEN ret WHEN dlret IS NOT NULL THEN dlret
  WHEN code IN (500, 520, 580, 584) OR code BETWEEN 551 AND 574 THEN -0.3 WHEN code = 100 THEN ret ELSE -1 END, 8) AS ret_adj,
  round(prc / 2, 8) AS prc_adj, round(shrout * 1000 * prc / 1e6, 8) AS mktcap FROM j JOIN free USING (date)"""
)
def crsp_monthly_v1_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, c = written_panel(spark, sf_dir, "permno date ret_excess prc_adj be listing_age exchange siccd"), F.col
    returns = data.select(
        "permno", F.date_add("date", 9).alias("date"), c("ret_excess").alias("ret"), (c("be") + 60).alias("shrout"),
        (-c("prc_adj")).alias("altprc"), F.lit(2.0).alias("cfacpr"),
    )
    number = F.when(c("exchange") == "NYSE", 1).when(c("exchange") == "AMEX", 2).otherwise(3)
    firms = materialize(data.select("permno", number.alias("exchcd"), "siccd").distinct(), "firms")
    early = firms.select("*", _first().alias("namedt"), _day(_SPLIT).alias("nameendt"), (10 + c("permno") % 2).alias("shrcd"))
    code = F.when(c("permno") % 5 == 0, 14).otherwise(11).cast("bigint").alias("shrcd")
    later = firms.select("*", F.date_add(_day(_SPLIT), 1).alias("namedt"), _day(_LAST).alias("nameendt"), code)
    gone = data.where("listing_age = 20").select(
        "permno", F.date_add("date", 10).alias("dlstdt"), F.when(c("permno") % 2 == 0, 0.125).alias("dlret"),
        (400 + c("permno") * 13 % 200).cast("int").alias("dlstcd"),
    )
    tables = {"returns": returns, "names": early.unionByName(later), "delistings": gone, "risk_free": risk_free(data)}
    out = load_raw("crsp_monthly", tables, version="v1")
    return rounded(out.select("permno", "date", "listing_age", "ret_adj", "prc_adj", "mktcap"), "ret_adj", "prc_adj", "mktcap")


#: Days of users as trading days; every seventh user is delisted on a day that is a day of trading for some only.
_DAYS = f"""WITH {DAILY}, d AS (SELECT user_id AS permno, CAST(date - 8380 AS DATE) AS date, value / 1000 AS ret FROM daily),
c AS (SELECT * FROM d WHERE ret IS NOT NULL AND permno % 3 <> 2),
g AS (SELECT DISTINCT permno, DATE '2001-02-01' AS dlst, -0.25e0 AS dlret FROM d WHERE permno % 7 = 0),
a AS (SELECT c.permno, c.date, coalesce(dlret, ret) AS ret FROM c LEFT JOIN g ON g.permno = c.permno AND dlst = c.date
  UNION ALL SELECT permno, dlst, dlret FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.permno = g.permno AND c.date = dlst))"""


@query(
    f"""{_DAYS} SELECT a.permno, a.date, round(a.ret, 10) AS ret, round(a.ret - f.rf, 10) AS ret_excess FROM a LEFT JOIN g USING (permno)
LEFT JOIN (SELECT DISTINCT date, 0.0001e0 AS rf FROM d) f ON f.date = a.date WHERE a.date <= coalesce(dlst, DATE '2024-12-31')"""
)
def crsp_daily_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = daily(spark, sf_dir).select(c("user_id").alias("permno"), F.date_sub("date", 8380).alias("date"), (c("value") / 1000).alias("ret"))
    firms = rows.select("permno").distinct()
    names = firms.select("permno", _day("1990-01-01").alias("namedt"), _day("2010-01-01").alias("nameendt"), (c("permno") % 3 + 10).alias("shrcd"))
    gone = firms.where("permno % 7 = 0").select("permno", _day("2001-02-01").alias("dlstdt"), F.lit(-0.25).alias("dlret"))
    rates = rows.select("date").distinct().withColumn("risk_free", F.lit(0.0001))
    tables = {"returns": rows, "names": names, "delistings": gone, "risk_free": rates}
    out = load_raw("crsp_daily", tables, version="v1")
    return rounded(out.select("permno", "date", "ret", "ret_excess"), "ret", "ret_excess", digits=10)


#: Issues made from parts, whose conditions fail for some.
@query("""SELECT CAST(p_partkey AS VARCHAR) AS complete_cusip, p_size AS offering_amt, 's' || CAST(p_size AS VARCHAR) AS sic_code FROM part
WHERE p_type <> 'ECONOMY' AND (p_size % 3 <> 0 OR p_size % 2 = 0) AND p_size % 7 <> 0 AND p_retailprice < 1500""")
def fisd_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, c = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col
    size = c("p_size")
    made = {
        "complete_cusip": c("p_partkey").cast("string"),
        "offering_amt": size,
        "issue_id": c("p_partkey"),
        "issuer_id": size,
        "security_level": F.when(c("p_type") == "ECONOMY", "JUN").otherwise("SEN"),
        "yankee": F.when((size % 3 == 0) & (size % 2 != 0), "Y").when(size % 3 == 0, None).otherwise("N"),
        "bond_type": F.when(c("p_retailprice") < 1500, "CDEB").otherwise("UNKN"),
        "interest_frequency": F.lit("2"),
    }
    letters = "defaulted convertible coupon_change_indicator foreign_currency rule_144a perpetual".split()
    made |= {k: F.lit("N") for k in letters} | {"coupon_type": F.lit("F")}
    absent = (
        "slob security_pledge asset_backed defeased defeased_date pay_in_kind pay_in_kind_exp_date canadian fix_frequency "
        "private_placement filing_date settlement exchange putable unit_deal exchangeable preferred_security maturity "
        "offering_date dated_date coupon last_interest_date"
    ).split()
    made |= {k: F.lit(None).cast("string") for k in absent}
    issues = parts.select(*(v.alias(k) for k, v in made.items()))
    issuers = parts.select(size.alias("issuer_id")).distinct().select(
        "issuer_id", F.when(c("issuer_id") % 7 == 0, "CAN").otherwise("USA").alias("country_domicile"),
        F.concat(F.lit("s"), c("issuer_id").cast("string")).alias("sic_code"),
    )
    out = load_raw("fisd", {"issues": issues, "issuers": issuers})
    return out.select("complete_cusip", "offering_amt", "sic_code")


_Q = f"q AS (SELECT {sorted_sql('ret_excess')} AS s FROM panel)"


@query(
    f"WITH {PANEL}, {_Q} SELECT permno, date, round(least(greatest(ret_excess, {lerp_sql('s', 0.02)}), {lerp_sql('s', 1 - 0.02)}), 8) AS ret_excess FROM panel, q"
)
def winsorize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(winsorize(panel(spark, sf_dir), "ret_excess", 0.02).select("permno", "date", "ret_excess"), "ret_excess")


@query(
    f"WITH {PANEL}, q AS (SELECT date, {sorted_sql('bm')} AS s FROM panel GROUP BY date) SELECT permno, panel.date, round(bm, 8) AS bm FROM panel JOIN q USING (date) WHERE bm BETWEEN {lerp_sql('s', 0.1)} AND {lerp_sql('s', 1 - 0.1)}"
)
def trim_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trim(panel(spark, sf_dir), "bm", 0.1, by=["date"]).select("permno", "date", "bm"), "bm")


_DETAIL = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(
    f"WITH {PANEL} SELECT exchange, 'bm' AS variable, count(bm) AS count, "
    + ", ".join(f"round(quantile_cont(bm, {p}), 6) AS {n}" for n, p in _DETAIL.items())
    + " FROM panel WHERE bm IS NOT NULL AND ret_excess IS NOT NULL AND mktcap_lag IS NOT NULL GROUP BY exchange"
)
def summary_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = create_summary_statistics(panel(spark, sf_dir), ["bm", "ret_excess", "mktcap_lag"], by="exchange", detail=True, drop_na=True)
    points = {f"{int(p * 100)}%": n for n, p in _DETAIL.items()}
    out = out.where("variable = 'bm'").select("exchange", "variable", "count", *(F.col(f"`{k}`").alias(n) for k, n in points.items()))
    return rounded(out, *_DETAIL, digits=6)


@query(
    f"WITH {PANEL}, q AS (SELECT {sorted_sql('mktcap')} AS s FROM panel), b AS (SELECT [{', '.join(lerp_sql('s', p) for p in linspace(11))}] AS bs FROM q) SELECT k AS k, round(bs[k + 1], 8) AS b FROM b, unnest(range(11)) AS r(k)"
)
def breakpoints_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without groups: one set of breakpoints over the whole table."""
    out = compute_breakpoints(panel(spark, sf_dir), "mktcap", breakpoint_options(n_portfolios=10))
    return out.select(F.posexplode("breakpoints").alias("k", "b")).select("k", F.round("b", 8).alias("b"))


_PLACES = {0: ("London Stock Exchange", ".L", "GBP"), 1: ("Tokyo Stock Exchange", ".T", "JPY"), 2: ("Nasdaq", "", "USD")}
_CASE = "CASE s_nationkey % 3 " + " ".join(f"WHEN {k} THEN '{{{k}}}'" for k in _PLACES) + " END"


@query(f"""WITH s AS (SELECT s_suppkey, s_nationkey, s_name, {_CASE.format(*(p[0] for p in _PLACES.values()))} AS exchange,
  {_CASE.format(*(p[1] for p in _PLACES.values()))} AS suffix, {_CASE.format(*(p[2] for p in _PLACES.values()))} AS currency FROM supplier)
SELECT replace(replace('A ' || s_suppkey || '.', ' ', '-') || suffix, '..', '.') AS symbol, s_name AS name, CAST(s_nationkey AS VARCHAR) AS location, exchange, currency
FROM s WHERE s_nationkey % 4 <> 0 AND s_suppkey <> 1""")
def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings made from suppliers: cash among them, one blacklisted, German headers."""
    c, nation = F.col, F.col("s_nationkey")
    place = F.when(nation % 3 == 0, _PLACES[0][0]).when(nation % 3 == 1, _PLACES[1][0]).otherwise(_PLACES[2][0])
    raw = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("A "), c("s_suppkey").cast("string"), F.lit(".")).alias("Emittententicker"),
        F.concat(F.lit(" "), c("s_name")).alias("Name"), nation.cast("string").alias("Standort"), place.alias("Börse"),
        F.when(nation % 4 == 0, "Cash").otherwise("Aktien").alias("Anlageklasse"),
    )
    return markets.index_constituents(raw, "DAX", blacklist=("A 1.",))


@query("""WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS c FROM orders GROUP BY 1),
l AS (SELECT date, n, c, lag(n) OVER o AS n1, lag(c) OVER o AS c1, lag(c, 2) OVER o AS c2 FROM s WINDOW o AS (ORDER BY date))
SELECT date, '2024-05' AS vintage, round(ln(n) - ln(n1), 8) AS orders, round(c - 2 * c1 + c2, 8) AS customers FROM l""")
def macro_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel as published: a row of codes, then months."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.trunc("o_orderdate", "MM").alias("day"))
    counts = orders.agg(F.count(F.lit(1)).cast("string").alias("orders"), F.count_distinct("o_custkey").cast("string").alias("customers"))
    body = counts.select(F.date_format("day", "M/d/yyyy").alias("sasdate"), "orders", "customers")
    codes = spark.createDataFrame([("Transform:", "5", "3")], body.schema)
    return rounded(macro.macro_panel(codes.unionByName(body), vintage="2024-05"), "orders", "customers")
