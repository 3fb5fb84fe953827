"""Queries of the pipelines and sources, over raw tables that are made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.transforms import holding_period_return, stationary
from .plans import accounting, bonds, stocks
from .queries import DAILY, PANEL, daily, panel, query, rounded, written_panel
from .sources import macro

FREE = "free AS (SELECT DISTINCT date, month(date) / 10000e0 AS risk_free FROM panel WHERE month(date) <> 7)"


def risk_free(data: DataFrame) -> DataFrame:
    """A rate for every month but July."""
    return data.select("date").distinct().where(F.month("date") != 7).withColumn("risk_free", F.month("date") / F.lit(10000.0))


_AGE = "greatest((year(date) - year({0})) * 12 + month(date) - month({0}) - CAST(day(date) < day({0}) AS INT), 0)"
_INDUSTRY = "CASE " + " ".join(f"WHEN siccd BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in [(1, 999, "Agriculture"), (1000, 1499, "Mining"), (1500, 1799, "Construction"), (2000, 3999, "Manufacturing"), (4000, 4899, "Transportation"), (4900, 4999, "Utilities"), (5000, 5199, "Wholesale"), (5200, 5999, "Retail"), (6000, 6799, "Finance"), (7000, 8999, "Services"), (9000, 9999, "Public")]) + " ELSE 'Missing' END"


@query(f"""WITH {PANEL}, {FREE}, s AS (SELECT permno, date, ret_excess AS ret, be + 60 AS shrout, CASE WHEN permno % 9 = 0 AND month(date) = 3 THEN 0 ELSE prc_adj END AS prc, siccd, exchange, make_date(1994 + CAST(permno % 5 AS INT), 5, 20) AS first FROM panel),
m AS (SELECT *, nullif(shrout * 1000 * prc / 1e6, 0) AS mktcap FROM s)
SELECT m.permno, m.date, CAST(m.date + 9 AS DATE) AS calculation_date, {_AGE.format('m.first').replace('(date)', '(m.date)')} AS listing_age, round(m.mktcap, 8) AS mktcap, round(b.mktcap, 8) AS mktcap_lag, m.exchange, {_INDUSTRY.replace('siccd', 'm.siccd')} AS industry, round(m.ret - risk_free, 8) AS ret_excess
FROM m LEFT JOIN m b ON b.permno = m.permno AND CAST(b.date + INTERVAL 1 MONTH AS DATE) = m.date LEFT JOIN free ON free.date = m.date WHERE m.ret - risk_free IS NOT NULL AND m.mktcap IS NOT NULL""")
def crsp_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = written_panel(spark, sf_dir, "permno date ret_excess prc_adj be exchange siccd")
    first = F.make_date((F.lit(1994) + F.col("permno") % 5).cast("int"), F.lit(5), F.lit(20))
    price = F.when((F.col("permno") % 9 == 0) & (F.month("date") == 3), 0.0).otherwise(F.col("prc_adj"))
    raw = data.select("permno", F.date_add("date", 9).alias("date"), F.col("ret_excess").alias("ret"), (F.col("be") + 60).alias("shrout"), price.alias("prc"), F.when(F.col("exchange") == "NASDAQ", "Q").otherwise(F.substring("exchange", 1, 1)).alias("primaryexch"), "siccd", first.alias("first_crsp_date"))
    out = stocks.crsp_monthly(raw, risk_free(data))
    return rounded(out.select("permno", "date", "calculation_date", "listing_age", "mktcap", "mktcap_lag", "exchange", "industry", "ret_excess"), "mktcap", "mktcap_lag", "ret_excess")


@query(f"""WITH {PANEL}, {FREE}, g AS (SELECT permno, date, CASE WHEN permno % 2 = 0 THEN 0.125e0 END AS dlret, CAST(400 + permno * 13 % 200 AS INT) AS code FROM panel WHERE (permno + listing_age) % 29 = 0),
j AS (SELECT p.permno, p.date, p.prc_adj, p.ret_excess AS ret, dlret, code FROM panel p LEFT JOIN g USING (permno, date))
SELECT j.permno, j.date, round(CASE WHEN code IS NULL THEN ret WHEN dlret IS NOT NULL THEN dlret WHEN code IN (500, 520, 580, 584) OR code BETWEEN 551 AND 574 THEN -0.3 WHEN code = 100 THEN ret ELSE -1 END, 8) AS ret_adj,
  round(prc_adj / 2, 8) AS prc_adj FROM j JOIN free USING (date)""")
def crsp_monthly_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = written_panel(spark, sf_dir, "permno date ret_excess prc_adj listing_age siccd")
    c = F.col
    gone = data.where((c("permno") + c("listing_age")) % 29 == 0).select("permno", F.date_add("date", 10).alias("dlstdt"), F.when(c("permno") % 2 == 0, 0.125).alias("dlret"), (400 + c("permno") * 13 % 200).cast("int").alias("dlstcd"))
    raw = data.select("permno", F.date_add("date", 20).alias("date"), c("ret_excess").alias("ret"), F.lit(1.0).alias("shrout"), (-c("prc_adj")).alias("altprc"), F.lit(2.0).alias("cfacpr"), F.lit(1).alias("exchcd"), "siccd")
    first = data.groupBy("permno").agg(F.min("date").alias("first_crsp_date"))
    return rounded(stocks.crsp_monthly_v1(raw, gone, first, risk_free(data)).select("permno", "date", "ret_adj", "prc_adj"), "ret_adj", "prc_adj")


@query(f"""WITH {DAILY}, d AS (SELECT user_id AS permno, CAST(date - 8380 AS DATE) AS date, value / 1000 AS ret, n, CASE WHEN n = 4 THEN -99 ELSE n * 100 END AS vol FROM daily WHERE value IS NOT NULL),
f AS (SELECT *, product(CASE WHEN n = 3 THEN 2e0 ELSE 1e0 END) OVER (PARTITION BY permno ORDER BY date) AS factor FROM d)
SELECT permno, date, round(abs(-5e0 * n) / factor, 8) AS prc_adj, round(CASE WHEN permno % 2 = 0 THEN nullif(vol, -99) / CASE WHEN date < DATE '2001-02-01' THEN 2e0 ELSE 1.8e0 END ELSE nullif(vol, -99) END, 8) AS vol_adj FROM f""")
def crsp_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = daily(spark, sf_dir).select(c("user_id").alias("permno"), F.date_sub("date", 8380).alias("date"), (c("value") / 1000).alias("ret"), (-5.0 * c("n")).alias("dlyprc"), F.when(c("n") == 4, -99).otherwise(c("n") * 100).alias("dlyvol"), F.when(c("n") == 3, 2.0).otherwise(1.0).alias("dlyfacprc"), F.when(c("user_id") % 2 == 0, "Q").otherwise("N").alias("primaryexch"))
    rates = rows.select("date").distinct().withColumn("risk_free", F.lit(0.0001))
    return rounded(stocks.crsp_daily(rows, rates, adjust_volume=True).select("permno", "date", "prc_adj", "vol_adj"), "prc_adj", "vol_adj")


#: A link of every firm to mid 1998, and a later one of every third that overlaps by a year and has no end.
_LINKS = "links AS (SELECT DISTINCT permno, lpad(CAST(permno AS VARCHAR), 6, '0') AS gvkey, DATE '1995-01-01' AS linkdt, DATE '1998-06-30' AS linkenddt FROM li UNION ALL SELECT DISTINCT permno, 'N' || permno, DATE '1997-07-01', DATE '2000-12-31' FROM li WHERE permno % 3 = 0)"


@query(f"WITH {PANEL}, {_LINKS} SELECT p.permno, p.date, gvkey FROM panel p LEFT JOIN links l ON l.permno = p.permno AND p.date BETWEEN linkdt AND linkenddt")
def ccm_link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = written_panel(spark, sf_dir, "permno date")
    firms = data.select("permno").distinct()
    day = lambda x: F.lit(x).cast("date")
    first = firms.select("permno", F.lpad(F.col("permno").cast("string"), 6, "0").alias("gvkey"), day("1995-01-01").alias("linkdt"), day("1998-06-30").alias("linkenddt"))
    later = firms.where("permno % 3 = 0").select("permno", F.concat(F.lit("N"), "permno").alias("gvkey"), day("1997-07-01").alias("linkdt"), day(None).alias("linkenddt"))
    kinds = first.unionByName(later).withColumn("linktype", F.lit("LU")).withColumn("linkprim", F.lit("P"))
    other = first.withColumn("gvkey", F.lit("X")).withColumn("linktype", F.lit("LS")).withColumn("linkprim", F.lit("P"))
    return stocks.add_gvkey(data, stocks.ccm_links(kinds.unionByName(other), "2000-12-31")).select("permno", "date", "gvkey")


#: Reports with holes in their items.
_REPORTS = """r AS (SELECT lpad(CAST(permno AS VARCHAR), 6, '0') AS gvkey, last_day(date) AS datadate, CASE WHEN permno % 3 <> 0 THEN qty / 2 END AS seq, qty / 3 AS ceq, CASE WHEN permno % 2 = 0 THEN qty / 50 END AS pstk, mktcap / 1000 AS assets, mktcap / 3000 AS lt,
CASE WHEN permno % 5 <> 0 THEN qty / 20 END AS txditc, qty / 30 AS txdb, qty / 90 AS itcb, qty AS sale, CASE WHEN permno % 7 <> 0 THEN qty / 4 END AS cogs, qty / 10 AS xsga, qty / 40 AS xint, CASE WHEN permno % 4 = 0 THEN 'CAD' ELSE 'USD' END AS curcd FROM li)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, qty = F.col("permno"), F.col("be") + 60
    when = lambda condition, value: F.when(condition, value)
    return panel(spark, sf_dir).select(
        F.lpad(p.cast("string"), 6, "0").alias("gvkey"), F.last_day("date").alias("datadate"), when(p % 3 != 0, qty / 2).alias("seq"), (qty / 3).alias("ceq"), when(p % 2 == 0, qty / 50).alias("pstk"), (F.col("mktcap") / 1000).alias("at"), (F.col("mktcap") / 3000).alias("lt"),
        when(p % 5 != 0, qty / 20).alias("txditc"), (qty / 30).alias("txdb"), (qty / 90).alias("itcb"), qty.alias("sale"), when(p % 7 != 0, qty / 4).alias("cogs"), (qty / 10).alias("xsga"), (qty / 40).alias("xint"), F.lit(None).cast("double").alias("pstkrv"), F.lit(None).cast("double").alias("pstkl"), when(p % 4 == 0, "CAD").otherwise("USD").alias("curcd"),
    )


@query(f"""WITH {PANEL}, {_REPORTS}, b AS (SELECT *, coalesce(seq, ceq + pstk, assets - lt) + coalesce(txditc, txdb + itcb, 0) - coalesce(pstk, 0) AS raw, row_number() OVER (PARTITION BY gvkey, year(datadate) ORDER BY datadate DESC) AS k FROM r),
y AS (SELECT *, CASE WHEN raw > 0 THEN raw END AS be, year(datadate) AS yr FROM b WHERE k = 1)
SELECT y.gvkey, CAST(date_trunc('month', y.datadate) AS DATE) AS date, round(y.be, 6) AS be, round((y.sale - coalesce(y.cogs, 0) - y.xsga - y.xint) / y.be, 6) AS op, round(y.assets / p.assets - 1, 6) AS inv FROM y LEFT JOIN y p ON p.gvkey = y.gvkey AND p.yr + 1 = y.yr WHERE y.curcd = 'USD'""")
def compustat_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accounting.compustat_annual(reports(spark, sf_dir), only_usd=True).select("gvkey", "date", "be", "op", "inv"), "be", "op", "inv", digits=6)


@query(f"""WITH {PANEL}, q AS (SELECT lpad(CAST(permno AS VARCHAR), 6, '0') AS gvkey, last_day(date) AS datadate, CASE WHEN month(date) % 3 = 0 THEN last_day(date) + 40 WHEN month(date) % 3 = 1 THEN CAST(date - 3 AS DATE) END AS rdq, CAST(quarter(date) AS INT) AS fqtr, CASE WHEN permno % 13 <> 0 THEN year(date) END AS fyearq, mktcap AS atq FROM li),
a AS (SELECT *, row_number() OVER (PARTITION BY gvkey, fyearq, fqtr ORDER BY datadate DESC) AS k FROM q WHERE fyearq IS NOT NULL)
SELECT gvkey, CAST(date_trunc('month', datadate) AS DATE) AS date, datadate, round(atq, 6) AS atq FROM a WHERE k = 1 AND (rdq IS NULL OR date_trunc('month', datadate) < rdq)""")
def compustat_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, m = panel(spark, sf_dir), F.month("date")
    rdq = F.when(m % 3 == 0, F.date_add(F.last_day("date"), 40)).when(m % 3 == 1, F.date_sub("date", 3))
    raw = data.select(F.lpad(F.col("permno").cast("string"), 6, "0").alias("gvkey"), F.last_day("date").alias("datadate"), rdq.alias("rdq"), F.quarter("date").alias("fqtr"), F.when(F.col("permno") % 13 != 0, F.year("date")).alias("fyearq"), F.col("mktcap").alias("atq"), F.col("mktcap").alias("ceqq"), F.lit("USD").alias("curcdq"))
    return rounded(accounting.compustat_quarterly(raw, only_usd=True).select("gvkey", "date", "datadate", "atq"), "atq", digits=6)


#: Trade reports made from events: repeated numbers, prices and volumes, so that messages find each other.
_MESSAGES = """m AS (SELECT 'B' || user_id % 20 AS cusip_id, event_id % 40 AS msg_seq_nb, CASE WHEN event_id % 3 = 0 THEN event_id % 37 END AS orig_msg_seq_nb, event_id % 4 * 100 AS vol, CAST(event_id % 3 + 99 AS DOUBLE) AS pr,
CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side, CASE WHEN user_id % 3 = 0 THEN 'C' ELSE 'D' END AS cntra, CAST(ts AS DATE) AS dt, CASE event_id % 9 WHEN 0 THEN 'X' WHEN 1 THEN 'C' WHEN 2 THEN 'Y' WHEN 3 THEN 'R' ELSE 'T' END AS st,
CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 10 AS VARCHAR) END AS days, event_id % 13 AS late FROM events)"""


@query(f"""WITH {_MESSAGES}, x AS (SELECT * FROM m a WHERE st IN ('T', 'R') AND NOT EXISTS (SELECT 1 FROM m b WHERE b.st IN ('X', 'C') AND b.cusip_id = a.cusip_id AND b.msg_seq_nb = a.msg_seq_nb AND b.vol = a.vol AND b.pr = a.pr AND b.side = a.side AND b.cntra = a.cntra AND b.dt = a.dt)
AND NOT EXISTS (SELECT 1 FROM m b WHERE b.st = 'Y' AND b.cusip_id = a.cusip_id AND b.orig_msg_seq_nb = a.msg_seq_nb AND b.vol = a.vol AND b.pr = a.pr AND b.side = a.side AND b.cntra = a.cntra AND b.dt = a.dt)),
g AS (SELECT * FROM x WHERE cntra = 'C' UNION ALL SELECT * FROM x WHERE cntra = 'D' AND side = 'S' UNION ALL SELECT * FROM x a WHERE cntra = 'D' AND side = 'B' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.cntra = 'D' AND b.side = 'S' AND b.cusip_id = a.cusip_id AND b.dt = a.dt AND b.vol = a.vol AND b.pr = a.pr))
SELECT cusip_id, dt AS trd_exctn_dt, pr AS rptd_pr, vol AS entrd_vol_qt, side AS rpt_side_cd, cntra AS cntra_mp_id, count(*) AS n FROM g WHERE (days IS NULL OR CAST(days AS INT) <= 7) AND late <> 5 GROUP BY ALL""")
def trace_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = bonds.process_trace_data(_messages(spark, sf_dir))
    return kept.groupBy("cusip_id", "trd_exctn_dt", "rptd_pr", "entrd_vol_qt", "rpt_side_cd", "cntra_mp_id").agg(F.count(F.lit(1)).alias("n"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = F.col("event_id"), F.col
    kind = F.when(e % 9 == 0, "X").when(e % 9 == 1, "C").when(e % 9 == 2, "Y").when(e % 9 == 3, "R").otherwise("T")
    day = F.to_date("ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("B"), c("user_id") % 20).alias("cusip_id"), (e % 40).alias("msg_seq_nb"), F.when(e % 3 == 0, e % 37).alias("orig_msg_seq_nb"), (e % 4 * 100).alias("entrd_vol_qt"), (e % 3 + 99).cast("double").alias("rptd_pr"), F.lit(4.0).alias("yld_pt"),
        F.when(e % 2 == 0, "B").otherwise("S").alias("rpt_side_cd"), F.when(c("user_id") % 3 == 0, "C").otherwise("D").alias("cntra_mp_id"), day.alias("trd_exctn_dt"), F.lit("10:00:00").alias("trd_exctn_tm"), day.alias("trd_rpt_dt"), F.lit("10:01:00").alias("trd_rpt_tm"),
        kind.alias("trc_st"), F.when(e % 13 == 5, "A").alias("asof_cd"), F.lit("N").alias("wis_fl"), F.when(e % 11 != 0, (e % 10).cast("string")).alias("days_to_sttl_ct"), day.alias("stlmnt_dt"), F.lit("").alias("spcl_trd_fl"),
    )


#: One step k of the loop over corrections: s has the trades and the corrections that wait, f those that find a trade.
_STEP = """n AS (SELECT cusip_id, dt, msg_seq_nb AS number, count(*) AS copies FROM s WHERE NOT waits GROUP BY ALL),
f AS (SELECT s.*, copies FROM s JOIN n ON n.cusip_id = s.cusip_id AND n.dt = s.dt AND number = orig_msg_seq_nb WHERE waits)
SELECT k + 1, waits, s.* EXCLUDE (k, waits) FROM s WHERE EXISTS (SELECT 1 FROM f) AND NOT EXISTS (SELECT 1 FROM f
  WHERE f.cusip_id = s.cusip_id AND f.dt = s.dt AND f.orig_msg_seq_nb = CASE WHEN s.waits THEN s.orig_msg_seq_nb ELSE s.msg_seq_nb END)
UNION ALL SELECT k + 1, false, f.* EXCLUDE (k, waits, copies) FROM f, generate_series(1, copies)"""


@query(f"""WITH RECURSIVE {_MESSAGES}, r AS (SELECT * REPLACE (CASE WHEN msg_seq_nb % 7 = 0 THEN 'W' ELSE st END AS st) FROM m),
o AS (SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.st = 'C' AND b.cusip_id = a.cusip_id AND b.orig_msg_seq_nb = a.msg_seq_nb
  AND b.vol = a.vol AND b.pr = a.pr AND b.side = a.side AND b.cntra = a.cntra AND b.dt = a.dt)),
s AS (SELECT 0 AS k, false AS waits, * FROM o UNION ALL SELECT 0, true, * FROM r WHERE st = 'W' UNION ALL SELECT * FROM (WITH {_STEP})),
x AS (SELECT * FROM s WHERE NOT waits AND k = (SELECT max(k) FROM s)),
g AS (SELECT * FROM x WHERE cntra = 'C' OR side = 'S' UNION ALL SELECT * FROM x a WHERE cntra = 'D' AND side = 'B' AND NOT EXISTS
  (SELECT 1 FROM x b WHERE b.cntra = 'D' AND b.side = 'S' AND b.cusip_id = a.cusip_id AND b.dt = a.dt AND b.vol = a.vol AND b.pr = a.pr))
SELECT cusip_id, dt AS trd_exctn_dt, '10:00:00' AS trd_exctn_tm, pr AS rptd_pr, vol AS entrd_vol_qt, 4.0e0 AS yld_pt, side AS rpt_side_cd, cntra AS cntra_mp_id
FROM g WHERE (days IS NULL OR CAST(days AS INT) <= 7) AND late <> 5""")
def trace_clean_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules before 2012, with chains of corrections."""
    shift = F.date_sub("trd_exctn_dt", 4800)
    w = F.when(F.col("msg_seq_nb") % 7 == 0, "W").otherwise(F.col("trc_st"))
    return bonds.process_trace_data(_messages(spark, sf_dir).withColumn("trd_rpt_dt", shift).withColumn("trc_st", w))


_SERIES = "s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1), l AS (SELECT *, lag(x) OVER (ORDER BY date) AS x1, lag(x, 2) OVER (ORDER BY date) AS x2 FROM s)"


@query(f"WITH {_SERIES} SELECT date, x AS code1, x - x1 AS code2, x - 2 * x1 + x2 AS code3, round(ln(x), 8) AS code4, round(ln(x) - ln(x1), 8) AS code5, round(ln(x) - 2 * ln(x1) + ln(x2), 8) AS code6, round(x / x1 - x1 / x2, 8) AS code7 FROM l")
def stationary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.trunc("o_orderdate", "MM").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    order = Window.orderBy("date")  # one series of months
    made = series.select("date", *(stationary(F.col("x"), k, order).alias(f"code{k}") for k in range(1, 8)))
    return rounded(made, *(f"code{k}" for k in range(4, 8)))


@query("""WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS idx, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
g AS (SELECT *, n * 10 AS d12, n * 20 AS e12, ln(idx + n * 10) - ln(lag(idx + n * 10) OVER o) AS growth, lag(idx) OVER o AS last FROM s WINDOW o AS (ORDER BY date)),
p AS (SELECT date, lead(growth) OVER (ORDER BY date) - 0.001 AS rp_div, ln(d12) - ln(idx) AS dp, ln(d12) - ln(last) AS dy, ln(e12) - ln(idx) AS ep, ln(d12) - ln(e12) AS de FROM g)
SELECT date, round(rp_div, 8) AS rp_div, round(dp, 8) AS dp, round(dy, 8) AS dy, round(ep, 8) AS ep, round(de, 8) AS de FROM p WHERE rp_div IS NOT NULL AND dy IS NOT NULL""")
def macro_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1)).cast("double")
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("yyyymm")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").cast("string").alias("Index"), (n * 10).alias("D12"), (n * 20).alias("E12"))
    rest = {"Rfree": "0.001", "svar": "1", "b/m": "1", "ntis": "1", "tbl": "1", "lty": "1", "ltr": "1", "BAA": "2", "AAA": "1", "infl": "1"}
    raw = months.select("*", *(F.lit(v).alias(k) for k, v in rest.items()))
    return rounded(macro.macro_predictors(raw).select("date", "rp_div", "dp", "dy", "ep", "de"), "rp_div", "dp", "dy", "ep", "de")


@query("""WITH d AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_discount AS x FROM lineitem), h AS (SELECT *, CASE WHEN date < DATE '2001-07-01' THEN 90e0 ELSE 28e0 END AS n FROM d)
SELECT date, x AS discount, round(power(1 + x * n / 360 / (1 - x * n / 360), CASE WHEN date < DATE '2001-07-01' THEN 1e0 / 3 ELSE 365e0 / 336 END) - 1, 10) AS risk_free FROM h""")
def risk_free_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.trunc("l_shipdate", "MM").alias("date"), F.col("l_discount").alias("discount")).distinct()
    return rounded(rows.withColumn("risk_free", holding_period_return(F.col("discount"), F.col("date"))), "risk_free", digits=10)
