"""One query for each panel operator over the test tables, each with its DuckDB SQL.

The tables make a stock panel: suppliers are firms, ship months are dates. Sums that become sorting keys are taken in
decimals, so both engines see the same doubles; results are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.calendar import months
from .functions.quantile import linspace, trim, winsorize
from .operators.breakpoints import assign_portfolio, compute_breakpoints
from .operators.filters import filter_sorting_data
from .operators.lagging import add_lagged_columns, join_lagged_values
from .operators.portfolios import compute_long_short_returns, compute_portfolio_returns, implement_portfolio_sort
from .operators.regression import estimate_betas, estimate_fama_macbeth, estimate_model
from .operators.rolling import compute_rolling_value
from .operators.summary import create_summary_statistics
from .options import breakpoint_options, filter_options, portfolio_sort_options
from .shared import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else c for c in df.columns))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permno, date, mktcap, mktcap_lag, ret_excess, bm, prc_adj, be, ib, listing_age, exchange, siccd."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    n = F.count(F.lit(1))
    firm = lines.groupBy(F.col("l_suppkey").alias("permno"), F.trunc("l_shipdate", "MM").alias("date")).agg(
        exact("l_extendedprice").alias("mktcap"), (exact("l_discount") / n).alias("disc"), (exact("l_tax") / n).alias("bm"), F.max("l_quantity").alias("prc_adj"), exact("l_quantity").alias("qty")
    )
    months_of = Window.partitionBy("permno").orderBy("date")  # one row for each month, of a firm
    before = F.add_months(F.lag("date").over(months_of), 1) == F.col("date")
    firm = firm.withColumn("mktcap_lag", F.when(before, F.lag("mktcap").over(months_of)))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    place = F.pmod("s_nationkey", F.lit(3))
    return firm.join(supplier, F.col("permno") == F.col("s_suppkey")).select(
        "permno", "date", "mktcap", "mktcap_lag", (F.col("disc") - F.col("bm")).alias("ret_excess"), "bm", "prc_adj", (F.col("qty") - 60).alias("be"), (F.col("qty") - 40).alias("ib"),
        (F.year("date") * 12 + F.month("date") - 1995 * 12).alias("listing_age"), F.when(place == 0, "NYSE").when(place == 1, "AMEX").otherwise("NASDAQ").alias("exchange"),
        F.when(F.col("permno") % 17 != 0, (4000 + F.col("permno") * 37 % 3000).cast("int")).alias("siccd"),
    )


def written_panel(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    """Some columns of the panel, written for a query that makes several tables from them."""
    return materialize(panel(spark, sf_dir).select(*columns.split()), "panel")


PANEL = """
li AS (
  SELECT l_suppkey AS permno, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS mktcap, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS disc,
    CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS bm, max(l_quantity) AS prc_adj, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT li.permno, li.date, li.mktcap, b.mktcap AS mktcap_lag, li.disc - li.bm AS ret_excess, li.bm, li.prc_adj, li.qty - 60 AS be, li.qty - 40 AS ib,
    year(li.date) * 12 + month(li.date) - 1995 * 12 AS listing_age, CASE s_nationkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'AMEX' ELSE 'NASDAQ' END AS exchange,
    CASE WHEN li.permno % 17 <> 0 THEN CAST(4000 + li.permno * 37 % 3000 AS INT) END AS siccd
  FROM li JOIN supplier ON s_suppkey = li.permno LEFT JOIN li b ON b.permno = li.permno AND CAST(b.date + INTERVAL 1 MONTH AS DATE) = li.date)
"""


def number(x: float) -> str:
    return repr(float(x)) if "e" in repr(float(x)) else f"{float(x)!r}e0"


def lerp_sql(s: str, p: float) -> str:
    """The quantile of a sorted list."""
    h = f"({number(p)} * (len({s}) - 1))"
    a, b, t = f"{s}[CAST(floor({h}) AS INT) + 1]", f"{s}[CAST(least(floor({h}) + 1, len({s}) - 1) AS INT) + 1]", f"({h} - floor({h}))"
    return f"CASE WHEN {t} < 0.5 THEN {a} + ({b} - {a}) * {t} ELSE {b} - ({b} - {a}) * (1 - {t}) END"


def sorted_sql(x: str, where: str = "TRUE") -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL AND {where}))"


def assign_sql(name: str, source: str, x: str, probs: list[float], groups: str, new: str, universe: str = "TRUE") -> str:
    """CTEs that add a portfolio column to source."""
    inner = " + ".join(f"CAST(({lerp_sql('s', p)}) + 1e-20 <= {x} AS INT)" for p in probs[1:-1])
    return f"""
{name}_q AS (SELECT {groups}, {sorted_sql(x, universe)} AS s, min({x}) AS lo, max({x}) AS hi FROM {source} GROUP BY {groups}),
{name} AS (SELECT p.*, CASE WHEN lo IS NULL OR lo = hi THEN 1.0 WHEN {x} IS NULL OR len(s) IS NULL THEN NULL ELSE CAST(1 + {inner} AS DOUBLE) END AS {new}
  FROM {source} p JOIN {name}_q q USING ({groups}))"""


NYSE = "exchange = 'NYSE'"
USED = f"""
used_q AS (SELECT date, {sorted_sql('mktcap_lag')} AS w FROM base GROUP BY date),
used AS (SELECT b.*, coalesce(mktcap_lag, 0) AS wt, CASE WHEN mktcap_lag IS NULL THEN 0 ELSE least(mktcap_lag, {lerp_sql('w', 0.8)}) END AS wc FROM base b JOIN used_q USING (date))
"""
SUMS = "coalesce(sum(ret_excess * wt), 0) / nullif(sum(wt), 0) AS vw, coalesce(sum(ret_excess), 0) / count(*) AS ew, coalesce(sum(ret_excess * wc), 0) / nullif(sum(wc), 0) AS vwc"
FINISH = """
SELECT p.portfolio, d.date, round(vw, 8) AS ret_excess_vw, round(ew, 8) AS ret_excess_ew, round(vwc, 8) AS ret_excess_vw_capped
FROM dates d CROSS JOIN (SELECT DISTINCT portfolio FROM ret) p LEFT JOIN ret ON ret.portfolio = p.portfolio AND ret.date = d.date
"""
RETURNS = ("ret_excess_vw", "ret_excess_ew", "ret_excess_vw_capped")


def dates_sql(source: str = "panel") -> str:
    return f"dates AS (SELECT DISTINCT date FROM {source})"


@query(f"WITH {PANEL} SELECT permno, date, siccd FROM panel WHERE (siccd IS NULL OR siccd NOT BETWEEN 6000 AND 6799) AND (siccd IS NULL OR siccd NOT BETWEEN 4900 AND 4999) AND prc_adj >= 20 AND listing_age >= 12 AND be > 0 AND ib > 0")
def filter_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = filter_options(True, True, min_stock_price=20, min_listing_age=12, exclude_negative_book_equity=True, exclude_negative_earnings=True)
    return filter_sorting_data(panel(spark, sf_dir), options).select("permno", "date", "siccd")


@query(f"WITH {PANEL}, q AS (SELECT date, {sorted_sql('mktcap_lag')} AS s FROM panel WHERE exchange = 'NYSE' GROUP BY date) SELECT permno, panel.date, mktcap_lag FROM panel JOIN q USING (date) WHERE mktcap_lag >= {lerp_sql('s', 0.4)}")
def filter_size_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_sorting_data(panel(spark, sf_dir), filter_options(min_size_quantile=0.4)).select("permno", "date", "mktcap_lag")


def _points(spark: SparkSession, sf_dir: str, variable: str, **options: object) -> DataFrame:
    out = compute_breakpoints(panel(spark, sf_dir), variable, breakpoint_options(**options), by=["date"])
    return out.select("date", F.posexplode_outer("breakpoints").alias("k", "b")).select("date", "k", F.round("b", 8).alias("b"))


def _points_sql(variable: str, probs: list[float], source: str = "panel", where: str = "TRUE") -> str:
    shifted = ", ".join(lerp_sql("s", p) for p in probs)
    return f"WITH {PANEL}, q AS (SELECT date, {sorted_sql(variable, where)} AS s FROM {source} GROUP BY date), b AS (SELECT date, CASE WHEN s IS NOT NULL THEN [{shifted}] END AS bs FROM q) SELECT date, k AS k, round(bs[k + 1], 8) AS b FROM b, unnest(range({len(probs)})) AS r(k) WHERE bs IS NOT NULL UNION ALL SELECT date, NULL, NULL FROM b WHERE bs IS NULL"


@query(_points_sql("mktcap", linspace(6)))
def breakpoints_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "mktcap", n_portfolios=5)


@query(_points_sql("mktcap", [0.0, 0.3, 0.7, 1.0]))
def breakpoints_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "mktcap", percentiles=[0.3, 0.7])


@query(_points_sql("mktcap", linspace(5), where="exchange IN ('NYSE', 'AMEX')"))
def breakpoints_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "mktcap", n_portfolios=4, breakpoints_exchanges=["NYSE", "AMEX"])


@query(_points_sql("bm", linspace(4), where="mktcap_lag > cut").replace("q AS (SELECT date", f"c AS (SELECT date, {sorted_sql('mktcap_lag')} AS m FROM panel GROUP BY date), pc AS (SELECT p.*, {lerp_sql('m', 0.25)} AS cut FROM panel p JOIN c USING (date)), q AS (SELECT date", 1).replace("FROM panel GROUP BY date), b AS", "FROM pc GROUP BY date), b AS"))
def breakpoints_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "bm", n_portfolios=3, breakpoints_min_size_threshold=0.25)


#: prc_adj capped at 48 from above and 20 from below bunches at both edges.
_SMOOTH = f"""
WITH {PANEL}, v AS (SELECT date, greatest(least(prc_adj, 48), 20) AS x FROM panel),
q AS (SELECT date, {sorted_sql('x')} AS s FROM v GROUP BY date),
e AS (SELECT date, s, {lerp_sql('s', linspace(6)[0])} AS b0, {lerp_sql('s', linspace(6)[1])} AS b1, {lerp_sql('s', linspace(6)[4])} AS b4, {lerp_sql('s', linspace(6)[5])} AS b5 FROM q),
f AS (SELECT *, b0 = b1 AS low, b4 = b5 AS high FROM e),
i AS (SELECT *, CASE WHEN low AND high THEN list_filter(s, lambda x: x > b0 AND x < b5) WHEN low THEN list_filter(s, lambda x: x > b0) WHEN high THEN list_filter(s, lambda x: x < b4) ELSE s END AS z FROM f),
b AS (SELECT date, CASE
  WHEN low AND high THEN [b0, {', '.join(lerp_sql('z', p) for p in linspace(4))}, b5]
  WHEN low THEN [b0, {', '.join(lerp_sql('z', p) for p in linspace(5))}]
  WHEN high THEN [{', '.join(lerp_sql('z', p) for p in linspace(5))}, b5]
  ELSE [{', '.join(lerp_sql('s', p) for p in linspace(6))}] END AS bs FROM i)
SELECT date, k, round(bs[k + 1], 8) AS b FROM b, unnest(range(6)) AS r(k)
"""


@query(_SMOOTH)
def breakpoints_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = panel(spark, sf_dir).withColumn("x", F.greatest(F.least("prc_adj", F.lit(48.0)), F.lit(20.0)))
    out = compute_breakpoints(data, "x", breakpoint_options(n_portfolios=5, smooth_bunching=True), by=["date"])
    return out.select("date", F.posexplode_outer("breakpoints").alias("k", "b")).select("date", "k", F.round("b", 8).alias("b"))


@query(f"WITH {PANEL}, {assign_sql('a', 'panel', 'mktcap_lag', linspace(6), 'date', 'portfolio', universe=NYSE)} SELECT permno, date, portfolio FROM a")
def assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = breakpoint_options(n_portfolios=5, breakpoints_exchanges="NYSE")
    return assign_portfolio(panel(spark, sf_dir), "mktcap_lag", options, by=["date"]).select("permno", "date", "portfolio")


_UNIVARIATE = f"WITH {PANEL}, base AS (SELECT * FROM panel WHERE bm IS NOT NULL), {USED}, {assign_sql('a', 'used', 'bm', linspace(6), 'date', 'portfolio')}, ret AS (SELECT portfolio, date, {SUMS} FROM a WHERE portfolio IS NOT NULL GROUP BY 1, 2), {dates_sql()} {FINISH}"


@query(_UNIVARIATE)
def returns_univariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compute_portfolio_returns(panel(spark, sf_dir), "bm", "univariate", breakpoint_options_main=breakpoint_options(n_portfolios=5)), *RETURNS)


@query(f"""WITH {PANEL}, base AS (SELECT * FROM panel WHERE bm IS NOT NULL), {USED}, june AS (SELECT * FROM used WHERE month(date) = 6), {assign_sql('a', 'june', 'bm', linspace(6), 'date', 'portfolio')},
held AS (SELECT u.*, a.portfolio FROM used u JOIN a ON a.permno = u.permno AND year(a.date) = year(u.date) - CAST(month(u.date) < 6 AS INT)),
ret AS (SELECT portfolio, date, {SUMS} FROM held WHERE portfolio IS NOT NULL GROUP BY 1, 2), dates AS (SELECT DISTINCT date FROM panel WHERE date >= (SELECT min(date) FROM june)) {FINISH}""")
def returns_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compute_portfolio_returns(panel(spark, sf_dir), "bm", "univariate", rebalancing_month=6, breakpoint_options_main=breakpoint_options(n_portfolios=5)), *RETURNS)


def _bivariate_sql(main_groups: str) -> str:
    return f"""WITH {PANEL}, base AS (SELECT * FROM panel WHERE bm IS NOT NULL AND mktcap IS NOT NULL), {USED}, {assign_sql('a', 'used', 'mktcap', linspace(3), 'date', 'second')}, {assign_sql('c', 'a', 'bm', linspace(4), main_groups, 'portfolio')},
cells AS (SELECT portfolio, second, date, {SUMS} FROM c WHERE portfolio IS NOT NULL AND second IS NOT NULL GROUP BY 1, 2, 3), ret AS (SELECT portfolio, date, avg(vw) AS vw, avg(ew) AS ew, avg(vwc) AS vwc FROM cells GROUP BY 1, 2), {dates_sql()} {FINISH}"""


def _bivariate(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return rounded(compute_portfolio_returns(panel(spark, sf_dir), ["bm", "mktcap"], method, breakpoint_options_main=breakpoint_options(n_portfolios=3), breakpoint_options_secondary=breakpoint_options(n_portfolios=2)), *RETURNS)


@query(_bivariate_sql("date, second"))
def returns_bivariate_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bivariate(spark, sf_dir, "bivariate-dependent")


@query(_bivariate_sql("date"))
def returns_bivariate_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bivariate(spark, sf_dir, "bivariate-independent")


@query(f"""WITH r AS ({_UNIVARIATE.replace('round(vw, 8)', 'vw').replace('round(ew, 8)', 'ew').replace('round(vwc, 8)', 'vwc')}), e AS (SELECT date, min(portfolio) AS lo, max(portfolio) AS hi FROM r GROUP BY date)
SELECT e.date, {', '.join(f"CASE WHEN lo < hi THEN round(max(CASE WHEN portfolio = hi THEN {c} END) - max(CASE WHEN portfolio = lo THEN {c} END), 8) END AS {c}" for c in RETURNS)} FROM e JOIN r USING (date) GROUP BY e.date, lo, hi""")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = compute_portfolio_returns(panel(spark, sf_dir), "bm", "univariate", breakpoint_options_main=breakpoint_options(n_portfolios=5))
    return rounded(compute_long_short_returns(returns), *RETURNS)


@query(f"WITH {PANEL}, base AS (SELECT * FROM panel WHERE (siccd IS NULL OR siccd NOT BETWEEN 6000 AND 6799) AND prc_adj >= 15 AND bm IS NOT NULL), {USED}, {assign_sql('a', 'used', 'bm', [0.0, 0.3, 0.7, 1.0], 'date', 'portfolio')}, ret AS (SELECT portfolio, date, {SUMS} FROM a WHERE portfolio IS NOT NULL GROUP BY 1, 2), {dates_sql('base')} {FINISH}")
def implement_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = portfolio_sort_options(filter_options(exclude_financials=True, min_stock_price=15), breakpoint_options(percentiles=[0.3, 0.7]))
    return rounded(implement_portfolio_sort(panel(spark, sf_dir), "bm", "univariate", options), *RETURNS)


@query(f"WITH {PANEL} SELECT a.permno, a.date, b.bm AS bm_lag, b.be AS be_lag FROM panel a LEFT JOIN panel b ON a.permno = b.permno AND a.date = CAST(b.date + INTERVAL 3 MONTH AS DATE)")
def lag_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_lagged_columns(panel(spark, sf_dir), ["bm", "be"], months(3), by="permno").select("permno", "date", "bm_lag", "be_lag")


#: Daily values of users: events on some days only, and NULLs where a day's count is even.
DAILY = "daily AS (SELECT user_id, CAST(ts AS DATE) AS date, CASE WHEN count(*) % 2 = 1 THEN max(value) END AS value, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.count(F.lit(1))
    return events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.when(n % 2 == 1, F.max("value")).alias("value"), n.alias("n"))


def _window_sql(drop: bool) -> str:
    return f"""WITH {DAILY}, s AS (SELECT user_id AS u, date AS d, value AS v FROM daily {'WHERE value IS NOT NULL' if drop else ''})
SELECT user_id, date, CASE WHEN d >= date - 5 THEN v END AS value_lag FROM (SELECT a.*, s.d, s.v, row_number() OVER (PARTITION BY user_id, date ORDER BY d DESC NULLS LAST) AS k FROM daily a LEFT JOIN s ON u = user_id AND d <= date - 2) WHERE k = 1"""


@query(_window_sql(False))
def lag_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_lagged_columns(daily(spark, sf_dir), "value", 2, 5, by="user_id").select("user_id", "date", "value_lag")


@query(_window_sql(True))
def lag_window_drop_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_lagged_columns(daily(spark, sf_dir), "value", 2, 5, by="user_id", drop_na=True).select("user_id", "date", "value_lag")


@query(f"""WITH {PANEL}, s AS (SELECT permno AS p, date AS d, bm AS v FROM (SELECT *, max(date) OVER (PARTITION BY permno, year(date)) AS last FROM panel) WHERE date = last)
SELECT permno, date, CASE WHEN d >= CAST(date - INTERVAL 18 MONTH AS DATE) THEN v END AS bm_lag FROM (SELECT a.*, d, v, row_number() OVER (PARTITION BY permno, date ORDER BY d DESC NULLS LAST) AS k FROM panel a LEFT JOIN s ON p = permno AND d <= CAST(date - INTERVAL 6 MONTH AS DATE)) WHERE k = 1""")
def lag_year_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_lagged_columns(panel(spark, sf_dir), "bm", months(6), months(18), by="permno", ff_adjustment=True).select("permno", "date", "bm_lag")


#: Accounts of every firm: what was returned to it, in the months in which anything was.
REPORTS = """reports AS (SELECT l_suppkey AS permno, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sales,
CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS margin FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


@query(f"""WITH {PANEL}, {REPORTS} SELECT permno, date, CASE WHEN date <= CAST(d + INTERVAL 9 MONTH AS DATE) THEN sales END AS sales, CASE WHEN date <= CAST(d + INTERVAL 9 MONTH AS DATE) THEN margin END AS margin
FROM (SELECT a.permno, a.date, r.date AS d, sales, margin, row_number() OVER (PARTITION BY a.permno, a.date ORDER BY r.date DESC NULLS LAST) AS k FROM panel a LEFT JOIN reports r ON r.permno = a.permno AND CAST(r.date + INTERVAL 3 MONTH AS DATE) <= a.date) WHERE k = 1""")
def join_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = panel(spark, sf_dir)
    back = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    reports = back.groupBy(F.col("l_suppkey").alias("permno"), F.trunc("l_shipdate", "MM").alias("date"))
    reports = reports.agg(exact("l_quantity").alias("sales"), (exact("l_tax") / F.count(F.lit(1))).alias("margin"))
    return join_lagged_values(stocks.select("permno", "date"), reports, "permno", months(3), months(9))


def _rolling_sql(bucket: str, periods: int, least: int, expression: str) -> str:
    return f"""WITH {PANEL}, k AS (SELECT permno, date, ret_excess, bm, {bucket} AS b FROM panel),
w AS (SELECT a.permno, a.b, CASE WHEN count(*) >= {least} THEN {expression} END AS v FROM (SELECT DISTINCT permno, b FROM k) a JOIN k x ON x.permno = a.permno AND x.b BETWEEN a.b - {periods - 1} AND a.b GROUP BY 1, 2)
SELECT k.permno, k.date, round(w.v, 8) AS rolling_value FROM k JOIN w USING (permno, b)"""


def _rolling(spark: SparkSession, sf_dir: str, f: str | Column, **options: object) -> DataFrame:
    data = panel(spark, sf_dir).select("permno", "date", "ret_excess", "bm")
    return rounded(compute_rolling_value(data, f, by=["permno"], **options).select("permno", "date", "rolling_value"), "rolling_value")


@query(_rolling_sql("year(date) * 12 + month(date)", 6, 4, "avg(x.ret_excess)"))
def rolling_mean_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, "avg(ret_excess)", period="month", periods=6, min_obs=4)


@query(_rolling_sql("year(date) * 4 + quarter(date)", 4, 4, "stddev_samp(x.ret_excess)"))
def rolling_deviation_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, F.stddev_samp("ret_excess"), period="quarter", periods=4)


@query(_rolling_sql("year(date)", 2, 2, "max(x.bm) - min(x.ret_excess)"))
def rolling_range_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, "max(bm) - min(ret_excess)", period="year", periods=2)


def _summary_sql(by: str | None) -> str:
    one = lambda v: f"SELECT {by + ', ' if by else ''}'{v}' AS variable, count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min, round(quantile_cont({v}, 0.5), 6) AS median, round(max({v}), 6) AS max FROM panel {'GROUP BY ' + by if by else ''}"
    return f"WITH {PANEL} {' UNION ALL '.join(one(v) for v in ('ret_excess', 'bm', 'mktcap_lag'))}"


def _summary(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    out = create_summary_statistics(panel(spark, sf_dir), ["ret_excess", "bm", "mktcap_lag"], by=by).withColumnRenamed("50%", "median")
    return rounded(out, "mean", "std", "min", "median", "max", digits=6)


@query(_summary_sql(None))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, None)


@query(_summary_sql("exchange"))
def summary_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "exchange")


@query(f"WITH {PANEL}, q AS (SELECT date, {sorted_sql('ret_excess')} AS s FROM panel GROUP BY date) SELECT permno, panel.date, round(least(greatest(ret_excess, {lerp_sql('s', 0.05)}), {lerp_sql('s', 0.95)}), 8) AS ret_excess FROM panel JOIN q USING (date)")
def winsorize_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(winsorize(panel(spark, sf_dir), "ret_excess", 0.05, by=["date"]).select("permno", "date", "ret_excess"), "ret_excess")


@query(f"WITH {PANEL}, q AS (SELECT {sorted_sql('mktcap_lag')} AS s FROM panel) SELECT permno, date, round(mktcap_lag, 8) AS mktcap_lag FROM panel, q WHERE mktcap_lag BETWEEN {lerp_sql('s', 0.1)} AND {lerp_sql('s', 1 - 0.1)}")
def trim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trim(panel(spark, sf_dir), "mktcap_lag", 0.1).select("permno", "date", "mktcap_lag"), "mktcap_lag")


_LINE = "count(*) AS n, avg(bm) AS mx, avg(ret_excess) AS my, regr_slope(ret_excess, bm) AS b, regr_intercept(ret_excess, bm) AS a, regr_sxx(ret_excess, bm) AS sxx, regr_syy(ret_excess, bm) AS syy"


@query(f"WITH {PANEL}, m AS (SELECT exchange, {_LINE} FROM panel WHERE ret_excess IS NOT NULL AND bm IS NOT NULL GROUP BY 1) SELECT exchange, round(a, 7) AS intercept, round(b, 7) AS bm FROM m")
def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimate_model(panel(spark, sf_dir), "ret_excess ~ bm", by=["exchange"]), "intercept", "bm", digits=7)


#: A regressor with a mean of a million and a deviation of about one; SQL takes the mean off, which is exact.
@query(f"WITH {PANEL}, p AS (SELECT exchange, ret_excess AS y, bm * 50 + 1000000 - 1000000 AS x FROM panel) SELECT exchange, round(regr_slope(y, x), 9) AS slope, round(avg(y) - regr_slope(y, x) * avg(x), 8) AS at_million FROM p GROUP BY 1")
def ols_large_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = panel(spark, sf_dir).select("exchange", F.col("ret_excess").alias("y"), (F.col("bm") * 50 + 1000000).alias("x"))
    out = estimate_model(data, "y ~ x", by=["exchange"])
    return out.select("exchange", F.round("x", 9).alias("slope"), F.round(F.col("intercept") + 1000000 * F.col("x"), 8).alias("at_million"))


@query(f"WITH {PANEL}, m AS (SELECT exchange, {_LINE} FROM panel GROUP BY 1), v AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS s2 FROM m) SELECT exchange, round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 5) AS intercept, round(b / sqrt(s2 / sxx), 5) AS bm FROM v")
def ols_t_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimate_model(panel(spark, sf_dir), "ret_excess ~ bm", output="tstats", by=["exchange"]), "intercept", "bm", digits=5)


@query(f"WITH {PANEL}, m AS (SELECT {_LINE} FROM panel) SELECT permno, date, round(ret_excess - a - b * bm, 7) AS residual FROM panel, m")
def ols_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimate_model(panel(spark, sf_dir), "ret_excess ~ bm", output="residuals").select("permno", "date", "residual"), "residual", digits=7)


@query(f"""WITH {PANEL}, r AS (SELECT permno, date, count(*) OVER w AS n, regr_slope(ret_excess, bm) OVER w AS b, regr_intercept(ret_excess, bm) OVER w AS a FROM panel WINDOW w AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT permno, date, CASE WHEN n >= 12 THEN round(a, 7) END AS alpha, CASE WHEN n >= 12 THEN round(b, 7) END AS beta FROM r""")
def rolling_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = estimate_betas(panel(spark, sf_dir), "ret_excess ~ bm", 24, 12)
    return rounded(out.select("permno", "date", F.col("Intercept").alias("alpha"), F.col("bm").alias("beta")), "alpha", "beta", digits=7)


#: Two regressors, centred, solved by Cramer's rule.
@query(f"""WITH {PANEL}, p AS (SELECT permno, date, ret_excess AS y, bm AS x, prc_adj / 50 AS z FROM panel), m AS (SELECT permno, date, count(*) OVER w AS n, covar_samp(x, x) OVER w AS xx, covar_samp(z, z) OVER w AS zz, covar_samp(x, z) OVER w AS xz, covar_samp(x, y) OVER w AS xy, covar_samp(z, y) OVER w AS zy,
avg(x) OVER w AS mx, avg(z) OVER w AS mz, avg(y) OVER w AS my FROM p WINDOW w AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)), c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM m WHERE n >= 28)
SELECT p.permno, p.date, round(my - b1 * mx - b2 * mz, 6) AS alpha, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM p LEFT JOIN c USING (permno, date)""")
def rolling_betas_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = panel(spark, sf_dir).select("permno", "date", F.col("ret_excess").alias("y"), F.col("bm").alias("x"), (F.col("prc_adj") / 50).alias("z"))
    out = estimate_betas(data, "y ~ x + z", 36).select("permno", "date", F.col("Intercept").alias("alpha"), F.col("x").alias("b1"), F.col("z").alias("b2"))
    return rounded(out, "alpha", "b1", "b2", digits=6)


#: Ten series of days, and windows of 500.
@query("""WITH l AS (SELECT l_suppkey % 10 AS id, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / 1e3 AS y, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS x FROM lineitem GROUP BY 1, 2),
r AS (SELECT id, date, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM l WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
SELECT id, date, CASE WHEN n >= 400 THEN round(a, 5) END AS alpha, CASE WHEN n >= 400 THEN round(b, 6) END AS beta FROM r""")
def rolling_betas_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    series = lines.groupBy((F.col("l_suppkey") % 10).alias("id"), F.to_date("l_shipdate").alias("date")).agg((exact("l_extendedprice") / 1e3).alias("y"), exact("l_quantity").alias("x"))
    out = estimate_betas(series, "y ~ x", 500, id_col="id", date_col="date")
    out = out.select("id", "date", F.col("Intercept").alias("alpha"), F.col("x").alias("beta"))
    return rounded(rounded(out, "alpha", digits=5), "beta", digits=6)


_FM = f"{PANEL}, d AS (SELECT date, count(*) AS n, regr_slope(ret_excess, bm) AS b, regr_intercept(ret_excess, bm) AS a FROM panel GROUP BY date HAVING count(*) > 1), s AS (SELECT 'Intercept' AS factor, date, a AS v FROM d UNION ALL SELECT 'bm', date, b FROM d)"


@query(f"WITH {_FM} SELECT factor, round(avg(v), 6) AS risk_premium, round(stddev_samp(v) / sqrt(count(v)), 6) AS standard_error, CAST(count(v) AS DOUBLE) AS n FROM s GROUP BY factor")
def fama_macbeth_iid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimate_fama_macbeth(panel(spark, sf_dir), "ret_excess ~ bm", vcov="iid").drop("t_statistic"), "risk_premium", "standard_error", digits=6)


@query(f"""WITH {_FM}, e AS (SELECT factor, list(v ORDER BY date) AS y, avg(v) AS m, count(v) AS n FROM s WHERE v IS NOT NULL GROUP BY factor), c AS (SELECT factor, m, n, list_transform(y, lambda x: x - m) AS u FROM e),
g AS (SELECT factor, m, n, list_sum(list_transform(u, lambda x: x * x)) AS g0, {', '.join(f"list_sum(list_transform(range(1, n - {j} + 1), lambda i: u[i] * u[i + {j}])) AS g{j}" for j in (1, 2, 3))} FROM c)
SELECT factor, round(m, 6) AS risk_premium, round(sqrt((g0 + 2 * (0.75 * g1 + 0.5 * g2 + 0.25 * g3)) / (n * n)), 6) AS standard_error, CAST(n AS DOUBLE) AS n FROM g""")
def fama_macbeth_newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = estimate_fama_macbeth(panel(spark, sf_dir), "ret_excess ~ bm", vcov_options={"lag": 3, "prewhite": 0}).drop("t_statistic")
    return rounded(out, "risk_premium", "standard_error", digits=6)
