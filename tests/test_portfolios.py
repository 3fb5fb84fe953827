import datetime

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import stratum
from stratum import assign_portfolio, breakpoint_options, compute_breakpoints, compute_long_short_returns, compute_portfolio_returns, data_options, filter_options, filter_sorting_data, implement_portfolio_sort, portfolio_sort_options


@pytest.fixture(scope="module")
def stocks():
    r = np.random.default_rng(42)
    dates = pd.date_range("2019-07-01", periods=14, freq="MS")
    rows = [(i, d.date(), r.normal(), r.uniform(50, 150), r.uniform(0.5, 2), r.uniform(100, 1000)) for d in dates for i in range(1, 31)]
    return pd.DataFrame(rows, columns=["permno", "date", "ret_excess", "size", "bm", "mktcap_lag"])


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for m in (1, 2):
        base = 5 * (m - 1)
        columns = zip(["NYSE", "NYSE", "NASDAQ", "NYSE", "NYSE"], [6500, 2000, 4950, 3000, 6100], [10.0, 0.5, 15.0, 20.0, 5.0], [100.0, 200.0, 50.0, 500.0, 300.0], [24, 6, 60, 12, 36], [10.0, -5.0, 50.0, 5.0, 0.0], [5.0, -2.0, 20.0, -10.0, 30.0])
        rows += [(base + k, datetime.date(2020, m, 1), *c) for k, c in enumerate(columns, 1)]
    return spark.createDataFrame(rows, "permno int, date date, exchange string, siccd int, prc_adj double, mktcap_lag double, listing_age int, be double, ib double")


def kept(table, **options):
    return sorted(r.permno for r in filter_sorting_data(table, filter_options(**options)).collect())


def test_filters(table, spark):
    assert kept(table) == list(range(1, 11))
    assert kept(table, exclude_financials=True) == [2, 3, 4, 7, 8, 9]
    assert kept(table, exclude_utilities=True) == [1, 2, 4, 5, 6, 7, 9, 10]
    assert kept(table, min_stock_price=1) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert kept(table, min_size_quantile=0.5) == [4, 5, 9, 10]
    assert kept(table, min_listing_age=12) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert kept(table, exclude_negative_book_equity=True) == [1, 3, 4, 6, 8, 9]
    assert kept(table, exclude_negative_earnings=True) == [1, 3, 5, 6, 8, 10]
    holes = table.selectExpr("permno", "cast(null as int) as siccd", "cast(null as double) as prc_adj")
    assert kept(holes, exclude_financials=True) == list(range(1, 11)) and kept(holes, min_stock_price=1) == []
    with pytest.warns(UserWarning, match="Removed 4"):
        filter_sorting_data(table, filter_options(exclude_financials=True), quiet=False)
    with pytest.raises(ValueError, match="siccd"):
        filter_sorting_data(table.drop("siccd"), filter_options(exclude_financials=True))


@pytest.mark.parametrize("bad", [{"n_portfolios": 0}, {"n_portfolios": 2.5}, {"n_portfolios": True}, {"percentiles": [1.5]}, {"percentiles": 3}, {"breakpoints_exchanges": ""}, {"breakpoints_exchanges": [1]}, {"smooth_bunching": 1}, {"breakpoints_min_size_threshold": 1}])
def test_breakpoint_options_are_checked(bad):
    with pytest.raises(ValueError):
        breakpoint_options(**bad)


def test_other_options_are_checked():
    for bad in ({"min_stock_price": 0}, {"min_size_quantile": 1}, {"min_listing_age": -1}, {"exclude_financials": 1}):
        with pytest.raises(ValueError):
            filter_options(**bad)
    for bad in ({}, {"breakpoint_options_main": {}}, {"filter_options": {}, "breakpoint_options_main": breakpoint_options(5)}):
        with pytest.raises(ValueError):
            portfolio_sort_options(**bad)
    with pytest.raises(ValueError):
        data_options(id=3)
    assert data_options(id="firm", extra=1)["extra"] == 1


def points(spark, values, **options):
    data = spark.createDataFrame([(float(v),) for v in values], "x double")
    return compute_breakpoints(data, "x", breakpoint_options(**options)).first().breakpoints


def smooth(values, n):
    """Both-edge and one-edge bunching, by the rule."""
    x = np.asarray(values, float)
    b = np.quantile(x, np.linspace(0, 1, n + 1))
    low, high = b[0] == b[1], b[n - 1] == b[n]
    if low and high:
        q = np.quantile(x[(x > b[0]) & (x < b[n])], np.linspace(0, 1, n - 1))
        q[-1] += 1e-15
        b = np.r_[b[0], q, b[n]]
    elif low:
        b = np.r_[b[0], np.quantile(x[x > b[0]], np.linspace(0, 1, n))]
    elif high:
        q = np.quantile(x[x < b[n - 1]], np.linspace(0, 1, n))
        q[-1] += 1e-15
        b = np.r_[q, b[n]]
    b[1:] += 1e-20
    return b.tolist()


def test_breakpoints(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=101)
    for n in (2, 3, 5, 10):
        assert points(spark, x, n_portfolios=n) == (np.quantile(x, np.linspace(0, 1, n + 1)) + np.r_[0, np.full(n, 1e-20)]).tolist()
    assert points(spark, x, percentiles=[0.3, 0.7]) == np.quantile(x, [0, 0.3, 0.7, 1]).tolist()
    middle = np.linspace(1, 99, 100)
    for values in ([0] * 200 + middle.tolist() + [100] * 200, [0] * 200 + middle.tolist(), middle.tolist() + [100] * 200, middle.tolist()):
        assert points(spark, values, n_portfolios=5, smooth_bunching=True) == smooth(values, 5)
    for bad in ({}, {"n_portfolios": 5, "percentiles": [0.5]}, {"n_portfolios": 1}):
        with pytest.raises(ValueError):
            points(spark, x, **bad)


def test_breakpoint_universes(spark):
    data = spark.createDataFrame([(float(k), 10.0 * k, "NYSE" if k > 1 else "AMEX") for k in range(1, 6)], "x double, mktcap_lag double, exchange string")
    made = lambda **o: compute_breakpoints(data, "x", breakpoint_options(n_portfolios=2, **o)).first().breakpoints
    assert made(breakpoints_min_size_threshold=0.25) == [3, 4, 5]
    assert made(breakpoints_exchanges="NYSE") == [2, 3.5, 5]
    assert made(breakpoints_exchanges=["LSE"]) is None


def labels(spark, values, **options):
    data = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "k int, x double")
    return [r.portfolio for r in assign_portfolio(data, "x", breakpoint_options(**options)).orderBy("k").collect()]


def test_assignment(spark):
    assert labels(spark, [42, 42, None, 42], n_portfolios=5) == [1, 1, 1, 1]
    assert labels(spark, [None, None], n_portfolios=2) == [1, 1]
    assert labels(spark, [1, 2, 3, 4, None], n_portfolios=2) == [1, 1, 2, 2, None]
    assert labels(spark, [1, 1, 1, 1, 9], n_portfolios=4) == [4, 4, 4, 4, 4]
    r = np.random.default_rng(2)
    x = r.normal(size=77)
    b = np.quantile(x, np.linspace(0, 1, 6))
    assert labels(spark, x, n_portfolios=5) == (1 + np.searchsorted(b[1:-1], x, "right")).tolist()


def test_assignment_by_a_callers_function(spark):
    data = spark.createDataFrame([(g, float(k)) for g in (1, 2) for k in range(4)], "g int, x double")
    out = assign_portfolio(data, "x", None, lambda table, variable, options, roles: [0, table[variable].median(), 9], by=["g"]).collect()
    assert all(r.portfolio == (1 if r.x < 1.5 else 2) for r in out)


def oracle(data, variables, n_main, n_second=None, dependent=False, month=None, cap=0.8):
    d = data.copy()
    d["date"] = pd.to_datetime(d["date"])
    cut = d.groupby("date").mktcap_lag.transform(lambda x: np.quantile(x, cap))
    d["capped"] = np.minimum(d.mktcap_lag, cut)
    bucket = lambda x, n: pd.Series(1 + np.searchsorted(np.quantile(x, np.linspace(0, 1, n + 1))[1:-1] + 1e-20, x, "right"), x.index)
    formed = d if month is None else d[d.date.dt.month == month].copy()
    formed = formed.copy()
    if n_second:
        formed["second"] = formed.groupby("date")[variables[1]].transform(lambda x: bucket(x, n_second))
    keys = ["date", "second"] if dependent else ["date"]
    formed["portfolio"] = formed.groupby(keys)[variables[0]].transform(lambda x: bucket(x, n_main))
    if month is not None:
        held = formed[["permno", "date", "portfolio", *(["second"] if n_second else [])]].assign(year=formed.date.dt.year).drop(columns="date")
        d["year"] = d.date.dt.year - (d.date.dt.month < month)
        formed = d.merge(held, on=["permno", "year"])
    cells = ["portfolio", "date", *(["second"] if n_second else [])]
    agg = formed.groupby(cells)[list(d.columns)].apply(lambda x: pd.Series({"vw": (x.ret_excess * x.mktcap_lag).sum() / x.mktcap_lag.sum(), "ew": x.ret_excess.mean(), "capped": (x.ret_excess * x.capped).sum() / x.capped.sum()})).reset_index()
    return agg.groupby(["portfolio", "date"])[["vw", "ew", "capped"]].mean()


@pytest.mark.parametrize(("variables", "method", "month"), [(["bm"], "univariate", None), (["bm"], "univariate", 7), (["bm", "size"], "bivariate-dependent", None), (["bm", "size"], "bivariate-independent", None), (["bm", "size"], "bivariate-independent", 7)])
def test_returns_equal_pandas(spark, stocks, variables, method, month):
    second = breakpoint_options(2) if len(variables) > 1 else None
    got = compute_portfolio_returns(spark.createDataFrame(stocks), variables, method, month, breakpoint_options(3), second).toPandas()
    got["date"] = pd.to_datetime(got["date"])
    want = oracle(stocks, variables, 3, 2 if second else None, method == "bivariate-dependent", month)
    got = got.set_index(["portfolio", "date"])[["ret_excess_vw", "ret_excess_ew", "ret_excess_vw_capped"]].sort_index()
    assert len(got) == 42 and np.allclose(got.to_numpy(), want.reindex(got.index).to_numpy(), atol=1e-12)


def test_returns_of_odd_panels(spark, stocks):
    data = spark.createDataFrame(stocks)
    main = breakpoint_options(3)
    plain = compute_portfolio_returns(data.drop("mktcap_lag"), "bm", "univariate", breakpoint_options_main=main)
    assert plain.columns == ["portfolio", "date", "ret_excess_ew"]
    none = compute_portfolio_returns(data.selectExpr("*").withColumn("mktcap_lag", data.mktcap_lag * None), "bm", "univariate", breakpoint_options_main=main)
    assert none.where("ret_excess_vw IS NOT NULL").count() == 0 and none.where("ret_excess_ew IS NULL").count() == 0
    small = compute_portfolio_returns(data, "bm", "univariate", breakpoint_options_main=main, min_portfolio_size=11)
    assert small.where("ret_excess_ew IS NOT NULL").count() == 0
    empty = compute_portfolio_returns(data.withColumn("bm", data.bm * None), "bm", "univariate", breakpoint_options_main=main)
    assert empty.count() == 0
    for change in ({"sorting_method": "x"}, {"cap_weight": 2}, {"rebalancing_month": 13}, {"sorting_variables": []}, {"sorting_variables": ["bm", "size"]}, {"sorting_variables": "nothing"}):
        with pytest.raises(ValueError):
            compute_portfolio_returns(**{"data": data, "sorting_variables": "bm", "sorting_method": "univariate", "breakpoint_options_main": main} | change)


def test_null_returns_count_in_the_denominators(spark):
    rows = [(1, datetime.date(2020, 1, 1), 0.3, 1.0, 2.0), (2, datetime.date(2020, 1, 1), None, 1.0, 1.0)]
    data = spark.createDataFrame(rows, "permno int, date date, ret_excess double, bm double, mktcap_lag double")
    row = compute_portfolio_returns(data, "bm", "univariate", breakpoint_options_main=breakpoint_options(2)).first()
    assert row.ret_excess_ew == pytest.approx(0.15) and row.ret_excess_vw == pytest.approx(0.2)


def test_long_short(spark):
    d = [datetime.date(2020, m, 1) for m in (1, 2, 3)]
    rows = [(1.0, d[0], 0.1, 0.2), (3.0, d[0], 0.4, 0.1), (2.0, d[0], 9.0, 9.0), (1.0, d[1], 0.1, 0.1), (1.0, d[2], None, 0.1), (2.0, d[2], 0.2, 0.3)]
    data = spark.createDataFrame(rows, "portfolio double, date date, ret_excess_ew double, ret_excess_vw double")
    got = {r.date: r for r in compute_long_short_returns(data).collect()}
    assert got[d[0]].ret_excess_ew == pytest.approx(0.3) and got[d[0]].ret_excess_vw == pytest.approx(-0.1)
    assert got[d[1]].ret_excess_ew is None and got[d[2]].ret_excess_ew is None and got[d[2]].ret_excess_vw == pytest.approx(0.2)
    assert compute_long_short_returns(data, "bottom_minus_top").where("date = '2020-01-01'").first().ret_excess_ew == pytest.approx(-0.3)
    with pytest.raises(ValueError):
        compute_long_short_returns(data, "other")


def test_whole_sort_and_backends(spark, stocks):
    options = portfolio_sort_options(None, breakpoint_options(3))
    stratum.set_backend("pandas")
    try:
        got = implement_portfolio_sort(stocks, "bm", "univariate", options)
    finally:
        stratum.set_backend("spark")
    assert isinstance(got, pd.DataFrame) and len(got) == 42 and stratum.get_backend() == "spark"
    with pytest.raises(ValueError):
        stratum.set_backend("other")
    with pytest.raises(ValueError):
        implement_portfolio_sort(stocks, "bm", "univariate", {})


def test_sort_plan_has_no_python_and_no_cartesian_product(spark, stocks):
    data = spark.createDataFrame(stocks)
    plan = compute_portfolio_returns(data, "bm", "univariate", breakpoint_options_main=breakpoint_options(5))._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "MapInPandas" not in plan


def test_absent_months_and_holes_are_told(spark):
    days = [f"2020-0{m}-01" for m in (1, 2, 3)]
    rows = [(k, d, 0.01 * k, 1.0 + k, float(k)) for k in range(6) for d in days]
    data = spark.createDataFrame(rows, "permno long, date string, ret_excess double, mktcap_lag double, size double")
    data = data.withColumn("date", F.col("date").cast("date"))
    options = {"breakpoint_options_main": breakpoint_options(n_portfolios=3)}
    with pytest.raises(ValueError, match="rebalancing month 12"):
        compute_portfolio_returns(data, "size", "univariate", 12, **options, quiet=False)
    with pytest.raises(Exception, match="rebalancing month 12"):
        compute_portfolio_returns(data, "size", "univariate", 12, **options).collect()
    none = data.withColumn("size", F.lit(None).cast("double"))
    with pytest.warns(UserWarning, match="empty panel"):
        assert compute_portfolio_returns(none, "size", "univariate", **options, quiet=False).count() == 0
    assert compute_portfolio_returns(none, "size", "univariate", 12, **options).count() == 0
    with pytest.warns(UserWarning, match="9 returns are missing"):
        out = compute_portfolio_returns(data, "size", "univariate", min_portfolio_size=10, **options, quiet=False)
    assert out.count() == 9 and out.where("ret_excess_ew IS NOT NULL").count() == 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert compute_portfolio_returns(data, "size", "univariate", **options, quiet=False).count() == 9
