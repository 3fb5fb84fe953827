import datetime
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from stratum.functions.transforms import holding_period_return, transform_series
from stratum.sources import factors, macro, markets, pseudo
from stratum.plans import bonds
from stratum.plans.raw import load_raw
from stratum.sources.catalog import (
    available_french_datasets, check_dataset, check_jkp_selection, datasets, frequency, french_datasets, is_legacy_type,
    list_supported_datasets, list_supported_indexes, list_supported_jkp_factors, parse_type, resolve_domain,
)
from stratum.sources.dates import date_bounds, parse_date
from stratum.sources.load import load_data


def rows(df, order="date"):
    return [tuple(r) for r in df.orderBy(order).collect()]


def day(text):
    return datetime.date.fromisoformat(text)


def test_dates():
    assert parse_date("202002") == day("2020-02-01") and parse_date("202002", True) == day("2020-02-29") and parse_date("2020-03-04") == day("2020-03-04")
    assert date_bounds(None, "2020-01-01") == (None, day("2020-01-01"))
    for bad in (("2021-01-01", "2020-01-01"), ("x", None)):
        with pytest.raises(ValueError):
            date_bounds(*bad)


def test_french_factors(spark, tmp_path):
    body = "\n".join(["This file was made for a test.", "", ",Mkt-RF,SMB,RF", "202001, 1.0, -2.0, 0.10", "202002, -99.99, 3.0, 0.10", "", "Annual", "", ",Mkt-RF,SMB,RF", "2020, 9.0, 9.0, 9.0"])
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", body)
    out = factors.read_french_factors(spark, str(tmp_path / "f.zip"), least=40)
    assert out.columns == ["date", "mkt_excess", "smb", "risk_free"]
    assert rows(out) == [(day("2020-01-01"), 0.01, -0.02, pytest.approx(0.001)), (day("2020-02-01"), None, 0.03, pytest.approx(0.001))]
    assert load_data(spark, "Fama-French", "x", str(tmp_path / "f.zip"), start_date="2020-02", least=40).count() == 1
    bins = "\n".join(["Breakpoints", "202001, 5, 10," + ",".join(str(k) for k in range(1, 21))])
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", bins)
    row = factors.read_french_breakpoints(spark, str(tmp_path / "b.zip")).first()
    assert row.nonpositive == 5 and row.positive == 10 and row.p5 == 1 and row.p100 == 20


def test_other_factor_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text("year,quarter,R_F,R_MKT\n2020,2,1.0,2.0\n")
    assert rows(factors.read_q_factors(spark, str(tmp_path / "q.csv"))) == [(day("2020-04-01"), 0.01, 0.02)]
    (tmp_path / "o.csv").write_text("date,AbnormalAccruals\n2020-01-31,1.5\n")
    out = factors.read_characteristic_portfolios(spark, str(tmp_path / "o.csv"))
    assert out.columns == ["date", "abnormal_accruals"] and rows(out) == [(day("2020-01-01"), 0.015)]
    (tmp_path / "l.txt").write_text("% comment\n196208  -0.017  0.004  -99\n")
    assert rows(factors.read_liquidity_factors(spark, str(tmp_path / "l.txt"))) == [(day("1962-08-01"), -0.017, 0.004, None)]
    (tmp_path / "m.csv").write_text("YYYYMM, MKTRF, SMB, MGMT, PERF, RF\n196301, 0.05, 0.03, 0.01, -0.02, 0.0025\n")
    assert factors.read_mispricing_factors(spark, str(tmp_path / "m.csv")).columns == ["date", "mkt_excess", "smb", "mgmt", "perf", "risk_free"]
    (tmp_path / "g.csv").write_text("date,pf,ret\n2020-01-31,1.0,na\n2020-02-29,2.0,0.5\n")
    assert rows(factors.read_global_factors(spark, str(tmp_path / "g.csv"), end_date="202002")) == [(day("2020-01-01"), 1, None), (day("2020-02-01"), 2, 0.5)]


def test_factor_grid(spark, tmp_path):
    base = dict(factors.GRID_DEFAULTS)
    made = [base | {"id": 1, "sorting_variable": "sv_bm"}, base | {"id": 2, "sorting_variable": "sv_me", "min_size_quantile": None}, base | {"id": 3, "sorting_variable": "sv_me", "weighting_scheme": "EW"}, base | {"id": 4, "sorting_variable": "sv_me", "sorting_method": "bivariate-dependent", "n_portfolios_secondary": 2}]
    schema = "id long, sorting_variable string, min_size_quantile double, exclude_financials boolean, exclude_utilities boolean, exclude_negative_earnings boolean, sorting_variable_lag string, rebalancing string, n_portfolios_main int, sorting_method string, n_portfolios_secondary int, breakpoints_exchanges string, breakpoints_min_size_threshold double, weighting_scheme string"
    grid = spark.createDataFrame(made, schema)
    ids = lambda **f: sorted(r.id for r in factors.filter_factor_grid(grid, **f).collect())
    assert ids() == [1] and ids(min_size_quantile=None) == [1, 2] and ids(weighting_scheme=["EW", "VW"]) == [1, 3] and ids(fill_all=True) == [1, 2, 3, 4]
    assert ids(sorting_variable="sv_me", weighting_scheme="EW") == [3] and ids(sorting_method="bivariate-dependent", n_portfolios_secondary=2) == [4]
    for bad in ({"nothing": 1}, {"sorting_method": "bivariate-dependent"}):
        with pytest.raises(ValueError):
            ids(**bad)
    returns = spark.createDataFrame([(k, day("2020-01-01"), 0.1 * k, "sv_bm" if k == 1 else "sv_me", "6m") for k in (1, 2, 3)], "id long, date date, ret double, sorting_variable string, sorting_variable_lag string")
    returns.write.partitionBy("sorting_variable", "sorting_variable_lag").parquet(str(tmp_path / "lib"))
    assert [r.id for r in factors.read_factor_library(spark, str(tmp_path / "lib"), grid, ids=[3]).collect()] == [3]
    assert [r.id for r in factors.read_factor_library(spark, str(tmp_path / "lib"), grid).collect()] == [1]


def test_macro_panel(spark, tmp_path):
    (tmp_path / "m.csv").write_text("sasdate,LEVELSER,LOGDIFFSER\nTransform:,1,5\n1/1/2020,100,100\n2/1/2020,101,110\n3/1/2020,102,121\n,,\n")
    got = rows(macro.macro_vintages(spark, {"2020-04": str(tmp_path / "m.csv")}))
    assert [r[2] for r in got] == [100, 101, 102] and got[0][3] is None and got[1][3] == pytest.approx(math.log(1.1)) and got[1][1] == "2020-04"
    with pytest.raises(ValueError):
        macro.macro_vintages(spark, {"2020-04": "x"}, vintages="2019-01")
    (tmp_path / "s.csv").write_text("observation_date,GDP\n2020-01-01,.\n2020-02-01,5.5\n")
    assert rows(macro.read_series(spark, {"GDP": str(tmp_path / "s.csv")})) == [(day("2020-01-01"), "GDP", None), (day("2020-02-01"), "GDP", 5.5)]


def test_transformations(spark):
    data = spark.createDataFrame([(k, float(x)) for k, x in enumerate([1, 2, 4, 8])], "date int, x double")
    take = lambda code: [r[1] for r in rows(transform_series(data, {"x": code}))]
    assert take(1) == [1, 2, 4, 8] and take(2) == [None, 1, 2, 4] and take(3) == [None, None, 1, 2] and take(7) == [None, None, 0, 0]
    assert take(5)[1:] == pytest.approx([math.log(2)] * 3) and take(6)[2:] == pytest.approx([0, 0]) and take(4)[0] == 0
    with pytest.raises(ValueError):
        take(8)


def test_constituents(spark):
    raw = spark.createDataFrame([("BRK B", "Berkshire", "US", "NYSE", "Equity"), ("SAP", "SAP", "DE", "Xetra", "Aktien"), ("NA x", "NATIONAL BANK OF CANADA", "CA", "Toronto Stock Exchange", "Equity"), ("USD", "USD CASH", "US", "-", "Equity"), ("F", "S&P 500 Future", "US", "-", "Equity"), ("", "none", "", "", "Equity"), ("B", "Bond", "US", "NYSE", "Bond"), ("BP.", "BP", "GB", "London Stock Exchange", "Equity")], "Ticker string, Name string, Location string, Exchange string, `Asset Class` string")
    got = {r.symbol: r.currency for r in markets.index_constituents(raw, "S&P 500").collect()}
    assert got == {"BRK-B": "USD", "SAP.DE": "EUR", "NA.TO": "CAD", "BP.L": "GBP"}


def test_prices(spark, tmp_path):
    chart = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [1577923200, 1578009600], "indicators": {"quote": [{"volume": [1, None], "open": [1.0, 2.0], "low": [1.0, 2.0], "high": [1.0, 2.0], "close": [1.0, 2.0]}], "adjclose": [{"adjclose": [0.9, 1.9]}]}}]}}
    (tmp_path / "a.json").write_text(json.dumps(chart))
    (tmp_path / "b.json").write_text(json.dumps({"chart": {"result": None}}))
    got = rows(load_data(spark, "Stock Prices", path=f"{tmp_path}/*.json"))
    assert [(r[0], r[1], r[2], r[-1]) for r in got] == [("A", day("2020-01-02"), 1, 0.9), ("A", day("2020-01-03"), None, 1.9)]


def test_bill_returns(spark):
    from pyspark.sql import functions as F

    data = spark.createDataFrame([(day("2000-01-01"), 0.05), (day("2020-01-01"), 0.02)], "date date, d double")
    got = [r[0] for r in data.orderBy("date").select(holding_period_return(F.col("d"), F.col("date"))).collect()]
    whole = lambda d, n: d * n / 360 / (1 - d * n / 360)
    assert got == pytest.approx([(1 + whole(0.05, 90)) ** (1 / 3) - 1, (1 + whole(0.02, 28)) ** (365 / 336) - 1])


def test_pseudo_data_do_not_depend_on_partitions(spark):
    with pytest.warns(UserWarning):
        first = load_data(spark, "Pseudo Data", "crsp_monthly", start_date="2020-01-01", end_date="2020-12-01", n_assets=20)
    again = pseudo.crsp_monthly(spark, "2020-01-01", "2020-12-01", 20)
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, again.repartition(7).collect()), key=str) and first.count() == 240
    assert first.select("permno", "exchange").distinct().count() == 20 and first.where("mktcap_lag IS NULL").count() == 20
    other = pseudo.crsp_monthly(spark, "2020-01-01", "2020-12-01", 20, seed=9)
    assert other.agg({"ret": "sum"}).first() != again.agg({"ret": "sum"}).first()
    daily = pseudo.crsp_daily(spark, "2020-01-01", "2020-01-31", 5)
    assert daily.count() == 5 * 23 and all(r.date.weekday() < 5 for r in daily.collect())
    annual = pseudo.compustat_annual(spark, "2018-01-01", "2020-12-31", 10)
    assert annual.count() == 30 and annual.join(pseudo.ccm_links(spark, 10), "gvkey").count() == 30
    assert pseudo.compustat_quarterly(spark, "2020-01-01", "2020-12-31", 10).count() == 40
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        pseudo.pseudo_data(spark, "other")


# Datasets of the Fama/French library and their types, one or more of each pattern of name.
FRENCH = {
    "Fama/French 3 Factors": "3_monthly",
    "Fama/French 3 Factors [Weekly]": "3_weekly",
    "Fama/French 5 Factors (2x3) [Daily]": "5_2x3_daily",
    "Portfolios Formed on Size [ex.Dividends]": "size_exdividends_monthly",
    "Portfolios Formed on Book-to-Market [ex. Dividends]": "bm_exdividends_monthly",
    "6 Portfolios Formed on Size and Operating Profitability (2 x 3)": "6_size_and_op_2_x_3_monthly",
    "32 Portfolios Formed on Size, Book-to-Market, and Investment (2 x 4 x 4)": "32_size_bm_and_inv_2_x_4_x_4_monthly",
    "Portfolios Formed on Earnings/Price": "earningsprice_monthly",
    "Momentum Factor (Mom) [Daily]": "momentum_factor_daily",
    "Short-Term Reversal Factor (ST Rev)": "shortterm_reversal_factor_st_rev_monthly",
    "10 Portfolios Formed on Long-Term Reversal": "10_longterm_reversal_monthly",
    "49 Industry Portfolios [Daily]": "49_industry_portfolios_daily",
    "BE/ME Breakpoints": "beme_breakpoints_monthly",
    "Prior (2-12) Return Breakpoints": "prior_212_return_breakpoints_monthly",
    "Fama/French Asia Pacific ex Japan 5 Factors": "asia_pacific_ex_japan_5_monthly",
    "6 Developed ex US Portfolios Formed on Size and Momentum (2 x 3)": "6_developed_ex_us_size_and_momentum_2_x_3_monthly",
    "4 Emerging Market Portfolios Formed on Book-to-Market  and Operating Profitability (2 x 2)  ": "4_emerging_market_bm__and_op_2_x_2___monthly",
}


def test_types_are_parsed(spark):
    assert parse_type("factors_ff_3_daily") == ("Fama-French", "Fama/French 3 Factors [Daily]")
    assert parse_type("factors_ff5_monthly") == ("Fama-French", "Fama/French 5 Factors (2x3)")
    assert parse_type("factors_q5_weekly_w2w") == ("Global Q", "q5_factors_weekly_w2w_2024")
    assert parse_type("macro_predictors_annual") == ("Goyal-Welch", "annual") and parse_type("wrds_fisd") == ("WRDS", "fisd")
    assert parse_type("hf_risk_free") == ("Hosted Library", "risk_free") and parse_type("jkp") == ("Global Factor Data", None)
    with pytest.raises(ValueError):
        parse_type("nothing")
    legacy = ["factors_ff_3_daily", "factors_ff3_weekly", "wrds_crsp_daily", "FRED-MD", "macro_predictors_monthly"]
    assert all(map(is_legacy_type, legacy))
    assert not any(map(is_legacy_type, ["fred", "jkp", "liquidity", "mispricing", "risk_free", "factor_library", "crsp_monthly", "x"]))
    check_dataset("WRDS", "fisd")
    for domain, name in (("WRDS", "x"), ("Fama-French", "x"), ("Global Q", "factors_q5_daily")):
        with pytest.raises(ValueError):
            check_dataset(domain, name)


def test_indexes_and_manifests(spark, tmp_path):
    rows = list_supported_indexes(spark).collect()
    assert len(rows) == 13 and {r.skip for r in rows} == {2, 9} and all(r.url.startswith("https://") for r in rows)
    manifest = {"factors": {"usa": ["be_me", "size"], "deu": ["size"]}, "industry": {"usa": ["gics"]}, "factors_monthly_only": {"usa": ["size"]}}
    path = tmp_path / "availability.json"
    path.write_text(json.dumps(manifest, indent=1))
    assert {r.region for r in list_supported_jkp_factors(spark, str(path)).collect()} == {"usa", "deu"}
    assert [tuple(r) for r in list_supported_jkp_factors(spark, str(path), "usa", "industry").collect()] == [("usa", "gics")]
    check_jkp_selection(spark, str(path), "factors", "usa", "size")
    check_jkp_selection(spark, str(path), "factors", "deu", "size", "daily")
    for bad in (("factors", "usa", "size", "daily"), ("factors", "x", "size"), ("factors", "deu", "be_me"), ("portfolios", "usa", "size")):
        with pytest.raises(ValueError):
            check_jkp_selection(spark, str(path), *bad)
    data = tmp_path / "size.csv"
    data.write_text("date,ret\n2020-01-31,0.5\n")
    read = lambda monthly, region: factors.read_global_factors(spark, str(data), monthly=monthly, manifest=str(path), region=region, selector="size")
    assert read(True, "usa").first().date == day("2020-01-01") and read(False, "deu").first().date == day("2020-01-31")
    for bad in ((False, "usa"), (True, "x")):
        with pytest.raises(ValueError):
            read(*bad)
    for bad in (("usa", "other"), ("x", "factors")):
        with pytest.raises(ValueError):
            list_supported_jkp_factors(spark, str(path), *bad)
    page = tmp_path / "data_library.html"
    page.write_text('<a href="ftp/F-F_Research_Data_Factors_CSV.zip">x</a><A class=y HREF=ftp/49_CSV.zip >b</a><a href="ftp/no.zip">c</a>')
    assert available_french_datasets(spark, str(page)) == ["F-F_Research_Data_Factors", "49"]


def test_raw_tables_are_asked_for(spark):
    empty = spark.createDataFrame([], "permno long, cusip_id string, trd_exctn_dt date")
    for bad in (
        lambda: load_raw("x", {}),
        lambda: load_raw("crsp_monthly", {"returns": empty}),
        lambda: load_raw("crsp_monthly", {}, version="v3"),
        lambda: load_raw("crsp_monthly", {}, adjust_volume=True),
        lambda: load_raw("crsp_monthly", {}, "2020-01-01", "2025-01-31", version="v1"),
        lambda: load_raw("crsp_daily", dict.fromkeys(("returns", "names", "risk_free"), empty), adjust_volume=True),
        lambda: load_raw("trace_enhanced", {"trades": empty}, cusips=["short"]),
        lambda: load_data(spark, "WRDS", "fisd"),
    ):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([("A" * 9,), ("B" * 9,), (None,)], "cusip_id string")
    assert bonds.trades_of(rows, ["A" * 9]).count() == 1 and bonds.trades_of(rows, []).count() == 0 and bonds.trades_of(rows).count() == 3
    assert bonds.trades_of(rows, [f"{k:09d}" for k in range(1500)] + ["B" * 9]).count() == 1
    with pytest.warns(DeprecationWarning):
        links = spark.createDataFrame([(1, "a", None, None)], "permno long, gvkey string, linkdt date, linkenddt date")
        assert load_raw("wrds_ccm_links", {"links": links}, as_of="2020-01-01").first().linkenddt.year == 2020


def test_catalogue(spark):
    assert len(french_datasets()) == len(set(french_datasets())) == 297 and len(datasets()) == 331
    assert sorted(map(tuple, list_supported_datasets(spark).collect())) == sorted(datasets())
    types = {name: kind for kind, name, _ in french_datasets()}
    for name, kind in FRENCH.items():  # fixed values
        assert types[name] == f"factors_ff_{kind}"
    assert list_supported_datasets(spark, domain="WRDS").count() == 7
    assert list_supported_datasets(spark, ["WRDS", "Global Q"], as_vector=True)[:2] == ["factors_q5_daily", "factors_q5_weekly"]
    assert list_supported_datasets(spark, "nothing").count() == 0
    assert frequency("q5_factors_weekly_2024") == "weekly" and frequency("Fama/French 3 Factors [Daily]") == "daily" and frequency("x") == "monthly"
    with pytest.warns(DeprecationWarning):
        assert resolve_domain("famafrench") == "Fama-French"
    for bad in (lambda: resolve_domain("x"), lambda: load_data(spark, "WRDS", "x"), lambda: load_data(spark, "FRED", "x")):
        with pytest.raises(ValueError):
            bad()


def test_laws_of_pseudo_data(spark):
    """A thousand assets over twenty-one years by default: rows, assets, dates and distributions."""
    day = lambda *x: datetime.date(*x)
    c = F.col
    laws = {
        "crsp_monthly": ("permno", "date", 252_000, day(2000, 1, 1), day(2020, 12, 1), (F.abs(F.avg("ret") - 0.008) < 0.002) & (F.abs(F.stddev("ret") - 0.1) < 0.002) & (F.min("ret_excess") >= -1)),
        "crsp_daily": ("permno", "date", 5_479_000, day(2000, 1, 3), day(2020, 12, 31), (F.abs(F.avg("ret") - 0.0004) < 0.0002) & F.every(F.weekday("date") < 5)),
        "compustat_annual": ("gvkey", "datadate", 21_000, day(2000, 12, 31), day(2020, 12, 31), (F.min("at") > 0) & F.every((c("be") > 0) | c("be").isNull())),
        "compustat_quarterly": ("gvkey", "datadate", 84_000, day(2000, 3, 31), day(2020, 12, 31), (F.min("atq") > 0) & F.every(c("ceqq").between(c("atq") * 0.2, c("atq") * 0.6))),
    }
    for name, (asset, date, n, first, last, holds) in laws.items():
        rows = pseudo.DATASETS[name](spark, "2000-01-01", "2020-12-31")
        assert tuple(rows.agg(F.count(F.lit(1)), F.count_distinct(asset), F.min(date), F.max(date), holds).first()) == (n, 1000, first, last, True), name
