import datetime

import numpy as np
import pytest

from stratum.plans import accounting, bonds, stocks


def day(text):
    return datetime.date.fromisoformat(text)


def test_monthly_panel(spark):
    rows = [(1, day("2020-01-31"), 0.1, 1.0, 10.0, "N", 5100, day("2000-01-01"), 7), (1, day("2020-02-28"), 0.2, 2.0, 10.0, "N", 5300, day("2000-01-01"), 7), (1, day("2020-04-30"), 0.2, 2.0, 0.0, "Z", 6500, day("2000-01-01"), 7), (2, day("2020-02-28"), None, 1.0, 5.0, "A", 9500, day("2000-01-01"), 7), (2, day("2020-03-31"), 0.3, 1.0, 5.0, "Q", None, day("2030-01-01"), 7)]
    raw = spark.createDataFrame(rows, "permno long, date date, ret double, shrout double, prc double, primaryexch string, siccd int, first_crsp_date date, mthvol long")
    free = spark.createDataFrame([(day(f"2020-0{m}-01"), 0.01) for m in range(1, 6)], "date date, risk_free double")
    out = stocks.crsp_monthly(raw, free)
    assert out.columns == ["permno", "date", "calculation_date", "ret", "shrout", "prc", "primaryexch", "siccd", "mthvol", "listing_age", "mktcap", "mktcap_lag", "exchange", "industry", "ret_excess"]
    got = [(r.permno, r.date.month, round(r.mktcap, 9), r.mktcap_lag and round(r.mktcap_lag, 9), r.exchange, r.industry, round(r.ret_excess, 9), r.listing_age) for r in out.orderBy("permno", "date").collect()]
    assert got == [(1, 1, 0.01, None, "NYSE", "Wholesale", 0.09, 240), (1, 2, 0.02, 0.01, "NYSE", "Retail", 0.19, 241), (2, 3, 0.005, 0.005, "NASDAQ", "Missing", 0.29, 0)]


def test_lagged_month_by_one_window(spark):
    """Several rows of a month, gaps and NULL keys, as a join finds them; what the panel is made from runs once."""
    rows = [(1, "2020-01-01", 1.0), (1, "2020-01-01", 2.0), (1, "2020-02-01", 3.0), (1, "2020-02-01", None), (1, "2020-03-01", 4.0), (1, "2020-05-01", 5.0), (1, None, 6.0), (None, "2020-01-01", 7.0), (None, "2020-02-01", 8.0), (2, "2019-12-01", None), (2, "2020-01-01", 9.0)]
    panel = spark.createDataFrame([(p, d and day(d), x) for p, d, x in rows], "permno long, date date, x double")
    out = stocks.lagged_month(panel, "x", "x_lag")
    assert out.columns == ["permno", "date", "x", "x_lag"] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    panel.createOrReplaceTempView("months_of_panel")
    want = spark.sql("SELECT a.*, b.x AS x_lag FROM months_of_panel a LEFT JOIN months_of_panel b ON b.permno = a.permno AND add_months(b.date, 1) = a.date")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 14


@pytest.mark.parametrize("name", ["crsp_monthly", "crsp_monthly_older", "ccm_link_join", "crsp_monthly_raw", "crsp_monthly_v1_raw"])
def test_queries_of_several_tables_make_the_panel_once(spark, name):
    import __spark_entry__ as driver
    from stratum.queries import panel

    sf_dir = "/root/testdata/sf0.001"
    assert panel(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert not [f for f in driver.queries()[name](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_older_panels(spark):
    raw = spark.createDataFrame([(1, day("2020-01-31"), 0.1, 5.0, -10.0, 2.0, 1, 5100), (2, day("2020-01-31"), 0.1, 5.0, 10.0, 0.0, 3, 100)], "permno long, date date, ret double, shrout double, altprc double, cfacpr double, exchcd int, siccd int")
    gone = spark.createDataFrame([(1, day("2020-01-15"), None, 570.0)], "permno long, dlstdt date, dlret double, dlstcd double")
    first = spark.createDataFrame([(1, day("2019-12-31"))], "permno long, first_crsp_date date")
    free = spark.createDataFrame([(day("2020-01-01"), 0.01)], "date date, risk_free double")
    got = {r.permno: r for r in stocks.crsp_monthly_v1(raw, gone, first, free).collect()}
    assert got[1].mktcap == pytest.approx(0.05) and got[1].exchange == "NYSE" and got[1].ret_excess == pytest.approx(-0.31) and got[1].prc_adj == 5 and got[2].prc_adj is None
    daily = spark.createDataFrame([(1, day("2020-01-02"), 0.1, -5.0, -99.0, 1.0, 3), (1, day("2020-01-03"), 0.1, 5.0, 8.0, 1.0, 3), (2, day("2020-01-09"), 0.2, 5.0, 8.0, 1.0, 1)], "permno long, date date, ret double, prc double, vol double, cfacpr double, exchcd int")
    gone = spark.createDataFrame([(1, day("2020-01-02"), -0.5), (1, day("2020-01-01"), -0.9), (2, day("2020-01-20"), None)], "permno long, dlstdt date, dlret double")
    free = spark.createDataFrame([(day(f"2020-01-0{k}"), 0.0) for k in (1, 2, 3, 9)], "date date, risk_free double")
    got = {(r.permno, r.date.day): (r.ret, r.vol_adj) for r in stocks.crsp_daily_v1(daily, gone, free, "2020-01-05", adjust_volume=True).collect()}
    assert got == {(1, 1): (-0.9, None), (1, 2): (-0.5, None)}


@pytest.mark.parametrize(("dlret", "code", "want"), [(None, None, 0.1), (0.4, 500.0, 0.4), (None, 500.0, -0.3), (None, 560.0, -0.3), (None, 100.0, 0.1), (None, 231.0, -1.0)])
def test_delisting_returns(spark, dlret, code, want):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(0.1, dlret, code)], "r double, d double, c double").select(stocks.delisting_return(F.col("r"), F.col("d"), F.col("c"))).first()
    assert row[0] == pytest.approx(want)


def test_volumes_and_factors(spark):
    rows = [(1, day(d), 0.1, 10.0, v, f, "Q") for d, v, f in (("2001-01-15", 20.0, 1.0), ("2001-02-15", 18.0, 2.0), ("2002-02-15", 16.0, 1.0), ("2004-02-15", -99.0, 1.0))] + [(2, day("2020-01-02"), 0.1, -4.0, 5.0, 1.0, "N"), (2, day("2020-01-03"), None, 4.0, 6.0, 1.0, "N")]
    raw = spark.createDataFrame(rows, "permno long, date date, ret double, dlyprc double, dlyvol double, dlyfacprc double, primaryexch string")
    free = raw.select("date").distinct().selectExpr("date", "0.0d as risk_free")
    got = [(r.vol_adj, r.prc_adj) for r in stocks.crsp_daily(raw, free, True).orderBy("permno", "date").collect()]
    assert got == [(10, 10), (10, 5), (10, 5), (None, 5), (5, 4)]


def test_links(spark):
    panel = spark.createDataFrame([(1, day("2020-01-01")), (1, day("2021-01-01")), (2, day("2020-01-01"))], "permno long, date date")
    links = spark.createDataFrame([(1, "001", day("2019-01-01"), day("2020-06-30")), (1, "002", day("2020-12-01"), None), (1, None, day("2019-01-01"), None)], "permno long, gvkey string, linkdt date, linkenddt date")
    got = {(r.permno, r.date.year): r.gvkey for r in stocks.add_gvkey(panel, stocks.ccm_links(links, "2021-06-30")).collect()}
    assert got == {(1, 2020): "001", (1, 2021): "002", (2, 2020): None}


def test_annual_accounts(spark):
    columns = "gvkey string, datadate date, seq double, ceq double, at double, lt double, txditc double, txdb double, itcb double, pstkrv double, pstkl double, pstk double, sale double, cogs double, xint double, xsga double, curcd string"
    rows = [("001", day("2019-12-31"), 10.0, None, 10.0, 1.0, None, None, None, None, None, None, 5.0, 1.0, None, None, "USD"), ("001", day("2020-12-31"), None, 7.0, 20.0, 1.0, None, 1.0, 1.0, None, 1.0, 1.0, 15.0, 2.0, 1.0, None, "USD"), ("001", day("2020-06-30"), 1.0, None, 99.0, 1.0, 0.0, None, None, None, None, None, 1.0, None, None, None, "USD"), ("002", day("2020-12-31"), None, None, 5.0, 9.0, None, None, None, None, None, None, 1.0, None, None, None, "CAD")]
    data = spark.createDataFrame(rows, columns)
    got = {(r.gvkey, r.date.year): r for r in accounting.compustat_annual(data).collect()}
    row = got["001", 2020]
    assert len(got) == 3 and row.be == 9 and row.op == pytest.approx(12 / 9) and row.inv == 1 and got["002", 2020].be is None and "curcd" not in row
    assert accounting.compustat_annual(data, only_usd=True).count() == 2


def test_quarterly_accounts(spark):
    rows = [("001", day("2020-03-31"), day("2020-04-20"), 1, 2020, 1.0, 1.0, "USD"), ("001", day("2020-02-28"), day("2020-04-20"), 1, 2020, 9.0, 1.0, "USD"), ("001", day("2020-06-30"), None, 2, 2020, 3.0, 1.0, "USD"), (None, day("2020-06-30"), None, 2, 2020, 4.0, 1.0, "USD"), ("001", day("2020-09-30"), day("2020-08-15"), 3, 2020, 5.0, 1.0, "USD")]
    data = spark.createDataFrame(rows, "gvkey string, datadate date, rdq date, fqtr int, fyearq int, atq double, ceqq double, curcdq string")
    assert [r.atq for r in accounting.compustat_quarterly(data).orderBy("date").collect()] == [1, 3]
    with pytest.raises(ValueError):
        accounting.compustat_quarterly(data, additional_columns=["nothing"])


NEW, OLD = day("2013-01-02"), day("2011-01-02")


def message(msg, orig, vol, side, contra, on, status, asof="", wis="N", settle=1, stlmnt=1, spcl=""):
    return ("B1", msg, orig, vol, 99.0, 4.0, side, contra, on, "10:00:00", on, "10:01:00", status, asof, wis, settle, on + datetime.timedelta(stlmnt), spcl)


TRACE = "cusip_id string, msg_seq_nb long, orig_msg_seq_nb long, entrd_vol_qt long, rptd_pr double, yld_pt double, rpt_side_cd string, cntra_mp_id string, trd_exctn_dt date, trd_exctn_tm string, trd_rpt_dt date, trd_rpt_tm string, trc_st string, asof_cd string, wis_fl string, days_to_sttl_ct int, stlmnt_dt date, spcl_trd_fl string"
MESSAGES = [
    message(10, None, 100, "B", "C", NEW, "T"), message(11, None, 101, "S", "D", NEW, "T"), message(11, None, 101, "S", "D", NEW, "X"), message(12, None, 102, "S", "C", NEW, "T"), message(99, 12, 102, "S", "C", NEW, "Y"),
    message(13, None, 103, "S", "D", NEW, "T"), message(14, None, 103, "B", "D", NEW, "T"), message(15, None, 104, "B", "D", NEW, "T"), message(16, None, 105, "B", "C", NEW, "T", settle=8), message(17, None, 106, "B", "C", NEW, "T", stlmnt=8),
    message(18, None, 107, "B", "C", NEW, "T", wis="Y"), message(19, None, 108, "B", "C", NEW, "T", spcl="Y"), message(20, None, 109, "B", "C", NEW, "T", asof="A"), message(21, None, 201, "B", "C", OLD, "T"), message(90, 21, 201, "B", "C", OLD, "C"),
    message(22, None, 202, "B", "C", OLD, "T"), message(23, 22, 203, "B", "C", OLD, "W"), message(24, 23, 204, "B", "C", OLD, "W"), message(25, 999, 205, "B", "C", OLD, "W"), message(30, None, 301, "B", "C", OLD, "T"), message(31, None, 301, "B", "C", OLD, "T", asof="R"),
]


def test_bond_trades(spark):
    data = spark.createDataFrame(MESSAGES, TRACE)
    volumes = lambda **o: sorted(r.entrd_vol_qt for r in bonds.process_trace_data(data, **o).collect())
    assert volumes() == [100, 103, 104, 201, 203, 204, 204, 205]
    assert volumes(strict_status=True) == [100, 103, 104, 204]
    assert bonds.process_trace_data(data.limit(0)).count() == 0


def test_cut_off_of_the_newer_rules(spark):
    on = day("2012-04-01")
    data = spark.createDataFrame([message(1, None, 100, "B", "C", on, "T"), message(1, None, 100, "B", "C", on, "X"), message(2, None, 200, "B", "C", on, "T")], TRACE)
    assert [r.entrd_vol_qt for r in bonds.process_trace_data(data).collect()] == [200]


def brute_corrections(trades, waiting):
    """One global loop: whoever finds a trade replaces it, until nobody does."""
    trades, waiting = [dict(t) for t in trades], [dict(w) for w in waiting]
    key = lambda r, c: (r["cusip_id"], r["trd_exctn_dt"], r[c])
    while True:
        found = [w for w in waiting for t in trades if key(t, "msg_seq_nb") == key(w, "orig_msg_seq_nb")]
        if not found:
            return trades
        gone = {key(w, "orig_msg_seq_nb") for w in found}
        waiting = [w for w in waiting if key(w, "orig_msg_seq_nb") not in gone]
        trades = [t for t in trades if key(t, "msg_seq_nb") not in gone] + found


@pytest.mark.parametrize(("seed", "numbers", "corrections"), [(1, 12, 0.5), (2, 18, 0.9), (3, 30, 0.85)])
def test_corrections_equal_one_global_loop(spark, seed, numbers, corrections):
    """Branches, circles, repeated messages, missing numbers, and chains of several corrections."""
    r = np.random.default_rng(seed)
    rows = [{"cusip_id": f"B{r.integers(3)}", "trd_exctn_dt": day(f"2011-01-0{r.integers(1, 4)}"), "msg_seq_nb": int(r.integers(numbers)), "orig_msg_seq_nb": None if r.random() < 0.3 else int(r.integers(numbers)), "v": k, "_w": bool(r.random() < corrections)} for k in range(160)]
    schema = "cusip_id string, trd_exctn_dt date, msg_seq_nb long, orig_msg_seq_nb long, v long"
    table = lambda w: spark.createDataFrame([{k: x for k, x in row.items() if k != "_w"} for row in rows if row["_w"] == w], schema)
    got = bonds._corrected(table(False), table(True)).collect()
    want = brute_corrections([x for x in rows if not x["_w"]], [x for x in rows if x["_w"]])
    assert sorted(x.v for x in got) == sorted(x["v"] for x in want)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A trade that is corrected 10,000 times in a row, once twice over, and a circle that no trade leads to."""
    made = []
    write = bonds.materialize
    monkeypatch.setattr(bonds, "materialize", lambda df, name: made.append(name) or write(df, name))
    on = day("2011-01-03")
    schema = "cusip_id string, trd_exctn_dt date, msg_seq_nb long, orig_msg_seq_nb long"
    chain = [("B", on, k + 1, k) for k in range(10_000)] + [("B", on, 5001, 5000), ("C", on, 1, 2), ("C", on, 2, 1)]
    got = bonds._corrected(spark.createDataFrame([("B", on, 0, None), ("D", on, 0, None)], schema), spark.createDataFrame(chain, schema)).collect()
    assert sorted((r.cusip_id, r.msg_seq_nb) for r in got) == [("B", 10_000)] * 2 + [("D", 0)]
    assert len(made) < 25


def test_copies_of_corrections_are_counted_until_the_end(spark, monkeypatch):
    """40 corrections of a number that 50 trades carry are 2,000 rows, made after all sorts and joins; 60 of them are reversed."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(bonds, "BLOCK", 16, raising=False)
    at = lambda row, hour: (*row[:9], f"{hour:02}:00:00", *row[10:])
    rows = [message(1, None, 200, "B", "C", OLD, "T")] * 50 + [at(message(2 + k, 1, 100, "B", "C", OLD, "W"), 10 + k // 10) for k in range(40)]
    rows += [message(900 + k, None, 100, "B", "C", OLD, "T", asof="R") for k in range(60)] + [message(999, None, 300, "B", "C", OLD, "T")]
    out = bonds.process_trace_data(spark.createDataFrame(rows, TRACE))
    plan = [line.strip(" :+-") for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    first = lambda *names: next(k for k, line in enumerate(plan) if line.startswith(names))
    assert first("Generate") < first("Join", "Window", "Sort", "Aggregate")
    got = {(r.entrd_vol_qt, r.trd_exctn_tm): r.n for r in out.groupBy("entrd_vol_qt", "trd_exctn_tm").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = 10 * 50 + 10  # copies of ten corrections, and these as messages
    assert got == {(100, "10:00:00"): each - 60, (300, "10:00:00"): 1} | {(100, f"{h}:00:00"): each for h in (11, 12, 13)}


def test_bond_universe(spark):
    plain = {"security_level": "SEN", "bond_type": "CDEB", "foreign_currency": "N", "coupon_type": "F", "coupon_change_indicator": "N", "interest_frequency": "2", "rule_144a": "N", "defaulted": "N", "convertible": "N", "perpetual": "N"}
    names = [*bonds.ISSUE_COLUMNS, *(w for w in "security_level slob security_pledge asset_backed defeased defeased_date bond_type pay_in_kind pay_in_kind_exp_date yankee canadian foreign_currency coupon_type fix_frequency coupon_change_indicator rule_144a private_placement defaulted filing_date settlement convertible exchange putable unit_deal exchangeable perpetual preferred_security".split())]
    change = [{}, {"yankee": "N"}, {"yankee": "Y"}, {"interest_frequency": "9"}, {"exchange": "X"}, {"putable": "Y"}, {"pay_in_kind": "N"}]
    rows = [{n: None for n in names} | plain | {"issue_id": str(k), "issuer_id": "1"} | c for k, c in enumerate(change)] + [{n: None for n in names} | plain | {"issue_id": "foreign", "issuer_id": "2"}]
    issues = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    issuers = spark.createDataFrame([("1", "1000", "USA"), ("2", "1000", "CAN")], "issuer_id string, sic_code string, country_domicile string")
    assert sorted(r.issue_id for r in bonds.fisd_bonds(issues, issuers).collect()) == ["0", "1", "6"]
    with pytest.raises(ValueError):
        bonds.fisd_bonds(issues, issuers, ["a; drop"])
