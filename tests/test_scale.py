"""Large means, hot groups, long windows and many windows: the same results, by plans that hold."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratum import add_lagged_columns, as_spark, compute_rolling_value, create_summary_statistics, estimate_betas, estimate_fama_macbeth, estimate_model, join_lagged_values, quantiles
from stratum.functions import least_squares, quantile
from stratum.functions.panes import PaneAggregate
from stratum.functions.quantile import refined_quantiles
from stratum.functions.rolling_fit import window_fits
from stratum.operators import lagging, regression, validity


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def slopes(rows, columns, intercept=True):
    centre = lambda c: c - c.mean() if intercept else c
    return np.linalg.lstsq(np.column_stack([centre(rows[c]) for c in columns]), centre(rows["y"]), rcond=None)[0]


@pytest.mark.parametrize(("mean", "apart"), [(0, 1), (1e5, 1), (1e6, 1), (50, 1e-4), (1e6, 0.05)])
def test_fits_keep_their_digits(spark, mean, apart):
    r = np.random.default_rng(3)
    x = r.normal(size=1500) + mean
    data = pd.DataFrame({"g": r.integers(0, 3, 1500), "x": x, "z": x + apart * r.normal(size=1500)})
    data["y"] = 3 * data.x - 2 * data.z + r.normal(size=1500)
    table = as_spark(data, spark).repartition(5)
    for model, columns in (("y ~ x", ["x"]), ("y ~ x + z", ["x", "z"])):
        got = estimate_model(table, model, by=["g"]).toPandas().set_index("g")
        for g, rows in data.groupby("g"):
            assert np.allclose(got.loc[g, columns].astype(float), slopes(rows, columns), rtol=1e-9, atol=0)
    fm = estimate_fama_macbeth(table.withColumn("date", F.col("g")), "y ~ x + z", vcov="iid").toPandas().set_index("factor")
    want = np.mean([slopes(rows, ["x", "z"]) for _, rows in data.groupby("g")], axis=0)
    assert np.allclose(fm.loc[["x", "z"], "risk_premium"], want, rtol=1e-9, atol=0)


def test_fits_of_odd_groups(spark, monkeypatch):
    empty = spark.createDataFrame([], "g int, x double, y double")
    assert estimate_model(empty, "y ~ x").collect() == [(None, None)] and estimate_model(empty, "y ~ x", by=["g"]).collect() == []
    rows = [(None, 1.0, 2.0), (None, 2.0, 4.5), (None, 3.0, 5.0), (1, None, 1.0), (2, 1.0, 1.0), (2, 1.0, 1.0)]
    got = {r.g: r for r in estimate_model(spark.createDataFrame(rows, "g int, x double, y double"), "y ~ x", by=["g"]).collect()}
    assert got[None].x == pytest.approx(1.5) and got[1].x is None and got[2].x == pytest.approx(0.5)
    collinear = spark.createDataFrame([(1.0, 2.0, 2.0), (2.0, 4.0, 3.0), (3.0, 6.0, 5.0), (5.0, 10.0, 1.0)], "x double, z double, y double")
    want = np.linalg.lstsq(np.asarray([[1, 1, 2], [1, 2, 4], [1, 3, 6], [1, 5, 10.0]]), np.asarray([2, 3, 5, 1.0]), rcond=None)[0]
    assert np.allclose(list(estimate_model(collinear, "y ~ x + z").first()), want)
    # Factors that are made of few rows and sent early merge to the same fit.
    r = np.random.default_rng(8)
    data = pd.DataFrame({"g": r.integers(0, 40, 3000), "x": r.normal(size=3000) + 1e4, "y": r.normal(size=3000)})
    once = estimate_model(as_spark(data, spark), "y ~ x", by=["g"], output="tstats").toPandas().sort_values("g")
    monkeypatch.setattr(least_squares, "GATHERED", 100)
    monkeypatch.setattr(least_squares, "HELD", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 90)
    try:
        pieces = estimate_model(as_spark(data, spark), "y ~ x", by=["g"], output="tstats").toPandas().sort_values("g")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(once, pieces, rtol=1e-9)


@pytest.mark.parametrize("kind", ["lognormal", "narrow", "ties", "ascending"])
def test_refined_quantiles_equal_numpys(spark, kind, monkeypatch):
    monkeypatch.setattr(quantile, "SMALL_GROUP", 2000)
    monkeypatch.setattr(quantile, "ACCURACY", 500)
    r = np.random.default_rng(1)
    n = 20_000
    x = {"lognormal": np.round(r.lognormal(0, 2, n), 3), "narrow": 1e6 + r.normal(size=n), "ties": r.integers(0, 4, n) * 1.0, "ascending": np.arange(n) * 1.0}[kind]
    g = (r.random(n) < 0.03).astype(int)
    table = spark.createDataFrame(pd.DataFrame({"g": g, "x": x})).repartition(6).unionByName(spark.createDataFrame([(0, None)], "g int, x double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    assert refined_quantiles(table, [], "x", probs).first()[0] == [float(np.quantile(x, p)) for p in probs]
    for row in refined_quantiles(table, ["g"], "x", probs).collect():
        assert row.quantiles == [float(np.quantile(x[g == row.g], p)) for p in probs]
    # What is shuffled: sketches, and a small part of the values.
    counted = quantiles(table, [], "x", [0.5])
    assert counted.first()[0] == [float(np.quantile(x, 0.5))] and "RepartitionByExpression" not in plan_of(counted)


def test_summary_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SMALL_GROUP", 500)
    r = np.random.default_rng(2)
    data = pd.DataFrame({"g": np.where(r.random(9000) < 0.4, "a", "b"), "x": r.normal(size=9000), "y": r.normal(size=9000) * 1e-9 + 5})
    got = create_summary_statistics(as_spark(data, spark), ["x", "y"], by="g", detail=True).toPandas().set_index(["g", "variable"])
    for g, rows in data.groupby("g"):
        for v in ("x", "y"):
            for label, p in (("1%", 0.01), ("25%", 0.25), ("50%", 0.5), ("99%", 0.99)):
                assert got.loc[(g, v), label] == np.quantile(rows[v], p)


def brute_betas(rows, columns, length, least, intercept):
    out = []
    for k in range(len(rows)):
        w = rows.iloc[max(0, k - length + 1) : k + 1]
        X = np.column_stack([np.ones(len(w))] * intercept + [w[c] for c in columns])
        out.append(np.linalg.lstsq(X, w.y, rcond=None)[0] if len(w) >= least else np.full(X.shape[1], np.nan))
    return np.asarray(out)


@pytest.mark.parametrize("length", [3, 40, 100, 399, 400, 5000])
def test_window_fits_equal_least_squares(length):
    r = np.random.default_rng(4)
    drift = np.cumsum(r.normal(size=400)) * 3 + 1e4
    rows = pd.DataFrame({"x": drift + r.normal(size=400), "z": r.normal(size=400)})
    rows["y"] = rows.x * 0.5 - rows.z + r.normal(size=400)
    for columns in (["x"], ["x", "z"], []):
        got = window_fits(rows[[*columns, "y"]].to_numpy(), length, min(length, 5) if length > 3 else 3, True)
        want = brute_betas(rows, columns, length, min(length, 5) if length > 3 else 3, True)
        many = slice(20, None) if len(columns) < 2 or length > 3 else slice(0, 0)
        assert (np.isnan(got) == np.isnan(want)).all() or length == 3
        assert np.allclose(got[many], want[many], rtol=1e-8, atol=1e-8, equal_nan=True)


def test_hot_series_are_cut_into_stretches(spark, monkeypatch):
    """An id with most of the rows, more than one stretch, windows that reach over their bounds: as in one piece."""
    r = np.random.default_rng(6)
    rows = [(1, k, float(v), float(w)) for k, (v, w) in enumerate(zip(r.normal(size=900) + 100, r.normal(size=900)))]
    rows += [(g, k, float(r.normal()), float(r.normal())) for g in (2, 3, None) for k in range(60)]
    rows = [(g, k, None if k % 11 == 5 else x, y) for g, k, x, y in rows]
    data = spark.createDataFrame(rows, "permno int, date int, x double, y double").repartition(5)
    for length in (7, 100, 300):
        whole = {(r.permno, r.date): r for r in estimate_betas(data, "y ~ x", length, 5).collect()}
        monkeypatch.setattr(regression, "LONG_SERIES", 128)
        cut = {(r.permno, r.date): r for r in estimate_betas(data, "y ~ x", length, 5).collect()}
        monkeypatch.undo()
        assert len(cut) == len(rows) and cut.keys() == whole.keys()
        for key, one in whole.items():
            assert (one.x is None) == (cut[key].x is None)
            if one.x is not None:
                assert one.x == pytest.approx(cut[key].x, rel=1e-8, abs=1e-10) and one.Intercept == pytest.approx(cut[key].Intercept, rel=1e-8, abs=1e-8)
    assert estimate_betas(data.where("x > 1e9"), "y ~ x", 5).count() == 0


def test_rolling_values_are_merged_from_panes(spark):
    r = np.random.default_rng(7)
    dates = [datetime.date(2020, 1, 1) + datetime.timedelta(int(d)) for d in r.integers(0, 900, 500)]
    data = pd.DataFrame({"g": r.integers(0, 3, 500), "date": dates, "x": r.normal(size=500) + 1e6, "n": r.integers(0, 50, 500)})
    data.loc[::17, "x"] = np.nan
    table = as_spark(data, spark).repartition(4)
    merged = ["avg(x)", "stddev_samp(x)", "var_pop(x)", "max(x) - min(n)", "sum(n) / count(*)", "sqrt(variance(x)) + mean(n * 2)"]
    other = ["median(x)", "count(DISTINCT n)", "max_by(x, date)", "sum(CAST(n AS decimal(9, 2)))"]
    assert all(PaneAggregate.of(f, table) for f in merged) and not any(PaneAggregate.of(f, table) for f in other)
    assert PaneAggregate.of(F.stddev_samp("x"), table)
    for f in merged:
        for by in (["g"], []):
            got = compute_rolling_value(table, f, "month", 5, 3, by=by).toPandas()
            plain = compute_rolling_value(table, f"{f} + max_by(0, date)", "month", 5, 3, by=by).toPandas()
            keys = ["g", "date", "n", "x"]
            a, b = (d.sort_values(keys, ignore_index=True).rolling_value.astype(float) for d in (got, plain))
            assert np.allclose(a, b, rtol=1e-7, equal_nan=True) and a.notna().any()
    # Rows are not sent to windows one by one.
    assert "Generate" not in plan_of(compute_rolling_value(table, "avg(x)", "month", 60, by=["g"]))
    assert "Generate" in plan_of(compute_rolling_value(table, "median(x)", "month", 60, by=["g"]))


def test_lags_of_hot_groups_are_sorted_in_stretches(spark, monkeypatch):
    """A group with most of the rows, with dates that tie or are missing, and a NULL group: as in one piece."""
    start = datetime.date(2001, 1, 1)
    days = [start + datetime.timedelta(days=int(d)) for d in np.random.default_rng(4).choice(900, 500, replace=False)]
    rows = [(1, d, float(k) if k % 5 else None) for k, d in enumerate(days)] + [(1, None, 7.0)]
    rows += [(g, d, float(k)) for g in (2, None) for k, d in enumerate(days[:40])]
    data = spark.createDataFrame(rows, "g int, date date, x double").repartition(6)
    other = data.where("x IS NOT NULL").withColumnRenamed("x", "y").where("pmod(y, 3) = 0")
    plain = [add_lagged_columns(data, "x", 10, 30, by="g", drop_na=drop).collect() for drop in (False, True)]
    joined = join_lagged_values(data, other, "g", 5, 60).collect()
    monkeypatch.setattr(lagging, "LONG_GROUP", 100)
    monkeypatch.setattr(lagging, "SMALL_INPUT", 0)
    for drop, want in zip((False, True), plain):
        got = add_lagged_columns(data, "x", 10, 30, by="g", drop_na=drop)
        assert "_stretch" in plan_of(got)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert sorted(map(tuple, join_lagged_values(data, other, "g", 5, 60).collect()), key=str) == sorted(map(tuple, joined), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_validity_joins_of_crowded_ids(spark, monkeypatch, how):
    """Overlapping, nested, open and empty intervals, NULLs: as a comparison of all pairs finds them."""
    r = np.random.default_rng(11)
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(int(k))
    spans = [(int(g), day(a), day(a + n), f"v{k}") for k, (g, a, n) in enumerate(zip(r.integers(0, 2, 300), r.integers(0, 2000, 300), r.choice([0, 3, 40, 900], 300)))]
    spans += [(0, day(100), day(50), "empty"), (0, None, day(70), "null"), (None, day(0), day(3000), "none"), (5, day(0), day(3000), "alone")]
    rows = [(g, day(d), k) for k, (g, d) in enumerate(zip([*r.integers(0, 3, 200), 5, 5], r.integers(-50, 3200, 202)))]
    rows = [(int(g), d, k) for g, d, k in rows] + [(None, day(5), 900), (0, None, 901)]
    left = spark.createDataFrame(rows, "permno int, date date, k int").repartition(3)
    right = spark.createDataFrame(spans, "permno int, start date, end date, name string").repartition(3)
    want = []
    for g, d, k in rows:
        hits = [(g, d, k, n) for h, a, b, n in spans if g is not None and g == h and d and a and a <= d <= b]
        want += hits or ([(g, d, k, None)] if how == "left" else [])
    plain = validity.join_validity(left, right, "permno", "date", "start", "end", how)
    monkeypatch.setattr(validity, "CROWDED", 20)
    monkeypatch.setattr(validity, "SMALL_INPUT", 0)
    cut = validity.join_validity(left, right, "permno", "date", "start", "end", how)
    assert "_bin" in plan_of(cut) and "_bin" not in plan_of(plain)
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(cut.collect()) == key(plain.collect()) == key(want) and cut.columns == ["permno", "date", "k", "name"]


def test_an_id_with_many_intervals(spark, monkeypatch):
    monkeypatch.setattr(validity, "SMALL_INPUT", 0)
    starts = spark.range(100_000).select(F.lit(1).alias("permno"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("start"), F.col("id").alias("name"))
    spans = starts.withColumn("end", F.date_add("start", 4))
    rows = spark.range(20_000).select(F.lit(1).alias("permno"), F.date_add(F.lit("1900-01-10").cast("date"), F.col("id").cast("int")).alias("date"))
    got = validity.join_validity(rows, spans, "permno", "date", "start", "end")
    assert got.count() == 20_000 * 15
