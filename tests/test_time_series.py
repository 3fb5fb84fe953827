import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratum import Offset, add_lagged_columns, as_spark, compute_rolling_value, create_summary_statistics, estimate_betas, estimate_fama_macbeth, estimate_model, join_lagged_values, months, newey_west_se
from stratum.functions.calendar import to_offset
from stratum.functions.formula import parse_formula
from stratum.functions.newey_west import ar1


def day(text):
    return datetime.date.fromisoformat(text)


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(day(x) if isinstance(x, str) and x[:2] == "20" else x for x in r) for r in rows], schema)


def lagged(df, column="size_lag"):
    return [r[column] for r in df.orderBy("date").collect()]


def test_exact_lag(spark):
    rows = [(p, f"2023-0{m}-01", float(4 * p + m - 4)) for p in (1, 2) for m in (1, 2, 3, 4)]
    out = add_lagged_columns(frame(spark, rows, "permno int, date date, size double"), "size", months(1), by="permno")
    assert lagged(out.where("permno = 1")) == [None, 1, 2, 3] and lagged(out.where("permno = 2")) == [None, 5, 6, 7]
    clipped = frame(spark, [("2023-01-30", 1.0), ("2023-01-31", 2.0), ("2023-02-28", 3.0)], "date date, size double")
    assert lagged(add_lagged_columns(clipped, "size", months(1))) == [None, None, 2]
    with pytest.raises(ValueError, match="already has"):
        add_lagged_columns(out, "size", months(1))
    with pytest.raises(ValueError, match="unique"):
        add_lagged_columns(clipped.union(clipped), "size", months(1), check_keys=True)


def test_window_lag(spark):
    data = frame(spark, [("2023-01-01", 1.0), ("2023-02-01", 2.0), ("2023-06-01", 3.0)], "date date, size double")
    assert lagged(add_lagged_columns(data, "size", months(1), months(2))) == [None, 1, None]
    holes = frame(spark, [(f"2023-0{m}-01", x) for m, x in enumerate([1.0, None, None, 4.0, 5.0], 1)], "date date, size double")
    assert lagged(add_lagged_columns(holes, "size", months(1), months(3)))[3] is None
    assert lagged(add_lagged_columns(holes, "size", months(1), months(3), drop_na=True))[3] == 1
    year = frame(spark, [("2022-06-01", 10.0), ("2022-12-01", 20.0), ("2023-06-01", 30.0)], "date date, size double")
    assert lagged(add_lagged_columns(year, "size", months(6), ff_adjustment=True)) == [None, None, 20]


def test_window_lag_equals_merge_asof(spark):
    r = np.random.default_rng(3)
    rows = sorted({(int(g), day("2023-01-01") + datetime.timedelta(int(k))) for g, k in zip(r.integers(0, 5, 300), r.integers(0, 200, 300))})
    data = pd.DataFrame([(g, d, float(k) if k % 5 else None) for k, (g, d) in enumerate(rows)], columns=["g", "date", "x"])
    got = add_lagged_columns(as_spark(data, spark), "x", 3, 10, by="g").toPandas().sort_values(["g", "date"])
    for row in got.itertuples():
        source = data[(data.g == row.g) & (data.date <= row.date - datetime.timedelta(3))]
        want = source.iloc[-1].x if len(source) and source.iloc[-1].date >= row.date - datetime.timedelta(10) else None
        assert (pd.isna(row.x_lag) and pd.isna(want)) or row.x_lag == want


def test_lag_from_another_table(spark):
    target = frame(spark, [(1, "2023-02-01"), (1, "2023-04-01"), (1, "2023-05-01")], "id int, date date")
    source = frame(spark, [(1, "2023-01-01", 10.0, 20.0)], "id int, date date, x double, y double")
    out = join_lagged_values(target, source, "id", months(1), months(3))
    assert lagged(out, "x") == [10, 10, None] and lagged(out, "y") == [20, 20, None]
    target = frame(spark, [(1, "2022-08-01"), (1, "2023-03-01")], "id int, date date")
    source = frame(spark, [(1, "2022-06-01", 5.0), (1, "2022-12-01", 10.0)], "id int, date date, x double")
    assert lagged(join_lagged_values(target, source, "id", months(1), months(3), ff_adjustment=True), "x") == [None, 10]
    for change in ({"min_lag": months(-1)}, {"min_lag": months(5)}, {"id_keys": "nothing"}, {"new_data": source.withColumnRenamed("x", "date2").withColumn("x", F.lit(1)).drop("id")}):
        with pytest.raises(ValueError):
            join_lagged_values(**{"original_data": target, "new_data": source, "id_keys": "id", "min_lag": months(1), "max_lag": months(3)} | change)


def test_offsets():
    assert to_offset(5) == Offset(days=5) and to_offset(pd.DateOffset(months=2)) == months(2) and to_offset(pd.Timedelta(days=3)) == Offset(days=3)
    assert Offset(days=31).equals(months(1)) and not Offset(days=30).equals(months(1))
    for bad in (True, "x", 1.5, pd.Timedelta(hours=1)):
        with pytest.raises(ValueError):
            to_offset(bad)


def rolling_oracle(data, f, periods, least):
    b = data.date.map(lambda d: d.year * 12 + d.month)
    out = []
    for k in b:
        rows = data[(b <= k) & (b > k - periods)].dropna()
        out.append(f(rows) if len(rows) >= least else None)
    return out


@pytest.mark.parametrize("f", ["avg(value)", "column", lambda rows: rows.value.mean()])
def test_rolling_value(spark, f):
    f = F.avg("value") if f == "column" else f
    r = np.random.default_rng(42)
    dates = [d.date() for d in pd.date_range("2020-01-01", periods=24, freq="MS")] + [day("2020-05-20"), day("2021-03-09")]
    data = pd.DataFrame({"date": dates, "value": r.normal(size=26)})
    data.loc[4, "value"] = None
    data = data.sort_values("date", ignore_index=True)
    got = compute_rolling_value(as_spark(data, spark), f, "month", 4).orderBy("date").toPandas().rolling_value
    want = rolling_oracle(data, lambda x: x.value.mean(), 4, 4)
    assert [pd.isna(a) == (b is None) and (b is None or abs(a - b) < 1e-12) for a, b in zip(got, want)] == [True] * 26
    for bad in ({"period": "day"}, {"periods": 0}, {"min_obs": 0}):
        with pytest.raises(ValueError):
            compute_rolling_value(as_spark(data, spark), f, **bad)


def test_summary(spark):
    r = np.random.default_rng(42)
    data = pd.DataFrame({"group": r.choice(["A", "B"], 100), "x": r.normal(size=100), "y": r.integers(0, 9, 100)})
    data.loc[3, "x"] = np.nan
    got = create_summary_statistics(as_spark(data, spark), ["x", "y"], detail=True).toPandas().set_index("variable")
    want = data[["x", "y"]].describe(percentiles=[0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]).T
    assert np.allclose(got[want.columns].astype(float), want)
    by = create_summary_statistics(as_spark(data, spark), ["x"], by="group", wide=True).toPandas().set_index("group")
    assert np.allclose(by["x_50%"].sort_index(), data.groupby("group").x.median())
    assert create_summary_statistics(as_spark(data, spark), ["y"], drop_na=True).first()["count"] == 100
    assert create_summary_statistics(as_spark(data, spark), ["x", "y"], drop_na=True).toPandas()["count"].tolist() == [99, 99]
    with pytest.raises(ValueError, match="numeric"):
        create_summary_statistics(as_spark(data, spark), ["group"])


SERIES = [0.01, -0.02, 0.015, 0.03, -0.01, 0.005, 0.02, -0.025, 0.01, 0, 0.018, -0.012, 0.022, -0.008, 0.014, 0.006, -0.019, 0.011, 0.027, -0.003]


@pytest.mark.parametrize(("options", "se"), [({}, 0.000646974246259443), ({"prewhite": 0}, 0.00094140519968821), ({"lag": 3, "prewhite": 0}, 0.00177500880279507), ({"lag": 3}, 0.00140568050935899), ({"lag": 6, "prewhite": 0}, 0.0012883225527793873)])
def test_newey_west(options, se):
    assert newey_west_se(SERIES, **options) == pytest.approx(se, rel=1e-9)
    assert newey_west_se([*SERIES[:5], float("nan"), *SERIES[5:]], **options) == pytest.approx(se, rel=1e-9)


def test_newey_west_of_short_series():
    assert np.isnan(newey_west_se([1.0])) and newey_west_se([2.0, 2.0]) == 0
    rho, rest = ar1(np.asarray([1.0, 2, 4, 8, 16]))
    assert rho == 2 and (rest == 0).all()


@pytest.mark.parametrize(("text", "names"), [("y ~ x", ("Intercept", "x")), ("y~x+z", ("Intercept", "x", "z")), ("y ~ x - 1", ("x",)), ("y ~ 0 + x", ("x",)), ("y ~ x -1", ("x",)), ("y ~ 1", ("Intercept",)), ("y ~ a*b", ("Intercept", "a", "b", "a:b")), ("y ~ log(x) + z", ("Intercept", "log(x)", "z"))])
def test_formulas(text, names):
    assert parse_formula(text).names == names


@pytest.fixture(scope="module")
def regression_data():
    r = np.random.default_rng(42)
    return pd.DataFrame({"permno": np.repeat([1, 2], 100), "date": list(pd.date_range("2020-01-01", periods=100).date) * 2, "y": r.normal(size=200) + 5, "x": r.normal(size=200) + 50, "z": r.normal(size=200)})


@pytest.mark.parametrize("model", ["y ~ x", "y ~ x + z", "y ~ x - 1", "y ~ x + z - 1", "y ~ 1"])
def test_rolling_betas_equal_least_squares(spark, regression_data, model):
    data = regression_data.copy()
    data.loc[[5, 120], "x"] = np.nan
    formula = parse_formula(model)
    got = estimate_betas(as_spark(data, spark), model, 30).toPandas()
    assert len(got) == 200 and list(got.columns) == [*formula.names, "permno", "date"]
    for p, rows in data.groupby("permno"):
        full = rows.dropna(subset=["y", *formula.regressors]).reset_index(drop=True)
        mine = got[got.permno == p].set_index("date")
        for k in range(0, len(full), 7):
            window = full.iloc[max(0, k - 29) : k + 1]
            row = mine.loc[full.date[k], list(formula.names)]
            if len(window) < 24:
                assert row.isna().all()
            else:
                X = np.column_stack([np.ones(len(window)) if n == "Intercept" else window[n] for n in formula.names])
                assert np.allclose(row.astype(float), np.linalg.lstsq(X, window.y, rcond=None)[0], rtol=1e-8)


def test_singular_windows_are_null(spark, regression_data):
    for model in ("y ~ x", "y ~ x + z"):
        got = estimate_betas(as_spark(regression_data.assign(x=3.0), spark), model, 30).toPandas()
        assert got["Intercept"].isna().all()


def test_model(spark, regression_data):
    out = estimate_model(as_spark(regression_data, spark), "y ~ x + z", output=["coefficients", "tstats", "residuals"])
    X = np.column_stack([np.ones(200), regression_data.x, regression_data.z])
    beta, rss = np.linalg.lstsq(X, regression_data.y, rcond=None)[:2]
    se = np.sqrt(rss[0] / 197 * np.diag(np.linalg.inv(X.T @ X)))
    assert np.allclose(list(out["coefficients"].first()), beta, rtol=1e-8) and np.allclose(list(out["tstats"].first()), beta / se, rtol=1e-7)
    rest = out["residuals"].toPandas().merge(regression_data)
    assert np.allclose(rest.residual, rest.y - beta[0] - beta[1] * rest.x - beta[2] * rest.z, atol=1e-8)
    few = as_spark(regression_data.head(3), spark)
    assert list(estimate_model(few, "y ~ x + z", min_obs=4).first()) == [None] * 3
    assert estimate_model(few, "y ~ x + z", min_obs=4, output="residuals").where("residual IS NOT NULL").count() == 0
    for change in ({"model": "y x"}, {"output": "other"}, {"model": "y ~ q"}):
        with pytest.raises(ValueError):
            estimate_model(**{"data": few, "model": "y ~ x"} | change)


def test_fama_macbeth_golden_values(spark):
    r, parts = np.random.default_rng(987654), []
    for d in pd.date_range("2000-01-31", periods=48, freq="ME"):
        beta, bm, size, eps = r.normal(1, 0.3, 40), r.normal(0.5, 0.2, 40), r.normal(10, 1, 40), r.normal(0, 0.05, 40)
        parts.append(pd.DataFrame({"date": d.date(), "beta": beta, "bm": bm, "size": size, "ret": 0.002 + 0.0015 * beta - 0.003 * bm + 0.0008 * size + eps}))
    out = estimate_fama_macbeth(as_spark(pd.concat(parts), spark), "ret ~ beta + bm + size", detail=True)
    got = out["coefficients"].toPandas().set_index("factor")
    for factor, t in {"Intercept": -0.792, "beta": 2.301, "bm": 1.005, "size": 0.887}.items():
        assert got.t_statistic[factor] == pytest.approx(t, abs=5e-4)
    assert got.risk_premium["beta"] == pytest.approx(0.007, abs=5e-4) and set(got.n) == {48.0}
    assert out["summary_statistics"].first().n_obs == 40
    with pytest.raises(ValueError):
        estimate_fama_macbeth(as_spark(parts[0], spark), "ret ~ beta", vcov="other")


def test_frames_have_no_nan(spark):
    assert as_spark(pd.DataFrame({"x": [1.0, np.nan]}), spark).where("x IS NULL").count() == 1


def test_lags_without_groups_are_sorted_in_stretches(spark):
    """One long series, with dates that tie and are missing: the same as in a single group."""
    start = datetime.date(2001, 1, 1)
    days = [start + datetime.timedelta(days=int(d)) for d in np.random.default_rng(4).choice(900, 400, replace=False)]
    rows = [(1, d, float(k) if k % 5 else None) for k, d in enumerate(days)] + [(1, None, 7.0)]
    data = spark.createDataFrame(rows, "g int, date date, x double").repartition(6)
    for drop in (False, True):
        plain = add_lagged_columns(data.drop("g"), "x", 10, 30, drop_na=drop).collect()
        grouped = add_lagged_columns(data, "x", 10, 30, by="g", drop_na=drop).drop("g").collect()
        assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, grouped), key=str)
    few = spark.createDataFrame([(start, 1.0)], "date date, x double")
    assert add_lagged_columns(few, "x", 0, 5).collect() == [(start, 1.0, 1.0)]
    assert add_lagged_columns(few.where("x < 0"), "x", 0, 5).count() == 0
