"""Reads of a database, and of folders, that leave out what is not asked for."""

import warnings

import pytest
from pyspark.sql import functions as F

from stratum import filter_options, filter_sorting_data
from stratum.sources import factors
from stratum.sources.database import id_ranges, read_ids, read_table


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    """An embedded database with a table of daily stock rows."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/stocks;create=true"
    rows = spark.range(600).select(
        (F.col("id") % 30 + 10_000).cast("int").alias("PERMNO"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 30).cast("int")).alias("DAY"), (F.col("id") * 0.01).alias("RET"), F.lit("x").alias("NOTE")
    )
    rows.write.jdbc(url, "DSF", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    return url


DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_read_in_ranges(spark, url):
    whole = read_table(spark, url, "DSF", properties=DRIVER)
    assert whole.count() == 600 and whole.columns == ["permno", "day", "ret", "note"]
    split = read_table(spark, url, "DSF", ["permno", "ret"], split_by="PERMNO", partitions=5, properties=DRIVER)
    assert split.rdd.getNumPartitions() == 5 and split.count() == 600 and split.select("permno").distinct().count() == 30
    few = split.where("permno < 10003")
    plan = scans(few)
    assert few.count() == 60 and "PushedFilters" in plan and "LessThan" in plan and "NOTE" not in plan.split("ReadSchema")[-1]
    days = read_table(spark, url, "DSF", split_by="DAY", partitions=4, where="PERMNO = 10005", properties=DRIVER)
    assert days.rdd.getNumPartitions() == 4 and days.count() == 20
    assert read_table(spark, url, "DSF", split_by="DAY", where="PERMNO = 1", properties=DRIVER).count() == 0
    assert read_table(spark, url, "DSF", split_by="PERMNO", properties=DRIVER).rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="Missing"):
        read_table(spark, url, "DSF", ["other"], properties=DRIVER)


def test_ids_become_ranges(spark, url):
    assert id_ranges([5, 1, 2, 900, 901, 5], 10) == [(1, 5), (900, 901)] and id_ranges([]) == []
    got = read_ids(spark, url, "DSF", "PERMNO", [10_001, 10_002, 10_020, 10_021, 99_999], ["permno", "ret"], "RET < 3", 5, DRIVER)
    assert got.rdd.getNumPartitions() == 3 and got.columns == ["permno", "ret"]
    want = read_table(spark, url, "DSF", properties=DRIVER).where("permno IN (10001, 10002, 10020, 10021) AND ret < 3").select("permno", "ret")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 40
    assert read_ids(spark, url, "DSF", "PERMNO", [], properties=DRIVER).count() == 0


def test_only_folders_of_the_grid_are_read(spark, tmp_path):
    keys = [(k, f"sv_v{k}" if k % 2 else f"v{k}", lag) for k, lag in enumerate(["6m", "3m"] * 6)]
    rows = spark.createDataFrame([(k, sv, lag, f"2020-0{d}-01", float(k)) for k, sv, lag in keys for d in (1, 2)], "id int, sorting_variable string, sorting_variable_lag string, date string, ret double")
    rows.withColumn("date", F.to_date("date")).write.partitionBy("sorting_variable", "sorting_variable_lag").parquet(str(tmp_path / "lib"))
    grid = spark.createDataFrame([(k, sv, lag) for k, sv, lag in keys] + [(99, "sv_none", "6m")], "id int, sorting_variable string, sorting_variable_lag string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = factors.read_factor_library(spark, str(tmp_path / "lib"), grid, ids=[3, 4])
        assert sorted((r.id, r.sorting_variable, r.ret) for r in got.collect()) == [(3, "v3", 3.0), (3, "v3", 3.0), (4, "v4", 4.0), (4, "v4", 4.0)]
        leaves = got._jdf.queryExecution().executedPlan().collectLeaves()
        read = [leaves.apply(k).metrics().get("numPartitions") for k in range(leaves.size())]
        assert [m.get().value() for m in read if m.isDefined()] == [2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    with pytest.raises(ValueError, match="none"):
        factors.read_factor_library(spark, str(tmp_path / "lib"), grid, ids=[3, 99])


def test_losses_of_filters_are_observed_in_one_run(spark):
    rows = [(k, "2020-01-01", 6500 if k % 5 == 0 else 100, float(k), float(k), "NYSE" if k % 2 else "AMEX", k - 3.0) for k in range(40)]
    data = spark.createDataFrame(rows, "permno int, date string, siccd int, prc_adj double, mktcap_lag double, exchange string, be double")
    options = filter_options(exclude_financials=True, min_stock_price=10, min_size_quantile=0.3, exclude_negative_book_equity=True)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plain", "")
    filter_sorting_data(data, options).count()
    spark.sparkContext.setJobGroup("observed", "")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        out = filter_sorting_data(data, options, quiet=False)
    jobs = len(tracker.getJobIdsForGroup("observed"))
    spark.sparkContext._jsc.clearJobGroup()
    plain = filter_sorting_data(data, options)
    assert sorted(out.collect()) == sorted(plain.collect())
    cut = sorted(k for k in range(10, 40) if k % 5 and k % 2)
    low = cut[int(0.3 * (len(cut) - 1))] + (cut[int(0.3 * (len(cut) - 1)) + 1] - cut[int(0.3 * (len(cut) - 1))]) * (0.3 * (len(cut) - 1) % 1)
    losses = [8, 8, sum(k % 5 != 0 and 10 <= k < low for k in range(40))]
    texts = [str(w.message) for w in said if "Removed" in str(w.message)]
    assert texts == [f"Removed {n} observation(s) with {label}." for n, label in zip(losses, ("financial firms", "a low price", "a small size"))]
    assert jobs == len(tracker.getJobIdsForGroup("plain"))  # of one run: a job for each of its stages
