import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum import quantiles, trim, winsorize
from stratum.functions.quantile import distribution, distribution_quantiles, linspace


def test_quantiles_equal_numpy_to_the_last_bit(spark):
    r = np.random.default_rng(0)
    rows, want = [], {}
    probs = sorted({*linspace(6), *linspace(11), 0.3, 0.7, 0.05, 0.95})
    for g in range(40):
        x = np.round(r.normal(size=r.integers(1, 90)), 2) if g % 2 else r.normal(size=r.integers(1, 90))
        rows += [(g, float(v)) for v in x] + [(g, None)]
        want[g] = np.quantile(x, probs)
    got = quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", probs).collect()
    assert len(got) == 40
    for row in got:
        assert row.quantiles == want[row.g].tolist()


def test_linspace_is_numpys():
    for n in range(2, 30):
        assert linspace(n) == np.linspace(0, 1, n).tolist()


def test_winsorize_and_trim(spark):
    data = spark.createDataFrame([(float(x),) for x in range(11)] + [(None,)], "x double")
    assert sorted(r.x for r in winsorize(data, "x", 0.1).collect() if r.x is not None) == [1, *range(1, 10), 9]
    assert winsorize(data, "x", 0.1).where("x IS NULL").count() == 1
    assert sorted(r.x for r in trim(data, "x", 0.1).collect()) == list(range(1, 10))
    assert winsorize(data.withColumn("g", F.lit(1)), "x", 0.5, by=["g"], new_column="y").select("y").distinct().count() == 2
    for bad in (-0.1, 0.6, True, "a"):
        with pytest.raises(ValueError, match="cut"):
            winsorize(data, "x", bad)


def test_whole_tables_are_counted_in_stretches(spark):
    """No groups, or few: exact, and no task sorts all values."""
    r = np.random.default_rng(9)
    values = np.round(r.lognormal(0, 2, 5000), 2)
    rows = spark.createDataFrame([(int(k % 3 == 0), float(v)) for k, v in enumerate(values)] + [(1, None)], "g int, x double").repartition(5)
    probs = [0.0, 0.01, 0.3, 0.5, 0.777, 1.0]
    got = quantiles(rows, [], "x", probs).first()[0]
    assert got == [float(np.quantile(values, p)) for p in probs]
    spread = distribution_quantiles(distribution(rows, ["g"], "x", few=True), ["g"], probs)
    for row in spread.collect():
        own = values[np.arange(len(values)) % 3 == 0] if row.g else values[np.arange(len(values)) % 3 != 0]
        assert row.quantiles == [float(np.quantile(own, p)) for p in probs]
    plan = distribution(rows, [], "x")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    over_values = [x for x in plan if re.search(r"Window \[.*_x#\d+ ASC", x)]
    assert over_values and all("_part" in x for x in over_values)
    assert quantiles(rows.where("x < 0"), [], "x", probs).collect() in ([], [(None,)])
    one = spark.createDataFrame([(2.5,)] * 4, "x double")
    assert quantiles(one, [], "x", [0.2]).first()[0] == [2.5]
