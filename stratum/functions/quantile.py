"""Exact quantiles of groups, winsorizing and trimming.

A quantile is the linear interpolation of two order statistics, computed so that it agrees to the last bit with
NumPy's: buckets compare values with quantiles, and a value often equals one. Order statistics are read off a running
count over the distinct values of a group: distinct values are counted map-side, and the window sorts with spill, so
no group is ever held as one array. Where there are no groups, or few, rows are not shuffled at all: a first pass brackets
each quantile by a mergeable sketch, a second one counts the rows between the brackets and, inside them, each value
(`refined_quantiles`). Where the whole distribution of a large group is wanted it is cut into stretches of about equal
numbers of distinct values, which are counted side by side and start from the counts of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def lerp(low: Column, high: Column, t: Column) -> Column:
    return F.when(t < 0.5, low + (high - low) * t).otherwise(high - (high - low) * (1 - t))


#: Stretches of a group's values that are counted side by side, at most.
STRETCHES = 128


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(right[k])
    return on


def _spread(counts: DataFrame, groups: list[str]) -> DataFrame:
    """counts (groups, _x, _n) with _upto and _count, by stretches of each group."""
    parts = min(STRETCHES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    cuts = counts.groupBy(*groups).agg(F.percentile_approx("_x", probs, F.lit(1000)).alias("_cuts"))
    cuts = cuts if groups else F.broadcast(cuts)  # one row
    placed = counts.join(cuts, _same(counts, cuts, groups), "left").select(counts["*"], cuts["_cuts"])
    placed = placed.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    keys = [*groups, "_part"]
    totals = placed.groupBy(*keys).agg(F.sum("_n").alias("_in"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # at most a row for each stretch
    before = F.sum("_in").over(whole.orderBy("_part")) - F.col("_in")
    named = [F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)]
    totals = totals.select(*named, before.alias("_before"), F.sum("_in").over(whole).alias("_count"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= placed[k].eqNullSafe(totals[f"_of{i}"])
    placed = placed.join(totals, on).drop(*(f"_of{i}" for i in range(len(keys))))
    running = Window.partitionBy(*groups, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(*groups, "_x", (F.col("_before") + F.sum("_n").over(running)).alias("_upto"), "_count", "_n")


def distribution(
    data: DataFrame, groups: list[str], value: str, times: str | None = None, few: bool | None = None
) -> DataFrame:
    """groups, _x, _n (rows with _x), _upto (rows up to and with it) and _count (rows in all): one row for each distinct value.

    times: a column that says for how many rows each row stands, maybe none. few: groups are few and large, so each is
    cut into stretches (always so without groups).
    """
    rows = F.sum(times) if times else F.count(F.lit(1))
    counts = data.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_x")).agg(rows.alias("_n"))
    if few or not groups:
        return _spread(counts, groups)
    part = Window.partitionBy(*groups)
    running = part.orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*groups, "_x", F.sum("_n").over(running).alias("_upto"), F.sum("_n").over(part).alias("_count"), "_n")


def distribution_quantiles(values: DataFrame, groups: list[str], probs: list[float], name: str = "quantiles", ends: bool = False) -> DataFrame:
    """groups and an array with the quantiles of a distribution; ends: also its least and greatest value, of any count."""
    n, upto, here = F.col("_count"), F.col("_upto"), F.col("_n")
    picks = []
    for k, p in enumerate(probs):
        low = F.floor(F.lit(float(p)) * (n - 1))
        high = F.least(low + 1, n - 1)
        for side, at in (("a", low), ("b", high)):
            picks.append(F.max(F.when((at < upto) & (at >= upto - here), F.col("_x"))).alias(f"_{side}{k}"))
    edges = [F.min("_x").alias("_least"), F.max("_x").alias("_most")] if ends else []
    picked = values.groupBy(*groups).agg(F.max("_count").alias("_count"), *picks, *edges)

    def one(k: int, p: float) -> Column:
        h = F.lit(float(p)) * (F.col("_count") - 1)
        return lerp(F.col(f"_a{k}"), F.col(f"_b{k}"), h - F.floor(h))

    made = F.array(*(one(k, p) for k, p in enumerate(probs)))
    return picked.select(*groups, F.when(F.col("_count") > 0, made).alias(name), *(["_least", "_most"] if ends else []))


#: A sketch's rank error is a row in ACCURACY; brackets are three times as wide to each side. Groups smaller than
#: SMALL_GROUP are not bracketed. At most BROADCAST_GROUPS rows of brackets are broadcast.
ACCURACY, SMALL_GROUP, BROADCAST_GROUPS = 4000, 100_000, 10_000


def refined_quantiles(data: DataFrame, groups: list[str], value: str, probs: list[float], name: str = "quantiles", more: list[Column] | None = None) -> DataFrame:
    """groups, an array with the exact quantiles of value and, from the first pass, the aggregates `more`.

    For few and large groups: what is shuffled are sketches and, in brackets of some thousandths of a group's rows,
    different values with their counts; rows outside the brackets are counts. A group without values has NULL.
    """
    probs = [float(p) for p in probs]
    margin = 3 / ACCURACY
    edges = sorted({e for p in probs for e in (p - margin, p + margin) if 0 < e < 1})
    x = F.col(value).cast("double")
    cuts = F.percentile_approx(x, F.array(*map(F.lit, edges)), F.lit(ACCURACY)) if edges else F.lit(None).cast("array<double>")
    first = data.groupBy(*groups).agg(F.count(x).alias("_count"), cuts.alias("_cuts"), *(more or []))
    first = materialize(first, "brackets") if groups else first
    side = lambda e, far: F.when(F.col("_count") >= SMALL_GROUP, F.col("_cuts")[edges.index(e)]).otherwise(far) if e in edges else F.lit(far)
    low = [side(p - margin, float("-inf")).alias(f"_low{k}") for k, p in enumerate(probs)]
    high = [side(p + margin, float("inf")).alias(f"_high{k}") for k, p in enumerate(probs)]
    brackets = first.where("_count > 0").select(*(F.col(g).alias(f"_of{k}") for k, g in enumerate(groups)), *low, *high)
    few, on = True, F.lit(True)
    for k, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"_of{k}"))
    if groups:
        n, most = first.agg(F.count(F.lit(1)), F.max("_count")).first()
        few = n <= BROADCAST_GROUPS
        if (most or 0) < SMALL_GROUP:  # nothing to bracket
            return _with_first(first, distribution_quantiles(distribution(data, groups, value), groups, probs, name), groups, name, on, few)
    brackets = F.broadcast(brackets) if few else brackets
    rows = data.where(x.isNotNull()).select(*groups, x.alias("_x")).join(brackets, on)
    # The number of bracket ends below a value grows with the value, so it orders what is counted together.
    place, inside = F.lit(0), F.lit(False)
    for k in range(len(probs)):
        above, beyond = F.col("_x") >= F.col(f"_low{k}"), F.col("_x") > F.col(f"_high{k}")
        place, inside = place + above.cast("int") + beyond.cast("int"), inside | (above & ~beyond)
    counted = rows.groupBy(*groups, place.alias("_place"), F.when(inside, F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    # Brackets are numbered side by side, each from the count of what lies below it.
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # a row for each bracket
    sums = counted.groupBy(*groups, "_place").agg(F.sum("_n").alias("_in"))
    before = (F.sum("_in").over(part.orderBy("_place")) - F.col("_in")).alias("_before")
    sums = sums.select(*(F.col(g).alias(f"_of{k}") for k, g in enumerate(groups)), F.col("_place").alias("_at"), before, F.sum("_in").over(part).alias("_count"))
    counted = counted.join(F.broadcast(sums) if few else sums, on & (F.col("_place") == F.col("_at")))
    running = Window.partitionBy(*groups, "_place").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = counted.select(*groups, "_x", "_n", (F.col("_before") + F.sum("_n").over(running)).alias("_upto"), "_count")
    found = distribution_quantiles(values, groups, probs, name)
    if not groups:
        return found if not more else first.drop("_cuts", "_count").join(F.broadcast(found), F.lit(True), "left")
    return _with_first(first, found, groups, name, on, few)


def _with_first(first: DataFrame, found: DataFrame, groups: list[str], name: str, on: Column, few: bool) -> DataFrame:
    """The quantiles found, and what the first pass has of each group."""
    named = found.select(*(F.col(g).alias(f"_of{k}") for k, g in enumerate(groups)), F.col(name))
    out = first.join(F.broadcast(named) if few else named, on, "left")
    return out.select(*groups, F.col(name), *(c for c in first.columns if c not in {*groups, "_count", "_cuts"}))


def quantiles(data: DataFrame, groups: list[str], value: str, probs: list[float], name: str = "quantiles") -> DataFrame:
    """groups and an array with the quantiles of value among its non-NULL rows; a group without any has no row."""
    if not groups:
        return refined_quantiles(data, [], value, probs, name)
    return distribution_quantiles(distribution(data, groups, value), groups, probs, name)


def linspace(n: int) -> list[float]:
    """n equally spaced numbers from 0 to 1, as doubles are spaced by k * step."""
    if n == 1:
        return [0.0]
    step = 1.0 / (n - 1)
    return [k * step for k in range(n - 1)] + [1.0]


def _bounds(data: DataFrame, column: str, cut: float, by: list[str]) -> DataFrame:
    if isinstance(cut, bool) or not isinstance(cut, (int, float)) or not 0 <= cut <= 0.5:
        raise ValueError("'cut' must be inside [0, 0.5].")
    bounds = quantiles(data, by, column, [cut, 1 - cut], "_bounds")
    if by:
        return data.join(bounds, _same(data, bounds, by), "left").select(data["*"], bounds["_bounds"])
    return data.join(F.broadcast(bounds), F.lit(True), "left")  # one row


def winsorize(data: DataFrame, column: str, cut: float, by: list[str] | None = None, new_column: str | None = None) -> DataFrame:
    """data with column clipped to its quantiles at cut and 1 - cut (within groups of by); NULL stays NULL."""
    x = F.col(column).cast("double")
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.col("_bounds")[0]), F.col("_bounds")[1]))
    return _bounds(data, column, cut, by or []).withColumn(new_column or column, clipped).drop("_bounds")


def trim(data: DataFrame, column: str, cut: float, by: list[str] | None = None) -> DataFrame:
    """data without rows whose column is NULL or outside its quantiles at cut and 1 - cut."""
    return _bounds(data, column, cut, by or []).where(F.col(column).between(F.col("_bounds")[0], F.col("_bounds")[1])).drop("_bounds")
