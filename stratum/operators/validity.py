"""Joins of dated rows with intervals of validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import inner_name
from ..shared import materialize

#: Intervals of an id beyond which its time is cut into bins; bins at most; bytes of intervals below which nobody counts.
CROWDED, BINS, SMALL_INPUT = 256, 128, 1 << 20


def _day(x: Column) -> Column:
    return F.unix_date(x.cast("date"))


def join_validity(rows: DataFrame, intervals: DataFrame, id: str, date: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """rows with the other columns of each interval of their id that holds their date, both ends included.

    intervals: columns id, low, high and others, none of which rows has; a NULL id, date or end matches nothing. how:
    'inner' or 'left'. An id with more than CROWDED intervals has its time cut into bins, at quantiles of the intervals' ends;
    a row then meets the intervals that reach into its bin instead of all of its id. An interval is copied to each of its bins,
    in all of which it is valid. Which ids are crowded is counted when this is called, on the intervals alone.
    """
    own, first, last, at, cuts = (inner_name(x) for x in ("id", "low", "high", "bin", "cuts"))
    others = [c for c in intervals.columns if c not in {id, low, high}]
    right = intervals.select(F.col(id).alias(own), F.col(low).alias(first), F.col(high).alias(last), *others)
    right = right.where(F.col(own).isNotNull() & (F.col(first) <= F.col(last)))
    left, on = rows, (F.col(id) == F.col(own)) & (F.col(date) >= F.col(first)) & (F.col(date) <= F.col(last))
    crowded = _crowded(right, own, first, last, cuts)
    if crowded is not None:
        at_right, key = inner_name("bin"), inner_name("key")
        named = crowded.withColumnRenamed(own, key)
        few = F.broadcast(named) if named.count() <= 1000 else named
        place = lambda x: F.coalesce(F.size(F.filter(cuts, lambda c: c < _day(x))), F.lit(0))
        place_ = lambda x: F.when(F.col(cuts).isNotNull() & x.isNotNull(), place(x)).otherwise(0)
        left = rows.join(few, F.col(id) == F.col(key), "left").withColumn(at, place_(F.col(date))).drop(key, cuts)
        right = right.join(few, F.col(own) == F.col(key), "left")
        right = right.withColumn(at_right, F.explode(F.sequence(place_(F.col(first)), place_(F.col(last))))).drop(key, cuts)
        on &= F.col(at) == F.col(at_right)
    return left.join(right, on, how).select(*(f"`{c}`" for c in rows.columns), *others)


def _crowded(intervals: DataFrame, id: str, low: str, high: str, cuts: str) -> DataFrame | None:
    if int(intervals._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_INPUT:
        return None
    many = intervals.groupBy(id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    many = materialize(many.select(id), "crowded-ids")
    if many.isEmpty():
        return None
    ends = intervals.join(many, id, "left_semi").select(id, F.explode(F.array(_day(F.col(low)), _day(F.col(high)))).alias("day"))
    quantiles = F.percentile_approx("day", F.array(*(F.lit(k / BINS) for k in range(1, BINS))), F.lit(1000))
    return materialize(ends.groupBy(id).agg(F.array_distinct(quantiles).alias(cuts)), "crowded")
