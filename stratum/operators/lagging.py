"""Lagged values: by exact offset, within a window of dates, and from another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import inner_name, require_columns, require_new_columns, table_function
from ..functions.calendar import Offset, to_offset
from ..options import roles
from ..shared import materialize


def _columns(x: str | list[str] | None) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def _offsets(low: object, high: object, names: tuple[str, str]) -> tuple[Offset, Offset]:
    least, most = to_offset(low), to_offset(low if high is None else high)
    if min(least.months, least.days, most.months, most.days) < 0:
        raise ValueError(f"'{names[0]}' and '{names[1]}' must not be negative.")
    if (least.months * 30.4 + least.days) > (most.months * 30.4 + most.days) and not least.equals(most):
        raise ValueError(f"'{names[1]}' must not be smaller than '{names[0]}'.")
    return least, most


def _last_of_year(source: DataFrame, by: list[str], date: str) -> DataFrame:
    """Rows on the last date of their group and year."""
    last = inner_name("last")
    part = Window.partitionBy(*by, F.year(date))
    return source.withColumn(last, F.max(date).over(part)).where(F.col(date) == F.col(last)).drop(last)


#: Rows of a group beyond which its dates are cut into stretches; bytes of input below which no group is looked at.
LONG_GROUP, SMALL_INPUT = 1_000_000, 1 << 28


def _long_groups(both: DataFrame, keys: list[str], at: str, cuts: str) -> DataFrame | None:
    """The groups with more than LONG_GROUP rows (without keys: the whole table) and the approximate cuts of their dates, as
    many as there are shuffle partitions (128 at most); None where there are none. Written when this is called."""
    if keys and int(both._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_INPUT:
        return None
    n = max(2, min(128, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    days = F.percentile_approx(F.unix_date(F.col(at).cast("date")), F.array(*(F.lit(k / n) for k in range(1, n))), F.lit(1000))
    if not keys:
        return materialize(both.agg(F.array_distinct(F.coalesce(days, F.array().cast("array<int>"))).alias(cuts)), "cuts")
    counts = materialize(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG_GROUP), "long-groups")
    if counts.isEmpty():
        return None
    named = [F.col(k).alias(f"_{k}") for k in keys]
    long = both.join(counts.select(*named), _same(keys), "left_semi")
    return materialize(long.groupBy(*keys).agg(F.array_distinct(F.coalesce(days, F.array().cast("array<int>"))).alias(cuts)), "cuts")


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return on


def asof_backward(target: DataFrame, source: DataFrame, by: list[str], target_at: Column, source_at: Column, found: str) -> DataFrame:
    """target with a struct `found`: source's latest row (all its columns, and `at`) of the same group at or before target_at.

    One shuffle of both tables together and one sort: a source row stands before the target rows of its date, and a
    running last value carries it forward. Of source rows at the same date the last in the order of all their columns
    counts. NULL groups match each other; a NULL date finds nothing. The dates of a table without groups, and of a group
    with more than LONG_GROUP rows, are cut into stretches that are sorted side by side; what the stretches before carry
    over is a row for each.
    """
    keys = [inner_name(f"k{i}") for i in range(len(by))]
    rows, row, tag, at = (inner_name(x) for x in ("target", "source", "tag", "at"))
    left = target.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), target_at.alias(at), F.lit(1).alias(tag), F.struct(*(f"`{c}`" for c in target.columns)).alias(rows))
    right = source.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), source_at.alias(at), F.lit(0).alias(tag), F.struct(source_at.alias("at"), *(F.col(f"`{c}`") for c in source.columns if c != "at")).alias(row))
    both = left.unionByName(right.where(F.col(at).isNotNull()), allowMissingColumns=True)
    stretch, cuts = inner_name("stretch"), inner_name("cuts")
    long = _long_groups(both, keys, at, cuts)
    parts = keys
    if long is not None:
        parts = [*keys, stretch]
        few = F.broadcast(long) if not keys or long.count() <= 1000 else long
        both = both.join(few.select(*(F.col(k).alias(f"_{k}") for k in keys), cuts), _same(keys), "left").drop(*(f"_{k}" for k in keys))
        day = F.unix_date(F.col(at).cast("date"))
        both = both.withColumn(stretch, F.when(F.col(cuts).isNotNull() & day.isNotNull(), F.size(F.filter(cuts, lambda c: c < day))).otherwise(0))
    order = Window.partitionBy(*parts).orderBy(F.col(at).asc_nulls_first(), tag, row)
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn(row, F.last(row, ignorenulls=True).over(order)).where(F.col(tag) == 1)
    if long is not None:
        ahead = inner_name("ahead")
        latest = both.where((F.col(tag) == 0) & F.col(cuts).isNotNull()).groupBy(*parts).agg(F.max(F.struct(at, row)).alias(ahead))
        every = long.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode(F.sequence(F.lit(0), F.size(cuts))).alias(f"_{stretch}"))
        of = every.join(latest, _same(parts), "left").select(*(f"_{p}" for p in parts), ahead)
        whole = Window.partitionBy(*(f"_{k}" for k in keys)) if keys else Window.partitionBy(F.lit(0))  # a row for each stretch
        earlier = whole.orderBy(f"_{stretch}").rowsBetween(Window.unboundedPreceding, -1)
        of = of.select(*(f"_{p}" for p in parts), F.last(F.col(ahead)[row], ignorenulls=True).over(earlier).alias(ahead))
        carried = carried.join(of, _same(parts), "left").withColumn(row, F.coalesce(row, ahead))
    return carried.select(*(F.col(rows)[c].alias(c) for c in target.columns), F.when(F.col(at).isNotNull(), F.col(row)).alias(found))


@table_function
def add_lagged_columns(data: DataFrame, cols: str | list[str], lag: object, max_lag: object = None, by: str | list[str] | None = None, drop_na: bool = False, ff_adjustment: bool = False, date_col: str = "date", data_options: dict | None = None, check_keys: bool = False) -> DataFrame:
    """data with a column `<col>_lag` for each of cols.

    Without max_lag (or with one that is the same span) the value of exactly `lag` before, else the latest value from
    max_lag to lag before; a source row too old gives NULL, with no older one in its place. drop_na: NULLs are no source.
    ff_adjustment: only the last date of each group's year is a source. Keys of groups and dates must be unique;
    check_keys=True verifies that, which runs the plan. Where shorter months make two source dates one, the later counts.
    """
    cols, by = _columns(cols), _columns(by)
    if data_options and date_col == "date":
        date_col = roles(data_options)["date"]
    require_columns(data, [*cols, *by, date_col])
    require_new_columns(data, [f"{c}_lag" for c in cols])
    least, most = _offsets(lag, max_lag, ("lag", "max_lag"))
    if check_keys and not data.groupBy(*by, date_col).count().where("count > 1").isEmpty():
        raise ValueError("The combinations of 'by' and the date must be unique.")
    out = data
    for names in [[c] for c in cols] if drop_na else [cols]:
        source = data.select(*by, date_col, *(F.col(c).alias(f"{c}_lag") for c in names))
        if drop_na:
            source = source.dropna(subset=[f"{c}_lag" for c in names])
        if ff_adjustment:
            source = _last_of_year(source, by, date_col)
        if least.equals(most):
            out = _exact(out, source, [f"{c}_lag" for c in names], by, date_col, least)
        else:
            found = inner_name("found")
            out = asof_backward(out, source, by, least.before(F.col(date_col)), F.col(date_col), found)
            fresh = F.col(found)["at"] >= most.before(F.col(date_col))
            out = out.select("*", *(F.when(fresh, F.col(found)[f"{c}_lag"]).alias(f"{c}_lag") for c in names)).drop(found)
    return out


def _exact(data: DataFrame, source: DataFrame, new: list[str], by: list[str], date: str, lag: Offset) -> DataFrame:
    keys = {b: inner_name(b) for b in by}
    to = inner_name("to")
    moved = source.select(*(F.col(b).alias(k) for b, k in keys.items()), lag.after(F.col(date)).alias(to), F.struct(F.col(date).alias("at"), *new).alias("_row"))
    moved = moved.groupBy(*keys.values(), to).agg(F.max_by("_row", "_row.at").alias("_row"))
    on = data[date] == moved[to]
    for b, k in keys.items():
        on &= data[b].eqNullSafe(moved[k])
    return data.join(moved, on, "left").select(*(data[f"`{c}`"] for c in data.columns), *(F.col("_row")[c].alias(c) for c in new))


@table_function
def join_lagged_values(original_data: DataFrame, new_data: DataFrame, id_keys: str | list[str], min_lag: object, max_lag: object, ff_adjustment: bool = False, date_col: str = "date", data_options: dict | None = None) -> DataFrame:
    """original_data with new_data's other columns, each row's from the latest observation whose window holds its date.

    An observation of date d is known from d + min_lag to d + max_lag. One pass carries all columns together.
    """
    keys = _columns(id_keys)
    if data_options and date_col == "date":
        date_col = roles(data_options)["date"]
    require_columns(original_data, [*keys, date_col])
    require_columns(new_data, [*keys, date_col])
    values = [c for c in new_data.columns if c not in {*keys, date_col}]
    clash = [c for c in values if c in original_data.columns]
    if clash:
        raise ValueError(f"Both tables have the column(s) {', '.join(clash)}.")
    least, most = _offsets(min_lag, max_lag, ("min_lag", "max_lag"))
    source = _last_of_year(new_data, keys, date_col) if ff_adjustment else new_data
    upper, found = inner_name("upper"), inner_name("found")
    source = source.withColumn(upper, most.after(F.col(date_col)))
    out = asof_backward(original_data, source, keys, F.col(date_col), least.after(F.col(date_col)), found)
    fresh = F.col(date_col) <= F.col(found)[upper]
    return out.select("*", *(F.when(fresh, F.col(found)[c]).alias(c) for c in values)).drop(found)
