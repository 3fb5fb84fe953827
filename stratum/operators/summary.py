"""Summary statistics of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import require_columns, table_function
from ..functions.quantile import refined_quantiles
from ..shared import materialize

PERCENTILES = {"5%": 0.05, "10%": 0.1, "25%": 0.25, "50%": 0.5, "75%": 0.75, "90%": 0.9, "95%": 0.95}
DETAIL = {"1%": 0.01} | PERCENTILES | {"99%": 0.99}


@table_function
def create_summary_statistics(
    data: DataFrame, variables: str | list[str], by: str | None = None, detail: bool = False, drop_na: bool = False,
    wide: bool = False,
) -> DataFrame:
    """A row for each variable (and group of by): count, mean, std, min, percentiles and max.

    Booleans count as 0 and 1. drop_na leaves out rows in which any of the variables is NULL. A NULL group is left out.
    detail adds percentiles to the median. wide: a row for each group, with columns <variable>_<statistic>.
    The columns are written once. One pass over them aggregates all variables, turned into rows, and brackets their
    percentiles; both run when this is called. Percentiles are exact: a second pass counts what lies between the brackets
    and the values inside them.
    """
    names = [variables] if isinstance(variables, str) else list(variables)
    require_columns(data, [*names, *([by] if by else [])])
    kinds = {f.name: f.dataType for f in data.schema.fields}
    bad = [n for n in names if not isinstance(kinds[n], (T.NumericType, T.BooleanType))]
    if bad:
        raise ValueError(f"The following columns are not numeric or boolean: {', '.join(bad)}.")
    points = DETAIL if detail else {"50%": 0.5}
    rows = data.select(*([by] if by else []), *(F.col(n).cast("double").alias(n) for n in names))
    if drop_na:
        rows = rows.dropna(subset=names)
    if by:
        rows = rows.where(F.col(by).isNotNull())
    keys = [by] if by else []
    rows = materialize(rows, "summary-rows")  # both passes read these columns
    tall = F.explode(F.array(*(F.struct(F.lit(n).alias("variable"), F.col(n).alias("x")) for n in names))).alias("r")
    tall = rows.select(*keys, tall).select(*keys, "r.variable", "r.x")
    plain = [F.count("x"), F.avg("x"), F.stddev_samp("x"), F.min("x"), F.max("x")]
    named = [c.alias(n) for c, n in zip(plain, ("count", "mean", "std", "min", "max"))]
    made = refined_quantiles(tall, [*keys, "variable"], "x", list(points.values()), "_points", named)
    labels = ["count", "mean", "std", "min", *points, "max"]
    fields = [F.col("_points")[list(points).index(n)] if n in points else F.col(n) for n in labels]
    if not wide:
        return made.select(*keys, "variable", *(c.alias(n) for c, n in zip(fields, labels)))
    of = lambda n, c: F.max(F.when(F.col("variable") == n, c))
    return made.groupBy(*keys).agg(*(of(n, c).alias(f"{n}_{label}") for n in names for c, label in zip(fields, labels)))
