"""Least squares by group, over rolling windows, and averaged over time.

Groups and dates are reduced to mergeable orthogonal factors (functions/least_squares.py), so that neither large means
nor nearly collinear regressors cost digits.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import inner_name, require_columns, table_function
from ..functions.formula import Formula, parse_formula
from ..functions.least_squares import group_fits
from ..functions.newey_west import newey_west_se
from ..functions.rolling_fit import stream_fits
from ..shared import materialize, number_rows

#: Rows of an id beyond which its series is cut into stretches for several tasks.
LONG_SERIES = 250_000


@table_function
def estimate_model(data: DataFrame, model: str, min_obs: int = 1, output: str | list[str] = "coefficients", by: list[str] | None = None) -> DataFrame | dict[str, DataFrame]:
    """Least squares over complete rows, of the whole table or of each group.

    output: 'coefficients', 'tstats' (a row each, with a column for each term, the constant as 'intercept'), or
    'residuals' (data with a column `residual`); a list gives a dict. With fewer complete rows than min_obs, or no more
    than there are regressors, all are NULL.
    """
    wanted = [output] if isinstance(output, str) else list(output)
    if not wanted or not set(wanted) <= {"coefficients", "tstats", "residuals"}:
        raise ValueError("output must be among 'coefficients', 'tstats' and 'residuals'.")
    if "~" not in str(model):
        raise ValueError("The model must be a formula like 'y ~ x1 + x2'.")
    formula, groups = parse_formula(model), list(by or [])
    if "intercept" in data.columns:
        raise ValueError("A column must not be named 'intercept'.")
    require_columns(data, [t for t in (formula.dependent, *formula.regressors) if re.fullmatch(r"\w+", t)])
    y, xs = formula.design(data)
    enough = (F.col("_n") >= min_obs) & (F.col("_n") > len(formula.regressors))
    fit = group_fits(data, groups, y, xs[formula.intercept :], formula.intercept)
    fit = fit.withColumn("_ok", enough if xs else F.lit(False))
    terms = ["intercept" if t == "Intercept" else t for t in formula.names]
    coef, se = F.col("_fit.coef"), F.col("_fit.se")
    ratio = lambda i: F.when(F.col("_ok") & (se[i] > 0), coef[i] / se[i])
    out: dict[str, DataFrame] = {}
    if "coefficients" in wanted:
        out["coefficients"] = fit.select(*groups, *(F.when(F.col("_ok"), coef[i]).alias(t) for i, t in enumerate(terms)))
    if "tstats" in wanted:
        out["tstats"] = fit.select(*groups, *(ratio(i).alias(t) for i, t in enumerate(terms)))
    if "residuals" in wanted:
        b = inner_name("coef")
        small = fit.select(*groups, F.when(F.col("_ok"), coef).alias(b))
        joined = data.join(small, groups, "left") if groups else data.join(F.broadcast(small), F.lit(True), "left")  # one row
        fitted = F.lit(0.0)
        for i, x in enumerate(xs):
            fitted = fitted + F.col(b)[i] * x
        out["residuals"] = joined.select(*(f"`{c}`" for c in data.columns), (y - fitted).alias("residual"))
    return out[wanted[0]] if isinstance(output, str) else out


@table_function
def estimate_betas(data: DataFrame, model: str, lookback: int, min_obs: int | None = None, id_col: str = "permno", date_col: str = "date") -> DataFrame:
    """Rolling coefficients: of each row, over the last `lookback` complete rows of its id, by date.

    Fewer than min_obs complete rows (default: 80 % of lookback), a singular window, or an incomplete row give NULL.
    The cost does not grow with lookback (functions/rolling_fit.py). Rows are shuffled by id; an id with more than
    LONG_SERIES rows is cut into stretches, which also get the lookback - 1 complete rows before them. Which ids are
    long is counted when this is called, on the rows' written columns.
    """
    formula = parse_formula(model)
    if not isinstance(lookback, int) or lookback < 1:
        raise ValueError("lookback must be a positive integer.")
    least = int(0.8 * lookback) if min_obs is None else min_obs
    if least <= 0:
        raise ValueError("min_obs must be a positive integer.")
    require_columns(data, [id_col, date_col])
    y, xs = formula.design(data)
    values = [c.cast("double").alias(f"_v{i}") for i, c in enumerate([*xs[formula.intercept :], y])]
    rows = data.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{date_col}`").alias("_date"), F.lit(False).alias("_halo"), *values)
    rows = materialize(rows, "series")
    schema = T.StructType([rows.schema["_id"], rows.schema["_date"], T.StructField("_coef", T.ArrayType(T.DoubleType()))])
    fit = lambda keys: stream_fits(keys, lookback, least, formula.intercept)
    counts = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG_SERIES)
    long = materialize(counts.select(F.col("_id").alias("_long")), "long-series")
    if long.isEmpty():
        out = rows.repartition("_id").sortWithinPartitions("_id", "_date").mapInArrow(fit(0), schema)
    else:
        here = F.col("_id").eqNullSafe(F.col("_long"))
        out = rows.join(long, here, "left_anti").repartition("_id").sortWithinPartitions("_id", "_date").mapInArrow(fit(0), schema)
        hot = rows.join(long, here, "left_semi")
        full = F.lit(True)
        for v in rows.columns[3:]:
            full &= F.col(v).isNotNull()
        out = out.unionByName(hot.where(~full).select("_id", "_date", F.lit(None).cast("array<double>").alias("_coef")))
        numbered = number_rows(hot.where(full), ["_id", "_date"], "_number")
        size = max(LONG_SERIES, lookback)
        stretch = F.floor(F.col("_number") / size).cast("long")
        late = F.col("_number") % size > size - lookback
        copies = F.when(late, F.array(F.struct(stretch.alias("k"), F.lit(False).alias("halo")), F.struct((stretch + 1).alias("k"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(stretch.alias("k"), F.lit(False).alias("halo"))))
        dealt = numbered.withColumn("_copy", F.explode(copies)).select(F.col("_copy.k").alias("_stretch"), "_id", "_date", F.col("_copy.halo").alias("_halo"), *rows.columns[3:], "_number")
        dealt = dealt.repartition("_stretch").sortWithinPartitions("_stretch", "_number").drop("_number")
        out = out.unionByName(dealt.mapInArrow(fit(1), schema))
    coef = [F.col("_coef")[i].alias(t) for i, t in enumerate(formula.names)]
    return out.select(*coef, F.col("_id").alias(id_col), F.col("_date").alias(date_col))


@table_function
def estimate_fama_macbeth(data: DataFrame, model: str, vcov: str = "newey-west", vcov_options: dict | None = None, date_col: str = "date", detail: bool = False) -> DataFrame | dict[str, DataFrame]:
    """A regression for each date, and the time-series averages of its coefficients.

    factor, risk_premium, standard_error, t_statistic, n. Dates with no more rows than the formula has terms are left
    out. vcov: 'newey-west' (options lag, prewhite, adjust) or 'iid'. detail: a dict with also `summary_statistics`.
    """
    if vcov not in ("iid", "newey-west"):
        raise ValueError("vcov must be 'iid' or 'newey-west'.")
    formula: Formula = parse_formula(model)
    options = dict(vcov_options or {})
    if "maxlags" in options:
        options = {"lag": options["maxlags"], "prewhite": 0} | {k: v for k, v in options.items() if k != "maxlags"}
    if not options.keys() <= {"lag", "prewhite", "adjust"}:
        raise ValueError("vcov_options may have 'lag', 'prewhite' and 'adjust'.")
    require_columns(data, [date_col])
    y, xs = formula.design(data)
    pieces = len(model.split("~")[1].split("+"))
    # NULL rows count for whether a date is used, but not in its regression.
    fits = group_fits(data.where(F.col(date_col).isNotNull()), [date_col], y, xs[formula.intercept :], formula.intercept)
    fits = fits.where((F.col("_rows") > pieces) & (F.col("_n") > 0)).withColumn("_obs", F.col("_n").cast("double"))
    terms = F.array(*map(F.lit, formula.names))
    long = fits.select(date_col, F.explode(F.arrays_zip(terms.alias("factor"), F.col("_fit.coef").alias("value"))).alias("_z")).select(date_col, F.col("_z.factor").alias("factor"), F.col("_z.value").alias("value"))
    series = long.where("value IS NOT NULL").groupBy("factor").agg(F.avg("value").alias("risk_premium"), F.transform(F.array_sort(F.collect_list(F.struct(date_col, "value"))), lambda p: p["value"]).alias("_series"), F.count("value").cast("double").alias("n"), F.stddev_samp("value").alias("_sd"))

    @F.pandas_udf("double")
    def robust(series: pd.Series) -> pd.Series:
        return series.map(lambda x: newey_west_se(x, options.get("lag"), options.get("prewhite", 1), options.get("adjust", False)))

    se = F.nanvl(robust("_series"), F.lit(None)) if vcov == "newey-west" else F.col("_sd") / F.sqrt("n")
    found = series.withColumn("standard_error", F.when(F.col("n") >= 2, se))
    ratio = F.when(F.col("standard_error") != 0, F.col("risk_premium") / F.col("standard_error"))
    out = found.select("factor", "risk_premium", "standard_error", ratio.alias("t_statistic"), "n")
    if not detail:
        return out
    summary = fits.agg(F.avg("_fit.r2").alias("r_squared"), F.avg("_fit.adj_r2").alias("adj_r_squared"), F.avg("_obs").alias("n_obs"))
    return {"coefficients": out, "summary_statistics": summary}
