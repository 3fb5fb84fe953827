"""Macro series: predictors of the equity premium, single series, and large macro panels with vintages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.transforms import transform_series
from .dates import between_dates

PREDICTORS = "rp_div dp dy ep de svar bm ntis tbl lty ltr tms dfy infl".split()


def _number(name: str):
    return F.regexp_replace(F.col(f"`{name}`").cast("string"), ",", "").try_cast("double")


def macro_predictors(raw: DataFrame, frequency: str = "monthly", start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Predictors from the raw table: yyyymm, yyyyq or yyyy, and index, dividends, earnings and yields as text.

    Rows with any missing value are left out. One series is at most some thousand rows, in one ordered window.
    """
    period = {"monthly": "yyyymm", "quarterly": "yyyyq", "annual": "yyyy"}.get(frequency)
    if period is None:
        raise ValueError("frequency must be 'monthly', 'quarterly' or 'annual'.")
    code = F.col(period).cast("string")
    year = code.substr(1, 4).cast("int")
    tail = F.substring(code, 5, 2).try_cast("int")
    month = {"monthly": tail, "quarterly": tail * 3 - 2, "annual": F.lit(1)}[frequency]
    columns = {c.lower(): c for c in raw.columns}
    x = lambda n: _number(columns[n.lower()])
    wanted = ["Index", "D12", "E12", "Rfree", "svar", "b/m", "ntis", "tbl", "lty", "ltr", "BAA", "AAA", "infl"]
    data = raw.select(F.make_date(year, month, F.lit(1)).alias("date"), *(x(n).alias(n.lower().replace("/", "")) for n in wanted))
    order = Window.orderBy("date")
    c = F.col
    data = data.withColumn("_paid", c("index") + c("d12"))
    data = data.withColumn("_growth", F.ln("_paid") - F.ln(F.lag("_paid").over(order)))
    made = data.select(
        "date", (F.lead("_growth").over(order) - c("rfree")).alias("rp_div"), (F.ln("d12") - F.ln("index")).alias("dp"), (F.ln("d12") - F.ln(F.lag("index").over(order))).alias("dy"), (F.ln("e12") - F.ln("index")).alias("ep"), (F.ln("d12") - F.ln("e12")).alias("de"),
        "svar", "bm", "ntis", "tbl", "lty", "ltr", (c("lty") - c("tbl")).alias("tms"), (c("baa") - c("aaa")).alias("dfy"), "infl",
    )
    return between_dates(made.dropna(), start_date, end_date)


def read_series(spark: SparkSession, paths: dict[str, str], start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Single series, a CSV file of date and value each: date, series, value."""
    parts = []
    for name, path in paths.items():
        raw = spark.read.csv(path, header=True)
        date, value = raw.columns[:2]
        parts.append(raw.select(F.to_date(date).alias("date"), F.lit(name).alias("series"), F.col(f"`{value}`").try_cast("double").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return between_dates(out, start_date, end_date)


def macro_panel(raw: DataFrame, transform: bool = True, vintage: str | None = None) -> DataFrame:
    """A macro panel as published: a row of transformation codes (`Transform:`), then a row for each M/D/YYYY date.

    The codes are read by one small action, as they decide the plan.
    """
    date = raw.columns[0]
    head = raw.where(F.lower(F.trim(F.col(f"`{date}`"))).startswith("transform")).first()
    if head is None:
        raise ValueError("The table has no row of transformation codes.")
    series = [c for c in raw.columns[1:]]
    rows = raw.withColumn("_date", F.try_to_timestamp(F.col(f"`{date}`"), F.lit("M/d/yyyy")).cast("date")).where("_date IS NOT NULL")
    data = rows.select(F.col("_date").alias("date"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in series))
    if transform:
        data = transform_series(data, {c: int(float(head[c])) for c in series if head[c] not in (None, "")})
    return data.withColumn("vintage", F.lit(vintage)).select("date", "vintage", *series) if vintage else data


def macro_vintages(spark: SparkSession, paths: dict[str, str], transform: bool = True, vintages: str | list[str] = "all") -> DataFrame:
    """Vintages (YYYY-MM to path) one above the other: date, vintage, and every series that any of them has."""
    chosen = sorted(paths) if vintages == "all" else [max(paths)] if vintages == "latest" else [vintages] if isinstance(vintages, str) else list(vintages)
    bad = [v for v in chosen if not re.fullmatch(r"\d{4}-\d{2}", v) or v not in paths]
    if bad:
        raise ValueError(f"Unknown vintages: {', '.join(bad)}.")
    out = None
    for v in chosen:
        part = macro_panel(spark.read.csv(paths[v], header=True), transform, v)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
