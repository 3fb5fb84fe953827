"""Annual and quarterly accounting panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import inner_name, require_columns, table_function

STANDARD = "indfmt = 'INDL' AND datafmt = 'STD' AND consol = 'C'"


def _standard(data: DataFrame) -> DataFrame:
    return data.where(STANDARD) if {"indfmt", "datafmt", "consol"} <= set(data.columns) else data


@table_function
def compustat_annual(data: DataFrame, only_usd: bool = False) -> DataFrame:
    """Each firm's last report of a year, with book equity `be`, operating profitability `op` and investment `inv`.

    Lagged assets are those of the year before, in any currency; only_usd is applied after them.
    """
    c = F.col
    equity = F.coalesce("seq", c("ceq") + c("pstk"), c("at") - c("lt"))
    taxes = F.coalesce("txditc", c("txdb") + c("itcb"), F.lit(0.0))
    preferred = F.coalesce("pstkrv", "pstkl", "pstk", F.lit(0.0))
    be = equity + taxes - preferred
    out = _standard(data).withColumn("be", F.when(be > 0, be))
    costs = sum((F.coalesce(x, F.lit(0.0)) for x in ("cogs", "xsga", "xint")), F.lit(0.0))
    out = out.withColumn("op", (c("sale") - costs) / c("be")).withColumn("_year", F.year("datadate"))
    latest = Window.partitionBy("gvkey", "_year").orderBy(F.col("datadate").desc(), F.struct(*sorted(set(data.columns) - {"datadate"})).desc())
    out = out.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")
    key, year = inner_name("gvkey"), inner_name("year")
    before = out.select(c("gvkey").alias(key), (c("_year") + 1).alias(year), c("at").alias("_at_lag"))
    out = out.join(before, (out["gvkey"] == before[key]) & (out["_year"] == before[year]), "left").drop(key, year)
    out = out.withColumn("inv", F.when(c("_at_lag") > 0, c("at") / c("_at_lag") - 1))
    if only_usd:
        out = out.where("curcd = 'USD'")
    return out.withColumn("date", F.trunc("datadate", "MM")).drop("_year", "_at_lag", "curcd")


@table_function
def compustat_quarterly(data: DataFrame, only_usd: bool = False, additional_columns: list[str] | None = None) -> DataFrame:
    """A row for each firm and month: the newest of a fiscal quarter's reports, then the first announced of a month's;
    reports announced before their month ends are left out."""
    out = _standard(data).dropna(subset=["gvkey", "datadate", "fyearq", "fqtr"]).withColumn("date", F.trunc("datadate", "MM"))
    rest = F.struct(*sorted(set(data.columns) - {"datadate", "rdq"}))
    newest = Window.partitionBy("gvkey", "fyearq", "fqtr").orderBy(F.col("datadate").desc(), F.col("rdq").asc_nulls_last(), rest)
    out = out.withColumn("_k", F.row_number().over(newest)).where("_k = 1")
    earliest = Window.partitionBy("gvkey", "date").orderBy(F.col("rdq").asc_nulls_last(), F.col("datadate").desc(), rest)
    out = out.withColumn("_k", F.row_number().over(earliest)).where("_k = 1").where("rdq IS NULL OR date < rdq")
    if only_usd:
        out = out.where("curcdq = 'USD'")
    columns = ["gvkey", "date", "datadate", "atq", "ceqq"]
    more = [x for x in additional_columns or [] if x not in columns]
    require_columns(data, more)
    return out.select(*columns, *more)
