"""Tables of a database over JDBC, read by several tasks side by side.

A table is cut into ranges of a number or date column, and each range is one query of one task. Filters that Spark can
express in SQL, and the list of columns, go to the database with it; lists of ids become ranges, in place of
statements for a few hundred ids at a time. Ids inside the ranges that were not asked for are left out by a join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import require_columns

#: Rows that one task should read, and ids that one range may span with gaps.
ROWS_OF_TASK, LONGEST_GAP = 1_000_000, 1000


def read_table(
    spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, split_by: str | None = None,
    partitions: int | None = None, properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table's columns and rows. where: an SQL condition for the database.

    split_by: the column whose range is cut into `partitions` (default: as many as give a task ROWS_OF_TASK rows). The
    database is asked once for its least and greatest value and the number of rows. NULLs are read with the first range.
    """
    options = {"url": url, **(properties or {})}
    source = f"(SELECT * FROM {table} WHERE {where}) t" if where else table
    read = lambda **more: spark.read.format("jdbc").options(**options | more)
    if split_by is None:
        return _columns(read(dbtable=source).load(), columns)
    asked = f"SELECT MIN({split_by}) AS LEAST_VALUE, MAX({split_by}) AS MOST_VALUE, COUNT(*) AS N FROM {table}" + (f" WHERE {where}" if where else "")
    least, most, n = read(query=asked).load().first()
    if least is None:
        return _columns(read(dbtable=source).load(), columns)
    parts = partitions or max(1, math.ceil(n / ROWS_OF_TASK))
    bounds = {"partitionColumn": split_by, "lowerBound": str(least), "upperBound": str(most), "numPartitions": str(parts)}
    return _columns(read(dbtable=source, **bounds).load(), columns)


def _columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Names in lower case; the columns asked for."""
    df = df.toDF(*(c.lower() for c in df.columns))
    if columns is None:
        return df
    require_columns(df, columns)
    return df.select(*columns)


def id_ranges(ids: list[int], gap: int = LONGEST_GAP) -> list[tuple[int, int]]:
    """Ranges that hold all ids, cut where more than gap numbers are missing."""
    out: list[list[int]] = []
    for i in sorted(set(ids)):
        if out and i - out[-1][1] <= gap:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tuple(x) for x in out]


def read_ids(
    spark: SparkSession, url: str, table: str, id_column: str, ids: list[int], columns: list[str] | None = None, where: str | None = None,
    gap: int = LONGEST_GAP, properties: dict[str, str] | None = None,
) -> DataFrame:
    """The rows of some ids: one task, and one query, for each range of neighbouring ids."""
    ranges = id_ranges(ids, gap)
    source = spark.read.jdbc(url, table, predicates=[f"{id_column} BETWEEN {a} AND {b}" + (f" AND ({where})" if where else "") for a, b in ranges] or ["1 = 0"], properties=properties or {})
    found = _columns(source, None)
    wanted = spark.createDataFrame([(i,) for i in sorted(set(ids))], "wanted long")
    out = found.join(F.broadcast(wanted), found[id_column.lower()] == wanted["wanted"], "left_semi")  # the caller's list
    return out if columns is None else _columns(out, columns)
