"""The folder that driver and executors share, and tables written to it between steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset and Spark runs in local mode, a folder of this machine serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"{tempfile.gettempdir()}/checkpoints/stratum-{os.getuid()}"
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet to a path and read again: cuts the lineage, outlives lost executors."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to a new path in the shared folder and read again."""
    return written(df, shared_path(df.sparkSession, name))


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes what `written` put at a path of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """df with global numbers 0..n-1 in ascending order of some columns, without gathering rows in one task.

    A range partitioning and a sort inside partitions; what goes to every task is one count for each partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "row-numbers")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
