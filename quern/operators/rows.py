"""Row order without a single-task window, and folders for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in plain local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``materialise``, but in columns: for large tables of numbers, which take a fraction of the room."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pieces(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions of so many rows that hold df."""
    return df.count() // rows + 1


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with the dense 0-based position of each row in the total order ``order``.

    Rows are range-partitioned; each partition numbers its own rows and adds the
    sizes of those before it. No task sees more than its range. Rows that are
    equal in ``order`` are numbered in any order.
    """
    part, before = f"_{name}_part", f"_{name}_before"
    parted = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = parted.groupBy(part).agg(F.count("*").alias("n"))  # a row for each partition
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(before))
    out = parted.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return out.join(F.broadcast(sizes), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def every_nth(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of the order."""
    return numbered(df, order).where(F.pmod("row_no", F.lit(n)) == 0).drop("row_no")


def first_seen(df: DataFrame, value: str, idx: str) -> DataFrame:
    """Distinct values in the order of their first row, with their ordinal and colour slot of 20."""
    firsts = df.groupBy(value).agg(F.min(idx).alias("first_idx"))
    return numbered(firsts, [F.col("first_idx"), F.col(value)], "ordinal").withColumn("slot", F.pmod("ordinal", F.lit(20)))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, which ends with ``name``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}-{name}"
