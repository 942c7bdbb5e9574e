"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is only chosen in plain local mode (tests), where every
    task runs in the driver's process; elsewhere the setting is required.
    """
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
    """Write ``df`` to the shared checkpoint folder and read it from there, so
    that lost executors cost a re-read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few short columns that are broadcast at most, some MB.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table, marked for broadcast where it has at most ``most`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: log2 of the bits of a key filter: 8 MB, whatever the number of keys.
FILTER_BITS = 26


def keep_likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be among those of ``keys`` (one column): all that are, and a share of the others.

    The filter is a bitmap of fixed size, in rows of 4 KB, which is broadcast. It
    grows coarse with the number of keys and never wrong, so that what follows
    must tell the rest. For joins by shuffle of which most rows find no partner."""
    at, row, bits = fresh(df, "at"), fresh(df, "row"), fresh(df, "bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    marks = keys.select(place(keys.columns[0]).alias(at)).select(F.shiftright(at, 15).alias(row), F.col(at).bitwiseAND(F.lit(32767)).alias(at))
    marks = marks.groupBy(row).agg(F.expr(f"bitmap_construct_agg({at})").alias(bits))
    out = df.withColumn(at, place(key)).withColumn(row, F.shiftright(at, 15)).join(F.broadcast(marks), row)
    # bit i of a bitmap is bit i % 8 of its byte i / 8
    byte = f"cast(conv(hex(substring({bits}, cast(({at} & 32767) >> 3 as int) + 1, 1)), 16, 10) as int)"
    return out.where(F.expr(f"(shiftright({byte}, cast({at} & 7 as int)) & 1) = 1")).select(*df.columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = f"_q_{name}"
    while out.lower() in taken:
        out += "_"
    return out


def prefix(df: DataFrame) -> str:
    """The start of column names of which ``df`` has none."""
    out = "_q_"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "q_"
    return out


def word_tokens(text: Column) -> Column:
    """Count of white-space separated words; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


#: DuckDB spelling of :func:`word_tokens`.
WORD_TOKENS_SQL = r"CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS BIGINT)"


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name.replace(' ', '_')}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``stage_path`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
