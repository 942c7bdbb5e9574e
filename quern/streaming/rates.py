"""The trailing rate as a stream: an extension, as batch progress logs also arrive live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_rate(events: DataFrame, keys: list[str], ts: str, value: str, length: str = "30 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """keys, start, end, n, rate of sliding windows; events later than the watermark are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, length, step).alias("w"), *keys)
    first, last = F.min(F.struct(ts, value)), F.max(F.struct(ts, value))
    out = w.agg(F.count("*").alias("n"), first.alias("a"), last.alias("b"))
    took = (F.unix_micros(F.col("b")[ts]) - F.unix_micros(F.col("a")[ts])) / F.lit(1e6)
    rate = F.when(took > 0, (F.col("b")[value] - F.col("a")[value]) / took)
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", rate.alias("rate"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All data there is, then stop; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
