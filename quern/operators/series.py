"""Ordered data: trailing rates, record assembly, cumulative distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of each phase in the whole of a job.
PHASES = {"align": 0.2, "stack": 0.4, "merge": 0.4}


def trailing_rate(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int = 30) -> DataFrame:
    """rate: (last - first) / (time between) over the rows of the last seconds, null under two samples or without time between."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    sample = F.struct(micros.alias("at"), F.col(value).alias("v"))
    first, last = F.min(sample).over(w), F.max(sample).over(w)
    took = (last["at"] - first["at"]) / F.lit(1e6)
    return df.withColumn("rate", F.when(took > 0, (last["v"] - first["v"]) / took))


def with_eta(df: DataFrame, ts: str = "ts", phase: str = "phase", percent: str = "percent", job: str = "job", seconds: int = 30) -> DataFrame:
    """rate, phase_eta and total_eta (seconds) of progress samples. Rates start anew with
    a phase; there is no estimate where the rate isn't positive."""
    out = trailing_rate(df, [job, phase], ts, percent, seconds)
    eta = F.when(F.col("rate") > 0, (100 - F.col(percent)) / F.col("rate"))
    done, share = F.lit(0.0), F.lit(None).cast("double")
    before = 0.0
    for name, w in PHASES.items():
        share = F.when(F.col(phase) == name, F.lit(w)).otherwise(share)
        done = F.when(F.col(phase) == name, F.lit(before) + F.lit(w) * F.col(percent) / 100).otherwise(done)
        before += w
    out = out.withColumn("phase_eta", eta)
    # the remaining share of the job at this phase's speed
    return out.withColumn("total_eta", F.when(F.col("rate") > 0, (1 - done) / share * 100 / F.col("rate")))


HEAD = r"(?U)^([^\d]+)\s+(\d{1,2}\.\d{1,2}\.\d{4}|UNBEKANNT|e ABELE)\s+(.+)$"


def assemble_records(lines: DataFrame, doc: str = "path", no: str = "line_no", line: str = "line") -> DataFrame:
    """doc, record_no, name, date, rest, names: records of listings.

    Lines up to the first dashed one are ignored. A line of a name, a date and
    more opens a record; of every other line the first word goes to the names of
    the record that is open. Documents are assembled apart, each in its order.
    """
    w = Window.partitionBy(doc).orderBy(no)
    dashed = F.max(F.col(line).rlike(r"^\s*-{3,}").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("_open", F.coalesce(dashed, F.lit(0)) == 1).where(F.col("_open") & ~F.col(line).rlike(r"^\s*-{3,}"))
    rows = rows.withColumn("_head", F.regexp_extract(line, HEAD, 0) != "").withColumn("record_no", F.sum(F.col("_head").cast("int")).over(w))
    word = F.regexp_extract(line, r"(?U)(\w+)", 1)
    part = lambda i: F.max(F.when(F.col("_head"), F.trim(F.regexp_extract(line, HEAD, i))))
    names = F.sort_array(F.collect_list(F.when(~F.col("_head") & (word != ""), F.struct(F.col(no).alias("n"), word.alias("w")))))
    out = rows.where("record_no > 0").groupBy(doc, "record_no").agg(part(1).alias("name"), part(2).alias("date"), part(3).alias("rest"), names.alias("_names"))
    return out.select(doc, "record_no", "name", "date", "rest", F.transform("_names", lambda s: s["w"]).alias("names"))


def assemble_turns(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, n_turns, all texts in their order."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return turns.groupBy(key).agg(parts.alias("_p")).select(key, F.size("_p").alias("n_turns"), F.array_join(F.transform("_p", lambda p: p[text]), "\n").alias("body"))


def cumulative_levels(df: DataFrame, keys: list[str], value: str, levels: int = 255, clip: int | None = None) -> DataFrame:
    """keys, value, n, level: the cumulative share of each distinct value, scaled to 0..levels.
    With ``clip``, counts above it are cut off; the cut rest is spread evenly over the values."""
    h = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    by, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    mass: Column = F.col("n").cast("double")
    if clip is not None:
        kept = F.least(F.col("n"), F.lit(clip)).cast("double")
        h = h.withColumn("_kept", kept).withColumn("_rest", F.sum(F.col("n") - F.col("_kept")).over(by) / F.count("*").over(by))
        mass = F.col("_kept") + F.col("_rest")
    h = h.withColumn("_mass", mass)
    level = F.floor(F.sum("_mass").over(upto) / F.sum("_mass").over(by) * levels + 1e-9).cast("int")
    return h.select(*keys, value, "n", level.alias("level"))
