"""Aggregates: distributions, fences, thresholds, arg-max, last-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.address import scaled
from quern.operators.rows import numbered, stored


def frequencies(df: DataFrame, key: Column, name: str = "key", exclude: str | None = None) -> DataFrame:
    """Count by key; null is a key. Rows whose key is ``exclude`` don't count."""
    out = df.select(key.alias(name))
    if exclude is not None:
        out = out.where(~F.col(name).eqNullSafe(exclude))
    return out.groupBy(name).agg(F.count("*").alias("n"))


def totals(df: DataFrame, failed: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(failed).alias("errors"))


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 over all rows, as <column>_scaled. The limits are one row, joined to all."""
    limits = df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(limits))
    return out.select(*df.columns, *(scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")).alias(f"{c}_scaled") for c in columns))


def last_write_wins(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of each key's last row."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def spread_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, min, max, mean and population deviation by key; one value deviates by 0."""
    c = F.col(value)
    return df.groupBy(key).agg(F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation"))


def with_fallback(df: DataFrame, groups: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and deviation of each row's key, or those of all rows for keys without a group."""
    overall = df.agg(F.avg(value).alias("all_mean"), F.stddev_pop(value).alias("all_deviation"))
    out = df.join(groups.select(key, "mean", "deviation"), key, "left").crossJoin(F.broadcast(overall))
    return out.select(*df.columns, F.coalesce("mean", "all_mean").alias("mean"), F.coalesce("deviation", "all_deviation").alias("deviation"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles by key, named as in ``shares``; null where a key has no value. As ``F.percentile``, but no task holds the values of a key.

    Sketches of bounded size give narrow brackets around each percentile. Rows are counted below and in each of these, so it is
    known in which piece the wanted places are, and only the values of that piece are ordered. The sketch decides how
    much is ordered, never the result.
    """
    if not keys:
        one = df.sparkSession.range(1).select(F.lit(0).alias("_all"))  # a row even of no rows
        return one.join(percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, shares), "_all", "left").drop("_all")
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v"))
    near = sorted({min(max(p + d, 0.0), 1.0) for p in shares.values() for d in (-0.05, -0.002, -0.0003, 0.0003, 0.002, 0.05)})
    cuts = stored(rows.groupBy(*keys).agg(F.percentile_approx("_v", near, 10000).alias("_cuts")))
    # the piece of a value: how many cuts are at most it
    cut = by_key(rows.where("_v IS NOT NULL"), cuts, keys).withColumn("_piece", sum((F.when(F.col("_v") >= F.col("_cuts")[i], 1).otherwise(0) for i in range(len(near))), F.lit(0))).drop("_cuts")
    sizes = stored(cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n")))
    upto = Window.partitionBy(*keys).orderBy("_piece")
    of_key = Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "_piece", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(of_key).alias("_all_n"))
    places = lambda n, p: (F.floor(p * (n - 1)), F.ceil(p * (n - 1)))
    ends = [e for p in shares.values() for e in places(F.col("_all_n"), p)]
    inside = lambda e, before, upto: (e >= F.col(before)) & (e < F.col(upto))
    wanted = stored(sizes.where(F.exists(F.array(*ends), lambda e: inside(e, "_before", "_upto"))).select(*keys, "_piece", "_before", "_all_n"))
    # equal values are one row; in what is left, places are counted within a piece
    held = by_key(cut, wanted, [*keys, "_piece"]).groupBy(*keys, "_piece", "_v").agg(F.count("*").alias("_n"), F.first("_before").alias("_before"), F.first("_all_n").alias("_all_n"))
    running = F.sum("_n").over(Window.partitionBy(*keys, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_to", F.col("_before") + running).withColumn("_from", F.col("_to") - F.col("_n"))
    out = held.groupBy(*keys).agg(F.first("_all_n").alias("_all_n"), *(F.max(F.when(inside(e, "_from", "_to"), F.col("_v"))).alias(f"_e{i}") for i, e in enumerate(ends)))

    def between(i: int, p: float) -> Column:
        low, high, at = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}"), p * (F.col("_all_n") - 1)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    out = stored(out.select(*keys, *(between(i, p).alias(name) for i, (name, p) in enumerate(shares.items()))))
    return by_key(cuts.select(*keys), out, keys, "left")


#: Rows of a table that are broadcast at most.
BROADCAST = 100_000


def by_key(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of its key in a stored table with a row for each key. Null is a key.

    A small table is broadcast: few keys would bring all rows to as few tasks.
    """
    right = groups.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    right = F.broadcast(right) if groups.count() <= BROADCAST else right
    same = [df[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.join(right, on, how).drop(*(f"_k_{k}" for k in keys))


def iqr_fences(df: DataFrame, keys: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Exact quartiles and the fence around them, by key; without a value the fence is (0, infinity)."""
    out = percentiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    reach = factor * (F.col("q3") - F.col("q1"))
    return out.select(*keys, "q1", "q3", F.coalesce(F.col("q1") - reach, F.lit(0.0)).alias("lower"), F.coalesce(F.col("q3") + reach, F.lit(float("inf"))).alias("upper"))


def outside_fences(df: DataFrame, keys: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the fences of their key; those without a key have none."""
    fences = stored(iqr_fences(df, keys, value, factor))
    out = by_key(df.dropna(subset=keys), fences.dropna(subset=keys), keys) if keys else df.crossJoin(F.broadcast(fences))
    return out.where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))).select(*df.columns)


def best_fraction(df: DataFrame, score: str, tie: str, percent: float) -> DataFrame:
    """Of the rows at least as good as the median less one sample deviation (0 for one row),
    the best percent but two at least; ties go to the greater ``tie``. Adds ``place`` from 1."""
    limit = percentiles(df, [], score, {"_m": 0.5}).crossJoin(df.agg(F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("_s")))
    good = df.crossJoin(F.broadcast(limit)).where(F.col(score) >= F.col("_m") - F.col("_s")).drop("_m", "_s")
    placed = numbered(good, [F.col(score).desc(), F.col(tie).desc()], "place")
    most = placed.agg(F.greatest(F.lit(2), F.floor(F.count("*") * percent / 100)).alias("_most"))
    return placed.crossJoin(F.broadcast(most)).where(F.col("place") < F.col("_most")).withColumn("place", F.col("place") + 1).drop("_most")


def arg_max(df: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """The value of best score by key, ties to the greater value."""
    best = F.max(F.struct(score, value)).alias("_b")
    out = df.groupBy(*keys).agg(best) if keys else df.agg(best)
    return out.select(*keys, F.col("_b")[value].alias(value), F.col("_b")[score].alias(score))


def top_n(df: DataFrame, score: str, idx: str, n: int) -> DataFrame:
    """The n best rows, ties in the order of ``idx``: a top-k in each partition, then of these."""
    return df.orderBy(F.col(score).desc(), F.col(idx)).limit(n)


def letter_ratios(df: DataFrame, name: str, width: str) -> DataFrame:
    """Mean of width / length over the names that contain a letter, by letter."""
    named = df.where(F.length(name) > 0)
    letters = named.select(F.explode(F.array_distinct(F.split(name, ""))).alias("letter"), (F.col(width) / F.length(name)).alias("ratio"))
    return letters.where("letter <> ''").groupBy("letter").agg(F.avg("ratio").alias("mean_ratio"), F.count("*").alias("n"))


def centroid(df: DataFrame, keys: list[str], x1: str, x2: str, y1: str, y2: str) -> DataFrame:
    """Mean centre of boxes."""
    return df.groupBy(*keys).agg(F.avg((F.col(x1) + F.col(x2)) / 2).alias("cx"), F.avg((F.col(y1) + F.col(y2)) / 2).alias("cy"))


def running_index(df: DataFrame, key: str, order: list[str], name: str = "nth") -> DataFrame:
    """0, 1, 2, ... within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
