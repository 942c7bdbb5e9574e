"""Grids: cell means, voxels, street layouts, gaps, hill-shade."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.stats import last_write_wins, outside_fences


def bin_mean(df: DataFrame, x: str, y: str, z: str, size: float) -> DataFrame:
    """gx, gy, n, mean_z of the cells that hold points; cells count from the least x and y."""
    limits = df.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    cell = lambda v, lo: F.floor((F.col(v) - F.col(lo)) / size).cast("long")
    out = df.crossJoin(F.broadcast(limits)).select(cell(x, "_x0").alias("gx"), cell(y, "_y0").alias("gy"), F.col(z).alias("z"))
    return out.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"))


def full_grid(cells: DataFrame) -> DataFrame:
    """All cells of the extent, those without points with a null mean and ``filled`` false."""
    ends = cells.agg(F.max("gx").alias("mx"), F.max("gy").alias("my"))
    every = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), "mx")).alias("gx"), "my").select("gx", F.explode(F.sequence(F.lit(0).cast("long"), "my")).alias("gy"))
    return every.join(cells, ["gx", "gy"], "left").withColumn("filled", F.col("n").isNotNull())


def voxel_downsample(df: DataFrame, axes: list[str], size: float) -> DataFrame:
    """The mean point of each voxel and its number of points."""
    voxel = [F.floor(F.col(a) / size).cast("long").alias(f"v_{a}") for a in axes]
    return df.select(*axes, *voxel).groupBy(*(f"v_{a}" for a in axes)).agg(*(F.avg(a).alias(a) for a in axes), F.count("*").alias("n"))


def dense_occupancy(df: DataFrame, keys: list[str], number: str, last: int | None = None) -> DataFrame:
    """keys, number, occupied for every number from 1 to ``last``, or to the greatest of the key."""
    seen = df.where(F.col(number) >= 1).select(*keys, F.col(number).cast("int").alias("number")).distinct()
    top = F.max("number") if last is None else F.lit(last)
    ends = (seen.groupBy(*keys) if keys else seen).agg(top.alias("_top"))
    dense = ends.select(*keys, F.explode(F.sequence(F.lit(1), F.col("_top"))).alias("number"))
    return dense.join(seen.withColumn("_seen", F.lit(True)), [*keys, "number"], "left").select(*keys, "number", F.coalesce("_seen", F.lit(False)).alias("occupied"))


def street_grid(df: DataFrame, number: str, industry: str, idx: str) -> DataFrame:
    """side, slot, number, industry of both sides of a street.

    House numbers outside the fence of the quartiles are left out; a number's
    slot is its half, its last row wins, and both sides are as long as the longer
    one needs. Free slots are ``Unknown``. The number of a slot is the one that
    sits in it: 2 * slot on the even side, 2 * slot + 1 on the odd one.
    """
    rows = df.where(F.col(number).isNotNull())
    inside = rows.join(outside_fences(rows, [], number).select(idx), idx, "left_anti")
    housed = last_write_wins(inside, [number], industry, [idx]).select((F.pmod(number, F.lit(2)) == 0).alias("even"), F.floor(F.col(number) / 2).cast("int").alias("slot"), industry)
    ends = inside.agg(F.coalesce(F.max(F.when(F.pmod(number, F.lit(2)) == 1, F.col(number))), F.lit(100)).alias("odd"), F.coalesce(F.max(F.when(F.pmod(number, F.lit(2)) == 0, F.col(number))), F.lit(100)).alias("even"))
    last = (F.floor((F.greatest("odd", "even") + 10) / 2)).cast("int")
    slots = ends.select(F.explode(F.sequence(F.lit(0), last)).alias("slot")).crossJoin(df.sparkSession.createDataFrame([(True,), (False,)], "even boolean"))
    out = slots.join(housed, ["even", "slot"], "left")
    return out.select(F.when(F.col("even"), "even").otherwise("odd").alias("side"), "slot", (2 * F.col("slot") + F.when(F.col("even"), 0).otherwise(1)).alias("number"), F.coalesce(industry, F.lit("Unknown")).alias(industry))


def first_free_slots(slots: DataFrame, taken: DataFrame, waiting: DataFrame, keys: list[str], slot: str, item: str) -> DataFrame:
    """keys, slot, item: the n-th waiting item of a key gets its n-th free slot; items beyond the free slots get none."""
    free = slots.join(taken.select(*keys, slot).distinct(), [*keys, slot], "left_anti")
    nth = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c)).alias("_nth")
    return free.select(*keys, slot, nth(slot)).join(waiting.select(*keys, item, nth(item)), [*keys, "_nth"]).drop("_nth")


def hill_shade(cells: DataFrame, z: str = "mean_z", size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """gx, gy, shade from 0 to 1. Slopes are central differences, one-sided at the edges; null next to a gap."""
    azim, alt = math.radians(360 - azimuth + 90), math.radians(altitude)

    def slope(along: str, other: str) -> Column:
        w = Window.partitionBy(other).orderBy(along)
        before, after = (f(z).over(w) for f in (F.lag, F.lead))
        gap = lambda f: f(along).over(w)
        first, last = gap(F.lag).isNull(), gap(F.lead).isNull()
        return F.when(first & last, 0.0).when(first, (after - F.col(z)) / size).when(last, (F.col(z) - before) / size).otherwise((after - before) / (2 * size))

    out = cells.withColumn("_dx", slope("gx", "gy")).withColumn("_dy", slope("gy", "gx"))
    steep = F.atan(F.hypot("_dx", "_dy"))
    aspect = F.atan2(-F.col("_dx"), F.col("_dy"))
    shade = F.lit(math.sin(alt)) * F.cos(steep) + F.lit(math.cos(alt)) * F.sin(steep) * F.cos(F.lit(azim) - aspect)
    return out.select("gx", "gy", F.greatest(F.lit(0.0), shade).alias("shade"))


def fill_gaps(cells: DataFrame, tile: int = 64, reach: int = 8) -> DataFrame:
    """gx, gy, mean_z with gaps filled by inverse-distance means of the filled cells within ``reach``.

    A stand-in for linear interpolation over triangles, which needs a library
    that isn't there: values differ, and a gap with no filled cell in reach stays
    null. Tiles are filled on their own, each with a margin of the reach.
    """
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = cells.select("gx", "gy", "mean_z", F.explode(near).alias("i")).select("*", F.explode(near).alias("j"))
    tiled = spread.select(
        "gx", "gy", "mean_z", F.floor(F.col("gx") / tile).alias("tx"), F.floor(F.col("gy") / tile).alias("ty"), "i", "j",
    ).select("gx", "gy", "mean_z", (F.col("tx") + F.col("i")).alias("tx"), (F.col("ty") + F.col("j")).alias("ty"))
    lo = lambda v, t: F.col(v) >= F.col(t) * tile - reach
    hi = lambda v, t: F.col(v) < (F.col(t) + 1) * tile + reach
    tiled = tiled.where(lo("gx", "tx") & hi("gx", "tx") & lo("gy", "ty") & hi("gy", "ty"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[(rows.gx // tile == key[0]) & (rows.gy // tile == key[1])].copy()
        known, gaps = rows[rows.mean_z.notna()], own.mean_z.isna()
        for at in own.index[gaps]:
            d = np.hypot(known.gx - own.gx[at], known.gy - own.gy[at])
            w = np.where(d <= reach, 1 / np.maximum(d, 1e-9), 0)
            if w.sum() > 0:
                own.loc[at, "mean_z"] = float((w * known.mean_z).sum() / w.sum())
        return own[["gx", "gy", "mean_z"]]

    return tiled.groupBy("tx", "ty").applyInPandas(fill, "gx long, gy long, mean_z double")
