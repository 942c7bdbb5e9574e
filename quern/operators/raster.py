"""Rasters: numpy kernels over decoded pictures (h, w, 8-bit pixels as bytes), and
operators on the long form (image, y, x, v). Decoding picture files is left to the caller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _image(h: int, w: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(h, w).astype(np.float64)


def _laplacian(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="reflect") if min(a.shape) > 1 else np.pad(a, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a


_QUALITY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sharpness", "contrast", "score")])


@F.pandas_udf(_QUALITY)
def quality(h: pd.Series, w: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    """sharpness (variance of the Laplacian), contrast (deviation), and 0.5 sharpness + 0.3 contrast - 0.2 noise, where noise is the deviation too."""
    out = []
    for a, b, p in zip(h, w, pixels):
        if p is None or not len(p):
            out.append((None, None, None))
            continue
        x = _image(a, b, p)
        sharp, dev = float(_laplacian(x).var()), float(x.std())
        out.append((sharp, dev, 0.5 * sharp + 0.3 * dev - 0.2 * dev))
    return pd.DataFrame(out, columns=["sharpness", "contrast", "score"], dtype="float64")


def pixels(images: DataFrame, key: str = "image") -> DataFrame:
    """Long form (image, y, x, v) of decoded pictures."""

    def long(batches):
        for rows in batches:
            for k, h, w, p in zip(rows[key], rows["h"], rows["w"], rows["pixels"]):
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({key: k, "y": y, "x": x, "v": np.frombuffer(p, np.uint8).astype(np.int32)})

    return images.select(key, "h", "w", "pixels").mapInPandas(long, f"{key} {images.schema[key].dataType.simpleString()}, y int, x int, v int")


def focus_stack(long: DataFrame, key: str = "image", order: str = "image", block: int = 8) -> DataFrame:
    """by, bx, image: for each block the picture with most local contrast (variance); ties to the first picture."""
    b = long.withColumn("by", F.floor(F.col("y") / block)).withColumn("bx", F.floor(F.col("x") / block))
    sharp = b.groupBy("by", "bx", key).agg(F.var_pop("v").alias("s"))
    best = sharp.groupBy("by", "bx").agg(F.max("s").alias("m"))
    return sharp.join(best, ["by", "bx"]).where(F.col("s") == F.col("m")).groupBy("by", "bx").agg(F.min(key).alias(key))


def stacked(long: DataFrame, key: str = "image", block: int = 8) -> DataFrame:
    """y, x, v of the stack."""
    chosen = focus_stack(long, key, key, block)
    b = long.withColumn("by", F.floor(F.col("y") / block)).withColumn("bx", F.floor(F.col("x") / block))
    return b.join(chosen, ["by", "bx", key]).select("y", "x", "v")


def common_area(long: DataFrame, key: str = "image") -> DataFrame:
    """y0, x0, y1, x1 of the smallest box around the places where all pictures have a value over 0, ends included."""
    n = long.select(key).distinct().agg(F.count("*").alias("_n"))
    valid = long.where("v > 0").groupBy("y", "x").agg(F.countDistinct(key).alias("k")).crossJoin(F.broadcast(n)).where("k = _n")
    return valid.agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


def stretch(long: DataFrame, key: str = "image", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values between two exact percentiles of their picture, scaled to 0..255."""
    limits = long.groupBy(key).agg(F.percentile("v", low).alias("_lo"), F.percentile("v", high).alias("_hi"))
    share = (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 255)).otherwise(F.col("v"))
    return long.join(limits, key).select(key, "y", "x", scaled.cast("int").alias("v"))


def mean_threshold(long: DataFrame, key: str = "image") -> DataFrame:
    """1 over the picture's mean, 0 elsewhere."""
    mean = long.groupBy(key).agg(F.avg("v").alias("_m"))
    return long.join(mean, key).select(key, "y", "x", (F.col("v") > F.col("_m")).cast("int").alias("v"))


@F.pandas_udf(T.BinaryType())
def adaptive_contrast(h: pd.Series, w: pd.Series, pixels: pd.Series) -> pd.Series:
    """Local equalisation: each pixel's rank in a window that is wide in flat and
    narrow in busy places (3 to 65, odd), scaled to 0..255. Squares don't wrap at 256."""
    out = []
    for a, b, p in zip(h, w, pixels):
        if p is None or not len(p):
            out.append(p)
            continue
        x = _image(a, b, p)
        gy, gx = np.gradient(x) if min(x.shape) > 1 else (np.zeros_like(x), np.zeros_like(x))
        pad = np.pad(x, 2, mode="edge")
        near = np.lib.stride_tricks.sliding_window_view(pad, (5, 5))
        busy = near.var(axis=(2, 3)) / 255**2 + np.hypot(gy, gx) / 255
        half = np.clip((32 * (1 - busy / max(float(busy.max()), 1e-9))).astype(int), 1, 32)
        y = np.empty_like(x)
        for i in range(a):
            for j in range(b):
                k = half[i, j]
                win = x[max(0, i - k) : i + k + 1, max(0, j - k) : j + k + 1]
                y[i, j] = (win <= x[i, j]).mean() * 255
        out.append(y.round().astype(np.uint8).tobytes())
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def focus_weights(h: pd.Series, w: pd.Series, pixels: pd.Series) -> pd.Series:
    """Weight of each pixel in a blend, |Laplacian| + half the gradient, as 32-bit floats."""
    out = []
    for a, b, p in zip(h, w, pixels):
        if p is None or not len(p):
            out.append(p)
            continue
        x = _image(a, b, p)
        gy, gx = np.gradient(x) if min(x.shape) > 1 else (np.zeros_like(x), np.zeros_like(x))
        out.append((np.abs(_laplacian(x)) + 0.5 * np.hypot(gy, gx)).astype(np.float32).tobytes())
    return pd.Series(out, dtype=object)


def to_budget(h: int, w: int, budget: int) -> tuple[int, int]:
    """Height and width of at most a budget of pixels, in the same proportion."""
    scale = min(1.0, (budget / max(h * w, 1)) ** 0.5)
    return max(1, int(h * scale)), max(1, int(w * scale))
