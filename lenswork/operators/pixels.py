"""Pixels: resizing for a detector, differences of frames, motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clamp, keys_of, previous

#: Smallest magnitude that is motion, overlay strengths and green ramps.
THRESHOLD = 20
PAGE_ALPHA, HUD_ALPHA = 0.5, 0.6
PAGE_RAMP, HUD_RAMP = (80.0, 1.1), (120.0, 1.5)
#: Numbers of a camera's frames that one task compares.
FRAMES = 256


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, by the pixels' centres; places before the first pixel take it."""

    def axis(n: int, m: int):
        at = (np.arange(m) + 0.5) * (n / m) - 0.5
        low = np.floor(at).astype(int)
        t = np.where(low < 0, 0.0, at - low)
        low = np.clip(low, 0, n - 1)
        return low, np.minimum(low + 1, n - 1), t

    y0, y1, ty = axis(image.shape[0], height)
    x0, x1, tx = axis(image.shape[1], width)
    image = image.astype(np.float64)
    tx, ty = tx[None, :, None], ty[:, None, None]
    top = image[y0][:, x0] * (1 - tx) + image[y0][:, x1] * tx
    low = image[y1][:, x0] * (1 - tx) + image[y1][:, x1] * tx
    return top * (1 - ty) + low * ty


def preprocess(frames: DataFrame, width: int, height: int, channel_order: str = "rgb") -> DataFrame:
    """frames: keys, data (BGR), width, height. Rows with tensor (channels first, 0 to 1) and the resized BGR bytes."""
    keep = [c for c in frames.columns if c not in ("data", "width", "height")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tensors, resized = [], []
            for data, w, h in zip(pdf.data, pdf.width, pdf.height):
                small = resize(np.frombuffer(data, np.uint8).reshape(h, w, 3), width, height)
                channels = small[:, :, ::-1] if channel_order == "rgb" else small
                tensors.append((channels / 255.0).transpose(2, 0, 1).ravel())
                resized.append(small.astype(np.uint8).tobytes())
            yield pdf[keep].assign(tensor=tensors, resized=resized)

    kept = "".join(f"{c} {frames.schema[c].dataType.simpleString()}, " for c in keep)
    return frames.mapInPandas(run, f"{kept}tensor array<double>, resized binary")


def check_buffer(frames: DataFrame) -> DataFrame:
    """Frames whose bytes aren't width x height x 3."""
    wanted = F.col("width").cast("long") * F.col("height") * 3
    return frames.filter(F.col("data").isNull() | (F.octet_length("data") != wanted)).withColumns({"found_bytes": F.octet_length("data"), "wanted_bytes": wanted})


def bgr_to_rgb(frames: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def swap(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else np.frombuffer(d, np.uint8).reshape(-1, 3)[:, ::-1].tobytes())

    return frames.withColumn("data", swap("data"))


def pixel_delta(pixels: DataFrame, threshold: int = THRESHOLD, first: str = "skip") -> DataFrame:
    """pixels: keys, frame_number, px, r, g, b. Against the frame before: mag (mean of the differences, under threshold 0) and signed parts around 128.

    first: what a pixel's first frame gives, nothing (skip) or the difference to black (blank).
    """
    w = Window.partitionBy(*keys_of(pixels), "px").orderBy("frame_number")
    before = {f"p_{c}": F.lag(c).over(w) for c in "rgb"}
    rows = pixels.withColumns(before)
    rows = rows.filter("p_r is not null") if first == "skip" else rows.withColumns({f"p_{c}": F.coalesce(f"p_{c}", F.lit(0)) for c in "rgb"})
    mean = (F.abs(F.col("r") - F.col("p_r")) + F.abs(F.col("g") - F.col("p_g")) + F.abs(F.col("b") - F.col("p_b"))) / F.lit(3.0)
    signed = {f"d_{c}": clamp(128 + F.col(c) - F.col(f"p_{c}"), 0, 255) for c in "rgb"}
    return rows.withColumn("mag", F.when(mean < threshold, 0.0).otherwise(mean)).withColumns(signed).drop("p_r", "p_g", "p_b")


def frame_delta(frames: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """frames: keys, frame_number, data (bytes, 3 per pixel). mags: a byte array of rounded-down magnitudes against the frame before.

    Ranges of FRAMES numbers of a camera are compared apart; each gets the last frame of the range before.
    """

    @F.pandas_udf("binary")
    def delta(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None or len(x) != len(y):
                return None
            d = np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)).reshape(-1, 3).mean(axis=1)
            return np.where(d < threshold, 0, d).astype(np.uint8).tobytes()

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    rows = previous(frames, keys_of(frames), "frame_number", "data", FRAMES, "_before")
    return rows.withColumn("mags", delta("data", "_before")).drop("_before", "data")


def motion_overlay(delta: DataFrame, alpha: float = PAGE_ALPHA, ramp: tuple[float, float] = PAGE_RAMP) -> DataFrame:
    """Adds green and alpha of the picture of motion; an exact half of an alpha goes up."""
    mag = F.col("mag")
    return delta.withColumns({"green": F.least(F.lit(255.0), ramp[0] + ramp[1] * mag), "alpha": F.floor(mag * alpha + 0.5).cast("int")})


def motion_stats(delta: DataFrame) -> DataFrame:
    """Per frame: share of moving pixels, mean and largest magnitude."""
    return delta.groupBy(*keys_of(delta), "frame_number").agg(F.avg((F.col("mag") > 0).cast("double")).alias("moving"), F.avg("mag").alias("mean_mag"), F.max("mag").alias("max_mag"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
