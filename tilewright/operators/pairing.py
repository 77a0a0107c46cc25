"""Pairing images with masks, and auditing what doesn't pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import draws


def pair(images: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(masks, key, "inner")


def raster_audit(images: DataFrame, masks: DataFrame, shape: tuple[int, int] | None = None, key: str = "image_id") -> DataFrame:
    """image_id and problem: an image without a mask, a mask without an image, undecodable (height below 0) or of another
    shape. Tables without height and width are audited for pairs alone."""
    out = images.join(masks, key, "left_anti").select(key, F.lit("no mask").alias("problem")).unionByName(masks.join(images, key, "left_anti").select(key, F.lit("no image").alias("problem")))
    for df, kind in ((images, "image"), (masks, "mask")):
        if {"height", "width"} <= set(df.columns):
            out = out.unionByName(df.where("height < 0").select(key, F.lit(f"undecodable {kind}").alias("problem")))
            if shape:
                out = out.unionByName(df.where((F.col("height") >= 0) & ((F.col("height") != shape[0]) | (F.col("width") != shape[1]))).select(key, F.lit(f"{kind} of another shape").alias("problem")))
    return out


def with_draws(df: DataFrame, names: list[str], seed: int = 42, epoch: int = 0, key: str = "image_id") -> DataFrame:
    """One column for each named draw; joined to image and mask alike they get one transformation."""
    return df.withColumns({f"u_{n}": draws.draw(F.col(key), n, seed, epoch) for n in names})
