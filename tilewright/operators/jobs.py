"""Jobs composed of the operators: scoring a folder of images into masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tilewright.operators.score import PredictorFactory, batched, score_rasters
from tilewright.sources.filesink import write_set
from tilewright.sources.images import scan_images
from tilewright.sources.masks import CONTENT, encode, named


def score_paths(spark: SparkSession, root: str, factory: PredictorFactory, views: bool = False, batch_size: int = 8, **how) -> DataFrame:
    """image_id, height, width, channels, q of the images of a folder, all bands scored."""
    return score_rasters(scan_images(spark, root), factory, batch_size, views, **how)


def _masks(frames: Iterator[pd.DataFrame], threshold: float, dtype: str) -> Iterator[pd.DataFrame]:
    for f in frames:
        on = [np.repeat(np.where(np.frombuffer(q, dtype) > threshold, 255, 0).astype(np.uint8), 3).tobytes() for q in f["q"]]
        yield f.drop(columns=["q"]).assign(channels=3, data=on)


def mask_rows(scored: DataFrame, threshold: float = 4.0, dtype: str = "float32") -> DataFrame:
    """Sums of eight views to three-channel masks: 255 strictly above ``threshold``."""
    run = lambda frames: _masks(frames, threshold, dtype)
    return scored.select("image_id", "height", "width", "q").mapInPandas(run, "image_id string, height int, width int, channels int, data binary")


def mask_files(rasters: DataFrame, factory: PredictorFactory, batch_size: int = 8, threshold: float = 4.0, batch_bytes: int = 256 << 20, dtype: str = "float32") -> DataFrame:
    """Images through the eight views to the files of their masks (name, content): what ``score_rasters``, ``mask_rows`` and
    ``encoded`` give one after the other, in one pass through Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return encode(_masks(batched(frames, factory, batch_size, batch_bytes, True, dtype), threshold, dtype))

    rows = named(rasters.where("height > 0"))
    return rows.select("name", "height", "width", "channels", "data").mapInPandas(run, CONTENT)


def predict_job(spark: SparkSession, src: str, dst: str, factory: PredictorFactory, batch_size: int = 8, if_exists: str = "error", **how) -> None:
    """Images of ``src`` through the eight views to three-channel masks in ``dst``."""
    write_set(mask_files(scan_images(spark, src), factory, batch_size, **how), dst, if_exists)
