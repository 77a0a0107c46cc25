"""Scoring with a plug-in predictor, and its eight-view ensemble.

Two forms with one meaning. Pixel tables: a predictor is a function of columns, and views are index arithmetic. Raster
rows: a predictor factory is called once per task and gives a function on a batch of arrays (n, bands, height, width); all
eight views of an image are scored within one batch, so nothing is shuffled. Use raster rows for mass scoring. How many
rows Spark hands over at a time is bounded by the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless
set) and ``maxRecordsPerBatch``; of these rows ``batch_size`` are scored at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tilewright.functions import pixels
from tilewright.functions.pixels import sigmoid

#: A predictor on columns: (normalised value, row, column) to probability.
PixelPredictor = Callable[[Column, Column, Column], Column]
#: Called without arguments on a worker; gives a function of normalised (n, bands, height, width) arrays to (n, height,
#: width) probabilities.
PredictorFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]
VIEWS = range(8)


def logistic(bias: float = 0.1, weight: float = 0.8, by_row: float = 0.05, by_col: float = -0.03) -> PixelPredictor:
    """A small logistic model that depends on the position, so that a wrong view shows."""
    return lambda x, r, c: sigmoid(F.lit(bias) + F.lit(weight) * x + F.lit(by_row) * r + F.lit(by_col) * c)


def logistic_factory(bias: float = 0.1, weights: Sequence[float] = (0.8,), by_row: float = 0.05, by_col: float = -0.03) -> PredictorFactory:
    """The same model on arrays, with a weight for each band."""

    def factory() -> Callable[[np.ndarray], np.ndarray]:
        def predict(x: np.ndarray) -> np.ndarray:
            r, c = np.arange(x.shape[2])[None, :, None], np.arange(x.shape[3])[None, None, :]
            return 1 / (1 + np.exp(-(bias + np.tensordot(x, np.asarray(weights), (1, 0)) + by_row * r + by_col * c)))

        return predict

    return factory


def score(df: DataFrame, predictor: PixelPredictor, value: str = "b") -> DataFrame:
    """Pixel table with ``q``, the probability; all other columns (the image id) stay."""
    return df.withColumn("q", predictor(pixels.normalise(F.col(value)), F.col("r"), F.col("c"))).drop(value)


def tta_views(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Each image as eight views (bit 0: quarter turn, then bit 1: vertical and bit 2: horizontal flip)."""
    height, width = shape
    v = df.withColumn("view", F.explode(F.array(*map(F.lit, VIEWS))))
    bit = lambda n: F.col("view").bitwiseAND(F.lit(1 << n)) > 0
    v = v.withColumns({"_r": F.when(bit(0), width - 1 - F.col("c")).otherwise(F.col("r")), "_c": F.when(bit(0), F.col("r")).otherwise(F.col("c")), "_h": F.when(bit(0), width).otherwise(height), "_w": F.when(bit(0), height).otherwise(width)})
    return v.withColumns({"r": F.when(bit(1), F.col("_h") - 1 - F.col("_r")).otherwise(F.col("_r")), "c": F.when(bit(2), F.col("_w") - 1 - F.col("_c")).otherwise(F.col("_c"))}).drop("_r", "_c", "_h", "_w")


def tta_invert(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Undo the views: flips first, then the turn."""
    height, width = shape
    bit = lambda n: F.col("view").bitwiseAND(F.lit(1 << n)) > 0
    h, w = F.when(bit(0), width).otherwise(height), F.when(bit(0), height).otherwise(width)
    v = df.withColumns({"_r": F.when(bit(1), h - 1 - F.col("r")).otherwise(F.col("r")), "_c": F.when(bit(2), w - 1 - F.col("c")).otherwise(F.col("c"))})
    return v.withColumns({"r": F.when(bit(0), F.col("_c")).otherwise(F.col("_r")), "c": F.when(bit(0), width - 1 - F.col("_r")).otherwise(F.col("_c"))}).drop("_r", "_c")


def tta_merge(views: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Sum of the views for each pixel, ``q`` from 0 to 8."""
    return views.groupBy(*keys, "r", "c").agg(F.sum("q").alias("q"))


def tta_score(df: DataFrame, predictor: PixelPredictor, shape: tuple[int, int], value: str = "b", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Eight-view ensemble on a pixel table."""
    return tta_merge(tta_invert(score(tta_views(df, shape), predictor, value), shape), keys)


def planes(data: bytes | np.ndarray, height: int, width: int, channels: int) -> np.ndarray:
    """A raster's interleaved bytes (or numbers 0-255) as an array (bands, height, width)."""
    flat = np.frombuffer(data, np.uint8) if isinstance(data, bytes | bytearray | memoryview) else np.asarray(data)
    return flat.reshape(height, width, channels).transpose(2, 0, 1)


def batched(it: Iterator[pd.DataFrame], factory: PredictorFactory, size: int, most: int, views: bool, dtype: str) -> Iterator[pd.DataFrame]:
    """Frames of raster rows scored: what a task of ``score_rasters`` does."""
    predict = factory()
    for frame in it:
        out: list = [None] * len(frame)
        shapes = list(zip(frame["height"], frame["width"], frame["channels"], strict=True))
        for h, w, n in dict.fromkeys(shapes):
            same = [i for i, s in enumerate(shapes) if s == (h, w, n)]
            step = max(1, min(size, most // (int(h) * w * n * np.dtype(dtype).itemsize)))
            for at in range(0, len(same), step):
                where = same[at : at + step]
                x = np.stack([planes(frame["data"].iloc[i], h, w, n) for i in where]).astype(dtype) / 255.0 * 3.2 - 1.6
                q = _eight(x, predict) if views else predict(x)
                for i, one in zip(where, q, strict=True):
                    out[i] = np.ascontiguousarray(one, dtype).tobytes()
        yield frame.drop(columns=["data"]).assign(q=out)


def _eight(x: np.ndarray, predict: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    total = 0
    for k in VIEWS:
        v = np.rot90(x, axes=(2, 3)) if k & 1 else x
        v = v[:, :, ::-1] if k & 2 else v
        q = predict(np.ascontiguousarray(v[:, :, :, ::-1] if k & 4 else v))
        q = q[:, :, ::-1] if k & 4 else q
        q = q[:, ::-1] if k & 2 else q
        total = total + (np.rot90(q, -1, axes=(1, 2)) if k & 1 else q)
    return total


def score_rasters(rasters: DataFrame, factory: PredictorFactory, batch_size: int = 8, views: bool = False, batch_bytes: int = 256 << 20, dtype: str = "float32") -> DataFrame:
    """Raster rows (.., height, width, channels: 1 if absent, data: interleaved bytes) to the same with ``q`` for
    ``data``: the probabilities in row-major order as little-endian ``dtype``.

    ``views``: the eight-view sum. Images may differ in shape; those of one shape are stacked, at most ``batch_size`` and
    ``batch_bytes`` of them at a time. Rows that couldn't be decoded (height below 1) are left out.
    """
    rows = rasters if "channels" in rasters.columns else rasters.withColumn("channels", F.lit(1))
    keep = [f for f in rows.schema.fields if f.name != "data"]
    ordered = rows.where("height > 0").select(*[f.name for f in keep], "data")
    return ordered.mapInPandas(lambda it: batched(it, factory, batch_size, batch_bytes, views, dtype), StructType([*keep, StructField("q", BinaryType())]))


def numbers_of(rasters: DataFrame, data: str = "q", dtype: str = "float32") -> DataFrame:
    """A binary payload of numbers as an array of doubles, for pixel tables."""

    @F.pandas_udf("array<double>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, dtype).astype(np.float64) if b is not None else None)

    return rasters.withColumn(data, unpack(data))
