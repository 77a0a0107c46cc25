"""The two layouts: raster rows (one array a row, for mass work) and pixel tables (relational, for metrics)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels_of(rasters: DataFrame, width: int, data: str = "data", value: str = "v") -> DataFrame:
    """Raster rows (array in row-major order) to (.., r, c, value)."""
    rest = [c for c in rasters.columns if c != data]
    e = rasters.select(*rest, F.posexplode(data).alias("_p", value))
    return e.select(*rest, F.floor(F.col("_p") / width).cast("int").alias("r"), (F.col("_p") % width).alias("c"), value)


def rasters_of(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Pixels to raster rows in row-major order."""
    cells = F.sort_array(F.collect_list(F.struct("r", "c", value)))
    return pixels.groupBy(*keys).agg(F.transform(cells, lambda x: x[value]).alias("data"), (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def to_chw(data: Column, pixels: Column, channels: int) -> Column:
    """Interleaved channels (row, column, channel) to planes (channel, row, column) by an index permutation."""
    i = F.sequence(F.lit(0), pixels * channels - 1)
    return F.transform(i, lambda p: data[(p % pixels) * channels + F.floor(p / pixels).cast("int")])


def to_hwc(data: Column, pixels: Column, channels: int) -> Column:
    i = F.sequence(F.lit(0), pixels * channels - 1)
    return F.transform(i, lambda p: data[(p % channels) * pixels + F.floor(p / channels).cast("int")])


def gray_to_bgr(data: Column) -> Column:
    """Each grey value three times."""
    return F.flatten(F.transform(data, lambda x: F.array(x, x, x)))


def gray_planes(pixels: DataFrame, channels: int = 3) -> DataFrame:
    """The pixel-table form: every pixel once for each channel."""
    return pixels.withColumn("ch", F.explode(F.array(*map(F.lit, range(channels)))))


def split_channels(pixels: DataFrame, names: list[str], keys: list[str], value: str = "b") -> DataFrame:
    """(keys, ch, value) to one column for each channel."""
    return pixels.groupBy(*keys).agg(*[F.max(F.when(F.col("ch") == i, F.col(value))).alias(n) for i, n in enumerate(names)])


def merge_channels(planes: DataFrame, names: list[str], keys: list[str], value: str = "b") -> DataFrame:
    """One column for each channel to (keys, ch, value)."""
    return planes.select(*keys, F.posexplode(F.array(*names)).alias("ch", value))


def concat_channels(a: DataFrame, b: DataFrame, channels_a: int) -> DataFrame:
    """The channels of two aligned rasters one after the other."""
    return a.unionByName(b.withColumn("ch", F.col("ch") + channels_a))


def add_axes(data: Column, n: int = 1) -> Column:
    """``n`` axes of length one before the others."""
    return data if n == 0 else add_axes(F.array(data), n - 1)


def drop_axes(data: Column, n: int = 1) -> Column:
    """Undo ``add_axes``: the first entry of each of ``n`` axes."""
    return data if n == 0 else drop_axes(data[0], n - 1)
