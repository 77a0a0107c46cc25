"""Reading image files: listing without content, colour images, grey masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import pixels

#: Partitions of files that a task reads, about.
TOGETHER = 32
RASTER = "image_id string, height int, width int, channels int, data binary"


def list_images(spark: SparkSession, root: str, only_images: bool = True) -> DataFrame:
    """path, length, image_id of a split's files. Contents aren't read."""
    files = spark.read.format("binaryFile").load(root).select("path", "length")
    files = files.where(pixels.is_image_name(F.element_at(F.split("path", "/"), -1))) if only_images else files
    return files.withColumn("image_id", pixels.image_id(F.col("path")))


def _rasters(spark: SparkSession, root: str, glob: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream.schema("image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>") if streaming else spark.read
    files = reader.format("image").option("pathGlobFilter", glob).load(root)
    if streaming:
        return files
    # Spark takes some 32 files to a partition, however small they are (it adds 4 MB to each); one task reads several of these
    n = files.rdd.getNumPartitions()
    most = max(4 * spark.sparkContext.defaultParallelism, n // TOGETHER)
    return files.coalesce(most) if n > most else files


def scan_images(spark: SparkSession, root: str, glob: str = "*_sat.*", streaming: bool = False, named: Callable[[Column], Column] = pixels.image_id) -> DataFrame:
    """image_id (``named`` gives it from the path), height, width, channels, data (rows of blue, green, red bytes).
    Undecodable files have height -1."""
    i = F.col("image")
    return _rasters(spark, root, glob, streaming).select(named(i["origin"]).alias("image_id"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def scan_masks(spark: SparkSession, root: str, glob: str = "*_mask.*") -> DataFrame:
    """As ``scan_images``, turned to one grey channel."""
    i = F.col("image")
    raw = _rasters(spark, root, glob).select(pixels.mask_id(i["origin"]).alias("image_id"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))
    return raw.mapInPandas(_grey, RASTER)


def _grey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for data, n in zip(f["data"], f["channels"], strict=True):
            if n in (3, 4):
                b, g, r = (np.frombuffer(data, np.uint8)[k::n].astype(float) for k in range(3))
                data = np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.uint8).tobytes()
            out.append(data)
        yield f.assign(data=out, channels=f["channels"].clip(upper=1))


def bytes_to_array(rasters: DataFrame, data: str = "data") -> DataFrame:
    """Binary payloads to arrays of integers 0-255, once a row: a filter on them (Spark adds one to an explode) would call a
    deterministic function again, and below the coalesce of a scan, with a Python runner and its memory for each partition."""

    @F.pandas_udf("array<int>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, np.uint8).astype(np.int32) if b is not None else None)

    return rasters.withColumn(data, unpack.asNondeterministic()(data))


def raster_pixels(rasters: DataFrame) -> DataFrame:
    """Raster rows of binary, interleaved channels to a pixel table (image_id, ch, r, c, b)."""
    e = bytes_to_array(rasters.where("height > 0")).select("image_id", "width", "channels", F.posexplode("data").alias("p", "b"))
    cell = F.floor(F.col("p") / F.col("channels"))
    return e.select("image_id", (F.col("p") % F.col("channels")).alias("ch"), F.floor(cell / F.col("width")).cast("int").alias("r"), (cell % F.col("width")).cast("int").alias("c"), "b")
