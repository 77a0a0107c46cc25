"""Shuffling samples into batches without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.draws import draw_key


#: Ids of a range, about.
RANGE_ROWS = 1_000_000


def make_batches(ids: DataFrame, size: int, seed: int = 42, epoch: int = 0, key: str = "image_id", ranges: int | None = None) -> DataFrame:
    """``pos`` (from 0, in an order drawn anew for each epoch) and ``batch_id``.

    The order is that of an md5 key. Its first digits spread evenly, so they cut the ids into ``ranges`` ranges without
    sampling; rows are numbered within a range, and the ranges' counts (``ranges`` rows) give the offsets. Without
    ``ranges`` the ids are counted: as many as there are shuffle partitions, and no more than ``RANGE_ROWS`` ids in each.
    """
    if ranges is None:
        ranges = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // RANGE_ROWS))
    k = draw_key(F.col(key), "order", seed, epoch)
    d = ids.withColumn("_k", k).withColumn("_range", F.floor(F.conv(F.substring("_k", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int"))
    counts = d.groupBy("_range").count()
    offsets = counts.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = d.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("_k", key)) - 1)
    out = numbered.join(F.broadcast(offsets), "_range").withColumn("pos", F.col("_n") + F.col("_before"))
    return out.withColumn("batch_id", F.floor(F.col("pos") / size)).drop("_k", "_range", "_n", "_before")


def sample_at(batches: DataFrame, i: int | Column) -> DataFrame:
    return batches.where(F.col("pos") == i)


def n_samples(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def n_batches(df: DataFrame, size: int) -> DataFrame:
    """The last, shorter batch counts."""
    return df.agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
