"""Images and masks as tables bucketed by image id, so that they pair, align and audit without a shuffle.

Tables are in the session's catalogue. Both sides need the same number of buckets; a join on the id then reads bucket by
bucket. A set that is written again replaces the table. Buckets are files, so choose about as many as the cluster has cores,
or more for larger ones; an id that a large part of all rows has makes its bucket large, as a shuffle's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def save(df: DataFrame, name: str, buckets: int = BUCKETS, key: str = "image_id", path: str | None = None) -> None:
    """``df`` as a table bucketed and sorted by ``key``; one file a bucket, as each task writes one bucket. ``path``: where
    its files are (the warehouse, if absent)."""
    out = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (out.option("path", path) if path else out).saveAsTable(name)


def load(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def shuffles(df: DataFrame) -> int:
    """Exchanges in the plan of ``df``."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
