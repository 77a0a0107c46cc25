"""Pieces shared by the training-data operators: the shared folder, lineage cuts, words and shingles."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SHINGLE_WORDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a temporary folder is made and set if Spark runs on this machine alone (tests); on a
    cluster, where each executor would write to its own disk, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths that this thread's operators write within the block, for ``remove`` when nothing reads them any more.
    What is left in the list at the end goes to the block around it."""
    paths: list[str] = []
    token = _PATHS.set(paths)
    try:
        yield paths
    finally:
        _PATHS.reset(token)
        if (outer := _PATHS.get()) is not None:
            outer += paths


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if (paths := _PATHS.get()) is not None:
        paths.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = hadoop(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once with a number of each row, so that the numbers stay the same whenever it is read."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_split(rows: DataFrame, per_key: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` left joined with ``per_key``: a written table (``cut``) of one row for each key, with ``n``, its rows.

    Keys that have more than a quarter of a partition's fair share are at most four times as many as the partitions, so
    their rows of ``per_key`` are broadcast. What they have found is dealt out by ``spread`` (a column of the key's kind
    that differs from row to row) in the join of the others, so no task gets more than its share of any key.
    """
    spark, cols = rows.sparkSession, [c for c in per_key.columns if c not in (key, "n")]
    share = (per_key.agg(F.sum("n")).first()[0] or 0) / (4 * partitions(spark))
    held = per_key.select(F.col(key).alias("_key"), F.struct("n", *cols).alias("_held"), (F.col("n") > share).alias("_hot"))
    hot = F.broadcast(held.where("_hot").select("_key", F.col("_held").alias("_first")))
    out = rows.join(hot, F.col(key) == F.col("_key"), "left").drop("_key")
    out = out.withColumn("_by", F.when(F.col("_first").isNull(), F.col(key)).otherwise(spread))
    out = out.join(held.where("not _hot").drop("_hot"), F.col("_by") == F.col("_key"), "left").withColumn("_got", F.coalesce("_first", "_held"))
    return out.select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in ("n", *cols)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, chars: int = 4_000_000, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``rows`` rows and about ``chars`` bytes of the text column."""
    for batch in batches:
        col = batch.column(text)
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1].astype(np.int64)) if len(col) else []
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or total + n > chars):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < len(col):
            yield batch.slice(start)


class _Hashes(dict):
    """Word to 64-bit hash, emptied when it has grown to ``most`` words."""

    most = 120_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in text order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        out = out * _STEP + words[j : j + n]
    return mix(out)


#: One for each worker process, so that later tasks of a worker find its words.
_HASHES = _Hashes()


class Shingler:
    """Word runs of a text as 64-bit hashes. Lower-cased ``\\w+`` words; a shorter text is one run of all its words."""

    def __init__(self, size: int = SHINGLE_WORDS):
        self.size, self.hashes = size, _HASHES

    def words(self, text: str | None) -> np.ndarray:
        found = WORD.findall((text or "").lower())
        return np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))

    def ordered(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        return windows(w, min(self.size, len(w))) if len(w) else w

    def distinct(self, text: str | None) -> np.ndarray:
        return np.unique(self.ordered(text))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over whole texts. Spark bounds the bytes of a batch; operators cut it further with ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # a worker lives on after its task

    return df.mapInArrow(run, schema)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add: its own results replace clashing names."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def bucket_by_range(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Add ``name``: the number of the key's range among ``n`` ranges of about equal row counts.

    The bounds come from one pass over the key alone. They are looked up in two steps (coarse, then fine), so the
    expression costs about 2*sqrt(n) comparisons. Null keys go to the first range.
    """
    kind = dict(df.dtypes)[key]
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  # one constant, however many ranges
    bounds = []
    if n > 1:
        found = df.agg(F.percentile_approx(key, listed([i / n for i in range(1, n)], "double"), max(10_000, 10 * n)).alias("p")).first()["p"]
        bounds = sorted(set(found or []))
    if not bounds:
        return df.withColumn(name, F.lit(0))
    width = max(1, round(len(bounds) ** 0.5))
    value = F.col(key)

    def below(options):
        return F.size(F.filter(options, lambda b: b < value))

    coarse = below(listed(bounds[width - 1 :: width], kind))
    fine = below(F.slice(listed(bounds, kind), coarse * width + 1, F.lit(width)))
    return df.withColumn(name, F.when(value.isNull(), 0).otherwise(coarse * width + fine))
