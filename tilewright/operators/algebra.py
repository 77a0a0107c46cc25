"""Raster map algebra on pixel tables: focal sums, resampling, standardisation, band arithmetic.

Kernels are rows (i, j, w), given as a nested list and exploded from a literal; their size is the caller's code, not data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.pixels import relu


def _scatter(df: DataFrame, kernel: list[list[float]]) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for i, row in enumerate(kernel) for j, w in enumerate(row)]
    return df.withColumn("_k", F.explode(F.array(*cells)))


def _within(shape: tuple[int, int]):
    return F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1)


def focal(df: DataFrame, kernel: list[list[float]], shape: tuple[int, int], dilation: int = 1, keys: tuple[str, ...] = ("image_id",), value: str = "v") -> DataFrame:
    """Weighted sum over neighbours ``dilation`` apart, zero outside. A pixel is scattered to its neighbours, so one
    shuffle (the sum) is enough."""
    ci, cj = len(kernel) // 2, len(kernel[0]) // 2
    s = _scatter(df, kernel).select(*keys, (F.col("r") - (F.col("_k.i") - ci) * dilation).alias("r"), (F.col("c") - (F.col("_k.j") - cj) * dilation).alias("c"), (F.col("_k.w") * F.col(value)).alias("_s"))
    return s.where(_within(shape)).groupBy(*keys, "r", "c").agg(F.sum("_s").alias(value))


def multi_rate_focal(df: DataFrame, kernel: list[list[float]], shape: tuple[int, int], rates: tuple[int, ...] = (1, 2, 4, 8), residual: bool = True, keys: tuple[str, ...] = ("image_id",), value: str = "v") -> DataFrame:
    """A cascade of focal sums and ReLU at growing rates; the sum of all steps (and of the input)."""
    base = df.select(*keys, "r", "c", value)
    total, step = base if residual else None, base
    for rate in rates:
        step = focal(step, kernel, shape, rate, keys, value).withColumn(value, relu(F.col(value)))
        total = step if total is None else total.unionByName(step)
    return total.groupBy(*keys, "r", "c").agg(F.sum(value).alias(value))


def block_max(df: DataFrame, size: int = 2, keys: tuple[str, ...] = ("image_id",), value: str = "v") -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col("r") / size).alias("r"), F.floor(F.col("c") / size).alias("c")).agg(F.max(value).alias(value))


def upsample(df: DataFrame, kernel: list[list[float]], shape: tuple[int, int], stride: int = 2, pad: int = 1, out_pad: int = 0, keys: tuple[str, ...] = ("image_id",), value: str = "v") -> DataFrame:
    """Each pixel adds its kernel at ``stride`` times its place less ``pad``; a place that nothing is added to is 0 (in
    images that have a pixel at row 0, column 0)."""
    out = tuple((n - 1) * stride - 2 * pad + k + out_pad for n, k in zip(shape, (len(kernel), len(kernel[0])), strict=True))
    s = _scatter(df, kernel).select(*keys, (F.col("r") * stride + F.col("_k.i") - pad).alias("r"), (F.col("c") * stride + F.col("_k.j") - pad).alias("c"), (F.col("_k.w") * F.col(value)).alias("_s"))
    # rows and columns that no pixel reaches follow from the shapes; most often there are none
    bare = [sorted(set(range(m)) - {p * stride + i - pad for p in range(n) for i in range(k)}) for m, n, k in zip(out, shape, (len(kernel), len(kernel[0])), strict=True)]
    if any(bare):
        rows, cols = (F.array(*[F.lit(x) for x in range(m)]) for m in out)
        cells = df.where("r = 0 and c = 0").select(*keys, F.explode(rows).alias("r")).select(*keys, "r", F.explode(cols).alias("c"))
        s = s.unionByName(cells.where(F.col("r").isin(bare[0]) | F.col("c").isin(bare[1])).withColumn("_s", F.lit(0.0)))
    return s.where(_within(out)).groupBy(*keys, "r", "c").agg(F.sum("_s").alias(value))


def channel_statistics(df: DataFrame, by: str = "ch", value: str = "b") -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def standardise(df: DataFrame, by: str = "ch", value: str = "b", eps: float = 1e-5, statistics: DataFrame | None = None) -> DataFrame:
    """(value - mean) / sqrt(var + eps) by channel; ``statistics``: a saved table (by, mean, var) for the frozen form.

    The statistics have a row for each channel, which bounds the broadcast; a join by channel would put all pixels into as
    many tasks as there are channels."""
    s = statistics if statistics is not None else channel_statistics(df, by, value)
    return df.join(F.broadcast(s), by).withColumn(value, (F.col(value) - F.col("mean")) / F.sqrt(F.col("var") + eps)).drop("mean", "var")


def raster_add(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("image_id", "r", "c"), value: str = "v") -> DataFrame:
    return a.join(b.withColumnRenamed(value, "_w"), list(keys)).withColumn(value, F.col(value) + F.col("_w")).drop("_w")


def band_math(df: DataFrame, weights: list[list[float]], keys: tuple[str, ...] = ("image_id", "r", "c"), value: str = "b") -> DataFrame:
    """Linear combinations of the channels; ``weights[out][in]``."""
    out = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.array(*[F.lit(float(w)) for w in row]).alias("w")) for o, row in enumerate(weights)]))
    e = df.withColumn("_o", out)
    return e.groupBy(*keys, F.col("_o.o").alias("ch")).agg(F.sum(F.col(value) * F.element_at("_o.w", (F.col("ch") + 1).cast("int"))).alias("v"))
