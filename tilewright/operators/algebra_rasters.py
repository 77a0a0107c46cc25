"""The map algebra on raster rows: one image a row, any shape and number of bands, bytes in and out.

Rows have height, width, channels (1 if absent) and ``v``: the bands one after the other, each in row-major order, as
little-endian ``dtype``, or an array of numbers. An operator reads a row and gives a row with its result's height, width and
``v``; other columns stay. ``numbers`` gives ``v`` as an array of doubles. So rows that come as arrays and go to a pixel table
pass through Python once, where a task has a worker for each pass. Neighbourhoods lie within the image, so nothing is
shuffled, where the pixel-table form makes a row for each pixel and kernel cell. A null payload stays null. Results equal the
pixel-table form's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

#: Bytes of results that are handed back together.
TOGETHER = 8 << 20


def bytes_of(rasters: DataFrame, data: str = "v", dtype: str = "float64") -> DataFrame:
    """An array of numbers as a binary payload."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda a: np.asarray(a, dtype).tobytes() if a is not None else None)

    return rasters.withColumn(data, pack(data))


def _schema(keep: list[StructField], numbers: bool) -> StructType:
    made = [StructField(n, IntegerType()) for n in ("height", "width", "channels")]
    return StructType([*keep, *made, StructField("v", ArrayType(DoubleType()) if numbers else BinaryType())])


def _image(height: int, width: int, channels: int, v: bytes | np.ndarray | None, dtype: str) -> np.ndarray | None:
    if v is None:
        return None
    return (v if isinstance(v, np.ndarray) else np.frombuffer(v, dtype)).astype(np.float64).reshape(channels, height, width)


def _row(x: np.ndarray, dtype: str, numbers: bool) -> tuple:
    """height, width, channels and v of a result."""
    flat = np.ascontiguousarray(x, dtype)
    return *x.shape[1:], x.shape[0], flat.astype(np.float64).ravel() if numbers else flat.tobytes()


def _handed_back(f: pd.DataFrame, columns: list[str], keep: list[str], one: Callable[..., tuple]) -> Iterator[pd.DataFrame]:
    """``one`` on each row's ``columns``, with the columns ``keep``; about ``TOGETHER`` bytes at a time."""
    rest, start, held, done = f[keep], 0, 0, []
    for at, r in enumerate(zip(*(f[n] for n in columns), strict=True), 1):
        done.append(one(*r))
        held += 0 if (v := done[-1][3]) is None else memoryview(v).nbytes
        if held > TOGETHER or at == len(f):
            found = pd.DataFrame(done, columns=["height", "width", "channels", "v"])
            yield pd.concat([rest.iloc[start:at].reset_index(drop=True), found], axis=1)
            start, held, done = at, 0, []


def map_rasters(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """``fn`` on each image as an array (bands, height, width) of float64."""
    rows = rows if "channels" in rows.columns else rows.withColumn("channels", F.lit(1))
    keep = [f for f in rows.schema.fields if f.name not in ("height", "width", "channels", "v")]
    names, read = [f.name for f in keep], ["height", "width", "channels", "v"]

    def one(height: int, width: int, channels: int, v: bytes | np.ndarray | None) -> tuple:
        x = _image(height, width, channels, v, dtype)
        return (height, width, channels, None) if x is None else _row(fn(x), dtype, numbers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from _handed_back(f, read, names, one)

    return rows.select(*names, *read).mapInPandas(run, _schema(keep, numbers))


def _focal(x: np.ndarray, kernel: np.ndarray, dilation: int) -> np.ndarray:
    (kh, kw), (_, height, width) = kernel.shape, x.shape
    top, left = kh // 2 * dilation, kw // 2 * dilation
    padded = np.pad(x, ((0, 0), (top, (kh - 1) * dilation - top), (left, (kw - 1) * dilation - left)))
    out = np.zeros_like(x)
    for i in range(kh):
        for j in range(kw):
            out += kernel[i, j] * padded[:, i * dilation : i * dilation + height, j * dilation : j * dilation + width]
    return out


def focal(rows: DataFrame, kernel: list[list[float]], dilation: int = 1, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """Weighted sum over neighbours ``dilation`` apart, zero outside, in each band."""
    k = np.array(kernel, np.float64)
    return map_rasters(rows, lambda x: _focal(x, k, dilation), dtype, numbers)


def multi_rate_focal(rows: DataFrame, kernel: list[list[float]], rates: tuple[int, ...] = (1, 2, 4, 8), residual: bool = True, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """A cascade of focal sums and ReLU at growing rates; the sum of all steps (and of the input), in one pass."""
    k = np.array(kernel, np.float64)

    def cascade(x: np.ndarray) -> np.ndarray:
        total, step = x if residual else np.zeros_like(x), x
        for rate in rates:
            step = np.maximum(_focal(step, k, rate), 0.0)
            total = total + step
        return total

    return map_rasters(rows, cascade, dtype, numbers)


def block_max(rows: DataFrame, size: int = 2, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """The largest value of each block; blocks at the lower and right edge may be cut."""

    def blocks(x: np.ndarray) -> np.ndarray:
        down = np.maximum.reduceat(x, np.arange(0, x.shape[1], size), axis=1)
        return np.maximum.reduceat(down, np.arange(0, x.shape[2], size), axis=2)

    return map_rasters(rows, blocks, dtype, numbers)


def upsample(rows: DataFrame, kernel: list[list[float]], stride: int = 2, pad: int = 1, out_pad: int = 0, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """Each value adds its kernel at ``stride`` times its place less ``pad``; a place that nothing is added to is 0."""
    k = np.array(kernel, np.float64)

    def spread(x: np.ndarray) -> np.ndarray:
        bands, *shape = x.shape
        full = np.zeros((bands, *[(n - 1) * stride + m + out_pad for n, m in zip(shape, k.shape, strict=True)]))
        for i in range(k.shape[0]):
            for j in range(k.shape[1]):
                full[:, i : i + (shape[0] - 1) * stride + 1 : stride, j : j + (shape[1] - 1) * stride + 1 : stride] += k[i, j] * x
        return full[:, pad : full.shape[1] - pad, pad : full.shape[2] - pad]

    return map_rasters(rows, spread, dtype, numbers)


def bands_first(rows: DataFrame, data: str = "data", dtype: str = "float64") -> DataFrame:
    """Rows with interleaved bytes ``data`` as rows with ``v`` (rows that couldn't be decoded are left out)."""
    read = ["height", "width", "channels", data]
    keep = [f for f in rows.schema.fields if f.name not in read]
    names = [f.name for f in keep]

    def one(h: int, w: int, n: int, d: bytes | None) -> tuple:
        return h, w, n, None if d is None else np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(h, w, n).transpose(2, 0, 1), dtype).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from _handed_back(f, read, names, one)

    return rows.where("height > 0").select(*names, *read).mapInPandas(run, _schema(keep, False))


def binarise_masks(rows: DataFrame, threshold: float = 127.5, invert: bool = False, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """1 where a mask is at least ``threshold``, else 0; ``invert`` changes the two."""
    return map_rasters(rows, lambda x: ((x >= threshold) != invert).astype(np.float64), dtype, numbers)


def band_math(rows: DataFrame, weights: list[list[float]], dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """Linear combinations of the bands, ``weights[out][in]``, within the row."""
    w = np.array(weights, np.float64)
    return map_rasters(rows, lambda x: np.tensordot(w, x, 1), dtype, numbers)


def channel_statistics(rows: DataFrame, dtype: str = "float64") -> DataFrame:
    """ch, mean, var over all images: a row for each image and band is what is shuffled (null payloads have none)."""
    rows = rows if "channels" in rows.columns else rows.withColumn("channels", F.lit(1))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, v in zip(f["channels"], f["v"], strict=True):
                for ch, x in enumerate(np.frombuffer(v, dtype).astype(np.float64).reshape(n, -1)):
                    out.append((ch, x.size, x.mean() if x.size else 0.0, ((x - x.mean()) ** 2).sum() if x.size else 0.0))
            yield pd.DataFrame(out, columns=["ch", "n", "m", "d"])

    each = rows.where("v is not null and height > 0 and width > 0").select("channels", "v").mapInPandas(sums, "ch int, n long, m double, d double")
    # of the images' own means and squared deviations the whole's: what lies within images and what lies between them
    total = each.groupBy("ch").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("d").alias("d"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    mean = F.col("s") / F.col("n")
    return total.select("ch", mean.alias("mean"), F.greatest(F.lit(0.0), (F.col("d") + F.col("q")) / F.col("n") - mean * mean).alias("var"))


def standardise(rows: DataFrame, eps: float = 1e-5, statistics: DataFrame | None = None, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """(value - mean) / sqrt(var + eps) by band; ``statistics``: a saved table (ch, mean, var) for the frozen form. The
    statistics have a row for each band, which bounds what the driver holds."""
    found = statistics if statistics is not None else channel_statistics(rows, dtype)
    known = {r["ch"]: (r["mean"], r["var"]) for r in found.collect()}

    def shift(x: np.ndarray) -> np.ndarray:
        mean, var = (np.array([known[c][k] for c in range(len(x))])[:, None, None] for k in (0, 1))
        return (x - mean) / np.sqrt(var + eps)

    return map_rasters(rows, shift, dtype, numbers)


def zip_rasters(a: DataFrame, b: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str = "image_id", dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """``fn`` on the images that two tables have of one key: one row of each is shuffled, not pixels. Where one payload is
    null, or ``fn`` gives None, the result's is. Columns of ``a`` stay."""
    both = [x if "channels" in x.columns else x.withColumn("channels", F.lit(1)) for x in (a, b)]
    read = ["height", "width", "channels", "v"]
    other = both[1].select(key, *[F.col(n).alias(f"_b_{n}") for n in read])
    joined = both[0].join(other, key)
    keep = [f for f in both[0].schema.fields if f.name not in read]
    names = [f.name for f in keep]

    def one(*r) -> tuple:
        x, y = _image(*r[:4], dtype), _image(*r[4:], dtype)
        z = None if x is None or y is None else fn(x, y)
        return (*r[:3], None) if z is None else _row(z, dtype, numbers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from _handed_back(f, [*read, *(f"_b_{n}" for n in read)], names, one)

    return joined.mapInPandas(run, _schema(keep, numbers))


def raster_add(a: DataFrame, b: DataFrame, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """The sum of two images of one shape; null where the shapes differ."""
    return zip_rasters(a, b, lambda x, y: x + y if x.shape == y.shape else None, dtype=dtype, numbers=numbers)


def concat_channels(a: DataFrame, b: DataFrame, dtype: str = "float64", numbers: bool = False) -> DataFrame:
    """The bands of two images of one size one after the other; null where the sizes differ."""
    return zip_rasters(a, b, lambda x, y: np.concatenate([x, y]) if x.shape[1:] == y.shape[1:] else None, dtype=dtype, numbers=numbers)
