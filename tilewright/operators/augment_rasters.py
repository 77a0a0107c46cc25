"""The training augmentations on raster rows: one image and its mask a row, any shape, bytes in and out.

The draws of ``augment`` are columns, made once for each image; the pixels are NumPy work within the row, so nothing is
shuffled. Results equal the pixel-table form's.

Defined cases: rows that couldn't be decoded (height, width or channels below 1 or null, null data, or data of another length than
height x width x channels) are left out, as in scoring; grey images (one band) become three equal bands, of four bands the
first three count; a null mask, or one that hasn't one, three or four bands of the image's shape, gives a null ``t`` (of
three or four bands the luma counts); a null id has draws like any other value; repeated rows give repeated results; other
columns are dropped; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import draws
from tilewright.operators.augment import ID, affine, chances

#: Bytes of results that are handed back together.
TOGETHER = 4 << 20
#: Weights of blue, green and red in a grey value.
LUMA = np.array([0.114, 0.587, 0.299])
OUT = "image_id {}, height int, width int, channels int, x binary, t binary"


def with_parameters(rows: DataFrame, hue=(-30, 30), sat=(-5, 5), val=(-15, 15), u: float | Mapping[str, float] = 0.5, seed: int = 42, epoch: int = 0, **ranges) -> DataFrame:
    """``rows`` (image_id, height, width) with the draws of the whole pipeline as columns. ``u``: the probability of every
    step, or of each by its name (``STEPS``; 0.5 for those that it doesn't name)."""
    i, how = F.col(ID), {"seed": seed, "epoch": epoch}
    gates = {f"on_{n}": draws.gate(i, n, p, **how) for n, p in chances(u).items()}
    shifts = {"d_hue": draws.integer(i, "hue", *hue, **how), "d_sat": draws.uniform(i, "sat", *sat, **how), "d_val": draws.uniform(i, "val", *val, **how)}
    return rows.withColumns(gates | shifts | affine((F.col("height"), F.col("width")), **how, **ranges))


def to_hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0-179), saturation and value of blue, green, red bytes (height, width, 3); rounding half up."""
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    v, d = image.max(2).astype(np.float64), np.ptp(image, axis=2).astype(np.float64)
    safe = np.maximum(d, 1)
    deg = np.select([d == 0, v == r, v == g], [0.0, 60.0 * (g - b) / safe, 120.0 + 60.0 * (b - r) / safe], 240.0 + 60.0 * (r - g) / safe)
    deg = np.where(deg < 0, deg + 360.0, deg)
    return np.floor(deg / 2 + 0.5) % 180, np.where(v == 0, 0, np.floor(255.0 * d / np.maximum(v, 1) + 0.5)), v


def to_bgr(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    at = h / 30.0
    sector, f, sat = np.floor(at) % 6, at - np.floor(at), s / 255.0
    p, q, t = v * (1 - sat), v * (1 - sat * f), v * (1 - sat * (1 - f))
    by = {0: (p, t, v), 1: (p, v, q), 2: (t, v, p), 3: (v, q, p), 4: (v, p, t), 5: (q, p, v)}
    return np.stack([np.floor(np.select([sector == k for k in by], [x[c] for x in by.values()]) + 0.5) for c in range(3)], 2).astype(np.uint8)


def shift_hsv(image: np.ndarray, hue: float, sat: float, val: float, hue_wrap: int = 256) -> np.ndarray:
    h, s, v = to_hsv(image)
    add = lambda x, d: np.clip(np.floor(x + d + 0.5), 0, 255)
    return to_bgr((h + hue) % hue_wrap, add(s, sat), add(v, val))


def warp_part(source: np.ndarray, at: tuple[int, int], box: tuple[int, int, int, int], shape: tuple[int, int], a: float, b: float, c: float, d: float, dx: float, dy: float, border: float = 0.0) -> np.ndarray:
    """A box (first row and column, end) of the inverse mapping of an image about its centre, bilinear, ``border`` outside.

    ``source`` (height, width, bands) bytes is the part of the image that begins ``at`` and holds all pixels that are read.
    """
    height, width = shape
    cx, cy, det = width // 2, height // 2, a * d - b * c
    x, y = np.arange(box[1], box[3])[None, :] - cx - dx, np.arange(box[0], box[2])[:, None] - cy - dy
    sx, sy = (d * x - b * y) / det + cx, (a * y - c * x) / det + cy
    x0, y0 = np.floor(sx), np.floor(sy)
    fx, fy = sx - x0, sy - y0
    out = np.zeros((*x0.shape, source.shape[2]))
    for j in (0, 1):
        for i in (0, 1):
            r, k = (y0 + j).astype(np.int64), (x0 + i).astype(np.int64)
            inside = (r >= 0) & (r < height) & (k >= 0) & (k < width)
            value = np.full(out.shape, float(border))
            value[inside] = source[r[inside] - at[0], k[inside] - at[1]]
            out += ((fx if i else 1 - fx) * (fy if j else 1 - fy))[..., None] * value
    return np.floor(np.round(out, 9) + 0.5).astype(np.uint8)


def warp(image: np.ndarray, *matrix: float) -> np.ndarray:
    """``warp_part`` of a whole image; ``matrix``: a, b, c, d, dx, dy and the border."""
    return warp_part(image, (0, 0), (0, 0, *image.shape[:2]), image.shape[:2], *matrix)


def turned(image: np.ndarray, hflip: bool, vflip: bool, rot90: bool) -> np.ndarray:
    image = image[:, ::-1] if hflip else image
    image = image[::-1] if vflip else image
    return np.rot90(image) if rot90 else image


def three_bands(data: bytes | None, height: int, width: int, channels: int) -> np.ndarray | None:
    """(height, width, 3) of an image's bytes, or None where they don't fit."""
    if data is None or len(data) != height * width * channels:
        return None
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image[..., :3] if channels >= 3 else np.repeat(image[..., :1], 3, axis=2)


def one_band(mask: bytes | None, height: int, width: int) -> np.ndarray | None:
    """(height, width, 1) of a mask's bytes, or None where they don't fit."""
    bands = len(mask) // (height * width) if mask is not None and len(mask) % (height * width) == 0 else 0
    if bands not in (1, 3, 4):
        return None
    m = np.frombuffer(mask, np.uint8).reshape(height, width, bands)
    return m if bands == 1 else np.floor(m[..., :3].astype(np.float64) @ LUMA + 0.5).astype(np.uint8)[..., None]


def augment_rasters(rows: DataFrame, hue_wrap: int = 256, border: float = 0.0, dtype: str = "float32", **how) -> DataFrame:
    """image_id, height, width, channels (3 if absent), data (blue, green, red bytes) and mask (grey bytes) through colour,
    geometry, flips and turn to image_id, height, width, channels, x (normalised, bands first, little-endian ``dtype``) and t
    (0 and 1 bytes).

    A turned image's height and width change places. ``how``: ranges, u, seed, epoch of ``with_parameters``.
    """
    rows = rows if "channels" in rows.columns else rows.withColumn("channels", F.lit(3))
    good = rows.where("height > 0 and width > 0 and channels > 0 and data is not null").select(ID, "height", "width", "channels", "data", "mask")
    drawn = with_parameters(good, **how)

    def one(r) -> tuple | None:
        image, mask = three_bands(r.data, r.height, r.width, r.channels), one_band(r.mask, r.height, r.width)
        if image is None:
            return None
        if r.on_hsv:
            image = shift_hsv(image, r.d_hue, r.d_sat, r.d_val, hue_wrap)
        pair = [image] if mask is None else [image, mask]
        if r.on_ssr:
            pair = [warp(x, r.m_a, r.m_b, r.m_c, r.m_d, r.m_x, r.m_y, border) for x in pair]
        image, *mask = (turned(x, r.on_hflip, r.on_vflip, r.on_rot90) for x in pair)
        x = image.transpose(2, 0, 1).astype(dtype) / 255.0 * 3.2 - 1.6
        return r.image_id, *image.shape[:2], 3, np.ascontiguousarray(x, dtype).tobytes(), (mask[0] >= 128).astype(np.uint8).tobytes() if mask else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["image_id", "height", "width", "channels", "x", "t"]
        for f in frames:
            out, held = [], 0
            for r in f.itertuples(index=False):
                if (done := one(r)) is None:
                    continue
                out.append(done)
                held += len(done[4])
                if held > TOGETHER:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    return drawn.mapInPandas(run, OUT.format(dict(rows.dtypes)[ID]))
