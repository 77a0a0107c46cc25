"""Tile rows: images that are larger than a row should be, as a grid of tiles with whole-image results.

A tile row has image_id, height, width, channels (of the whole image), size (of the grid), tile_r, tile_c (its place in the
grid), r0, c0, h, w (its box in the image) and ``v``: the bands one after the other, each in row-major order, as
little-endian ``dtype``. Tiles at the right and lower edge may be smaller.

What needs other tiles moves pieces of tiles, not pixels: each tile cuts from itself what each other tile needs, sends that
in one shuffle by (image_id, tile_r, tile_c), and a tile puts together the few pieces that reach it: its halo (``focal``,
``multi_rate_focal``, ``upsample``; at most eight neighbours while the margin is below the tile size) or the footprint that
its pixels have in the source (``warp``). The eight views act on boxes and turn each tile in itself, without a shuffle. A
large image's tiles are dealt out like any others.

Defined cases: an image with a null payload is one tile with a null payload and gives null results; images without pixels
(height or width below 1) have no tiles; ``image_id`` tells images apart, a null one like any other value, and tiles of
images that share an id would be mixed, so it must be unique; other columns are dropped (join them by image_id); empty
tables give empty results.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tilewright.functions import draws
from tilewright.operators.augment import ID, affine
from tilewright.operators.augment_rasters import warp_part
from tilewright.operators.score import VIEWS

GRID = ("height", "width", "channels", "size", "tile_r", "tile_c", "r0", "c0", "h", "w")
PLACE = ("height", "width", "channels", "size", "tile_r", "tile_c")
BOX = tuple[int, int, int, int]
#: Pieces or tiles that are handed back together, in bytes about.
TOGETHER = 8 << 20
#: Tiles, and bytes of them about, that are scored together.
TILES, TILE_BYTES = 1024, 8 << 20


def _schema(df: DataFrame, ints: tuple[str, ...]) -> StructType:
    return StructType([df.schema[ID], *(StructField(n, IntegerType()) for n in ints), StructField("v", BinaryType())])


def _mapped(df: DataFrame, schema: StructType, each: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``each`` on a task's rows (named tuples of the columns), which gives rows of ``schema``; handed back by bytes."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            kind = None
            for b in batches:
                kind = kind or namedtuple("Row", b.schema.names)
                yield from map(kind._make, zip(*(c.to_pylist() for c in b.columns), strict=True))

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

        held, n = [], 0
        for r in each(rows()):
            held.append(r)
            n += len(r[-1] or b"")
            if n > TOGETHER or len(held) >= 10_000:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    return df.mapInArrow(run, schema)


def _grouped(df: DataFrame, keys: tuple[str, ...], schema: StructType, fn: Callable[[list[tuple]], tuple | None]) -> DataFrame:
    """``fn`` on the rows of each key, which one shuffle brings together: a row, or none."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, lambda r: tuple(getattr(r, k) for k in keys)):
            if (out := fn(list(group))) is not None:
                yield out

    return _mapped(dealt, schema, each)


def _array(v: bytes | list[float], channels: int, h: int, w: int, dtype: str) -> np.ndarray:
    return (np.frombuffer(v, dtype) if isinstance(v, bytes) else np.array(v, dtype)).reshape(channels, h, w)


def _bytes(x: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


def box_of(place: int, size: int, length: int) -> tuple[int, int]:
    """Begin and end of a tile along one axis."""
    return place * size, min(length, (place + 1) * size)


def cut_tiles(rows: DataFrame, size: int, dtype: str = "float64", interleaved: bool = False) -> DataFrame:
    """Raster rows (image_id, height, width, channels: 1 if absent, v: bytes or an array) as tile rows; ``interleaved``: the
    bands of a pixel are side by side in the bytes."""
    rows = rows if "channels" in rows.columns else rows.withColumn("channels", F.lit(1))
    made = _schema(rows, GRID)

    def each(images: Iterator[tuple]) -> Iterator[tuple]:
        for i, height, width, channels, v in images:
            if v is None:
                yield i, height, width, channels, size, 0, 0, 0, 0, min(size, height), min(size, width), None
                continue
            x = np.frombuffer(v, dtype).reshape(height, width, channels).transpose(2, 0, 1) if interleaved else _array(v, channels, height, width, dtype)
            for a in range(-(-height // size)):
                for b in range(-(-width // size)):
                    (r0, r1), (c0, c1) = box_of(a, size, height), box_of(b, size, width)
                    yield i, height, width, channels, size, a, b, r0, c0, r1 - r0, c1 - c0, _bytes(x[:, r0:r1, c0:c1], dtype)

    return _mapped(rows.where("height > 0 and width > 0").select(ID, "height", "width", "channels", "v"), made, each)


def join_tiles(tiles: DataFrame, dtype: str = "float64") -> DataFrame:
    """Tile rows put together to raster rows: the way back for images that fit a row."""
    made = StructType([tiles.schema[ID], *(StructField(n, IntegerType()) for n in ("height", "width", "channels")), StructField("v", BinaryType())])

    def whole(group: list[tuple]) -> tuple:
        i, height, width, channels = group[0][:4]
        if any(t.v is None for t in group):
            return i, height, width, channels, None
        out = np.zeros((channels, height, width), dtype)
        for t in group:
            out[:, t.r0 : t.r0 + t.h, t.c0 : t.c0 + t.w] = _array(t.v, channels, t.h, t.w, dtype)
        return i, height, width, channels, out.tobytes()

    return _grouped(tiles.select(ID, *GRID, "v"), (ID,), made, whole)


# pieces ----------------------------------------------------------------------------------------------------------

_PIECE = ("height", "width", "channels", "size", "tile_r", "tile_c", "p_r", "p_c", "p_h", "p_w")


def exchange(tiles: DataFrame, send: Callable[..., Iterator[tuple[int, int, BOX]]], extra: tuple[str, ...] = (), dtype: str = "float64") -> DataFrame:
    """Pieces for each target tile: (image_id, the target's grid columns, p_r, p_c, p_h, p_w: the piece's box in the image,
    v). ``send`` gets a tile's row (grid columns, then ``extra``) and gives (tile_r, tile_c, box within the tile's own). Each
    tile sends at least an empty piece to its own place, so that no target is missing."""
    made = StructType([*_schema(tiles, _PIECE).fields[:-1], *[tiles.schema[n] for n in extra], StructField("v", BinaryType())])

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            i, height, width, channels, size, a, b, r0, c0, h, w, *more, v = row
            grid = (i, height, width, channels, size)
            yield *grid, a, b, r0, c0, 0, 0, *more, None if v is None else b""
            if v is None:
                continue
            x = _array(v, channels, h, w, dtype)
            for to_r, to_c, (top, left, bottom, right) in send(row):
                part = x[:, top - r0 : bottom - r0, left - c0 : right - c0]
                yield *grid, to_r, to_c, top, left, bottom - top, right - left, *more, _bytes(part, dtype)

    return _mapped(tiles.select(ID, *GRID, *extra, "v"), made, each)


def assemble(pieces: DataFrame, fn: Callable[..., tuple[BOX, np.ndarray] | None], extra: tuple[str, ...] = (), dtype: str = "float64", out_dtype: str | None = None, shape: Callable[[int, int], tuple[int, int]] | None = None, scale: int = 1) -> DataFrame:
    """Target tiles of pieces: ``fn(row, box, canvas)`` gets the target's grid columns and the array of the smallest box
    that holds its pieces (zero where there is none) and gives the result's box and array. A tile has nine pieces or some
    more, so a group is small whatever the image's size. ``shape`` gives the result's image size and ``scale`` its grid's."""
    made = StructType([*_schema(pieces, GRID).fields])

    def tile(group: list[tuple]) -> tuple | None:
        row = group[0]
        height, width = shape(row.height, row.width) if shape else (row.height, row.width)
        where = (row[0], height, width, row.channels, row.size * scale, row.tile_r, row.tile_c)
        if any(p.v is None for p in group):
            (r0, r1), (c0, c1) = box_of(row.tile_r, row.size * scale, height), box_of(row.tile_c, row.size * scale, width)
            return *where, r0, c0, r1 - r0, c1 - c0, None
        group = [p for p in group if p.p_h]
        top, left = (min((getattr(p, n) for p in group), default=0) for n in ("p_r", "p_c"))
        bottom, right = (max((getattr(p, a) + getattr(p, b) for p in group), default=0) for a, b in (("p_r", "p_h"), ("p_c", "p_w")))
        canvas = np.zeros((row.channels, bottom - top, right - left), dtype)
        for p in group:
            canvas[:, p.p_r - top : p.p_r - top + p.p_h, p.p_c - left : p.p_c - left + p.p_w] = _array(p.v, row.channels, p.p_h, p.p_w, dtype)
        found = fn(row, (top, left, bottom, right), canvas)
        if found is None:
            return None
        (r0, c0, r1, c1), x = found
        return *where, r0, c0, r1 - r0, c1 - c0, _bytes(x, out_dtype or dtype)

    return _grouped(pieces, (ID, "tile_r", "tile_c"), made, tile)


# neighbourhoods --------------------------------------------------------------------------------------------------


def _halo(margin: BOX) -> Callable[..., Iterator[tuple[int, int, BOX]]]:
    """Sends what lies within ``margin`` (above, left, below, right) of other tiles, and all of a tile to itself."""
    above, left, below, right = margin

    def send(row) -> Iterator[tuple[int, int, BOX]]:
        size, rows, cols = row.size, -(-row.height // row.size), -(-row.width // row.size)
        # a target's box grows by the margin; so a tile reaches the targets within the margin the other way round
        for a in range(max(0, (row.r0 - below) // size), min(rows - 1, (row.r0 + row.h - 1 + above) // size) + 1):
            for b in range(max(0, (row.c0 - right) // size), min(cols - 1, (row.c0 + row.w - 1 + left) // size) + 1):
                (r0, r1), (c0, c1) = box_of(a, size, row.height), box_of(b, size, row.width)
                box = max(row.r0, r0 - above), max(row.c0, c0 - left), min(row.r0 + row.h, r1 + below), min(row.c0 + row.w, c1 + right)
                if box[0] < box[2] and box[1] < box[3]:
                    yield a, b, box

    return send


def _padded(row, box: BOX, canvas: np.ndarray, margin: BOX) -> tuple[BOX, np.ndarray]:
    """The tile's box and its canvas with the margin around, zero outside the image."""
    (r0, r1), (c0, c1) = box_of(row.tile_r, row.size, row.height), box_of(row.tile_c, row.size, row.width)
    top, left, bottom, right = r0 - margin[0], c0 - margin[1], r1 + margin[2], c1 + margin[3]
    out = np.pad(canvas.astype(np.float64), ((0, 0), (box[0] - max(top, 0) + max(0, -top), bottom - box[2]), (box[1] - max(left, 0) + max(0, -left), right - box[3])))
    return (r0, c0, r1, c1), out


def _margin(kernel: np.ndarray, dilation: int) -> BOX:
    (kh, kw) = kernel.shape
    above, left = kh // 2 * dilation, kw // 2 * dilation
    return above, left, (kh - 1) * dilation - above, (kw - 1) * dilation - left


def _valid(x: np.ndarray, kernel: np.ndarray, dilation: int) -> np.ndarray:
    """Focal sums where the kernel lies within ``x``."""
    kh, kw = kernel.shape
    h, w = x.shape[1] - (kh - 1) * dilation, x.shape[2] - (kw - 1) * dilation
    out = np.zeros((len(x), h, w))
    for i in range(kh):
        for j in range(kw):
            out += kernel[i, j] * x[:, i * dilation : i * dilation + h, j * dilation : j * dilation + w]
    return out


def focal(tiles: DataFrame, kernel: list[list[float]], dilation: int = 1, dtype: str = "float64") -> DataFrame:
    """Weighted sum over neighbours ``dilation`` apart, zero outside the image, in each band."""
    k = np.array(kernel, np.float64)
    margin = _margin(k, dilation)

    def fn(row, box: BOX, canvas: np.ndarray) -> tuple[BOX, np.ndarray]:
        own, x = _padded(row, box, canvas, margin)
        return own, _valid(x, k, dilation)

    return assemble(exchange(tiles, _halo(margin), dtype=dtype), fn, dtype=dtype)


def multi_rate_focal(tiles: DataFrame, kernel: list[list[float]], rates: tuple[int, ...] = (1, 2, 4, 8), residual: bool = True, dtype: str = "float64") -> DataFrame:
    """A cascade of focal sums and ReLU at growing rates; the sum of all steps (and of the input). One exchange of the
    cascade's whole margin; what a step gives outside the image is zero again, as in the whole image."""
    k = np.array(kernel, np.float64)
    each = [_margin(k, r) for r in rates]
    margin: BOX = tuple(sum(m[i] for m in each) for i in range(4))  # type: ignore[assignment]

    def fn(row, box: BOX, canvas: np.ndarray) -> tuple[BOX, np.ndarray]:
        own, step = _padded(row, box, canvas, margin)
        r0, c0, r1, c1 = own
        top, left = r0 - margin[0], c0 - margin[1]
        crop = lambda x, top, left: x[:, r0 - top : r1 - top, c0 - left : c1 - left]
        total = crop(step, top, left) if residual else np.zeros((len(step), r1 - r0, c1 - c0))
        for rate, (above, before, _, _) in zip(rates, each, strict=True):
            step = np.maximum(_valid(step, k, rate), 0.0)
            top, left = top + above, left + before
            r, c = np.arange(step.shape[1]) + top, np.arange(step.shape[2]) + left
            step *= ((r >= 0) & (r < row.height))[:, None] & ((c >= 0) & (c < row.width))[None, :]
            total = total + crop(step, top, left)
        return own, total

    return assemble(exchange(tiles, _halo(margin), dtype=dtype), fn, dtype=dtype)


def upsample(tiles: DataFrame, kernel: list[list[float]], stride: int = 2, pad: int = 1, out_pad: int = 0, dtype: str = "float64") -> DataFrame:
    """Each value adds its kernel at ``stride`` times its place less ``pad``; a place that nothing is added to is 0. The
    result's tiles are ``stride`` times as large; a result without rows or columns has no tiles."""
    k = np.array(kernel, np.float64)
    shape = lambda *n: tuple((x - 1) * stride - 2 * pad + m + out_pad for x, m in zip(n, k.shape, strict=True))

    def reached(begin: int, end: int, axis: int, side: int, out: int) -> range:
        """The result's tiles that the values of a stretch add to."""
        low, high = begin * stride - pad, (end - 1) * stride - pad + k.shape[axis] - 1
        return range(max(0, low // side), min(-(-out // side) - 1, high // side) + 1)

    def needed(place: int, axis: int, side: int, out: int) -> tuple[int, int]:
        """The values that add to a tile of the result."""
        begin, end = box_of(place, side, out)
        return -((k.shape[axis] - 1 - begin - pad) // stride), (end - 1 + pad) // stride + 1

    def send(row) -> Iterator[tuple[int, int, BOX]]:
        side, (height, width) = row.size * stride, shape(row.height, row.width)
        for a in reached(row.r0, row.r0 + row.h, 0, side, height):
            for b in reached(row.c0, row.c0 + row.w, 1, side, width):
                (r0, r1), (c0, c1) = needed(a, 0, side, height), needed(b, 1, side, width)
                box = max(row.r0, r0), max(row.c0, c0), min(row.r0 + row.h, r1), min(row.c0 + row.w, c1)
                if box[0] < box[2] and box[1] < box[3]:
                    yield a, b, box
        if row.tile_r == row.tile_c == 0:  # tiles of the result that nothing is added to, or that the grid doesn't have
            for a in range(-(-height // side)):
                for b in range(-(-width // side)):
                    yield a, b, (row.r0, row.c0, row.r0, row.c0)

    def fn(row, box: BOX, canvas: np.ndarray) -> tuple[BOX, np.ndarray] | None:
        height, width = shape(row.height, row.width)
        (r0, r1), (c0, c1) = box_of(row.tile_r, row.size * stride, height), box_of(row.tile_c, row.size * stride, width)
        if r0 >= r1 or c0 >= c1:
            return None
        out = np.zeros((row.channels, r1 - r0, c1 - c0))

        def stretch(first: int, n: int, step: int, begin: int, size: int) -> tuple[slice, slice]:
            """Of ``n`` values from ``first`` those that a kernel place adds to a result's stretch, and where."""
            off = first * stride + step - pad - begin
            low, high = max(0, -(off // stride)), min(n, (size - 1 - off) // stride + 1)
            return slice(low, max(low, high)), slice(low * stride + off, max(low, high) * stride + off, stride) if high > low else slice(0, 0)

        for i in range(k.shape[0]):
            for j in range(k.shape[1]):
                (src_r, to_r), (src_c, to_c) = stretch(box[0], canvas.shape[1], i, r0, r1 - r0), stretch(box[1], canvas.shape[2], j, c0, c1 - c0)
                if src_r.start < src_r.stop and src_c.start < src_c.stop:
                    out[:, to_r, to_c] += k[i, j] * canvas[:, src_r, src_c]
        return (r0, c0, r1, c1), out

    return assemble(exchange(tiles, send, dtype=dtype), fn, dtype=dtype, shape=shape, scale=stride)


# geometry --------------------------------------------------------------------------------------------------------

_AFFINE = ("m_a", "m_b", "m_c", "m_d", "m_x", "m_y")


def footprint(m: tuple[float, ...], box: BOX, height: int, width: int) -> BOX:
    """The box of the source pixels that the inverse mapping of a target box may read."""
    a, b, c, d, dx, dy = m
    cx, cy, det = width // 2, height // 2, a * d - b * c
    x, y = (np.array(v, np.float64) for v in zip(*[(col - cx - dx, row - cy - dy) for row in (box[0], box[2] - 1) for col in (box[1], box[3] - 1)], strict=True))
    sx, sy = (d * x - b * y) / det + cx, (a * y - c * x) / det + cy
    low = lambda v: int(np.floor(v.min() - 1e-6))
    high = lambda v: int(np.floor(v.max() + 1e-6)) + 2
    return max(0, low(sy)), max(0, low(sx)), min(height, high(sy)), min(width, high(sx))


def random_ssr(tiles: DataFrame, border: float = 0.0, u: float = 0.5, seed: int = 42, epoch: int = 0, **ranges) -> DataFrame:
    """Shift, scale, aspect and turn gated images of byte tiles (dtype uint8): inverse mapping, bilinear, ``border`` outside.

    A tile is mapped forward to find the targets it may reach, and sends to each what lies in that target's footprint in the
    source. Images that aren't gated aren't shuffled.
    """
    how = {"seed": seed, "epoch": epoch}
    on = draws.gate(F.col(ID), "ssr", u, **how)
    drawn = tiles.where(on).withColumns(affine((F.col("height"), F.col("width")), **how, **ranges))

    def send(row) -> Iterator[tuple[int, int, BOX]]:
        m = tuple(getattr(row, n) for n in _AFFINE)
        a, b, c, d, dx, dy = m
        cx, cy = row.width // 2, row.height // 2
        x, y = (np.array(v, np.float64) for v in zip(*[(col - cx, r - cy) for r in (row.r0 - 1, row.r0 + row.h) for col in (row.c0 - 1, row.c0 + row.w)], strict=True))
        to_c, to_r = a * x + b * y + cx + dx, c * x + d * y + cy + dy
        tiles_of = lambda v, n: range(max(0, int(np.floor(v.min())) // row.size), min(-(-n // row.size) - 1, int(np.ceil(v.max())) // row.size) + 1)
        for i in tiles_of(to_r, row.height):
            for j in tiles_of(to_c, row.width):
                (r0, r1), (c0, c1) = box_of(i, row.size, row.height), box_of(j, row.size, row.width)
                need = footprint(m, (r0, c0, r1, c1), row.height, row.width)
                box = max(row.r0, need[0]), max(row.c0, need[1]), min(row.r0 + row.h, need[2]), min(row.c0 + row.w, need[3])
                if box[0] < box[2] and box[1] < box[3]:
                    yield i, j, box

    def fn(row, box: BOX, canvas: np.ndarray) -> tuple[BOX, np.ndarray]:
        (r0, r1), (c0, c1) = box_of(row.tile_r, row.size, row.height), box_of(row.tile_c, row.size, row.width)
        out = warp_part(canvas.transpose(1, 2, 0), box[:2], (r0, c0, r1, c1), (row.height, row.width), *(getattr(row, n) for n in _AFFINE), border)
        return (r0, c0, r1, c1), out.transpose(2, 0, 1)

    warped = assemble(exchange(drawn, send, _AFFINE, "uint8"), fn, _AFFINE, "uint8")
    return warped.unionByName(tiles.where(~on).select(ID, *GRID, "v"))


# the eight views -------------------------------------------------------------------------------------------------


def _seen(box: BOX, height: int, width: int, view: int) -> BOX:
    """Where a box of the image lies in a view (bit 0: quarter turn against the clock, then bit 1: vertical, bit 2:
    horizontal flip)."""
    r0, c0, r1, c1 = box
    if view & 1:
        r0, c0, r1, c1 = width - c1, r0, width - c0, r1
        height, width = width, height
    if view & 2:
        r0, r1 = height - r1, height - r0
    if view & 4:
        c0, c1 = width - c1, width - c0
    return r0, c0, r1, c1


def _to_view(x: np.ndarray, view: int) -> np.ndarray:
    x = np.rot90(x, axes=(-2, -1)) if view & 1 else x
    x = x[..., ::-1, :] if view & 2 else x
    return x[..., ::-1] if view & 4 else x


def _from_view(x: np.ndarray, view: int) -> np.ndarray:
    x = x[..., ::-1] if view & 4 else x
    x = x[..., ::-1, :] if view & 2 else x
    return np.rot90(x, -1, axes=(-2, -1)) if view & 1 else x


def view_tiles(tiles: DataFrame, dtype: str = "float64") -> DataFrame:
    """Each tile in the eight views, with ``view``: its box, its place in the grid of boxes and its pixels turned and
    flipped; height and width of the view. Places count tiles, so they are those of a grid that may begin with the smaller
    tiles. Nothing is shuffled."""
    made = _schema(tiles, ("view", *GRID))

    def fn(row) -> Iterator[tuple]:
        for view in VIEWS:
            box = _seen((row.r0, row.c0, row.r0 + row.h, row.c0 + row.w), row.height, row.width, view)
            height, width = (row.width, row.height) if view & 1 else (row.height, row.width)
            a, b, *_ = _seen((row.tile_r, row.tile_c, row.tile_r + 1, row.tile_c + 1), -(-row.height // row.size), -(-row.width // row.size), view)
            v = None if row.v is None else _bytes(_to_view(_array(row.v, row.channels, row.h, row.w, dtype), view), dtype)
            yield row[0], view, height, width, row.channels, row.size, a, b, box[0], box[1], box[2] - box[0], box[3] - box[1], v

    return _mapped(tiles.select(ID, *GRID, "v"), made, lambda rows: (out for row in rows for out in fn(row)))


def unview_tiles(tiles: DataFrame, dtype: str = "float64") -> DataFrame:
    """Undo ``view_tiles``; ``view`` stays."""
    made = _schema(tiles, ("view", *GRID))

    def back(box: BOX, height: int, width: int, view: int) -> BOX:
        """The flips undone, then the turn; ``height`` and ``width`` are the view's."""
        r0, c0, r1, c1 = _seen(box, height, width, view & 6)
        return (c0, height - r1, c1, height - r0) if view & 1 else (r0, c0, r1, c1)

    def fn(row) -> Iterator[tuple]:
        box = back((row.r0, row.c0, row.r0 + row.h, row.c0 + row.w), row.height, row.width, row.view)
        height, width = (row.width, row.height) if row.view & 1 else (row.height, row.width)
        a, b, *_ = back((row.tile_r, row.tile_c, row.tile_r + 1, row.tile_c + 1), -(-row.height // row.size), -(-row.width // row.size), row.view)
        v = None if row.v is None else _bytes(_from_view(_array(row.v, row.channels, row.h, row.w, dtype), row.view), dtype)
        yield row[0], row.view, height, width, row.channels, row.size, a, b, box[0], box[1], box[2] - box[0], box[3] - box[1], v

    return _mapped(tiles.select(ID, "view", *GRID, "v"), made, lambda rows: (out for row in rows for out in fn(row)))


def merge_views(tiles: DataFrame, dtype: str = "float64") -> DataFrame:
    """The sum of a tile's views: one shuffle of tiles, eight rows a group."""
    made = _schema(tiles, GRID)

    def total(group: list[tuple]) -> tuple:
        v = None if any(t.v is None for t in group) else _bytes(sum(np.frombuffer(t.v, dtype) for t in sorted(group, key=lambda t: t.view)), dtype)
        return *group[0][: len(GRID) + 1], v

    return _grouped(tiles.select(ID, *GRID, "view", "v"), (ID, "tile_r", "tile_c"), made, total)


#: Called without arguments on a worker; gives a function of a normalised tile (bands, h, w) and its first row and column in
#: the image (or view) to probabilities (h, w). If the function has an attribute ``many``, that takes tiles of one shape
#: (n, bands, h, w) and arrays of their first rows and columns to (n, h, w).
TilePredictorFactory = Callable[[], Callable[[np.ndarray, int, int], np.ndarray]]


def logistic_tiles(bias: float = 0.1, weights: tuple[float, ...] = (0.8,), by_row: float = 0.05, by_col: float = -0.03) -> TilePredictorFactory:
    """The small logistic model of ``score``, which depends on the position, on tiles."""

    def factory() -> Callable[[np.ndarray, int, int], np.ndarray]:
        def predict(x: np.ndarray, r0: int, c0: int) -> np.ndarray:
            return many(x[None], np.array([r0]), np.array([c0]))[0]

        def many(x: np.ndarray, r0: np.ndarray, c0: np.ndarray) -> np.ndarray:
            r, c = np.arange(x.shape[2])[:, None] + r0[:, None, None], np.arange(x.shape[3])[None, :] + c0[:, None, None]
            return 1 / (1 + np.exp(-(bias + np.tensordot(x, np.asarray(weights), (1, 0)) + by_row * r + by_col * c)))

        predict.many = many
        return predict

    return factory


def score_tiles(tiles: DataFrame, factory: TilePredictorFactory, views: bool = False, data_dtype: str = "uint8", dtype: str = "float32") -> DataFrame:
    """Byte tiles to tiles of probabilities (one band, ``dtype``); ``views``: the sum of the eight views, all of a tile within
    one task, so nothing is shuffled. For a predictor that looks around, cut tiles with its margin (``cut_tiles`` of a
    larger size) and crop. A column ``view`` stays."""
    more = ("view",) if "view" in tiles.columns else ()
    made = _schema(tiles, (*more, *GRID))

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        predict, at = factory(), 1 + len(more)
        for row in rows:
            q = None
            if row.v is not None:
                x = _array(row.v, row.channels, row.h, row.w, data_dtype).astype(dtype) / 255.0 * 3.2 - 1.6
                q = 0
                for view in VIEWS if views else (0,):
                    r0, c0, *_ = _seen((row.r0, row.c0, row.r0 + row.h, row.c0 + row.w), row.height, row.width, view)
                    q = q + _from_view(predict(np.ascontiguousarray(_to_view(x, view)), r0, c0), view)
                q = _bytes(q, dtype)
            yield *row[: at + 2], 1, *row[at + 3 : at + 10], q

    return _mapped(tiles.select(ID, *more, *GRID, "v"), made, each)


def _some(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows by some ``TILES`` and ``TILE_BYTES``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row.v or b"")
        if len(held) >= TILES or n >= TILE_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def score_each_view(tiles: DataFrame, factory: TilePredictorFactory, data_dtype: str = "uint8", dtype: str = "float32") -> DataFrame:
    """Byte tiles to eight rows of probabilities each, with ``view``: what ``view_tiles``, ``score_tiles`` and
    ``unview_tiles`` give one after the other, in one pass through Python. Tiles of one shape are turned and (by a predictor
    with ``many``) scored together."""
    made = _schema(tiles, ("view", *GRID))

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        predict = factory()
        many = getattr(predict, "many", None) or (lambda x, r0, c0: np.stack([predict(*one) for one in zip(x, r0.tolist(), c0.tolist(), strict=True)]))
        for held in _some(rows):
            shapes: dict = {}
            for row in held:
                shapes.setdefault((row.channels, row.h, row.w, row.v is None), []).append(row)
            for (channels, h, w, none), same in shapes.items():
                x = None if none else np.stack([_array(t.v, channels, h, w, data_dtype) for t in same]).astype(dtype) / 255.0 * 3.2 - 1.6
                for view in VIEWS:
                    q = [None] * len(same)
                    if x is not None:
                        at = np.array([_seen((t.r0, t.c0, t.r0 + h, t.c0 + w), t.height, t.width, view)[:2] for t in same])
                        found = _from_view(many(np.ascontiguousarray(_to_view(x, view)), at[:, 0], at[:, 1]), view)
                        q = [_bytes(one, dtype) for one in found]
                    for t, v in zip(same, q, strict=True):
                        yield t[0], view, t.height, t.width, 1, *t[4:11], v

    return _mapped(tiles.select(ID, *GRID, "v"), made, each)


def tile_pixels(tiles: DataFrame, dtype: str = "float64") -> DataFrame:
    """Tile rows as a pixel table: image_id, ch, r, c, v (tiles with a null payload have no pixels)."""

    @F.pandas_udf("array<double>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, dtype).astype(np.float64) if b is not None else None)

    e = tiles.select(*[n for n in (ID, "view") if n in tiles.columns], "h", "w", "r0", "c0", F.posexplode(unpack("v")).alias("p", "v"))
    area = F.col("h") * F.col("w")
    where = F.col("p") % area
    return e.select(*[n for n in (ID, "view") if n in tiles.columns], F.floor(F.col("p") / area).cast("int").alias("ch"), (F.col("r0") + F.floor(where / F.col("w"))).cast("int").alias("r"), (F.col("c0") + where % F.col("w")).alias("c"), "v")
