"""The eight symmetries of a rectangle as a group: chains of flips and turns become one element before any projection.

An element is a number from 0 to 7, the view of that number in ``score``: a quarter turn against the clock if bit 0 is set,
then a vertical flip if bit 1 is, then a horizontal one if bit 2 is. ``TABLE[b][a]`` is the element that does ``a``, then
``b``. On pixel tables an element is one projection of row and column; on arrays in row-major order one permutation by
``transform(sequence)``. Images may have any shape; the odd elements change height and width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import draws
from tilewright.operators.augment import ID, STEPS, chances

IDENTITY, NAMES = 0, {"rot90": 1, "vflip": 2, "hflip": 4, "rot180": 6}


def _matrix(k: int) -> tuple[int, int, int, int]:
    """What an element does to (row, column) about the centre."""
    a, b, c, d = (0, -1, 1, 0) if k & 1 else (1, 0, 0, 1)
    rows, cols = -1 if k & 2 else 1, -1 if k & 4 else 1
    return rows * a, rows * b, cols * c, cols * d


def _product(p: tuple[int, ...], q: tuple[int, ...]) -> tuple[int, int, int, int]:
    return p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]


_NUMBER = {_matrix(k): k for k in range(8)}
TABLE = [[_NUMBER[_product(_matrix(b), _matrix(a))] for a in range(8)] for b in range(8)]
INVERSE = [next(b for b in range(8) if TABLE[b][a] == IDENTITY) for a in range(8)]


def chain(*steps: str | int) -> int:
    """The element that does ``steps`` (names or elements) one after the other."""
    out = IDENTITY
    for s in steps:
        out = TABLE[NAMES[s] if isinstance(s, str) else s][out]
    return out


def then(first: Column, second: Column | int) -> Column:
    """The element of two elements that are columns, by the table."""
    table = F.array(*[F.lit(x) for row in TABLE for x in row])
    return table[(second if isinstance(second, Column) else F.lit(second)) * 8 + first]


def _bit(k: Column | int, n: int) -> Column:
    return (k if isinstance(k, Column) else F.lit(k)).bitwiseAND(F.lit(1 << n)) > 0


def place(k: Column | int, r: Column, c: Column, height: Column | int, width: Column | int) -> tuple[Column, Column]:
    """Where an element takes row and column of an image of this shape."""
    height, width = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    if isinstance(k, int):
        r, c, height, width = (width - 1 - c, r, width, height) if k & 1 else (r, c, height, width)
        return height - 1 - r if k & 2 else r, width - 1 - c if k & 4 else c
    turned = _bit(k, 0)
    row, col = F.when(turned, width - 1 - c).otherwise(r), F.when(turned, r).otherwise(c)
    h, w = F.when(turned, width).otherwise(height), F.when(turned, height).otherwise(width)
    return F.when(_bit(k, 1), h - 1 - row).otherwise(row), F.when(_bit(k, 2), w - 1 - col).otherwise(col)


def apply(pixels: DataFrame, k: Column | int, shape: tuple[int, int]) -> DataFrame:
    """A pixel table under an element (a number or a column): one projection."""
    r, c = place(k, F.col("r"), F.col("c"), *shape)
    return pixels.withColumns({"r": r.cast(dict(pixels.dtypes)["r"]), "c": c.cast(dict(pixels.dtypes)["c"])})


def drawn(u: float | dict[str, float] = 0.5, seed: int = 42, epoch: int = 0, key: str = ID) -> Column:
    """The element of the gated flips and turn of an image (``STEPS`` of ``augment``), from the same draws."""
    out: Column = F.lit(IDENTITY)
    for name in STEPS[2:]:
        out = then(out, F.when(draws.gate(F.col(key), name, chances(u)[name], seed, epoch), NAMES[name]).otherwise(IDENTITY))
    return out


def random_turns(pixels: DataFrame, shape: tuple[int, int], **how) -> DataFrame:
    """``random_hflip``, ``random_vflip`` and ``random_rot90`` in one projection, with equal results."""
    folded = pixels.withColumn("_k", drawn(**how))
    return apply(folded, F.col("_k"), shape).drop("_k")


def array_view(data: Column, height: Column, width: Column, k: int) -> Column:
    """An array in row-major order under an element: each place of the result reads one of the source."""
    w = height if k & 1 else width  # of the result

    def read(p: Column) -> Column:
        r, c = F.floor(p / w).cast("int"), (p % w).cast("int")
        r, c = place(INVERSE[k], r, c, *((width, height) if k & 1 else (height, width)))
        return data[(r * width + c).cast("int")]

    return F.when(F.size(data) > 0, F.transform(F.sequence(F.lit(0), F.size(data) - 1), read)).otherwise(data)


def stack_views(data: Column, height: Column, width: Column) -> Column:
    """The eight views of an array, stacked."""
    return F.array(*[array_view(data, height, width, k) for k in range(8)])
