"""A table function on raster rows: one image gives many rows, its tiles' statistics or its connected regions.

``ImageRegions`` is a Python UDTF for SQL and DataFrames: ``SELECT ... FROM masks, LATERAL image_regions(height, width, data)``
gives a row for each region of equal, non-zero bytes that touch at sides. With ``TABLE(...) PARTITION BY`` the pieces of a
larger mask would meet in one task, so masks are rows here and the function is lateral: nothing is shuffled.

Defined cases: null, undecodable (height or width below 1) and all-zero masks, and payloads of another length than the shape,
have no regions; regions are numbered from 1 by their first pixel in row-major order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

COLUMNS = "region int, value int, area long, top int, left int, bottom int, right int"


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers of regions (0: none) by union of runs: the runs of each row are joined with those above that they touch."""
    height, width = mask.shape
    padded = np.pad(mask.astype(np.int64), ((0, 0), (1, 1)), constant_values=-1)
    begin = (padded[:, 1:-1] != padded[:, :-2]) & (mask > 0)
    run = np.where(mask > 0, np.cumsum(begin.ravel()).reshape(height, width), 0)
    parent = np.arange(int(begin.sum()) + 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    touch = (mask[1:] > 0) & (mask[1:] == mask[:-1])
    for a, b in np.unique(np.stack([run[:-1][touch], run[1:][touch]], 1), axis=0).tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(parent))])
    return np.where(mask > 0, np.searchsorted(np.unique(roots[1:]), roots[run]) + 1, 0) if len(roots) > 1 else run


class ImageRegions:
    def eval(self, height: int, width: int, data: bytes) -> Iterator[tuple]:
        if data is None or height is None or width is None or height < 1 or width < 1 or len(data) != height * width:
            return
        mask = np.frombuffer(bytes(data), np.uint8).reshape(height, width)
        found = label(mask)
        r, c = np.nonzero(found)
        k = found[r, c] - 1
        n = int(found.max())
        area = np.bincount(k, minlength=n)
        ends = [np.full(n, fill) for fill in (height, width, -1, -1)]
        for out, at, x in zip(ends, (np.minimum, np.minimum, np.maximum, np.maximum), (r, c, r, c), strict=True):
            at.at(out, k, x)
        value = np.zeros(n, np.int64)
        value[k] = mask[r, c]
        for i in range(n):
            yield i + 1, int(value[i]), int(area[i]), *(int(e[i]) for e in ends)


def register(spark: SparkSession, name: str = "image_regions") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, udtf(ImageRegions, returnType=COLUMNS))


def regions(masks: DataFrame, key: str = "image_id") -> DataFrame:
    """key and a row for each region (region, value, area, top, left, bottom, right) of masks (key, height, width, data)."""
    register(masks.sparkSession)
    masks.select(key, "height", "width", "data").createOrReplaceTempView("_masks_of_regions")
    return masks.sparkSession.sql(f"SELECT m.`{key}`, r.* FROM _masks_of_regions m, LATERAL image_regions(m.height, m.width, m.data) r")
