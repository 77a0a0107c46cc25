"""The mask sink: one PNG file per row, encoded and staged by the tasks, in place when the job has ended."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tilewright.functions import pixels
from tilewright.sources.filesink import write_set, write_stream


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """Bytes (grey, or blue, green, red) as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    if channels == 3:
        rgb = bytearray(data)
        rgb[0::3], rgb[2::3] = data[2::3], data[0::3]
        data = bytes(rgb)
    step = width * channels
    rows = b"".join(b"\0" + data[i * step : (i + 1) * step] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def _raw(data) -> bytes:
    return bytes(data) if isinstance(data, bytes | bytearray | memoryview) else np.asarray(data).astype(np.uint8).tobytes()


CONTENT = "name string, content binary"


def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"name": f["name"], "content": [png(h, w, n, _raw(d)) for h, w, n, d in zip(f["height"], f["width"], f["channels"], f["data"], strict=True)]})


def encoded(df: DataFrame) -> DataFrame:
    """Rows (name, height, width, channels, data: array or binary) as rows (name, content): PNG files."""
    return df.select("name", "height", "width", "channels", "data").mapInPandas(encode, CONTENT)


def named(df: DataFrame) -> DataFrame:
    """Adds the file name ``{image_id}_mask.png``."""
    return df.withColumn("name", pixels.mask_name(pixels.image_name(df["image_id"])))


def write_files(df: DataFrame, path: str, if_exists: str = "error") -> None:
    """Rows (name, height, width, channels, data) as PNG files below ``path``; ``if_exists``: error, append or overwrite.
    See ``filesink`` for what a failed job leaves (nothing) and how a set is replaced."""
    write_set(encoded(df), path, if_exists)


def write_masks(df: DataFrame, path: str, if_exists: str = "error") -> None:
    """Rows (image_id, height, width, channels, data: array or binary) as ``{image_id}_mask.png``."""
    write_files(named(df), path, if_exists)


def stream_masks(df: DataFrame, path: str, state: str) -> StreamingQuery:
    """A stream of such rows as mask files, each batch once."""
    return write_stream(encoded(named(df)), path, state)
