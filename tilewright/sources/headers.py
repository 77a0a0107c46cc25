"""Image files by their headers: size and bands without reading or decoding the pixels.

A Python data source: the files are listed once and dealt out to partitions by number; a task reads the first bytes of each
(PNG: 33; JPEG: segment by segment up to the frame header, passing over segments by their lengths). Filters on ``path``
(equal, in, begins, ends, contains) are pushed to the listing, so other files aren't opened; they need
``spark.sql.python.filterPushdown.enabled`` and are otherwise applied after the scan, with equal results.

Defined cases: files that are neither, or end within the header, have height, width and channels -1 and no format; a header
alone doesn't tell whether the pixels are whole; an empty folder gives no rows, a missing one is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from tilewright.functions import pixels
from tilewright.sources.shared import open_fs

SCHEMA = "path string, length long, format string, height int, width int, channels int"
#: Files of a partition.
FILES = 2000
#: Bands by a PNG's colour type (grey, colour, palette, grey and alpha, colour and alpha) when it is decoded.
PNG_BANDS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}
UNKNOWN = (None, -1, -1, -1)


def header(f) -> tuple[str | None, int, int, int]:
    """Format, height, width and bands of an open file."""
    head = f.read(33)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        if len(head) < 26 or head[12:16] != b"IHDR":
            return UNKNOWN
        width, height = struct.unpack(">II", head[16:24])
        return ("png", height, width, PNG_BANDS[head[25]]) if head[25] in PNG_BANDS and 0 < min(height, width) and max(height, width) < 1 << 31 else UNKNOWN
    if head[:2] != b"\xff\xd8":
        return UNKNOWN
    at = 2
    while True:
        f.seek(at)
        mark = f.read(4)
        if len(mark) < 4 or mark[0] != 0xFF:
            return UNKNOWN
        if mark[1] == 0xFF:  # a fill byte
            at += 1
            continue
        if mark[1] == 0x01 or 0xD0 <= mark[1] <= 0xD8:  # markers without a segment
            at += 2
            continue
        if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            frame = f.read(6)
            if len(frame) < 6:
                return UNKNOWN
            _, height, width, bands = struct.unpack(">BHHB", frame)
            return ("jpeg", height, width, bands) if height and width else UNKNOWN
        if mark[1] in (0xD9, 0xDA):  # the end, or pixels without a frame
            return UNKNOWN
        at += 2 + struct.unpack(">H", mark[2:])[0]


def _test(f: Filter) -> Callable[[str], bool] | None:
    if getattr(f, "attribute", None) != ("path",):
        return None
    kinds = {EqualTo: lambda p: p == f.value, In: lambda p: p in f.value, StringStartsWith: lambda p: p.startswith(f.value), StringEndsWith: lambda p: p.endswith(f.value), StringContains: lambda p: f.value in p}
    return kinds.get(type(f))


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.glob, self.size, self.wanted = options["path"], options.get("glob", "*"), int(options.get("files", FILES)), []

    def _wanted(self, path: str) -> bool:
        return all(_test(kind(("path",), value))(path) for kind, value in self.wanted)

    def partitions(self) -> list[InputPartition]:
        fs, root = open_fs(self.root)
        scheme = self.root.split(root)[0] if root in self.root else ""
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatchcase(f.base_name, self.glob))
        files = [f for f in files if self._wanted(f[0])]
        return [_Part(files[i : i + self.size]) for i in range(0, len(files), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        fs, _ = open_fs(self.root)
        for path, length in partition.files:
            with fs.open_input_file(open_fs(path)[1]) as f:
                yield path, length, *header(f)


class _PushReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (test := _test(f)) is None:
                yield f
            else:
                self.wanted.append((type(f), f.value))


class ImageHeaders(DataSource):
    """Options: path, glob, files (of a partition), push (whether the session pushes filters to Python sources)."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PushReader(self.options) if self.options.get("push") == "true" else _Reader(self.options)


def scan_headers(spark: SparkSession, root: str, glob: str = "*_sat.*", named: Callable[[Column], Column] = pixels.image_id, files: int = FILES) -> DataFrame:
    """image_id (``named`` gives it from the path), path, length, format, height, width, channels."""
    spark.dataSource.register(ImageHeaders)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")  # Spark refuses a reader that could where it is off
    found = spark.read.format("image_headers").options(glob=glob, files=files, push=push).load(root)
    return found.select(named(F.col("path")).alias("image_id"), "*")
