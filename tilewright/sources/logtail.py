"""Run logs as they grow: a streaming source that remembers how far it has read each file.

The offset is, for each file below a folder, the number of bytes up to the end of its last whole epoch (its ``SHAPE`` line),
so an epoch that is still being written waits for the next batch and none comes twice. A batch's files are dealt out to
tasks, which read their new bytes only. A restart goes on from the checkpoint's offsets.

Defined cases: what isn't an epoch (other lines, rate changes, the end mark) is passed over; a file that appears later is
read from its beginning; one that is shorter than what was read, or is gone, gives nothing more until it is longer; an empty
or missing folder gives no rows. A file may hold many runs, each epoch with the name of its run (``runlog.growing_logs``). The
offset has an entry for each file, so where there are very many runs let them share files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tilewright.sources.runlog import LINES
from tilewright.sources.shared import open_fs

SCHEMA = "file string, epoch int, elapsed_s int, loss double, height int, width int, run string"
# The text format of a run log.
EPOCH = re.compile(rf"\*{{8}}\r?\n{LINES}".encode())
#: Bytes at a file's end that are searched first for its last whole epoch.
TAIL = 1 << 16
#: Files of a partition, and their new bytes (one file may have more).
FILES, BYTES = 64, 1 << 24


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.glob, self.seen = options["path"], options.get("glob", "*"), {}

    def initialOffset(self) -> dict:
        return {}

    def _whole(self, fs, path: str, size: int) -> int:
        """Bytes up to the end of the last whole epoch."""
        known, length = self.seen.get(path, (0, -1))
        if size <= length:
            return known
        for begin in dict.fromkeys((max(known, size - TAIL), known)):
            with fs.open_input_file(path) as f:
                f.seek(begin)
                found = [m.end() for m in EPOCH.finditer(f.read(size - begin))]
            if found:
                known = begin + found[-1]
                break
        self.seen[path] = known, size
        return known

    def latestOffset(self) -> dict:
        fs, root = open_fs(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = {f.path: f.size for f in found if f.type == pafs.FileType.File and fnmatchcase(f.base_name, self.glob)}
        return {p: n for p in sorted(files) if (n := self._whole(fs, p, files[p]))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        grown = [(p, start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]
        parts, size = [], 0
        for file in grown:
            new = file[2] - file[1]
            if not parts or len(parts[-1]) == FILES or size + new > BYTES:
                parts.append([])
                size = 0
            parts[-1].append(file)
            size += new
        return [_Part(files) for files in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        fs, _ = open_fs(self.root)
        for file, begin, end in partition.files:
            with fs.open_input_file(file) as f:
                f.seek(begin)
                text = f.read(end - begin)
            for m in EPOCH.finditer(text):
                run, epoch, elapsed, loss, height, width = m.groups()
                yield file, int(epoch), int(elapsed), float(loss), int(height), int(width), run.decode() if run else None


class RunLogTail(DataSource):
    """Options: path, glob."""

    @classmethod
    def name(cls) -> str:
        return "run_log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def tail_run_logs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A stream of file, epoch, elapsed_s, loss, height, width, run of all epochs below ``path``, each once."""
    spark.dataSource.register(RunLogTail)
    return spark.readStream.format("run_log_tail").option("glob", glob).load(path)
