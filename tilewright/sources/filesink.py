"""A sink of whole files with a commit protocol, for batches and streams.

Rows are (name, content). Tasks write to folders of their own beside the target; nothing stands below the target until every
task has ended. Then the driver moves the files of the tasks that Spark has accepted, so files of failed, repeated and
speculative attempts are never seen. A job that fails leaves the target as it was and no staged files (in a store without
folders, tasks that Spark hasn't stopped yet may leave some beside the target, never in it).

``overwrite`` makes the new set beside the target, moves the old one aside, moves the new one in and then deletes the old:
at any moment one whole set exists (``path``, or ``path.old-...`` should the driver die between two renames).

In a stream a batch is committed once: its number is written below ``path/_batches/<stream>`` after its files are in place,
and a batch that comes again is dropped if the number is there, else its files replace themselves. ``stream`` is the name of
the checkpoint, so that another stream's batches of the same numbers aren't taken for these.

Of rows with one name one stays. A null name is an error; null content is an empty file. Names hold no folders. Moving is
the driver's work, one rename a file (``MOVERS`` at a time), as the layout is flat.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from tilewright.sources.shared import exists, open_fs

MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class _Files:
    #: Whether tasks may make the folder of all staged files. In a batch the driver makes it, so a task that still runs when
    #: the job has failed and its files are deleted can't make it again.
    lasting = True

    def __init__(self, options):
        self.path, self.mode = options["path"].rstrip("/"), options.get("if_exists", "append")
        self.stage = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, stage = open_fs(self.stage)
        folder = f"{stage}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=self.lasting)
        for row in iterator:
            if row["name"] is None or "/" in row["name"]:
                raise ValueError(f"not a file name: {row['name']!r}")
            with fs.open_output_stream(f"{folder}/{row['name']}") as f:
                f.write(bytes(row["content"] or b""))
        return Staged(folder)

    def move(self, messages, to: str) -> None:
        """The files of the accepted tasks to ``to``."""
        fs, root = open_fs(to)
        fs.create_dir(root, recursive=True)
        folders = pafs.FileSelector
        for m in messages:
            if m is None:
                continue
            found = [f.path for f in fs.get_file_info(folders(m.folder))]
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda p: fs.move(p, f"{root}/{p.rsplit('/', 1)[1]}"), found))

    def clear(self) -> None:
        fs, stage = open_fs(self.stage)
        if exists(self.stage):
            fs.delete_dir(stage)


class _Batch(_Files, DataSourceWriter):
    lasting = False

    def __init__(self, options):
        super().__init__(options)
        fs, stage = open_fs(self.stage)
        fs.create_dir(stage, recursive=True)

    def commit(self, messages) -> None:
        if self.mode == "error" and exists(self.path):
            self.clear()
            raise FileExistsError(self.path)
        if self.mode != "overwrite":
            self.move(messages, self.path)
            self.clear()
            return
        new, old = f"{self.path}.new-{uuid.uuid4().hex}", f"{self.path}.old-{uuid.uuid4().hex}"
        self.move(messages, new)
        (fs, root), (_, new), (_, old) = open_fs(self.path), open_fs(new), open_fs(old)
        there = exists(self.path)
        if there:
            fs.move(root, old)
        fs.move(new, root)
        if there:
            fs.delete_dir(old)
        self.clear()

    def abort(self, messages) -> None:
        self.clear()


class _Stream(_Files, DataSourceStreamWriter):
    def __init__(self, options):
        super().__init__(options)
        self.marks = f"{self.path}/_batches/{options['stream']}"

    def commit(self, messages, batchId: int) -> None:
        fs, marks = open_fs(self.marks)
        if not exists(f"{self.marks}/{batchId}"):
            self.move(messages, self.path)
            fs.create_dir(marks, recursive=True)
            fs.open_output_stream(f"{marks}/{batchId}").close()
        self.drop(messages)

    def abort(self, messages, batchId: int) -> None:
        self.drop(messages)

    def drop(self, messages) -> None:
        """What the tasks have staged; the writer that commits isn't the one that they got, so the messages tell where."""
        fs, _ = open_fs(self.path)
        there = lambda p: fs.get_file_info(p).type == pafs.FileType.Directory
        for folder in [m.folder for m in messages if m is not None]:
            if there(folder):
                fs.delete_dir(folder)
            stage = folder.rsplit("/", 1)[0]
            if there(stage) and not fs.get_file_info(pafs.FileSelector(stage)):
                fs.delete_dir(stage)


class FileSet(DataSource):
    """Options: path, if_exists (error, append, overwrite), stream (a stream's name)."""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Batch(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(self.options)


def write_set(df: DataFrame, path: str, if_exists: str = "error") -> None:
    """Rows (name, content) as files below ``path``; ``if_exists``: error, append or overwrite."""
    if if_exists == "error" and exists(path):
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(FileSet)
    df.select("name", "content").write.format("file_set").option("if_exists", if_exists).mode("append").save(path)


def write_stream(df: DataFrame, path: str, state: str) -> StreamingQuery:
    """A stream of rows (name, content) as files below ``path``, what is there now, each batch once; ``state``: the stream's
    checkpoint folder."""
    df.sparkSession.dataSource.register(FileSet)
    how = {"path": path, "stream": sha256(state.encode()).hexdigest()[:16], "checkpointLocation": state}
    return df.select("name", "content").writeStream.format("file_set").options(**how).outputMode("append").trigger(availableNow=True).start()
