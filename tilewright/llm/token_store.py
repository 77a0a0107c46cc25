"""Token-ID output: Arrow files of equal-length sequences with masks, read in place.

``write_token_store`` encodes documents and writes them in ascending id order as shards. A shard is two Arrow IPC
files: ``*.tokens.arrow`` has record batches of ``ids: fixed_size_list<uint16|uint32>[seq_len]`` and
``mask: dictionary<fixed_size_list<uint8>[seq_len]>`` (0: padding, at the end of a shard only); ``*.docs.arrow`` has, for
each document, its id, its first token's place in the shard and its number of tokens. A shard has at most two different
masks, the full one and that of its last sequence, so these are the dictionary and a sequence holds a number. All batches
but a shard's last have ``BATCH_SEQUENCES`` sequences, so a sequence's or token's batch follows from its number. Buffers
are uncompressed: a memory map gives any sequence, and the dictionary any mask, as an array without copying.

Defined cases: null text encodes as empty (end id alone); empty tables give no shard; repeated ids are kept, ordered by
text, and are dealt over several shards if they are many; a null id sorts first; other columns of the table are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, new_path, partitions, pieces, table
from tilewright.llm.wordsplit import lower_words

SEQ_LEN = 2048
#: Rows of one id, or of none, are dealt to shards by so many first characters of the text.
RANGE_CHARS = 256
BATCH_SEQUENCES = 256


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for any URI that Arrow knows (file, hdfs, s3, gs, abfs)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


class CachedEncoder:
    """Encode with the tokenizers library, each distinct word once.

    Words are split as the vocabulary's own pre-tokenizer does; unseen ones are encoded by the library. Texts outside
    the splitter's sure range (see ``wordsplit``) or with a special token's text go to the library whole. The cache is
    emptied at ``most`` words.
    """

    def __init__(self, tokenizer_file: str, dtype, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.dtype, self.most, self.cache = Tokenizer.from_file(tokenizer_file), dtype, most, {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _words(self, words: list[str], together: int = 128) -> list[bytes]:
        """Ids of each word. Words are encoded ``together``, a blank between them, and parted after word-end tokens."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        out: list[bytes] = []
        for g, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(g) and cuts[-1] == len(ids):
                raw, places, item = ids.astype(self.dtype).tobytes(), cuts.tolist(), np.dtype(self.dtype).itemsize
                out += [raw[a * item : b * item] for a, b in zip([0, *places], places, strict=False)]
            else:
                out += self._whole(g)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the bytes of a little-endian array of ``dtype``."""
        words = [None if "<|" in t else lower_words(t) for t in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
        new = list(set().union(*(w for w in words if w)).difference(self.cache))
        self.cache.update(zip(new, self._words(new), strict=True))
        get, rest = self.cache.__getitem__, iter(self._whole([t for t, w in zip(texts, words, strict=True) if w is None]))
        return [next(rest) if w is None else b"".join(map(get, w)) for w in words]


@functools.cache
def load(tokenizer_file: str, dtype: str) -> CachedEncoder:
    """One for each worker process: later tasks of a worker find its words."""
    return CachedEncoder(tokenizer_file, dtype)


class ShardWriter:
    """Packs token bytes into fixed-length sequences; writes to hidden names and renames when whole."""

    def __init__(self, base: str, shard: int, attempt: str, dtype, seq_len: int):
        self.fs, root = open_fs(base)
        self.fs.create_dir(root, recursive=True)
        self.dtype, self.seq_len, self.item = dtype, seq_len, np.dtype(dtype).itemsize
        self.names = [(f"{root}/.{attempt}-{shard:06d}.{k}.arrow", f"{root}/shard-{shard:06d}.{k}.arrow") for k in ("tokens", "docs")]
        ids = pa.list_(pa.from_numpy_dtype(dtype), seq_len)
        self.schema = pa.schema([("ids", ids), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), seq_len)))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [self.fs.open_output_stream(n[0]) for n in self.names]
        self.tokens = ipc.new_file(self.out[0], self.schema, options=ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.docs = ipc.new_file(self.out[1], self.docs_schema)
        self.parts, self.held, self.total, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        sizes = np.array([len(x) // self.item for x in ids], np.int64)
        starts = self.total + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(ids) else sizes
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.docs_schema))
        self.total, self.n_docs = self.total + int(sizes.sum()), self.n_docs + len(ids)
        self.parts += ids
        self.held += int(sizes.sum())
        if self.held >= self.seq_len * BATCH_SEQUENCES:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.parts), self.dtype)
        size = self.seq_len * BATCH_SEQUENCES
        whole = len(flat) // size * size
        for i in range(0, whole, size):
            self._batch(flat[i : i + size], size)
        rest = flat[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.seq_len) * self.seq_len, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
            rest = rest[:0]
        self.parts, self.held = [rest.tobytes()], len(rest)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len)
        masks, which = np.ones((1, self.seq_len), np.uint8), np.zeros(len(flat) // self.seq_len, np.int32)
        if real < len(flat):
            masks, which[-1] = np.repeat(masks, 2, 0), 1
            masks[1, real - len(flat) :] = 0
        self.tokens.write_batch(pa.record_batch([lists(flat), pa.DictionaryArray.from_arrays(pa.array(which), lists(masks.ravel()))], schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for w, o, (hidden, final) in zip((self.tokens, self.docs), self.out, self.names, strict=True):
            w.close()
            o.close()
            self.fs.move(hidden, final)


def write_token_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, vocab_size: int | None = None, shards: int | None = None) -> DataFrame:
    """Write ``docs`` below ``path`` (a folder that all executors share) and return the manifest.

    Manifest: shard, path, n_docs, n_tokens, start (tokens in all shards before). One row per shard, so the driver
    holds as many rows as there are partitions. A task that is run again writes the same shard anew.
    """
    spark = docs.sparkSession
    if vocab_size is None:
        from tokenizers import Tokenizer

        vocab_size = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer = TaskContext.get(), load(tokenizer_file, dtype), None
        for b in pieces(batches):
            if writer is None:
                writer = ShardWriter(path, task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}", dtype, seq_len)
            texts = [t or "" for t in b.column(1).to_pylist()]
            writer.add(b.column(0).to_pylist(), [x + end for x in encoder.encode(texts)])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [f"{path}/shard-{task.partitionId():06d}"], "n_docs": [writer.n_docs], "n_tokens": [writer.total]})

    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(shards or partitions(spark), "doc_id", F.substring("text", 1, RANGE_CHARS))
        .sortWithinPartitions("doc_id", "text")
    )
    rows = arrow_map(rows, write, "shard int, path string, n_docs long, n_tokens long").collect()
    start, out = 0, []
    for r in sorted(rows, key=lambda r: r["shard"]):
        out.append((r["shard"], r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(out, "shard int, path string, n_docs long, n_tokens long, start long")


class TokenShard:
    """Random access to one shard; on a local file the arrays point into the memory map."""

    def __init__(self, base: str):
        def source(kind: str):
            fs, p = open_fs(f"{base}.{kind}.arrow")
            return pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)

        self.file = ipc.open_file(source("tokens"))
        self.docs = ipc.open_file(source("docs"))
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def __len__(self) -> int:
        """Sequences: of the last batch the rows, of all before the full number."""
        n = self.file.num_record_batches
        return (n - 1) * BATCH_SEQUENCES + self.file.get_batch(n - 1).num_rows if n else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence, without copying: the ids point into the file's memory map, the mask into the
        shard's dictionary."""
        b, at = self.file.get_batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        mask = b.column("mask")
        lists = b.column("ids")[at], mask.dictionary[mask.indices[at].as_py()]
        return tuple(x.values.to_numpy(zero_copy_only=True) for x in lists)

    def _flat(self, i: int) -> np.ndarray:
        if self.held[0] != i:
            self.held = (i, self.file.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.held[1]

    def slices(self, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Runs of tokens by their first place and number, ascending; each batch is fetched once."""
        size = self.seq_len * BATCH_SEQUENCES
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            got = []
            while n > 0:
                part = self._flat(s // size)[s % size : s % size + n]
                got.append(part)
                s, n = s + len(part), n - len(part)
            yield got[0] if len(got) == 1 else np.concatenate(got) if got else np.empty(0, np.uint16)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before), n_tokens, ids_crc32, shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, first in zip(*(b.column(k).to_pylist() for k in ("shard", "path", "start")), strict=True):
                store = TokenShard(path)
                for i in range(store.docs.num_record_batches):
                    d = store.docs.get_batch(i)
                    starts, sizes = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in store.slices(starts, sizes)]
                    yield pa.RecordBatch.from_arrays([d.column("doc_id"), pa.array(starts + first), d.column("n_tokens"), pa.array(crc, pa.int64()), pa.array([shard] * len(crc), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, min(manifest.count(), partitions(manifest.sparkSession)))
    return manifest.select("shard", "path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_token_store(table(spark, sf_dir, "documents"), new_path(spark, "token-store"), public_tokenizers.path("word_bpe_49k.json"), 1))
