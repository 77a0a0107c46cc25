"""Alignment of two tokenizers' tokens: where both end, texts are cut into groups and the tokens that end there are linked.

A is a byte-level BPE vocabulary, over a blank and the text; B is a sentencepiece model, over the text, to which it adds
the blank. Both then spell the same bytes. Tokens of all documents of a block lie in flat arrays, with the byte offsets
where they end. One state vector holds a pointer into A and one into B for each document; in each step all pointers whose
token ends first advance, both where the ends are equal, which is a cut and a link. Finished documents leave the vector.
No token has zero bytes (checked), so a cut links one token of A with one of B.

Links are counted over the corpus block by block: a block (documents of about ``BLOCK_CHARS`` characters in one task) has
each pair of ids once, with its count. Pairs are summed, the highest count of each B id is found, and each block gets the
figures of its own pairs back. So a pair that stands in every document is one row of each block, and what is shuffled is
pairs of blocks, not links.

Defined cases: a null or empty text, and one whose A or B tokens don't spell the blank and the text (it holds U+2581, or
the model changes it), has no tokens: zeros and an empty digest; strings of special tokens are plain text; repeated rows
give repeated results and count each time; a null id stays null; texts of any length (one that is longer than a block is
a block of its own); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.bpe import ByteBPE
from tilewright.llm.common import arrow_map, cut, pieces, table

#: A block is encoded and written in digits part by part, so that lists of numbers stay short.
BLOCK_CHARS, PART_CHARS = 3_000_000, 1_000_000
#: The words that a worker keeps between batches: so many, and none of more characters.
KEPT_WORDS, LONGEST_KEPT = 120_000, 64
SPACE = "▁"


class PieceModel:
    """A sentencepiece BPE model. Texts are parted before blanks that follow something else, and before line ends, and each
    part is encoded once. That gives the tokens of the whole text if no piece reaches over such a place; a model with a
    piece that does encodes whole texts."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        reach_over = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.", re.DOTALL)
        parted = not any(reach_over.search(p) for p in pieces) and "\n" not in pieces and self.model.encode("\na")[:1] == self.model.encode("\nb")[:1]
        self.parts = re.compile(" +[^ \n]*|\n[^ \n]*" if parted else r"(?s:.+)")
        self.before = self.model.encode("\na")[:1]
        self.cache: dict[str, bytes | None] = {}

    def _encode(self, parts: list[str]) -> list[bytes | None]:
        """Ids of parts of a text with a blank before it, or None where these don't spell the part."""
        line = [p[0] == "\n" for p in parts]
        found = self.model.encode([p if n else p[1:] for p, n in zip(parts, line, strict=True)], num_threads=1)
        for i, (p, after) in enumerate(zip(parts, line, strict=True)):
            if after:
                found[i] = found[i][1:] if found[i][:1] == self.before else [0]
            elif p == " ":  # the library gives an empty text no tokens
                found[i] = self.before
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        spelled = b"".join(map(self.bytes_of.__getitem__, flat.tolist()))
        sure = "".join(parts).encode() == spelled and np.array_equal(np.cumsum(self.size[flat])[np.cumsum(sizes) - 1], np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in parts])) if parts else True
        raw, ends = flat.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        out: list[bytes | None] = [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        if not sure:
            out = [x if b"".join(map(self.bytes_of.__getitem__, ids)) == p.encode() else None for x, ids, p in zip(out, found, parts, strict=True)]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, or None where they don't spell a blank and the text."""
        split = [None if SPACE in t else self.parts.findall(" " + t) for t in texts]
        if len(self.cache) > KEPT_WORDS:
            self.cache.clear()
        new = list(set().union(*(s for s in split if s)).difference(self.cache))
        self.cache.update(zip(new, self._encode(new), strict=True))
        get, out = self.cache.__getitem__, []
        for s in split:
            ids = [None] if s is None else list(map(get, s))
            out.append(None if None in ids else b"".join(ids))
        for w in new:
            if len(w) > LONGEST_KEPT:
                del self.cache[w]
        return out


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and of B that end where one of the other ends, in order: places in the flat arrays. Documents have
    tokens of both or none."""
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    live = np.flatnonzero(n_a)
    a, b, stop = first_a[live], first_b[live], (first_a + n_a)[live]
    while len(a):
        ends_a, ends_b = end_a[a], end_b[b]
        both = ends_a == ends_b
        cut_a[a[both]] = True
        cut_b[b[both]] = True
        a = a + (ends_a <= ends_b)
        b = b + (ends_b <= ends_a)
        if (going := a < stop).all():
            continue
        a, b, stop = a[going], b[going], stop[going]
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)


class Aligner:
    def __init__(self, byte_file: str, piece_file: str):
        self.a, self.b = ByteBPE(byte_file), PieceModel(piece_file)
        self.a.special_split = None  # their strings are plain text here
        self.size_a, self.size_b = np.fromiter(map(len, self.a.bytes_of), np.int64, self.a.size), self.b.size
        # digits of each id with what follows it: another token of its side, the other side, another group
        n = max(len(self.size_a), len(self.size_b))
        self.digits, self.kinds = [f"{i}{after}" for after in ",|;" for i in range(n)], n

    def block(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Flat ids of both sides with each document's first place and number, and the linked places in order."""
        a: list[bytes] = []
        b: list[bytes] = []
        for part in _parts(texts, PART_CHARS):
            ours, theirs = self.a.encode_batch([" " + t if t else "" for t in part]), self.b.encode_batch([t or "" for t in part])
            for t, x, y in zip(part, ours, theirs, strict=True):
                a.append(x if t and y is not None else b"")
                b.append(y if t and y is not None else b"")
        out: dict[str, np.ndarray] = {}
        for side, found, size in (("a", a, self.size_a), ("b", b, self.size_b)):
            out[side] = np.frombuffer(b"".join(found), "<u4")
            out[f"n_{side}"] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            out[f"first_{side}"] = np.cumsum(out[f"n_{side}"]) - out[f"n_{side}"]
            sizes = size[out[side]]
            if len(sizes) and not sizes.min():
                raise ValueError("a token without bytes")
            out[f"end_{side}"] = np.cumsum(sizes, dtype=np.int32 if sizes.sum() < 1 << 31 else np.int64)
        # both sides of a document spell the same bytes, so ends counted through the block are equal where they are in it
        out["at_a"], out["at_b"] = lockstep(out.pop("end_a"), out.pop("end_b"), out["first_a"], out["n_a"], out["first_b"])
        out["n_links"] = np.diff(np.searchsorted(out["at_a"], np.concatenate([out["first_a"], [len(out["a"])]])))
        return out

    def written(self, found: dict[str, np.ndarray]) -> Iterator[str]:
        """Each document's groups in digits: ``a1,a2|b1;a3|b2,b3``."""
        ends = {k: np.concatenate([[0], np.cumsum(found[f"n_{k}"])]) for k in ("a", "b", "links")}
        low, n = 0, len(found["n_a"])
        while low < n:
            high = max(low + 1, int(np.searchsorted(ends["a"], ends["a"][low] + PART_CHARS // 4, "right")) - 1)
            (a, b, links) = (slice(ends[k][low], ends[k][high]) for k in ("a", "b", "links"))
            sizes = (found["n_a"] + found["n_b"])[low:high]
            yield from self._digits(found["a"][a], found["b"][b], found["at_a"][links] - a.start, found["at_b"][links] - b.start, sizes)
            low = high

    def _digits(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, sizes: np.ndarray) -> Iterator[str]:
        # a token comes after all of its side before it and the other side's tokens of the groups before (B: and its own)
        before_b, upto_a = np.concatenate([[0], at_b + 1]), np.concatenate([at_a + 1, [0]])
        order, kind_a, kind_b = np.empty(len(a) + len(b), np.int64), np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[at_a], kind_b[at_b] = self.kinds, 2 * self.kinds
        order[np.arange(len(a)) + before_b[np.searchsorted(at_a, np.arange(len(a)))]] = a + kind_a
        order[np.arange(len(b)) + upto_a[np.searchsorted(at_b, np.arange(len(b)))]] = b + kind_b
        words, begin, digits = order.tolist(), 0, self.digits.__getitem__
        for n in sizes.tolist():
            yield "".join(map(digits, words[begin : begin + n]))[:-1]
            begin += n


def _parts(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    part, held = [], 0
    for t in texts:
        if part and held + len(t or "") > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t or "")
    if part:
        yield part


@functools.cache
def load(byte_file: str, piece_file: str) -> Aligner:
    """One for each worker process: later tasks of a worker find its words."""
    return Aligner(byte_file, piece_file)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def align(docs: DataFrame, byte_file: str, piece_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, a_ids, b_ids, and for each group the number of its last token on each side, a_ends and b_ends
    (these two tokens are linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(byte_file, piece_file)
        for b in pieces(batches):
            f = aligner.block(b.column(1).to_pylist())
            ends = [at - np.repeat(first, f["n_links"]) for at, first in ((f["at_a"], f["first_a"]), (f["at_b"], f["first_b"]))]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(f["a"], f["n_a"]), _lists(f["b"], f["n_b"]), *(_lists(e, f["n_links"]) for e in ends)], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>, links binary, pairs array<long>, times array<long>"


def aligned_blocks(docs: DataFrame, byte_file: str, piece_file: str, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each block: its documents' figures, its distinct pairs (A id * 2^32 + B id) with their counts, and the
    number among these of each link. Written, so that blocks keep their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = load(byte_file, piece_file), TaskContext.get().partitionId()
        for i, (ids, texts) in enumerate(_blocks(batches, block_chars)):
            f = aligner.block(texts)
            digests = [sha256(w.encode()).hexdigest() if w else "" for w in aligner.written(f)]
            pairs, links, times = np.unique(f["a"][f["at_a"]].astype(np.int64) << 32 | f["b"][f["at_b"]], return_inverse=True, return_counts=True)
            row = [task << 32 | i, ids, f["n_a"], f["n_b"], f["n_links"], digests, links.astype(_kind(len(pairs))).tobytes(), pairs, times]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(arrow_map(rows, run, _BLOCK), "aligned-blocks")


def _kind(pairs: int) -> str:
    """The numbers' kind of a block's links."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[int | None], list[str | None]]]:
    ids, texts, held = [], [], 0
    for b in pieces(batches, rows=100_000, chars=chars):
        new, size = b.column(1).to_pylist(), b.column(1).nbytes
        if texts and held + size > chars:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids, texts, held = ids + b.column(0).to_pylist(), texts + new, held + size
    if texts:
        yield ids, texts


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count over the corpus, best: whether no A id is linked with its B id more often. One row for each pair. The
    window holds one B id's distinct pairs, at most the A vocabulary."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def link_profile(docs: DataFrame, byte_file: str, piece_file: str, **how) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id, ties
    included), count_sum (of the links' pair counts), groups_sha256."""
    blocks = aligned_blocks(docs, byte_file, piece_file, **how)
    own = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(blocks), "pair")
    known = own.groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("known"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i] for n in b.schema.names}
                links, of = np.frombuffer(row["links"].as_py(), _kind(len(row["pairs"]))), row["n_links"].values.to_numpy()
                count, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
                if row["known"].is_valid:
                    at, c, x = (row["known"].values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    count[at], best[at] = c, x
                ends = np.concatenate([[0], np.cumsum(of)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends]) for x in (best, count)]
                cols = [row["doc_id"].values, row["n_a"].values, row["n_b"].values, pa.array(of), pa.array(of), *map(pa.array, sums), row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = blocks.join(known, "block", "left").select("doc_id", "n_a", "n_b", "n_links", "groups_sha256", "links", "pairs", "known")
    return joined.mapInArrow(profile, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_profile(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
