"""Byte-level BPE in batched numpy merge rounds, and decoding.

The distinct new words of a batch go into one flat symbol array. In each round all neighbouring pairs are looked up by
binary search in the sorted pair keys (left * size + right), every word's lowest rank is found, and all its occurrences
merge at once, left to right; words without a known pair leave the array. A word longer than ``LONG`` symbols, for which
rounds over the array would cost the square of its length, is merged with a heap of pairs (same rule: lowest rank, then
leftmost). Results are kept by word in a cache of bounded size.

Defined cases: null text encodes as empty; texts of any length; special tokens' strings become their ids, as the
tokenizers library does by default; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, pieces, table
from tilewright.llm.wordsplit import byte_words

LONG = 256
MOST_WORDS = 150_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.base = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = keys, first.astype(np.int64)
        self.merged = np.array([vocab[merges[r][0] + merges[r][1]] for r in first], np.int64)
        self.by_pair, self.back, self.file, self.library = None, back, tokenizer_file, None
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.cache: dict[str, bytes] = {}

    # encoding
    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        split = [self._parts(t) for t in texts]
        if len(self.cache) > MOST_WORDS:
            self.cache.clear()
        new = list(set().union(*(p for parts in split for p in parts if isinstance(p, list))).difference(self.cache))
        if new:
            self.cache.update(zip(new, self.merge_words([w.encode() for w in new]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else p for p in parts) for parts in split]

    def _parts(self, text: str) -> list:
        if self.special_split is None or not any(s in text for s in self.specials):
            return [self._words(text)]
        out: list = []
        for p in self.special_split.split(text):
            if p in self.specials:
                out.append(np.array([self.specials[p]], "<u4").tobytes())
            elif p:
                out.append(self._words(p))
        return out

    def _words(self, text: str) -> list[str]:
        """The text's words; the library's pre-tokenizer splits those with characters of an unsure class."""
        words = byte_words(text)
        if words is None:
            if self.library is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.file).pre_tokenizer
            words = [bytes(map(self.back.__getitem__, piece)).decode() for piece, _ in self.library.pre_tokenize_str(text)]
        return words

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            for j, ids in zip(part, self._rounds([words[k] for k in part]), strict=True):
                out[j] = ids
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._heap(w)
        return out

    def _rounds(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word, none = [], [], np.iinfo(np.int64).max
        while len(sym):
            same = np.flatnonzero(word[1:] == word[:-1])
            key = sym[same] * self.size + sym[same + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            low = np.full(len(words), none)
            np.minimum.at(low, word[same], rank)
            hit = np.flatnonzero((rank != none) & (rank == low[word[same]]))
            live = low[word] != none
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            if not len(hit):
                break
            left, new = same[hit], self.merged[at[hit]]
            # of overlapping pairs (a run such as "aaa") every second one, from the left, merges
            joined = np.concatenate([[False], left[1:] == left[:-1] + 1])
            run = np.cumsum(~joined) - 1
            first = np.flatnonzero(~joined)
            take = (np.arange(len(left)) - first[run]) % 2 == 0
            left, new = left[take], new[take]
            sym[left] = new
            live[left + 1] = False
            sym, word = sym[live], word[live]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")].astype("<u4")
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        raw, begin, out = sym.tobytes(), 0, []
        for e in ends.tolist():
            out.append(raw[begin:e])
            begin = e
        return out

    def _heap(self, word: bytes) -> bytes:
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        pair, size = self.by_pair, self.size
        sym = self.base[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(*pair[k], i, k) for i in range(n - 1) if (k := sym[i] * size + sym[i + 1]) in pair]
        todo = [(r, i, k, m) for r, m, i, k in todo]
        heapq.heapify(todo)
        while todo:
            _, i, k, m = heapq.heappop(todo)
            j = after[i]
            if sym[i] < 0 or j >= n or sym[i] * size + sym[j] != k:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (x := sym[a] * size + sym[after[a]]) in pair:
                    r, mm = pair[x]
                    heapq.heappush(todo, (r, a, x, mm))
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    # decoding
    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def load(tokenizer_file: str) -> ByteBPE:
    """One for each worker process: later tasks of a worker find its words."""
    return ByteBPE(tokenizer_file)


def encode_documents(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_file)
        for b in pieces(batches):
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per row of ``encode_documents``: doc_id, ids, n_tokens, text (special tokens kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_file)
        for b in pieces(batches):
            texts = [bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "n_tokens", "text"])

    return arrow_map(encoded.select("doc_id", "ids", "n_tokens"), run, "doc_id long, ids binary, n_tokens long, text string")


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Encode, decode and digest: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decode_documents(encode_documents(docs, tokenizer_file), tokenizer_file).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
