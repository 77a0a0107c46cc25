"""Periodic runs of words: suffix trees of a text and its reversal answer how far two places agree, in both directions.

A run is a stretch of words with smallest period q and length >= max(``least``, 2q) that no neighbouring word extends.
Its words hold a Lyndon root: a stretch that is smaller than all its own suffixes, in the order of the words' numbers or
in the reverse order, and that ends where the next smaller (greater) suffix begins. So each place has two candidates at
most. A candidate (i, j) is extended by the common extension of the suffixes i and j to the right and of the reversed
prefixes to the left. Both trees are Ukkonen's; a common extension is the depth of the lowest common ancestor of two
leaves, by a sparse table over the Euler tour (of what the tour visits between two neighbouring leaves only the
shallowest node is kept). Places are numbers of words, so a common word costs as much as a rare one.

Only stretches that may hold a run get trees, which loses none: a word of a run occurs twice in it, so a word that is
unique in its stretch parts it, again and again; and the first ``ceil(least / 2)`` words of a run stand again q words
later, so a stretch that repeats no such words has no run.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows give repeated results; a null id stays
null; texts of any length (memory grows with the longest periodic stretch times its logarithm); other columns are dropped
by ``find_runs``, kept by ``collapse_runs``, which replaces a column of its result's name; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tilewright.llm.common import arrow_map, pieces, table, without

LEAST = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Suffixes of a sequence of non-negative integers, ranked, and their common prefixes."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]  # the end, smaller than all
        start, end, kids = self._grow(text)
        self.rank, depths = self._tour(len(text), start, end, kids)
        self.levels = [depths]
        while (width := 1 << len(self.levels)) <= len(depths):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(depths) - width + 1], last[width // 2 : width // 2 + len(depths) - width + 1]))

    @staticmethod
    def _grow(text: list[int]):
        """Ukkonen: one symbol after the other. Edges are (start, end) of the node below; a leaf's end is the text's."""
        n = len(text)
        start, end, link, kids = [0], [0], [0], [{}]
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    edge = i
                below = kids[node].get(text[edge])
                if below is None:
                    kids[node][text[edge]] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if made:
                        link[made] = node
                    made = 0
                else:
                    at = start[below]
                    size = min(end[below], i + 1) - at
                    if length >= size:
                        edge, length, node = edge + size, length - size, below
                        continue
                    if text[at + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    middle = len(start)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    kids += ({text[at + length]: below, c: middle + 1}, None)
                    start[below] = at + length
                    kids[node][text[edge]] = middle
                    if made:
                        link[made] = middle
                    made = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return start, end, kids

    @staticmethod
    def _tour(n: int, start: list[int], end: list[int], kids: list) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each suffix, and at each rank the depth of the shallowest node since the leaf before."""
        order, depths, shallowest = [], [], 0
        todo = [(0, 0, -1)]  # node, depth of its parent, depth to come back to (-1: a first child)
        while todo:
            node, above, back = todo.pop()
            if back >= 0:
                shallowest = back
            depth = above + end[node] - start[node]
            if kids[node] is None:
                order.append(n - depth)
                depths.append(shallowest)
                continue
            first = True
            below = []
            for _, k in sorted(kids[node].items()):
                below.append((k, depth, -1 if first else depth))
                first = False
            todo += reversed(below)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return rank, np.array(depths, np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes ``i`` and ``j`` (different places)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k) + 1])
        return out


def _next_beyond(rank: list[int]) -> list[int]:
    """For each place the next one of a smaller rank, else -1."""
    out, stack = [-1] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def stretch_runs(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, ascending by start, then period."""
    n = len(symbols)
    tree, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = tree.rank[:n]
    after = np.concatenate([_next_beyond(rank.tolist()), _next_beyond((-rank).tolist())]).astype(np.int64)
    i, ok = np.tile(np.arange(n), 2), after >= 0
    i, j = i[ok], after[ok]
    right, left = tree.common(i, j), np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back.common(n - i[inner], n - j[inner])
    period = j - i
    start, length = i - left, right + left + period
    ok = length >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([start[ok], period[ok], length[ok]], 1), axis=0)
    return found[:, [0, 2, 1]]


def _stretches(h: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Parts (begin, end) of a text's word hashes that may hold a run: no word is unique in them, and some
    ``ceil(least / 2)`` words in a row occur twice."""
    gram = -(-least // 2)
    todo = [(0, len(h))]
    while todo:
        begin, end = todo.pop()
        if end - begin < least:
            continue
        _, number, times = np.unique(h[begin:end], return_inverse=True, return_counts=True)
        single = np.flatnonzero(times[number] == 1)
        if len(single):
            edges = np.concatenate([[-1], single, [end - begin]]) + begin
            wide = np.flatnonzero(np.diff(edges) > least)
            todo += zip((edges[wide] + 1).tolist(), edges[wide + 1].tolist(), strict=True)
            continue
        grams = np.zeros(end - begin - gram + 1, np.uint64)
        for k in range(gram):
            grams = (grams + number[k : k + len(grams)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
        if len(np.unique(grams)) < len(grams):
            yield begin, end


def word_runs(words: list[bytes], least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text's words, ascending by start, then period."""
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    out = []
    for begin, end in sorted(_stretches(np.fromiter(map(hash, words), np.int64, len(words)), least)):
        number: dict[bytes, int] = {}
        found = stretch_runs([number.setdefault(w, len(number)) for w in words[begin:end]], least)
        if len(found):
            out.append(found + np.array([begin, 0, 0]))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(drop) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


def _run_lists(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty((0, 3), np.int64), *found])
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(_RUN)))


def _split(col: pa.Array) -> list[list[bytes]]:
    """Words: what is between blanks, tabs, line ends, vertical tabs and form feeds (which is what ``bytes.split`` parts at)."""
    return [(t or b"").split() for t in col.cast(pa.binary()).to_pylist()]


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, runs (start and length in words, period; by start, then period), collapsed (the words that
    no run holds after its first period, joined by one blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = _split(b.column(1))
            found = [word_runs(w, least) for w in words]
            kept = [b" ".join(kept_words(w, f)) for w, f in zip(words, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in words], pa.int64()), _run_lists(found), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def collapse_runs(docs: DataFrame, *, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with each run's repetitions after the first taken out of the text. A text without a run stays as it is,
    white space included; in the others the kept words are joined by one blank. All other columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text=at):
            raw, cols = b.column(at).cast(pa.binary()).to_pylist(), list(b.columns)
            new = []
            for t in raw:
                words = (t or b"").split()
                found = word_runs(words, least)
                new.append(b" ".join(kept_words(words, found)) if len(found) else t)
            cols[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    schema = StructType([StructField(f.name, StringType(), True) if i == at else f for i, f in enumerate(docs.schema.fields)])
    return arrow_map(docs, run, schema)


def with_longest(runs: DataFrame) -> DataFrame:
    """Adds n_runs and, of the run of greatest length (ties: smallest start, then period), start, length, period and
    exponent_milli (thousandths of length / period, rounded down); null where there is no run."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = without(runs, ["n_runs", "start", "length", "period", "exponent_milli"]).withColumn("n_runs", F.size("runs").cast("long")).withColumn("_longest", longest)
    return out.select(
        "*",
        (-F.col("_longest.start")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"),
    ).drop("_longest")


def periodic_tail(doc_id: Column, text: Column) -> Column:
    """The text of the query: where crc32(doc_id) ends in 0, its words from a place on repeat a first stretch of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(held: Column) -> Column:
        w, n = held["w"], F.size(held["w"]).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # the words are held in an array of one struct, so that the lambda reads them without splitting again
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.transform(F.array(F.struct(words.alias("w"))), repeated)[0]).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_tail(F.col("doc_id"), F.col("text")).alias("text"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return with_longest(find_runs(docs)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
