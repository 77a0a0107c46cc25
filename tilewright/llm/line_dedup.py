"""Line dedup: Bloom filters find lines that may repeat; only those shuffle, for exact confirmation.

1. Each task reduces its lines to distinct 64-bit hashes, ``HELD`` at a time (with a flag: seen twice here). They are
   dealt by hash to segments, and each segment runs a Bloom filter of the hashes *once seen*. It grows by layers, each
   with ``BITS_EACH`` bits for every hash it may take, so its rate of false hits stays near one percent whatever the
   input's size. It lives in one task and is never broadcast.
2. Every hash that hits its segment's filter is written, and what is written is made distinct: nothing ever keeps a hash
   from being written, so false hits add lines that don't repeat and never lose one that does. If filters of the *twice
   seen* hashes, ``BITS_EACH`` bits a hash, stay below ``broadcast_bytes`` in all, they are broadcast; else the lines'
   hashes (without the lines) are joined with the written ones. Both ways give the same suspects, but for the filters'
   false hits, and the same results.
3. Suspected lines are written with their whole keys, counted exactly by key, and the surviving occurrence (the largest
   document id) is chosen. A line in a third of all documents is counted by line and document first. The chosen lines
   are written, and the rows of the most frequent ones are dealt out by document in the join back (``join_split``).
4. Documents meet their own dropped keys by id and a hash of the text, so that rows of one id, or of none, don't meet
   in one task, and are rewritten. The dropped keys are written first, so that this join can be split as well.

Defined cases: null or empty text is one empty line and becomes the empty text; rows with one id are one document (all
keep or lose a line together); null ids are one document below all others; lines of any length; an empty table gives an
empty result. ``drop_lines`` leaves all columns but the text as they are; the columns that ``dedup_lines`` adds replace
the table's columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tilewright.llm.common import arrow_map, cut, join_split, mix, partitions, pieces, table, unused, without

_FOUND = "_id long, _hash long, key binary"
STRIP = b" \t\n\x0b\x0c\r"
HASHES = 4
#: Bits of a Bloom filter for each hash in it; four places in so many give 0.24 % of false hits.
BITS_EACH = 16
#: All broadcast filters together.
BROADCAST_BYTES = 32 << 20
#: Hashes that a task holds to make them distinct.
HELD = 1 << 20


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped, A-Z lower-cased; other characters stay."""
    return line.strip(STRIP).lower()


def is_long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def text_keys(text: bytes | None, least: int) -> set[bytes]:
    """Distinct keys of a text that are long enough to count."""
    return {k for k in map(line_key, (text or b"").split(b"\n")) if is_long(k, least)}


def bloom_places(h: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The ``i``-th place of each hash among ``bits`` (a power of two): another stretch of the mixed hash, added to."""
    return (mix(h) + np.uint64(i) * (h | np.uint64(1))) >> np.uint64(64 - bits.bit_length() + 1)


class Bloom:
    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(bits // 8, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may have been added; later places are looked up for the survivors alone."""
        out, at = np.zeros(len(h), bool), np.arange(len(h))
        for i in range(HASHES):
            p = bloom_places(h[at], self.bits, i)
            at = at[((self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
        out[at] = True
        return out

    def add(self, h: np.ndarray) -> None:
        for i in range(HASHES):
            p = bloom_places(h, self.bits, i)
            np.bitwise_or.at(self.data, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def filter_bits(n: int, each: int = BITS_EACH) -> int:
    """Bits of a filter for ``n`` hashes: a power of two, ``each`` for each at least."""
    return 1 << max(10, (n * each - 1).bit_length())


class Growing:
    """A Bloom filter of layers: the next one, four times as large, begins when the last has all the hashes it may take."""

    def __init__(self, first: int = 1 << 12, bits_each: int = BITS_EACH):
        self.room, self.next, self.each, self.layers = 0, first, bits_each, []

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for layer in self.layers:
            out |= layer.has(h)
        return out

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self.room:
                self.layers.append(Bloom(filter_bits(self.next, self.each)))
                self.room, self.next = self.next, self.next * 4
            self.layers[-1].add(h[: self.room])
            h, self.room = h[self.room :], self.room - min(self.room, len(h))


def _texts(batch: pa.RecordBatch, i: int = 1) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def _held(parts: Iterator[tuple[np.ndarray, ...]], most: int = HELD) -> Iterator[tuple[np.ndarray, ...]]:
    """Parallel arrays, put together until they have ``most`` places."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for x in parts:
        held.append(x)
        n += len(x[0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def twice_seen(lines: DataFrame, segments: int, least: int, bits_each: int = BITS_EACH) -> DataFrame:
    """segment, h: all hashes that occur in two rows or more (and a few that don't), once each. ``lines``: (_id, _text)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((np.array([xxhash.xxh3_64_intdigest(k) for t in _texts(b) for k in text_keys(t, least)], np.uint64),) for b in pieces(batches))
        for (found,) in _held(each):
            h, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(segments)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n > 1)], names=["segment", "h", "twice"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Growing(bits_each=bits_each)  # hashes of different segments are different, so one serves all of a task
        for seg, h, many in _held(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)) for b in batches):
            mine, first, n = np.unique(h.view(np.uint64), return_index=True, return_counts=True)
            again = (n > 1) | np.isin(mine, h.view(np.uint64)[many]) | once.has(mine)
            once.add(mine[~again])
            yield pa.RecordBatch.from_arrays([pa.array(seg[first[again]]), pa.array(mine[again].view(np.int64))], names=["segment", "h"])

    dealt = arrow_map(lines, hashes, "segment int, h long, twice boolean").repartitionById(segments, F.col("segment"))
    return cut(dealt.mapInArrow(fill, "segment int, h long").distinct(), "twice-seen")


def filters(twice: DataFrame, bits_each: int) -> dict[int, bytes]:
    """A Bloom filter of each segment's hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, h in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                bloom = Bloom(filter_bits(len(h.values), bits_each))
                bloom.add(h.values.to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "data": [bloom.data.tobytes()]})

    rows = twice.groupBy("segment").agg(F.collect_list("h").alias("h")).mapInArrow(make, "segment int, data binary")
    return {r["segment"]: bytes(r["data"]) for r in rows.collect()}


def suspects(lines: DataFrame, twice: DataFrame, segments: int, least: int, broadcast_bytes: int, bits_each: int = BITS_EACH) -> DataFrame:
    """_id, _hash and key of the lines whose hash was seen twice, once for each row."""

    def found(b: pa.RecordBatch, rows: list[int], keys: list[bytes]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(keys, pa.binary())], names=["_id", "_hash", "key"])

    n = twice.count()
    if 2 * bits_each * n / 8 <= broadcast_bytes:
        held = lines.sparkSession.sparkContext.broadcast(filters(twice, bits_each))

        def by_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blooms = {s: Bloom(len(d) * 8, d) for s, d in held.value.items()}
            for b in pieces(batches):
                rows, keys = [], []
                for i, t in enumerate(_texts(b)):
                    own = text_keys(t, least)
                    rows += [i] * len(own)
                    keys += own
                h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
                seg, hit = (h % np.uint64(segments)).astype(np.int64), np.zeros(len(h), bool)
                for s in np.unique(seg).tolist():
                    if s in blooms:
                        hit[seg == s] = blooms[s].has(h[seg == s])
                at = np.flatnonzero(hit)
                yield found(b, [rows[i] for i in at], [keys[i] for i in at])

        return arrow_map(lines, by_filter, _FOUND)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, h = [], []
            for i, t in enumerate(_texts(b)):
                own = [xxhash.xxh3_64_intdigest(k) for k in text_keys(t, least)]
                rows += [i] * len(own)
                h += own
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(np.array(h, np.uint64).view(np.int64))], names=["_id", "_hash", "h"])

    def by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, keys = [], []
            for i, (t, hits) in enumerate(zip(_texts(b), b.column(3).to_pylist(), strict=True)):
                hits = set(hits)
                own = [k for k in text_keys(t, least) if np.uint64(xxhash.xxh3_64_intdigest(k)).astype(np.int64).item() in hits]
                rows += [i] * len(own)
                keys += own
            yield found(b, rows, keys)

    hits = arrow_map(lines, numbers, "_id long, _hash long, h long").join(twice.select("h"), "h").groupBy("_id", "_hash").agg(F.collect_set("h").alias("hits"))
    return arrow_map(lines.join(cut(hits, "line-hits"), ["_id", "_hash"]).select("_id", "_text", "_hash", "hits"), by_list, _FOUND)


def _number(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def dropped_keys(docs: DataFrame, *, id_col: str, text_col: str, min_chars: int, min_docs: int, broadcast_bytes: int, bits_each: int) -> DataFrame:
    """Per document that loses lines: _id, _hash (of the text) and the keys it loses."""
    lines = docs.select(_number(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    segments = partitions(docs.sparkSession)
    found = cut(suspects(lines, twice_seen(lines, segments, min_chars, bits_each), segments, min_chars, broadcast_bytes, bits_each), "suspect-lines")
    counts = found.groupBy("key").agg(F.count_distinct("_id").alias("n"), F.max("_id").alias("keeper"))
    kept = cut(counts.where(F.col("n") >= min_docs), "repeated-lines")
    spread = F.concat(F.lit("#"), F.xxhash64("_id", "_hash").cast("string")).cast("binary")
    return cut(join_split(found, kept, "key", spread).where("_id <> keeper").groupBy("_id", "_hash").agg(F.collect_set("key").alias("_keys")), "dropped-lines")


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES, bits_each: int = BITS_EACH, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the text's repeated lines dropped; ``counts`` names columns to add: lines before, lines dropped."""
    drops = dropped_keys(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs, broadcast_bytes=broadcast_bytes, bits_each=bits_each)
    number, hashed, keys = unused(docs, "_id"), unused(docs, "_hash"), unused(docs, "_keys")
    drops = drops.select(F.col("_id").alias(number), F.col("_hash").alias(hashed), F.col("_keys").alias(keys))
    same = (_number(id_col) == F.col(number)) & (F.xxhash64(text_col) == F.col(hashed))
    joined = docs.join(drops.hint("shuffle_hash"), same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], keys)
    at, width = docs.columns.index(text_col), len(docs.columns)
    names = [*docs.columns, *(counts or ())]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text=at):
            texts, n_lines, n_dropped = [], [], []
            for t, gone in zip(_texts(b, at), b.column(width).to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                drop = set(gone or ())
                stay = [x for x in lines if line_key(x) not in drop] if drop else lines
                texts.append(b"\n".join(stay).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            cols = list(b.columns[:width])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if counts else [])], names=names)

    return arrow_map(joined, rewrite, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in counts or ())]))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``drop_lines`` with n_lines (before) and n_dropped."""
    return drop_lines(without(docs, ["n_lines", "n_dropped"]), counts=("n_lines", "n_dropped"), **how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), c AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, i, line, (c.k IS NOT NULL AND c.keeper <> l.doc_id) AS gone FROM l LEFT JOIN c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
