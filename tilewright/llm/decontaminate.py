"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is reduced to those of its shingles that may be shingles of an item, by a Bloom filter of all items' shingles
with 16 bits for each; that filter is broadcast if it stays below ``broadcast_bytes``, else documents' shingles are joined
with the items'. The reduction leaves the containment of every item unchanged and makes the rest short even in a long
document. The rests are partitioned by size (powers of two), and so are the items. For each pair of partitions the
containment threshold becomes a Jaccard threshold (from the larger bound of the rest's size), and from that follows how
many MinHash coordinates make a miss less likely than ``MISS``. Rest and item are candidates if they agree in one of these
coordinates: an equi-join. Pairs of partitions that would need more than ``MOST`` coordinates (a document that holds a
large part of the benchmark, and short items) are searched exactly instead: of an item of n shingles so many of the rarest
are keys that a rest without any of them can't hold enough of it. Candidates are verified by exact shingle containment,
counted by an equi-join on rest and shingle, so a long rest is never copied for each of its items.

Defined cases: null or wordless texts hold nothing; an item of fewer words than a shingle is one shingle of its own
length, and documents are searched for runs of that length as well; a null or wordless item is never found; repeated
rows give repeated results, repeated items one row each; rows that share an id, or have none, are searched and dropped
each by itself; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import SHINGLE_WORDS, Shingler, arrow_map, cut, mix, numbered, pieces, table, unused, windows
from tilewright.llm.line_dedup import Bloom, filter_bits

CONTAINMENT = 0.8
#: The items' filter.
BROADCAST_BYTES = 64 << 20
MISS = 1e-6
#: Coordinates of a set; what would need more is searched by the items' rarest shingles.
MOST = 512
#: Coordinates computed at a time; bounds memory at rest size times this.
STEP = 64


def coordinates(rest_class: int, item_class: int, t: float = CONTAINMENT) -> int:
    """MinHash coordinates for rests of at most 2^(rest_class+1)-1 shingles and items of at least 2^item_class."""
    most, least = 2 ** (rest_class + 1) - 1, 2**item_class
    jaccard = min(1.0, t * least / (max(most, t * least) + least * (1 - t)))
    return 1 if jaccard >= 1 else math.ceil(math.log(MISS) / math.log1p(-jaccard))


def size_class(n: int) -> int:
    return n.bit_length() - 1


def minhash(shingles: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` MinHash coordinates of a set: of each hash function, the least hash."""
    out = np.empty(n, np.uint64)
    for i in range(0, n, STEP):
        seeds = mix(np.arange(i + 1, min(n, i + STEP) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        blocks = np.array_split(shingles, len(shingles) // 20_000 + 1)
        out[i : i + STEP] = np.minimum.reduce([mix(x[None, :] ^ seeds[:, None]).min(1) for x in blocks])
    return out


def item_shingles(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in pieces(batches):
            words = [shingler.words(t) for t in b.column(1).to_pylist()]
            sets = [np.unique(windows(w, min(size, len(w)))) if len(w) else w for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([min(size, len(w)) for w in words], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["item_id", "run", "shingles"])

    return arrow_map(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")), run, "item_id long, run int, shingles array<long>").where(F.size("shingles") > 0)


def bloom_of(items: DataFrame, bits: int) -> bytes:
    """One filter of all items' shingles: made in at most eight tasks, joined by OR one at a time."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(bits)
        for b in batches:
            bloom.add(b.column(0).flatten().to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_pydict({"data": [bloom.data.tobytes()]})

    whole = Bloom(bits)
    for r in items.select("shingles").coalesce(8).mapInArrow(make, "data binary").toLocalIterator():
        np.bitwise_or(whole.data, np.frombuffer(r["data"], np.uint8), out=whole.data)
    return whole.data.tobytes()


def rare_keys(items: DataFrame, containment: float) -> DataFrame:
    """item, s: of each item the rarest shingles, as many as a text that holds enough of it can't all lack."""
    each = items.select("item", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    many = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    ranked = each.join(many, "s").groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("l"))
    need = (F.col("n") - F.ceil(containment * F.col("n") - F.lit(1e-9)) + 1).cast("int")
    return ranked.select("item", F.explode(F.slice("l", F.lit(1), need)).alias("x")).select("item", F.col("x.s").alias("s"))


def find_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT, size: int = SHINGLE_WORDS, broadcast_bytes: int = BROADCAST_BYTES, most: int = MOST) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, n_common, n_item (shingles), containment."""
    spark = docs.sparkSession
    parts = cut(item_shingles(items, item_col, item_text_col, size), "items")
    runs = sorted(r["run"] for r in parts.select("run").distinct().collect())
    item_classes = sorted(r["c"] for r in parts.select((F.length(F.bin(F.size("shingles").cast("long"))) - 1).alias("c")).distinct().collect())
    bits = filter_bits(parts.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first()["n"])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bloom = spark.sparkContext.broadcast(bloom_of(parts, bits)) if bits // 8 <= broadcast_bytes else None

    def rest(s: np.ndarray) -> tuple:
        return size_class(len(s)), xxhash.xxh3_128_digest(s.tobytes()), s.view(np.int64)

    def batch(got: list[tuple]) -> pa.RecordBatch:
        ids, part, digest, s = zip(*got, strict=True) if got else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(digest, pa.binary()), pa.array(s, pa.list_(pa.int64()))], names=["doc_id", "part", "digest", "shingles"])

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, filt = Shingler(size), Bloom(bits, bloom.value)
        for b in pieces(batches):
            got = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = shingler.words(t)
                s = np.concatenate([windows(w, n) for n in runs]) if runs else w[:0]
                s = np.unique(s[filt.has(s)])
                if len(s):
                    got.append((i, *rest(s)))
            yield batch(got)

    def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in pieces(batches, rows=64):
            words = [shingler.words(t) for t in b.column(1).to_pylist()]
            sets = [np.unique(np.concatenate([windows(w, n) for n in runs])) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["row", "s"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of_lists(batches):
            yield batch([(i, *rest(np.sort(s.values.to_numpy().view(np.uint64)))) for i, s in zip(b.column(0).to_pylist(), b.column(1), strict=True)])

    kind = "doc_id long, part int, digest binary, shingles array<long>"
    if bloom is not None:
        found = arrow_map(texts, rests, kind)
    else:
        rows = numbered(texts, "row")
        known = cut(parts.select(F.explode("shingles").alias("s")).distinct(), "item-shingles")
        hits = arrow_map(rows.select("row", "text"), all_shingles, "row long, s long").join(known, "s").groupBy("row").agg(F.collect_set("s").alias("shingles"))
        found = arrow_map(hits.join(rows.select("row", "doc_id"), "row").select("doc_id", "shingles"), gathered, kind)
    found = numbered(found, "row")
    # documents with the same rest (copies; one passage in many documents) are searched once
    one = cut(found.join(found.groupBy("digest").agg(F.min("row").alias("row")).select("row"), "row", "left_semi").select("row", "part", "shingles"), "rests")
    rest_classes = sorted(r["part"] for r in found.select("part").distinct().collect())
    # by both sizes: coordinates, or none where there would be too many
    need = {(p, c): n for p in rest_classes for c in item_classes if containment * 2**c <= 2 ** (p + 1) - 1 and (n := coordinates(p, c, containment)) <= most}
    exact = [(p, c) for p in rest_classes for c in item_classes if containment * 2**c <= 2 ** (p + 1) - 1 and (p, c) not in need]

    def signed(rows: list[tuple[int, int, int, np.ndarray]], name: str) -> pa.RecordBatch:
        """(id, part, coordinates, MinHash) to one row for each coordinate."""
        n = [r[2] for r in rows]
        ids, part = (np.repeat(np.array([r[k] for r in rows], np.int64), n) for k in (0, 1))
        place = np.concatenate([np.arange(x, dtype=np.int32) for x in n]) if rows else np.empty(0, np.int32)
        h = np.concatenate([r[3][: r[2]] for r in rows]).view(np.int64) if rows else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part.astype(np.int32)), pa.array(place), pa.array(h)], names=[name, "part", "place", "h"])

    def sign_rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of_lists(batches):
            rows = []
            for row, part, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                # an item of which enough is within the rest has at most so many shingles; the smallest needs most
                n = max((n for (p, c), n in need.items() if p == part and containment * 2**c <= len(s)), default=0)
                rows += [(row, part, n, minhash(np.array(s, np.int64).view(np.uint64), n))] if n else []
            yield signed(rows, "row")

    def sign_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of_lists(batches):
            rows = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = {p: n for (p, c), n in need.items() if c == size_class(len(s)) and containment * len(s) <= 2 ** (p + 1) - 1}
                m = minhash(np.array(s, np.int64).view(np.uint64), max(mine.values(), default=0))
                rows += [(i, p, n, m) for p, n in mine.items()]
            yield signed(rows, "item")

    items_of = numbered(parts, "item")
    left = one.mapInArrow(sign_rests, "row long, part int, place int, h long")
    right = items_of.select("item", "shingles").mapInArrow(sign_items, "item long, part int, place int, h long")
    pairs = left.join(right, ["part", "place", "h"]).select("row", "item")
    in_rest = one.select("row", F.explode("shingles").alias("s"))
    if exact:
        klass = F.length(F.bin(F.size("shingles").cast("long"))) - 1
        both = spark.createDataFrame(exact, "part int, class int")
        keys = rare_keys(items_of.select("item", "shingles"), containment).join(items_of.select("item", klass.alias("class")), "item").join(F.broadcast(both), "class")
        pairs = pairs.union(one.select("row", "part", F.explode("shingles").alias("s")).join(keys, ["part", "s"]).select("row", "item"))
    pairs = cut(pairs.distinct(), "item-pairs")
    common = pairs.join(items_of.select("item", F.explode("shingles").alias("s")), "item").join(in_rest, ["row", "s"]).groupBy("row", "item").agg(F.count(F.lit(1)).alias("n_common"))
    sized = common.join(items_of.select("item", "item_id", F.size("shingles").cast("long").alias("n_item")), "item").where(F.col("n_common") >= containment * F.col("n_item"))
    verified = sized.join(found.select("row", "digest"), "row").select("digest", "item_id", "n_common", "n_item")
    return found.select("doc_id", "digest").join(verified, "digest").select("doc_id", "item_id", "n_common", "n_item", (F.col("n_common") / F.col("n_item")).alias("containment"))


def pieces_of_lists(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    number = unused(docs, "_row")
    rows = numbered(docs, number)
    bad = find_items(rows, items, id_col=number, **how).select(F.col("doc_id").alias(number)).distinct()
    return rows.join(bad, number, "left_anti").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') FROM benchmark),
r AS (SELECT DISTINCT least(5, len(ws)) AS r FROM w WHERE kind = 1 AND len(ws) > 0),
s AS (SELECT DISTINCT kind, id, array_to_string(list_slice(ws, i, i + r - 1), ' ') AS g
  FROM (SELECT kind, id, ws, r, unnest(range(1, len(ws) - r + 2)) AS i FROM w JOIN r ON kind = 0 OR r = least(5, len(ws)))),
i AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE kind = 1)
SELECT d.id AS doc_id, i.item_id, count(*) AS n_common, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM s d JOIN i ON d.g = i.g WHERE d.kind = 0 GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n_item)
"""
