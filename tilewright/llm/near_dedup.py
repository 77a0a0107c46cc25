"""Near-duplicate classes by DartMinHash signatures, banded joining and exact confirmation.

DartMinHash: the shingles of a document are regions of a plane (weight up, rank to the right). Each unit of weight of
each shingle receives darts from a hashed Poisson process along the rank axis; a dart also carries a coordinate and a
height in its unit. Of the darts below a shingle's weight the earliest of each coordinate is kept. Darts are thrown
only as far right as about ``k ln k`` of them need, so the work doesn't depend on the document's length beyond one pass.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

1. ``signatures``: one pass over the texts gives each document a digest of its shingle set and its bands.
2. Documents with equal shingle sets collapse to one of them (pre-aggregated, so thousands of copies cost nothing).
3. Representatives that share a band are linked to the band's smallest and largest member, not to each other: the
   number of links is at most twice the number of rows, whatever the size of the group.
4. Links are confirmed by exact Jaccard similarity of the shingle sets; the connected components of the confirmed links
   are the classes so far. The links of a document that is the end of large buckets are dealt out in cells of about
   ``CELL``, each with the document's text once.
5. Buckets that still hold two classes are dealt anew by one more common band, up to ``DEPTH`` bands, and linked again
   by their ends.
6. Members of buckets of one band that still hold two classes may be near to others than the ends they met. A prefix
   filter join over all of them finds every two classes that are left with a link (``rest_links``), so no link between
   documents that share a band is lost. The join is one of blocks of documents, and pairs are never made as rows: two
   blocks meet in one task, which counts the common shingles of their documents by a matrix product.
7. A class is named by its smallest id.

Rows are told apart by a number that is written with them once, not by their id. Defined cases: documents without a word
(null, empty, punctuation) are near only to rows with the same text (null as empty); shorter texts than a shingle are one
shingle; rows that share an id, or have none, are documents of their own, one row of the result each; a class of which
no row has an id is named null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import SHINGLE_WORDS, Shingler, arrow_map, cut, join_split, mix, numbered, pieces, remove, table, unused, written

BANDS, ROWS = 24, 6
SIMILARITY = 0.8
DEPTH = 2
#: Documents of a block, shingles of a block, and links of one end in a cell, about.
BLOCK = 256
BLOCK_SHINGLES = 1 << 16
#: Blocks of a strip, at most; a task holds the shared shingles of one strip (some 32 MB).
STRIP_BITS = 6
STRIP = 1 << STRIP_BITS
CELL = 64
#: Set sizes from which tiers of a factor of about 1.03 begin.
TIERS = np.unique((1.03 ** np.arange(730)).astype(np.int64))
#: Documents and characters whose darts are thrown together, at most; arrays of all darts at once are made of them.
SIGNED = 64
SIGNED_CHARS = 200_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Ranks of darts are counted in this part of a unit.
UNIT = 1 << 30


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int, seed: int = 1) -> np.ndarray:
    """Weighted MinHash signatures, n_docs x k of uint64 dart ids; rows of documents without elements are 0.

    ``elements`` (uint64), ``weights`` (positive floats) and ``doc`` are parallel; an element occurs once per document.
    """
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weights, n_docs)
    far = np.divide(k * (np.log(k) + 3), total, out=np.zeros(n_docs), where=total > 0)
    todo = total > 0
    layers = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    start = mix(elements[at] ^ mix(layer.astype(np.uint64) + np.uint64(seed) * _GOLD))
    while todo.any():
        at_row = np.flatnonzero(todo[doc[at]])
        limit = np.ceil(far[doc[at[at_row]]] * UNIT).astype(np.int64)
        thrown, rank = np.zeros(len(at_row), np.int64), np.zeros(len(at_row), np.int64)
        keys, ranks, ids = [], [], []
        while len(at_row):
            # as many darts of each process as will about do, in one flat array; whole ranks add up the same in any parts
            ahead = (limit - rank) / UNIT
            n = np.ceil(ahead + np.sqrt(ahead)).astype(np.int64) + 1
            last = np.cumsum(n) - 1
            of = np.repeat(np.arange(len(n)), n)
            number = np.arange(len(of)) - (last - n + 1)[of] + thrown[of] + 1
            h = mix(start[at_row][of] + number.astype(np.uint64) * _GOLD)
            step = (-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * UNIT).astype(np.int64)
            walked = np.cumsum(step)
            r = walked + (rank - (walked[last] - np.add.reduceat(step, last - n + 1)))[of]
            near = r < limit[of]
            h, of_row, r_near = h[near], at_row[of[near]], r[near]
            z = mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
            inside = layer[of_row] + (z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < weights[at[of_row]]
            keys.append((doc[at[of_row]] * k + ((z >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64))[inside])
            ranks.append(r_near[inside])
            ids.append(h[inside])
            more = r[last] < limit
            at_row, limit, thrown, rank = at_row[more], limit[more], (thrown + n)[more], r[last][more]
        key, r, i = map(np.concatenate, (keys, ranks, ids)) if keys else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        earliest = np.full(n_docs * k, np.iinfo(np.int64).max)
        np.minimum.at(earliest, key, r)
        first = np.flatnonzero(earliest[key] == r)
        out.ravel()[key[first]] = i[first]
        full = (earliest.reshape(n_docs, k) < np.iinfo(np.int64).max).all(axis=1)
        todo &= ~full
        far[todo] *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        out = mix(out * _GOLD + sig[:, j : bands * rows : rows] + np.uint64(1))
    return out.view(np.int64)


def signatures(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE_WORDS, weighting: str = "set") -> DataFrame:
    """``docs`` (_id, text, doc_id) to _id, doc_id, digest of the shingle set (or of a wordless text), bands (null if
    wordless).

    ``weighting``: "set" weighs every shingle 1; "count" by its number in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in pieces(batches, rows=SIGNED, chars=SIGNED_CHARS):
            texts = b.column(1).to_pylist()
            sets = [np.unique(shingler.ordered(t), return_counts=True) for t in texts]
            digest = [xxhash.xxh3_128_digest(s.tobytes() if len(s) else b"text:" + (t or "").encode()) for (s, _), t in zip(sets, texts, strict=True)]
            n = np.array([len(s) for s, _ in sets])
            elements = np.concatenate([s for s, _ in sets])
            weights = np.concatenate([c for _, c in sets]).astype(np.float64) if weighting == "count" else np.ones(len(elements))
            sig = dart_signatures(elements, weights, np.repeat(np.arange(len(sets)), n), len(sets), bands * rows)
            flat = pa.array(band_hashes(sig, bands, rows).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
            none = pa.array(n == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digest, pa.binary()), pc.if_else(none, pa.scalar(None, lists.type), lists)], names=["_id", "doc_id", "digest", "bands"])

    return arrow_map(docs.select("_id", "text", "doc_id"), run, "_id long, doc_id long, digest binary, bands array<long>")


def confirmed(links: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (a, b, hub, cell) to a, b and the exact Jaccard similarity of both shingle sets, from the texts.

    ``hub`` is one of the two; the text of a hub goes once to each of its cells, the other's text once for each link.
    """
    other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    dealt = cut(links.select("hub", "cell", other.alias("member")), "dealt")
    need = dealt.select(F.col("hub").alias("_id")).union(dealt.select("member")).distinct()
    # one plan at every size: the ids grow with the data, so they are never broadcast
    texts = docs.join(need.hint("shuffle_hash"), "_id", "left_semi").select("_id", "text")
    hubs = dealt.select("hub", "cell").distinct().hint("shuffle_hash").join(texts.withColumnRenamed("_id", "hub"), "hub").select("hub", "cell", F.lit(None).cast("long").alias("member"), "text")
    members = dealt.hint("shuffle_hash").join(texts.withColumnRenamed("_id", "member"), "member").select("hub", "cell", "member", "text")
    rows = hubs.union(members).repartition("hub", "cell").sortWithinPartitions("hub", "cell", F.asc_nulls_first("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, of, p = Shingler(size), None, None
        for x in pieces(batches, rows=1024, text=3):
            a, b, out = [], [], []
            for hub, member, text in zip(*(x.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if member is None:
                    of, p = (hub, p) if hub == of else (hub, shingler.distinct(text))
                    continue
                q = shingler.distinct(text)
                common = len(np.intersect1d(p, q, assume_unique=True))
                a.append(min(hub, member))
                b.append(max(hub, member))
                out.append(common / max(1, len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return arrow_map(rows, run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, label (its component's smallest node).

    Each round takes the smallest label of the neighbours and then follows labels one step (pointer jumping); the
    state of a round is a written table. Ends when a round changes nothing.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        remove(links.sparkSession, labels.cut_path)
        labels = new
        if new.where("was <> label").isEmpty():
            remove(links.sparkSession, edges.cut_path)
            return labels.select("node", "label")


def mixed(active: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (rep, used, key) of the buckets that hold two classes or more, with their class ``own`` and the bucket's
    smallest and largest member: ``first``, ``last`` (structs of rep and own), and number of members ``n``. The ends are
    written, and the rows of the largest buckets are dealt out by member (``join_split``)."""
    if labels is None:
        rows = active.withColumn("own", F.col("rep"))
    else:
        rows = active.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "used", "key", F.coalesce("label", "rep").alias("own"))
    one = F.struct("rep", "own")
    ends = rows.groupBy("key").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.min("own").alias("_lo"), F.max("own").alias("_hi"), F.count(F.lit(1)).alias("n")).where("_lo <> _hi").drop("_lo", "_hi")
    return join_split(rows, cut(ends, "bucket-ends"), "key", F.xxhash64("rep", "used")).where("n is not null")


def link(hub: Column, member: Column, n: Column) -> Column:
    """A link as a struct; ``n`` links of the hub, or fewer, come from the same group."""
    return F.struct(F.least(hub, member).alias("a"), F.greatest(hub, member).alias("b"), F.struct(hub.alias("hub"), F.pmod(F.xxhash64(member), F.ceil(n / CELL)).alias("cell")).alias("at"))


def each_once(links: DataFrame) -> DataFrame:
    """Links ``l`` to a, b, hub, cell, one row for each pair."""
    return links.groupBy("l.a", "l.b").agg(F.min("l.at").alias("at")).select("a", "b", "at.hub", "at.cell")


def star_links(members: DataFrame) -> DataFrame:
    """Links of each member with its bucket's ends, where the classes differ."""
    ends = F.array(F.col("first"), F.col("last"))
    pairs = members.select("rep", "own", "n", F.explode(ends).alias("end")).where(F.col("end.own") != F.col("own"))
    return each_once(pairs.select(link(F.col("end.rep"), F.col("rep"), F.col("n")).alias("l")))


def narrower(members: DataFrame) -> DataFrame:
    """Members of mixed buckets dealt anew to buckets of one band more.

    Two members of different classes that share a band make its bucket mixed, so only a member's mixed bands count; each
    set of bands is made once, in ascending order.
    """
    mine = members.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("_mixed"))
    rows = members.select("rep", "used").join(mine, "rep").select("rep", "used", F.explode(F.filter("_mixed", lambda j: j > F.array_max("used"))).alias("_j"))
    return keyed(rows.select("rep", F.concat("used", F.array("_j")).alias("used")))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (rep, used) with the bucket's key; ``used`` lists the bands as structs of number and hash."""
    return rows.select("rep", "used", F.xxhash64("used").alias("key"))


def prefix_keys(n: int, shared: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set of ``n`` shingles, of which two sets of at least this similarity have one in common.

    Sets of n and m shingles must share ``o = similarity / (1 + similarity) * (n + m)``, so the first ``n - o + 1`` and
    ``m - o + 1`` of them in one common order, here the rarest first, share one. ``o`` depends on both sizes, so each
    tier of the other's size has keys of its own, for the smallest size in it. Shingles that no other class has come
    first in the order and can't be common: they are left out; ``shared`` are the others in order.
    """
    alone = n - len(shared)
    least, most = math.ceil(similarity * n - 1e-9), math.floor(n / similarity + 1e-9)
    own, *others = np.searchsorted(TIERS, [n, least, most], "right") - 1
    out = []
    for k in range(others[0], others[1] + 1):
        o = math.ceil(similarity / (1 + similarity) * (n + max(least, int(TIERS[k]))) - 1e-9)
        if n - o + 1 > alone:
            out.append(mix(shared[: n - o + 1 - alone] ^ mix(np.array([min(own, k) << 16 | max(own, k)], np.uint64))))
    return np.concatenate(out) if out else shared[:0]


def near_pairs(left: list[tuple], right: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Of documents (rep, own, n, shared) those pairs of different classes with at least this similarity, one for each two
    classes. All shingles that a pair may have in common are in ``shared``."""

    def flat(docs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([d[3] for d in docs]), np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])

    (x, i), (y, j) = flat(left), flat(right)
    words = np.intersect1d(x, y)

    def placed(v: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(words, v), max(0, len(words) - 1))
        hit = words[at] == v if len(words) else np.zeros(len(v), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], doc[hit][order]

    (x, i), (y, j) = placed(x, i), placed(y, j)
    common = np.zeros((len(left), len(right)))
    for low in range(0, len(words), 4096):
        part = []
        for v, doc, n in ((x, i, len(left)), (y, j, len(right))):
            lo, hi = np.searchsorted(v, [low, low + 4096])
            m = np.zeros((n, min(4096, len(words) - low)), np.float32)
            m[doc[lo:hi], v[lo:hi] - low] = 1
            part.append(m)
        common += part[0] @ part[1].T
    n, m, own, other = (np.array([d[k] for d in docs]) for docs, k in ((left, 2), (right, 2), (left, 1), (right, 1)))
    near = (common / np.maximum(1, n[:, None] + m[None, :] - common) >= similarity) & (own[:, None] != other[None, :])
    found = {}
    for i, j in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
        found.setdefault((min(own[i], other[j]), max(own[i], other[j])), (left[i][0], right[j][0]))
    return [(min(p), max(p)) for p in found.values()]


def rest_links(rest: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (a, b) of at least this similarity between members (rep, own) of different classes: of each two classes in
    two blocks one, if there is one.

    How many documents have a shingle, and whether two classes have it, is counted exactly; the order of the prefixes is
    taken from that. So a passage that many documents share makes keys only for those that have little else. A block
    holds documents with the same most frequent shingle, so a family that shares a passage fills few blocks. The blocks of
    a family form strips of about half the square root of their number. Each pair of strips is one group: its first strip
    is held, the blocks of the other stream past and meet those that the prefix keys name. So a family of m blocks sends
    about 2 * m ** 1.5 blocks, not m ** 2 (with the widest strips, beyond 16,000 blocks, m ** 2 / 64).
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in pieces(batches):
            found = [shingler.distinct(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int64()))], names=["rep", "own", "shingles"])

    texts = docs.join(rest.withColumnRenamed("rep", "_id").hint("shuffle_hash"), "_id").select("_id", "text", "own")
    rows = cut(arrow_map(texts, sets, "rep long, own long, shingles array<long>"), "rest-shingles")
    each = rows.select("rep", "own", F.explode("shingles").alias("s"))
    shared = cut(each.groupBy("s").agg(F.min("own").alias("_lo"), F.max("own").alias("_hi"), F.count(F.lit(1)).alias("n")).where("_lo <> _hi").select("s", "n"), "shared-shingles")
    ordered = each.select("rep", "s").join(shared, "s").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("shared"))
    of = cut(rows.select("rep", "own", F.size("shingles").alias("n")).join(ordered, "rep").select("rep", "own", "n", F.transform("shared", lambda x: x["s"]).alias("shared")).withColumn("top", F.element_at("shared", -1)), "rest-sets")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("shared")) / BLOCK_SHINGLES))
    tops = of.groupBy("top").agg(parts.alias("parts")).withColumn("wide", F.least(F.lit(STRIP), F.ceil(F.sqrt("parts") / 2)))
    blocks = cut(tops, "rest-tops")
    part = F.pmod(F.xxhash64("rep"), "parts")
    block = (F.floor(part / F.col("wide")), part % F.col("wide"))
    placed = cut(of.join(blocks, "top").select("rep", "own", "n", "shared", (F.shiftleft(F.xxhash64("top", block[0]), STRIP_BITS) + block[1]).alias("block")), "rest-blocks")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for b in slices(x):
                found = [prefix_keys(n, s.values.to_numpy().view(np.uint64), similarity) for n, s in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
                many = [len(k) for k in found]
                own, block = (np.repeat(b.column(i).to_numpy(), many) for i in (0, 3))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(own), pa.array(block)], names=["key", "own", "block"])

    emitted = arrow_map(placed.select("own", "n", "shared", "block"), emit, "key long, own long, block long")
    met = cut(emitted.groupBy("key", "block").agg(F.min("own").alias("lo"), F.max("own").alias("hi")), "prefix-blocks")
    a, b = (met.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "lo", "hi")]) for side in "ab")
    tiles = a.join(b, "key").where((F.col("block_a") <= F.col("block_b")) & (F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b")))
    tiles = cut(tiles.select("block_a", "block_b").distinct(), "tiles")
    pair = [F.shiftright(f"block_{side}", STRIP_BITS).alias(f"strip_{side}") for side in "ab"]
    strips = tiles.select(*pair, "block_a", "block_b")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rep", "long"), ("own", "long"), ("n", "int"), ("shared", "array<long>"))]
    heads = strips.groupBy("strip_a", "strip_b", "block_b").agg(F.collect_list("block_a").alias("meets")).select("strip_a", "strip_b", F.lit(1).alias("side"), F.col("block_b").alias("block"), *none, "meets")
    # both strips are the same one: its blocks go there once
    left, right = strips.select("strip_a", "strip_b", F.lit(0).alias("side"), F.col("block_a").alias("block")), strips.select("strip_a", "strip_b", F.when(F.col("strip_a") < F.col("strip_b"), 1).otherwise(0).alias("side"), F.col("block_b").alias("block"))
    sent = left.union(right).distinct().join(placed, "block").select("strip_a", "strip_b", "side", "block", "rep", "own", "n", "shared", F.lit(None).cast("array<long>").alias("meets"))
    dealt = heads.union(sent).repartition("strip_a", "strip_b").sortWithinPartitions("strip_a", "strip_b", "side", "block", F.asc_nulls_first("rep"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, meets, docs_of = None, {}, None, [], []

        def links() -> pa.RecordBatch:
            found = [p for m in meets for p in near_pairs(held[m], docs_of or held[block], similarity)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for x in batches:
            for a, b, side, of, rep, own, n, s, m in zip(*(x.column(i).to_pylist() for i in range(7)), x.column(7), x.column(8).to_pylist(), strict=True):
                if (a, b) != at or side and of != block:
                    yield links()
                    meets, docs_of = [], []
                    if (a, b) != at:
                        at, held, block = (a, b), {}, None
                if rep is None:
                    block, meets = of, m
                else:
                    (docs_of if side else held.setdefault(of, [])).append((rep, own, n, s.values.to_numpy().copy()))
        yield links()

    return arrow_map(dealt, compare, "a long, b long")


def slices(b: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def row_classes(rows: DataFrame, **how) -> DataFrame:
    """Of rows (_id: a number of each row, doc_id, text) per row: _id, doc_id, copy and keeper: structs (absent, doc_id,
    _id) of the row that stands for its shingle set and for its class, that of the smallest id."""
    with written() as paths:
        signed, of_set = sets_of_classes(rows, **how)
        keep = [signed.cut_path, of_set.cut_path]
        remove(rows.sparkSession, *[p for p in paths if p not in keep])
        paths[:] = keep
    return signed.select("_id", "doc_id", "digest").join(of_set, "digest").select("_id", "doc_id", "copy", "keeper")


def sets_of_classes(rows: DataFrame, *, bands: int = BANDS, rows_each: int = ROWS, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Two written tables: of each row its shingle set's digest, and of each set the rows ``copy`` and ``keeper``."""
    texts = rows.select("_id", "text")
    signed = cut(signatures(rows, bands=bands, rows=rows_each, size=size), "signatures")
    me = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_id")
    sets = cut(signed.groupBy("digest").agg(F.min(me).alias("copy")).withColumn("rep", F.col("copy._id")), "sets")
    own = signed.where(F.col("bands").isNotNull()).join(sets.select(F.col("rep").alias("_id")), "_id", "left_semi").select(F.col("_id").alias("rep"), "bands")
    labels, found, tried, widest = None, None, None, None
    active = keyed(own.select("rep", F.posexplode("bands").alias("i", "h")).select("rep", F.array(F.struct("i", "h")).alias("used")))
    for level in range(1, depth + 1):
        members = cut(mixed(active, labels), "buckets")
        widest = members if level == 1 else widest
        links = star_links(members)
        links = links if tried is None else links.join(tried, ["a", "b"], "left_anti")
        scored = cut(confirmed(links, texts, similarity, size), "links")
        tried = scored.select("a", "b") if tried is None else tried.union(scored.select("a", "b"))
        new = scored.where(F.col("similarity") >= similarity).select("a", "b")
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            labels = components(found)
        if level < depth:
            left = cut(mixed(members.select("rep", "used", "key"), labels).select("rep", "used"), "mixed")
            active = cut(narrower(left), "narrowed")
    rest = cut(mixed(widest.select("rep", "used", "key"), labels).select("rep", "own").distinct(), "rest")
    if not rest.isEmpty():
        new = cut(rest_links(rest, texts, similarity, size), "rest-links")
        if not new.isEmpty():
            labels = components(new if found is None else found.union(new))
    if labels is None:
        return signed, cut(sets.select("digest", "copy", F.col("copy").alias("keeper")), "sets-named")
    linked = cut(labels.withColumnRenamed("node", "rep").join(sets.select("rep", "copy"), "rep"), "linked")
    keepers = cut(linked.groupBy("label").agg(F.min("copy").alias("keeper")), "keepers")
    named = cut(linked.select("rep", "label").join(keepers, "label").select("rep", "keeper"), "named")
    of_set = cut(sets.join(named, "rep", "left").select("digest", "copy", F.coalesce("keeper", "copy").alias("keeper")), "sets-named")
    return signed, of_set


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of (the id that stands for its shingle set)."""
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "_id")
    return row_classes(rows, **how).select("doc_id", F.col("keeper.doc_id").alias("class_id"), F.col("copy.doc_id").alias("copy_of"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; a missing id comes last."""
    number = unused(docs, "_row")
    rows = numbered(docs, number)
    found = row_classes(rows.select(F.col(number).alias("_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), **how)
    kept = found.where(F.col("_id") == F.col("keeper._id")).select(F.col("_id").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
