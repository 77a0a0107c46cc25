"""Approximate nearest neighbours by cosine: vantage-point trees per shard, pruned by a relaxed triangle inequality.

1. A bounded sample (``sample_bytes`` of vectors, those of the smallest hashes) gives the router, a vantage-point tree
   whose leaves are regions, and a bound on each query's k-th nearest. Nothing else is fitted; every row is indexed.
2. Rows go down the router to their region. A region with more than ``shard_bytes`` of vectors is dealt over several
   shards by row number, so a dense region or a vector that a third of all rows hold is split.
3. A query goes to the shards of the regions that the inequality can't rule out. Distances are angles, which obey the
   triangle inequality. A region is ruled out where ``factor`` times its least possible angle from the query exceeds the
   bound. Factor 1 rules out nothing that holds a nearer row: the search is exact. Greater ones rule out more. In its own
   region a query starts without a bound, and where that region has no more than ``k`` rows everywhere, so each query
   finds ``k`` rows.
4. Rows and queries are partitioned by shard, rows first. A task builds its shard's tree from the rows, then answers the
   queries batch by batch as they stream past, ruling out branches by the same inequality with the bound found so far.
   Equal vectors of a shard are one point of the tree that keeps as many of its smallest ids as any query may need.
5. The shards' answers, ``k`` at most for each query, are merged by score, then id.

Scores are the cosines of the original vectors in double precision, summed in one fixed way, so that equal vectors tie
whatever shard they are in; matrix products only choose candidates, with a margin above their rounding.

Defined cases: rows without an id, and vectors that are null, zero, hold null or non-finite components or overflow when
squared, or that haven't ``dim`` components (default: the most frequent length, of equally frequent ones the longest),
take no part; a query has fewer than ``k`` rows if there are fewer candidates; ties go to the smaller id; each row of a
repeated id is a candidate, and a query of its own; rows with the query's own id aren't its candidates; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut, partitions, table

#: Recall on directions without any structure, the hardest case, is in the README. 1 is exact.
FACTOR = 4.0
SAMPLE_BYTES = 8 << 20
SHARD_BYTES = 64 << 20
#: Rows of the sample for each region at least, rows of a shard at least where there are few.
REGION_SAMPLE, SHARD_LEAST = 16, 64
LEAF = 256
#: Margins above the rounding of matrix products (cosines) and of arc cosines near 1 (angles).
_CLOSE, _SLACK = 1e-12, 1e-6
QUERY_ROWS = 1024
_TO = pa.list_(pa.struct([("shard", pa.int32()), ("bound", pa.float64())]))


def _angles(unit: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ point, -1.0, 1.0))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal rows give equal results at any place."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _vantage(unit: np.ndarray, rows: np.ndarray) -> int:
    """Of nine rows spread over ``rows`` the one whose angles to a spread of the others vary most."""
    tried = rows[np.linspace(0, len(rows) - 1, 9).astype(np.int64)]
    seen = rows[np.linspace(0, len(rows) - 1, min(len(rows), 256)).astype(np.int64)]
    return int(tried[np.argmax(np.arccos(np.clip(unit[seen] @ unit[tried].T, -1.0, 1.0)).std(axis=0))])


class Router:
    """A complete vantage-point tree over a sample: vantage point and split angle of each inner node, in heap order."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.depth = max(0, (max(1, regions) - 1).bit_length())
        self.points, self.split = np.zeros(((1 << self.depth) - 1, sample.shape[1])), np.full((1 << self.depth) - 1, np.pi)
        held = {0: np.arange(len(sample))}
        for node in range(len(self.split)):
            rows = held.pop(node)
            if len(rows):
                self.points[node] = sample[_vantage(sample, rows)]
                angle = _angles(sample[rows], self.points[node])
                self.split[node] = np.median(angle)
                held[2 * node + 1], held[2 * node + 2] = rows[angle <= self.split[node]], rows[angle > self.split[node]]
            else:
                held[2 * node + 1] = held[2 * node + 2] = rows

    @property
    def regions(self) -> int:
        return 1 << self.depth

    def _go(self, unit: np.ndarray, reach: np.ndarray | None) -> Iterator[tuple[np.ndarray, int]]:
        """Rows of ``unit`` that get to each region: with a reach, to all that it can't rule out, else to one."""
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node >= len(self.split):
                yield rows, node - len(self.split)
                continue
            over = _angles(unit[rows], self.points[node]) - self.split[node]
            if reach is None:
                todo += [(2 * node + 1, rows[over <= 0]), (2 * node + 2, rows[over > 0])]
            else:
                todo += [(2 * node + 1, rows[over <= reach[rows]]), (2 * node + 2, rows[-over <= reach[rows]])]

    def region(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(unit), np.int32)
        for rows, r in self._go(unit, None):
            out[rows] = r
        return out

    def within(self, unit: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        """The regions that may hold something within ``reach`` (an angle) of each row."""
        out: list[list[int]] = [[] for _ in range(len(unit))]
        for rows, r in self._go(unit, reach):
            for i in rows.tolist():
                out[i].append(r)
        return out


def reach(bound: np.ndarray, factor: float) -> np.ndarray:
    """The angle beyond which nothing is looked for, by a bound on the k-th cosine (below -1: no bound)."""
    return np.where(bound < -1.0, np.pi, np.arccos(np.clip(bound, -1.0, 1.0)) / factor) + _SLACK


def sample_bounds(unit: np.ndarray, own: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th cosine: that among the sample's other ids; -2 where these are fewer than k."""
    if len(sample) < k:
        return np.full(len(unit), -2.0)
    s = unit @ sample.T
    s[own[:, None] == sample_ids[None, :]] = -2.0
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


class ShardTree:
    """Vantage-point tree of one shard's rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.k = k
        order = np.lexsort((ids, (vectors * np.cos(np.arange(vectors.shape[1]))).sum(axis=1)))
        vectors, ids = vectors[order], ids[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)]) if len(ids) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        # of a vector's rows no query needs more than k of one id, and 2k in all (k of them may be its own)
        keep = self._place(group, ids) < k
        group, ids = group[keep], ids[keep]
        keep = self._place(group) < 2 * k
        group, ids = group[keep], ids[keep]
        self.vectors = vectors[new]
        self.unit = _units(self.vectors)
        n = len(self.unit)
        self.perm = np.arange(n)
        self._build(n)
        self.unit = np.ascontiguousarray(self.unit[self.perm])
        self.vectors = self.vectors[self.perm]
        first = np.searchsorted(group, np.arange(n + 1))
        self.ids, self.first, self.count = ids, first[:-1][self.perm], np.diff(first)[self.perm]
        low, high = ids[first[:-1]][self.perm], ids[first[1:] - 1][self.perm]
        self.only = np.where(low == high, low, np.iinfo(np.int64).min)  # the one id of a vector that has one
        self.single = low == high

    @staticmethod
    def _place(*keys: np.ndarray) -> np.ndarray:
        """Number of each row among those before it with the same keys (sorted by them)."""
        n = len(keys[0])
        new = np.ones(n, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        begin = np.flatnonzero(new)
        return np.arange(n) - begin[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)

    def _build(self, n: int) -> None:
        """Nodes: (vantage row, near low, near high, far low, far high, near node, far node), leaves: (begin, end)."""
        self.nodes: list[tuple] = [()]
        todo = [(0, 0, n)]
        while todo:
            node, begin, end = todo.pop()
            rows = self.perm[begin:end]
            if end - begin > LEAF:
                point = _vantage(self.unit, rows)
                angle = _angles(self.unit[rows], self.unit[point])
                middle = (end - begin) // 2
                order = np.argpartition(angle, middle)
                self.perm[begin:end], angle = rows[order], angle[order]
                near, far = angle[:middle], angle[middle:]
                i = len(self.nodes)
                self.nodes += [(), ()]
                self.nodes[node] = (self.unit[point].copy(), near.min(), near.max(), far.min(), far.max(), i, i + 1)
                todo += [(i, begin, begin + middle), (i + 1, begin + middle, end)]
            else:
                self.nodes[node] = (begin, end)

    def search(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and cosine of the ``k`` nearest rows of the shard to each query, as far as they reach ``bound``."""
        unit = _units(queries)
        best = np.full((len(queries), self.k), -2.0)
        bound, pairs = bound.copy(), []

        def scan(begin: int, end: int, rows: np.ndarray) -> None:
            s = unit[rows] @ self.unit[begin:end].T
            s[self.single[None, begin:end] & (own[rows, None] == self.only[None, begin:end])] = -3.0
            top = np.concatenate([best[rows], s], axis=1)
            top = np.partition(top, top.shape[1] - self.k, axis=1)[:, -self.k :]
            best[rows], bound[rows] = top, np.maximum(bound[rows], top.min(axis=1))
            q, x = np.nonzero(s >= np.maximum(bound[rows], -2.0)[:, None] - _CLOSE)
            pairs.append((rows[q], x + begin, s[q, x]))

        home = np.zeros(len(queries), np.int64)
        todo = [(0, np.arange(len(queries)))]
        while todo:  # each query's nearest leaf first, for a good bound
            node, rows = todo.pop()
            if not len(rows):
                continue
            if len(self.nodes[node]) == 2:
                home[rows] = node
                scan(*self.nodes[node], rows)
                continue
            point, _, near_high, far_low, _, near, far = self.nodes[node]
            angle = _angles(unit[rows], point)
            inside = angle <= (near_high + far_low) / 2
            todo += [(near, rows[inside]), (far, rows[~inside])]
        todo = [(0, np.arange(len(queries)))]
        while todo:  # then all branches that aren't ruled out, each once for all its queries
            node, rows = todo.pop()
            if not len(rows):
                continue
            if len(self.nodes[node]) == 2:
                if len(rows := rows[home[rows] != node]):
                    scan(*self.nodes[node], rows)
                continue
            point, near_low, near_high, far_low, far_high, near, far = self.nodes[node]
            angle, far_enough = _angles(unit[rows], point), reach(bound[rows], factor)
            todo += [(child, rows[np.maximum(angle - high, low - angle) <= far_enough]) for child, low, high in ((far, far_low, far_high), (near, near_low, near_high))]
        q, x, s = (np.concatenate(p) for p in zip(*pairs, strict=True))
        keep = s >= bound[q] - _CLOSE
        q, x = q[keep], x[keep]
        score = cosines(queries[q], self.vectors[x])
        times = self.count[x]
        at = np.repeat(self.first[x] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        q, score, ids = np.repeat(q, times), np.repeat(score, times), self.ids[at]
        other = ids != own[q]
        q, score, ids = q[other], score[other], ids[other]
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        keep = self._place(q) < self.k
        return q[keep], ids[keep], score[keep]


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector of doubles has a cosine: ``dim`` finite components, not all zero, whose squares can be summed."""
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & (norm > 0) & (norm < float("inf"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, factor: float = FACTOR, dim: int | None = None, sample_bytes: int = SAMPLE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows of ``vectors`` found for each row of ``queries``."""
    spark = vectors.sparkSession
    rows, asked = _clean(vectors, id_col, vector_col), _clean(queries, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        lengths = rows.groupBy(F.size("v").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
        if lengths is None:
            return empty
        dim = lengths["dim"]
    rows, asked = rows.where(usable(F.col("v"), dim)), asked.where(usable(F.col("v"), dim))
    n = rows.count()
    if not n:
        return empty

    sampled = rows.orderBy(F.xxhash64("id", "v"), "id").limit(max(REGION_SAMPLE, sample_bytes // (8 * dim))).toArrow()
    sample_ids, sample = sampled.column("id").to_numpy(), _units(_matrix(sampled.column("v").combine_chunks(), dim))
    wanted = max(-(-n * 8 * dim // shard_bytes), min(partitions(spark), n // SHARD_LEAST), 1)
    held = spark.sparkContext.broadcast((Router(sample, min(wanted, max(1, len(sample) // REGION_SAMPLE))), sample, sample_ids))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = held.value[0].region(_units(_matrix(b.column("v"), dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=["id", "v", "region"])

    settled = cut(rows.mapInArrow(settle, "id long, v array<double>, region int").withColumn("n", F.monotonically_increasing_id()), "settled-vectors")
    sizes = {r["region"]: r["count"] for r in settled.groupBy("region").count().collect()}
    most = max(SHARD_LEAST, min(shard_bytes // (8 * dim), -(-2 * n // wanted)))
    counts = np.array([sizes.get(r, 0) for r in range(max(sizes) + 1)])
    parts_of = -(-counts // most)
    first = np.cumsum(parts_of) - parts_of
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
    place = constant(first.tolist())[F.col("region")] + F.pmod("n", constant(parts_of.tolist())[F.col("region")]).cast("int")
    data = settled.select(place.alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("number"), "id", "v", F.lit(None).cast("double").alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, sample, sample_ids = held.value
        for b in batches:
            for i in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(i, QUERY_ROWS)
                unit = _units(_matrix(part.column("v"), dim))
                bound, home = sample_bounds(unit, part.column("id").to_numpy(), sample, sample_ids, k), router.region(unit)
                bound[np.concatenate([counts, np.zeros(router.regions)])[home] <= k] = -2.0
                to = []
                for regions, own, least in zip(router.within(unit, reach(bound, factor)), home.tolist(), bound.tolist(), strict=True):
                    to.append([(s, -2.0 if r == own else least) for r in regions if r < len(counts) for s in range(first[r], first[r] + parts_of[r])])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[{"shard": s, "bound": x} for s, x in t] for t in to], _TO)], names=["number", "id", "v", "to"])

    numbered = cut(asked.select(F.monotonically_increasing_id().alias("number"), "id", "v"), "ann-queries")
    routed = numbered.mapInArrow(route, "number long, id long, v array<double>, to array<struct<shard:int,bound:double>>").select("number", "id", "v", F.explode("to").alias("to")).select("to.shard", F.lit(1).alias("kind"), "number", "id", "v", "to.bound")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tree = None, [], None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(shard)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                if shard[begin] != now:
                    now, parts, tree = shard[begin], [], None
                part = b.slice(begin, end - begin)
                ids, v = part.column("id").to_numpy(), _matrix(part.column("v"), dim)
                if not kind[begin]:
                    parts.append((ids.copy(), v.copy()))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    tree, parts = ShardTree(np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts]), k), []
                numbers, bound = part.column("number").to_numpy(), part.column("bound").to_numpy()
                for i in range(0, len(ids), QUERY_ROWS):
                    at = slice(i, i + QUERY_ROWS)
                    q, found, score = tree.search(v[at], ids[at], bound[at], factor)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at][q]), pa.array(ids[at][q]), pa.array(found), pa.array(score)], names=["number", "query_id", "vec_id", "score"])

    dealt = data.unionByName(routed).repartitionById(int(parts_of.sum()), F.col("shard")).sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(answer, "number long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
