"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A text's pieces (lines, cut at sentence ends and into runs of at most ``RUN`` words) are hashed to wide vectors, and the vectors are summed modulo
powers of two. The sum doesn't depend on the order of pieces, and inserting or deleting a piece adds or subtracts its
vector (``combine``). A vector has two parts:

* ``STRONG`` lanes of 32 bits, summed modulo 2^32: equality;
* ``WIDE`` lanes of one bit (read as -1 or 1), summed modulo 2^31, two packed into a long: likeness. The mean square of
  the lanes estimates the size of a multiset, that of two fingerprints' product their common part; ``likeness`` is the
  cosine of the two, with a standard error of about 1/sqrt(WIDE).

Defined cases: null text is empty; a text without a word has the zero fingerprint (like 1 to itself, 0 to any
other); Spark's texts have less than 2^31 bytes, so a text's pieces never pass a lane's modulus (of ``fingerprint``, which
adds the rows of one id, 2^31 - 1 pieces may come together); rows of one id are ordered by a hash of the text, by which
many of them are dealt out (``ordered_buckets``), then by text; a null id sorts first; with one document, the next one is itself; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import bucket_by_range, partitions, table

LANE_BITS = 31
SUMS = [(seed, shift) for seed in (0, 1) for shift in range(LANE_BITS)]
WIDE = 2 * len(SUMS)
STRONG = 4
RUN = 5
_LOW = (1 << LANE_BITS) - 1
_ONES = 1 | 1 << LANE_BITS


def pieces_of(text: Column) -> Column:
    """Lines of a text, cut after a full stop, exclamation or question mark and blank, and into runs of words."""
    run = F.lit(rf"\S+(?:\s+\S+){{0,{RUN - 1}}}")
    return F.flatten(F.transform(F.split(text, r"\n|(?<=[.!?])\s+"), lambda p: F.regexp_extract_all(p, run, F.lit(0))))


def _hash(piece: Column, seed: int) -> Column:
    return F.xxhash64(piece, F.lit(seed))


def sums(piece: Column) -> list[Column]:
    """Aggregates over rows of pieces (null: no piece): the number of pieces, the wide lanes, the strong lanes."""
    there = piece.isNotNull()
    out = [F.count(piece).alias("_n")]
    for i, (seed, shift) in enumerate(SUMS):
        lanes = F.shiftrightunsigned(F.col(f"_h{seed}"), shift).bitwiseAND(F.lit(_ONES))
        out.append(F.sum(F.when(there, lanes).otherwise(0)).alias(f"_w{i}"))
    for j in range(STRONG):
        half = F.shiftrightunsigned(F.col(f"_h{j // 2}"), 32 * (j % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(F.sum(F.when(there, half).otherwise(0)).alias(f"_s{j}"))
    return out


def packed() -> Column:
    """The aggregates as one array: count, wide sums, strong sums modulo 2^32."""
    return F.array("_n", *[F.col(f"_w{i}") for i in range(len(SUMS))], *[F.col(f"_s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(STRONG)])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together (or, with sign -1, of ``a`` without ``b``), each lane by its modulus."""
    strong = 1 + len(SUMS)

    def wide(x: Column, y: Column) -> Column:
        low, high = (lambda v: v.bitwiseAND(F.lit(_LOW))), (lambda v: F.shiftrightunsigned(v, LANE_BITS))
        lanes = [F.pmod(part(x) + sign * part(y), F.lit(1 << LANE_BITS)) for part in (low, high)]
        return lanes[0].bitwiseOR(F.shiftleft(lanes[1], LANE_BITS))

    def one(p: Column, y: Column) -> Column:
        plain = p["x"] + sign * y
        return F.when(p["i"] == 0, plain).when(p["i"] >= strong, F.pmod(plain, F.lit(1 << 32))).otherwise(wide(p["x"], y))

    return F.zip_with(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), b, one)


def text_of(fp: Column) -> Column:
    """Hexadecimal form: strong lanes first."""
    strong = [F.lpad(F.lower(F.hex(fp[1 + len(SUMS) + j])), 8, "0") for j in range(STRONG)]
    wide = [F.lpad(F.lower(F.hex(fp[1 + i])), 16, "0") for i in range(len(SUMS))]
    return F.concat(*strong, F.lower(F.hex(fp[0])), F.lit("-"), *wide)


def _product(a: Column, b: Column) -> Column:
    """Sum over the wide lanes of the product of their signed values."""

    def signed(fp: Column) -> Column:
        words = F.slice(fp, 2, len(SUMS))
        lane = lambda k: F.transform(words, lambda w: 2.0 * F.shiftrightunsigned(w, k * LANE_BITS).bitwiseAND(F.lit(_LOW)) - fp[0])
        return F.concat(lane(0), lane(1))

    return F.aggregate(F.zip_with(signed(a), signed(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two fingerprints; 1 for equal ones."""
    cosine = _product(a, b) / F.sqrt(F.greatest(_product(a, a) * _product(b, b), F.lit(1e-9)))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[int, str]) -> DataFrame:
    """``keys``, ``_side`` and ``_fp`` of each of the text columns ``texts`` (side: column). Rows that are already dealt
    out by one of ``keys`` aren't shuffled again."""

    def tagged(side: int, text: str) -> Column:
        """A null piece first, so that a text without a piece has a row as well."""
        found = F.concat(F.array(F.lit(None).cast("string")), pieces_of(F.coalesce(text, F.lit(""))))
        return F.transform(found, lambda p: F.struct(F.lit(side).alias("side"), p.alias("piece")))

    side = [tagged(s, c) for s, c in texts.items()]
    each = rows.select(*keys, F.explode(F.concat(*side)).alias("_e")).select(*keys, F.col("_e.side").alias("_side"), F.col("_e.piece").alias("_piece"), *[_hash(F.col("_e.piece"), s).alias(f"_h{s}") for s in (0, 1)])
    return each.groupBy(*keys, "_side").agg(*sums(F.col("_piece"))).select(*keys, "_side", packed().alias("_fp"))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id: doc_id and fp (array of long). Rows of one id are one multiset."""
    return fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), ["doc_id"], {0: "_t"}).select("doc_id", F.col("_fp").alias("fp"))


def ordered_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, text, _h: a hash of the text) with _bucket: consecutive numbers of ranges of (doc_id, _h) of about
    equal row counts. Rows of one id that are over two ranges' worth, and of none, are parted by the hash."""
    ranged = bucket_by_range(rows, "doc_id", buckets, "_range").withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_range") + 1))
    found = {r["_range"]: r for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).collect()}
    fair = max(1, sum(r["n"] for r in found.values()) // buckets)
    last, parts, first, at = [], [], [], 0
    for i in range(max(found, default=0) + 1):
        n = found[i]["n"] if i in found else 0
        last.append(found[i]["last"] or 0 if i in found else 0)
        parts.append(-(-n // fair) if n > 2 * fair else 1)
        first.append(at)
        at += 1 + parts[-1]
    of = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")[F.col("_range")]
    part = F.floor(F.shiftrightunsigned("_h", 1) / F.lit(2.0**63) * of(parts, "int"))
    parted = (of(parts, "int") > 1) & (F.col("doc_id").isNull() | (F.col("doc_id") == of(last, "bigint")))
    return ranged.withColumn("_bucket", (of(first, "int") + F.when(parted, 1 + F.least(part, of(parts, "int") - 1)).otherwise(0)).cast("int")).drop("_range")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, text) with _h, _bucket, _rn (order in it), _guest and the next document's text.

    Rows are cut into ranges; a copy of the next range's first document stands at each range's end as a guest, so the
    next text is at hand in the range, and the texts are shuffled once. The guests are as many as the ranges.
    """
    docs = docs.withColumn("_h", F.xxhash64("text"))
    rows = ordered_buckets(docs, buckets).withColumn("_guest", F.lit(0))
    order_of = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.shiftrightunsigned("_h", 1).alias("_high"), "_h")
    heads = sorted((r["_bucket"], r["id"], r["h"]) for r in rows.groupBy("_bucket").agg(F.min(order_of).alias("m")).select("_bucket", F.col("m.doc_id").alias("id"), F.col("m._h").alias("h")).collect())
    if not heads:
        return rows.select("*", F.lit(0).alias("_rn"), F.col("text").alias("_next"))
    before = [heads[i - 1][0] for i in range(len(heads))]
    spark = docs.sparkSession
    to = spark.createDataFrame([(h[1], h[2], h[0], b) for h, b in zip(heads, before, strict=True)], "head long, head_h long, own int, before int")
    first = docs.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("_h") == F.col("head_h"))).groupBy("own", "before", "head", "head_h").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("m"))
    guests = first.select(F.col("head").alias("doc_id"), F.col("m.text").alias("text"), F.col("head_h").alias("_h"), F.col("before").alias("_bucket"), F.lit(1).alias("_guest"))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.asc_nulls_first("doc_id"), F.shiftrightunsigned("_h", 1), "_h", F.asc_nulls_first("text"))
    return rows.unionByName(guests).withColumn("_rn", F.row_number().over(order)).withColumn("_next", F.lead("text").over(order))


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of texts and of their edited texts (the last half replaced by the next document's first half)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    both = with_next(rows, buckets or 4 * partitions(docs.sparkSession)).withColumn("_edited", edited)
    keys = ["_bucket", "_rn", "_guest", "doc_id", "n_chars", "edited_sha256"]
    fps = fingerprints(both.select("_bucket", "_rn", "_guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "text", "_edited"), keys, {0: "text", 1: "_edited"})
    order = Window.partitionBy("_bucket").orderBy("_rn", "_side")
    near = fps.withColumn("_e", F.lead("_fp", 1).over(order)).withColumn("_n", F.lead("_fp", 2).over(order)).where("_side = 0 and _guest = 0")
    return near.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("_fp")).alias("fingerprint"), text_of(F.col("_e")).alias("edited_fingerprint"), likeness(F.col("_fp"), F.col("_e")).alias("near_edited"), likeness(F.col("_fp"), F.col("_n")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
