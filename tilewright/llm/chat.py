"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A log often holds a conversation several times, each time a few turns longer. A turn's hash covers its number, role and
text; the sum of hashes up to a turn is the prefix's hash (three lanes of 40 bits). A conversation whose whole hash
equals the prefix hash of a longer one is a snapshot of it and is dropped by an anti-join; of equal conversations the
smallest id stays. What is left is rendered.

Running sums are taken in blocks of ``BLOCK`` turn numbers, and the blocks' sums are added, so a conversation with a
large part of all rows isn't summed in one task. Prefixes and whole conversations are made distinct before they meet.
Conversations of more turns than a block has are rendered block by block, and the blocks' texts are joined.

Defined cases: a null turn comes first, a null role is rendered as ``unknown``, a null text as empty; turns with one
number are one step of the prefix, rendered by role, then text; repeated rows count; rows of a null id are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import table

BLOCK = 1024
LANES = ["_a", "_b", "_c"]
_MASK = (1 << 40) - 1


def turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("_turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.withColumns({name: F.xxhash64("_turn", "_role", "_text", F.lit(i)).bitwiseAND(F.lit(_MASK)) for i, name in enumerate(LANES)})


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, and of each distinct turn number the number of rows up to it and their hash."""
    steps = rows.groupBy("conv_id", F.floor(F.col("_turn") / BLOCK).alias("_block"), "_turn").agg(F.count(F.lit(1)).alias("_k"), *[F.sum(x).alias(x) for x in LANES])
    cols = ["_k", *LANES]
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy("conv_id", "_block").agg(*[F.sum(c).alias(c) for c in cols]).select("conv_id", "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in cols])
    within = Window.partitionBy("conv_id", "_block").orderBy("_turn")
    run = steps.select("conv_id", "_block", "_turn", *[F.sum(c).over(within).alias(c) for c in cols])
    same = run["conv_id"].eqNullSafe(blocks["conv_id"]) & (run["_block"] == blocks["_block"])
    return run.join(blocks, same).select(run["conv_id"], "_turn", *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in cols])


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that aren't snapshots of others."""
    key = ["_k", *LANES]
    whole = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_k"), *[F.sum(x).alias(x) for x in LANES])
    last = rows.groupBy("conv_id").agg(F.max("_turn").alias("_last"))
    p = prefixes(rows)
    proper = p.join(last, p["conv_id"].eqNullSafe(last["conv_id"])).where("_turn < _last").select(*key).distinct()
    one = whole.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("m")).select(*key, F.col("m.conv_id").alias("conv_id"))
    return one.join(proper, key, "left_anti").select("conv_id", F.col("_k").alias("n_turns"))


def render(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, chat (``<|im_start|>role``, text, ``<|im_end|>`` by turn)."""
    rows = turns(conversations, conv, turn, role, text)
    kept = maximal(rows).withColumnRenamed("conv_id", "_id")
    own = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
    said = F.concat(F.lit("<|im_start|>"), F.col("_role"), F.lit("\n"), F.col("_text"), F.lit("<|im_end|>\n"))
    joined = lambda *order, line: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "")
    chat = joined("_turn", "_role", "_text", line=said)
    short = own.where(F.col("n_turns") <= BLOCK).groupBy("conv_id", "n_turns").agg(chat.alias("chat"))
    blocks = own.where(F.col("n_turns") > BLOCK).groupBy("conv_id", "n_turns", F.floor(F.col("_turn") / BLOCK).alias("_block")).agg(chat.alias("_part"))
    return short.union(blocks.groupBy("conv_id", "n_turns").agg(joined("_block", line=F.col("_part")).alias("chat")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list({'t': turn, 'r': role, 'x': text} ORDER BY turn, role, text) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT md5(CAST(list_slice(l, 1, k) AS VARCHAR)) AS h FROM (SELECT l, turns.k FROM c, LATERAL (SELECT unnest(range(1, n_turns)) AS k) AS turns) WHERE l[k].t < l[k + 1].t),
o AS (SELECT l, n_turns, min(conv_id) AS conv_id FROM c GROUP BY ALL)
SELECT conv_id, n_turns, list_aggregate(list_transform(l, lambda y: '<|im_start|>' || y.r || chr(10) || y.x || '<|im_end|>' || chr(10)), 'string_agg', '') AS chat
FROM o WHERE md5(CAST(l AS VARCHAR)) NOT IN (SELECT h FROM p)
"""
