import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import augment, symmetry


def view(x, k):
    x = np.rot90(x) if k & 1 else x
    x = x[::-1] if k & 2 else x
    return x[:, ::-1] if k & 4 else x


def test_table_is_that_of_the_views():
    x = np.arange(12).reshape(3, 4)
    for a, b in itertools.product(range(8), repeat=2):
        assert (view(view(x, a), b) == view(x, symmetry.TABLE[b][a])).all()
        assert symmetry.TABLE[symmetry.INVERSE[a]][a] == symmetry.TABLE[a][symmetry.INVERSE[a]] == 0
    assert symmetry.chain(*["rot90"] * 4) == symmetry.chain("hflip", "hflip") == 0
    assert symmetry.chain("hflip", "vflip") == symmetry.NAMES["rot180"] == symmetry.chain("rot90", "rot90")


def test_arrays_and_pixels_under_each_element(spark):
    x = np.arange(12).reshape(3, 4)
    rows = spark.createDataFrame([(1, 3, 4, x.ravel().tolist()), (2, 0, 0, []), (3, 1, 1, None)], "image_id long, height int, width int, data array<int>")
    got = {r["image_id"]: r["v"] for r in rows.select("image_id", symmetry.stack_views(F.col("data"), F.col("height"), F.col("width")).alias("v")).collect()}
    assert got[1] == [view(x, k).ravel().tolist() for k in range(8)] and got[2] == [[]] * 8 and got[3] == [None] * 8
    px = spark.createDataFrame([(r, c, int(x[r, c])) for r in range(3) for c in range(4)], "r int, c int, b int")
    for k in range(8):
        for e in (k, F.lit(k)):
            y = view(x, k)
            assert {(r["r"], r["c"], r["b"]) for r in symmetry.apply(px, e, (3, 4)).collect()} == {(r, c, int(y[r, c])) for r in range(y.shape[0]) for c in range(y.shape[1])}


@pytest.mark.parametrize("u", [0.5, {"hflip": 1.0, "vflip": 0.0, "rot90": 0.5}])
def test_folded_gates_equal_the_chain(spark, u):
    px = spark.range(60).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("p")).select("image_id", F.floor(F.col("p") / 3).cast("int").alias("r"), (F.col("p") % 3).alias("c"), F.col("p").alias("b"))
    chances = augment.chances(u)
    chained = augment.random_rot90(augment.random_vflip(augment.random_hflip(px, (3, 3), chances["hflip"]), (3, 3), chances["vflip"]), (3, 3), chances["rot90"])
    folded = symmetry.random_turns(px, (3, 3), u=u)
    key = lambda df: sorted(tuple(r) for r in df.select("image_id", "r", "c", "b").collect())
    assert key(folded) == key(chained)


def test_a_chain_is_one_projection(spark):
    px = spark.createDataFrame([(0, 0, 1)], "r int, c int, b int")
    chained = px
    for step in ("hflip", "rot90", "vflip", "rot90", "hflip", "rot90", "rot90"):
        chained = symmetry.apply(chained, symmetry.NAMES[step], (5, 5))
    one = symmetry.apply(px, symmetry.chain("hflip", "rot90", "vflip", "rot90", "hflip", "rot90", "rot90"), (5, 5))
    assert [tuple(r) for r in one.collect()] == [tuple(r) for r in chained.collect()]
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1 and plan.count("- ") <= 4  # at most 4 - r and 4 - c
