"""Raster rows: augmentation of odd rows, arithmetic of bands and pairs, and the pixel forms they equal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import algebra, algebra_rasters, augment, augment_rasters, layouts, score
from tilewright.plans import registry


def test_augment_odd_rows(spark):
    rng = np.random.default_rng(3)
    colour, grey, mask = (bytearray(rng.integers(0, 256, n).astype(np.uint8).tobytes()) for n in (60, 20, 20))
    four = bytearray(np.concatenate([np.frombuffer(colour, np.uint8).reshape(20, 3), np.full((20, 1), 9, np.uint8)], 1).tobytes())
    three = bytearray(np.repeat(np.frombuffer(mask, np.uint8), 3).tobytes())
    rows = [(1, 4, 5, 3, colour, mask), (2, -1, -1, -1, bytearray(), mask), (3, 4, 5, 3, None, mask), (4, 4, 5, 1, grey, mask), (5, 4, 5, 3, colour, None), (6, 4, 5, 4, four, three), (7, 4, 5, 3, colour[:-1], mask), (8, 4, 5, 3, colour, mask[:-1]), (9, 0, 5, 3, bytearray(), mask), (10, None, None, None, colour, mask), (11, 4, 5, None, colour, mask)]
    schema = "image_id long, height int, width int, channels int, data binary, mask binary, x string"
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(2)
    off = {r["image_id"]: r for r in augment_rasters.augment_rasters(df, u=0.0, dtype="float64").collect()}
    assert set(off) == {1, 4, 5, 6, 8}
    plain = lambda b: np.frombuffer(bytes(b), np.uint8).reshape(4, 5, -1).transpose(2, 0, 1) / 255 * 3.2 - 1.6
    x = {i: np.frombuffer(r["x"]).reshape(3, 4, 5) for i, r in off.items()}
    assert np.allclose(x[1], plain(colour)) and np.allclose(x[6], x[1]) and np.allclose(x[4], np.repeat(plain(grey), 3, 0))
    assert off[5]["t"] is None and off[8]["t"] is None and off[6]["t"] == off[1]["t"] == bytes((np.frombuffer(mask, np.uint8) >= 128).astype(np.uint8))
    on = {r["image_id"]: r for r in augment_rasters.augment_rasters(df, u=1.0).collect()}
    assert set(on) == {1, 4, 5, 6, 8} and all((r["height"], r["width"]) == (5, 4) for r in on.values())
    assert augment_rasters.augment_rasters(df.where("false")).count() == 0


def test_each_step_has_its_own_gate_and_ranges(spark):
    rng = np.random.default_rng(4)
    pics, grey = (rng.integers(0, 256, (30, 6, 6, n)).astype(np.uint8) for n in (3, 1))
    rows = spark.createDataFrame([(i, 6, 6, bytearray(pics[i].tobytes()), bytearray(grey[i].tobytes())) for i in range(30)], "image_id long, height int, width int, data binary, mask binary")
    px = spark.createDataFrame([(i, ch, r, c, int(pics[i, r, c, ch])) for i in range(30) for ch in range(3) for r in range(6) for c in range(6)], "image_id long, ch int, r int, c int, b int")
    mk = spark.createDataFrame([(i, r, c, int(grey[i, r, c, 0])) for i in range(30) for r in range(6) for c in range(6)], "image_id long, r int, c int, b int")
    how = {"u": {"hsv": 1.0, "ssr": 0.7, "hflip": 0.0, "rot90": 0.3}, "hue": (-90, 90), "sat": (-40, 40), "val": (0, 60), "rotate": (-45, 45), "shift": (-0.4, 0.4), "seed": 7, "epoch": 3}
    got = {r["image_id"]: r for r in augment_rasters.augment_rasters(rows, dtype="float64", **how).collect()}
    x, t = augment.augment(px, mk, (6, 6), **how)
    cells = x.collect()
    assert len(cells) == 30 * 108
    for r in cells:
        assert abs(np.frombuffer(got[r["image_id"]]["x"]).reshape(3, 6, 6)[r["ch"], r["r"], r["c"]] - r["x"]) < 1e-12
    for r in t.collect():
        assert np.frombuffer(got[r["image_id"]]["t"], np.uint8).reshape(6, 6)[r["r"], r["c"]] == r["t"]
    with pytest.raises(ValueError, match="no such steps"):
        augment.augment(px, mk, (6, 6), u={"hue": 1.0})


def rows_of(spark, arrays, **more):
    return spark.createDataFrame([(i, *(x.shape[1:] if x is not None else (2, 2)), len(x) if x is not None else 1, None if x is None else bytearray(x.astype("float64").tobytes())) for i, x in arrays.items()], "image_id long, height int, width int, channels int, v binary")


def arrays_of(df):
    return {r["image_id"]: None if r["v"] is None else np.frombuffer(r["v"]).reshape(r["channels"], r["height"], r["width"]) for r in df.collect()}


def test_arithmetic_on_raster_rows(spark):
    rng = np.random.default_rng(5)
    a = {i: rng.normal(50, 20, (2, 3 + i % 2, 4)) for i in range(12)} | {50: None, 51: np.ones((2, 1, 1))}
    b = {i: rng.normal(size=(2, 3, 4)) for i in range(3, 12)} | {50: np.ones((1, 2, 2)), 99: np.ones((1, 1, 1))}
    x, y = rows_of(spark, a), rows_of(spark, b)
    total = arrays_of(algebra_rasters.raster_add(x, y))
    assert set(total) == {*range(3, 12), 50} and total[50] is None and total[3] is None and np.allclose(total[4], a[4] + b[4])
    assert np.allclose(arrays_of(algebra_rasters.concat_channels(x, y))[4], np.concatenate([a[4], b[4]]))
    w = [[0.5, 0.25], [1, -1], [0, 2]]
    assert np.allclose(arrays_of(algebra_rasters.band_math(x, w))[5], np.tensordot(np.array(w), a[5], 1))
    flat = [np.concatenate([v[k].ravel() for v in a.values() if v is not None]) for k in (0, 1)]
    stats = {r["ch"]: r for r in algebra_rasters.channel_statistics(x).collect()}
    assert all(np.isclose(stats[k]["mean"], flat[k].mean()) and np.isclose(stats[k]["var"], flat[k].var()) for k in (0, 1))
    z = arrays_of(algebra_rasters.standardise(x))
    assert z[50] is None and np.allclose(z[6], (a[6] - np.array([f.mean() for f in flat])[:, None, None]) / np.sqrt(np.array([f.var() for f in flat])[:, None, None] + 1e-5))
    frozen = spark.createDataFrame([(0, 1.0, 4.0), (1, 0.0, 1.0)], "ch int, mean double, var double")
    assert np.allclose(arrays_of(algebra_rasters.standardise(x, statistics=frozen))[51], (np.ones((2, 1, 1)) - np.array([1, 0])[:, None, None]) / np.sqrt(np.array([4, 1])[:, None, None] + 1e-5))
    m = arrays_of(algebra_rasters.binarise_masks(x, 50.0, invert=True))[7]
    assert ((a[7] < 50).astype(float) == m).all()
    none = x.where("false")
    assert algebra_rasters.standardise(none).count() == algebra_rasters.raster_add(none, y).count() == 0


@pytest.mark.parametrize(("kernel", "how"), [([[1.0]], {"pad": 0, "out_pad": 1}), ([[1.0, 2.0]], {"stride": 3, "pad": 0, "out_pad": 2}), ([[1.0, 2.0], [3.0, 4.0]], {"pad": 0})])
def test_upsample_forms_are_equal_on_empty_cells(spark, kernel, how):
    x = {1: np.ones((1, 1, 1)), 2: np.full((1, 1, 1), 5.0)}
    rows = algebra_rasters.upsample(rows_of(spark, x), kernel, **how)
    px = spark.createDataFrame([(i, 0, 0, float(v[0, 0, 0])) for i, v in x.items()], "image_id long, r int, c int, v double")
    want = {(i, r, c, float(v[0, r, c])) for i, v in arrays_of(rows).items() for r in range(v.shape[1]) for c in range(v.shape[2])}
    assert {tuple(r) for r in algebra.upsample(px, kernel, (1, 1), **how).select("image_id", "r", "c", "v").collect()} == want


def test_axes(spark):
    df = spark.createDataFrame([([1, 2],), (None,), ([],)], "d array<int>")
    x = layouts.add_axes(F.col("d"), 3)
    assert [r[0] for r in df.select(layouts.drop_axes(x, 3)).collect()] == [[1, 2], None, []]
    assert df.select(x.alias("x")).first()["x"] == [[[[1, 2]]]]


def test_plugin_losses_as_mergeable_states(spark):
    from tilewright.operators import metrics

    rng = np.random.default_rng(9)
    data = [(i % 3 if i % 7 else None, rng.integers(0, 2, 6).astype(np.uint8), rng.random(6)) for i in range(200)]
    rows = spark.createDataFrame([(g, bytearray(t.tobytes()), bytearray(q.tobytes()), "x") for g, t, q in data] + [(5, None, bytearray(8), ""), (1, bytearray(b"\1"), None, "")], "g int, t binary, q binary, _state string").repartition(7)
    add = lambda s, t, q: np.array([s[0] + len(t), s[1] + abs(t - q).sum(), max(s[2], abs(t - q).max())])
    merge = lambda a, b: np.array([a[0] + b[0], a[1] + b[1], max(a[2], b[2])])
    finish = {"mean": lambda s: s[1] / s[0] if s[0] else float("nan"), "most": lambda s: s[2], "n": lambda s: s[0]}
    got = {r["g"]: r for r in metrics.raster_aggregate(rows, lambda: np.zeros(3), add, merge, finish, ["g"], "float64", fan=2).collect()}
    assert set(got) == {0, 1, 2, None, 5} and got[5]["n"] == 0
    for g in (0, 1, 2, None):
        d = np.concatenate([abs(t - q) for k, t, q in data if k == g])
        assert got[g]["n"] == len(d) and np.isclose(got[g]["mean"], d.mean()) and got[g]["most"] == d.max()
    whole = metrics.raster_aggregate(rows, lambda: np.zeros(3), add, merge, finish, [], "float64").collect()
    assert len(whole) == 1 and whole[0]["n"] == 1200
    with pytest.raises(Exception, match="payloads of 1 and 2 values"):
        metrics.raster_aggregate(spark.createDataFrame([(1, bytearray(1), bytearray(16))], "g int, t binary, q binary"), lambda: np.zeros(3), add, merge, finish, ["g"], "float64").collect()
    sums = metrics.raster_sums(spark.createDataFrame([(1, None, bytearray(8)), (2, bytearray(1), bytearray(np.full(1, 0.25).tobytes()))], "g int, t binary, q binary"), ["g"], "float64").collect()
    assert [(r["g"], r["n"]) for r in sorted(sums)] == [(1, 0), (2, 1)]


def test_numbers_and_names(spark):
    from tilewright.functions import pixels

    df = spark.createDataFrame([(2.5, "ab"), (-2.5, "abcdefghij"), (-0.4, ""), (300.9, None), (None, "é" * 9), (float("nan"), "x"), (float("inf"), "x")], "x double, t string")
    got = df.select(pixels.round_half_away(F.col("x")), pixels.as_byte(F.col("x")), pixels.without_end(F.col("t"), 8), pixels.as_float(F.col("x"))).collect()
    assert [r[0] for r in got[:5]] == [3.0, -3.0, 0.0, 301.0, None]
    assert [r[1] for r in got] == [2, 254, 0, 44, None, None, None]
    assert [r[2] for r in got] == ["", "ab", "", None, "é", "", ""]
    assert got[3][3] == float(np.float32(300.9))


def test_arrays_pass_through_python_once(spark):
    rng = np.random.default_rng(6)
    a = {i: rng.normal(size=(2, 3, 4)) for i in range(9)} | {50: None}
    x = rows_of(spark, a)
    arrays = score.numbers_of(x, "v", "float64").localCheckpoint()
    ops = [lambda r, **how: algebra_rasters.focal(r, [[1.0, 2.0], [3.0, 4.0]], 1, **how), lambda r, **how: algebra_rasters.block_max(r, **how), lambda r, **how: algebra_rasters.upsample(r, [[1.0, 2.0], [3.0, 4.0]], **how), lambda r, **how: algebra_rasters.raster_add(r, r, **how), lambda r, **how: algebra_rasters.binarise_masks(r, 0.0, invert=True, **how)]
    for op in ops:
        want = arrays_of(op(x))
        made = op(arrays, numbers=True)
        got = {r["image_id"]: None if r["v"] is None else np.array(r["v"]).reshape(r["channels"], r["height"], r["width"]) for r in made.collect()}
        assert want.keys() == got.keys() and all(np.array_equal(want[i], got[i]) for i in want if i != 50) and got[50] is None
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["p11_invert_mask", "m2_multi_rate_focal", "m3_block_max", "m4_upsample"])
def test_raster_row_queries_need_one_worker_a_task(spark, name):
    plan = registry.QUERIES[f"{name}_raster_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan and "Exchange" not in plan
