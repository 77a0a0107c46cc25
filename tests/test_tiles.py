"""Tiles against whole images, for several tile sizes."""

import numpy as np
import pytest

from tilewright.operators import algebra_rasters, augment_rasters, score, tiles

SHAPES = [(1, 1), (7, 5), (8, 8), (13, 20)]


def rasters(spark, dtype, bands=2):
    rng = np.random.default_rng(1)
    rows = []
    for i, (h, w) in enumerate(SHAPES * 2):
        x = rng.integers(0, 256, (bands, h, w)).astype(dtype)
        rows.append((i, h, w, bands, bytearray(x.tobytes()), "clash"))
    rows += [(100, 4, 4, bands, None, ""), (101, -1, -1, bands, bytearray(), ""), (None, 3, 3, bands, bytearray(np.ones((bands, 3, 3), dtype).tobytes()), "")]
    return spark.createDataFrame(rows, "image_id long, height int, width int, channels int, v binary, tile_r string").repartition(3)


def whole(df):
    return {r["image_id"]: (r["height"], r["width"], r["channels"], None if r["v"] is None else bytes(r["v"])) for r in df.select("image_id", "height", "width", "channels", "v").collect()}


@pytest.mark.parametrize("size", [1, 3, 8, 64])
def test_tiles_there_and_back(spark, size):
    rows = rasters(spark, "float64")
    cut = tiles.cut_tiles(rows, size)
    assert whole(tiles.join_tiles(cut)) == whole(rows.where("height > 0"))
    assert cut.where("v is not null").selectExpr("max(h) m", "max(w) n").first().asDict() == {"m": min(size, 13), "n": min(size, 20)}
    assert tiles.cut_tiles(rows.where("false"), size).count() == 0


@pytest.mark.parametrize("size", [2, 3, 7, 64])
def test_map_algebra_on_tiles(spark, size):
    rows = rasters(spark, "float64")
    cut, good = tiles.cut_tiles(rows, size), rows.where("height > 0")
    assert whole(tiles.cut_tiles(rows.where("height = 1").withColumn("channels", rows["channels"]), size, interleaved=True)) == whole(tiles.cut_tiles(rows.where("height = 1"), size))
    for kernel, how in (([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]], {"dilation": 2}), ([[1.0, 2.0]], {}), ([[1.0, -2.0], [0.5, 3.0], [2.0, 2.0], [1.0, 1.0]], {"dilation": 1})):
        assert whole(tiles.join_tiles(tiles.focal(cut, kernel, **how))) == whole(algebra_rasters.focal(good, kernel, **how))
    k = [[0.1, 0.2, -0.3], [0.4, -0.5, 0.6], [0.7, 0.8, -0.9]]
    assert whole(tiles.join_tiles(tiles.multi_rate_focal(cut, k))) == whole(algebra_rasters.multi_rate_focal(good, k))
    assert whole(tiles.join_tiles(tiles.focal(cut.where("false"), k))) == {}


@pytest.mark.parametrize("size", [1, 3, 64])
@pytest.mark.parametrize(("kernel", "how"), [((4, 4), {}), ((2, 2), {"pad": 0}), ((3, 3), {"pad": 1, "out_pad": 1}), ((5, 2), {"stride": 3, "pad": 0, "out_pad": 4}), ((1, 1), {"pad": 0, "out_pad": 1})])
def test_upsample_on_tiles(spark, size, kernel, how):
    rows = rasters(spark, "float64")
    k = (np.arange(kernel[0] * kernel[1]).reshape(kernel) + 1.0).tolist()
    want = {i: r for i, r in whole(algebra_rasters.upsample(rows.where("height > 0 and v is not null"), k, **how)).items() if r[0] > 0 and r[1] > 0}
    got = whole(tiles.join_tiles(tiles.upsample(tiles.cut_tiles(rows.where("v is not null"), size), k, **how)))
    assert got == want


@pytest.mark.parametrize("size", [1, 4, 64])
def test_warp_on_tiles(spark, size):
    rows = rasters(spark, "uint8", 3)
    cut = tiles.cut_tiles(rows, size, "uint8")
    for how in ({"u": 1.0}, {"u": 1.0, "rotate": (-180, 180), "scale": (-0.6, 1.5), "shift": (-0.6, 0.6), "border": 7.0}, {"u": 0.5}):
        border = how.get("border", 0.0)
        drawn = augment_rasters.with_parameters(rows.where("height > 0 and v is not null"), **{k: v for k, v in how.items() if k != "border"}).collect()
        want = {}
        for r in drawn:
            x = np.frombuffer(r["v"], np.uint8).reshape(3, r["height"], r["width"]).transpose(1, 2, 0)
            x = augment_rasters.warp(x, *(r[n] for n in tiles._AFFINE), border) if r["on_ssr"] else x
            want[r["image_id"]] = x.transpose(2, 0, 1).tobytes()
        got = whole(tiles.join_tiles(tiles.random_ssr(cut, **how), "uint8"))
        assert {i: r[3] for i, r in got.items() if i != 100} == want and got[100][3] is None


@pytest.mark.parametrize("size", [1, 3, 5, 64])
def test_views_on_tiles(spark, size):
    rows = rasters(spark, "uint8", 3)
    cut = tiles.cut_tiles(rows, size, "uint8")
    good = {r["image_id"]: np.frombuffer(r["v"], np.uint8).reshape(3, r["height"], r["width"]) for r in rows.where("height > 0 and v is not null").collect()}
    seen = tiles.view_tiles(cut, "uint8")
    for r in seen.where("v is not null").collect():
        x = good[r["image_id"]]
        x = np.rot90(x, axes=(1, 2)) if r["view"] & 1 else x
        x = x[:, ::-1] if r["view"] & 2 else x
        x = x[:, :, ::-1] if r["view"] & 4 else x
        assert x.shape[1:] == (r["height"], r["width"])
        assert x[:, r["r0"] : r["r0"] + r["h"], r["c0"] : r["c0"] + r["w"]].tobytes() == bytes(r["v"])
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    back = tiles.unview_tiles(seen, "uint8")
    for view in (0, 3, 5, 7):
        assert key(back.where(f"view = {view}").drop("view")) == key(cut)
    rgb = (0.2, 0.5, -0.3)
    interleaved = spark.createDataFrame([(i, x.shape[1], x.shape[2], 3, bytearray(x.transpose(1, 2, 0).tobytes())) for i, x in good.items()], "image_id long, height int, width int, channels int, data binary")
    want = {r["image_id"]: np.frombuffer(r["q"]) for r in score.score_rasters(interleaved, score.logistic_factory(weights=rgb), views=True, dtype="float64").collect()}
    fused = tiles.score_tiles(cut, tiles.logistic_tiles(weights=rgb), views=True, dtype="float64")
    each = tiles.score_tiles(tiles.view_tiles(cut, "uint8").drop("view"), tiles.logistic_tiles(weights=rgb), dtype="float64")
    assert each.count() == 8 * cut.count()
    got = whole(tiles.join_tiles(fused))
    assert got.pop(100)[3] is None and set(got) == set(want)
    assert all(np.allclose(np.frombuffer(got[i][3]), want[i], atol=1e-12) for i in want)


def test_score_each_view_is_view_score_unview_in_one_pass(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, h, w, n, bytearray(rng.integers(0, 256, n * h * w).astype(np.uint8).tobytes())) for i, (h, w, n) in enumerate([(7, 5, 1), (4, 9, 1), (3, 3, 1)])] + [(9, 4, 4, 1, None)], "image_id long, height int, width int, channels int, v binary")
    cut = tiles.cut_tiles(rows, 3, "uint8")
    plain = lambda: (lambda x, r0, c0: x[0] + r0 - c0 * 0.5)
    for factory in (plain, tiles.logistic_tiles()):
        want = tiles.unview_tiles(tiles.score_tiles(tiles.view_tiles(cut, "uint8"), factory, dtype="float64"))
        got = tiles.score_each_view(cut, factory, dtype="float64")
        key = lambda r: (r["image_id"], r["view"], r["tile_r"], r["tile_c"])
        a, b = (sorted(x.collect(), key=key) for x in (want, got))
        assert len(a) == len(b) > 0
        for x, y in zip(a, b, strict=True):
            assert x[:-1] == y[:-1] and (x["v"] is None) == (y["v"] is None)
            assert x["v"] is None or np.allclose(np.frombuffer(x["v"]), np.frombuffer(y["v"]), atol=1e-12)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
