import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import pixels
from tilewright.operators import algebra, algebra_rasters, augment, augment_rasters, batches, layouts, metrics, pairing, runs, score
from tilewright.sources import images, masks, runlog, shared
from tilewright.streaming import monitor

H, W = 3, 5


@pytest.fixture(scope="module")
def raster(spark):
    rng = np.random.default_rng(1)
    data = {i: rng.integers(0, 256, (H, W)) for i in range(6)}
    df = spark.createDataFrame([(i, a.ravel().tolist()) for i, a in data.items()], "image_id long, data array<int>")
    return data, layouts.pixels_of(df, W, value="b")


def grid(rows, value, shape):
    out = {}
    for r in rows:
        out.setdefault(r["image_id"], np.full(shape, np.nan))[r["r"], r["c"]] = r[value]
    return out


def test_views_invert_to_identity(raster):
    data, px = raster
    back = score.tta_invert(score.tta_views(px, (H, W)), (H, W)).where("view >= 0").collect()
    assert len(back) == 8 * 6 * H * W
    assert all(r["b"] == data[r["image_id"]][r["r"], r["c"]] for r in back)


def test_tta_pixels_equal_numpy_and_fused(spark, raster):
    data, px = raster
    predict = score.logistic_factory()()
    want = {}
    for i, a in data.items():
        total = np.zeros((H, W))
        for k in range(8):
            v = a / 255 * 3.2 - 1.6
            v = np.rot90(v) if k & 1 else v
            v = v[::-1] if k & 2 else v
            v = v[:, ::-1] if k & 4 else v
            q = predict(v[None, None])[0]
            q = q[:, ::-1] if k & 4 else q
            q = q[::-1] if k & 2 else q
            total += np.rot90(q, 3) if k & 1 else q
        want[i] = total
    got = grid(score.tta_score(px, score.logistic(), (H, W)).collect(), "q", (H, W))
    rasters = layouts.rasters_of(px, ["image_id"], "b")
    fused = {r["image_id"]: np.frombuffer(r["q"], "<f8").reshape(H, W) for r in score.score_rasters(rasters, score.logistic_factory(), 2, views=True, dtype="float64").collect()}
    for i in data:
        assert np.allclose(got[i], want[i]) and np.allclose(fused[i], want[i])


def test_flips_and_turns(raster):
    data, px = raster
    h = grid(augment.random_hflip(px, (H, W), u=1.0).collect(), "b", (H, W))
    v = grid(augment.random_vflip(px, (H, W), u=1.0).collect(), "b", (H, W))
    t = grid(augment.random_rot90(px, (H, W), u=1.0).collect(), "b", (W, H))
    for i, a in data.items():
        assert (h[i] == a[:, ::-1]).all() and (v[i] == a[::-1]).all() and (t[i] == np.rot90(a)).all()
    none = grid(augment.random_ssr(px, (H, W), u=0.0).collect(), "b", (H, W))
    same = grid(augment.random_ssr(px, (H, W), u=1.0, shift=(0, 0), scale=(0, 0), aspect=(0, 0)).collect(), "b", (H, W))
    assert all((none[i] == a).all() and (same[i] == a).all() for i, a in data.items())


def test_focal_and_resampling(raster):
    data, px = raster
    k = [[1.0, 2, 3], [4, 5, 6], [7, 8, 9]]
    for dilation in (1, 2):
        got = grid(algebra.focal(px, k, (H, W), dilation, value="b").collect(), "b", (H, W))
        for i, a in data.items():
            p = np.pad(a, dilation)
            want = sum(k[y][x] * p[y * dilation : y * dilation + H, x * dilation : x * dilation + W] for y in range(3) for x in range(3))
            assert np.allclose(got[i], want)
    got = grid(algebra.block_max(px, 2, value="b").collect(), "b", (2, 3))
    assert got[0][1, 2] == data[0][2, 4] and got[0][0, 0] == data[0][:2, :2].max()
    up = algebra.upsample(px, [[1.0, 1], [1, 1]], (H, W), stride=2, pad=0, value="b").collect()
    assert all(r["b"] == data[r["image_id"]][r["r"] // 2, r["c"] // 2] for r in up) and len(up) == 6 * 4 * H * W


def test_algebra_on_raster_rows(spark, raster):
    data, px = raster
    k = [[1.0, -2, 3], [4, 5, -6]]
    rows = spark.createDataFrame([(i, "x", H, W, np.stack([a, 255 - a]).astype("<f8").tobytes(), 2) for i, a in data.items()] + [(99, "x", H, W, None, 2)], "image_id long, label string, height int, width int, v binary, channels int")
    two = px.withColumn("ch", F.lit(0)).unionByName(px.withColumn("ch", F.lit(1)).withColumn("b", 255 - F.col("b")))
    keys = ("image_id", "ch")
    forms = [
        (algebra_rasters.focal(rows, k, 2), algebra.focal(two, k, (H, W), 2, keys, "b")),
        (algebra_rasters.multi_rate_focal(rows, k, (1, 2), False), algebra.multi_rate_focal(two, k, (H, W), (1, 2), False, keys, "b")),
        (algebra_rasters.multi_rate_focal(rows, k, (1, 2)), algebra.multi_rate_focal(two, k, (H, W), (1, 2), True, keys, "b")),
        (algebra_rasters.block_max(rows), algebra.block_max(two, 2, keys, "b")),
        (algebra_rasters.upsample(rows, k, 2, 1, 1), algebra.upsample(two, k, (H, W), 2, 1, 1, keys, "b")),
    ]
    for by_row, by_pixel in forms:
        got = {r["image_id"]: r for r in by_row.collect()}
        assert got[99]["v"] is None and all(r["label"] == "x" for r in got.values())
        want = {i: np.zeros((2, got[i]["height"], got[i]["width"])) for i in data}
        for r in by_pixel.collect():
            want[r["image_id"]][r["ch"], r["r"], r["c"]] = r["b"]
        assert all(np.allclose(np.frombuffer(got[i]["v"], "<f8").reshape(want[i].shape), want[i]) for i in data)
    assert algebra_rasters.block_max(rows.limit(0)).count() == 0


def test_thresholds_at_ties(spark):
    df = spark.createDataFrame([(127, 0.5, 4.0), (128, 0.5000001, 4.000001)], "b int, q double, s double")
    rows = df.select(pixels.binarise_mask(F.col("b")), pixels.binarise_pred(F.col("q")), pixels.tta_threshold(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (1, 1, 255)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 0.0), (2, 0, 0.0), (3, 1, 0.0)], "image_id int, t int, q double")
    d = {r["image_id"]: r["dice"] for r in metrics.dice(df, ["image_id"]).collect()}
    assert d == {1: 1.0, 2: None, 3: 0.0}
    assert metrics.bce(df.where("image_id = 3")).first()["bce"] == 100.0
    i = {r["image_id"]: r["iou"] for r in metrics.iou(df, ["image_id"]).collect()}
    assert all(i[k] is None or i[k] <= d[k] for k in d)


def test_run_rules(spark):
    losses = [5.0, 4.0, 4.0, 4.1, 4.2, 4.3, 3.0, *[9.0] * 7]
    df = spark.createDataFrame([(1, e, x, 700 * e) for e, x in enumerate(losses, 1)], "run long, epoch int, loss double, elapsed_s long")
    r = [x.asDict() for x in runs.lr_schedule(df).orderBy("epoch").collect()]
    assert [x["no_optim"] for x in r] == [0, 0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 5, 6, 7]
    assert [x["cuts"] for x in r] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 3, 4, 5]
    s = runs.stop_epoch(df).first()
    # the rate before the cut of epoch 13 is 2e-4 / 5^3; the early stop comes at 14
    assert (s["stop_epoch"], s["reason"]) == (14, "early stop")
    assert runs.best_checkpoint(df).first()["epoch"] == 7
    assert [x["checkpoint"] for x in runs.active_checkpoint(df).orderBy("epoch").collect()][:7] == [1, 2, 2, 2, 2, 2, 7]


def test_batches_do_not_depend_on_partitions(spark):
    ids = spark.range(100).withColumnRenamed("id", "image_id")
    a = {r["image_id"]: r["pos"] for r in batches.make_batches(ids.repartition(1), 8).collect()}
    b = {r["image_id"]: r["pos"] for r in batches.make_batches(ids.repartition(7), 8).collect()}
    c = {r["image_id"]: r["pos"] for r in batches.make_batches(ids, 8, epoch=1).collect()}
    assert a == b and sorted(a.values()) == list(range(100)) and a != c


def test_files_round_trip(spark, raster):
    data, px = raster
    path = shared.scratch(spark, "test-masks")
    rows = layouts.rasters_of(px, ["image_id"], "b").withColumn("channels", F.lit(1))
    masks.write_masks(rows, path)
    with pytest.raises(FileExistsError):
        masks.write_masks(rows, path)
    masks.write_masks(rows.where("image_id = 1"), path, if_exists="overwrite")
    assert [r["image_id"] for r in images.scan_masks(spark, path).collect()] == ["1"]
    masks.write_masks(rows, path, if_exists="append")
    got = {int(r["image_id"]): np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in images.scan_masks(spark, path).collect()}
    assert all((got[i] == a).all() for i, a in data.items())


def test_run_log_round_trip(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 700), (1, 2, 0.25, 1400), (2, 1, 9.0, 3)], "run long, epoch int, loss double, elapsed_s long")
    path = shared.scratch(spark, "test-log")
    runlog.write_text_log(df, path)
    assert sorted((r["epoch"], r["loss"], r["elapsed_s"]) for r in runlog.read_run_log(spark, path).collect()) == [(1, 0.5, 700), (1, 9.0, 3), (2, 0.25, 1400)]


def test_audit_and_pair(spark):
    i = spark.createDataFrame([("a", 2, 2), ("b", -1, -1), ("c", 3, 2)], "image_id string, height int, width int")
    m = spark.createDataFrame([("a",), ("b",), ("d",)], "image_id string")
    assert sorted(map(tuple, pairing.raster_audit(i, m, (2, 2)).collect())) == [("b", "undecodable image"), ("c", "image of another shape"), ("c", "no mask"), ("d", "no image")]
    assert pairing.pair(i, m).count() == 2


def test_colour_round_trip_of_greys(spark):
    df = spark.createDataFrame([(v,) for v in range(256)], "v int")
    x = pixels.hsv(F.col("v"), F.col("v"), F.col("v"))
    y = pixels.bgr(x["h"], x["s"], x["v"])
    assert all(r[0] == r[1] == r[2] == r[3] for r in df.select("v", y["b"], y["g"], y["r"]).collect())
    assert math.isclose(df.select(pixels.normalise(F.lit(255))).first()[0], 1.6)


def test_raster_rows_augment_as_pixel_tables(spark):
    """Images of two shapes, neither square, in one table of raster rows; each shape by itself in pixel tables."""
    rng = np.random.default_rng(4)
    shapes = {i: (4, 7) if i % 2 else (6, 5) for i in range(40)}
    pics = {i: rng.integers(0, 256, (*s, 3)).astype(np.uint8) for i, s in shapes.items()}
    grey = {i: rng.integers(0, 256, s).astype(np.uint8) for i, s in shapes.items()}
    rows = spark.createDataFrame([(i, *shapes[i], bytearray(pics[i].tobytes()), bytearray(grey[i].tobytes())) for i in pics], "image_id long, height int, width int, data binary, mask binary")
    got = {r["image_id"]: r for r in augment_rasters.augment_rasters(rows, dtype="float64", rotate=(-30, 30)).collect()}
    for odd in (0, 1):
        some = [i for i in pics if i % 2 == odd]
        px = spark.createDataFrame([(i, ch, r, c, int(pics[i][r, c, ch])) for i in some for ch in range(3) for r in range(shapes[i][0]) for c in range(shapes[i][1])], "image_id long, ch int, r int, c int, b int")
        mk = spark.createDataFrame([(i, r, c, int(grey[i][r, c])) for i in some for r in range(shapes[i][0]) for c in range(shapes[i][1])], "image_id long, r int, c int, b int")
        x = augment.random_ssr(augment.random_hsv(px), shapes[some[0]], by=["ch"], rotate=(-30, 30))
        t = augment.random_ssr(mk, shapes[some[0]], rotate=(-30, 30))
        for f in (augment.random_hflip, augment.random_vflip, augment.random_rot90):
            x, t = f(x, shapes[some[0]]), f(t, shapes[some[0]])
        n = 0
        for r in x.collect():
            one = got[r["image_id"]]
            v = np.frombuffer(one["x"], "<f8").reshape(3, one["height"], one["width"])[r["ch"], r["r"], r["c"]]
            assert math.isclose(v, r["b"] / 255 * 3.2 - 1.6, abs_tol=1e-12)
            n += 1
        for r in t.collect():
            one = got[r["image_id"]]
            assert np.frombuffer(one["t"], np.uint8).reshape(one["height"], one["width"])[r["r"], r["c"]] == (r["b"] >= 128)
        assert n == sum(pics[i].size for i in some)


def test_scores_of_three_bands_and_mixed_shapes(spark):
    rng = np.random.default_rng(5)
    pics = {i: rng.integers(0, 256, (3 + i % 2, 5, 3)).astype(np.uint8) for i in range(7)}
    rows = spark.createDataFrame([(i, *p.shape, bytearray(p.tobytes())) for i, p in pics.items()] + [(99, -1, -1, -1, None)], "image_id long, height int, width int, channels int, data binary")
    weights = (0.2, 0.5, -0.3)
    for how in ({"batch_size": 2}, {"batch_bytes": 1}):
        got = {r["image_id"]: np.frombuffer(r["q"], "<f8").reshape(r["height"], r["width"]) for r in score.score_rasters(rows, score.logistic_factory(weights=weights), dtype="float64", **how).collect()}
        assert set(got) == set(pics)
        for i, p in pics.items():
            z = 0.1 + (p / 255 * 3.2 - 1.6) @ np.array(weights) + 0.05 * np.arange(p.shape[0])[:, None] - 0.03 * np.arange(5)[None, :]
            assert np.allclose(got[i], 1 / (1 + np.exp(-z)))


def test_raster_losses_equal_pixel_losses(spark, raster):
    data, _ = raster
    q = {i: (a / 255.0) for i, a in data.items()}
    rows = spark.createDataFrame([(i, bytearray((a > 99).astype(np.uint8).tobytes()), bytearray(q[i].astype("<f8").tobytes())) for i, a in data.items()], "image_id long, t binary, q binary")
    px = spark.createDataFrame([(i, int(t), float(v)) for i, a in data.items() for t, v in zip((a > 99).ravel(), q[i].ravel(), strict=True)], "image_id long, t int, q double")
    got = {r["image_id"]: r for r in metrics.raster_losses(metrics.raster_sums(rows, ["image_id"], "float64"), ["image_id"]).collect()}
    for r in metrics.evaluate(px, {"bce": metrics.bce_agg, "dice": metrics.dice_agg, "iou": metrics.iou_agg}, ["image_id"]).collect():
        assert all(math.isclose(r[k], got[r["image_id"]][k], abs_tol=1e-9) for k in ("bce", "dice", "iou"))


def golden(spark):
    """A run of 220 epochs with 128 improvements, the best at epoch 214, and cuts after 92, 209, 218 and 219."""
    idle = {*range(89, 93), *range(206, 210), *range(215, 221)}
    idle |= set(list(e for e in range(3, 200) if e % 2 and e not in range(86, 96))[: 220 - 128 - len(idle)])
    loss, rows = 0.632581405982, []
    for e in range(1, 221):
        loss = loss if e in idle else loss * 0.99 + 1e-9 * e if e == 1 else loss - (0.632581405982 - 0.200456294287) / 128
        rows.append((1, e, loss + (1e-7 if e in idle else 0.0), 718 * e))
    return spark.createDataFrame(rows, "run long, epoch int, loss double, elapsed_s long")


def test_golden_run(spark):
    df = golden(spark)
    r = runs.lr_schedule(df)
    assert [x["epoch"] for x in r.where("cut = 1").orderBy("epoch").collect()][:4] == [92, 209, 218, 219]
    assert r.where("improved = 1").count() == 128
    s = runs.stop_epoch(df).first()
    assert (s["stop_epoch"], s["reason"]) == (220, "minimum rate")
    assert runs.best_checkpoint(df).first()["epoch"] == 214 and runs.best_epochs(df, 2).where("rank = 1").first()["epoch"] == 214
    path = shared.scratch(spark, "golden")
    runlog.write_text_log(df, path)
    back = runlog.read_run_log(spark, path).select(F.lit(1).cast("long").alias("run"), "epoch", "loss", "elapsed_s")
    assert sorted(map(tuple, back.collect())) == sorted((r["run"], r["epoch"], r["loss"], r["elapsed_s"]) for r in df.collect())
    lines = [x["value"] for x in spark.read.option("recursiveFileLookup", "true").text(path).collect()]
    assert sum(x.startswith("update learning rate: ") for x in lines) == 4 and lines.count("update learning rate: 0.000200 -> 0.000040") == 1


def test_runs_that_never_improve_have_no_checkpoint(spark):
    df = spark.createDataFrame([(1, 1, 250.0), (1, 2, 200.0), (2, 1, 99.0), (2, 2, 99.5)], "run long, epoch int, loss double")
    assert [tuple(r)[:3] for r in runs.best_checkpoint(df).collect()] == [(2, 1, 99.0)]
    assert runs.best_epochs(df).orderBy("run").first()["epoch"] == 2


def test_monitor_equals_batch_and_marks_late_epochs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STATE_STORE)
    src, dst = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    df = golden(spark).unionByName(golden(spark).withColumn("run", F.lit(2).cast("long")).withColumn("loss", F.col("loss") + 0.3))
    schema = df.schema
    late = df.where("run = 2 and epoch = 5")
    for part in (df.where("epoch < 100 and not (run = 2 and epoch = 5)"), late.unionByName(df.where("epoch >= 100"))):
        part.write.mode("append").parquet(src)
        out = monitor.run_available(monitor.monitor(spark.readStream.schema(schema).parquet(src)), dst)
    cols = ["run", "epoch", "best", "improved", "no_optim", "cuts"]
    want = runs.lr_schedule(df.where("not (run = 2 and epoch = 5)")).select(*cols)
    assert sorted(map(tuple, out.where("late = 0").select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert [(r["run"], r["epoch"]) for r in out.where("late = 1").collect()] == [(2, 5)]


def test_draws_are_uniform_and_stable(spark):
    from tilewright.functions import draws

    u = spark.range(4000).select(draws.draw(F.col("id"), "x").alias("u"), draws.draw(F.col("id"), "x", epoch=1).alias("v"), draws.integer(F.col("id"), "k", -2, 2).alias("k")).toPandas()
    counts = np.histogram(u.u, 10, (0, 1))[0]
    assert abs(counts - 400).max() < 100 and abs(np.corrcoef(u.u, u.v)[0, 1]) < 0.06 and set(u.k) == {-2, -1, 0, 1, 2}
    again = spark.range(4000).repartition(7).select("id", draws.draw(F.col("id"), "x").alias("u")).orderBy("id").toPandas()
    assert (again.u == u.u).all()


def test_four_turns_are_the_identity(raster):
    data, px = raster
    shape, turned = (H, W), px
    for _ in range(4):
        turned, shape = augment.random_rot90(turned, shape, u=1.0), shape[::-1]
    got = grid(turned.collect(), "b", (H, W))
    assert all((got[i] == a).all() for i, a in data.items())
