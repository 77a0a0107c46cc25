"""The header source and the file sink: what they read, and what failed or repeated jobs leave."""

import io
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringEndsWith

from tilewright.functions import pixels
from tilewright.operators import jobs, pairing, score
from tilewright.plans import registry
from tilewright.sources import filesink, headers, images, masks, shared
from tilewright.streaming import monitor


def jpeg(height, width, bands, app=b"x" * 70_000, frame=0xC0):
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    apps = b"".join(segment(0xE1, app[i : i + 65_000]) for i in range(0, len(app), 65_000))
    return b"\xff\xd8" + apps + segment(0xC4, b"table") + b"\xff" + segment(frame, struct.pack(">BHHB", 8, height, width, bands) + b"123" * bands) + b"\xff\xda"


def test_headers_of_files():
    of = lambda data: headers.header(io.BytesIO(data))
    for h, w, n in ((1, 1, 1), (3, 700, 3)):
        assert of(masks.png(h, w, n, bytes(h * w * n))) == ("png", h, w, n)
        assert of(jpeg(h, w, n)) == of(jpeg(h, w, n, frame=0xC2)) == ("jpeg", h, w, n)
    png = lambda kind: b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 5, 4, 8, kind, 0, 0, 0) + struct.pack(">I", 0)
    assert [of(png(k))[3] for k in (0, 2, 3, 4, 6, 1)] == [1, 3, 3, 2, 4, -1]
    whole = jpeg(4, 5, 3)
    for cut in (0, 1, 3, 10, 66_000, len(whole) - 25):
        assert of(whole[:cut]) == headers.UNKNOWN
    for junk in (b"", b"GIF89a" + bytes(50), png(2)[:20], b"\xff\xd8\xff\xda" + bytes(9), b"\xff\xd8\xff\xd9xx", bytes(100)):
        assert of(junk) == headers.UNKNOWN


@pytest.fixture
def folder(spark):
    """Images and masks with every problem that the audit knows."""
    grey, colour = masks.png(4, 5, 1, bytes(20)), masks.png(4, 5, 3, bytes(60))
    files = {"a_sat.png": colour, "a_mask.png": grey, "b_sat.jpg": jpeg(4, 5, 3), "c_mask.png": grey, "d_sat.png": b"junk", "d_mask.png": b"", "e_sat.png": masks.png(9, 5, 3, bytes(135)), "e_mask.png": masks.png(4, 6, 1, bytes(24))}
    path = shared.scratch(spark, "audit")
    filesink.write_set(spark.createDataFrame([(n, bytearray(b)) for n, b in files.items()], "name string, content binary"), path)
    return path


def test_audit_by_headers(spark, folder):
    found = pairing.raster_audit(headers.scan_headers(spark, folder), headers.scan_headers(spark, folder, "*_mask.*", pixels.mask_id), (4, 5))
    assert sorted(map(tuple, found.collect())) == [("b", "no mask"), ("c", "no image"), ("d", "undecodable image"), ("d", "undecodable mask"), ("e", "image of another shape"), ("e", "mask of another shape")]
    decoded = {(r["image_id"], r["height"], r["width"]) for r in images.scan_images(spark, folder, "[ade]_sat.*").collect()}
    assert decoded == {(r["image_id"], r["height"], r["width"]) for r in headers.scan_headers(spark, folder, "[ade]_sat.*").collect()}


def test_header_filters_are_pushed(spark, folder):
    reader = headers._PushReader({"path": folder, "files": "2"})
    size, end = EqualTo(("height",), 4), StringEndsWith(("path",), "_sat.png")
    assert list(reader.pushFilters([size, end])) == [size]
    parts = reader.partitions()
    assert [len(p.files) for p in parts] == [2, 1] and all(f.endswith("_sat.png") for p in parts for f, _ in p.files)
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        got = headers.scan_headers(spark, folder, "*").where(F.col("path").endswith("_sat.png") & (F.col("height") > 0))
        assert sorted(r["image_id"] for r in got.collect()) == ["a", "e"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def listing(path):
    p = shared.open_fs(path)[1]
    near = [n for n in os.listdir(os.path.dirname(p)) if n.startswith(os.path.basename(p)) and n != os.path.basename(p)]
    return sorted(os.listdir(p)) if os.path.isdir(p) else None, near


def content(path, name):
    with open(f"{shared.open_fs(path)[1]}/{name}", "rb") as f:
        return f.read()


def test_failed_job_leaves_nothing(spark):
    path = shared.scratch(spark, "failed")
    good = [(f"f{i}", bytearray(b"%d" % i)) for i in range(20)]
    bad = spark.createDataFrame([*good, ("x/y", bytearray(b"z"))], "name string, content binary").repartition(4)
    with pytest.raises(Exception, match="not a file name"):
        filesink.write_set(bad, path)
    assert listing(path) == (None, [])
    filesink.write_set(spark.createDataFrame(good, "name string, content binary").repartition(3), path)
    assert len(listing(path)[0]) == 20 and listing(path)[1] == []
    with pytest.raises(Exception, match="not a file name"):
        filesink.write_set(bad, path, "overwrite")
    assert len(listing(path)[0]) == 20 and content(path, "f7") == b"7" and listing(path)[1] == []
    new = spark.createDataFrame([("f7", bytearray(b"new")), ("empty", None)], "name string, content binary")
    filesink.write_set(new, path, "append")
    assert len(listing(path)[0]) == 21 and content(path, "f7") == b"new" and content(path, "empty") == b""
    filesink.write_set(new, path, "overwrite")
    assert listing(path) == (["empty", "f7"], [])
    filesink.write_set(new.where("false"), path, "overwrite")
    assert listing(path) == ([], [])


def test_stream_batch_is_committed_once(spark):
    path = shared.scratch(spark, "stream")
    options = {"path": path, "stream": "s"}

    def batch(rows, number):
        w = filesink._Stream(options)
        w.commit([w.write(iter([{"name": n, "content": c} for n, c in rows])), None], number)

    batch([("a", b"1")], 0)
    batch([("a", b"2"), ("b", b"2")], 0)  # the batch comes again: nothing changes
    assert listing(path) == (["_batches", "a"], []) and content(path, "a") == b"1"
    batch([("b", b"3")], 1)
    assert content(path, "b") == b"3"
    w = filesink._Stream(options)
    w.abort([w.write(iter([{"name": "c", "content": b""}]))], 2)
    assert listing(path) == (["_batches", "a", "b"], [])
    options["stream"] = "another"
    batch([("d", b"4")], 0)
    assert content(path, "d") == b"4"


def test_stream_writes_the_masks_of_the_batch_job(spark):
    src, to, again, state = (shared.scratch(spark, n) for n in ("arriving", "masks-stream", "masks-batch", "masks-state"))
    x = [(f"{i}_sat.png", bytearray(masks.png(4, 5, 3, zlib.compress(bytes([i] * 99), 0)[:60]))) for i in range(6)]
    how = {"factory": score.logistic_factory(weights=(0.2, 0.5, -0.3)), "dtype": "float64"}

    def arrive(files):
        filesink.write_set(spark.createDataFrame(files, "name string, content binary"), src, "append")
        masks.stream_masks(jobs.mask_rows(monitor.score_stream(spark, src, **how), dtype="float64"), to, state).awaitTermination()

    arrive(x[:4])
    arrive(x[4:])
    jobs.predict_job(spark, src, again, **how)
    names = [f"{i}_mask.png" for i in range(6)]
    assert listing(again)[0] == names and listing(to) == ([*names, "_batches"], [])
    assert all(content(to, n) == content(again, n) for n in names)


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    one = masks.png(2, 2, 3, bytes(range(12)))
    for i in range(600):
        (tmp_path / f"{i}_sat.png").write_bytes(one)
    found = images.scan_images(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {(r["image_id"], bytes(r["data"])) for r in found.collect()} == {(str(i), bytes(range(12))) for i in range(600)}


def test_pixels_of_files_pass_through_python_once(spark, tmp_path):
    x = {str(i): np.random.default_rng(i).integers(0, 256, 12).astype(np.uint8) for i in range(600)}
    for i, v in x.items():
        (tmp_path / f"{i}_sat.png").write_bytes(masks.png(2, 2, 3, v.tobytes()))
    (tmp_path / "none_sat.png").write_bytes(b"no image")
    got = images.raster_pixels(images.scan_images(spark, str(tmp_path)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Coalesce")  # above: one runner a task
    assert {tuple(r) for r in got.collect()} == {(i, p % 3, p // 6, p // 3 % 2, int(b)) for i, v in x.items() for p, b in enumerate(v)}


@pytest.mark.parametrize("name", ["t7_predict_job", "x2_stream_masks"])
def test_written_masks_pass_back_through_python_once(spark, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert got.count() == 498 and {r["n"] for r in got.collect()} == {64}


def test_mask_files_in_one_pass(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}_sat.png").write_bytes(masks.png(3, 4, 3, np.random.default_rng(i).integers(0, 256, 36).astype(np.uint8).tobytes()))
    (tmp_path / "9_sat.png").write_bytes(b"no image")
    how = {"factory": score.logistic_factory(weights=(0.2, 0.5, -0.3)), "dtype": "float64"}
    rows = images.scan_images(spark, str(tmp_path))
    want = masks.encoded(masks.named(jobs.mask_rows(score.score_rasters(rows, views=True, **how), dtype="float64")))
    got = jobs.mask_files(rows, **how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
