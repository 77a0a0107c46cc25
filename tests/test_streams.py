"""Growing logs, warm starts and silent runs."""

import os

import pytest
from pyspark.sql import functions as F

from tilewright.operators import runs
from tilewright.sources import logtail, runlog, shared
from tilewright.streaming import monitor


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STATE_STORE)


def losses(n, shift=0.0):
    return [round(1 / (1 + i % 11) + shift + (i * 7 % 5) / 50, 6) for i in range(1, n + 1)]


def text(loss, first=1):
    return "".join(f"********\nepoch: {i}     time: {700 * i}\ntrain_loss: {x}\nSHAPE: (1024, 1024)\n" + ("update learning rate: 0.1 -> 0.02\n" if i % 9 == 0 else "") for i, x in enumerate(loss, first))


def test_growing_logs_give_each_epoch_once(spark):
    root, to = shared.scratch(spark, "logs"), shared.scratch(spark, "tailed")
    here = shared.open_fs(root)[1]
    a, b = losses(40), losses(25, 0.3)
    stages = [{"a.log": "started\n" + text(a[:10]) + text(a[10:11], 11)[:30]}, {"a.log": "started\n" + text(a[:30]), "b.log": text(b[:3])}, {"a.log": "started\n" + text(a) + "Finish!\n", "b.log": text(b).rstrip("\n")}, {}]
    got = []
    for files in stages:
        os.makedirs(here, exist_ok=True)
        for name, body in files.items():
            with open(f"{here}/{name}", "w") as f:
                f.write(body)
        out = monitor.run_available(logtail.tail_run_logs(spark, root, "*.log"), to)
        got.append(sorted((os.path.basename(r["file"]), r["epoch"], r["loss"]) for r in out.collect()))
    part = lambda name, x: [(name, i, v) for i, v in enumerate(x, 1)]
    assert got == [part("a.log", a[:10]), part("a.log", a[:30]) + part("b.log", b[:3]), part("a.log", a) + part("b.log", b), part("a.log", a) + part("b.log", b)]
    batch = sorted((os.path.basename(r["file"]), r["epoch"], r["elapsed_s"], r["loss"], r["height"]) for r in runlog.read_run_log(spark, root).collect())
    assert batch == sorted((os.path.basename(r["file"]), r["epoch"], r["elapsed_s"], r["loss"], r["height"]) for r in out.collect())


def test_last_whole_epoch_before_much_else(tmp_path):
    body = text(losses(5)) + "noise\n" * 30_000 + "********\nepoch: 6     ti"
    (tmp_path / "a").write_text(body)
    reader = logtail._Reader({"path": f"file://{tmp_path}"})
    end = reader.latestOffset()
    assert end == {str(tmp_path / "a"): body.index("noise") - 1}
    parts = reader.partitions({}, end)
    assert [r[1] for p in parts for r in reader.read(p)] == [1, 2, 3, 4, 5] and reader.partitions(end, end) == []
    (tmp_path / "a").write_text("short")
    assert reader.partitions(end, reader.latestOffset()) == [] and logtail._Reader({"path": f"file://{tmp_path}/none"}).latestOffset() == {}


def frame(spark, *series):
    rows = [(run, i, x) for run, loss in series for i, x in enumerate(loss, 1)]
    return spark.createDataFrame(rows, "run long, epoch long, loss double")


def test_restart_from_a_saved_table_equals_an_unbroken_stream(spark):
    src = shared.scratch(spark, "later")
    whole = frame(spark, (1, losses(60)), (2, losses(60, 0.2)), (3, [200.0] * 30), (4, losses(5)))
    before, after = whole.where("epoch <= 20 and run <> 4"), whole.where("epoch > 20 or run = 4")
    after.write.parquet(src)
    saved = shared.scratch(spark, "states")
    monitor.state_of(before).write.parquet(saved)
    stream = monitor.monitor(spark.readStream.schema(whole.schema).parquet(src), known=spark.read.parquet(saved))
    out = monitor.run_available(stream, shared.scratch(spark, "warm"))
    cols = ["run", "epoch", "best", "improved", "no_optim", "cuts"]
    want = runs.lr_schedule(whole).where("epoch > 20 or run = 4").select(*cols)
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.collect())) and out.where("late = 1").count() == 0


def test_silent_runs_are_closed(spark):
    src, to = shared.scratch(spark, "timed"), shared.scratch(spark, "closed")
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + 60 * m)
    df = frame(spark, (1, losses(12)), (2, losses(60, 0.2))).withColumn("at", at(F.col("epoch")))
    back = frame(spark, (1, [0.5])).withColumn("at", at(F.lit(70)))
    for part in (df.where("epoch <= 12"), df.where("epoch between 13 and 40"), df.where("epoch > 40"), back):
        part.coalesce(1).write.mode("append").parquet(src)
        out = monitor.run_available(monitor.monitor_until_silent(spark.readStream.schema(df.schema).parquet(src), 10 * 60_000), to)
    closed = out.where("closed = 1").collect()
    last = runs.lr_schedule(df.where("run = 1")).where("epoch = 12").first()
    assert [(r["run"], r["epoch"], r["loss"], r["cuts"]) for r in closed if r["run"] == 1] == [(1, 12, None, last["cuts"])]
    again = out.where("run = 1 and closed = 0 and loss = 0.5 and epoch = 1").orderBy("best").collect()
    assert again[-1]["best"] == 100.0  # it begins anew
    assert out.where("closed = 0").count() == 73


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocked_schedule_equals_the_windows(spark, block):
    df = frame(spark, (1, losses(150)), (2, losses(40, 0.2)), (3, [200.0] * 25), (4, [5.0, None, 4.0, None, None, 9.0, 9.0, 9.0, 3.0]), (5, [0.5])).withColumn("best", F.lit("clash")).drop("best")
    want = runs.lr_schedule(df)
    got = runs.lr_schedule_blocked(df, block=block)
    assert set(got.columns) == set(want.columns)
    key = lambda x: sorted(tuple(str(v) for v in r) for r in x.select(*want.columns).collect())
    assert key(got) == key(want)
    assert runs.lr_schedule_blocked(df.where("false"), block=block).count() == 0


def test_ranges_follow_the_ids(spark, monkeypatch):
    from tilewright.operators import batches

    ids = spark.range(1000).withColumnRenamed("id", "image_id")
    want = {r["image_id"]: r["pos"] for r in batches.make_batches(ids, 8, ranges=64).collect()}
    assert sorted(want.values()) == list(range(1000))
    for most in (1_000_000, 10):
        monkeypatch.setattr(batches, "RANGE_ROWS", most)
        assert {r["image_id"]: r["pos"] for r in batches.make_batches(ids, 8).collect()} == want
