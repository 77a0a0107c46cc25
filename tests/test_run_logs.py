"""Logs of many runs in few files."""

import os

import pytest
from pyspark.sql import functions as F

from tilewright.sources import filesink, logtail, runlog, shared
from tilewright.streaming import monitor

RUNS = 300


def files_below(path):
    return [f"{d}/{f}" for d, _, names in os.walk(shared.open_fs(path)[1]) for f in names if not f.startswith(("_", "."))]


def many(spark):
    """Runs of one to six epochs."""
    r = spark.range(RUNS * 6, numPartitions=3).select((F.col("id") % RUNS).alias("run"), (F.floor(F.col("id") / RUNS) + 1).cast("int").alias("epoch"))
    return r.where("epoch <= 1 + run % 6").withColumn("loss", 1 / (F.col("run") * 7 % 11 + F.col("epoch"))).withColumn("elapsed_s", F.col("epoch").cast("long") * 700)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_a_run_written_again_replaces_its_own_rows_in_few_files(spark):
    path, r = shared.scratch(spark, "saved"), many(spark).withColumn("run", F.expr("nullif(run, 7)"))
    cols = ("coalesce(run, -1) as run", "epoch", "loss", "elapsed_s")
    back = lambda: sorted(map(tuple, runlog.saved_runs(spark, path).selectExpr(*cols).collect()))
    runlog.write_run_log(r, path)
    assert back() == sorted(map(tuple, r.selectExpr(*cols).collect())) and len(files_below(path)) <= 8
    again = r.where("epoch <= 2 and (run in (4, 5) or run is null)").withColumn("loss", F.lit(9.0))
    runlog.write_run_log(again, path)
    want = r.where("run not in (4, 5)").unionByName(again)
    assert back() == sorted(map(tuple, want.selectExpr(*cols).collect())) and len(files_below(path)) <= 16
    runlog.write_run_log(again.where("run = 5 and epoch = 1"), path)
    assert [tuple(x) for x in runlog.saved_runs(spark, path).where("run = 5").select("epoch", "loss").collect()] == [(1, 9.0)]


@pytest.mark.parametrize("split", [None, 150, 1000])
def test_text_logs_of_many_runs_share_files(spark, split):
    path, r = shared.scratch(spark, "shared-logs"), many(spark)
    runlog.write_text_log(r, path, events=False)
    assert len(files_below(path)) <= 8
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        if split:
            spark.conf.set(key, str(split))
        got = rows(runlog.read_run_log(spark, path).withColumn("run", F.col("run").cast("long")), "run", "epoch", "loss", "elapsed_s", "height", "width")
    finally:
        spark.conf.set(key, was)
    assert got == rows(r.withColumn("h", F.lit(1024)).withColumn("w", F.lit(1024)), "run", "epoch", "loss", "elapsed_s", "h", "w")
    if not split:
        text = "".join(open(f).read() for f in files_below(path))
        assert text.count(runlog.END) == RUNS
        for run in (5, 11):
            part = text[text.index(f"run: {run}\nepoch: 1 ") :]
            assert [x for x in part[: part.index(runlog.END)].split("\n") if x.startswith(("run", "epoch"))] == [y for e in range(1, 7) for y in (f"run: {run}", f"epoch: {e}     time: {700 * e}")]


def test_odd_logs(spark, tmp_path):
    body = "from epoch: 3\n*********\r\nepoch: 1     time: 7\r\ntrain_loss: NaN\r\nSHAPE: (8, 9)\r\n********\nrun: x y\nepoch: 2     time: 9\ntrain_loss: -inf\nSHAPE: (8, 9)\nFinish!\n********\nepoch: 3     time: 11\ntrain_lo"
    (tmp_path / "a").write_bytes(body.encode())
    reader = logtail._Reader({"path": f"file://{tmp_path}"})
    tail = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
    batch = runlog.read_run_log(spark, f"file://{tmp_path}").collect()
    for got in (tail, [tuple(r) for r in batch]):
        assert sorted((r[1], r[2], str(r[3]), r[4], r[5], r[6]) for r in got) == [(1, 7, "nan", 8, 9, None), (2, 9, "-inf", 8, 9, "x y")]
    with pytest.raises(Exception, match="a line break in the name"):
        runlog.write_text_log(spark.createDataFrame([("a\nb", 1, 0.5, 7)], "run string, epoch int, loss double, elapsed_s long"), shared.scratch(spark, "broken"), events=False)


def test_growing_logs_of_many_runs_give_each_epoch_once(spark):
    path, to, r = shared.scratch(spark, "growing"), shared.scratch(spark, "grown"), many(spark)
    before = {}
    for part in (r.where("epoch <= 3"), r):
        filesink.write_set(runlog.growing_logs(part, 5), path, "append")
        here = {f: open(f, "rb").read() for f in files_below(path)}
        assert len(here) == 5 and all(here[f].startswith(text) for f, text in before.items())
        before = here
        out = monitor.run_available(logtail.tail_run_logs(spark, path), to).withColumn("run", F.col("run").cast("long"))
        assert rows(out, "run", "epoch", "loss", "elapsed_s") == rows(part, "run", "epoch", "loss", "elapsed_s")


def test_a_partition_has_a_bounded_number_of_new_bytes():
    reader, mb = logtail._Reader({"path": "/none"}), 1 << 20
    end = {str(i).zfill(3): 5 * mb for i in range(200)}
    parts = [p.files for p in reader.partitions({}, end)]
    assert sorted(f for p in parts for f in p) == [(p, 0, n) for p, n in end.items()] and max(sum(n for _, _, n in p) for p in parts) <= 16 * mb
    assert [len(p.files) for p in reader.partitions({p: n - 1 for p, n in end.items()}, end)] == [64, 64, 64, 8]


def test_the_monitor_takes_a_loss_that_is_null_and_makes_no_frames(spark, monkeypatch):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STATE_STORE)
    src = shared.scratch(spark, "losses")
    r = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 4.0), (2, 1, None), (3, 1, 500.0)], "run long, epoch long, loss double")
    r.write.parquet(src)
    stream = monitor.monitor(spark.readStream.schema(r.schema).parquet(src))
    assert "TransformWithStateInPySpark" in stream._jdf.queryExecution().logical().toString()
    got = rows(monitor.run_available(stream, shared.scratch(spark, "nulls")).na.fill(-1.0, ["loss"]), "run", "epoch", "loss", "best", "improved", "no_optim")
    assert got == [(1, 1, 5.0, 100.0, 1, 0), (1, 2, -1.0, 5.0, 0, 1), (1, 3, 4.0, 5.0, 1, 0), (2, 1, -1.0, 100.0, 0, 1), (3, 1, 500.0, 100.0, 0, 1)]

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    from pyspark.sql import Row

    m = monitor.PlateauMonitor()
    m.state = State()
    out = list(m.handleInputRows((1,), iter([Row(run=1, epoch=2, loss=3.0), Row(run=1, epoch=1, loss=4.0)]), None))
    assert [(r["epoch"], r["best"], r["late"]) for r in out] == [(1, 100.0, 0), (2, 4.0, 0)] and m.state.value == (3.0, 0, 0, 2) and m.state.calls == 2
