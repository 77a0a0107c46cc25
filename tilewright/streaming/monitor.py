"""Streams: the live plateau and rate monitor, and scoring of images as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilewright.operators.runs import lr_schedule
from tilewright.operators.score import PredictorFactory, score_rasters
from tilewright.sources.images import scan_images

OUT = "run long, epoch long, loss double, best double, improved int, no_optim long, cuts long, lr double, late int"
OUT_ROW = Row(*[c.split()[0] for c in OUT.split(", ")])
CLOSING_ROW = Row(*OUT_ROW, "closed")
#: A run's state: what the next epoch needs.
STATE = "best double, no_optim long, cuts long, last long"


class PlateauMonitor(StatefulProcessor):
    """Per run: best loss, epochs since, cuts so far and the last epoch. A micro-batch's rows are taken in the order of
    their epochs. An epoch that comes after a later one was taken (or again) is late: it is returned with ``late`` = 1 and
    the state as it is, which it doesn't change; on-time rows equal the batch form over them.

    A run may begin with a state of the batch form (``state_of``). With ``silence_ms`` rows have a time ``at``, and a run that
    is silent for so long after its last time, by the watermark, is closed: one row with ``closed`` = 1, its last epoch and
    state and no loss; its state goes, so should it report again, it begins anew.

    A run's rows of one micro-batch are sorted in memory: bound micro-batches by ``maxFilesPerTrigger``. Rows are taken as they
    are, not as a data frame a run, of which a batch with many short runs would make very many.
    """

    def __init__(self, init: float = 100.0, lr0: float = 2e-4, factor: float = 5.0, patience: int = 3, silence_ms: int | None = None):
        self.start, self.lr0, self.factor, self.patience, self.silence_ms = init, lr0, factor, patience, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)
        if self.silence_ms is not None:
            self.due = handle.getValueState("due", "at long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        best, idle, cuts, last = (initialState[c] for c in ("best", "no_optim", "cuts", "last"))
        self.state.update((float(best), int(idle), int(cuts), int(last)))
        if self.silence_ms is not None and "at" in initialState and initialState["at"] is not None:
            self._wait(initialState["at"])

    def _wait(self, at: datetime) -> None:
        """Close the run at this time and the silence, if that is later than what was set before."""
        due = int(at.timestamp() * 1000) + self.silence_ms
        if self.due.exists():
            if (was := self.due.get()[0]) >= due:
                return
            self.handle.deleteTimer(was)
        self.handle.registerTimer(due)
        self.due.update((due,))

    def _out(self, values: tuple, closed: int) -> Row:
        return OUT_ROW(*values) if self.silence_ms is None else CLOSING_ROW(*values, closed)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.state.get()
        best, idle, cuts, last = (self.start, 0, 0, -(1 << 63)) if state is None else state
        given = sorted(rows, key=lambda r: r["epoch"])
        if not given:
            return
        for r in given:
            epoch, loss = r["epoch"], None if r["loss"] is None else float(r["loss"])
            if epoch <= last:
                yield self._out((key[0], epoch, loss, best, 0, idle, cuts, self.lr0 / self.factor**cuts, 1), 0)
                continue
            before, better, last = best, loss is not None and loss < best, epoch
            best, idle = (loss, 0) if better else (best, idle + 1)
            cuts += idle > self.patience
            yield self._out((key[0], epoch, loss, before, int(better), idle, cuts, self.lr0 / self.factor**cuts, 0), 0)
        self.state.update((float(best), int(idle), int(cuts), int(last)))
        if self.silence_ms is not None and (times := [r["at"] for r in given if r["at"] is not None]):
            self._wait(max(times))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.state.get()
        if state is None:
            return
        best, idle, cuts, last = state
        self.state.clear()
        self.due.clear()
        yield self._out((key[0], last, None, best, 0, idle, cuts, self.lr0 / self.factor**cuts, 0), 1)

    def close(self) -> None:
        pass


def state_of(runs: DataFrame, **how) -> DataFrame:
    """run, best, no_optim, cuts, last: the state that a stream over the batch form's rows (run, epoch, loss) would have."""
    r = lr_schedule(runs, **how)
    after = F.when(F.col("improved") == 1, F.col("loss")).otherwise(F.col("best"))
    held = F.max_by(F.struct(after.cast("double").alias("best"), F.col("no_optim").cast("long").alias("no_optim"), F.col("cuts").cast("long").alias("cuts"), F.col("epoch").cast("long").alias("last")), "epoch")
    return r.groupBy("run").agg(held.alias("s")).select("run", "s.*")


def monitor(runs: DataFrame, known: DataFrame | None = None, **how) -> DataFrame:
    """A stream of (run, epoch, loss) to the batch form's columns, row by row; ``known``: states to begin with
    (``state_of``)."""
    begin = known.groupBy("run") if known is not None else None
    return runs.groupBy("run").transformWithState(PlateauMonitor(**how), outputStructType=OUT, outputMode="Append", timeMode="None", initialState=begin)


def monitor_until_silent(runs: DataFrame, silence_ms: int, delay: str = "0 seconds", known: DataFrame | None = None, **how) -> DataFrame:
    """``monitor`` of (run, epoch, loss, at) that closes runs which are silent for ``silence_ms``, with ``closed``."""
    begin = known.groupBy("run") if known is not None else None
    timed = runs.withWatermark("at", delay).groupBy("run")
    return timed.transformWithState(PlateauMonitor(silence_ms=silence_ms, **how), outputStructType=f"{OUT}, closed int", outputMode="Append", timeMode="EventTime", initialState=begin)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet below ``path``; returns the written rows."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def score_stream(spark: SparkSession, root: str, factory: PredictorFactory, batch_size: int = 8, **how) -> DataFrame:
    """The eight-view sum of images as they arrive in ``root``: the fused form, which needs no streaming state."""
    return score_rasters(scan_images(spark, root, streaming=True), factory, batch_size, views=True, **how)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
