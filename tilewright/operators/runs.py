"""Analysis of training runs: (run, epoch, loss[, elapsed_s]) with window functions, one partition a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

INIT = 100.0


def _by() -> WindowSpec:
    return Window.partitionBy("run").orderBy("epoch")


def running_best(runs: DataFrame, init: float = INIT) -> DataFrame:
    """``best``: the least loss of earlier epochs, at most ``init``; ``improved``: strictly below it."""
    before = F.min("loss").over(_by().rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("best", F.least(F.coalesce(before, F.lit(init)), F.lit(init))).withColumn("improved", F.coalesce(F.col("loss") < F.col("best"), F.lit(False)).cast("int"))


def plateau(runs: DataFrame, init: float = INIT) -> DataFrame:
    """``no_optim``: epochs since the last improvement (a rate cut doesn't reset it)."""
    r = running_best(runs, init).withColumn("_island", F.sum("improved").over(_by()))
    return r.withColumn("no_optim", F.sum(1 - F.col("improved")).over(Window.partitionBy("run", "_island").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def lr_schedule(runs: DataFrame, lr0: float = 2e-4, factor: float = 5.0, patience: int = 3, init: float = INIT) -> DataFrame:
    """``cuts`` so far, the rate before (``lr_before``) and after (``lr``) each epoch; recomputed from counts."""
    r = plateau(runs, init).withColumn("cut", (F.col("no_optim") > patience).cast("int"))
    r = r.withColumn("cuts", F.sum("cut").over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    return r.withColumn("lr", F.lit(lr0) / F.pow(F.lit(factor), F.col("cuts"))).withColumn("lr_before", F.lit(lr0) / F.pow(F.lit(factor), F.col("cuts") - F.col("cut")))


def set_rate(runs: DataFrame, new_lr: Column, lr0: float = 2e-4) -> DataFrame:
    """The rate set directly: the last that isn't null so far."""
    return runs.withColumn("lr", F.coalesce(F.last(new_lr, ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(lr0)))


def stop_epoch(runs: DataFrame, early: int = 6, patience: int = 3, min_lr: float = 5e-7, total: int = 300, block: int | None = None, **how) -> DataFrame:
    """run, stop_epoch, reason. The early stop is tested first, then the rate before a cut, then the last epoch. ``block``:
    the blocks' epochs of ``lr_schedule_blocked``, for very long runs."""
    r = lr_schedule(runs, patience=patience, **how) if block is None else lr_schedule_blocked(runs, patience=patience, block=block, **how)
    reason = F.when(F.col("no_optim") > early, "early stop").when((F.col("no_optim") > patience) & (F.col("lr_before") < min_lr), "minimum rate").when(F.col("epoch") >= total, "total epochs")
    return r.withColumn("reason", reason).where("reason is not null").groupBy("run").agg(F.min("epoch").alias("stop_epoch"), F.min_by("reason", "epoch").alias("reason"))


def until_stop(runs: DataFrame, **how) -> DataFrame:
    """Rows up to each run's stop."""
    stops = stop_epoch(runs, **how).select("run", "stop_epoch")
    return runs.join(stops, "run", "left").where(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))).drop("stop_epoch")


def epoch_seconds(runs: DataFrame) -> DataFrame:
    return runs.withColumn("seconds", F.col("elapsed_s") - F.lag("elapsed_s", 1, 0).over(_by()))


def active_checkpoint(runs: DataFrame, init: float = INIT) -> DataFrame:
    """``checkpoint``: the epoch whose weights a reload would use (null before the first improvement)."""
    return running_best(runs, init).withColumn("checkpoint", F.max(F.when(F.col("improved") == 1, F.col("epoch"))).over(_by().rowsBetween(Window.unboundedPreceding, 0)))


def best_checkpoint(runs: DataFrame, path: Column | None = None, init: float = INIT) -> DataFrame:
    """run, epoch, loss and path of the weights that were saved last: weights are saved on improvement below ``init``, so a
    run that never comes below it has none."""
    path = path if path is not None else F.format_string("checkpoints/%s", F.col("run").cast("string"))
    saved = running_best(runs, init).where("improved = 1")
    return saved.groupBy("run").agg(F.max(F.struct("epoch", "loss")).alias("b")).select("run", F.col("b.epoch").alias("epoch"), F.col("b.loss").alias("loss"), path.alias("path"))


def best_epochs(runs: DataFrame, k: int = 1) -> DataFrame:
    """run, rank, epoch, loss of the ``k`` least losses of each run, whether saved or not; the earlier of equal ones."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy("loss", "epoch"))
    return runs.select("run", rank.alias("rank"), "epoch", "loss").where(F.col("rank") <= k)


def first_epochs(runs: DataFrame, n: int = 300) -> DataFrame:
    return runs.where(F.col("epoch") <= n)


def progress(df: DataFrame, by: str, order: str, every: int = 10) -> DataFrame:
    """Every ``every``-th row of a group, the first included, with its number (from 0)."""
    return df.withColumn("item", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).where(F.col("item") % every == 0)


def lr_schedule_blocked(runs: DataFrame, lr0: float = 2e-4, factor: float = 5.0, patience: int = 3, init: float = INIT, block: int = 100_000) -> DataFrame:
    """``lr_schedule`` for runs that are too long for one window partition: the same columns and rows.

    A run is cut into blocks of ``block`` epochs. What a block passes on is a small summary that can be put together in any
    grouping: its least loss and rows, the number of its last improvement's row, its rate cuts. Each is summed up over the
    blocks of a run (a row for each block), and the windows are those of (run, block).
    """
    own = Window.partitionBy("run", "_block").orderBy("epoch")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, parts: dict[str, Column], passed: dict[str, Column]) -> DataFrame:
        """``rows`` with what the blocks before theirs pass on."""
        blocks = rows.groupBy("run", "_block").agg(*[c.alias(n) for n, c in parts.items()])
        return rows.join(blocks.select("run", "_block", *[c.alias(n) for n, c in passed.items()]), ["run", "_block"])

    r = runs.withColumn("_block", F.floor(F.col("epoch") / block))
    least = F.least(F.coalesce(F.min("_least").over(before), F.lit(init)), F.lit(init))
    r = carried(r, {"_least": F.min("loss"), "_n": F.count(F.lit(1))}, {"_best0": least, "_rows0": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    here = F.min("loss").over(own.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("best", F.least(F.coalesce(here, F.col("_best0")), F.col("_best0"))).withColumn("improved", F.coalesce(F.col("loss") < F.col("best"), F.lit(False)).cast("int"))
    r = r.withColumn("_row", F.col("_rows0") + F.row_number().over(own))
    better = F.when(F.col("improved") == 1, F.col("_row"))
    r = carried(r, {"_last": F.max(better)}, {"_last0": F.coalesce(F.max("_last").over(before), F.lit(0))})
    r = r.withColumn("no_optim", F.col("_row") - F.coalesce(F.max(better).over(so_far), F.col("_last0"))).withColumn("cut", (F.col("no_optim") > patience).cast("int"))
    r = carried(r, {"_cuts": F.sum("cut")}, {"_cuts0": F.coalesce(F.sum("_cuts").over(before), F.lit(0))})
    r = r.withColumn("cuts", F.col("_cuts0") + F.sum("cut").over(so_far))
    r = r.withColumn("lr", F.lit(lr0) / F.pow(F.lit(factor), F.col("cuts"))).withColumn("lr_before", F.lit(lr0) / F.pow(F.lit(factor), F.col("cuts") - F.col("cut")))
    return r.select(*runs.columns, "best", "improved", "no_optim", "cut", "cuts", "lr", "lr_before")
