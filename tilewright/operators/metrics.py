"""Losses and overlaps of predictions (q) with truth (t), as aggregations. ``by``: grouping columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups whose states a task holds at a time.
GROUPS = 10_000
#: A plug-in loss: (t, q) to an aggregate column.
Loss = Callable[[Column, Column], Column]


def align(pred: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("image_id", "r", "c")) -> DataFrame:
    return pred.join(truth, list(keys))


def bce_terms(t: Column, q: Column, clamp: float = -100.0) -> Column:
    """Cross entropy of one pixel; each logarithm at least ``clamp``."""
    log = lambda x: F.when(x > 0, F.greatest(F.log(x), F.lit(clamp))).otherwise(F.lit(clamp))
    return -(t * log(q) + (1 - t) * log(1 - q))


def bce_agg(t: Column, q: Column) -> Column:
    return F.avg(bce_terms(t, q))


def dice_agg(t: Column, q: Column, smooth: float = 0.0) -> Column:
    """Soft Dice; null where truth and prediction are both empty and ``smooth`` is 0."""
    return F.try_divide(2 * F.sum(t * q) + smooth, F.sum(t) + F.sum(q) + smooth)


def iou_agg(t: Column, q: Column, smooth: float = 0.0) -> Column:
    both = F.sum(t * q)
    return F.try_divide(both + smooth, F.sum(t) + F.sum(q) - both + smooth)


def evaluate(pairs: DataFrame, losses: dict[str, Loss], by: list[str] | None = None) -> DataFrame:
    """Any number of losses in one aggregation."""
    t, q = F.col("t"), F.col("q")
    return pairs.groupBy(*(by or [])).agg(*[f(t, q).alias(n) for n, f in losses.items()])


def bce(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return evaluate(pairs, {"bce": bce_agg}, by)


def dice(pairs: DataFrame, by: list[str] | None = None, mean: bool = False, smooth: float = 0.0) -> DataFrame:
    """Dice for each group; with ``mean``, the mean of the groups' values."""
    each = evaluate(pairs, {"dice": lambda t, q: dice_agg(t, q, smooth)}, by)
    return each.agg(F.avg("dice").alias("dice")) if mean else each


def dice_loss(pairs: DataFrame, by: list[str] | None = None, smooth: float = 0.0) -> DataFrame:
    return evaluate(pairs, {"dice_loss": lambda t, q: 1 - dice_agg(t, q, smooth)}, by)


def dice_bce_loss(pairs: DataFrame, by: list[str] | None = None, batch: bool = True) -> DataFrame:
    """Cross entropy plus Dice loss; ``batch=False`` takes Dice for each image and then the mean."""
    by = by or []
    if batch:
        return evaluate(pairs, {"loss": lambda t, q: bce_agg(t, q) + 1 - dice_agg(t, q)}, by)
    t, q = F.col("t"), F.col("q")
    each = pairs.groupBy(*dict.fromkeys([*by, "image_id"])).agg(F.sum(bce_terms(t, q)).alias("_e"), F.count(F.lit(1)).alias("_n"), dice_agg(t, q).alias("_d"))
    return each.groupBy(*by).agg((F.sum("_e") / F.sum("_n") + 1 - F.avg("_d")).alias("loss"))


def iou(pairs: DataFrame, by: list[str] | None = None, smooth: float = 0.0) -> DataFrame:
    return evaluate(pairs, {"iou": lambda t, q: iou_agg(t, q, smooth)}, by)


def epoch_loss(batch_losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean of the batches' losses, whatever their sizes."""
    return batch_losses.groupBy(*(by or [])).agg(F.avg("loss").alias("epoch_loss"))


def raster_sums(rows: DataFrame, keys: list[str], dtype: str = "float32", clamp: float = -100.0) -> DataFrame:
    """Raster rows (keys, t: bytes 0 and 1, q: little-endian ``dtype``) to one small row each: n, sums of t, q, t*q and of
    the cross entropy. A megapixel pair is one row in and one out, where a pixel table would join a million. A null payload
    gives zeros; payloads of different lengths are an error that names the row."""
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at, (a, b) in enumerate(zip(f["t"], f["q"], strict=True)):
                if a is None or b is None:
                    out.append((0, 0.0, 0.0, 0.0, 0.0))
                    continue
                t, q = np.frombuffer(a, np.uint8).astype(np.float64), np.frombuffer(b, dtype).astype(np.float64)
                if len(t) != len(q):
                    raise ValueError(f"payloads of {len(t)} and {len(q)} values in {f[keys].iloc[at].to_dict()}")
                with np.errstate(divide="ignore"):
                    e = -(t * np.maximum(np.log(q), clamp) + (1 - t) * np.maximum(np.log1p(-q), clamp))
                out.append((len(t), t.sum(), q.sum(), (t * q).sum(), e.sum()))
            yield pd.concat([f[keys].reset_index(drop=True), pd.DataFrame(out, columns=["n", "s_t", "s_q", "s_tq", "s_e"])], axis=1)

    return rows.select(*keys, "t", "q").mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, s_t double, s_q double, s_tq double, s_e double"]))


def raster_losses(sums: DataFrame, by: list[str] | None = None, smooth: float = 0.0) -> DataFrame:
    """bce, dice, iou, dice_loss and loss (cross entropy plus Dice loss) of ``raster_sums``, for each group."""
    n, t, q, tq, e = (F.sum(c) for c in ("n", "s_t", "s_q", "s_tq", "s_e"))
    dice, iou = F.try_divide(2 * tq + smooth, t + q + smooth), F.try_divide(tq + smooth, t + q - tq + smooth)
    return sums.groupBy(*(by or [])).agg((e / n).alias("bce"), dice.alias("dice"), iou.alias("iou"), (1 - dice).alias("dice_loss"), (e / n + 1 - dice).alias("loss"))


def raster_aggregate(rows: DataFrame, zero: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: dict[str, Callable[[np.ndarray], float]], by: list[str], dtype: str = "float32", fan: int = 64) -> DataFrame:
    """A plug-in loss on raster rows (by, t: bytes 0 and 1, q: little-endian ``dtype``): for each group the numbers ``finish``.

    ``zero`` gives a state (an array of doubles), ``add`` the state with one image's t and q, ``merge`` that of two states.
    Each task adds its images to the states of their groups, ``GROUPS`` at a time; these are merged in two steps, ``fan``
    tasks a group and then one, so a group that has most images is no task's whole work. ``merge`` must not depend on the
    order. Rows with a null payload add nothing (a group of these alone has the state ``zero``); payloads of different
    lengths are an error that names the group.
    """
    kinds = dict(rows.dtypes)
    held = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "_part int, _state array<double>"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, states = TaskContext.get().partitionId() % fan, {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, part, s.tolist()) for k, s in states.items()], columns=[*by, "_part", "_state"])

        for f in frames:
            for *key, a, b in f[[*by, "t", "q"]].astype(object).where(f[[*by, "t", "q"]].notna(), None).itertuples(index=False, name=None):
                s = states.get(key := tuple(key))
                s = zero() if s is None else s
                if a is not None and b is not None:
                    t, q = np.frombuffer(a, np.uint8).astype(np.float64), np.frombuffer(b, dtype).astype(np.float64)
                    if len(t) != len(q):
                        raise ValueError(f"payloads of {len(t)} and {len(q)} values in {dict(zip(by, key, strict=True))}")
                    s = add(s, t, q)
                states[key] = s
            if len(states) > GROUPS:
                yield out()
                states = {}
        yield out()

    def merged(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, state = None, None  # rows come sorted by key
            for f in frames:
                out = []
                f = f.astype(object).where(f.notna(), None)
                for row in f[[*by, "_part", "_state"]].itertuples(index=False, name=None):
                    own, s = row[:-1] if "_part" in keys else row[:-2], np.asarray(row[-1], np.float64)
                    if key != own and key is not None:
                        out.append((*(key if "_part" in keys else (*key, 0)), state.tolist()))
                    key, state = own, s if key != own else merge(state, s)
                yield pd.DataFrame(out, columns=[*by, "_part", "_state"])
            if key is not None:
                yield pd.DataFrame([(*(key if "_part" in keys else (*key, 0)), state.tolist())], columns=[*by, "_part", "_state"])

        return run

    states = rows.select(*by, "t", "q").mapInPandas(partial, held)
    for keys in ([*by, "_part"], by):
        dealt = states.repartition(*keys).sortWithinPartitions(*keys) if keys else states.coalesce(1)
        states = dealt.mapInPandas(merged(keys), held)

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = {n: [fn(np.asarray(s, np.float64)) for s in f["_state"]] for n, fn in finish.items()}
            yield pd.concat([f[by].reset_index(drop=True), pd.DataFrame(values, columns=list(finish), dtype="float64")], axis=1)

    return states.mapInPandas(last, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), *(f"`{n}` double" for n in finish)]))
