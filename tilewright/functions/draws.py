"""Repeatable random draws: one number in [0, 1) for each seed, epoch, image and name.

A draw depends on nothing else, so a job can be split or run again freely, and image and mask get the same draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(image_id: Column, name: str, seed: int, epoch: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), image_id.cast("string"), F.lit(name)))


def draw(image_id: Column, name: str, seed: int = 42, epoch: int = 0) -> Column:
    return F.conv(F.substring(draw_key(image_id, name, seed, epoch), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def uniform(image_id: Column, name: str, low: float, high: float, seed: int = 42, epoch: int = 0) -> Column:
    """A float draw in [low, high)."""
    return F.lit(float(low)) + draw(image_id, name, seed, epoch) * F.lit(float(high - low))


def integer(image_id: Column, name: str, low: int, high: int, seed: int = 42, epoch: int = 0) -> Column:
    """An integer draw in low..high, both included."""
    return (F.lit(low) + F.floor(draw(image_id, name, seed, epoch) * F.lit(float(high - low + 1)))).cast("long")


def gate(image_id: Column, name: str, u: float = 0.5, seed: int = 42, epoch: int = 0) -> Column:
    """True with probability ``u``."""
    return draw(image_id, name, seed, epoch) < F.lit(float(u))
