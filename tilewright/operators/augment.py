"""Random augmentations of pixel tables. Each draws from (seed, epoch, image), so image and mask go together.

A pixel table has image_id, r, c and a byte column; colour tables also ch (0 blue, 1 green, 2 red).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import draws, pixels
from tilewright.operators.layouts import merge_channels, split_channels

ID = "image_id"
STEPS = ("hsv", "ssr", "hflip", "vflip", "rot90")


def chances(u: float | Mapping[str, float]) -> dict[str, float]:
    """The probability of each step: one for all, or by name (0.5 for those without)."""
    if isinstance(u, Mapping):
        if unknown := set(u) - set(STEPS):
            raise ValueError(f"no such steps: {sorted(unknown)}")
        return {n: u.get(n, 0.5) for n in STEPS}
    return dict.fromkeys(STEPS, u)


def random_hsv(df: DataFrame, hue=(-30, 30), sat=(-5, 5), val=(-15, 15), u: float = 0.5, seed: int = 42, epoch: int = 0, hue_wrap: int = 256) -> DataFrame:
    """Shift hue (wrapping at ``hue_wrap``), saturation and value (saturating) of gated images."""
    i = F.col(ID)
    planes = split_channels(df, ["b", "g", "r_"], [ID, "r", "c"])
    p = planes.select(ID, "r", "c", "b", "g", "r_", *[x.alias(f"_{k}") for k, x in pixels.hsv(F.col("b"), F.col("g"), F.col("r_")).items()])
    h = pixels.wrap_add(F.col("_h"), draws.integer(i, "hue", *hue, seed, epoch), hue_wrap)
    s = pixels.saturating_add(F.col("_s"), draws.uniform(i, "sat", *sat, seed, epoch))
    v = pixels.saturating_add(F.col("_v"), draws.uniform(i, "val", *val, seed, epoch))
    p = p.withColumns({"_h2": h, "_s2": s, "_v2": v})
    new = pixels.bgr(F.col("_h2"), F.col("_s2"), F.col("_v2"))
    on = draws.gate(i, "hsv", u, seed, epoch)
    p = p.select(ID, "r", "c", F.when(on, new["b"]).otherwise(F.col("b")).alias("b0"), F.when(on, new["g"]).otherwise(F.col("g")).alias("b1"), F.when(on, new["r"]).otherwise(F.col("r_")).alias("b2"))
    return merge_channels(p, ["b0", "b1", "b2"], [ID, "r", "c"]).select(ID, "ch", "r", "c", "b")


def affine(shape: tuple[int, int], shift=(-0.1, 0.1), scale=(-0.1, 0.1), aspect=(-0.1, 0.1), rotate=(0.0, 0.0), seed: int = 42, epoch: int = 0, true_aspect: bool = False) -> dict[str, Column]:
    """The drawn matrix R = [[a, b], [c, d]] and shift of an image, as columns, with the matrix's inverse.

    By default the aspect enters both axes alike and ``sy`` the sine terms only; ``true_aspect`` scales x and y apart.
    """
    i, (height, width) = F.col(ID), shape
    ang = F.radians(draws.uniform(i, "angle", *rotate, seed, epoch))
    k = draws.uniform(i, "scale", 1 + scale[0], 1 + scale[1], seed, epoch)
    asp = F.sqrt(draws.uniform(i, "aspect", 1 + aspect[0], 1 + aspect[1], seed, epoch))
    sx, sy = k * asp, k / asp
    cos, sin = F.cos(ang), F.sin(ang)
    a, b, c, d = (cos * sx, -sin * sx, sin * sy, cos * sy) if true_aspect else (cos * sx, -sin * sy, sin * sy, cos * sx)
    return {"m_a": a, "m_b": b, "m_c": c, "m_d": d, "m_x": F.round(draws.uniform(i, "dx", *shift, seed, epoch) * width), "m_y": F.round(draws.uniform(i, "dy", *shift, seed, epoch) * height)}


def random_ssr(df: DataFrame, shape: tuple[int, int], value: str = "b", by: list[str] | None = None, border: float = 0.0, u: float = 0.5, seed: int = 42, epoch: int = 0, **ranges) -> DataFrame:
    """Shift, scale, aspect and turn gated images: inverse mapping, bilinear, ``border`` outside.

    Every source pixel's four destinations can't be told from the source, so each target pixel asks for four taps and
    an equi-join on (image, row, column) fetches them; a target of which all taps are outside gets the border.
    """
    height, width = shape
    by = by or []
    keys = [ID, *by]
    cx, cy = width // 2, height // 2
    m = affine(shape, seed=seed, epoch=epoch, **ranges)
    on = draws.gate(F.col(ID), "ssr", u, seed, epoch)
    gated = df.where(on)
    t = gated.select(*keys, "r", "c", *[x.alias(k) for k, x in m.items()])
    x, y = F.col("c") - cx - F.col("m_x"), F.col("r") - cy - F.col("m_y")
    det = F.col("m_a") * F.col("m_d") - F.col("m_b") * F.col("m_c")
    t = t.withColumns({"_x": (F.col("m_d") * x - F.col("m_b") * y) / det + cx, "_y": (F.col("m_a") * y - F.col("m_c") * x) / det + cy})
    t = t.withColumns({"_x0": F.floor("_x"), "_y0": F.floor("_y")}).withColumns({"_fx": F.col("_x") - F.col("_x0"), "_fy": F.col("_y") - F.col("_y0")})
    taps = [F.struct((F.col("_y0") + j).alias("sr"), (F.col("_x0") + i).alias("sc"), ((F.col("_fx") if i else 1 - F.col("_fx")) * (F.col("_fy") if j else 1 - F.col("_fy"))).alias("w")) for j in (0, 1) for i in (0, 1)]
    t = t.select(*keys, "r", "c", F.explode(F.array(*taps)).alias("_t")).select(*keys, "r", "c", F.col("_t.sr").cast("int").alias("sr"), F.col("_t.sc").cast("int").alias("sc"), F.col("_t.w").alias("w"))
    src = gated.select(*keys, F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("_v"))
    got = t.join(src, [*keys, "sr", "sc"], "left").groupBy(*keys, "r", "c").agg(F.sum(F.col("w") * F.coalesce("_v", F.lit(border))).alias("_s"))
    # nine decimals first, so that equal sums in another order round alike
    warped = got.select(*keys, "r", "c", F.floor(F.round("_s", 9) + 0.5).cast("int").alias(value))
    return warped.unionByName(df.where(~on).select(*keys, "r", "c", F.col(value).cast("int").alias(value)))


def random_hflip(df: DataFrame, shape: tuple[int, int], u: float = 0.5, seed: int = 42, epoch: int = 0) -> DataFrame:
    return df.withColumn("c", F.when(draws.gate(F.col(ID), "hflip", u, seed, epoch), shape[1] - 1 - F.col("c")).otherwise(F.col("c")))


def random_vflip(df: DataFrame, shape: tuple[int, int], u: float = 0.5, seed: int = 42, epoch: int = 0) -> DataFrame:
    return df.withColumn("r", F.when(draws.gate(F.col(ID), "vflip", u, seed, epoch), shape[0] - 1 - F.col("r")).otherwise(F.col("r")))


def random_rot90(df: DataFrame, shape: tuple[int, int], u: float = 0.5, seed: int = 42, epoch: int = 0) -> DataFrame:
    """A quarter turn against the clock; height and width of gated images change places."""
    on = draws.gate(F.col(ID), "rot90", u, seed, epoch)
    return df.withColumn("_r", F.when(on, shape[1] - 1 - F.col("c")).otherwise(F.col("r"))).withColumn("c", F.when(on, F.col("r")).otherwise(F.col("c"))).withColumn("r", F.col("_r")).drop("_r")


def augment(images: DataFrame, masks: DataFrame, shape: tuple[int, int], seed: int = 42, epoch: int = 0, u: float | Mapping[str, float] = 0.5, hue=(-30, 30), sat=(-5, 5), val=(-15, 15), hue_wrap: int = 256, border: float = 0.0, **ranges) -> tuple[DataFrame, DataFrame]:
    """The training pipeline: colour, geometry, flips, turn; then normalised images (x) and binary masks (t).

    ``images``: image_id, ch, r, c, b; ``masks``: image_id, r, c, b. Flips and turn are one projection. ``u``: the
    probability of every step, or of each by its name (``STEPS``); ``ranges``: those of ``affine``.
    """
    how, on = {"seed": seed, "epoch": epoch}, chances(u)

    def turn(df: DataFrame) -> DataFrame:
        for name, f in (("hflip", random_hflip), ("vflip", random_vflip), ("rot90", random_rot90)):
            df = f(df, shape, u=on[name], **how)
        return df

    moved = {"border": border, "u": on["ssr"], **how, **ranges}
    x = turn(random_ssr(random_hsv(images, hue, sat, val, on["hsv"], hue_wrap=hue_wrap, **how), shape, by=["ch"], **moved))
    t = turn(random_ssr(masks, shape, **moved))
    return x.select(ID, "ch", "r", "c", pixels.normalise(F.col("b")).alias("x")), t.select(ID, "r", "c", pixels.binarise_mask(F.col("b")).alias("t"))
