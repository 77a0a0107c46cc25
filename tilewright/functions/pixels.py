"""Column functions on pixel values, masks, probabilities and file names. Bytes are held as integers 0-255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(b: Column) -> Column:
    """Bytes to the model's range, -1.6 to 1.6."""
    return b / F.lit(255.0) * F.lit(3.2) - F.lit(1.6)


def binarise_mask(b: Column, invert: bool = False) -> Column:
    """Mask byte to 1 from one half up, else 0; decided on the byte, without a division."""
    t = (b >= F.lit(128)).cast("int")
    return 1 - t if invert else t


def binarise_pred(q: Column, t: float = 0.5) -> Column:
    """Probability to 1 strictly above ``t``."""
    return F.when(q > F.lit(t), 1).otherwise(0)


def tta_threshold(total: Column, t: float = 4.0) -> Column:
    """Sum of the eight views to a mask byte: 255 strictly above ``t``."""
    return F.when(total > F.lit(t), 255).otherwise(0)


def luma(b: Column, g: Column, r: Column) -> Column:
    """Grey of a colour, half up."""
    return F.floor(F.lit(0.114) * b + F.lit(0.587) * g + F.lit(0.299) * r + F.lit(0.5)).cast("int")


def wrap_add(x: Column, d: Column, period: int = 256) -> Column:
    return F.pmod(x + d, F.lit(period))


def saturating_add(x: Column, d: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + d + F.lit(0.5)).cast("int")))


def hsv(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """8-bit hue (0-179), saturation and value of a colour; rounding half up."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = v - low
    degrees = (
        F.when(d == 0, 0.0)
        .when(v == r, F.lit(60.0) * (g - b) / F.greatest(d, F.lit(1)))
        .when(v == g, F.lit(120.0) + F.lit(60.0) * (b - r) / F.greatest(d, F.lit(1)))
        .otherwise(F.lit(240.0) + F.lit(60.0) * (r - g) / F.greatest(d, F.lit(1)))
    )
    degrees = F.when(degrees < 0, degrees + 360.0).otherwise(degrees)
    return {
        "h": F.pmod(F.floor(degrees / 2 + 0.5), F.lit(180)).cast("int"),
        "s": F.when(v == 0, 0).otherwise(F.floor(F.lit(255.0) * d / F.greatest(v, F.lit(1)) + 0.5)).cast("int"),
        "v": v,
    }


def bgr(h: Column, s: Column, v: Column) -> dict[str, Column]:
    """Colour of an 8-bit hue (two degrees a step, any byte), saturation and value; rounding half up."""
    at = h / F.lit(30.0)
    sector, f, sat = F.pmod(F.floor(at), F.lit(6)), at - F.floor(at), s / F.lit(255.0)
    p, q, t = v * (1 - sat), v * (1 - sat * f), v * (1 - sat * (1 - f))

    def pick(*by_sector: Column) -> Column:
        out = F.when(sector == 0, by_sector[0])
        for i in range(1, 6):
            out = out.when(sector == i, by_sector[i])
        return F.floor(out + F.lit(0.5)).cast("int")

    v = v.cast("double")
    return {"b": pick(p, p, t, v, v, q), "g": pick(t, v, v, q, p, p), "r": pick(v, q, p, p, t, v)}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def is_image_name(name: Column) -> Column:
    return name.contains("sat")


def image_id(path: Column) -> Column:
    """``.../X_sat.jpg`` to ``X``."""
    return F.regexp_extract(path, r"([^/]+)_sat\.[a-z]+$", 1)


def mask_id(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)_mask\.[a-z]+$", 1)


def image_name(image_id: Column) -> Column:
    return F.format_string("%s_sat.jpg", image_id.cast("string"))


def mask_name(name: Column) -> Column:
    """``X_sat.jpg`` to ``X_mask.png``: the last seven characters are replaced."""
    return F.concat(F.substring(name, F.lit(1), F.length(name) - 7), F.lit("mask.png"))


def as_float(x: Column) -> Column:
    """A number in single precision."""
    return x.cast("float")


def as_byte(x: Column) -> Column:
    """A number as an unsigned byte: cut towards zero, then modulo 256 (not saturating; see ``saturating_add``). Null, NaN and
    infinite stay null."""
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    return F.when(~F.isnan(x.cast("double")) & (F.abs(x) < F.lit(2.0**53)), F.pmod(whole, F.lit(256))).cast("int")


def round_half_away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))


def rotation(degrees: Column) -> tuple[Column, Column]:
    """Cosine and sine of an angle in degrees."""
    angle = F.radians(degrees)
    return F.cos(angle), F.sin(angle)


def without_end(text: Column, n: int) -> Column:
    """A text without its last ``n`` characters; empty where it has no more."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(0), F.char_length(text) - n))


def loss_line(loss: Column, epoch: Column) -> Column:
    """A loss with six and with two places, and an epoch, as logs print them."""
    return F.format_string("%f %.2f %d", loss, loss, epoch)
