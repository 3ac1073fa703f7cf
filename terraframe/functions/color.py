"""Columns for pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def to_linear(c: Column) -> Column:
    """An sRGB channel of 0 to 255 as linear light of 0 to 1."""
    u = c / 255.0
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def from_linear(x: Column) -> Column:
    return F.when(x <= 0.0031308, 255 * 12.92 * x).otherwise(255 * (1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055))


def _byte(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def composite(pixels: Column) -> Column:
    """An array of (r, g, b, a) of 0 to 255, each laid over those before it in linear light, as one (r, g, b, a). Pixels with
    a null channel don't count; nothing is transparent black."""
    complete = F.filter(pixels, lambda p: p["r"].isNotNull() & p["g"].isNotNull() & p["b"].isNotNull() & p["a"].isNotNull())
    none = F.struct(*[F.lit(0.0).alias(c) for c in (*CHANNELS, "a")])

    def over(acc: Column, p: Column) -> Column:
        a = p["a"] / 255.0
        return F.struct(*[(to_linear(p[c]) * a + acc[c] * (1 - a)).alias(c) for c in CHANNELS], (a + acc["a"] * (1 - a)).alias("a"))

    def bytes_of(acc: Column) -> Column:
        plain = lambda c: F.when(acc["a"] > 0, _byte(from_linear(acc[c] / F.nullif(acc["a"], F.lit(0.0))))).otherwise(0).alias(c)
        return F.struct(*[plain(c) for c in CHANNELS], _byte(acc["a"] * 255).alias("a"))

    return F.aggregate(complete, none, over, bytes_of)
