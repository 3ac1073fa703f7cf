"""Labels of a map: their lines' lengths and anchors, one label for each line name, their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of labels that stand once for each text.
LINES = ("road", "water")
POINT = "struct<x:double,y:double>"


def _steps(line: Column) -> Column:
    """The segments of an array of points (x, y), with their planar lengths."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    step = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("d"))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), step)


def line_length(line: Column) -> Column:
    return F.aggregate(_steps(line), F.lit(0.0), lambda acc, s: acc + s["d"])


def line_midpoint(line: Column) -> Column:
    """The point half way along a line of POINTs; null for an empty one."""
    nowhere = F.lit(None).cast(POINT)
    state = lambda left, at: F.struct(left.alias("left"), at.alias("at"))

    def step(acc: Column, s: Column) -> Column:
        part = F.when(s["d"] == 0, F.lit(0.0)).otherwise(acc["left"] / s["d"])
        here = F.struct((s["ax"] + (s["bx"] - s["ax"]) * part).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * part).alias("y"))
        return F.when(acc["at"].isNotNull(), acc).when(acc["left"] <= s["d"], state(acc["left"], here)).otherwise(state(acc["left"] - s["d"], nowhere))

    return F.aggregate(_steps(line), state(line_length(line) / 2, nowhere), step, lambda acc: F.coalesce(acc["at"], F.get(line, F.size(line) - 1)))


def best_lines(candidates: DataFrame) -> DataFrame:
    """Candidates (kind, text, priority, length, key, ...), of roads and waters one for each kind and text in lower case: that
    with the highest priority, then the greatest length, then the least key."""
    rank = F.struct((-F.col("priority")).alias("p"), (-F.col("length")).alias("l"), F.col("key").alias("k"))
    line = F.col("kind").isin(*LINES)
    best = candidates.where(line).groupBy("kind", F.lower("text").alias("_text")).agg(F.min_by(F.struct(*candidates.columns), rank).alias("_best"))
    return candidates.where(F.coalesce(~line, F.lit(True))).unionByName(best.select("_best.*"))


def in_order(candidates: DataFrame) -> DataFrame:
    """Candidates in the order in which they are placed: by priority and length, greatest first, then by key."""
    return candidates.orderBy(F.desc("priority"), F.desc("length"), "key")
