"""Sets of pixels as rows: dilation, erosion and rings, which run on runs of pixels; selections of cells."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .ordering import written

SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel: each row's half-width is round(r * sqrt(1 - dy^2 / r^2))."""
    r = size // 2
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-round(r * sqrt(max(0, 1 - dy * dy / (r * r)))), round(r * sqrt(max(0, 1 - dy * dy / (r * r)))) + 1)] if r else [(0, 0)]


def dilate(px: DataFrame, kernel: list[tuple[int, int]], keys: list[str], width: int, height: int) -> DataFrame:
    """The union of the shifted set, inside the image."""
    return runs.pixels_of(runs.dilate(runs.runs_of(px, keys), kernel, keys, width, height), keys)


def erode(px: DataFrame, kernel: list[tuple[int, int]], keys: list[str], width: int, height: int) -> DataFrame:
    """Pixels whose neighbourhood is all in the set; what is outside the image counts as in it."""
    return runs.pixels_of(runs.erode(written(runs.runs_of(px, keys), "runs"), kernel, keys, width, height), keys)  # read four times


def ring_runs(px: DataFrame, size: int, keys: list[str], width: int, height: int) -> DataFrame:
    own = written(runs.runs_of(px, keys), "runs")
    return runs.subtracted(runs.dilate(own, ellipse(size), keys, width, height), own, keys)


def ring(px: DataFrame, size: int, keys: list[str], width: int, height: int) -> DataFrame:
    """The dilation by an elliptic kernel without the set."""
    return runs.pixels_of(ring_runs(px, size, keys, width, height), keys)


def background_ring(px: DataFrame, image: DataFrame, keys: list[str], width: int, height: int, size: int = 7) -> DataFrame:
    """The median intensity of the ring about the mask; NULL where there is none."""
    around = ring_runs(px, size, keys, width, height)
    got = image.join(around, [*keys, "y"]).where(F.col("x").between(F.col("x0"), F.col("x1"))).groupBy(*keys).agg(F.percentile("intensity", 0.5).alias("background"))
    return px.select(*keys).distinct().join(got, keys, "left")


def selections(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of the union, the intersection and the differences of two selections of cells."""
    both = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    a_, b_ = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(F.count("*").alias("union_n"), n(a_ & b_).alias("both_n"), n(a_ & ~b_).alias("only_a"), n(~a_ & b_).alias("only_b"))
