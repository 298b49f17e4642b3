"""Filters, predicates and ordering of cells, regions, components and polygons."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.geometry import crosses_itself
from .ordering import placed


def filter_label(df: DataFrame, label: str | None, mode: str = "bulk", column: str = "manual_label") -> DataFrame:
    """bulk: N/A also matches 1000, not NULL. phenotype: N/A matches all that mean none. exact: equality, and blank is an error."""
    text, wanted = F.col(column).cast("string"), (label or "").strip()
    if mode == "exact":
        if not wanted:
            raise ValueError("a label is needed")
        return df.where(text == wanted)
    if not wanted or wanted.lower() == "all":
        return df
    if wanted.upper() != "N/A":
        return df.where(text == wanted)
    if mode == "bulk":
        return df.where(text.isin("N/A", "1000"))
    if mode == "phenotype":
        return df.where(text.isNull() | text.isin("N/A", "1000", ""))
    raise ValueError(mode)


def require_channel(df: DataFrame, channel: str, fluorescence_only: bool = False) -> DataFrame:
    """Rows of a known channel that have an image, a contour and an id."""
    if channel not in S.CHANNELS or (fluorescence_only and channel == "ph"):
        raise ValueError(f"unknown channel {channel}")
    return df.where((F.col("channel") == channel) & F.col("pixels").isNotNull() & F.col("contour").isNotNull() & F.col("cell_id").isNotNull())


def cell_areas(df: DataFrame, label: str | None = None) -> DataFrame:
    return filter_label(df, label).where("area > 0").select("dbname", "cell_id", "area")


def filter_candidates(regions: DataFrame, low: float = 400, high: float = 1700) -> DataFrame:
    """Regions of enough area (px_um decides), with a moment, and a centre strictly inside the square."""
    return regions.where((F.col("area") >= S.min_contour_area(F.col("px_um"))) & (F.col("m00") != 0)).where((F.col("cx") > low) & (F.col("cx") < high) & (F.col("cy") > low) & (F.col("cy") < high))


def centred_in_crop(crops: DataFrame, size: int = 200, within: float = 3) -> DataFrame:
    """Regions found again in their crop: area and moment as before, and a centre (x, y in the crop) less than 3 px from the crop's."""
    near = lambda c: F.abs(F.col(c) - size / 2) < within
    return crops.where((F.col("area") >= S.min_contour_area(F.col("px_um"))) & (F.col("m00") != 0) & near("crop_cx") & near("crop_cy"))


def screen_contours(df: DataFrame) -> DataFrame:
    """Label 1 where the smaller variance is at most 120 and hull over perimeter above 0.85."""
    convexity = F.try_divide(F.col("hull_perimeter"), F.col("perimeter"))
    return df.withColumn("label", F.when((F.col("lambda2") <= 120) & (convexity > 0.85), F.lit("1")).otherwise(F.lit("N/A")))


class TrapRules(NamedTuple):
    """What a component in a trap must be to count as a cell, and how far that is relaxed where the last frame's cells support it."""

    side_margin: int = 6
    min_area: float = 80
    max_area: float = 1800
    min_minor: float = 5
    max_minor: float = 36
    min_major: float = 14
    max_major: float = 115
    min_elongation: float = 1.25
    max_elongation: float = 8
    max_mean: float = 145
    max_least: float = 255
    min_contrast: float = 8
    min_right_edge: float = 0
    min_contained: float = 0
    exclude_top: bool = False
    exclude_bottom: bool = False
    exclude_bottom_rois: tuple[int, ...] = ()
    bottom_margin: int = 0
    recovery: bool = False
    radius: int = 8
    min_overlap: float = 0.12
    scale: float = 1.6
    mean_margin: float = 40
    contrast_scale: float = 0.5


def trap_place_ok(r: TrapRules) -> Column:
    """Rules of place, which are never relaxed. Columns: roi, area, full_area (of the whole component), top, left, box_height, box_width (in the trap's core), trap_height, trap_width."""
    margin = F.least(F.lit(r.side_margin), F.greatest(F.floor((F.col("trap_width") - 1) / 2), F.lit(0)))
    bottom = F.col("top") + F.col("box_height")
    ok = (F.col("area") > 0) & (F.col("area") / F.col("full_area") >= r.min_contained) & ((margin + F.col("left") + F.col("box_width")) / F.col("trap_width") >= r.min_right_edge)
    if r.exclude_top:
        ok = ok & (F.col("top") != 0)
    if r.exclude_bottom:
        ok = ok & (bottom != F.col("trap_height"))
    if r.exclude_bottom_rois:
        ok = ok & ~(F.col("roi").isin(*r.exclude_bottom_rois) & (bottom >= F.col("trap_height") - r.bottom_margin))
    return ok


def trap_cell_ok(r: TrapRules, relaxed: bool = False) -> Column:
    """Rules of size, shape and intensity, strict or relaxed. Columns: area, minor, major, mean, least, contrast (NULL without a ring)."""
    k = r.scale if relaxed else 1.0
    elongation = F.col("major") / F.greatest(F.col("minor"), F.lit(1.0))
    within = lambda c, low, high: (c >= low / k) & (c <= high * k)
    shape = within(F.col("area"), r.min_area, r.max_area) & within(F.col("minor"), r.min_minor, r.max_minor) & within(F.col("major"), r.min_major, r.max_major)
    low = max(1.0, r.min_elongation / k) if relaxed else r.min_elongation
    light = (F.col("mean") < r.max_mean + (r.mean_margin if relaxed else 0)) & (F.col("least") < r.max_least)
    dark = F.coalesce(F.col("contrast") >= r.min_contrast * (r.contrast_scale if relaxed else 1), F.lit(False))
    return shape & (elongation >= low) & (elongation <= r.max_elongation * k) & light & dark


def trap_verdict(r: TrapRules, overlap: Column) -> Column:
    """'strict', 'recovered' (the relaxed rules, where enough of the component lies on the last frame's cells) or NULL."""
    out = F.when(trap_place_ok(r) & trap_cell_ok(r), F.lit("strict"))
    return out.when(trap_place_ok(r) & trap_cell_ok(r, True) & (overlap >= r.min_overlap), F.lit("recovered")) if r.recovery else out


ROUTES = [
    ("single", 0, "ph"), ("dual", 0, "ph"), ("dual", 1, "fluo1"), ("dual_reversed", 0, "fluo1"), ("dual_reversed", 1, "ph"),
    ("triple", 0, "ph"), ("triple", 1, "fluo1"), ("triple", 2, "fluo2"), ("quad", 0, "ph"), ("quad", 1, "fluo1"), ("quad", 2, "fluo2"),
]


def route_layers(df: DataFrame) -> DataFrame:
    """layer from (mode, channel_index); channels without a route drop out. The table of routes is eleven rows."""
    routes = df.sparkSession.createDataFrame(ROUTES, "mode string, channel_index int, layer string")
    return df.join(F.broadcast(routes), ["mode", "channel_index"])


def validate_fluorescence(px: DataFrame, keys: list[str]) -> DataFrame:
    """Per image: why it is rejected (or NULL), and the bit depth that it needs."""
    v = F.col("intensity")
    out = px.groupBy(*keys).agg(F.max((F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull()).cast("int")).alias("odd"), F.min(v).alias("low"), F.max(F.rint(v)).alias("high"))
    reason = F.when(F.col("odd") == 1, "non-finite").when(F.col("low") < 0, "negative").when(F.col("high") > 65535, "over 65535")
    return out.select(*keys, reason.alias("reason"), F.when(reason.isNull(), F.when(F.col("high") <= 255, 8).otherwise(16)).alias("bits"))


def validate_polygons(df: DataFrame, width: int, height: int) -> DataFrame:
    """reason (or NULL) for each polygon (points: array of x, y structs): points, range, crossing, area (of the points rounded to whole pixels)."""

    @F.pandas_udf("boolean")
    def crossing(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([crosses_itself(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys)], dtype=bool)

    axis = lambda c: F.transform("points", lambda p: p[c].cast("double"))
    bad = lambda v, top: F.exists(v, lambda a: a.isNull() | F.isnan(a) | (a < 0) | (a >= top))
    xs, ys = axis("x"), axis("y")
    n = F.size("points")
    outside = bad(xs, width) | bad(ys, height)
    fair = df.withColumn("_why", F.when(F.col("points").isNull() | (n < 3), "fewer than three points").when(outside, "outside"))
    # Only polygons that are fair so far go to Python; the others are a point each.
    some = lambda v: F.when(F.col("_why").isNull(), v).otherwise(F.array(F.lit(0.0)))
    rounded = lambda v: F.transform(v, lambda a: F.rint(a))
    turned = lambda v: F.concat(F.slice(v, 2, n - 1), F.slice(v, 1, 1))
    terms = F.zip_with(F.zip_with(rounded(xs), turned(rounded(ys)), lambda a, b: a * b), F.zip_with(turned(rounded(xs)), rounded(ys), lambda a, b: a * b), lambda a, b: a - b)
    area = F.abs(F.aggregate(terms, F.lit(0.0), lambda s, e: s + e)) / 2
    reason = F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("_crossed"), "self-intersection").when(area < 1, "area")
    return fair.withColumn("_crossed", crossing(some(xs), some(ys))).withColumn("reason", reason).drop("_why", "_crossed")


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per database the points where both metrics are there, and how many rows lack one."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.groupBy("dbname").agg(F.count(F.when(both, 1)).alias("points"), F.count(F.when(~both, 1)).alias("missing"), F.avg(F.when(both, F.col(x))).alias("mean_x"), F.avg(F.when(both, F.col(y))).alias("mean_y"))


def box_select(df: DataFrame, x: str, y: str, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def search_names(df: DataFrame, text: str, column: str = "dbname") -> DataFrame:
    return df.where(F.contains(F.lower(column), F.lit(text.lower())))


def sort_keys(cell_id: Column) -> list[Column]:
    """Natural order by frame and index; other ids last, by text."""
    frame = S.frame_of(cell_id)
    return [frame.isNull().asc(), frame.asc(), S.index_of(cell_id).asc(), cell_id.asc()]


def label_keys(label: Column) -> list[Column]:
    """N/A first, then numbers, then texts."""
    number = label.try_cast("double")
    return [F.when(label == "N/A", 0).when(number.isNotNull(), 1).otherwise(2).asc(), number.asc(), label.asc()]


def page(df: DataFrame, size: int, number: int, keys: list[str]) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows within each database, in natural order."""
    rows = placed(df, ["dbname"], [*sort_keys(F.col("cell_id")), *keys], place="row", total="of").drop("of")
    return rows.where(F.col("row").between((number - 1) * size + 1, number * size)).withColumn("row", F.col("row").cast("int"))


def padded_domain(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A plot's range: 6 % beyond the values, or about a single one; [0, 1] without any."""
    low, high = F.min(value), F.max(value)
    pad = F.when(high > low, 0.06 * (high - low)).otherwise(F.greatest(0.06 * F.abs(low), F.lit(0.01)))
    return df.groupBy(*by).agg(F.coalesce(low - pad, F.lit(0.0)).alias("low"), F.coalesce(high + pad, F.lit(1.0)).alias("high"))


def composite(px: DataFrame, first: str, second: str, inside: DataFrame | None = None) -> DataFrame:
    """The greater of two channels at each pixel, each min-max scaled to 0..255 over the whole image, or over the pixels ``inside`` a contour, which are then all there is."""
    if inside is not None:
        px = px.join(inside.select("dbname", "cell_id", "x", "y").distinct(), ["dbname", "cell_id", "x", "y"], "left_semi")
    wide = px.where(F.col("channel").isin(first, second)).groupBy("dbname", "cell_id", "x", "y").agg(*(F.max(F.when(F.col("channel") == c, F.col("intensity"))).alias(n) for c, n in ((first, "a"), (second, "b"))))
    cell = Window.partitionBy("dbname", "cell_id")
    scaled = lambda c: F.floor(F.try_divide(F.col(c) - F.min(c).over(cell), F.max(c).over(cell) - F.min(c).over(cell)) * 255)
    return wide.select("dbname", "cell_id", "x", "y", F.greatest(scaled("a"), scaled("b")).cast("long").alias("v")).where("v is not null")


def densify(df: DataFrame, step: float = 1.0) -> DataFrame:
    """contour (array of x, y structs) with points about every ``step`` along its closed outline."""
    ring = "transform(sequence(0, size(contour) - 1), i -> struct(contour[i] as a, contour[(i + 1) % size(contour)] as b))"
    dense = f"flatten(transform({ring}, s -> transform(sequence(0, int(greatest(round(sqrt(pow(s.b.x - s.a.x, 2) + pow(s.b.y - s.a.y, 2)) / {step}), 1)) - 1), k -> struct(s.a.x + (s.b.x - s.a.x) * k / greatest(round(sqrt(pow(s.b.x - s.a.x, 2) + pow(s.b.y - s.a.y, 2)) / {step}), 1) as x, s.a.y + (s.b.y - s.a.y) * k / greatest(round(sqrt(pow(s.b.x - s.a.x, 2) + pow(s.b.y - s.a.y, 2)) / {step}), 1) as y))))"
    return df.withColumn("contour", F.when(F.size("contour") > 0, F.expr(dense)).otherwise(F.col("contour")))


def contour_of_json(text: Column) -> Column:
    """[[x, y], ..] as an array of x, y structs; NULL where the text isn't that."""
    return F.transform(F.from_json(text, "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def json_of_contour(contour: Column) -> Column:
    return F.to_json(F.transform(contour, lambda p: F.array(p["x"], p["y"])))


def roi_bands(rois: DataFrame, from_width: int, from_height: int, width: int, height: int) -> DataFrame:
    """Rectangles scaled to an image's size, and the band (equal y0, y1) of each within its view, from the top."""
    scaled = {c: F.round(F.col(c) * (width / from_width if c[0] == "x" else height / from_height)).cast("long") for c in ("x0", "x1", "y0", "y1")}
    out = rois.withColumns(scaled)
    return out.withColumn("band", F.dense_rank().over(Window.partitionBy("view").orderBy("y0", "y1")))
