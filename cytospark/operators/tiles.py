"""Components of frames that are larger than a row: tiles are labelled alone, and labels that touch across tiles are united.

A tile is a row: keys, x0 and y0 (its corner in the frame), height, width, and mask or pixels (row-major). Only pixels on the
tiles' edges meet: each of them with the three that it touches in the next tile. What unites is a graph over the
tiles' labels, so a task holds one tile, and a shuffle holds edges and sums, whatever the frame's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import each_row_arrays
from .graph import components
from .ordering import group_key, merged, removed, spread_join, with_group, written


def cut_frames(frames: DataFrame, keys: list[str], nx: int, ny: int, column: str) -> DataFrame:
    """frames (keys, height, width and a row-major array ``column``) as tiles, whose bounds are i * N div n."""
    span = lambda k, n, size: (f"{k} * {size} div {n}", f"({k} + 1) * {size} div {n}")
    (x0, x1), (y0, y1) = span("tx", nx, "width"), span("ty", ny, "height")
    f = frames.withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    f = f.withColumns({k: F.expr(e).cast("int") for k, e in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))})
    rows = F.expr(f"flatten(transform(sequence(y0, y1 - 1), y -> slice({column}, int(y * width + x0 + 1), int(x1 - x0))))")
    return f.where("x0 < x1 and y0 < y1").select(*keys, "x0", "y0", (F.col("y1") - F.col("y0")).alias("height"), (F.col("x1") - F.col("x0")).alias("width"), rows.alias(column))


def _labelled(tiles: DataFrame, keys: list[str], tag_of, what: str) -> DataFrame:
    """A row for each component of each tile: keys, tile, local, tag, n, sum_x, sum_y, first (y, then x, of its first pixel), its places in the tile, and those of them on its edge."""
    types = dict(tiles.dtypes)

    def make(r: dict) -> tuple | None:
        h, w = int(r["height"]), int(r["width"])
        tag = tag_of(r, h, w)
        if tag is None:
            return None
        c = G.components(tag)
        y, x = np.nonzero(c)
        if not len(x):
            return None
        own = c[y, x]
        order = np.argsort(own, kind="stable")
        x, y, own = x[order].astype(np.int64), y[order].astype(np.int64), own[order]
        first = np.flatnonzero(np.diff(own, prepend=0))
        n = np.diff(np.append(first, len(own)))
        edge = (x == 0) | (y == 0) | (x == w - 1) | (y == h - 1)
        lists = lambda v, keep: _lists([v[a : a + k][keep[a : a + k]] for a, k in zip(first.tolist(), n.tolist())])
        total = lambda v: np.add.reduceat(v, first)
        every = np.ones(len(x), bool)
        return *(r[k] for k in keys), int(r["x0"]), int(r["y0"]), own[first].astype(np.int32), np.asarray(tag, np.int64)[y[first], x[first]], n, total(x + int(r["x0"])), total(y + int(r["y0"])), y[first] + int(r["y0"]), x[first] + int(r["x0"]), lists(x + int(r["x0"]), every), lists(y + int(r["y0"]), every), lists(x + int(r["x0"]), edge), lists(y + int(r["y0"]), edge)

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", tile_x int, tile_y int, local int, tag long, n long, sum_x long, sum_y long, first_y long, first_x long, xs array<long>, ys array<long>, edge_xs array<long>, edge_ys array<long>"
    found = each_row_arrays(tiles, make, schema)
    return written(found.withColumn("label", F.monotonically_increasing_id()), what)


def _lists(parts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(parts), object)
    out[:] = parts
    return out


def _united(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """label and root of the tiles' labels that touch across an edge: pixels of one tag, side by side or corner to corner."""
    edge = labelled.select(*keys, "tile_x", "tile_y", "tag", "label", F.explode(F.arrays_zip("edge_xs", "edge_ys")).alias("p"))
    edge = edge.select(group_key(keys).alias("g"), "tile_x", "tile_y", "tag", "label", F.col("p.edge_xs").alias("x"), F.col("p.edge_ys").alias("y"))
    # Half of the eight neighbours: each pair of pixels meets once.
    near = edge.withColumn("o", F.explode(F.expr("array(struct(1 as i, 0 as j), struct(-1 as i, 1 as j), struct(0 as i, 1 as j), struct(1 as i, 1 as j))")))
    near = near.select("g", "tag", F.col("label").alias("a"), F.col("tile_x").alias("tx"), F.col("tile_y").alias("ty"), (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    pairs = near.join(merged(edge), ["g", "tag", "x", "y"]).where("tile_x <> tx or tile_y <> ty").select("a", F.col("label").alias("b"))
    return components(pairs.where("a <> b").distinct())


def tiled_components(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """tiles (with mask: labels, 0 outside): keys, x, y in the frame, and the component of each pixel, numbered by its first pixel in reading order."""
    labelled = _labelled(tiles, keys, lambda r, h, w: np.asarray(r["mask"]).reshape(h, w), "tile-labels")
    roots = _united(labelled, keys)
    rooted = labelled.select(*keys, "label", "first_y", "first_x").join(merged(roots.withColumnRenamed("node", "label")), "label", "left").withColumn("root", F.coalesce("root", "label"))
    first = rooted.groupBy(*keys, "root").agg(F.min(F.struct("first_y", "first_x")).alias("first"))
    place = first.withColumn("component", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).select("root", "component")
    named = written(spread_join(written(rooted.select("label", "root"), "tile-roots"), merged(place), ["root"], ["label"]).select("label", "component"), "tile-components")
    px = labelled.join(merged(named), "label").select(*keys, "component", F.explode(F.arrays_zip("xs", "ys")).alias("p"))
    return px.select(*keys, F.col("p.xs").cast("int").alias("x"), F.col("p.ys").cast("int").alias("y"), F.col("component").cast("int").alias("component"))


def segment_tiles(tiles: DataFrame, keys: list[str], param1: int = 130) -> DataFrame:
    """tiles (with pixels): regions darker than ``param1`` of the frame's own 8-bit range, as `segment_frames` gives them for whole frames: keys, component, area, cx, cy."""
    v = F.transform("pixels", lambda p: p.cast("double"))
    span = tiles.select(*keys, F.array_min(v).alias("low"), F.array_max(v).alias("high")).groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def dark(r: dict, h: int, w: int) -> np.ndarray | None:
        if not r["low"] < r["high"]:  # NaN where a frame has no span
            return None
        img = np.asarray(r["pixels"], float).reshape(h, w)
        return np.floor((img - r["low"]) / (r["high"] - r["low"]) * 255) < param1

    labelled = _labelled(with_group(tiles, span.where("low < high"), keys, "left"), keys, dark, "tile-regions")
    roots = _united(labelled, keys)
    rooted = labelled.drop("xs", "ys", "edge_xs", "edge_ys").join(merged(roots.withColumnRenamed("node", "label")), "label", "left").withColumn("root", F.coalesce("root", "label"))
    sums = rooted.groupBy(*keys, "root").agg(F.sum("n").alias("n"), F.sum("sum_x").alias("sum_x"), F.sum("sum_y").alias("sum_y"), F.min(F.struct("first_y", "first_x")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))  # a frame's regions
    out = written(sums.select(*keys, place.cast("int").alias("component"), F.col("n").cast("int").alias("area"), (F.col("sum_x") / F.col("n")).alias("cx"), (F.col("sum_y") / F.col("n")).alias("cy")), "tile-sums")
    removed(labelled, roots)
    return out
