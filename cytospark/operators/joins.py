"""Joins: ranges, tiles, crops, overlaps between frames, label edits, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs
from .ordering import written
from .pixel_sets import ellipse


def assign_frame_splits(frames: DataFrame, splits: DataFrame, frame_count: int) -> DataFrame:
    """frames by split: ranges (name, start, end) cut to the frames there are; a frame in two ranges is in both; repeated names get a suffix; without a valid range, one split ``all``."""
    s = splits.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", F.lit(frame_count - 1))}).where("start <= end")
    again = F.row_number().over(Window.partitionBy("name").orderBy("start", "end"))
    s = s.withColumn("again", again).select(F.when(F.col("again") > 1, F.concat("name", F.lit("_"), F.col("again").cast("string"))).otherwise(F.col("name")).alias("split"), "start", "end")
    if s.isEmpty():
        return frames.withColumn("split", F.lit("all"))
    # Each range spreads over its own frames: an equi-join, whatever the number of ranges.
    at = s.select("split", F.explode(F.sequence("start", "end")).alias("frame"))
    return frames.join(at, "frame")


def pixels_in_rois(pixels: DataFrame, rois: DataFrame, drift: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels (view, frame, x, y) inside the view's rectangles (ends exclusive), which follow the frame's drift and are cut to the image."""
    moved = rois.join(drift, "view").select(
        "view", "frame", "roi", F.greatest(F.col("x0") + F.col("dx"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("dx"), F.lit(width)).alias("x1"),
        F.greatest(F.col("y0") + F.col("dy"), F.lit(0)).alias("y0"), F.least(F.col("y1") + F.col("dy"), F.lit(height)).alias("y1"),
    )
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return pixels.join(moved, ["view", "frame"]).where(inside).drop("x0", "x1", "y0", "y1")


def tile_counts(width: int, height: int, mode: str = "manual", nx: int = 1, ny: int = 1, candidates: tuple = (), camera: tuple = ()) -> tuple[int, int]:
    """How many tiles across and down.

    none: one. manual: as given, at least one, and at most a pixel each. auto: the best of the file's candidates (across,
    down, whether they are of its own layout, whether that is marked valid): tiles of a camera's shape (width, height)
    count most, then many tiles, its own layout, an even grid, a valid mark; those that are neither of a camera's shape
    nor valid don't count, and without any there is one tile. The first wins ties.
    """
    if mode == "none":
        return 1, 1
    if mode == "manual":
        if not (1 <= nx <= width and 1 <= ny <= height):
            raise ValueError("tiles are at least one, and at least a pixel wide and high")
        return nx, ny
    if mode != "auto":
        raise ValueError(f"unknown mode {mode}")
    best, most = (1, 1), 0
    for across, down, own, valid in candidates:
        if not (1 <= across <= width and 1 <= down <= height):
            continue
        even = width % across == 0 and height % down == 0
        shot = even and (width // across, height // down) in camera
        score = across * down + (1000 if shot else 50 * even) + 100 * own + 10 * valid
        if (shot or valid) and score > most:
            best, most = (across, down), score
    return best


def tile_frames(pixels: DataFrame, width: int, height: int, nx: int = 1, ny: int = 1, mode: str = "manual", **layout) -> DataFrame:
    """Tiles (as many as `tile_counts` says) with bounds i * N div n become frames, row by row; x and y count from the tile's corner."""
    nx, ny = tile_counts(width, height, mode, nx, ny, **layout)
    # The tile of x is the last whose start is at most x; starts are whole, so it has a closed form.
    tx = F.expr(f"((x + 1) * {nx} - 1) div {width}")
    ty = F.expr(f"((y + 1) * {ny} - 1) div {height}")
    out = pixels.withColumns({"tx": tx, "ty": ty})
    return out.select((F.col("frame") * nx * ny + F.col("ty") * nx + F.col("tx")).alias("frame"), (F.col("x") - F.expr(f"tx * {width} div {nx}")).alias("x"), (F.col("y") - F.expr(f"ty * {height} div {ny}")).alias("y"), *(c for c in pixels.columns if c not in ("frame", "x", "y")))


def crop_windows(pixels: DataFrame, centers: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Pixels in the square of ``size`` about each centre of their frame; squares over the edge drop out.

    Both sides carry the grid cells (of ``size``) that a square touches, so the join is an equi-join.
    """
    half = size // 2
    c = centers.withColumns({"x0": (F.floor("cx") - half).cast("long"), "y0": (F.floor("cy") - half).cast("long")})
    c = c.where((F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") + size <= width) & (F.col("y0") + size <= height))
    cells = lambda v: F.sequence(F.floor(F.col(v) / size), F.floor((F.col(v) + size - 1) / size))
    c = c.withColumn("gx", F.explode(cells("x0"))).withColumn("gy", F.explode(cells("y0")))
    p = pixels.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    hit = p.join(c.select("frame", "center_id", "x0", "y0", "gx", "gy"), ["frame", "gx", "gy"]).where(F.col("x").between(F.col("x0"), F.col("x0") + size - 1) & F.col("y").between(F.col("y0"), F.col("y0") + size - 1))
    return hit.select("frame", "center_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), *(k for k in pixels.columns if k not in ("frame", "x", "y")))


def pair_review_images(raw: DataFrame, overlay: DataFrame) -> DataFrame:
    return raw.join(overlay, ["view", "roi", "frame"])


def drift_steps(drift: DataFrame) -> DataFrame:
    """drift (view, frame, dx, dy: against frame 0) as the step from the frame before: view, frame, dx, dy."""
    before = drift.select("view", (F.col("frame") + 1).alias("frame"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
    return drift.join(before, ["view", "frame"]).select("view", "frame", (F.col("dx") - F.col("bx")).alias("dx"), (F.col("dy") - F.col("by")).alias("dy"))


def temporal_overlap(current: DataFrame, previous: DataFrame, radius: int = 0, drift: DataFrame | None = None) -> DataFrame:
    """Per component of current (view, frame, label, x, y): the share of its pixels on the last frame's labels, and which of these it lies on.

    The last frame is shifted by the drift's step (0 without one) and its labels are dilated by a disk. parents
    are the labels that cover max(8, round(2 %)) of the component's area or more, in order. Both frames' labels are runs of pixels.
    """
    keys = ["view", "frame", "label"]
    before = runs.runs_of(previous.select("view", (F.col("frame") + 1).alias("frame"), "x", "y", F.col("label").alias("before")), ["view", "frame", "before"])
    if drift is not None:
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
        dx, dy = zero("dx"), zero("dy")
        before = before.join(drift_steps(drift), ["view", "frame"], "left").select("view", "frame", "before", (F.col("y") + dy).alias("y"), (F.col("x0") + dx).alias("x0"), (F.col("x1") + dx).alias("x1"))
    before = runs.dilate(before, ellipse(2 * radius + 1), ["view", "frame", "before"])
    named = lambda df: df.withColumnsRenamed({"x0": "b0", "x1": "b1"})
    own = runs.runs_of(current, keys)
    area = own.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"))
    support = runs.merged(before.drop("before"), ["view", "frame"])
    covered = runs.overlaps(own, named(support), ["view", "frame"]).groupBy(*keys).agg(F.sum("common").alias("covered"))
    each = runs.overlaps(own, named(before), ["view", "frame"]).groupBy(*keys, "before").agg(F.sum("common").alias("n"))
    each = each.join(area, keys).where(F.col("n") >= F.greatest(F.lit(8), F.rint(F.col("area") * 0.02)))
    lists = each.groupBy(*keys).agg(F.sort_array(F.collect_list("before")).alias("parents"))
    none = F.expr("cast(array() as array<bigint>)")
    return area.join(covered, keys, "left").join(lists, keys, "left").select(*keys, "area", (F.coalesce("covered", F.lit(0)) / F.col("area")).alias("overlap"), F.coalesce(F.col("parents").cast("array<bigint>"), none).alias("parents"))


def annotation_overlaps(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels that two instances of a frame cover."""
    return px.groupBy(*keys, "x", "y").agg(F.count_distinct("instance_id").alias("instances")).where("instances > 1")


def apply_label_updates(cells: DataFrame, updates: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """cells with the new labels (digits become whole-number text), and the updates whose cell isn't there. A blank label is an error.

    Of several edits of one cell the last one wins, by ``order`` (columns of updates) and then by label, so that each cell stays one row.
    """
    if not updates.where("new_label is null or trim(new_label) = ''").isEmpty():
        raise ValueError("a label is blank")
    keys, t = ["dbname", "cell_id"], F.trim("new_label")
    text = F.when(t.rlike(r"^\d+$"), F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(t)
    u = updates.select(*keys, *(order or []), text.alias("new_label"))
    u = u.groupBy(*keys).agg(F.max_by("new_label", F.struct(*(order or []), "new_label")).alias("new_label"))
    return cells.join(u, keys, "left").withColumn("manual_label", F.coalesce("new_label", "manual_label")).drop("new_label"), u.join(cells.select(*keys), keys, "left_anti")


def compare_by_key(a: DataFrame, b: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One id in two databases is two cells: rows of both by their whole key, and where each is found."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    return j.withColumn("found", F.when(F.col("b").isNull(), "a").when(F.col("a").isNull(), "b").otherwise("both"))


def broadcast_threshold(df: DataFrame, control: DataFrame, value: str) -> DataFrame:
    """value against the one threshold of control."""
    return df.crossJoin(F.broadcast(control)).withColumn("below", F.col(value) < F.col("threshold"))


#: Pivots of a nearest-neighbour join, sites that their cells lie on, rows of a block of a site or of the queries that meet it, and distances to pivots that a task holds at once.
MOST_PIVOTS, SITES, BLOCK, MOST_HELD = 1024, 64, 8192, 1 << 18


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of a to each of b, by differences, so an exact match has 0."""
    out, step = np.empty((len(a), len(b))), max(1, 4_000_000 // max(1, b.size))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = np.sqrt(((a[lo : lo + step, None, :] - b[None, :, :]) ** 2).sum(2))
    return out


def _matrix(features: pd.Series) -> np.ndarray:
    return np.stack(features.to_numpy()).astype(float)


def pivots_of(train: DataFrame, most: int = MOST_PIVOTS) -> np.ndarray:
    """Features of about the root of the number of training rows, ``most`` at most, chosen by a hash of their ids."""
    n = train.count()
    some = train.orderBy(F.xxhash64("train_id"), "train_id").limit(min(most, max(1, round(n**0.5)))).toPandas() if n else None
    return _matrix(some["features"]) if n else np.zeros((0, 0))


def _steps(pdfs: Iterator[pd.DataFrame], pivots: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of batches and their distances to the pivots, so few at a time that MOST_HELD distances or values are held, however large a batch is."""
    step = max(1, MOST_HELD // max(pivots.shape))
    for pdf in pdfs:
        for lo in range(0, len(pdf), step):
            part = pdf.iloc[lo : lo + step]
            yield part, _apart(_matrix(part["features"]), pivots)


def cells_of(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """train with its nearest pivot (cell) and the distance to it (off)."""

    def run(pdfs):
        for part, d in _steps(pdfs, pivots):
            cell = d.argmin(1)
            yield pd.DataFrame({"train_id": part["train_id"], "features": part["features"], "cell": cell.astype(np.int32), "off": d[np.arange(len(d)), cell]})

    return train.select("train_id", F.col("features").cast("array<double>")).mapInPandas(run, "train_id long, features array<double>, cell int, off double")


def sites_of(size: np.ndarray) -> np.ndarray:
    """The site of each cell: SITES at most, of about the same number of rows. A query goes once to each site that it visits, whatever the number of cells."""
    site, held = np.zeros(len(size), np.int64), np.zeros(min(SITES, len(size)), np.int64)
    for cell in np.argsort(-size, kind="stable").tolist():
        site[cell] = held.argmin()
        held[site[cell]] += size[cell]
    return site


def _visited(query: DataFrame, pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, k: int, home: bool) -> DataFrame:
    """A row for each site that a query (query_id, features, reach: its k-th distance so far) goes to, with the cells that it visits there and how far (away) their pivots are.

    home: the nearest cells that together hold k rows. Otherwise all others that may hold a row within the query's reach:
    no row of a cell is nearer than the pivot's distance less the cell's radius.
    """
    site = sites_of(size)
    dealt = [np.flatnonzero(site == s) for s in range(site.max() + 1)]

    def run(pdfs):
        for part, d in _steps(pdfs, pivots):
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1)
            at_home = np.zeros(d.shape, bool)
            np.put_along_axis(at_home, order, np.concatenate([np.zeros((len(d), 1)), held[:, :-1]], axis=1) < k, axis=1)
            at_home &= size > 0
            reach = part["reach"].to_numpy(float)
            goes = at_home if home else ~at_home & (size > 0) & (d - radius <= reach[:, None] * (1 + 1e-9) + 1e-9)
            for s, cells in enumerate(dealt):
                rows = np.flatnonzero(goes[:, cells].any(1))
                if not len(rows):
                    continue
                there = [cells[goes[q, cells]] for q in rows]
                yield part.iloc[rows].assign(site=np.int32(s), cells=[c.astype(np.int32) for c in there], away=[d[q, c] for q, c in zip(rows, there)])

    return query.select("query_id", "features", "reach").mapInPandas(run, "query_id long, features array<double>, reach double, site int, cells array<int>, away array<double>")


def _met(visits: DataFrame, train: DataFrame, size: np.ndarray, k: int, block: int) -> DataFrame:
    """The k nearest rows that each visit of a site's block finds: query_id, train_id, distance, compared (how many distances the visit took, on one of its rows).

    A site's rows and its queries are cut into blocks; a task has a block of each. A query compares the rows only of the cells
    that it visits, and of these those whose distance to the pivot differs from its own by no more than its reach.
    """
    site = sites_of(size)
    of_query = visits.groupBy("site").agg(F.ceil(F.count("*") / block).cast("int").alias("nq"))  # a row a site
    rows = np.bincount(site, size).astype(int).tolist()
    parts = F.element_at(F.array(*(F.lit(max(1, -(-n // block))) for n in rows)), F.col("site") + 1)
    part = lambda c, n: F.pmod(F.xxhash64(c), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = visits.join(F.broadcast(of_query), "site").withColumn("qb", part("query_id", F.col("nq"))).withColumn("tb", every(parts)).drop("nq")
    t = train.withColumn("site", F.element_at(F.array(*(F.lit(int(s)) for s in site)), F.col("cell") + 1))
    t = t.join(F.broadcast(of_query), "site").withColumn("tb", part("train_id", parts)).withColumn("qb", every(F.col("nq"))).drop("nq")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n = len(a)
        none = np.iinfo(np.int64).max
        near, ids, compared = np.full((n, k), np.inf), np.full((n, k), none), np.zeros(n, np.int64)
        if n and len(b):
            b = b.sort_values(["cell", "off"])
            train_ids, off, x, points = b["train_id"].to_numpy(), b["off"].to_numpy(), _matrix(b["features"]), _matrix(a["features"])
            cell, away = np.concatenate(a["cells"].to_numpy()), np.concatenate(a["away"].to_numpy())
            of = np.repeat(np.arange(n), a["cells"].map(len))
            slack = a["reach"].to_numpy()[of] * (1 + 1e-9) + 1e-9
            first = np.flatnonzero(np.r_[True, np.diff(b["cell"].to_numpy()) != 0])
            for c, lo, hi in zip(b["cell"].to_numpy()[first].tolist(), first.tolist(), [*first[1:].tolist(), len(b)]):
                here = np.flatnonzero(cell == c)
                i, j = (lo + np.searchsorted(off[lo:hi], away[here] + s * slack[here], side=side) for s, side in ((-1, "left"), (1, "right")))
                compared[of[here]] += np.maximum(j - i, 0)
                for one, i, j in zip(of[here].tolist(), i.tolist(), j.tolist()):
                    if i < j:
                        d = np.sqrt(((points[one] - x[i:j]) ** 2).sum(1))
                        at = np.flatnonzero(d <= near[one, -1])
                        if len(at):
                            far, who = np.r_[near[one], d[at]], np.r_[ids[one], train_ids[i:j][at]]
                            best = np.lexsort((who, far))[:k]
                            near[one], ids[one] = far[best], who[best]
        q, place = np.nonzero(np.isfinite(near) | (ids < none))
        return pd.DataFrame({"query_id": a["query_id"].to_numpy()[q], "train_id": ids[q, place], "distance": near[q, place], "compared": np.where(place == 0, compared[q], 0)})

    return q.groupBy("site", "qb", "tb").cogroup(t.groupBy("site", "qb", "tb")).applyInPandas(run, "query_id long, train_id long, distance double, compared long")


def knn_visits(query: DataFrame, train: DataFrame, k: int, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """Rows among which are the k nearest of each query, with ``compared``, whose sum is the number of distances taken.

    Training rows belong to the nearest of a bounded number of pivots. A query meets the cells about it that hold k rows, which
    gives its reach; by the triangle inequality only cells, and rows in them, within that reach can hold a nearer one.
    """
    pivots = pivots_of(train, most_pivots)
    if not len(pivots):
        return query.sparkSession.createDataFrame([], "query_id long, train_id long, distance double, compared long")
    cells = written(cells_of(train, pivots), "cells")
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect():  # a row a pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    q = query.select("query_id", F.col("features").cast("array<double>").alias("features"))
    first = written(_met(_visited(q.withColumn("reach", F.lit(float("inf"))), pivots, size, radius, k, True), cells, size, k, block), "nearest")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "train_id"))  # k rows a block that it met
    reach = first.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("distance").alias("reach"))
    near = q.join(reach, "query_id")  # a query that met fewer than k rows has met all there are
    return first.unionByName(_met(_visited(near, pivots, size, radius, k, False), cells, size, k, block))


def knn_join(query: DataFrame, train: DataFrame, k: int, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, train_id, distance, rank and weight of the k nearest (features: arrays of doubles); the lower train_id wins ties."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "train_id"))
    out = knn_visits(query, train, k, most_pivots, block).drop("compared").withColumn("rank", rank)
    return out.where(F.col("rank") <= k).withColumn("weight", 1 / (F.col("distance") + 1e-6))
