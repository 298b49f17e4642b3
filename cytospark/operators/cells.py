"""Operators on whole cells, frames and profiles: numpy helpers inside Spark's maps, a batch of rows at a time.

A cell is a row with ``contour`` (array of x, y structs), ``height``, ``width`` and ``pixels``
(row-major); its size is bounded by its crop, so rows, not groups, are the unit of work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from . import pixel_sets as P
from .ordering import merged, with_group, written
from .select import TrapRules, centred_in_crop, filter_candidates, filter_label, trap_cell_ok, trap_place_ok

CELL = ["dbname", "cell_id", "channel"]
Rows = Iterator[tuple]


def outline(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float) if points is not None else np.zeros((0, 2))


def each_row(df: DataFrame, make: Callable[[dict], Rows], schema: str, at_a_time: int = 256) -> DataFrame:
    """Rows that ``make`` yields for each row, so many rows at a time; a cell that can't be measured yields what ``make`` says for it."""
    names = [c.strip().split()[0] for c in _fields(schema)]

    def run(pdfs):
        for pdf in pdfs:
            for lo in range(0, len(pdf), at_a_time):
                part = pdf.iloc[lo : lo + at_a_time]
                yield pd.DataFrame([r for row in part.to_dict("records") for r in make(row)], columns=names)

    return df.mapInPandas(run, schema)


def each_row_arrays(df: DataFrame, make: Callable[[dict], tuple | None], schema: str) -> DataFrame:
    """As `each_row`, where ``make`` returns a row's output by column: arrays of one length, and single values that stand in each."""
    names = [c.strip().split()[0] for c in _fields(schema)]

    def run(pdfs):
        for pdf in pdfs:
            for lo in range(0, len(pdf), 256):
                got = [g for row in pdf.iloc[lo : lo + 256].to_dict("records") if (g := make(row)) is not None]
                if not got:
                    continue
                sizes = [next(len(c) for c in g if isinstance(c, np.ndarray)) for g in got]
                columns = [[c if isinstance(c, np.ndarray) else np.full(n, c, object) for c, n in zip(column, sizes)] for column in zip(*got)]
                yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, columns)})

    return df.mapInPandas(run, schema)


#: Values of images that are worked on at once, and rows that are copied to every task to meet frames.
MOST_VALUES, MOST_COPIED = 1 << 18, 1024


def each_stack(df: DataFrame, make: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], schema: str, reads: list[str], image: str = "pixels") -> DataFrame:
    """Tables that ``make`` yields for rows of one height and width and their images as one array (row, y, x), so many values at a time. Rows without an image drop out.

    ``reads`` are the columns that make reads beside the image: others are neither worked out nor sent to Python.
    """
    names = [c.strip().split()[0] for c in _fields(schema)]

    def run(pdfs):
        for pdf in pdfs:
            for (h, w), same in pdf[pdf[image].notna()].groupby(["height", "width"], sort=False):
                step = max(1, MOST_VALUES // max(1, int(h) * int(w)))
                for lo in range(0, len(same), step):
                    part = same.iloc[lo : lo + step].reset_index(drop=True)
                    for out in make(part, np.stack(part[image].to_numpy()).reshape(len(part), int(h), int(w))):
                        yield out[names]

    return df.select(*dict.fromkeys([*reads, "height", "width", image])).mapInPandas(run, schema)


def meeting(frames: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Frames joined with rows, a few of which may be copied; frames never are. Their arrays are made in the plan, so Spark can't tell their size, and would take them for the smaller side."""
    rows = written(rows, "meeting")
    return frames.join(F.broadcast(rows) if rows.limit(MOST_COPIED + 1).count() <= MOST_COPIED else merged(rows), on)


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


#: Outlines whose measures a worker keeps: a cell's channels and frames share one, so they are measured once.
OUTLINES = 128


@lru_cache(maxsize=OUTLINES)
def _mask_of(contour: bytes, height: int, width: int) -> np.ndarray:
    mask = G.raster(np.frombuffer(contour).reshape(-1, 2), height, width)
    mask.flags.writeable = False
    return mask


def _own(row: dict) -> tuple[bytes, int, int]:
    return outline(row["contour"]).tobytes(), int(row["height"]), int(row["width"])


def _mask(row: dict) -> np.ndarray:
    return _mask_of(*_own(row))


@lru_cache(maxsize=OUTLINES)
def _along(contour: bytes, height: int, width: int, degree: int) -> tuple[np.ndarray, G.Centerline | None, np.ndarray | None, np.ndarray | None]:
    """An outline's pixels, its centreline, and their arc length and distance there; none for fewer than three pixels."""
    p = G.pixels(_mask_of(contour, height, width))
    line = G.Centerline(p, degree) if len(p) >= 3 else None
    return p, line, *(line.place(p) if line else (None, None))


@lru_cache(maxsize=OUTLINES)
def _widths_of(contour: bytes, height: int, width: int, degree: int) -> tuple[float, float]:
    c = np.frombuffer(contour).reshape(-1, 2)
    return G.widths(c, G.pixels(_mask_of(contour, height, width)), degree)


@lru_cache(maxsize=OUTLINES)
def _ribs_of(contour: bytes, height: int, width: int, degree: int, step: float) -> list[tuple]:
    line = _along(contour, height, width, degree)[1]
    return G.ribs(np.frombuffer(contour).reshape(-1, 2), line, step) if line else []


@lru_cache(maxsize=OUTLINES)
def _rod_of(contour: bytes, height: int, width: int) -> tuple[G.Rod | None, str | None]:
    try:
        return G.Rod(np.frombuffer(contour).reshape(-1, 2), G.pixels(_mask_of(contour, height, width))), None
    except ValueError as e:
        return None, str(e)


@lru_cache(maxsize=OUTLINES)
def _shape_of(contour: bytes, area: float | None, perimeter: float | None) -> dict[str, float]:
    return G.shape_features(np.frombuffer(contour).reshape(-1, 2), area, perimeter)


@lru_cache(maxsize=OUTLINES)
def _settings_of(mask: bytes, height: int, width: int) -> tuple[float, float, float]:
    return G.spot_settings(np.frombuffer(mask, bool).reshape(height, width))


def rasterize(cells: DataFrame) -> DataFrame:
    """The pixels inside each contour, its border too, with their intensity."""

    def make(r: dict) -> tuple | None:
        if r["contour"] is None or r["pixels"] is None:
            return None
        img = np.asarray(r["pixels"], float).reshape(int(r["height"]), int(r["width"]))
        y, x = np.nonzero(_mask(r))
        return r["dbname"], r["cell_id"], r["channel"], x.astype(np.int32), y.astype(np.int32), img[y, x]

    return each_row_arrays(cells, make, "dbname string, cell_id string, channel string, x int, y int, intensity double")


def axial_positions(cells: DataFrame, degree: int = 4) -> DataFrame:
    """The pixels inside each contour with their place t (0 to 1) along the centreline."""

    def make(r: dict) -> tuple | None:
        p, line, arc, _ = _along(*_own(r), degree)
        if not line:
            return None
        t = arc / line.length
        img = np.asarray(r["pixels"], float).reshape(int(r["height"]), int(r["width"]))
        x, y = p.astype(np.int32).T
        return r["dbname"], r["cell_id"], r["channel"], x, y, img[y, x], t

    return each_row_arrays(cells, make, "dbname string, cell_id string, channel string, x int, y int, intensity double, t double")


def measured(cells: DataFrame, degree: int = 4, ring: int = 7) -> DataFrame:
    """All that needs a cell's image, in one pass over it: CELL, length, width_mean, width_median, background (median of the ring about it), and intensity and t of its pixels as arrays.

    What can't be measured is NULL; a cell of fewer than three pixels has no arrays.
    """

    def make(r: dict) -> Rows:
        m = _mask(r)
        p, line, arc, _ = _along(*_own(r), degree)
        img = np.asarray(r["pixels"], float).reshape(m.shape)
        y, x = np.nonzero(m)
        back = shape = None
        if len(y):
            reach = ring // 2
            box = np.s_[max(0, y.min() - reach) : y.max() + reach + 1, max(0, x.min() - reach) : x.max() + reach + 1]
            around = _widened(m[box], P.ellipse(ring)) & ~m[box]
            back = float(np.median(img[box][around])) if around.any() else None
        if len(p) >= 3 and G.length(p) > 0:
            shape = [round(v, 4) for v in (G.length(p), *_widths_of(*_own(r), degree))]
        arrays = (img[y, x].tolist(), (arc / line.length).tolist()) if line else (None, None)
        yield r["dbname"], r["cell_id"], r["channel"], *(shape or (None, None, None)), back, *arrays

    return each_row(cells, make, "dbname string, cell_id string, channel string, length double, width_mean double, width_median double, background double, intensity array<double>, t array<double>")


def cell_widths(cells: DataFrame, degree: int = 4) -> DataFrame:
    """length, width_mean and width_median, 4 decimals; NULL where a cell has no shape."""

    def make(r: dict) -> Rows:
        c = outline(r["contour"])
        p = G.pixels(_mask(r)) if len(c) >= 3 else c
        if len(p) < 3 or G.length(p) <= 0:
            yield r["dbname"], r["cell_id"], None, None, None
            return
        mean, median = _widths_of(*_own(r), degree)
        yield r["dbname"], r["cell_id"], round(G.length(p), 4), round(mean, 4), round(median, 4)

    return each_row(cells, make, "dbname string, cell_id string, length double, width_mean double, width_median double")


def profile_pixels(cells: DataFrame, degree: int = 4) -> DataFrame:
    """Pixels with u, their arc length; `windows.profile_bins` makes profiles of them."""
    px = axial_positions(cells, degree)
    return px.withColumnRenamed("t", "u")


def aligned_contours(cells: DataFrame) -> DataFrame:
    """Contours in the cell's axes, about the middle of their box there."""

    def make(r: dict) -> Rows:
        c = outline(r["contour"])
        if len(c) < 3:
            return
        centre, turn = G.axes(G.pixels(_mask(r)))
        p = (c - centre) @ turn.T
        p -= (p.min(0) + p.max(0)) / 2
        yield r["dbname"], r["cell_id"], [{"x": float(a), "y": float(b)} for a, b in p]

    return each_row(cells, make, "dbname string, cell_id string, contour array<struct<x:double,y:double>>")


def hull_measures(cells: DataFrame) -> DataFrame:
    def make(r: dict) -> Rows:
        c = outline(r["contour"])
        h = G.hull(c)
        area, hull_area, around = G.area(c), G.area(h), G.perimeter(c)
        yield r["dbname"], r["cell_id"], G.perimeter(h), hull_area, G.perimeter(h) / around if around else None, area / hull_area if hull_area else None

    return each_row(cells, make, "dbname string, cell_id string, hull_perimeter double, hull_area double, convexity double, solidity double")


def axis_ribs(cells: DataFrame, degree: int = 1, step: float = 5.0) -> DataFrame:
    def make(r: dict) -> Rows:
        for k, rib in enumerate(_ribs_of(*_own(r), degree, step)):
            yield r["dbname"], r["cell_id"], k, *rib

    return each_row(cells, make, "dbname string, cell_id string, rib int, arc double, x0 double, y0 double, x1 double, y1 double")


def _map_of(r: dict, degree: int, height: int | None, width: int | None, opening: int, eight_bit: bool) -> np.ndarray | None:
    p, _, arc, off = _along(*_own(r), degree)
    if len(p) < 9:
        return None
    img = np.asarray(r["pixels"], float).reshape(int(r["height"]), int(r["width"]))
    img = img - G.grey_open(img, P.ellipse(opening))
    v = img[p[:, 1].astype(int), p[:, 0].astype(int)]
    a, b = np.round(arc).astype(int), np.round(off - off.min()).astype(int)
    raw = np.full((b.max() + 3, a.max() + 3), -np.inf)
    for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
        np.maximum.at(raw, (b + 1 + j, a + 1 + i), v)
    m = np.where(np.isinf(raw), v.min(), raw)[1:-1, 1:-1]
    if height and width:
        m = m[np.arange(height) * m.shape[0] // height][:, np.arange(width) * m.shape[1] // width]
    if m[:, m.shape[1] // 2 :].sum() > m[:, : m.shape[1] - m.shape[1] // 2].sum():
        m = m[:, ::-1]
    if eight_bit:
        m = np.floor((m - m.min()) / np.ptp(m) * 255) if np.ptp(m) > 0 else np.zeros_like(m)
    return m


def cell_maps(cells: DataFrame, degree: int = 4, height: int | None = 256, width: int | None = 1024, opening: int = 21, eight_bit: bool = False) -> DataFrame:
    """Each cell's intensities above their opening by arc length and distance; the brighter half is on the left.

    Maps are resized (nearest) to height x width, or raw where these are None; eight_bit: min-max scaled to 0..255.
    """

    def make(r: dict) -> Rows:
        m = _map_of(r, degree, height, width, opening, eight_bit)
        if m is not None:
            yield r["dbname"], r["cell_id"], *m.shape, m.ravel()

    return each_row(cells, make, "dbname string, cell_id string, height int, width int, map array<double>", 8)


def cell_map_totals(cells: DataFrame, degree: int = 4, height: int | None = 256, width: int | None = 1024, opening: int = 21, eight_bit: bool = False) -> DataFrame:
    """The size, range and total (from the first value on) of each map of `cell_maps`, whose values don't leave the task."""

    def make(r: dict) -> Rows:
        m = _map_of(r, degree, height, width, opening, eight_bit)
        if m is not None:
            yield r["dbname"], r["cell_id"], *m.shape, float(m.min()), float(m.max()), float(np.cumsum(m)[-1])

    return each_row(cells, make, "dbname string, cell_id string, height int, width int, low double, high double, total double")


def cell_profiles(cells: DataFrame, degree: int = 4, n: int = 35, digits: int = 9) -> DataFrame:
    """dbname, cell_id, u1, g: the profiles that `windows.profile_bins` makes of a cell's pixels, made where its image lies. Places, of so many digits, count from the left."""

    def make(r: dict) -> Rows:
        p, line, arc, _ = _along(*_own(r), degree)
        if not line:
            return
        img = np.asarray(r["pixels"], float).reshape(int(r["height"]), int(r["width"]))
        v, u = img[p[:, 1].astype(int), p[:, 0].astype(int)], arc / line.length
        if u[np.argmax(p[:, 0])] < u[np.argmin(p[:, 0])]:
            u = 1 - u
        u = np.round(u, digits)
        order = np.lexsort((v, u))
        first, last = order[0], order[-1]
        inner = []
        if u[last] > u[first]:
            at = np.minimum(np.floor((u - u[first]) / (u[last] - u[first]) * n), n - 1)
            best = np.lexsort((u, -v, at))
            best = best[at[best] >= 1]
            inner = best[np.diff(at[best], prepend=0) > 0].tolist()
        ends = [first, *inner, last]
        yield r["dbname"], r["cell_id"], u[ends].tolist(), v[ends].tolist()

    return each_row(cells, make, "dbname string, cell_id string, u1 array<double>, g array<double>")


def population_map(cells: DataFrame, relative: bool = False, degree: int = 4, height: int | None = 256, width: int | None = 1024, opening: int = 21) -> DataFrame:
    """The mean of the maps of a database's cells and their three flips; of raw maps, those of the first cell's size count.

    Maps are made and added up in the same task, which sends one sum a database and size; relative: the mean is scaled to 0..1.
    """

    fixed = height and width
    if not fixed:
        cells = with_group(cells, first_sizes(cells, degree, opening), ["dbname"])

    def run(pdfs):
        sums: dict[str, list] = {}
        for pdf in pdfs:
            for r in pdf.to_dict("records"):
                m = _map_of(r, degree, height, width, opening, False)
                if m is not None and (fixed or m.shape == (r["first_height"], r["first_width"])):
                    s = sums.setdefault(r["dbname"], [np.zeros(m.shape), 0])
                    s[0] += m
                    s[1] += 4
        for db, (total, n) in sums.items():
            total = total + total[::-1]  # pairs first: the sum stays symmetric to the bit
            total = total + total[:, ::-1]
            for k, band in enumerate(np.array_split(total, min(BANDS, len(total)))):
                yield pd.DataFrame([(db, k, *total.shape, band.ravel(), n)], columns=["dbname", "band", "height", "width", "map", "n"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*pdf.iloc[0][["dbname", "band", "height", "width"]], sum(pdf["map"].to_numpy()), pdf["n"].sum())], columns=pdf.columns)

    schema = "dbname string, band int, height int, width int, map array<double>, n long"
    # Bands of rows are added up as arrays, in two steps where there are many tasks, and become pixels once.
    parts = cells.mapInPandas(run, schema).groupBy("dbname", "band", F.spark_partition_id() % 16).applyInPandas(lambda p: added(p), schema).groupBy("dbname", "band").applyInPandas(lambda p: added(p), schema)
    px = parts.select("dbname", "band", "height", "width", "n", F.posexplode("map").alias("i", "v"))
    rows = F.expr(f"height div least({BANDS}, height)")
    spare = F.expr(f"height % least({BANDS}, height)")  # the first bands have a row more
    first_row = F.col("band") * rows + F.least("band", spare)
    db = Window.partitionBy("dbname")  # as many pixels as a map has
    mean = px.select("dbname", (first_row + F.expr("i div width")).cast("long").alias("y"), F.expr("i % width").cast("long").alias("x"), (F.col("v") / F.col("n")).alias("v"))
    v = F.try_divide(F.col("v") - F.min("v").over(db), F.max("v").over(db) - F.min("v").over(db)) if relative else F.col("v")
    return mean.select("dbname", "y", "x", v.alias("value"))


#: Bands of rows that a map is added up in.
BANDS = 16


def first_sizes(cells: DataFrame, degree: int, opening: int) -> DataFrame:
    """dbname and the size of the raw map of its first cell, by id, that has one: the only size that counts there."""

    def filled(r: dict) -> Rows:
        if r["contour"] is not None and r["pixels"] is not None and len(G.pixels(_mask(r))) >= 9:
            yield r["dbname"], r["cell_id"]

    first = each_row(cells, filled, "dbname string, cell_id string").groupBy("dbname").agg(F.min("cell_id").alias("cell_id"))

    def size(r: dict) -> Rows:
        yield r["dbname"], *_map_of(r, degree, None, None, opening, False).shape

    sizes = each_row(with_group(cells, first.withColumn("_first", F.lit(True)), ["dbname", "cell_id"]).drop("_first"), size, "dbname string, first_height int, first_width int")
    return sizes.groupBy("dbname").agg(F.min(F.struct("first_height", "first_width")).alias("s")).select("dbname", "s.*")


def _columns(pdf: pd.DataFrame, keys: list[str], of: np.ndarray, **values) -> pd.DataFrame:
    """The keys of the rows ``of``, beside values of the same number."""
    return pd.DataFrame({k: pdf[k].to_numpy()[of] for k in keys} | values)


def connected_components(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames (keys, height, width, mask: row-major labels, 0 outside): the component of each pixel."""
    types = dict(frames.dtypes)

    def make(pdf: pd.DataFrame, masks: np.ndarray):
        c = G.components_of_many(masks)
        of, y, x = np.nonzero(c)
        yield _columns(pdf, keys, of, x=x.astype(np.int32), y=y.astype(np.int32), component=c[of, y, x].astype(np.int32))

    return each_stack(frames, make, ", ".join(f"{k} {types[k]}" for k in keys) + ", x int, y int, component int", keys, "mask")


def _dark(imgs: np.ndarray, threshold: int) -> np.ndarray:
    """Which pixels of each image are darker than ``threshold`` of its own 8-bit range; none where it has no range."""
    low, span = imgs.min((1, 2), keepdims=True), np.ptp(imgs, axis=(1, 2), keepdims=True)
    return (span > 0) & (np.floor((imgs - low) / np.where(span > 0, span, 1) * 255) < threshold)


def segment_frames(frames: DataFrame, keys: list[str], param1: int = 130) -> DataFrame:
    """Regions darker than ``param1`` of an 8-bit scaled frame: area, moment and centre of each component."""
    types = dict(frames.dtypes)

    def make(pdf: pd.DataFrame, imgs: np.ndarray):
        c = G.components_of_many(_dark(imgs.astype(float), param1))
        of, y, x = np.nonzero(c)
        many = c.max((1, 2))
        before = np.cumsum(many) - many  # components of the frames before
        at = before[of] + c[of, y, x] - 1
        n = np.bincount(at)
        mean = lambda v: np.bincount(at, v) / n
        own = np.repeat(np.arange(len(many)), many)
        yield _columns(pdf, keys, own, component=(np.arange(len(own)) - before[own] + 1).astype(np.int32), area=n.astype(np.int32), cx=mean(x), cy=mean(y))

    return each_stack(frames, make, ", ".join(f"{k} {types[k]}" for k in keys) + ", component int, area int, cx double, cy double", keys)


def cells_of_frames(frames: DataFrame, keys: list[str], px_um: float = S.DEFAULT_PIXEL, param1: int = 130, size: int = 200, low: float = 400, high: float = 1700) -> DataFrame:
    """frames (keys, the last of which is the frame) to cells: regions that pass the filters, found again in their crop, with an id.

    A candidate has enough area and its centre in the inner square; its crop of ``size`` must lie in the frame, and
    hold a region of enough area whose centre is within 3 px of the crop's. Ids count a frame's cells in reading order.
    """
    found = segment_frames(frames, keys, param1).withColumns({"px_um": F.lit(px_um), "m00": F.col("area")})
    near = filter_candidates(found, low, high).withColumnRenamed("area", "whole_area")
    x0, y0 = F.floor("cx").cast("int") - size // 2, F.floor("cy").cast("int") - size // 2
    near = near.withColumns({"crop_x0": x0, "crop_y0": y0}).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("component", "crop_x0", "crop_y0"))).alias("crops"))
    types = dict(frames.dtypes)

    def make(r: dict) -> Rows:
        h, w = int(r["height"]), int(r["width"])
        img = np.asarray(r["pixels"], float).reshape(h, w)
        level = img.min() + np.ptp(img) * param1 / 255
        for c in r["crops"]:
            x0, y0 = c["crop_x0"], c["crop_y0"]
            if x0 < 0 or y0 < 0 or x0 + size > w or y0 + size > h:
                continue
            part = G.components(img[y0 : y0 + size, x0 : x0 + size] < level)
            for k in range(1, part.max() + 1):
                y, x = np.nonzero(part == k)
                yield *(r[k] for k in keys), c["component"], x0, y0, len(x), float(x.mean()), float(y.mean())

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", component int, crop_x0 int, crop_y0 int, area int, crop_cx double, crop_cy double"
    again = each_row(meeting(frames, near, keys), make, schema, 16).withColumns({"px_um": F.lit(px_um), "m00": F.col("area")})
    one = centred_in_crop(again, size).drop("px_um", "m00")
    # A frame's cells are few: they fit in its crops.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("component", "crop_cx", "crop_cy")) - 1
    return one.withColumn("cell_id", S.make_cell_id(F.col(keys[-1]), place))


def separation_flag(profiles: DataFrame, degree: int = 4, centre: float = 0.15, ratio: float = 0.9) -> DataFrame:
    """within (a dip near the middle) or outside; profiles that are too short drop out."""

    def make(r: dict) -> Rows:
        s = G.separation(np.asarray(r["g"], float), degree, centre, ratio)
        if s is not None:
            yield r["dbname"], r["cell_id"], "within" if s else "outside"

    return each_row(profiles.select("dbname", "cell_id", "g"), make, "dbname string, cell_id string, flag string")


def separation_ratio(profiles: DataFrame) -> DataFrame:
    """Per database the share of all profiles, short ones too, on each side."""
    n = profiles.groupBy("dbname").agg(F.count("*").alias("n"))
    return separation_flag(profiles).groupBy("dbname", "flag").agg(F.count("*").alias("k")).join(n, "dbname").select("dbname", "flag", (F.col("k") / F.col("n")).alias("share"))


def cluster_points(cells: DataFrame, k: int) -> DataFrame:
    """k groups of each cell's pixels: label of each pixel, and the mean squared distance."""

    def make(r: dict) -> tuple | None:
        p = G.pixels(_mask(r))
        if len(p) < k:
            return None
        label, _, mse = G.k_groups(p, k)
        x, y = p.astype(np.int32).T
        return r["dbname"], r["cell_id"], x, y, label.astype(np.int32), mse

    return each_row_arrays(cells, make, "dbname string, cell_id string, x int, y int, grp int, mse double")


def smooth_profiles(profiles: DataFrame, sigma: float) -> DataFrame:
    def make(r: dict) -> Rows:
        yield r["dbname"], r["cell_id"], G.smooth(np.asarray(r["g"], float), sigma).tolist()

    return each_row(profiles.select("dbname", "cell_id", "g"), make, "dbname string, cell_id string, g array<double>")


def edge_profiles(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames (keys, height, width, pixels of 16 bits) with their smoothed edge profile, a value a row of pixels."""
    types = dict(frames.dtypes)

    def make(pdf: pd.DataFrame, imgs: np.ndarray):
        yield pdf[keys].assign(profile=list(G.edge_profiles(G.to_eight_bit(imgs))))

    return each_stack(frames, make, ", ".join(f"{k} {types[k]}" for k in keys) + ", profile array<double>", keys)


def drift(frames: DataFrame, most: int | None = None) -> DataFrame:
    """frames (view, frame, height, width, pixels of 16 bits): shift of each frame against the view's frame 0, across (dx) and down (dy).

    Down first, by the edge profiles of the rows from 200 to 1600 of 2044 parts of the height; then across, by the profile of
    the walls' band, which is moved by what was found. most: 60 of 2044 parts of the shorter side, at least 2, unless given.
    The two profiles of a view's frame 0 are all that its other frames are joined with. Views without a frame 0 drop out.
    """

    def profiles(pdf: pd.DataFrame, imgs: np.ndarray):
        imgs = G.to_eight_bit(imgs)
        yield pdf[["view"]].assign(edges=list(G.edge_profiles(imgs)), walls=list(G.wall_profiles(imgs, np.zeros(len(imgs), int))))

    first = each_stack(frames.where("frame = 0"), profiles, "view long, edges array<double>, walls array<double>", ["view"])

    def make(pdf: pd.DataFrame, imgs: np.ndarray):
        imgs = G.to_eight_bit(imgs)
        h, w = imgs.shape[1:]
        reach = max(2, round(min(h, w) * 60 / 2044)) if most is None else most
        dy, _ = G.best_shifts(np.stack(pdf["edges"]).astype(float), G.edge_profiles(imgs), round(h * 200 / 2044), round(h * 1600 / 2044), reach)
        dx, _ = G.best_shifts(np.stack(pdf["walls"]).astype(float), G.wall_profiles(imgs, dy), 0, w, reach)
        yield pdf[["view", "frame"]].assign(dx=dx, dy=dy)

    return each_stack(meeting(frames, first, ["view"]), make, "view long, frame long, dx int, dy int", ["view", "frame", "edges", "walls"])


def elastic_mask(cells: DataFrame, delta: int, label: str | None = None) -> DataFrame:
    """Masks (of a label) grown or shrunk by |delta| 3x3 steps; of what is left, the part nearest to the old centre; the old mask where nothing is.

    The new mask stands in the columns ys, x0s and x1s: a run of pixels for each of their places, both ends included, as in `runs`.
    """
    cells = filter_label(cells, label)

    def make(r: dict) -> Rows:
        old = _mask(r)
        m = old.copy()
        for _ in range(abs(delta)):
            around = [G.shifted(m, i, j, delta < 0) for i, j in P.SQUARE]
            m = np.any(around, axis=0) if delta > 0 else np.all(around, axis=0)
        c, status = G.components(m), "updated"
        if c.max() == 0:
            m, status = old, "failed"
        elif c.max() > 1:
            centre = G.pixels(old).mean(0)
            near = min(range(1, c.max() + 1), key=lambda k: float(((G.pixels(c == k).mean(0) - centre) ** 2).sum()))
            m = c == near
        wide = np.pad(m.astype(np.int8), ((0, 0), (1, 1)))
        change = np.diff(wide, axis=1)
        (ys, x0s), x1s = np.nonzero(change == 1), np.nonzero(change == -1)[1] - 1
        yield r["dbname"], r["cell_id"], int(old.sum()), int(m.sum()), status, ys.tolist(), x0s.tolist(), x1s.tolist()

    return each_row(cells, make, "dbname string, cell_id string, old_area int, area int, status string, ys array<int>, x0s array<int>, x1s array<int>")


def mask_runs(masks: DataFrame) -> DataFrame:
    """The new masks of `elastic_mask` as runs (dbname, cell_id, y, x0, x1), which the operators of `runs` take."""
    return masks.select("dbname", "cell_id", F.explode(F.arrays_zip("ys", "x0s", "x1s")).alias("r")).select("dbname", "cell_id", F.col("r.ys").alias("y"), F.col("r.x0s").alias("x0"), F.col("r.x1s").alias("x1"))


def elastic_report(masks: DataFrame) -> DataFrame:
    """Totals of `elastic_mask`: cells, and how many were updated and failed."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return masks.groupBy("dbname").agg(F.count("*").alias("total"), n("updated").alias("updated"), n("failed").alias("failed"))


def detect_spots(cells: DataFrame, settings: tuple[float, float, float] | None = None, most: int = 10) -> DataFrame:
    """Spots of each cell, strongest first; settings: least and greatest width and least signal to noise, else each cell's own."""

    schema = "dbname string, cell_id string, channel string, spot_id int, x double, y double, amplitude double, width_a double, width_b double, snr double, bic_improvement double"

    def make(pdf: pd.DataFrame, imgs: np.ndarray):
        masks = [_mask_of(outline(c).tobytes(), *imgs.shape[1:]) for c in pdf["contour"]]
        found = G.spots_of_many(imgs, masks, settings, most, lambda mask: _settings_of(mask.tobytes(), *mask.shape))
        keys = pdf[["dbname", "cell_id", "channel"]].itertuples(index=False, name=None)
        yield pd.DataFrame([(*key, k, *s) for key, spots in zip(keys, found) for k, s in enumerate(spots)], columns=[c.strip().split()[0] for c in _fields(schema)])

    return each_stack(cells, make, schema, [*CELL, "contour"])


def locate_spots(spots: DataFrame, cells: DataFrame) -> DataFrame:
    """spots in their cell's coordinates; lateral_reason says why a place across, or all places, are missing. A cell's spots are at most the cap."""
    lists = spots.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("spot_id", "x", "y"))).alias("spots"))

    def make(r: dict) -> Rows:
        rod, why = _rod_of(*_own(r))
        found = rod.places(np.array([(s["x"], s["y"]) for s in r["spots"]], float)) if rod else [(None, None, None, why)] * len(r["spots"])
        for s, place in zip(r["spots"], found):
            yield r["dbname"], r["cell_id"], r["channel"], s["spot_id"], *place

    return each_row(cells.join(merged(lists), CELL), make, "dbname string, cell_id string, channel string, spot_id int, longitudinal double, nearest_pole double, lateral_at double, lateral_reason string")


def contour_image_features(cells: DataFrame) -> DataFrame:
    """The 96 features of a cell, in the order of `geometry.feature_names`: 30 of shape, 22 for each of three channels.

    cells: contour, height, width, images (a struct ph, fluo1, fluo2 of row-major arrays, NULL where there is
    none), and area and perimeter, which are measured where they are NULL. Cells without a contour drop out.
    """
    given = [c for c in ("area", "perimeter") if c in cells.columns]

    def make(r: dict) -> Rows:
        c = outline(r["contour"])
        if not len(c):
            return
        known = {k: None if k not in given or r[k] is None or not np.isfinite(r[k]) else float(r[k]) for k in ("area", "perimeter")}
        out = dict(_shape_of(c.tobytes(), known["area"], known["perimeter"]))
        mask = _mask_of(np.rint(c).tobytes(), int(r["height"]), int(r["width"]))
        for name in ("ph", "fluo1", "fluo2"):
            img = r["images"][name]
            out |= {f"{name}_{k}": v for k, v in G.channel_features(None if img is None else np.asarray(img, float).reshape(mask.shape), mask).items()}
        yield r["dbname"], r["cell_id"], [out[n] if np.isfinite(out[n]) else 0.0 for n in sorted(out)]

    return each_row(cells, make, "dbname string, cell_id string, features array<double>")


def split_recovered(pixels: DataFrame, previous: DataFrame, least: int = 80, radius: int = 8, drift: DataFrame | None = None) -> DataFrame:
    """Components (view, frame, label, x, y) that lie on several of the last frame's cells are split: each pixel goes to the nearest cell's pixels.

    Gives the pixels of parts of at least ``least`` pixels, with their parent. Cells are those of `temporal_overlap`.
    """
    from .joins import drift_steps, temporal_overlap

    keys = ["view", "frame", "label"]
    many = temporal_overlap(pixels, previous, radius, drift).where("size(parents) > 1").select(*keys, "parents")
    old = previous.select("view", (F.col("frame") + 1).alias("frame"), F.col("label").cast("long").alias("parent"), "x", "y")
    if drift is not None:
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
        old = old.join(drift_steps(drift), ["view", "frame"], "left").withColumns({"x": F.col("x") + zero("dx"), "y": F.col("y") + zero("dy")})
    points = F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))).alias("points")
    seeds = old.groupBy("view", "frame", "parent").agg(points)
    seeds = many.withColumn("parent", F.explode("parents")).join(seeds, ["view", "frame", "parent"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("parent", "points"))).alias("seeds"))
    whole = pixels.join(many.select(*keys), keys, "left_semi").groupBy(*keys).agg(points)  # a cell's pixels are few

    def make(r: dict) -> tuple | None:
        own = outline(r["points"]).astype(np.int32)
        parent = np.array([s["parent"] for s in r["seeds"]])[_nearest(own, [outline(s["points"]) for s in r["seeds"]])]
        ids, place, size = np.unique(parent, return_inverse=True, return_counts=True)
        stays = size[place] >= least
        if not stays.any():
            return None
        return r["view"], r["frame"], r["label"], own[stays, 0], own[stays, 1], parent[stays]

    return each_row_arrays(whole.join(seeds, keys), make, "view long, frame long, label long, x int, y int, parent long")


def _nearest(own: np.ndarray, seeds: list[np.ndarray]) -> np.ndarray:
    """Which seed's pixels are nearest to each of a component's; the first on ties. Exact distances in two passes: down the columns of the box that holds all, then along the pixels' rows."""
    corner = np.min([p.min(0) for p in (own, *seeds)], axis=0).astype(int)
    w, h = np.max([p.max(0) for p in (own, *seeds)], axis=0).astype(int) - corner + 1
    x, y = (own - corner).astype(int).T
    best, which = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.int64)
    across = (x[:, None] - np.arange(w)) ** 2
    far = 4 * (w + h)
    for k, seed in enumerate(seeds):
        row = np.full((h, w), -far)
        sx, sy = (seed - corner).astype(int).T
        row[sy, sx] = sy
        above = np.maximum.accumulate(row, axis=0)
        row[row < 0] = far + h
        below = np.minimum.accumulate(row[::-1], axis=0)[::-1]
        down = np.minimum(np.arange(h)[:, None] - above, below - np.arange(h)[:, None])
        d = (across + down[y] ** 2).min(1)
        closer = d < best
        best[closer], which[closer] = d[closer], k
    return which


def trap_components(frames: DataFrame, rois: DataFrame, drift: DataFrame | None, rules: TrapRules, threshold: int = 130, sized: bool = False) -> DataFrame:
    """A row for each component in each trap of each frame; a frame is one row's work. sized: those only whose area the rules, strict or relaxed, take.

    frames: view, frame, height, width, pixels (16-bit). rois: view, roi, x0, y0, x1, y1 at frame 0, shifted by
    drift (view, frame, dx, dy). Regions are those darker than ``threshold`` in the frame's own 8-bit range. pixels
    are the component's in the frame, as y * width + x.
    """
    # A view's traps are a microscope's: few, so they ride along with each of its frames.
    lists = rois.groupBy("view").agg(F.sort_array(F.collect_list(F.struct("roi", "x0", "y0", "x1", "y1"))).alias("rois"))
    df = meeting(frames, lists, ["view"])
    df = df.join(merged(drift.select("view", "frame", "dx", "dy")), ["view", "frame"], "left") if drift is not None else df.withColumns({"dx": F.lit(0), "dy": F.lit(0)})
    least, most = (0, np.inf) if not sized else (rules.min_area / max(1, rules.scale), rules.max_area * max(1, rules.scale))

    def make(pdf: pd.DataFrame, imgs: np.ndarray):
        light = G.to_eight_bit(imgs)
        regions = G.components_of_many(_dark(light, threshold))
        h, w = imgs.shape[1:]
        rows = []
        views, frame_ids = pdf["view"].tolist(), pdf["frame"].tolist()
        moves = [tuple(0 if v is None or v != v else int(v) for v in d) for d in zip(pdf["dx"], pdf["dy"])]
        for nth in range(max(map(len, pdf["rois"]))):
            core = np.zeros(imgs.shape, np.int64)
            places: list[tuple | None] = []
            for k, ((dx, dy), rois) in enumerate(zip(moves, pdf["rois"])):
                places.append(None)
                if nth < len(rois):
                    roi = rois[nth]
                    x0, x1, y0, y1 = (int(np.clip(v, 0, top)) for v, top in ((roi["x0"] + dx, w), (roi["x1"] + dx, w), (roi["y0"] + dy, h), (roi["y1"] + dy, h)))
                    margin = min(rules.side_margin, max(0, (x1 - x0 - 1) // 2))
                    if x1 - x0 > 2 * margin and y1 > y0:
                        places[-1] = roi["roi"], x0, x1, y0, y1, margin
                        core[k, y0:y1, x0 + margin : x1 - margin] = regions[k, y0:y1, x0 + margin : x1 - margin]
            parts = G.components_of_many(core)
            of, y, x = np.nonzero(parts)
            if not len(of):
                continue
            # A frame's parts by whole component, then by their first pixel.
            whole, part = core[of, y, x], parts[of, y, x]
            order = np.lexsort((part, whole, of))
            of, y, x, whole, part = (v[order] for v in (of, y, x, whole, part))
            first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(part) != 0)])
            frame_first = first[np.searchsorted(of[first], of[first])]
            label = np.arange(len(first)) - np.searchsorted(first, frame_first) + 1
            sizes, full = np.diff(np.r_[first, len(of)]), {}
            # Grey levels are whole: sums over a component don't depend on their order.
            v, at = light[of, y, x], (y * w + x).astype(np.int32)
            grey, sums, darkest = v.astype(np.int32), np.add.reduceat(v, first), np.minimum.reduceat(v, first)
            box = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), y[first], y[first + sizes - 1]
            each = (c.tolist() for c in (first, sizes, label, of[first], whole[first], *box, sums, darkest))
            for a, n, nth_of_frame, k, region, left, right, top, bottom, total, low in zip(*each):
                if not least <= n <= most:
                    continue
                own = slice(a, a + n)
                roi, x0, x1, y0, y1, margin = places[k]
                cx0, cx1 = x0 + margin, x1 - margin
                if k not in full:
                    full[k] = np.bincount(regions[k, y0:y1].ravel())
                minor, major = _rectangle(x[own], y[own])
                # 4 pixels about the component's box hold all of its 9 x 9 surroundings
                by, bx = max(top - 4, y0), max(left - 4, cx0)
                around = np.s_[k, by : min(bottom + 5, y1), bx : min(right + 5, cx1)]
                rest = core[around]
                mask = np.zeros(rest.shape, bool)
                mask[y[own] - by, x[own] - bx] = True
                ring = light[around][_about(mask, 4) & (rest == 0)]
                rows.append((
                    views[k], roi, frame_ids[k], nth_of_frame, n, int(full[k][region]), top - y0, left - cx0, bottom - top + 1, right - left + 1, y1 - y0, x1 - x0, minor, major,
                    total / n, low, _median(ring) - total / n if len(ring) else None, w, h, *moves[k], at[own], grey[own],
                ))
        yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in _fields(schema)])

    schema = "view long, roi long, frame long, component int, area int, full_area int, top int, left int, box_height int, box_width int, trap_height int, trap_width int, minor double, major double, mean double, least double, contrast double, width int, height int, dx int, dy int, pixels array<int>, light array<int>"
    return each_stack(df, make, schema, ["view", "frame", "rois", "dx", "dy"])


def _median(v: np.ndarray) -> float:
    v, half = np.sort(v), len(v) // 2
    return float(v[half] if len(v) % 2 else (v[half - 1] + v[half]) / 2)


@lru_cache(maxsize=1 << 16)
def _rectangle_of(x: bytes, y: bytes) -> tuple[float, float]:
    return _rectangle_about(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))


def _rectangle_about(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    ends = np.r_[first, np.r_[first[1:], len(y)] - 1]  # the hull's corners end rows
    return G.least_rectangle(np.column_stack([x[ends], y[ends]]).astype(float))


def _rectangle(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The least rectangle of pixels in reading order; a shape of a few pixels is measured once a worker."""
    x, y = x - x.min(), y - y[0]
    return _rectangle_of(x.tobytes(), y.tobytes()) if len(x) <= 64 else _rectangle_about(x, y)


def _about(mask: np.ndarray, reach: int) -> np.ndarray:
    """A mask widened by a square of 2 * reach + 1, by running counts."""
    for _ in range(2):
        h, w = mask.shape
        upto = np.zeros((h, w + 2 * reach + 1), np.int64)
        np.cumsum(mask, axis=1, out=upto[:, reach + 1 : reach + 1 + w])
        upto[:, reach + 1 + w :] = upto[:, reach + w : reach + w + 1]
        mask = (upto[:, 2 * reach + 1 :] > upto[:, : -2 * reach - 1]).T
    return mask


def track_traps(frames: DataFrame, rois: DataFrame, rules: TrapRules | None = None, drift: DataFrame | None = None, threshold: int = 130) -> DataFrame:
    """Cells of each trap and frame: components that the strict rules accept, and (recovery) relaxed ones that the last frame's cells support.

    A recovered component on several of the last frame's cells is split among them. Only components' pixels go
    into the pass over a trap's frames in order, whose memory is that of two frames however long the film is: rows are
    dealt out by trap and sorted by frame, and what crosses from one batch of them to the next are the last frame's cells.
    label counts within the trap and frame; boxes end behind their last pixel.
    """
    rules = rules or TrapRules(recovery=True)
    found = trap_components(frames, rois, drift, rules, threshold, True).where(trap_place_ok(rules)).withColumn("strict", trap_cell_ok(rules)).withColumn("relaxed", trap_cell_ok(rules, True))
    keep = found.where("strict or relaxed" if rules.recovery else "strict")
    return keep.repartition("view", "roi").sortWithinPartitions("view", "roi", "frame", "component").mapInPandas(lambda pdfs: followed(pdfs, rules), TRACKED)


TRACKED = "view long, roi long, frame long, label int, area int, cx double, cy double, x0 int, y0 int, x1 int, y1 int, mean_intensity double, temporal_recovery boolean"


def _widened(mask: np.ndarray, kernel: list[tuple[int, int]]) -> np.ndarray:
    return G._over_kernel(mask.astype(float), kernel, np.maximum) > 0


class _LastCells:
    """A trap's cells of one frame as arrays of pixels, and how they are met in the next one."""

    def __init__(self, cells: list[np.ndarray], shift: tuple[int, int], radius: int):
        self.cells, self.shift, self.disk, self.radius = cells, shift, P.ellipse(2 * radius + 1), radius

    def moved(self, shift: tuple[int, int]) -> list[np.ndarray]:
        return [p + (shift[0] - self.shift[0], shift[1] - self.shift[1]) for p in self.cells]

    def grown(self, cells: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each cell's dilated mask, and the corner (x, y) that it counts from."""
        out = []
        for p in cells:
            corner = p.min(0) - self.radius
            mask = np.zeros((np.ptp(p, axis=0) + 2 * self.radius + 1)[::-1], bool)
            mask[p[:, 1] - corner[1], p[:, 0] - corner[0]] = True
            out.append((_widened(mask, self.disk), corner))
        return out


def _on(points: np.ndarray, mask: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Which points are on a mask."""
    x, y = (points - corner).T
    ok = (x >= 0) & (y >= 0) & (x < mask.shape[1]) & (y < mask.shape[0])
    ok[ok] = mask[y[ok], x[ok]]
    return ok


def followed(pdfs: Iterator[pd.DataFrame], rules: TrapRules) -> Iterator[pd.DataFrame]:
    """Cells of components that come by trap and frame, in batches of any size: the rows of `TRACKED`."""
    smallest = max(80, round(rules.min_area / rules.scale))
    none = _LastCells([], (0, 0), rules.radius)
    trap, frame, last, now, shift, grown, old = None, None, none, [], (0, 0), None, []
    for pdf in pdfs:
        rows = []
        for r in pdf.to_dict("records"):
            if (trap, frame) != ((r["view"], r["roi"]), r["frame"]):
                follows = trap == (r["view"], r["roi"]) and frame == r["frame"] - 1
                last = _LastCells(now, shift, rules.radius) if follows else none
                trap, frame, now, shift, grown = (r["view"], r["roi"]), r["frame"], [], (r["dx"], r["dy"]), None
                old = last.moved(shift)
            at, light, recovered = np.asarray(r["pixels"]), np.asarray(r["light"], float), not r["strict"]
            own = np.column_stack([at % r["width"], at // r["width"]])
            parts = [np.ones(len(own), bool)]
            if recovered:
                grown = last.grown(old) if grown is None else grown
                on = [_on(own, *g) for g in grown]
                if not on or np.any(on, axis=0).mean() < rules.min_overlap:
                    continue
                match = [k for k, o in enumerate(on) if o.sum() >= max(8, round(len(own) * 0.02))]
                if len(match) > 1:
                    which = _nearest(own, [old[k] for k in match])
                    parts = [which == k for k in range(len(match)) if (which == k).sum() >= smallest] or parts
            for part in parts:
                p, v = own[part], light[part]
                now.append(p)
                x, y = p.T
                rows.append((*trap, frame, len(now), len(p), x.mean(), y.mean(), x.min(), y.min(), x.max() + 1, y.max() + 1, v.mean(), recovered))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACKED.split(", ")])
