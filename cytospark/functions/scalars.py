"""Column expressions: labels, ids, units, names, scaling. All stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometres a pixel of the known objectives.
OBJECTIVES = {"100x": 0.065, "60x": 0.108}
DEFAULT_PIXEL = 0.065
CHANNELS = ("ph", "fluo1", "fluo2")


def canonical_label(label: Column) -> Column:
    """NULL, blank, n/a in any case, and 1000 are N/A; other labels are trimmed."""
    t = F.trim(label.cast("string"))
    return F.when(t.isNull() | (t == "") | (F.upper(t) == "N/A") | (t == "1000"), F.lit("N/A")).otherwise(t)


def training_label(label: Column) -> Column:
    """1 for 1 and 1.0; 0 for the texts that mean none; else NULL."""
    t = F.upper(F.trim(label.cast("string")))
    return F.when(t.isin("1", "1.0"), 1).when(t.isin("N/A", "NA", "NONE", "NULL", "0", "1000"), 0)


def finite_or_null(value: Column, positive: bool = False) -> Column:
    """NULL for text that isn't a number, NaN, infinities and negatives (and zero where positive)."""
    v = value.try_cast("double")
    low = v <= 0 if positive else v < 0
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | low, F.lit(None).cast("double")).otherwise(v)


def min_contour_area(pixel_um: Column) -> Column:
    return F.lit(300.0) * F.pow(F.lit(DEFAULT_PIXEL) / pixel_um, F.lit(2.0))


def infer_objective(pixel_um: Column, fallback: str = "100x") -> Column:
    """The nearest known objective within 10 % of its pixel size, else the fallback."""
    off = {k: F.abs(pixel_um - v) / v for k, v in OBJECTIVES.items()}
    near = F.when(F.abs(pixel_um - OBJECTIVES["100x"]) <= F.abs(pixel_um - OBJECTIVES["60x"]), F.struct(F.lit("100x").alias("name"), off["100x"].alias("off"))).otherwise(F.struct(F.lit("60x").alias("name"), off["60x"].alias("off")))
    return F.when(pixel_um.isNull() | (pixel_um <= 0), F.lit(fallback)).otherwise(F.when(near["off"] <= 0.1, near["name"]).otherwise(F.lit(fallback)))


def frame_of(cell_id: Column) -> Column:
    return F.regexp_extract(cell_id, r"^F(\d+)C(\d+)$", 1).try_cast("long")


def index_of(cell_id: Column) -> Column:
    return F.regexp_extract(cell_id, r"^F(\d+)C(\d+)$", 2).try_cast("long")


def make_cell_id(frame: Column, index: Column) -> Column:
    return F.concat(F.lit("F"), frame.cast("string"), F.lit("C"), index.cast("string"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def axis_name(index: Column, times: int, planes: int) -> Column:
    """A running frame index over (field, time, plane) as f03_t1_z2, from mixed-radix digits."""
    field, time, plane = F.floor(index / (times * planes)), F.floor(index / planes) % times, index % planes
    return F.concat(F.lit("f"), F.lpad(field.cast("string"), 2, "0"), F.lit("_t"), time.cast("string"), F.lit("_z"), plane.cast("string"))


def scale_fixed(value: Column, full: float = 65535.0) -> Column:
    """To 0..255 by a fixed range, truncated."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(full)) / full * 255).cast("long")


def scale_rounded(value: Column, full: float = 65535.0) -> Column:
    """To 0..255 by a fixed range, rounded to the nearest, halves to even."""
    return F.rint(F.least(F.greatest(value, F.lit(0.0)), F.lit(full)) * F.lit(255.0 / full)).cast("long")


def scale_range(value: Column, low: Column, high: Column) -> Column:
    """To 0..255 by an image's own range, truncated; 0 in an image of one value."""
    return F.when(high > low, F.floor((value - low) / (high - low) * 255)).otherwise(0).cast("long")


def scale_gain(value: Column, top: Column) -> Column:
    """To 0..255 by the full range of the bit depth that the image's maximum calls for, rounded."""
    return F.rint(F.least(F.greatest(value, F.lit(0.0)) * 255.0 / bit_depth_limit(top), F.lit(255.0))).cast("long")


def bit_depth_limit(top: Column) -> Column:
    """The least of the usual full ranges that holds the maximum."""
    out = F.when(top <= 255, 255)
    for limit in (1023, 4095, 16383):
        out = out.when(top <= limit, limit)
    return out.otherwise(65535)


def slid_box(start: Column, size: Column, limit: Column) -> Column:
    """The start of a crop of ``size`` slid into [0, limit)."""
    return F.greatest(F.lit(0), F.least(start, limit - size))


def acquired_at(text: Column) -> Column:
    """A time in free text: ISO first, then the usual formats (month first before day first), else an ISO time inside a line."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd"]
    inside = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats), F.try_to_timestamp(F.regexp_replace(inside, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))


def valid_action(name: Column) -> Column:
    return name.isNotNull() & F.length(F.trim(name)).between(1, 64)
