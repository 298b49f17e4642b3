"""Window functions: duplicates, distributions, binning of profiles, neighbours, revisions, shifts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.geometry import best_shifts
from .ordering import placed


def dedupe_cells(df: DataFrame, ties: list[str]) -> DataFrame:
    """The first row of each cell id of a database, by frame and index."""
    w = Window.partitionBy("dbname", "cell_id").orderBy(S.frame_of(F.col("cell_id")), S.index_of(F.col("cell_id")), *ties)
    return df.withColumn("row", F.row_number().over(w)).where("row = 1").drop("row")


def ecdf(df: DataFrame, metric: str) -> DataFrame:
    """Per database and distinct value the share of values up to it. Values are counted first."""
    counts = df.where(F.col(metric).isNotNull()).groupBy("dbname", metric).agg(F.count("*").alias("n"))
    return placed(counts, ["dbname"], [metric], "n").select("dbname", metric, (F.col("place") / F.col("total")).alias("share"))


def profile_bins(px: DataFrame, keys: list[str], n: int = 35) -> DataFrame:
    """A profile of at most n + 1 points from pixels with a place u: the first point, the brightest of each filled bin 1..n-1 (earliest on ties), the last."""
    cell = Window.partitionBy(*keys)
    p = px.withColumns({"low": F.min("u").over(cell), "high": F.max("u").over(cell)})
    p = p.withColumn("bin", F.least(F.floor(F.try_divide(F.col("u") - F.col("low"), F.col("high") - F.col("low")) * n), F.lit(n - 1)))
    point = F.struct("u", "intensity")
    first, last = F.min(point).alias("p"), F.max(point).alias("p")
    inner = p.where("bin >= 1").groupBy(*keys, "bin").agg(F.min(F.struct((-F.col("intensity")).alias("i"), "u")).alias("m"))
    inner = inner.select(*keys, F.col("bin").cast("long").alias("bin"), F.struct(F.col("m.u").alias("u"), (-F.col("m.i")).alias("intensity")).alias("p"))
    ends = p.groupBy(*keys).agg(first).withColumn("bin", F.lit(0).cast("long")).unionByName(p.groupBy(*keys).agg(last).withColumn("bin", F.lit(n).cast("long")))
    whole = inner.unionByName(ends.select(*keys, "bin", "p")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "p"))).alias("a"))
    return whole.select(*keys, F.col("a.p.u").alias("u1"), F.col("a.p.intensity").alias("g"))


def order_profiles_abs(df: DataFrame) -> DataFrame:
    """By length: place in order, and u1 shifted to 0 and centred about the longest."""
    length = F.element_at("u1", -1) - F.element_at("u1", 1)
    d = df.withColumn("length", length)
    top = d.agg(F.max("length").alias("longest"))
    # A place within a database; the longest of the table is one row.
    d = placed(d, ["dbname"], ["length", "cell_id"], total="of").drop("of").crossJoin(F.broadcast(top))
    return d.withColumn("u1", F.transform("u1", lambda u: u - F.element_at("u1", 1) + (F.col("longest") - F.col("length")) / 2)).drop("longest")


def order_profiles_rel(df: DataFrame) -> DataFrame:
    """By the sum of g; positions are indices, centred by the number of points."""
    d = df.withColumn("total", F.aggregate("g", F.lit(0.0), lambda s, v: s + v))
    d = placed(d, ["dbname"], ["total", "cell_id"], total="of").drop("of").crossJoin(F.broadcast(d.agg(F.max(F.size("g")).alias("most"))))
    return d.withColumn("at", F.transform("g", lambda _, i: i + (F.col("most") - F.size("g")) / 2)).drop("most")


def frame_neighbours(frames: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("order_index", "frame_id")
    return frames.withColumns({"previous_id": F.lag("frame_id").over(w), "next_id": F.lead("frame_id").over(w)})


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The newest revision of each frame that was applied, its status, and how many edits weren't (conflicts).

    An edit is applied where its base is the revision that is current then: the newest applied one before it,
    0 at first. A frame's edits are the work of its reviewers, so they fit in an array.
    """
    edits = F.array_sort(F.collect_list(F.struct("revision", "base_revision", "status")))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("conflicts"))

    def apply(s, e):
        ok = F.coalesce(e["base_revision"] == s["revision"], F.lit(False))
        return F.struct(F.when(ok, e["revision"]).otherwise(s["revision"]).cast("long").alias("revision"), F.when(ok, e["status"]).otherwise(s["status"]).cast("string").alias("status"), F.when(ok, s["conflicts"]).otherwise(s["conflicts"] + 1).cast("long").alias("conflicts"))

    return revisions.groupBy("frame_id").agg(edits.alias("e")).select("frame_id", F.aggregate("e", start, apply).alias("r")).select("frame_id", "r.*")


def review_order(frames: DataFrame) -> DataFrame:
    """order = frames of all views before + place of the ROI in its view * times + time."""
    size = frames.groupBy("view").agg(F.count_distinct("roi").alias("rois"), (F.max("time") + 1).alias("times"))
    base = size.select("view", "times", F.coalesce(F.sum(F.col("rois") * F.col("times")).over(Window.orderBy("view").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    d = frames.join(base, "view").withColumn("roi_place", F.dense_rank().over(Window.partitionBy("view").orderBy("roi")) - 1)
    return d.withColumn("order_index", F.col("base") + F.col("roi_place") * F.col("times") + F.col("time")).drop("base", "times")


def label_boundaries(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with a label other than that of a neighbour beside or above, where there is one."""
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    differs = F.lit(False)
    for w, c in ((row, "x"), (col, "y")):
        for f, step in ((F.lag, -1), (F.lead, 1)):
            differs = differs | F.coalesce((f(c).over(w) == F.col(c) + step) & (f("label").over(w) != F.col("label")), F.lit(False))
    return px.withColumn("edge", differs).where("edge").drop("edge")


def best_shift(profiles: DataFrame, most: str | int, start: str | int = 0, stop: str | int | None = None) -> DataFrame:
    """profiles (reference, current: arrays of one length) with the shift from -most to most at which they correlate best, and its score.

    The reference's positions start to stop - 1, kept most + 2 away from the ends, are z-scored; so is each shifted window
    of current by its own mean and deviation. The lowest shift wins ties. most, start and stop are numbers or columns. A
    pair without such a position is an error; so are arrays of different lengths.
    """
    given = lambda c: F.col(c) if isinstance(c, str) else F.lit(c)
    end = F.size("reference") if stop is None else given(stop)

    @F.pandas_udf("struct<shift int, score double>")
    def shifts(reference: pd.Series, current: pd.Series, start: pd.Series, stop: pd.Series, most: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"shift": np.zeros(len(start), np.int32), "score": np.zeros(len(start))})
        kinds = pd.DataFrame({"n": reference.map(len), "m": current.map(len), "start": start, "stop": stop, "most": most})
        for (_, _, a, b, s), at in kinds.groupby(list(kinds.columns)).indices.items():  # rows of one kind at once
            shift, out.loc[at, "score"] = best_shifts(np.stack(reference.iloc[at]).astype(float), np.stack(current.iloc[at]).astype(float), a, b, s)
            out.loc[at, "shift"] = shift.astype(np.int32)
        return out

    found = profiles.withColumn("_best", shifts("reference", "current", given(start).cast("int"), end.cast("int"), given(most).cast("int")))
    return found.select(*profiles.columns, "_best.shift", "_best.score")


def stitched_offsets(frames: DataFrame, by: list[str]) -> DataFrame:
    """Where each frame starts when frames stand side by side in time."""
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("x_offset", F.coalesce(F.sum("width").over(w), F.lit(0)))


def profile_monotone(df: DataFrame) -> DataFrame:
    ok = F.expr("size(u1) >= 2 and forall(sequence(1, size(u1) - 1), i -> u1[i] >= u1[i - 1]) and u1[size(u1) - 1] > u1[0]")
    return df.withColumn("monotone", ok)


def cap_spots(spots: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest spots of each cell, and whether it had that many."""
    cell = Window.partitionBy("dbname", "cell_id")
    s = spots.withColumns({"rank": F.row_number().over(cell.orderBy(F.desc("amplitude"), "spot_id")), "many": F.count("*").over(cell)})
    return s.where(F.col("rank") <= n).withColumn("at_cap", F.col("many") >= n).drop("many")
