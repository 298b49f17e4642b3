"""Measurements by aggregation: shape and intensity of cells, distributions, labels, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_label, training_label
from .ordering import quantiles, selected, with_group

KEY = ["dbname", "cell_id", "channel"]


def principal_axes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sample variances of points along their principal axes (l1 >= l2) and the major axis' direction, per group."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("vxy", 2))
    angle = F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2
    return g.select(*keys, "n", (half + root).alias("l1"), F.greatest(half - root, F.lit(0.0)).alias("l2"), F.cos(angle).alias("ax"), F.sin(angle).alias("ay"))


def cell_lengths(px: DataFrame, keys: list[str], contours: DataFrame | None = None) -> DataFrame:
    """Extent of a cell's pixels along their major axis, 4 decimals; cells without an extent drop out.

    contours (keys, contour): a cell without pixels, or with fewer than two, is measured by its contour's points.
    """
    if contours is not None:
        points = contours.select(*keys, F.explode("contour").alias("p")).select(*keys, F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(True).alias("of_contour"))
        both = px.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(False).alias("of_contour")).unionByName(points)
        few = both.groupBy(*keys).agg((F.count(F.when(~F.col("of_contour"), 1)) < 2).alias("few"))
        px = both.join(few, keys).where(F.col("of_contour") == F.col("few"))
    axes = principal_axes(px, keys)
    along = F.col("x") * F.col("ax") + F.col("y") * F.col("ay")
    out = px.join(axes, keys).groupBy(*keys).agg(F.round(F.max(along) - F.min(along), 4).alias("length"))
    return out.where("length > 0 and not isnan(length)")


def pca_shape(df: DataFrame, keys: list[str]) -> DataFrame:
    """Variances, their roots, ratio and eccentricity."""
    a = principal_axes(df, keys)
    return a.select(*keys, "l1", "l2", F.sqrt("l1").alias("sd1"), F.sqrt("l2").alias("sd2"), F.try_divide(F.col("l2"), F.col("l1")).alias("ratio"), F.sqrt(1 - F.try_divide(F.col("l2"), F.col("l1"))).alias("eccentricity"))


def polygon_measures(df: DataFrame) -> DataFrame:
    """area, perimeter and centre (whole numbers, 0 where the area is 0) of closed contours (array of x, y structs)."""
    nxt = "contour[(i + 1) % size(contour)]"
    ring = f"transform(sequence(0, size(contour) - 1), i -> struct(contour[i].x as x0, contour[i].y as y0, {nxt}.x as x1, {nxt}.y as y1))"
    df = df.withColumn("ring", F.when(F.size("contour") > 0, F.expr(ring)))
    total = lambda e: F.expr(f"aggregate(ring, 0D, (s, e) -> s + {e})")
    twice = total("e.x0 * e.y1 - e.x1 * e.y0")
    centre = lambda c: F.when(twice == 0, F.lit(0).cast("long")).otherwise(F.try_divide(total(f"(e.{c}0 + e.{c}1) * (e.x0 * e.y1 - e.x1 * e.y0)"), 3 * twice).cast("long"))
    return df.withColumns({"poly_area": F.abs(twice) / 2, "poly_perimeter": total("sqrt(pow(e.x1 - e.x0, 2) + pow(e.y1 - e.y0, 2))"), "center_x": centre("x"), "center_y": centre("y")}).drop("ring")


def normalized_median(px: DataFrame, keys: list[str]) -> DataFrame:
    """Median over maximum of the intensities; 0 where all are 0."""
    return px.groupBy(*keys).agg(F.when(F.max("intensity") == 0, 0.0).otherwise(F.percentile("intensity", 0.5) / F.max("intensity")).alias("normalized_median"))


def fraction_below(df: DataFrame, value: str, threshold: float = 0.7414, keys: list[str] | None = None) -> DataFrame:
    """Share, number and total of the finite values strictly below the threshold. Without keys, no finite value is an error."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is a number from 0 to 1")
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    total = F.count("*") if keys else F.when(F.count("*") == 0, F.raise_error(F.lit("there is no finite value")).cast("long")).otherwise(F.count("*"))
    return ok.groupBy(*(keys or [])).agg(F.avg((F.col(value) < threshold).cast("double")).alias("ratio"), F.sum((F.col(value) < threshold).cast("long")).alias("below"), total.alias("total"))


def raw_intensities(px: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell's values in row-major order; a cell's pixels are bounded by its image."""
    return px.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", "intensity"))).alias("p")).select(*keys, F.col("p.intensity").alias("intensities"))


def intensity_stats(px: DataFrame, keys: list[str]) -> DataFrame:
    v, s = F.col("intensity"), F.sum("intensity")
    energy = 1 - F.try_divide(s * s, F.count("*") * F.sum(v * v))
    return px.groupBy(*keys).agg(
        F.stddev_pop(v).alias("sd"), F.try_divide(F.stddev_pop(v), F.avg(v)).alias("cv"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"),
        F.try_divide(F.avg(v), F.max(v)).alias("normalized_mean"), F.try_divide(F.percentile(v, 0.5), F.max(v)).alias("normalized_median"), F.least(F.greatest(energy, F.lit(0.0)), F.lit(1.0)).alias("energy"),
    )


def concentration(px: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy, Hoyer sparsity and the share of the brightest tenth, of intensities over the background. NULL without signal or with one pixel."""
    w = F.greatest(F.col("intensity") - F.col("background"), F.lit(0.0))
    # A cell's pixels are bounded by its image, so its values fit in an array.
    a = px.join(background, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("s"), F.sqrt(F.sum(w * w)).alias("q"), F.sort_array(F.collect_list(w), asc=False).alias("w"))
    root, ok = F.sqrt("n"), (F.col("s") > 0) & (F.col("n") > 1)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda x, v: x + v)
    share = lambda v: v / F.col("s")
    logs = total(F.transform("w", lambda v: F.when(v > 0, share(v) * F.log(share(v))).otherwise(0.0)))
    return a.select(
        *keys, F.when(ok, -logs / F.log("n")).alias("entropy_norm"), F.when(ok, (root - F.col("s") / F.col("q")) / (root - 1)).alias("hoyer_sparsity"),
        F.when(ok, total(F.slice("w", F.lit(1), F.greatest(F.ceil(F.col("n") * 0.1), F.lit(1)).cast("int"))) / F.col("s")).alias("top10_fraction"),
    )


def axial_localization(px: DataFrame, keys: list[str], tolerance: float = 1e-7) -> DataFrame:
    """Where along the axis (t from 0 to 1) the weight w lies: pole and middle enrichment, spread, offset, asymmetry."""
    t, w = F.col("t"), F.col("w")
    s, n = F.sum(w), F.count("*")
    polar, mid = (t <= 0.2 + tolerance) | (t >= 0.8 - tolerance), t.between(0.4 - tolerance, 0.6 + tolerance)
    rich = lambda part: F.try_divide(F.sum(F.when(part, w).otherwise(0.0)) / s, F.avg(part.cast("double")))
    left = F.sum(F.when(F.abs(t - 0.5) <= tolerance, w / 2).when(t < 0.5, w).otherwise(0.0)) / s
    mean = F.sum(w * t) / s
    g = px.groupBy(*keys).agg(s.alias("s"), n.alias("n"), rich(polar).alias("polar_enrichment"), rich(mid).alias("midcell_enrichment"), F.sqrt(F.greatest(F.sum(w * t * t) / s - mean * mean, F.lit(0.0))).alias("axial_spread"), F.abs(2 * mean - 1).alias("axial_offset"), F.abs(1 - 2 * left).alias("axial_asymmetry"))
    return g.where("s > 0").drop("s", "n")


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def metric_summary(df: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Per group: total, valid, missing, and the exact quartiles (NULL without values)."""
    m = F.col(metric)
    counts = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count(m).alias("valid"), (F.count("*") - F.count(m)).alias("missing"))
    return with_group(counts, quantiles(df, metric, keys, QUARTILES), keys, "left")


def metric_rollup(df: DataFrame, metric: str) -> DataFrame:
    """The summary by database and label, and over All labels: rows count for both, and are read once."""
    level = F.explode(F.array(F.struct(F.col("label").alias("label"), F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("label"), F.lit(True).alias("all"))))
    both = df.select("dbname", F.col(metric).alias("_metric"), level.alias("_level")).select("dbname", "_level.*", "_metric")
    out = metric_summary(both, "_metric", ["dbname", "label", "all"])
    return out.withColumn("label", F.when(F.col("all"), "All").otherwise(F.col("label"))).drop("all")


def label_counts(df: DataFrame, column: str = "manual_label") -> DataFrame:
    """Per database how many cells have each canonical label."""
    return df.groupBy("dbname", canonical_label(F.col(column)).alias("label")).agg(F.count("*").alias("n"))


def source_counts(df: DataFrame) -> DataFrame:
    """How many cells each database has, and how many of each training label."""
    y = training_label(F.col("manual_label"))
    return df.groupBy("dbname").agg(F.count("*").alias("n"), F.count(F.when(y == 1, 1)).alias("ones"), F.count(F.when(y == 0, 1)).alias("zeros"))


def distinct_labels(df: DataFrame, column: str = "manual_label") -> DataFrame:
    return df.select(F.trim(column).alias("label")).where("label <> ''").distinct().orderBy(F.lower("label"), "label")


def profile_score(g: Column) -> Column:
    """Mean of the min-max scaled profile; a constant profile keeps its mean."""
    low, high = F.array_min(g), F.array_max(g)
    mean = F.aggregate(g, F.lit(0.0), lambda s, v: s + v) / F.size(g)
    return F.when(high > low, (mean - low) / (high - low)).otherwise(mean)


def control_threshold(scores: DataFrame, value: str = "score", share: float = 0.95) -> DataFrame:
    """One row: the score at descending place int(share * n); no row without scores."""
    down = lambda total: F.least(F.floor(total * share), total - 1)
    return selected(scores, value, [], lambda total: {"threshold": total - 1 - down(total)}).select("threshold")


def aggregation_ratio(profiles: DataFrame, control: DataFrame, pixel: float = 0.065) -> DataFrame:
    """Per database the mean length and the share of profiles under the control's threshold. control has one row or none."""
    length = F.round((F.element_at("u1", -1) - F.element_at("u1", 1)) * pixel, 2)
    scored = profiles.select("dbname", length.alias("length"), profile_score(F.col("g")).alias("score")).join(F.broadcast(control), how="left")
    return scored.groupBy("dbname").agg(F.avg("length").alias("mean_length"), F.avg(F.when(F.col("threshold").isNotNull(), (F.col("score") < F.col("threshold")).cast("double"))).alias("ratio"), F.count("*").alias("n"))


def quantile_call(df: DataFrame, control: DataFrame, value: str, q: float, above: bool) -> DataFrame:
    """Per database the share of values beyond a quantile of the control."""
    cut = quantiles(control, value, [], {"cut": q})  # one row
    beyond = F.col(value) > F.col("cut") if above else F.col(value) < F.col("cut")
    return df.crossJoin(F.broadcast(cut)).groupBy("dbname").agg(F.avg(beyond.cast("double")).alias("positive"), F.count("*").alias("n"))


def profile_matrix(df: DataFrame, normalize: bool = False) -> DataFrame:
    """Profiles padded with NULL to the longest of the table; normalize: each min-max scaled, a constant one to 0."""
    longest = df.agg(F.max(F.size("g")).alias("longest"))
    low, high = F.array_min("g"), F.array_max("g")
    g = F.transform("g", lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(0.0)) if normalize else F.col("g")
    return df.crossJoin(F.broadcast(longest)).withColumn("row", F.concat(g, F.array_repeat(F.lit(None).cast("double"), F.col("longest") - F.size("g")))).drop("longest")


def five_number(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = quantiles(df, value, by, QUARTILES)
    v, spread = F.col(value).cast("double"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = with_group(df.select(*by, v.alias("_v")).where("_v is not null"), q, by).where(F.col("_v").between(F.col("q1") - spread, F.col("q3") + spread))
    return inside.groupBy(*by, "q1", "median", "q3").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))


def histogram(df: DataFrame, value: str, by: list[str], rule: str = "values") -> DataFrame:
    """Bins filled with zeros. values: min(40, max(8, floor sqrt n)) equal bins; intensities: one if constant, unit bins to a range of 256, else 256."""
    v = F.col(value)
    s = df.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
    wide = F.col("high") - F.col("low")
    bins = F.least(F.lit(40), F.greatest(F.lit(8), F.floor(F.sqrt("n")))) if rule == "values" else F.when(wide == 0, 1).when(wide <= 256, F.greatest(F.ceil(wide), F.lit(1))).otherwise(256)
    s = s.withColumn("bins", bins.cast("long"))
    at = F.when(wide == 0, 0).otherwise(F.least(F.floor((v - F.col("low")) / wide * F.col("bins")), F.col("bins") - 1)).cast("long")
    filled = with_group(df, s, by).where(v.isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("count"))
    grid = s.withColumn("bin", F.explode(F.expr("sequence(0L, bins - 1)")))
    return with_group(grid, filled, [*by, "bin"], "left").select(*by, "bin", (F.col("low") + wide * F.col("bin") / F.col("bins")).alias("from"), F.coalesce("count", F.lit(0)).alias("count"))


def kde(df: DataFrame, value: str, by: list[str], points: int = 200) -> DataFrame:
    """Gaussian density on a grid from max(0, min - 3h) to max + 3h, where NULLs in ``by`` are a group.

    Equal values are counted first, and each meets the grid points near it only.
    """
    v = F.col(value)
    s = df.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))
    rule = 1.06 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    h = F.when(rule > 0, rule).otherwise(F.greatest((F.col("high") - F.col("low")) / 20, 0.05 * F.abs("mean"), F.lit(0.05)))
    s = s.withColumn("h", h).withColumn("start", F.greatest(F.lit(0.0), F.col("low") - 3 * F.col("h"))).withColumn("step", (F.col("high") + 3 * F.col("h") - F.col("start")) / (points - 1))
    counts = df.where(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count("*").alias("many"))
    met = band_points(with_group(counts, s, by), points)
    x = F.col("start") + F.col("k") * F.col("step")
    sums = met.groupBy(*by, "k").agg(F.sum(F.col("many") * F.exp(-F.pow((x - F.col("v")) / F.col("h"), 2) / 2)).alias("sum"))
    grid = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return with_group(grid, sums, [*by, "k"], "left").select(*by, "k", x.alias("x"), (F.coalesce("sum", F.lit(0.0)) / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


#: A value further than so many bandwidths from a grid point adds less than exp(-32), 1.3e-14 of its own peak, and is left out.
BAND = 8


def band_points(values: DataFrame, points: int) -> DataFrame:
    """values (v, h, start, step) with each grid point k that is within BAND bandwidths of v."""
    edge = lambda sign: (F.col("v") + sign * BAND * F.col("h") - F.col("start")) / F.col("step")
    low, high = F.greatest(F.ceil(edge(-1)), F.lit(0)).cast("int"), F.least(F.floor(edge(1)), F.lit(points - 1)).cast("int")
    return values.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("k", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def spot_summary(cells: DataFrame, spots: DataFrame) -> DataFrame:
    """One row on all cells: analysed, skipped and positive ones, spots, cells at the cap, spots without a lateral place."""
    ok = F.col("status") == "ok"
    per = spots.groupBy("dbname", "cell_id").agg(F.count("*").alias("spots"), F.count(F.when(F.col("lateral_at").isNull(), 1)).alias("unmapped"))
    j = cells.join(per, ["dbname", "cell_id"], "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return j.agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("analysed"), F.count(F.when(~ok, 1)).alias("skipped"), F.count(F.when(ok & (F.col("spots") > 0), 1)).alias("positive"), zero("spots").alias("spots"), F.count(F.when(F.col("at_cap"), 1)).alias("at_cap"), zero("unmapped").alias("unmapped"))


def position_bins(spots: DataFrame, cells: DataFrame, axis: str = "nearest_pole", n: int = 20) -> DataFrame:
    """Percent of ok cells (spotless ones too) with a spot in each bin, and spots."""
    top = 0.5 if axis == "nearest_pole" else 1.0
    ok = cells.where("status = 'ok'").select("dbname", "cell_id")
    at = spots.join(ok, ["dbname", "cell_id"]).withColumn("bin", F.least(F.floor(F.col(axis) / top * n), F.lit(n - 1)).cast("long"))
    got = at.groupBy("bin").agg(F.count_distinct("dbname", "cell_id").alias("cells"), F.count("*").alias("spots"))
    grid = spots.sparkSession.range(n).withColumnRenamed("id", "bin")
    return grid.join(F.broadcast(ok.agg(F.count("*").alias("all_cells")))).join(got, "bin", "left").select("bin", (100.0 * F.coalesce("cells", F.lit(0)) / F.col("all_cells")).alias("percent"), F.coalesce("spots", F.lit(0)).alias("spots"))


def trap_cell_rows(labels: DataFrame) -> DataFrame:
    """Per (view, roi, frame, label): area, centre, box (ends exclusive), mean, and a label that runs on over the ROIs of a (view, frame)."""
    g = labels.groupBy("view", "roi", "frame", "label").agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("intensity").alias("mean_intensity")
    )
    return g.withColumn("global_label", F.row_number().over(Window.partitionBy("view", "frame").orderBy("roi", "label")))


def cells_per_frame(cells: DataFrame, frames: DataFrame) -> DataFrame:
    n = cells.groupBy("view", "roi", "frame").agg(F.count("*").alias("cells"))
    return frames.join(n, ["view", "roi", "frame"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def training_progress(frames: DataFrame, by: list[str]) -> DataFrame:
    """Total, reviewed, percent, completed, and the cursor: the first frame to review, else the last."""
    done = F.col("status") == "reviewed"
    g = frames.groupBy(*by).agg(F.count("*").alias("total"), F.count(F.when(done, 1)).alias("reviewed"), F.coalesce(F.min(F.when(~done, F.col("order_index"))), F.max("order_index")).alias("cursor"))
    return g.withColumn("percent", F.round(100 * F.col("reviewed") / F.col("total")).cast("long")).withColumn("completed", F.col("reviewed") == F.col("total"))


def region_quantiles(px: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("intensity")
    qs = [(f"p{p}", p / 100) for p in (10, 25, 50, 75, 90)]
    return px.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), *(F.percentile(v, p).alias(n) for n, p in qs), F.max(v).alias("high"))


def classification_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y", call: str = "call") -> DataFrame:
    """Counts and rates of calls (0 or 1) against truth; 0 where a denominator is."""
    is_ = lambda a, b: F.sum(((F.col(y) == a) & (F.col(call) == b)).cast("long"))
    g = df.groupBy(*(by or [])).agg(is_(1, 1).alias("tp"), is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"))
    return _rates(g)


def _rates(g: DataFrame) -> DataFrame:
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall, specific = div(tp, tp + fn), div(tn, tn + fp)
    return g.withColumns({"accuracy": div(tp + tn, tp + tn + fp + fn), "precision": div(tp, tp + fp), "recall": recall, "specificity": specific, "f1": div(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + specific) / 2})


def threshold_search(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y", steps: int = 121, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """The best cut-off of the grid by f1, balanced accuracy, accuracy and few false positives; the lowest wins ties.

    Scores become their place in the grid first, so work is one aggregation and 121 rows a group.
    """
    by = by or []
    width = (high - low) / (steps - 1)
    place = F.least(F.greatest(F.floor((F.col(score) - low) / width + 1e-9), F.lit(-1)), F.lit(steps - 1)).cast("int")
    counts = df.groupBy(*by, place.alias("place")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) == 0).cast("long")).alias("n"))
    grid = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.collect_list(F.struct("place", "p", "n")).alias("c")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    over = lambda f: F.expr(f"aggregate(c, 0L, (s, e) -> s + if(e.place >= k, e.{f}, 0L))")
    g = grid.withColumns({"tp": over("p"), "fp": over("n")}).withColumns({"fn": F.col("all_p") - F.col("tp"), "tn": F.col("all_n") - F.col("fp")})
    g = _rates(g.select(*by, F.round(low + F.col("k") * width, 6).alias("threshold"), "tp", "tn", "fp", "fn"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), F.desc("balanced_accuracy"), F.desc("accuracy"), "fp", "threshold"))
    return g.withColumn("rank", rank).where("rank = 1").drop("rank")


def robust_scaler(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(value - median) / interquartile range (else the deviation, else 1), clipped to 12."""
    q = quantiles(df, value, by, QUARTILES).select(*by, F.col("median").alias("_centre"), (F.col("q3") - F.col("q1")).alias("_iqr"))
    s = with_group(df.groupBy(*by).agg(F.stddev_pop(value).alias("_sd")), q, by, "left")
    scale = F.when(F.col("_iqr") > 1e-12, F.col("_iqr")).when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0)
    z = (F.col(value) - F.col("_centre")) / scale
    return with_group(df, s, by).withColumn("scaled", F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))).drop("_centre", "_iqr", "_sd")
