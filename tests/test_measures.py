"""Drift and tracking, runs of pixels, exact order statistics, nearest neighbours and densities against plain models."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytospark import queries as Q
from cytospark.functions import geometry as G
from cytospark.operators import aggregate as A
from cytospark.operators import cells as C
from cytospark.operators import joins as J
from cytospark.operators import ordering as O
from cytospark.operators import pixel_sets as P
from cytospark.operators import runs as R
from cytospark.operators import select as L
from cytospark.operators import windows as W

# --- shifts, drift, tracking


def shift_by_hand(a, b, start, stop, most):
    start, stop = max(start, most + 2), min(stop, len(a) - most - 2)
    z = lambda v: (v - v.mean()) / (v.std() + 1e-6)
    scores = [round(float(np.mean(z(a[start:stop]) * z(b[start + s : stop + s]))), 9) for s in range(-most, most + 1)]
    return int(np.argmax(scores)) - most


def test_shifts_are_of_each_window(spark):
    """300 random profiles, and constant ones; some are longer than others."""
    r, rows = np.random.default_rng(2), []
    for k in range(300):
        n = int(r.choice([20, 33, 64]))
        a = np.cumsum(r.normal(size=n)) if k % 2 else r.normal(size=n)
        b = np.roll(a, int(r.integers(-4, 5))) * r.uniform(0.5, 3) + r.normal(size=n) * r.choice([0, 0.3, 3])
        rows.append((k, a.tolist(), (b if k % 17 else np.full(n, 3.0)).tolist(), int(r.integers(0, 6)), n - int(r.integers(0, 6)), int(r.integers(1, 5))))
    df = spark.createDataFrame(rows, "id int, reference array<double>, current array<double>, a int, b int, m int")
    got = {x["id"]: x["shift"] for x in W.best_shift(df, "m", "a", "b").collect()}
    assert got == {k: shift_by_hand(np.array(a), np.array(b), lo, hi, m) for k, a, b, lo, hi, m in rows}


def walls(h, w, dx, dy):
    """A frame with edges across and walls down it, moved as a whole."""
    y, x = np.mgrid[0:h, 0:w]
    x, y = x - dx, y - dy
    img = np.full((h, w), 200.0)
    img[(x > w * 0.8) & (x < w * 0.9)] = 40
    img[(x < w * 0.1) & (y > h * 0.2) & (y < h * 0.5)] = 90
    img[(x > w * 0.4) & (x < w * 0.6) & (y > h * 0.3) & (y < h * 0.6)] = 130
    return img * 257


def test_drift_is_found_down_and_across(spark):
    moves = [(0, 0), (2, -1), (-2, 2), (1, 1), (0, -2)]
    f = [(v, t, 60 + 40 * v, 90, walls(60 + 40 * v, 90, *m).ravel().tolist()) for v in range(3) for t, m in enumerate(moves)]
    got = C.drift(spark.createDataFrame(f, "view long, frame long, height int, width int, pixels array<double>")).collect()
    assert {(r["view"], r["frame"]): (r["dx"], r["dy"]) for r in got} == {(v, t): m for v in range(3) for t, m in enumerate(moves)}


def test_blur_is_a_gaussian_with_mirrored_borders():
    img = np.random.default_rng(0).integers(0, 256, (30, 25)).astype(float)
    k = np.exp(-0.5 * (np.arange(-9, 10) / 3) ** 2)
    k, wide = k / k.sum(), np.pad(img, 9, mode="reflect")
    want = [[(wide[y : y + 19, x : x + 19] * np.outer(k, k)).sum() for x in range(25)] for y in range(30)]
    assert np.abs(G.blurred(img) - want).max() <= 0.5 + 1e-6
    assert (G.blurred(np.full((4, 5), 7.0)) == 7).all()


def tracked_by_hand(film, rois, rules, drift):
    """Rows of traps by whole-frame label images, one frame after the other."""
    rows, last = [], {}
    for view, frame, h, w, px in sorted(film):
        img = np.rint(np.clip(np.array(px), 0, 65535).reshape(h, w) * (255 / 65535))
        span = np.ptp(img)
        region = G.components(np.floor((img - img.min()) / span * 255) < 130) if span > 0 else np.zeros((h, w), int)
        dx, dy = drift[view, frame]
        for v, roi, x0, y0, x1, y1 in rois:
            if v != view:
                continue
            x0, x1, y0, y1 = (int(np.clip(c, 0, top)) for c, top in ((x0 + dx, w), (x1 + dx, w), (y0 + dy, h), (y1 + dy, h)))
            margin = min(rules.side_margin, max(0, (x1 - x0 - 1) // 2))
            inside = np.zeros((h, w), bool)
            inside[y0:y1, x0 + margin : x1 - margin] = True
            before = last.get((view, roi))
            old = {}
            if before and before[0] == frame - 1:
                sx, sy = dx - before[2][0], dy - before[2][1]
                for k, m in before[1].items():
                    ys, xs = np.nonzero(m)
                    ok = (ys + sy >= 0) & (ys + sy < h) & (xs + sx >= 0) & (xs + sx < w)
                    old[k] = np.zeros((h, w), bool)
                    old[k][ys[ok] + sy, xs[ok] + sx] = True
            disk = P.ellipse(2 * rules.radius + 1)
            grown = {k: np.any([G.shifted(m, i, j, False) for i, j in disk], axis=0) for k, m in old.items()}
            now = {}
            for whole in np.unique(region[inside & (region > 0)]).tolist():
                parts = G.components(inside & (region == whole))
                for k in range(1, parts.max() + 1):
                    m = parts == k
                    area, full = int(m.sum()), int((region[y0:y1] == whole).sum())
                    ys, xs = np.nonzero(m)
                    minor, major = G.least_rectangle(np.column_stack([xs, ys]).astype(float))
                    near = np.any([G.shifted(m, i, j, False) for i in range(-4, 5) for j in range(-4, 5)], axis=0) & inside & (region == 0)
                    contrast = np.median(img[near]) - img[m].mean() if near.any() else -np.inf
                    long = major / max(minor, 1)

                    def fits(s, mean, least):
                        return rules.min_area / s <= area <= rules.max_area * s and rules.min_minor / s <= minor <= rules.max_minor * s and rules.min_major / s <= major <= rules.max_major * s and (max(1, rules.min_elongation / s) if s > 1 else rules.min_elongation) <= long <= rules.max_elongation * s and img[m].mean() < mean and img[m].min() < rules.max_least and contrast >= least

                    assert area <= full
                    strict = fits(1, rules.max_mean, rules.min_contrast)
                    cover = np.any(list(grown.values()), axis=0) & m if grown else np.zeros_like(m)
                    relaxed = rules.recovery and bool(grown) and fits(rules.scale, rules.max_mean + rules.mean_margin, rules.min_contrast * rules.contrast_scale) and cover.sum() / area >= rules.min_overlap
                    if not strict and not relaxed:
                        continue
                    pieces = [m]
                    if not strict:
                        match = [i for i in sorted(old) if (grown[i] & m).sum() >= max(8, round(area * 0.02))]
                        if len(match) > 1:
                            far = np.stack([[min((ys_ - y) ** 2 + (xs_ - x) ** 2 for ys_, xs_ in zip(*np.nonzero(old[i]))) for y, x in zip(ys, xs)] for i in match])
                            which = far.argmin(0)
                            cut = []
                            for i in range(len(match)):
                                if (which == i).sum() >= max(80, round(rules.min_area / rules.scale)):
                                    p = np.zeros_like(m)
                                    p[ys[which == i], xs[which == i]] = True
                                    cut.append(p)
                            pieces = cut or pieces
                    for p in pieces:
                        now[len(now) + 1] = p
                        ys, xs = np.nonzero(p)
                        rows.append((view, roi, frame, len(now), len(xs), round(xs.mean(), 6), round(ys.mean(), 6), int(xs.min()), int(xs.max()) + 1, round(img[p].mean(), 6), not strict))
            last[view, roi] = (frame, now, (dx, dy))
    return sorted(rows)


def test_traps_of_the_tables_pixels_by_hand(spark, sf):
    film = [tuple(r) for r in Q._film(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.greatest(65535 - v, F.lit(0.0)))).select("view", "frame", "height", "width", "pixels").collect()]
    drift = {(r["view"], r["frame"]): (r["dx"], r["dy"]) for r in C.drift(spark.createDataFrame(film, "view long, frame long, height int, width int, pixels array<double>")).collect()}
    rois = [(v, k, *box) for v in {f[0] for f in film} for k, box in enumerate([(0, 0, 26, 11), (26, 0, 51, 11)])]
    got = sorted((r["view"], r["roi"], r["frame"], r["label"], r["area"], round(r["cx"], 6), round(r["cy"], 6), r["x0"], r["x1"], round(r["mean_intensity"], 6), r["temporal_recovery"]) for r in Q.QUERIES["j21_traps_of_pixels"](spark, sf).collect())
    want = tracked_by_hand(film, rois, Q.SMALL_CELLS, drift)
    assert got == want and any(r[-1] for r in got)


def parts_of(n, size, view=1):
    """n frames with two cells each, the second of which is relaxed in odd frames, as `track_traps` hands them on."""
    for t in range(n):
        for k, (x, y) in enumerate([(20 + t % 3, 10), (20 + t % 2, 40)], 1):
            xs, ys = np.meshgrid(np.arange(x, x + 12), np.arange(y, y + 9))
            yield {"view": view, "roi": 0, "frame": t, "component": k, "strict": k == 1 or t % 2 == 0, "dx": 0, "dy": 0, "width": 100, "pixels": (ys * 100 + xs).ravel(), "light": np.full(xs.size, 50)}


def batches(rows, size):
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pd.DataFrame(part)
            part = []
    if part:
        yield pd.DataFrame(part)


def test_memory_of_a_long_film_is_that_of_two_frames():
    """10,000 frames take no more than 1,000, and batches of any size, which cut frames anywhere, give the same rows."""
    rules, peaks = L.TrapRules(recovery=True), []
    for n in (1000, 10_000):
        tracemalloc.start()
        rows = sum(len(pdf) for pdf in C.followed(batches(parts_of(n, 7), 7), rules))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == 2 * n
    assert peaks[1] < 1.5 * peaks[0] + 200_000
    films = lambda: (r for v in (1, 2) for r in parts_of(9, 0, v))
    tables = [pd.concat(C.followed(batches(films(), size), rules), ignore_index=True) for size in (1, 2, 3, 1000)]
    assert all(t.equals(tables[0]) for t in tables) and len(tables[0]) == 36 and tables[0]["temporal_recovery"].sum() == 8


# --- runs of pixels


def mask_rows(masks):
    return [(k, x, y) for k, m in masks.items() for y, x in zip(*(v.tolist() for v in np.nonzero(m)))]


@pytest.mark.parametrize("kernel", [P.SQUARE, P.ellipse(7), P.ellipse(17), [(i, j) for i, j in P.SQUARE if not i or not j], [(0, 0), (1, 0), (2, 0), (0, 1)]])
def test_runs_are_the_sets_of_pixels(spark, kernel):
    r = np.random.default_rng(len(kernel))
    masks = {k: r.random((13, 29)) < p for k, p in enumerate((0.02, 0.3, 0.7, 0.97, 1.0))}
    df = spark.createDataFrame(mask_rows(masks) * 2, "m int, x int, y int")
    have = lambda d: {(x["m"], x["x"], x["y"]) for x in d.collect()}
    rows = R.runs_of(df, ["m"]).collect()
    assert len({(x["m"], x["y"], c) for x in rows for c in range(x["x0"], x["x1"] + 1)}) == sum(m.sum() for m in masks.values())
    grown = {k: np.any([G.shifted(m, -i, -j, False) for i, j in kernel], axis=0) for k, m in masks.items()}
    shrunk = {k: np.all([G.shifted(m, i, j, True) for i, j in kernel], axis=0) for k, m in masks.items()}
    assert have(P.dilate(df, kernel, ["m"], 29, 13)) == set(mask_rows(grown))
    assert have(P.erode(df, kernel, ["m"], 29, 13)) == set(mask_rows(shrunk))


def test_runs_not_pixels_are_shuffled_for_overlaps(spark):
    """At radius 8 the last frame's labels cost a run a kernel row, not 197 copies of each pixel."""
    px = spark.createDataFrame([(0, t, 1, x, y) for t in (0, 1) for x in range(100) for y in range(20)], "view long, frame long, label long, x int, y int")
    got = J.temporal_overlap(px, px, 8).collect()
    assert {(r["frame"], r["overlap"], tuple(r["parents"])) for r in got} == {(0, 0.0, ()), (1, 1.0, (1,))}
    before = R.runs_of(px.where("frame = 0"), ["view", "frame", "label"])
    assert before.count() == 20 and R.dilate(before, P.ellipse(17), ["view", "frame", "label"]).count() == 36


# --- exact order statistics, densities, groups


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False), st.sampled_from([0.0, -0.0, 1.0, 5e-324, -5e-324, 1e308, -1e308]), st.integers(-3, 3).map(float))), max_size=60), st.sampled_from([1, 3, 1000]))
def test_selection_is_the_sorted_place(spark, rows, slice_rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["total"], r["low"], r["mid"], r["high"]) for r in O.selected(df, "v", ["g"], lambda n: {"low": F.lit(0), "mid": F.floor(n / 2), "high": n - 1}, slice_rows).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = (len(own), own[0], own[len(own) // 2], own[-1])
    assert got == want


def test_quantiles_in_few_passes_without_sorting(spark):
    r = np.random.default_rng(7)
    values = np.concatenate([r.normal(size=3000), r.normal(size=3000) * 1e-9 + 5, np.full(500, 2.5), r.lognormal(0, 20, 500), [float("inf"), float("-inf")]])
    df = spark.createDataFrame([(None if k % 3 else "g", float(v)) for k, v in enumerate(values)], "g string, v double")
    for slice_rows in (10, 1_000_000):
        got = O.selected(df, "v", ["g"], lambda n: {str(k): F.floor((n - 1) * k / 20) for k in range(21)}, slice_rows)
        for row in got.collect():
            own = np.sort(values[[k for k in range(len(values)) if (None if k % 3 else "g") == row["g"]]])
            assert [row[str(k)] for k in range(21)] == [own[int((len(own) - 1) * k / 20)] for k in range(21)]
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    top = O.selected(nan, "v", [], lambda n: {"a": n - 1, "b": n - 2}).first()
    assert np.isnan(top["a"]) and top["b"] == float("inf")
    assert O.quantiles(nan.limit(0), "v", [], {"a": 0.5}).count() == 0


def test_null_groups_stay(spark):
    rows = [(g, float(v)) for g in ("a", None) for v in (1, 2, 3, 4, 50)]
    df = spark.createDataFrame(rows, "g string, v double")
    five = {r["g"]: tuple(r)[1:] for r in A.five_number(df, "v", ["g"]).collect()}
    assert five == {g: (2.0, 3.0, 4.0, 1.0, 4.0) for g in ("a", None)}
    for rule in ("values", "intensities"):
        h = A.histogram(df, "v", ["g"], rule).collect()
        assert {g: sum(r["count"] for r in h if r["g"] == g) for g in ("a", None)} == {"a": 5, None: 5}
    d = A.kde(df, "v", ["g"]).collect()
    assert sorted((r["k"], round(r["density"], 12)) for r in d if r["g"] == "a") == sorted((r["k"], round(r["density"], 12)) for r in d if r["g"] is None) and len(d) == 400
    scaled = A.robust_scaler(df, "v", ["g"]).collect()
    assert sorted(r["scaled"] for r in scaled if r["g"] is None) == sorted(r["scaled"] for r in scaled if r["g"] == "a") and len(scaled) == 10
    summary = {r["g"]: (r["total"], r["median"]) for r in A.metric_summary(df, "v", ["g"]).collect()}
    assert summary == {"a": (5, 3.0), None: (5, 3.0)}


def test_density_in_a_band_is_the_full_sum(spark):
    v = np.random.default_rng(5).lognormal(2, 0.6, 4000)
    df = spark.createDataFrame([("x", float(a)) for a in v], "g string, v double")
    got = {r["k"]: (r["x"], r["density"]) for r in A.kde(df, "v", ["g"]).collect()}
    h = 1.06 * v.std() * len(v) ** -0.2
    grid = np.linspace(max(0, v.min() - 3 * h), v.max() + 3 * h, 200)
    want = np.exp(-(((grid[:, None] - v[None]) / h) ** 2) / 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.allclose([got[k][0] for k in range(200)], grid) and np.abs([got[k][1] for k in range(200)] - want).max() < 1e-9
    s = df.select("v", F.lit(float(h)).alias("h"), F.lit(float(grid[0])).alias("start"), F.lit(float(grid[1] - grid[0])).alias("step"))
    met = A.band_points(s, 200).count()
    assert met < 0.5 * 200 * len(v)


def test_error_without_a_finite_value(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 0.5)], "g string, v double")
    with pytest.raises(Exception, match="no finite value"):
        A.fraction_below(df.where("g = 'a'"), "v").collect()
    assert [tuple(r) for r in A.fraction_below(df, "v", keys=["g"]).collect()] == [("b", 1.0, 1, 1)]


def test_last_of_several_edits_wins(spark):
    c = spark.createDataFrame([("a", "F0C0", None), ("a", "F0C1", "x")], "dbname string, cell_id string, manual_label string")
    u = spark.createDataFrame([("a", "F0C0", 2, "007"), ("a", "F0C0", 1, "q"), ("a", "F0C0", 1, "z"), ("a", "F9C9", 1, "q"), ("a", "F9C9", 2, "r")], "dbname string, cell_id string, at int, new_label string")
    new, unknown = J.apply_label_updates(c, u, ["at"])
    assert sorted((r["cell_id"], r["manual_label"]) for r in new.collect()) == [("F0C0", "7"), ("F0C1", "x")]
    assert [tuple(r)[:3] for r in unknown.collect()] == [("a", "F9C9", "r")]
    big = J.apply_label_updates(c, u.where("at = 2 and cell_id = 'F0C0'").withColumn("new_label", F.lit("000123456789012345678901234567890")))[0]
    assert {r["manual_label"] for r in big.collect()} == {"123456789012345678901234567890", "x"}


# --- nearest neighbours


def nearest_by_hand(q, t, k):
    out = []
    for i, x in q:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in t)[:k]
        out += [(i, r + 1, j) for r, (_, j) in enumerate(d)]
    return sorted(out)


def test_neighbours_with_pivots_are_exact(spark):
    """Clusters with copies and ties: few distances are taken, and a cell with most of the rows is cut in blocks."""
    r = random.Random(6)
    centres = [[r.uniform(-50, 50) for _ in range(5)] for _ in range(12)]
    point = lambda c: [round(x + r.choice([0, 0, 1, -1, 2]) * 0.5, 3) for x in centres[c]]
    t = [(k, point(0 if k % 3 == 0 else r.randrange(12))) for k in range(1500)]
    q = [(k, point(r.randrange(12))) for k in range(60)] + [(100, [0.0] * 5), (101, t[7][1])]
    qd, td = spark.createDataFrame(q, "query_id long, features array<double>"), spark.createDataFrame(t, "train_id long, features array<double>")
    for k, pivots, block in ((4, 1024, 8192), (4, 1024, 100), (7, 3, 50), (1, 1, 8192)):
        got = sorted((x["query_id"], x["rank"], x["train_id"]) for x in J.knn_join(qd, td, k, pivots, block).collect())
        assert got == nearest_by_hand(q, t, k)
    taken = J.knn_visits(qd, td, 4).agg(F.sum("compared").alias("n")).first()["n"]
    assert taken < 0.35 * len(q) * len(t)
    few = J.knn_join(qd, td.where("train_id < 3"), 5).collect()
    assert len(few) == 3 * len(q) and J.knn_join(qd, td.limit(0), 5).count() == 0
