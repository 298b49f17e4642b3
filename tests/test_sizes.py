"""What stays small as the tables grow: no plan copies tables of the input's size, whatever Spark takes their size for."""

import pytest


def plan_of(df) -> str:
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def caught(monkeypatch, module, name: str) -> list:
    """The tables that a module's function is called with."""
    seen, own = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *more, **named: seen.append(df) or own(df, *more, **named))
    return seen


def test_tiles_are_united_without_broadcasts(spark, monkeypatch):
    from cytospark.operators import graph, tiles

    rows = [(f, 4, 6, [1, 1, 0, 0, 2, 2] * 4) for f in range(5)]
    frames = spark.createDataFrame(rows, "frame long, height int, width int, mask array<int>")
    pairs, steps = caught(monkeypatch, tiles, "components"), caught(monkeypatch, graph, "written")
    out = tiles.tiled_components(tiles.cut_frames(frames, ["frame"], 3, 2, "mask"), ["frame"])
    for df in (out, pairs[0], *steps):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert {(r["x"] // 4, r["component"]) for r in out.collect()} == {(0, 1), (1, 2)}
    assert out.count() == 5 * 16


def near_texts(spark):
    """Three groups of near copies, one text twice, a line that all sources share, and texts of their own."""
    text = lambda g, n: " ".join(f"g{g}w{k}" for k in range(80)) + f" n{n}\nread more on this site"
    rows = [(k, text(k % 3, k), "en", f"s{k}", 0) for k in range(30)] + [(30, text(0, 0), "en", "s0", 0)]
    return spark.createDataFrame(rows + [(k, text(k, k), "en", "s1", 0) for k in range(40, 50)], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_are_found_without_broadcasts(spark, monkeypatch):
    """Spark takes a list of 24 keys for 8 bytes, and so keys that are counted for the smaller side of a join."""
    from cytospark.llm import near_dedup, ngram_join
    from cytospark.operators import ordering

    monkeypatch.setattr(ordering, "MOST_COPIED", -1, raising=False)
    seen = caught(monkeypatch, near_dedup, "written"), caught(monkeypatch, ngram_join, "written")
    out = near_dedup.near_copies(near_texts(spark))
    steps = [out, *seen[0], *seen[1]]
    assert len(steps) > 15
    for df in steps:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert {r["component_id"] for r in out.collect()} == {0, 1, 2, *range(40, 50)}


def test_stages_of_the_pipeline_join_without_broadcasts(spark, monkeypatch):
    from cytospark.llm import line_dedup, ngram_join
    from cytospark.operators import ordering

    monkeypatch.setattr(ordering, "MOST_COPIED", -1, raising=False)
    seen = caught(monkeypatch, line_dedup, "written"), caught(monkeypatch, ngram_join, "written")
    docs = near_texts(spark)
    lines, kept = line_dedup.without_boilerplate(docs), ngram_join.keep_one(docs)
    assert len(seen[0]) > 4 and len(seen[1]) > 7
    for df in (lines, kept, *seen[0], *seen[1]):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, *range(40, 50)}
    assert {r["n_removed"] for r in lines.where("doc_id > 0").collect()} == {1}


def test_tiles_meet_their_frames_range_and_are_not_copied_for_it(spark, monkeypatch):
    from cytospark.operators import tiles

    rows = [(1, 4, 6, [0.0, 0.0, 9.0, 9.0, 0.0, 0.0] * 4), (2, 4, 6, [5.0] * 24)]
    frames = spark.createDataFrame(rows, "frame long, height int, width int, pixels array<double>")
    seen = caught(monkeypatch, tiles, "_labelled")
    out = tiles.segment_tiles(tiles.cut_frames(frames, ["frame"], 3, 2, "pixels"), ["frame"])
    assert "LeftOuter" in seen[0]._jdf.queryExecution().sparkPlan().toString()  # whose left side is never broadcast
    assert [tuple(r) for r in out.orderBy("component").collect()] == [(1, 1, 8, 0.5, 1.5), (1, 2, 8, 4.5, 1.5)]


def test_frames_are_never_copied_to_meet_rows(spark):
    """Spark takes arrays that a plan makes for 8 bytes each, and so frames for the smaller side of a join."""
    from pyspark.sql import functions as F

    from cytospark.operators import cells

    def frames(views: int):
        f = spark.range(views).select((F.col("id") % views).alias("view"), F.lit(0).cast("long").alias("frame"), F.lit(12).alias("height"), F.lit(40).alias("width"))
        return f.repartition(4, "view").withColumn("pixels", F.expr("transform(sequence(0, 479), i -> double(i % 40 * 1000 + i div 40))"))

    joined = lambda views: cells.drift(frames(views))
    few, many = (joined(n)._jdf.queryExecution().sparkPlan().toString() for n in (3, cells.MOST_COPIED + 1))
    assert "BuildRight" in few and "BuildLeft" not in few
    assert "BroadcastHashJoin" not in many and "SortMergeJoin" in many
    assert {(r["dx"], r["dy"]) for r in joined(3).collect()} == {(0, 0)}


def test_crops_go_to_frames_and_not_the_other_way(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cytospark.operators import cells

    f = spark.range(3).select(F.col("id").alias("frame"), F.lit(60).alias("height"), F.lit(120).alias("width"))
    f = f.repartition(4, "frame").withColumn("pixels", F.expr("transform(sequence(0, 7199), i -> if(abs(i % 120 - 40) <= 8 and abs(i div 120 - 30) <= 4, 0D, 60000D))"))
    seen = caught(monkeypatch, cells, "each_row")
    out = cells.cells_of_frames(f, ["frame"], 0.13, size=24, low=24, high=60)
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(cells, "MOST_COPIED", 2)
    cells.cells_of_frames(f, ["frame"], 0.13, size=24, low=24, high=60)
    assert "SortMergeJoin" in seen[1]._jdf.queryExecution().sparkPlan().toString()
    assert [(r["frame"], r["area"], r["crop_cx"]) for r in out.orderBy("frame").collect()] == [(k, 153, 12.0) for k in range(3)]


def test_many_masks_are_labelled_in_one_pass():
    import numpy as np

    from cytospark.functions import geometry as G

    masks = np.random.default_rng(5).integers(0, 3, (40, 7, 13))
    many = G.components_of_many(masks)
    for mask, labels in zip(masks, many):
        want, seen = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if not want[y, x]:
                seen += 1
                todo = [(y, x)]
                while todo:
                    b, a = todo.pop()
                    if 0 <= b < 7 and 0 <= a < 13 and not want[b, a] and mask[b, a] == mask[y, x]:
                        want[b, a] = seen
                        todo += [(b + j, a + i) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (labels == want).all()


def test_an_outline_is_measured_once_for_all_its_images(monkeypatch):
    from cytospark.functions import geometry as G
    from cytospark.operators import cells

    made, own = [], G.Centerline
    monkeypatch.setattr(G, "Centerline", lambda *a: made.append(a) or own(*a))
    row = {"contour": [{"x": a, "y": b} for a, b in ((2.5, 1.0), (44.0, 1.0), (44.0, 9.0), (2.5, 9.0))], "height": 11, "width": 51, "pixels": list(range(561))}
    for opening in (3, 5, 7):
        cells._map_of(row, 4, 8, 16, opening, False)
    assert len(made) == 1


def test_map_totals_are_those_of_the_maps(spark, sf):
    from pyspark.sql import functions as F

    from cytospark import queries as Q
    from cytospark.operators import cells

    some = Q._fluo1(spark, sf).limit(4).localCheckpoint()
    maps = cells.cell_maps(some, height=16, width=64).select("cell_id", F.array_min("map").alias("low"), F.array_max("map").alias("high"), F.aggregate("map", F.lit(0.0), lambda s, v: s + v).alias("total"))
    assert sorted(map(tuple, cells.cell_map_totals(some, height=16, width=64).select("cell_id", "low", "high", "total").collect())) == sorted(map(tuple, maps.collect()))


def test_profiles_are_made_where_the_images_lie(spark, sf):
    from pyspark.sql import functions as F

    from cytospark import queries as Q
    from cytospark.operators import cells, windows

    some = Q._fluo1(spark, sf).limit(6).localCheckpoint()
    own = cells.cell_profiles(some, digits=6)
    assert "Exchange" not in own._jdf.queryExecution().sparkPlan().toString()
    px = cells.profile_pixels(some)
    turned = px.groupBy("dbname", "cell_id").agg((F.max_by("u", "x") < F.min_by("u", "x")).alias("turned"))
    px = px.join(turned, ["dbname", "cell_id"]).withColumn("u", F.round(F.when(F.col("turned"), 1 - F.col("u")).otherwise(F.col("u")), 6))
    want = {(r["dbname"], r["cell_id"]): (r["u1"], r["g"]) for r in windows.profile_bins(px, ["dbname", "cell_id"]).collect()}
    assert {(r["dbname"], r["cell_id"]): (r["u1"], r["g"]) for r in own.collect()} == want


def test_a_task_of_a_neighbour_join_holds_few_visits(spark, monkeypatch):
    """Queries that visit every cell go once to each site, and few distances to pivots at a time, however many rows a batch has."""
    import numpy as np
    from pyspark.sql import functions as F

    from cytospark.operators import joins

    monkeypatch.setattr(joins, "MOST_HELD", 120)
    r = np.random.default_rng(8)
    points = r.normal(size=(400, 12))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, features array<double>").coalesce(1)
    size = np.full(100, 4)
    q = df.where("id < 60").select(F.col("id").alias("query_id"), "features", F.lit(float("inf")).alias("reach"))
    visits = joins._visited(q, points[300:], size, np.full(100, 1e9), 1, False)
    met = visits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.size("cells")).alias("cells")).collect()
    assert len(met) == 60 and all(r["n"] <= joins.SITES and r["cells"] == 99 for r in met)  # all but the home cell
    steps = [len(part) for part, _ in joins._steps(iter([df.where("id < 60").toPandas()]), points[300:])]
    assert max(steps) == 1 and sum(steps) == 60
    got = joins.knn_join(df.where("id < 60").withColumnRenamed("id", "query_id"), df.where("id >= 60").withColumnRenamed("id", "train_id"), 3, 20, 50)
    d = np.sqrt(((points[:60, None] - points[None, 60:]) ** 2).sum(2))
    assert sorted((x["query_id"], x["rank"], x["train_id"]) for x in got.collect()) == sorted((k, n + 1, int(j) + 60) for k in range(60) for n, j in enumerate(np.argsort(d[k], kind="stable")[:3]))


def test_cells_with_spots_are_dealt_out(spark, sf):
    """Spark drops a step that deals rows out by the key that a join has dealt them by, and merges what is small into one task."""
    from cytospark import queries as Q

    assert "REPARTITION_BY_NUM" in plan_of(Q.QUERIES["j7_detect_spots"](spark, sf))


def test_spots_of_many_images_are_those_of_each(spark):
    """Images are searched together where their masks call for the same widths; a dark, an empty and an unfinite one among them."""
    import numpy as np

    from cytospark.functions import geometry as G
    from cytospark.operators import cells

    r = np.random.default_rng(3)
    y, x = np.mgrid[:40, :120]
    imgs = np.stack([30 + r.normal(size=x.shape) + sum(70 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 8) for a, b in ((25.3, 18.1), (60.2, 16.8), (95.1, 17.6))[: k % 4]) for k in range(12)])
    imgs[5, 20, 30] = np.nan
    boxes = [(4 + k % 3, 5, 115, 35 - k % 3 * 4) for k in range(12)]
    masks = [(x >= a) & (x <= c) & (y >= b) & (y <= d) for a, b, c, d in boxes]
    masks[7] = np.zeros_like(masks[7])
    many = G.spots_of_many(imgs, masks)
    assert many == [G.detect_spots(i, m) for i, m in zip(imgs, masks)] and not many[5] and not many[7]
    assert [len(s) for s in many] == [0, 1, 2, 3, 0, 0, 2, 0, 0, 1, 2, 3]
    rows = [("a", str(k), "f", 40, 120, img.ravel().tolist(), [{"x": float(p), "y": float(q)} for p, q in ((a, b), (c, b), (c, d), (a, d))]) for k, (img, (a, b, c, d)) in enumerate(zip(imgs, boxes)) if k not in (5, 7)]
    df = spark.createDataFrame(rows, "dbname string, cell_id string, channel string, height int, width int, pixels array<double>, contour array<struct<x:double,y:double>>")
    got = {(r["cell_id"], r["spot_id"]): (r["x"], r["y"], r["amplitude"]) for r in cells.detect_spots(df).collect()}
    assert got == {(str(k), n): s[:3] for k, spots in enumerate(many) for n, s in enumerate(spots)}


def test_components_of_traps_are_measured_without_a_pass_each(monkeypatch):
    """Surroundings, rectangles and medians of small shapes by plain definitions; none pads arrays, a shape that comes again isn't measured."""
    import numpy as np

    from cytospark.functions import geometry as G
    from cytospark.operators import cells

    r = np.random.default_rng(4)
    measured, own = [], G.least_rectangle
    monkeypatch.setattr(G, "least_rectangle", lambda p: measured.append(p) or own(p))
    monkeypatch.setattr(np, "pad", None)
    for k in range(30):
        mask = r.random((1 + k % 7, 2 + k % 9)) < 0.4
        wide = np.zeros(mask.shape, bool)
        for y, x in zip(*np.nonzero(mask)):
            wide[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = True
        assert (cells._about(mask, 2) == wide).all()
        if mask.any():
            v = r.integers(0, 256, int(mask.sum())).astype(float)
            assert cells._median(v) == np.median(v)
            y, x = np.nonzero(mask)
            cells._rectangle_of.cache_clear()
            n = len(measured)
            assert cells._rectangle(x, y) == cells._rectangle(x + 5, y + 3) and len(measured) == n + 1
            every = own(np.column_stack([x, y]).astype(float))
            assert abs(np.prod(cells._rectangle(x, y)) - np.prod(every)) < 1e-9


def test_a_cells_spots_are_placed_together():
    """Each as by itself, those without a place among them; lines meet a ring in order and once at its corners."""
    import numpy as np

    from cytospark.functions import geometry as G

    contour = np.array([[4.0, 6.0], [20.0, 5.0], [46.0, 8.0], [46.0, 17.0], [20.0, 14.0], [4.0, 15.0]])
    rod = G.Rod(contour, G.pixels(G.raster(contour, 24, 52)))
    points = np.random.default_rng(2).uniform([0, 0], [52, 24], (60, 2))
    points[7] = np.nan
    many = rod.places(points)
    assert many == [rod.place(p) for p in points]
    assert {why for *_, why in many} == {None, "no local width", "outside the section"}
    square = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]])
    meets = G.crossings(square, np.array([[1.0, 1.0], [0.0, 2.0], [9.0, 9.0]]), np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 1.0]]))
    assert [row[np.isfinite(row)].tolist() for row in meets] == [[-1.0, 3.0], [0.0, 4.0], []]
    corner = G.crossings(square, np.array([[2.0, 2.0]]), np.array([[1.0, 1.0]]))
    assert corner[0, :2].tolist() == [-2.0, 2.0] and not np.isfinite(corner[0, 2:]).any()


def bought(spark, path, rows) -> str:
    """A folder whose lineitem holds these rows: supplier, status, flag, quantity, discount, price."""
    spark.createDataFrame(rows, "l_suppkey long, l_linestatus string, l_returnflag string, l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_images_hold_the_greatest_value_at_each_place(spark, tmp_path):
    import math

    from cytospark import standin

    nan = float("nan")
    rows = [(s, "F", "N", float(s % 51), s % 11 / 100, 10.0 + s) for s in range(400)]  # no supplier has many items
    rows += [(7, "O", "A", 3.0, 0.01, v) for v in [-5.0, None, -2.0]] + [(7, "O", "R", 3.0, 0.01, None), (7, "O", "R", 4.0, 0.01, nan), (7, "O", "R", 4.0, 0.01, 1.0)]
    rows += [(8, "F", "A", 60.0, 0.1, 1.0), (8, None, "A", 2.0, 0.0, 4.0), (None, "F", "A", 2.0, 0.0, 5.0), (9, "F", "A", None, 0.0, 6.0)]
    rows += [(1000, "F", "N", float(k % 51), k // 51 % 11 / 100, float(k)) for k in range(2000)]  # one has most of them
    want = {}
    for s, d, c, q, p, v in rows:
        if q is not None and (at := round(p * 100) * 51 + int(q)) < 561:
            image = want.setdefault((s, d, {"A": "ph", "N": "fluo1", "R": "fluo2"}[c]), {})
            known = [x for x in (image.get(at), v) if x is not None]
            image[at] = nan if any(math.isnan(x) for x in known) else max(known, default=None)
    sf = bought(spark, tmp_path, rows)
    got = {(r["l_suppkey"], r["dbname"], r["channel"]): r["pixels"] for r in standin.images(spark, sf).collect()}
    assert got.keys() == want.keys() and len(got) == 405
    for k, image in want.items():
        assert repr(got[k]) == repr([image.get(at) or 0.0 for at in range(561)])
    for where, of in (("channel = 'ph'", "ph"), ("channel = 'fluo1'", "fluo1")):
        assert {(r["l_suppkey"], r["dbname"]) for r in standin.images(spark, sf, where).collect()} == {(s, d) for s, d, c in want if c == of}
        assert {(r["l_suppkey"], r["dbname"]) for r in standin.outlines(spark, sf, where).collect()} == {(s, d) for s, d, c in want if c == of}


def test_items_are_shuffled_once_for_their_images(spark, tmp_path):
    from cytospark import queries as Q

    sf = bought(spark, tmp_path, [(s, "F", "N", float(s % 51), s % 11 / 100, 10.0 + s) for s in range(400)])
    for name in ("j4_profile_vectors", "j12_regions", "j16_edge_profile"):
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert "max(l_extendedprice" not in plan  # pixels aren't grouped by place, then by image
    plan = Q._fluo1(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parts_of_images_grow_with_their_items(spark, tmp_path, monkeypatch):
    """Whatever the session's number of partitions: a task's items, and so its memory, don't grow with the table."""
    from cytospark import queries as Q
    from cytospark import standin

    sf = bought(spark, tmp_path, [(s, "F", "N", float(s % 51), s % 11 / 100, 10.0 + s) for s in range(400)])
    assert "Exchange hashpartitioning" in (few := Q._fluo1(spark, sf)._jdf.queryExecution().executedPlan().toString()) and ", 4), REPARTITION_BY_COL" in few
    monkeypatch.setattr(standin, "MOST_ITEMS", 40)
    assert ", 11), REPARTITION_BY_NUM" in Q._fluo1(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert Q.QUERIES["j4_profile_vectors"](spark, sf).count() == Q.QUERIES["j12_regions"](spark, sf).select("frame").distinct().count() == 400


def test_components_are_joined_by_runs():
    """Random labels against a flood fill; and a mask that is full costs little more than its answer, which has 8 bytes a pixel."""
    import tracemalloc

    import numpy as np

    from cytospark.functions import geometry as G

    def filled(mask):
        out = np.zeros(mask.shape, int)
        for start in zip(*np.nonzero(mask > 0)):
            todo, n = [start] if not out[start] else [], out.max() + 1
            while todo:
                y, x = at = todo.pop()
                if not out[at]:
                    out[at] = n
                    todo += [(i, j) for i in range(max(y - 1, 0), min(y + 2, len(mask))) for j in range(max(x - 1, 0), min(x + 2, mask.shape[1])) if mask[i, j] == mask[at]]
        return out

    r = np.random.default_rng(5)
    for labels in (1, 1, 2, 3) * 10:
        n, h, w = r.integers(1, 8, 3)
        masks = r.integers(1, labels + 1, (n, h, w)) * (r.random((n, h, w)) < r.random()) - (r.random((n, h, w)) < 0.1)
        assert (G.components_of_many(masks) == [filled(m) for m in masks]).all()
        assert (G.components_of_many(masks > 0) == [filled(m > 0) for m in masks]).all()
    full = np.ones((1, 700, 700), bool)
    tracemalloc.start()
    assert (G.components_of_many(full) == 1).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * full.size


def test_frames_go_to_python_with_what_is_read_of_them(spark, sf):
    from cytospark import queries as Q

    for name, unread in (("j12_regions", ("mask", "view", "roi", "contour")), ("j10_components_of_pixels", ("view", "roi", "contour")), ("j16_edge_profile", ("mask", "contour"))):
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not [c for c in unread if f" AS {c}#" in plan], name
