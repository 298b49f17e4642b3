"""Queries over the given tables, one or more for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import aggregate as A
from .operators import annotator
from .operators import cells as C
from .operators import joins as J
from .operators import pixel_sets as P
from .operators import select as L
from .operators import tiles as T
from .operators import windows as W
from .sources import profiles_csv, sqlite_cells, tables
from .plans import phenotype
from .operators.ordering import scratch, written
from .standin import frames, images, items, oracle, outlines, profiles, view
from .streaming import activity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, rounded: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query; doubles named in ``rounded`` are rounded in both."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) + 0.0 for c in rounded.split()}) if rounded else df

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = oracle(sql, rounded, digits)
        return f

    return register


K3, K2 = ["dbname", "cell_id", "channel"], ["dbname", "cell_id"]

# --- sources and labels ---------------------------------------------------------------------------


@query("SELECT dbname, cell_id, area FROM cells WHERE area > 100000")
def a1_read_cells(spark, sf):
    return view(spark, sf, "cells").where("area > 100000").select("dbname", "cell_id", "area")


@query("SELECT dbname, cell_id, manual_label, area, pixel_size_um FROM cells WHERE area > 1000")
def a1_sqlite_cells(spark, sf):
    """All cells as SQLite files, a few an experiment, and back: by ranges of rows, with the filter in the files' queries."""
    path = scratch(spark, "sqlite")
    sqlite_cells.write_sqlite(view(spark, sf, "cells"), path, 20_000)
    return tables.read_cells(spark, path, "sqlite", ["dbname", "cell_id", "manual_label", "area", "pixel_size_um"], where=[("area", ">", 1000)], rows_a_partition=5000)


@query("SELECT cell_id, CASE WHEN o_orderkey % 4 = 0 THEN '100x' ELSE '60x' END AS objective_magnification, CASE WHEN pixel_size_um <= 0 THEN 0.065 ELSE pixel_size_um END AS pixel_size_um FROM cells", "pixel_size_um")
def a2_migrate_cells(spark, sf):
    old = view(spark, sf, "cells").withColumn("objective_magnification", F.expr("case when o_orderkey % 8 = 0 then ' ' when o_orderkey % 4 = 0 then null else '60x' end"))
    return tables.migrate_cells(old).select("cell_id", "objective_magnification", "pixel_size_um")


@query("SELECT 'orders.parquet' AS dbname, count(*) AS cell_count, false AS failed FROM orders UNION ALL SELECT 'nation.parquet', count(*), false FROM nation UNION ALL SELECT 'missing.parquet', 0, true")
def a3_union_databases(spark, sf):
    _, status = tables.union_databases(spark, [f"{sf}/{n}.parquet" for n in ("orders", "nation", "orders", "missing")])
    return status.select("dbname", "cell_count", F.col("error").isNotNull().alias("failed"))


@query("SELECT dbname, cell_id, CAST(g1 AS DOUBLE) AS g1, CAST(n AS BIGINT) AS n FROM (SELECT dbname, max(cell_id) AS cell_id, count(DISTINCT cell_id) AS n, sum(g) AS g1 FROM profiles GROUP BY dbname)", "g1", 4)
def a5_profiles_csv_round_trip(spark, sf):
    lines = profiles_csv.profile_lines(profiles(spark, sf), 0.1)
    back = profiles_csv.parse_lines(lines).select("dbname", F.aggregate("g", F.lit(0.0), lambda s, v: s + v).alias("g"))
    return back.groupBy("dbname").agg(F.sum("g").alias("g1"), F.count("*").alias("n")).join(profiles(spark, sf).groupBy("dbname").agg(F.max("cell_id").alias("cell_id")), "dbname")


@query("SELECT event_id, CASE WHEN value > 50 THEN round(value, 2) ELSE 0.065 END AS pixel FROM events", "pixel", 4)
def a7_pixel_size(spark, sf):
    text = F.expr("case when value > 50 then concat('# pixel_size_um', if(event_id % 2 = 0, '=', ': '), cast(round(value, 2) as string)) when event_id % 2 = 0 then '# pixel_size_um=-1' else '# none' end")
    return view(spark, sf, "events").select("event_id", profiles_csv.profile_csv_pixel_size(text).alias("pixel"))


@query("SELECT dbname, cell_id, CAST(max(CASE WHEN channel = 'A' THEN 1 ELSE 0 END) AS INT) AS has_ph, CAST(max(CASE WHEN channel = 'N' THEN 1 ELSE 0 END) AS INT) AS has_fluo1, CAST(max(CASE WHEN channel = 'R' THEN 1 ELSE 0 END) AS INT) AS has_fluo2, lpad(CAST(row_number() OVER (PARTITION BY dbname ORDER BY cell_id) - 1 AS STRING), 6, '0') || '_' || cell_id || '.png' AS file_name FROM px GROUP BY dbname, cell_id")
def a11_cells_bundle_manifest(spark, sf):
    images = view(spark, sf, "px").select("dbname", "cell_id", F.expr("case channel when 'A' then 'ph' when 'N' then 'fluo1' else 'fluo2' end").alias("channel"), F.lit(True).alias("present"))
    return tables.cells_bundle_manifest(images)


@query("SELECT dbname, cell_id, CASE WHEN manual_label IS NULL OR upper(trim(manual_label)) IN ('N/A', '1000', '') THEN 'N/A' ELSE trim(manual_label) END AS label, cell_id || '.png' AS file_name FROM cells WHERE o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0")
def a12_annotation_manifest(spark, sf):
    return tables.annotation_manifest(view(spark, sf, "cells").withColumns({"has_image": F.expr("o_orderkey % 5 <> 0"), "has_contour": F.expr("o_custkey % 3 <> 0")}))


@query("SELECT view AS source, roi, frame, count(*) AS cells, CAST(sum(count(*)) OVER (PARTITION BY view, roi) AS BIGINT) AS roi_total, CAST(sum(count(*)) OVER (PARTITION BY view) AS BIGINT) AS total FROM labelled GROUP BY view, roi, frame")
def a10_build_manifest(spark, sf):
    docs = tables.build_manifest(view(spark, sf, "labelled").select(F.col("view").alias("source"), "view", "roi", "frame"))
    schema = "source long, total long, views array<struct<view:long,total:long,channels:array<struct<roi:long,total:long,frames:array<struct<frame:long,cells:long>>>>>>"
    d = docs.select(F.from_json("manifest", schema).alias("d")).select("d.source", "d.total", F.explode("d.views").alias("v")).select("source", "total", F.explode("v.channels").alias("c"))
    return d.select("source", "total", "c.roi", F.col("c.total").alias("roi_total"), F.explode("c.frames").alias("f")).select("source", "roi", "f.frame", "f.cells", "roi_total", "total")


@query("SELECT dbname, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM cells GROUP BY dbname")
def a4_write_cells(spark, sf):
    path = scratch(spark, "cells")
    tables.write_cells(view(spark, sf, "cells"), path)
    return spark.read.parquet(path).groupBy("dbname").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT dbname, cell_id, CASE WHEN manual_label <> '' THEN manual_label END AS manual_label, o_orderkey FROM cells WHERE area > 100000")
def a8_export_csv(spark, sf):
    path = scratch(spark, "csv")
    tables.export_csv(view(spark, sf, "cells").where("area > 100000").select("dbname", "cell_id", "manual_label", "o_orderkey"), path, True)
    return spark.read.csv(path, header=True, schema="dbname string, cell_id string, manual_label string, o_orderkey long", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("SELECT dbname, cell_id, manual_label, manual_label IS NULL AS kept_null FROM cells WHERE area > 100000")
def a9_export_json(spark, sf):
    path = scratch(spark, "json")
    tables.export_json(view(spark, sf, "cells").where("area > 100000").select("dbname", "cell_id", "manual_label"), path)
    lines = spark.read.text(path)
    row = F.from_json("value", "dbname string, cell_id string, manual_label string")
    return lines.select(row.alias("r"), F.contains("value", F.lit('"manual_label":null')).alias("kept_null")).select("r.*", "kept_null")


@query("SELECT dbname, label, count(*) AS n FROM (SELECT dbname, CASE WHEN manual_label IS NULL OR upper(trim(manual_label)) IN ('N/A', '1000', '') THEN 'N/A' ELSE trim(manual_label) END AS label FROM cells) GROUP BY dbname, label")
def b1_d15_label_counts(spark, sf):
    return A.label_counts(view(spark, sf, "cells"))


@query("SELECT dbname, count(*) AS n, count(*) FILTER (l IN ('1', '1.0')) AS ones, count(*) FILTER (l IN ('N/A', 'NA', 'NONE', 'NULL', '0', '1000')) AS zeros FROM (SELECT dbname, upper(trim(manual_label)) AS l FROM cells) GROUP BY dbname")
def d15_source_counts(spark, sf):
    return A.source_counts(view(spark, sf, "cells"))


@query("SELECT 'bulk' AS mode, count(*) FILTER (manual_label IN ('N/A', '1000')) AS na, count(*) FILTER (manual_label = '2') AS two FROM cells UNION ALL SELECT 'phenotype', count(*) FILTER (manual_label IS NULL OR manual_label IN ('N/A', '1000', '')), count(*) FILTER (manual_label = '2') FROM cells UNION ALL SELECT 'exact', count(*) FILTER (manual_label = 'N/A'), count(*) FILTER (manual_label = '2') FROM cells")
def b2_filter_label(spark, sf):
    c, out = view(spark, sf, "cells"), None
    for mode in ("bulk", "phenotype", "exact"):
        n = lambda label: L.filter_label(c, label, mode).agg(F.count("*").alias("n"))  # noqa: B023, E731
        row = n("N/A").select(F.lit(mode).alias("mode"), F.col("n").alias("na")).crossJoin(n("2").withColumnRenamed("n", "two"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT CASE WHEN l IN ('1', '1.0') THEN 1 WHEN l IN ('N/A', 'NA', 'NONE', 'NULL', '0', '1000') THEN 0 END AS y, count(*) AS n FROM (SELECT upper(trim(manual_label)) AS l FROM cells) GROUP BY 1")
def b3_training_label(spark, sf):
    return view(spark, sf, "cells").groupBy(S.training_label(F.col("manual_label")).alias("y")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events", "v")
def b5_finite_or_null(spark, sf):
    text = F.expr("case when event_id % 7 = 0 then 'NaN' when event_id % 5 = 0 then 'abc' when event_id % 3 = 0 then concat('-', cast(value + 1 as string)) else cast(value as string) end")
    return view(spark, sf, "events").select("event_id", S.finite_or_null(text).alias("v"))


@query("SELECT dbname, cell_id, area FROM cells WHERE area > 0 AND manual_label = '1'")
def b6_cell_areas(spark, sf):
    return L.cell_areas(view(spark, sf, "cells"), "1")


@query("SELECT o_orderkey, 300 * power(0.065 / (0.05 + pixel_size_um), 2) AS min_area, CASE WHEN abs(px - 0.065) / 0.065 <= 0.1 THEN '100x' WHEN abs(px - 0.108) / 0.108 <= 0.1 THEN '60x' ELSE 'other' END AS objective FROM (SELECT *, 0.05 + pixel_size_um / 2 AS px FROM cells)", "min_area")
def b7_b8_calibration(spark, sf):
    c = view(spark, sf, "cells")
    return c.select("o_orderkey", S.min_contour_area(0.05 + F.col("pixel_size_um")).alias("min_area"), S.infer_objective(0.05 + F.col("pixel_size_um") / 2, "other").alias("objective"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, area / 100 AS a, o_orderkey % 2000 AS cx, o_custkey % 2000 AS cy, o_orderkey % 9 AS m00 FROM cells) WHERE a >= 300 AND m00 <> 0 AND cx > 400 AND cx < 1700 AND cy > 400 AND cy < 1700")
def b9_filter_candidates(spark, sf):
    r = view(spark, sf, "cells").selectExpr("o_orderkey", "area / 100 as area", "o_orderkey % 2000 as cx", "o_custkey % 2000 as cy", "o_orderkey % 9 as m00", "0.065D as px_um")
    return L.filter_candidates(r).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, area / 100 AS a, o_orderkey % 20 + 90 AS cx, o_custkey % 20 + 90.5 AS cy FROM cells) WHERE a >= 300 AND abs(cx - 100) < 3 AND abs(cy - 100) < 3")
def b9_centred_in_crop(spark, sf):
    r = view(spark, sf, "cells").selectExpr("o_orderkey", "area / 100 as area", "o_orderkey % 20 + 90 as crop_cx", "o_custkey % 20 + 90.5 as crop_cy", "1 as m00", "0.065D as px_um")
    return L.centred_in_crop(r).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 200 <= 120 AND CAST(o_custkey % 100 AS DOUBLE) / 100 > 0.85 THEN '1' ELSE 'N/A' END AS label FROM cells")
def b10_screen_contours(spark, sf):
    c = view(spark, sf, "cells").selectExpr("o_orderkey", "double(o_orderkey % 200) as lambda2", "double(o_custkey % 100) as hull_perimeter", "100D as perimeter")
    return L.screen_contours(c).select("o_orderkey", "label")


_TRAP = "l_quantity * 40 AS area, l_quantity * 42 AS full_area, l_orderkey % 4 AS top, l_partkey % 9 AS \"left\", 20 AS box_height, 20 AS box_width, 24 AS trap_height, 40 AS trap_width, 2 + l_quantity AS minor, (2 + l_quantity) * (1 + l_discount * 60) AS major, l_extendedprice % 250 AS mean, l_extendedprice % 250 / 2 AS least, l_tax * 200 AS contrast, l_suppkey % 3 AS roi, l_linenumber / 20.0 AS overlap"
_SHAPE = "area >= 80 / {k} AND area <= 1800 * {k} AND minor >= 5 / {k} AND minor <= 36 * {k} AND major >= 14 / {k} AND major <= 115 * {k} AND major / greatest(minor, 1) >= {low} AND major / greatest(minor, 1) <= 8 * {k} AND mean < {mean} AND least < 110 AND contrast >= {dark}"
_STRICT, _RELAXED = _SHAPE.format(k="1.0", low=1.25, mean=145, dark=8), _SHAPE.format(k=1.6, low=1.0, mean=185, dark=4)


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN place AND {_STRICT} THEN 'strict' WHEN place AND {_RELAXED} AND overlap >= 0.12 THEN 'recovered' END AS ok FROM (SELECT *, area / full_area >= 0.9 AND (6 + \"left\" + 20) / 40.0 >= 0.7 AND top <> 0 AND top + 20 <> 24 AND NOT (roi = 1 AND top + 20 >= 22) AS place FROM (SELECT l_orderkey, l_linenumber, {_TRAP} FROM lineitem))")
def b11_filter_trap_components(spark, sf):
    rules = L.TrapRules(max_least=110, min_right_edge=0.7, min_contained=0.9, exclude_top=True, exclude_bottom=True, exclude_bottom_rois=(1,), bottom_margin=2, recovery=True)
    df = view(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_TRAP.replace('"left"', "left").split(", "))
    return df.select("l_orderkey", "l_linenumber", L.trap_verdict(rules, F.col("overlap")).alias("ok"))


_MODES = ("single", "dual", "dual_reversed", "triple", "quad")


@query("WITH r(mode, i, layer) AS (VALUES ('single', 0, 'ph'), ('dual', 0, 'ph'), ('dual', 1, 'fluo1'), ('dual_reversed', 0, 'fluo1'), ('dual_reversed', 1, 'ph'), ('triple', 0, 'ph'), ('triple', 1, 'fluo1'), ('triple', 2, 'fluo2'), ('quad', 0, 'ph'), ('quad', 1, 'fluo1'), ('quad', 2, 'fluo2')), m AS (SELECT l_orderkey, l_linenumber % 4 AS i, (['single', 'dual', 'dual_reversed', 'triple', 'quad'])[1 + l_orderkey % 5] AS mode FROM lineitem) SELECT l_orderkey, m.mode, layer, count(*) AS n FROM m JOIN r ON r.mode = m.mode AND r.i = m.i GROUP BY ALL")
def b12_route_layers(spark, sf):
    df = view(spark, sf, "lineitem").select("l_orderkey", F.element_at(F.array(*map(F.lit, _MODES)), F.expr("int(l_orderkey % 5 + 1)")).alias("mode"), F.expr("int(l_linenumber % 4)").alias("channel_index"))
    return L.route_layers(df).groupBy("l_orderkey", "mode", "layer").agg(F.count("*").alias("n"))


@query("SELECT dbname, cell_id, channel, CASE WHEN max(intensity) > 65535 THEN 'over 65535' END AS reason, CASE WHEN max(intensity) <= 65535 THEN 16 END AS bits FROM px GROUP BY dbname, cell_id, channel")
def b13_validate_fluorescence(spark, sf):
    return L.validate_fluorescence(view(spark, sf, "px"), K3)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fewer than three points' WHEN 1 THEN 'self-intersection' WHEN 2 THEN 'outside' END AS reason FROM orders")
def b14_validate_polygons(spark, sf):
    p = lambda *xy: "array(" + ", ".join(f"struct({x}D as x, {y}D as y)" for x, y in xy) + ")"
    points = f"case o_orderkey % 4 when 0 then {p((0, 0), (4, 4))} when 1 then {p((0, 0), (4, 4), (4, 0), (0, 4))} when 2 then {p((0, 0), (40, 0), (4, 4))} else {p((0, 0), (4, 0), (4, 4), (0, 4))} end"
    return L.validate_polygons(view(spark, sf, "orders").select("o_orderkey", F.expr(points).alias("points")), 20, 20).select("o_orderkey", "reason")


@query("SELECT dbname, count(*) FILTER (y IS NOT NULL AND chars > 1000) AS points, count(*) FILTER (chars <= 1000) AS missing, avg(y) FILTER (chars > 1000) AS mean_x, avg(chars) FILTER (chars > 1000) AS mean_y FROM scored GROUP BY dbname", "mean_x mean_y")
def b15_scatter_points(spark, sf):
    return L.scatter_points(view(spark, sf, "scored").withColumn("c", F.expr("if(chars > 1000, chars, null)")), "y", "c")


@query("SELECT dbname, doc_id FROM scored WHERE score BETWEEN 0.1 AND 0.5 AND y BETWEEN 1 AND 1")
def b16_box_select(spark, sf):
    return L.box_select(view(spark, sf, "scored"), "score", "y", 0.1, 0.5, 1, 1).select("dbname", "doc_id")


@query("SELECT DISTINCT dbname FROM cells WHERE lower(dbname) LIKE '%ur%'")
def b17_search_names(spark, sf):
    return L.search_names(view(spark, sf, "cells").select("dbname").distinct(), "UR")


# --- joins ----------------------------------------------------------------------------------------

_RANGES = [("early", -5, 400), ("mid", 300, 900), ("early", 1000, 1100), ("late", 2000, 99999), ("none", 50, 10)]
_DAY = "CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INT)"


@query(f"WITH f AS (SELECT o_orderkey, {_DAY} AS frame FROM orders) SELECT split, count(*) AS n, CAST(sum(frame) AS BIGINT) AS s FROM (SELECT 'early' AS split, frame FROM f WHERE frame BETWEEN 0 AND 400 UNION ALL SELECT 'mid', frame FROM f WHERE frame BETWEEN 300 AND 900 UNION ALL SELECT 'early_2', frame FROM f WHERE frame BETWEEN 1000 AND 1100 UNION ALL SELECT 'late', frame FROM f WHERE frame BETWEEN 2000 AND 3999) GROUP BY split")
def c1_assign_frame_splits(spark, sf):
    frames = view(spark, sf, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("frame"))
    splits = spark.createDataFrame(_RANGES, "name string, start int, end int")
    return J.assign_frame_splits(frames, splits, 4000).groupBy("split").agg(F.count("*").alias("n"), F.sum("frame").alias("s"))


@query("SELECT view, frame, roi, count(*) AS n FROM (SELECT l.view, l.frame, r.roi FROM labelled l JOIN (SELECT v AS view, k AS roi, k * 20 AS x0, k * 20 + 15 AS x1, 2 AS y0, 8 AS y1 FROM range(7) a(v), range(2) b(k)) r ON l.view = r.view WHERE x >= greatest(x0 + l.frame, 0) AND x < least(x1 + l.frame, 51) AND y >= y0 AND y < y1) GROUP BY view, frame, roi")
def c2_pixels_in_rois(spark, sf):
    rois = spark.range(14).selectExpr("id div 2 as view", "id % 2 as roi", "(id % 2) * 20 as x0", "(id % 2) * 20 + 15 as x1", "2 as y0", "8 as y1")
    drift = spark.range(35).selectExpr("id div 5 as view", "id % 5 as frame", "id % 5 as dx", "0 as dy")
    px = view(spark, sf, "labelled").withColumnRenamed("roi", "cell")
    return J.pixels_in_rois(px, rois, drift, 51, 11).groupBy("view", "frame", "roi").agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT i, i * 51 // 4 AS lo, (i + 1) * 51 // 4 AS hi FROM range(4) t(i)), c AS (SELECT j, j * 11 // 2 AS lo, (j + 1) * 11 // 2 AS hi FROM range(2) t(j)) SELECT l.frame * 8 + j * 4 + i AS frame, count(*) AS n, CAST(sum(x - b.lo) AS BIGINT) AS sx, CAST(sum(y - c.lo) AS BIGINT) AS sy FROM labelled l JOIN b ON x >= b.lo AND x < b.hi JOIN c ON y >= c.lo AND y < c.hi GROUP BY 1")
def c3_tile_frames(spark, sf):
    t = J.tile_frames(view(spark, sf, "labelled").select("frame", "x", "y"), 51, 11, 4, 2)
    return t.groupBy("frame").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("WITH c AS (SELECT i AS center_id, i % 5 AS frame, i AS cx, i % 11 AS cy FROM range(50) t(i)) SELECT center_id, count(*) AS n, CAST(sum(x - cx + 4) AS BIGINT) AS sx FROM labelled l JOIN c ON l.frame = c.frame AND x BETWEEN cx - 4 AND cx + 3 AND y BETWEEN cy - 4 AND cy + 3 WHERE cx - 4 >= 0 AND cy - 4 >= 0 AND cx + 4 <= 51 AND cy + 4 <= 11 GROUP BY center_id")
def c4_crop_windows(spark, sf):
    centers = spark.range(50).selectExpr("id as center_id", "id % 5 as frame", "double(id) as cx", "double(id % 11) as cy")
    px = view(spark, sf, "labelled").select("frame", "x", "y")
    return J.crop_windows(px, centers, 8, 51, 11).groupBy("center_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


@query("WITH r AS (SELECT DISTINCT view, roi, frame FROM labelled WHERE label <= 2), o AS (SELECT DISTINCT view, roi, frame FROM labelled WHERE label >= 6) SELECT view, count(*) AS n FROM r JOIN o USING (view, roi, frame) GROUP BY view")
def c5_pair_review_images(spark, sf):
    px, keys = view(spark, sf, "labelled"), ["view", "roi", "frame"]
    return J.pair_review_images(px.where("label <= 2").select(*keys).distinct(), px.where("label >= 6").select(*keys).distinct()).groupBy("view").agg(F.count("*").alias("n"))


_COMPONENTS = "SELECT view, frame, label, x, y FROM labelled GROUP BY view, frame, label, x, y"


@query(f"WITH c AS ({_COMPONENTS}), d AS (SELECT DISTINCT view, frame + 1 AS frame, x + i + CASE WHEN view % 2 = 0 THEN 1 ELSE 0 END AS x, y + j - CASE WHEN frame = 1 THEN 1 ELSE 0 END AS y, label AS before FROM c, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j)), h AS (SELECT c.view, c.frame, c.label, c.x, c.y, d.before FROM c JOIN d USING (view, frame, x, y)), a AS (SELECT view, frame, label, count(*) AS area FROM c GROUP BY ALL), p AS (SELECT view, frame, label, before, count(*) AS n FROM h GROUP BY ALL), q AS (SELECT view, frame, label, string_agg(CAST(before AS STRING), ',' ORDER BY before) AS parents FROM p JOIN a USING (view, frame, label) WHERE n >= greatest(8, round_even(area * 0.02, 0)) GROUP BY ALL), v AS (SELECT view, frame, label, count(DISTINCT (x, y)) AS covered FROM h GROUP BY ALL) SELECT view, frame, label, area, coalesce(covered, 0) / area AS overlap, coalesce(parents, '') AS parents FROM a LEFT JOIN v USING (view, frame, label) LEFT JOIN q USING (view, frame, label)", "overlap")
def c6_temporal_overlap(spark, sf):
    c = view(spark, sf, "labelled").select("view", "frame", "label", "x", "y").distinct()
    # Even views move one to the right a frame; all move one up between frames 1 and 2.
    drift = spark.range(7).selectExpr("id as view", "explode(sequence(0L, 4L)) as frame").selectExpr("view", "frame", "int(if(view % 2 = 0, frame, 0)) as dx", "int(if(frame >= 2, -1, 0)) as dy")
    return J.temporal_overlap(c, c, 1, drift).withColumn("parents", F.array_join(F.col("parents").cast("array<string>"), ","))


@query("SELECT view, frame, x, y, count(DISTINCT label) AS instances FROM labelled GROUP BY view, frame, x, y HAVING count(DISTINCT label) > 1")
def c7_annotation_overlaps(spark, sf):
    return J.annotation_overlaps(view(spark, sf, "labelled").withColumnRenamed("label", "instance_id"), ["view", "frame"])


@query("SELECT manual_label, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_custkey AS STRING) WHEN o_orderkey % 10 = 1 THEN 'x' ELSE manual_label END AS manual_label FROM cells) GROUP BY 1")
def c8_apply_label_updates(spark, sf):
    # Each edit of a cell comes twice; the first one of the two is overwritten.
    c = view(spark, sf, "cells")
    updates = c.where("o_orderkey % 10 < 2").select("dbname", "cell_id", F.expr("explode(array(struct(1 as at, 'old' as new_label), struct(2 as at, if(o_orderkey % 10 = 0, concat(' 0', o_custkey), 'x ') as new_label)))").alias("e")).select("dbname", "cell_id", "e.*")
    return J.apply_label_updates(c, updates, ["at"])[0].groupBy("manual_label").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), d AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, list_distance(q.v, t.v) AS distance FROM e q, e t WHERE q.vec_id % 50 = 0 AND t.vec_id % 50 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d) SELECT query_id, train_id, distance, CAST(rank AS INT) AS rank, 1 / (distance + 1e-6) AS weight FROM r WHERE rank <= 5", "distance weight", 4)
def c9_knn_join(spark, sf):
    e = view(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return J.knn_join(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.where("vec_id % 50 <> 0").withColumnRenamed("vec_id", "train_id"), 5)


@query("SELECT found, count(*) AS n, sum(coalesce(a, 0) + coalesce(b, 0)) AS s FROM (SELECT CASE WHEN y.area IS NULL THEN 'a' WHEN x.area IS NULL THEN 'b' ELSE 'both' END AS found, x.area AS a, y.area AS b FROM (SELECT * FROM cells WHERE o_orderkey % 3 < 2) x FULL JOIN (SELECT * FROM cells WHERE o_orderkey % 3 > 0) y ON x.dbname = y.dbname AND x.cell_id = y.cell_id) GROUP BY found", "s", 1)
def c10_compare_by_key(spark, sf):
    c = view(spark, sf, "cells")
    j = J.compare_by_key(c.where("o_orderkey % 3 < 2"), c.where("o_orderkey % 3 > 0"), "area", K2)
    return j.groupBy("found").agg(F.count("*").alias("n"), F.sum(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("s"))


@query("SELECT dbname, cell_id, area < (SELECT avg(area) FROM cells WHERE manual_label = '2') AS below FROM cells")
def c11_broadcast_threshold(spark, sf):
    c = view(spark, sf, "cells")
    return J.broadcast_threshold(c, c.where("manual_label = '2'").agg(F.avg("area").alias("threshold")), "area").select("dbname", "cell_id", "below")


# --- aggregations ---------------------------------------------------------------------------------

_AXES = "SELECT dbname, cell_id, channel, count(*) AS n, (var_samp(x) + var_samp(y)) / 2 + sqrt(power((var_samp(x) - var_samp(y)) / 2, 2) + power(covar_samp(x, y), 2)) AS l1, greatest((var_samp(x) + var_samp(y)) / 2 - sqrt(power((var_samp(x) - var_samp(y)) / 2, 2) + power(covar_samp(x, y), 2)), 0) AS l2, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS a FROM px GROUP BY dbname, cell_id, channel"


@query(f"WITH a AS ({_AXES}) SELECT dbname, cell_id, channel, max(x * cos(a) + y * sin(a)) - min(x * cos(a) + y * sin(a)) AS length FROM px JOIN a USING (dbname, cell_id, channel) GROUP BY ALL", "length", 4)
def d1_cell_lengths(spark, sf):
    return A.cell_lengths(view(spark, sf, "px"), K3)


@query("SELECT o_orderkey, CAST(w * h AS DOUBLE) AS poly_area, CAST(2 * (w + h) AS DOUBLE) AS poly_perimeter, CASE WHEN w * h = 0 THEN 0 ELSE w // 2 END AS center_x, CASE WHEN w * h = 0 THEN 0 ELSE h // 2 END AS center_y FROM (SELECT o_orderkey, o_orderkey % 50 AS w, o_custkey % 30 AS h FROM orders)", "poly_area poly_perimeter")
def d2_polygon_measures(spark, sf):
    o = view(spark, sf, "orders").selectExpr("o_orderkey", "double(o_orderkey % 50) as w", "double(o_custkey % 30) as h")
    box = F.expr("array(struct(0D as x, 0D as y), struct(w as x, 0D as y), struct(w as x, h as y), struct(0D as x, h as y))")
    return A.polygon_measures(o.withColumn("contour", box)).select("o_orderkey", "poly_area", "poly_perimeter", "center_x", "center_y")


@query(f"WITH a AS ({_AXES}) SELECT dbname, cell_id, channel, l1, l2, sqrt(l1) AS sd1, sqrt(l2) AS sd2, l2 / l1 AS ratio, sqrt(1 - l2 / l1) AS eccentricity FROM a", "l1 l2 sd1 sd2 ratio eccentricity", 5)
def d3_pca_variances(spark, sf):
    return A.pca_shape(view(spark, sf, "px"), K3)


@query("SELECT dbname, cell_id, channel, quantile_cont(intensity, 0.5) / max(intensity) AS normalized_median FROM px GROUP BY ALL", "normalized_median")
def d4_normalized_median(spark, sf):
    return A.normalized_median(view(spark, sf, "px"), K3)


@query("SELECT dbname, avg(CAST(score < 0.7414 AS INT)) AS ratio, CAST(sum(CAST(score < 0.7414 AS INT)) AS BIGINT) AS below, count(*) AS total FROM scored GROUP BY dbname", "ratio")
def d5_fraction_below(spark, sf):
    return A.fraction_below(view(spark, sf, "scored"), "score", keys=["dbname"])


@query("SELECT dbname, cell_id, count(*) AS n, arg_min(intensity, y * 1000 + x) AS first_value FROM grid GROUP BY ALL", "first_value", 2)
def d6_raw_intensities(spark, sf):
    return A.raw_intensities(view(spark, sf, "grid"), K2).select("dbname", "cell_id", F.size("intensities").cast("long").alias("n"), F.element_at("intensities", 1).alias("first_value"))


@query("SELECT dbname, cell_id, channel, stddev_pop(intensity) AS sd, stddev_pop(intensity) / avg(intensity) AS cv, avg(intensity) AS mean, quantile_cont(intensity, 0.5) AS median, avg(intensity) / max(intensity) AS normalized_mean, quantile_cont(intensity, 0.5) / max(intensity) AS normalized_median, 1 - sum(intensity) * sum(intensity) / (count(*) * sum(intensity * intensity)) AS energy FROM px GROUP BY ALL", "sd cv mean median normalized_mean normalized_median energy", 4)
def d7_intensity_stats(spark, sf):
    return A.intensity_stats(view(spark, sf, "px"), K3)


_DILATED = "SELECT DISTINCT dbname, cell_id, x + i AS x, y + j AS y FROM {0}, (SELECT a - 1 AS i, b - 1 AS j FROM range(3) s(a), range(3) t(b)) WHERE x + i BETWEEN 0 AND 50 AND y + j BETWEEN 0 AND 10"
_BRIGHT = "SELECT * FROM grid WHERE intensity > 60000"


@query(f"WITH m AS ({_BRIGHT}), d AS (SELECT DISTINCT dbname, cell_id, x + i AS x, y + j AS y FROM m, (VALUES (0, -3), (-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), (3, -1), (-3, 0), (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0), (3, 0), (-3, 1), (-2, 1), (-1, 1), (0, 1), (1, 1), (2, 1), (3, 1), (-2, 2), (-1, 2), (0, 2), (1, 2), (2, 2), (0, 3)) o(i, j) WHERE x + i BETWEEN 0 AND 50 AND y + j BETWEEN 0 AND 10), r AS (SELECT d.* FROM d ANTI JOIN m USING (dbname, cell_id, x, y)), b AS (SELECT dbname, cell_id, quantile_cont(intensity, 0.5) AS background FROM r JOIN grid USING (dbname, cell_id, x, y) GROUP BY ALL) SELECT * FROM (SELECT DISTINCT dbname, cell_id FROM m) LEFT JOIN b USING (dbname, cell_id)", "background", 3)
def d8_background_ring(spark, sf):
    g = view(spark, sf, "grid")
    return P.background_ring(g.where("intensity > 60000"), g, K2, 51, 11)


@query("WITH b AS (SELECT dbname, cell_id, quantile_cont(intensity, 0.25) AS b FROM grid GROUP BY ALL), w AS (SELECT dbname, cell_id, x, y, greatest(intensity - b, 0) AS w FROM grid JOIN b USING (dbname, cell_id)), s AS (SELECT *, sum(w) OVER k AS s, count(*) OVER k AS n, row_number() OVER (PARTITION BY dbname, cell_id ORDER BY w DESC, y, x) AS r FROM w WINDOW k AS (PARTITION BY dbname, cell_id)) SELECT dbname, cell_id, -sum(CASE WHEN w > 0 THEN w / s * ln(w / s) ELSE 0 END) / ln(max(n)) AS entropy_norm, (sqrt(max(n)) - sum(w) / sqrt(sum(w * w))) / (sqrt(max(n)) - 1) AS hoyer_sparsity, sum(CASE WHEN r <= greatest(ceil(n * 0.1), 1) THEN w / s ELSE 0 END) AS top10_fraction FROM s GROUP BY ALL", "entropy_norm hoyer_sparsity top10_fraction", 5)
def d9_concentration(spark, sf):
    g = view(spark, sf, "grid")
    return A.concentration(g, g.groupBy(*K2).agg(F.percentile("intensity", 0.25).alias("background")), K2)


@query("WITH t AS (SELECT dbname, cell_id, intensity AS w, x / 50.0 AS t FROM grid), g AS (SELECT dbname, cell_id, sum(w) AS s, sum(w * t) / sum(w) AS m, sum(w * t * t) / sum(w) AS q, sum(CASE WHEN t <= 0.2 + 1e-7 OR t >= 0.8 - 1e-7 THEN w ELSE 0 END) / sum(w) / avg(CAST(t <= 0.2 + 1e-7 OR t >= 0.8 - 1e-7 AS INT)) AS polar_enrichment, sum(CASE WHEN t BETWEEN 0.4 - 1e-7 AND 0.6 + 1e-7 THEN w ELSE 0 END) / sum(w) / avg(CAST(t BETWEEN 0.4 - 1e-7 AND 0.6 + 1e-7 AS INT)) AS midcell_enrichment, sum(CASE WHEN abs(t - 0.5) <= 1e-7 THEN w / 2 WHEN t < 0.5 THEN w ELSE 0 END) / sum(w) AS l FROM t GROUP BY ALL) SELECT dbname, cell_id, polar_enrichment, midcell_enrichment, sqrt(greatest(q - m * m, 0)) AS axial_spread, abs(2 * m - 1) AS axial_offset, abs(1 - 2 * l) AS axial_asymmetry FROM g", "polar_enrichment midcell_enrichment axial_spread axial_offset axial_asymmetry", 5)
def d10_axial_localization(spark, sf):
    return A.axial_localization(view(spark, sf, "grid").selectExpr("dbname", "cell_id", "intensity as w", "x / 50D as t"), K2)


@query("SELECT dbname, count(*) AS total, count(*) FILTER (chars > 500) AS valid, count(*) FILTER (chars <= 500) AS missing, quantile_cont(chars, 0.25) FILTER (chars > 500) AS q1, quantile_cont(chars, 0.5) FILTER (chars > 500) AS median, quantile_cont(chars, 0.75) FILTER (chars > 500) AS q3 FROM scored GROUP BY dbname", "q1 median q3", 3)
def d13_metric_summary(spark, sf):
    return A.metric_summary(view(spark, sf, "scored").withColumn("c", F.expr("if(chars > 500, chars, null)")), "c", ["dbname"])


_QUARTILES = "count(*) AS total, count(c) AS valid, count(*) - count(c) AS missing, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.75) AS q3"


@query(f"WITH s AS (SELECT dbname, label, CASE WHEN chars > 500 THEN chars END AS c FROM scored) SELECT dbname, label, {_QUARTILES} FROM s GROUP BY dbname, label UNION ALL SELECT dbname, 'All', {_QUARTILES} FROM s GROUP BY dbname", "q1 median q3", 3)
def d14_metric_rollup(spark, sf):
    return A.metric_rollup(view(spark, sf, "scored").withColumn("c", F.expr("if(chars > 500, chars, null)")), "c")


@query("SELECT DISTINCT trim(manual_label) AS label FROM cells WHERE trim(manual_label) <> ''")
def d16_f2_distinct_labels(spark, sf):
    labels = A.distinct_labels(view(spark, sf, "cells"))
    return labels.orderBy(*L.label_keys(F.col("label")))


_SCORE = "SELECT dbname, cell_id, CASE WHEN max(g) > min(g) THEN (avg(g) - min(g)) / (max(g) - min(g)) ELSE avg(g) END AS score FROM profiles GROUP BY dbname, cell_id"
_CONTROL = f"SELECT score AS threshold FROM ({_SCORE}) WHERE dbname = '0' ORDER BY score DESC LIMIT 1 OFFSET (SELECT CAST(floor(0.95 * count(DISTINCT cell_id)) AS BIGINT) FROM profiles WHERE dbname = '0')"


@query(_SCORE, "score")
def d17_profile_score(spark, sf):
    return profiles(spark, sf).select("dbname", "cell_id", A.profile_score(F.col("g")).alias("score"))


def _control(spark, sf):
    return A.control_threshold(profiles(spark, sf).where("dbname = '0'").select(A.profile_score(F.col("g")).alias("score")))


@query(_CONTROL, "threshold")
def d18_control_threshold(spark, sf):
    return _control(spark, sf)


@query(f"WITH s AS ({_SCORE}), c AS ({_CONTROL}), l AS (SELECT dbname, cell_id, (max(u1) - min(u1)) * 0.1 AS length FROM profiles GROUP BY ALL) SELECT s.dbname, avg(round(length, 2)) AS mean_length, avg(CAST(score < threshold AS INT)) AS ratio, count(*) AS n FROM s JOIN l USING (dbname, cell_id), c GROUP BY s.dbname", "mean_length ratio")
def d19_aggregation_ratio(spark, sf):
    return A.aggregation_ratio(profiles(spark, sf), _control(spark, sf), 0.1)


@query("WITH c AS (SELECT quantile_cont(score, 0.95) AS cut FROM scored WHERE dbname = 'en') SELECT dbname, avg(CAST(score > cut AS INT)) AS positive, count(*) AS n FROM scored, c GROUP BY dbname", "positive")
def d20_quantile_call(spark, sf):
    s = view(spark, sf, "scored")
    return A.quantile_call(s, s.where("dbname = 'en'"), "score", 0.95, True)


@query("WITH p AS (SELECT *, max(g) OVER w AS hi, min(g) OVER w AS lo FROM profiles WINDOW w AS (PARTITION BY cell_id)) SELECT cell_id, max(u1) + 1 AS n, max(CASE WHEN u1 = 0 THEN (g - lo) / (hi - lo) END) AS first_value FROM p GROUP BY cell_id", "first_value", 5)
def d21_profile_matrix(spark, sf):
    m = A.profile_matrix(profiles(spark, sf), True)
    return m.select("cell_id", F.size("row").cast("long").alias("n"), F.element_at("row", 1).alias("first_value"))


@query("WITH m AS (SELECT dbname, cell_id, avg(g) AS v FROM profiles GROUP BY ALL), q AS (SELECT dbname, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM m GROUP BY dbname) SELECT dbname, q1, median, q3, min(v) AS low, max(v) AS high FROM m JOIN q USING (dbname) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL", "q1 median q3 low high")
def d22_five_number(spark, sf):
    m = profiles(spark, sf).select("dbname", (F.aggregate("g", F.lit(0.0), lambda s, v: s + v) / F.size("g")).alias("v"))
    return A.five_number(m, "v", ["dbname"])


@query("WITH s AS (SELECT dbname, count(*) AS n, min(chars) AS lo, max(chars) AS hi, least(40, greatest(8, floor(sqrt(count(*)))))::BIGINT AS bins FROM scored GROUP BY dbname), b AS (SELECT dbname, least(floor((chars - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin, count(*) AS c FROM scored JOIN s USING (dbname) GROUP BY ALL), g AS (SELECT dbname, lo, hi, bins, unnest(range(bins)) AS bin FROM s) SELECT dbname, bin, lo + (hi - lo) * bin / bins AS \"from\", coalesce(c, 0) AS count FROM g LEFT JOIN b USING (dbname, bin)")
def d23_histogram(spark, sf):
    return A.histogram(view(spark, sf, "scored"), "chars", ["dbname"])


@query("WITH p AS (SELECT dbname, cell_id, CAST(CASE WHEN CAST(cell_id AS INT) % 3 = 0 THEN 7 WHEN CAST(cell_id AS INT) % 3 = 1 THEN floor(intensity / 1000) ELSE floor(intensity) END AS DOUBLE) AS v FROM grid), s AS (SELECT dbname, cell_id, min(v) AS lo, max(v) AS hi, CAST(CASE WHEN max(v) = min(v) THEN 1 WHEN max(v) - min(v) <= 256 THEN greatest(ceil(max(v) - min(v)), 1) ELSE 256 END AS BIGINT) AS bins FROM p GROUP BY ALL), b AS (SELECT dbname, cell_id, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * bins), bins - 1)::BIGINT END AS bin, count(*) AS c FROM p JOIN s USING (dbname, cell_id) GROUP BY ALL), g AS (SELECT dbname, cell_id, lo, hi, bins, unnest(range(bins)) AS bin FROM s) SELECT dbname, cell_id, bin, lo + (hi - lo) * bin / bins AS low, coalesce(c, 0) AS count FROM g LEFT JOIN b USING (dbname, cell_id, bin)", "low", 3)
def d23_intensity_histogram(spark, sf):
    v = F.expr("double(case when int(cell_id) % 3 = 0 then 7 when int(cell_id) % 3 = 1 then floor(intensity / 1000) else floor(intensity) end)")
    return A.histogram(view(spark, sf, "grid").select(*K2, v.alias("v")), "v", K2, "intensities").withColumnRenamed("from", "low")


@query("WITH s AS (SELECT dbname, count(*) AS n, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi, 1.06 * stddev_pop(score) * power(count(*), -0.2) AS h FROM scored GROUP BY dbname), g AS (SELECT dbname, n, h, greatest(0, lo - 3 * h) AS a, (hi + 3 * h - greatest(0, lo - 3 * h)) / 199 AS st, unnest(range(200)) AS k FROM s), x AS (SELECT dbname, n, h, k, a + k * st AS x FROM g) SELECT dbname, CAST(k AS INT) AS k, x, sum(exp(-power((x - score) / h, 2) / 2)) / (n * h * 2.5066282746310002) AS density FROM x JOIN scored USING (dbname) GROUP BY dbname, k, x, n, h", "x density", 5)
def d24_kde(spark, sf):
    return A.kde(view(spark, sf, "scored"), "score", ["dbname"])


@query("WITH p AS (SELECT dbname, cell_id, count(*) AS n, count(*) FILTER (lateral_at IS NULL) AS u FROM spots GROUP BY ALL), j AS (SELECT c.*, p.n, p.u FROM spot_cells c LEFT JOIN p USING (dbname, cell_id)) SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS analysed, count(*) FILTER (status <> 'ok') AS skipped, count(*) FILTER (status = 'ok' AND n > 0) AS positive, CAST(coalesce(sum(n), 0) AS BIGINT) AS spots, count(*) FILTER (at_cap) AS at_cap, CAST(coalesce(sum(u), 0) AS BIGINT) AS unmapped FROM j")
def d25_spot_summary(spark, sf):
    return A.spot_summary(view(spark, sf, "spot_cells"), view(spark, sf, "spots"))


@query("WITH k AS (SELECT dbname, cell_id FROM spot_cells WHERE status = 'ok'), b AS (SELECT CAST(least(floor(nearest_pole / 0.5 * 20), 19) AS BIGINT) AS bin, count(DISTINCT cell_id) AS c, count(*) AS s FROM spots JOIN k USING (dbname, cell_id) GROUP BY 1) SELECT i AS bin, 100.0 * coalesce(c, 0) / (SELECT count(*) FROM k) AS percent, coalesce(s, 0) AS spots FROM range(20) t(i) LEFT JOIN b ON b.bin = i", "percent")
def d26_position_bins(spark, sf):
    return A.position_bins(view(spark, sf, "spots"), view(spark, sf, "spot_cells"))


@query("SELECT view, roi, frame, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, avg(intensity) AS mean_intensity, CAST(row_number() OVER (PARTITION BY view, frame ORDER BY roi, label) AS INT) AS global_label FROM labelled GROUP BY view, roi, frame, label", "cx cy mean_intensity")
def d27_trap_cell_rows(spark, sf):
    return A.trap_cell_rows(view(spark, sf, "labelled"))


@query("WITH r AS (SELECT DISTINCT view, roi FROM labelled), c AS (SELECT view, roi, frame, count(DISTINCT label) AS cells FROM labelled WHERE label > 3 GROUP BY ALL) SELECT r.view, r.roi, f AS frame, coalesce(cells, 0) AS cells FROM r CROSS JOIN range(6) t(f) LEFT JOIN c ON c.view = r.view AND c.roi = r.roi AND c.frame = f")
def d28_cells_per_frame(spark, sf):
    px = view(spark, sf, "labelled")
    frames = px.select("view", "roi").distinct().withColumn("frame", F.explode(F.expr("sequence(0L, 5L)")))
    return A.cells_per_frame(px.where("label > 3").select("view", "roi", "frame", "label").distinct(), frames)


@query("SELECT roi, count(*) AS total, count(*) FILTER (status = 'reviewed') AS reviewed, coalesce(min(order_index) FILTER (status <> 'reviewed'), max(order_index)) AS cursor, CAST(round(100.0 * count(*) FILTER (status = 'reviewed') / count(*)) AS BIGINT) AS percent, count(*) = count(*) FILTER (status = 'reviewed') AS completed FROM frames GROUP BY roi")
def d29_training_progress(spark, sf):
    return A.training_progress(view(spark, sf, "frames"), ["roi"])


@query("WITH e AS (SELECT CAST(max(created_at) AS DATE) AS d FROM activity) SELECT CAST(g AS DATE) AS day, (SELECT count(*) FROM activity WHERE action_name <> 'view' AND CAST(created_at AS DATE) = CAST(g AS DATE)) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-10' - INTERVAL 13 DAY, DATE '2024-01-10', INTERVAL 1 DAY)) AS g)")
def d30_daily_activity(spark, sf):
    return activity.daily_activity(view(spark, sf, "activity"), "2024-01-10", 14, view_action="view")


@query("SELECT dbname, cell_id, stddev_pop(intensity) AS sd, min(intensity) AS low, quantile_cont(intensity, 0.1) AS p10, quantile_cont(intensity, 0.25) AS p25, quantile_cont(intensity, 0.5) AS p50, quantile_cont(intensity, 0.75) AS p75, quantile_cont(intensity, 0.9) AS p90, max(intensity) AS high FROM grid GROUP BY ALL", "sd low p10 p25 p50 p75 p90 high")
def d32_region_quantiles(spark, sf):
    return A.region_quantiles(view(spark, sf, "grid"), K2).drop("mean")


_RATES = "coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy"


@query(f"SELECT *, {_RATES} FROM (SELECT dbname, count(*) FILTER (y = 1 AND score >= 0.2) AS tp, count(*) FILTER (y = 0 AND score < 0.2) AS tn, count(*) FILTER (y = 0 AND score >= 0.2) AS fp, count(*) FILTER (y = 1 AND score < 0.2) AS fn FROM scored GROUP BY dbname)", "accuracy precision recall specificity f1 balanced_accuracy")
def d33_classification_metrics(spark, sf):
    return A.classification_metrics(view(spark, sf, "scored").withColumn("call", F.expr("int(score >= 0.2)")), ["dbname"])


@query(f"WITH g AS (SELECT dbname, round(0.2 + k * 0.005, 6) AS threshold, count(*) FILTER (y = 1 AND score >= 0.2 + k * 0.005 - 5e-12) AS tp, count(*) FILTER (y = 0 AND score < 0.2 + k * 0.005 - 5e-12) AS tn, count(*) FILTER (y = 0 AND score >= 0.2 + k * 0.005 - 5e-12) AS fp, count(*) FILTER (y = 1 AND score < 0.2 + k * 0.005 - 5e-12) AS fn FROM scored, range(121) t(k) GROUP BY dbname, k), r AS (SELECT *, {_RATES} FROM g) SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dbname ORDER BY f1 DESC, balanced_accuracy DESC, accuracy DESC, fp, threshold) AS rn FROM r) WHERE rn = 1", "threshold accuracy precision recall specificity f1 balanced_accuracy")
def d34_threshold_search(spark, sf):
    return A.threshold_search(view(spark, sf, "scored"), ["dbname"])


@query("WITH s AS (SELECT dbname, quantile_cont(chars, 0.5) AS c, quantile_cont(chars, 0.75) - quantile_cont(chars, 0.25) AS i FROM scored GROUP BY dbname) SELECT dbname, doc_id, least(greatest((chars - c) / i, -12), 12) AS scaled FROM scored JOIN s USING (dbname)", "scaled")
def d35_robust_scaler(spark, sf):
    return A.robust_scaler(view(spark, sf, "scored"), "chars", ["dbname"]).select("dbname", "doc_id", "scaled")


# --- windows, order, sets -------------------------------------------------------------------------


@query("SELECT dbname, min(area) AS area, count(*) AS n FROM cells GROUP BY dbname", "area", 2)
def e1_dedupe_cells(spark, sf):
    c = view(spark, sf, "cells")
    return W.dedupe_cells(c.unionByName(c.withColumn("area", F.col("area") + 1)), ["area"]).groupBy("dbname").agg(F.min("area").alias("area"), F.count("*").alias("n"))


@query("SELECT DISTINCT dbname, chars, cume_dist() OVER (PARTITION BY dbname ORDER BY chars) AS share FROM scored", "share")
def e2_ecdf(spark, sf):
    return W.ecdf(view(spark, sf, "scored"), "chars")


@query("WITH u AS (SELECT dbname, cell_id, x + y / 100.0 AS u, intensity FROM grid), r AS (SELECT *, min(u) OVER w AS lo, max(u) OVER w AS hi FROM u WINDOW w AS (PARTITION BY dbname, cell_id)), b AS (SELECT *, least(floor((u - lo) / (hi - lo) * 35), 34) AS bin FROM r), m AS (SELECT dbname, cell_id, bin, max(intensity) AS m FROM b WHERE bin >= 1 GROUP BY ALL), f AS (SELECT dbname, cell_id, arg_min(intensity, u) AS a, arg_max(intensity, u) AS z FROM u GROUP BY ALL) SELECT dbname, cell_id, count(*) + 2 AS n, sum(m) + max(a) + max(z) AS total FROM m JOIN f USING (dbname, cell_id) GROUP BY ALL", "total", 2)
def e3_profile_bins(spark, sf):
    p = W.profile_bins(view(spark, sf, "grid").selectExpr("dbname", "cell_id", "x + y / 100D as u", "intensity"), K2)
    return p.select("dbname", "cell_id", F.size("g").cast("long").alias("n"), F.aggregate("g", F.lit(0.0), lambda s, v: s + v).alias("total"))


_RAGGED = "filter(sequence(0, size(u1) - 1), i -> i <= int(cell_id) % 40 + 5)"


def _ragged(spark, sf):
    p = profiles(spark, sf)
    return p.withColumns({"u1": F.expr(f"transform({_RAGGED}, i -> u1[i])"), "g": F.expr(f"transform({_RAGGED}, i -> g[i])")})


@query("WITH l AS (SELECT dbname, cell_id, CAST(max(u1) AS DOUBLE) AS length FROM profiles WHERE u1 <= CAST(cell_id AS INT) % 40 + 5 GROUP BY ALL) SELECT dbname, cell_id, CAST(row_number() OVER (PARTITION BY dbname ORDER BY length, cell_id) AS INT) AS place, (max(length) OVER () - length) / 2 AS start FROM l", "start")
def e4_order_profiles_abs(spark, sf):
    return W.order_profiles_abs(_ragged(spark, sf)).select("dbname", "cell_id", "place", F.element_at("u1", 1).alias("start"))


@query("WITH l AS (SELECT dbname, cell_id, sum(g) AS total, count(*) AS n FROM profiles WHERE u1 <= CAST(cell_id AS INT) % 40 + 5 GROUP BY ALL) SELECT dbname, cell_id, CAST(row_number() OVER (PARTITION BY dbname ORDER BY total, cell_id) AS INT) AS place, (max(n) OVER () - n) / 2 AS start FROM l", "start")
def e5_order_profiles_rel(spark, sf):
    return W.order_profiles_rel(_ragged(spark, sf)).select("dbname", "cell_id", "place", F.element_at("at", 1).alias("start"))


@query("SELECT frame_id, lag(frame_id) OVER w AS previous_id, lead(frame_id) OVER w AS next_id FROM frames WINDOW w AS (PARTITION BY roi ORDER BY order_index, frame_id)")
def e6_frame_neighbours(spark, sf):
    return W.frame_neighbours(view(spark, sf, "frames"), ["roi"]).select("frame_id", "previous_id", "next_id")


@query("WITH RECURSIVE r AS (SELECT roi AS frame_id, row_number() OVER (PARTITION BY roi ORDER BY order_index) AS revision, status FROM frames), b AS (SELECT *, CASE WHEN revision % 7 = 0 THEN 0 WHEN revision % 7 = 1 AND revision > 1 THEN revision - 2 ELSE revision - 1 END AS base FROM r), s AS (SELECT DISTINCT frame_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS revision, CAST(NULL AS STRING) AS status, CAST(0 AS BIGINT) AS conflicts FROM b UNION ALL SELECT s.frame_id, s.k + 1, CASE WHEN b.base = s.revision THEN b.revision ELSE s.revision END, CASE WHEN b.base = s.revision THEN b.status ELSE s.status END, s.conflicts + CASE WHEN b.base = s.revision THEN 0 ELSE 1 END FROM s JOIN b ON b.frame_id = s.frame_id AND b.revision = s.k + 1) SELECT frame_id, max(k) AS edits, arg_max(revision, k) AS revision, arg_max(status, k) AS status, max(conflicts) AS conflicts FROM s GROUP BY frame_id")
def e7_latest_revision(spark, sf):
    # Every seventh edit is stale; the one after it was made on the revision before that.
    r = view(spark, sf, "frames").withColumn("revision", F.row_number().over(Window.partitionBy("roi").orderBy("order_index")))
    r = r.select(F.col("roi").alias("frame_id"), "revision", "status", F.expr("case when revision % 7 = 0 then 0 when revision % 7 = 1 and revision > 1 then revision - 2 else revision - 1 end").alias("base_revision"))
    return W.latest_revision(r).join(r.groupBy("frame_id").agg(F.count("*").alias("edits")), "frame_id")


@query("WITH f AS (SELECT DISTINCT view, roi, frame AS time FROM labelled), s AS (SELECT view, count(DISTINCT roi) AS rois, max(time) + 1 AS times FROM f GROUP BY view), b AS (SELECT view, times, coalesce(sum(rois * times) OVER (ORDER BY view ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s) SELECT f.view, roi, time, CAST(base + (dense_rank() OVER (PARTITION BY f.view ORDER BY roi) - 1) * times + time AS BIGINT) AS order_index FROM f JOIN b ON b.view = f.view")
def e8_review_order(spark, sf):
    f = view(spark, sf, "labelled").selectExpr("view", "roi", "frame as time").distinct()
    return W.review_order(f).select("view", "roi", "time", F.col("order_index").cast("long").alias("order_index"))


@query("WITH g AS (SELECT dbname, cell_id, x, y, CAST(floor(intensity) AS BIGINT) % 3 AS label FROM grid) SELECT DISTINCT a.* FROM g a JOIN g b ON a.dbname = b.dbname AND a.cell_id = b.cell_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.label <> b.label")
def e9_label_boundaries(spark, sf):
    return W.label_boundaries(view(spark, sf, "grid").selectExpr("dbname", "cell_id", "x", "y", "bigint(floor(intensity)) % 3 as label"), K2)


@query("WITH p AS (SELECT cell_id, u1 AS pos, g AS value FROM profiles), c AS (SELECT a.cell_id, k - 6 AS shift, covar_pop(a.value, b.value) / ((stddev_pop(a.value) + 1e-6) * (stddev_pop(b.value) + 1e-6)) AS score FROM p a CROSS JOIN range(13) t(k) JOIN p b ON b.cell_id = a.cell_id AND b.pos = (a.pos + k - 6 + CAST(a.cell_id AS INT) % 4) % 64 WHERE a.pos BETWEEN 8 AND 45 GROUP BY a.cell_id, k) SELECT cell_id, CAST(shift AS INT) AS shift, score FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(score, 9) DESC, shift) AS rn FROM c) WHERE rn = 1", "score", 5)
def e10_best_shift(spark, sf):
    # Against itself turned by up to three places; the window's start is moved up to 8 by its distance from the end.
    turned = "transform(sequence(0, 63), i -> g[(i + int(cell_id) % 4) % 64])"
    return W.best_shift(profiles(spark, sf).selectExpr("cell_id", "g as reference", f"{turned} as current"), 6, 3, 46).select("cell_id", "shift", "score")


@query("SELECT frame_id, CAST(coalesce(sum(width) OVER (PARTITION BY roi ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x_offset FROM frames")
def e12_stitched_offsets(spark, sf):
    return W.stitched_offsets(view(spark, sf, "frames").withColumn("time", F.col("frame_id")), ["roi"]).select("frame_id", "x_offset")


@query("SELECT cell_id, bool_and(d >= 0 OR d IS NULL) AND max(g) > min(g) AND arg_max(g, u1) > arg_min(g, u1) AS monotone FROM (SELECT *, g - lag(g) OVER (PARTITION BY cell_id ORDER BY u1) AS d FROM (SELECT cell_id, u1, CASE WHEN CAST(cell_id AS INT) % 2 = 0 THEN CAST(u1 AS DOUBLE) ELSE g END AS g FROM profiles)) GROUP BY cell_id")
def e13_profile_monotone(spark, sf):
    return W.profile_monotone(profiles(spark, sf).withColumn("u1", F.expr("if(int(cell_id) % 2 = 0, u1, g)"))).select("cell_id", "monotone")


@query("SELECT dbname, CAST(row AS INT) AS row, cell_id FROM (SELECT dbname, cell_id, row_number() OVER (PARTITION BY dbname ORDER BY o_custkey, o_orderkey) AS row FROM cells) WHERE row BETWEEN 25 AND 48")
def f1_f5_page(spark, sf):
    return L.page(view(spark, sf, "cells"), 24, 2, []).select("dbname", "row", "cell_id")


@query("SELECT dbname, max(o_orderdate) AS updated_at FROM cells GROUP BY dbname")
def f3_datasets_by_recency(spark, sf):
    return tables.datasets_by_recency(view(spark, sf, "cells").groupBy("dbname").agg(F.max("o_orderdate").alias("updated_at")))


@query("SELECT dbname, cell_id, CAST(rank AS INT) AS rank, amplitude, n >= 3 AS at_cap FROM (SELECT *, row_number() OVER (PARTITION BY dbname, cell_id ORDER BY amplitude DESC, spot_id) AS rank, count(*) OVER (PARTITION BY dbname, cell_id) AS n FROM spots) WHERE rank <= 3")
def f4_cap_spots(spark, sf):
    return W.cap_spots(view(spark, sf, "spots"), 3).select("dbname", "cell_id", "rank", "amplitude", "at_cap")


@query(f"WITH m AS ({_BRIGHT}), d AS ({_DILATED.format('m')}) SELECT dbname, cell_id, count(*) AS n, CAST(sum(x * 11 + y) AS BIGINT) AS s FROM d GROUP BY ALL")
def g1_dilate(spark, sf):
    m = view(spark, sf, "grid").where("intensity > 60000")
    return P.dilate(m, P.SQUARE, K2, 51, 11).groupBy(*K2).agg(F.count("*").alias("n"), F.sum(F.expr("x * 11 + y")).alias("s"))


@query("WITH g AS (SELECT dbname, cell_id, x, y FROM grid), o AS (SELECT a - 1 AS i, b - 1 AS j FROM range(3) s(a), range(3) t(b)) SELECT dbname, cell_id, x, y FROM g, o WHERE (i = 0 OR j = 0) GROUP BY dbname, cell_id, x, y HAVING bool_and((x + i NOT BETWEEN 0 AND 50) OR (y + j NOT BETWEEN 0 AND 10) OR EXISTS (SELECT 1 FROM grid h WHERE h.dbname = g.dbname AND h.cell_id = g.cell_id AND h.x = g.x + i AND h.y = g.y + j))")
def g2_erode(spark, sf):
    return P.erode(view(spark, sf, "grid"), [(i, j) for i, j in P.SQUARE if i == 0 or j == 0], K2, 51, 11)


@query("WITH a AS (SELECT dbname, cell_id FROM cells WHERE area > 100000), b AS (SELECT dbname, cell_id FROM cells WHERE o_orderkey % 2 = 0) SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS union_n, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_n, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def g5_selections(spark, sf):
    c = view(spark, sf, "cells")
    return P.selections(c.where("area > 100000"), c.where("o_orderkey % 2 = 0"), K2)


# --- scalar functions, streams --------------------------------------------------------------------


@query("SELECT cell_id, o_custkey AS frame, o_orderkey AS idx, cell_id AS again, 'F_' || o_custkey AS safe FROM cells")
def h1_h2_ids(spark, sf):
    c, i = view(spark, sf, "cells"), F.col("cell_id")
    return c.select("cell_id", S.frame_of(i).alias("frame"), S.index_of(i).alias("idx"), S.make_cell_id(S.frame_of(i), S.index_of(i)).alias("again"), S.safe_name(F.concat(F.lit("F "), F.col("o_custkey").cast("string"))).alias("safe"))


@query("SELECT event_id, 'f' || CASE WHEN event_id // 12 > 99 THEN substr(CAST(event_id // 12 AS STRING), 1, 2) ELSE lpad(CAST(event_id // 12 AS STRING), 2, '0') END || '_t' || (event_id // 3) % 4 || '_z' || event_id % 3 AS name FROM events")
def h3_axis_name(spark, sf):
    return view(spark, sf, "events").select("event_id", S.axis_name(F.col("event_id"), 4, 3).alias("name"))


@query("SELECT dbname, cell_id, x, y, CAST(floor(least(greatest(intensity, 0.0), 65535.0) / 65535 * 255) AS BIGINT) AS v, CAST(round_even(least(greatest(intensity, 0.0), 65535.0) * (255 / 65535.0), 0) AS BIGINT) AS rounded, CASE WHEN max(intensity) OVER w > min(intensity) OVER w THEN CAST(floor((intensity - min(intensity) OVER w) / (max(intensity) OVER w - min(intensity) OVER w) * 255) AS BIGINT) ELSE 0 END AS ranged, CAST(round_even(least(intensity * 255.0 / CASE WHEN max(intensity) OVER w <= 255 THEN 255 WHEN max(intensity) OVER w <= 1023 THEN 1023 WHEN max(intensity) OVER w <= 4095 THEN 4095 WHEN max(intensity) OVER w <= 16383 THEN 16383 ELSE 65535 END, 255.0), 0) AS BIGINT) AS gained, CASE WHEN intensity <= 255 THEN 255 WHEN intensity <= 1023 THEN 1023 WHEN intensity <= 4095 THEN 4095 WHEN intensity <= 16383 THEN 16383 ELSE 65535 END AS limit_ FROM grid WINDOW w AS (PARTITION BY dbname, cell_id)")
def h4_scaling(spark, sf):
    i, w = F.col("intensity"), Window.partitionBy("dbname", "cell_id")
    low, high = F.min(i).over(w), F.max(i).over(w)
    return view(spark, sf, "grid").select("dbname", "cell_id", "x", "y", S.scale_fixed(i).alias("v"), S.scale_rounded(i).alias("rounded"), S.scale_range(i, low, high).alias("ranged"), S.scale_gain(i, high).alias("gained"), S.bit_depth_limit(i).alias("limit_"))


@query("SELECT o_orderkey, greatest(0, least(o_orderkey % 500 - 50, 400 - 64)) AS start FROM orders")
def h5_slid_box(spark, sf):
    return view(spark, sf, "orders").select("o_orderkey", S.slid_box(F.expr("o_orderkey % 500 - 50"), F.lit(64), F.lit(400)).alias("start"))


@query("SELECT dbname, CASE WHEN max(chars) > min(chars) THEN min(chars) - 0.06 * (max(chars) - min(chars)) ELSE min(chars) - greatest(0.06 * abs(min(chars)), 0.01) END AS low, CASE WHEN max(chars) > min(chars) THEN max(chars) + 0.06 * (max(chars) - min(chars)) ELSE max(chars) + greatest(0.06 * abs(max(chars)), 0.01) END AS high FROM scored GROUP BY dbname", "low high", 3)
def h10_plot_domain(spark, sf):
    from .operators.select import padded_domain

    return padded_domain(view(spark, sf, "scored"), "chars", ["dbname"])


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def h12_acquired_at(spark, sf):
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "'taken at 'yyyy-MM-dd HH:mm:ss' by x'"]
    text = F.when(F.lit(False), "")
    for k, f in enumerate(forms):
        text = text.when(F.col("event_id") % 4 == k, F.date_format("ts", f))
    return view(spark, sf, "events").select("event_id", S.acquired_at(text).alias("at"))


@query("SELECT dbname, cell_id, x, y, CAST(greatest(a, b) AS BIGINT) AS v FROM (SELECT dbname, cell_id, x, y, floor((max(CASE WHEN channel = 'A' THEN intensity END) - min(max(CASE WHEN channel = 'A' THEN intensity END)) OVER w) / (max(max(CASE WHEN channel = 'A' THEN intensity END)) OVER w - min(max(CASE WHEN channel = 'A' THEN intensity END)) OVER w) * 255) AS a, floor((max(CASE WHEN channel = 'R' THEN intensity END) - min(max(CASE WHEN channel = 'R' THEN intensity END)) OVER w) / (max(max(CASE WHEN channel = 'R' THEN intensity END)) OVER w - min(max(CASE WHEN channel = 'R' THEN intensity END)) OVER w) * 255) AS b FROM px WHERE channel IN ('A', 'R') GROUP BY dbname, cell_id, x, y WINDOW w AS (PARTITION BY dbname, cell_id)) WHERE greatest(a, b) IS NOT NULL")
def h13_composite(spark, sf):
    from .operators.select import composite

    return composite(view(spark, sf, "px"), "A", "R")


@query("SELECT dbname, cell_id, x, y, CAST(greatest(a, b) AS BIGINT) AS v FROM (SELECT dbname, cell_id, x, y, floor((max(CASE WHEN channel = 'A' THEN intensity END) - min(max(CASE WHEN channel = 'A' THEN intensity END)) OVER w) / (max(max(CASE WHEN channel = 'A' THEN intensity END)) OVER w - min(max(CASE WHEN channel = 'A' THEN intensity END)) OVER w) * 255) AS a, floor((max(CASE WHEN channel = 'R' THEN intensity END) - min(max(CASE WHEN channel = 'R' THEN intensity END)) OVER w) / (max(max(CASE WHEN channel = 'R' THEN intensity END)) OVER w - min(max(CASE WHEN channel = 'R' THEN intensity END)) OVER w) * 255) AS b FROM px WHERE channel IN ('A', 'R') AND x BETWEEN 5 AND 40 GROUP BY dbname, cell_id, x, y WINDOW w AS (PARTITION BY dbname, cell_id)) WHERE greatest(a, b) IS NOT NULL")
def h13_composite_inside(spark, sf):
    px = view(spark, sf, "px")
    return L.composite(px, "A", "R", px.where("x between 5 and 40"))


@query("WITH d AS (SELECT dbname, sha256('{\"cell_id\":\"' || cell_id || '\",\"manual_label\":' || coalesce('\"' || manual_label || '\"', 'null') || ',\"o_orderkey\":' || o_orderkey || '}') AS h FROM cells) SELECT dbname, count(*) AS cells, sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 12))::BIGINT) || ':' || sum(('0x' || substr(h, 13, 12))::BIGINT) || ':' || sum(('0x' || substr(h, 25, 12))::BIGINT) || ':' || sum(('0x' || substr(h, 37, 12))::BIGINT)) AS fingerprint FROM d GROUP BY dbname")
def h11_fingerprints(spark, sf):
    return tables.fingerprints(view(spark, sf, "cells"), ["cell_id", "manual_label", "o_orderkey"])


@query("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM activity WHERE action_name <> 'view' GROUP BY 1")
def i1_stream_daily_activity(spark, sf):
    """The stream itself, over all there is, into a table. A stream reads a folder or, as here, a pattern."""
    path = scratch(spark, "stream")
    log = spark.readStream.schema(view(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet").selectExpr("timestamp(ts) as created_at", "event_type as action_name")
    sink = activity.stream_daily_activity(log, view_action="view").writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    # In complete mode a batch holds all days so far: the last one written is the result.
    sink.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/days")).start().awaitTermination()
    return spark.read.parquet(f"{path}/days")


@query("SELECT dbname, count(*) AS n FROM cells GROUP BY dbname")
def i2_stream_new_cells(spark, sf):
    """The stream itself over the cells, each of them twice, into a table."""
    path = scratch(spark, "stream")
    orders = spark.readStream.schema(view(spark, sf, "orders").schema).parquet(f"{sf}/order[s].parquet")
    cells = orders.selectExpr("o_orderpriority as dbname", "concat('F', o_custkey, 'C', o_orderkey) as cell_id", "timestamp(o_orderdate) as created_at", "explode(array(1, 2)) as copy")
    activity.stream_new_cells(cells).writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start(f"{path}/cells").awaitTermination()
    return spark.read.parquet(f"{path}/cells").groupBy("dbname").agg(F.count("*").alias("n"))


# --- whole cells, frames and profiles: measured by numpy helpers in Spark's maps -------------------
def _fluo1(spark, sf):
    return images(spark, sf, "channel = 'fluo1'")


@query("SELECT dbname, cell_id, x, y, intensity FROM inside", "intensity", 2)
def j1_rasterize(spark, sf):
    return C.rasterize(_fluo1(spark, sf)).drop("channel")


@query("SELECT dbname, cell_id, x, y, t FROM inside", "t", 4)
def j2_axial_positions(spark, sf):
    px = C.axial_positions(_fluo1(spark, sf))
    # An axis has no sign: places count from the left.
    turned = px.groupBy(*K2).agg((F.max_by("t", "x") < F.min_by("t", "x")).alias("turned"))
    return px.join(turned, K2).select("dbname", "cell_id", "x", "y", F.when(F.col("turned"), 1 - F.col("t")).otherwise(F.col("t")).alias("t"))


@query("SELECT dbname, cell_id, CAST(x1 - x0 AS DOUBLE) AS length, CAST(y1 - y0 AS DOUBLE) AS width_mean, CAST(y1 - y0 AS DOUBLE) AS width_median FROM boxes", "length width_mean width_median", 3)
def j3_cell_widths(spark, sf):
    return C.cell_widths(_fluo1(spark, sf))


@query("WITH u AS (SELECT dbname, cell_id, round(t, 9) AS u, intensity FROM inside), b AS (SELECT *, least(floor(u * 35), 34) AS bin FROM u), m AS (SELECT dbname, cell_id, bin, max(intensity) AS m FROM b WHERE bin >= 1 GROUP BY ALL), f AS (SELECT dbname, cell_id, min(intensity) FILTER (u = 0) AS a, max(intensity) FILTER (u = 1) AS z FROM u GROUP BY ALL) SELECT dbname, cell_id, count(*) + 2 AS n, sum(m) + max(a) + max(z) AS total FROM m JOIN f USING (dbname, cell_id) GROUP BY ALL", "total", 2)
def j4_profile_vectors(spark, sf):
    return C.cell_profiles(_fluo1(spark, sf)).select(*K2, F.size("g").cast("long").alias("n"), F.aggregate("g", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("SELECT dbname, cell_id, CAST(k AS INT) AS k, CAST((x1 - x0) / 2.0 AS DOUBLE) AS along, CAST((y1 - y0) / 2.0 AS DOUBLE) AS across FROM boxes, range(4) t(k)", "along across", 4)
def j5_aligned_contours(spark, sf):
    # An axis has no sign: corners are compared by their distance from the middle.
    c = C.aligned_contours(_fluo1(spark, sf)).select(*K2, F.posexplode("contour").alias("k", "p"))
    return c.select(*K2, "k", F.abs("p.x").alias("along"), F.abs("p.y").alias("across"))


@query()
def j6_j9_cell_maps(spark, sf):
    """Each map's size, range and total: its 262,144 values stay in the tasks."""
    return C.cell_map_totals(_fluo1(spark, sf))


@query()
def d31_population_map(spark, sf):
    return C.population_map(_fluo1(spark, sf), True)


_SPOTS = "SELECT s, k, 20 + 40 * k + s % 7 * 0.5 AS x, 20 + (k - 1) * 3 + s % 3 * 0.25 AS y, 60 + 10 * k + s % 5 * 8 AS a FROM (SELECT DISTINCT l_suppkey AS s FROM {lineitem}) l JOIN (VALUES (0), (1), (2)) t(k) ON k < s % 4"


def _spot_cells(spark, sf):
    """Cells of 120 x 40 pixels with up to three spots on a slope with some noise."""
    spots = spark.sql(_SPOTS, lineitem=view(spark, sf, "lineitem")).groupBy("s").agg(F.collect_list(F.struct("x", "y", "a")).alias("spots"))
    s = view(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s")).distinct().join(spots, "s", "left")
    # Few rows, much work each: dealt out to all tasks by a key that Spark hasn't dealt them by, else it drops the step and merges them.
    s = s.withColumn("deal", F.xxhash64("s")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "deal").drop("deal")
    s = s.withColumn("noise", F.expr("transform(sequence(0, 4799), i -> pmod(hash(i, s), 2001))"))

    def drawn(pdfs):
        y, x = np.divmod(np.arange(4800), 120)
        # The slope and the noise have six decimals, halves away from zero.
        slope, steps = 30_000_000 + 20_000 * x, np.arange(-1000, 1001)
        noise = np.sign(steps) * ((np.abs(steps) * 2_000_000 + 700) // 1400)
        for pdf in pdfs:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                light = (slope + noise[np.stack(part["noise"].to_numpy())]) / 1e6
                for n, some in enumerate(part["spots"]):
                    if some is not None:
                        light[n] += sum(float(p["a"]) * np.exp(-((x - float(p["x"])) ** 2 + (y - float(p["y"])) ** 2) / 8) for p in some)
                yield pd.DataFrame({"s": part["s"], "pixels": list(light)})

    box = "array(struct(4D as x, 5D as y), struct(115D as x, 5D as y), struct(115D as x, 35D as y), struct(4D as x, 35D as y))"
    return s.mapInPandas(drawn, "s long, pixels array<double>").selectExpr("'spots' as dbname", "cast(s as string) as cell_id", "'fluo1' as channel", "40 as height", "120 as width", "pixels", f"{box} as contour")


@query(f"SELECT 'spots' AS dbname, CAST(s AS STRING) AS cell_id, round(x) AS x, round(y) AS y, CAST(row_number() OVER (PARTITION BY s ORDER BY a DESC) AS INT) AS rank FROM ({_SPOTS.format(lineitem='lineitem')})")
def j7_detect_spots(spark, sf):
    # Places are to a fifth of a pixel: halves are moved off their edge before they are rounded.
    off = lambda c: F.round(F.col(c) + 0.125) + 0.0
    return W.cap_spots(C.detect_spots(_spot_cells(spark, sf))).select("dbname", "cell_id", off("x").alias("x"), off("y").alias("y"), "rank")


_POINTS = "SELECT l_linestatus AS dbname, CAST(l_suppkey AS STRING) AS cell_id, l_linenumber AS spot_id, CAST(min(l_quantity) AS DOUBLE) AS x, CAST(min(round(l_discount * 100)) AS DOUBLE) AS y FROM {lineitem} GROUP BY l_linestatus, l_suppkey, l_linenumber"


@query(f"SELECT dbname, cell_id, spot_id, greatest(least((x - x0) / (x1 - x0), 1), 0) AS longitudinal, least(greatest(least((x - x0) / (x1 - x0), 1), 0), 1 - greatest(least((x - x0) / (x1 - x0), 1), 0)) AS nearest_pole, CASE WHEN x > x0 AND x < x1 AND y BETWEEN y0 AND y1 THEN (y - (y0 + y1) / 2.0) / ((y1 - y0) / 2.0) END AS lateral_at, CASE WHEN x <= x0 OR x >= x1 THEN 'no local width' WHEN y NOT BETWEEN y0 AND y1 THEN 'outside the section' END AS lateral_reason FROM ({_POINTS.format(lineitem='lineitem')}) p JOIN boxes b USING (dbname, cell_id) WHERE EXISTS (SELECT 1 FROM px WHERE px.dbname = p.dbname AND px.cell_id = p.cell_id AND channel = 'N')", "longitudinal nearest_pole lateral_at", 4)
def j8_locate_spots(spark, sf):
    points = spark.sql(_POINTS, lineitem=view(spark, sf, "lineitem")).withColumn("channel", F.lit("fluo1"))
    return C.locate_spots(points, _fluo1(spark, sf)).drop("channel")


def _frames(spark, sf):
    # Views 0 to 6 are those of database F, 7 to 13 the other's.
    return _fluo1(spark, sf).selectExpr("l_suppkey % 7 + if(dbname = 'F', 0, 7) as view", "l_suppkey % 3 as roi", "l_suppkey as frame", "dbname", "height", "width", "pixels", "transform(pixels, p -> int(p > 20000)) as mask")


@query("SELECT DISTINCT b.dbname, CAST(b.cell_id AS BIGINT) AS frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x // (3 + CAST(b.cell_id AS INT) % 4) + 1 AS INT) AS component FROM boxes b JOIN px ON px.dbname = b.dbname AND px.cell_id = b.cell_id AND px.channel = 'N', range(51) t(x), range(11) u(y) WHERE t.x % (3 + CAST(b.cell_id AS INT) % 4) < 2".replace("CAST(x ", "CAST(t.x ").replace("CAST(y ", "CAST(u.y "))
def j10_connected_components(spark, sf):
    # Stripes of two columns, one to four apart; the random masks are compared with a flood fill in the tests.
    stripes = "transform(sequence(0, 560), i -> int((i % 51) % (3 + l_suppkey % 4) < 2))"
    return C.connected_components(_frames(spark, sf).join(outlines(spark, sf, "channel = 'fluo1'").selectExpr("dbname", "l_suppkey as frame", f"{stripes} as stripes"), ["dbname", "frame"]).withColumn("mask", F.col("stripes")), ["dbname", "frame"])


@query("SELECT DISTINCT b.dbname, CAST(b.cell_id AS BIGINT) AS frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x // (3 + CAST(b.cell_id AS INT) % 4) + 1 AS INT) AS component FROM boxes b JOIN px ON px.dbname = b.dbname AND px.cell_id = b.cell_id AND px.channel = 'N', range(51) t(x), range(11) u(y) WHERE t.x % (3 + CAST(b.cell_id AS INT) % 4) < 2".replace("CAST(x ", "CAST(t.x ").replace("CAST(y ", "CAST(u.y "))
def j10_tiled_components(spark, sf):
    """The same stripes from tiles of frames, 5 across and 3 down, which cut stripes lengthwise and across."""
    stripes = "transform(sequence(0, 560), i -> int((i % 51) % (3 + l_suppkey % 4) < 2))"
    f = outlines(spark, sf, "channel = 'fluo1'").selectExpr("dbname", "l_suppkey as frame", "height", "width", f"{stripes} as mask")
    return T.tiled_components(T.cut_frames(f, ["dbname", "frame"], 5, 3, "mask"), ["dbname", "frame"])


@query()
def j12_tiled_regions(spark, sf):
    """Regions of every image of the table, from 3 x 2 tiles of it."""
    return T.segment_tiles(T.cut_frames(_film(spark, sf), ["view", "frame"], 3, 2, "pixels"), ["view", "frame"])


@query()
def j10_components_of_pixels(spark, sf):
    return C.connected_components(_frames(spark, sf), ["dbname", "frame"])


@query("SELECT dbname, cell_id, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS hull_perimeter, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS hull_area, 1.0::DOUBLE AS convexity, 1.0::DOUBLE AS solidity FROM boxes", "hull_perimeter hull_area convexity solidity", 4)
def j11_hull_measures(spark, sf):
    return C.hull_measures(_fluo1(spark, sf))


@query("SELECT DISTINCT 'f' AS dbname, l_suppkey AS frame, 'F' || l_suppkey || 'C0' AS cell_id, CAST(18 + l_suppkey % 40 AS INT) AS crop_x0, CAST(8 + l_suppkey % 20 AS INT) AS crop_y0, 153 AS area, 12.0::DOUBLE AS crop_cx, 12.0::DOUBLE AS crop_cy FROM lineitem WHERE 30 + l_suppkey % 40 < 60 AND 20 + l_suppkey % 20 > 24")
def j12_segment_frames(spark, sf):
    f = frames(spark, sf, 60, 120, lambda x, y, s, t: (abs(x - 30 - s % 40) <= 8) & (abs(y - 20 - s % 20) <= 4) | (abs(x - 100) <= 1) & (abs(y - 40) <= 1))
    out = C.cells_of_frames(f.selectExpr("'f' as dbname", "s as frame", "height", "width", "pixels"), ["dbname", "frame"], 0.13, size=24, low=24, high=60)
    return out.drop("component")


@query()
def j12_regions(spark, sf):
    return C.segment_frames(_frames(spark, sf), ["dbname", "frame"])


#: A quartic by least squares in SQL: polynomials that are orthogonal on the 64 places, by their recurrence, there and at 20,001 finer places, whose extrema are placed by a parabola.
_QUARTIC = "WITH x0_ AS (SELECT 0 AS fine, k AS i, k / 63.0::DOUBLE AS x, 1.0::DOUBLE AS p0 FROM range(64) t(k) UNION ALL SELECT 1, k, k / 20000.0::DOUBLE, 1.0::DOUBLE FROM range(20001) t(k)), "
_QUARTIC += "x1_ AS (SELECT *, x - (SELECT avg(x) FROM x0_ WHERE fine = 0) AS p1 FROM x0_), "
for _k in (2, 3, 4):
    _a, _b = f"(SELECT sum(x * p{_k - 1} * p{_k - 1}) / sum(p{_k - 1} * p{_k - 1}) FROM x{_k - 1}_ WHERE fine = 0)", f"(SELECT sum(p{_k - 1} * p{_k - 1}) / sum(p{_k - 2} * p{_k - 2}) FROM x{_k - 1}_ WHERE fine = 0)"
    _QUARTIC += f"x{_k}_ AS (SELECT *, (x - {_a}) * p{_k - 1} - {_b} * p{_k - 2} AS p{_k} FROM x{_k - 1}_), "
_QUARTIC += "co_ AS (SELECT dbname, cell_id, " + ", ".join(f"sum(g * p{k}) / sum(p{k} * p{k}) AS c{k}" for k in range(5)) + " FROM profiles JOIN x4_ ON fine = 0 AND i = u1 GROUP BY ALL), "
_QUARTIC += "y_ AS (SELECT dbname, cell_id, x, " + " + ".join(f"c{k} * p{k}" for k in range(5)) + " AS y FROM co_ CROSS JOIN x4_ WHERE fine = 1), "
_QUARTIC += "n_ AS (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after FROM y_ WINDOW w AS (PARTITION BY dbname, cell_id ORDER BY x)), "
_QUARTIC += "e_ AS (SELECT dbname, cell_id, y < before AS low, x + 0.5 * (before - after) / (before - 2 * y + after) / 20000 AS place, y - 0.125 * (before - after) * (before - after) / (before - 2 * y + after) AS v FROM n_ WHERE (y < before AND y <= after OR y > before AND y >= after) AND abs(before - 2 * y + after) * 20000.0 * 20000 / (63 * 63) > 1e-6), "
_QUARTIC += "s_ AS (SELECT dbname, cell_id, min(v) FILTER (low AND abs(place - 0.5) <= 0.15) AS lo, max(v) FILTER (NOT low) AS hi FROM e_ GROUP BY ALL), "
_QUARTIC += "flags AS (SELECT dbname, cell_id, CASE WHEN abs(lo) > 1e-8 AND abs(hi) > 1e-8 AND lo / hi <= 0.9 THEN 'within' ELSE 'outside' END AS flag FROM co_ LEFT JOIN s_ USING (dbname, cell_id)) "


@query(_QUARTIC + "SELECT dbname, cell_id, flag FROM flags")
def j13_separation_flag(spark, sf):
    return C.separation_flag(profiles(spark, sf))


@query(_QUARTIC + ", shares AS (SELECT dbname, flag, count(*) AS k FROM flags GROUP BY ALL), alls AS (SELECT dbname, count(DISTINCT cell_id) AS n FROM profiles GROUP BY ALL) SELECT dbname, flag, k / n AS share FROM shares JOIN alls USING (dbname)", "share")
def d36_separation_ratio(spark, sf):
    return C.separation_ratio(profiles(spark, sf))


@query("SELECT dbname, cell_id, (x1 - x0 + 1) * (y1 - y0 + 1) AS n, 3 AS groups FROM boxes WHERE (dbname, cell_id) IN (SELECT (dbname, cell_id) FROM px WHERE channel = 'N')")
def j14_cluster_points(spark, sf):
    """Sizes only; that each pixel is with its nearest centre is tested by hand."""
    c = C.cluster_points(_fluo1(spark, sf), 3)
    return c.groupBy(*K2).agg(F.count("*").alias("n"), F.count_distinct("grp").cast("int").alias("groups"))


_FEATURES = "n_points area log_area perimeter circularity bbox_w bbox_area extent aspect_ratio center_dx pca_major_var pca_minor_sd eccentricity hu_0 hu_1 fluo1_present fluo1_inside_mean fluo1_inside_p75 fluo1_outside_mean fluo1_outside_std fluo1_contrast"


@query("WITH q AS (SELECT dbname, cell_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM image WHERE channel = 'N' GROUP BY ALL), n AS (SELECT i.*, CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0), 1) ELSE 0 END AS u, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS inner_, x BETWEEN x0 - 6 AND x1 + 6 AND y BETWEEN y0 - 6 AND y1 + 6 AS near_ FROM image i JOIN q USING (dbname, cell_id) WHERE channel = 'N'), f AS (SELECT dbname, cell_id, avg(u) FILTER (inner_) AS im, quantile_cont(u, 0.75) FILTER (inner_) AS i75, avg(u) FILTER (near_ AND NOT inner_) AS om, stddev_pop(u) FILTER (near_ AND NOT inner_) AS os, stddev_pop(u) AS sd FROM n GROUP BY ALL), g AS (SELECT *, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h FROM boxes) SELECT dbname, cell_id, 4.0::DOUBLE AS n_points, w * h AS area, ln(1 + w * h) AS log_area, 2 * (w + h) AS perimeter, 4 * pi() * w * h / (4 * (w + h) * (w + h)) AS circularity, w + 1 AS bbox_w, (w + 1) * (h + 1) AS bbox_area, w * h / ((w + 1) * (h + 1)) AS extent, (w + 1) / (h + 1) AS aspect_ratio, abs(x0 + (w + 1) / 2 - 100) AS center_dx, w * w / 3 AS pca_major_var, sqrt(h * h / 3) AS pca_minor_sd, sqrt(1 - h * h / (w * w)) AS eccentricity, -log10((w * w + h * h) / 12 / (w * h)) AS hu_0, -log10(power((w * w - h * h) / 12 / (w * h), 2)) AS hu_1, 1.0::DOUBLE AS fluo1_present, im AS fluo1_inside_mean, i75 AS fluo1_inside_p75, om AS fluo1_outside_mean, os AS fluo1_outside_std, (im - om) / (sd + 1e-6) AS fluo1_contrast FROM g JOIN f USING (dbname, cell_id)", _FEATURES, 4)
def j15_contour_image_features(spark, sf):
    from .functions import geometry

    i = images(spark, sf)
    wide = i.groupBy("dbname", "cell_id").pivot("channel", ["ph", "fluo1", "fluo2"]).agg(F.first("pixels"))
    cells = images(spark, sf, "channel = 'fluo1'").join(wide, K2).withColumn("images", F.struct("ph", "fluo1", "fluo2"))
    at = {n: k for k, n in enumerate(geometry.feature_names())}
    return C.contour_image_features(cells).select(*K2, *(F.col("features")[at[n]].alias(n) for n in _FEATURES.split()))


@query("WITH w AS (SELECT k, exp(-k * k / 8.0) AS w FROM range(-6, 7) t(k)), z AS (SELECT sum(w) AS z FROM w), n AS (SELECT dbname, cell_id, count(*) AS n FROM profiles GROUP BY ALL) SELECT p.dbname, p.cell_id, p.u1, sum(w * q.g) / max(z) AS g FROM profiles p JOIN n USING (dbname, cell_id), w, z, profiles q WHERE q.dbname = p.dbname AND q.cell_id = p.cell_id AND q.u1 = CASE WHEN p.u1 + k < 0 THEN -p.u1 - k - 1 WHEN p.u1 + k >= n THEN 2 * n - 1 - p.u1 - k ELSE p.u1 + k END GROUP BY ALL", "g", 5)
def j16_smooth(spark, sf):
    return C.smooth_profiles(profiles(spark, sf), 2.0).select("dbname", "cell_id", F.posexplode("g").alias("u1", "g")).withColumn("u1", F.col("u1").cast("long"))


def _film(spark, sf):
    """Every image of the table as a frame of 11 x 51 pixels: a view is a channel and database, and suppliers that leave one remainder by 7."""
    of = ["l_suppkey % 7 + if(dbname = 'F', 0, 7) + case channel when 'ph' then 0 when 'fluo1' then 14 else 28 end as view", "l_suppkey div 7 as at"]
    i = images(spark, sf).selectExpr(*of, "height", "width", "pixels")
    first = items(spark, sf).selectExpr(*of).groupBy("view").agg(F.min("at").alias("first"))
    return i.join(F.broadcast(first), "view").selectExpr("view", "at - first as frame", "height", "width", "pixels")  # 42 views


def _taps(sigma: float, radius: int) -> str:
    return f"(SELECT k, exp(-k * k / {2 * sigma * sigma}) / sum(exp(-k * k / {2 * sigma * sigma})) OVER () AS w FROM range({-radius}, {radius + 1}) t(k))"


def _mirrored(i: str, n: int) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN {2 * n - 2} - ({i}) ELSE {i} END"


def _smoothed(table: str, pos: str, n: int) -> str:
    """A profile (view, frame, pos, v) smoothed by 2 pixels; its ends are mirrored with their edge."""
    at = f"a.{pos} + k"
    return f"SELECT a.view, a.frame, a.{pos} AS pos, sum(w * b.v) AS v FROM {table} a CROSS JOIN {_taps(2, 6)} JOIN {table} b ON b.view = a.view AND b.frame = a.frame AND b.{pos} = CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} >= {n} THEN {2 * n - 1} - ({at}) ELSE {at} END GROUP BY ALL"


def _shifted(table: str, lo: int, hi: int) -> str:
    """The best shift of each frame's profile against frame 0's on positions lo to hi."""
    score = "covar_pop(a.v, b.v) / ((stddev_pop(a.v) + 1e-6) * (stddev_pop(b.v) + 1e-6))"
    return f"SELECT view, frame, shift FROM (SELECT *, row_number() OVER (PARTITION BY view, frame ORDER BY round(score, 9) DESC, shift) AS rn FROM (SELECT b.view, b.frame, k - 2 AS shift, {score} AS score FROM {table} a CROSS JOIN range(5) t(k) JOIN {table} b ON b.view = a.view AND b.pos = a.pos + k - 2 WHERE a.frame = 0 AND a.pos BETWEEN {lo} AND {hi} GROUP BY ALL)) WHERE rn = 1"


_EDGES = f"""WITH film AS (SELECT *, s // 7 - min(s // 7) OVER (PARTITION BY view) AS frame FROM (SELECT CAST(cell_id AS BIGINT) AS s, CAST(cell_id AS BIGINT) % 7 + CASE WHEN dbname = 'F' THEN 0 ELSE 7 END + CASE channel WHEN 'A' THEN 0 WHEN 'N' THEN 14 ELSE 28 END AS view, x, y, round_even(least(v, 65535) * (255 / 65535.0::DOUBLE), 0) AS g FROM image)),
bx AS (SELECT a.view, a.frame, a.y, a.x, sum(w * b.g) AS g FROM film a CROSS JOIN {_taps(3, 9)} JOIN film b ON b.view = a.view AND b.frame = a.frame AND b.y = a.y AND b.x = {_mirrored("a.x + k", 51)} GROUP BY ALL),
bl AS (SELECT a.view, a.frame, a.y, a.x, round_even(round(sum(w * b.g), 9), 0) AS g FROM bx a CROSS JOIN {_taps(3, 9)} JOIN bx b ON b.view = a.view AND b.frame = a.frame AND b.x = a.x AND b.y = {_mirrored("a.y + k", 11)} GROUP BY ALL),
ac AS (SELECT a.view, a.frame, a.y, a.x, sum((2 - abs(k)) * b.g) AS g FROM bl a CROSS JOIN range(-1, 2) t(k) JOIN bl b ON b.view = a.view AND b.frame = a.frame AND b.y = a.y AND b.x = {_mirrored("a.x + k", 51)} GROUP BY ALL),
gr AS (SELECT a.view, a.frame, a.y, a.x, sum(k * b.g) AS g FROM ac a CROSS JOIN (VALUES (-1), (1)) t(k) JOIN ac b ON b.view = a.view AND b.frame = a.frame AND b.x = a.x AND b.y = {_mirrored("a.y + k", 11)} GROUP BY ALL),
pr AS (SELECT view, frame, y, avg(abs(g)) AS v FROM gr GROUP BY ALL), edges AS ({_smoothed("pr", "y", 11)})"""


@query(f"{_EDGES} SELECT view, frame, pos, v AS value FROM edges", "value", 4)
def j16_edge_profile(spark, sf):
    return C.edge_profiles(_film(spark, sf), ["view", "frame"]).select("view", "frame", F.posexplode("profile").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""{_EDGES}, down AS ({_shifted("edges", 4, 6)}), band AS (SELECT view, frame, shift, greatest(0, least(3 + shift, 9)) AS top FROM down),
wl AS (SELECT f.view, f.frame, f.x, quantile_cont(g, 0.9) AS v FROM film f JOIN band USING (view, frame) WHERE y >= top AND y < greatest(top + 1, least(5 + shift, 11)) GROUP BY ALL),
walls AS ({_smoothed("wl", "x", 51)}), across AS ({_shifted("walls", 4, 46)})
SELECT view, frame, CAST(a.shift AS INT) AS dx, CAST(d.shift AS INT) AS dy FROM across a JOIN down d USING (view, frame)""")
def e11_drift(spark, sf):
    return C.drift(written(_film(spark, sf), "film"))


def _samples(spark, sf):
    return view(spark, sf, "embeddings").selectExpr("vec_id as id", "cast(embedding as array<double>) as features", "int(label >= 5) as y")


@query()
def j17_annotator(spark, sf):
    s = _samples(spark, sf)
    return annotator.predict_annotator(s, annotator.fit_annotator(s.where("id % 5 <> 0")))


@query()
def j18_cross_validate(spark, sf):
    return annotator.cross_validate(_samples(spark, sf))


@query("WITH r AS (SELECT *, (x1 - x0)::DOUBLE AS w, CAST(round_even((x1 - x0) / 5.0, 0) AS BIGINT) AS n FROM boxes) SELECT dbname, cell_id, (k + 0.5) * w / n AS arc, x0 + (k + 0.5) * w / n AS x, y0::DOUBLE AS low, y1::DOUBLE AS high FROM r, LATERAL (SELECT unnest(range(n)) AS k)", "arc x low high", 3)
def j19_axis_ribs(spark, sf):
    # An axis has no sign: arcs count from the left.
    r = C.axis_ribs(_fluo1(spark, sf))
    turned = r.groupBy(*K2).agg((F.max_by("x0", "arc") < F.min_by("x0", "arc")).alias("turned"), F.sum("arc").alias("s"), F.count("*").alias("n"))
    arc = F.when(F.col("turned"), 2 * F.col("s") / F.col("n") - F.col("arc")).otherwise(F.col("arc"))
    return r.join(turned, K2).select(*K2, arc.alias("arc"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.least("y0", "y1").alias("low"), F.greatest("y0", "y1").alias("high"))


@query(f"""WITH c AS ({_COMPONENTS}), d AS (SELECT DISTINCT view, frame + 1 AS frame, x + i AS x, y + j AS y, label AS before FROM c, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j)),
a AS (SELECT view, frame, label, count(*) AS area FROM c GROUP BY ALL), p AS (SELECT c.view, c.frame, c.label, d.before, count(*) AS n FROM c JOIN d USING (view, frame, x, y) GROUP BY ALL),
q AS (SELECT view, frame, label, before FROM p JOIN a USING (view, frame, label) WHERE n >= greatest(8, round_even(area * 0.02, 0))), m AS (SELECT view, frame, label FROM q GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT c.view, c.frame, c.label, c.x, c.y, q.before, min((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)) AS d FROM c JOIN m USING (view, frame, label) JOIN q USING (view, frame, label) JOIN c o ON o.view = c.view AND o.frame = c.frame - 1 AND o.label = q.before GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY view, frame, label, x, y ORDER BY d, before) AS rn FROM e), f AS (SELECT *, count(*) OVER (PARTITION BY view, frame, label, before) AS n FROM w WHERE rn = 1)
SELECT view, frame, label, x, y, before AS parent FROM f WHERE n >= 8""")
def j20_split_recovered(spark, sf):
    px = view(spark, sf, "labelled").select("view", "frame", "label", "x", "y").distinct()
    return C.split_recovered(px, px, 8, 1)


_CELL = "power((x - 25 - s % 9 - 2 * t) / 12.0, 2) + power((y - 30) / 6.0, 2) <= 1 AND (t <> 2 OR abs(y - 30) <= 1)"
#: How the whole frame has moved at each time, across and down.
_MOVED = ((0, 0), (1, 1), (2, -1), (1, 2))


@query(f"SELECT s AS view, 0::BIGINT AS roi, t AS frame, 1 AS label, CAST(count(*) AS INT) AS area, avg(x) + any_value(dx) AS cx, avg(y) + any_value(dy) AS cy, CAST(min(x) + any_value(dx) AS INT) AS x0, CAST(max(x) + 1 + any_value(dx) AS INT) AS x1, t = 2 AS temporal_recovery FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem), (VALUES {', '.join(f'({t}::BIGINT, {x}, {y})' for t, (x, y) in enumerate(_MOVED))}) f(t, dx, dy), range(90) a(x), range(60) b(y) WHERE {_CELL} GROUP BY s, t", "cx cy", 3)
def j21_track_traps(spark, sf):
    """Drift, traps, rules and rows in one: a cell that moves in frames that drift, with walls and edges that show it.

    In frame 2 the cell is too thin for the strict rules, so the one before must support it.
    """

    def dark(x, y, s, t):
        x, y = x - _MOVED[t][0], y - _MOVED[t][1]
        cell = (((x - 25 - s % 9 - 2 * t) / 12.0) ** 2 + ((y - 30) / 6.0) ** 2 <= 1) & ((t != 2) | (abs(y - 30) <= 1))
        return cell | (76 <= x) & (x <= 80) | (x <= 3) & ((14 <= y) & (y <= 22) | (38 <= y) & (y <= 44))

    f = frames(spark, sf, 60, 90, dark, times=4).selectExpr("s as view", "t as frame", "height", "width", "pixels")
    rois = f.select("view").distinct().selectExpr("view", "0L as roi", "5L as x0", "5L as y0", "70L as x1", "55L as y1")
    rules = L.TrapRules(recovery=True, min_minor=1.5, max_elongation=15)
    return C.track_traps(f, rois, rules, C.drift(f)).drop("y0", "y1", "mean_intensity")


@query()
def j21_traps_of_pixels(spark, sf):
    """The same chain over every image of the table, dark where there is much light: two traps a view, and rules for small cells."""
    film = written(_film(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.greatest(65535 - v, F.lit(0.0)))), "film")
    rois = film.select("view").distinct().select("view", F.explode(F.expr("array(struct(0L as roi, 0L as x0, 0L as y0, 26L as x1, 11L as y1), struct(1L as roi, 26L as x0, 0L as y0, 51L as x1, 11L as y1))")).alias("r")).select("view", "r.*")
    return C.track_traps(film, rois, SMALL_CELLS, C.drift(film))


#: Shapes of a few pixels have several least rectangles, so sizes decide here.
SMALL_CELLS = L.TrapRules(side_margin=1, min_area=4, min_minor=0, max_minor=1e9, min_major=0, max_major=1e9, min_elongation=0, max_elongation=1e9, max_mean=120, min_contrast=40, recovery=True, radius=2)


@query("SELECT b.dbname, b.cell_id, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS old_area, CAST((least(x1 + 2, 50) - greatest(x0 - 2, 0) + 1) * (least(y1 + 2, 10) - greatest(y0 - 2, 0) + 1) AS BIGINT) AS area, 'updated' AS status FROM boxes b WHERE CAST(cell_id AS BIGINT) % 3 = 1 AND (dbname, cell_id) IN (SELECT (dbname, cell_id) FROM px WHERE channel = 'N')")
def g4_elastic_mask(spark, sf):
    return C.elastic_mask(_fluo1(spark, sf), 2, "1").select(*K2, "status", *(F.col(c).cast("long").alias(c) for c in ("old_area", "area")))


@query("SELECT dbname, cell_id, CAST(y AS INT) AS y, CAST(greatest(x0 - 2, 0) AS INT) AS x0, CAST(least(x1 + 2, 50) AS INT) AS x1 FROM boxes, range(11) t(y) WHERE y BETWEEN y0 - 2 AND y1 + 2 AND (dbname, cell_id) IN (SELECT (dbname, cell_id) FROM px WHERE channel = 'N')")
def g4_elastic_runs(spark, sf):
    """The new masks themselves."""
    return C.mask_runs(C.elastic_mask(_fluo1(spark, sf), 2))


@query("SELECT dbname, count(*) AS total, count(*) FILTER (y1 - y0 >= 8) AS updated, count(*) FILTER (y1 - y0 < 8) AS failed FROM boxes WHERE (dbname, cell_id) IN (SELECT (dbname, cell_id) FROM px WHERE channel = 'N') GROUP BY dbname")
def g4_elastic_report(spark, sf):
    # Four steps leave nothing of a mask of up to eight rows.
    return C.elastic_report(C.elastic_mask(_fluo1(spark, sf), -4))


_METRICS = "normalized_median entropy_norm hoyer_sparsity top10_fraction polar_enrichment midcell_enrichment axial_spread axial_offset axial_asymmetry background_intensity".split()
_PHENOTYPE = """WITH o AS (SELECT * FROM (VALUES (0, -3), (-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), (3, -1), (-3, 0), (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0), (3, 0), (-3, 1), (-2, 1), (-1, 1), (0, 1), (1, 1), (2, 1), (3, 1), (-2, 2), (-1, 2), (0, 2), (1, 2), (2, 2), (0, 3)) o(i, j)),
b AS (SELECT dbname, cell_id, channel, quantile_cont(v, 0.5) AS bg FROM image WHERE channel <> 'A' AND NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AND EXISTS (SELECT 1 FROM o WHERE x - i BETWEEN x0 AND x1 AND y - j BETWEEN y0 AND y1) GROUP BY ALL),
w AS (SELECT dbname, cell_id, channel, v, bg, greatest(v - bg, 0) AS w, CAST(x - x0 AS DOUBLE) / (x1 - x0) AS t FROM image JOIN b USING (dbname, cell_id, channel) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
r AS (SELECT *, sum(w) OVER k AS s, count(*) OVER k AS n, row_number() OVER (k ORDER BY w DESC) AS r, t <= 0.2 + 1e-7 OR t >= 0.8 - 1e-7 AS pole, t BETWEEN 0.4 - 1e-7 AND 0.6 + 1e-7 AS mid FROM w WINDOW k AS (PARTITION BY dbname, cell_id, channel)),
m AS (SELECT dbname, cell_id, channel, CASE WHEN max(v) > 0 THEN quantile_cont(v, 0.5) / max(v) ELSE 0 END AS normalized_median, -sum(CASE WHEN w > 0 THEN w / s * ln(w / s) ELSE 0 END) / ln(max(n)) AS entropy_norm, (sqrt(max(n)) - sum(w) / sqrt(sum(w * w))) / (sqrt(max(n)) - 1) AS hoyer_sparsity,
sum(CASE WHEN r <= greatest(ceil(n * 0.1), 1) THEN w / s ELSE 0 END) AS top10_fraction, sum(CASE WHEN pole THEN w ELSE 0 END) / sum(w) / avg(CAST(pole AS INT)) AS polar_enrichment, sum(CASE WHEN mid THEN w ELSE 0 END) / sum(w) / avg(CAST(mid AS INT)) AS midcell_enrichment,
sqrt(greatest(sum(w * t * t) / sum(w) - power(sum(w * t) / sum(w), 2), 0)) AS axial_spread, abs(2 * sum(w * t) / sum(w) - 1) AS axial_offset, abs(1 - 2 * sum(CASE WHEN abs(t - 0.5) <= 1e-7 THEN w / 2 WHEN t < 0.5 THEN w ELSE 0 END) / sum(w)) AS axial_asymmetry, max(bg) AS background_intensity FROM r GROUP BY ALL HAVING sum(w) > 0
UNION ALL SELECT dbname, cell_id, channel, CASE WHEN max(v) > 0 THEN quantile_cont(v, 0.5) / max(v) ELSE 0 END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, max(bg) FROM r GROUP BY ALL HAVING sum(w) = 0)
SELECT DISTINCT b.dbname, b.cell_id, CAST(CAST(b.cell_id AS BIGINT) % 3 AS STRING) AS manual_label, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area_px2, CAST(x1 - x0 AS DOUBLE) AS length, CAST(y1 - y0 AS DOUBLE) AS width_mean, CAST(y1 - y0 AS DOUBLE) AS width_median, """ + ", ".join(f"p.{m} AS fluo1_{m}" for m in _METRICS) + ", " + ", ".join(f"q.{m} AS fluo2_{m}" for m in _METRICS) + """
FROM boxes b LEFT JOIN m p ON p.dbname = b.dbname AND p.cell_id = b.cell_id AND p.channel = 'N' LEFT JOIN m q ON q.dbname = b.dbname AND q.cell_id = b.cell_id AND q.channel = 'R'"""
_DOUBLES = " ".join(["area_px2 length width_mean width_median", *(f"{c}_{m}" for c in ("fluo1", "fluo2") for m in _METRICS)])


@query(_PHENOTYPE, _DOUBLES, 3)
def d11_phenotype_features(spark, sf):
    return phenotype.phenotype_features(images(spark, sf))


@query("WITH c AS (SELECT dbname, cell_id, x1 - x0 AS w FROM boxes WHERE CAST(cell_id AS BIGINT) % 3 = 1) SELECT dbname, cell_id, CAST(w AS DOUBLE) AS length, CAST(count(*) OVER (PARTITION BY dbname) AS BIGINT) AS cell_count, false AS failed FROM c UNION ALL SELECT 'missing', NULL, NULL, 0, true", "length", 3)
def d12_phenotype_comparison(spark, sf):
    path = scratch(spark, "experiments")
    paths = [f"{path}/{n}" for n in ("F", "O", "F", "missing")]
    for p in paths[:2]:
        images(spark, sf, f"dbname = '{p[-1]}'").drop("dbname").write.parquet(p)
    out, status = phenotype.phenotype_comparison(spark, paths, "1")
    return status.join(out, "dbname", "left").select("dbname", "cell_id", "length", "cell_count", F.col("error").isNotNull().alias("failed"))


@query("SELECT dbname, cell_id FROM boxes WHERE CAST(cell_id AS BIGINT) % 4 > 0")
def b4_require_channel(spark, sf):
    i = images(spark, sf).withColumn("contour", F.expr("if(l_suppkey % 4 = 0, null, contour)"))
    return L.require_channel(i, "fluo1", True).select("dbname", "cell_id")


@query(f"WITH m AS ({_BRIGHT}), d AS (SELECT DISTINCT dbname, cell_id, x + i AS x, y + j AS y FROM m, (VALUES (0, -3), (-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), (3, -1), (-3, 0), (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0), (3, 0), (-3, 1), (-2, 1), (-1, 1), (0, 1), (1, 1), (2, 1), (3, 1), (-2, 2), (-1, 2), (0, 2), (1, 2), (2, 2), (0, 3)) o(i, j) WHERE x + i BETWEEN 0 AND 50 AND y + j BETWEEN 0 AND 10) SELECT dbname, cell_id, x, y FROM d ANTI JOIN m USING (dbname, cell_id, x, y)")
def g3_ring(spark, sf):
    return P.ring(view(spark, sf, "grid").where("intensity > 60000"), 7, K2, 51, 11)


@query("SELECT dbname, cell_id, CAST(2 * (x1 - x0 + y1 - y0) AS BIGINT) AS points, CAST((x1 - x0 + y1 - y0) * (x0 + x1) AS DOUBLE) AS sum_x FROM boxes", "sum_x", 3)
def h6_densify(spark, sf):
    d = L.densify(outlines(spark, sf, "channel = 'fluo1'"))
    return d.select("dbname", "cell_id", F.size("contour").cast("long").alias("points"), F.aggregate("contour", F.lit(0.0), lambda s, p: s + p["x"]).alias("sum_x"))


@query("SELECT dbname, cell_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS poly_area FROM boxes", "poly_area", 3)
def h7_contour_json(spark, sf):
    text = L.json_of_contour(F.col("contour"))
    return A.polygon_measures(outlines(spark, sf, "channel = 'fluo1'").withColumn("contour", L.contour_of_json(text))).select("dbname", "cell_id", "poly_area")


@query("SELECT o_orderkey, CAST(round(x0 * 2.0) AS BIGINT) AS x0, CAST(round(y0 * 0.5) AS BIGINT) AS y0, CAST(dense_rank() OVER (PARTITION BY view ORDER BY round(y0 * 0.5), round((y0 + 9) * 0.5)) AS INT) AS band FROM (SELECT o_orderkey, o_custkey % 20 AS view, o_orderkey % 100 AS x0, o_orderkey % 7 * 10 AS y0 FROM orders)")
def h9_roi_bands(spark, sf):
    r = view(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey % 20 as view", "o_orderkey % 100 as x0", "o_orderkey % 100 + 5 as x1", "o_orderkey % 7 * 10 as y0", "o_orderkey % 7 * 10 + 9 as y1")
    return L.roi_bands(r, 100, 80, 200, 40).select("o_orderkey", "x0", "y0", "band")
