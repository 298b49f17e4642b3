"""Stand-ins: the library's tables as views of the given ones, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordering import frequent

#: {name} is a given table or a view above it.
VIEWS = {
    "cells": """SELECT o_orderpriority AS dbname, concat('F', o_custkey, 'C', o_orderkey) AS cell_id,
        CASE WHEN o_orderstatus = 'O' THEN '1' WHEN o_orderstatus = 'P' THEN '2' WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '1000' ELSE ' n/a ' END AS manual_label,
        o_totalprice AS area, o_orderkey, o_custkey, o_orderdate, CAST(o_orderkey % 5 AS DOUBLE) * 0.03 AS pixel_size_um FROM {orders}""",
    "px": """SELECT l_linestatus AS dbname, CAST(l_suppkey AS STRING) AS cell_id, l_returnflag AS channel, CAST(l_quantity AS INT) AS x,
        CAST(round(l_discount * 100) AS INT) AS y, l_extendedprice AS intensity FROM {lineitem}""",
    "grid": "SELECT dbname, cell_id, x, y, max(intensity) AS intensity FROM {px} GROUP BY dbname, cell_id, x, y",
    "small": """SELECT l_linestatus AS dbname, CAST(l_orderkey AS STRING) AS cell_id, CAST(l_quantity AS DOUBLE) AS x, round(l_discount * 100) AS y, l_extendedprice AS intensity FROM {lineitem}""",
    "activity": "SELECT event_id AS id, ts AS created_at, event_type AS action_name FROM {events}",
    "spots": """SELECT o_orderpriority AS dbname, CAST(l_orderkey AS STRING) AS cell_id, l_linenumber AS spot_id, round(l_discount * 10, 2) AS longitudinal,
        round(least(l_discount * 10, 1 - l_discount * 10), 2) AS nearest_pole, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END AS lateral_at, l_extendedprice AS amplitude
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "spot_cells": "SELECT o_orderpriority AS dbname, CAST(o_orderkey AS STRING) AS cell_id, CASE WHEN o_orderstatus = 'P' THEN 'skipped' ELSE 'ok' END AS status, o_orderkey % 11 = 0 AS at_cap FROM {orders}",
    "scored": """SELECT d.lang AS dbname, d.source AS label, l.doc_id AS doc_id, l.quality AS y, least(CAST(d.n_chars AS DOUBLE) / 5000, 1.0) AS score, CAST(d.n_chars AS DOUBLE) AS chars
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "frames": """SELECT event_id AS frame_id, user_id % 7 AS view, user_id AS roi, event_id AS order_index, CASE WHEN event_type = 'view' THEN 'pending' ELSE 'reviewed' END AS status,
        CAST(floor(value) AS BIGINT) + 1 AS width FROM {events}""",
    "labelled": """SELECT l_suppkey % 7 AS view, l_suppkey AS roi, l_partkey % 5 AS frame, l_linenumber AS label, CAST(l_quantity AS INT) AS x, CAST(round(l_discount * 100) AS INT) AS y,
        max(l_extendedprice) AS intensity FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6""",
}
VIEWS["boxes"] = "SELECT DISTINCT l_linestatus AS dbname, CAST(l_suppkey AS STRING) AS cell_id, l_suppkey % 5 AS x0, 45 + l_suppkey % 6 AS x1, 1 + l_suppkey % 2 AS y0, 8 + l_suppkey % 3 AS y1 FROM {lineitem}"
VIEWS["fluo1"] = "SELECT dbname, cell_id, x, y, max(intensity) AS intensity FROM {px} WHERE channel = 'N' GROUP BY dbname, cell_id, x, y"
#: These two are for the SQL only: all pixels of a cell's image a channel, and fluo1's inside the contour.
VIEWS["image"] = """SELECT b.*, c.channel AS channel, t.x AS x, u.y AS y, coalesce(p.intensity, 0) AS v FROM {boxes} b JOIN (SELECT DISTINCT dbname, cell_id, channel FROM {px}) c ON c.dbname = b.dbname AND c.cell_id = b.cell_id
        CROSS JOIN range(51) t(x) CROSS JOIN range(11) u(y) LEFT JOIN (SELECT dbname, cell_id, channel, x, y, max(intensity) AS intensity FROM {px} GROUP BY ALL) p ON p.dbname = b.dbname AND p.cell_id = b.cell_id AND p.channel = c.channel AND p.x = t.x AND p.y = u.y"""
VIEWS["inside"] = "SELECT dbname, cell_id, x, y, v AS intensity, CAST(x - x0 AS DOUBLE) / (x1 - x0) AS t, x0, x1, y0, y1 FROM {image} WHERE channel = 'N' AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs})


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "embeddings").selectExpr("cast(label as string) as dbname", "cast(vec_id as string) as cell_id", "transform(sequence(0, size(embedding) - 1), i -> double(i)) as u1", "cast(embedding as array<double>) as g")


BOX = "l_suppkey % 5 AS x0, 45 + l_suppkey % 6 AS x1, 1 + l_suppkey % 2 AS y0, 8 + l_suppkey % 3 AS y1"
CHANNEL = "CASE l_returnflag WHEN 'A' THEN 'ph' WHEN 'N' THEN 'fluo1' ELSE 'fluo2' END"


#: An image's key, its size, and the items that a task draws on average at most.
IMAGE, HEIGHT, WIDTH, MOST_ITEMS = ["l_suppkey", "dbname", "channel"], 11, 51, 1 << 22


def items(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """The items that are pixels of an image: its key, their place in it and value."""
    px = view(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_linestatus as dbname", f"{CHANNEL} as channel", f"int(round(l_discount * 100)) * {WIDTH} + int(l_quantity) as at", "l_extendedprice as v")
    return px.where(f"at between 0 and {HEIGHT * WIDTH - 1}").where(where)


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images of lists of items, so many at a time: the greatest value at each place, 0 where none is."""
    size = HEIGHT * WIDTH
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            b = batch.slice(lo, 512)
            e, n = b.column("e").flatten(), b.num_rows
            of = np.repeat(np.arange(n), b.column("e").value_lengths().to_numpy())
            some = e.field("v").is_valid().to_numpy(zero_copy_only=False)
            at = (of * size + e.field("at").to_numpy())[some]
            values, known = np.full(n * size, -np.inf), np.zeros(n * size, bool)
            np.maximum.at(values, at, e.field("v").to_numpy(zero_copy_only=False)[some])
            known[at] = True
            pixels = pa.ListArray.from_arrays(np.arange(0, n * size + 1, size, dtype=np.int32), np.where(known, values, 0.0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in IMAGE), pixels], [*IMAGE, "pixels"])


def images(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Cells with images: a supplier's items as 51 x 11 pixels a channel (0 where none), and a rectangle as contour; ``where`` is about an image's key.

    Items are shuffled once, by image, and listed there. An image with over 1 / MANY of them comes down to its pixels before, so
    none is one task's work or a long list. Parts grow in number with the items, whatever the session's number of partitions.
    """
    px, key = items(spark, sf_dir, where), F.xxhash64(*IMAGE)
    hot, n = frequent(px, IMAGE)
    if hot:
        px = px.where(~key.isin(hot)).unionByName(px.where(key.isin(hot)).groupBy(*IMAGE, "at").agg(F.max("v").alias("v")))
    parts = n // MOST_ITEMS + 1
    px = px.repartition(parts, *IMAGE) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else px.repartition(*IMAGE)
    listed = px.groupBy(*IMAGE).agg(F.collect_list(F.struct("at", "v")).alias("e"))
    return _outlined(listed.mapInArrow(filled, "l_suppkey long, dbname string, channel string, pixels array<double>"), "pixels")


def outlines(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """`images` without their pixels, which aren't drawn for it."""
    return _outlined(items(spark, sf_dir, where).select(*IMAGE).distinct())


def _outlined(img: DataFrame, *pixels: str) -> DataFrame:
    corner = "struct(double({0}) as x, double({1}) as y)"
    contour = ", ".join(corner.format(*c) for c in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))
    img = img.selectExpr("*", *(e for e in BOX.split(", ")))
    return img.selectExpr("dbname", "cast(l_suppkey as string) as cell_id", "channel", f"{HEIGHT} as height", f"{WIDTH} as width", *pixels, f"array({contour}) as contour", "cast(l_suppkey % 3 as string) as manual_label", "double((x1 - x0) * (y1 - y0)) as area", "x0", "x1", "y0", "y1", "l_suppkey")


def frames(spark: SparkSession, sf_dir: str, height: int, width: int, dark: Callable, light: int = 220, times: int = 1) -> DataFrame:
    """Frames with an ellipse or box a supplier: ``dark`` tells it for arrays of places x, y, a supplier s and a time t (0 to times - 1)."""
    s = view(spark, sf_dir, "lineitem").select("l_suppkey").distinct().selectExpr("l_suppkey as s", f"explode(sequence(0L, {times - 1}L)) as t")
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s", "t")  # few rows, much work each: not to be merged

    def drawn(pdfs):
        y, x = np.divmod(np.arange(height * width), width)
        for pdf in pdfs:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                yield part.assign(height=height, width=width, pixels=[np.where(dark(x, y, i, t), 60.0, light) * 257 for i, t in zip(part["s"], part["t"])])

    return s.mapInPandas(drawn, "s long, t long, height int, width int, pixels array<double>")


PROFILES_SQL = "SELECT CAST(label AS STRING) AS dbname, CAST(vec_id AS STRING) AS cell_id, unnest(CAST(embedding AS DOUBLE[])) AS g, generate_subscripts(embedding, 1) - 1 AS u1 FROM embeddings"


def oracle(body: str, rounded: str = "", digits: int = 6) -> str:
    """body with the views that it names in front, its columns in ``rounded`` rounded."""
    views = VIEWS | {"profiles": PROFILES_SQL}
    order, found = list(views), []

    def need(text: str) -> None:
        for n in order:
            if re.search(rf"\b{n}\b", text) and n not in found:
                need(re.sub(rf"\b{n}\b", "", views[n]) if n in views[n] and f"{{{n}}}" not in views[n] else views[n])
                found.append(n)

    need(body)
    ctes = ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', views[n])})" for n in found)
    if rounded:
        body = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in rounded.split())}) FROM ({body})"
    for head in ("WITH RECURSIVE ", "WITH "):
        if found and body.startswith(head):
            return f"{head}{ctes}, {body.removeprefix(head)}"
    return (f"WITH {ctes} " if found else "") + body
