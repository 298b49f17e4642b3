"""Cell tables in and out: Parquet, JDBC, unions of experiments, exports, manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordering import placed
from .sqlite_cells import read_sqlite

#: Columns of a cell table that older files may lack.
OPTIONAL = {
    "label_experiment": "string", "manual_label": "string", "perimeter": "double", "area": "double", "img_fluo1": "array<int>", "img_fluo2": "array<int>",
    "center_x": "double", "center_y": "double", "user_id": "string", "objective_magnification": "string", "pixel_size_um": "double",
}


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None, **options) -> DataFrame:
    """Parquet; SQLite files, by ranges of rows; or JDBC with its driver's options (url, driver) and bounds (`jdbc_bounds`). Columns and filters reach the source."""
    if fmt == "sqlite":
        return read_sqlite(spark, path, columns, **options)
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.format(fmt).options(dbtable="cells", **options).load(path or None)
    return df.select(*columns) if columns else df


def jdbc_bounds(low: int, high: int, rows: int = 50_000) -> dict[str, str]:
    """Options that cut a JDBC table into ranges of about so many ids, a task each; rows outside low to high still come, with the first and last range."""
    return {"partitionColumn": "id", "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(max(1, -(-(high + 1 - low) // rows)))}


def migrate_cells(df: DataFrame) -> DataFrame:
    """Old tables in today's columns, with the default objective and pixel size."""
    if "img_fluo" in df.columns and "img_fluo1" not in df.columns:
        df = df.withColumnRenamed("img_fluo", "img_fluo1")
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns})
    objective, pixel = F.trim("objective_magnification"), F.col("pixel_size_um")
    return df.withColumns({"objective_magnification": F.when(objective.isNull() | (objective == ""), "100x").otherwise(objective), "pixel_size_um": F.when(pixel.isNull() | (pixel <= 0), S.DEFAULT_PIXEL).otherwise(pixel)})


def database_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def union_databases(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, status): all tables tagged with their name, the first of a name wins; a table that isn't there is a status row."""
    first: dict[str, str] = {}
    for p in paths:
        first.setdefault(database_name(p), p)
    cells, errors = None, []
    for name, path in first.items():
        try:
            df = migrate_cells(read_cells(spark, path)).withColumn("dbname", F.lit(name))
        except AnalysisException as e:
            errors.append((name, str(e).split("\n")[0][:200]))
            continue
        cells = df if cells is None else cells.unionByName(df, allowMissingColumns=True)
    wanted = spark.createDataFrame([(n, dict(errors).get(n)) for n in first], "dbname string, error string")
    if cells is None:
        return spark.createDataFrame([], "dbname string, cell_id string"), wanted.withColumn("cell_count", F.lit(0).cast("long"))
    counts = cells.groupBy("dbname").agg(F.count("*").alias("cell_count"))
    return cells, wanted.join(counts, "dbname", "left").withColumn("cell_count", F.coalesce("cell_count", F.lit(0)))


def write_cells(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("dbname").parquet(path)


def export_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", quoteAll=quote_all, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def build_manifest(cells: DataFrame) -> DataFrame:
    """A document a source: views, their channels, counts of each frame and totals."""
    frames = cells.groupBy("source", "view", "roi", "frame").agg(F.count("*").alias("cells"))
    rois = frames.groupBy("source", "view", "roi").agg(F.sort_array(F.collect_list(F.struct("frame", "cells"))).alias("frames"), F.sum("cells").alias("total"))
    views = rois.groupBy("source", "view").agg(F.sort_array(F.collect_list(F.struct("roi", "frames", "total"))).alias("channels"), F.sum("total").alias("total"))
    docs = views.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("view", "channels", "total"))).alias("views"), F.sum("total").alias("total"))
    return docs.select("source", "total", F.to_json(F.struct("source", "views", "total")).alias("manifest"))


def cells_bundle_manifest(images: DataFrame) -> DataFrame:
    """Per cell which channels there are, and its file's name with a running number within the database."""
    flags = images.groupBy("dbname", "cell_id").pivot("channel", list(S.CHANNELS)).agg(F.max(F.col("present").cast("int")))
    flags = placed(flags, ["dbname"], ["cell_id"])
    name = F.concat(F.lpad((F.col("place") - 1).cast("string"), 6, "0"), F.lit("_"), S.safe_name(F.col("cell_id")), F.lit(".png"))
    return flags.select("dbname", "cell_id", *(F.coalesce(c, F.lit(0)).alias(f"has_{c}") for c in S.CHANNELS), name.alias("file_name"))


def annotation_manifest(df: DataFrame) -> DataFrame:
    ok = df.where("has_image and has_contour")
    return ok.select("dbname", "cell_id", S.canonical_label(F.col("manual_label")).alias("label"), F.concat(S.safe_name(F.col("cell_id")), F.lit(".png")).alias("file_name"))


def datasets_by_recency(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("updated_at"), "dbname")


def fingerprints(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest for each cell, and one for each database over its cells' digests, added up so that no cell list is gathered."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    each = df.select("dbname", "cell_id", digest.alias("digest"))
    number = lambda k: F.conv(F.substring("digest", k, 12), 16, 10).cast("decimal(38,0)")
    return each.groupBy("dbname").agg(F.count("*").alias("cells"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(F.sum(number(k)).cast("string") for k in (1, 13, 25, 37))), 256).alias("fingerprint"))
