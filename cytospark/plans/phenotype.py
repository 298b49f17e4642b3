"""Phenotypes of populations: all measurements of a cell in one row, and experiments compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import cells as C
from ..operators import select as L
from ..operators.ordering import written
from ..sources import tables

CHANNELS = ("fluo1", "fluo2")
METRICS = ("normalized_median", "entropy_norm", "hoyer_sparsity", "top10_fraction", "polar_enrichment", "midcell_enrichment", "axial_spread", "axial_offset", "axial_asymmetry", "background_intensity")


def phenotype_features(cells: DataFrame, label: str | None = None, degree: int = 4, background: str = "local_ring") -> DataFrame:
    """One row a cell (cells: a row a channel): shape once, and ten metrics a channel; what can't be measured is NULL.

    background: local_ring, or none (0 everywhere). Images go through Python once; their pixels, which that gives
    with their place, are written and shuffled once, by cell; all aggregations reuse that.
    """
    if degree < 1:
        raise ValueError("degree is at least 1")
    if background not in ("local_ring", "none"):
        raise ValueError(f"unknown background {background}")
    k = C.CELL
    cells = L.filter_label(cells, label, "phenotype")
    ok = cells.where("contour is not null and pixels is not null and size(contour) >= 3")
    m = written(C.measured(ok, degree), "measured-cells")
    px = m.where("intensity is not null").select(*k, F.explode(F.arrays_zip("intensity", "t")).alias("p")).select(*k, "p.intensity", "p.t").repartition("dbname", "cell_id")
    back = m.select(*k, "background" if background == "local_ring" else F.lit(0.0).alias("background"))
    w = px.join(back.where("background is not null"), k).withColumn("w", F.greatest(F.col("intensity") - F.col("background"), F.lit(0.0)))
    metrics = A.normalized_median(px, k).join(back.withColumnRenamed("background", "background_intensity"), k, "left")
    metrics = metrics.join(A.concentration(px, back.where("background is not null"), k), k, "left").join(A.axial_localization(w, k), k, "left")
    metrics = metrics.withColumns({m: S.finite_or_null(F.col(m)) for m in METRICS})
    wide = metrics.groupBy("dbname", "cell_id").pivot("channel", list(CHANNELS)).agg(*(F.first(m).alias(m) for m in METRICS))
    shape = m.groupBy("dbname", "cell_id").agg(F.min(F.struct("channel", "length", "width_mean", "width_median")).alias("s"))  # all channels have one contour
    shape = shape.select("dbname", "cell_id", *(S.finite_or_null(F.col(f"s.{c}"), True).alias(c) for c in ("length", "width_mean", "width_median")))
    base = cells.where("cell_id is not null").groupBy("dbname", "cell_id").agg(S.canonical_label(F.first("manual_label")).alias("manual_label"), S.finite_or_null(F.first("area"), True).alias("area_px2"))
    return base.join(shape, ["dbname", "cell_id"], "left").join(wide, ["dbname", "cell_id"], "left")


def phenotype_comparison(spark: SparkSession, paths: list[str], label: str | None = None, degree: int = 4) -> tuple[DataFrame, DataFrame]:
    """Phenotypes of several experiments (tables with a row a channel), and a status row for each that was asked for: its cells of the label, or why there are none."""
    cells, status = tables.union_databases(spark, paths)
    if "contour" not in cells.columns:
        return cells, status
    out = phenotype_features(cells, label, degree)
    n = out.groupBy("dbname").agg(F.count("*").alias("n"))
    return out, status.join(n, "dbname", "left").select("dbname", "error", F.coalesce("n", F.lit(0)).alias("cell_count"))
