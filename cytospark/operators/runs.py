"""Sets of pixels as runs of their rows: keys, y, x0, x1 (both ends in the set), disjoint and not touching within a row.

A run stands for all its pixels, so sets are widened, subtracted and overlapped a run at a time: a dilation
widens each run once for each row of the kernel and merges what meets in one scan by x0 (gaps and islands),
an erosion is the dilation of what isn't in the set, an overlap is an equi-join on the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs_of(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, x, y; repeats count once) as runs."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    island = px.select(*keys, "x", "y").distinct().withColumn("island", F.col("x") - F.row_number().over(row))
    return island.groupBy(*keys, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def pixels_of(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The runs' pixels: keys, x, y."""
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that meet or touch in a row become one."""
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.when(F.col("x0") > F.coalesce(reach + 1, F.col("x0") - 1), 1).otherwise(0)
    numbered = runs.withColumn("breaks", breaks).withColumn("island", F.sum("breaks").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "y", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def kernel_rows(kernel: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """A kernel of offsets (dx, dy) as dy and the first and last dx of each row, whose offsets must have no gap."""
    rows: dict[int, list[int]] = {}
    for dx, dy in kernel:
        rows.setdefault(dy, []).append(dx)
    if any(max(r) - min(r) + 1 != len(set(r)) for r in rows.values()):
        raise ValueError("a kernel's rows have no gaps")
    return [(dy, min(r), max(r)) for dy, r in sorted(rows.items())]


def dilate(runs: DataFrame, kernel: list[tuple[int, int]], keys: list[str], width: int | None = None, height: int | None = None) -> DataFrame:
    """The union of the shifted set; inside the image, where its size is given."""
    rows = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in kernel_rows(kernel))))
    wide = runs.select(*keys, "y", "x0", "x1", rows.alias("_kernel")).select(*keys, (F.col("y") + F.col("_kernel.dy")).alias("y"), (F.col("x0") + F.col("_kernel.a")).alias("x0"), (F.col("x1") + F.col("_kernel.b")).alias("x1"))
    if width is not None:
        wide = wide.where((F.col("y") >= 0) & (F.col("y") < height)).withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.lit(width - 1))}).where("x0 <= x1")
    return merged(wide, keys)


def complement(runs: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """What of the image isn't in the set, for each of the keys that has a run. Runs lie inside the image."""
    row = Window.partitionBy(*keys, "y").orderBy("x0")
    left = F.coalesce(F.lag("x1").over(row) + 1, F.lit(0))
    after = F.when(F.lead("x0").over(row).isNull(), F.col("x1") + 1)
    sides = runs.select(*keys, "y", F.struct(left.alias("x0"), (F.col("x0") - 1).alias("x1")).alias("before"), F.struct(after.alias("x0"), F.lit(width - 1).alias("x1")).alias("after"))
    gaps = sides.select(*keys, "y", F.explode(F.array("before", "after")).alias("g")).select(*keys, "y", "g.x0", "g.x1").where("x0 <= x1")
    there = runs.groupBy(*keys).agg(F.collect_set("y").alias("ys"))  # an image's rows at most
    kind = dict(runs.dtypes)["y"]
    empty = there.select(*keys, F.explode(F.array_except(F.sequence(F.lit(0), F.lit(height - 1)).cast(f"array<{kind}>"), "ys")).alias("y")).select(*keys, "y", F.lit(0).alias("x0"), F.lit(width - 1).alias("x1"))
    return gaps.unionByName(empty)


def subtracted(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What of a isn't in b: the runs of both, cut at each other's ends, in one scan of a row."""
    ends = a.select(*keys, "y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("in_a"), F.lit(0).alias("in_b")))).alias("e"))
    more = b.select(*keys, "y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")), F.struct((F.col("x1") + 1).alias("x"), F.lit(0).alias("in_a"), F.lit(-1).alias("in_b")))).alias("e"))
    ends = ends.unionByName(more).groupBy(*keys, "y", F.col("e.x").alias("x")).agg(F.sum("e.in_a").alias("in_a"), F.sum("e.in_b").alias("in_b"))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    upto = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ends.select(*keys, "y", F.col("x").alias("x0"), (F.lead("x").over(row) - 1).alias("x1"), F.sum("in_a").over(upto).alias("in_a"), F.sum("in_b").over(upto).alias("in_b"))
    return merged(cut.where("in_a > 0 and in_b = 0").select(*keys, "y", "x0", "x1"), keys)


def erode(runs: DataFrame, kernel: list[tuple[int, int]], keys: list[str], width: int, height: int) -> DataFrame:
    """Pixels whose neighbourhood is all in the set; what is outside the image counts as in it."""
    outside = dilate(complement(runs, keys, width, height), [(-dx, -dy) for dx, dy in kernel], keys, width, height)
    return subtracted(runs, outside, keys)


def overlaps(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a joined with rows of b (of other names but for ``on`` and y, with x0 and x1 as b0 and b1) that they overlap, with the number of common pixels."""
    shared = F.least("x1", "b1") - F.greatest("x0", "b0") + 1
    return a.join(b, [*on, "y"]).withColumn("common", shared).where("common > 0")
