"""Profiles as text: rows in pairs (positions, then values), and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordering import placed, spread_join, written


def profile_csv_pixel_size(text: Column) -> Column:
    """The header's pixel size by = or :, else the default."""
    v = F.regexp_extract(text, r"pixel_size_um\s*[=:]\s*([-+0-9.eE]+)", 1).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v <= 0), S.DEFAULT_PIXEL).otherwise(v)


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (dbname, at, line) of profile texts, in order of ``at``: each good pair as dbname, pair, u1, g.

    Byte-order mark, comment and blank lines, and empty fields at a line's end are passed over. An odd
    number of rows is an error. A pair that is short, not numeric or finite, of unequal lengths, decreasing
    or without a span drops out and leaves the others' numbers as they are. A text's lines are numbered by
    range, so a text of any length is many tasks' work.
    """
    lines = lines.withColumn("line", S.without_bom(F.col("line"))).where("trim(line) <> '' and not startswith(trim(line), '#')")
    rows = placed(lines, ["dbname"], ["at"], place="n")
    rows = rows.withColumn("fields", F.split(F.regexp_replace(F.trim("line"), r"[,\s]+$", ""), r"\s*,\s*"))
    rows = rows.withColumn("fields", F.when(F.col("total") % 2 == 1, F.raise_error(F.concat(F.lit("odd number of rows in "), F.col("dbname")))).otherwise(F.col("fields")))
    numbers = F.transform("fields", lambda f: f.try_cast("double"))
    pairs = rows.groupBy("dbname", F.expr("(n + 1) div 2").alias("pair")).agg(F.max(F.when(F.col("n") % 2 == 1, numbers)).alias("u1"), F.max(F.when(F.col("n") % 2 == 0, numbers)).alias("g"))
    finite = "forall({0}, v -> v is not null and not isnan(v) and abs(v) <> double('inf'))"
    ok = f"size(u1) >= 2 and size(u1) = size(g) and {finite.format('u1')} and {finite.format('g')}"
    order = "forall(sequence(1, size(u1) - 1), i -> u1[i] >= u1[i - 1]) and u1[size(u1) - 1] > u1[0]"
    return pairs.where(F.expr(f"if({ok}, {order}, false)"))


def parse_profiles(files: DataFrame) -> DataFrame:
    """files (dbname, text): their pairs, as `parse_lines` has them."""
    return parse_lines(files.select("dbname", F.posexplode(F.split(F.col("text"), r"\r?\n")).alias("at", "line")))


def read_profiles_csv(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("dbname"), F.col("value").alias("text"))
    return parse_profiles(files)


def profile_lines(df: DataFrame, pixel: float | None = None) -> DataFrame:
    """dbname, at, line: two rows a profile, padded with empty fields to the longest; the header first."""
    longest = df.groupBy("dbname").agg(F.max(F.size("u1")).alias("longest"))
    text = lambda c: F.array_join(F.concat(F.transform(c, lambda v: v.cast("string")), F.array_repeat(F.lit(""), F.col("longest") - F.size(c))), ",")
    # one row a database, joined in parts
    d = spread_join(written(placed(df, ["dbname"], ["cell_id"], place="n", total="of").drop("of"), "numbered"), longest, ["dbname"], ["cell_id"])
    out = d.select("dbname", F.explode(F.array(F.struct((F.col("n") * 2 - 1).alias("at"), text("u1").alias("line")), F.struct((F.col("n") * 2).alias("at"), text("g").alias("line")))).alias("r")).select("dbname", "r.at", "r.line")
    if pixel is not None:
        out = out.unionByName(longest.select("dbname", F.lit(0).alias("at"), F.lit(f"# pixel_size_um={pixel}").alias("line")))
    return out


def write_profiles_csv(df: DataFrame, path: str, pixel: float | None = None) -> None:
    """A folder for each database, in numbered parts: a profile's two lines stand in one part, and parts in order."""
    lines = profile_lines(df, pixel).withColumn("pair", F.expr("greatest((at + 1) div 2, 1)")).repartitionByRange("dbname", "pair").sortWithinPartitions("dbname", "at")
    lines.select("dbname", F.col("line").alias("value")).write.mode("overwrite").partitionBy("dbname").text(path)
