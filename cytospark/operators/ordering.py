"""Places, sums and quantiles in a total order, and joins on keys that many rows share, without one task for a group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: spark.checkpoint.dir's stand-in on one machine, where the session names none (tests).
_own_folder: list[str] = []
#: A key with over 1 / MANY of a table's rows is joined in SALTS parts.
MANY, SALTS = 256, 64


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares; without one, only a session on one machine gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="cytospark-"))
        folder = _own_folder[0]
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    if _open_scopes:
        _open_scopes[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


_open_scopes: list[scratch_tables] = []


class scratch_tables:  # noqa: N801
    """Within it, tables that `written` makes are noted; at its end all go but those that were `keep`ed."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self.paths.remove(table.scratch)
        return table

    def __enter__(self):
        _open_scopes.append(self)
        return self

    def __exit__(self, kind, *_):
        _open_scopes.remove(self)
        if kind is None:
            removed(*self.paths)


def removed(*tables: DataFrame | str) -> None:
    """Deletes tables that `written` made (or paths), once nothing reads them any more."""
    for t in tables:
        path, context = (t, SparkSession.active().sparkContext) if isinstance(t, str) else (t.scratch, t.sparkSession.sparkContext)
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def merged(right: DataFrame) -> DataFrame:
    """right, to be joined by a shuffle and a merge: for tables that grow with the input, whose size Spark can't tell from compressed files or from arrays made in a plan."""
    return right.hint("merge")


#: A table of a few numbers and digests a row may be copied to all tasks up to so many rows: some 5 MB.
MOST_COPIED = 50_000


def merged_if_many(right: DataFrame, rows: int) -> DataFrame:
    """right, a table of short rows: of MOST_COPIED ``rows`` at most it is left to Spark, which may copy it; a larger one is merged."""
    return right if rows <= MOST_COPIED else merged(right)


def frequent(df: DataFrame, on: list[str]) -> tuple[list[int], int]:
    """xxhash64 of the keys with over 1 / MANY of df's rows, MANY at most, by a sketch of frequent items; and df's rows."""
    seen = df.select(F.xxhash64(*on).alias("k")).agg(F.expr(f"approx_top_k(k, {2 * MANY}, {32 * MANY})").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in seen["top"] or [] if x["count"] * MANY > seen["n"] and seen["n"] > SALTS], seen["n"]


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, however many of left's rows one key has; right has few rows a key.

    Keys with over 1 / MANY of left's rows, MANY at most, are found by a sketch of frequent items. Their rows
    of left are dealt out by a hash of ``spread`` to SALTS parts, each of which has a copy of right's row.
    left is read twice, so it is a written table.
    """
    key = F.xxhash64(*on)
    hot, _ = frequent(left, on)
    if not hot:
        return left.join(right, on, how)
    salted = left.withColumn("_salt", F.when(key.isin(hot), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def placed(df: DataFrame, by: list[str], order: list[str | Column], weight: str | None = None, place: str = "place", total: str = "total") -> DataFrame:
    """df with each row's place by ``order`` among those alike in ``by``, from 1 (or the weights up to it), and the group's total.

    Rows are dealt out by range and numbered within their range; what stands before a range is a sum over
    one row for each range and group. So a group of any size is many tasks' work. Nulls in ``by`` are a group.
    """
    own = F.col(weight) if weight else F.lit(1)
    local = written(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = local.groupBy("_part", *by).agg(F.sum(own).alias("_sum"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("_part").alias("_of"), *(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), before.alias("_before"), F.sum("_sum").over(group).alias(total))
    same = F.col("_part") == F.col("_of")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    out = local.withColumn("_upto", F.sum(own).over(upto)).join(base, same)
    return out.select(*df.columns, (F.col("_before") + F.col("_upto")).cast("long").alias(place), total)


def group_key(by: list[str]) -> Column:
    """The columns of ``by`` as one key, in which a NULL equals a NULL: an equi-join on it keeps NULL groups."""
    return F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("_"))


def with_group(df: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df with the other columns of right, which has a row or a few for each group; NULLs in ``by`` are a group.

    A group may have most of df's rows: right is small, and where Spark doesn't broadcast it, it splits the group's rows.
    """
    other = right.select(group_key(by).alias("_group"), *(c for c in right.columns if c not in by))
    return df.withColumn("_group", group_key(by)).join(other, "_group", how).drop("_group")


#: A value's leading part is its sign, its power of two and so many parts of that; a later pass cuts a slice in CUTS parts.
PARTS, CUTS, SLICE = 64, 4096, 1_000_000


def leading(v: Column) -> Column:
    """A whole number that doesn't fall as v grows: the leading bits of its logarithm. NaN stands last, as in Spark's order."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    # power + size / 2^power - 1 is continuous, so a logarithm that is off by a bit at a power of two changes no order
    code = F.floor((power + 1100 + size / F.pow(F.lit(2.0), power.cast("double")) - 1) * PARTS).cast("long")
    top = (1 << 20) * PARTS
    return F.when(F.isnan(v), F.lit(2 * top)).when(v == 0, F.lit(0)).when(size == float("inf"), F.signum(v).cast("long") * top).otherwise(F.signum(v).cast("long") * (code + 1)).cast("long")


def _found(buckets: DataFrame, slices: list[str]) -> DataFrame:
    """buckets (slices, ranks: a map of names to places from 0 within the slice, part, n, low, high) that hold one of the ranks, which now count within them."""
    order = Window.partitionBy(*slices).orderBy("part")
    b = buckets.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = F.map_filter("ranks", lambda _, r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    return b.withColumn("ranks", F.transform_values(here, lambda _, r: r - F.col("before"))).where(F.size("ranks") > 0).drop("before")


def selected(df: DataFrame, value: str | Column, by: list[str], ranks: Callable[[Column], dict[str, Column]], slice_rows: int = SLICE) -> DataFrame:
    """by, total and a column for each of ``ranks``: the value at that place from 0 in ascending order; groups without values give no row.

    Nothing is sorted: values are counted by their leading part, whose running sums tell which part holds a place, and only
    rows of such parts are read again (and kept). A part of more than ``slice_rows`` rows is cut by its own range and
    counted again, until what is left is small or one value. Ties, NULL groups and groups of any size are exact.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(group_key(by).alias("g"), v.cast("double").alias("v")).where("v is not null")
    parts = rows.groupBy("g", leading(F.col("v")).alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    parts = parts.withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    wanted = ranks(F.col("total"))
    names = list(wanted)
    places = F.create_map(*(x for n, r in wanted.items() for x in (F.lit(n), r.cast("long"))))
    open_ = written(_found(parts.withColumn("ranks", places), ["g"]).withColumn("slice", F.col("part").cast("string")), "slices")
    known, scratch_tables, held = [], [open_], None
    while True:
        known.append(open_.where("low = high or isnan(low) and isnan(high)").select("g", "total", "ranks", F.col("low").alias("v")))
        todo = open_.where("low < high")
        most = todo.agg(F.max("n").alias("n")).first()["n"]
        if most is None:
            break
        slices = todo.select("g", "slice", "ranks", "total", "low", "high", "n")
        if held is None:  # the rows of all slices, once
            held = written(rows.withColumn("slice", leading(F.col("v")).cast("string")).join(slices.select("g", "slice"), ["g", "slice"], "left_semi"), "slice-rows")
            scratch_tables.append(held)
        inside = held.join(slices.withColumnRenamed("slice", "next"), "g").where(F.col("next").startswith(F.col("slice")) & F.col("v").between(F.col("low"), F.col("high")))
        if most <= slice_rows:
            counts = inside.groupBy("g", "next", "v").agg(F.count("*").alias("n"), F.first("ranks").alias("ranks"), F.first("total").alias("total"))
            last = _found(counts.withColumn("part", F.col("v")), ["g", "next"])
            known.append(last.select("g", "total", "ranks", "v"))
            break
        wide = F.col("high") / CUTS - F.col("low") / CUTS  # no overflow; 0 between neighbours among the least of numbers
        cut = F.when(wide == 0, (F.col("v") > F.col("low")).cast("long")).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), wide)), F.lit(CUTS - 1)))
        cut = inside.groupBy("g", "next", cut.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("ranks").alias("ranks"), F.first("total").alias("total"))
        open_ = written(_found(cut, ["g", "next"]).withColumn("slice", F.concat_ws(".", "next", "part")).drop("next"), "slices")
        scratch_tables.append(open_)
    found = known[0]
    for k in known[1:]:
        found = found.unionByName(k)
    found = found.select("g", "total", "v", F.explode("ranks").alias("name", "rank"))
    out = written(found.groupBy("g").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("name") == n, F.col("v"))).alias(f"_{k}") for k, n in enumerate(names))), "selected")
    removed(*scratch_tables)
    return out.select(*(F.col("g")[b].alias(b) for b in by), "total", *(F.col(f"_{k}").alias(n) for k, n in enumerate(names)))


def quantiles(df: DataFrame, value: str | Column, by: list[str], ps: dict[str, float]) -> DataFrame:
    """by and a column for each of ps (name: share): the exact quantile, interpolated at (n - 1) p; groups without values give no row."""
    at = lambda total, p: (total - 1) * p
    s = selected(df, value, by, lambda total: {f"{n} {k}": f(at(total, p)) for n, p in ps.items() for k, f in (("low", F.floor), ("high", F.ceil))})
    low, high, part = (lambda n: F.col(f"`{n} low`")), (lambda n: F.col(f"`{n} high`")), (lambda p: at(F.col("total"), p) - F.floor(at(F.col("total"), p)))
    return s.select(*by, *(F.when(low(n) == high(n), low(n)).otherwise(low(n) + (high(n) - low(n)) * part(p)).alias(n) for n, p in ps.items()))
