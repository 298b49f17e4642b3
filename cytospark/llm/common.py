"""What several of the operators need: tables, the shared scratch folder, joins on hot keys, a distributed prefix scan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.ordering import merged, merged_if_many, removed, scratch, scratch_tables, spread_join, written

__all__ = ["merged", "merged_if_many", "prefix_sums", "removed", "scratch", "scratch_tables", "spread_join", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], what: str, more_fields: list[StructField] | None = None, more: Callable | None = None) -> DataFrame:
    """df with a column for each of ``sums`` (value: name): the sum of value over all rows before a row by ``order``.

    Rows are dealt out by range and summed where they lie; one total a partition is then summed
    up and joined back, so no task sees more than its own range. Ties of ``order`` get distinct,
    adjacent places; nulls among the values count as 0. ``more()`` gives, for each partition, a function
    of a batch in order and its first value's sums so far (within the partition) to the columns ``more_fields``.
    """
    more_fields = more_fields or []
    added = [StructField("_part", IntegerType()), *(StructField(f"_{n}", LongType()) for n in sums.values())]
    schema = StructType([*df.schema.fields, *added, *more_fields])

    def run(batches):
        part, so_far, own = TaskContext.get().partitionId(), dict.fromkeys(sums, 0), more() if more else None
        for b in batches:
            columns = [pa.array(np.full(b.num_rows, part, np.int32))]
            for value in sums:
                v = b.column(b.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = so_far[value] + np.cumsum(v)
                so_far[value] = int(ends[-1]) if len(ends) else so_far[value]
                columns.append(pa.array(ends - v))
            if own:
                columns += own(b, columns[1].to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=schema.names)

    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), what)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_part").agg(*(F.sum(F.coalesce(F.col(v).cast("long"), F.lit(0))).alias(f"_total_{n}") for v, n in sums.items()))
    base = totals.select("_part", *(F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums.values()))
    out = local.join(base, "_part")
    return out.select(*df.columns, *(f.name for f in more_fields), *((F.col(f"_base_{n}") + F.col(f"_{n}")).alias(n) for n in sums.values()))
