"""The activity log, daily: as a batch and as a stream; and new cells without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

PAGE_VIEW = "top_page"


def daily_activity(log: DataFrame, end_date: str, days: int, action: str | None = None, view_action: str = PAGE_VIEW) -> DataFrame:
    """Counts for each day up to end_date, days without any too. Without an action, all but page views count."""
    if days < 1:
        raise ValueError("days is at least 1")
    end = F.to_date(F.lit(end_date))
    rows = log.where(F.col("action_name") == action) if action else log.where(F.col("action_name") != view_action)
    n = rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    grid = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    return grid.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def stream_daily_activity(events: DataFrame, watermark: str = "1 day", view_action: str = PAGE_VIEW) -> DataFrame:
    """Counts by one-day windows; rows later than the watermark drop out. Also right on a batch."""
    good = events.where(S.valid_action(F.col("action_name")) & (F.col("action_name") != view_action))
    g = good.withWatermark("created_at", watermark).groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.to_date("w.start").alias("day"), "n")


def stream_new_cells(cells: DataFrame) -> DataFrame:
    """Cells as they come, each (dbname, cell_id) once, however much later it comes again.

    A stream keeps its keys in its state for good, on disk with `KEYS_ON_DISK`, and in its checkpoint, so a stream
    that is killed and started again knows them too; a batch looks up its own keys only.
    """
    return cells.dropDuplicates(["dbname", "cell_id"])


#: Settings of a session whose streams keep more keys than fit in memory.
KEYS_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
