"""SQLite files, frames in tiles, and streams that repeat themselves."""

import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytospark import queries as Q
from cytospark.functions import geometry as G
from cytospark.operators import cells as C
from cytospark.operators import tiles as T
from cytospark.sources import sqlite_cells, tables
from cytospark.streaming import activity


def flooded(tag):
    """Components of equal positive tags by flood fill, numbered in reading order."""
    out, k = np.zeros(tag.shape, int), 0
    for y, x in zip(*np.nonzero(tag)):
        if out[y, x]:
            continue
        k += 1
        stack = [(y, x)]
        out[y, x] = k
        while stack:
            b, a = stack.pop()
            for j in range(max(0, b - 1), min(tag.shape[0], b + 2)):
                for i in range(max(0, a - 1), min(tag.shape[1], a + 2)):
                    if not out[j, i] and tag[j, i] == tag[b, a]:
                        out[j, i] = k
                        stack.append((j, i))
    return out


@pytest.mark.parametrize("nx,ny", [(2, 2), (3, 5), (1, 1), (23, 17)])
def test_components_of_tiles_are_those_of_the_frame(spark, nx, ny):
    r, rows, want = np.random.default_rng(nx), [], set()
    spiral = np.zeros((17, 23), int)
    for k in range(0, 8, 2):
        spiral[k, k : 23 - k] = spiral[16 - k, k : 23 - k] = 1
        spiral[k : 17 - k, 22 - k] = 1
        spiral[k + 2 : 17 - k, k] = 1
    masks = [spiral, np.eye(17, 23, dtype=int), np.zeros((17, 23), int), np.ones((17, 23), int)] + [r.integers(0, 3, (17, 23)) * (r.random((17, 23)) < p) for p in (0.2, 0.5, 0.7)]
    for f, m in enumerate(masks):
        rows.append((None if f % 2 else "v", f, 17, 23, m.ravel().tolist()))
        want |= {(None if f % 2 else "v", f, int(x), int(y), int(c)) for (y, x), c in np.ndenumerate(flooded(m)) if c}
    frames = spark.createDataFrame(rows, "view string, frame int, height int, width int, mask array<int>")
    tiles = T.cut_frames(frames, ["view", "frame"], nx, ny, "mask")
    assert tiles.count() == len(masks) * nx * ny
    got = [tuple(x) for x in T.tiled_components(tiles, ["view", "frame"]).select("view", "frame", "x", "y", "component").collect()]
    assert len(got) == len(want) and set(got) == want


def test_regions_of_tiles_are_those_of_the_frame(spark, sf):
    key = lambda df: sorted((r["view"], r["frame"], r["component"], r["area"], round(r["cx"], 9), round(r["cy"], 9)) for r in df.collect())
    want = key(C.segment_frames(Q._film(spark, sf), ["view", "frame"]))
    assert key(Q.QUERIES["j12_tiled_regions"](spark, sf)) == want and len(want) > 50
    img = np.full((40, 60), 200)
    img[5:20, 10:50] = 20
    img[30:, 55:] = 60
    f = spark.createDataFrame([(1, 1, 40, 60, img.ravel().tolist()), (1, 2, 40, 60, [7] * 2400)], "view long, frame long, height int, width int, pixels array<int>")
    assert [(a, x, y) for *_, a, x, y in key(T.segment_tiles(T.cut_frames(f, ["view", "frame"], 4, 3, "pixels"), ["view", "frame"]))] == [(600, 29.5, 12.0), (50, 57.0, 34.5)]


def old_file(path, rows, columns):
    c = sqlite3.connect(path)
    c.execute(f"CREATE TABLE cells ({columns})")
    c.executemany(f"INSERT INTO cells VALUES ({', '.join('?' * len(rows[0]))})", rows)
    c.commit()
    c.close()


def test_sqlite_files_as_they_are(spark, tmp_path):
    """Labels of mixed types, a file of an older make, an empty one, and images as bytes."""
    old_file(tmp_path / "a.db", [(k, f"F0C{k}", v, float(k), b"\x89PNG" + bytes([k])) for k, v in enumerate((1, "N/A", 1000, None, "2", ""))], "id INTEGER PRIMARY KEY, cell_id VARCHAR, manual_label INTEGER, area FLOAT, img_ph BLOB")
    old_file(tmp_path / "b.db", [(7, "F1C0", 12.5)], "id INTEGER PRIMARY KEY, cell_id VARCHAR, area FLOAT")
    c = sqlite3.connect(tmp_path / "c.db")
    c.execute("CREATE TABLE cells (id INTEGER PRIMARY KEY, cell_id VARCHAR)")
    c.close()
    df = tables.read_cells(spark, str(tmp_path), "sqlite", rows_a_partition=2)
    got = {(r["dbname"], r["cell_id"]): r for r in df.collect()}
    assert [got["a", f"F0C{k}"]["manual_label"] for k in range(6)] == ["1", "N/A", "1000", None, "2", ""]
    assert bytes(got["a", "F0C3"]["img_ph"]) == b"\x89PNG\x03" and got["b", "F1C0"]["area"] == 12.5 and got["b", "F1C0"]["manual_label"] is None and len(got) == 7
    assert df.rdd.getNumPartitions() == 4  # three ranges of one file, one of the next
    assert {r["cell_id"] for r in df.where("area > 2 and manual_label is not null").collect()} == {"F0C4", "F0C5"}
    assert {r["cell_id"] for r in df.where("manual_label = '1000' or cell_id in ('F1C0')").collect()} == {"F0C2", "F1C0"}
    assert [r["cell_id"] for r in df.where("manual_label is null and area >= 3").collect()] == ["F0C3", "F1C0"]
    assert {r["manual_label"] for r in tables.migrate_cells(df).where("dbname = 'b'").collect()} == {None}
    with pytest.raises(Exception, match="no cell table"):
        tables.read_cells(spark, str(tmp_path / "none*.db"), "sqlite").collect()


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    old_file(tmp_path / "a.db", [(k, f"F0C{k}", k % 3 or None, float(k)) for k in range(100)], "id INTEGER PRIMARY KEY, cell_id VARCHAR, manual_label INTEGER, area FLOAT")
    read = lambda *where, columns=("cell_id", "area"): tables.read_cells(spark, str(tmp_path), "sqlite", list(columns), where=list(where), rows_a_partition=30)
    reader = sqlite_cells.CellReader(read().schema, {"path": str(tmp_path), "rows_a_partition": "30", "where": '[["area", ">", 96]]'})
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [3] and len(reader.partitions()) == 4  # three rows leave the file
    assert {r["cell_id"] for r in read(("area", ">", 50), ("area", "<=", 60), ("manual_label", "=", "1")).collect()} == {"F0C52", "F0C55", "F0C58"}
    assert read(("manual_label", "IS NULL", None)).count() == 34 and read(("pixel_size_um", "IS NULL", None)).count() == 100 and read(("user_id", "=", "x")).count() == 0
    assert read().columns == ["cell_id", "area"]
    with pytest.raises(Exception, match="compares a column"):
        read(("area; DROP TABLE cells", "=", 1)).collect()
    # a DataFrame is filtered afresh by each query
    df = read()
    assert (df.where("area > 97").count(), df.count(), df.where("cell_id = 'F0C1'").count()) == (2, 100, 1)


def test_sqlite_round_trip_in_parts(spark, tmp_path):
    cells = spark.createDataFrame([("db one", f"F0C{k}", None if k % 3 else "1", k / 7 if k % 5 else None) for k in range(500)], "dbname string, cell_id string, manual_label string, area double")
    for _ in range(2):  # again: files are replaced
        sqlite_cells.write_sqlite(cells, f"file://{tmp_path}/out", 100)
    assert len(os.listdir(tmp_path / "out")) == 5
    back = tables.read_cells(spark, f"file://{tmp_path}/out", "sqlite", ["dbname", "cell_id", "manual_label", "area"])
    assert sorted(back.collect(), key=lambda r: r["cell_id"]) == sorted(cells.collect(), key=lambda r: r["cell_id"])
    assert tables.jdbc_bounds(1, 120_000) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "120001", "numPartitions": "3"}


def test_cells_come_once_for_ever(spark, tmp_path):
    """A repeat after ten days of other cells, and after the stream was stopped in the middle and started again."""
    schema = "dbname string, cell_id string, created_at timestamp"

    def put(name, rows):
        df = spark.createDataFrame(rows, "dbname string, cell_id string, t string").select("dbname", "cell_id", F.to_timestamp("t").alias("created_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        new = activity.stream_new_cells(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        return new.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))

    before = {k: spark.conf.get(k, None) for k in activity.KEYS_ON_DISK}
    for k, v in activity.KEYS_ON_DISK.items():
        spark.conf.set(k, v)
    try:
        for day in range(1, 12):
            put(f"d{day}", [("db", f"F{day}C0", f"2024-01-{day:02}"), ("db", f"F{day}C0", f"2024-01-{day:02}"), ("db", "F0C0", f"2024-01-{day:02}"), ("other", "F0C0", "2024-01-01")])
            q = run()
            q.processAllAvailable() if day % 2 else q.awaitTermination()
            q.stop()
        q = run()
        q.stop()  # at once: whatever was under way is done again
        put("late", [("db", "F1C0", "2024-03-01"), ("db", "F0C0", "2023-01-01")])
        run().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = [(r["dbname"], r["cell_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted({("db", f"F{day}C0") for day in range(12)} | {("other", "F0C0")})
