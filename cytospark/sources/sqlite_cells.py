"""Cell tables in SQLite files: read by ranges of rows, several tasks a file, with columns and filters in the files' own queries; and written.

A file is one experiment, or a part of it, with a table ``cells``. Its types are loose: a label may be the number 1, the
number 1000, the text N/A or nothing in one column, so labels are read as text, as a text comparison sees them.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from glob import glob
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The table's columns and how they are read.
COLUMNS = {
    "id": "long", "cell_id": "string", "label_experiment": "string", "manual_label": "string", "perimeter": "double", "area": "double", "img_ph": "binary", "img_fluo1": "binary", "img_fluo2": "binary", "contour": "binary",
    "center_x": "double", "center_y": "double", "user_id": "string", "objective_magnification": "string", "pixel_size_um": "double",
}
ROWS = 50_000
#: Comparisons that a file's query takes.
SIGNS = ("=", "<", "<=", ">", ">=", "IS NULL", "IS NOT NULL")


def local_path(path: str) -> str:
    """SQLite reads files by their place, so the folder must be mounted on all executors."""
    where = urlsplit(path)
    if where.scheme not in ("", "file"):
        raise ValueError(f"{path}: SQLite files are read from a mounted folder")
    return unquote(where.path)


def files_of(path: str) -> list[str]:
    """The files that a path, a folder or a pattern names, in order."""
    own = local_path(path)
    found = sorted(f"{own}/{n}" for n in os.listdir(own) if n.endswith((".db", ".sqlite"))) if os.path.isdir(own) else sorted(glob(own))
    if not found:
        raise FileNotFoundError(f"{path}: no cell table")
    return found


class Range(InputPartition):
    """Rows of one file, by their row number, both ends included."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class CellReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.rows = schema, options["path"], int(options.get("rows_a_partition", ROWS))
        self.where, self.values = [], []
        for name, sign, value in json.loads(options.get("where", "[]")):
            if name not in COLUMNS or sign not in SIGNS:
                raise ValueError(f"{name} {sign}: a filter compares a column of the table by one of {', '.join(SIGNS)}")
            # a label's type is mixed, so it is compared as the text that it is read as
            self.where.append((name, f'CAST("{name}" AS TEXT)' if COLUMNS[name] == "string" else f'"{name}"', sign))
            self.values += [value] if sign in SIGNS[:5] else []

    def partitions(self) -> list[Range]:
        out = []
        for path in files_of(self.path):
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                low, high = c.execute("SELECT min(rowid), max(rowid) FROM cells").fetchone()
            c.close()
            out += [Range(path, k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)] if low is not None else []
        return out or [Range("", 0, -1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        kind = to_arrow_schema(self.schema)
        c = sqlite3.connect(f"file:{part.path}?mode=ro", uri=True)
        there = {r[1] for r in c.execute("PRAGMA table_info(cells)")}
        name = os.path.splitext(os.path.basename(part.path))[0].partition("~")[0]
        select = ["?" if n == "dbname" else f'"{n}"' if n in there else "NULL" for n in kind.names]
        # a column that an older file lacks is NULL in it
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(f"{e if n in there else 'NULL'} {sign} {'?' if sign in SIGNS[:5] else ''}" for n, e, sign in self.where)])
        rows = c.execute(f"SELECT {', '.join(select)} FROM cells WHERE {where}", [*([name] if "dbname" in kind.names else []), part.low, part.high, *self.values])
        while got := rows.fetchmany(2048):
            yield pa.RecordBatch.from_arrays([pa.array([_as(v, t) for v in column], t) for column, t in zip(zip(*got), kind.types)], schema=kind)
        c.close()


def _as(v, kind: pa.DataType):
    if v is None or v == "" and not pa.types.is_string(kind):
        return None
    return v if not pa.types.is_string(kind) or isinstance(v, str) else v.decode() if isinstance(v, bytes) else str(v)


class CellTables(DataSource):
    """spark.read.format("cell_tables").load(path): a file, a folder of them or a pattern. Options: columns (by comma; only those are read), where (JSON), rows_a_partition."""

    @classmethod
    def name(cls) -> str:
        return "cell_tables"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or ["dbname", *COLUMNS]
        return ", ".join(f"{c} {'string' if c == 'dbname' else COLUMNS[c]}" for c in wanted)

    def reader(self, schema: StructType) -> CellReader:
        return CellReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, columns: list[str] | None = None, where: list[tuple] | None = None, rows_a_partition: int = ROWS) -> DataFrame:
    """Cells of SQLite files, with dbname from the file's name.

    Only ``columns`` are read, and only rows that pass ``where`` (column, sign of `SIGNS`, value or None) leave the files. These
    are arguments because Spark's own pushing of filters into such a source (off by default) keeps the first query's filters
    for later queries of the same DataFrame.
    """
    spark.dataSource.register(CellTables)
    return spark.read.format("cell_tables").options(columns=",".join(columns or []), where=json.dumps(where or []), rows_a_partition=rows_a_partition).load(path)


def write_sqlite(cells: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """cells (dbname, cell_id, ..) as SQLite files in a mounted folder: an experiment's are named dbname~part.db, about so many rows each.

    A file appears when it is whole, so a task that is run again replaces it.
    """
    folder, columns = local_path(path), [c for c in COLUMNS if c in cells.columns and c != "id"]
    os.makedirs(folder, exist_ok=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = f"{pdf['dbname'].iat[0]}~{pdf['part'].iat[0]}.db"
        temporary = f"{folder}/.{name}.{os.getpid()}"
        c = sqlite3.connect(temporary)
        c.execute(f"CREATE TABLE cells (id INTEGER PRIMARY KEY, {', '.join(columns)})")
        values = pdf[columns].astype(object).where(pdf[columns].notna(), None).sort_values("cell_id")
        c.executemany(f"INSERT INTO cells ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})", values.itertuples(index=False, name=None))
        c.commit()
        c.close()
        os.replace(temporary, f"{folder}/{name}")
        return pd.DataFrame({"n": [len(pdf)]})

    n = cells.groupBy("dbname").agg(F.ceil(F.count("*") / rows_a_file).alias("parts"))
    dealt = cells.join(n, "dbname").withColumn("part", F.pmod(F.xxhash64("cell_id"), "parts"))
    dealt.select("dbname", "part", *columns).groupBy("dbname", "part").applyInPandas(run, "n long").write.format("noop").mode("overwrite").save()
