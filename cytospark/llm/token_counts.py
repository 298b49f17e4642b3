"""Token counts of flat token files that have no index: a scan for the end-of-document id.

A flat file is 16-bit little-endian ids and nothing else; the files, by name, are one stream. Files of any
size, whatever bytes they hold, are cut into ranges of ids, each of which a task reads from its place on and searches
block by block. What stands before a block follows from the files' sizes; a prefix scan over the blocks says how many
separators, so documents, stand before each, and the last separator before a block is where its first document begins.
"""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import prefix_sums, removed, scratch, written

END = 50256


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int = END) -> str:
    """A text's ids in each row, and the end id between: the writer's line separator is that id's two bytes.

    Null text is empty: its document is the end id alone. The end's own token in a text is ordinary text, since
    its id would end the document.
    """

    def run(batches):
        encoder = bpe.Encoder.of(tokenizer, plain=True)
        for b in batches:
            for _, ids, off in encoder.of_column(b.column(0)):
                flat = pa.py_buffer(ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * 2).astype(np.int32).tobytes()), flat])], names=["value"])

    separator = end_id.to_bytes(2, "little").decode("latin-1")
    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)
    return path


#: Ids of a range, the unit of work, and of a block of it, which is searched at once.
RANGE, BLOCK = 4 << 20, 1 << 19


def opened(path: str):
    """A file of the shared folder for reading: by its path where that is mounted, else by pyarrow's file systems."""
    where = urlsplit(path)
    if where.scheme in ("", "file"):
        return open(unquote(where.path), "rb")
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def blocks_of(files: DataFrame, end_id: int, range_ids: int = RANGE, block_ids: int = BLOCK) -> DataFrame:
    """number, block and ends (places in the stream of the end ids) of each block of each file that holds one.

    files: number, path, ids, ids_before. A range begins at an even byte whatever the ids are, so its memory is a block's.
    """

    def run(batches):
        for b in batches:
            for number, path, ids, before, k in zip(*(b.column(i).to_pylist() for i in range(5))):
                with opened(path) as f:
                    f.seek(2 * k * range_ids)
                    for lo in range(k * range_ids, min((k + 1) * range_ids, ids), block_ids):
                        own = np.frombuffer(f.read(2 * min(block_ids, (k + 1) * range_ids - lo, ids - lo)), "<u2")
                        found = np.flatnonzero(own == end_id) + (before + lo)
                        if len(found):
                            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lo], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["number", "block", "ends"])

    ranges = files.select("number", "path", "ids", "ids_before", F.explode(F.expr(f"sequence(0L, (ids - 1) div {range_ids})")).alias("k"))
    many = files.agg(F.sum(F.expr(f"(ids - 1) div {range_ids} + 1")).alias("n")).first()["n"] or 1
    return ranges.repartition(min(many, MOST_TASKS)).mapInArrow(run, "number long, block long, ends array<long>")


#: Ranges are dealt out to as many tasks at most.
MOST_TASKS = 20_000


def scan(spark: SparkSession, path: str, end_id: int = END, range_ids: int = RANGE, block_ids: int = BLOCK) -> DataFrame:
    """A row for each document of the stream: document (its number), token_file, start, n_tokens, ended.

    token_file is the number of the file that it ends in; start counts ids from the stream's
    beginning; n_tokens is without the end id. Ids after the last separator are a document with
    ended false. An odd last byte isn't an id; files without an id have no number; no files, no rows.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    files = spark.read.format("binaryFile").load(path).select("path", F.expr("length div 2").alias("ids")).where("ids > 0")  # not their content
    by_name = Window.orderBy("path")  # one row a file
    files = files.select("path", "ids", F.row_number().over(by_name).cast("long").alias("number"), zero(F.sum("ids").over(by_name.rowsBetween(Window.unboundedPreceding, -1))).alias("ids_before"))
    files = written(files, "token-file-list")
    found = written(blocks_of(files, end_id, range_ids, block_ids), "separators")
    counted = prefix_sums(found.withColumn("n", F.size("ends").cast("long")), ["number", "block"], {"n": "document"}, "separators-before")
    counted = written(counted.select("number", "document", "n", "ends"), "separators-placed")
    removed(found)
    # The separator before a block's first is the last of the block whose documents end there.
    previous = counted.select((F.col("document") + F.col("n")).alias("document"), F.element_at("ends", -1).alias("previous"))
    stops = counted.join(previous, "document", "left").withColumn("starts", F.expr("transform(concat(array(coalesce(previous, -1)), slice(ends, 1, size(ends) - 1)), e -> e + 1)"))
    docs = stops.select("number", "document", F.posexplode(F.arrays_zip("starts", "ends")).alias("k", "span"))
    docs = docs.select((F.col("document") + F.col("k")).alias("document"), F.col("number").alias("token_file"), F.col("span.starts").alias("start"), (F.col("span.ends") - F.col("span.starts")).alias("n_tokens"), F.lit(True).alias("ended"))
    all_ids = files.agg(F.max("number").alias("token_file"), F.sum("ids").alias("end"))
    tail = all_ids.crossJoin(counted.agg(zero(F.max(F.col("document") + F.col("n"))).alias("document"), F.coalesce(F.max(F.element_at("ends", -1)), F.lit(-1)).alias("last")))  # one row by one
    tail = tail.where(F.col("end") > F.col("last") + 1).select("document", "token_file", (F.col("last") + 1).alias("start"), (F.col("end") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.unionByName(tail)


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs' ids as flat files in the scratch folder, then their scan.

    A row for each row of docs, repeated and null ones too, in the order of the files: its number stands
    for it, since a flat file has no ids of documents. Null text is a document of no ids.
    """
    path = write_flat(docs, scratch(docs.sparkSession, "flat-tokens"), tokenizer or bpe.default_path())
    out = scan(docs.sparkSession, path)
    removed(path)
    return out
