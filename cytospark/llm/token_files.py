"""Token ids in fixed-width bit packing, with random access.

A file holds a header, packed blocks and a trailer, each followed by one newline byte, since
Spark's text writer makes the files (any Hadoop file system, Spark's commit protocol):

    header   magic, bits an id (u32), ids a block (u32), number of the file (u32)
    block    ids of ``bits`` bits each, lowest bit first; all blocks but the last are full
    trailer  offset of each block (u64), doc_id (i64) and first id (u64) of each document,
             then numbers of blocks, documents and ids (u64 each) and the magic again

Files are numbered in ascending doc_id order and so are the documents in each. A null doc_id is
stored as the lowest 64-bit integer and read back as null; rows with one doc_id stay separate
documents, in any order; null text is empty and still gets its end id; an empty table makes no file
with blocks. A file holds about ``FILE_BYTES`` of text, and never less than a whole text: rows of one
doc_id are dealt to several files where they are more.
"""

from __future__ import annotations

import io
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import removed, scratch, written

MAGIC = b"CYTOPK01"
HEADER = len(MAGIC) + 12 + 1
NO_ID = np.iinfo(np.int64).min
#: Bytes of text that a file is made of, about; and the least for which one more task is worth it.
FILE_BYTES, TASK_BYTES = 128 << 20, 8 << 20
#: Ids that are unpacked at a time.
AT_A_TIME = 1 << 22


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class TokenFile:
    """A token file: documents and ids by number, unpacking only the blocks in question.

    ``source`` is the file's bytes, or an open seekable file, of which only the index and the blocks are read.
    """

    def __init__(self, source):
        self.source = source if hasattr(source, "seek") else io.BytesIO(source)
        size = self.source.seek(0, 2)
        head, tail = self.read(0, 20), self.read(size - 33, 33)
        if head[:8] != MAGIC or tail[-9:-1] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.part = (int(x) for x in np.frombuffer(head[8:], "<u4"))
        blocks, docs, self.n_ids = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        table = np.frombuffer(self.read(size - 33 - 8 * (blocks + 2 * docs), 8 * (blocks + 2 * docs)), "<i8")
        self.blocks, self.doc_id, self.start = table[:blocks], table[blocks : blocks + docs], table[blocks + docs :]
        self.end = np.append(self.start[1:], self.n_ids) if docs else self.start

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids number lo to hi-1 of the file."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            at = int(self.blocks[b])
            out.append(unpack(self.read(at, (n * self.bits + 7) // 8), n, self.bits))
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.start[k]), int(self.end[k]))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = 8192) -> str:
    """docs (doc_id, text) as token files under ``path``; ``block`` is a multiple of 8."""

    def run(batches):
        encoder, part = bpe.Encoder.of(tokenizer), TaskContext.get().partitionId()
        bits, rest, at, n_ids = encoder.bits, [np.zeros(0, np.uint32)], HEADER, 0
        offsets, doc_ids, starts = [], [], []
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary())], names=["value"])

        def blocks(all_of_it=False):
            nonlocal rest, at
            ids = np.concatenate(rest)
            full = len(ids) if all_of_it else len(ids) - len(ids) % block
            out = []
            for k in range(0, full, block):
                out.append(pack(ids[k : min(k + block, full)], bits))
                offsets.append(at)
                at += len(out[-1]) + 1
            rest = [ids[full:]]
            return row(*out)

        begun = False
        for b in batches:
            if b.num_rows and not begun:
                begun = True
                yield row(MAGIC + np.array([bits, block, part], "<u4").tobytes())
            own = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, ids, off in encoder.of_column(b.column(1)):
                n = len(off) - 1
                out = np.insert(ids, off[1:], end_id).astype(np.uint32)
                doc_ids.append(own[lo : lo + n])
                starts.append(n_ids + off[:-1] + np.arange(n))
                n_ids += len(out)
                rest.append(out)
                yield blocks()
        if begun:
            yield blocks(True)
            d, s = np.concatenate(doc_ids), np.concatenate(starts)
            yield row(np.array(offsets, "<i8").tobytes() + d.astype("<i8").tobytes() + s.astype("<i8").tobytes() + np.array([len(offsets), len(d), n_ids], "<u8").tobytes() + MAGIC)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(ceil(size / FILE_BYTES), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / TASK_BYTES)), 1)
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, read back from the files."""

    def documents(batches):
        for b in batches:
            for x in b.column(0):
                f, lo = TokenFile(pa.BufferReader(x.as_buffer())), 0
                while lo < len(f.doc_id):
                    hi = max(lo + 1, int(np.searchsorted(f.end, f.start[lo] + AT_A_TIME)))
                    ids, base = f.ids(int(f.start[lo]), int(f.end[hi - 1])), int(f.start[lo])
                    crcs = [bpe.crc(ids[s - base : e - base]) for s, e in zip(f.start[lo:hi].tolist(), f.end[lo:hi].tolist())]
                    own = f.doc_id[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(hi - lo, f.part, np.int32)), pa.array(own, mask=own == NO_ID), pa.array(f.start[lo:hi]), pa.array(f.end[lo:hi] - f.start[lo:hi]), pa.array(crcs, pa.int64())],
                        names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )
                    lo = hi

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(documents, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    docs = written(found, "documents-read")
    sizes = docs.groupBy("part").agg(F.sum("n_tokens").alias("n_ids"))  # one row a file
    base = sizes.select("part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return docs.join(base, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs in the format above to the scratch folder, reads them back, and deletes the files."""
    spark = docs.sparkSession
    path = write_files(docs, scratch(spark, "token-files"), tokenizer or bpe.default_path())
    out = read_documents(spark, path)
    removed(path)
    return out
