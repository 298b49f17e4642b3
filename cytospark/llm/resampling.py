"""Target-distribution importance resampling: documents drawn so that their features look like a target's.

A text's separators are collapsed to single spaces; then a regular expression with lookarounds at word
boundaries is searched with overlapping matches, so that its spans are the n-grams themselves, whose CRC
gives their bucket. Buckets of all documents and of all target texts are counted exactly; a bucket's gain is the
rounded-down logarithm of the ratio of its smoothed shares. A document's weight is its features' mean gain,
and adding Gumbel noise to the weights makes the highest scores a draw without replacement.

Features are found once and written (two bytes each); counting and weighing read that table. What reaches
the driver are one count and one gain a bucket. Ranks are places in a total order that no task holds whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import prefix_sums, removed, written

BUCKETS, ORDERS, LEAST_WORDS, SHARE, SEED = 10_000, (1, 1), 20, (10, 100), "2024"

#: Letters in lower case, digits and whatever isn't ASCII stay; the rest separates.
_KEPT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_NOT_SPACE = np.arange(256) != 0x20


def pattern(n: int):
    """Runs of n words of a text whose words are parted by single spaces; to be searched with overlapping matches."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def collapsed(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts in lower case with a single space for each run of separators, and their offsets."""
    data = np.frombuffer(_KEPT, np.uint8)[data]
    stays = np.ones(len(data), bool)
    stays[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    at = off[:-1][off[:-1] < len(data)]
    stays[at] = True  # a text's first byte follows no byte of its own
    ends = np.concatenate([[0], np.cumsum(stays)])
    return data[stays].tobytes(), ends[off]


def features(text: bytes, patterns: list, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of a collapsed text, repeats included, in ascending order."""
    crc = zlib.crc32
    found = [np.fromiter((crc(m[0]) for m in p.finditer(text, overlapped=True)), np.uint32) for p in patterns]
    return np.sort((np.concatenate(found) % np.uint32(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32))


def featured(docs: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary): of each text; null: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [pattern(n) for n in range(orders[0], orders[1] + 1)]
        for b in batches:
            for lo, hi, data, off in words.slabs(b.column(1)):
                text, at = collapsed(data, off)
                n_words = np.diff(words.per_text(words.segments(np.frombuffer(text, np.uint8), at, _NOT_SPACE)[0], at))
                own = [features(text[s:e], patterns, buckets) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n_words.astype(np.int64)), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def counted(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds; a partial count for each task, added up by Spark."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(words.buffers(b.column(0))[0].view(kind), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B))))."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(found: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, off = words.buffers(b.column(3))
            sums = np.concatenate([[0], np.cumsum(gain[ids.view(kind)])])
            off, n = off // np.dtype(kind).itemsize, b.column(2).to_numpy()
            weight = (sums[off[1:]] - sums[off[:-1]]) // np.maximum(n, 1)
            score = weight + np.array([noise(i, seed) for i in b.column(0).to_pylist()], np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: str = SEED) -> DataFrame:
    """A row for each row of docs: doc_id, n_features, weight, score, rank (1, 2, .. of the drawn rows; null for the others).

    Of the rows with at least ``least_words`` words the floor(share) with the highest scores are drawn, ties to the smaller
    doc_id, a null doc_id last, repeated doc_ids in any order. A null or empty text has no feature and weight 0; a null doc_id
    draws its noise from the seed alone. Without a target text, or without documents, the smoothed shares still give gains.
    """
    found = written(featured(docs, orders, buckets), "features")
    gain = gains(counted(found, buckets), counted(featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets), buckets))
    scored = weighed(found, gain, seed).withColumns({"one": F.lit(1), "late": F.col("n_words") < least_words, "down": -F.col("score"), "nameless": F.col("doc_id").isNull(), "row": F.monotonically_increasing_id()})
    scored = written(scored, "scored")
    removed(found)
    drawn = scored.where("not late").count() * share[0] // share[1]
    out = prefix_sums(scored, ["late", "down", "nameless", "doc_id", "row"], {"one": "before"}, "ranked")
    removed(scored)
    return out.select("doc_id", "n_features", "weight", "score", F.when((F.col("before") < drawn) & ~F.col("late"), F.col("before") + 1).alias("rank"))


#: CRC-32 is written out over each distinct word's bytes: DuckDB has no such function.
ORACLE_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)
), texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), lists AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS found
  FROM texts
), grams AS (
  SELECT side, doc_id, unnest(found) AS word FROM lists
), crcs AS (
  SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM grams), tab
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM grams JOIN crcs USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT doc_id, sum(gain) AS total FROM grams JOIN crcs USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scores AS (
  SELECT doc_id, len(found) AS n_features, CAST(coalesce(floor(total::DOUBLE / len(found)), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM lists LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (doc_id)
"""
