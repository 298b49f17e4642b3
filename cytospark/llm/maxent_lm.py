"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(part | class, history) * P(word | part). Classes are words
with alike endings (a hash of the last two bytes), and the end of a text; a class's parts are a hash of the
word. Class and part each have a softmax over hashed features of the history: a bias, the word before, the two words
before, and the word before last (a skip); for the part they are joined with the class. The word has the softmax
within its part whose only feature is the word; its maximum likelihood is the share of counts, smoothed by
one, with room for one unknown word.

Training: each round goes over all training texts. Every task sums, over its tokens, observed less
expected counts of (feature, class or part); sums of tasks are added up by Spark in two steps; the weights, whose
size is a parameter, then move by that gradient over its curvature. The first round's expected counts follow from the
observed ones, so it counts only. Biases are shares of counts,
which is what they are best at alone.

Counts of all words are exact, words are known by 128 bits. Words that are at least one in ``FREQUENT`` of all
training tokens, ``FREQUENT`` of them at most, go to every task; counts of the others, none of which is
frequent, are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log, log10, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import written

BUCKETS, WIDTH, ROUNDS, FREQUENT, BLOCK = 1 << 16, 16, 2, 1 << 19, 1024
#: Partitions of the scan that a task of a training round takes.
SCANS_A_TASK = 4
LEAVES = WIDTH * WIDTH
#: The inverse variance of a weight's prior.
PULL = 4.0
_END = np.uint64(0x5EED0FE0D0000001)
_START = np.uint64(0x5EED0FB0F0000001)
_ENDINGS = (words.mix(np.arange(65536, dtype=np.uint64)) % np.uint64(WIDTH - 1)).astype(np.int64)


def tokens(data: np.ndarray, off: np.ndarray, twice: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of the lower-cased words and ends of a run of texts, their leaves (class * WIDTH + part), texts' offsets, and (twice) second hashes."""
    n = len(off) - 1
    data = words.LOWER[data]
    s, e = words.segments(data, off, words.NOT_SPACE)
    at, view = words.per_text(s, off), words.eights(data)
    last = data[e - 1].astype(np.int64) * 256 + np.where(e - s > 1, data[np.maximum(e - 2, 0)], 0) if len(s) else np.zeros(0, np.int64)
    own = [np.insert(words.hashes(data, s, e, seed, view), at[1:], _END) for seed in range(1 + twice)]
    part = (words.mix(own[0] * np.uint64(11)) % np.uint64(WIDTH)).astype(np.int64)
    return own[0], np.insert(_ENDINGS[last], at[1:], WIDTH - 1) * WIDTH + part, at + np.arange(n + 1), own[1] if twice else None


def features(h: np.ndarray, off: np.ndarray, leaf: np.ndarray) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For class and part: the rows of the features of each token's history, the bias first, and which of WIDTH it is. The first WIDTH rows are biases."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = off[:-1]
    one[first] = _START
    two[first] = _START
    second = first + 1
    two[second[second < np.append(off[1:], 0)[: len(second)]]] = _START
    room, own = np.uint64(BUCKETS - WIDTH), leaf // WIDTH
    raw = [words.mix(x) for x in (one * np.uint64(3), one * np.uint64(5) + two * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(7))]
    joined = own.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    row = lambda x: (x % room).astype(np.int64) + WIDTH
    return [([np.zeros(len(h), np.int64), *map(row, raw)], own), ([own, *(row(words.mix(x + joined)) for x in raw)], leaf % WIDTH)]


def log_shares(weights: np.ndarray, by: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log probability of each token's class (or part)."""
    z = weights[by[0]]
    for f in by[1:]:
        z += weights[f]
    return z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))  # weights are bounded, so this is too


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out. A null doc_id is hashed as an empty text."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (crc % 7 == 2).alias("held_out"))


def word_counts(train: DataFrame) -> DataFrame:
    """word and more (its two hashes), leaf and n over all training tokens, summed in the tasks before the shuffle."""

    def run(batches):
        kept, n = [], 0

        def flush():
            h, c, more = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(h)
            h, c, more = h[order], c[order], more[order]
            if ((h[1:] == h[:-1]) & (more[1:] != more[:-1])).any():
                order = np.lexsort((more, h))
                h, c, more = h[order], c[order], more[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]))
            many = np.diff(np.append(first, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(more[first].view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(many)], names=["word", "more", "leaf", "n"])

        for b in batches:
            for _, _, data, off in words.slabs(b.column(0)):
                h, c, _, more = tokens(data, off, twice=True)
                kept.append((h, c, more))
                n += len(h)
                if n > 4_000_000:
                    yield flush()
                    kept, n = [], 0
        if n:
            yield flush()

    return train.select("text").mapInArrow(run, "word long, more long, leaf int, n long").groupBy("word", "more", "leaf").agg(F.sum("n").alias("n"))


def added_up(train: DataFrame, sums: Callable[[Iterator[tuple]], np.ndarray], arrays: int) -> np.ndarray:
    """What ``sums`` makes of each task's runs of tokens (`arrays` tables of BUCKETS x WIDTH), added up in two steps.

    A task's sums have the weights' size whatever its texts are, so tasks take several of the scan's partitions each.
    """

    def run(batches):
        pieces = (tokens(data, off)[:3] for b in batches for _, _, data, off in words.slabs(b.column(0), 1 << 18))
        flat, part = sums(pieces).astype(np.float32).reshape(-1, WIDTH), TaskContext.get().partitionId()
        for k in range(0, len(flat), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([flat[k : k + BLOCK].tobytes()])], names=["block", "part", "sums"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [0], "sums": [sum(np.frombuffer(x, np.float32) for x in pdf["sums"]).astype(np.float32).tobytes()]})

    schema = "block int, part int, sums binary"
    n = train.rdd.getNumPartitions()
    tasks = min(n, max(train.sparkSession.sparkContext.defaultParallelism, ceil(n / SCANS_A_TASK)))
    made = train.select("text").coalesce(tasks).mapInArrow(run, schema)
    made = made.groupBy("block", F.expr(f"part % {max(1, ceil(sqrt(tasks)))}")).applyInPandas(lambda p: total(p), schema).groupBy("block").applyInPandas(lambda p: total(p), schema)
    out = np.zeros((arrays * BUCKETS, WIDTH), np.float32)
    for r in made.collect():  # as many numbers as there are weights, whatever the input
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["sums"], np.float32).reshape(-1, WIDTH)
    return out.reshape(arrays, BUCKETS, WIDTH)


def observed(train: DataFrame) -> np.ndarray:
    """Over all of train the counts of (feature, class), of (feature, part), and of the part's features with each class: three tables.

    While all weights but the biases are 0, a class's expected count under a feature is its share of the feature's count, and
    a part's follows from the feature's counts by class: so the first round's gradient comes from these alone.
    """

    def sums(pieces):
        seen, kept = np.zeros(3 * BUCKETS * WIDTH), []

        def flush():
            nonlocal seen
            seen += np.bincount(np.concatenate(kept), minlength=len(seen))

        for h, leaf, off in pieces:
            (by, y), (joined, part) = features(h, off, leaf)
            kept += [f * WIDTH + y for f in by[1:]] + [(BUCKETS + f) * WIDTH + part for f in joined[1:]] + [(2 * BUCKETS + f) * WIDTH + y for f in joined[1:]]
            if len(kept) > 150:
                flush()
                kept = []
        if kept:
            flush()
        return seen

    return added_up(train, sums, 3)


def gradient(train: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Observed less expected counts of (feature, class) and (feature, part) over all of train."""

    def sums(pieces):
        g = np.zeros((2, BUCKETS, WIDTH), np.float32)
        for h, leaf, off in pieces:
            for k, (by, y) in enumerate(features(h, off, leaf)):
                z = weights[k].take(by[0], axis=0)
                for f in by[1:]:
                    z += weights[k].take(f, axis=0)
                np.exp(z, out=z)
                z /= -z.sum(1, keepdims=True)
                z.ravel()[np.arange(len(y)) * WIDTH + y] += 1
                for f in by[1:]:
                    short = f.astype(np.uint16)  # these are sorted by radix
                    order = np.argsort(short, kind="stable")
                    own = short[order]
                    last = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]]))
                    total = np.cumsum(z.take(order, axis=0), axis=0)[last]
                    total[1:] -= total[:-1].copy()
                    g[k][own[last]] += total
        return g

    return added_up(train, sums, 2)


def trained(train: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of (feature, class) and (feature, part), pulled to 0 as by a Gaussian prior; ``counts``: training tokens of each leaf."""
    weights, n = np.zeros((2, BUCKETS, WIDTH), np.float32), counts.reshape(WIDTH, WIDTH) + 1.0
    weights[0, 0] = np.log(n.sum(1) / n.sum())
    weights[1, :WIDTH] = np.log(n / n.sum(1, keepdims=True))
    *seen, by_class = observed(train)
    seen = np.stack(seen)
    n = seen.sum(2, keepdims=True)
    # The first gradient, at weights of 0: what is expected follows from counts and biases.
    shares = [np.exp(weights[0, 0])[None], np.exp(weights[1, :WIDTH])]
    g = seen - np.stack([n[0] * shares[0] / shares[0].sum(), by_class @ (shares[1] / shares[1].sum(1, keepdims=True))])
    for k in range(rounds):
        g = gradient(train, weights) if k else g
        expected = np.clip(seen - g, 0, n)
        curve = expected * (1 - expected / np.maximum(n, 1))
        step = np.clip((g - PULL * weights) / (2 + PULL + 2.5 * curve), -2, 2)
        step[:, :WIDTH] = 0  # biases
        weights = weights + step
    return weights.astype(np.float32)


def score(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, the end. Repeated rows are texts of their own, in training too; a null
    doc_id stands by each of its rows. An empty table gives no row; without training texts, no word is known.
    """
    spark, rows = docs.sparkSession, rows_of(docs)
    train = rows.where(~F.col("held_out"))
    counts = written(word_counts(train), "word-counts")
    leaves = {r["leaf"]: (r["n"], r["v"]) for r in counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n_all, v_all = sum(n for n, _ in leaves.values()), sum(v for _, v in leaves.values())
    frequent = counts.where(F.col("n") * FREQUENT >= n_all).select("word", "more", "n").orderBy("word").toPandas()  # FREQUENT rows at most
    keys, more_keys = (frequent[c].to_numpy(np.int64).view(np.uint64) for c in ("word", "more"))
    order = np.lexsort((more_keys, keys))
    table = keys[order], more_keys[order], np.log10(frequent["n"].to_numpy(float) + 1)[order]
    below = np.array([log10(sum(leaves.get(k, (0, 0))) + 1) for k in range(LEAVES)])
    n_leaf = np.array([leaves.get(k, (0, 0))[0] for k in range(LEAVES)], float)
    model = spark.sparkContext.broadcast((trained(train, n_leaf), table, below))  # of bounded size

    def run(batches):
        weights, (keys, more_keys, logs), below = model.value
        for b in batches:
            for lo, _, data, off in words.slabs(b.column(1), 1 << 18):
                h, leaf, off, more = tokens(data, off, twice=True)
                n, text = len(off) - 1, np.repeat(np.arange(len(off) - 1), np.diff(off))
                at, known = np.minimum(np.searchsorted(keys, h), len(keys) - 1), np.zeros(len(h), bool)
                if len(keys):
                    known = (keys[at] == h) & (more_keys[at] == more)
                sums = lambda x: np.bincount(text, x, n)
                lm = sum(log_shares(w, by, y) for w, (by, y) in zip(weights, features(h, off, leaf))) / log(10) - below[leaf]
                rare, ends = ~known, np.concatenate([[0], np.cumsum(np.bincount(text[~known], minlength=n))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rare].view(np.int64))) for x in (h, more)]
                known_logs = np.zeros(len(h))
                known_logs[known] = logs[at[known]] if len(keys) else 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), b.column(2).slice(lo, n), pa.array(np.diff(off)), pa.array(sums(known).astype(np.int64)), pa.array(sums(known_logs)), pa.array(sums(lm)), *lists],
                    names=["doc_id", "held_out", "n_tokens", "known", "logs", "lm", "rare", "rare_more"],
                )

    scored = rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, logs double, lm double, rare array<long>, rare_more array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_more")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.rare_more").alias("more"))
    joined = rare.join(counts.where(F.col("n") * FREQUENT < n_all).select("word", "more", "n"), ["word", "more"]).groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    out = scored.drop("rare", "rare_more").join(joined, "row", "left")
    logs_all = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (logs_all - F.col("n_tokens") * F.lit(log10(n_all + v_all + 1))).alias("base_score"), (logs_all + F.col("lm")).alias("score"),
    )
