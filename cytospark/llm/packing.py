"""Packing documents into training sequences as a cutting-stock problem.

A document's ids are cut into full pieces and one remainder. Full pieces are sequences of their
own. Remainders are counted by length class (``grid`` ids a class); a linear program over patterns
(how many of each class share a sequence) is solved by column generation on that histogram, which
has at most width / grid rows whatever the corpus is: a knapsack dynamic program over the duals
finds the next pattern. Patterns are rounded down and what is left over goes first-fit. Remainders,
ranked within their class, are then dealt to the patterns by arithmetic on the rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import prefix_sums, written

END = 0


def pieces(docs: DataFrame, tokenizer: str, width: int, end_id: int = END) -> DataFrame:
    """doc_id, doc_tokens and the crc32 of each piece. Null text is empty: one id, the end id."""

    def run(batches):
        encoder = bpe.Encoder.of(tokenizer)
        for b in batches:
            for lo, ids, off in encoder.of_column(b.column(1)):
                n = len(off) - 1
                ids = np.insert(ids, off[1:], end_id).astype("<u4")
                off = off + np.arange(n + 1)
                crcs = [[bpe.crc(ids[s : min(s + width, e)]) for s in range(a, e, width)] for a, e in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(np.diff(off)), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def best_pattern(worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: class s (from 1) takes s of the capacity and is worth worth[s - 1]."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = worth[:c] + best[c - 1 :: -1][: len(worth[:c])]
        k = int(np.argmax(gain)) if len(gain) else -1
        best[c], took[c] = (gain[k], k + 1) if k >= 0 and gain[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(len(worth), np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row pivots; at most width / grid rows."""
    n = len(a)
    a = np.hstack([a, np.eye(n)])
    for k in range(n):
        r = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, r]] = a[[r, k]]
        a[k] /= a[k, k]
        factor = a[:, k].copy()
        factor[k] = 0
        a -= factor[:, None] * a[k]
    return a[:, n:]


def column_generation(demand: np.ndarray, capacity: int, most_rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is cut, fractional, for the classes with demand."""
    classes = np.flatnonzero(demand) + 1
    if not len(classes):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    exact = demand[classes - 1].astype(float)
    d = exact * (1 + 1e-7 * np.arange(len(classes)))  # no two ratios tie, so the simplex doesn't cycle
    basis = np.diag((capacity // classes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ d
    for k in range(most_rounds):
        worth = np.zeros(len(demand))
        worth[classes - 1] = inverse.sum(0)
        value, pattern = best_pattern(worth, capacity)
        if value <= 1 + 1e-7:
            break
        column = pattern[classes - 1].astype(float)
        step = inverse @ column
        ok = step > 1e-9
        if not ok.any():
            break
        r = int(np.argmin(np.where(ok, np.maximum(x, 0) / np.where(ok, step, 1), np.inf)))
        basis[:, r] = column
        if k % 100 == 99:
            inverse = inverted(basis)
        else:
            row = inverse[r] / step[r]
            inverse = inverse - np.outer(step, row)
            inverse[r] = row
        x = inverse @ d
    patterns = np.zeros((len(classes), len(demand)), np.int64)
    patterns[:, classes - 1] = basis.T.round().astype(np.int64)
    return patterns, np.maximum(inverted(basis) @ exact, 0)


def rounded(demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(copies, pattern): together they take exactly the demand."""
    patterns, x = column_generation(demand, capacity)
    plan, left = [], demand.astype(np.int64).copy()
    for p, n in zip(patterns, np.floor(x + 1e-7).astype(np.int64)):
        n = int(min([n, *(left[s] // p[s] for s in np.flatnonzero(p))]))
        if n > 0:
            plan.append((n, p))
            left -= n * p
    bins: list[tuple[int, np.ndarray]] = []
    while left.any():  # first-fit decreasing, a bin at a time
        room, p = capacity, np.zeros(len(demand), np.int64)
        for s in range(len(demand), 0, -1):
            k = int(min(left[s - 1], room // s))
            p[s - 1] += k
            room -= k * s
        n = int(min(left[s] // p[s] for s in np.flatnonzero(p)))
        bins.append((n, p))
        left -= n * p
    return plan + bins


def pack(docs: DataFrame, tokenizer: str | None = None, width: int = 1024, grid: int = 8) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Repeated doc_ids are documents of their own, a null doc_id stays null. An empty table gives no row.
    """
    spark, capacity = docs.sparkSession, width // grid
    cut = pieces(docs, tokenizer or bpe.default_path(), width).withColumn("row", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    rest = (F.col("doc_tokens") % width).cast("long")
    cut = cut.withColumns({"full": F.floor(F.col("doc_tokens") / width).cast("long"), "rest": rest, "class": F.ceil(rest / grid).cast("int"), "one": F.lit(1)})
    # At most width / grid rows come to the driver.
    counts = {r["class"]: r["n"] for r in cut.where("rest > 0").groupBy("class").agg(F.count("*").alias("n")).collect()}
    demand = np.array([counts.get(s, 0) for s in range(1, capacity + 1)], np.int64)
    deals, sequence, taken = [], 0, np.zeros(capacity, np.int64)
    for n, p in rounded(demand, capacity):
        for s in np.flatnonzero(p).tolist():
            deals.append((s + 1, int(taken[s]), int(taken[s] + n * p[s]), sequence, int(p[s])))
            taken[s] += n * p[s]
        sequence += n
    ranked = prefix_sums(cut, ["class", "doc_id", "row"], {"one": "rank", "full": "full_before"}, "ranked")
    before = {s: int(demand[: s - 1].sum()) for s in range(1, capacity + 1)}
    none = cut.where("rest = 0").count()  # class 0 stands first
    bases = F.create_map(*(F.lit(x) for s, n in before.items() for x in (s, n + none)))
    plan = spark.createDataFrame(deals, "class int, lo long, hi long, first long, per long")
    tails = ranked.where("rest > 0").withColumn("k", F.col("rank") - bases[F.col("class")])
    # capacity classes by at most 2 * capacity patterns: a broadcast of proven size.
    dealt = tails.join(F.broadcast(plan), "class").where("k >= lo and k < hi").withColumn("sequence_id", F.expr("first + (k - lo) div per"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "k").rowsBetween(Window.unboundedPreceding, -1)
    tails = dealt.select(
        "doc_id", (F.col("full") * width).alias("start"), F.col("rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", "sequence_id", F.coalesce(F.sum("rest").over(within), F.lit(0)).alias("offset")
    )
    full = ranked.where("full > 0").select("doc_id", "doc_tokens", "full_before", F.posexplode(F.expr("slice(crcs, 1, int(full))")).alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k").cast("long") * width).alias("start"), F.lit(width).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(sequence) + F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(tails)
