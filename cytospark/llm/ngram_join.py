"""Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. Texts with one set of shingles are one node; their copies are never paired.
2. Each node gets ``HASHES`` MinHash values. Nodes that agree on ``ROWS`` values of a band meet in
   a bucket. Within a bucket pairs are compared value by value, ``STEP`` at a time, and dropped as
   soon as the posterior probability (uniform prior) that their similarity reaches the threshold
   falls below ``TOLERANCE``. What is left joins nodes into candidate clusters.
3. Within a cluster all pairs are verified on the sets of shingles. Sets and shingles are known by
   128 bits that aren't a plain polynomial, so no pattern of letters makes two texts meet.

Buckets and clusters are cut into blocks of at most about ``BLOCK`` nodes and ``BLOCK_BYTES`` of shingles
(a longer text is a block of its own); each pair of blocks is a task's work. A task returns counts and a
spanning forest, never the pairs. Tables that grow with the corpus meet by merge: Spark counts an array or an
exploded row as one value, and so would broadcast them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import merged, merged_if_many, removed, spread_join, written
from .components import components

#: The threshold is a share of whole numbers, which pairs are compared with exactly.
SHARE = (4, 5)
SHINGLE, THRESHOLD = 5, SHARE[0] / SHARE[1]
HASHES, ROWS, STEP, TOLERANCE, BLOCK, BLOCK_BYTES = 128, 4, 16, 1e-6, 512, 8 << 20
#: Groups up to this size share tasks, about this many rows a task.
SMALL, ROWS_A_TASK = 64, 4000

_factors = words.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in one array (128 bits each, in two columns), sorted within a text, and the texts' offsets.

    Words are runs of letters and digits, lower-cased. A text of one to four words is one shingle, one
    without words but not blank is a shingle of its signs; a blank text has none.
    """
    n, data = len(off) - 1, words.LOWER[data]
    s, e = words.segments(data, off, words.WORDLIKE)
    at, view = words.per_text(s, off), words.eights(data)
    count = np.diff(at)
    h = [words.hashes(data, s, e, seed, view) for seed in (0, 1)]
    text = np.repeat(np.arange(n), count)
    inside = text[: 1 - SHINGLE] == text[SHINGLE - 1 :]
    own = [np.column_stack([words.windows(x, SHINGLE)[inside] for x in h])]
    of = [text[: 1 - SHINGLE][inside]]
    for t in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():
        own.append(np.column_stack([words.windows(x[at[t] : at[t + 1]], int(count[t])) for x in h]))
        of.append(np.array([t]))
    for t in np.flatnonzero(count == 0).tolist():
        signs = data[off[t] : off[t + 1]]
        signs = signs[words.NOT_SPACE[signs]]
        if len(signs):
            own.append(np.column_stack([words.hashes(signs, np.array([0]), np.array([len(signs)]), seed) for seed in (0, 1)]))
            of.append(np.array([t]))
    own, of = np.concatenate(own), np.concatenate(of)
    order = np.lexsort((own[:, 0], of))
    own, of = own[order], of[order]
    same = (own[1:, 0] == own[:-1, 0]) & (of[1:] == of[:-1])
    if (same & (own[1:, 1] != own[:-1, 1])).any():
        order = np.lexsort((own[:, 1], own[:, 0], of))
        own, of = own[order], of[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]).any(1) | (of[1:] != of[:-1])
    own, of = own[fresh], of[fresh]
    return own, np.searchsorted(of, np.arange(n + 1))


def signatures(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, a row a text; texts without shingles have zeros."""
    n, filled, own = len(at) - 1, np.flatnonzero(np.diff(at) > 0), np.ascontiguousarray(own[:, 0])
    out = np.zeros((n, HASHES), np.uint16)
    lo = 0
    while lo < len(filled):  # so many shingles at a time that they stay in the cache
        hi = max(lo + 1, int(np.searchsorted(at[filled], at[filled[lo]] + 32768)))
        hi = min(hi, len(filled))
        part = own[at[filled[lo]] : at[filled[hi - 1] + 1]]
        first, room = at[filled[lo:hi]] - at[filled[lo]], np.empty_like(part)
        for k in range(HASHES):
            np.multiply(part, _factors[k], out=room)
            out[filled[lo:hi], k] = (np.minimum.reduceat(room, first) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        lo = hi
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), digest (of the set of shingles; null without any), n_shingles, and keys: the signature as 64-bit bands."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in words.slabs(b.column(1)):
                own, at = shingles(data, off)
                size, keys = np.diff(at), signatures(own, at).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                digest = pa.array([d if n else None for d, n in zip(digests(own, at), size.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), digest, pa.array(size), lists], names=["doc_id", "text_key", "digest", "n_shingles", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, digest binary, n_shingles long, keys array<long>")


def digests(own: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits for each set."""
    sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(words.mix(own ^ np.uint64(0x51ED27F1)), axis=0, dtype=np.uint64)])
    raw = words.mix((sums[at[1:]] - sums[at[:-1]]) ^ np.diff(at).astype(np.uint64)[:, None]).tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 STEP, .. values compared, the fewest matches with posterior P(similarity >= threshold) >= tolerance.

    After m matches of n the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        below = np.cumsum([comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 1)])
        out.append(int(np.argmax(below >= tolerance)))
    return out


_LEAST = least_matches()


def pairs_of(size_a: np.ndarray, size_b: np.ndarray, same: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, place in a, place in b) of all pairs of each group, so many at a time; same: a is b, each pair once."""
    each = size_a * size_b
    ends = np.cumsum(each)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        k = np.arange(lo, min(lo + most, int(ends[-1])))
        g = np.searchsorted(ends, k, side="right")
        k = k - (ends[g] - each[g])
        a, b = k // size_b[g], k % size_b[g]
        ok = ~same[g] | (a < b)
        yield g[ok], a[ok], b[ok]


def similar(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows survive the comparison value by value."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(_LEAST):
        part = slice(k * STEP, (k + 1) * STEP)
        got = got + (sig[a[alive], part] == sig[b[alive], part]).sum(1)
        ok = got >= least
        alive, got = alive[ok], got[ok]
    return alive


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that it is connected with."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label
    return label


def tasks(rows: DataFrame, group: str, node: str, blocks: Column, small: Column, tasks_for_small: int) -> DataFrame:
    """rows with a column for each task that needs them: the task, the blocks it compares, the row's own block.

    Groups are cut into ``blocks`` by a hash of the node; a pair of blocks is a task. Small groups share tasks. Tasks
    are dealt out by range, which evens out their rows.
    """
    blocks = F.greatest(F.ceil(blocks), F.lit(1)).cast("int")
    cut = rows.withColumn("own", F.pmod(F.xxhash64(node, F.lit(1)), blocks.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    task: Column = F.when(small, F.pmod(F.xxhash64(group), F.lit(tasks_for_small))).otherwise(F.xxhash64(group, low, high))
    out = cut.select(task.alias("task"), F.col(group).alias("grp"), low.alias("low"), high.alias("high"), "own", *(c for c in rows.columns if c != group))
    return written(out, "block-tasks")


def sides(pdf: pd.DataFrame):
    """Row numbers of the two sides of each group of a task, and whether they are one."""
    pdf = pdf.sort_values(["grp", "low", "high", "own", "node"], ignore_index=True)
    key = pdf[["grp", "low", "high"]].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    last = np.append(first[1:], len(pdf))
    second = np.array([f + int((pdf["own"].to_numpy()[f:e] == pdf["low"].iat[f]).sum()) for f, e in zip(first.tolist(), last.tolist())])
    same = (pdf["low"] == pdf["high"]).to_numpy()[first]
    return pdf, first, np.where(same, first, second), np.where(same, last - first, second - first), np.where(same, last - first, last - second), same


def candidates(nodes_: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what may be similar: for each bucket's task a spanning forest of the surviving pairs."""
    bands = nodes_.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = written(bands.join(merged(shared), "bucket"), "buckets")
    n = max(1, rows.count() // ROWS_A_TASK)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, a0, b0, na, nb, same = sides(pdf)
        sig = np.stack(pdf["keys"].to_numpy()).astype(np.int64).view(np.uint16).reshape(len(pdf), HASHES)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g, i, j in pairs_of(na, nb, same):
            a, b = a0[g] + i, b0[g] + j
            ok = similar(sig, a, b)
            left.append(a[ok])
            right.append(b[ok])
        node = pdf["node"].to_numpy()
        own, place = np.unique(node, return_inverse=True)
        label = forest(len(own), place[np.concatenate(left)], place[np.concatenate(right)])
        moved = np.flatnonzero(label != np.arange(len(own)))
        return pd.DataFrame({"a": own[moved], "b": own[label[moved]]})

    dealt = tasks(rows.join(merged(nodes_.select("node", "keys")), "node"), "bucket", "node", F.col("size") / BLOCK, F.col("size") <= SMALL, n)
    edges = written(dealt.repartitionByRange("task").groupBy("task").applyInPandas(run, "a long, b long").distinct(), "candidates")
    removed(rows, dealt)
    return edges


def verified(clusters: DataFrame, docs: DataFrame, shingles: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = shingles) -> DataFrame:
    """For each node and task the weight of its links there, and its link into the task's spanning forest; ``shingles`` makes the sets.

    clusters: cluster, node, digest, text_key (of one of its texts), copies, and the cluster's size and bytes.
    """

    def sets(batches):
        for b in batches:
            for lo, hi, data, off in words.slabs(b.column(0)):
                own, at = shingles(data, off)
                flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((at * 16).astype(np.int64).tobytes()), pa.py_buffer(own.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(digests(own, at), pa.binary()), flat], names=["digest", "shingles"])

    total = clusters.agg(F.count("*").alias("n"), F.sum(F.col("n_shingles") * 16).alias("bytes")).first()
    texts = docs.select(F.col("text").cast("string"), F.xxhash64("text").alias("text_key")).join(merged_if_many(clusters.select("text_key"), total["n"]), "text_key", "left_semi")
    found = texts.select("text").mapInArrow(sets, "digest binary, shingles binary").dropDuplicates(["digest"])
    rows = clusters.join(merged(found), "digest").drop("digest", "text_key")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, a0, b0, na, nb, same = sides(pdf)
        flat = told_apart([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in pdf["shingles"]])
        size, weight, node = np.array([len(x) for x in flat]), pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        own, place = np.unique(node, return_inverse=True)
        links, left, right = np.zeros(len(own), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in range(len(a0)):
            a, b = np.arange(a0[g], a0[g] + na[g]), np.arange(b0[g], b0[g] + nb[g])
            common = shared([flat[i] for i in a], None if same[g] else [flat[i] for i in b])
            # the float32 counts are exact: a set has far fewer than 2^24 shingles
            common = common.astype(np.int64)
            linked = SHARE[1] * common >= SHARE[0] * (size[a][:, None] + size[b][None, :] - common)
            if same[g]:
                np.fill_diagonal(linked, False)
            np.add.at(links, place[a], linked @ weight[b])
            if not same[g]:
                np.add.at(links, place[b], linked.T @ weight[a])
            i, j = np.nonzero(linked)
            left.append(place[a[i]])
            right.append(place[b[j]])
        label = forest(len(own), np.concatenate(left), np.concatenate(right))
        return pd.DataFrame({"node": own, "links": links, "to": own[label]})

    n = max(1, total["n"] // ROWS_A_TASK * 4, (total["bytes"] or 0) // BLOCK_BYTES)
    blocks, small = F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES), (F.col("size") <= SMALL) & (F.col("bytes") <= BLOCK_BYTES)
    dealt = tasks(rows.drop("n_shingles"), "cluster", "node", blocks, small, n)
    links = written(dealt.repartitionByRange("task").groupBy("task").applyInPandas(run, "node long, links long, to long"), "links")
    removed(dealt)
    return links


def told_apart(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of 128-bit shingles as sorted sets of 64-bit numbers that are equal where the shingles are."""
    flat = np.concatenate(sets)
    order = np.argsort(flat[:, 0], kind="stable")
    a, b = flat[order[1:]], flat[order[:-1]]
    if ((a[:, 0] == b[:, 0]) & (a[:, 1] != b[:, 1])).any():  # their first halves aren't enough
        ids = np.unique(flat, axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
    else:
        ids = np.ascontiguousarray(flat[:, 0])
    return np.split(ids, np.cumsum([len(x) for x in sets])[:-1])


def shared(a: list[np.ndarray], b: list[np.ndarray] | None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b (or of a), by products of 0/1 matrices."""
    both = a if b is None else a + b
    ids, many = np.unique(np.concatenate(both), return_counts=True)
    ids = ids[many > 1]  # the others are in no intersection
    out = np.zeros((len(a), len(a if b is None else b)), np.float32)
    for k in range(0, len(ids), width):
        part = ids[k : k + width]

        def matrix(sets):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, x in enumerate(sets):
                x = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], side="right")]
                at = np.searchsorted(part, x)
                m[i, at[part[np.minimum(at, len(part) - 1)] == x]] = 1
            return m

        left = matrix(a)
        out += left @ (left if b is None else matrix(b)).T
    return out


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, digest) and nodes (digest, root of the class, copies, links to rows of other nodes, doc and first: least doc_id, least doc_id and text_key)."""
    rows = written(described(docs), "signatures")
    some, at = rows.where("digest is not null"), F.struct("doc_id", "text_key")
    copies = some.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"), F.min(at).alias("first"))
    distinct = some.dropDuplicates(["digest"]).select("digest", "n_shingles", "keys").join(merged(copies), "digest")
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n_nodes = distinct.count()
    met = lambda df: merged_if_many(df, n_nodes)  # noqa: E731  # for tables of a row a node at most
    clusters = written(components(candidates(distinct)).withColumnRenamed("root", "cluster").join(met(distinct.select("node", "digest", "n_shingles", "copies", F.col("first.text_key").alias("text_key"))), "node"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("n_shingles") * 16).alias("bytes"))
    members = written(spread_join(clusters, met(sizes), ["cluster"], ["node"]), "clusters")
    links = verified(members, docs)
    removed(clusters, members)
    roots = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    weight = links.groupBy("node").agg(F.sum("links").alias("links"))
    out = distinct.drop("keys", "n_shingles").join(met(roots), "node", "left").join(met(weight), "node", "left")
    out = written(out.select("digest", "copies", "doc", "first", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    removed(distinct, links, roots)
    return rows.select("doc_id", "text_key", "digest"), out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_links.

    class_id is the least doc_id among all that a chain of links reaches; n_links is how many other
    rows are at least 0.8 similar, copies included. Blank and null texts, and rows whose class has no
    doc_id, are linked with nothing: class_id is their own doc_id.
    """
    rows, out = classes(docs)
    n_nodes = out.count()
    least = out.groupBy("root").agg(F.min("doc").alias("class_id"))
    out = written(spread_join(out, merged_if_many(least, n_nodes), ["root"], ["digest"]).select("digest", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "linked")
    found = spread_join(rows, merged_if_many(out, n_nodes), ["digest"], ["doc_id", "text_key"], "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the first by doc_id (nulls first), then by a hash of the text.

    Blank and null texts are in no class and stay. All columns stay, whatever their names.
    """
    rows, out = classes(docs)
    n_nodes = out.count()
    first = out.groupBy("root").agg(F.min("first").alias("class_first"))
    out = written(spread_join(out, merged_if_many(first, n_nodes), ["root"], ["digest"]).select("digest", "class_first"), "linked")
    rows = spread_join(rows, merged_if_many(out, n_nodes), ["digest"], ["doc_id", "text_key"]).withColumn("stays", F.struct("doc_id", "text_key").eqNullSafe(F.col("class_first")))
    rows = written(rows.select("doc_id", "text_key", "stays"), "stays")
    gone = rows.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    stay = docs.join(merged_if_many(gone, rows.where("not stays").count()), docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")
    # A row that is there twice, id and text: seldom, so it is looked for before texts are shuffled for it.
    twice = rows.where("stays").groupBy(F.col("doc_id").alias("twice_id"), F.col("text_key").alias("twice_key")).agg(F.count("*").alias("n")).where("n > 1")
    n_twice = twice.count()
    if not n_twice:
        return stay
    at = stay["doc_id"].eqNullSafe(twice["twice_id"]) & (F.xxhash64(stay["text"]) == twice["twice_key"])
    return stay.join(merged_if_many(twice, n_twice), at, "left_anti").unionByName(stay.join(merged_if_many(twice, n_twice), at, "left_semi").dropDuplicates(["doc_id", "text"]))
