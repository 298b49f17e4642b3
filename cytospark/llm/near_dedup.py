"""Near copies by tensored MinHash banding, each link confirmed on whole sets of shingles.

1. Texts with one set of four-word shingles are one node; their copies are never paired.
2. A node has two small collections of ``SIDE`` short keys, each made of ``ROWS`` MinHash values. The SIDE x SIDE tables of
   the banding have one short key of either collection combined as their key: 144 tables of 4 values come from 48
   values instead of 576. Only short keys that some other node has are combined. Two sets at similarity s meet in a table
   unless they agree on no key of one collection, which at 0.8 has a chance below 1e-5.
3. Each bucket's least node is its centre. A node is compared on full sets with the centre that it meets in most buckets, so a
   tight group of any size costs a comparison a node, not a pair, and becomes one component.
4. Only buckets that still hold several components go on: their pairs across components are compared by signature, dropped
   where their posterior probability of reaching the threshold is below ``TOLERANCE``, and what is left is verified on
   full sets. Pairs within a component need no comparison, as the result is components.

The centres' tasks and the buckets are cut into blocks of bounded size; tasks return forests, never pairs of a group.
Tables that grow with the corpus meet by merge: Spark counts an array or an exploded row as one value, and so would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join, words
from .common import merged, merged_if_many, removed, spread_join, written
from .components import components, tree_roots

#: Links have SHARE[1] * intersection >= SHARE[0] * union, in whole numbers.
SHARE, SHINGLE = (4, 5), 4
SIDE, ROWS, TOLERANCE = 12, 2, 1e-7
VALUES = 2 * SIDE * ROWS
#: Members a task compares with one centre, and rows of buckets a task.
BLOCK, ROWS_A_TASK = 512, 4000

_factors = words.mix(np.arange(1001, 1001 + VALUES, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles (128 bits each, in two columns), sorted within a text, and the texts' offsets; fewer words than a shingle are one, none are none."""
    n, data = len(off) - 1, words.LOWER[data]
    s, e = words.segments(data, off, words.NOT_SPACE)
    at, view = words.per_text(s, off), words.eights(data)
    count = np.diff(at)
    h = [words.hashes(data, s, e, seed, view) for seed in (0, 1)]
    text = np.repeat(np.arange(n), count)
    inside = text[: 1 - SHINGLE] == text[SHINGLE - 1 :]
    own, of = [np.column_stack([words.windows(x, SHINGLE)[inside] for x in h])], [text[: 1 - SHINGLE][inside]]
    for t in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():
        own.append(np.column_stack([words.windows(x[at[t] : at[t + 1]], int(count[t])) for x in h]))
        of.append(np.array([t]))
    own, of = np.concatenate(own), np.concatenate(of)
    order = np.lexsort((own[:, 1], own[:, 0], of))
    own, of = own[order], of[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]).any(1) | (of[1:] != of[:-1])
    own, of = own[fresh], of[fresh]
    return own, np.searchsorted(of, np.arange(n + 1))


def minima(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The MinHash values of each text, VALUES columns; texts without shingles have zeros."""
    filled, own = np.flatnonzero(np.diff(at) > 0), np.ascontiguousarray(own[:, 0])
    out, lo = np.zeros((len(at) - 1, VALUES), np.uint64), 0
    while lo < len(filled):  # so many shingles at a time that they stay in the cache
        hi = min(max(lo + 1, int(np.searchsorted(at[filled], at[filled[lo]] + 32768))), len(filled))
        part = own[at[filled[lo]] : at[filled[hi - 1] + 1]]
        first, room = at[filled[lo:hi]] - at[filled[lo]], np.empty_like(part)
        for k in range(VALUES):
            np.multiply(part, _factors[k], out=room)
            out[filled[lo:hi], k] = np.minimum.reduceat(room, first)
        lo = hi
    return out


def short_keys(values: np.ndarray) -> np.ndarray:
    """2 * SIDE keys of ROWS values each: the first collection's, then the second's."""
    out = np.zeros((len(values), 2 * SIDE), np.uint64)
    for r in range(ROWS):
        out = words.mix(out + values[:, r::ROWS] + np.arange(2 * SIDE, dtype=np.uint64))
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), digest (of the set of shingles; null without any), n_shingles, keys (short ones), signature (16 bits a value, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in words.slabs(b.column(1)):
                own, at = shingles(data, off)
                size, values = np.diff(at), minima(own, at)
                keys, sig = short_keys(values), (words.mix(values) >> np.uint64(48)).astype(np.uint16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * (2 * SIDE)), pa.array(keys.view(np.int64).ravel()))
                digest = pa.array([d if n else None for d, n in zip(ngram_join.digests(own, at), size.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), digest, pa.array(size), lists, pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "text_key", "digest", "n_shingles", "keys", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, digest binary, n_shingles long, keys array<long>, signature binary")


def least_matches(tolerance: float = TOLERANCE) -> int:
    """The fewest of VALUES matches with a posterior probability (uniform prior) of at least tolerance that the similarity reaches the threshold."""
    t, n = SHARE[0] / SHARE[1], VALUES
    below = np.cumsum([comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(n + 1)])
    return int(np.argmax(below >= tolerance))


_LEAST = least_matches()


def table_rows(nodes: DataFrame) -> DataFrame:
    """bucket, node: for each node all combinations of a first and a second short key that other nodes have too."""
    short = nodes.select("node", F.posexplode("keys").alias("k", "key")).select("node", (F.col("k") < SIDE).alias("first"), F.xxhash64("k", "key").alias("key"))
    common = short.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    held = written(short.join(merged(common), "key"), "short-keys")
    sides = held.groupBy("node").agg(F.collect_list(F.when(F.col("first"), F.col("key"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("key"))).alias("b"))
    out = written(sides.select("node", F.explode("a").alias("x"), "b").select("node", "x", F.explode("b").alias("y")).select("node", F.xxhash64("x", "y").alias("bucket")), "tables")
    removed(held)
    return out


def linked(flat: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of places of flat, sorted sets, are links."""
    ok = SHARE[1] * np.minimum(size[a], size[b]) >= SHARE[0] * np.maximum(size[a], size[b])
    for k in np.flatnonzero(ok).tolist():
        x, y = flat[a[k]], flat[b[k]]
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        ok[k] = SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both)
    return ok


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """Each text's shingles as a sorted set of numbers that are equal where the shingles' 128 bits are."""
    own, at = [], []
    for _, _, data, off in words.slabs(pa.array(texts, pa.large_string())):
        x, y = shingles(data, off)
        own.append(x)
        at.append(np.diff(y))
    at = np.concatenate([[0], np.cumsum(np.concatenate(at))])
    flat = np.concatenate(own)
    return ngram_join.told_apart([flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())])


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one of the texts of each node (node, text_key, digest) given."""
    one = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return one.join(merged(nodes.select("node", "text_key").distinct()), "text_key").dropDuplicates(["node"]).select("node", "text")


def to_centres(edges: DataFrame, texts: DataFrame, n_nodes: int) -> DataFrame:
    """The links among edges (a, b: the centre) of n_nodes nodes: a task has a centre and at most about BLOCK of its members."""
    parts = edges.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    own = spread_join(edges, merged_if_many(parts, n_nodes), ["b"], ["a"]).withColumn("part", F.pmod(F.xxhash64("a", F.lit(7)), "parts"))
    own = written(own.select("a", "b", "part"), "centres")
    members = own.join(merged(texts.withColumnRenamed("node", "a")), "a").select("b", "part", F.col("a").alias("node"), "text")
    centres = own.select("b", "part").distinct().join(merged(texts.withColumnRenamed("node", "b")), "b").select("b", "part", F.col("b").alias("node"), "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, b = pdf["node"].to_numpy(), pdf["b"].to_numpy()
        flat = sets_of(pdf["text"].tolist())
        size = np.array([len(x) for x in flat])
        key = pd.MultiIndex.from_arrays([b, pdf["part"]])
        at = np.flatnonzero(node == b)
        x = np.flatnonzero(node != b)
        y = at[pd.Index(key[at]).get_indexer(key[x])]
        ok = linked(flat, size, x, y)
        return pd.DataFrame({"a": node[x[ok]], "b": node[y[ok]]})

    # Centres of few members share a task.
    task = F.xxhash64("b", "part")
    n = max(1, own.count() // BLOCK)
    dealt = members.unionByName(centres).withColumn("task", F.pmod(task, F.lit(4 * n)))
    out = written(dealt.groupBy("task").applyInPandas(run, "a long, b long"), "links")
    removed(own)
    return out


def across(tables: DataFrame, labels: DataFrame, nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Pairs of nodes (a, b) that meet in a bucket, are of different components, and whose signatures don't rule a link out: for each task a spanning forest of them."""
    rows = spread_join(tables, merged_if_many(labels, n_nodes), ["node"], ["bucket"])
    rows = written(rows, "labelled")
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size")
    rest = written(rows.join(merged(mixed), "bucket"), "mixed")
    removed(rows)
    n = max(1, rest.count() // ROWS_A_TASK)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grp", "low", "high", "label", "node"], ignore_index=True)
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint16).reshape(len(pdf), VALUES)
        size, node, own = pdf["n_shingles"].to_numpy(), pdf["node"].to_numpy(), pdf["own"].to_numpy()
        key = pdf[["grp", "low", "high"]].to_numpy()
        new_task = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
        new_label = new_task | np.concatenate([[True], pdf["label"].to_numpy()[1:] != pdf["label"].to_numpy()[:-1]])
        next_of = lambda new: np.append(np.flatnonzero(new)[1:], len(pdf))[np.cumsum(new) - 1]
        after, end = next_of(new_label), next_of(new_task)
        many = end - after  # rows of other components further on
        ends = np.cumsum(many)
        single = pdf["low"].to_numpy() == pdf["high"].to_numpy()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, int(ends[-1]), 200_000):
            k = np.arange(lo, min(lo + 200_000, int(ends[-1])))
            a = np.searchsorted(ends, k, side="right")
            b = after[a] + k - (ends[a] - many[a])
            ok = (single[a] | (own[a] != own[b])) & (SHARE[1] * np.minimum(size[a], size[b]) >= SHARE[0] * np.maximum(size[a], size[b]))
            a, b = a[ok], b[ok]
            ok = (sig[a] == sig[b]).sum(1) >= _LEAST
            left.append(a[ok])
            right.append(b[ok])
        ids, at = np.unique(node, return_inverse=True)
        label = ngram_join.forest(len(ids), at[np.concatenate(left)], at[np.concatenate(right)])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})

    dealt = ngram_join.tasks(rest.join(merged(nodes.select("node", "n_shingles", "signature")), "node"), "bucket", "node", F.col("size") / BLOCK, F.col("size") <= ngram_join.SMALL, n)
    out = written(dealt.repartitionByRange("task").groupBy("task").applyInPandas(run, "a long, b long").distinct(), "across")
    removed(rest, dealt)
    return out


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, n_shingles), and digest, component_id, copies for each distinct set."""
    rows = written(described(docs), "signatures")
    some = rows.where("digest is not null")
    docs_of = some.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "text_key"))["text_key"].alias("text_key"))
    nodes = some.dropDuplicates(["digest"]).select("digest", "n_shingles", "keys", "signature").join(merged(docs_of), "digest")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n_nodes = nodes.count()
    met = lambda df: merged_if_many(df, n_nodes)  # noqa: E731  # for tables of a row a node at most
    tables = table_rows(nodes)
    centre = tables.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b")
    # Of its buckets' centres a node is compared with the one that it meets most often; the pairs that this leaves out come in step 4.
    meetings = tables.join(merged(centre), "bucket").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n"))
    edges = written(meetings.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")), "edges")
    few = nodes.select("node", "n_shingles", "signature")
    alike = edges.join(met(few.selectExpr("node as a", "n_shingles as size_a")), "a").join(met(few.selectExpr("node as b", "n_shingles as size_b")), "b")
    edges_of_size = written(alike.where(SHARE[1] * F.least("size_a", "size_b") >= SHARE[0] * F.greatest("size_a", "size_b")).select("a", "b"), "edges")
    removed(edges)
    wanted = edges_of_size.select(F.col("a").alias("node")).union(edges_of_size.select("b")).distinct().join(met(nodes.select("node", "text_key")), "node")
    texts = written(texts_of(docs, wanted), "texts")
    links = to_centres(edges_of_size, texts, n_nodes)
    removed(edges_of_size, texts)
    roots = tree_roots(links)  # a centre is the least of its bucket, and a node has one: these are trees
    labels = written(nodes.select("node").join(met(roots), "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")
    removed(roots)
    more = across(tables, labels, nodes, n_nodes)
    removed(tables)
    clusters = written(components(more).withColumnRenamed("root", "cluster").join(met(nodes.select("node", "digest", "n_shingles", "copies", "text_key")), "node"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("n_shingles") * 16).alias("bytes"))
    members = written(spread_join(clusters, met(sizes), ["cluster"], ["node"]), "clusters")
    rest = ngram_join.verified(members, docs, shingles)
    removed(clusters, members, more)
    # What was found across components joins their labels.
    label = lambda c: met(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")))
    found = rest.where("node <> to").select("node", "to").join(label("node"), "node").join(label("to"), "to").where("label_node <> label_to")
    roots = components(found.select(F.col("label_node").alias("a"), F.col("label_to").alias("b")))
    whole = spread_join(labels, met(roots.withColumnRenamed("node", "label")), ["label"], ["node"], "left").select("node", F.coalesce("root", "label").alias("root"))
    out = written(nodes.select("node", "digest", "copies", "doc").join(met(whole), "node").select("digest", "copies", "doc", "root"), "classes")
    removed(nodes, labels, links, rest, roots)
    return rows.select("doc_id", "digest", "n_shingles", "text_key"), out


def near_copies(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id that a chain of links reaches, the row's own included; kept tells
    whether it is the row's own. Texts that are null or without words have no shingle and are linked with nothing.
    Rows with one doc_id are rows of their own; a row whose component has no doc_id has none as its component, and is kept.
    """
    rows, out = classes(docs)
    n_nodes = out.count()
    least = out.groupBy("root").agg(F.min("doc").alias("component_id"))
    out = written(spread_join(out, merged_if_many(least, n_nodes), ["root"], ["digest"]).select("digest", "component_id"), "components")
    found = spread_join(rows, merged_if_many(out, n_nodes), ["digest"], ["doc_id", "text_key"], "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
