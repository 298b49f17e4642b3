"""Conversations in a chat template, merged into prefix trees.

Conversations that begin with the same turns share those turns' tokens: a tree's node is a turn
after a given history, and the stream holds each node once, depth-first. A node carries its
position ids' first value (tokens of all its ancestors), and the stream intervals of its
ancestors, to which its tokens attend besides those before them in the node. Nodes that follow
their parent at once make a run, so ancestors are few intervals: one for each run on the path.

A node is named by the hash of its history. Trees are cut into chains: runs of nodes without another
child. A chain's path is the hashes of the first nodes of all chains above it and of its own, and nodes are
ordered by path and place in the chain, which is a depth-first order; so trees are laid out by a range
shuffle and a prefix scan, however many conversations share a first turn, and a path grows with the branches
above a turn, not with the turns. Joins on turns that many conversations share are split.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from . import bpe
from .common import prefix_sums, removed, scratch_tables, spread_join, written

#: Marks of the roles; other roles stand in hex between the last pair.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]|SYS\]|ROLE[\]:]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]|SYS\]|ROLE[\]:]))")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[SYS\] (?P<system>.*?) \[/SYS\]|\[ROLE:(?P<hex>[0-9a-f]*)\](?P<other>.*?)\[/ROLE\]", re.S)


def escaped(text: str) -> str:
    """Control strings in a text get a backslash after their bracket; those with some already get one more."""
    return _CONTROL.sub(r"\1\2\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"[ROLE:{role.encode().hex()}]", "[/ROLE]")


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for m in _TURN.finditer(formatted):
        role = next((r for r in MARKS if m[r] is not None), None)
        out.append((role, unescaped(m[role])) if role else (bytes.fromhex(m["hex"]).decode(), unescaped(m["other"])))
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turns (in order): rows of one conv_id by turn, then role and text where turns tie. Nulls are empty; a null conv_id is a conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def node_of(parent: bytes, role: bytes, text: bytes) -> bytes:
    """The hash of a turn and all before it. Lengths stand before bytes, so neither role and text nor a first turn and a later one run together."""
    return hashlib.blake2b(bytes([len(parent)]) + parent + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()


def placed(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, k, its node and the node before, role and text."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for conv, all_turns in zip(pdf["conv_id"], pdf["turns"]):
                h = b""
                for k, t in enumerate(all_turns):
                    before, h = h, node_of(h, t["role"].encode(), t["text"].encode())
                    rows.append((None if pd.isna(conv) else int(conv), k, h, before, t["role"], t["text"]))
            yield pd.DataFrame(rows, columns=["conv_id", "k", "node", "parent", "role", "text"]).astype({"conv_id": "Int64"})

    return turns(conversations).mapInPandas(run, "conv_id long, k int, node binary, parent binary, role string, text string")


def chains(places: DataFrame) -> DataFrame:
    """A row for each node: node, path and idx (its place in its chain). ``places`` is a written table."""
    branches = places.select("parent", "node").distinct().groupBy("parent").agg(F.count("*").alias("children")).where("children > 1").select("parent", F.lit(True).alias("branch"))
    later = written(places.where("k > 0").select("conv_id", "k", "node", "parent"), "chat-edges")
    begins = spread_join(later, written(branches, "chat-branches"), ["parent"], ["conv_id", "k"], "left").select("conv_id", "k", "node", F.coalesce("branch", F.lit(False)).alias("begins"))
    begins = begins.unionByName(places.where("k = 0").select("conv_id", "k", "node", F.lit(True).alias("begins")))
    lists = begins.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "node", "begins"))).alias("nodes"))

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for nodes in pdf["nodes"]:
                path, idx = b"", 0
                for n in nodes:
                    path, idx = (path + bytes(n["node"]), 0) if n["begins"] else (path, idx + 1)
                    rows.append((n["node"], path, idx))
            yield pd.DataFrame(rows, columns=["node", "path", "idx"])

    return lists.select("nodes").mapInPandas(run, "node binary, path binary, idx int").dropDuplicates(["node"])


def prefix_tree(places: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each node of the stream.

    node, parent, depth, role, formatted, loss_from and loss_to (code points of formatted under the loss
    mask: an assistant's escaped text, else none), ids, loss_ids_from and loss_ids_to, n_tokens, start (in
    the stream), position (of the first token), attends (start and end of its ancestors' intervals, from the root).
    """

    def run(batches):
        encoder = bpe.Encoder.of(tokenizer, plain=True)  # as marks, so special tokens: a text can't make them
        for b in batches:
            role, text = b.column(5).to_pylist(), b.column(6).to_pylist()
            body, around = [escaped(t) for t in text], [marks(r) for r in role]
            flat = [x for t, (o, c) in zip(body, around) for x in (o, t, c)]
            ids, off = [], [0]
            for _, got, at in encoder.of_column(pa.array(flat, pa.string())):
                ids.append(got)
                off += (off[-1] + at[1:]).tolist()
            ids, off = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32), np.array(off)
            mine = [r == "assistant" for r in role]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:6], pa.array([o + t + c for t, (o, c) in zip(body, around)], pa.string()),
                    pa.array([len(o) if m else 0 for m, (o, _) in zip(mine, around)], pa.int32()), pa.array([len(o) + len(t) if m else 0 for m, t, (o, _) in zip(mine, body, around)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(off[::3].astype(np.int32)), pa.array(ids)),
                    pa.array(np.where(mine, off[1::3] - off[:-1:3], 0).astype(np.int32)), pa.array(np.where(mine, off[2::3] - off[:-1:3], 0).astype(np.int32)), pa.array(np.diff(off[::3])),
                ],
                names=["node", "parent", "depth", "path", "idx", "role", "formatted", "loss_from", "loss_to", "ids", "loss_ids_from", "loss_ids_to", "n_tokens"],
            )

    distinct = places.select("node", "parent", "k", "role", "text").dropDuplicates(["node"]).join(chains(places), "node").select("node", "parent", F.col("k").alias("depth"), "path", "idx", "role", "text")
    schema = "node binary, parent binary, depth int, path binary, idx int, role string, formatted string, loss_from int, loss_to int, ids array<int>, loss_ids_from int, loss_ids_to int, n_tokens long"
    fields = [StructField("run", BinaryType()), StructField("back", LongType())]
    nodes = written(distinct.mapInArrow(run, schema), "chat-tokens")  # else the sampling of ranges would make them too
    stream = written(prefix_sums(nodes, ["path", "idx"], {"n_tokens": "start"}, "chat-nodes", fields, in_runs), "chat-stream")
    removed(nodes)
    # Only the first node of a run looks up its ancestors: all of the chains above it, and its own up to it.
    spans = stream.groupBy(F.expr("substring(path, length(path) - 15, 16)").alias("at")).agg(F.min("start").alias("from"), F.max(F.col("start") + F.col("n_tokens")).alias("to"))
    spans = written(spans, "chat-spans")
    heads = stream.where("back = 0").select(F.col("node").alias("head"), "start", F.explode(F.expr("transform(sequence(0, int(length(path) / 16) - 1), i -> substring(path, i * 16 + 1, 16))")).alias("at"))
    above = spread_join(written(heads, "chat-heads"), spans, ["at"], ["head"]).select("head", F.col("from").alias("begin"), F.least("to", "start").alias("end")).where("begin < end").groupBy("head")
    above = above.agg(F.sort_array(F.collect_list(F.struct(F.col("begin").alias("start"), "end"))).alias("above"), F.sum(F.col("end") - F.col("begin")).alias("before"))
    out = spread_join(stream, above.withColumnRenamed("head", "run"), ["run"], ["node"], "left")
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    own = F.when(F.col("back") > 0, F.array(F.struct((F.col("start") - F.col("back")).alias("start"), F.col("start").alias("end")))).otherwise(none)
    return out.select(
        "node", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "depth", "role", "formatted", "loss_from", "loss_to", "ids", "loss_ids_from", "loss_ids_to", "n_tokens", "start",
        (F.coalesce("before", F.lit(0)) + F.col("back")).alias("position"), F.concat(F.coalesce("above", none), own).alias("attends"),
    )


def in_runs():
    """For each node, in stream order: the first node of its run, and the tokens from there to it."""
    last, head, at = None, None, 0

    def make(b: pa.RecordBatch, before: np.ndarray) -> list[pa.Array]:
        nonlocal last, head, at
        runs, back = [], []
        column = lambda name: b.column(b.schema.get_field_index(name)).to_pylist()
        for parent, node, start in zip(column("parent"), column("node"), before.tolist()):
            if parent != last:
                head, at = node, start
            last = node
            runs.append(head)
            back.append(start - at)
        return [pa.array(runs, pa.binary()), pa.array(back, pa.int64())]

    return make


def read_back(places: DataFrame, tree: DataFrame) -> DataFrame:
    """Each conversation from the tree's nodes: digests of what its formatted text and its loss mask say."""
    parts = spread_join(places.select("conv_id", "k", "node"), tree.select("node", "formatted", "loss_from", "loss_to", "position", "n_tokens"), ["node"], ["conv_id", "k"])
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "formatted", "loss_from", "loss_to", "position", "n_tokens"))).alias("parts"))

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for conv, parts in zip(pdf["conv_id"], pdf["parts"]):
                text = "".join(p["formatted"] for p in parts)
                found = parsed(text)
                loss = "".join(unescaped(p["formatted"][p["loss_from"] : p["loss_to"]]) for p in parts)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest()
                rows.append((None if pd.isna(conv) else int(conv), len(found), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), parts[-1]["position"] + parts[-1]["n_tokens"]))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]).astype({"conv_id": "Int64"})

    return whole.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def chat(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conversations formatted, merged, and read back: a row for each conv_id; an empty table gives none.

    A conversation is read back by one task, whatever its length; turns that are there twice are two turns.
    """
    with scratch_tables() as tables:  # of which only what is returned is read later
        places = written(placed(conversations), "chat-turns")
        tree = written(prefix_tree(places, tokenizer or bpe.default_path()), "chat-tree")
        return tables.keep(written(read_back(places, tree), "chat-read"))
