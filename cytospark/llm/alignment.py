"""Two tokenizers' tokens of the same text aligned by interval coalescing, and how often their ids go together.

Tokens are intervals of bytes. All tokens of both tokenizers are sorted by start (lexsort), the running
maximum of their ends is taken, and a group breaks where a start reaches it; within a group every A token is
linked with every B token. A space or a newline after what isn't white space always begins a part for the A
tokenizer, as does a change between letters, digits and other signs (but for what follows an apostrophe), and B has no piece
that goes across such a place, so both end a token there: texts are cut at such places, and each distinct chunk is tokenized
and coalesced once (a bounded cache, known by its bytes). A text's groups are its chunks' groups in order.

How many documents hold a pair of ids is counted by Spark over each document's distinct pairs. The most frequent
pairs (``MOST_HOT`` at most) go to every task, and what a document has of them is summed where it lies; the rest,
each of which few documents hold, meet their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, words
from .common import removed, written

MOST_CHUNKS, MOST_BYTES, MOST_HOT, MOST_PAIRS = 300_000, 16 << 20, 1 << 18, 2_000_000
SPACE = "▁"

_visible = np.zeros(256, bool)
_visible[0x21:0x7F] = True


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The sign that a byte-level vocabulary has for each byte: itself where it is visible, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def changes(vocabularies: list[list[bytes]]) -> np.ndarray:
    """For each two ASCII bytes whether a part ends between them: their kinds differ, the first is no apostrophe, and no token holds them side by side."""
    kind = np.array([0 if chr(i).isalpha() else 1 if chr(i).isdigit() else 2 for i in range(128)])
    out = np.zeros((256, 256), bool)
    out[0x21:0x7F, 0x21:0x7F] = (kind[:, None] != kind[None, :])[0x21:0x7F, 0x21:0x7F]
    out[ord("'")] = False
    for tokens in vocabularies:
        for t in tokens:
            for a, b in zip(t, t[1:]):
                out[a, b] = False
    return out


def cuts(data: np.ndarray, off: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, at each space or newline after a sign that surely isn't white space, and at changes of kind."""
    at = np.flatnonzero((data[1:] == 0x20) | (data[1:] == 0x0A)) + 1
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    tail = (one >= 0x80) & (one < 0xC0)
    wide = tail & (two >= 0xC3) & (two < 0xE0) | tail & (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three < 0xF0)
    edges = np.zeros(len(data) + 1, bool)
    edges[at[_visible[one] | wide]] = True
    edges[1:-1] |= changes[data[:-1], data[1:]]
    edges[off[:-1]] = True
    edges[len(data)] = False
    return np.flatnonzero(edges)


def coalesced(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the tokens by start, and in that order the number of each one's group."""
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks)


def links(owner: np.ndarray, group: np.ndarray, kind: np.ndarray, ids: np.ndarray, most: int = MOST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, how many links) for each distinct pair of an A and a B id, A * 2^16 + B, that share groups of an owner.

    Tokens come group by group; so many pairs are expanded at a time.
    """
    # distinct ids of each group and side, with their number: a group of many equal tokens is a few pairs
    key = (group.astype(np.uint64) << np.uint64(17)) | (kind.astype(np.uint64) << np.uint64(16)) | ids.astype(np.uint64)
    own, n = np.unique(key, return_counts=True)
    g, b_side, ids = (own >> np.uint64(17)).astype(np.int64), (own >> np.uint64(16) & np.uint64(1)).astype(bool), own & np.uint64(0xFFFF)
    first = np.zeros(int(g[-1]) + 2 if len(g) else 1, np.int64)
    owner_of = np.zeros(len(first) - 1, np.int64)
    owner_of[group] = owner
    a, b = np.flatnonzero(~b_side), np.flatnonzero(b_side)
    first[1:] = np.cumsum(np.bincount(g[b], minlength=len(first) - 1))
    many = np.diff(first)[g[a]]  # partners of each A id
    ends = np.cumsum(many)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        k = np.arange(lo, min(lo + most, int(ends[-1])))
        x = np.searchsorted(ends, k, side="right")
        y = b[first[g[a[x]]] + k - (ends[x] - many[x])]
        x = a[x]
        out.append(merged(owner_of[g[x]], ((ids[x] << np.uint64(16)) | ids[y]), n[x] * n[y]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return out[0] if len(out) == 1 else merged(*(np.concatenate(x) for x in zip(*out)))


def merged(owner: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each owner and pair, sorted, with the sum of n."""
    key = (owner.astype(np.uint64) << np.uint64(32)) | pair
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order], first) if len(key) else np.zeros(0, np.int64)
    return (key[first] >> np.uint64(32)).astype(np.int64), key[first] & np.uint64(0xFFFFFFFF), sums


class Spellings:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """All ids' bytes, one behind the other."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Aligner:
    """What a worker knows of chunks: numbers of tokens and groups, the groups as text, and the linked pairs."""

    _kept: dict[tuple[str, str], "Aligner"] = {}

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in cls._kept:
            cls._kept[path_a, path_b] = cls(path_a, path_b)
        return cls._kept[path_a, path_b]

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte, special = byte_level(), {i for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = {i: (t.encode() if i in special else bytes(byte[c] for c in t)) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if max(self.bytes_a) >= 1 << 16 or len(pieces) > 1 << 16:
            raise ValueError("a pair of ids is kept in 32 bits: vocabularies of up to 65,536 ids")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError(f"{path_b}: pieces with a space after another sign, or with a newline, can't be cut there")
        self.lead = self.b.encode("\n")
        if [self.bytes_b[i] for i in self.lead] != [b" ", b"\n"]:
            raise ValueError(f"{path_b}: it must add a space to a text and keep newlines")
        self.spellings = Spellings([self.bytes_a.get(i, b"") for i in range(max(self.bytes_a) + 1)]), Spellings(self.bytes_b)
        self.digits = Spellings([str(i).encode() for i in range(1 << 16)])
        self.changes = changes([[t for i, t in self.bytes_a.items() if i not in special], self.bytes_b])
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted keys, and where each one's entry is
        self.texts, self.entries = np.zeros(0, np.uint8), np.zeros((0, 9), np.int64)  # n_a, n_b, n_groups, n_links, differs, text at, size, pairs at, number
        self.view, self.groups = words.eights(self.texts), []
        self.pairs, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def tokens(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks, which begin with a space or a newline that ends what stood before."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast(plain, add_special_tokens=False)]
        b = self.b.encode(["\n" + t for t in plain], num_threads=1)  # behind a newline no space is added
        return a, [ids[len(self.lead) :] for ids in b]

    def aligned(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Entries of chunks without their places, their groups as text, and all their pairs and link counts in order."""
        a, b = self.tokens(texts)
        flat = lambda side: (np.fromiter(chain.from_iterable(side), np.int64), np.fromiter(map(len, side), np.int64, len(side)))
        (ids_a, n_a), (ids_b, n_b) = flat(a), flat(b)
        ids, same = [ids_a, ids_b], [True] * len(texts)
        whole, length = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        if not all((np.bincount(np.repeat(np.arange(len(texts)), n), x.size[i], len(texts)) == length).all() and x.of(i).tobytes() == whole for x, i, n in zip(self.spellings, ids, (n_a, n_b))):
            same = [b"".join(map(self.bytes_a.__getitem__, x)) == t == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, t in zip(a, b, texts)]
            (ids_a, n_a), (ids_b, n_b) = flat([x if ok else [] for x, ok in zip(a, same)]), flat([y if ok else [] for y, ok in zip(b, same)])
            ids = [ids_a, ids_b]
        ends, starts, owners = [], [], []
        for side, n, size in zip(ids, (n_a, n_b), (x.size for x in self.spellings)):
            end = np.cumsum(size[side])
            starts.append(end - size[side])  # both sides have the same bytes, so both count from the chunks' bases
            ends.append(end)
            owners.append(np.repeat(np.arange(len(texts)), n))
        kind = np.repeat([0, 1], [len(x) for x in ids])
        order, group = coalesced(np.concatenate(starts), np.concatenate(ends), kind)
        ids, kind, owner = np.concatenate(ids)[order], kind[order], np.concatenate(owners)[order]
        own, pair, n = links(owner, group, kind, ids)
        n_groups = np.bincount(owner[np.flatnonzero(np.diff(group, prepend=-1))], minlength=len(texts)) if len(group) else np.zeros(len(texts), np.int64)
        n_links, n_pairs = np.bincount(own, weights=n, minlength=len(texts)).astype(np.int64), np.bincount(own, minlength=len(texts))
        return np.column_stack([n_a, n_b, n_groups, n_links, ~np.array(same, bool), n_pairs]), self.spelled(owner, group, kind, ids, len(texts)), pair, n

    def spelled(self, owner: np.ndarray, group: np.ndarray, kind: np.ndarray, ids: np.ndarray, n: int) -> list[bytes]:
        """`a1,a2|b1;a3|b2`: each chunk's groups. Tokens come by group."""
        order = np.argsort(group * 2 + kind, kind="stable")
        owner, group, kind, ids = owner[order], group[order], kind[order], ids[order]
        mark = np.full(len(ids), ord(","), np.uint8)  # what stands behind each id
        mark[:-1][kind[1:] != kind[:-1]] = ord("|")
        mark[:-1][group[1:] != group[:-1]] = ord(";")
        size = self.digits.size[ids] + 1
        ends, out = np.cumsum(size), np.empty(int(size.sum()), np.uint8)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside], out[ends - 1] = self.digits.of(ids), mark
        raw, edge = out.tobytes(), np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(n + 1))]
        return [raw[x : y - 1] if y > x else b"" for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        got, groups, pairs, times = self.aligned(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        where, first = np.searchsorted(self.keys, keys), len(self.entries)
        begin = lambda n, at: at + np.cumsum(n) - n
        more = np.column_stack([got[:, :5], begin(size, len(self.texts)), size, begin(got[:, 5], len(self.pairs)), got[:, 5]])
        self.keys, self.place = np.insert(self.keys, where, keys), np.insert(self.place, where, np.arange(first, first + len(keys)))
        self.entries, self.groups = np.concatenate([self.entries, more]), self.groups + groups
        self.texts = np.concatenate([self.texts, np.frombuffer(b"".join(texts), np.uint8)])
        self.view = words.eights(self.texts)
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    def slab(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text, which begins with its added space: counts (four columns) and the groups' digest; then the text, pair and number of all links."""
        n = len(off) - 1
        if not len(data):
            return np.zeros((n, 4), np.int64), [""] * n, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = cuts(data, off, self.changes)
        ends, raw = np.append(starts[1:], len(data)), data.tobytes()
        size = ends - starts
        number = words.numbered(data, starts, ends, h := words.hashes(data, starts, ends))
        _, first, back = np.unique(number, return_index=True, return_inverse=True)
        own, one = np.unique(h[first], return_index=True)
        odd = np.setdiff1d(np.arange(len(first)), one)  # chunks with another one's hash are aligned apart
        text = lambda k: [raw[x:y] for x, y in zip(starts[first[k]].tolist(), ends[first[k]].tolist())]
        if len(self.keys) + len(own) > MOST_CHUNKS or len(self.texts) + int(size[first].sum()) > MOST_BYTES:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = self.keys[at] != own if len(self.keys) else np.ones(len(own), bool)
        if new.any():
            self.learn(own[new], text(one[new]))
        entry = np.zeros(len(first), np.int64)
        entry[one] = self.place[np.searchsorted(self.keys, own)]
        held = self.entries[entry[one]]
        other = (held[:, 6] != size[first[one]]) | ~words.equal(self.texts, held[:, 5], data, starts[first[one]], np.minimum(held[:, 6], size[first[one]]), self.view)
        odd = np.union1d(odd, one[other])
        entries, groups, pairs, times = self.entries, self.groups, self.pairs, self.times
        if len(odd):
            got, more, p, t = self.aligned(text(odd))
            entry[odd] = len(entries) + np.arange(len(odd))
            entries = np.concatenate([entries, np.column_stack([got[:, :5], np.zeros((len(odd), 2), np.int64), len(pairs) + np.cumsum(got[:, 5]) - got[:, 5], got[:, 5]])])
            groups, pairs, times = groups + more, np.concatenate([pairs, p]), np.concatenate([times, t])
        at, chunk = np.searchsorted(starts, off), entry[back]
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(entries[chunk, :5], axis=0)])
        sums = sums[at[1:]] - sums[at[:-1]]
        good = (sums[:, 4] == 0) & (np.diff(at) > 0)
        digests = [hashlib.sha256(b";".join(map(groups.__getitem__, chunk[x:y].tolist()))).hexdigest() if ok else "" for x, y, ok in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist())]
        doc = np.repeat(np.arange(n), np.diff(at))
        chunk, doc = chunk[good[doc]], doc[good[doc]]
        many = entries[chunk, 8]
        ends = np.cumsum(many)
        take = np.repeat(entries[chunk, 7] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
        return sums[:, :4] * good[:, None], digests, *merged(np.repeat(doc, many), pairs[take], times[take])


def aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256; pairs (distinct, A * 2^16 + B in 32 bits) and how many links each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*paths)
        for b in batches:
            for lo, hi, data, off in words.slabs(b.column(1)):
                there = np.flatnonzero(np.diff(off) > 0)
                data = np.insert(data, off[there], 0x20)
                off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
                counts, digests, doc, pair, n = aligner.slab(data, off)
                at = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.uint32).view(np.int32))) for x in (pair, n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(c)) for c in counts.T), pa.array(digests), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (no other pair of its A id has more)."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.shiftrightunsigned("pair", 16)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    out = written(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    removed(counts)
    return out


def align(docs: DataFrame, paths: tuple[str, str] | None = None, most_hot: int = MOST_HOT) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose tokens' bytes aren't a space and the text, have zeros and an empty
    digest, and hold no pair. Repeated doc_ids are documents of their own, and a null doc_id stays null.
    """
    found = written(aligned(docs, paths or default_paths()).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(found)
    # How many pairs reach each power of two of documents: at most 64 rows. The hot ones are all pairs from the least power on that leaves no more than most_hot.
    scale = sorted((r["power"], r["many"]) for r in counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) + 1e-9).alias("power")).agg(F.count("*").alias("many")).collect())
    least, held = 62, 0
    for power, many in reversed(scale):
        if held + many > most_hot:
            break
        least, held = power, held + many
    cold = held < sum(many for _, many in scale)
    hot = counts.where(F.col("n") >= F.lit(1).cast("long") * (1 << least)).toPandas()
    code = hot["pair"].to_numpy(np.int32).view(np.uint32)
    order = np.argsort(code)
    code, n_of, best_of = code[order], hot["n"].to_numpy(np.int64)[order], hot["best"].to_numpy(bool)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, times = b.column(7), b.column(8)
            off = pairs.offsets.to_numpy().astype(np.int64)
            flat, many = pairs.values.to_numpy()[off[0] : off[-1]].view(np.uint32), times.values.to_numpy()[off[0] : off[-1]].view(np.uint32).astype(np.int64)
            off = off - off[0]
            at = np.minimum(np.searchsorted(code, flat), max(0, len(code) - 1))
            hit = code[at] == flat if len(code) else np.zeros(len(flat), bool)
            value = np.zeros((len(flat) + 1, 3), np.int64)
            if hit.any():
                value[1:][hit] = np.column_stack([many[hit] * best_of[at[hit]], many[hit] * n_of[at[hit]], np.zeros(int(hit.sum()), np.int64)])
            value[1:, 2] = ~hit
            sums = np.cumsum(value, axis=0)[off]
            rest = [pa.ListArray.from_arrays(pa.array(sums[:, 2].astype(np.int32)), pa.array(x[~hit].astype(np.uint32).view(np.int32))) for x in (flat, many)]
            sums = np.diff(sums, axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), *rest], names=["row", *names, "n_best", "count_sum", "pairs", "times"])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<int>, times array<int>"
    out = found.select("row", *names, "pairs", "times").mapInArrow(run, kinds)
    if cold:
        out = written(out, "scored")
        rest = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times").join(counts.withColumnRenamed("pair", "pairs"), "pairs")
        rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
        out = out.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.select(*names[:5], "n_best", "count_sum", "groups_sha256")
