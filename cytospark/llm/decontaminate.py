"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of the corpus.

Items are cut into entries of at most ``ENTRY`` words; passages are twice as long and start every
``ENTRY`` words, so an entry that a text holds lies whole in one passage. Scores are shares of
the entry's score of itself. Words are known by their bytes, which are compared once a hash has been found. A
passage whose terms' greatest impacts can't add up to the threshold in any block of entries is
passed over at once (in numpy, for all passages of a batch); the others walk the postings by
block-max WAND. What is retrieved is then verified word by word: three-word runs of the item's
question part and of its answer part (its last sentence) must both be in the text. A word edited in a
short part breaks most of its runs, so one of the parts may instead be there, in order, but for one
word changed, added or left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import merged, written

ENTRY, RUN, POSTINGS, BLOCKS = 64, 3, 16, 256
#: Words of the other part that a part of two or three words is looked for with.
BESIDE = 5
THRESHOLD, QUESTION, ANSWER = 0.55, 0.7, 0.7
#: Bytes of items that an index holds (a longer item has one of its own); more are indexed and searched in turn, so that what is in memory stays bounded.
#: How often terms occur, and how long entries are, is counted over all items, so scores don't depend on it.
MOST_BYTES = 2 << 20
K1, B = 1.2, 0.75


class Terms(NamedTuple):
    """The words of an index: their hashes in order, and their bytes."""

    hashes: np.ndarray
    filter: np.ndarray  #: by a hash's first 16 bits, whether a term has them
    data: np.ndarray
    view: np.ndarray
    at: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple["Terms", np.ndarray]:
        """The terms among a run of words, and each word's term."""
        number, h = words.numbered(data, s, e), words.hashes(data, s, e)
        one = np.unique(number, return_index=True)[1]
        one = one[np.argsort(h[one], kind="stable")]
        term = np.empty(number.max() + 1, np.int64)
        term[number[one]] = np.arange(len(one))
        seen = np.zeros(65536, bool)
        seen[(h >> np.uint64(48)).astype(np.int64)] = True
        return cls(h[one], seen, data, words.eights(data), s[one], (e - s)[one]), term[number]

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Each word's term, or -1."""
        h, out = words.hashes(data, s, e), np.full(len(s), -1, np.int64)
        todo = np.flatnonzero(self.filter[(h >> np.uint64(48)).astype(np.int64)])
        term = np.searchsorted(self.hashes, h[todo])
        while len(todo):  # words of one hash stand side by side
            ok = term < len(self.hashes)
            ok[ok] = self.hashes[term[ok]] == h[todo[ok]]
            todo, term = todo[ok], term[ok]
            size = e[todo] - s[todo]
            same = (self.size[term] == size) & words.equal(self.data, self.at[term], data, s[todo], np.minimum(size, self.size[term]), self.view)
            out[todo[same]] = term[same]
            todo, term = todo[~same], term[~same] + 1
        return out


def runs_of(term: np.ndarray, width: int) -> np.ndarray:
    """Each run of neighbouring terms as one number; a run with an unknown word (-1) is none of an item's. An index has under 2^21 terms."""
    n = max(0, len(term) - width + 1)
    out = np.zeros(n, np.int64)
    for k in range(width):
        out = out << 21 | term[k : k + n] + 1
    return out


def runs(term: np.ndarray) -> tuple[np.ndarray, int]:
    width = min(RUN, len(term))
    return np.unique(runs_of(term, width)), width


def but_for_one_word(own: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` holds the words of ``own`` side by side with at most one changed, added or left out."""
    n = len(own)
    edge = np.full(n + 1, -1, part.dtype)  # as a word that isn't in the index
    part = np.concatenate([edge, part, edge])
    same = [part == x for x in own]
    m = len(part) - n - 1
    # words that agree from each place on, and words from the end that agree before it
    begin, end = np.zeros(len(part), np.int64), np.zeros(len(part) + 1, np.int64)
    alive = np.ones(len(part), bool)
    for j in range(n):
        alive[: len(part) - j] &= same[j][j:]
        alive[len(part) - j :] = False
        begin += alive
    alive = np.ones(len(part) + 1, bool)
    for j in range(n):
        alive[j + 1 :] &= same[n - 1 - j][: len(part) - j]
        alive[: j + 1] = False
        end += alive
    if max(begin.max(), end.max()) >= n - 1:
        return True
    k = np.arange(m)
    return bool(((begin[k] + end[k + n] >= n - 1) | (begin[k] + end[k + n - 1] >= n - 1) | (begin[k] + end[k + n + 1] >= n)).any())


class Item(NamedTuple):
    item_id: int
    words: np.ndarray
    n_answer: int
    question: tuple[np.ndarray, int]  #: runs of words and how many words a run has
    answer: tuple[np.ndarray, int]
    entries: int


class Index(NamedTuple):
    items: list[Item]
    of: np.ndarray  #: each entry's item
    terms: Terms
    greatest: np.ndarray  #: each term's greatest impact
    blocks: np.ndarray  #: each term's greatest impact in each of at most BLOCKS runs of entries
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  #: entries, impacts, greatest impact a block


def edited(item: Item, part: np.ndarray) -> tuple[float, float]:
    """Shares of the words of question and answer where they are in ``part`` but for one word, else 0.

    Parts of two or three words are looked for with the words of the other part that they stand beside; of
    a part of one word nothing would be left.
    """
    k, n = len(item.words) - item.n_answer, len(item.words)
    out = []
    for size, own in ((k, item.words[: k if k > 3 else k + BESIDE]), (n - k, item.words[k if n - k > 3 else max(0, k - BESIDE) :])):
        out.append((size - 1) / size if size > 1 and len(own) > 3 and but_for_one_word(own, part) else 0.0)
    return out[0], out[1]


def n_words(text: str) -> int:
    data, off = words.buffers(pa.array([text]))
    return len(words.segments(data, off, words.WORDLIKE)[0])


def answer_words(text: str) -> int:
    """How many words the answer has: the last sentence, or the last quarter of the words where that is longer; half of all at most."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if n_words(p)]
    n = n_words(text)
    return min(max(n_words(parts[-1]) if len(parts) > 1 else 0, ceil(n / 4)), max(1, n // 2))


class Statistics(NamedTuple):
    """What scores need to know of all items, whichever of them an index holds."""

    entries: int
    words: int
    df: dict[bytes, int]  #: entries that hold a term, by its 128 bits


def entry_numbers(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words: each word's entry, counted over all texts, and how many entries each text has."""
    entries = -(-count // ENTRY)
    base = np.repeat(np.cumsum(entries) - entries, count)
    return base + (np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count)) // ENTRY, entries


def names_of(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    """128 bits of each word."""
    raw = np.column_stack([words.hashes(data, s, e, seed) for seed in (0, 1)]).tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def indexed(rows: list[tuple[int, str]], statistics: Statistics | None = None) -> Index | None:
    """An index of these items; scores follow from the statistics of all items, or of these where none are given."""
    data, off = words.buffers(pa.array([t or "" for _, t in rows], pa.large_string()))
    data = words.LOWER[data]
    s, e = words.segments(data, off, words.WORDLIKE)
    if not len(s):
        return None
    terms, term = Terms.of(data, s, e)
    if len(terms.hashes) >= 1 << 21:
        raise ValueError("an item has more words than an index can hold")
    at, items, entries, of = words.per_text(s, off), [], [], []
    for (item_id, text), lo, hi in zip(rows, at[:-1].tolist(), at[1:].tolist()):
        if lo == hi:
            continue
        own, k = term[lo:hi], answer_words(text)
        cut = [own[j : j + ENTRY] for j in range(0, len(own), ENTRY)]
        items.append(Item(item_id, own, k, runs(own[: len(own) - k] if len(own) > k else own), runs(own[len(own) - k :]), len(cut)))
        entries += cut
        of += [len(items) - 1] * len(cut)
    sizes = np.array([len(x) for x in entries], float)
    flat, entry = np.concatenate(entries), np.repeat(np.arange(len(entries)), sizes.astype(int))
    pair, many = np.unique(flat * len(entries) + entry, return_counts=True)
    each, e = pair // len(entries), pair % len(entries)
    first, df = np.unique(each, return_index=True, return_counts=True)[1:]
    all_entries, mean, all_df = len(entries), sizes.mean(), df
    if statistics:
        all_entries, mean = statistics.entries, statistics.words / statistics.entries
        all_df = np.array([statistics.df[x] for x in names_of(terms.data, terms.at, terms.at + terms.size)])
    idf = np.log(1 + (all_entries - all_df + 0.5) / (all_df + 0.5))
    impact = idf[each] * many * (K1 + 1) / (many + K1 * (1 - B + B * sizes[e] / mean))
    impact = impact / np.bincount(e, impact, len(entries))[e]
    postings = []
    for at, n in zip(first.tolist(), df.tolist()):
        p = impact[at : at + n]
        postings.append((e[at : at + n], p, np.maximum.reduceat(p, np.arange(0, n, POSTINGS))))
    n_blocks = min(BLOCKS, len(entries))
    blocks = np.zeros((len(df), n_blocks), np.float32)
    np.maximum.at(blocks, (each, e * n_blocks // len(entries)), impact)
    return Index(items, np.array(of), terms, np.array([p.max() for _, p, _ in postings]), blocks, postings)


def wand(index: Index, terms: list[int], least: float, among: tuple[int, int] | None = None) -> list[tuple[int, float]]:
    """Entries (of a range) whose score for these (distinct) terms is at least ``least``, by block-max WAND."""
    lists, done = [], 1 << 60
    for t in terms:
        entries, impacts, maxima = index.postings[t]
        lo, hi = entries.searchsorted(among) if among else (0, len(entries))
        if lo < hi:
            lists.append([entries, impacts, maxima, int(lo), float(index.greatest[t]), int(hi)])
    found = []
    here = lambda x: int(x[0][x[3]]) if x[3] < x[5] else done

    def skip(x, to):
        x[3] += int(np.searchsorted(x[0][x[3] : x[5]], to))

    while True:
        lists.sort(key=here)
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            if here(x) == done:
                break
            bound += x[4]
            if bound >= least:
                pivot = k
                break
        if pivot < 0:
            return found
        entry = here(lists[pivot])
        while pivot + 1 < len(lists) and here(lists[pivot + 1]) == entry:
            pivot += 1
        block, until = 0.0, done
        for x in lists[: pivot + 1]:  # what the blocks that hold the entry can add up to
            at = x[3] + int(np.searchsorted(x[0][x[3] : x[5]], entry))
            if at < x[5]:
                b = at // POSTINGS
                block += float(x[2][b])
                until = min(until, int(x[0][min((b + 1) * POSTINGS, len(x[0])) - 1]) + 1)
        if block < least:
            after = here(lists[pivot + 1]) if pivot + 1 < len(lists) else done
            to = max(entry + 1, min(until, after))
            for x in lists[: pivot + 1]:
                skip(x, to)
        elif here(lists[0]) == entry:
            score = 0.0
            for x in lists[: pivot + 1]:
                score += float(x[1][x[3]])
                x[3] += 1
            if score >= least:
                found.append((entry, score))
        else:
            for x in lists[:pivot]:
                if here(x) < entry:
                    skip(x, entry)


def block_bounds(index: Index, term: np.ndarray, edge: np.ndarray, most: int = 1 << 13) -> np.ndarray:
    """For each stretch (between neighbouring edges of term) the most that its terms can add to an entry of each block."""
    out = np.zeros((len(edge) - 1, index.blocks.shape[1]), np.float32)
    filled = np.flatnonzero(np.diff(edge))
    lo = 0
    while lo < len(filled):  # so many at a time that they stay in the cache
        hi = max(lo + 1, int(np.searchsorted(edge[filled], edge[filled[lo]] + most)))
        part = filled[lo:hi]
        out[part] = np.add.reduceat(index.blocks[term[edge[part[0]] : edge[part[-1] + 1]]], edge[part] - edge[part[0]], axis=0)
        lo = hi
    return out


def search(index: Index, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, float, float, float]]:
    """(text, item, passages, score, question overlap, answer overlap) of what is verified in a run of texts."""
    data = words.LOWER[data]
    s, e = words.segments(data, off, words.WORDLIKE)
    if not len(s):
        return []
    known = index.terms.find(data, s, e)
    at = words.per_text(s, off)
    at_term = np.flatnonzero(known >= 0)
    term = known[at_term]
    n = np.diff(at)
    # A passage is two neighbouring stretches of ENTRY words; in a stretch a term counts once.
    stretches = -(-n // ENTRY)
    begin = np.cumsum(stretches) - stretches
    of = np.repeat(np.arange(len(n)), n)[at_term]
    own = np.unique((begin[of] + (at_term - at[of]) // ENTRY) * len(index.postings) + term)
    bound = block_bounds(index, own % len(index.postings), np.searchsorted(own // len(index.postings), np.arange(int(stretches.sum()) + 1)))
    passages = np.maximum(1, stretches - 1) * (n > 0)
    text = np.repeat(np.arange(len(n)), passages)
    k = np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)
    lo = at[text] + k * ENTRY
    hi = np.minimum(lo + 2 * ENTRY, at[text + 1])
    k += begin[text]
    both = k + 1 < begin[text] + stretches[text]
    most = np.where(both[:, None], bound[k] + bound[k + both], bound[k]) if len(k) else np.zeros((0, 1))
    first, last = np.searchsorted(at_term, lo), np.searchsorted(at_term, hi)
    hits: dict[tuple[int, int], list] = {}
    n_entries, n_blocks = len(index.of), bound.shape[1]
    for p, block in zip(*(x.tolist() for x in np.nonzero(most >= THRESHOLD - 1e-4))):
        own = np.unique(term[first[p] : last[p]])
        for entry, score in wand(index, own.tolist(), THRESHOLD, (-(-block * n_entries // n_blocks), -(-(block + 1) * n_entries // n_blocks))):
            hits.setdefault((int(text[p]), int(index.of[entry])), []).append((score, int(lo[p]), int(hi[p])))
    out = []
    for (t, i), found in hits.items():
        item = index.items[i]
        around = (at[t], at[t + 1]) if item.entries > 1 else (max(at[t], min(x[1] for x in found) - ENTRY), min(at[t + 1], max(x[2] for x in found) + ENTRY))
        part = known[around[0] : around[1]]
        shares = [float(np.isin(x, runs_of(part, w)).mean()) for x, w in (item.question, item.answer)]
        whole = [shares[0] >= QUESTION, shares[1] >= ANSWER]
        if any(whole) and not all(whole):
            near = edited(item, part)
            whole, shares = [w or n > 0 for w, n in zip(whole, near)], [x if w else max(x, n) for x, w, n in zip(shares, whole, near)]
        if all(whole):
            out.append((t, item.item_id, len({x[1] for x in found}), max(x[0] for x in found), *shares))
    return out


def statistics_of(benchmark: DataFrame, shards: int) -> tuple[int, int, DataFrame]:
    """Entries and words of all items, and shard, term (128 bits), df for the terms of each shard: df counts the entries of all shards."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in words.slabs(b.column(1)):
                data = words.LOWER[data]
                s, e = words.segments(data, off, words.WORDLIKE)
                count = np.diff(words.per_text(s, off))
                entry, entries = entry_numbers(count)
                number = words.numbered(data, s, e)
                first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
                shard = np.repeat(b.column(0).slice(lo, hi - lo).to_numpy(), count)
                if len(s):
                    own = np.unique(number * (int(entries.sum()) + 1) + entry, return_index=True)[1]  # a term once an entry
                    key = shard[own] * (int(number.max()) + 1) + number[own]
                    _, at, many = np.unique(key, return_index=True, return_counts=True)
                    first = own[at]
                yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array(names_of(data, s[first], e[first]), pa.binary()), pa.array(many.astype(np.int64)), pa.array(np.zeros(len(first), np.int64))], names=["shard", "term", "n", "words"])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([int(entries.sum())], pa.int64()), pa.array([len(s)], pa.int64())], names=["shard", "term", "n", "words"])

    sharded = benchmark.select(shard_of(shards).alias("shard"), F.col("text").cast("string"))
    parts = written(sharded.mapInArrow(run, "shard int, term binary, n long, words long"), "item-terms")
    whole = parts.where("shard < 0").agg(F.sum("n").alias("entries"), F.sum("words").alias("words")).first()
    df = parts.where("shard >= 0").groupBy("term").agg(F.sum("n").alias("df"))
    return whole["entries"] or 0, whole["words"] or 0, written(parts.where("shard >= 0").select("shard", "term").distinct().join(merged(df), "term"), "item-statistics")


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")


def indexes(benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> list[Broadcast]:
    """Broadcast indexes over all items, each over a bounded share of them; together they score as one index of all would."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards, out = max(1, ceil(size / most_bytes)), []
    if shards > 1:
        entries, n_words_, df = statistics_of(benchmark, shards)
    for shard in range(shards):
        rows = benchmark.where(shard_of(shards) == shard).select("item_id", "text").collect()
        own = Statistics(entries, n_words_, {bytes(r["term"]): r["df"] for r in df.where(F.col("shard") == shard).collect()}) if shards > 1 else None
        index = indexed(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), own)
        if index is not None:
            out.append(spark.sparkContext.broadcast(index))
    return out


def held(shared: list[Broadcast]) -> Iterator[Index]:
    """The indexes one after the other; of several a worker has one in memory at a time."""
    for one in shared:
        yield one.value
        if len(shared) > 1:
            del one._value  # it is read again from the executor's disk


def leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, item_id, passages, score, question_overlap, answer_overlap for each text and item that it holds.

    Texts and items without words give no row; a null or repeated doc_id stands by each of its rows. The corpus is
    read once, whatever the number of items.
    """
    schema = "doc_id long, item_id long, passages long, score double, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    shared = indexes(benchmark, most_bytes)

    def run(batches):
        for b in batches:
            for index in held(shared):
                for lo, _, data, off in words.slabs(b.column(1)):
                    rows = search(index, data, off)
                    if rows:
                        t, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + x for x in t])), *(pa.array(list(x), kind) for x, kind in zip(rest, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs without the rows whose text holds an item. Batches are searched where they lie; all columns stay."""
    shared = indexes(benchmark, most_bytes)

    def run(batches):
        for b in batches:
            stays = np.ones(b.num_rows, bool)
            for index in held(shared):
                for lo, _, data, off in words.slabs(b.column(b.schema.get_field_index("text"))):
                    stays[[lo + r[0] for r in search(index, data, off)]] = False
            yield b.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
