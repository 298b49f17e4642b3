"""Token alignment, importance resampling and near copies against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from cytospark.llm import alignment, near_dedup, queries, resampling, words

from ..oracles import differ, duck

SCHEMA = "doc_id long, text string, node long, row long, pairs int, n long, score long, rank int, bucket int, label string, late boolean"


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def table_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7, "l", True) for i, t in zip(ids, texts)], SCHEMA)


ODD = [
    None, "", " ", "  ", "\n", "\n\n", " \n x", "a▁b", "▁", "x ▁ y", "<s>hi</s>", "<0x0A>", "a\x00b", "end.<|endoftext|>next", "日本語 テキスト\n改行", "é é", " x   y", "a 　 b", "😀 😀😀", "\r\nx\r\n y",
    "\ta\t b", "it's 's 'S  's", "a" * 3000, "ab " * 500, "—a— b", "\u0085 x", ". ,", "1,000.5%  x", "x  ", "x\n ", "Über ÀÉ naïve NAÏVE Été",
]


def make_texts():
    r = random.Random(3)
    alphabet = [" ", "\n", "a", "b", "é", "日", "　", "▁", "'s", "1", ".", "  ", "\t", "😀", "<0x41>", "ß"]
    mixed = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(60)]
    vocabulary = ["the", "of", "Été", "Quick,", "don't", "x1", "brown", "日本", "zebra"]
    plain = [" ".join(r.choice(vocabulary) + (str(r.randint(0, 30)) if r.random() < 0.3 else "") for _ in range(r.randint(1, 80))) for _ in range(60)]
    return ODD + mixed + plain + plain[:5] + [" ".join(plain)]


TEXTS = make_texts()


# token alignment


def aligned_by_hand(texts):
    """Each text's tokens, grouped at the byte offsets where both end."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    a, b, signs = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path), alignment.byte_level()
    a.encode_special_tokens = True
    name, rows = {i: t for t, i in a.get_vocab().items()}, []
    for t in texts:
        raw = (" " + (t or "")).encode()
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bx = [bytes(signs[c] for c in name[i]) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(bx) != raw or b"".join(by) != raw:
            rows.append(([0] * 3 + [""], collections.Counter()))
            continue
        ends = [np.cumsum([len(z) for z in side]).tolist() for side in (bx, by)]
        groups, links, last = [], collections.Counter(), 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            own = [[i for i, z in zip(ids, side) if last < z <= e] for ids, side in zip((x, y), ends)] if len(raw) < 4000 else [ids[np.searchsorted(side, last, "right") : np.searchsorted(side, e, "right")] for ids, side in zip((x, y), ends)]
            groups.append("|".join(",".join(map(str, z)) for z in own))
            links.update(itertools.product(*own))
            last = e
        rows.append(([len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()], links))
    held = collections.Counter(p for _, links in rows for p in links)
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(*r[:3], sum(k.values()), sum(m for p, m in k.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in k.items()), r[3]) for r, k in rows]


@pytest.mark.parametrize("most_hot", [alignment.MOST_HOT, 40, 0])
def test_alignment(spark, most_hot):
    """However many pairs go to every task, the others are counted by a shuffle."""
    got = sorted(alignment.align(table_of(spark, TEXTS).repartition(3), most_hot=most_hot).collect())
    assert [tuple(r)[1:] for r in got] == aligned_by_hand(TEXTS)


def test_alignment_of_repeated_and_nameless_rows(spark):
    texts = ["one two", "one two", "three", None]
    got = collections.Counter(tuple(r) for r in alignment.align(table_of(spark, texts, [1, 1, None, None])).collect())
    assert got == collections.Counter((i, *w) for i, w in zip([1, 1, None, None], aligned_by_hand(texts)))
    assert alignment.align(table_of(spark, [])).count() == 0


def test_alignment_whatever_a_worker_keeps(monkeypatch):
    """Chunks in small slabs, a cache that is full all the time, and hashes that collide."""
    monkeypatch.setattr(alignment, "MOST_CHUNKS", 60)
    texts, want = TEXTS, aligned_by_hand(TEXTS)
    real = words.hashes

    def collide(data, starts, ends, seed=0, view=None):
        return real(data, starts, ends, seed, view) % np.uint64(97)

    for weak in (False, True):
        monkeypatch.setattr(words, "hashes", collide if weak else real)
        own = alignment.Aligner(*alignment.default_paths())
        for lo, hi, data, off in words.slabs(pa.array(texts), 400):
            there = np.diff(off) > 0
            data, off = np.insert(data, off[:-1][there], 0x20), off + np.concatenate([[0], np.cumsum(there)])
            counts, digests, *_ = own.slab(data, off)
            assert [(*c, d) for c, d in zip(counts.tolist(), digests)] == [(*w[:4], w[6]) for w in want[lo:hi]]


def test_links_of_a_large_group_are_expanded_in_parts():
    r = np.random.default_rng(0)
    kind, ids, group = np.repeat([0, 1], 300), r.integers(0, 50, 600), np.zeros(600, np.int64)
    want = collections.Counter((x << 16 | y) for x in ids[:300].tolist() for y in ids[300:].tolist())
    for most in (7, 1000, 10**6):
        owner, pair, n = alignment.links(group, group, kind, ids, most)
        assert dict(zip(pair.tolist(), n.tolist())) == want and not owner.any()


# importance resampling


def resampled_by_hand(rows, target, orders=(1, 1), buckets=10_000):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def features(t):
        w = word.findall(lower(t))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for k in range(len(w) - n + 1)]

    own, wanted = [(i, *features(t)) for i, t in rows], [features(t)[1] for t in target]
    s, t = collections.Counter(x for r in own for x in r[2]), collections.Counter(x for f in wanted for x in f)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s_all + buckets) / ((s[k] + 1) * (t_all + buckets))))
    out = []
    for i, n_words, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {k: n + 1 for n, k in enumerate(map(id, drawn[: len(drawn) * 10 // 100]))}
    return collections.Counter((r[0], *r[2:], place.get(id(r))) for r in out)


@pytest.mark.parametrize("orders,buckets", [((1, 1), 10_000), ((1, 3), 70_000), ((2, 2), 50)])
def test_resampling(spark, orders, buckets):
    target = spark.createDataFrame([("the brown zebra of Été",), (None,), ("x1 don't x1",)], "text string")
    for order in (1, -1):
        got = resampling.resampled(table_of(spark, TEXTS).orderBy(F_desc(order)).repartition(3), target, orders, buckets)
        assert collections.Counter(map(tuple, got.collect())) == resampled_by_hand(list(enumerate(TEXTS)), [r[0] for r in target.collect()], orders, buckets)


def F_desc(order):
    from pyspark.sql import functions as F

    return F.col("doc_id") * order


def test_resampling_of_ties_and_nothing(spark):
    none = spark.createDataFrame([], "text string")
    text = " ".join(["word"] * 20)
    # the noise of a doc_id is its own, so rows that tie share one
    got = resampling.resampled(table_of(spark, [text] * 20, [7] * 20), none).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2] and len({r["score"] for r in got}) == 1
    rows = [(None, text)] * 10 + [(3, text)] * 10
    got = resampling.resampled(table_of(spark, [t for _, t in rows], [i for i, _ in rows]), none).collect()
    assert len([r for r in got if r["rank"]]) == 2 and [r["n_features"] for r in got] == [20] * 20
    assert resampling.resampled(table_of(spark, []), none).count() == 0


def test_resampling_sql(spark, sf):
    assert differ(queries.op12_importance_resampling(spark, sf), duck(sf), resampling.ORACLE_SQL) == ""


# near copies


def set_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def components_by_hand(rows):
    sets, root = [set_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        a, b = sets[x], sets[y]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    of = [least.get(find(k), i) for k, (i, _) in enumerate(rows)]
    return collections.Counter((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, of))


def near(spark, rows):
    return collections.Counter(map(tuple, near_dedup.near_copies(table_of(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)).collect()))


def test_near_copies_of_odd_texts(spark):
    r = random.Random(8)
    texts = TEXTS + ["one two three", "ONE two\tthree", "one two", "three"]
    for size in (40, 90, 300):  # edits at and about the threshold, chains of edits
        base = [f"w{r.randint(0, 500)}" for _ in range(size)]
        for k in range(12):
            t = list(base)
            for _ in range(k // 2):
                t[r.randrange(size)] = f"e{r.randint(0, 99)}"
            texts.append(" ".join(t))
        for _ in range(6):
            base[r.randrange(size)] = f"c{r.randint(0, 99)}"
            texts.append(" ".join(base))
    rows = list(enumerate(texts)) + [(None, texts[-1]), (None, "alone and nameless it stands here"), (3, texts[40]), (3, None)]
    assert near(spark, rows) == components_by_hand(rows)
    assert near_dedup.near_copies(table_of(spark, [])).count() == 0


def test_links_at_exactly_the_threshold(spark):
    rows = []
    for k in (1, 2, 5, 30):  # 4 k of 5 k shingles are common; one fewer isn't enough
        word = lambda n: f"k{k}n{n}"
        rows += [" ".join(map(word, range(4 * k + 3))), " ".join(map(word, range(5 * k + 3))), " ".join(map(word, range(5 * k + 3 + (k + 3) // 4 + 1)))]
    rows = list(enumerate(rows))
    want = components_by_hand(rows)
    assert near(spark, rows) == want and sum(i != c for i, _, c, _ in want) >= 4


def test_large_tight_and_loose_groups(spark, monkeypatch):
    """A group of many blocks with chains at its edge, and texts that share a passage without being near copies."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(9)
    base, passage = [f"b{k}" for k in range(120)], [f"p{k}" for k in range(60)]
    rows = []
    for k in range(150):
        t = list(base)
        t[r.randrange(120)] = f"x{k}"
        rows.append(" ".join(t))
    for k in range(80):
        rows.append(" ".join([f"y{k}_{n}" for n in range(30)] + passage + [f"z{k}_{n}" for n in range(r.randint(0, 30))]))
    chain = list(base)
    for k in range(40):  # each is near the one before
        chain[3 * k] = f"q{k}"
        rows.append(" ".join(chain))
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert near(spark, rows) == components_by_hand(rows)


def test_tensored_keys_find_what_is_near():
    """How many pairs at a similarity of 0.8 and a little more meet in no table: far fewer than one in a thousand."""
    r, missed = np.random.default_rng(4), 0
    for _ in range(300):
        own = r.integers(0, 1 << 63, (500, 2), dtype=np.uint64)
        both = np.concatenate([own[:450], own[50:]])  # 400 of 500 are common
        sets = [np.sort(x) for x in (both[:450, 0], both[450:, 0])]
        flat = np.column_stack([np.concatenate(sets)] * 2)
        keys = near_dedup.short_keys(near_dedup.minima(flat, np.array([0, 450, 900])))
        same = keys[0] == keys[1]
        missed += not (same[: near_dedup.SIDE].any() and same[near_dedup.SIDE :].any())
    assert missed == 0
