"""Quality rules: text statistics, and an ordered list of learned threshold rules over them.

Statistics come from the byte buffers of whole texts. The list is learned by sequential covering:
a rule grows by the threshold with the best information gain on two thirds of the labelled rows,
is pruned on the rest, and is kept while it stays precise there; what it covers is then set aside.
The list becomes one ordered ``CASE WHEN`` over the statistics' columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words

#: Labelled rows that the learner takes at most, those first by a hash of doc_id.
MOST_LABELLED = 20_000
#: Words of the windows whose repeats count.
WINDOW = 8

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_top_word"]
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTERS = words.WORDLIKE & ~((np.arange(256) >= 48) & (np.arange(256) <= 57))
_MARKS = np.isin(np.arange(256), list(b"!?"))

#: What rules look at: a name and its expression, where @ stands before a statistic's column.
FEATURES = {
    "n_words": "double(@n_words)",
    "mean_word": "@word_chars / greatest(@n_words, 1)",
    "symbol_share": "@n_symbols / greatest(@n_words, 1)",
    "repeat_share": "@n_repeat_words / greatest(@n_words, 1)",
    "dup_line_share": "@n_dup_lines / greatest(@n_lines, 1)",
    "upper_share": "@n_upper / greatest(@n_letters, 1)",
    "mark_share": "@n_marks / greatest(@n_words, 1)",
    "distinct_share": "@n_distinct / greatest(@n_words, 1)",
    "top_word_share": "@n_top_word / greatest(@n_words, 1)",
    "line_words": "@n_words / greatest(@n_lines, 1)",
}
BASE_FAILED = "@n_words < 20 or 100 * @n_repeat_words > 30 * @n_words"


def counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The statistics of a run of texts, in the order of ``_COUNTS``."""
    n = len(off) - 1
    if not len(data):
        return [np.zeros(n, np.int64) for _ in _COUNTS]
    where = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data])])[off])
    cp, view = words.code_points(data), words.eights(data)
    s, e = words.segments(data, off, words.NOT_SPACE)
    at = words.per_text(s, off)
    n_words = np.diff(at)
    text = np.repeat(np.arange(n), n_words)
    chars = np.bincount(text, cp[e] - cp[s], n).astype(np.int64)
    word = words.numbered(data, s, e, words.hashes(data, s, e, view=view))
    own, each = np.unique(text * (len(word) + 1) + word, return_counts=True, return_index=True)[1:]
    distinct = np.bincount(text[own], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, text[own], each)
    ls, le = words.segments(data, off, words.NOT_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(words.NOT_SPACE[data])])
    worded = filled[le] > filled[ls]
    ls, le = ls[worded], le[worded]
    lines = np.diff(words.per_text(ls, off))
    of = np.repeat(np.arange(n), lines)
    line = words.numbered(data, ls, le, words.hashes(data, ls, le, view=view))
    first = np.unique(of * (len(line) + 1) + line, return_index=True)[1]
    dup = lines - np.bincount(of[first], minlength=n)
    cover = np.zeros(len(word) + 1, np.int64)
    k = repeated(word, text)
    np.add.at(cover, k, 1)
    np.add.at(cover, k + WINDOW, -1)
    repeat = np.bincount(text, np.cumsum(cover[:-1]) > 0, n).astype(np.int64) if len(word) else np.zeros(n, np.int64)
    return [n_words, chars, where(_SYMBOLS), dup, repeat, lines, where(_UPPER), where(_LETTERS), where(_MARKS), distinct, top]


def repeated(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where windows of WINDOW word numbers start that their text has more than once; equal hashes are compared word by word."""
    k = np.flatnonzero(text[: 1 - WINDOW] == text[WINDOW - 1 :])
    h = words.mix(words.windows(word.astype(np.uint64), WINDOW)[k] + words.mix(text[k].astype(np.uint64)))
    _, first, back, many = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    k, one = k[many[back] > 1], k[first[back]][many[back] > 1]
    same = text[k] == text[one]
    for j in range(WINDOW):
        same &= word[k + j] == word[one + j]
    if same.all():
        return k
    rows = np.column_stack([text[k], *(word[k + j] for j in range(WINDOW))])
    _, back, many = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    return k[many[back.ravel()] > 1]


def measured(docs: DataFrame, column: str) -> DataFrame:
    """docs with a struct of the statistics of text; all columns stay. Null text has no words, repeated rows each have a row."""
    fields = StructType([StructField(c, LongType()) for c in _COUNTS])
    schema = StructType([*docs.schema.fields, StructField(column, fields)])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            for lo, hi, data, off in words.slabs(b.column(at)):
                own = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in counts(data, off)], _COUNTS)
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, own], names=schema.names)

    return docs.mapInArrow(run, schema)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and a column for each of ``_COUNTS``."""
    return measured(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "stats").select("doc_id", "stats.*")


Rule = list[tuple[str, bool, float]]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, above, t in rule:
        out &= x[name] >= t if above else x[name] <= t
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 12, most_terms: int = 4, cuts: int = 48, seed: int = 7) -> list[Rule]:
    """Rules for the bad rows, by sequential covering."""
    rules: list[Rule] = []
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    thresholds = {}
    for name, v in x.items():
        both = np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)), np.quantile(v[bad], np.linspace(0, 1, cuts))]) if bad.any() else np.zeros(0)
        thresholds[name] = np.unique(both)
    while len(rules) < most_rules and (left & bad).sum() >= least:
        rule: Rule = []
        now = left & grow
        for _ in range(most_terms):
            p0, n0 = (now & bad).sum(), (now & ~bad).sum()
            if not n0 or p0 < least:
                break
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
            for name, v in x.items():
                t = thresholds[name]
                ups = len(t) - np.searchsorted(t, v[now & bad], side="right"), len(t) - np.searchsorted(t, v[now & ~bad], side="right")
                for above in (True, False):
                    if above:  # rows at or over each threshold
                        p, m = (np.bincount(len(t) - u, minlength=len(t) + 1)[::-1].cumsum()[::-1][1:] for u in ups)
                    else:
                        p, m = (np.bincount(np.searchsorted(t, v[now & y], side="left"), minlength=len(t) + 1).cumsum()[:-1] for y in (bad, ~bad))
                    gain = np.where(p >= least, p * (np.log2(np.maximum(p, 1) / np.maximum(p + m, 1)) - base), 0)
                    k = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), (name, above, float(t[k])))
            if best[1] is None:
                break
            rule.append(best[1])
            now = now & covered(rule[-1:], x)
        test = left & ~grow

        def worth(r: Rule) -> float:
            c = covered(r, x) & test
            p, m = (c & bad).sum(), (c & ~bad).sum()
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule = rule[:-1]
        c = covered(rule, x) & left if rule else np.zeros(len(bad), bool)
        if (c & bad).sum() < least or (c & bad).sum() < precision * c.sum() or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~c
    return rules


def expression(rules: list[Rule], of: str = "") -> Column:
    """The number of the first rule that holds, from 1; 0 if none does. ``of``: the struct that the statistics stand in."""
    at, out = f"`{of}`." if of else "", None
    for k, rule in enumerate(rules, 1):
        test = " and ".join(f"({FEATURES[name]}) {'>=' if above else '<='} {t!r}D" for name, above, t in rule).replace("@", at)
        out = F.when(F.expr(test), F.lit(k)) if out is None else out.when(F.expr(test), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(of: str = "") -> Column:
    return F.expr(BASE_FAILED.replace("@", f"`{of}`." if of else ""))


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[Rule]:
    """Rules from texts with a label; labels (doc_id, quality), where 0 is bad. Without labels, no rules.

    The labels are cut by a share of their ids' hash to about ``most`` rows, which bounds what is broadcast and
    what the driver takes; only texts under these labels are measured. A doc_id with two labels has the lesser.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("label"))
    place = F.pmod(F.xxhash64("label_id"), F.lit(1 << 40))
    marked = marked.where(place < int(min(1, 1.2 * most / max(1, labels.count())) * (1 << 40)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(marked), F.col("doc_id") == F.col("label_id"))
    rows = measured(texts, "stats").select("label_id", "label", *(F.expr(e.replace("@", "stats.")).cast("double").alias(n) for n, e in FEATURES.items()))
    got = rows.orderBy(place, "label_id", *FEATURES).limit(most).toPandas()
    if not len(got):
        return []
    return learn({n: got[n].to_numpy() for n in FEATURES}, (got["label"] == 0).to_numpy())


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed, the number of the rule that rejects a row, and kept."""
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", expression(fitted(docs, labels)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are rejected; all of docs' columns stay, whatever their names.

    The verdict is an expression over a row's own statistics, so texts aren't shuffled: each batch
    is measured where it lies.
    """
    spare = "_".join(["stats", *docs.columns])
    return measured(docs, spare).where(~base_failed(spare) & (expression(fitted(docs, labels), spare) == 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
