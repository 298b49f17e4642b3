"""Cross-site boilerplate: lines that many sites share, by sketches of each line's distinct sites.

A line (the first 128 bits of its trimmed text's SHA-256, so that no two lines meet) must occur ``min_sites`` times to be on as many sites, so
counts come first. The rest get a HyperLogLog sketch of their sites, merged before and after the
shuffle by aggregation. Where an estimate is too near the threshold, sites are counted exactly.
A line over it goes everywhere but at its first place, by doc_id and position. Lines' tables grow with the corpus,
however small Spark takes their digests to be, so they meet by merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged, merged_if_many, removed, spread_join, written

MIN_SITES = 8
#: A line has some sign that isn't a space; a blank one is no boilerplate.
MIN_CHARS = 1
#: log2 of a sketch's registers, and how far from the threshold an estimate decides: over six standard errors.
LG_K, MARGIN = 12, 0.1


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key (hash of the text), site, pos and line (digest) for each line of enough characters."""
    hashed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.when(F.length(F.trim(x)) >= min_chars, F.substring(F.unhex(F.sha2(F.trim(x), 256)), 1, 16)))
    # The text's hash is taken before its lines become rows, not again for each of them.
    whole = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), hashed.alias("lines"))
    return whole.select("doc_id", "key", "site", F.posexplode("lines").alias("pos", "line")).where("line is not null")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least min_sites sites, each with its first place. ``lines`` is a written table; so is the result."""
    often = written(lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line"), "often-lines")
    n_often = often.count()
    shared = written(spread_join(lines, merged_if_many(often, n_often), ["line"], ["doc_id", "pos"], "left_semi"), "shared-lines")
    spread = written(shared.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min(F.struct("doc_id", "key", "pos")).alias("first")), "site-sketches")
    far, near = F.col("sites") >= min_sites * (1 + MARGIN) + 1, F.col("sites") > min_sites * (1 - MARGIN) - 1
    close = spread.where(~far & near)
    sites = spread_join(shared, merged_if_many(close.select("line"), n_often), ["line"], ["doc_id", "pos"], "left_semi").select("line", "site").distinct()
    exact = sites.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    out = written(spread.where(far).select("line", "first").unionByName(close.join(merged_if_many(exact, n_often), "line", "left_semi").select("line", "first")), "boilerplate")
    removed(often, shared, spread)
    return out


def removals(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key and the positions of the lines that go, one row for each text that loses any."""
    lines = written(line_table(docs, min_chars), "lines")
    chosen = boilerplate(lines, min_sites)
    gone = spread_join(lines, merged_if_many(chosen, chosen.count()), ["line"], ["doc_id", "pos"]).where(~F.struct("doc_id", "key", "pos").eqNullSafe(F.col("first")))
    out = written(gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "removals")
    removed(lines, chosen)
    return out


def between(lines: Column, gone: Column) -> Column:
    """lines without those at the places ``gone`` (sorted, from 0): the stretches between them, so each line is touched once."""
    def cut(both: Column) -> Column:
        own = F.transform(F.concat(both["gone"], F.array(F.size(both["lines"]))), lambda end, k: F.struct(end.alias("end"), F.when(k == 0, -1).otherwise(F.get(both["gone"], k - 1)).alias("before")))
        return F.flatten(F.transform(own, lambda x: F.slice(both["lines"], x["before"] + 2, x["end"] - x["before"] - 1)))

    # As a variable of a function the split text is a value, not an expression to be split again for each stretch.
    return F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), cut)[0]


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the lines gone from text, and how many lines there were and went, under ``names``.

    Null text stays null (no lines); an empty text has one empty line, which never goes. A null
    source is one site. Rows alike in doc_id and text are treated alike: of a line's first place in a repeated
    row each copy stays. docs' other columns stay, but for those called as the two ``names``, which these replace.
    """
    spare = "_".join(["_", *docs.columns])
    gone = removals(docs, min_sites, min_chars).select(F.col("doc_id").alias(f"{spare}d"), F.col("key").alias(f"{spare}k"), F.col("gone").alias(f"{spare}g"))
    # What goes grows with the corpus, so texts and removals meet by shuffle at any size.
    out = docs.join(merged(gone), F.col("doc_id").eqNullSafe(F.col(f"`{spare}d`")) & (F.xxhash64("text") == F.col(f"`{spare}k`")), "left")
    lines, drop = F.split("text", "\n", -1), F.col(f"`{spare}g`")
    cut = F.when(drop.isNull(), F.col("text")).otherwise(F.array_join(between(lines, drop), "\n"))
    counts = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long")
    return out.select(*(cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in names), *(n.alias(name) for n, name in zip(counts, names)))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, site, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM d),
b AS (SELECT trim(raw) AS line, min(doc_id * 1000000 + pos) AS first FROM l WHERE length(trim(raw)) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT l.*, b.line IS NOT NULL AND l.doc_id * 1000000 + l.pos <> b.first AS gone FROM l LEFT JOIN b ON trim(l.raw) = b.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id
"""
