"""Cases that are easily got wrong: bytes that run together, texts of very many lines, files without newlines, items in shards, blank documents."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytospark.llm import chat_format, common, decontaminate, line_dedup, token_counts
from cytospark.operators import ordering


def test_role_and_text_dont_run_together(spark):
    rows = [(1, 0, "user\0x", "y"), (2, 0, "user", "x\0y"), (3, 0, "user", "x"), (3, 1, "", "y"), (4, 0, "userx", ""), (5, 0, "user", "xy"), (6, 0, "use", "rxy")]
    # a conversation that begins with what another one's hash and turn would give
    parent = chat_format.node_of(b"", b"user", b"x")
    rows += [(7, 0, parent.decode("latin-1"), "y"), (8, 0, "", parent.decode("latin-1") + "y")]
    got = {r["conv_id"]: r for r in chat_format.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    import hashlib

    for conv in {r[0] for r in rows}:
        own = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == conv)
        assert got[conv]["turns_sha256"] == hashlib.sha256(own.encode()).hexdigest()


def test_chat_leaves_no_table_but_its_result(spark):
    folder = ordering.scratch(spark, "x").removeprefix("file://").rpartition("/")[0]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [(c, k, "user", f"turn {k} of {c % 3}") for c in range(9) for k in range(3)]
    assert chat_format.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 9
    assert [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before] == ["chat-read"]


def test_stretches_between_lines(spark):
    r = np.random.default_rng(1)
    rows = [([f"l{k}" for k in range(n)], sorted(r.choice(n, m, replace=False).tolist())) for n, m in ((1, 0), (1, 1), (5, 2), (9, 9), (40, 13), (7, 0))]
    df = spark.createDataFrame(rows, "lines array<string>, gone array<int>")
    for lines, gone, left in df.select("lines", "gone", line_dedup.between(F.col("lines"), F.col("gone"))).collect():
        assert left == [x for k, x in enumerate(lines) if k not in gone]


def test_removed_lines_are_linear(spark):
    """Nine sites with texts of 100,000 removed lines: twice the lines aren't four times the work."""

    def took(n):
        text = "\n".join(f"boilerplate {k}" for k in range(n)) + "\nown line "
        df = common.written(spark.createDataFrame([(k, text + str(k), f"s{k}") for k in range(9)], "doc_id long, text string, source string"), "many-lines")
        began = time.time()
        got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(df).collect()}
        assert all(got[k]["n_removed"] == n and got[k]["text"] == f"own line {k}" for k in range(1, 9)) and got[0]["n_removed"] == 0
        return time.time() - began

    took(1000)
    assert took(100_000) < 60


def test_flat_file_without_a_newline(spark, tmp_path):
    """One repeated id for 200 MB, with two separators in it: what a task reads at once is a block."""
    n, ends = 100_000_000, (3, 77_777_777)
    with open(tmp_path / "flat.bin", "wb") as f:
        block = np.full(1 << 20, 7, "<u2")
        for lo in range(0, n, 1 << 20):
            own = block[: min(1 << 20, n - lo)].copy()
            for e in ends:
                if lo <= e < lo + len(own):
                    own[e - lo] = token_counts.END
            f.write(own.tobytes())
    got = sorted(token_counts.scan(spark, str(tmp_path)).collect())
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in got] == [(0, 3, True), (4, ends[1] - 4, True), (ends[1] + 1, n - ends[1] - 1, False)]


@pytest.mark.parametrize("most_bytes", [500, 5000])
def test_scores_dont_depend_on_shards(spark, sf, most_bytes):
    """Items in many indexes give the rows and scores of one index."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["passages"], round(r["score"], 9), round(r["question_overlap"], 9), round(r["answer_overlap"], 9)) for r in df.collect())
    want = key(decontaminate.leaks(docs, bench))
    assert key(decontaminate.leaks(docs, bench, most_bytes)) == want and want
    assert len(decontaminate.indexes(bench, most_bytes)) > 1
    gone = {r[0] for r in want}
    assert {r["doc_id"] for r in decontaminate.keep(docs, bench, most_bytes).collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - gone


def test_pipeline_drops_documents_of_blank_lines(spark, tmp_path):
    import corpus_pipeline

    line = "This boilerplate line is on every site there is"
    rows = [(k, f"\n{line}\n \t\n\n", f"s{k}", "en", 60) for k in range(20)] + [(50, f"{line}\nown text", "s50", "en", 60), (51, "\n\n", "s51", "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert set(got) == {0, 50, 51} and got[50] == "own text"
