"""Chunking and vector search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrawl.fixed_values import CHARS_PER_TOKEN, WHITESPACE
from papertrawl.functions.registry import register
from papertrawl.operators import chunks as K
from papertrawl.operators import search as S
from papertrawl.operators.ranking import number_rows


def step_by_step(text, tokens, overlap):
    size, back = tokens * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    at, found = 0, []
    while window := text[at:at + size]:
        head, gap, _ = window.rpartition(" ")
        length = len(head) if gap and len(head) > back and at + size < len(text) else size
        found.append(text[at:at + length].strip(WHITESPACE))
        at += length - back
    return list(enumerate(p for p in found if p))


def test_sql_reads_the_same_chunks(spark):
    register(spark)
    texts = [None, "", "short", "  ", "word " * 900, "a " + "y" * 400 + " b \u2003", "\u00a0 x\u3000"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT doc_id, c.* FROM some_texts, LATERAL chunk_text(text, 20, 5) c")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Generate" in plan
    want = [(i, n, p) for i, t in enumerate(texts) for n, p in step_by_step(t or "", 20, 5)]
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in rows.collect()) == sorted(want)
    found = spark.sql("""SELECT e.* FROM (SELECT '<div id=a class="x y">one <b>two</b></div>' AS html) p, LATERAL html_elements(p.html) e""").collect()
    assert [(r.el_idx, r.parent, r.tag, r.id, r["class"], r.text) for r in found] == [(1, 0, "div", "a", "x y", "one two"), (2, 1, "b", None, None, "two")]


def test_chunks_equal_the_step_by_step_reading(spark):
    rng = random.Random(7)
    texts = ["", "short", "word " * 3000, "x" * 5000, "a " + "y" * 4000 + " b " + "z" * 300, "é" * 10 + " " + "日本 " * 2000]
    texts += ["".join(rng.choice("abc  é") for _ in range(rng.randrange(0, 3000))) for _ in range(30)]
    texts += [" ".join("w" * rng.randrange(1, 400) for _ in range(20)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for tokens, overlap in ((512, 128), (64, 16), (20, 19), (10, 0)):
        got = {}
        for r in K.chunk_documents(df, tokens=tokens, overlap=overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"]))
        for i, text in enumerate(texts):
            assert got.get(i, []) == step_by_step(text, tokens, overlap), (i, tokens, overlap)


def test_chunks_cover_the_text(spark):
    text = " ".join(f"word{i}" for i in range(5000))
    parts = K.chunk_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"), tokens=64, overlap=16)
    words = {w for r in parts.collect() for w in r["text"].split()}
    assert {f"word{i}" for i in range(5000)} <= words


def _brute(queries, vectors, k, allowed=None):
    out = []
    for qid, q in queries:
        scored = []
        for cid, doc, v in vectors:
            if v is None or (allowed is not None and (qid, doc) not in allowed):
                continue
            length = np.linalg.norm(q) * np.linalg.norm(v)
            if length > 0:
                scored.append((-round(float(np.dot(q, v) / length), 9), cid))
        out += [(qid, place + 1, cid) for place, (_, cid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 64])
def test_topk_is_exact(spark, slice_bytes):
    rng = np.random.default_rng(3)
    vectors = [(i, int(i % 3), [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    vectors[5] = (5, 2, [0.0] * 6)
    vectors[6] = (6, 0, None)
    queries = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(7)]
    chunk_df = spark.createDataFrame(vectors, "chunk_id bigint, document_id bigint, embedding array<float>")
    query_df = spark.createDataFrame(queries, "qid bigint, vector array<double>")
    # equal vectors tie exactly only after rounding, so compare the similarity sequence and the members
    got = S.vector_topk(query_df, chunk_df, 5, slice_bytes=slice_bytes).collect()
    by_id = {c: v for c, _, v in vectors}
    for qid, q in queries:
        mine = sorted((r for r in got if r["qid"] == qid), key=lambda r: r["place"])
        want = [c for n, _, c in _brute([(qid, q)], vectors, 5)]
        sims = [round(float(np.dot(q, by_id[c]) / np.linalg.norm(q) / np.linalg.norm(by_id[c])), 9) for c in want]
        assert [round(r["similarity"], 9) for r in mine] == sims


def test_filtered_topk(spark):
    vectors = [(1, 10, [1.0, 0.0]), (2, 11, [1.0, 0.1]), (3, 12, [0.0, 1.0]), (4, 10, [0.6, 0.8])]
    chunk_df = spark.createDataFrame(vectors, "chunk_id bigint, document_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "qid bigint, vector array<double>")
    allowed = spark.createDataFrame([(1, 10), (1, 12), (2, 11)], "qid bigint, document_id bigint")
    got = sorted((r["qid"], r["place"], r["chunk_id"]) for r in S.filtered_topk(queries, chunk_df, allowed).collect())
    assert got == [(1, 1, 1), (1, 2, 4)]


def test_prompts(spark):
    questions = spark.createDataFrame([(1, "How much?"), (2, "Who?")], "qid bigint, question string")
    sources = spark.createDataFrame([(1, 2, "b.pdf", "two"), (1, 1, "a.pdf", "one")], "qid bigint, place int, filename string, chunk_text string")
    first, second = [r["prompt"] for r in S.build_prompts(questions, sources).orderBy("qid").collect()]
    assert "[Source 1 — a.pdf]\none\n\n[Source 2 — b.pdf]\ntwo" in first and first.endswith("USER QUESTION: How much?\n\nANSWER:")
    assert "DOCUMENT CONTEXT" not in second and second.endswith("QUESTION: Who?\n\nANSWER:")


def test_zero_vector_for_blank_text(spark):
    rows = K.hashed_embedding(spark.createDataFrame([(1, ""), (2, "pay pay now")], "i int, text string"), dims=32).orderBy("i").collect()
    assert sum(rows[0]["embedding"]) == 0 and abs(sum(x * x for x in rows[1]["embedding"]) - 1) < 1e-6


def test_numbering_with_one_key_holding_most_rows(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7 + 1).alias("k"), (F.col("id") * 7919 % 5003).alias("o")
    )
    rows = number_rows(df, ["k"], ["o"], "n", ranges=6).collect()
    assert len(rows) == 5000
    by_key = {}
    for r in rows:
        by_key.setdefault(r["k"], []).append((r["n"], r["o"]))
    for got in by_key.values():
        got.sort()
        assert [n for n, _ in got] == list(range(1, len(got) + 1))
        assert [o for _, o in got] == sorted(o for _, o in got)
