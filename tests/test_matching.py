"""Pairs of questions and chunks that are summed where chunks are read, against sums in Python and against rows that are joined."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import lexical, matching
from siltstone.operators import retrieval as V


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    said = lambda most: " ".join(rng.choices(["a", "b", "ab", "c", "né", "zz", "9"], k=rng.randrange(most)))
    texts = [(i, said(12)) for i in range(120)] + [(200, None), (201, ""), (202, "zz zz, zz"), (None, "a b")]
    asked = [(i, said(6)) for i in range(9)] + [(9, "a b c"), (10, None), (11, "nothing")]
    x = np.random.default_rng(3).normal(size=(100, 4)).astype(np.float32)
    x[4] = 0
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (110, None), (None, x[0].tolist())]
    return spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(vectors, "chunk_id long, embedding array<float>"), x


def terms_of(asked):
    return lexical.similarity_terms(asked, text.tokens("text"), "query_id")


def expected(texts, asked):
    """tksim of each (query_id, chunk_id) with a common term."""
    weights = {}
    for r in terms_of(asked).collect():
        weights.setdefault(r["key"], {})[r["term"]] = r["weight"]
    out = {}
    for r in texts.collect():
        words = re.findall(r"\w+", (r["text"] or "").lower())
        own = {*words, *(a + b for a, b in zip(words, words[1:]))}
        for q, w in weights.items():
            if own & w.keys():
                out[q, r["chunk_id"]] = (sum(v for t, v in w.items() if t in own) + 1e-9) / (sum(w.values()) + 1e-9)
    return out


@pytest.mark.parametrize("few", [1 << 20, 30, 1])
def test_similar_texts(spark, tables, monkeypatch, few):
    texts, asked, *_ = tables
    monkeypatch.setattr(matching, "SUMMED", few)
    monkeypatch.setattr(matching, "PACK_TEXTS", 7 if few == 30 else 1024)
    df = lexical.text_similarity(terms_of(asked), texts, text.tokens("text"), "chunk_id")
    want = expected(texts, asked)
    got = {(r["query_id"], r["chunk_id"]): r["tksim"] for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert df.schema["query_id"].dataType.simpleString() == "int" and len(want) > 500
    # No token is a row of its own, and no pair is shuffled.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_hybrid_sums(spark, tables, monkeypatch):
    texts, asked, vectors, x = tables
    queries = vectors.select(F.col("chunk_id").cast("int").alias("query_id"), "embedding").where("query_id IN (0, 1, 2, 3, 4, 5, 110)")
    run = lambda: V.hybrid_sums(terms_of(asked), texts, text.tokens("text"), "chunk_id", queries, vectors, 0.3)
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    want = {}
    for (q, chunk), sim in expected(texts, asked).items():
        want.setdefault(q, []).append((unit[q] @ unit[chunk] if q < 6 and chunk is not None and chunk < 100 else 0.0, sim))
    # Question 4 has a vector of zeros and questions from 6 on have none, so they keep the token similarity.
    want = {q: (len(v), sum(0.3 * c + 0.7 * s if any(c for c, _ in v) else s for c, s in v)) for q, v in want.items()}
    df = run()
    for found in (df, monkeypatch.setattr(lexical, "BROADCAST_TOKENS", 1) or run()):
        got = {r["query_id"]: (r["n"], r["s"]) for r in found.collect()}
        assert got.keys() == want.keys() and all(got[q][0] == n and abs(got[q][1] - s) < 1e-9 for q, (n, s) in want.items())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CoGroup" not in plan and "hashpartitioning(_b" not in plan
    none = V.hybrid_sums(terms_of(asked), texts, text.tokens("text"), "chunk_id", queries.limit(0), vectors.limit(0), 0.3)
    assert none.count() == len(want)


def test_only_rows_that_may_be_in_the_window_are_ranked(spark, tables, monkeypatch):
    texts, asked, *_ = tables
    monkeypatch.setattr(matching, "PACK_TEXTS", 40)
    scored = lambda most: lexical.text_similarity(terms_of(asked), texts.where("chunk_id IS NOT NULL").coalesce(1), text.tokens("text"), "chunk_id", most).withColumn("score", F.round("tksim", 6))
    assert [V.window_end(p, 10) for p in (1, 7, 8)] == [70, 70, 140] and V.window_end(31, 1) == 60
    best = lambda df: {tuple(r) for r in lexical.top(df, 5).select("query_id", "chunk_id", "rank", "score").collect()}
    assert best(scored(5)) == best(scored(0))
    assert scored(5).count() < scored(0).count() / 2


@pytest.mark.parametrize("few", [1 << 20, 30])
def test_scores_of_packs_equal_scores_of_rows(spark, tables, monkeypatch, few):
    texts, asked, *_ = tables
    monkeypatch.setattr(matching, "SUMMED", few)
    monkeypatch.setattr(matching, "PACK_TEXTS", 1024 if few > 30 else 7)
    chunks = texts.where("chunk_id IS NOT NULL").withColumn("title", F.when(F.col("chunk_id") % 5 != 0, F.concat(F.lit("a t"), F.col("chunk_id") % 3)))
    # A text that is null has no tokens, here as a null array: field and chunk then don't count.
    fields = {"body": F.when(F.col("text").isNotNull(), text.tokens("text")), "title": F.when(F.col("title").isNotNull(), F.split("title", " "))}
    terms = asked.select("query_id", F.explode(F.array_distinct(F.concat(text.tokens("text"), F.array(F.lit("t1"), F.lit(None))))).alias("token")).withColumn("weight", 1.0 + F.col("query_id") / 7)
    df = lexical.match_scores(chunks, fields, terms, {"title": 3.0})
    by_pair = lambda df: {(r["query_id"], r["chunk_id"]): (round(r["score"], 9), r["n_matched"]) for r in df.collect()}
    want = by_pair(lexical.joined_scores(chunks, fields, terms, {"title": 3.0}))
    assert by_pair(df) == want and len(want) > 500
    assert df.dtypes == [("query_id", "int"), ("chunk_id", "bigint"), ("score", "double"), ("n_matched", "int")]
    # Neither tokens nor addends are rows: nothing is dealt by chunk or by pair.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(chunk_id" not in plan and "hashpartitioning(query_id" not in plan
    assert lexical.match_scores(chunks, fields, terms.limit(0)).count() == 0 and lexical.match_scores(chunks.limit(0), fields, terms).count() == 0
