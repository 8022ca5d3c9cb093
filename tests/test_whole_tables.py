"""Queries whose job is larger on large tables than on the small ones, against brute force."""

import random

import numpy as np
import pytest

import __spark_entry__
from siltstone import plans
from siltstone.operators import retrieval
from siltstone.plans.registry import Tables

N_QUESTIONS, N_VECTORS = 50, 560


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(3).normal(size=(N_VECTORS, 6)).round(3)


@pytest.fixture(scope="module")
def wide(spark, vectors, tmp_path_factory):
    """A folder of tables with more than 40 questions and more than 500 vectors; two chunks have none."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    d = tmp_path_factory.mktemp("wide")
    put = lambda name, rows, shape: spark.createDataFrame(rows, shape).write.parquet(f"{d}/{name}.parquet")
    put("embeddings", [(i, v.tolist(), i % 7) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    put("benchmark", [(i, say(5)) for i in range(N_QUESTIONS)], "item_id long, text string")
    put("documents", [(i, say(12), "en", f"src{i % 3}", 40) for i in range(N_VECTORS + 2)], "doc_id long, text string, lang string, source string, n_chars long")
    return str(d)


@pytest.fixture(scope="module")
def cosines(vectors):
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def run(spark, name, d):
    return __spark_entry__.queries()[name](spark, d)


def test_all_questions_are_searched(spark, wide, cosines):
    got = {(r["query_id"], r["chunk_id"]): r["cosine"] for r in run(spark, "v02_vector_top_k", wide).collect()}
    want = {(q, int(k)): cosines[q, k] for q in range(N_QUESTIONS) for k in np.lexsort((np.arange(N_VECTORS), -cosines[q].round(9)))[:30]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
    assert run(spark, "d06_summary", wide).first()["questions"] == N_QUESTIONS


def test_all_pairs_have_their_cosine(spark, wide, cosines):
    t = Tables(spark, wide)
    got = {(r["query_id"], r["chunk_id"]): (r["cosine"], r["sim"], r["tksim"]) for r in plans.retrieval.reranked(t).collect()}
    assert len(got) > 0.8 * N_QUESTIONS * N_VECTORS
    for (q, d), (cosine, sim, tokens) in got.items():
        want = cosines[q, d] if d < N_VECTORS else 0.0
        assert abs(cosine - want) < 1e-9 and abs(sim - (0.3 * want + 0.7 * tokens)) < 1e-9


def longest(toc, sections):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(sections) + 1)
    for t in toc:
        new = [0]
        for j, s in enumerate(sections):
            new.append(row[j] + 1 if t == s else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_contents_of_long_texts_are_aligned(spark, tmp_path):
    rng = random.Random(2)
    texts = [[f"line {rng.randrange(m):03}" for _ in range(n)] for n, m in ((150, 900), (120, 20), (60, 900), (3, 2))] + [[f"line {i:03}" for i in range(130)]]
    spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in run(spark, "c28_toc_alignment", str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["entry"], r["section"]))
    for i, lines in enumerate(texts):
        path, toc = sorted(got[i]), sorted(lines)
        assert all(toc[a] == lines[b] for a, b in path) and all(a < c and b < d for (a, b), (c, d) in zip(path, path[1:]))
        assert len(path) == longest(toc, lines)
    assert len(got[4]) == 130


def test_whole_task_list_is_ordered(spark, tmp_path):
    rows = [(k, n) for k in (1, 150, 199, 200, 201, 5000) for n in (1, 2, 3)]
    spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in run(spark, "r9_task_order", str(tmp_path)).collect()] == sorted(rows, key=lambda r: (r[0], -r[1]))


def test_every_sentence_is_cited(spark, wide, cosines):
    sim, want = cosines.round(6), set()
    for answer in range(N_VECTORS // 10):
        own = range(10 * answer, 10 * answer + 10)
        others = [d for d in range(N_VECTORS) if d not in own]
        best = {s: 0.99 * max(sim[s, d] for d in others) for s in own}
        level = next((x for x in retrieval.CITATION_LEVELS if max(best.values()) >= x), np.inf)
        seen = set()
        for s in own:
            cited = sorted((d for d in others if sim[s, d] > best[s] >= level), key=lambda d: (-sim[s, d], d))[:4]
            want |= {(answer, s, d) for d in cited if d not in seen}
            seen |= set(cited)
    got = {(r["answer_id"], r["sentence"], r["chunk"]) for r in run(spark, "v35_citations", wide).collect()}
    assert got == want and len({a for a, _, _ in got}) == N_VECTORS // 10
