"""Nearest vectors and cosines of pairs by blocks against numpy, and the recall of the stored index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import candidates
from siltstone.operators import retrieval as V

SHAPE = "chunk_id long, embedding array<float>"


def made(n=300, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[7] = x[3]
    x[9] = 0
    return x


def frames(spark, x):
    chunks = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (None, [1.0] * x.shape[1])], SHAPE)
    return chunks.where("chunk_id % 5 = 0 OR chunk_id = 900").withColumnRenamed("chunk_id", "query_id"), chunks


def cosines(x):
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    return unit @ unit.T


@pytest.mark.parametrize("few", [True, False])
def test_nearest_by_packs(spark, monkeypatch, few):
    monkeypatch.setattr(V, "PACK", 16)
    monkeypatch.setattr(V, "PRODUCT", 5)
    if not few:
        monkeypatch.setattr(V, "BROADCAST_PACKS", 0)
    x = made()
    queries, chunks = frames(spark, x)
    found = {}
    for r in V.nearest(queries, chunks.repartition(5), 4).collect():
        found.setdefault(r["query_id"], []).append((-round(r["cosine"], 9), r["chunk_id"]))
    all_pairs = np.round(cosines(x), 9)
    assert {q: sorted(v) for q, v in found.items()} == {q: sorted((-all_pairs[q, c], c) for c in range(len(x)))[:4] for q in range(0, len(x), 5)}


def test_plans_do_not_grow_with_the_questions(spark):
    queries, chunks = frames(spark, made())
    plan = lambda q: V.nearest(q, chunks, 3)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    more = queries.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(200)))).select((F.col("n") * 1000 + F.col("query_id")).alias("query_id"), "embedding")
    one = queries.select("query_id", "embedding")
    assert abs(plan(more) - plan(one)) <= 4
    assert V.nearest(queries.limit(0), chunks, 3).count() == 0


def test_cosines_of_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "PAIR_BLOCK", 16)
    monkeypatch.setattr(V, "CHUNK_BLOCK", 16)
    x = made(90)
    queries, chunks = frames(spark, x)
    pairs = spark.createDataFrame([(q, c, f"{q}-{c}") for q in (0, 5, 9, 10, 85, 900, 901) for c in (3, 7, 9, 80, 900, 1000)] + [(None, 3, "n"), (5, None, "m")], "query_id long, chunk_id long, cosines string")
    found = {r["cosines"]: r["cosine"] for r in V.pair_cosines(pairs, queries, chunks).collect()}
    full = cosines(x)
    assert len(found) == 44
    for name, value in found.items():
        q, c = (int(i) if i.isdigit() else None for i in (name.split("-") + ["x"])[:2])
        assert abs(value - (full[q, c] if q is not None and c is not None and q % 5 == 0 and q < 90 and c < 90 else 0.0)) < 1e-9


def test_index_holds_every_row_and_finds_most_of_the_nearest(spark, data, tmp_path):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = vectors.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    index = candidates.VectorIndex(spark, str(tmp_path))
    index.build(vectors, sample=256, part_rows=64)
    assert index.log.read()["rows"] == vectors.where("embedding IS NOT NULL").count()
    exact = V.nearest(queries, vectors, 30)
    shares = candidates.recall(index.search(queries, 30, probes=16), exact).agg(F.avg("recall"), F.min("n")).first()
    assert shares[0] >= 0.9 and shares[1] == 30, shares
    all_cells = {(r["query_id"], r["chunk_id"], round(r["cosine"], 6)) for r in index.search(queries, 30, probes=10**6, refine=10**4).collect()}
    assert all_cells == {(r["query_id"], r["chunk_id"], round(r["cosine"], 6)) for r in exact.collect()}


def test_one_cell_with_most_rows_is_several_parts(spark, tmp_path):
    x = np.concatenate([np.tile(made(20, 8)[0], (400, 1)), made(60, 8, 3)])
    queries, chunks = frames(spark, x)
    index = candidates.VectorIndex(spark, str(tmp_path))
    index.build(chunks, cells=6, part_rows=50)
    assert max(index.log.read()["parts"]) >= 8
    found = index.search(queries.where("query_id < 20"), 5, probes=6).collect()
    assert {r["chunk_id"] for r in found if r["query_id"] == 0} == {0, 1, 2, 3, 4} and len(found) == 20
