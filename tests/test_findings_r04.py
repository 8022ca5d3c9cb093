"""What the findings of the fourth round named: one test for each that was right."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_inverted import BOOSTS, asked, chunk, everything, fields, frame, searched

import __spark_entry__
from siltstone.operators import inverted
from siltstone.operators import lexical as L


def both(spark, name, documents, folder):
    """Sorted rows of a query, and of its SQL, on these documents."""
    documents.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    df = __spark_entry__.queries()[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(found, key=str)


def test_a_text_without_sentences_has_no_longest(spark, tmp_path):
    texts = [None, "", "\n", "a", "one; two", "。。x", "end\n"]
    got, want = both(spark, "c25_sentences", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path)
    assert got == want == [(0, None, None), (1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 4), (5, 3, 1), (6, 1, 4)]


def test_a_plan_lists_all_parts_of_a_large_language(spark, tmp_path):
    lang = F.when(F.col("id") < 100_001, "en").when(F.col("id") < 100_101, "fr")
    got, want = both(spark, "w03_shard_plan", spark.range(100_102).select(F.col("id").alias("doc_id"), lang.alias("lang")), tmp_path)
    parts = [("en", 100_001, p, 100) for p in range(1, 1001)] + [("en", 100_001, 1001, 1), ("fr", 100, 1, 100), (None, 1, 1, 1)]
    assert got == want == sorted(parts, key=str)


def test_questions_and_chunks_meet_where_the_lists_of_a_segment_do(spark, tmp_path, monkeypatch):
    """Many small segments, changed chunks and few broadcast terms: as scoring everything, and no pair is shuffled."""
    monkeypatch.setattr(inverted, "LISTED_TOKENS", 300)
    rng = random.Random(7)
    rows = {i: chunk(rng, i) for i in range(120)}
    index = inverted.InvertedIndex(spark, str(tmp_path), ["body", "title"], buckets=3)
    index.add(frame(spark, [*rows.values(), *[chunk(rng, i) for i in range(200, 260)], (5, *rows[5][1:])]), fields())
    new = {i: chunk(rng, i) for i in range(0, 120, 9)} | {500: (500, None, "t1"), 501: (501, "w0 é中 " * 300, None)}
    index.add(frame(spark, list(new.values())), fields())
    index.withdraw(spark.range(200, 400).select(F.col("id").alias("chunk_id")))
    rows |= new
    terms = asked(spark, rng, 6).unionByName(spark.createDataFrame([(7, "é中", 1.5), (7, "t3", 1.0), (7, None, 1.0)], "query_id int, token string, weight double"))
    known = terms.where("token IS NOT NULL")
    for fold in (False, True):
        if fold:
            index.fold()
        plain = {(r["query_id"], r["chunk_id"]): (round(r["score"], 9), r["n_matched"]) for r in L.match_scores(frame(spark, list(rows.values())), fields(), known, BOOSTS).collect()}
        for broadcast in (L.BROADCAST_TOKENS, 3):
            with monkeypatch.context() as m:
                m.setattr(L, "BROADCAST_TOKENS", broadcast)
                m.setattr(inverted, "PACK_TERMS", 12)
                df = index.matches(terms, BOOSTS)
                assert "hashpartitioning(query_id" not in df._jdf.queryExecution().executedPlan().toString()
                assert {(r["query_id"], r["chunk_id"]): (round(r["score"], 9), r["n_matched"]) for r in df.collect()} == plain
                assert searched(index, known, 4, 0.3) == everything(frame(spark, list(rows.values())), known, 4, 0.3)
    assert index.log.read()["generations"][0]["n"] == len(rows)


def test_numbers_come_back_from_their_bytes():
    counts = np.array([2, 0, 5, 1])
    values = np.array([0, 127, 128, 16383, 16384, 2**21, 2**31, 1])
    got, n = inverted._numbers(inverted._bytes(values, counts))
    assert got.tolist() == values.tolist() and n.tolist() == counts.tolist()
    sliced, n = inverted._numbers(inverted._bytes(values, counts).slice(2))
    assert sliced.tolist() == values[2:].tolist() and n.tolist() == [5, 1]


def test_the_files_of_an_index_are_smaller_than_its_texts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"word{int(5000 * rng.random() ** 3)}" for _ in range(200)), "t") for i in range(2000)]
    index = inverted.InvertedIndex(spark, str(tmp_path), ["body", "title"], buckets=2)
    index.add(frame(spark, rows), fields())
    index.withdraw(spark.range(500).select(F.col("id").alias("chunk_id")))
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.5 * sum(len(x[1]) for x in rows)


def test_parts_of_a_bucket_grow_with_the_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SLICE_TASKS", 2)
    index = inverted.InvertedIndex(spark, str(tmp_path), ["body", "title"], buckets=2)
    rows = frame(spark, [(i, f"w{i % 9} w{i}", "t") for i in range(60)]).repartition(6, "chunk_id")
    packs = index._packed(rows.select("chunk_id", *[c.alias(f"tokens_{f}") for f, c in fields().items()]), "g").select("bucket", "slice").collect()
    assert {r["bucket"] for r in packs} == {-1, 0, 1} and {r["slice"] // inverted.SLICES for r in packs if r["bucket"] == -1} == {0, 1, 2}
    # The question's terms leave no pair to be shuffled, and a search is what scoring everything gives.
    index.add(rows, fields())
    terms = spark.createDataFrame([(q, f"w{w}", 1.0) for q in range(5) for w in (q, q + 9, 3)], "query_id int, token string, weight double").distinct()
    assert searched(index, terms, 3, 0.3) == everything(rows, terms, 3, 0.3)
