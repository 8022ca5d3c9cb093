"""What the findings of the third round named: one test for each that was right."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import identifiers
from siltstone.operators import corpus, folders, inverted, layout, lexical, relational, retrieval, segment
from siltstone.streaming import queues, tasks


def test_many_files_of_one_name_find_their_places():
    n = 50_000
    taken = range(0, n, 2)
    rows = pd.DataFrame({"id": [f"s{i}" for i in taken] + [f"m{i:06}" for i in range(n)], "dest": "d", "name": "a", "family": "a", "moved": [False] * len(taken) + [True] * n, "turn": [*taken] + [0] * n})
    free = [i for i in range(n) if i % 2] + [*range(n, n + n // 2)]
    assert folders._free_turns(rows)["turn"].tolist() == free


def test_phrases_shuffle_counts_only(spark):
    rng = random.Random(4)
    texts = {i: [rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for i in range(40)}
    pairs = [(q, a, b) for q, (a, b) in enumerate(itertools.product("abz", repeat=2))]
    chunks = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "chunk_id long, text string")
    for slop in (0, 2):
        df = lexical.phrases(chunks, F.split("text", " "), spark.createDataFrame(pairs, "query_id long, a string, b string"), slop)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        near = lambda i, j: j == i + 1 if not slop else abs(i - j) <= 1 + slop and i != j  # noqa: B023, E731
        want = {(q, i, sum(near(x, y) and t[x] == a and t[y] == b for x in range(len(t)) for y in range(len(t)))) for q, a, b in pairs for i, t in texts.items()}
        assert {(r["query_id"], r["chunk_id"], r["n"]) for r in df.collect()} == {w for w in want if w[2]}


def test_citation_marks_are_mended_one_after_the_other(spark):
    df = spark.createDataFrame([("(ID: 3) and ref 4, (ID 99) [ ID 5 ]",), ("none",), (None,)], "a string").select(retrieval.repair_citations(F.col("a"), 25).alias("r"))
    assert [r[0] for r in df.collect()] == ["[ID:3] and [ID:4], (ID 99) [ID:5]", "none", None]
    # Each mark names the answer before it several times; nested as texts, the four make 81 of the first.
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2 * len(retrieval.CITATION_MARKS)


def test_parts_follow_their_order(spark):
    rng = random.Random(7)
    ids = rng.sample(range(10_000), 600)
    rows = [(i, rng.choice("aab"), str(i)) for i in ids]
    found = corpus.sharded(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["source"], ["doc_id"], 7).collect()
    for source in "ab":
        order = sorted(i for i, s, _ in rows if s == source)
        assert {r["doc_id"]: r["part_index"] for r in found if r["source"] == source} == {i: at // 7 + 1 for at, i in enumerate(order)}


def test_completion_wins_whatever_comes_after(spark, tmp_path):
    log = str(tmp_path / "log")
    for seq, values in enumerate([{"a": 1.0, "b": -1.0, "c": 0.4}, {"a": -1.0, "b": 0.9, "c": 0.2, "d": -1.0}, {"d": 1.0}]):
        spark.createDataFrame([(k, seq, v) for k, v in values.items()], "task_id string, seq int, progress double").coalesce(1).write.mode("append").json(log)
    out = {}

    def put(batch, epoch):
        out.update({r["task_id"]: r["progress"] for r in batch.collect()})

    stream = tasks.progress(tasks.task_log(spark, log, "task_id string, seq int, progress double"))
    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert out == {"a": 1.0, "b": -1.0, "c": 0.4, "d": 1.0}


def test_documents_are_folded_from_arrow_batches(spark):
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else "\n".join("ab"[: i % 3])) for i in range(100)], "doc_id long, text string").coalesce(1)
    df = segment.per_document(docs, lambda x: ((s, [len(s)]) for s in x.split("\n") if s), "line string, sizes array<int>")
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    want = {(i, at, s, (1,)) for i in range(100) if i % 5 for at, s in enumerate("ab"[: i % 3])}
    assert {(r["doc_id"], r["pos"], r["line"], tuple(r["sizes"])) for r in df.collect()} == want
    ids = docs.select(identifiers.xxh64_id(F.col("text"))).collect()
    assert ids[0][0] is None and ids[3][0] == "ef46db3751d8e999"


def test_names_repeated_very_often_are_numbered_by_many_tasks(spark):
    ids = random.Random(3).sample(range(5000), 3000)
    df = relational.rename_repeated(spark.createDataFrame([(i, "a.txt" if i % 9 else "b") for i in ids], "id long, name string"), "name", [F.col("id")])
    often = sorted(i for i in ids if i % 9)
    got = {r["id"]: r["name"] for r in df.collect()}
    assert [got[i] for i in often] == ["a.txt"] + [f"a({n}).txt" for n in range(1, len(often))]
    rare = sorted(i for i in ids if i % 9 == 0)
    assert [got[i] for i in rare] == ["b"] + [f"b({n})" for n in range(1, len(rare))]
    numbered = relational.numbered_within(spark.createDataFrame([(i, None) for i in ids], "id long, name string"), ["name"], [F.col("id")], "n")
    assert [r["n"] for r in numbered.orderBy("id").collect()] == list(range(1, 3001))
    # No window is over a name alone, with all its rows.
    assert re.findall(r"row_number\(\) windowspecdefinition\(name#\d+, (\w+)", df._jdf.queryExecution().analyzed().toString()) == ["_c"]


def test_pairs_of_questions_and_chunks_are_summed_where_they_are_made(spark):
    chunks = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcde", k=6))) for i in range(50)], "chunk_id long, text string")
    fields = {"content": F.split("text", " ")}
    terms = spark.createDataFrame([(q, t, 1.0) for q in range(4) for t in "abx"], "query_id long, token string, weight double")
    index = lexical.postings(chunks, fields, tokens=terms)
    df = lexical.field_scores(index, lexical.frequencies(index, chunks, fields), terms, "boolean", n_chunks=20 * lexical.PART_CHUNKS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and re.search(r"hashpartitioning\(chunk_id#\d+L?, 20\)", plan)
    want = {(q, r["chunk_id"], float(len({"a", "b"} & set(r["text"].split())))) for q in range(4) for r in chunks.collect()}
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in df.collect()} == {w for w in want if w[2]}


def test_shards_with_null_lines_are_digested_as_their_sql(spark):
    rows = spark.createDataFrame([(1, "a", "é"), (2, "a", None), (3, "a", "x"), (4, "b", None)], "doc_id long, source string, text string")
    got = {r["source"]: (r["written"], r["bytes"], r["md5"]) for r in corpus.shard_digests(rows, ["source"], F.col("text"), ["doc_id"]).collect()}
    assert got == {"a": (3, 6, hashlib.md5("é\nx\n".encode()).hexdigest()), "b": (1, None, None)}


def test_messages_are_folded_by_buckets(spark, tmp_path):
    (tmp_path / "acks").mkdir()
    spark.range(3000).select(F.col("id").cast("string").alias("msg_id"), F.lit("p").alias("payload"), F.to_timestamp(F.lit("2024-01-01")).alias("at")).write.json(str(tmp_path / "sent"))
    read = lambda name, shape: spark.readStream.schema(shape).json(str(tmp_path / name))
    given = queues.deliveries(read("sent", "msg_id string, payload string, at timestamp"), read("acks", "msg_id string, at timestamp"), consumers=3)
    out = queues.work(given, lambda batch: batch.where("msg_id % 2 = 0").select("msg_id"), str(tmp_path / "out"), str(tmp_path / "acks"), str(tmp_path / "state"))
    out.awaitTermination()
    assert 0 < max(o["numRowsTotal"] for p in out.recentProgress for o in p["stateOperators"]) <= queues.BUCKETS
    got = queues.given_rows(spark, str(tmp_path / "out"))
    assert {int(r["msg_id"]): (r["attempt"], r["consumer"]) for r in got.collect()} == {i: (1, int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 3) for i in range(3000)}
    assert got.count() == 3000 and spark.read.schema("msg_id string").json(str(tmp_path / "acks")).count() == 1500


def test_context_of_tables_cuts_and_shuffles_texts_once(spark):
    blocks = [(1, 0, "text", "a\x01b. c d."), (1, 1, "table", "t"), (1, 2, "text", "e. f"), (1, 3, "other", "no"), (None, 0, "text", "x"), (None, 1, "image", "i")]
    df = layout.surrounded(spark.createDataFrame(blocks, "doc_id long, seq int, kind string, text string"), 3)
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 1, "table", "t", "c d.", "e. f"), (None, 1, "image", "i", "", "")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("regexp_extract_all") == 1


def test_nearest_with_few_rows_held_in_python(spark, monkeypatch):
    for name, value in (("HELD", 40), ("PACK", 16), ("PRODUCT", 8)):
        monkeypatch.setattr(retrieval, name, value)
    x = np.random.default_rng(5).normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, embedding array<double>").coalesce(1)
    got = retrieval.nearest(df, df.withColumnRenamed("query_id", "chunk_id"), 3).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-np.round(unit @ unit.T, 9), axis=1, kind="stable")[:, :3]
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(i, int(j)) for i, row in enumerate(best) for j in row} and len(got) == 270


def test_postings_are_counted_where_their_chunk_lies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "LISTED_TOKENS", 5)
    index = inverted.InvertedIndex(spark, str(tmp_path / "index"), ["a", "b"])
    rows = [(1, ["x", "y", "x"], ["y"]), (2, None, ["z", "z"]), (3, [], []), (4, ["x"] * 9, None), (5, ["y"], ["x", "q", "y"])]
    posted = index._posted(index._listed(spark.createDataFrame(rows, "chunk_id long, tokens_a array<string>, tokens_b array<string>").coalesce(1)))
    want = {(i, t, (a or []).count(t), len(a) if t in (a or []) else None, (b or []).count(t), len(b) if t in (b or []) else None) for i, a, b in rows for t in {*(a or []), *(b or [])}}
    assert sorted(map(str, want)) == sorted(str((r["chunk_id"], r["token"], r["tf_a"], r["len_a"], r["tf_b"], r["len_b"])) for r in posted.collect())
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
