"""The stored inverted index against scoring everything, under changes, and how much of it a search reads."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import inverted
from siltstone.operators import lexical as L

BOOSTS = {"body": 2.0, "title": 10.0}


def fields():
    return {"body": text.tokens("body"), "title": text.tokens("title")}


def chunk(rng, i, vocabulary=60):
    words = [f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randrange(1, 80))]
    return (i, " ".join(words), f"w{rng.randrange(9)} t{i % 5}")


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, body string, title string")


def asked(spark, rng, n=8, vocabulary=60):
    rows = [(q, w, 1.0 + rng.random()) for q in range(n) for w in {f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(6)} | {"t1", "w0"}]
    return spark.createDataFrame(rows, "query_id int, token string, weight double")


def everything(chunks, terms, k, share):
    found = L.enough(L.match_scores(chunks, fields(), terms, BOOSTS), terms, share).withColumn("score", F.round("score", 6))
    return [tuple(r) for r in L.top(found, k).select("query_id", "rank", "chunk_id", "score", "n_matched", "n_terms").orderBy("query_id", "rank").collect()]


def searched(index, terms, k, share):
    return [tuple(r) for r in index.search(terms, k, share, BOOSTS, seed=4).select("query_id", "rank", "chunk_id", "score", "n_matched", "n_terms").orderBy("query_id", "rank").collect()]


def test_search_equals_scoring_everything(spark, tmp_path):
    rng = random.Random(2)
    chunks = frame(spark, [chunk(rng, i) for i in range(600)] + [(900, None, None), (901, "", "t1")])
    index = inverted.InvertedIndex(spark, str(tmp_path), ["body", "title"], buckets=4)
    index.add(chunks, fields())
    terms = asked(spark, rng)
    for k, share in ((3, 0.3), (10, 0.7)):
        assert searched(index, terms, k, share) == everything(chunks, terms, k, share)
    plain = {(r["query_id"], r["chunk_id"]): (round(r["score"], 9), r["n_matched"]) for r in L.match_scores(chunks, fields(), terms, BOOSTS).collect()}
    assert {(r["query_id"], r["chunk_id"]): (round(r["score"], 9), r["n_matched"]) for r in index.matches(terms, BOOSTS).collect()} == plain
    assert index.search(terms.where("query_id < 0")).count() == 0 and index.search(terms.withColumn("token", F.lit("nowhere"))).count() == 0


def test_changes_show_in_the_next_search(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = {i: chunk(rng, i) for i in range(60)}
    index = inverted.InvertedIndex(spark, str(tmp_path), ["body", "title"], buckets=2, fold_at=5)
    terms = asked(spark, rng, 4)
    assert searched(index, terms, 5, 0.3) == []
    index.add(frame(spark, list(rows.values())), fields())
    new = {i: chunk(rng, i) for i in (3, 7, 100, 101)}
    other, plain = inverted.InvertedIndex(spark, str(tmp_path), ["body", "title"]), index.log.put
    waiting = [lambda: other.withdraw(spark.createDataFrame([(9,), (3,), (777,)], "chunk_id long"))]

    def late(version, content):
        # Another writer commits between this one's reading and its writing.
        if waiting:
            waiting.pop()()
        return plain(version, content)

    monkeypatch.setattr(index.log, "put", late)
    index.add(frame(spark, list(new.values())), fields())
    del rows[9]
    rows |= new
    assert not waiting and searched(index, terms, 5, 0.3) == everything(frame(spark, list(rows.values())), terms, 5, 0.3)
    index.withdraw(spark.createDataFrame([(100,)], "chunk_id long"))
    index.add(frame(spark, [(100, "w0 w1 t1", "t1")] * 3), fields())
    rows[100] = (100, "w0 w1 t1", "t1")
    assert len(index.log.read()["generations"]) == 1  # folded
    index.vacuum()
    assert searched(index, terms, 5, 0.3) == everything(frame(spark, list(rows.values())), terms, 5, 0.3)
    with pytest.raises(ValueError):
        inverted.InvertedIndex(spark, str(tmp_path), ["body"])


def test_a_search_reads_its_postings(spark, tmp_path):
    """Thirteen times the chunks, in other words, and buckets for them: the index grows, what a search reads hardly does."""
    rng = random.Random(5)
    rows = [chunk(rng, i) for i in range(300)]
    others = [(1000 + i, " ".join(f"x{rng.randrange(4000)}" for _ in range(120)), "y") for i in range(3600)]
    systems = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    done = lambda: sum(s.getBytesRead() for s in systems.getAllStatistics() if s.getScheme() == "file")
    terms, read, size = asked(spark, rng, 1), [], []
    for name, part, buckets in (("small", rows, 4), ("large", rows + others, 64)):
        index = inverted.InvertedIndex(spark, str(tmp_path / name), ["body", "title"], buckets, page_rows=500)
        index.add(frame(spark, part), fields())
        before = done()
        index.matches(terms, BOOSTS).count()
        read.append(done() - before)
        size.append(sum(p.stat().st_size for p in (tmp_path / name).rglob("postings/*/*.parquet")))
    assert size[1] > 40 * size[0] and read[1] < 4 * read[0] and read[1] < size[1] / 10, (size, read)
