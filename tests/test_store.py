"""The document store's contract."""

from pyspark.sql import functions as F

from siltstone.operators import store


def test_changes_are_versions(spark, tmp_path):
    s = store.DocumentStore(spark, str(tmp_path / "chunks"))
    assert not s.exists()
    s.create("chunk_id string, kb_id string, content string, tags array<string>, available_int int")
    s.create("other string")
    rows = spark.createDataFrame([("c1", "The cat sat.", ["a", "b"], 1), ("c2", "A dog.", ["b"], 0), ("c3", "Cats.", [], None)], "chunk_id string, content string, tags array<string>, available_int int")
    s.insert(rows, "k1")
    s.insert(rows.where("chunk_id = 'c1'").withColumn("content", F.lit("A cat.")), "k1")
    s.insert(rows.where("chunk_id = 'c2'").withColumn("chunk_id", F.lit("x9")), "k2")
    assert s.total(s.rows()) == 4 and s.get("c1", ["k1"]).first()["content"] == "A cat." and s.get("c1", ["k2"]).count() == 0
    ids = lambda **c: [r[0] for r in s.search(["chunk_id"], c, ["k1"], [F.col("chunk_id").desc()]).collect()]
    assert ids(available_int=1) == ["c3", "c1"] and ids(tags=["b"]) == ["c2", "c1"] and ids(nope="x") == [] and ids(kb_id="") == ["c3", "c2", "c1"]
    s.update(F.col("chunk_id") == "c2", {"available_int": 1, "content": ""})
    s.delete("k1", ids=[])
    s.delete("k1", ids=["c3", "x9"])
    assert sorted(r["chunk_id"] for r in s.rows().collect()) == ["c1", "c2", "x9"] and ids(available_int=1) == ["c2", "c1"]
    assert {r["key"]: r["n"] for r in s.aggregation(s.rows(), "tags").collect()} == {"a": 1, "b": 3}
    assert s.highlight(s.get("c1", ["k1"]), "content", ["cat"]).first()["highlight"] == "A <em>cat</em>"
    assert s.sql("SELECT count(*) AS n FROM chunks", ["k1"]).first()["n"] == 2
    s.drop("k1")
    assert s.exists()
    s.drop()
    assert not s.exists()


def test_migration_and_schema(spark):
    df = spark.createDataFrame([("1", "x"), ("bad", "y")], "a string, b string")
    out = store.migrate(df, {"c": "int", "a": "string"}, {"a": "int"}, {"b": "name"})
    assert out.columns == ["a", "name", "c"] and [r["a"] for r in out.collect()] == [1, None]
    schema = store.json_schema([{"key": "brand", "enum": ["x", "y", "x"]}, {"key": "note", "description": "free"}])
    assert schema["properties"]["brand"]["items"]["enum"] == ["x", "y"] and schema["properties"]["note"]["type"] == "string"


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("*.parquet")}


def test_a_row_is_one_small_file(spark, tmp_path):
    s = store.DocumentStore(spark, str(tmp_path))
    s.create("chunk_id long, kb_id string, n long")
    s.insert(spark.range(50000).select(F.col("id").alias("chunk_id"), (F.col("id") * 7 % 1000).alias("n")), "k")
    before = _files(tmp_path)
    s.insert(spark.createDataFrame([(17, -1)], "chunk_id long, n long"), "k")
    s.delete("k", ids=[18])
    new = {k: v for k, v in _files(tmp_path).items() if k not in before}
    assert before.items() <= _files(tmp_path).items() and len(new) == 2 and max(new.values()) < 3000
    assert s.rows().count() == 49999 and s.get(17, ["k"]).first()["n"] == -1 and not s.get(18, ["k"]).count()


def test_two_writers_keep_both_changes(spark, tmp_path, monkeypatch):
    one, two = (store.DocumentStore(spark, str(tmp_path)) for _ in range(2))
    one.create("chunk_id long, kb_id string, n long")
    row = lambda i, n: spark.createDataFrame([(i, n)], "chunk_id long, n long")
    one.insert(row(0, 0), "a")
    plain, others = one.log.put, [lambda: two.insert(row(1, 1), "a"), lambda: two.insert(row(2, 2), "b")]

    def late(version, content):
        # Another writer commits between this one's reading and its writing.
        if others:
            others.pop(0)()
        return plain(version, content)

    monkeypatch.setattr(one.log, "put", late)
    one.insert(row(3, 3), "a")
    found = lambda: sorted((r["kb_id"], r["chunk_id"], r["n"]) for r in two.rows().collect())
    assert not others and found() == [("a", 0, 0), ("a", 1, 1), ("a", 3, 3), ("b", 2, 2)]
    # An update that has read rows is made again on the other writer's row of the same knowledge base.
    others.append(lambda: two.insert(row(0, 50), "a"))
    one.update(F.col("chunk_id") == 0, {"n": F.col("n") + 1})
    assert not others and found() == [("a", 0, 51), ("a", 1, 1), ("a", 3, 3), ("b", 2, 2)]
    # One of another knowledge base doesn't stand in its way if it isn't in the condition's scope.
    others.append(lambda: two.delete("a", ids=[3]))
    one.delete("b", ids=[2])
    assert found() == [("a", 0, 51), ("a", 1, 1)]


def test_mixed_changes_against_a_dictionary(spark, tmp_path):
    import random

    rng, s, wanted = random.Random(4), store.DocumentStore(spark, str(tmp_path), fold_files=3, fold_share=0.2), {}
    s.create("chunk_id long, kb_id string, n long")
    for step in range(14):
        kb, kind = rng.choice("ab"), rng.choice(["insert", "insert", "update", "delete"])
        if kind == "insert":
            rows = [(rng.randrange(30), step * 100 + i, i) for i in range(rng.randrange(1, 12))]
            s.insert(spark.createDataFrame(rows, "chunk_id long, n long, i int"), kb, order="i")
            wanted.update({(kb, k): n for k, n, _ in rows})
        elif kind == "update":
            s.update((F.col("chunk_id") % 3 == 1) & (F.col("kb_id") == kb), {"n": F.col("n") + 1})
            wanted.update({k: n + 1 for k, n in wanted.items() if k[0] == kb and k[1] % 3 == 1})
        else:
            s.delete(kb, where=F.col("chunk_id") % 5 == step % 5)
            wanted = {k: n for k, n in wanted.items() if k[0] != kb or k[1] % 5 != step % 5}
    assert {(r["kb_id"], r["chunk_id"]): r["n"] for r in s.rows().collect()} == wanted
    assert s.rows().count() == len(wanted) and all(len(f) <= 4 for f in s.log.read()["kbs"].values())
    s.compact(["a", "b"])
    s.vacuum()
    assert {(r["kb_id"], r["chunk_id"]): r["n"] for r in s.rows().collect()} == wanted and len(s.log.folders()) == 1


def test_upsert_takes_one_new_row_of_a_key(spark):
    from siltstone.operators import mutations

    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int"), spark.createDataFrame([(1, "x", 2), (1, "y", 3), (1, "z", 1), (3, None, 0), (3, None, 0)], "k int, v string, o int")
    assert sorted((r["k"], r["v"]) for r in mutations.upsert(old, new, "k", "o").collect()) == [(1, "y"), (2, "b"), (3, None)]
    assert mutations.upsert(old, new, "k").count() == 3
