"""Golden cases and invariants of the operators on small frames."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import identifiers, models, text, vectors
from siltstone.operators import corpus, evaluation, lexical, memory, mutations, predicates, relational, retrieval, segment, text_sql

META = [
    ("version", {"doc1": "hello earth", "doc2": "hello mars"}, "contains", "earth", ["doc1"]),
    ("version", {"doc1": "hello earth", "doc2": "hello mars"}, "not contains", "earth", ["doc2"]),
    ("status", {"doc1": "active", "doc2": "pending", "doc3": "done"}, "in", "active,pending", ["doc1", "doc2"]),
    ("status", {"doc1": "active", "doc2": "pending", "doc3": "done"}, "not in", "active,pending", ["doc3"]),
    ("name", {"doc1": "prefix_value", "doc2": "other"}, "start with", "pre", ["doc1"]),
    ("file", {"doc1": "report.pdf", "doc2": "image.png"}, "end with", ".pdf", ["doc1"]),
    ("notes", {"doc1": "", "doc2": "non-empty"}, "empty", "", ["doc1"]),
    ("notes", {"doc1": "", "doc2": "non-empty"}, "not empty", "", ["doc2"]),
    ("score", {"doc1": "5", "doc2": "6"}, "=", "5", ["doc1"]),
    ("score", {"doc1": "5", "doc2": "6"}, "≠", "5", ["doc2"]),
    ("score", {"doc1": "10", "doc2": "2"}, ">", "5", ["doc1"]),
    ("score", {"doc1": "10", "doc2": "2"}, "<", "5", ["doc2"]),
    ("score", {"doc1": "5", "doc2": "6", "doc3": "4"}, "≥", "5", ["doc1", "doc2"]),
    ("score", {"doc1": "5", "doc2": "6", "doc3": "4"}, "≤", "5", ["doc1", "doc3"]),
    ("day", {"doc1": "2024-03-01", "doc2": "later"}, ">", "2024-02-01", ["doc1"]),
    ("score", {"doc1": "abc", "doc2": "7"}, ">", "5", ["doc2"]),
]


@pytest.mark.parametrize("key,values,op,wanted,found", META)
def test_metadata_conditions(spark, key, values, op, wanted, found):
    meta = spark.createDataFrame([(d, key, v) for d, v in values.items()], "doc_id string, key string, value string")
    got = predicates.meta_filter(meta, [{"key": key, "op": op, "value": wanted}])
    assert sorted(r[0] for r in got.collect()) == found


def test_metadata_logic(spark):
    meta = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "1")], "doc_id string, key string, value string")
    f = [{"key": "none", "op": "=", "value": "0"}, {"key": "x", "op": "=", "value": "1"}, {"key": "y", "op": "=", "value": "2"}]
    ids = lambda **k: sorted(r[0] for r in predicates.meta_filter(meta, f, **k).collect())
    assert ids() == [] and ids(strict=False) == ["a"] and ids(logic="or") == ["a", "b"]


def test_status_counts(spark):
    rows = spark.createDataFrame([("k1", "0"), ("k1", "3"), ("k1", "9"), ("k2", "4"), ("k3", "1")], "kb_id string, run string")
    wanted = spark.createDataFrame([("k1",), ("k2",), ("empty",)], "kb_id string")
    names = {"0": "unstart", "1": "running", "2": "cancel", "3": "done", "4": "fail"}
    got = {r["kb_id"]: tuple(r)[1:] for r in relational.status_counts(rows, "kb_id", "run", names, wanted).collect()}
    assert got == {"k1": (1, 0, 0, 1, 0), "k2": (0, 0, 0, 0, 1), "empty": (0, 0, 0, 0, 0)}


def test_delete_keeps_scope(spark):
    df = spark.createDataFrame([("c1", "k1", "d1"), ("c2", "k2", "d1"), ("c3", "k1", None)], "chunk_id string, kb_id string, doc_id string")
    left = lambda **k: sorted(r[0] for r in mutations.delete(df, "k1", **k).collect())
    assert left(where=F.col("doc_id") == "d1") == ["c2", "c3"]
    assert left(ids=["c1", "c2"]) == ["c2", "c3"]
    assert left(ids=[]) == ["c1", "c2", "c3"]
    assert left(where=F.col("doc_id").isNull()) == ["c1", "c2"]


def test_highlight(spark):
    df = spark.createDataFrame([("The cat sat.",), ("Nothing here.",), (None,)], "t string")
    got = [r[0] for r in df.select(text.highlight("t", F.array(F.lit("cat")))).collect()]
    assert got == ["The <em>cat</em> sat", None, None]


@pytest.mark.parametrize("given_text,wanted", [("( test", "(test"), ("world !", "world!"), ("a  b", "a b"), ("x , y", "x , y")])
def test_tighten(spark, given_text, wanted):
    assert spark.createDataFrame([(given_text,)], "t string").select(text.tighten("t")).first()[0] == wanted


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.strip_fence(F.lit("```markdown\n# A\n```"))) == "# A"
    assert get(text.human_bytes(F.lit(1536))) == "1.50 KB"
    assert get(text.specialty(F.lit("临床诊疗指南—骨科分册2020.pdf"))) == "骨科"
    assert get(text.clamp_percent(F.lit("0.5"))) == 50 and get(text.clamp_percent(F.lit("x"))) == 0
    assert get(text.is_english(F.lit("plain words"))) and not get(text.is_english(F.lit("中文内容")))
    assert get(text.latin_digits(F.lit("٣٤"))) == "34"
    assert [r[0] for r in spark.createDataFrame([("三十二",), ("XIV",), ("forty-two",), ("?",)], "t string").select(identifiers.ordinal_number("t")).collect()] == [32, 14, 42, -1]
    assert get(vectors.token_f1(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == pytest.approx(2 / 3)
    assert get(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_counter_clamps(spark):
    df = spark.createDataFrame([("5",), ("bad",), (None,), ("99",), ("1",)], "v string")
    assert [r[0] for r in df.select(mutations.bump(F.col("v"), -2.0, 0.0, 50.0)).collect()] == [3.0, None, None, 50.0, None]
    array = spark.createDataFrame([(["a", "b", "a"],)], "t array<string>")
    assert array.select(mutations.remove_first(F.col("t"), "a")).first()[0] == ["b", "a"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab. \n", max_size=30), max_size=12), st.integers(4, 40))
def test_merged_sections_keep_all_text(sections, budget):
    chunks = segment.merge_sections(sections, budget)
    assert "".join(chunks) == "".join("\n" + s for s in sections)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=30), st.integers(50, 80))
def test_greedy_batches_fit(sizes, most):
    batches = segment.greedy_batches(sizes, most)
    assert all(sum(n for n, b in zip(sizes, batches, strict=True) if b == k) <= most for k in set(batches))
    assert batches == sorted(batches)


def test_markdown_blocks():
    blocks = list(segment.markdown_blocks("# A\ntext one\n## B\n| h | i |\n|---|---|\n| 1 | 2 |\n\n第 3 页\n![x](y)\n<table><tr><td>q</td></tr></table>"))
    assert [(b[0], b[1], b[2]) for b in blocks] == [("heading", "A", ["A"]), ("paragraph", "text one", ["A"]), ("heading", "B", ["A", "B"]), ("table", "h | i\n1 | 2", ["A", "B"]), ("table", "q", ["A", "B"])]


def test_chunks_of_units():
    units = [("s1", "c1", "a", 400), ("s1", "c1", "b", 400), ("s2", "c2", "c", 10)]
    chunks = list(segment.chunk_units(units, 768))
    assert [(c[0], c[3]) for c in chunks] == [("c1", 1), ("c1", 1), ("c2", 1)]
    assert segment.shard_rows([3000, 3000, 3000], 40, 6144) == [1, 1, 2] and segment.shard_rows([1] * 41) == [1] * 40 + [2]


def test_json_split_and_toc():
    import json

    big = json.dumps({"a": {"x": "1" * 30, "y": "2" * 30}, "b": [1, 2]})
    parts = [json.loads(p) for p, _ in segment.split_json(big, 60)]
    assert {k for p in parts for k in p} == {"a", "b"} and all(n <= 60 for _, n in segment.split_json(big, 60))
    assert segment.align_toc(["A", "B", "C"], ["A", "x", "C", "B", "C"]) == [(0, 0), (1, 3), (2, 4)]
    assert segment.align_toc([], []) == []


def test_questions_of_markdown():
    found = list(segment.markdown_questions("# Q1\nans\n```\n# code\n```\n## Q2\nmore"))
    assert found == [("Q1", "ans\n```\n# code\n```"), ("Q1\nQ2", "more")]


def test_page_window_and_total(spark):
    rows = [("q", i, 1.0 - i / 100, 1.0 - i / 100) for i in range(90)]
    scored = spark.createDataFrame(rows, "query_id string, chunk_id int, score double, sim double")
    page = retrieval.result_page(scored, 2, 10, 0.5).collect()
    assert [r["chunk_id"] for r in sorted(page, key=lambda r: r["rank"])] == list(range(10, 20)) and {r["total"] for r in page} == {51}
    assert retrieval.window_size(1) == 30 and retrieval.window_size(10) == 70


def test_citation_levels(spark):
    pairs = spark.createDataFrame([("a", 0, 0, 0.55), ("a", 0, 1, 0.549), ("a", 1, 0, 0.2), ("b", 0, 0, 0.2)], "answer_id string, sentence int, chunk int, sim double")
    assert sorted(tuple(r) for r in retrieval.citations(pairs).collect()) == [("a", 0, 0), ("a", 0, 1)]


def test_lexical_plan_has_no_product(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox")], "chunk_id int, text string")
    terms = spark.createDataFrame([(7, "fox", 1.0), (7, "red", 1.0)], "query_id int, token string, weight double")
    fields = {"content": text.tokens("text")}
    index = lexical.postings(docs, fields, tokens=terms)
    best = lexical.top(lexical.best_fields(lexical.field_scores(index, lexical.frequencies(index, docs, fields), terms), terms, 0.5), 1)
    assert best.first()["chunk_id"] == 1
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_eviction_frees_enough(spark):
    rows = [("m", f"i{i}", i if i % 2 else None, i, 10) for i in range(6)]
    df = spark.createDataFrame(rows, "memory string, id string, forget int, created int, size int")
    need = spark.createDataFrame([("m", 25)], "memory string, need int")
    gone = memory.evictions(df, need, "memory", F.col("size"), "forget", "created", "id")
    assert sorted(r["id"] for r in gone.collect()) == ["i1", "i3", "i5"]


def test_shards_and_summary(spark):
    df = spark.range(95).select(F.col("id"), F.lit("b").alias("bucket"))
    got = corpus.sharded(df, ["bucket"], ["id"], 20).groupBy("part_index").count().orderBy("part_index").collect()
    assert [tuple(r) for r in got] == [(1, 20), (2, 20), (3, 20), (4, 20), (5, 15)]
    first = spark.createDataFrame([(1,), (4,), (None,)], "first_hit int")
    assert tuple(evaluation.summary(first, []).first()) == (3, 0.666667, 0.416667, 0.333333, 0.333333, 0.666667, 0.666667)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = corpus.numbered(df, "k", F.lit(50), 8).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(51, 1051))


def test_folder_tree(spark):
    nodes = spark.createDataFrame([("r", "r", 1), ("a", "r", 2), ("b", "a", 4)], "id string, parent_id string, size long")
    assert {r["id"]: r["size"] for r in relational.subtree_sizes(nodes, "size").collect()} == {"r": 7, "a": 6, "b": 4}


def test_text_to_sql_repairs_once(spark):
    chunks = spark.createDataFrame([("d1", "n", "k1", 5), ("d2", "n", "k2", 7)], "doc_id string, docnm_kwd string, kb_id string, price int")
    text_sql.scoped_view(spark, chunks, ["k1"], "products")
    said = []

    def model(question, problem):
        said.append(problem)
        return "```sql\nselect nope from products;\n```" if problem is None else "select doc_id, docnm_kwd, price from products"

    sql, result = text_sql.answer(spark, "price?", model)
    assert [r["price"] for r in result.collect()] == [5] and len(said) == 2
    assert text_sql.render(result)[0] == "|price|Source|"
    text_sql.answer(spark, "how many?", lambda q, p: said.append("x") or "select count(*) n from products")
    assert said.count("x") == 1


def test_default_models(spark):
    df = spark.createDataFrame([("red fox",), (None,)], "t string")
    v = [r[0] for r in df.select(models.embed(F.col("t"))).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-5) and len(v[1]) == 64
    assert df.select(models.rerank(F.lit("red wolf"), F.col("t"))).first()[0] == 0.5
