"""SentencePiece, fill-in-middle and whitening against the library and brute force, with the awkward cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import fim, pieces, queries, whitening

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
SHAPE = "doc_id long, text string, source string, slice int, ids string, form string, _fim string, fim_n long"
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "▁", "▁▁a ▁", "a\n b\t  c", "\x00a", "ａ ﬁ é", "<s> </s> <unk>", "x" * 3000, " " * 40 + "end" + " " * 33,
    "漢字かな交じり文 " * 50, "😀a😀😀 b😀", "👩‍👩‍👧 é", "no <P> here", "<S>", "a<", "S>b", "1 22 333 a1b2", "\r\n\r\n", "def f(x):\n    return x\n", "word " * 20000,
]


def rows():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab ▁é漢😀\n1<PSM>") for _ in range(rng.randrange(60))) for _ in range(300)]
    made = [(i, t, f"s{i % 3}", 1, "i", "f", "_", 2) for i, t in enumerate(texts)]
    return made + [made[8]] * 3 + [(None, None) + (None,) * 6] * 2 + [(None, "a b", None, None, None, None, None, None), (-5, None, "s", 0, "", "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE)


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_path("piece_bpe_32k.model")


def counted(found):
    return collections.Counter(map(tuple, found))


def test_encoding_and_decoding_are_the_library(spark, docs, model):
    sp = pieces.processor(model)
    encoded = pieces.encode(docs, model, ids="found", slice_bytes=20000)
    assert encoded.columns == docs.columns + ["found"]
    wanted = [(r[0], r[1], r[4], tuple(sp.encode(r[1] or "") + [2])) for r in rows()]
    assert counted((r["doc_id"], r["text"], r["ids"], tuple(r["found"])) for r in encoded.collect()) == counted(wanted)
    back = pieces.decode(encoded.select("doc_id", "text", F.col("found").alias("ids")), model).collect()
    assert counted((r["doc_id"], r["decoded"]) for r in back) == counted((i, sp.decode(list(ids))) for i, _, _, ids in wanted)
    loose = spark.createDataFrame([(1, None), (2, []), (3, [1, 2, 0, None, 264])], "k long, ids array<int>")
    assert [r["decoded"] for r in pieces.decode(loose, model).orderBy("k").collect()] == ["", "", sp.decode([1, 2, 0, 264])]


def test_each_distinct_chunk_is_segmented_once(spark, model, monkeypatch):
    asked = spark.sparkContext.accumulator(0)
    plain = pieces._segment

    def counting(path, chunks):
        asked.add(len(chunks))
        return plain(path, chunks)

    monkeypatch.setattr(pieces, "_segment", counting)
    texts = [(i, f"one two  three{i % 7} one") for i in range(200)]
    assert pieces.encode(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), model, slice_bytes=500).count() == 200
    assert asked.value == len({" one", " two"} | {f"  three{i}" for i in range(7)})


def test_texts_are_shuffled_once(spark, docs, model):
    encoded = pieces.encode(docs, model, ids="found")
    encoded.collect()
    plan = encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_models_with_crossing_pieces_take_whole_texts(spark, docs, model, monkeypatch):
    sp = pieces.processor(model)
    monkeypatch.setattr(pieces, "separable", lambda _: False)
    monkeypatch.setattr(pieces, "_segment", lambda path, chunks: [pieces.processor(path).encode(c[1:]) for c in chunks])
    found = pieces.encode(docs, model, ids="found").select("text", "found").collect()
    assert counted((r["text"], tuple(r["found"])) for r in found) == counted((r[1], tuple(sp.encode(r[1] or "") + [2])) for r in rows())


def expect_fim(doc_id, text):
    text = text or ""
    found = UNIT.findall(text)
    n = len(found)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(found[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs):
    cut = fim.fill_in_middle(docs).withColumn("again", fim.restored(F.col("_fim_output"), F.col("_fim_form")))
    new = ["_fim_n", "_fim_form", "_fim_prefix_chars", "_fim_middle_chars", "_fim_output"]
    assert cut.columns == docs.columns + new + ["again"]
    found = counted((r["doc_id"], r["text"], *[r[c] for c in new], r["again"]) for r in cut.collect())
    assert found == counted((r[0], r[1], *expect_fim(r[0], r[1]), r[1] or "") for r in rows())
    assert {k[3] for k in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("name,pattern", [("words", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("lines", "\n|[^\n]+"), ("letters", UNIT.pattern), ("characters", r"[\s\S]")])
def test_boundaries_of_every_grammar(docs, name, pattern):
    for r in docs.select("text", fim.units(F.col("text"), fim.GRAMMARS[name]).alias("u")).collect():
        assert r["u"] == re.findall(pattern, r["text"] or "")


@pytest.mark.parametrize("grammar", ["abc", "[a]+", "[a-z]|[a-c]+|[^a-z]"])
def test_grammars_that_do_not_part_the_characters(grammar):
    with pytest.raises(ValueError):
        fim.boundary(grammar)


def vector_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 6)) @ np.diag([3, 1, 1, 0.5, 0.2, 0.05])
    made = [(i, [float(c) for c in np.float32(v)], "k") for i, v in enumerate(base)]
    odd = [(900, None, "k"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], "k"), (902, [float("nan")] + [0.0] * 5, None), (903, [float("inf")] + [0.0] * 5, "k"), (904, [1.0] * 9, "k"), (905, [], "k"), (None, made[3][1], None)]
    return made + [made[0]] * 150 + odd


def test_whitening_against_the_covariance(spark):
    rows = [r for r in vector_rows() if r[0] is None or r[0] < 900]
    table = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, part string").repartition(7)
    vectors = table.select("vec_id", "part", whitening.integers().alias("x"))
    model = whitening.fit(vectors, most=4)
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=float)).astype(np.int64) + 1_000_000
    n = len(x)
    exact = n * x - x.sum(0)
    centred = exact / n
    values, v = np.linalg.eigh(centred.T @ centred / n)
    values, v = values[::-1][:4], v[:, ::-1][:, :4]
    wanted = {r[0]: (int((d.astype(object) ** 2).sum()), w) for r, d, w in zip(rows, exact, centred @ v / np.sqrt(values), strict=True)}
    assert model.n == n and np.allclose(model.explained, values / np.trace(centred.T @ centred / n), rtol=1e-9)
    error = whitening.identity_error(vectors, model)
    assert error < 1e-9
    found = whitening.components(whitening.whiten(vectors, model), model, error).collect()
    assert counted((r["vec_id"], r["component"]) for r in found) == counted((r[0], c + 1) for r in rows for c in range(4))
    signs = {}
    for r in found:
        far, w = wanted[r["vec_id"]]
        c = r["component"] - 1
        assert r["deviation"] == far and r["n"] == n and r["identity_error"] == error
        sign = signs.setdefault(c, np.sign(r["whitened"] * w[c]))
        assert abs(r["whitened"] * sign - w[c]) < 1e-9


def test_whitening_without_variance_rows_or_entries(spark):
    shape = "vec_id long, embedding array<double>"
    fit = lambda rows: whitening.fit(spark.createDataFrame(rows, shape).select("vec_id", whitening.integers().alias("x")))
    assert fit([]) is None and fit([(1, None), (2, [])]) is None
    assert fit([(1, [0.5, 0.5])] * 3).components.shape == (2, 0)
    few = fit([(1, [0.0, 1.0, 5.0]), (2, [3.0, 1.0, 1.0])])
    assert few.components.shape == (3, 1) and abs(few.explained.sum() - 1) < 1e-12
    same = spark.createDataFrame([(1, [0.5, 0.5])] * 3, shape).select("vec_id", whitening.integers().alias("x"))
    model = whitening.fit(same)
    assert whitening.components(whitening.whiten(same, model), model, whitening.identity_error(same, model)).count() == 0


def test_whitening_keeps_the_digits_of_small_eigenvalues(spark):
    """A component 1e-7 of the first in scale, whose share the squares of a covariance would lose."""
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(-(10**8), 10**8, 500), rng.integers(-9, 10, 500)])
    model = whitening.fit(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>"))
    centred = x - x.mean(0)
    unit = centred[:, 0] / np.linalg.norm(centred[:, 0])
    least = np.linalg.norm(centred[:, 1] - unit * (unit @ centred[:, 1])) ** 2 / len(x)
    assert abs(model.eigenvalues[1] / least - 1) < 1e-6


def test_empty_tables(spark, tmp_path, model):
    docs = spark.createDataFrame([], SHAPE)
    assert pieces.encode(docs, model, ids="found").count() == 0 and fim.fill_in_middle(docs).count() == 0
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    none = queries.op13_embedding_whitening(spark, str(tmp_path))
    assert none.count() == 0 and dict(none.dtypes)["component"] == "int" and dict(none.dtypes)["n"] == "bigint"


def test_registered_queries(spark, data, model):
    sp = pieces.processor(model)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {i: sp.encode(t) + [2] for i, t in texts.items()}
    found = {tuple(r) for r in queries.op11_sentencepiece(spark, data).collect()}
    assert found == {(i, len(x), sha(" ".join(map(str, x))), sha(sp.decode(x))) for i, x in ids.items()}
    cut = {i: expect_fim(i, t) for i, t in texts.items()}
    assert {tuple(r) for r in queries.op12_fill_in_middle(spark, data).collect()} == {(i, *c[:4], sha(c[4]), sha(texts[i])) for i, c in cut.items()}
    rows = queries.op13_embedding_whitening(spark, data).toPandas()
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert rows["n"].nunique() == 1 and rows["n"][0] == len(wide) and wide.shape[1] == 32
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-9 and rows["identity_error"].max() < 1e-9
