"""The registered queries against brute force, on a small fixture with the awkward cases and on the small tables."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, classifier, linededup, minhash, mixing, packing, queries, rules, secrets, substring, topk

WORD = re.compile("[^\x20\x09-\x0d]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _t string, _k1 long, node string, size string, score string, n_removed long, __at string, keys string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def fixture_rows():
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, copies, near copies and secrets."""
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(rng, 60, 10**6)
    lines = [prose(rng, 9) for _ in range(12)]
    texts = {
        1: base, 2: base, 3: near, 4: None, 5: "", 6: " \t\n \x0b", 7: "one", 8: "one two", 9: "a b a b a b a b a b a b a b a b a b a b a b",
        10: prose(rng, 40) + " " + passage + " " + prose(rng, 30), 11: prose(rng, 30) + " " + passage + " " + prose(rng, 40),
        12: "\n".join(lines[:6]), 13: "\n".join(lines[1:5] + lines[8:]), 14: "\n\n".join(["x y z"] * 9),
        15: 'PASSWORD = "s3cr3tvalue" and AKIA' + "A1" * 10 + " " + "0af" * 9 + " é token:short é api_key:abcdefgh1",
        16: "login: bob99 https://host.example/p " + "Ab1" * 14, 17: "https://lonely.example/x " + "Ab1" * 14 + "..",
        18: prose(rng, 6000), 19: "É#* <b> 100% &|\r\n", 20: "word\x1cword 　wide x",
    }
    rows = [(i, t, "en", f"s{i % 3}" if i != 9 else None, len(t) if t else None, "x", 1, "n", "s", "q", 5, "at", "k") for i, t in texts.items()]
    rows += [rows[0], rows[11], (None, base, None, None, None) + (None,) * 8, (None, None, None, None, None) + (None,) * 8]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def expect_secrets(t):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(docs, empty):
    got = collections.defaultdict(list)
    for r in secrets.secret_digest(secrets.find_secrets(docs)).collect():
        got[r["doc_id"]].append(r)
    for i, t in texts_of(docs):
        spans = expect_secrets(t)
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert any(r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)] for r in got[i])
    assert {r["doc_id"]: r["n_linked"] for i in (15, 16, 17) for r in got[i]} == {15: 0, 16: 3, 17: 2}
    assert secrets.find_secrets(empty).count() == 0


def test_long_texts_have_right_spans(spark):
    text = " ".join(f"token=abcdef{i}" for i in range(1500))
    row = secrets.secret_digest(secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row["spans"].startswith(",".join(f"assign:{a}:{b}" for a, _, b in expect_secrets(text)))


def expect_rules(t):
    w, lines, seen, dup = WORD.findall(t), t.split("\n"), set(), 0
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_rules(spark, docs, empty):
    trusted = docs.where("doc_id IN (1, 10, 18)")
    weights = rules.ngram_weights(docs, trusted, buckets=64)
    got = rules.quality_rules(docs, weights, buckets=64).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(str, ((r["doc_id"], *[r[n] for n in names]) for r in got))) == sorted(map(str, ((i, *expect_rules(t)) for i, t in texts_of(docs))))
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= -0.1) for r in got)
    assert rules.quality_rules(empty, weights, buckets=64).count() == 0
    flat = rules.ngram_weights(empty, empty, buckets=8).first()["weights"]
    assert len(flat) == 8 and len(set(flat)) == 1


def test_rules_score_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "!!")], "doc_id long, text string")
    row = rules.ngram_weights(docs, docs.where("doc_id = 1"), buckets=4096).first()["weights"]
    score = {r["doc_id"]: r["score"] for r in rules.quality_rules(docs, rules.ngram_weights(docs, docs.where("doc_id = 1"), buckets=4096), buckets=4096).collect()}
    p = lambda c, n: np.log((c + 1) / (n + 4096))
    a, once = p(1, 3) - p(2, 7), p(1, 3) - p(1, 7)
    assert score[1] == pytest.approx((a + 2 * once) / 3) and score[3] == pytest.approx(p(0, 3) - p(1, 7)) and len(row) == 4096


def expect_lines(rows):
    keys = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda k: k[:2])
    first, gone = {}, collections.defaultdict(set)
    for key in keys:
        lines = [(n, x) for n, x in enumerate(key[2].split("\n")) if WORD.search(x)]
        for k in range(len(lines) - 2):
            window = tuple(x for _, x in lines[k : k + 3])
            if window in first:
                gone[key].update(n for n, _ in lines[k : k + 3])
            first.setdefault(window, key)
    return {k: "\n".join(x for n, x in enumerate(k[2].split("\n")) if n not in gone[k]) for k in keys}


def test_line_dedup(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = expect_lines(rows)
    got = linededup.dedup_lines(docs)
    out = got.select("doc_id", "text", "n_removed").collect()
    expected = [(i, t if t is None else wanted[(i is None, i or 0, t)]) for i, t in rows]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out))) == sorted(map(str, expected))
    assert {r["doc_id"] for r in out if r["n_removed"]} == {13, 14}
    assert set(docs.columns) <= set(got.columns) and linededup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    mine = queries.QUERIES[name](spark, data)
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(str, map(tuple, mine.select(*names).collect()))) == sorted(map(str, found.fetchall()))


def test_substring_dedup(docs, empty):
    got = {}
    for r in substring.dedup_substrings(docs, least=8).collect():
        got.setdefault(r["doc_id"], r)
    text = dict((i, t) for i, t in texts_of(docs) if i is not None)
    passage = text[10].split()[40:100]
    left = got[11]["text"].split()
    assert got[10]["removed"] == "" and got[11]["kept_in"] == [10]
    assert len(set(passage) & set(left)) <= 25 and text[11].split()[:20] == left[:20]
    assert got[2]["text"].strip() == "" and got[2]["kept_in"] and got[13]["n_removed_chars"] > 0
    assert all(got[i]["text"] == text[i] for i in (5, 6, 7, 8, 12, 15, 18, 19)) and got[4]["text"] is None
    for i, r in got.items():
        if i is not None and r["removed"]:
            spans = [tuple(map(int, s.split(":"))) for s in r["removed"].split(",")]
            keep = "".join(text[i][a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text[i])], strict=True))
            assert keep == r["text"] and sum(b - a for a, b in spans) == r["n_removed_chars"]
    assert substring.dedup_substrings(empty).count() == 0
    wide = {r["doc_id"]: r for r in substring.dedup_substrings(docs, least=25, guard=26).collect()}
    assert wide[13]["removed"] == "" and wide[11]["kept_in"] == [10] and wide[2]["text"].strip() == ""


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, docs, empty, size, percent):
    rng = random.Random(size)
    chain = [prose(rng, 80, 10**6).split()]
    for _ in range(40):
        w = list(chain[-1])
        w[rng.randrange(len(w))] = f"n{rng.random()}"
        chain.append(w)
    more = spark.createDataFrame([(100 + i, " ".join(w).upper() if i % 2 else " ".join(w)) for i, w in enumerate(chain)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    sets = collections.defaultdict(set)
    every = []
    for i, t in texts_of(rows):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        every.append((i, len(s)))
        if i is not None:
            sets[i].add(s)
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and u and 100 * len(s & u) >= percent * len(s | u) for s in sets[a] for u in sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(rows, size, percent).collect()
    wanted = [(i, n, root(i) if i is not None else None, i is None or root(i) == i) for i, n in every]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert minhash.near_duplicates(empty, size, percent).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = np.unique(np.concatenate((common, own[:100]))), np.unique(np.concatenate((common, own[100:])))
    for x, y in ((a, b), (a[:3], a[1:4])):
        s = minhash.sketch([x, y], 2000)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - true) < 0.06
    rows, bands = minhash.banding(0.85)
    assert (1 - 0.85**rows) ** bands <= 1e-5


def expect_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, free, left, target = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), sum(size.values()), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3 * size[s] if over else share[s]
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    return target


def check_mix(rows, got):
    size = collections.Counter()
    for s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    target = expect_targets(size)
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"]
    return size, target, taken


def test_mixing(spark, docs, empty, data):
    again = [sorted(map(str, map(tuple, mixing.mix(docs).collect()))) for _ in range(2)]
    assert again[0] == again[1]
    check_mix([(r["source"], r["text"]) for r in docs.collect()], mixing.mix(docs).collect())
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in table.collect()}
    got = mixing.mix(table).collect()
    size, target, _ = check_mix([(r["source"], r["text"]) for r in rows.values()], got)
    taken = collections.Counter()
    for r in got:
        s = rows[r["doc_id"]]["source"]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
    assert all(abs(taken[s] - target[s]) <= 128 for s in size)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0


def test_targets_and_permutations():
    assert mixing.targets([100, 1], [1, 2]) == [98.0, 3.0] and mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    for n in (1, 2, 7, 64, 1000):
        at = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9))
        assert sorted(at) == list(range(n))


def test_mixed_texts_take_what_the_mix_says(docs):
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_packing(docs, empty):
    path = queries.tokenizer_path()
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = collections.Counter()
    for i, t in texts_of(docs):
        ids[(i, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    rows = packing.pack(docs.coalesce(2), path, buffer=3000).collect()
    sequences, total, pieces = collections.defaultdict(list), 0, collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0, *[r["length"] for r in s]])[:-1]) and sum(r["length"] for r in s) <= 4096
        total += sum(r["length"] for r in s)
    assert total == sum(len(b) // 4 * n for (_, b), n in ids.items())
    for (i, b), n in ids.items():
        own = [r for r in pieces[i, len(b) // 4] if zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]]
        covered = collections.Counter(k for r in own for k in range(r["start"], r["start"] + r["length"]))
        assert all(covered[k] >= n for k in range(len(b) // 4))
    assert packing.pack(empty, path).count() == 0


def test_encoder_is_the_tokenizers(data, spark):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [t or "" for t in pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()]
    texts += ["don't it's WORD. Word, <|endoftext|> x<|startoftext|>", "é é ÀÉ İstanbul ΣΑΣ ﬁ", "a.b,c...  \t3.5 1,000.", ".", " x　y\x1cz"]
    tokenizer = Tokenizer.from_file(path)
    for got, t in zip(packing.Encoder(path, most=2000).encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def expect_top(rows, k=20):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    x = np.array([np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, dim - len(v))) for _, v in ok]).astype(int)
    out = []
    for a, (i, _) in enumerate(ok):
        if i % 20 == 0:
            s = sorted((-int(x[a] @ x[b]), ok[b][0]) for b in range(len(ok)) if b != a)[:k]
            out += [(i, n, c, -m) for n, (m, c) in enumerate(s, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 420)]
    vectors += [(420, None), (421, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [1.0] * 8), (20, [0.1] * 8), (480, [0.2] * 3), (500, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("vec_id", topk.scaled().alias("v"), F.lit("x").alias("c_id"))
    query = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    got = sorted(map(tuple, topk.exact_top_k(df, query, block=32, batch=8).collect()))
    assert got == expect_top(vectors)
    assert topk.exact_top_k(df.limit(0), query).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert topk.exact_top_k(few, query).count() == 2


def test_chat(spark, data):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "<turn x>\n</turn>\\l"), (None, 0, "assistant", "é"), (3, 0, "a>\n<turn", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, record int")
    got = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(chat.chat_records(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\nassistant\nb\n") and got[1]["loss_sha256"] == sha("bb") and got[1]["loss_chars"] == 2
    assert got[2]["turns_sha256"] == sha("\n<turn x>\n</turn>\\l\n") and got[2]["n_turns"] == 1
    assert got[None]["loss_sha256"] == sha("é") and got[3]["turns_sha256"] == sha("a>\n<turn\n\n")
    assert chat.chat_digest(chat.format_chats(chat.chat_records(df.limit(0)))).count() == 0
    probe = next(r for r in queries.op1_chat_format(spark, data).collect() if r["conv_id"] == -7)
    said = chat.PROBE[1]
    assert probe["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and probe["loss_sha256"] == sha(said)


def test_layouts(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "id": 3}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "q", "completion": "a", "extra": {"deep": [1]}}', '{"instruction": "q", "input": "", "output": "a"}', '{"question": "q", "answer": "a"}', "not json", None, "[1]", "{}",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert [got[i]["layout"] for i in range(9)] == ["messages", "shares", "prompt_completion", "instruction", "question", None, None, None, None]
    assert all(chat.parse(got[i]["formatted"]) == [("user", "q"), ("assistant", "a")] for i in range(5))
    assert len({got[i]["fingerprint"] for i in range(5)}) == 5


def test_classifier(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, (prose(rng, 60) + "." if i % 3 else prose(rng, 60).upper().replace(" ", "!! ")), int(i % 3 > 0)) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    machine = classifier.learn(table, table.select("doc_id", "quality"), dims=256, sample=400)
    got = classifier.classify(table, machine).join(table, "doc_id").where(classifier.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    scores = classifier.classify(docs, machine, columns=docs.columns, prefix="__")
    assert scores.count() == docs.count() and scores.where("`__score` IS NULL OR `__score` < 0 OR `__score` > 1").count() == 0
    assert classifier.classify(empty, machine).count() == 0
    blank = classifier.learn(table, table.select("doc_id", "quality").limit(0), dims=64)
    assert {round(r["score"], 6) for r in classifier.classify(docs, blank).collect()} == {0.5}


def test_sum_of_squares_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = classifier.Machine(16, 0.3, rng.normal(size=16 + classifier.N_STATS), rng.normal(size=(16 + classifier.N_STATS, 4)), np.zeros(classifier.N_STATS), np.ones(classifier.N_STATS))
    index, value, stats = np.array([2, 5, 11]), np.array([0.5, -1.0, 2.0]), rng.normal(size=(1, classifier.N_STATS))
    x = np.zeros(16 + classifier.N_STATS)
    x[index], x[16:] = value, stats[0]
    direct = m.bias + m.weight @ x + sum(m.factor[i] @ m.factor[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert m.logits(np.array([0, 3]), index, value, stats)[0] == pytest.approx(direct)


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = df.select("doc_id", classifier.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
