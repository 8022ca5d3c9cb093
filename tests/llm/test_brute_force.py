"""Selections by brute force: substring units, draws and slots of the mix, windows of the packing, random texts in the encoder."""

import collections
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import chat, classifier, mixing, packing, queries, substring
from siltstone.llm.common import row_key
from siltstone.llm.wordhash import Words, windows

LEAST = -(2**63)


def say(rng, n, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def repeating_rows():
    """Repeated rows and lines, ties of ids, null ids and texts, shared passages and a very long text."""
    rng = random.Random(11)
    lines, passage, long = [say(rng, n) for n in (1, 3, 9, 26, 40)], say(rng, 90), say(rng, 30000, 5000)
    texts = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (2, "\n".join(lines[1:3])), (3, None), (4, ""), (None, lines[2]), (None, lines[2]), (None, None)]
    texts += [(5, f"{say(rng, 30)} {passage} {say(rng, 9)}"), (6, f"{say(rng, 8)} {passage.upper()}"), (7, long), (8, f"{long[:4000]}\n{lines[0]}"), (9, "a b\na  b\n\nA B\n a b"), (9, "a b\na  b\n\nA B\n a b")]
    return texts + [(10, "a " * 200)]


def expect_removed(rows, keys, least, window, guard):
    found = collections.defaultdict(set)
    for (k1, k2), text in {k: t for k, (_, t) in zip(keys, rows, strict=True)}.items():
        words = Words(pa.array([text or ""]), lower=True)
        points = words.code_points(np.arange(len(words.raw) + 1))
        spans = [(int(points[a]), int(points[b])) for a, b in zip(words.start, words.end, strict=True)]
        plain = [(text or "")[a:b].lower() for a, b in spans]
        at = 0
        for line in (text or "").split("\n"):
            n = len([w for w in line.split(" ") if w])
            if n and n >= least:
                found["line", *plain[at : at + n]].add((k2, k1, spans[at][0], spans[at + n - 1][1]))
            at += n
        h = windows(words.hash, window)
        for i in sorted({int(np.argmin(h[j : j + guard])) + j for j in range(len(h) - guard + 1)}):
            found["run", *plain[i : i + window]].add((k2, k1, spans[i][0], spans[i + window - 1][1]))
    gone = collections.defaultdict(set)
    for places in found.values():
        for k2, k1, a, b in sorted(places)[1:]:
            gone[k1, k2].update(range(a, b))
    return gone


@pytest.mark.parametrize("least,window,guard", [(1, 25, 25), (4, 5, 3)])
def test_substrings(spark, least, window, guard):
    rows = repeating_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = [(r["_k1"], r["_k2"]) for r in docs.select(*row_key()).collect()]
    gone = expect_removed(rows, keys, least, window, guard)
    wanted = collections.Counter()
    for (i, t), k in zip(rows, keys, strict=True):
        left = sorted(gone[k])
        # Touching spans are one; what is between two stays.
        wanted[i, t if t is None else "".join(c for n, c in enumerate(t) if n not in gone[k]), len(left)] += 1
    got = collections.Counter((r["doc_id"], r["text"], r["n_removed_chars"]) for r in substring.dedup_substrings(docs, least, window, guard).collect())
    assert got == wanted and sum(n > 0 for _, _, n in got) > 4


def test_draws_meet_totals_and_shards():
    for seed, wanted in ((1, [5, 0, 17, 400]), (2, [1]), (3, [0, 0]), (4, [10**6, 3, 10**5])):
        drawn = mixing.draw(np.array(wanted), 16, seed)
        assert drawn.sum(1).tolist() == wanted and (drawn >= 0).all() and np.ptp(drawn.sum(0)) <= 1
    wanted = np.array([30000, 10000, 24000])
    one, two = (mixing.draw(wanted, 16, s) for s in (1, 2))
    assert (one != two).any()
    # Multinomial: each count is about its share, no closer and no farther than chance.
    z = (one - 4000 * (wanted / 64000)[:, None]) / np.sqrt(4000 * (wanted / 64000 * (1 - wanted / 64000))[:, None])
    assert 0.5 < z.std() < 1.5 and (np.ptp(one, axis=1) > 0).all()


def stream_of(rows, keys):
    """The words of each source in the order of the operator: chunks of a hash, then hash, size and text."""
    sources = collections.defaultdict(list)
    for (i, text, source), (h, t) in zip(rows, keys, strict=True):
        sources[source].append((h, len((text or "").split()), t, i, text or ""))
    out = {}
    for source, docs in sources.items():
        chunks = max(1, -(-len(docs) // 1024))
        out[source] = [(i, n, w) for _, h, _, t, i, text in sorted((h % chunks, h, n, t, i, text) for h, n, t, i, text in docs) for n, w in enumerate(text.split())]
    return out


def test_mix_takes_the_blocks_of_its_slots(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, say(rng, rng.randrange(0, 90)), f"s{i % 3}" if i % 7 else None) for i in range(300)] + [(300, None, "s1"), (None, say(rng, 20), "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    ordered = docs.select("doc_id", "text", "source", F.xxhash64("doc_id").alias("h"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()
    streams = stream_of([(r["doc_id"], r["text"], r["source"]) for r in ordered], [(r["h"], r["t"]) for r in ordered])
    order = sorted(streams, key=lambda s: (s is None, s or ""))
    sizes = [len(streams[s]) for s in order]
    target = mixing.targets(sizes, [1, 2, 3, 1])
    blocks = [-(-n // 16) for n in sizes]
    wanted = np.array([min(round(t / n * b), 3 * b) for t, n, b in zip(target, sizes, blocks, strict=True)])
    seen = {}
    for shards, seed in ((4, 5), (4, 6), (9, 5)):
        drawn, taken, by_shard = mixing.draw(wanted, shards, seed), collections.Counter(), collections.defaultdict(set)
        for si, source in enumerate(order):
            slot = 0
            for shard in range(shards):
                for _ in range(drawn[si, shard]):
                    turn, n = divmod(slot, blocks[si])
                    b = int(mixing.permute(np.array([n]), np.array([blocks[si]]), mixing._key(seed, si, np.array([turn])))[0])
                    for i, _, w in streams[source][16 * b : 16 * b + 16]:
                        taken[i] += 1
                        by_shard[i].add(shard)
                    slot += 1
        got = mixing.mix(docs, block=16, shards=shards, seed=seed).collect()
        assert {r["doc_id"]: (r["taken"], r["n_shards"]) for r in got} == {i: (taken[i], len(by_shard[i])) for i, _, _ in rows}
        texts = mixing.mixed_texts(docs, block=16, shards=shards, seed=seed, placed=True).collect()
        assert collections.Counter(i for r in texts for i in [r["doc_id"]] * len(r["text"].split())) == +taken
        places = [(r["shard"], r["slot"]) for r in texts]
        assert {s for s, _ in places} <= set(range(shards)) and all(0 <= n < drawn[:, s].sum() for s, n in places)
        seen[shards, seed] = sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text"]) for r in texts)
    assert seen[4, 5] != seen[4, 6] and seen[4, 5] != seen[9, 5]
    again = mixing.mixed_texts(docs.repartition(2, "text"), block=16, shards=4, seed=5, placed=True).collect()
    assert sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text"]) for r in again) == seen[4, 5]


def test_too_many_sources_are_an_error(spark):
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    assert mixing.mix(docs, most_sources=5).count() == 5
    with pytest.raises(ValueError):
        mixing.mix(docs, most_sources=4)


def test_windows_are_full_but_for_the_last(spark):
    rng = random.Random(6)
    lengths = [rng.randrange(1, 900) for _ in range(400)] + [20000, 4096, 4097, 1, 256, 255]
    packer = packing.Packer(buffer=6000)
    out = []
    for i, n in enumerate(lengths):
        out += packer.push(i, np.arange(n, dtype="<u4"))
        assert packer.held <= 6000 + 4096
    out += packer.finish()
    seen = collections.defaultdict(list)
    for window in out:
        for doc, start, ids in window:
            seen[doc] += range(start, start + len(ids))
            assert ids[0] == start
    assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(lengths))
    sizes = [sum(len(p[2]) for p in w) for w in out]
    assert sum(s not in packing.TIERS for s in sizes) <= 1 and min(sizes) > 0 and max(sizes) == 4096
    assert {4096, 512} <= set(sizes)


def test_step_groups_are_equal_over_partitions(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, say(rng, rng.choice((5, 60, 300, 900)), 40)) for i in range(300)], "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, queries.tokenizer_path(), step_tokens=8192, buffer=5000).where("offset = 0").collect()
    steps = collections.Counter((r["tier"], r["step"]) for r in rows)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and len({r["sequence_id"] >> 40 for r in rows}) > 2
    for tier in {t for t, _ in steps}:
        sizes = [steps[tier, k] for k in range(sum(t == tier for t, _ in steps))]
        assert all(n == 8192 // tier for n in sizes[:-1]) and 0 < sizes[-1] <= 8192 // tier


def test_encoder_on_random_scripts():
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(), random.Random(1)
    scripts = [(0x41, 0x7B), (0xC0, 0x250), (0x370, 0x460), (0x300, 0x340), (0x4E00, 0x4E40), (0x1E00, 0x1F00), (0x20, 0x40), (0xAC00, 0xAC40), (0x600, 0x650), (0x1F600, 0x1F640), (0xFB00, 0xFB10), (0x2000, 0x2070)]

    def word():
        own = [rng.choice(scripts)] if rng.randrange(4) else scripts
        w = "".join(chr(rng.randrange(*rng.choice(own))) for _ in range(rng.randrange(1, 7)))
        return (w[:1] + rng.choice("İıſßŉΣ") + w[1:] if rng.random() < 0.15 else w) + rng.choice(("", "", ".", ",", "..", ".,", "!"))

    texts = [rng.choice((" ", "\n", "  ")).join(word() for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["İİ.", "ıİ,", "İİİ, a b", "İstanbul.", "ΣΑΣ.", "ΣΑΣ, ΣΑ", say(rng, 20000)]
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path, most=2000)
    got = [b for at in range(0, len(texts), 50) for b in encoder.encode(texts[at : at + 50])]
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizers_that_keep_blanks_encode_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = ["a b  c\n\nd.", "", " lead", "don't"]
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert not encoder.by_piece and [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_nested_layouts_and_parts(spark):
    nested = {"conversation": {"messages": [{"author": {"role": "human"}, "content": {"parts": ["q", {"type": "text", "text": "r"}]}}, {"author": {"role": "gpt"}, "content": {"parts": ["a"]}}, None]}}
    records = [
        nested, {"input": {"prompt": "q"}, "output": {"text": "a"}, "id": 3}, {"input": {"prompt": "q", "system": "s"}, "output": {"text": "a"}},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "image", "url": "u"}]}, {"role": "assistant", "content": "a"}]},
        {"conversation": {"messages": []}}, {"conversation": "text"}, {"messages": {"role": "user", "content": "x"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert [got[i]["layout"] for i in range(7)] == ["authored", "input_output", "input_output", "messages", None, None, None]
    said = [chat.parse(got[i]["formatted"]) for i in range(4)]
    assert said[0] == [("user", "q\nr"), ("assistant", "a")] and said[1] == [("user", "q"), ("assistant", "a")] and said[2][0] == ("system", "s")
    assert said[3] == [("user", 'q\n{"type": "image", "url": "u"}'), ("assistant", "a")]
    assert len({got[i]["fingerprint"] for i in range(7)}) == 7


def test_remembered_layouts_are_bounded():
    known = {}
    for i in range(50):
        assert chat.select_layout({"prompt": "q", "completion": "a", f"x{i}": 1}, known, most=20) == "prompt_completion"
    assert len(known) == 20


def test_very_long_chats_come_back(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(("</turn>\n", "<turn user>\n", "\\l", "\\", "<", "é", "word ")) for _ in range(200_000))
    rows = [(1, 0, "user", text), (1, 1, "assistant", text[::-1])]
    formatted = chat.format_chats(chat.chat_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    (a, b), out = formatted["loss_spans"][0], formatted["formatted"]
    assert chat.parse(out) == [("user", text), ("assistant", text[::-1])] and chat.unescape(out[a:b]) == text[::-1]


def test_repeated_ids_bring_one_row_to_the_driver(spark):
    rows = [(i, f"good word {i}" if i % 2 else f"BAD!! {i}", i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 30 + [(1, "another text")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    seen, fit = [], classifier.fit
    classifier.fit = lambda rows, *a, **k: seen.append(len(rows)) or fit(rows, *a, **k)
    try:
        once, many = (classifier.learn(d, labels, dims=64) for d in (docs.distinct(), docs))
    finally:
        classifier.fit = fit
    assert seen[0] == seen[1] <= 40 and np.array_equal(once.weight, many.weight)


def test_features_and_scores_by_hand():
    texts = ["the cat the CAT\n\nsat!", "", "é 12 é"]
    starts, index, value, stats = classifier.features(pa.array(texts), 1 << 30)
    for i, t in enumerate(texts):
        count = collections.Counter(t.split())
        norm = sum(count.values()) ** 0.5
        assert sorted(value[starts[i] : starts[i + 1]].round(9)) == sorted(round((n**0.5) / norm, 9) for n in count.values())
    assert stats[0][11] == pytest.approx(np.log1p(5)) and stats[0][7] == pytest.approx(2 / len(texts[0])) and stats[0][9] == pytest.approx(4 / 5)
    rng = np.random.default_rng(4)
    m = classifier.Machine(1 << 10, 0.1, rng.normal(size=1024 + classifier.N_STATS), rng.normal(size=(1024 + classifier.N_STATS, 3)), np.zeros(classifier.N_STATS), np.ones(classifier.N_STATS))
    starts, index, value, stats = classifier.features(pa.array(texts), 1 << 10)
    got = m.logits(starts, index, value, stats)
    for i in range(3):
        x = np.zeros(1024 + classifier.N_STATS)
        x[index[starts[i] : starts[i + 1]]] = value[starts[i] : starts[i + 1]]
        x[1024:] = np.clip(stats[i], -6, 6)
        pairs = sum(m.factor[a] @ m.factor[b] * x[a] * x[b] for a in np.flatnonzero(x) for b in np.flatnonzero(x) if b < a)
        assert got[i] == pytest.approx(m.bias + m.weight @ x + pairs)


def test_fit_takes_adam_steps():
    rows = [(np.array([0], np.int32), np.array([1.0]), np.zeros(classifier.N_STATS)), (np.array([1], np.int32), np.array([1.0]), np.zeros(classifier.N_STATS))]
    m = classifier.fit(rows, np.array([1.0, 0.0]), 2, 2, epochs=1, rate=0.1, decay=0.0)
    # The first step of Adam is the rate against the gradient's sign.
    assert m.weight[:2] == pytest.approx([0.1, -0.1], abs=1e-6)
