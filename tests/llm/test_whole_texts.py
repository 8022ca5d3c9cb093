"""op3 with the settings of the query: lines of any length and whole short texts."""

import random

from siltstone.llm import queries


def removed(spark, tmp_path, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r for r in queries.op3_substring_dedup(spark, str(tmp_path)).collect()}


def test_short_repeats_are_removed(spark, tmp_path):
    say = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    lines = [say(f"l{k}x", 9) for k in range(4)]
    paragraph = "\n".join(say(f"p{k}x", 4) for k in range(5))
    short = say("s", 32)
    texts = {
        1: "\n".join([say("a", 7), *lines, say("b", 7)]), 2: "\n".join([lines[0], say("c", 7), *lines[1:]]),
        3: f"{say('d', 9)}\n\n{paragraph}\n\n{say('e', 9)}", 4: f"{say('f', 9)}\n\n{paragraph.upper()}\n\n{say('g', 9)}",
        5: short, 6: f" {short}\n", 7: "one word", 8: "One  Word", 9: say("h", 200),
    }
    got = removed(spark, tmp_path, texts)
    assert {i: " ".join(r["text"].split()) for i, r in got.items() if r["n_removed_chars"]} == {2: say("c", 7), 4: say("f", 9) + " " + say("g", 9), 6: "", 8: ""}
    assert all(got[i]["kept_in"] == [i - 1] for i in (2, 4, 6, 8))


def test_removed_passages_have_no_holes(spark, tmp_path):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    texts, shared = {}, {}
    for i in range(0, 120, 2):
        shared[i + 1] = say(rng.randrange(60, 400))
        texts[i], texts[i + 1] = (f"{say(30)} {shared[i + 1]} {say(30)}" for _ in range(2))
    got = removed(spark, tmp_path, texts)
    for i, passage in shared.items():
        left = set(got[i]["text"].split())
        stays = "".join("x" if w in left else " " for w in passage.split())
        assert " " in stays and "x" not in stays.strip("x") and len(stays) - stays.count(" ") <= 48
