"""Context of tables and images: golden cases of geometry, and folds over blocks as brute force."""

import random
import re

from siltstone.operators import layout

TOKEN = re.compile(r"[A-Za-z0-9_À-ɏ]+|[^\sA-Za-z0-9_À-ɏ]")
FLAT = "doc_id long, seq int, kind string, text string"
LAID = FLAT + ", positions array<struct<page:int,left:double,right:double,top:double,bottom:double>>"


def count(t):
    return len(TOKEN.findall(t or ""))


def cut(text, end=r"[。!?？；！\n]|\. "):
    return re.findall(rf"(?s).*?(?:{end})|.+", text or "")


def expect(blocks, at, budget):
    """Nearest sentences of text blocks before and behind until the budget is full."""
    sides = []
    for step in (-1, 1):
        held, said = 0, []
        for _, _, kind, text in (blocks[at - 1 :: -1] if at else []) if step < 0 else blocks[at + 1 :]:
            for s in cut(text)[::step] if kind == "text" else []:
                if held >= budget:
                    break
                said.append(s)
                held += count(s)
        sides.append("".join(said[::step]))
    return tuple(sides)


def test_surrounded_against_a_fold(spark):
    rng = random.Random(8)
    docs = []
    for doc in range(12):
        text = lambda: " ".join(rng.choice(["word", "x.", "A. ", "中文。", "b\n", "?", "end!"]) for _ in range(rng.randrange(30)))
        docs.append([(doc, i, rng.choice(["text", "text", "table", "image"]), rng.choice([text(), text(), "", None])) for i in range(rng.randrange(1, 25))])
    docs += [[(50, 0, "text", "one two. " * 4000), (50, 1, "table", "t"), (50, 2, "text", None)], [(51, 0, "image", None)]]
    frame = spark.createDataFrame([b for d in docs for b in d], FLAT)
    for budget in (1, 7, 40):
        found = {(r["doc_id"], r["seq"]): (r["above"], r["below"]) for r in layout.surrounded(frame, budget).collect()}
        assert found == {(b[0], b[1]): expect(d, i, budget) for d in docs for i, b in enumerate(d) if b[2] != "text"}
    # Many short blocks: no number of neighbours stands in the way of the budget.
    long = spark.createDataFrame([(1, i, "text", f"a{i}") for i in range(50)] + [(1, 50, "table", "t")], FLAT)
    assert layout.surrounded(long, 40).first()["above"] == "".join(f"a{i}" for i in range(10, 50))


def on(page, top, bottom, left=0.0):
    return (page, float(left), 100.0, float(top), float(bottom))


def test_text_beside(spark):
    cases = {
        "overlap, nearest middle": ([("text", [on(1, 0, 50)]), ("text", [on(1, 40, 70)]), ("table", [on(1, 45, 60)])], {2: 1}),
        "ties go to the earlier": ([("text", [on(1, 0, 20)]), ("image", [on(1, 10, 20)]), ("text", [on(1, 10, 30)])], {1: 0}),
        "gap in the middle of a page": ([("text", [on(1, 0, 10)]), ("table", [on(1, 20, 30)]), ("text", [on(1, 40, 50)])], {}),
        "first on its page": ([("table", [on(2, 0, 5)]), ("text", [on(2, 30, 40)]), ("text", [on(2, 10, 20)]), ("text", [on(1, 0, 5)])], {0: 2}),
        "last on its page": ([("text", [on(1, 0, 10)]), ("image", [on(1, 80, 90)]), ("text", [on(1, 20, 30)]), ("text", [on(2, 0, 9)])], {1: 2}),
        "over a page change": ([("table", [on(1, 90, 99), on(2, 0, 30)]), ("text", [on(1, 0, 9)]), ("text", [on(2, 20, 60)])], {0: 2}),
        "upside down and without a bottom": ([("text", [(1, 0.0, 0.0, 50.0, 10.0)]), ("table", [(1, 0.0, 0.0, 30.0, None)])], {1: 0}),
        "alone, and without positions": ([("table", [on(3, 0, 9)]), ("image", None), ("text", [])], {}),
    }
    rows = [(i, seq, kind, f"{name} {seq}", p) for i, (name, (blocks, _)) in enumerate(cases.items()) for seq, (kind, p) in enumerate(blocks)]
    found = {}
    for r in layout.nearest_text(spark.createDataFrame(rows, LAID)).collect():
        found.setdefault(r["doc_id"], {})[r["seq"]] = r["beside"]
    assert {name: found.get(i, {}) for i, name in enumerate(cases)} == {name: want for name, (_, want) in cases.items()}


def test_sentences_around_the_middle_up_to_the_budget(spark):
    text = "one two. three four. five six. seven eight. nine ten."
    rows = [(1, 0, "text", text, [on(1, 0, 50)]), (1, 1, "table", "T", [on(1, 10, 20)]), (1, 2, "image", "", [on(1, 30, 40)]), (1, 3, "table", "far", [on(9, 0, 1)]), (1, 4, "text", None, [on(1, 48, 49)])]
    got = lambda *budgets: {r["seq"]: r["text"] for r in layout.with_page_context(spark.createDataFrame(rows, LAID), *budgets).collect()}
    assert got(1, 0) == {0: text, 1: " three four.\nT\n five six.", 2: "", 3: "far", 4: None}
    assert got(3, 4)[1] == " three four.\nT\n five six." and got(4, 4)[1] == "one two.\n three four.\nT\n five six.\n seven eight."
    assert got(0, 4)[2] == "one two.\n three four.\n five six.\n seven eight." and got(0, 4)[1] == "T"
    assert got(99, 99)[1] == "one two.\n three four.\nT\n five six.\n seven eight.\n nine ten."
