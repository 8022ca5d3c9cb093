"""The learned lexicon and the best path, against all paths of short runs and a corpus whose words are known."""

import math
import random
from collections import Counter

from siltstone.operators import lexicon


def ways(run):
    if not run:
        yield []
    for i in range(1, len(run) + 1):
        for rest in ways(run[i:]):
            yield [run[:i], *rest]


def test_best_path_of_all():
    rng = random.Random(6)
    for _ in range(150):
        words = {"".join(rng.choice("天地人和") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))}
        trie, total = lexicon.Trie(list(words.items())), sum(words.values())
        run = "".join(rng.choice("天地人和大") for _ in range(rng.randrange(1, 9)))
        weight = lambda w: math.log(words[w] / total) if w in words else math.log(0.5 / total)  # noqa: B023, E731
        allowed = [p for p in ways(run) if all(w in words or len(w) == 1 for w in p)]
        assert trie.path(run) == max(allowed, key=lambda p: (round(sum(map(weight, p)), 8), -len(p), [len(w) for w in p]))


def corpus(n=700):
    """Sentences without blanks of words drawn at random."""
    rng = random.Random(9)
    script = [chr(0x4E00 + 97 * i) for i in range(60)]
    words = ["".join(rng.sample(script, rng.choice([1, 2, 2, 3]))) for _ in range(60)]
    return words, [[rng.choice(words) for _ in range(rng.randrange(4, 12))] for _ in range(n)]


def test_words_of_a_corpus_are_found(spark):
    words, said = corpus()
    texts = spark.createDataFrame([(i, "".join(s) + " Abc 12") for i, s in enumerate(said)] + [(-1, None), (-2, "")], "doc_id int, text string")
    learned = lexicon.learn_words(texts)
    found = {r["word"]: r for r in learned.collect()}
    counts = Counter("".join(s)[i : i + n] for s in said for n in (1, 2, 3, 4) for i in range(len("".join(s)) - n + 1))
    assert all(r["n"] == counts[w] for w, r in found.items())
    long = {w for w in words if len(w) > 1}
    assert len(long & set(found)) >= 0.9 * len(long)
    got = {r["doc_id"]: r["segments"] for r in lexicon.segmented(texts, learned).collect()}
    assert got[-1] == got[-2] == [] and got[0][-2:] == ["abc", "12"]
    ends = lambda s: {sum(map(len, s[: i + 1])) for i in range(len(s))}
    right = sum(len(ends(s) & ends(got[i][:-2])) for i, s in enumerate(said))
    assert right / sum(len(ends(s)) for s in said) > 0.9 and right / sum(len(ends(got[i][:-2])) for i in range(len(said))) > 0.9


def test_cohesion_and_freedom_by_hand(spark):
    texts = spark.createDataFrame([("甲乙丙",), ("丁甲乙",), ("甲乙",), ("丙丁",)], "text string")
    row = lexicon.learn_words(texts, least=1, cohesion=-99, freedom=-99).where("word = '甲乙'").first()
    assert row["n"] == 3 and abs(row["cohesion"] - math.log(3 * 10 / (3 * 3))) < 1e-12
    # Before: the beginning twice, 丁 once; behind: the end twice, 丙 once.
    assert abs(row["freedom"] - (math.log(3) - 2 * math.log(2) / 3)) < 1e-12
