"""Texts built so that hashes linear in bytes or words agree: Thue-Morse orders, and words that differ in one place."""

import pyarrow as pa
import pytest

from siltstone.llm import linededup, minhash, substring
from siltstone.llm.wordhash import Words


def order(n, a, b):
    """The first n terms of the Thue-Morse sequence over two things."""
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def built(n):
    """Single words, and lines of words, in the sequence and in its complement."""
    return ["".join(order(n, "a", "b")), "".join(order(n, "b", "a")), " ".join(order(n, "a", "b")), " ".join(order(n, "b", "a")), "\n".join(order(n, "a x", "b x")), "\n".join(order(n, "b x", "a x"))]


def test_lanes_of_words():
    words = [*(w for n in (8, 16, 32, 64, 128, 1024, 4096) for w in built(n)[:2]), *("x" * n for n in range(1, 140)), *("x" * i + "y" + "x" * (69 - i) for i in range(70)), "\x00", "\x00\x00", "a\x00"]
    found = Words(pa.array(words)).lanes
    assert len(set(found[:, 0].tolist())) == len(set(found[:, 1].tolist())) == len(set(words))
    upper = Words(pa.array([w.upper() for w in words]), lower=True).lanes
    assert (upper == Words(pa.array(words), lower=True).lanes).all()


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_documents_in_complementary_orders_stay_apart(spark, n):
    texts = built(n)
    docs = spark.createDataFrame(list(enumerate(texts[:2])), "doc_id long, text string")
    assert all(r["kept"] for r in minhash.near_duplicates(docs, size=3, percent=85).collect())
    assert all(r["n_removed_chars"] == 0 for r in substring.dedup_substrings(docs).collect())
    # Lines of single words: runs of 25 words recur in both orders, whole lines do not.
    lines = spark.createDataFrame(list(enumerate(texts[2:4])), "doc_id long, text string")
    assert all(r["n_removed_chars"] == 0 for r in substring.dedup_substrings(lines, window=n, guard=n).collect())
    blocks = spark.createDataFrame([(0, texts[0] + "\n" + texts[2] + "\nlast"), (1, texts[1] + "\n" + texts[3] + "\nlast")], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in linededup.dedup_lines(blocks).collect())
