"""Golden cases of rules that are easily got nearly right: marks of citations, question words, contents, outlines."""

import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import lexical, retrieval, segment


def test_citation_repair(spark):
    cases = {
        "(ID12) and (ID: 3)": "[ID:12] and [ID:3]", "【ID3】【 ID : 05 】": "[ID:3][ID:05]", "[ ID 7 ] [ID:7] [7]": "[ID:7] [ID:7] [7]",
        "(id: 3) [id:3]": "(id: 3) [id:3]", "REF 4, ref4 Ref　٣": "[ID:4], [ID:4] [ID:٣]", "(ID: 20) 【ID20】 ref 20 [ID: 20]": "(ID: 20) 【ID20】 ref 20 [ID: 20]",
        "(ID: 19)(ID: 020)": "[ID:19](ID: 020)", "(ID:٣٣) (ID:١٩)": "(ID:٣٣) [ID:١٩]", "(ID: 99999999999999999999)": "(ID: 99999999999999999999)", "": "", "no marks": "no marks", "ref": "ref",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "a string, v string")
    got = df.select("a", "v", retrieval.repair_citations(F.col("a"), 20).alias("r")).withColumn("c", retrieval.cited_chunks(F.col("r"), 20)).collect()
    assert [r["r"] for r in got] == [r["v"] for r in got]
    assert [r["c"] for r in got][:5] == [[3, 12], [3, 5], [7], [], [3, 4]]
    many = spark.createDataFrame([("ref 79 ref 80",)], "a string").select(retrieval.repair_citations(F.col("a"), 80)).first()[0]
    assert many == "[ID:79] ref 80"


def test_question_words(spark):
    asked = [
        "what is the dose of aspirin", "Who's the doctor", "请问阿司匹林怎么服用", "高血压是什么", "感冒怎么办", "怎么办", "by the ", "it's on and off in the ward ", "WHICH drug should I take", "no noise", "", "they're out of stock", "哪些药是啥",
    ]

    def expect(t):
        left = t
        for pattern, instead in text.QUESTION_NOISE:
            left = re.sub(pattern, instead, left, flags=re.IGNORECASE)
        return left or t

    df = spark.createDataFrame([(a,) for a in asked], "a string")
    got = {r["a"]: r["v"] for r in df.select("a", text.strip_question_words("a").alias("v")).collect()}
    assert got == {a: expect(a) for a in asked}
    assert got["请问阿司匹林怎么服用"] == "阿司匹林服用" and got["高血压是什么"] == "高血压" and got["怎么办"] == "怎么办" and got["by the "] == " the "


@pytest.mark.parametrize(
    "lines,kept",
    [
        (["intro", "目　录", "", "第一章 总论", "第二章 各论", "第一章 总论", "body"], ["intro", "第一章 总论", "body"]),
        (["contents", "abcd 1", "other 2", "tail"], ["other 2", "tail"]),
        (["contents", "abcd 1", "abcx", "tail"], ["abcx", "tail"]),
        (["Contents", "abcd 1", "abcd"], ["Contents", "abcd 1", "abcd"]),
        (["contents@@3", "(a", "b", "(a text"], ["(a text"]),
        (["x", "acknowledge"], ["x"]), (["contents", "", " "], []), (["致谢", "only"], []), ([""], [""]),
        (["目录", "甲一", "目录", "乙二", "甲一 text"], ["甲一 text"]),
    ],
)
def test_contents(lines, kept):
    assert [s for (s,) in segment.without_contents("\n".join(lines))] == kept


def test_contents_of_english_texts():
    lines = ["contents", "Chapter one: aims", "Chapter two: means", "Chapter one in full"]
    assert [s for (s,) in segment.without_contents("\n".join(lines), english=True)] == lines[2:]
    lines[3] = "Chapter one: in full"
    assert [s for (s,) in segment.without_contents("\n".join(lines), english=True)] == lines[3:]
    far = ["contents", "abc 1", *["x"] * 127, "abc"]
    left = lambda x: len(list(segment.without_contents("\n".join(x), english=False)))
    assert left(far) == 1 and left([*far[:2], "x", *far[2:]]) == 129


OUTLINE = ["preface text", "第一章 甲", "一些 文字", "第一节 乙", "正文 一", "正文 二", "第二节 丙", "第二章 丁", "12", "x", "尾 文"]


def test_outline():
    got = [t for t, _ in segment.tree_paths("\n".join(OUTLINE), 2)]
    assert got == ["preface text", "第一章 甲\n一些 文字\n第一节 乙\n正文 一\n正文 二", "第一章 甲\n一些 文字\n第二节 丙", "第二章 丁\n尾 文"]
    got = [t for t, _ in segment.tree_paths("\n".join(OUTLINE), 1)]
    assert got == ["preface text", "第一章 甲\n一些 文字\n第一节 乙\n正文 一\n正文 二\n第二节 丙", "第二章 丁\n尾 文"]
    # Deeper than there are levels: the last above bodies.
    assert list(segment.tree_paths("\n".join(OUTLINE), 9)) == list(segment.tree_paths("\n".join(OUTLINE), 2))
    titled = [("第一章 甲", ""), ("Aims", "title"), ("body text", "text"), ("This, however, is none", "title"), ("Means", "head")]
    assert [t for t, _ in segment.tree_paths(titled, 2)] == ["第一章 甲\nAims\nbody text\nThis, however, is none", "第一章 甲\nMeans"]
    assert list(segment.tree_paths("no bullets\nhere")) == [("no bullets", 0), ("here", 0)]


def test_hierarchical_chunks():
    got = [t for t, _ in segment.hierarchical_chunks("\n".join(OUTLINE), 5)]
    assert got == ["preface text", "第一章 甲\n一些 文字", "第一章 甲\n第一节 乙\n正文 一", "第一章 甲\n第一节 乙\n正文 二", "第二章 丁\n尾 文", "第一章 甲\n第二节 丙"]
    loose = [f"plain line {i}" for i in range(9)] + ["第一章 甲"]
    assert [t for t, _ in segment.hierarchical_chunks("\n".join(loose), 1, budget=10)] == ["\n".join(loose[i : i + 3]) for i in (0, 3, 6)]
    assert list(segment.hierarchical_chunks("no bullets")) == [] and list(segment.hierarchical_chunks("")) == []


def test_segment_clauses(spark):
    segments = spark.createDataFrame([(1, 0, "糖尿病患者"), (1, 1, "mri"), (1, 300, "late"), (1, 2, "")], "query_id long, seg int, segment string")
    weights = spark.createDataFrame([(1, 0, "糖尿病", 0.75), (1, 0, "患者", 0.25), (1, 1, "mri", 1.0), (1, 300, "late", 1.0)], "query_id long, seg int, token string, weight double")
    synonyms = spark.createDataFrame([("糖尿病患者", "消渴病人"), ("mri", "磁共振"), ("患者", "病人")], "term string, synonym string")
    got = sorted(tuple(r)[1:] for r in lexical.segment_clauses(segments, weights, synonyms).collect())
    assert got == sorted([
        (0, "term", "糖尿病", 3.75), (0, "term", "患者", 1.25), (0, "fine_phrase", "糖尿 尿病", 3.75), (0, "fine_near", "糖尿 尿病", 1.875),
        (0, "token_synonym", "病人", 0.25), (0, "segment_near", "糖尿 尿病 病患 患者", 7.5), (0, "segment_synonym", "消渴病人", 0.7),
        (1, "term", "mri", 5.0), (1, "token_synonym", "磁共振", 1.0), (1, "segment_synonym", "磁共振", 0.7),
    ])


def test_lexicon_weights_of_parts(spark):
    flat = spark.createDataFrame([(1, i, t) for i, t in enumerate(["未知之词", "ab", "北京"])], "query_id long, pos int, token string")
    lexicon = spark.createDataFrame([("未知", 600, 60, None, None), ("知之", 1200, 120, None, None), ("之词", 900, 90, None, None), ("北京", 5, 1, "loca", "ns")], "token string, freq long, df long, name string, tag string")
    from math import log10

    idf = lambda s, n: log10(10 + (n - s + 0.5) / (s + 0.5))
    raw = [0.3 * idf(f, 1e7) + 0.7 * idf(d, 1e9) for f, d in ((100, 63 / 6), (300, 300), (10, 4))]
    raw = [raw[0], 0.01 * raw[1], 9 * raw[2]]
    got = [r["weight"] for r in lexical.lexicon_weights(flat, lexicon).orderBy("pos").collect()]
    assert got == pytest.approx([x / sum(raw) for x in raw])
