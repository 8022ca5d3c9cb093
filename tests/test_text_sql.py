"""Full-text predicates inside statements: what is rewritten, what is left alone, and the rows."""

import pytest

from siltstone.operators import text_sql

CASES = [
    ("SELECT a FROM t WHERE content_ltks LIKE '%x y%'", "SELECT a FROM t WHERE ts_match(content_ltks, '%x y%')"),
    ("where title_tks='it''s'", "where ts_match(title_tks, 'it''s')"),
    (r"where t.`title_tks` = 'a\'b' and x = 1", r"where ts_match(t.`title_tks`, 'a\'b') and x = 1"),
    ("where content_ltks not like 'q'", "where NOT ts_match(content_ltks, 'q')"),
    ("select 'content_ltks = ''x''' as s, \"content_ltks like 'y'\" as d", None),
    ("select 1 -- content_ltks = 'x'\n from t /* title_tks like 'y' */", None),
    ("where content_ltks <> 'x' or content_ltks != 'y' or content_ltks >= 'z' or content_ltks == 'w'", None),
    ("where content = 'x' and my_ltks_2 = 'y' and content_ltks = other", None),
    ("select `content_ltks = 'x'` from t", None),
]


@pytest.mark.parametrize("statement,wanted", CASES)
def test_what_is_rewritten(statement, wanted):
    assert text_sql.match_predicates(statement) == (wanted or statement)


def test_rows_are_those_of_the_column(spark):
    rows = [(1, "The cat's 100% `raw` price", "a"), (2, "nothing here", "b"), (3, None, "c"), (4, "PRICE of cats", "d")]
    df = spark.createDataFrame(rows, "id int, content_ltks string, note string")
    df.createOrReplaceTempView("match_me")
    for said in ("cat price", "%100% raw%", "`raw`", "it''s", "none at all"):
        got = text_sql.search_sql(spark, f"SELECT id FROM match_me WHERE content_ltks LIKE '{said}' AND note <> 'content_ltks = ''x'''", 0.5)
        assert sorted(got.collect()) == sorted(df.where(text_sql.ts_match(df["content_ltks"], said.replace("''", "'"), 0.5)).select("id").collect()), said
