"""Text to SQL: generated SQL over views that are filtered before it can see them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text

AGGREGATE = re.compile(r"(?i)\b(count|sum|avg|min|max|group\s+by|distinct)\b")


def clean_sql(answer: str) -> str:
    """The statement of a model's answer, without thoughts, fences and the closing semicolon."""
    s = re.sub(r"(?s)<think>.*?</think>", "", answer)
    fenced = re.search(r"(?s)```(?:sql)?\s*(.*?)```", s)
    return (fenced[1] if fenced else s).strip().rstrip(";").strip()


def is_aggregate(sql: str) -> bool:
    return bool(AGGREGATE.search(sql))


def scoped_view(spark: SparkSession, chunks: DataFrame, kb_ids: list[str], name: str = "chunks") -> None:
    """a view with the rows of the given knowledge bases only; no text of a statement is rewritten."""
    chunks.where(F.col("kb_id").isin(kb_ids)).createOrReplaceTempView(name)


def ts_match(column: Column, query: str, share: float = 0.3) -> Column:
    """Whether a text has at least so large a share of a query's tokens."""
    wanted = F.array_distinct(text.tokens(F.lit(re.sub(r"[%`]", "", query))))
    found = F.size(F.array_intersect(text.tokens(column), wanted))
    return found >= F.greatest(F.lit(1), F.floor(share * F.size(wanted)))


_LITERAL = r"'(?:[^'\\]|\\.|'')*'"
_NAME = r"(?:(?:\w+|`[^`]+`)\.)?(?:\b[a-z_]+_l?tks\b|`[a-z_]+_l?tks`)"
_OTHER = rf'--[^\n]*|/\*.*?\*/|{_LITERAL}|"(?:[^"\\]|\\.)*"'
_PREDICATE = re.compile(rf"(?is)(?P<field>{_NAME})\s*(?P<not>\bnot\s+)?(?:\blike\b|=(?!=))\s*(?P<said>{_LITERAL})|(?P<other>{_OTHER}|`[^`]*`)")


def match_predicates(statement: str) -> str:
    """The statement with ``ts_match`` in the place of ``LIKE`` and ``=`` on token fields.

    Comments, other literals and quoted names are passed over; a negated predicate stays negated.
    """

    def put(m: re.Match) -> str:
        return m[0] if m["other"] is not None else f"{'NOT ' if m['not'] else ''}ts_match({m['field']}, {m['said']})"

    return _PREDICATE.sub(put, statement)


def register_match(spark: SparkSession, share: float = 0.3) -> None:
    """``ts_match(field, words)`` as a function of the session: a plain SQL expression, so statements with it stay compiled."""
    tokens = r"regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+', 0)"
    wanted, found = f"array_distinct({tokens.format('words')})", tokens.format("field")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ts_match(field STRING, words STRING) RETURNS BOOLEAN RETURN size(array_intersect({found}, {wanted})) >= greatest(1, floor({share}D * size({wanted})))")


def search_sql(spark: SparkSession, statement: str, share: float = 0.3) -> DataFrame:
    """Runs a statement whose token fields are matched by words."""
    register_match(spark, share)
    return spark.sql(match_predicates(statement))


def answer(spark: SparkSession, question: str, model: Callable[[str, str | None], str], sources: tuple[str, ...] = ("doc_id", "docnm_kwd")) -> tuple[str, DataFrame]:
    """M8: runs the model's statement; an error is shown to the model once, and so are missing source columns of a statement
    that doesn't aggregate. Gives the statement and its lazy result."""
    sql = clean_sql(model(question, None))
    try:
        result = search_sql(spark, sql)
    except Exception as e:
        sql = clean_sql(model(question, str(e)[:500]))
        result = search_sql(spark, sql)
    if not is_aggregate(sql) and not set(sources) <= set(result.columns):
        fixed = clean_sql(model(question, f"missing columns: {', '.join(sources)}"))
        try:
            result, sql = search_sql(spark, fixed), fixed
        except Exception:
            return sql, result
    return sql, result


def render(result: DataFrame, sources: tuple[str, ...] = ("doc_id", "docnm_kwd"), most: int = 20) -> list[str]:
    """The first rows of a result as a Markdown table, sources as numbered marks."""
    shown = [c for c in result.columns if c not in sources]
    cited = len(shown) < len(result.columns)
    rows = result.limit(most).select(text.markdown_row(*shown).alias("_r")).collect()
    head = "|" + "|".join(shown) + ("|Source|" if cited else "|")
    return [head, "|" + "---|" * (len(shown) + cited), *[r[0] + (f" ##{i}$$|" if cited else "") for i, r in enumerate(rows)]]
