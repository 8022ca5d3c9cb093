"""Predicates: builders from request values to Columns, and the metadata filter algebra."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



#: Spellings of the metadata operators.
SPELLINGS = {"is": "=", "==": "=", "not is": "≠", "!=": "≠", ">=": "≥", "<=": "≤"}
COMPARISONS = ("=", "≠", ">", "<", "≥", "≤")
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def available(flag: int, column: str = "available_int") -> Column:
    """1 keeps rows that are not switched off, missing ones too; 0 keeps those switched off."""
    return F.coalesce(F.col(column), F.lit(1)) >= 1 if flag else F.coalesce(F.col(column) < 1, F.lit(False))


def term_filter(df: DataFrame, condition: Mapping[str, object]) -> Column:
    """Equality or membership by column; arrays match any element; empty values are skipped; unknown columns
    match nothing. ``exists`` and ``must_not_exists`` name columns."""
    parts = []
    for key, value in condition.items():
        if key == "exists":
            parts.append(F.col(value).isNotNull() if value in df.columns else F.lit(False))
        elif key == "must_not_exists":
            parts.append(F.col(value).isNull() if value in df.columns else F.lit(True))
        elif key == "available_int":
            parts.append(available(int(value)) if key in df.columns else F.lit(bool(value)))
        elif not value and value is not False:
            continue
        elif key not in df.columns:
            parts.append(F.lit(False))
        else:
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            many = isinstance(df.schema[key].dataType, T.ArrayType)
            parts.append(F.arrays_overlap(F.col(key), F.array(*map(F.lit, values))) if many else F.col(key).isin(values))
    return _all(parts)


def model_filter(df: DataFrame, filters: Mapping[str, object], continuous: tuple[str, ...] = ()) -> DataFrame:
    """pairs on continuous columns are closed ranges with open ends (None), other lists memberships; None and unknown
    columns are skipped; without any usable filter there are no rows."""
    parts = []
    for key, value in filters.items():
        if value is None or key not in df.columns:
            continue
        c = F.col(key)
        if isinstance(value, (list, tuple, set)):
            if key in continuous:
                low, high = list(value)[:2]
                parts += [c >= low] * (low is not None) + [c <= high] * (high is not None)
            else:
                parts.append(c.isin(list(value)))
        else:
            parts.append(c == value)
    return df.where(_all(parts)) if parts else df.limit(0)


_OPERATORS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "%": lambda c, v: c.like(v),
    "^": lambda c, v: c.startswith(v),
    "$": lambda c, v: c.endswith(v),
    "~": lambda c, v: c.rlike(v),
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "is null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "&": lambda c, v: c.bitwiseAND(v) > 0,
}


def operator_filter(conditions: list[tuple[str, str, object]]) -> Column:
    """(column, operator, value) triples, all of which must hold."""
    return _all([_OPERATORS[op](F.col(c), v) for c, op, v in conditions])


def keyword(column: str, word: str) -> Column:
    """contains the word whatever the case; an empty word matches all."""
    return F.lower(F.col(column)).contains(word.lower()) if word else F.lit(True)


def not_equal(column: str, value) -> Column:
    """differs or is missing."""
    return F.col(column).isNull() | (F.col(column) != value)


def advances(old: Column, new: Column) -> Column:
    """whether a progress may replace the old one: failure sticks, completion always wins, else only forwards."""
    return F.coalesce((new >= 1) | ((old != -1) & ((new == -1) | (new > old))), F.lit(True))


def recent(column: str, now: str, seconds: int = 600) -> Column:
    """not older than so many seconds at ``now``."""
    return F.col(column) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(secs=F.lit(seconds))


def clean_label(column: str, longest: int = 12) -> Column:
    """1 to 12 characters, CJK ideographs and Latin letters only."""
    return F.col(column).rlike(r"^[一-龥A-Za-z]+$") & (F.length(column) <= longest)


def noise(block_type: Column, text: Column, times: Column) -> Column:
    """page numbers, bare digits, and short paragraphs found four times or more in their document."""
    return (block_type == "paragraph") & (text.rlike(r"^第?\s*[0-9]+\s*页$") | text.rlike(r"^[0-9]+$") | ((F.length(text) <= 30) & (times >= 4)))


def meta_condition(value: Column, op: str, wanted: str) -> Column:
    """one condition on the text of a metadata value; what can't be compared doesn't match.

    A date is compared only with dates; numbers by value, other texts lower-cased; ``in`` is containment in
    the wanted text.
    """
    op = SPELLINGS.get(op, op)
    low, want = F.lower(value), wanted.lower()
    if op in COMPARISONS:
        compare = {"=": lambda a, b: a == b, "≠": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "≥": lambda a, b: a >= b, "≤": lambda a, b: a <= b}[op]
        if re.match(DATE, wanted.strip()):
            return F.coalesce(F.trim(value).rlike(DATE) & compare(F.trim(value), F.lit(wanted.strip())), F.lit(False))
        number = F.trim(value).try_cast("double")
        try:
            want_number = float(wanted)
        except ValueError:
            return F.coalesce(compare(low, F.lit(want)) if op in ("=", "≠") else F.when(number.isNull(), compare(low, F.lit(want))), F.lit(False))
        mixed = F.lit(op == "≠")
        return F.coalesce(F.when(number.isNotNull(), compare(number, F.lit(want_number))).otherwise(mixed), F.lit(False))
    tests = {
        "contains": low.contains(want),
        "not contains": ~low.contains(want),
        "in": F.lit(want).contains(low),
        "not in": ~F.lit(want).contains(low),
        "start with": low.startswith(want),
        "end with": low.endswith(want),
        "empty": value == "",
        "not empty": value != "",
    }
    return F.coalesce(tests[op], F.lit(False))


def meta_filter(meta: DataFrame, filters: list[dict], logic: str = "and", strict: bool = True) -> DataFrame:
    """Ids of documents whose metadata rows (doc_id, key, value) meet the filters.

    One pass: each row is tagged with the filters it meets and documents count distinct ones. With ``strict`` an AND
    with an unmet filter has no result; otherwise the first operands that are empty are replaced by the next, not
    intersected, as long as nothing has matched yet.
    """
    if not filters:
        return meta.select("doc_id").limit(0)
    tags = F.array_compact(F.array(*[F.when((F.col("key") == f["key"]) & meta_condition(F.col("value"), f["op"], str(f["value"])), F.lit(i)) for i, f in enumerate(filters)]))
    hits = meta.select("doc_id", F.explode(tags).alias("i")).distinct()
    if logic == "or":
        return hits.select("doc_id").distinct()
    counted = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if strict:
        return counted.where(F.col("n") == len(filters)).select("doc_id")
    first = hits.agg(F.min("i").alias("f"))  # one row; filters before the first with any match were replaced
    return counted.join(F.broadcast(first), F.col("n") == len(filters) - F.col("f"), "left_semi").select("doc_id")


def restriction(base: DataFrame | None, matched: DataFrame, mode: str) -> DataFrame | None:
    """a manual filter without matches restricts to the sentinel id -999; an automatic one doesn't restrict.

    Whether there is a restriction at all is the caller's to know, so one match is looked for first.
    """
    if not matched.isEmpty():
        return matched if base is None else base.unionAll(matched)
    return matched.sparkSession.createDataFrame([("-999",)], "doc_id string") if mode == "manual" else base
