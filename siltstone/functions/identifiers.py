"""Functions that Spark has no expression for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_HAN = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def xxh64_id(c: Column) -> Column:
    """Hexadecimal 64-bit xxHash of a text, seed 0."""

    @F.arrow_udf("string")
    def digest(s: pa.Array) -> pa.Array:
        import xxhash

        # Texts are hashed where they lie in the batch.
        return pa.array([xxhash.xxh64(x.as_buffer()).hexdigest() if x.is_valid else None for x in s], pa.string())

    return digest(c)


def _number(text: str | None) -> int:
    t = (text or "").strip().lower()
    if re.fullmatch(r"[+-]?[0-9]+", t):
        return int(t)
    words = re.split(r"[\s-]+", t)
    if all(w in _UNITS or w in _TENS for w in words):
        return sum(_UNITS.index(w) if w in _UNITS else _TENS[w] for w in words)
    if t and all(c in _HAN or c in "十百" for c in t):
        total, digit = 0, 0
        for c in t:
            if c in "十百":
                total, digit = total + (digit or 1) * (10 if c == "十" else 100), 0
            else:
                digit = _HAN[c]
        return total + digit
    if re.fullmatch(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", t) and t:
        values = [_ROMAN[c] for c in t]
        return sum(-v if v < n else v for v, n in zip(values, [*values[1:], 0], strict=True))
    return -1


@F.pandas_udf(T.IntegerType())
def ordinal_number(s: pd.Series) -> pd.Series:
    """An index written in digits, English words, Chinese or Roman numerals; -1 if none."""
    return s.map(_number).astype("int32")


def sha1_mod(c: Column, m: int) -> Column:
    """The whole SHA-1 digest as a number, modulo m."""

    @F.pandas_udf("long")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: int(hashlib.sha1((x or "").encode()).hexdigest(), 16) % m)

    return digest(c)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: _merge(a[k], v) if k in a else v for k, v in b.items()}
    if isinstance(a, list) and isinstance(b, list):
        return a + [x for x in b if x not in a]
    return b


@F.pandas_udf(T.StringType())
def deep_merge(a: pd.Series, b: pd.Series) -> pd.Series:
    """JSON objects merged key by key; lists are united, other values overwritten."""
    return pd.Series([json.dumps(_merge(json.loads(x or "{}"), json.loads(y or "{}")), sort_keys=True, ensure_ascii=False) for x, y in zip(a, b, strict=True)])


def config_digest(config: Column, *parts: Column, ignored: tuple[str, ...] = ("raptor", "graphrag")) -> Column:
    """A digest of a configuration (a map of strings) whatever the order of its keys, and of parts such as the document and its pages.

    Keys that only later steps read are left out; values are told from keys and from absent ones by their lengths.
    """
    kept = F.array_sort(F.filter(F.map_entries(F.coalesce(config, F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin(*ignored)))
    said = F.transform(kept, lambda e: F.concat_ws(":", F.length(e["key"]).cast("string"), e["key"], F.length(e["value"]).cast("string"), e["value"]))
    return F.md5(F.concat_ws("|", F.array_join(said, ";"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
