"""Model surface: batched pandas UDFs with injectable providers and deterministic defaults."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed hashed bag of words of unit length: the default provider, the same everywhere."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(c: Column, provider: Embedder = hashing_embedder, batch: int = 16, longest: int = 8191) -> Column:
    """M1, M2: vectors of texts; texts are cut to so many characters before the provider sees them."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in provider(texts[at : at + batch])]
            yield pd.Series([np.asarray(v, np.float32) for v in vectors])

    return run(F.substring(F.coalesce(c, F.lit("")), 1, longest))


def word_overlap(query: str, texts: list[str]) -> list[float]:
    """Share of the query's words that a text has: the default rerank provider."""
    q = set(re.findall(r"\w+", query.lower()))
    return [len(q & set(re.findall(r"\w+", t.lower()))) / max(1, len(q)) for t in texts]


def rerank(query: Column, text: Column, provider: Callable[[str, list[str]], list[float]] = word_overlap) -> Column:
    """M3: scores of (query, text) rows; texts of one query in a batch go to the provider together."""

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=q.index)
        for value, at in q.fillna("").groupby(q.fillna("")).groups.items():
            out.loc[at] = provider(value, t.loc[at].fillna("").tolist())
        return out

    return run(query, text)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_int8(s: pd.Series) -> pd.Series:
    """M4: base64 of signed bytes as a vector."""
    return s.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), np.int8).astype(np.float32))
