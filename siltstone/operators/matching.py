"""Sums over the terms that questions and chunks share, made where chunks are read.

A batch of questions is a ``Book``: its terms, and for each term the questions that ask for it. Chunks come as arrays of tokens, in
Arrow batches; terms are looked up by hash, and the pairs of a few chunks with all questions are summed at once. So neither a token
nor an addend is a row, and nothing is shuffled to add pairs up. What a task holds is bounded by ``PACK_TEXTS`` and ``SUMMED``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of one packed row.
PACK_TEXTS = 1024
#: Pairs, and addends, that are summed at once.
SUMMED = 1 << 20


class Book(NamedTuple):
    """Distinct tokens; questions' ids and their type; and for token i the rows start[i] to start[i + 1] of (asker, weight)."""

    tokens: pa.Array
    ids: pa.Array
    kind: str
    start: np.ndarray
    asker: np.ndarray
    weight: np.ndarray

    def totals(self) -> np.ndarray:
        return np.bincount(self.asker, self.weight, len(self.ids))


def book(terms: DataFrame, most: int) -> Book | None:
    """The book of ``terms`` (query_id, token, weight); None if they are more than ``most`` rows."""
    rows = terms.select("query_id", "token", F.col("weight").cast("double")).where("token IS NOT NULL").limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    ids = rows["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    tokens = rows["token"].combine_chunks().dictionary_encode()
    # In the order of tokens, so that sums don't depend on how the terms were read.
    at = pc.sort_indices(tokens.dictionary).to_numpy()
    number = np.empty(len(at), np.int64)
    number[at] = np.arange(len(at))
    term, asker, weight = number[tokens.indices.to_numpy()], ids.indices.to_numpy(), rows["weight"].to_numpy()
    order = np.lexsort((weight, term))
    start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(at)))]).astype(np.int64)
    return Book(tokens.dictionary.take(pa.array(at)), ids.dictionary, terms.schema["query_id"].dataType.simpleString(), start, asker[order], weight[order])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, PACK_TEXTS) for b in batches for at in range(0, b.num_rows, PACK_TEXTS))


def found(column: pa.ListArray, tokens: pa.Array, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the known tokens of a list column, one for each occurrence; ``pairs``: of joined neighbours too."""
    flat = column.flatten()
    tokens = tokens.cast(flat.type)
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    look_up = lambda x: pc.index_in(x, value_set=tokens).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, numbers = [row], [look_up(flat)]
    if pairs and len(flat) > 1:
        joined = pc.binary_join_element_wise(flat.slice(0, len(flat) - 1), flat.slice(1), pa.scalar("", flat.type))
        rows.append(row[1:])
        numbers.append(np.where(row[:-1] == row[1:], look_up(joined), -1))
    row, number = np.concatenate(rows), np.concatenate(numbers)
    return row[number >= 0], number[number >= 0]


def summed(row: np.ndarray, term: np.ndarray, values: list[np.ndarray | None], asked: Book, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """For postings in order of their row: row and question of each pair with a common term, sums of weight * value, terms in common."""
    n = len(asked.ids)
    each = asked.start[term + 1] - asked.start[term]
    ends = np.searchsorted(row, np.arange(n_rows + 1))
    added = np.concatenate([[0], np.cumsum(each)])[ends]
    at = 0
    while at < n_rows and n:
        to = max(at + 1, min(at + SUMMED // n, n_rows, int(np.searchsorted(added, added[at] + SUMMED, "right")) - 1))
        mine = slice(ends[at], ends[to])
        times = each[mine]
        i = np.repeat(np.arange(len(times)), times)
        entry = np.arange(len(i)) + (asked.start[term[mine]] - (np.cumsum(times) - times))[i]
        cell = (row[mine][i] - at) * n + asked.asker[entry]
        shared = np.bincount(cell, minlength=(to - at) * n)
        hit = np.flatnonzero(shared)
        weight = asked.weight[entry]
        yield at + hit // n, hit % n, [np.bincount(cell, weight if v is None else weight * v[mine][i], (to - at) * n)[hit] for v in values], shared[hit]
        at = to


def leading(value: np.ndarray, question: np.ndarray, most: int, margin: float) -> np.ndarray:
    """Which pairs are within ``margin`` of their question's ``most``-th value, or above it."""
    order = np.lexsort((-value, question))
    first = np.flatnonzero(np.diff(question[order], prepend=-1))
    size = np.diff(first, append=len(order))
    floor = np.where(size > most, value[order][np.minimum(first + most - 1, len(order) - 1)], -np.inf)
    kept = np.empty(len(order), bool)
    kept[order] = value[order] >= np.repeat(floor, size) - margin
    return kept


def _covers(part: pa.RecordBatch, asked: Book) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, question and token similarity of the pairs of a batch (key, tokens, ...) with a common token or pair of neighbours."""
    row, term = found(part.column(1), asked.tokens, pairs=True)
    n, total = max(1, len(asked.tokens)), asked.totals()
    for at, q, (s,), _ in summed(*np.divmod(np.unique(row * n + term), n), [None], asked, part.num_rows):
        yield at, q, (s + 1e-9) / (total[q] + 1e-9)


def covered(texts: DataFrame, asked: Book, most: int = 0, margin: float = 0.0) -> DataFrame:
    """query_id, chunk_id, tksim of each pair of a question and a row of ``texts`` (key, tokens) with something in common.

    With ``most``, only pairs that may be among so many best ones of their question when they are rounded by less than ``margin``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            for at, q, value in _covers(part, asked):
                if most and len(q):
                    kept = leading(value, q, most, margin)
                    at, q, value = at[kept], q[kept], value[kept]
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q)), part.column(0).take(pa.array(at)), pa.array(value)], ["query_id", "chunk_id", "tksim"])

    return texts.mapInArrow(run, f"query_id {asked.kind}, chunk_id {texts.schema[0].dataType.simpleString()}, tksim double")


def mixed_sums(texts: DataFrame, asked: Book, vectors: np.ndarray, vector_weight: float) -> DataFrame:
    """Of the pairs of ``covered``: query_id, number of pairs n, and sums of |cosine|, of token similarity and of both by weight.

    ``texts``: key, tokens, vector; ``vectors``: unit vectors of the questions in the book's order, zero for none. A task adds up its
    pairs for each question, so pairs are neither rows nor shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, len(asked.ids)))
        for part in _slices(batches):
            known = np.flatnonzero(part.column(2).is_valid().to_numpy(zero_copy_only=False))
            cosines = np.zeros((part.num_rows, len(asked.ids)))
            if len(known) and vectors.size:
                x = part.column(2).take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(known), -1)
                cosines[known] = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ vectors.T
            for at, q, value in _covers(part, asked):
                cosine = cosines[at, q]
                for i, v in enumerate((None, np.abs(cosine), value, vector_weight * cosine + (1 - vector_weight) * value)):
                    sums[i] += np.bincount(q, v, len(asked.ids))
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(some)), pa.array(sums[0][some].astype(np.int64)), *(pa.array(s[some]) for s in sums[1:])], ["query_id", "n", "cosines", "tksim", "mixed"])

    parts = texts.mapInArrow(run, f"query_id {asked.kind}, n long, cosines double, tksim double, mixed double")
    return parts.groupBy("query_id").agg(*[F.sum(x).alias(x) for x in ("n", "cosines", "tksim", "mixed")])


_POSTED = "row binary, term binary, tf binary, len binary"


def posted(chunks: DataFrame, names: list[str], asked: Book) -> DataFrame:
    """Postings of the book's tokens by the thousand chunks: ids, and row, term, tf and len as packed numbers.

    ``chunks``: key and an array of tokens for each of ``names``. A posting is a (row, term), in order, with its count in each field; ``len`` is
    the length of each chunk's fields, -1 for null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(1, len(asked.tokens))
        for part in _slices(batches):
            columns = [part.column(1 + i) for i in range(len(names))]
            keys = [row * n + term for row, term in (found(c, asked.tokens) for c in columns)]
            every = np.unique(np.concatenate(keys))
            tf = np.stack([np.bincount(np.searchsorted(every, k), minlength=len(every)) for k in keys])
            length = np.stack([c.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for c in columns])
            row, term = np.divmod(every, n)
            numbers = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (row, term, tf, length)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)])), *numbers], ["ids", "row", "term", "tf", "len"])

    return chunks.mapInArrow(run, f"ids array<{chunks.schema[0].dataType.simpleString()}>, {_POSTED}")


def _unposted(batch: pa.RecordBatch, at: int, n_fields: int) -> list[np.ndarray]:
    row, term, tf, length = (np.frombuffer(batch.column(name)[at].as_buffer(), "<i4").astype(np.int64) for name in ("row", "term", "tf", "len"))
    return [row, term, tf.reshape(n_fields, -1), length.reshape(n_fields, -1)]


def posted_counts(packs: DataFrame, n_fields: int, n_tokens: int) -> DataFrame:
    """One row of arrays for all packs: ``df`` of each field and token, as n_fields * n_tokens numbers, and chunks and length of each field;
    and the number n of chunks with any field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, sums, n = np.zeros((n_fields, n_tokens), np.int64), np.zeros((2, n_fields), np.int64), 0
        for batch in batches:
            for at in range(batch.num_rows):
                _, term, tf, length = _unposted(batch, at, n_fields)
                for f in range(n_fields):
                    df[f] += np.bincount(term[tf[f] > 0], minlength=n_tokens)
                sums += np.stack([(length >= 0).sum(1), length.clip(0).sum(1)])
                n += int((length >= 0).any(0).sum())
        flat = np.concatenate([df.ravel(), sums.ravel(), [n]])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["at", "n"])

    # All columns, as for scoring, so that the packs are made once for both.
    each = packs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return each.agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))


def scored(packs: DataFrame, counts: DataFrame, boosts: list[float], asked: Book, similarity: Callable[..., np.ndarray]) -> DataFrame:
    """V6-V8: query_id, chunk_id, score (the best field's sum) and n_matched of each pair with a common token.

    ``similarity``: of tf, df, n, length and mean length of a field.
    """
    n_fields, n_tokens = len(boosts), len(asked.tokens)
    kind = packs.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                row, term, tf, length = _unposted(batch, i, n_fields)
                flat = np.zeros(n_fields * (n_tokens + 2) + 1)
                flat[batch.column("c_at")[i].values.to_numpy()] = batch.column("c_n")[i].values.to_numpy()
                df, (chunks, total), n = flat[: n_fields * n_tokens].reshape(n_fields, -1), flat[n_fields * n_tokens : -1].reshape(2, -1), flat[-1]
                values = []
                for f, boost in enumerate(boosts):
                    value, has = np.zeros(len(row)), tf[f] > 0
                    value[has] = boost * similarity(tf[f][has], df[f][term[has]], n, length[f][row[has]], total[f] / max(1.0, chunks[f]))
                    values.append(value)
                for at, q, sums, shared in summed(row, term, values, asked, len(ids)):
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q)), ids.take(pa.array(at)), pa.array(np.max(sums, axis=0)), pa.array(shared.astype(np.int32))], ["query_id", "chunk_id", "score", "n_matched"])

    met = packs.crossJoin(F.broadcast(counts.select(F.col("at").alias("c_at"), F.col("n").alias("c_n"))))
    return met.mapInArrow(run, f"query_id {asked.kind}, chunk_id {kind}, score double, n_matched int")
