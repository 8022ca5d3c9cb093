"""Quality classifier (10): a factorisation machine over hashed words, structure statistics and length.

A text's features are its distinct words, hashed into ``dims`` dimensions with counts turned into weights of unit
length, and some twenty statistics of its structure (shares of kinds of characters, word and line lengths,
repeats) and of its length as metadata. The machine has a weight and a vector of ``rank`` factors for each
feature; all pairwise interactions are summed in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

It is fitted by Adam on the logistic loss over at most ``sample`` labelled rows, those of the least hashes of
their ids; only their features, not their texts, reach the driver. The fitted model has a fixed size and goes to the
executors with the function; scoring reads every text once, without a shuffle.

Defined results: null and blank texts have no words and get the score of their statistics; with no labelled rows
every score is 0.5; labels that are null, and ids that are null, are never learned from; of several labels of one
id the lowest counts; rows that repeat are scored each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import unused
from siltstone.llm.wordhash import U, Words, slices

_KINDS = np.full(256, 9, np.int64)
for _k, _set in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "|", "#*$%&<>@_=+~^", "\n")):
    _KINDS[[ord(x) for x in _set]] = _k
_KINDS[0x80:] = 8
N_STATS = 18


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def features(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, indices and values of the distinct hashed words of each text, and the statistics."""
    words = Words(column, lower=False)
    n = len(words.at) - 1
    per_text = np.diff(words.first)
    owner = np.repeat(np.arange(n), per_text)
    key, count = np.unique(owner * dims + (words.hash >> U(20)).astype(np.int64) % dims, return_counts=True)
    row, index = key // dims, key % dims
    value = np.sqrt(count.astype(np.float64))
    norm = np.sqrt(np.bincount(row, value**2, n))
    value /= np.maximum(norm, 1e-12)[row]
    size = np.diff(words.at)
    kinds = np.bincount(np.repeat(np.arange(n) * 10, size) + _KINDS[words.raw], minlength=10 * n).reshape(n, 10)[:, :9]
    many = np.maximum(size, 1)
    nw = np.maximum(per_text, 1)
    length = (words.end - words.start).astype(np.float64)
    chars = np.bincount(owner, length, n)
    squares = np.bincount(owner, length**2, n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    distinct = np.bincount(np.unique(owner.astype(U) << U(40) ^ words.hash >> U(24)) >> U(40), minlength=n)[:n] if len(owner) else np.zeros(n)
    again = np.zeros(n)
    if len(owner) > 1:
        same = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:], same, n)
    lines = kinds[:, 7] + 1
    mean = chars / nw
    stats = np.column_stack(
        (
            kinds / many[:, None],
            distinct / nw,
            again / nw,
            np.log1p(per_text),
            np.log1p(size),
            mean,
            np.sqrt(np.maximum(squares / nw - mean**2, 0)),
            np.log1p(longest),
            np.log1p(per_text / lines),
            np.log1p(lines),
        )
    )
    starts = np.searchsorted(row, np.arange(n + 1))
    return starts, index.astype(np.int32), value, stats


@dataclass
class Machine:
    dims: int
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(starts) - 1
        row = np.repeat(np.arange(n), np.diff(starts))
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        w, v = self.weight, self.factor
        linear = np.bincount(row, w[index] * value, n) + z @ w[self.dims :]
        pair = np.zeros(n)
        for f in range(v.shape[1]):
            x = v[index, f] * value
            s = np.bincount(row, x, n) + z @ v[self.dims :, f]
            q = np.bincount(row, x * x, n) + (z * z) @ (v[self.dims :, f] ** 2)
            pair += (s * s - q) / 2
        return self.bias + linear + pair


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, rank: int, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 10) -> Machine:
    """Adam over mini-batches of (indices, values, statistics); without both labels the machine is constant."""
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, N_STATS))
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    size = dims + N_STATS
    m = Machine(dims, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)), mean, scale)
    if not len(labels):
        m.factor[:] = 0
        return m
    share = (labels.sum() + 1) / (len(labels) + 2)
    m.bias = float(np.log(share / (1 - share)))
    moments = [np.zeros(size), np.zeros(size), np.zeros((size, rank)), np.zeros((size, rank))]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            step += 1
            picked = [rows[i] for i in at]
            n = len(picked)
            row = np.repeat(np.arange(n), [len(p[0]) for p in picked])
            index = np.concatenate([p[0] for p in picked])
            value = np.concatenate([p[1] for p in picked])
            z = np.clip((np.array([p[2] for p in picked]) - mean) / scale, -6, 6)
            starts = np.concatenate(([0], np.cumsum([len(p[0]) for p in picked])))
            p = 1 / (1 + np.exp(-np.clip(m.logits(starts, index, value, np.array([p[2] for p in picked])), -30, 30)))
            g = (p - labels[at]) / n
            gw = np.bincount(index, g[row] * value, size)
            gw[dims:] += g @ z
            gv = np.zeros((size, rank))
            for f in range(rank):
                x = m.factor[index, f] * value
                s = np.bincount(row, x, n) + z @ m.factor[dims:, f]
                gv[:, f] = np.bincount(index, g[row] * value * (s[row] - x), size)
                gv[dims:, f] += (g * s) @ z - (g @ (z * z)) * m.factor[dims:, f]
            m.bias -= rate * float(g.sum())
            for parameter, grad, a, b in ((m.weight, gw, moments[0], moments[1]), (m.factor, gv, moments[2], moments[3])):
                grad += decay * parameter
                a *= 0.9
                a += 0.1 * grad
                b *= 0.999
                b += 0.001 * grad**2
                parameter -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, dims: int = 1 << 13, rank: int = 6, sample: int = 6000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Machine:
    """Fit on at most ``sample`` of the labelled documents outside the held-out fold, one row of each.

    Of several texts of one id the one of the least hash counts. What reaches the driver is bounded by ``sample`` rows of
    ``dims`` words each.
    """
    marked = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").where(~held_out(F.col("_id")))
    chosen = marked.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_t", 1 << 20):
                starts, index, value, stats = features(batch.column("_t"), dims)
                lists = lambda flat: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), lists(index), lists(value), pa.array(list(stats))], ["id", "y", "i", "x", "s"])

    marked = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id")
    picked = marked.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t"), "_t")).alias("m")).select("_id", "_y", "m._t")
    table = picked.mapInArrow(run, "id long, y int, i array<int>, x array<double>, s array<double>").toArrow().sort_by([("id", "ascending")]).combine_chunks()
    lists = [table.column(c).combine_chunks() for c in "ixs"]
    starts = lists[0].offsets.to_numpy() if len(table) else np.zeros(1, np.int32)
    i, x, s = (a.flatten().to_numpy() for a in lists)
    s, at = s.reshape(len(table), N_STATS), starts - starts[0]
    rows = [(i[a:b], x[a:b], s[n]) for n, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    return fit(rows, table.column("y").to_numpy().astype(float), dims, rank)


def classify(docs: DataFrame, machine: Machine, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """score and predicted (1 from the threshold on), their names behind a prefix, after ``columns`` (the id) of every row."""
    dims, name = machine.dims, unused("_text", columns or [doc_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, name, 1 << 20):
                p = 1 / (1 + np.exp(-np.clip(machine.logits(*features(batch.column(name), dims)), -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names[:-1], f"{prefix}score", f"{prefix}predicted"])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns or [doc_id]], F.coalesce(F.col(text), F.lit("")).alias(name))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{shape}, `{prefix}score` double, `{prefix}predicted` int")
