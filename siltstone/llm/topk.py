"""Exact top-k search (8): a pivot-distance index with sorted annuli and triangle-inequality bounds.

Pivots are fitted on a bounded sample; every vector is keyed by its nearest pivot and by its distance to it,
cut into annuli. The cells (pivot, annulus) are few and bounded, and their counts, radii and norms bound the inner
product of a query q with any member x: with d the distance, q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and
d(q, x) is at least the gap between d(q, pivot) and the annulus. Each query first expands the cells with the
best bounds until they hold k candidates, which gives its k-th score so far; it then visits only
the cells whose bound reaches that score. Cells are split into blocks by a hash, so that copies of one
vector never meet in one task, and queries are scored in batches against blocks by a matrix product. Vectors travel as
bytes of the narrowest integers that hold all components, one byte a component for scaled unit vectors.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no
part; shorter vectors count as padded with zeros; each row is its own candidate, so a query is not matched with
its own row but is with another row of the same id; fewer than k candidates give fewer rows; equal scores
rank by the smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut

_HITS = "q_row long, query_id long, c_id long, score long"


def scaled(embedding: str = "embedding", factor: int = 64) -> Column:
    """floor(factor * x) of each component as a double; null unless all are finite."""
    x = F.col(embedding)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    return F.when(F.forall(x, finite), F.transform(x, lambda v: F.floor(v.cast("double") * factor).cast("long")))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _unpacked(packed: pd.Series, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), dim).astype(float)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _bounds(q: np.ndarray, cells: dict, pivots: np.ndarray) -> np.ndarray:
    """Upper bounds of the score of each query with the members of each cell."""
    p = pivots[cells["pivot"]]
    norm = (q**2).sum(1)[:, None]
    dot = q @ p.T
    d = np.sqrt(np.maximum(norm + (p**2).sum(1) - 2 * dot, 0))
    gap = np.maximum(np.maximum(d - cells["r_max"], cells["r_min"] - d), 0)
    by_distance = (norm + cells["norm"] - gap**2) / 2
    by_offset = dot + np.sqrt(norm) * cells["r_max"]
    return np.minimum(by_distance, by_offset) * (1 + 1e-9) + 1.0


def _score(k: int, dim: int, kind: str):
    """Best k of a block for each query of a batch; ``floor`` is the score a query has to reach."""

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["c_id", "c_row"], kind="stable")
        x, rows, ids = _unpacked(block["x"], dim, kind), block["c_row"].to_numpy(), block["c_id"].to_numpy()
        bits = max(1, int(len(rows)).bit_length())
        out = []
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            q = _unpacked(part["x"], dim, kind)
            exact = np.abs(q).sum(1).max(initial=0) * np.abs(x).max(initial=0) < 2**53 / (1 << bits)
            s = (q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T
            key = (s << bits) - np.arange(len(rows)) if exact else s
            for i, (row, qid, floor) in enumerate(zip(part["q_row"], part["query_id"], part["floor"], strict=True)):
                good = np.flatnonzero((s[i] >= floor) & (rows != row))
                if len(good) > k:
                    good = good[np.argpartition(-key[i][good], k)[:k]] if exact else good[np.lexsort((good, -s[i][good]))[:k]]
                out.append(pd.DataFrame({"q_row": row, "query_id": qid, "c_id": ids[good], "score": s[i][good]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q_row", "query_id", "c_id", "score")})

    return run


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "v",
    block: int = 2048,
    batch: int = 2048,
    most_pivots: int = 256,
    annuli: int = 4,
    sample: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query row of ``vectors``.

    ``vectors`` has an id and an array of integers; ``sample`` bounds the vectors that pivots are fitted on. There is a pivot
    for 4096 vectors, 8 at least and ``most_pivots`` at most.
    """
    rows = cut(
        vectors.select(F.col(vec_id).cast("long").alias("c_id"), F.col(vector).alias("v"), is_query.alias("is_query"))
        .where("c_id IS NOT NULL AND v IS NOT NULL")
        .withColumn("c_row", F.monotonically_increasing_id())
    )
    spark = vectors.sparkSession
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    names = ["query_id", "rank", "vec_id", "score"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    kind = next(k for k in ("i1", "<i2", "<i4", "<i8") if (most or 0) <= np.iinfo(k).max)
    fitted = rows.orderBy(F.xxhash64("c_id", "v"), "c_row").limit(sample).select("v").toPandas()
    points = np.unique(_matrix(fitted["v"], dim), axis=0)
    pivots = _pivots(points, int(min(most_pivots, max(8, n // 4096))))
    d = np.sqrt(((points[:, None, :] - pivots[None]) ** 2).sum(2).min(1)) if len(points) * len(pivots) * dim < 1 << 26 else np.sqrt(np.array([((p - pivots) ** 2).sum(1).min() for p in points]))
    edges = np.unique(np.quantile(d, np.arange(1, annuli) / annuli))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part.iloc[at : at + 2048] for part in parts for at in range(0, len(part), 2048)):
            x = _matrix(pdf["v"], dim)
            norm = (x**2).sum(1)
            far = norm[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)
            at = far.argmin(1)
            r = np.sqrt(np.maximum(far[np.arange(len(x)), at], 0))
            cell = at * (len(edges) + 1) + np.searchsorted(edges, r)
            yield pdf[["c_id", "is_query", "c_row"]].assign(x=[row.tobytes() for row in x.astype(kind)], cell=cell.astype("int32"), r=r, norm=norm)

    indexed = cut(rows.mapInPandas(assign, "c_id long, is_query boolean, c_row long, x binary, cell int, r double, norm double"))
    # At most most_pivots * annuli cells.
    table = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.max("norm").alias("norm")).orderBy("cell").toPandas()
    cells = {c: table[c].to_numpy() for c in table}
    cells["r_min"], cells["r_max"], cells["pivot"] = cells["r_min"] - 1e-6, cells["r_max"] + 1e-6, cells["cell"] // (len(edges) + 1)
    blocks = np.ceil(cells["n"] / block).astype(int)
    parts = np.ones(len(pivots) * (len(edges) + 1), int)
    parts[cells["cell"]] = blocks
    parts_of = F.element_at(F.array(*[F.lit(int(b)) for b in parts]), F.col("cell") + 1)
    members = indexed.withColumn("part", F.pmod(F.xxhash64("c_row"), parts_of).cast("int"))
    queries = indexed.where("is_query").select(F.col("c_row").alias("q_row"), F.col("c_id").alias("query_id"), "x")
    batches = max(1, math.ceil(queries.count() / batch))

    def visits(first: bool):
        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (part.iloc[at : at + 512] for part in pdfs for at in range(0, len(part), 512)):
                bound = _bounds(_unpacked(pdf["x"], dim, kind), cells, pivots)
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(cells["n"][order], axis=1)
                # The cells before those that already hold k candidates besides the query itself.
                opening = np.zeros(bound.shape, bool)
                np.put_along_axis(opening, order, np.concatenate([np.zeros((len(pdf), 1)), held[:, :-1]], axis=1) < k + 1, axis=1)
                chosen = opening if first else ~opening & (bound >= pdf["floor"].to_numpy()[:, None])
                q, c = np.nonzero(chosen)
                times = blocks[c]
                q, c = np.repeat(q, times), np.repeat(c, times)
                part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, int)
                yield pdf.iloc[q].assign(cell=cells["cell"][c].astype("int32"), part=part.astype("int32"))

        return run

    def evaluate(todo: DataFrame) -> DataFrame:
        keys = ["cell", "part", "batch"]
        todo = todo.withColumn("batch", F.pmod(F.xxhash64("q_row"), F.lit(batches)).cast("int"))
        other = ["m_cell", "m_part", "m_batch"]
        needed = todo.select(*[F.col(a).alias(b) for a, b in zip(keys, other, strict=True)]).distinct()
        data = members.select(F.col("cell").alias("m_cell"), F.col("part").alias("m_part"), "c_id", "c_row", "x").join(needed, other[:2])
        return todo.groupBy(*keys).cogroup(data.groupBy(*other)).applyInPandas(_score(k, dim, kind), _HITS)

    shape = "q_row long, query_id long, x binary, floor long, cell int, part int"
    low = F.lit(-(2**62)).cast("long")
    opened = cut(evaluate(cut(queries.withColumn("floor", low).mapInPandas(visits(True), shape))))
    ranked = Window.partitionBy("q_row").orderBy(F.desc("score"), "c_id")
    kth = opened.withColumn("rn", F.row_number().over(ranked)).where(F.col("rn") == k).select("q_row", F.col("score").alias("floor"))
    rest = queries.join(kth, "q_row", "left").select("q_row", "query_id", "x", F.coalesce("floor", low).alias("floor"))
    found = opened.unionByName(evaluate(cut(rest.mapInPandas(visits(False), shape))))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", F.col("c_id").alias("vec_id"), "score").select(*names)
