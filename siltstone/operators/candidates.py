"""Approximate vector candidates: a stored index of cells and product-quantised codes, re-ranked exactly.

Cells and codebooks are fitted on a bounded sample (``sample`` rows, those of the least digests of their ids); every row
is then put into its nearest cell and coded, so the index holds all rows. A row's code has one byte for each part of its residual from
the cell's centre. Files are Parquet: ``codes`` (ids and codes) and ``vectors`` (ids and unit vectors), in folders by cell; cells
larger than ``part_rows`` are cut into parts by a hash of the id, so that a cell that a third of all rows share is several tasks.

Search sends each question to the parts of its nearest ``probes`` cells, scores codes there by tables of inner products, keeps the best
``refine`` * k of each question, reads these rows' vectors and ranks them by their exact cosine. Questions are a DataFrame and
stay on the executors. ``retrieval.nearest`` is the exact way; ``recall`` compares the two.

Defined results: null vectors and ids take no part; vectors of length zero have cosine 0 with all; equal cosines rank by id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.commits import CommitLog
from siltstone.operators.retrieval import _matrix

_BATCH = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(1) - 2 * x[at : at + _BATCH] @ centres.T).argmin(1) for at in range(0, len(x), _BATCH)]) if len(x) else np.zeros(0, int)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty one moves to a row at random."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, self.path)

    def build(self, vectors: DataFrame, cells: int | None = None, parts: int = 8, codes: int = 256, sample: int = 65_536, part_rows: int = 65_536, seed: int = 7, chunk_id: str = "chunk_id", vector: str = "embedding") -> None:
        """Fits and writes the index. ``cells`` is about the root of the number of rows, 4096 at most, unless it is given."""
        rows = vectors.select(F.col(chunk_id).cast("long").alias("chunk_id"), F.col(vector).alias("v")).where("chunk_id IS NOT NULL AND v IS NOT NULL")
        n = rows.count()
        # What reaches the driver is bounded by ``sample``.
        drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("v").collect()
        if not drawn:
            raise ValueError("there are no vectors to fit cells on")
        x, rng = _unit(np.array([r["v"] for r in drawn], float)), np.random.default_rng(seed)
        dim = x.shape[1]
        centres = _means(x, min(len(x), cells or int(min(4096, max(1, round(n**0.5))))), rng)
        left = x - centres[_nearest(x, centres)]
        bounds = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        books = [_means(left[:, a:b], min(codes, 256, len(x)), rng) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _BATCH):
                    part = batch.slice(at, _BATCH)
                    unit = _unit(_matrix(part.column("v"), part.num_rows))
                    cell = _nearest(unit, centres)
                    residual = unit - centres[cell]
                    code = np.stack([_nearest(residual[:, a:b], book) for a, b, book in zip(bounds[:-1], bounds[1:], books, strict=True)], 1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([part.column("chunk_id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([u.tobytes() for u in unit], pa.binary())], ["chunk_id", "cell", "code", "unit"])

        folder = f"v{seed}-{self.log.version() + 1}"
        placed = rows.mapInArrow(place, "chunk_id long, cell int, code binary, unit binary")
        placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/{folder}")
        stored = self.spark.read.schema("chunk_id long, code binary, unit binary, cell int").parquet(f"{self.path}/{folder}")
        sizes = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}  # a row for each cell
        text = lambda a: base64.b64encode(np.ascontiguousarray(a, float).tobytes()).decode()
        self.log.change(lambda _: {"folder": folder, "dim": dim, "centres": text(centres), "bounds": bounds.tolist(), "books": [text(b) for b in books], "parts": [int(-(-sizes.get(c, 0) // part_rows)) for c in range(len(centres))], "rows": sum(sizes.values())})

    def search(self, queries: DataFrame, k: int, probes: int = 8, refine: int = 8, query_id: str = "query_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
        """query_id, chunk_id and exact cosine of the best k found; fewer where the cells hold fewer."""
        m = self.log.read()
        array = lambda t: np.frombuffer(base64.b64decode(t))
        centres, bounds, n_parts = array(m["centres"]).reshape(-1, m["dim"]), m["bounds"], np.array(m["parts"])
        books = [array(t).reshape(-1, b - a) for t, a, b in zip(m["books"], bounds[:-1], bounds[1:], strict=True)]
        filled = np.flatnonzero(n_parts)
        probes, keep = min(probes, len(filled)), refine * k

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each question and part of its nearest cells."""
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    unit = _unit(_matrix(part.column("v"), part.num_rows))
                    order = filled[np.argsort(-(unit @ centres[filled].T), axis=1, kind="stable")[:, :probes]]
                    i = np.repeat(np.arange(len(unit)), n_parts[order].sum(1))
                    cell = np.repeat(order.ravel(), n_parts[order].ravel())
                    number = np.concatenate([np.arange(p) for p in n_parts[order].ravel()]) if len(cell) else cell
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(i)), pa.array(cell, pa.int32()), pa.array(number, pa.int32()), pa.array([unit[j].tobytes() for j in i], pa.binary())], ["query_id", "q_cell", "q_part", "q"])

        asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("v")).where("query_id IS NOT NULL AND v IS NOT NULL")
        sent = asked.mapInArrow(send, "query_id long, q_cell int, q_part int, q binary")
        stored = self.spark.read.schema("chunk_id long, code binary, unit binary, cell int").parquet(f"{self.path}/{m['folder']}")
        part_of = F.pmod(F.xxhash64("chunk_id"), F.element_at(F.array(*[F.lit(int(max(p, 1))) for p in n_parts]), F.col("cell") + 1)).cast("int")

        def score(rows: pa.Table, mine: pa.Table) -> pa.Table:
            """The best of a part for each question that was sent to it."""
            shape = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("cell", pa.int32()), ("near", pa.float64())])
            if not rows.num_rows or not mine.num_rows:
                return shape.empty_table()
            ids, cell = rows["chunk_id"].to_numpy(), mine["q_cell"][0].as_py()
            code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            out = []
            for qid, q in zip(mine["query_id"].to_pylist(), mine["q"].to_pylist(), strict=True):
                q = np.frombuffer(q)
                near = np.full(len(ids), float(q @ centres[cell]))
                for j, (a, b, book) in enumerate(zip(bounds[:-1], bounds[1:], books, strict=True)):
                    near += (book @ q[a:b])[code[:, j]]
                best = np.argpartition(-near, keep)[:keep] if len(near) > keep else np.arange(len(near))
                out.append(pa.table([pa.array(np.full(len(best), qid)), pa.array(ids[best]), pa.array(np.full(len(best), cell), pa.int32()), pa.array(near[best])], schema=shape))
            return pa.concat_tables(out)

        coded = stored.select("chunk_id", "code", "cell").withColumn("part", part_of)
        found = coded.groupBy("cell", "part").cogroup(sent.groupBy("q_cell", "q_part")).applyInArrow(score, "query_id long, chunk_id long, cell int, near double")
        best = found.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id"))).where(F.col("_rn") <= keep).select("query_id", "chunk_id", "cell")
        exact = best.join(stored.select("chunk_id", "cell", "unit"), ["cell", "chunk_id"]).join(asked, "query_id")

        def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch.column("unit").to_pylist())).reshape(batch.num_rows, -1)
                    cosine = (x * _unit(_matrix(batch.column("v"), batch.num_rows))).sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), pa.array(cosine)], ["query_id", "chunk_id", "cosine"])

        ranked = exact.select("query_id", "chunk_id", "unit", "v").mapInArrow(cosines, "query_id long, chunk_id long, cosine double")
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", digits)), "chunk_id")
        return ranked.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of each question's exact results (query_id, chunk_id) that was found."""
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("n"))
