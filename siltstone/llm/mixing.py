"""Mixing sources to target weights (5): token blocks, multinomial draws by shard and index permutations.

The words of each source, in the order of a hash of their documents, form one stream that is cut into blocks of
``block`` words. Every output shard draws its slots' sources from one multinomial of the targets. Independent
draws miss the targets by the root of their number, so the totals are corrected afterwards: sources above theirs give up
slots of shards drawn at random, and sources below take those over, which leaves shards equal in size and every source within
half a block of its target. A source's slots are numbered shard after shard and map to its blocks through a keyed
pseudorandom permutation of the block numbers, one for each pass over the source: no pass takes a block twice, and
no more passes than the cap are made. Inside a shard slots stand in a keyed random order. Slots and pieces of
documents are joined by (source, block), a key that no hot source shares.

Positions in a stream are prefix sums in two levels: rows are dealt into chunks of a thousand rows or more, at most
65536 chunks a source; chunks are summed, and the sums of the chunks before each chunk are added to the positions
inside it. A source that holds a third of all rows is as many chunks as it needs. Only one row for each source reaches the
driver, and more sources than ``most_sources`` are an error.

Defined results: null and blank texts have size 0 and are never taken; a null source is a source of its own,
ordered last; null ids and repeated rows are rows like others, in an order that follows ids and texts alone; if no source
has words nothing is taken; other columns pass through ``mixed_texts`` and are ignored by ``mix``; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, keep, partitions, unused, words
from siltstone.llm.wordhash import U, Words, slices
from siltstone.llm.wordhash import mix as mixed

#: Chunks a source at most: what one window of chunk sums holds.
CHUNKS = 1 << 16


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of the whole size by weight, none above ``cap`` times its source; the excess is reshared by weight."""
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size) applied to index: a four-round Feistel network that walks its cycles."""
    half = np.ones(len(size), np.int64)
    while (small := (1 << (2 * half)) < size).any():
        half[small] += 1
    mask, out, todo = (1 << half) - 1, index.copy(), np.ones(len(index), bool)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            f = mixed(right.astype(U) ^ mixed(key[todo].astype(U) + U(r * 0x9E3779B9)))
            left, right = right, left ^ ((f & mask[todo].astype(U)).astype(np.int64))
        out[todo] = (left << half[todo]) | right
        todo = out >= size
    return out


def draw(wanted: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots by source and shard: multinomial draws of equal shards, corrected to the totals ``wanted``."""
    rng, total = np.random.default_rng(seed), int(wanted.sum())
    if not total:
        return np.zeros((len(wanted), shards), np.int64)
    size = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    drawn = np.array([rng.multinomial(n, wanted / total) for n in size]).T.astype(np.int64)
    excess = drawn.sum(1) - wanted
    free = np.zeros(shards, np.int64)
    for i in np.flatnonzero(excess > 0):
        given = _without_return(rng, drawn[i], int(excess[i]))
        drawn[i] -= given
        free += given
    for i in np.flatnonzero(excess < 0):
        got = _without_return(rng, free, int(-excess[i]))
        drawn[i] += got
        free -= got
    return drawn


def _without_return(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """n drawn without return from these counts; beyond a total of 10^9 by multinomial draws clipped to what is left."""
    if counts.sum() < 10**9:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros_like(counts)
    while n:
        more = np.minimum(rng.multinomial(n, (counts - out) / (counts - out).sum()), counts - out)
        out, n = out + more, n - int(more.sum())
    return out


def _plan(spark: SparkSession, sources: pd.DataFrame, block: int, cap: float, shards: int, seed: int) -> DataFrame:
    """si, shard, first, n, blocks, at, room: the runs of each source's slots by shard, and where they stand in it."""
    blocks = -(-sources["source_size"].to_numpy() // block)
    size = np.maximum(sources["source_size"].to_numpy(), 1)
    wanted = np.minimum(np.rint(sources["target"].to_numpy() / size * blocks), np.floor(cap) * blocks).astype(np.int64)
    drawn = draw(wanted, shards, seed)
    first, place, room = np.cumsum(drawn, axis=1) - drawn, np.cumsum(drawn, axis=0) - drawn, drawn.sum(0)
    runs = [(int(i), int(k), int(first[i, k]), int(drawn[i, k]), int(blocks[i]), int(place[i, k]), int(room[k])) for i, k in zip(*np.nonzero(drawn), strict=True)]
    return spark.createDataFrame(runs, "si int, shard int, first long, n long, blocks long, at long, room long")


def _key(seed: int, stream: int, at: np.ndarray) -> np.ndarray:
    one = mixed(np.array([seed, stream], U) + U(1))
    return (mixed(one[0] ^ mixed(one[1] ^ mixed(at.astype(U) + U(1)))) >> U(1)).astype(np.int64)


def _slots(plan: DataFrame, seed: int, step: int = 1 << 16) -> DataFrame:
    """si, shard, slot, b, turn: the place of every slot in its shard, its block and its pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for si, shard, first, n, blocks, at, room in pdf.itertuples(index=False):
                slot = np.arange(first, first + n, dtype=np.int64)
                turn, place = slot // blocks, np.arange(at, at + n, dtype=np.int64)
                b = permute(slot % blocks, np.full(n, blocks), _key(seed, int(si), turn))
                order = permute(place, np.full(n, room), _key(~seed & 0xFFFFFFFF, int(shard), np.zeros(n, np.int64)))
                yield pd.DataFrame({"si": np.int32(si), "shard": np.int32(shard), "slot": order, "b": b, "turn": turn.astype("int32")})

    pieces = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("_o"))
    pieces = pieces.select("si", "shard", (F.col("first") + F.col("_o")).alias("first"), F.least(F.lit(step), F.col("n") - F.col("_o")).alias("n"), "blocks", (F.col("at") + F.col("_o")).alias("at"), "room")
    return pieces.repartition(partitions(plan), "si", "shard", "first").mapInPandas(run, "si int, shard int, slot long, b long, turn int")


class Mix:
    """``rows``: _row, the kept columns, size, source_size and target; ``picks``: _row, turn, shard, slot, start, end in words.

    ``sized``: _row, the kept columns, _source, _h (hash of the id), _t (hash of the text) and size, held by the caller.
    """

    def __init__(self, sized: DataFrame, kept: list[str], block: int, cap: float, shards: int, seed: int, weights: tuple[float, ...], most_sources: int):
        spark = sized.sparkSession
        # One row for each source, of which there are ``most_sources`` at most.
        table = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).limit(most_sources + 1).toPandas()
        if len(table) > most_sources:
            raise ValueError(f"there are more than {most_sources} sources")
        table = table.sort_values("_source", key=lambda s: s.map(lambda v: (v is None, v or "")), ignore_index=True)
        table["target"] = targets(table["source_size"].tolist(), [weights[i % len(weights)] for i in range(len(table))], cap)
        shape = "_source string, source_size long, target double, si int, chunks long"
        known = [(None if pd.isna(s) else s, int(z), float(t), i, min(CHUNKS, max(1, -(-int(n) // 1024)))) for i, (s, z, n, t) in enumerate(table.itertuples(index=False))]
        named = spark.createDataFrame(known, shape)
        placed = sized.join(F.broadcast(named), sized["_source"].eqNullSafe(named["_source"])).drop(named["_source"]).withColumn("chunk", F.pmod(F.xxhash64("_h", "_t"), "chunks"))
        self.rows = placed.select("_row", *kept, "size", "source_size", "target")
        self.picks = None
        if not len(table) or not table["source_size"].sum():
            return
        some = placed.where("size > 0")
        sums = some.groupBy("si", "chunk").agg(F.sum("size").alias("s"))
        before = Window.partitionBy("si").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = sums.select("si", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
        # Rows that are equal in all of these differ in nothing that the result shows.
        inside = Window.partitionBy("si", "chunk").orderBy("_h", "size", "_t", "_row").rowsBetween(Window.unboundedPreceding, -1)
        offset = (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("off")
        stream = some.select("_row", "si", "chunk", "_h", "_t", "size").join(chunks, ["si", "chunk"]).select("_row", "si", "size", offset)
        pieces = stream.select("_row", "si", "size", "off", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))).alias("b")).select(
            "_row", "si", "b", F.greatest(F.lit(0), F.col("b") * block - F.col("off")).alias("start"), F.least("size", (F.col("b") + 1) * block - F.col("off")).alias("end")
        )
        slots = _slots(_plan(spark, table, block, cap, shards, seed), seed)
        # The planner takes the slots for as few as the plan's rows; there are as many as blocks.
        self.picks = slots.hint("merge").join(pieces, ["si", "b"]).select("_row", "turn", "shard", "slot", "start", "end")


def _sized(source: str, text: str, doc_id: str) -> list:
    order = [F.xxhash64(F.col(doc_id)).alias("_h"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t")]
    return [F.col(source).alias("_source"), *order, F.size(words(F.col(text))).cast("long").alias("size")]


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", block: int = 128, cap: float = 3.0, shards: int = 64, seed: int = 5,
    weights: tuple[float, ...] = (1, 2, 3), most_sources: int = 65536,
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and n_shards, the number of shards that take
    of it, for every row of ``docs``."""
    name = unused("_id", docs.columns)
    sized = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias(name), *_sized(source, text, doc_id)))
    m = Mix(sized, [name], block, cap, shards, seed, weights, most_sources)
    columns = [F.col(name).alias("doc_id"), "size", "source_size", "target"]
    none = F.lit(0).cast("long")
    if m.picks is None:
        return m.rows.select(*columns, none.alias("taken"), none.alias("n_shards"))
    taken = m.picks.groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"))
    return m.rows.join(taken, "_row", "left").select(*columns, *[F.coalesce(c, none).cast("long").alias(c) for c in ("taken", "n_shards")])


def mixed_texts(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", block: int = 128, cap: float = 3.0, shards: int = 64, seed: int = 5,
    weights: tuple[float, ...] = (1, 2, 3), most_sources: int = 65536, placed: bool = False,
) -> DataFrame:
    """The mixture: the columns of ``docs``, a row for each shard and pass that takes of a document.

    Its text has the words that are taken, as they stand: adjoining blocks in one piece, others parted by a line end. ``placed``
    adds ``shard`` and ``slot``, the first slot there (behind underscores, if ``docs`` has such columns).
    """
    at, picked = unused("_at", docs.columns), unused("_ranges", docs.columns)
    whole = cut(docs.withColumn(at, F.monotonically_increasing_id()))
    names = [unused(c, docs.columns) for c in ("shard", "slot")] if placed else []
    m = Mix(keep(whole.select(F.col(at).alias("_row"), *_sized(source, text, doc_id))), [], block, cap, shards, seed, weights, most_sources)
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` {k}" for n, k in zip(names, ("int", "long"), strict=False)])
    if m.picks is None:
        return docs.sparkSession.createDataFrame([], shape)
    # A text is sent once, with all its ranges.
    ranges = m.picks.groupBy(F.col("_row").alias(at)).agg(F.array_sort(F.collect_list(F.struct("turn", "shard", "start", "end", "slot"))).alias(picked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                place = part.schema.get_field_index(text)
                rows, texts, where = cut_words(part.column(text), part.column(picked).to_pylist())
                columns = [pa.array(texts, pa.string()) if i == place else c.take(pa.array(rows, pa.int64())) for i, c in enumerate(part.columns[:-1])]
                added = [pa.array([w[k] for w in where], kind) for k, kind in zip(range(len(names)), (pa.int32(), pa.int64()), strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, *added], [*part.schema.names[:-1], *names])

    named = whole.join(ranges, at).select(*[F.col(f"`{c}`") for c in docs.columns], picked)
    return named.mapInArrow(run, shape)


def cut_words(texts: pa.Array, ranges: list[list[dict]]) -> tuple[list[int], list[bytes], list[tuple[int, int]]]:
    """The rows of the texts, the parts cut of them by (turn, shard), and the shard and first slot of each part.

    Ranges are sorted by turn, shard and start; adjoining ones are one piece, others are parted by a line end.
    """
    found = Words(texts, hashes=False)
    raw = found.raw.tobytes()
    rows, out, where = [], [], []
    for i, lo, hi in found.texts():
        groups: dict[tuple[int, int], tuple[list[list[int]], list[int]]] = {}
        for r in ranges[i]:
            runs, slots = groups.setdefault((r["turn"], r["shard"]), ([], []))
            slots.append(r["slot"])
            if runs and runs[-1][1] == r["start"]:
                runs[-1][1] = r["end"]
            else:
                runs.append([r["start"], r["end"]])
        for (_, shard), (runs, slots) in groups.items():
            rows.append(i)
            where.append((shard, min(slots)))
            if runs == [[0, hi - lo]]:
                out.append(raw[found.at[i] : found.at[i + 1]])
            else:
                out.append(b"\n".join(raw[found.start[lo + a] : found.end[lo + b - 1]] for a, b in runs))
    return rows, out, where
