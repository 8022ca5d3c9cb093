"""Streaming: task logs, progress, rates and memories as Structured Streaming queries.

Offsets and state live in the checkpoint folder of each query, so a lost executor or a restart replays what was not
committed; sinks are idempotent by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def task_log(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """An append-only log of JSON tasks as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def consume(tasks: DataFrame, handle: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, time: str, key: str = "task_id", ttl: str = "7 days"):
    """At-least-once delivery with an idempotent sink: a batch's results are written to a folder of its own, and a
    replayed batch overwrites it. Tasks that came before are known by the query's state, within ``ttl`` of their event time
    ``time``, and not by reading results."""
    once = tasks.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])

    def run(batch: DataFrame, epoch: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(updates: DataFrame, key: str = "task_id", value: str = "progress") -> DataFrame:
    """The progress of each task: it only advances, a failure (-1) sticks, and completion always wins.

    None of these depends on the order of updates, so the state is a largest value and whether any failed, whatever batches bring.
    """
    said = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    folded = updates.groupBy(key).agg(F.max(said).alias("_most"), F.max(said == -1).alias("_failed"))
    now = F.when(F.col("_most") >= 1, F.col("_most")).when(F.col("_failed"), F.lit(-1.0)).otherwise(F.greatest(F.coalesce("_most", F.lit(0.0)), F.lit(0.0)))
    return folded.select(key, now.alias(value))


def rate_limited(requests: DataFrame, capacity: float, per_second: float, key: str = "client", time: str = "ts") -> DataFrame:
    """A token bucket for each client: whether each request passes, and the tokens left."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = []
        for pdf in parts:
            for t in pdf[time].sort_values():
                at = t.timestamp()
                tokens = min(capacity, tokens + (at - last) * per_second) if last is not None else tokens
                last = at
                ok = tokens >= 1
                tokens -= ok
                rows.append((k[0], t, bool(ok), float(tokens)))
        state.update((float(tokens), last))
        yield pd.DataFrame(rows, columns=[key, time, "passed", "tokens"])

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {time} timestamp, passed boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def deltas(stream: DataFrame, by: str, seq: str, piece: str, least: int = 16) -> DataFrame:
    """Pieces of an answer joined into deltas of ``least`` characters or more; markers of thinking stand alone."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        rows = []
        for pdf in parts:
            for p in pdf.sort_values(seq)[piece]:
                marker = p in ("<think>", "</think>")
                if not marker:
                    held += p
                if held and (marker or len(held) >= least):
                    rows.append((k[0], n, held))
                    held, n = "", n + 1
                if marker:
                    rows.append((k[0], n, p))
                    n += 1
        state.update((held, n))
        yield pd.DataFrame(rows, columns=[by, "n", "delta"])

    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).applyInPandasWithState(fold, f"{by} {kind}, n int, delta string", "held string, n int", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, width: str, late: str, by: str, *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Extension: counts by event-time windows with a watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, by).agg(*(aggregates or (F.count(F.lit(1)).alias("n"),)))
