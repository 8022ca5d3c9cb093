"""Queues with acknowledgement and a store of expiring values, as keyed state of Structured Streaming.

Time is the events' own: leases and times to live run out when the watermark passes them, so a stream that is replayed decides alike.
State is kept by message or key and ends with it: no query here remembers for ever.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_DELIVERY = "msg_id string, payload string, consumer int, attempt int, at timestamp"


def _ms(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


#: Groups of messages whose state is held together: a batch has few calls of Python, and a group few messages (about 10,000 of five million).
BUCKETS = 512
_HELD = pa.schema([("msg_id", pa.string()), ("payload", pa.string()), ("attempt", pa.int32()), ("acked", pa.bool_()), ("until", pa.int64())])


def _held(state: GroupState) -> pd.DataFrame:
    """The messages of a bucket's state, by id."""
    table = pa.ipc.open_stream(bytes(state.get[0])).read_all() if state.exists else _HELD.empty_table()
    return table.to_pandas().set_index("msg_id")


def _hold(messages: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(pa.Table.from_pandas(messages.reset_index(), _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def deliveries(messages: DataFrame, acks: DataFrame, consumers: int = 1, lease_s: float = 30.0, remember_s: float = 86_400.0, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """G1: what a group's consumers are given: each message once, and again each time its lease ends without an acknowledgement.

    ``messages``: msg_id, payload, at; ``acks``: msg_id, at. A message is pending from its delivery to its acknowledgement, on a consumer
    by its id; each new attempt goes to the next one. An acknowledged id is remembered for ``remember_s``, so that a message
    that is sent again, or an acknowledgement that comes first, brings no delivery. State is by bucket of messages, all of which a batch folds
    at once, so no group is one task; ``buckets`` is fixed for a checkpoint.
    """
    both = messages.select("msg_id", "payload", "at", F.lit(False).alias("ack")).unionByName(acks.select("msg_id", F.lit(None).cast("string").alias("payload"), "at", F.lit(True).alias("ack")))

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, watermark = _held(state), state.getCurrentWatermarkMs()
        came = [] if state.hasTimedOut else [p for p in parts if len(p)]
        rows = pd.concat(came) if came else pd.DataFrame({"msg_id": [], "payload": [], "at": pd.to_datetime([]), "ack": np.zeros(0, bool)})
        rows = rows.assign(_ms=rows["at"].astype("datetime64[ms]").astype("int64")).sort_values("_ms", kind="stable")
        by = rows.groupby("msg_id", sort=False)
        met = pd.DataFrame({"now": by["_ms"].max().clip(lower=watermark), "said": by["ack"].any()})
        sent = rows.loc[~rows["ack"].astype(bool)].drop_duplicates("msg_id").set_index("msg_id")["payload"]
        # Ids that neither come nor run out stay as they are; acknowledged ones that run out are forgotten.
        late_ids = held.index[(held["until"] < watermark) & ~held.index.isin(met.index)]
        gone = late_ids[held.loc[late_ids, "acked"].to_numpy(bool)]
        again = late_ids.difference(gone, sort=False)
        todo = pd.concat([met, pd.DataFrame({"now": watermark, "said": False}, index=again)]) if len(again) else met
        stay = held.drop(index=todo.index.intersection(held.index).union(gone))
        now = held.reindex(todo.index)
        attempt, was = now["attempt"].fillna(0).astype(int), now["acked"].eq(True)
        new = todo.index.isin(sent.index) & (attempt == 0).to_numpy()
        acked = was | todo["said"].astype(bool)
        payload = now["payload"].where(~new, sent.reindex(todo.index))
        given = (new | todo.index.isin(again)) & ~acked
        attempt = attempt + given
        moment = todo["now"].astype("int64")
        until = moment + np.where(acked, int(1000 * remember_s), int(1000 * lease_s)) + 1
        # An acknowledged message isn't given again, so its payload isn't kept.
        done = pd.DataFrame({"payload": payload.where(~acked, None), "attempt": attempt, "acked": acked, "until": until})
        kept = pd.concat([x for x in (stay, done) if len(x)]).rename_axis("msg_id") if len(stay) or len(done) else stay
        if len(kept):
            state.update((_hold(kept),))
            state.setTimeoutTimestamp(max(int(kept["until"].min()), watermark + 1))
        elif state.exists:
            state.remove()
        if given.any():
            ids = todo.index[given]
            home = np.array([int(hashlib.md5(i.encode()).hexdigest()[:8], 16) for i in ids])
            yield pd.DataFrame({"msg_id": ids, "payload": payload[given].to_numpy(), "consumer": (home + attempt[given].to_numpy() - 1) % consumers, "attempt": attempt[given].to_numpy(), "at": pd.to_datetime(moment[given].to_numpy(), unit="ms")})

    dealt = both.where("msg_id IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("msg_id"), F.lit(buckets)))
    return dealt.withWatermark("at", late).groupBy("bucket").applyInPandasWithState(fold, _DELIVERY, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def work(given: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, acks: str, checkpoint: str):
    """Hands batches of deliveries to ``handle`` and acknowledges the ids that it returns (column msg_id).

    Results go to a folder for each batch, which a replayed batch overwrites, and acknowledgements follow them; if the handler fails, neither is
    written, and the restarted query hands the same batch out again. Acknowledgements that the stream hasn't read yet are looked up
    for messages that come again, so none comes after its own.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # before its first use, or the fold runs once more
        whole = batch
        if not batch.where("attempt > 1").isEmpty():
            known = batch.sparkSession.read.schema("msg_id string").json(acks).join(batch.where("attempt > 1").select("msg_id"), "msg_id", "left_semi")
            batch = batch.join(known.distinct(), "msg_id", "left_anti")
        batch.write.mode("overwrite").json(f"{out}/given/epoch={epoch}")
        done = handle(batch)
        done.write.mode("overwrite").parquet(f"{out}/done/epoch={epoch}")
        stored = batch.sparkSession.read.schema(done.schema).parquet(f"{out}/done/epoch={epoch}")
        stored.join(batch.select("msg_id", "at"), "msg_id").select("msg_id", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("at")).distinct().write.mode("append").json(acks)
        whole.unpersist()

    return given.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def given_rows(spark: SparkSession, out: str) -> DataFrame:
    """All deliveries that ``work`` has handed out."""
    return spark.read.schema(_DELIVERY + ", epoch long").json(f"{out}/given")


def group_info(messages: DataFrame, given: DataFrame, acks: DataFrame) -> DataFrame:
    """By consumer: messages pending and acknowledged, deliveries, the oldest pending one; and, with a null consumer, the lag."""
    last = given.groupBy("msg_id").agg(F.max_by("consumer", "attempt").alias("consumer"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    known = last.join(acks.select("msg_id").distinct().withColumn("_acked", F.lit(True)), "msg_id", "left")
    waits = F.col("_acked").isNull()
    by = known.groupBy("consumer").agg(F.count_if(waits).alias("pending"), F.count_if(~waits).alias("acked"), F.sum("n").alias("deliveries"), F.min(F.when(waits, F.col("first"))).alias("oldest"))
    lag = messages.select("msg_id").distinct().join(given.select("msg_id").distinct(), "msg_id", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    zero = F.lit(0).cast("long")
    return by.unionByName(lag.select(F.lit(None).cast("int").alias("consumer"), "pending", zero.alias("acked"), zero.alias("deliveries"), F.lit(None).cast("timestamp").alias("oldest")))


def _apply(held: dict, op: str, member: str | None, low: float | None, high: float | None) -> object:
    """One command on the values of a key: plain value ``v``, set ``s``, sorted set ``z``; what it answers."""
    z, ranked = held["z"], lambda: sorted(held["z"].items(), key=lambda x: (x[1], x[0]))
    if op == "set":
        held["v"] = member
    elif op == "incrby":
        held["v"] = str(int(held["v"] or 0) + int(low))
        return held["v"]
    elif op == "get":
        return held["v"]
    elif op == "sadd":
        held["s"] = sorted({*held["s"], member})
    elif op == "srem":
        held["s"] = [m for m in held["s"] if m != member]
    elif op == "smembers":
        return held["s"]
    elif op == "zadd":
        z[member] = low
    elif op == "zcount":
        return sum(low <= v <= high for v in z.values())
    elif op == "zrangebyscore":
        return [m for m, v in ranked() if low <= v <= high]
    elif op == "zpopmin":
        first = ranked()[: int(low)]
        for m, _ in first:
            del z[m]
        return first
    elif op == "zremrangebyscore":
        gone = [m for m, v in z.items() if low <= v <= high]
        for m in gone:
            del z[m]
        return len(gone)
    elif op == "delete":
        held.update(v=None, s=[], z={})
    else:
        raise ValueError(f"unknown command {op}")
    return None


READS = ("get", "incrby", "smembers", "zcount", "zrangebyscore", "zpopmin", "zremrangebyscore")


def key_values(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Values, sets and sorted sets that expire, by key: (key, seq, op, answer as JSON) of each command that reads.

    ``commands``: key, seq, op, member, low, high, ttl_s, at. A key's commands run in the order of (at, seq); one with ``ttl_s`` sets the time to
    live of all the key holds anew, from its own time on. What has expired before a command's time isn't there for it; state goes when the
    watermark passes its time.
    """

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        empty = lambda: {"v": None, "s": [], "z": {}, "until": None}
        held, out = json.loads(state.get[0]) if state.exists else empty(), []
        rows = pd.concat(list(parts)).sort_values(["at", "seq"])
        for seq, op, member, low, high, ttl, at in rows[["seq", "op", "member", "low", "high", "ttl_s", "at"]].itertuples(index=False):
            now = _ms(at)
            if held["until"] is not None and held["until"] <= now:
                held = empty()
            answer = _apply(held, op, member, low, high)
            if ttl is not None and not pd.isna(ttl):
                held["until"] = now + int(1000 * ttl)
            if op in READS:
                out.append((k[0], seq, op, json.dumps(answer, ensure_ascii=False)))
        if held["v"] is None and not held["s"] and not held["z"]:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            if held["until"] is not None and held["until"] > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(held["until"])
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "op", "answer"])

    kind = commands.schema["key"].dataType.simpleString()
    return commands.withWatermark("at", late).groupBy("key").applyInPandasWithState(fold, f"key {kind}, seq long, op string, answer string", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def document_status(updates: DataFrame) -> DataFrame:
    """A document's status from the progress of its tasks, only when it changes: (doc_id, seq, status, progress).

    ``updates``: doc_id, task_id, seq, progress. Tasks only advance, -1 is a failure, 1 the end. A document runs until every task has ended;
    it has failed if any task has then, and is done otherwise. Its progress is the mean of its tasks', failures counting 0.
    """

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tasks, said = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, "")
        out = []
        for seq, task, value in pd.concat(list(parts)).sort_values("seq")[["seq", "task_id", "progress"]].itertuples(index=False):
            was = tasks.get(str(task), 0.0)
            if value >= 1 or (was != -1 and (value == -1 or value > was)):
                tasks[str(task)] = float(value)
            else:
                tasks.setdefault(str(task), was)
            values = tasks.values()
            ended = all(v >= 1 or v == -1 for v in values)
            status = "run" if not ended else "fail" if -1 in values else "done"
            if status != said:
                said = status
                out.append((k[0], int(seq), status, sum(min(max(v, 0.0), 1.0) for v in values) / len(values)))
        state.update((json.dumps(tasks), said))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "seq", "status", "progress"])

    kind = updates.schema["doc_id"].dataType.simpleString()
    return updates.groupBy("doc_id").applyInPandasWithState(fold, f"doc_id {kind}, seq long, status string, progress double", "tasks string, said string", "append", GroupStateTimeout.NoTimeout)


def memory_sizes(changes: DataFrame) -> DataFrame:
    """The running size and number of messages of each memory, as an updated table: ``changes`` are memory_id, size, and ``evicted``
    where a message leaves."""
    sign = F.when(F.col("evicted"), -1).otherwise(1)
    return changes.groupBy("memory_id").agg(F.sum(sign * F.col("size")).alias("size"), F.sum(sign).alias("n"))
