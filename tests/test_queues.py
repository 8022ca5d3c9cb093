"""Consumer groups, expiring values, statuses and sizes as streams, through failures and restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import queues

MESSAGE, ACK = "msg_id string, payload string, at timestamp", "msg_id string, at timestamp"


def log(spark, path, shape):
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(path))


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def at(s):
    return f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}.000Z"


def drained(stream, path, mode="append"):
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_messages_come_again_until_they_are_acknowledged(spark, tmp_path):
    messages, acks, out = tmp_path / "messages", tmp_path / "acks", tmp_path / "out"
    acks.mkdir()
    put(messages, "a", [{"msg_id": f"m{i}", "payload": f"p{i}", "at": at(i)} for i in range(6)])

    def run(handle):
        given = queues.deliveries(log(spark, messages, MESSAGE), log(spark, acks, ACK), consumers=2, lease_s=30)
        queues.work(given, handle, str(out), str(acks), str(tmp_path / "state")).awaitTermination()

    def dies(batch):
        raise RuntimeError("half-way")

    seen = []

    def even(batch):
        """Acknowledges messages of even numbers, and the others from the third attempt on."""
        seen.extend((r["msg_id"], r["attempt"]) for r in batch.orderBy("msg_id").collect())
        return batch.where("attempt >= 3 OR substring(msg_id, 2, 9) % 2 = 0").select("msg_id", F.upper("payload").alias("answer"))

    with pytest.raises(Exception, match="half-way"):
        run(dies)
    assert not list(acks.glob("*.json"))
    run(even)
    assert sorted(seen) == [(f"m{i}", 1) for i in range(6)]
    for step, name in enumerate("bcde"):
        # Time passes with other messages; a message that is sent again is none.
        put(messages, name, [{"msg_id": f"n{step}0", "payload": "x", "at": at(100 * (step + 1))}, {"msg_id": "m2", "payload": "p2", "at": at(100 * (step + 1))}])
        run(even)
    mine = [x for x in seen if x[0].startswith("m")]
    assert sorted(mine) == sorted([(f"m{i}", 1) for i in range(6)] + [(f"m{i}", n) for i in (1, 3, 5) for n in (2, 3)])
    done = spark.read.parquet(f"{out}/done")
    assert {r["msg_id"]: r["answer"] for r in done.collect() if r["msg_id"][0] == "m"} == {f"m{i}": f"P{i}" for i in range(6)}
    put(messages, "z", [{"msg_id": "late", "payload": "x", "at": at(10)}])
    table = queues.group_info(spark.read.schema(MESSAGE).json(str(messages)), queues.given_rows(spark, str(out)), spark.read.schema(ACK).json(str(acks))).collect()
    assert {r["consumer"] for r in table} == {0, 1, None} and sum(r["acked"] for r in table) == 10 and sum(r["deliveries"] for r in table) == len(seen)
    assert [r["pending"] for r in table if r["consumer"] is None] == [1] and sum(r["pending"] for r in table) == 1


def test_expiring_values_against_a_dictionary(spark, tmp_path):
    rng, commands, held, wanted = random.Random(3), [], {}, {}
    for seq in range(400):
        key, op = rng.choice("abc"), rng.choice(["set", "get", "incrby", "sadd", "srem", "smembers", "zadd", "zadd", "zcount", "zrangebyscore", "zpopmin", "zremrangebyscore", "delete"])
        if op in ("set", "incrby", "delete") and rng.random() < 0.6:
            continue
        low, high = float(rng.randrange(5)), float(rng.randrange(4, 9))
        member = str(rng.randrange(50)) if op == "set" else rng.choice("xyz")
        ttl = rng.choice([None, None, 5.0, 40.0])
        commands.append({"key": key, "seq": seq, "op": op, "member": member, "low": low, "high": high, "ttl_s": ttl, "at": at(3 * seq // 2)})
        now, mine = 1000 * (3 * seq // 2), held.setdefault(key, {"v": None, "s": [], "z": {}, "until": None})
        if mine["until"] is not None and mine["until"] <= now:
            mine.update(v=None, s=[], z={}, until=None)
        answer = queues._apply(mine, op, member, low, high)
        mine["until"] = now + int(1000 * ttl) if ttl else mine["until"]
        if mine["v"] is None and not mine["s"] and not mine["z"]:
            mine["until"] = None
        if op in queues.READS:
            wanted[seq] = (op, json.loads(json.dumps(answer)))
    shape = "key string, seq long, op string, member string, low double, high double, ttl_s double, at timestamp"
    for i in range(0, len(commands), 40):
        put(tmp_path / "log", f"{i:05d}", commands[i : i + 40])
        drained(queues.key_values(log(spark, tmp_path / "log", shape)), tmp_path)
    found = {r["seq"]: (r["op"], json.loads(r["answer"])) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == wanted and any(v[1] == [] for v in wanted.values()) and any(v[1] not in ([], None, 0) for v in wanted.values())


def test_commands_on_one_key():
    held = {"v": None, "s": [], "z": {}}
    say = lambda *x: queues._apply(held, *(x + (None,) * (4 - len(x))))
    for m, v in (("a", 2.0), ("b", 1.0), ("c", 2.0)):
        say("zadd", m, v)
    assert say("zrangebyscore", None, 1.0, 2.0) == ["b", "a", "c"] and say("zcount", None, 2.0, 9.0) == 2 and say("zpopmin", None, 2.0) == [("b", 1.0), ("a", 2.0)]
    assert say("zremrangebyscore", None, 0.0, 9.0) == 1 and held["z"] == {} and say("incrby", None, 3.0) == "3" and say("get") == "3"
    with pytest.raises(ValueError):
        say("nope")


def test_statuses_and_sizes_over_restarts(spark, tmp_path):
    rng, updates, wanted, tasks = random.Random(4), [], [], {}
    for seq in range(200):
        doc, task, value = rng.randrange(6), rng.randrange(3), rng.choice([0.2, 0.5, 0.8, 1.0, 1.0, -1.0])
        updates.append({"doc_id": doc, "task_id": task, "seq": seq, "progress": value})
        mine = tasks.setdefault(doc, {"said": ""})
        was = mine.get(task, 0.0)
        mine[task] = value if value >= 1 or (was != -1 and (value == -1 or value > was)) else was
        values = [v for k, v in mine.items() if k != "said"]
        status = "run" if any(0 <= v < 1 for v in values) else "fail" if -1 in values else "done"
        if status != mine["said"]:
            mine["said"] = status
            wanted.append((doc, seq, status))
    changes = [{"memory_id": rng.randrange(4), "size": rng.randrange(9), "evicted": rng.random() < 0.3} for _ in range(90)]
    for i in range(4):
        put(tmp_path / "u", f"{i}", updates[50 * i : 50 * i + 50])
        put(tmp_path / "c", f"{i}", changes[25 * i : 25 * i + 25])
        drained(queues.document_status(log(spark, tmp_path / "u", "doc_id long, task_id long, seq long, progress double")), tmp_path / "status")
        drained(queues.memory_sizes(log(spark, tmp_path / "c", "memory_id long, size long, evicted boolean")), tmp_path / "sizes", "update")
    assert sorted((r["doc_id"], r["seq"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/status/out").collect()) == sorted(wanted)
    last = spark.read.parquet(f"{tmp_path}/sizes/out").groupBy("memory_id").agg(F.max_by(F.struct("size", "n"), "epoch").alias("r")).collect()
    sums = {}
    for x in changes:
        sign, (size, n) = -1 if x["evicted"] else 1, sums.get(x["memory_id"], (0, 0))
        sums[x["memory_id"]] = (size + sign * x["size"], n + sign)
    assert {r["memory_id"]: tuple(r["r"]) for r in last} == sums
