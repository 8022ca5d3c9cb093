"""Sources, sinks and streams against their batch meaning."""

import json
import os

from pyspark.sql import functions as F

from siltstone.sources import readers, writers
from siltstone.streaming import tasks


def put(path, name, content):
    path.mkdir(exist_ok=True)
    mode = "wb" if isinstance(content, bytes) else "w"
    with (path / name).open(mode) as f:
        f.write(content)


def test_readers(spark, tmp_path):
    put(tmp_path / "arr", "a.json", json.dumps([{"title": "t", "ask": "q"}, {"title": "u", "ask": "r"}]))
    rows = readers.json_arrays(spark, str(tmp_path / "arr"), "title string, ask string", limit=1).collect()
    assert [(r["title"], r["source_file"], r["source_row_index"]) for r in rows] == [("t", "a.json", 1)]
    put(tmp_path / "qa", "a.jsonl", '{"instruction": "q1", "output": "a1"}\n\nbad\n{"问题": "q2", "答案": "a2"}\n{"q": "only"}\n')
    assert sorted(tuple(r) for r in readers.qa_pairs(spark, str(tmp_path / "qa")).collect()) == [("q1", "a1"), ("q2", "a2")]
    assert readers.qa_pairs(spark, str(tmp_path / "qa"), skip=1).count() == 1
    put(tmp_path / "txt", "a.txt", "q1\ta1\nmore\nq2\ta2\n")
    assert [tuple(r) for r in readers.text_questions(spark, str(tmp_path / "txt")).collect()] == [("q1", "a1\nmore"), ("q2", "a2")]
    put(tmp_path / "bin", "x.txt", "中文".encode("gb18030"))
    assert readers.decoded(spark, str(tmp_path / "bin")).first()["text"] == "中文"
    listed = readers.files(spark, str(tmp_path / "bin"))
    assert listed.first()["bytes"] == 4 and readers.files(spark, str(tmp_path / "bin"), done=listed).count() == 0
    put(tmp_path / "csv", "a.csv", "question,answer\n1,2\n")
    assert tuple(readers.csv_dialogues(spark, str(tmp_path / "csv")).first()) == ("1", "2")


def test_writers_can_run_again(spark, tmp_path):
    rows = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("shard"))
    for _ in range(2):
        writers.shards(rows, str(tmp_path / "s"), ["shard"], ["id"])
    assert spark.read.json(str(tmp_path / "s")).count() == 10
    assert writers.resume(rows, str(tmp_path / "p"), "id") == 10 and writers.resume(rows, str(tmp_path / "p"), "id") == 0


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("update" if name == "progress" else "append").trigger(availableNow=True).start()
    q.awaitTermination()


def source(spark, tmp_path, name, batches, schema):
    for i, rows in enumerate(batches):
        put(tmp_path / name, f"{i}.json", "\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / name / f"{i}.json", (1_700_000_000 + i,) * 2)  # files are read in the order of their times
    return tasks.task_log(spark, str(tmp_path / name), schema)


def test_progress_folds_in_order(spark, tmp_path):
    batches = [[{"task_id": "a", "seq": 1, "progress": 0.5}, {"task_id": "b", "seq": 1, "progress": -1.0}], [{"task_id": "a", "seq": 2, "progress": 0.2}, {"task_id": "b", "seq": 2, "progress": 0.9}], [{"task_id": "b", "seq": 3, "progress": 1.0}]]
    drain(tasks.progress(source(spark, tmp_path, "pr", batches, "task_id string, seq int, progress double")), "progress")
    rows = spark.table("progress").collect()
    assert [r["progress"] for r in rows if r["task_id"] == "a"][-1] == 0.5
    assert [r["progress"] for r in rows if r["task_id"] == "b"] == [-1.0, -1.0, 1.0]


def test_rate_limit_and_deltas(spark, tmp_path):
    times = [{"client": "x", "ts": f"2024-01-01T00:00:0{i}Z"} for i in (0, 0, 0, 5)]
    drain(tasks.rate_limited(source(spark, tmp_path, "rl", [times], "client string, ts timestamp"), 2, 0.5), "limits")
    assert sorted(r["passed"] for r in spark.table("limits").collect()) == [False, True, True, True]
    pieces = [{"s": "a", "seq": i, "p": p} for i, p in enumerate(["<think>", "12345678", "90123456", "</think>", "rest"])]
    drain(tasks.deltas(source(spark, tmp_path, "dl", [pieces], "s string, seq int, p string"), "s", "seq", "p"), "deltas")
    assert [r["delta"] for r in spark.table("deltas").orderBy("n").collect()] == ["<think>", "1234567890123456", "</think>"]


def test_tasks_are_handled_once(spark, tmp_path):
    log = source(spark, tmp_path, "tl", [[{"task_id": "a"}, {"task_id": "b"}], [{"task_id": "b"}, {"task_id": "c"}]], "task_id string")
    tasks.consume(log.withColumn("at", F.to_timestamp(F.lit("2024-01-01"))), lambda df: df, str(tmp_path / "done"), str(tmp_path / "cp"), "at").awaitTermination()
    assert sorted(r["task_id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["a", "b", "c"]


def test_event_windows(spark, tmp_path):
    events = source(spark, tmp_path, "ev", [[{"k": "a", "ts": "2024-01-01T00:00:10Z"}, {"k": "a", "ts": "2024-01-01T00:00:50Z"}], [{"k": "a", "ts": "2024-01-01T01:00:00Z"}]], "k string, ts timestamp")
    drain(tasks.windowed(events, "ts", "1 minute", "5 minutes", "k"), "wins")
    assert [r["n"] for r in spark.table("wins").collect()] == [2]
