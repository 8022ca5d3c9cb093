"""Queries of readers, writers, streams and the store: files written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.operators import mutations as K
from siltstone.operators import store, text_sql
from siltstone.plans.registry import add
from siltstone.plans.relational import CHUNKS, chunks
from siltstone.sources import readers, writers
from siltstone.streaming import queues, tasks

c = F.col


def written(t, lines: DataFrame, *by: str) -> str:
    """A folder of text files of ``value``, one for each value of ``by``."""
    path = t.scratch()
    (lines.repartition(*by) if by else lines).write.partitionBy(*by).text(path)
    return path


# Sources
def nation_arrays(t):
    arrays = t.nation.groupBy("n_regionkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("title"), F.concat(F.lit("ask "), x["n_nationkey"].cast("string")).alias("ask")))).alias("value"))
    return readers.json_arrays(t.spark, written(t, arrays.select("n_regionkey", "value"), "n_regionkey"), "title string, ask string", limit=4)


add("s01_json_arrays", lambda t: nation_arrays(t).select("title", "ask", "source_row_index"), "SELECT n_name AS title, 'ask ' || n_nationkey AS ask, n::INT AS source_row_index FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) WHERE n <= 4")


def order_lines(t):
    return written(t, t.orders.select(F.concat(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")), F.when(c("o_orderkey") % 5 == 0, F.lit("\n\n")).otherwise(F.lit(""))).alias("value")))


add("s02_jsonl", lambda t: readers.jsonl(t.spark, order_lines(t), "o_orderkey long, o_custkey long, o_orderstatus string"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
add("s03_jsonl_inferred", lambda t: readers.jsonl(t.spark, order_lines(t)).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys")), "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS custkeys FROM orders GROUP BY 1")


def qa_lines(t):
    """Questions and answers under several names, records without both, and lines that aren't JSON."""
    names = [("question", "answer"), ("instruction", "output"), ("问题", "答案"), ("q", "回答"), ("ask", "a")]
    made = [F.when(c("o_orderkey") % 7 == i, F.to_json(F.struct(F.concat(F.lit(" who "), c("o_custkey")).alias(q), F.concat(F.lit("it is "), c("o_orderkey")).alias(a)))) for i, (q, a) in enumerate(names)]
    half = F.when(c("o_orderkey") % 7 == 5, F.to_json(F.struct(c("o_custkey").cast("string").alias("question"), F.lit(" ").alias("answer"))))
    return written(t, t.orders.select(F.coalesce(*made, half, F.lit("no json {")).alias("value")))


add("s04_qa_pairs", lambda t: readers.qa_pairs(t.spark, qa_lines(t)), "SELECT 'who ' || o_custkey AS question, 'it is ' || o_orderkey AS answer FROM orders WHERE o_orderkey % 7 < 5")
add("s05_qa_pairs_after_skip", lambda t: readers.qa_pairs(t.spark, qa_lines(t), skip=11).agg(F.count("*").alias("n")), "SELECT greatest(0, count(*) - 11) AS n FROM orders WHERE o_orderkey % 7 < 5")
add("s15_qa_by_question", lambda t: readers.qa_pairs(t.spark, qa_lines(t)).groupBy("question").agg(F.count("*").alias("n")), "SELECT 'who ' || o_custkey AS question, count(*) AS n FROM orders WHERE o_orderkey % 7 < 5 GROUP BY 1")


def dialogue_csv(t, delimiter):
    path = t.scratch()
    t.part.select(F.concat(c("p_name"), F.lit(f'{delimiter}"x"\nand')).alias("question"), c("p_size").alias("answer"), c("p_brand").alias("other")).write.option("header", True).option("sep", delimiter).option("escape", '"').csv(path)
    return readers.csv_dialogues(t.spark, path, delimiter)


DIALOGUES = "SELECT p_name || '{0}\"x\"' || chr(10) || 'and' AS question, p_size::VARCHAR AS answer FROM part"
add("s06_csv_dialogues", lambda t: dialogue_csv(t, ","), DIALOGUES.format(","))
add("s12_tsv_dialogues", lambda t: dialogue_csv(t, "\t"), DIALOGUES.replace("{0}", "' || chr(9) || '"))


def brand_files(t):
    lines = t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("value"))
    return written(t, lines.select("p_brand", "value"), "p_brand")


FILES = "SELECT p_brand, string_agg(p_name, chr(10) ORDER BY p_name) || chr(10) AS body FROM part GROUP BY 1"
add("s07_files", lambda t: readers.files(t.spark, brand_files(t), "*.txt").select("md5", "bytes"), f"SELECT md5(body) AS md5, strlen(body) AS bytes FROM ({FILES})")
add("s08_files_not_done", lambda t: not_done(t), f"SELECT count(*) AS n FROM ({FILES}) WHERE strlen(body) % 3 <> 0")


def not_done(t):
    path = brand_files(t)
    return readers.files(t.spark, path, done=readers.files(t.spark, path).where("bytes % 3 = 0")).agg(F.count("*").alias("n"))


def encoded(t):
    path = t.scratch()
    t.nation.select(F.concat("n_name", F.lit("é")).alias("v")).repartition(1).write.option("encoding", "iso-8859-1").csv(f"{path}/latin")
    t.region.select(F.concat(F.lit("é中"), "r_name").alias("v")).repartition(1).write.csv(f"{path}/utf")
    whole = readers.decoded(t.spark, f"{path}/*/*.csv")
    return whole.select("codec", F.explode(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n")).alias("line"))


add("s09_decoded", lambda t: encoded(t), "SELECT 'latin-1' AS codec, n_name || 'é' AS line FROM nation UNION ALL SELECT 'utf-8', 'é中' || r_name FROM region")


# Sinks and the store
def rewritten_shards(t):
    """Shards written twice; the second time only those of one status, which replace theirs."""
    path, rows = t.scratch(), t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    writers.shards(rows, path, ["o_orderstatus"], ["o_orderkey"])
    writers.shards(rows.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0"), path, ["o_orderstatus"], ["o_orderkey"])
    return t.spark.read.json(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


add("k16_shards", rewritten_shards, "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY 1")


def resumed(t):
    path, rows = t.scratch(), t.orders.select("o_orderkey", "o_orderstatus")
    counts = [writers.resume(part, path, "o_orderkey") for part in (rows.where("o_orderstatus = 'F'"), rows, rows)]
    return t.spark.read.parquet(path).agg(F.count("*").alias("stored"), F.countDistinct("o_orderkey").alias("keys")).select("*", *[F.lit(n).cast("long").alias(f"run_{i}") for i, n in enumerate(counts)])


add("k22_resume", resumed, "SELECT count(*) AS stored, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (o_orderstatus = 'F') AS run_0, count(*) FILTER (o_orderstatus <> 'F') AS run_1, 0::BIGINT AS run_2 FROM orders")
add("k09_mapped_update", lambda t: K.update(t.customer.select("c_custkey", "c_name", "c_mktsegment"), c("c_custkey") % 3 == 0, {"c_name": "changed", "c_mktsegment": ""}), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS c_name, c_mktsegment FROM customer")


def filled_store(t):
    """A store after inserts, an upsert, an update and a delete in single knowledge bases."""
    s = store.DocumentStore(t.spark, t.scratch())
    rows = chunks(t).select("kb_id", "chunk_id", "lang", "n_chars")
    s.create("kb_id string, chunk_id long, lang string, n_chars long")
    s.create("other string")
    for kb in ("src1", "src2", "src3"):
        s.insert(rows.where(c("kb_id") == kb).drop("kb_id"), kb)
    s.insert(rows.where("kb_id = 'src1' AND chunk_id % 2 = 0").withColumn("n_chars", F.lit(7).cast("long")).drop("kb_id"), "src1")
    s.update((c("kb_id") == "src2") & (c("lang") == "en"), {"lang": "xx"})
    s.delete("src3", where=c("chunk_id") % 4 == 0)
    s.drop("src2")
    return s


STORED = f"SELECT kb_id, chunk_id, CASE WHEN kb_id = 'src2' AND lang = 'en' THEN 'xx' ELSE lang END AS lang, CASE WHEN kb_id = 'src1' AND chunk_id % 2 = 0 THEN 7 ELSE n_chars END AS n_chars FROM {CHUNKS} WHERE kb_id IN ('src1', 'src2') OR (kb_id = 'src3' AND chunk_id % 4 <> 0)"
add("q01_store_rows", lambda t: filled_store(t).rows().select("kb_id", "chunk_id", "lang", "n_chars"), STORED)
add("q02_store_search", lambda t: filled_store(t).search(["chunk_id", "n_chars"], {"lang": ["en", "xx"]}, ["src1", "src2"], [c("n_chars").desc()], 3, 20), f"SELECT chunk_id, n_chars FROM ({STORED}) WHERE lang IN ('en', 'xx') AND kb_id IN ('src1', 'src2') ORDER BY n_chars DESC, chunk_id LIMIT 20 OFFSET 3")


# Models and text to SQL
add("m2_cut_texts", lambda t: t.documents.select("doc_id", (models.embed(c("text"), longest=40) == models.embed(F.substring("text", 1, 40))).alias("same"), (models.embed(c("text"), longest=40) == models.embed(F.concat(F.substring("text", 1, 40), F.lit(" more words")), longest=52)).alias("other")), "SELECT doc_id, true AS same, false AS other FROM documents")


def told(t, statements):
    """Text to SQL with a model that says these statements one after the other."""
    view = "told_chunks"
    text_sql.scoped_view(t.spark, chunks(t), ["src1", "src2"], view)
    said = iter(statements)
    return text_sql.answer(t.spark, "how many", lambda question, error: next(said).replace("chunks", view), ("chunk_id",))[1]


add("m8_text_to_sql", lambda t: told(t, ["<think>hm</think>```sql\nSELECT nothing FROM chunks;\n```", "SELECT lang, count(*) AS n FROM chunks GROUP BY lang;"]), f"SELECT lang, count(*) AS n FROM {CHUNKS} WHERE kb_id IN ('src1', 'src2') GROUP BY 1")
add("m8_missing_sources", lambda t: told(t, ["SELECT lang FROM chunks WHERE n_chars > 900", "SELECT chunk_id, lang FROM chunks WHERE n_chars > 900"]), f"SELECT chunk_id, lang FROM {CHUNKS} WHERE kb_id IN ('src1', 'src2') AND n_chars > 900")
add("x41_clean_sql", lambda t: t.nation.select("n_nationkey", F.udf(text_sql.clean_sql)(F.concat(F.lit("<think>a;\nb</think>\n```sql\nSELECT "), "n_name", F.lit(" ; \n```\nas asked"))).alias("a"), F.udf(text_sql.clean_sql)(F.concat(F.lit(" SELECT "), "n_name", F.lit(";"))).alias("b")), "SELECT n_nationkey, 'SELECT ' || n_name AS a, 'SELECT ' || n_name AS b FROM nation")


# Streams; each reads a log of JSON files to its end.
def logged(t, rows: DataFrame, files: int = 3) -> DataFrame:
    path = t.scratch()
    rows.repartition(files).write.json(path)
    return tasks.task_log(t.spark, path, rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), files)


def drained(t, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its log ends, by batches in a folder."""
    path = t.scratch()
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


def consumed(t):
    path = t.scratch()
    log = logged(t, t.lineitem.select(c("l_orderkey").alias("task_id"), (c("l_orderkey") % 10).alias("priority"), F.to_timestamp(F.lit("2024-01-01")).alias("at")), 4)
    run = tasks.consume(log, lambda batch: batch.withColumn("answer", c("task_id") * 2), f"{path}/done", f"{path}/state", "at")
    run.awaitTermination()
    return t.spark.read.parquet(f"{path}/done")


CONSUMED = "SELECT DISTINCT l_orderkey AS task_id, l_orderkey * 2 AS answer FROM lineitem"
add("g01_task_queue", lambda t: consumed(t).select("task_id", "answer"), CONSUMED)
add("k19_idempotent_sink", lambda t: consumed(t).groupBy().agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("keys")), "SELECT count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) AS keys FROM lineitem")
add("s22_task_log", lambda t: drained(t, logged(t, t.orders.select("o_orderkey", "o_orderstatus"))).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders")


def group_of_four(t):
    """Customers as messages to four consumers, who acknowledge two of three."""
    path, at = t.scratch(), F.to_timestamp(F.lit("2024-01-01"))
    sent = t.customer.select(c("c_custkey").cast("string").alias("msg_id"), c("c_name").alias("payload"), at.alias("at"))
    messages = logged(t, sent, 2)
    t.spark.createDataFrame([], "msg_id string, at timestamp").write.json(f"{path}/acks")
    acks = t.spark.readStream.schema("msg_id string, at timestamp").json(f"{path}/acks")
    handle = lambda batch: batch.where(c("msg_id").cast("long") % 3 != 0).select("msg_id", F.upper("payload").alias("answer"))
    queues.work(queues.deliveries(messages, acks, consumers=4), handle, f"{path}/out", f"{path}/acks", f"{path}/state").awaitTermination()
    return queues.group_info(sent, queues.given_rows(t.spark, f"{path}/out"), t.spark.read.schema("msg_id string, at timestamp").json(f"{path}/acks"))


GROUPS = "SELECT (('0x' || left(md5(c_custkey::VARCHAR), 8))::BIGINT % 4)::INT AS consumer, count(*) FILTER (c_custkey % 3 = 0) AS pending, count(*) FILTER (c_custkey % 3 <> 0) AS acked, count(*) AS deliveries FROM customer GROUP BY 1"
add("g02_lag", lambda t: group_of_four(t).select("consumer", "pending", "acked", "deliveries"), f"{GROUPS} UNION ALL SELECT NULL, 0, 0, 0")
add("w14_consumer_progress", lambda t: group_of_four(t).where("consumer IS NOT NULL").select("consumer", F.round(F.try_divide("acked", "deliveries"), 6).alias("share")), f"SELECT consumer, round(acked / deliveries, 6) AS share FROM ({GROUPS})")
add("g03_rate_limit", lambda t: drained(t, tasks.rate_limited(logged(t, t.events.select(c("user_id").alias("client"), "ts"), 1), 3, 0.0)).groupBy("client").agg(F.count_if("passed").alias("passed"), F.count("*").alias("n")), "SELECT user_id AS client, least(3, count(*)) AS passed, count(*) AS n FROM events GROUP BY 1")


def last_events(t):
    """Each user's last event is kept for a day; every third event of a kind asks for it."""
    asks = c("event_id") % 3 == 0
    rows = t.events.select(c("user_id").alias("key"), c("event_id").alias("seq"), F.when(asks, "get").otherwise("set").alias("op"), c("event_type").alias("member"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.when(~asks, F.lit(86400.0)).alias("ttl_s"), c("ts").cast("timestamp").alias("at"))
    return drained(t, queues.key_values(logged(t, rows, 1)))


add("g05_expiring_keys", lambda t: last_events(t).select("key", "seq", "answer"), """
WITH e AS (SELECT user_id, event_id, event_id % 3 = 0 AS asks, event_type, date_trunc('millisecond', ts) AS ts, ts AS moment FROM events), l AS (SELECT *, last_value(CASE WHEN NOT asks THEN event_type END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN NOT asks THEN ts END IGNORE NULLS) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY moment, event_id))
SELECT user_id AS key, event_id AS seq, CASE WHEN s IS NOT NULL AND ts < s + INTERVAL 1 DAY THEN '"' || v || '"' ELSE 'null' END AS answer FROM l WHERE asks""")
TURNS = "(SELECT DISTINCT conv_id, turn FROM conversations)"


def turn_progress(t):
    """Each turn is a task of its conversation."""
    rows = t.conversations.select(c("conv_id").alias("doc_id"), c("turn").alias("task_id"), c("turn").cast("long").alias("seq")).distinct().where("seq < 9 OR doc_id % 2 = 0")
    rows = rows.withColumn("progress", F.when((c("task_id") % 4 == 1) & (c("doc_id") % 5 == 0), 0.5).when((c("task_id") % 4 == 2) & (c("doc_id") % 3 == 0), -1.0).otherwise(1.0))
    return drained(t, queues.document_status(logged(t, rows, 1))).groupBy("doc_id").agg(F.max_by("status", "seq").alias("status"))


add("g06_document_status", turn_progress, f"""
WITH u AS (SELECT conv_id AS doc_id, turn, CASE WHEN conv_id % 5 <> 0 AND turn % 4 = 1 THEN 1.0 WHEN turn % 4 = 1 THEN 0.5 WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN -1.0 ELSE 1.0 END AS p FROM {TURNS} WHERE turn < 9 OR conv_id % 2 = 0)
SELECT doc_id, CASE WHEN bool_or(p = 0.5) THEN 'run' WHEN bool_or(p = -1) THEN 'fail' ELSE 'done' END AS status FROM u GROUP BY 1""")


def memories(t):
    """Each turn adds a message to the memory of its conversation, or takes one of its size out."""
    rows = t.conversations.select(c("conv_id").alias("memory_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), (c("turn") % 4 == 3).alias("evicted"))
    sizes = drained(t, queues.memory_sizes(logged(t, rows, 3)), "update")
    return sizes.groupBy("memory_id").agg(F.max_by(F.struct("size", "n"), "epoch").alias("r")).select("memory_id", "r.size", "r.n")


add("g09_memory_sizes", memories, "SELECT conv_id AS memory_id, sum(CASE WHEN turn % 4 = 3 THEN -1 ELSE 1 END * coalesce(length(text), 0))::BIGINT AS size, sum(CASE WHEN turn % 4 = 3 THEN -1 ELSE 1 END)::BIGINT AS n FROM conversations GROUP BY 1")


def progress_updates(t):
    value = F.when(c("l_linenumber") == 7, 1.0).when(c("l_linenumber") == 5, -1.0).otherwise(c("l_discount"))
    return t.lineitem.select(c("l_orderkey").alias("task_id"), c("l_linenumber").alias("seq"), value.alias("progress"))


add("g07_progress_stream", lambda t: drained(t, tasks.progress(logged(t, progress_updates(t), 8)), "update").select("task_id", F.round("progress", 6).alias("progress")), "SELECT l_orderkey AS task_id, CASE WHEN bool_or(l_linenumber = 7) THEN 1.0 WHEN bool_or(l_linenumber = 5) THEN -1.0 ELSE round(max(l_discount), 6) END::DOUBLE AS progress FROM lineitem GROUP BY 1")


def pieces(t):
    """Each turn is a piece of an answer; thoughts are marked."""
    piece = F.when(c("turn") % 5 == 1, F.lit("<think>")).when(c("turn") % 5 == 3, F.lit("</think>")).otherwise(F.rpad(F.concat(F.lit("turn "), c("turn").cast("string")), 20, "."))
    return t.conversations.select("conv_id", "turn").distinct().select("conv_id", c("turn").alias("seq"), piece.alias("piece"))


add("g08_deltas", lambda t: drained(t, tasks.deltas(logged(t, pieces(t), 1), "conv_id", "seq", "piece")).select("conv_id", "n", "delta"), "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n, CASE turn % 5 WHEN 1 THEN '<think>' WHEN 3 THEN '</think>' ELSE rpad('turn ' || turn, 20, '.') END AS delta FROM (SELECT DISTINCT conv_id, turn FROM conversations)")


def schema_of_values(t):
    """The languages and sources of the documents as choices, and a field that takes any text."""
    each = t.documents.select(F.explode(F.array(F.struct(F.lit("lang").alias("key"), F.lit("Language").alias("description"), c("lang").alias("value")), F.struct(F.lit("source").alias("key"), F.lit(None).cast("string").alias("description"), c("source").alias("value")), F.struct(F.lit("note").alias("key"), F.lit("free").alias("description"), F.lit(None).cast("string").alias("value")))).alias("f"))
    return store.schema_rows(each.select("f.*").distinct())


add("x25_metadata_schema", schema_of_values, """
WITH f AS (SELECT 'lang' AS key, 'Language' AS d, lang AS v FROM documents UNION SELECT 'source', '', source FROM documents UNION SELECT 'note', 'free', NULL FROM documents)
SELECT key, CASE WHEN count(v) > 0 THEN '{"type":"array","items":{"type":"string","enum":[' || string_agg('"' || v || '"', ',' ORDER BY v) || ']},"description":"' || max(d) || '"}' ELSE '{"type":"string","description":"' || max(d) || '"}' END AS property FROM f GROUP BY key""")
