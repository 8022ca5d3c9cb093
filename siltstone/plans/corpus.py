"""Queries of ingest, mutations, evaluation and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import corpus as C
from siltstone.operators import evaluation as E
from siltstone.operators import memory as M
from siltstone.operators import mutations as K
from siltstone.operators import retrieval as V
from siltstone.plans.registry import add
from siltstone.plans.relational import CHUNKS, chunks
from siltstone.plans.retrieval import asked

c = F.col
NORM = r"trim(regexp_replace(text, '[\s\x{3000}\x{00A0}\x{0085}]+', ' ', 'g'))"
KEY = f"md5(lang || chr(10) || {NORM})"


def flagged(t):
    return C.first_occurrences(t.documents, C.content_key(c("lang"), c("text")), "source", "doc_id")


FLAGGED = f"(SELECT *, row_number() OVER (PARTITION BY source, {KEY} ORDER BY doc_id) > 1 AS local_dup, row_number() OVER (PARTITION BY {KEY} ORDER BY source, doc_id) > 1 AS global_dup FROM documents)"
add("w01_first_occurrences", lambda t: flagged(t).select("doc_id", "local_dup", "global_dup"), f"SELECT doc_id, local_dup, global_dup FROM {FLAGGED}")
add("d01_exact_dedup", lambda t: C.distinct_rows(t.documents, C.content_key(c("lang"), c("text")), ["source", "doc_id"]).select("doc_id"), f"SELECT doc_id FROM {FLAGGED} WHERE NOT global_dup")
add("a16_corpus_stats", lambda t: C.corpus_stats(flagged(t), "source", c("lang") == "en"), f"SELECT source, count(*) AS total, count(*) FILTER (local_dup) AS local_dups, count(*) FILTER (global_dup AND NOT local_dup) AS global_dups, count(*) FILTER (NOT global_dup) AS kept, count(*) FILTER (NOT global_dup AND lang = 'en') AS clean FROM {FLAGGED} GROUP BY source")


def buckets(t):
    return C.bucketed(t.documents.withColumn("label", F.concat("source", F.lit("_"), (c("doc_id") % 2).cast("string"))), "lang", "label", 12, {"en": 14})


BUCKETS = "(SELECT *, CASE WHEN count(*) OVER (PARTITION BY lang, label) >= CASE WHEN lang = 'en' THEN 14 ELSE 12 END THEN label ELSE 'misc' END AS bucket FROM (SELECT *, source || '_' || doc_id % 2 AS label FROM documents))"
add("d02_threshold_buckets", lambda t: buckets(t).groupBy("lang", "bucket").agg(F.count("*").alias("n")), f"SELECT lang, bucket, count(*) AS n FROM {BUCKETS} GROUP BY 1, 2")
add("w02_shard_parts", lambda t: C.sharded(buckets(t), ["lang", "bucket"], ["doc_id"], 20).groupBy("lang", "bucket", "part_index").agg(F.count("*").alias("n")), f"SELECT lang, bucket, p::INT AS part_index, least(20, n - 20 * (p - 1)) AS n FROM (SELECT lang, bucket, count(*) AS n FROM {BUCKETS} GROUP BY 1, 2), range(1, 1000) r(p) WHERE p <= ceil(n / 20.0)")
add("w03_shard_plan", lambda t: C.shard_plan(t.documents.groupBy("lang").agg(F.count("*").alias("n")), "n", 100), "SELECT lang, n, p::INT AS part_index, least(100, n - 100 * (p - 1)) AS planned FROM (SELECT lang, n, unnest(range(1, ceil(n / 100.0)::BIGINT + 1)) AS p FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1))")
add("d03_plan_mismatches", lambda t: C.plan_mismatches(C.shard_plan(buckets(t).groupBy("lang", "bucket").agg(F.count("*").alias("n")), "n", 20).select("lang", "bucket", "part_index", "planned"), C.sharded(buckets(t), ["lang", "bucket"], ["doc_id"], 20).groupBy("lang", "bucket", "part_index").agg(F.count("*").alias("written")), ["lang", "bucket", "part_index"]).agg(F.count("*").alias("n")), "SELECT 0::BIGINT AS n")
add("k17_shard_digests", lambda t: C.shard_digests(C.sharded(t.documents, ["source"], ["doc_id"], 50), ["source", "part_index"], c("text"), ["doc_id"]), "SELECT source, part_index, count(*) AS written, (sum(strlen(text)) + count(*))::BIGINT AS bytes, md5(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS md5 FROM (SELECT *, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 + 1)::INT AS part_index FROM documents) GROUP BY 1, 2")
add("j19_pending_shards", lambda t: C.pending(t.documents.select("doc_id", F.md5("text").alias("content_hash")), t.documents.where("doc_id % 3 = 0").select("doc_id", F.md5(F.when(c("doc_id") % 2 == 0, c("text")).otherwise(F.lit("old"))).alias("content_hash"), F.lit("done").alias("status"))).select("doc_id"), "SELECT doc_id FROM documents WHERE NOT (doc_id % 6 = 0)")
add("d04_stratified_sample", lambda t: C.stratified(t.documents.select("doc_id", "source"), "source", "doc_id", 50).select("id", "doc_id", "source"), "WITH h AS (SELECT doc_id, source, md5('42:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents), p AS (SELECT *, rn <= greatest(1, floor(50.0 / (SELECT count(DISTINCT source) FROM documents))) AS top FROM h ORDER BY top DESC, h, doc_id LIMIT 50) SELECT printf('qa_%04d', row_number() OVER (ORDER BY source, doc_id)) AS id, doc_id, source FROM p")
add("d10_parse_cache", lambda t: t.pages.select("page_id", F.md5("html").alias("md5")).join(t.pages.where("page_id % 2 = 0").select(F.md5("html").alias("md5"), c("page_id").alias("cached")), "md5").groupBy("page_id").agg(F.min("cached").alias("cached")), "SELECT p.page_id, min(q.page_id) AS cached FROM pages p JOIN pages q ON q.page_id % 2 = 0 AND md5(p.html) = md5(q.html) GROUP BY 1")

# Mutations
add("k01_upsert", lambda t: K.upsert(t.nation, t.nation.where("n_nationkey < 5").withColumn("n_name", F.lower("n_name")), "n_nationkey"), "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
add("k02_update_by_id", lambda t: K.update(chunks(t), c("chunk_id") == 4, {"lang": "xx", "kb_id": "", "available_int": 0}).select("chunk_id", "lang", "kb_id", "available_int"), f"SELECT chunk_id, CASE WHEN chunk_id = 4 THEN 'xx' ELSE lang END AS lang, kb_id, CASE WHEN chunk_id = 4 THEN 0 ELSE available_int END AS available_int FROM {CHUNKS}")
add("k02_remove_element", lambda t: chunks(t).select("chunk_id", F.array_join(K.remove_first(c("tag_kwd"), "even"), ",").alias("tags")), "SELECT doc_id AS chunk_id, lang AS tags FROM documents")
add("k03_update_by_query", lambda t: K.update(chunks(t), (c("lang") == "de") & (c("kb_id") == "src1"), {"n_chars": c("n_chars") + 1}).select("chunk_id", "n_chars"), f"SELECT chunk_id, n_chars + CASE WHEN lang = 'de' AND kb_id = 'src1' THEN 1 ELSE 0 END AS n_chars FROM {CHUNKS}")
add("k04_clamped_counter", lambda t: t.events.select("event_id", K.bump(F.when(c("event_id") % 3 == 0, "bad").otherwise(F.get_json_object("props", "$.k")), -40.0, 0.0, 50.0).alias("v")), "SELECT event_id, CASE WHEN x > 0 THEN x END AS v FROM (SELECT event_id, greatest(least(coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE props::JSON ->> '$.k' END AS DOUBLE), 0) - 40.0, 50.0), 0.0)::DOUBLE AS x FROM events)")
add("k05_delete_by_query", lambda t: K.delete(chunks(t), "src1", where=c("available_int").isNull()).select("chunk_id"), f"SELECT chunk_id FROM {CHUNKS} WHERE NOT (kb_id = 'src1' AND available_int IS NULL)")
add("k05_delete_empty_ids", lambda t: K.delete(chunks(t), "src1", ids=[]).select("chunk_id"), f"SELECT chunk_id FROM {CHUNKS}")
add("k08_upsert_latest", lambda t: K.upsert_latest(t.nation.withColumn("v", F.lit(1)), t.nation.where("n_nationkey % 2 = 0").withColumn("n_name", F.lit("new")).withColumn("v", F.lit(2)), "n_nationkey", "v").select("n_nationkey", "n_name", "v"), "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS n_name, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS v FROM nation")
add("k10_counters", lambda t: K.counters(t.documents, "source", text.token_count("text")), r"SELECT source, count(*) AS chunk_num, sum(len(regexp_extract_all(text, '[A-Za-z0-9_\x{00C0}-\x{024F}]+|[^\sA-Za-z0-9_\x{00C0}-\x{024F}]')))::BIGINT AS token_num FROM documents GROUP BY source")
add("k11_counters_after_delete", lambda t: K.counters(K.delete(chunks(t), "src2", where=c("lang") == "en"), "kb_id", c("n_chars")), f"SELECT kb_id, count(*) AS chunk_num, sum(n_chars)::BIGINT AS token_num FROM {CHUNKS} WHERE NOT (kb_id = 'src2' AND lang = 'en') GROUP BY kb_id")
LINKS = [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
add("k12_cascade_delete", lambda t: K.cascade({n: getattr(t, n) for n in ("customer", "orders", "lineitem")}, "customer", c("c_nationkey") == 3, LINKS)["lineitem"].select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)")
add("q06_user_cascade", lambda t: K.cascade({n: getattr(t, n) for n in ("customer", "orders", "lineitem")}, "customer", c("c_custkey") == 10, LINKS)["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey <> 10 GROUP BY 1")


def metas(t):
    return t.part.select(c("p_partkey").alias("doc_id"), F.create_map(F.lit("brand"), F.array("p_brand", F.lit("x")), F.lit("type"), F.array("p_type")).alias("meta"))


RULES = dict(updates=[{"key": "brand", "value": "y", "match": "x"}, {"key": "new", "value": "1"}], deletes=[{"key": "type"}, {"key": "brand", "value": "Brand#1"}])
add("k14_metadata_program", lambda t: K.apply_rules(metas(t), **RULES).select("doc_id", F.array_join(c("meta")["brand"], ",").alias("brand"), F.array_join(c("meta")["new"], ",").alias("new"), F.map_contains_key("meta", F.lit("type")).alias("typed"), "changed"), "SELECT p_partkey AS doc_id, CASE WHEN p_brand = 'Brand#1' THEN 'y' ELSE p_brand || ',y' END AS brand, '1' AS new, false AS typed, true AS changed FROM part")
add("k13_drop_metadata_value", lambda t: K.apply_rules(metas(t), [], [{"key": "brand", "value": "x"}]).select("doc_id", F.array_join(c("meta")["brand"], ",").alias("brand")), "SELECT p_partkey AS doc_id, p_brand AS brand FROM part")
add("k15_rename_tag", lambda t: chunks(t).select("chunk_id", F.array_join(K.rename_tag(c("tag_kwd"), "even", "twos"), ",").alias("tags")), f"SELECT chunk_id, array_to_string(list_transform(tag_kwd, lambda x: CASE WHEN x = 'even' THEN 'twos' ELSE x END), ',') AS tags FROM {CHUNKS}")
add("k20_retention", lambda t: K.keep_latest(t.events, "user_id", "event_id", 5).select("event_id"), "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
add("k21_pagerank_set", lambda t: K.update(chunks(t).withColumn("pagerank_fea", F.lit(None).cast("double")), c("kb_id") == "src5", {"pagerank_fea": 7.0}).groupBy("kb_id").agg(F.max("pagerank_fea").alias("p")), "SELECT source AS kb_id, CASE WHEN source = 'src5' THEN 7.0 END::DOUBLE AS p FROM documents GROUP BY 1")
add("q12_enqueue_guard", lambda t: t.orders.select("o_orderkey", "o_custkey").join(t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
add("q13_task_fan_out", lambda t: t.region.join(t.benchmark.select("item_id")).groupBy("r_regionkey").agg(F.count("*").alias("n")), "SELECT r_regionkey, count(*) AS n FROM region, benchmark GROUP BY 1")
add("g04_new_ids", lambda t: C.numbered(t.benchmark.select("item_id"), "item_id", t.documents.agg(F.max("doc_id")).scalar()).select("item_id", "id"), "SELECT item_id, row_number() OVER (ORDER BY item_id) + (SELECT max(doc_id) FROM documents) AS id FROM benchmark")
add("g07_progress_fold", lambda t: t.lineitem.groupBy("l_orderkey").agg(F.when(F.max("l_discount") >= 0.1, 1.0).when(F.min(F.when(c("l_linenumber") == 5, -1.0).otherwise(0.0)) < 0, -1.0).otherwise(F.max("l_discount")).alias("p")), "SELECT l_orderkey, CASE WHEN max(l_discount) >= 0.1 THEN 1.0 WHEN bool_or(l_linenumber = 5) THEN -1.0 ELSE max(l_discount) END::DOUBLE AS p FROM lineitem GROUP BY 1")
add("g13_cancelled", lambda t: t.lineitem.join(t.orders.where("o_orderstatus = 'P'").select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")

# Evaluation
def scored(t):
    d = t.embeddings.select(c("vec_id").alias("chunk_id"), "embedding", "label")
    near = V.nearest(asked(t), d, 50).where("query_id <> chunk_id").join(d.select("chunk_id", "label"), "chunk_id").join(d.select(c("chunk_id").alias("query_id"), c("label").alias("ql")), "query_id")
    return near.select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), ((c("chunk_id") % 7) / 7.0).alias("tokens"), (c("label") == c("ql")).alias("relevant"))


SCORED = "(SELECT query_id, chunk_id, round(cosine, 6) AS cosine, (chunk_id % 7) / 7.0 AS tokens, label = ql AS relevant FROM (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))) AS cosine, d.label, q.label AS ql FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(cosine, 9) DESC, d.vec_id) <= 50) WHERE query_id <> chunk_id)"
RANK = f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM {SCORED}), f AS (SELECT query_id, min(rank) FILTER (relevant) AS first_hit FROM r GROUP BY 1)"


def first(t):
    ranked = scored(t).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id"))).withColumnRenamed("relevant", "hit")
    return E.first_hits(ranked, ["query_id"])


add("w13_first_hits", lambda t: first(t), f"WITH {RANK} SELECT query_id, first_hit::INT AS first_hit FROM f")
SUMMARY = "count(*) AS questions, round(avg((first_hit IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr, " + ", ".join(f"round(avg(coalesce((first_hit <= {k})::INT, 0)), 6) AS recall_{k}" for k in (1, 3, 5, 10))
add("d06_summary", lambda t: E.summary(first(t), []), f"WITH {RANK} SELECT {SUMMARY} FROM f")
GRID = "(SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS config, v AS vt, th AS threshold, n AS top_n FROM (VALUES (1, 0.1), (2, 0.3), (3, 0.5), (4, 0.7), (5, 0.9)) a(i, v), (VALUES (1, 0.0), (2, 0.2), (3, 0.4), (4, 0.6)) b(j, th), (VALUES (1, 3), (2, 6), (3, 10)) d(k, n))"
GRID_SQL = f"s AS (SELECT g.*, query_id, chunk_id, relevant, round(vt * cosine + (1 - vt) * tokens, 6) AS sim FROM {SCORED}, {GRID} g), r AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY sim DESC, chunk_id) AS rank FROM s), f AS (SELECT config, query_id, min(rank) FILTER (relevant AND sim >= threshold AND rank <= top_n) AS first_hit FROM r GROUP BY 1, 2)"


def grid(t):
    return E.evaluate_grid(scored(t), E.grid(t.spark, [0.1, 0.3, 0.5, 0.7, 0.9], [0.0, 0.2, 0.4, 0.6], [3, 6, 10]))


add("d07_grid", lambda t: grid(t), f"WITH {GRID_SQL} SELECT config::INT AS config, {SUMMARY} FROM f GROUP BY 1")
add("t11_best_configs", lambda t: grid(t).orderBy(F.desc("mrr"), F.desc("recall_10"), "config").limit(20).select("config", "mrr"), f"WITH {GRID_SQL} SELECT config::INT AS config, round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr FROM f GROUP BY 1 ORDER BY mrr DESC, avg(coalesce((first_hit <= 10)::INT, 0)) DESC, 1 LIMIT 20")
add("d05_token_f1_hits", lambda t: _f1(t), r"""WITH n AS (SELECT query_id, chunk_id FROM (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))) AS cosine FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) <= 10),
 x AS (SELECT query_id, chunk_id, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+')) AS w FROM n JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id),
 f AS (SELECT query_id, chunk_id, 2.0 * len(list_intersect(q, w)) / (len(q) + len(w)) AS f1 FROM x) SELECT query_id, chunk_id, round(f1, 6) AS f1, f1 >= 0.3 AS hit FROM f""")


def _f1(t):
    """The ten nearest texts of each question against its expected one."""
    from siltstone.functions.vectors import token_f1

    near = V.nearest(asked(t), t.embeddings.select(c("vec_id").alias("chunk_id"), "embedding"), 10).select("query_id", "chunk_id")
    said = near.join(t.benchmark.select(c("item_id").alias("query_id"), text.tokens("text").alias("q")), "query_id").join(t.documents.select(c("doc_id").alias("chunk_id"), text.tokens("text").alias("w")), "chunk_id")
    return said.select("query_id", "chunk_id", token_f1(c("q"), c("w")).alias("f")).select("query_id", "chunk_id", F.round("f", 6).alias("f1"), (c("f") >= 0.3).alias("hit"))


add("a24_section_scores", lambda t: t.events.where("value >= 0.3").groupBy("user_id").agg(F.round(F.avg("value") / 5, 6).alias("s")).orderBy(F.desc("s"), "user_id").limit(10), "SELECT user_id, round(avg(value) / 5, 6) AS s FROM events WHERE value >= 0.3 GROUP BY 1 ORDER BY s DESC, user_id LIMIT 10")
add("a25_cosine_summary", lambda t: scored(t).agg(F.round(F.avg("cosine"), 5).alias("mean"), F.min("cosine").alias("low"), F.max("cosine").alias("high"), (F.avg("cosine") > 0.9).alias("passed")), f"SELECT round(avg(cosine), 5) AS mean, min(cosine) AS low, max(cosine) AS high, avg(cosine) > 0.9 AS passed FROM {SCORED}")

# Memory
def size():
    return F.octet_length("text")


def messages(t):
    return t.conversations.select(c("conv_id").alias("memory_id"), c("turn").alias("message_id"), "role", "text", F.when(c("turn") % 3 == 1, c("turn")).alias("forget_at"), F.concat_ws("_", c("conv_id").cast("string"), c("turn").cast("string")).alias("id"))


MSG = "(SELECT conv_id AS memory_id, turn AS message_id, role, text, CASE WHEN turn % 3 = 1 THEN turn END AS forget_at, conv_id || '_' || turn AS id, strlen(text) AS size FROM conversations)"
add("k06_message_rows", lambda t: M.message_rows(t.conversations.withColumn("status", c("role") == "user"), "conv_id", "turn").select("id", "status_int"), "SELECT conv_id || '_' || turn AS id, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS status_int FROM conversations")
add("k07_message_update", lambda t: K.update(messages(t), c("message_id") == 0, {"role": "first"}).groupBy("role").agg(F.count("*").alias("n")), f"SELECT CASE WHEN message_id = 0 THEN 'first' ELSE role END AS role, count(*) AS n FROM {MSG} GROUP BY 1")
add("a20_memory_sizes", lambda t: M.sizes(messages(t), "memory_id", "text"), f"SELECT memory_id, sum(size)::BIGINT AS bytes FROM {MSG} GROUP BY 1")
EVICT = "(SELECT *, coalesce(sum(size) OVER (PARTITION BY memory_id ORDER BY forget_at IS NULL, forget_at, message_id, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM " + MSG + ")"
add("w06_fifo_eviction", lambda t: M.evictions(messages(t), messages(t).select("memory_id").distinct().withColumn("need", F.lit(900)), "memory_id", size(), "forget_at", "message_id", "id").select("id"), f"SELECT id FROM {EVICT} WHERE freed < 900")
add("g10_insert_with_eviction", lambda t: M.insert_with_eviction(messages(t).where("message_id > 0"), messages(t).where("message_id = 0"), "memory_id", size(), 2000, "forget_at", "message_id", "id").select("id"), f"""WITH n AS (SELECT memory_id, sum(size) FILTER (message_id = 0) AS new, coalesce(sum(size) FILTER (message_id > 0), 0) AS old FROM {MSG} GROUP BY 1),
e AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY memory_id ORDER BY forget_at IS NULL, forget_at, message_id, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM {MSG} WHERE message_id > 0)
SELECT id FROM e LEFT JOIN n USING (memory_id) WHERE new IS NULL OR new > 2000 OR new + old <= 2000 OR freed >= new + old - 2000 UNION ALL SELECT id FROM {MSG} m JOIN n USING (memory_id) WHERE message_id = 0 AND new <= 2000""")
add("j15_nested_messages", lambda t: M.nested(t.conversations.select((c("conv_id") * 100 + c("turn")).alias("message_id"), F.when(c("turn") == 0, "raw").otherwise(c("role")).alias("message_type"), (c("conv_id") * 100).alias("source_id"))).select("message_id", F.coalesce(F.size("extracted"), F.lit(0)).cast("long").alias("n")), "SELECT conv_id * 100 AS message_id, count(*) - 1 AS n FROM conversations GROUP BY conv_id HAVING min(turn) = 0")
add("j16_latest_task", lambda t: t.customer.join(t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("task")), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce(c("task").cast("string"), F.lit("Unknown")).alias("task")), "SELECT c_custkey, coalesce(task::VARCHAR, 'Unknown') AS task FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS task FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey")
add("w05_prompt_budget", lambda t: M.within_budget(messages(t), "memory_id", [c("message_id")], F.length("text"), 1500).select("id"), "SELECT conv_id || '_' || turn AS id FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 1500")

def told_system(t):
    """Conversations whose first turns, of every second one, are the system's."""
    return t.conversations.select("conv_id", "turn", F.when((c("turn") == 0) & (c("conv_id") % 2 == 0), "system").otherwise(c("role")).alias("role"), "text")


add("c26_history_fit", lambda t: M.history_fit(told_system(t), "conv_id", "turn", "role", "text", 40), r"""
WITH m AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'system' ELSE role END AS role, text, coalesce(text, '') AS said FROM conversations), k AS (SELECT *, regexp_extract_all(said, '\s*(?:[A-Za-z0-9_À-ɏ]+|[^\sA-Za-z0-9_À-ɏ])') AS x FROM m),
n AS (SELECT *, len(x) AS k, sum(len(x)) OVER (PARTITION BY conv_id) AS a, coalesce(role = 'system', false) AS sys, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC NULLS LAST, said DESC) = 1 AS latest FROM k), p AS (SELECT * FROM n WHERE a <= 40 OR latest OR sys),
q AS (SELECT *, sum(CASE WHEN sys THEN k ELSE 0 END) OVER w AS s, sum(CASE WHEN latest AND NOT sys THEN k ELSE 0 END) OVER w AS l, bool_or(latest AND sys) OVER w AS own, coalesce(sum(CASE WHEN sys THEN k ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WINDOW w AS (PARTITION BY conv_id)),
r AS (SELECT *, own OR s > 0.8 * (s + l) AS first FROM q)
SELECT conv_id, turn, role, CASE WHEN a > 40 AND s + l > 40 THEN array_to_string(x[1:greatest(0, CASE WHEN sys THEN CASE WHEN first THEN 40 - l - before ELSE k END WHEN first AND s > 0 THEN k ELSE 40 - s END)], '') ELSE text END AS text FROM r""")
add("c27_prompt_blocks", lambda t: t.documents.select("doc_id", F.md5(M.prompt_block(c("doc_id"), c("source"), c("text"))).alias("md5")), "SELECT doc_id, md5(chr(10) || 'ID: ' || doc_id || chr(10) || '├── Title: ' || source || chr(10) || '└── Content:' || chr(10) || text) AS md5 FROM documents")
add("g11_answer_accumulation", lambda t: M.accumulate(t.conversations.withColumn("final", (c("conv_id") % 2 == 0) & (c("role") == "assistant")), "conv_id", "turn", "text", "final").select("conv_id", F.md5("answer").alias("md5")), "SELECT conv_id, md5(CASE WHEN bool_or(f) THEN arg_max(text, turn) FILTER (f) ELSE string_agg(text, '' ORDER BY turn) END) AS md5 FROM (SELECT *, conv_id % 2 = 0 AND role = 'assistant' AS f FROM conversations) GROUP BY 1")
add("r14_recent_messages", lambda t: messages(t).where("forget_at IS NULL").withColumn("_rn", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("message_id")))).where("_rn <= 2").select("id"), f"SELECT id FROM {MSG} WHERE forget_at IS NULL QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY message_id DESC) <= 2")
add("q14_token_backfill", lambda t: messages(t).withColumn("tok", F.when(c("message_id") > 0, F.length("text"))).withColumn("tok", F.coalesce("tok", F.length("text"))).groupBy("memory_id").agg(F.sum("tok").alias("n")), f"SELECT memory_id, sum(length(text))::BIGINT AS n FROM {MSG} GROUP BY 1")
add("v27_message_search", lambda t: _message_search(t), r"""WITH q AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) WHERE length(token) > 1), m AS (SELECT DISTINCT conv_id, turn, token FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM conversations)) SELECT item_id, conv_id, turn, count(*) AS n FROM q JOIN m USING (token) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, conv_id, turn) <= 5""")


def _message_search(t):
    q = t.benchmark.select("item_id", F.explode(F.array_distinct(text.tokens("text"))).alias("token")).where(F.length("token") > 1)
    m = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(text.tokens("text"))).alias("token"))
    hits = q.join(m, "token").groupBy("item_id", "conv_id", "turn").agg(F.count("*").alias("n"))
    return hits.withColumn("_rn", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "conv_id", "turn"))).where("_rn <= 5").drop("_rn")
