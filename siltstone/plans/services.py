"""Queries of the remaining services and variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import models, text
from siltstone.operators import corpus as C
from siltstone.operators import lexical as L
from siltstone.operators import lexicon
from siltstone.operators import mutations as K
from siltstone.operators import predicates as P
from siltstone.operators import relational as R
from siltstone.operators import retrieval as V
from siltstone.operators import segment as S
from siltstone.operators import store, text_sql
from siltstone.plans.registry import add
from siltstone.plans.relational import CHUNKS, chunks
from siltstone.plans.retrieval import NEAR, hits

c = F.col
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
add("a10_release_times", lambda t: t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("released")), "SELECT l_orderkey, max(l_shipdate) AS released FROM lineitem GROUP BY 1")
add("a15_answer_documents", lambda t: t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")), "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
add("a17_misc_rollup", lambda t: C.bucketed(t.part, "p_brand", "p_type", 20).groupBy("p_brand", "bucket").agg(F.count("*").alias("n")), "SELECT p_brand, CASE WHEN m >= 20 THEN p_type ELSE 'misc' END AS bucket, sum(m)::BIGINT AS n FROM (SELECT p_brand, p_type, count(*) AS m FROM part GROUP BY 1, 2) GROUP BY 1, 2")
add("j8_stats_join", lambda t: t.events.join(t.customer, c("user_id") == c("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")), "SELECT c_mktsegment, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
add("w11_pair_weights", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(0.6 * F.greatest("l_tax", F.lead("l_tax").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_tax"))), 6).alias("w")), "SELECT l_orderkey, l_linenumber, l_partkey, round(0.6 * greatest(l_tax, lead(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_tax)), 6) AS w FROM lineitem")
add("t7_global_top_k", lambda t: t.orders.orderBy(c("o_totalprice").desc(), "o_orderkey").limit(64).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 64")
add("t9_top_nodes", lambda t: t.customer.orderBy(F.coalesce("c_acctbal", F.lit(0.0)).desc(), "c_custkey").limit(256).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey LIMIT 256")
add("u6_token_sets", lambda t: t.benchmark.select("item_id", F.size(F.array_intersect(text.tokens("text"), F.array(F.lit("the"), F.lit("de"), F.lit("die")))).cast("long").alias("common")), f"SELECT item_id, len(list_intersect({TOK}, ['the', 'de', 'die']))::BIGINT AS common FROM benchmark")
add("v20_pretokens", lambda t: t.benchmark.select("item_id", F.array_join(L.without_noise(text.tokens("text"), ["the", "de", "of"]), " ").alias("v")), rf"SELECT item_id, array_to_string(list_filter({TOK}, lambda x: x NOT IN ('the', 'de', 'of') AND regexp_matches(x, '[\p{{L}}\p{{N}}]') AND NOT regexp_full_match(x, '[0-9]')), ' ') AS v FROM benchmark")
add(
    "v20_merged_singles",
    lambda t: t.part.select("p_partkey", F.array_join(L.merged_singles(F.filter(F.concat(F.array("p_brand"), F.split(F.substring(F.lit("abcdefgh"), F.lit(1), (c("p_partkey") % 9).cast("int")), ""), F.array(F.lit("xx"), F.lit("y"))), lambda x: x != "")), " ").alias("v")),
    "SELECT p_partkey, concat_ws(' ', p_brand, CASE WHEN n BETWEEN 1 AND 4 THEN s WHEN n > 4 THEN array_to_string([s[i:i + 1] FOR i IN range(1, n + 1, 2)], ' ') END, 'xx', 'y') AS v FROM (SELECT *, (p_partkey % 9)::INT AS n, left('abcdefgh', (p_partkey % 9)::INT) AS s FROM part)",
)
add(
    "v21_joined_latin",
    lambda t: t.benchmark.select("item_id", F.array_join(L.joined_latin(F.concat(F.split(F.lit("heart failure 心 衰 mri a b c 1x"), " "), text.tokens("text"))), "|").alias("v")),
    rf"SELECT item_id, regexp_replace(regexp_replace(array_to_string(list_concat(['heart', 'failure', '心', '衰', 'mri', 'a', 'b', 'c', '1x'], {TOK}), '|'), '([a-zA-Z])\|([a-zA-Z])', '\1 \2', 'g'), '([a-zA-Z])\|([a-zA-Z])', '\1 \2', 'g') AS v FROM benchmark",
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCRIPT = "".join(chr(0x4E00 + 101 * i) for i in range(26))


def unblanked(df):
    """Texts in a script without blanks: letters become ideographs, and what is between words goes."""
    return df.withColumn("text", F.translate(F.regexp_replace(F.lower("text"), "[^a-z\n]", ""), LETTERS, SCRIPT))


def questions_in_words(t):
    """Questions cut into words that the corpus of all questions teaches."""
    texts = unblanked(t.benchmark.select(c("item_id").alias("query_id"), "text"))
    return lexicon.segmented(texts, lexicon.learn_words(texts, longest=6))


add("x20_learned_words", lambda t: lexicon.learn_words(unblanked(t.benchmark), longest=6, cohesion=-99.0, freedom=-99.0).select("word", "n", F.round(F.greatest("freedom", F.lit(0.0)), 6).alias("freedom")), f"""
WITH r AS (SELECT unnest(regexp_extract_all(translate(regexp_replace(lower(text), '[^a-z\n]', '', 'g'), '{LETTERS}', '{SCRIPT}'), '[一-鿿]+')) AS r FROM benchmark), i AS (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM r), n AS (SELECT r, i, unnest(range(1, least(6, length(r) - i + 1) + 1)) AS n FROM i),
g AS (SELECT r[i:i + n - 1] AS word, CASE WHEN i > 1 THEN r[i - 1:i - 1] ELSE '' END AS a, r[i + n:i + n] AS b FROM n), ca AS (SELECT word, a, count(*) AS c FROM g GROUP BY 1, 2), cb AS (SELECT word, b, count(*) AS c FROM g GROUP BY 1, 2),
ha AS (SELECT word, sum(c)::BIGINT AS n, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM ca GROUP BY 1), hb AS (SELECT word, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM cb GROUP BY 1)
SELECT word, n, round(greatest(least(ha.h, hb.h), 0), 6) AS freedom FROM ha JOIN hb USING (word) WHERE n >= 5 OR length(word) = 1""")
add("v23_segmented_terms", lambda t: L.segmented_terms(questions_in_words(t), F.array_distinct("segments"), text.fine_tokens("text")).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("w")))
SYNONYMS = [("儿科门诊", "小儿门诊"), ("门诊", "诊室"), ("the", "der")]


def segmented_questions(t):
    """Questions as segments (words) and their tokens, one of them in Chinese, of two tokens."""
    words = F.slice(F.concat(F.array(F.lit("儿科门诊")), text.tokens("text")), 1, 256)
    segments = t.benchmark.select(c("item_id").alias("query_id"), F.posexplode(words).alias("seg", "segment"))
    parts = F.when(c("segment") == "儿科门诊", F.array(F.struct(F.lit("儿科").alias("token"), F.lit(0.5).alias("weight")), F.struct(F.lit("门诊").alias("token"), F.lit(0.5).alias("weight")))).otherwise(F.array(F.struct(c("segment").alias("token"), F.lit(1.0).alias("weight"))))
    weights = segments.select("query_id", "seg", F.explode(parts).alias("x")).select("query_id", "seg", "x.token", "x.weight")
    return L.segment_clauses(segments, weights, t.spark.createDataFrame(SYNONYMS, "term string, synonym string"))


add(
    "v23_segment_clauses",
    lambda t: segmented_questions(t).groupBy("query_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")),
    rf"""WITH w AS (SELECT item_id AS query_id, unnest({TOK}[1:255]) AS token FROM benchmark), k AS (SELECT query_id, 'term' AS kind, CASE WHEN token = 'the' THEN 5.0 ELSE 1.0 END AS w FROM w
 UNION ALL SELECT query_id, unnest(['fine_phrase', 'fine_near']), unnest([1.0, 0.5]) FROM w WHERE length(token) >= 3 AND NOT regexp_full_match(token, '[0-9a-z.+#_*-]+')
 UNION ALL SELECT query_id, unnest(['token_synonym', 'segment_synonym']), unnest([1.0, 0.7]) FROM w WHERE token = 'the'
 UNION ALL SELECT item_id, unnest(['term', 'term', 'token_synonym', 'segment_near', 'segment_synonym']), unnest([2.5, 2.5, 0.5, 7.5, 0.7]) FROM benchmark)
 SELECT query_id, kind, count(*) AS n, round(sum(w)::DOUBLE, 6) AS weight FROM k GROUP BY 1, 2""",
)
add("v33_toc_boost", lambda t: V.boost_merge(hits(t), hits(t).join(V.best_document(hits(t), "label"), ["query_id", "label"]).select("query_id", "chunk_id", F.lit(0.1).alias("sim"))).groupBy("query_id").agg(F.round(F.sum("sim"), 5).alias("s")), f"WITH h AS ({NEAR}), b AS (SELECT query_id, label FROM (SELECT query_id, label, round(sum(cosine), 9) AS s FROM h GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) = 1) SELECT h.query_id, round(sum(cosine + CASE WHEN b.label IS NULL THEN 0 ELSE 0.1 END), 5) AS s FROM h LEFT JOIN b ON b.query_id = h.query_id AND b.label = h.label GROUP BY 1")
add("v34_collapsed_tokens", lambda t: t.conversations.groupBy("conv_id").agg(F.size(F.flatten(F.collect_list(text.tokens("text")))).cast("long").alias("n")), rf"SELECT conv_id, sum(len({TOK}))::BIGINT AS n FROM conversations GROUP BY 1")
add("v40_text_match", lambda t: t.documents.where(text_sql.ts_match(c("text"), "%the of and ingest%", 0.5)).select("doc_id"), f"SELECT doc_id FROM documents WHERE len(list_intersect(list_distinct({TOK}), ['the', 'of', 'and', 'ingest'])) >= 2")
STATEMENT = """SELECT doc_id, `lang` FROM told_texts d WHERE (d.content_ltks LIKE '%the of, and ingest%' -- content_ltks = 'nothing'
 OR `content_ltks`='le d''accord') AND note <> 'content_ltks = ''the''' /* title_tks = 'x' */ AND content_ltks NOT LIKE '%zweite%'"""


def told_statement(t):
    t.documents.select("doc_id", "lang", c("text").alias("content_ltks"), F.concat(F.lit("note "), "lang").alias("note")).createOrReplaceTempView("told_texts")
    return text_sql.search_sql(t.spark, STATEMENT, 0.5)


def _has(words, least):
    return f"len(list_intersect(list_distinct({TOK}), {words})) >= {least}"


add("v40_statement", told_statement, f"SELECT doc_id, lang FROM documents WHERE ({_has(['the', 'of', 'and', 'ingest'], 2)} OR {_has(['le', 'd', 'accord'], 1)}) AND NOT ({_has(['zweite'], 1)})")
add("f23_scoped_sql", lambda t: _scoped(t), f"SELECT lang, count(*) AS n FROM {CHUNKS} WHERE kb_id IN ('src1', 'src2') GROUP BY 1")


def _scoped(t):
    text_sql.scoped_view(t.spark, chunks(t), ["src1", "src2"], "scoped_chunks")
    return t.spark.sql("SELECT lang, count(*) AS n FROM scoped_chunks GROUP BY 1")


add("r2_visible_dialogs", lambda t: R.page_with_total(t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).where((c("c_nationkey") < 5) | (c("c_custkey") == 3)), [c("o_orderdate").desc(), c("o_orderkey")], 1, 30).select("o_orderkey", "c_name", "total"), "SELECT o_orderkey, c_name, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5 OR c_custkey = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
add("r3_conversations_of_dialogs", lambda t: t.orders.where(c("o_custkey").isin(1, 2, 4)).select("o_orderkey", "o_custkey").orderBy("o_custkey", c("o_orderkey").desc()), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 4)")
add("r4_search_detail", lambda t: t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).where("s_suppkey = 5").select("s_suppkey", "s_name", "n_name"), "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 5")
add("r10_versions", lambda t: R.latest(t.lineitem, ["l_partkey"], [c("l_shipdate").desc(), c("l_orderkey"), c("l_linenumber"), c("l_extendedprice")], 3).groupBy("l_partkey").agg(F.max("l_shipdate").alias("newest"), F.count("*").alias("n")), "SELECT l_partkey, max(l_shipdate) AS newest, count(*) AS n FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice) <= 3) GROUP BY 1")
add("r12_unique_names", lambda t: R.rename_repeated(t.part.select("p_partkey", F.concat("p_brand", F.lit(".pdf")).alias("name")), "name", [c("p_partkey")]), "SELECT p_partkey, p_brand || CASE WHEN n > 1 THEN '(' || (n - 1) || ')' ELSE '' END || '.pdf' AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
add("r13_existence", lambda t: t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True)), "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has")), "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has FROM customer")
add("r15_user_lookup", lambda t: t.customer.where(P.operator_filter([("c_name", "==", "Customer#000000007"), ("c_acctbal", ">", -10000)])).select("c_custkey", "c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_name = 'Customer#000000007' AND c_acctbal > -10000")
add("q03_migration", lambda t: store.migrate(t.nation, {"created": "timestamp"}, {"n_nationkey": "string"}, {"n_name": "name"}).select("n_nationkey", "name", c("created").isNull().alias("fresh")), "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name AS name, true AS fresh FROM nation")
LINKS = [("orders", "o_orderkey", "lineitem", "l_orderkey")]
add("q07_dialog_cascade", lambda t: K.cascade({"orders": t.orders, "lineitem": t.lineitem}, "orders", c("o_orderstatus") == "P", LINKS)["lineitem"].agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
add("q08_error_report", lambda t: t.events.where("event_type = 'error'").groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.substring("props", 1, 128))), 1, 5), ";").alias("errors")), "SELECT user_id, array_to_string(list_sort(list(left(props, 128)))[1:5], ';') AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
add("q09_upload_pipeline", lambda t: S.per_document(t.pages.select(c("page_id").alias("doc_id"), text.html_text("html").alias("text")), S.naive_chunks, "chunk string, tokens int").withColumn("chunk_id", F.md5(F.concat_ws(":", "chunk", "doc_id"))).select("doc_id", "pos", "chunk_id", "tokens", F.size(models.embed(c("chunk"))).alias("dim")))
add("q11_metadata_scan", lambda t: t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")), "SELECT source, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
add("c05_tokenised_chunks", lambda t: S.per_document(t.documents, S.naive_chunks, "chunk string, tokens int").select("doc_id", "pos", F.size(text.tokens(text.strip_table_tags("chunk"))).alias("n")))
