"""Queries of predicates, joins, aggregations, windows, sorting and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import folders
from siltstone.operators import corpus as C
from siltstone.operators import predicates as P
from siltstone.operators import relational as R
from siltstone.plans.registry import add

c = F.col


def chunks(t):
    """Documents as chunks: kb_id, tags, an availability flag that some lack."""
    return t.documents.select(
        c("doc_id").alias("chunk_id"), c("source").alias("kb_id"), "lang", "n_chars",
        F.when(c("doc_id") % 3 == 0, 0).when(c("doc_id") % 3 == 1, 1).cast("int").alias("available_int"),
        F.array_compact(F.array("lang", F.when(c("doc_id") % 2 == 0, F.lit("even")))).alias("tag_kwd"),
    )


CHUNKS = "(SELECT doc_id AS chunk_id, source AS kb_id, lang, n_chars, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS available_int, CASE WHEN doc_id % 2 = 0 THEN [lang, 'even'] ELSE [lang] END AS tag_kwd FROM documents) ch"

# Scans, lookups, projections
add("s18_filtered_scan", lambda t: chunks(t).where(P.term_filter(chunks(t), {"kb_id": ["src1", "src2"], "available_int": 1, "lang": ""})).select("chunk_id", "kb_id").orderBy(c("n_chars").desc(), "chunk_id").limit(20), f"SELECT chunk_id, kb_id FROM {CHUNKS} WHERE kb_id IN ('src1', 'src2') AND coalesce(available_int, 1) >= 1 ORDER BY n_chars DESC, chunk_id LIMIT 20")
add("s19_point_lookup", lambda t: chunks(t).where(c("chunk_id") == 7).select("chunk_id", "kb_id", "lang"), f"SELECT chunk_id, kb_id, lang FROM {CHUNKS} WHERE chunk_id = 7")
add("s20_lookups", lambda t: P.model_filter(t.orders, {"o_orderkey": [1, 2, 3, 7], "o_orderstatus": None, "nope": 1}).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 2, 3, 7)")
add("s21_full_scan", lambda t: t.orders.select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders")
add("p1_projection", lambda t: t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("dim")), "SELECT vec_id, len(embedding)::BIGINT AS dim FROM embeddings")
add("p2_field_map", lambda t: chunks(t).select("chunk_id", F.when(F.size("tag_kwd") == 1, F.get("tag_kwd", 0)).otherwise(F.array_join("tag_kwd", " ")).alias("tags"), c("n_chars").cast("string").alias("n_chars")), f"SELECT chunk_id, array_to_string(tag_kwd, ' ') AS tags, n_chars::VARCHAR AS n_chars FROM {CHUNKS}")
add("p3_alias_fallback", lambda t: chunks(t).select("chunk_id", F.coalesce(c("available_int").cast("string"), "kb_id").alias("value")), f"SELECT chunk_id, coalesce(available_int::VARCHAR, kb_id) AS value FROM {CHUNKS}")
add("p4_key_remap", lambda t: t.customer.select("c_custkey", "c_name").withColumnsRenamed({"c_custkey": "chunk_count", "c_name": "name"}), "SELECT c_custkey AS chunk_count, c_name AS name FROM customer")
add("p5_message_mapping", lambda t: t.conversations.selectExpr("concat(conv_id, '_', turn) AS id", "turn AS message_id", "role AS message_type", "text AS content_ltks"), "SELECT conv_id || '_' || turn AS id, turn AS message_id, role AS message_type, text AS content_ltks FROM conversations")
add("f1_term_filter", lambda t: chunks(t).where(P.term_filter(chunks(t), {"tag_kwd": ["even", "x"], "lang": "de"})).select("chunk_id"), f"SELECT chunk_id FROM {CHUNKS} WHERE list_has_any(tag_kwd, ['even', 'x']) AND lang = 'de'")
add("f2_available_on", lambda t: chunks(t).where(P.available(1)).groupBy("kb_id").count().withColumnRenamed("count", "n"), f"SELECT kb_id, count(*) AS n FROM {CHUNKS} WHERE coalesce(available_int, 1) >= 1 GROUP BY kb_id")
add("f2_available_off", lambda t: chunks(t).where(P.available(0)).groupBy("kb_id").count().withColumnRenamed("count", "n"), f"SELECT kb_id, count(*) AS n FROM {CHUNKS} WHERE available_int < 1 GROUP BY kb_id")
add("f3_request_filter", lambda t: chunks(t).where(P.term_filter(chunks(t), {"kb_id": ["src3"], "chunk_id": [], "removed_kwd": None})).select("chunk_id"), f"SELECT chunk_id FROM {CHUNKS} WHERE kb_id = 'src3'")
add("f4_exists", lambda t: chunks(t).where(P.term_filter(chunks(t), {"must_not_exists": "available_int", "exists": "lang"})).select("chunk_id"), f"SELECT chunk_id FROM {CHUNKS} WHERE available_int IS NULL AND lang IS NOT NULL")
add("f5_substring_filter", lambda t: t.customer.where(c("c_name").contains("00001")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE contains(c_name, '00001')")
add("f6_not_forgotten", lambda t: t.events.withColumn("forget_at", F.when(c("event_type") == "error", c("ts"))).where("forget_at IS NULL").groupBy("user_id").agg(F.count("*").alias("n")), "SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id")
add("f7_model_filter", lambda t: P.model_filter(t.orders, {"o_totalprice": [1000, None], "o_orderstatus": ["O", "P"]}, ("o_totalprice",)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('O', 'P')")
add("f8_operator_filter", lambda t: t.part.where(P.operator_filter([("p_size", ">=", 10), ("p_size", "<", 40), ("p_brand", "^", "Brand"), ("p_type", "!=", "x"), ("p_name", "%", "%1%")])).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND starts_with(p_brand, 'Brand') AND p_type <> 'x' AND p_name LIKE '%1%'")
add("f9_keyword", lambda t: t.part.where(P.keyword("p_brand", "BRAND#1")).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'brand#1')")
add("f10_null_tolerant", lambda t: chunks(t).where(P.not_equal("available_int", 0)).select("chunk_id"), f"SELECT chunk_id FROM {CHUNKS} WHERE available_int IS DISTINCT FROM 0")
add("f11_bit_flags", lambda t: t.part.where(P.operator_filter([("p_size", "&", 4)])).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size & 4 > 0")
add("f12_date_window", lambda t: t.orders.where(c("o_orderdate").between("1996-01-01", "1996-12-31")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
add("f13_progress_guard", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", P.advances(F.when(c("l_linenumber") == 3, -1.0).otherwise(c("l_discount") * 5), c("l_tax") * 10).alias("ok")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN l_tax * 10 >= 1 ELSE l_tax * 10 >= 1 OR l_tax * 10 > l_discount * 5 END AS ok FROM lineitem")
add("f14_recent", lambda t: t.events.where(P.recent("ts", "2024-01-30 00:00:00", 86400)).select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'")

META = [("p_brand", "brand"), ("p_type", "type"), ("p_size", "size")]


def meta(t):
    return t.part.select(c("p_partkey").alias("doc_id"), F.explode(F.create_map(*[x for col, k in META for x in (F.lit(k), c(col).cast("string"))])).alias("key", "value"))


META_SQL = "(SELECT p_partkey AS doc_id, unnest(['brand', 'type', 'size']) AS key, unnest([p_brand, p_type, p_size::VARCHAR]) AS value FROM part) m"
add("f15_meta_and", lambda t: P.meta_filter(meta(t), [{"key": "brand", "op": "contains", "value": "brand#1"}, {"key": "size", "op": ">", "value": "20"}]), "SELECT p_partkey AS doc_id FROM part WHERE contains(lower(p_brand), 'brand#1') AND p_size > 20")
add("f15_meta_or", lambda t: P.meta_filter(meta(t), [{"key": "brand", "op": "=", "value": "brand#12"}, {"key": "size", "op": "≤", "value": "3"}], "or"), "SELECT p_partkey AS doc_id FROM part WHERE lower(p_brand) = 'brand#12' OR p_size <= 3")
add("f15_meta_lenient_and", lambda t: P.meta_filter(meta(t), [{"key": "brand", "op": "=", "value": "none"}, {"key": "size", "op": ">=", "value": "45"}], strict=False), "SELECT p_partkey AS doc_id FROM part WHERE p_size >= 45")
for i, (op, value, sql) in enumerate([("≠", "Brand#1", "lower(value) <> 'brand#1'"), ("not contains", "1", "NOT contains(lower(value), '1')"), ("in", "brand#1,brand#2", "contains('brand#1,brand#2', lower(value))"), ("not in", "brand#1,brand#2", "NOT contains('brand#1,brand#2', lower(value))"), ("start with", "BRAND#2", "starts_with(lower(value), 'brand#2')"), ("end with", "3", "suffix(lower(value), '3')"), ("empty", "", "value = ''"), ("not empty", "", "value <> ''")]):
    add(f"f15_meta_op_{i}_{op.replace(' ', '_').replace('≠', 'ne')}", lambda t, op=op, value=value: P.meta_filter(meta(t), [{"key": "brand", "op": op, "value": value}]), f"SELECT DISTINCT doc_id FROM {META_SQL} WHERE key = 'brand' AND {sql}")
CASES = [("manual", "brand#12"), ("manual", "nothing"), ("auto", "nothing"), ("auto", "brand#13"), ("semi_auto", "nothing")]


def restricted(t):
    """Small parts, restricted further by the brand, in each mode: with matches and without."""
    base, out = meta(t).where("key = 'size' AND value::int < 5").select(c("doc_id").cast("string")), None
    for i, (mode, brand) in enumerate(CASES):
        found = P.meta_filter(meta(t), [{"key": "brand", "op": "=", "value": brand}]).select(c("doc_id").cast("string"))
        one = P.restriction(base, found, mode).select(F.lit(i).alias("case"), F.lit(mode).alias("mode"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


add("f16_f17_restriction", restricted, " UNION ALL ".join(f"""SELECT {i} AS "case", '{mode}' AS mode, doc_id FROM (WITH f AS (SELECT p_partkey::VARCHAR AS doc_id FROM part WHERE lower(p_brand) = '{brand}') SELECT doc_id FROM f UNION ALL
SELECT p_partkey::VARCHAR FROM part WHERE p_size < 5 AND (EXISTS (FROM f) OR '{mode}' <> 'manual') UNION ALL SELECT '-999' WHERE NOT EXISTS (FROM f) AND '{mode}' = 'manual')""" for i, (mode, brand) in enumerate(CASES)))
add("f18_noise_lines", lambda t: t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "line"))).where(P.noise(F.lit("paragraph"), c("line"), c("n"))).select("doc_id", "line"), r"SELECT doc_id, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE regexp_full_match(line, '第?\s*[0-9]+\s*页') OR regexp_full_match(line, '[0-9]+') OR (length(line) <= 30 AND n >= 4)")
add("f19_f20_valid_rows", lambda t: t.part.where((F.length(F.trim("p_name")) > 0)).select("p_partkey", P.clean_label("p_type").alias("clean")), "SELECT p_partkey, regexp_full_match(p_type, '[一-龥A-Za-z]+') AND length(p_type) <= 12 AS clean FROM part WHERE length(trim(p_name)) > 0")
add("f21_length_range", lambda t: t.documents.where(F.length("text").between(50, 800)).select("doc_id"), "SELECT doc_id FROM documents WHERE length(text) BETWEEN 50 AND 800")
add("f22_toc_titles", lambda t: t.part.where(~c("p_name").rlike(r"^-?[0-9]+$") & (F.size(F.split("p_name", " ")) <= 22)).select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT regexp_full_match(p_name, '-?[0-9]+') AND len(string_split(p_name, ' ')) <= 22")

# Joins
add("j1_catalogue_join", lambda t: t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey")).join(t.part, c("l_partkey") == c("p_partkey")).join(t.supplier, (c("l_suppkey") == c("s_suppkey")) & (c("s_acctbal") > 0), "left").select("l_orderkey", "l_linenumber", "p_name", "s_name"), "SELECT l_orderkey, l_linenumber, p_name, s_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0")
add("j2_filtered_page", lambda t: R.page_with_total(t.orders.where(c("o_orderstatus").isin("O", "F")).join(t.customer.where(P.keyword("c_name", "customer")), c("o_custkey") == c("c_custkey"), "left"), [c("o_orderdate").desc(), c("o_orderkey")], 2, 15).select("o_orderkey", "c_name", "total"), "SELECT o_orderkey, c_name, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'F')) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND contains(lower(c_name), 'customer') WHERE o_orderstatus IN ('O', 'F') ORDER BY o_orderdate DESC, o_orderkey LIMIT 15 OFFSET 15")
add("j3_detail_join", lambda t: t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
add("j4_id_list", lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
add("j5_four_way", lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")), "SELECT n_name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
add("j6_task_retry", lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", F.when(c("l_linenumber") >= 3, -1.0).otherwise(c("l_discount")).alias("progress"), (c("l_linenumber") + 1).alias("retry")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 3 THEN -1.0 ELSE l_discount END::DOUBLE AS progress, l_linenumber + 1 AS retry FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
add("j7_distinct_locations", lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, (c("o_custkey") == c("c_custkey")) & (c("c_acctbal") > 0), "left").select(F.coalesce("c_custkey", F.lit(-1)).alias("parent"), c("l_suppkey").alias("location")).dropDuplicates(), "SELECT DISTINCT coalesce(c_custkey, -1) AS parent, l_suppkey AS location FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
add("j9_visibility", lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).where((c("c_nationkey").isin(1, 2, 3) & (c("o_orderstatus") == "O")) | (c("o_custkey") == 7)).select("o_orderkey"), "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_nationkey IN (1, 2, 3) AND o_orderstatus = 'O') OR o_custkey = 7")
add("j10_log_join", lambda t: t.events.join(t.customer, c("user_id") == c("c_custkey")).select("event_id", "c_name"), "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
add("j11_semi_join", lambda t: R.semi(t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.where("l_discount >= 0.09").withColumnRenamed("l_orderkey", "k"), ["k"]).select("k"), "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.09)")
add("j12_anti_join", lambda t: R.anti(t.customer.withColumnRenamed("c_custkey", "k"), t.orders.withColumnRenamed("o_custkey", "k"), ["k"]).select("k"), "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("j13_page_metadata", lambda t: t.documents.orderBy("doc_id").limit(50).join(t.labels, "doc_id", "left").select("doc_id", "quality"), "SELECT doc_id, quality FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 50) LEFT JOIN labels USING (doc_id)")
add("j14_owner_map", lambda t: t.orders.join(t.customer.where("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("owner")), "SELECT o_orderkey, coalesce(c_name, '') AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
add("j20_digest_reuse", lambda t: t.lineitem.alias("n").where("l_linenumber > 1").join(t.lineitem.alias("o").where("l_linenumber = 1"), (c("n.l_partkey") == c("o.l_partkey")) & (c("n.l_suppkey") == c("o.l_suppkey"))).select(c("n.l_orderkey").alias("new"), c("n.l_linenumber").alias("line"), c("o.l_orderkey").alias("old")), "SELECT n.l_orderkey AS new, n.l_linenumber AS line, o.l_orderkey AS old FROM lineitem n JOIN lineitem o ON n.l_partkey = o.l_partkey AND n.l_suppkey = o.l_suppkey WHERE n.l_linenumber > 1 AND o.l_linenumber = 1")
add("j23_graph_edges", lambda t: _graph(t), """WITH n AS (SELECT o_custkey AS id, sum(o_totalprice) AS rank FROM orders GROUP BY 1 ORDER BY rank DESC, id LIMIT 256), e AS (SELECT o_custkey AS source, l_suppkey AS target, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT source, target, weight FROM e WHERE source <> target AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) ORDER BY weight DESC, source, target LIMIT 128""")
add("j24_title_match", lambda t: t.nation.join(t.region, F.replace(F.lower("n_name"), F.lit(" "), F.lit("")) == F.replace(F.lower("r_name"), F.lit(" "), F.lit("")), "left").select("n_nationkey", "r_regionkey"), "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON replace(lower(n_name), ' ', '') = replace(lower(r_name), ' ', '')")
add("j25_display_map", lambda t: t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", "s_name").alias("display")), "SELECT s_suppkey, coalesce(n_name, s_name) AS display FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")


def _graph(t):
    nodes = t.orders.groupBy(c("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("rank")).orderBy(c("rank").desc(), "id").limit(256).select("id")
    edges = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey")).groupBy(c("o_custkey").alias("source"), c("l_suppkey").alias("target")).agg(F.count("*").alias("weight"))
    kept = edges.where("source <> target").join(nodes, c("source") == c("id"), "left_semi").join(nodes, c("target") == c("id"), "left_semi")
    return kept.orderBy(c("weight").desc(), "source", "target").limit(128)


def tree(t):
    """Regions, nations and customers as one folder tree with sizes."""
    return (
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.concat(F.lit("r"), "r_regionkey").alias("parent_id"), c("r_name").alias("name"), F.lit(0).cast("long").alias("size"))
        .union(t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.lit(0).cast("long")))
        .union(t.customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name", F.length("c_name").cast("long")))
    )


TREE = "tree AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name, 0 AS size FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 0 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, length(c_name) FROM customer), up AS (SELECT id AS node, parent_id AS ancestor, 1 AS distance FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT up.node, t.parent_id, up.distance + 1 FROM up JOIN tree t ON t.id = up.ancestor WHERE t.parent_id IS NOT NULL)"
add("j26_ancestors", lambda t: R.ancestors(tree(t)), f"WITH RECURSIVE {TREE} SELECT node, ancestor, distance FROM up")
add("j26_paths", lambda t: R.paths(tree(t), "name"), f"WITH RECURSIVE {TREE} SELECT t.id, coalesce((SELECT string_agg(a.name, '/' ORDER BY up.distance DESC) || '/' FROM up JOIN tree a ON a.id = up.ancestor WHERE up.node = t.id), '') || t.name AS path FROM tree t")
add("a30_folder_sizes", lambda t: R.subtree_sizes(tree(t), "size"), f"WITH RECURSIVE {TREE} SELECT id, sum(size)::BIGINT AS size FROM (SELECT id, size FROM tree UNION ALL SELECT ancestor, size FROM up JOIN tree ON tree.id = up.node) GROUP BY id")
add("a31_has_child", lambda t: tree(t).alias("a").join(tree(t).where("id <> parent_id").select(c("parent_id").alias("p")).distinct(), c("id") == c("p"), "left").select("id", c("p").isNotNull().alias("has_child")), f"WITH RECURSIVE {TREE} SELECT id, id IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL) AS has_child FROM tree")
add("r6_children", lambda t: tree(t).where("parent_id = 'r1' AND id <> parent_id").select("id", "name"), f"WITH RECURSIVE {TREE} SELECT id, name FROM tree WHERE parent_id = 'r1'")
add("q5_delete_subtree", lambda t: tree(t).join(R.ancestors(tree(t)).where("ancestor = 'r2'").select(c("node").alias("id")), "id", "left_anti").where("id <> 'r2'").select("id"), f"WITH RECURSIVE {TREE} SELECT id FROM tree WHERE id <> 'r2' AND id NOT IN (SELECT node FROM up WHERE ancestor = 'r2')")


def filed(t):
    """Regions, nations and customers as folders and files whose names collide."""
    turn = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.concat(F.lit("c"), "c_custkey"))) - 1
    rows = [
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), c("r_name").alias("name"), F.lit("folder").alias("kind"), F.lit("").alias("location")),
        t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("f"), c("n_nationkey") % 7), F.lit("folder"), F.lit("")),
        t.customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_mktsegment", F.lit("file"), F.concat("c_mktsegment", F.repeat(F.lit("_"), turn))),
    ]
    return rows[0].union(rows[1]).union(rows[2])


def merged_nations(t):
    """All nations of other regions are moved into the first one; those of one name merge."""
    return folders.move_into(filed(t), filed(t).where("id LIKE 'n%' AND parent_id <> 'r0'"), "r0")


add("q4_move_folder", merged_nations, """
WITH n AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS p, 'f' || n_nationkey % 7 AS name FROM nation), th AS (SELECT name, min(id) AS t FROM n WHERE p = 'r0' GROUP BY 1),
m AS (SELECT n.id, n.name, t IS NULL AS fresh, coalesce(t, md5('r0/' || n.name)) AS dest FROM n LEFT JOIN th USING (name) WHERE p <> 'r0'),
cu AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS p, c_mktsegment AS name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY 'c' || c_custkey) - 1 AS k FROM customer),
x AS (SELECT cu.id, coalesce(m.dest, cu.p) AS parent_id, cu.name, k, dest FROM cu LEFT JOIN m ON m.id = cu.p), e AS (SELECT parent_id, name, count(*) AS e FROM x WHERE dest IS NULL GROUP BY 1, 2)
SELECT 'r' || r_regionkey AS id, 'root' AS parent_id, r_name AS name, 'folder' AS kind, '' AS location FROM region UNION ALL SELECT id, p, name, 'folder', '' FROM n WHERE p = 'r0' UNION ALL SELECT DISTINCT dest, 'r0', name, 'folder', '' FROM m WHERE fresh
UNION ALL SELECT x.id, x.parent_id, x.name, 'file', x.name || repeat('_', CASE WHEN dest IS NULL THEN k ELSE coalesce(e, 0) + row_number() OVER (PARTITION BY dest, x.name ORDER BY x.id) - 1 END) FROM x LEFT JOIN e ON e.parent_id = x.dest AND e.name = x.name""")

# Aggregations
add("a1_facets", lambda t: R.facet(chunks(t), "tag_kwd", True), f"SELECT key, count(*) AS n FROM (SELECT DISTINCT chunk_id, unnest(tag_kwd) AS key FROM {CHUNKS}) GROUP BY key")
add("a2_hit_total", lambda t: chunks(t).where("lang = 'en'").agg(F.count("*").alias("total")), f"SELECT count(*) AS total FROM {CHUNKS} WHERE lang = 'en'")
add("a3_status_pivot", lambda t: R.status_counts(t.orders.withColumnRenamed("o_custkey", "kb_id"), "kb_id", "o_orderstatus", {"O": "running", "F": "done", "X": "fail"}, t.customer.select(c("c_custkey").alias("kb_id"))), "SELECT c_custkey AS kb_id, count(*) FILTER (o_orderstatus = 'O')::INT AS running, count(*) FILTER (o_orderstatus = 'F')::INT AS done, 0 AS fail FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("a4_conditional_sums", lambda t: t.orders.groupBy("o_custkey").agg(F.count_if(c("o_orderstatus") == "F").alias("finished"), F.count_if(c("o_orderstatus") == "P").alias("failed"), F.coalesce(F.round(F.sum(F.when(c("o_orderstatus") == "O", c("o_totalprice"))), 2), F.lit(0.0)).alias("open")), "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS failed, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0.0) AS open FROM orders GROUP BY 1")
add("a5_daily_stats", lambda t: t.events.join(t.customer, c("user_id") == c("c_custkey"), "left").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("pv"), F.countDistinct("user_id").alias("uv"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.avg("value"), 4).alias("speed"), F.count_if(c("event_type") == "click").alias("thumbs")), "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS pv, count(DISTINCT user_id) AS uv, round(sum(value), 4) AS tokens, round(avg(value), 4) AS speed, count(*) FILTER (event_type = 'click') AS thumbs FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1")
add("a6_total_size", lambda t: t.documents.groupBy("source").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size")), "SELECT source, coalesce(sum(n_chars), 0)::BIGINT AS size FROM documents GROUP BY source")
add("a7_count_by_kb", lambda t: t.documents.groupBy("source").agg(F.count("*").alias("n")), "SELECT source, count(*) AS n FROM documents GROUP BY source")
add("a8_duplicate_keys", lambda t: R.repeated(t.orders, ["o_custkey", "o_orderstatus"]), "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
add("a8_rename_duplicates", lambda t: R.rename_repeated(t.lineitem.select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit(".txt")).alias("name")), "name", [c("l_orderkey"), c("l_linenumber")]), "SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN n > 1 THEN '(' || (n - 1) || ')' ELSE '' END || '.txt' AS name FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)")
add("a9_latest_session", lambda t: t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last")), "SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1")
add("a11_filter_panel", lambda t: chunks(t).groupingSets([["lang"], ["kb_id"]], "lang", "kb_id").agg(F.count("*").alias("n"), F.count_if(c("available_int").isNull()).alias("empty")), f"SELECT lang, kb_id, count(*) AS n, count(*) FILTER (available_int IS NULL) AS empty FROM {CHUNKS} GROUP BY GROUPING SETS ((lang), (kb_id))")
add("a12_inverted_metadata", lambda t: meta(t).groupBy("key", "value").agg(F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("ids")), f"SELECT key, value, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM {META_SQL} GROUP BY key, value")
add("a13_metadata_summary", lambda t: _summary(t), f"SELECT key, value, count(*) AS n, CASE WHEN key = 'size' THEN 'number' ELSE 'string' END AS type FROM {META_SQL} GROUP BY key, value")


def _summary(t):
    from siltstone.functions import text

    typed = meta(t).withColumn("type", text.value_type("value"))
    kinds = typed.groupBy("key", "type").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "type")).alias("k")).select("key", c("k.type").alias("type"))
    return typed.groupBy("key", "value").agg(F.count("*").alias("n")).join(F.broadcast(kinds), "key")


add("a14_document_hits", lambda t: t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first")).orderBy(c("n").desc(), "l_suppkey"), "SELECT l_suppkey, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1")
add("a18_source_totals", lambda t: t.documents.agg(F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count("*").alias("rows")), "SELECT count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, count(*) AS rows FROM documents")
add("a19_field_values", lambda t: chunks(t).select(F.explode("tag_kwd").alias("v")).select(F.trim("v").alias("v")).where("v <> ''").groupBy("v").agg(F.count("*").alias("n")), f"SELECT trim(v) AS v, count(*) AS n FROM (SELECT unnest(tag_kwd) AS v FROM {CHUNKS}) GROUP BY 1")
add("a21_max_id", lambda t: t.conversations.groupBy("conv_id").agg(F.coalesce(F.max("turn"), F.lit(1)).alias("last")), "SELECT conv_id, coalesce(max(turn), 1) AS last FROM conversations GROUP BY 1")


def task_progress():
    return F.when(c("l_linenumber") % 5 == 0, -1.0).when(c("l_returnflag") == "N", c("l_discount") * 10).otherwise(1.0)


add("a22_progress", lambda t: R.progress_of(t.lineitem.withColumn("p", task_progress()), "l_orderkey", "p").withColumn("progress", F.round("progress", 6)), "SELECT l_orderkey, round(CASE WHEN bool_and(p >= 1 OR p < 0) AND min(p) = -1 THEN -1.0 WHEN bool_and(p >= 1 OR p < 0) THEN 1.0 ELSE avg(greatest(p, 0)) END, 6)::DOUBLE AS progress, CASE WHEN bool_and(p >= 1 OR p < 0) AND min(p) = -1 THEN '4' WHEN bool_and(p >= 1 OR p < 0) THEN '3' ELSE '1' END AS run FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 5 = 0 THEN -1.0 WHEN l_returnflag = 'N' THEN l_discount * 10 ELSE 1.0 END::DOUBLE AS p FROM lineitem) GROUP BY 1")
add("a26_latency_summary", lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)]), "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
add("a27_request_rate", lambda t: t.events.agg(F.round(F.count("*") / ((F.max(F.unix_millis(c("ts").cast("timestamp"))) - F.min(F.unix_millis(c("ts").cast("timestamp")))) / 1000), 6).alias("qps")), "SELECT round(count(*) / ((max(epoch_us(ts)) // 1000 - min(epoch_us(ts)) // 1000) / 1000), 6) AS qps FROM events")
add("a29_grouped_lists", lambda t: t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names")), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")

# Windows, sorting, sets
add("w12_latest_version", lambda t: R.latest(t.orders, ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey").desc()]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
add("w04_token_budget", lambda t: t.documents.withColumn("run", F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))).where(c("run") <= 0.97 * 20000).select("source", "doc_id"), "SELECT source, doc_id FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents) WHERE run <= 0.97 * 20000")
add("w08_islands", lambda t: _islands(t), "WITH f AS (SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) THEN 1 ELSE 0 END AS new FROM lineitem), g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS island FROM f) SELECT l_suppkey, island::BIGINT AS island, any_value(l_returnflag) AS flag, count(*) AS n FROM g GROUP BY 1, 2")


def _islands(t):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    new = F.when(F.lag("l_returnflag").over(w).eqNullSafe(c("l_returnflag")), 0).otherwise(1)
    return t.lineitem.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("l_suppkey", "island").agg(F.first("l_returnflag").alias("flag"), F.count("*").alias("n"))


add("w09_part_numbers", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber")).alias("part")), "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber)::INT AS part FROM lineitem")
add("w10_section_prefix", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.lag("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).eqNullSafe(c("l_returnflag")), "").otherwise(F.concat(F.lit("§"), "l_returnflag")).alias("prefix")), "SELECT l_orderkey, l_linenumber, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) IS NOT DISTINCT FROM l_returnflag THEN '' ELSE '§' || l_returnflag END AS prefix FROM lineitem")
add("t1_multi_key_order", lambda t: t.orders.orderBy(c("o_orderstatus").asc(), c("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 25")
add("t2_array_order", lambda t: t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q")).orderBy(R.array_mean(c("q")).asc_nulls_last(), "l_orderkey").limit(30).select("l_orderkey"), "SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY avg(l_quantity), l_orderkey LIMIT 30")
add("t3_offset_page", lambda t: t.orders.orderBy("o_orderkey").offset(40).limit(20).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
add("t4_keyset_page", lambda t: R.after(t.lineitem, ["l_orderkey", "l_linenumber"], [100, 2], 50).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY 1, 2 LIMIT 50")
add("t5_chunk_list", lambda t: t.lineitem.where("l_suppkey = 3").orderBy("l_orderkey", "l_linenumber").limit(128).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 ORDER BY 1, 2 LIMIT 128")
add("t6_page_with_total", lambda t: R.page_with_total(t.customer, [c("c_acctbal").desc(), c("c_custkey")], 3, 10).select("c_custkey", "total"), "SELECT c_custkey, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20")
add("t10_bucket_order", lambda t: t.part.groupBy("p_type").agg(F.count("*").alias("n")).withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c("p_type") == "misc", c("n").desc(), "p_type"))), "SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY p_type = 'misc', count(*) DESC, p_type)::INT AS pos FROM part GROUP BY p_type")
add("t12_most_common", lambda t: t.part.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "p_brand").limit(20), "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 20")
add("t13_sample", lambda t: C.sampled(t.documents, "doc_id", 25).select("doc_id"), "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25")
add("t14_sample_with_replacement", lambda t: t.documents.sample(True, 0.1, 42).select("doc_id"))
add("u1_set_algebra", lambda t: t.orders.where("o_orderstatus = 'O'").select("o_custkey").intersect(t.orders.where("o_orderstatus = 'F'").select("o_custkey")).union(t.customer.where("c_custkey < 5").select("c_custkey")).distinct(), "SELECT * FROM ((SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION SELECT c_custkey FROM customer WHERE c_custkey < 5)")
add("u2_union_all", lambda t: t.nation.select(c("n_name").alias("name")).unionAll(t.region.select("r_name")), "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
add("u3_array_union", lambda t: chunks(t).select("chunk_id", F.array_join(F.array_sort(F.array_union("tag_kwd", F.array(F.lit("even"), F.lit("new")))), ",").alias("ids")), f"SELECT chunk_id, array_to_string(list_sort(list_distinct(list_concat(tag_kwd, ['even', 'new']))), ',') AS ids FROM {CHUNKS}")
add("u4_missing_ids", lambda t: t.customer.select(c("c_custkey").alias("k")).exceptAll(t.orders.select("o_custkey").distinct()), "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT DISTINCT o_custkey FROM orders")
add("u5_union_by_name", lambda t: t.documents.select("doc_id", "text").unionByName(t.benchmark.select("text", c("item_id").alias("doc_id"))).groupBy().agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark)")
add("u7_ordered_distinct", lambda t: chunks(t).select("chunk_id", F.array_join(F.array_distinct(F.concat("tag_kwd", F.array("lang"))), ",").alias("v")), f"SELECT chunk_id, array_to_string(tag_kwd, ',') AS v FROM {CHUNKS}")
add("u8_media_order", lambda t: t.lineitem.where("l_returnflag = 'A'").union(t.lineitem.where("l_returnflag <> 'A'")).orderBy(c("l_orderkey").asc_nulls_last(), "l_linenumber").limit(40).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2 LIMIT 40")

# Listings of the services
add("r1_listing", lambda t: R.page_with_total(t.customer.where(P.keyword("c_name", "1") & c("c_mktsegment").isNotNull()), [c("c_custkey").desc()], 1, 12).select("c_custkey", "c_name", "total"), "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE contains(c_name, '1')) AS total FROM customer WHERE contains(c_name, '1') ORDER BY c_custkey DESC LIMIT 12")
add("r5_conversation_list", lambda t: t.conversations.where(P.keyword("text", "the")).groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first")), "SELECT conv_id, count(*) AS n, min(turn) AS first FROM conversations WHERE contains(lower(text), 'the') GROUP BY 1")
add("r7_bit_flag_list", lambda t: t.part.where(P.operator_filter([("p_size", "&", 3)]) & P.keyword("p_name", "a")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size & 3 > 0 AND contains(lower(p_name), 'a')")
add("r8_logs", lambda t: R.page_with_total(t.events.where(P.not_equal("event_type", "view") & c("ts").between("2024-01-05", "2024-01-20")), [c("ts").desc(), c("event_id")], 1, 20).select("event_id", "total"), "SELECT event_id, (SELECT count(*) FROM events WHERE event_type <> 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS total FROM events WHERE event_type <> 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 20")
add("r9_task_order", lambda t: t.lineitem.orderBy("l_orderkey", c("l_linenumber").desc()).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem")
add("r11_field_map_union", lambda t: t.part.select(F.explode(F.create_map("p_brand", "p_type")).alias("k", "v"), "p_partkey").groupBy("k").agg(F.max_by("v", "p_partkey").alias("v")), "SELECT p_brand AS k, arg_max(p_type, p_partkey) AS v FROM part GROUP BY 1")
add("q10_duplicate_ids", lambda t: R.repeated(t.lineitem, ["l_partkey"]), "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
add("q15_validations", lambda t: t.customer.select("c_custkey", (F.octet_length("c_name") <= 128).alias("short"), F.regexp_extract("c_name", r"\.([a-z]+)$", 1).alias("ext")), r"SELECT c_custkey, strlen(c_name) <= 128 AS short, regexp_extract(c_name, '\.([a-z]+)$', 1) AS ext FROM customer")
add("q17_image_ids", lambda t: t.part.select("p_partkey", F.concat_ws("-", "p_brand", "p_name").alias("id")).select("p_partkey", F.split("id", "-", 2)[0].alias("bucket"), F.split("id", "-", 2)[1].alias("object")), "SELECT p_partkey, p_brand AS bucket, p_name AS object FROM part")
add("q18_graph_nodes", lambda t: t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("rank")).orderBy(F.coalesce("rank", F.lit(0)).desc(), "o_custkey").limit(256), "SELECT o_custkey, round(sum(o_totalprice), 2) AS rank FROM orders GROUP BY 1 ORDER BY rank DESC, o_custkey LIMIT 256")
