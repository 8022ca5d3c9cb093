"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import identifiers, text, vectors
from siltstone.plans.registry import add

c = F.col

WS = r"'[\s\x{3000}\x{00A0}\x{0085}]+'"


def _docs(t, **columns):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in columns.items()])


def _sql(table: str = "documents", key: str = "doc_id", **columns: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {table}"


COLLAPSED = f"trim(regexp_replace(coalesce(text, ''), {WS}, ' ', 'g'))"
add("x01_collapse_space", lambda t: _docs(t, v=text.collapse("text")), _sql(v=COLLAPSED))
add("x02_collapse_wide_space", lambda t: _docs(t, v=text.collapse_wide(F.concat(F.lit("　"), F.col("text")))), _sql(v=f"trim(regexp_replace(chr(12288) || text, {WS}, ' ', 'g'))"))
SAFE = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({x}, '[\s\x{{3000}}]+', ' ', 'g')), '[\\/:*?"<>|]+', '_', 'g'), '\s+', '', 'g'), '_+', '_', 'g')"""
add("x03_safe_name", lambda t: t.pages.select("page_id", text.safe_name("url").alias("v")), f"SELECT page_id, coalesce(nullif(left(trim({SAFE.format(x='url')}, '_'), 40), ''), 'untitled') AS v FROM pages")
add(
    "x04_title_and_specialty",
    lambda t: t.part.select("p_partkey", text.document_title(F.concat("p_name", F.lit("_x著.pdf"))).alias("title"), text.specialty(F.concat(F.lit("临床诊疗指南 - "), "p_name", F.lit("分册2021.pdf"))).alias("specialty")),
    f"SELECT p_partkey, trim(regexp_replace(p_name, {WS}, ' ', 'g')) || '_x著' AS title, trim(regexp_replace(p_name, {WS}, ' ', 'g')) AS specialty FROM part",
)
add(
    "x05_heading_path",
    lambda t: t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", text.heading_text(F.array(F.col("r_name"), F.lit("  "), F.concat(F.lit(" "), "n_name"))).alias("path")),
    "SELECT n_nationkey, trim(r_name) || ' > ' || trim(n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
)
add("x06_stable_ids", lambda t: _docs(t, id=text.stable_id("source", "doc_id")), _sql(id="md5(source || ':' || doc_id)"))
add("d09_config_digest", lambda t: t.part.select("p_partkey", identifiers.config_digest(F.map_from_arrays(F.when(F.col("p_partkey") % 2 == 0, F.array(*map(F.lit, ("type", "brand", "raptor", "size")))).otherwise(F.array(*map(F.lit, ("size", "raptor", "brand", "type")))), F.when(F.col("p_partkey") % 2 == 0, F.array("p_type", "p_brand", "p_name", F.col("p_size").cast("string"))).otherwise(F.array(F.col("p_size").cast("string"), F.lit("x"), "p_brand", "p_type"))), F.lit("doc"), F.col("p_size")).alias("digest")), "SELECT p_partkey, md5('5:brand:' || length(p_brand) || ':' || p_brand || ';4:size:' || length(p_size::VARCHAR) || ':' || p_size || ';4:type:' || length(p_type) || ':' || p_type || '|doc|' || p_size) AS digest FROM part")
add("x06_chunk_ids", lambda t: t.documents.select("doc_id", identifiers.xxh64_id(F.concat_ws("\n", F.col("doc_id").cast("string"), "text")).alias("chunk_id")))
add("x07_content_md5", lambda t: _docs(t, md5=F.md5("text"), bytes=F.octet_length("text").cast("long")), _sql(md5="md5(text)", bytes="strlen(text)::BIGINT"))
add(
    "x08_shard_names",
    lambda t: t.documents.select("doc_id", text.shard_name("source", "lang", (F.col("doc_id") % 1000)).alias("name")).withColumn("path", text.shard_path("name")),
    "SELECT doc_id, n AS name, 'normalized_shards/' || n || '.jsonl' AS path FROM (SELECT doc_id, 'pdf_' || source || '_' || lang || '_p' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS n FROM documents)",
)
add(
    "x09_major_of_file",
    lambda t: t.documents.select("doc_id", text.major(F.concat("source", F.lit("_part.json")), ["src1", "src2"]).alias("major")),
    "SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN 'src1' WHEN starts_with(source, 'src2') THEN 'src2' ELSE source || '_part' END AS major FROM documents",
)
add("x10_tighten_spaces", lambda t: _docs(t, v=text.tighten("text")), _sql(v=r"regexp_replace(regexp_replace(text, '([^a-zA-Z0-9.,\)>]) +([^ ])', '\1\2', 'g'), '([^ ]) +([^a-zA-Z0-9.,\(<])', '\1\2', 'g')"))
add("x11_strip_fence", lambda t: _docs(t, v=text.strip_fence(F.concat(F.lit("```markdown\n"), "text", F.lit("\n```\n")))), _sql(v=r"regexp_replace(text, '^\s+|\s+$', '', 'g')"))
add(
    "x12_floats",
    lambda t: t.events.select("event_id", text.to_float(F.get_json_object("props", "$.k")).alias("k"), F.array_max(text.tab_floats(F.concat_ws("\t", F.col("value").cast("int").cast("string"), F.lit("x")))).alias("best")),
    "SELECT event_id, coalesce(try_cast(props::JSON ->> '$.k' AS DOUBLE), '-inf'::DOUBLE) AS k, trunc(value)::DOUBLE AS best FROM events",
)
add("x13_clamp_percent", lambda t: t.part.select("p_partkey", text.clamp_percent(F.col("p_size") * 3 - 10).alias("v")), "SELECT p_partkey, least(90, greatest(0, p_size * 3 - 10)) AS v FROM part")
add(
    "x14_language_tests",
    lambda t: _docs(t, english=text.is_english("text"), chinese=text.is_chinese("text"), query=text.is_chinese_query("text")),
    _sql(
        english=r"""length(regexp_replace(text, '[`a-zA-Z0-9\s.,'':;/"?<>!()\-]', '', 'g')) < 0.2 * length(text)""",
        chinese=r"(length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g'))) > 0.2 * length(text)",
        query=r"len(regexp_split_to_array(text, '[ \t]+')) <= 3 OR len(list_filter(regexp_split_to_array(text, '[ \t]+'), lambda x: NOT regexp_matches(x, '^[a-zA-Z]+$'))) >= 0.7 * len(regexp_split_to_array(text, '[ \t]+'))",
    ),
)
add("x15_strip_qa_label", lambda t: t.conversations.select("conv_id", "turn", text.strip_qa_label(F.concat("role", F.lit(": "), "text")).alias("v")), r"SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN regexp_replace(text, '^[\t:： ]+', '') ELSE trim(role || ': ' || text, ' ') END AS v FROM conversations")
ENT = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
HTML = "trim(regexp_replace(" + ENT.format(x=r"regexp_replace(regexp_replace({x}, '(?is)<br\s*/?>|</p\s*>|</div\s*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')") + r", '[\s\x{{3000}}\x{{00A0}}]+', ' ', 'g'))"
add("x16_html_text", lambda t: t.pages.select("page_id", text.html_text("html").alias("v")), f"SELECT page_id, {HTML.format(x='html')} AS v FROM pages")
add(
    "x17_html_table",
    lambda t: t.nation.select("n_nationkey", text.html_table_text(F.concat(F.lit("<table><tr><th>Key</th><th>Name</th></tr><tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><b>"), "n_name", F.lit("</b></td></tr></table>"))).alias("v")),
    "SELECT n_nationkey, 'Key | Name' || chr(10) || n_nationkey || ' | ' || n_name AS v FROM nation",
)
add(
    "x18_markdown_table",
    lambda t: t.nation.select("n_nationkey", text.markdown_table_text(F.concat(F.lit("| Key | Name |\n|:--|---:|\n| "), F.col("n_nationkey").cast("string"), F.lit(" |  "), "n_name", F.lit(" |\nafter"))).alias("v")),
    "SELECT n_nationkey, 'Key | Name' || chr(10) || n_nationkey || ' | ' || n_name AS v FROM nation",
)
add("x19_strip_table_tags", lambda t: t.pages.select("page_id", text.strip_table_tags("html").alias("v")), r"SELECT page_id, regexp_replace(html, '(?i)</?(table|td|caption|tr|th)( [^<>]{0,12})?>', ' ', 'g') AS v FROM pages")
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
add("x20_tokens", lambda t: _docs(t, n=F.size(text.tokens("text")).cast("long"), first=F.get(text.tokens("text"), 0), uniq=F.size(F.array_distinct(text.tokens("text"))).cast("long")), _sql(n=f"len({TOK})::BIGINT", first=f"{TOK}[1]", uniq=f"list_unique({TOK})::BIGINT"))
add("x20_half_width", lambda t: t.part.select("p_partkey", text.half_width(F.concat(F.lit("ＡＢ１　"), "p_brand")).alias("v"), F.array_join(text.fine_tokens(F.concat(F.lit("儿科门诊 "), "p_brand")), " ").alias("fine")), r"SELECT p_partkey, 'AB1 ' || p_brand AS v, '儿科 科门 门诊 ' || array_to_string(regexp_extract_all(lower(p_brand), '[\p{L}\p{N}_]+'), ' ') AS fine FROM part")
add("x21_token_count", lambda t: _docs(t, n=text.token_count("text").cast("long")), _sql(n=r"len(regexp_extract_all(text, '[A-Za-z0-9_\x{00C0}-\x{024F}]+|[^\sA-Za-z0-9_\x{00C0}-\x{024F}]'))::BIGINT"))
add("x22_ordinals", lambda t: t.part.select("p_partkey", identifiers.ordinal_number(F.element_at(F.array(*[F.lit(x) for x in ("7", "twenty one", "二十三", "xiv", "?")]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("n")), "SELECT p_partkey, [7, 21, 23, 14, -1][p_partkey % 5 + 1]::INT AS n FROM part")
add("x23_split_values", lambda t: t.part.select("p_partkey", F.array_join(text.split_values(F.concat_ws("、", "p_brand", F.lit(" a , b;a "), "p_brand")), "/").alias("v")), "SELECT p_partkey, p_brand || '/a/b' AS v FROM part")
add(
    "x24_merge_meta",
    lambda t: t.part.select("p_partkey", text.merge_meta(F.create_map(F.lit("brand"), F.array("p_brand"), F.lit("size"), F.array(F.col("p_size").cast("string"))), F.create_map(F.lit("brand"), F.array(F.lit("new"), F.col("p_brand")), F.lit("type"), F.array("p_type"))).alias("m")).select("p_partkey", F.array_join(F.col("m")["brand"], ",").alias("brand"), F.array_join(F.col("m")["size"], ",").alias("size"), F.array_join(F.col("m")["type"], ",").alias("type")),
    "SELECT p_partkey, p_brand || ',new' AS brand, p_size::VARCHAR AS size, p_type AS type FROM part",
)
add("x26_value_types", lambda t: t.orders.select("o_orderkey", text.value_type(F.col("o_orderkey").cast("string")).alias("a"), text.value_type(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b"), text.value_type("o_orderpriority").alias("c")), "SELECT o_orderkey, 'number' AS a, 'time' AS b, 'string' AS c FROM orders")
add("x27_hash_mod", lambda t: t.part.select("p_partkey", identifiers.sha1_mod(F.col("p_name"), 1_000_000).alias("v")), "SELECT p_partkey, list_reduce([('0x' || sha1(p_name)[8 * i + 1:8 * i + 8])::BIGINT::HUGEINT FOR i IN range(0, 5)], lambda a, x: (a * 4294967296 + x) % 1000000)::BIGINT AS v FROM part")
add("x28_human_bytes", lambda t: t.documents.groupBy("source").agg(F.sum("n_chars").alias("n")).select("source", text.human_bytes("n").alias("v")), "SELECT source, CASE WHEN n < 1024 THEN printf('%.0f', n::DOUBLE) || ' B' WHEN n < 1048576 THEN CASE WHEN n / 1024.0 >= 100 THEN printf('%.0f', n / 1024.0) WHEN n / 1024.0 >= 10 THEN printf('%.1f', n / 1024.0) ELSE printf('%.2f', n / 1024.0) END || ' KB' ELSE CASE WHEN n / 1048576.0 >= 100 THEN printf('%.0f', n / 1048576.0) WHEN n / 1048576.0 >= 10 THEN printf('%.1f', n / 1048576.0) ELSE printf('%.2f', n / 1048576.0) END || ' MB' END AS v FROM (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY source)")
add(
    "x29_dates",
    lambda t: t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.date_format(F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))), "yyyy-MM-dd HH:mm:ss").alias("text"), F.date_trunc("second", "ts").alias("sec"), F.timestamp_diff("second", F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("since")),
    "SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, date_trunc('second', ts) AS sec, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000)::BIGINT AS since FROM events",
)
add("x30_day_bounds", lambda t: t.events.select("event_id", F.date_trunc("day", "ts").alias("first"), (F.date_trunc("day", "ts") + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '1' SECOND")).alias("last")), "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS first, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 SECOND AS last FROM events")
add("x31_tail_lines", lambda t: _docs(t, v=text.tail_lines("text", 300)), _sql(v="CASE WHEN length(text) <= 300 THEN text WHEN strpos(right(text, 300), chr(10)) > 0 THEN substr(right(text, 300), strpos(right(text, 300), chr(10)) + 1) ELSE right(text, 300) END"))
add(
    "x32_deep_merge",
    lambda t: t.events.select("event_id", identifiers.deep_merge(F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.array("event_type", F.lit("x")).alias("tags"), F.struct("user_id", F.lit(1).alias("n")).alias("who"))), F.to_json(F.struct(F.array(F.lit("x"), F.lit("y")).alias("tags"), F.struct(F.lit(2).alias("n"), F.array("event_id").alias("ids")).alias("who")))).alias("merged")),
    """SELECT event_id, '{"k": ' || (props->>'k') || ', "tags": ["' || event_type || '", "x", "y"], "who": {"ids": [' || event_id || '], "n": 2, "user_id": ' || user_id || '}}' AS merged FROM events""",
)
add("x33_first_json", lambda t: t.events.select("event_id", F.get_json_object(text.first_json(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\ndone"))), "$.k").alias("k")), "SELECT event_id, props::JSON ->> '$.k' AS k FROM events")
add("x34_latin_digits", lambda t: t.part.select("p_partkey", text.latin_digits(F.translate(F.col("p_size").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("v"), identifiers.nfkc(F.concat(F.lit("ﬁ"), "p_brand")).alias("n")), "SELECT p_partkey, p_size::VARCHAR AS v, 'fi' || p_brand AS n FROM part")
add("x37_split_model_name", lambda t: t.part.select("p_partkey", F.substring_index(F.concat("p_name", F.lit("@"), "p_brand"), "@", 1).alias("model"), F.substring_index(F.concat("p_name", F.lit("@"), "p_brand"), "@", -1).alias("factory")), "SELECT p_partkey, p_name AS model, p_brand AS factory FROM part")
add("x38_bullets", lambda t: _docs(t, not_bullet=F.col("text").rlike(text.NOT_BULLET), heading=F.col("text").rlike(r"(?m)^#+ ")), _sql(not_bullet=r"regexp_matches(text, '^(0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})')", heading=r"regexp_matches(text, '(?m)^#+ ')"))
add("x39_first_term", lambda t: _docs(t, v=text.first_term("text", ["password", "license", "the", "der"])), _sql(v="CASE WHEN contains(text, 'password') THEN 'password' WHEN contains(text, 'license') THEN 'license' WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'der') THEN 'der' ELSE 'other' END"))
add("x40_markdown_rows", lambda t: t.orders.select("o_orderkey", text.markdown_row("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00")).alias("row")), "SELECT o_orderkey, '|' || o_orderkey || '|' || coalesce(nullif(o_orderstatus, 'F'), ' ') || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' AS row FROM orders")
add("x42_qa_text", lambda t: _docs(t, v=text.qa_text("source", "lang", "text")), _sql(v=f"'标题：' || source || chr(10) || '问题：' || lang || chr(10) || '回答：' || {COLLAPSED}"))
add("v26_escape_query", lambda t: t.benchmark.select("item_id", text.escape_query(F.concat(F.lit("a-b (c)? "), "text")).alias("v")), r"""SELECT item_id, trim(regexp_replace(replace('a-b (c)? ' || text, '''', ''), '([:{}/\[\]\-*?"()|+~^])', '\\\1', 'g')) AS v FROM benchmark""")
def asked(t):
    """Benchmark texts as questions of many kinds, and questions of nothing but noise."""
    around = [("what is the ", ""), ("Who're you? ", " by the way "), ("请问", "怎么办"), ("阿司匹林是什么 ", " 哪些"), ("it's on and off ", " of them"), ("", ""), ("please tell me if ", " may be done ")]
    each = [F.struct(F.lit(i).alias("kind"), F.concat(F.lit(a), c("text"), F.lit(b)).alias("q")) for i, (a, b) in enumerate(around)]
    noise = [F.struct(F.lit(len(around) + i).alias("kind"), F.lit(q).alias("q")) for i, q in enumerate(("怎么办", "请问什么", "by the ", "in the "))]
    return t.benchmark.select("item_id", F.explode(F.array(*each, *noise)).alias("x")).select("item_id", "x.*")


_NOISE = [(p.replace("'", "''"), i) for p, i in text.QUESTION_NOISE]
_LEFT = f"regexp_replace(regexp_replace(regexp_replace(q, '{_NOISE[0][0]}', '', 'gi'), '{_NOISE[1][0]}', ' ', 'gi'), '{_NOISE[2][0]}', ' ', 'gi')"
add(
    "v26_strip_question_words",
    lambda t: asked(t).select("item_id", "kind", text.strip_question_words("q").alias("v"), text.space_scripts(F.concat(F.lit("MRI检查"), "item_id")).alias("s")),
    f"""WITH k AS (SELECT item_id, unnest([{{'kind': 0, 'q': 'what is the ' || text}}, {{'kind': 1, 'q': 'Who''re you? ' || text || ' by the way '}}, {{'kind': 2, 'q': '请问' || text || '怎么办'}}, {{'kind': 3, 'q': '阿司匹林是什么 ' || text || ' 哪些'}},
 {{'kind': 4, 'q': 'it''s on and off ' || text || ' of them'}}, {{'kind': 5, 'q': text}}, {{'kind': 6, 'q': 'please tell me if ' || text || ' may be done '}}, {{'kind': 7, 'q': '怎么办'}}, {{'kind': 8, 'q': '请问什么'}}, {{'kind': 9, 'q': 'by the '}}, {{'kind': 10, 'q': 'in the '}}]) AS x FROM benchmark),
 l AS (SELECT item_id, x.kind AS kind, x.q AS q FROM k) SELECT item_id, kind, CASE WHEN {_LEFT} = '' THEN q ELSE {_LEFT} END AS v, 'MRI 检查' || item_id AS s FROM l""",
)
add("v28_emphasise", lambda t: t.part.select("p_partkey", text.emphasise(F.concat("p_brand", F.lit(" is a Brand, brand!")), F.array(F.lit("brand"))).alias("v")), "SELECT p_partkey, p_brand || ' is a <em>Brand</em>, <em>brand</em>!' AS v FROM part WHERE p_brand NOT LIKE '%brand%'")
add("v29_highlight", lambda t: t.part.select("p_partkey", text.highlight(F.concat(F.lit("No word here. The cat "), "p_brand", F.lit(" sat? Dogs; cat.")), F.array(F.lit("cat"))).alias("v")), "SELECT p_partkey, 'The <em>cat</em> ' || p_brand || ' sat...<em>cat</em>' AS v FROM part")
add("c25_sentences", lambda t: _docs(t, n=F.size(text.sentences("text")).cast("long"), longest=F.array_max(F.transform(text.sentences("text"), F.length)).cast("long")), _sql(n=r"len(list_filter(regexp_extract_all(text, '[^。？！!?;；:\n]*[。？！!?;；:\n]?'), lambda x: x <> ''))::BIGINT", longest=r"list_max(list_transform(list_filter(regexp_extract_all(text, '[^。？！!?;；:\n]*[。？！!?;；:\n]?'), lambda x: x <> ''), lambda x: length(x)))::BIGINT"))
add(
    "x35_vector_and_set_scores",
    lambda t: t.embeddings.alias("a").join(t.embeddings.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id"), F.round(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cos"), F.round(vectors.jaccard(F.array("a.label", "b.label"), F.array("b.label")), 6).alias("jac"), F.round(vectors.token_f1(F.array("a.label", "b.label"), F.array("b.label")), 6).alias("f1")),
    "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cos, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.5 END::DOUBLE AS jac, CASE WHEN a.label = b.label THEN 1.0 ELSE round(2.0 / 3, 6) END::DOUBLE AS f1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
add("x36_min_max", lambda t: t.supplier.select("s_suppkey", F.round(vectors.min_max(F.col("s_acctbal"), "s_nationkey"), 6).alias("v")), "SELECT s_suppkey, round(coalesce((s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 0), 6) AS v FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
add(
    "v39_embedding_agreement",
    lambda t: t.embeddings.alias("a").join(t.embeddings.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id"), F.round(F.greatest(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), vectors.cosine(F.col("a.embedding"), vectors.blend(F.col("a.embedding"), F.col("b.embedding")))), 5).alias("v")),
    "SELECT vec_id, round(greatest(d / sqrt(aa * bb), (0.1 * aa + 0.9 * d) / sqrt(aa * (0.01 * aa + 0.18 * d + 0.81 * bb))), 5) AS v FROM (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS aa, list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS bb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)",
)
add("v03_sparse_and_tensor", lambda t: t.embeddings.select("vec_id", F.round(vectors.max_sim(F.array("embedding"), F.array("embedding", F.transform("embedding", lambda x: -x))), 5).alias("late"), vectors.sparse_dot(F.create_map(F.lit(1), F.lit(2.0), F.lit(3), F.lit(1.0)), F.create_map(F.lit(3), F.col("label").cast("double"))).alias("sparse")), "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS late, label::DOUBLE AS sparse FROM embeddings")
