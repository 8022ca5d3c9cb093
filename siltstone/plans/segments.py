"""Queries of segmentation, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.operators import layout as O
from siltstone.operators import segment as S
from siltstone.plans.registry import add
from siltstone.sources import readers, writers

c = F.col


def with_colons(t):
    """Documents between lines that end with colons."""
    return t.documents.select("doc_id", F.concat(F.lit("Aims. The first part:\n"), F.coalesce("text", F.lit("")), F.lit("\n"), "source", F.lit("：")).alias("text"))


def numbered(t):
    """Documents behind headings of one family or another."""
    heads = ["第一章 x\n第二节 y\n", "1. x\n1.2 y\n0.1 z\n", "Section 1\nChapter IV\n"]
    head = F.coalesce(*[F.when(c("doc_id") % 4 == i, F.lit(h)) for i, h in enumerate(heads)], F.lit(""))
    return t.documents.select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def markdown(t):
    """Documents as Markdown: their first line as a heading."""
    return t.documents.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text").alias("text"))


add("c01_naive_chunks", lambda t: S.per_document(t.documents, S.naive_chunks, "chunk string, tokens int"))
add("c02_chunks_with_images", lambda t: S.per_document(t.documents, lambda x: ((a, len(b)) for a, b in S.chunks_with_images([(s, "img" if i % 5 == 0 else None) for i, s in enumerate(x.split("\n"))])), "chunk string, images int"))
def lines_as_blocks(t, media):
    """Each line of a document is a block; ``media`` says which are tables."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    return lines.withColumn("kind", F.when(media, "table").otherwise("text"))


def laid_out(t):
    """Lines on pages of five, a quarter of them tables, whose extents overlap here and there."""
    top = 40 * (c("seq") % 5) + c("doc_id") % 7
    where = F.struct((F.floor(c("seq") / 5) + 1).cast("int").alias("page"), F.lit(0.0).alias("left"), F.lit(90.0).alias("right"), top.cast("double").alias("top"), (top + 10 + F.length("text") % 60).cast("double").alias("bottom"))
    return lines_as_blocks(t, c("seq") % 4 == 2).withColumn("positions", F.array(where))


def _lines_sql(media):
    return f"""b AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
k AS (SELECT *, CASE WHEN {media} THEN 'table' ELSE 'text' END AS kind FROM b)"""


TOKENS = r"len(regexp_extract_all({}, '[A-Za-z0-9_À-ɏ]+|[^\sA-Za-z0-9_À-ɏ]'))"


def _surrounded_sql(media, budget):
    return rf"""WITH {_lines_sql(media)}, p AS (SELECT *, coalesce(sum(CASE WHEN kind = 'text' THEN {TOKENS.format("text")} ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM k),
q AS (SELECT doc_id, seq, p, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([。!?？；！\n]|\. )', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS x FROM p WHERE kind = 'text')),
e AS (SELECT *, p + sum({TOKENS.format("s")}) OVER (PARTITION BY doc_id, seq ORDER BY i) AS e, {TOKENS.format("s")} AS n FROM q)
SELECT m.doc_id, m.seq, (SELECT coalesce(string_agg(s, '' ORDER BY e.seq, i), '') FROM e WHERE e.doc_id = m.doc_id AND e.seq < m.seq AND m.p - e < {budget}) AS above,
 (SELECT coalesce(string_agg(s, '' ORDER BY e.seq, i), '') FROM e WHERE e.doc_id = m.doc_id AND e.seq > m.seq AND e - n - m.p < {budget}) AS below FROM p m WHERE kind = 'table'"""


add("c03_media_context", lambda t: O.surrounded(lines_as_blocks(t, c("text").contains("|") | (c("seq") % 9 == 4)), 64).select("doc_id", "seq", "above", "below"), _surrounded_sql("contains(text, '|') OR seq % 9 = 4", 64))
add("c18_table_context", lambda t: O.surrounded(lines_as_blocks(t, c("seq") % 4 == 2), 32).select("doc_id", "seq", "above", "below"), _surrounded_sql("seq % 4 = 2", 32))
add("c17_text_beside", lambda t: O.nearest_text(laid_out(t)), f"""WITH {_lines_sql("seq % 4 = 2")}, r AS (SELECT *, seq // 5 + 1 AS page, 40 * (seq % 5) + doc_id % 7 AS top, 40 * (seq % 5) + doc_id % 7 + 10 + length(text) % 60 AS bottom FROM k),
o AS (SELECT m.doc_id, m.seq, arg_min(t.seq, abs((m.top + m.bottom) / 2.0 - (t.top + t.bottom) / 2.0) * 1000000 + t.seq) AS beside FROM r m JOIN r t ON t.doc_id = m.doc_id AND t.page = m.page AND t.kind = 'text' AND m.bottom >= t.top AND m.top <= t.bottom WHERE m.kind = 'table' GROUP BY 1, 2),
f AS (SELECT *, seq = min(seq) OVER w AS is_first, seq = max(seq) OVER w AS is_last, min(CASE WHEN kind = 'text' THEN seq END) OVER w AS f, max(CASE WHEN kind = 'text' THEN seq END) OVER w AS l FROM r WINDOW w AS (PARTITION BY doc_id, page))
SELECT f.doc_id, f.seq, coalesce(beside, CASE WHEN is_first THEN f WHEN is_last THEN l END)::INT AS beside FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.seq = f.seq WHERE kind = 'table' AND coalesce(beside, CASE WHEN is_first THEN f WHEN is_last THEN l END) IS NOT NULL""")
add("c17_page_context", lambda t: O.with_page_context(laid_out(t), 24, 24).select("doc_id", "seq", "kind", "text"))
add("c04_parts_with_parent", lambda t: S.parts_with_parent(t.documents.select("doc_id", "text"), "text", "[.]").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("part")).alias("chars")), r"SELECT doc_id, count(*) AS n, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.]*[.]|[^.]+')) AS p FROM documents) WHERE trim(p) <> '' GROUP BY 1")
add("c06_table_batches", lambda t: S.table_batches(t.part.select("p_brand", "p_partkey", F.concat_ws(":", "p_name", "p_type").alias("line")), "p_brand", "p_partkey", "line"), "SELECT p_brand, (i - 1) // 10 AS batch, string_agg(p_name || ':' || p_type, '; ' ORDER BY i) AS content FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) GROUP BY 1, 2")
add("c07_markdown_blocks", lambda t: S.per_document(markdown(t), S.markdown_blocks, S.BLOCK_SCHEMA))
add("c08_units", lambda t: S.units(S.per_document(markdown(t), S.markdown_blocks, S.BLOCK_SCHEMA), c("doc_id").cast("string")).select("doc_id", "pos", "section", "chapter", "tokens", "tables"))
add("c09_c11_markdown_chunks", lambda t: S.per_document(markdown(t), S.markdown_chunks, "chapter string, chunk string, tokens int, units int, shard int"))
add("c12_hierarchical_chunks", lambda t: S.per_document(markdown(t), S.hierarchical_chunks, "chunk string, tokens int"))
add("c13_outline", lambda t: S.per_document(markdown(t), S.tree_paths, "chunk string, depth int"))
_FAMILY = lambda i: "len(list_filter(string_split(text, chr(10)), lambda s: (" + " OR ".join("regexp_matches(trim(s, ' ' || chr(9) || chr(13)), '^(?:" + p.replace("{,", "{0,") + ")')" for p in S.BULLETS[i]) + ") AND NOT regexp_matches(trim(s, ' ' || chr(9) || chr(13)), '" + S.X.NOT_BULLET + "')))"
add(
    "c14_bullets_category",
    lambda t: S.per_document(numbered(t), lambda x: iter([(S.bullets_category(x.split("\n")),)]), "family int"),
    "WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '第一章 x' || chr(10) || '第二节 y' || chr(10) WHEN 1 THEN '1. x' || chr(10) || '1.2 y' || chr(10) || '0.1 z' || chr(10) WHEN 2 THEN 'Section 1' || chr(10) || 'Chapter IV' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents), "
    + "h AS (SELECT doc_id, [" + ", ".join(_FAMILY(i) for i in range(len(S.BULLETS))) + "] AS hits FROM n) SELECT doc_id, 0 AS pos, CASE WHEN list_max(hits) = 0 THEN -1 ELSE list_position(hits, list_max(hits)) - 1 END::INT AS family FROM h",
)
add(
    "c15_without_contents",
    lambda t: S.per_document(t.documents.select("doc_id", F.concat(F.lit("intro\n目　录\n\n第一章 甲\n第二章 乙\n第一章 "), "source", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")), S.without_contents, "line string"),
    "SELECT doc_id, (n - 1)::INT AS pos, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, list_concat(['intro', '第一章 ' || source], string_split(coalesce(text, ''), chr(10))) AS l FROM documents))",
)
add(
    "c16_colon_titles",
    lambda t: S.per_document(with_colons(t), S.colon_titles, "kind string, body string"),
    r"""WITH d AS (SELECT doc_id, string_split('Aims. The first part:' || chr(10) || coalesce(text, '') || chr(10) || source || '：', chr(10)) AS l FROM documents),
 l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
 s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS st FROM l), k AS (SELECT *, list_last(regexp_split_to_array(st, '[。？！!?;；]| \.')) AS last FROM s),
 r AS (SELECT doc_id, i, 0 AS j, 'title' AS kind, last AS body FROM k WHERE regexp_matches(st, '[:：]$') AND length(last) BETWEEN 2 AND 32 UNION ALL SELECT doc_id, i, 1, 'text', line FROM k)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS pos, kind, body FROM r""",
)
add("c19_positions", lambda t: t.part.select("p_partkey", F.to_json(S.positions(F.array(F.array(F.lit(0), "p_size", F.lit(9), F.lit(2), F.lit(3))))).alias("p")), "SELECT p_partkey, '[[1,' || p_size || ',9,2,3]]' AS p FROM part")
add("c20_markdown_tables", lambda t: S.per_document(t.pages.select(c("page_id").alias("doc_id"), c("html").alias("text")), S.markdown_tables, "kind string, body string"))
add("c21_markdown_elements", lambda t: S.per_document(markdown(t), S.markdown_elements, "kind string, body string, first int, last int"))
add("c22_json_split", lambda t: S.per_document(t.events.select(c("event_id").alias("doc_id"), F.to_json(F.struct("props", F.struct("event_type", "user_id").alias("who"), F.array("event_type", "event_type").alias("list"))).alias("text")), lambda x: S.split_json(x, 60), "chunk string, size int"))
add("c24_page_ranges", lambda t: S.page_ranges(t.part.select("p_partkey", "p_size"), "p_size", 12), "SELECT p_partkey, p_size, f::INT AS from_page, least(f + 12, p_size)::INT AS to_page FROM part, range(0, 1000, 12) r(f) WHERE f <= greatest(p_size - 1, 0)")
add("c28_toc_alignment", lambda t: S.per_document(t.documents, lambda x: iter(S.align_toc(sorted(x.split("\n")), x.split("\n"))), "entry int, section int"))
add("c29_delimiters", lambda t: S.per_document(t.part.select(c("p_partkey").alias("doc_id"), F.concat(F.lit("`##`;"), "p_brand", F.lit("`ab`")).alias("text")), lambda x: ((d,) for d in S.delimiters(x)), "delimiter string"), "SELECT p_partkey AS doc_id, (n - 1)::INT AS pos, d AS delimiter FROM (SELECT p_partkey, unnest(l) AS d, generate_subscripts(l, 1) AS n FROM (SELECT p_partkey, list_concat(['##', 'ab'], string_split(';' || p_brand, '')) AS l FROM part))")
add("w07_greedy_batches", lambda t: S.per_document(t.documents, lambda x: ((b,) for b in S.greedy_batches([len(s) for s in x.split("\n")], 500)), "batch int"), """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: length(s)) AS sizes FROM documents),
 g(doc_id, i, batch, held) AS (SELECT doc_id, 1, 0, sizes[1] FROM l UNION ALL SELECT g.doc_id, i + 1, CASE WHEN held + sizes[i + 1] > 500 THEN batch + 1 ELSE batch END, CASE WHEN held + sizes[i + 1] > 500 THEN sizes[i + 1] ELSE held + sizes[i + 1] END FROM g JOIN l USING (doc_id) WHERE i < len(sizes))
 SELECT doc_id, (i - 1)::INT AS pos, batch::INT AS batch FROM g""")
add("s11_text_questions", lambda t: t.part.select("p_partkey", F.inline(S.text_questions(F.split(F.concat("p_name", F.lit("\t"), "p_brand", F.lit("\nmore\nq2\ta2")), "\n")))), "SELECT p_partkey, p_name AS question, p_brand || chr(10) || 'more' AS answer FROM part UNION ALL SELECT p_partkey, 'q2', 'a2' FROM part")
add("s13_markdown_questions", lambda t: S.per_document(markdown(t), S.markdown_questions, "question string, answer string").select("doc_id", "question", F.md5("answer").alias("answer")))
add("s16_json_sniffing", lambda t: t.events.select("event_id", readers.looks_like_jsonl(F.concat("props", F.lit("\n"), "props", F.when(c("event_id") % 2 == 0, F.lit("\nbad")).otherwise(F.lit("")))).alias("jsonl")), "SELECT event_id, event_id % 2 <> 0 AS jsonl FROM events")
add("k18_report", lambda t: writers.report(t.documents.groupBy("source").agg(F.count("*").alias("n")), "Sources"), "SELECT '# Sources' || chr(10) || chr(10) || '| source | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || source || ' | ' || n || ' |', chr(10) ORDER BY '| ' || source || ' | ' || n || ' |') AS report FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
add(
    "m1_embeddings",
    lambda t: t.benchmark.select("item_id", models.embed(c("text")).alias("e"), models.embed(F.concat(F.lit("- "), "text", F.lit(" ."))).alias("f")).select("item_id", F.size("e").cast("long").alias("dim"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 4).alias("square"), (c("e") == c("f")).alias("same")),
    "SELECT item_id, 64::BIGINT AS dim, 1.0::DOUBLE AS square, true AS same FROM benchmark",
)
add(
    "m4_int8_vectors",
    lambda t: t.part.select("p_partkey", models.decode_int8(F.base64(F.unhex(F.concat(F.lpad(F.hex("p_size"), 2, "0"), F.lpad(F.hex(256 - c("p_size")), 2, "0"), F.lit("7F80"))))).alias("v")),
    "SELECT p_partkey, [p_size, -p_size, 127, -128]::FLOAT[] AS v FROM part",
)
