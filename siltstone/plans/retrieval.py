"""Queries of lexical, vector and hybrid retrieval: all benchmark questions in one plan each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import candidates, inverted
from siltstone.operators import lexical as L
from siltstone.operators import retrieval as V
from siltstone.plans.registry import ORACLES, add

c = F.col
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def chunks_of(t):
    return t.documents.select(c("doc_id").alias("chunk_id"), "text", "source")


def fields():
    return {"content_ltks": text.tokens("text"), "title_tks": F.array("source")}


def full_index(t):
    return L.postings(chunks_of(t), fields())


def index(t):
    """The postings of the questions' tokens."""
    return L.postings(chunks_of(t), fields(), tokens=questions(t))


def stats(t):
    return L.frequencies(index(t), chunks_of(t), fields())


def questions(t):
    flat = t.benchmark.select(c("item_id").alias("query_id"), F.explode(F.array_distinct(text.tokens("text"))).alias("token"))
    return flat.withColumn("weight", F.lit(1.0))


def matches(t):
    return L.match_scores(chunks_of(t), fields(), questions(t), {"content_ltks": 2.0, "title_tks": 10.0})


def bm25_top(t, k=10, msm=0.3):
    return L.top(L.enough(matches(t), questions(t), msm).withColumn("score", F.round("score", 6)), k)


BASE = rf"""
tk AS (SELECT doc_id AS chunk_id, unnest({TOK}) AS token FROM documents),
f AS (SELECT chunk_id, 'content_ltks' AS field, token, count(*) AS tf FROM tk GROUP BY 1, 3 UNION ALL SELECT doc_id, 'title_tks', source, 1 FROM documents),
ln AS (SELECT chunk_id, field, sum(tf) AS length FROM f GROUP BY 1, 2), av AS (SELECT field, sum(length) / (SELECT count(*) FROM documents) AS avgdl FROM ln GROUP BY 1),
df AS (SELECT field, token, count(*) AS df FROM f GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest({TOK}) AS token FROM benchmark)),
qn AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY 1),
h AS (SELECT q.query_id, f.chunk_id, f.field, f.token, f.tf, ln.length, av.avgdl, df.df, n.n FROM f JOIN q USING (token) JOIN ln ON ln.chunk_id = f.chunk_id AND ln.field = f.field JOIN av ON av.field = f.field JOIN df ON df.field = f.field AND df.token = f.token CROSS JOIN n)"""
BM = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avgdl))"
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)"
BOOST = "CASE field WHEN 'content_ltks' THEN 2.0 ELSE 10.0 END"
BEST = f"s AS (SELECT query_id, chunk_id, field, sum({BOOST} * {BM}) AS score FROM h GROUP BY 1, 2, 3), mt AS (SELECT query_id, chunk_id, count(DISTINCT token) AS n_matched FROM h GROUP BY 1, 2), b AS (SELECT s.query_id, s.chunk_id, round(max(score), 6) AS score, any_value(n_matched) AS n_matched, any_value(n_terms) AS n_terms FROM s JOIN mt ON mt.query_id = s.query_id AND mt.chunk_id = s.chunk_id JOIN qn ON qn.query_id = s.query_id GROUP BY 1, 2)"


def _msm(p: float) -> str:
    return f"n_matched >= greatest(1, floor({p} * n_terms))"


TOP10 = f"SELECT query_id, chunk_id, score, n_matched::INT AS n_matched, n_terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM b WHERE {_msm(0.3)} QUALIFY rank <= 10"
add("v06_bm25_top10", lambda t: bm25_top(t), f"WITH {BASE}, {BEST} {TOP10}")
add("v06_bm25_facets", lambda t: bm25_top(t).join(t.documents.select(c("doc_id").alias("chunk_id"), "source", "lang"), "chunk_id").groupingSets([["query_id", "source"], ["query_id", "lang"]], "query_id", "source", "lang").agg(F.count("*").alias("n")), f"WITH {BASE}, {BEST}, r AS ({TOP10}) SELECT query_id, source, lang, count(*) AS n FROM r JOIN documents d ON d.doc_id = r.chunk_id GROUP BY GROUPING SETS ((query_id, source), (query_id, lang))")
add("v01_postings", lambda t: full_index(t).groupBy("field", "token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), f"WITH {BASE} SELECT field, token, count(*) AS df, sum(tf)::BIGINT AS tf FROM f GROUP BY 1, 2")
add("v05_scaled_idf", lambda t: L.field_scores(index(t), stats(t), questions(t), "idf", n_chunks=t.documents.count()).select("query_id", "chunk_id", "field", F.round("score", 6).alias("score")), f"WITH {BASE} SELECT query_id, chunk_id, field, round(sum({IDF}), 6) AS score FROM h GROUP BY 1, 2, 3")
add("v06_boolean", lambda t: L.field_scores(index(t), stats(t), questions(t), "boolean", {"content_ltks": 2.0, "title_tks": 10.0}, t.documents.count()).select("query_id", "chunk_id", "field", "score"), f"WITH {BASE} SELECT query_id, chunk_id, field, sum({BOOST})::DOUBLE AS score FROM h GROUP BY 1, 2, 3")
add("v07_best_fields", lambda t: L.enough(matches(t), questions(t), 0.0).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max(F.round("score", 6)), 5).alias("best")), f"WITH {BASE}, {BEST} SELECT query_id, count(*) AS n, round(max(score), 5) AS best FROM b GROUP BY 1")
add("v08_min_should_match", lambda t: L.enough(matches(t), questions(t), 0.6).groupBy("query_id").agg(F.count("*").alias("n")), f"WITH {BASE}, {BEST} SELECT query_id, count(*) AS n FROM b WHERE {_msm(0.6)} GROUP BY 1")
add("v11_relaxed_search", lambda t: L.relaxed(matches(t), questions(t), 0.95, 0.4).groupBy("query_id", "phase").agg(F.count("*").alias("n")), f"WITH {BASE}, {BEST}, a AS (SELECT query_id, chunk_id FROM b WHERE {_msm(0.95)}) SELECT query_id, 1 AS phase, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT query_id, 2, count(*) FROM b WHERE {_msm(0.4)} AND query_id NOT IN (SELECT query_id FROM a) GROUP BY 1")
add("v12_listing", lambda t: t.documents.where("source = 'src4'").orderBy("lang", c("n_chars").desc(), "doc_id").select("doc_id").limit(64), "SELECT doc_id FROM documents WHERE source = 'src4' ORDER BY lang, n_chars DESC, doc_id LIMIT 64")


def stored_index(t):
    """An index of the documents on disk: most are added, some with other words; these give way, and chunks that don't belong leave."""
    index = inverted.InvertedIndex(t.spark, t.scratch(), list(fields()))
    docs = chunks_of(t)
    index.add(docs.where("chunk_id % 7 <> 3").withColumn("text", F.when(c("chunk_id") % 11 == 5, F.lit("other words")).otherwise(c("text"))), fields())
    index.add(docs.where("chunk_id % 7 = 3 OR chunk_id % 11 = 5").unionByName(docs.select((-c("chunk_id") - 1).alias("chunk_id"), "text", "source")), fields())
    index.withdraw(docs.select((-c("chunk_id") - 1).alias("chunk_id")))
    return index


STORED_BOOSTS = {"content_ltks": 2.0, "title_tks": 10.0}
add("v06_stored_index", lambda t: stored_index(t).search(questions(t), 10, 0.3, STORED_BOOSTS), f"WITH {BASE}, {BEST} {TOP10}")
add("v08_stored_matches", lambda t: L.enough(stored_index(t).matches(questions(t), STORED_BOOSTS), questions(t), 0.6).groupBy("query_id").agg(F.count("*").alias("n")), f"WITH {BASE}, {BEST} SELECT query_id, count(*) AS n FROM b WHERE {_msm(0.6)} GROUP BY 1")


def phrase_pairs(t):
    w = Window.partitionBy("query_id").orderBy("pos")
    flat = t.benchmark.select(c("item_id").alias("query_id"), F.posexplode(text.tokens("text")).alias("pos", "a"))
    return flat.withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL").select("query_id", "a", "b").distinct()


POS = rf"p AS (SELECT doc_id AS chunk_id, unnest({TOK}) AS token, generate_subscripts({TOK}, 1) AS pos FROM documents), bq AS (SELECT item_id AS query_id, unnest({TOK}) AS a, generate_subscripts({TOK}, 1) AS pos FROM benchmark), pr AS (SELECT DISTINCT query_id, a, b FROM (SELECT query_id, a, lead(a) OVER (PARTITION BY query_id ORDER BY pos) AS b FROM bq) WHERE b IS NOT NULL)"
add("v09_phrases", lambda t: L.phrases(chunks_of(t), text.tokens("text"), phrase_pairs(t)).groupBy("query_id", "chunk_id").agg(F.sum("n").alias("n")), f"WITH {POS} SELECT query_id, x.chunk_id, count(*) AS n FROM pr JOIN p x ON x.token = pr.a JOIN p y ON y.chunk_id = x.chunk_id AND y.token = pr.b AND y.pos = x.pos + 1 GROUP BY 1, 2")

WEIGHT = r"((0.3 * log10(10 + (1e7 - fr + 0.5) / (fr + 0.5)) + 0.7 * log10(10 + (1e9 - dfq + 0.5) / (dfq + 0.5))) * kind * pk)"
KINDS = r"""(SELECT *, CASE WHEN regexp_full_match(token, '[0-9. -]{2,}') THEN 3.0 WHEN regexp_full_match(token, '[a-z. -]+') THEN 300.0 ELSE 10.0 END::DOUBLE AS fr, CASE WHEN regexp_full_match(token, '[0-9. -]{2,}') THEN 5.0 WHEN regexp_full_match(token, '[a-z. -]+') THEN 300.0 ELSE 3.0 END::DOUBLE AS dfq, CASE WHEN regexp_full_match(token, '[0-9,.]{2,}') THEN 2.0 WHEN regexp_full_match(token, '[a-z]{1,2}') THEN 0.01 ELSE 1.0 END::DOUBLE AS kind, CASE WHEN regexp_matches(token, '^[0-9-]+') THEN 2.0 ELSE 1.0 END::DOUBLE AS pk FROM (SELECT item_id AS query_id, unnest(""" + TOK + r""") AS token, generate_subscripts(""" + TOK + r""", 1) AS pos FROM benchmark))"""
add("v19_term_weights", lambda t: L.query_terms(t.benchmark, text.tokens("text"), "item_id").where("kind = 'term'").select("query_id", "pos", "token", F.round("weight", 9).alias("weight")), f"SELECT query_id, (pos - 1)::INT AS pos, token, round({WEIGHT} / sum({WEIGHT}) OVER (PARTITION BY query_id), 9) AS weight FROM {KINDS}")
NAMED = [("糖尿", 6000, 900, None, None), ("尿病", 4200, 800, None, None), ("病患", 9000, 70, None, None), ("患者", 8000, 900, None, "n"), ("北京", 5000, 400, "loca", "ns"), ("和", 90000, 9000, None, "c"), ("砒霜", 20, 2, "toxic", "n")]


def lexical_weights(t):
    """Weights by the frequencies of the documents, with some names and parts of speech, and words known by their parts only."""
    lexicon = L.corpus_lexicon(t.documents, text.tokens("text"), "doc_id").unionByName(t.spark.createDataFrame(NAMED, "token string, freq long, df long, name string, tag string"))
    asked = t.benchmark.select(c("item_id").alias("query_id"), F.posexplode(F.concat(F.split(F.lit("糖尿病患者 北京 和 砒霜 未知之词 12.5 3-4 ab"), " "), text.tokens("text"))).alias("pos", "token"))
    return L.lexicon_weights(asked, lexicon)


LEXICON = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in NAMED) + ") v(token, freq, df, name, tag)"
add("v19_lexicon_weights", lambda t: lexical_weights(t).select("query_id", "pos", "token", F.round("weight", 9).alias("weight")), rf"""
WITH o AS (SELECT doc_id, unnest({TOK}) AS token FROM documents), lx AS (SELECT token, count(*) AS freq, count(DISTINCT doc_id) AS df, NULL::VARCHAR AS name, NULL::VARCHAR AS tag FROM o GROUP BY 1 UNION ALL SELECT * FROM {LEXICON}),
q0 AS (SELECT item_id AS query_id, list_concat(['糖尿病患者', '北京', '和', '砒霜', '未知之词', '12.5', '3-4', 'ab'], {TOK}) AS l FROM benchmark), q AS (SELECT query_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM q0),
w AS (SELECT q.*, freq, df, name, tag, CASE token WHEN '糖尿病患者' THEN 4200 / 6.0 END AS pf, CASE token WHEN '糖尿病患者' THEN 73 / 6.0 END AS pd FROM q LEFT JOIN lx USING (token)),
x AS (SELECT *, CASE WHEN regexp_full_match(token, '[0-9. -]{{2,}}') THEN 3.0 WHEN freq > 0 THEN greatest(freq, 10) WHEN regexp_full_match(token, '[a-z. -]+') THEN 300 ELSE coalesce(greatest(pf, 10), 10) END::DOUBLE AS f,
 CASE WHEN regexp_full_match(token, '[0-9. -]{{2,}}') THEN 5.0 WHEN df IS NOT NULL THEN df + 3 WHEN regexp_full_match(token, '[a-z. -]+') THEN 300 ELSE coalesce(greatest(pd, 3), 3) END::DOUBLE AS d,
 CASE WHEN regexp_full_match(token, '[0-9,.]{{2,}}') THEN 2.0 WHEN regexp_full_match(token, '[a-z]{{1,2}}') THEN 0.01 WHEN name = 'toxic' THEN 2 WHEN name = 'loca' THEN 3 ELSE 1 END::DOUBLE AS kind,
 CASE WHEN tag = 'c' THEN 0.3 WHEN tag = 'ns' THEN 3 WHEN tag = 'n' THEN 2 WHEN regexp_matches(token, '^[0-9-]+') THEN 2 ELSE 1 END::DOUBLE AS pk FROM w),
y AS (SELECT *, (0.3 * log10(10 + (1e7 - f + 0.5) / (f + 0.5)) + 0.7 * log10(10 + (1e9 - d + 0.5) / (d + 0.5))) * kind * pk AS v FROM x)
SELECT query_id, pos::INT AS pos, token, round(v / sum(v) OVER (PARTITION BY query_id), 9) AS weight FROM y""")
add("v22_query_clauses", lambda t: L.query_terms(t.benchmark, text.tokens("text"), "item_id").groupBy("query_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")), f"WITH w AS (SELECT query_id, pos, {WEIGHT} / sum({WEIGHT}) OVER (PARTITION BY query_id) AS w FROM {KINDS}), p AS (SELECT *, lead(w) OVER (PARTITION BY query_id ORDER BY pos) AS nw FROM w) SELECT query_id, 'term' AS kind, count(*) AS n, round(sum(w), 6) AS weight FROM p GROUP BY 1 UNION ALL SELECT query_id, 'phrase', count(*), round(sum(2 * greatest(w, nw)), 6) FROM p WHERE nw IS NOT NULL GROUP BY 1")
add("v24_content_query", lambda t: L.content_query(t.benchmark, text.tokens("text"), "item_id").groupBy("query_id").agg(F.count("*").alias("n"), F.first("min_match").alias("min_match"), F.round(F.sum("weight"), 5).alias("weight")), f"WITH d AS (SELECT DISTINCT query_id, token, {WEIGHT} AS w FROM {KINDS}), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, token) <= 30) SELECT query_id, count(*) AS n, least(3, round(count(*) / 10.0))::INT AS min_match, round(sum(w), 5) AS weight FROM k GROUP BY 1")
def synonyms(t):
    """Tokens of the documents that begin with the same four letters, by how often they occur."""
    found = t.documents.select(F.explode(text.tokens("text")).alias("synonym")).where(F.length("synonym") > 4).groupBy("synonym").agg(F.count("*").alias("n"))
    found = found.withColumn("stem", F.substring("synonym", 1, 4))
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("n"), "synonym"))
    ranked = found.withColumn("rank", rank).where("rank <= 9")
    wanted = questions(t).select("token").distinct().withColumn("stem", F.substring("token", 1, 4))
    return wanted.join(ranked, "stem").where("synonym <> token").select("token", "synonym", F.row_number().over(Window.partitionBy("token").orderBy("rank")).alias("rank"))


add("v25_synonyms", lambda t: L.expand_synonyms(questions(t), synonyms(t)).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")), rf"""
WITH q AS (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest({TOK}) AS token FROM benchmark)), f AS (SELECT token AS synonym, count(*) AS n FROM (SELECT unnest({TOK}) AS token FROM documents) WHERE length(token) > 4 GROUP BY 1),
r AS (SELECT synonym, left(synonym, 4) AS stem, row_number() OVER (PARTITION BY left(synonym, 4) ORDER BY n DESC, synonym) AS rank FROM f QUALIFY rank <= 9),
s AS (SELECT t.token, r.synonym FROM (SELECT DISTINCT token FROM q) t JOIN r ON r.stem = left(t.token, 4) AND r.synonym <> t.token QUALIFY row_number() OVER (PARTITION BY t.token ORDER BY r.rank) <= 8),
e AS (SELECT query_id, 1.0 AS w FROM q UNION ALL SELECT query_id, 0.25 FROM q JOIN s USING (token)) SELECT query_id, count(*) AS n, round(sum(w), 6)::DOUBLE AS weight FROM e GROUP BY 1""")


def similarity_terms(t):
    return L.similarity_terms(t.benchmark, text.tokens("text"), "item_id")


def similar(t, most=0):
    return L.text_similarity(similarity_terms(t), t.documents, text.tokens("text"), "doc_id", most)


SIM = f"""w AS (SELECT query_id, pos, token, {WEIGHT} / sum({WEIGHT}) OVER (PARTITION BY query_id) AS w FROM {KINDS}),
pw AS (SELECT *, lead(token) OVER (PARTITION BY query_id ORDER BY pos) AS nt, lead(w) OVER (PARTITION BY query_id ORDER BY pos) AS nw FROM w),
qm AS (SELECT query_id, term, sum(w) AS w FROM (SELECT query_id, token AS term, 0.4 * w AS w FROM pw UNION ALL SELECT query_id, token || nt, 0.6 * greatest(w, nw) FROM pw WHERE nt IS NOT NULL) GROUP BY 1, 2),
dt AS (SELECT doc_id AS chunk_id, unnest({TOK}) AS token, generate_subscripts({TOK}, 1) AS pos FROM documents),
dm AS (SELECT DISTINCT chunk_id, term FROM (SELECT chunk_id, token AS term FROM dt UNION ALL SELECT chunk_id, token || lead(token) OVER (PARTITION BY chunk_id ORDER BY pos) FROM dt) WHERE term IS NOT NULL),
ts AS (SELECT query_id, chunk_id, (sum(w) + 1e-9) / (any_value(total) + 1e-9) AS tksim FROM qm JOIN dm USING (term) JOIN (SELECT query_id, sum(w) AS total FROM qm GROUP BY 1) t USING (query_id) GROUP BY 1, 2)"""
add("v16_token_similarity", lambda t: similar(t).select("query_id", "chunk_id", F.round("tksim", 6).alias("tksim")), f"WITH {SIM} SELECT query_id, chunk_id, round(tksim, 6) AS tksim FROM ts")


def asked(t):
    """The vectors of all benchmark questions."""
    return t.embeddings.select(c("vec_id").alias("query_id"), "embedding").join(t.benchmark.select(c("item_id").alias("query_id")), "query_id", "left_semi")


def indexed(t):
    return t.embeddings.select(c("vec_id").alias("chunk_id"), "embedding", "label")


COS = "(SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))) AS cosine, d.label FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark))"
NEAR = f"SELECT query_id, chunk_id, cosine, label FROM {COS} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) <= 30"
add("v02_vector_top_k", lambda t: V.nearest(asked(t), indexed(t), 30).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine")), f"SELECT query_id, chunk_id, round(cosine, 6) AS cosine FROM ({NEAR})")
add("v02_vector_threshold", lambda t: V.nearest(asked(t), indexed(t), 30, 0.3).groupBy("query_id").agg(F.count("*").alias("n")), f"SELECT query_id, count(*) AS n FROM ({NEAR}) WHERE cosine >= 0.3 GROUP BY 1")


def vector_index(t):
    """All vectors by cells and codes, in files."""
    index = candidates.VectorIndex(t.spark, t.scratch())
    index.build(indexed(t), part_rows=4096)
    return index


add("v02_stored_candidates", lambda t: vector_index(t).search(asked(t), 30, probes=16).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine")))
add("v02_stored_all_cells", lambda t: vector_index(t).search(asked(t), 30, probes=4096, refine=1_000_000).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine")), f"SELECT query_id, chunk_id, round(cosine, 6) AS cosine FROM ({NEAR})")


def text_scores(t):
    return L.enough(matches(t), questions(t), 0.3).withColumn("score", F.round("score", 6))


add("v04_fused_within_text", lambda t: V.fuse(text_scores(t), V.nearest(asked(t), indexed(t), 30), 0.95).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("score")), f"WITH {BASE}, {BEST}, d AS ({NEAR}) SELECT query_id, count(*) AS n, round(max(0.05 * score + 0.95 * coalesce((1 + cosine) / 2, 0)), 4) AS score FROM (SELECT query_id, chunk_id, score FROM b WHERE {_msm(0.3)}) LEFT JOIN d USING (query_id, chunk_id) GROUP BY 1")
add("v37_fused_union", lambda t: V.fuse(text_scores(t), V.nearest(asked(t), indexed(t), 30), 0.95, False).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("s")), f"WITH {BASE}, {BEST}, d AS ({NEAR}) SELECT query_id, count(*) AS n, round(sum(0.05 * coalesce(score, 0) + 0.95 * coalesce((1 + cosine) / 2, 0)), 4) AS s FROM (SELECT query_id, chunk_id, score FROM b WHERE {_msm(0.3)}) FULL JOIN d USING (query_id, chunk_id) GROUP BY 1")
add("v10_rank_features", lambda t: V.nearest(asked(t), indexed(t), 30).join(indexed(t).select("chunk_id", "label"), "chunk_id").select("query_id", "chunk_id", F.round(V.rank_feature(c("cosine"), (F.nullif(c("label").cast("double"), F.lit(0.0)), 0.5)), 6).alias("score")), f"SELECT query_id, chunk_id, round(cosine + 0.5 * label, 6) AS score FROM ({NEAR})")
add("v18_tag_similarity", lambda t: t.part.select("p_partkey", F.round(V.tag_similarity(F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0)), F.create_map(F.lit("a"), c("p_size").cast("double"), F.lit("z"), F.lit(3.0)), F.lit(0.5)), 6).alias("s")), "SELECT p_partkey, round(10 * 2 * p_size / (sqrt(5) * sqrt(p_size * p_size + 9)) + 0.5, 6) AS s FROM part")


def reranked(t):
    """Token similarity and a cosine of chunk vectors for pairs with a common term, mixed and summed."""
    return V.hybrid_sums(similarity_terms(t), t.documents, text.tokens("text"), "doc_id", asked(t), indexed(t), 0.3)


def reranked_page(t, page, size):
    """A page of which only the rows of its window have met their vectors, and only those that may be in it have been ranked."""
    window = V.page_window(similar(t, V.window_end(page, size)).withColumn("score", F.round("tksim", 6)), page, size)
    sim = F.round(V.hybrid(c("cosine"), c("tksim"), 0.3), 6)
    return V.ranked_page(V.pair_cosines(window, asked(t), indexed(t)).withColumn("sim", sim), page, size)


ALLCOS = f"SELECT query_id, chunk_id, cosine FROM {COS}"
HYB = f"{SIM}, cs AS ({ALLCOS}), hy AS (SELECT query_id, chunk_id, tksim, coalesce(cosine, 0) AS cosine FROM ts LEFT JOIN cs USING (query_id, chunk_id)), hs AS (SELECT *, CASE WHEN sum(abs(cosine)) OVER (PARTITION BY query_id) = 0 THEN tksim ELSE 0.3 * cosine + 0.7 * tksim END AS sim FROM hy)"
add("v17_hybrid_similarity", lambda t: reranked(t).withColumn("s", F.round("s", 4)), f"WITH {HYB} SELECT query_id, count(*) AS n, round(sum(sim), 4) AS s FROM hs GROUP BY 1")
PAGE = "pg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(tksim, 6) DESC, chunk_id) AS w FROM hs QUALIFY w <= 70), pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, chunk_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM pg WHERE round(sim, 6) >= 0.2)"
add("v13_retrieval_page", lambda t: reranked_page(t, 2, 10).select("query_id", "chunk_id", "rank", "total", F.round("sim", 5).alias("sim")), f"WITH {HYB}, {PAGE} SELECT query_id, chunk_id, rank::INT AS rank, total, round(round(sim, 6), 5) AS sim FROM pk WHERE rank BETWEEN 11 AND 20")
add("a14_document_facets", lambda t: V.document_hits(reranked_page(t, 1, 10).join(t.documents.select(c("doc_id").alias("chunk_id"), "source"), "chunk_id"), "source"), f"WITH {HYB}, {PAGE} SELECT query_id, source, count(*) AS n FROM pk JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY 1, 2")
add("v14_rule_rerank_tokens", lambda t: t.documents.select("doc_id", F.size(V.rerank_tokens(text.tokens("text"), F.array("source"), F.array("lang", "lang"), F.array("source"))).cast("long").alias("n")), f"SELECT doc_id, list_unique({TOK})::BIGINT + 2 + 10 + 6 AS n FROM documents")
add("v15_model_rerank", lambda t: _model_rerank(t), rf"WITH n AS (SELECT query_id, chunk_id, cosine FROM {COS} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) <= 10), p AS (SELECT query_id, chunk_id, cosine, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+')) AS q, regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+') AS w FROM n JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id) SELECT query_id, chunk_id, round(0.3 * len(list_intersect(q, w)) / greatest(1, len(q)) + 0.7 * cosine, 6) AS sim FROM p")


def _model_rerank(t):
    from siltstone.functions import models

    pairs = V.nearest(asked(t), indexed(t), 10).join(t.benchmark.select(c("item_id").alias("query_id"), c("text").alias("question")), "query_id").join(t.documents.select(c("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return pairs.select("query_id", "chunk_id", F.round(0.3 * models.rerank(c("question"), c("text")) + 0.7 * c("cosine"), 6).alias("sim"))


def hits(t):
    return V.nearest(asked(t), indexed(t), 30).join(indexed(t).select("chunk_id", "label"), "chunk_id").withColumnRenamed("cosine", "sim")


add("a23_best_document", lambda t: V.best_document(hits(t), "label"), f"SELECT query_id, label FROM (SELECT query_id, label, round(sum(cosine), 9) AS s FROM ({NEAR}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) = 1")
EXTRA = 0.25


def extra_hits(t):
    """Every fiftieth vector is a hit of every question besides."""
    every = indexed(t).where("chunk_id % 50 = 0").select("chunk_id")
    return asked(t).select("query_id", F.lit(EXTRA).alias("sim"), F.pmod("query_id", F.lit(50)).alias("_k")).join(every.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(49)))), "_k").drop("_k")


add("j18_boost_merge", lambda t: V.boost_merge(hits(t), extra_hits(t)).select("query_id", "chunk_id", F.round("sim", 6).alias("sim")), f"SELECT query_id, chunk_id, round(coalesce(cosine, 0) + coalesce(e, 0), 6) AS sim FROM ({NEAR}) FULL JOIN (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, 0.25 AS e FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND d.vec_id % 50 = 0) USING (query_id, chunk_id)")
add("j17_parent_collapse", lambda t: V.collapse_parents(hits(t).withColumn("mom_id", F.when(c("chunk_id") % 2 == 0, c("label").cast("long"))).withColumn("content", F.lit("own")), t.embeddings.select(c("vec_id").alias("chunk_id"), F.concat(F.lit("parent "), "vec_id").alias("content"))).select("query_id", "chunk_id", F.round("sim", 6).alias("sim"), "content", "children"), f"SELECT query_id, chunk_id, round(cosine, 6) AS sim, 'own' AS content, 1::BIGINT AS children FROM ({NEAR}) WHERE chunk_id % 2 <> 0 UNION ALL SELECT query_id, label, round(avg(cosine), 6), 'parent ' || label, count(*) FROM ({NEAR}) WHERE chunk_id % 2 = 0 GROUP BY query_id, label")
TAGS = "tg AS (SELECT source AS tag, count(*) AS n FROM documents GROUP BY 1), pr AS (SELECT tag, n, (n + 1) / (sum(n) OVER () + 1000)::DOUBLE AS prior FROM tg)"


def tags(t):
    return t.documents.groupBy(c("source").alias("tag")).agg(F.count("*").alias("n"))


def tag_matches(t):
    m = bm25_top(t, 100).join(t.documents.select(c("doc_id").alias("chunk_id"), c("source").alias("tag")), "chunk_id")
    return m.groupBy("query_id", "tag").agg(F.count("*").alias("c")).withColumn("cnt", F.sum("c").over(Window.partitionBy("query_id")))


add("v31_tag_priors", lambda t: V.tag_priors(tags(t)).withColumn("prior", F.round("prior", 9)), f"WITH {TAGS} SELECT tag, n, round(prior, 9) AS prior FROM pr")
add("v32_tag_scores", lambda t: V.tag_scores(tag_matches(t), V.tag_priors(tags(t))), f"WITH {BASE}, {BEST}, {TAGS}, tp AS (SELECT query_id, chunk_id FROM b WHERE {_msm(0.3)} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 100), m AS (SELECT query_id, source AS tag, count(*) AS c FROM tp JOIN documents ON doc_id = chunk_id GROUP BY 1, 2), l AS (SELECT query_id, tag, 0.1 * (c + 1) / (sum(c) OVER (PARTITION BY query_id) + 1000) / greatest(prior, 0.0001) AS lift FROM m JOIN pr USING (tag)) SELECT query_id, tag, greatest(1, round_even(lift, 0))::INT AS score FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(lift, 9) DESC, tag) <= 3")
ANSWER = 10


def sentence_pairs(t):
    """Every vector is a sentence of the answer of ten that it belongs to; the chunks are the vectors of other answers.

    Of each sentence the four chunks it can cite are enough, and as many more as its own answer may displace.
    """
    sentences, answer = t.embeddings.select(c("vec_id").alias("query_id"), "embedding"), lambda x: F.floor(c(x) / ANSWER)
    near = V.nearest(sentences, indexed(t), 4 + ANSWER, digits=6).where(answer("query_id") != answer("chunk_id"))
    return near.select(answer("query_id").alias("answer_id"), c("query_id").alias("sentence"), c("chunk_id").alias("chunk"), F.round("cosine", 6).alias("sim"))


add("v35_citations", lambda t: V.citations(sentence_pairs(t)), """
WITH p AS (SELECT a.vec_id // 10 AS answer_id, a.vec_id AS sentence, b.vec_id AS chunk, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id // 10 <> b.vec_id // 10),
m AS (SELECT *, max(sim) OVER (PARTITION BY answer_id, sentence) * 0.99 AS mx FROM p), t AS (SELECT *, max(mx) OVER (PARTITION BY answer_id) AS top FROM m),
l AS (SELECT * FROM t WHERE mx >= CASE WHEN top >= 0.63 THEN 0.63 WHEN top >= 0.504 THEN 0.504 WHEN top >= 0.4032 THEN 0.4032 WHEN top >= 0.32256 THEN 0.32256 ELSE 1e9 END AND sim > mx QUALIFY row_number() OVER (PARTITION BY answer_id, sentence ORDER BY sim DESC, chunk) <= 4)
SELECT answer_id, min(sentence) AS sentence, chunk FROM l GROUP BY answer_id, chunk""")


def marked_answers(t):
    """One answer for each form of mark, well shaped or not, around the number p_size."""
    n = c("p_size").cast("string")
    eastern = F.translate(n, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    forms = [("(ID", n, ")"), ("( ID : ", n, " )"), ("【ID: ", n, "】"), ("[ ID", n, "]"), ("see REF ", n, "."), ("ref", n, ""), ("(id: ", n, ")"), ("[", n, "]"), ("(ID:", eastern, ")")]
    # Many answers come from a file of few megabytes, so its rows are spread before they are worked on.
    spread = t.part.select("p_partkey", "p_size").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.concat(F.lit("so "), F.lit(a), x, F.lit(b)).alias("answer")) for i, (a, x, b) in enumerate(forms)])).alias("m")).select("p_partkey", "m.*")


REPAIRED = """WITH p AS (SELECT p_partkey, p_size < 25 AS good, p_size::VARCHAR AS n, translate(p_size::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS e FROM part),
f AS (SELECT p_partkey, good, unnest([{'form': 0, 'raw': '(ID' || n || ')', 'ok': '[ID:' || n || ']'}, {'form': 1, 'raw': '( ID : ' || n || ' )', 'ok': '[ID:' || n || ']'}, {'form': 2, 'raw': '【ID: ' || n || '】', 'ok': '[ID:' || n || ']'},
 {'form': 3, 'raw': '[ ID' || n || ']', 'ok': '[ID:' || n || ']'}, {'form': 4, 'raw': 'see REF ' || n || '.', 'ok': 'see [ID:' || n || '].'}, {'form': 5, 'raw': 'ref' || n, 'ok': '[ID:' || n || ']'},
 {'form': 6, 'raw': '(id: ' || n || ')', 'ok': '(id: ' || n || ')'}, {'form': 7, 'raw': '[' || n || ']', 'ok': '[' || n || ']'}, {'form': 8, 'raw': '(ID:' || e || ')', 'ok': '[ID:' || e || ']'}]) AS x, n FROM p)
SELECT p_partkey, x.form, 'so ' || CASE WHEN good THEN x.ok ELSE x.raw END AS v, CASE WHEN good AND x.form NOT IN (6, 7) THEN [n::INT] ELSE [] END AS cited FROM f"""
add("v36_citation_repair", lambda t: marked_answers(t).select("p_partkey", "form", V.repair_citations(c("answer"), 25).alias("v")).withColumn("cited", V.cited_chunks(c("v"), 25)), REPAIRED)
add("v38_evaluator_rerank", lambda t: V.nearest(asked(t), indexed(t), 30).join(indexed(t).select("chunk_id", "label"), "chunk_id").join(indexed(t).select(c("chunk_id").alias("query_id"), c("label").alias("ql")), "query_id").withColumn("sim", F.round(0.3 * c("cosine") + 0.7 * (c("label") == c("ql")).cast("double"), 6)).where("sim >= 0.2").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id"))).select("query_id", "chunk_id", "sim", "rank"), f"SELECT n.query_id, n.chunk_id, round(0.3 * cosine + 0.7 * (n.label = q.label)::INT, 6) AS sim, row_number() OVER (PARTITION BY n.query_id ORDER BY round(0.3 * cosine + 0.7 * (n.label = q.label)::INT, 6) DESC, n.chunk_id)::INT AS rank FROM ({NEAR}) n JOIN embeddings q ON q.vec_id = n.query_id WHERE round(0.3 * cosine + 0.7 * (n.label = q.label)::INT, 6) >= 0.2")
add("v30_keyword_expansion", lambda t: t.benchmark.select("item_id", F.size(F.array_distinct(F.filter(F.concat(text.tokens("text"), text.fine_tokens("text")), lambda x: F.length(x) >= 2))).cast("long").alias("n")), rf"SELECT item_id, len(list_distinct(list_filter({TOK}, lambda x: length(x) >= 2)))::BIGINT AS n FROM benchmark")
FLAGSHIP = "v06_bm25_top10"
assert FLAGSHIP in ORACLES
