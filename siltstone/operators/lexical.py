"""Lexical retrieval: postings, weights and scores as DataFrames.

An index is a DataFrame of postings (chunk_id, field, token, tf, length) and one of document frequencies; questions
are a DataFrame of weighted terms. Scoring is a join on (field, token), combined per chunk before it is shuffled again, so
a batch of questions is one plan and no pair of question and chunk without a common token is ever made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import matching

# Boosts of the fields, BM25's constants, weights of word kinds.
BOOSTS = {"title_tks": 10.0, "title_sm_tks": 5.0, "important_kwd": 30.0, "important_tks": 20.0, "question_tks": 20.0, "content_ltks": 2.0, "content_sm_ltks": 1.0}
K1, B = 1.2, 0.75
FREQ_TOTAL, DF_TOTAL = 1e7, 1e9


#: Question tokens up to this many are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_TOKENS = 500_000
#: Chunks whose pairs with questions are summed in one task.
PART_CHUNKS = 2000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame, marked for broadcast if it has few enough rows; ``rows`` is a bound of them where one is known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_TOKENS else df


def _fields(chunks: DataFrame, fields: dict[str, Column], chunk_id: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("tokens")) for n, c in fields.items()])).alias("f")
    return chunks.select(chunk_id, each).select(chunk_id, "f.field", "f.tokens", F.size("f.tokens").alias("length"))


def postings(chunks: DataFrame, fields: dict[str, Column], chunk_id: str = "chunk_id", tokens: DataFrame | None = None) -> DataFrame:
    """One row per chunk, field and distinct token with its count and the field's length.

    With ``tokens`` (token, distinct) only postings of these are made: tokens are looked up where the chunks are read,
    before anything is shuffled, so a batch of questions moves its own postings and no others.
    """
    flat = _fields(chunks, fields, chunk_id).select(chunk_id, "field", "length", F.explode("tokens").alias("token"))
    if tokens is not None:
        flat = flat.join(small(tokens.select("token").distinct()), "token", "left_semi")
    return flat.groupBy(chunk_id, "field", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def frequencies(index: DataFrame, chunks: DataFrame, fields: dict[str, Column], chunk_id: str = "chunk_id") -> DataFrame:
    """df, mean field length and number of chunks for each (field, token) of the index; lengths need no token."""
    df = index.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
    lengths = _fields(chunks, fields, chunk_id).groupBy("field").agg(F.avg("length").alias("avgdl"), F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(lengths), "field")


def bm25(tf: Column, df: Column, n: Column, length: Column, avgdl: Column) -> Column:
    """V6: the default similarity of analysed text."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + K1 * (1 - B + B * length / avgdl))


def scaled_idf(tf: Column, df: Column, n: Column) -> Column:
    """V5: idf over the idf of a token found once, for tokens that occur."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) / F.log(1 + (n - 0.5) / 1.5) * F.least(tf, F.lit(1))


def field_scores(index: DataFrame, stats: DataFrame, terms: DataFrame, similarity: str = "bm25", boosts: dict[str, float] | None = None, n_chunks: int = 0) -> DataFrame:
    """Score of each (query, chunk, field): the sum over terms of boost, weight and similarity; and the terms matched.

    Postings are dealt by chunk before they meet the questions, so pairs are summed where they are made. ``n_chunks``, where it is known,
    gives parts of ``PART_CHUNKS`` each, so that what a task holds doesn't grow with the corpus.
    """
    boosts = boosts or {}
    boost = F.coalesce(*[F.when(F.col("field") == f, F.lit(b)) for f, b in boosts.items()], F.lit(1.0))
    s = {"bm25": bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("avgdl")), "idf": scaled_idf(F.col("tf"), F.col("df"), F.col("n")), "boolean": F.lit(1.0)}[similarity]
    # Statistics have a row for each field and token at most; only those of the questions' tokens are joined.
    asked = terms.select("token").distinct()
    n_tokens = asked.count()
    if similarity != "boolean":
        index = index.join(small(stats.join(small(asked, n_tokens), "token", "left_semi"), 8 * n_tokens), ["field", "token"])
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_chunks // PART_CHUNKS))
    hits = index.repartition(parts, "chunk_id").join(small(terms), "token")
    return hits.groupBy("query_id", "chunk_id", "field").agg(F.sum(boost * F.col("weight") * s).alias("score"), F.collect_set("token").alias("matched"))


def best_fields(scores: DataFrame, terms: DataFrame, min_match: float = 0.3) -> DataFrame:
    """V7, V8: the best field's score of each (query, chunk) that matches enough distinct terms in all fields together."""
    wanted = terms.groupBy("query_id").agg(F.countDistinct("token").alias("n_terms"))
    merged = scores.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("n_matched"))
    return merged.join(small(wanted), "query_id").where(F.col("n_matched") >= F.greatest(F.lit(1), F.floor(F.lit(min_match) * F.col("n_terms"))))


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best chunks of each query, ties by id; the limit reaches below the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relaxed(matches: DataFrame, terms: DataFrame, first: float = 0.3, second: float = 0.1) -> DataFrame:
    """Questions without any hit at the first share of matched terms are asked again at the second."""
    strict = enough(matches, terms, first).withColumn("phase", F.lit(1))
    loose = enough(matches, terms, second).join(strict.select("query_id").distinct(), "query_id", "left_anti").withColumn("phase", F.lit(2))
    return strict.unionByName(loose)


def phrases(chunks: DataFrame, tokens: Column, pairs: DataFrame, slop: int = 0, chunk_id: str = "chunk_id") -> DataFrame:
    """V9: chunks in which the pair's second token stands behind the first (``slop``: or so near), with the count.

    ``pairs``: query_id, a, b, distinct; ``chunk_id`` is a key. A chunk's neighbours are looked up where it is read, so only counts of
    pairs that are asked for are shuffled.
    """
    flat = chunks.where(F.col(chunk_id).isNotNull()).select(F.col(chunk_id).alias("chunk_id"), tokens.alias("_t"))
    n = F.size("_t")
    shifted = lambda d: F.zip_with(F.slice("_t", 1, F.greatest(n - d, F.lit(0))), F.slice("_t", d + 1, F.greatest(n - d, F.lit(0))), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    ahead = [shifted(d) for d in range(1, slop + 2)]
    behind = [F.transform(p, lambda x: F.struct(x["b"].alias("a"), x["a"].alias("b"))) for p in ahead] if slop else []
    near = flat.select("chunk_id", F.explode(F.concat(*ahead, *behind) if slop else ahead[0]).alias("p")).select("chunk_id", "p.a", "p.b")
    return near.join(small(pairs), ["a", "b"]).groupBy("query_id", "chunk_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _idf10(s: Column, n: float) -> Column:
    return F.log10(10 + (n - s + 0.5) / (s + 0.5))


def raw_weight(token: Column) -> Column:
    """A token's weight before normalising, by the branches that need no dictionary."""
    number = token.rlike(r"^[0-9. -]{2,}$")
    latin = token.rlike(r"^[a-z. -]+$")
    freq = F.when(number, 3.0).when(latin, 300.0).otherwise(10.0)
    df = F.when(number, 5.0).when(latin, 300.0).otherwise(3.0)
    kind = F.when(token.rlike(r"^[0-9,.]{2,}$"), 2.0).when(token.rlike(r"^[a-z]{1,2}$"), 0.01).otherwise(1.0)
    pos = F.when(token.rlike(r"^[0-9-]+"), 2.0).otherwise(1.0)
    return (0.3 * _idf10(freq, FREQ_TOTAL) + 0.7 * _idf10(df, DF_TOTAL)) * kind * pos


# Weights of kinds of names and of parts of speech.
NAME_WEIGHTS = {"toxic": 2.0, "func": 1.0, "corp": 3.0, "loca": 3.0, "sch": 3.0, "stock": 3.0, "firstnm": 1.0}
TAG_WEIGHTS = {"r": 0.3, "c": 0.3, "d": 0.3, "ns": 3.0, "nt": 3.0, "n": 2.0}


def corpus_lexicon(chunks: DataFrame, tokens: Column, chunk_id: str = "chunk_id") -> DataFrame:
    """How often each token occurs, and in how many texts: token, freq, df, and null kinds of name and part of speech."""
    each = chunks.select(F.col(chunk_id).alias("_c"), F.explode(tokens).alias("token")).groupBy("_c", "token").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("df")).select("token", "freq", "df", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tag"))


def lexicon_weights(flat: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``flat`` (query_id, pos, token) with the normalised ``weight`` of each token by a lexicon (token, freq, df, name, tag).

    Tokens that the lexicon lacks and that aren't Latin count by their parts: a sixth of the rarest of two or more.
    Only rows of the lexicon that questions ask for are joined.
    """
    t = F.col("token")
    numbers, latin = t.rlike(r"^[0-9. -]{2,}$"), t.rlike(r"^[a-z. -]+$")
    parts = F.filter(text.fine_tokens(t), lambda x: F.length(x) > 1)
    words = flat.select("token").distinct().withColumn("parts", F.when((F.length("token") >= 4) & ~latin & ~numbers & (F.size(parts) > 1), parts))
    asked = words.select("token").union(words.select(F.explode("parts"))).distinct()
    found = asked.join(lexicon, "token", "left")
    # The value of a token of its own, null where its parts are to be asked.
    own_freq = F.when(numbers, F.lit(3.0)).when(F.col("freq") > 0, F.greatest(F.col("freq").cast("double"), F.lit(10.0))).when(latin, F.lit(300.0))
    own_df = F.when(numbers, F.lit(5.0)).when(F.col("df").isNotNull(), F.col("df") + F.lit(3.0)).when(latin, F.lit(300.0))
    own = found.select("token", own_freq.alias("f"), own_df.alias("d"), "name", "tag")
    of_part = own.select(F.col("token").alias("part"), F.coalesce("f", F.lit(10.0)).alias("pf"), F.coalesce("d", F.lit(3.0)).alias("pd"))
    by_parts = words.select("token", F.explode("parts").alias("part")).join(of_part, "part").groupBy("token").agg((F.min("pf") / 6).alias("pf"), (F.min("pd") / 6).alias("pd"))
    freq = F.coalesce("f", F.greatest("pf", F.lit(10.0)), F.lit(10.0))
    df = F.coalesce("d", F.greatest("pd", F.lit(3.0)), F.lit(3.0))
    kind = F.when(t.rlike(r"^[0-9,.]{2,}$"), 2.0).when(t.rlike(r"^[a-z]{1,2}$"), 0.01).otherwise(F.coalesce(*[F.when(F.col("name") == n, F.lit(w)) for n, w in NAME_WEIGHTS.items()], F.lit(1.0)))
    speech = F.coalesce(*[F.when(F.col("tag") == n, F.lit(w)) for n, w in TAG_WEIGHTS.items()], F.when(t.rlike("^[0-9-]+"), F.lit(2.0)), F.lit(1.0))
    valued = own.join(by_parts, "token", "left").select("token", ((0.3 * _idf10(freq, FREQ_TOTAL) + 0.7 * _idf10(df, DF_TOTAL)) * kind * speech).alias("w"))
    return flat.join(valued, "token").withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).select("query_id", "pos", "token", "weight")


def weighted(tokens: Column) -> Column:
    """(token, weight) of each token in order; the weights sum to 1."""
    w = F.transform(tokens, lambda t: F.struct(t.alias("token"), raw_weight(t).alias("w")))
    return w


def query_terms(questions: DataFrame, tokens: Column, query_id: str = "query_id") -> DataFrame:
    """Terms with normalised weights, and adjacent pairs at twice the larger weight: query_id, pos, kind, token,
    next, weight."""
    flat = questions.select(F.col(query_id).alias("query_id"), F.posexplode(weighted(tokens)).alias("pos", "x")).select("query_id", "pos", "x.token", "x.w")
    by = Window.partitionBy("query_id")
    flat = flat.withColumn("weight", F.col("w") / F.sum("w").over(by))
    ordered = by.orderBy("pos")
    pairs = flat.withColumn("next", F.lead("token").over(ordered)).withColumn("pair_weight", 2 * F.greatest("weight", F.lead("weight").over(ordered)))
    return pairs.select("query_id", "pos", F.lit("term").alias("kind"), "token", F.lit(None).cast("string").alias("next"), "weight").unionByName(
        pairs.where("next IS NOT NULL").select("query_id", "pos", F.lit("phrase").alias("kind"), "token", "next", F.col("pair_weight").alias("weight"))
    )


def similarity_terms(texts: DataFrame, tokens: Column, key: str) -> DataFrame:
    """The map behind token similarity as rows (key, term, weight): unigrams at 0.4, adjacent pairs at 0.6 of the larger."""
    flat = texts.select(F.col(key).alias("key"), F.posexplode(weighted(tokens)).alias("pos", "x")).select("key", "pos", "x.token", "x.w")
    by = Window.partitionBy("key")
    flat = flat.withColumn("weight", F.col("w") / F.sum("w").over(by))
    ordered = by.orderBy("pos")
    wide = flat.withColumn("n", F.lead("token").over(ordered)).withColumn("nw", F.lead("weight").over(ordered))
    both = F.array(F.struct(F.col("token").alias("t"), (0.4 * F.col("weight")).alias("w")), F.when(F.col("n").isNotNull(), F.struct(F.concat("token", "n").alias("t"), (0.6 * F.greatest("weight", "nw")).alias("w"))))
    return wide.select("key", F.explode(F.array_compact(both)).alias("e")).groupBy("key", F.col("e.t").alias("term")).agg(F.sum("e.w").alias("weight"))


def similarity_keys(texts: DataFrame, tokens: Column, key: str) -> DataFrame:
    """The distinct terms of each text, without weights: (key, term)."""
    flat = texts.select(F.col(key).alias("key"), tokens.alias("_t"))
    pairs = F.zip_with(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))), F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return flat.select("key", F.explode(F.array_distinct(F.concat("_t", pairs))).alias("term"))


def token_similarity(query: DataFrame, docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Asymmetric coverage of the query's terms by a document's: query_id, chunk_id, tksim, for pairs with a common term."""
    total = query.groupBy("key").agg(F.sum("weight").alias("total"))
    q = query.select(F.col("key").alias("query_id"), "term", "weight")
    d = docs.select(F.col("key").alias("chunk_id"), "term")
    hit = d.join(small(q), "term").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("m"))
    if pairs is not None:
        hit = pairs.select("query_id", "chunk_id").distinct().join(hit, ["query_id", "chunk_id"], "left")
    return hit.join(small(total.withColumnRenamed("key", "query_id")), "query_id").select("query_id", "chunk_id", ((F.coalesce("m", F.lit(0.0)) + 1e-9) / (F.col("total") + 1e-9)).alias("tksim"))


def term_book(query: DataFrame) -> matching.Book | None:
    """The terms of ``similarity_terms`` as a book, None for more than ``BROADCAST_TOKENS``."""
    return matching.book(query.select(F.col("key").alias("query_id"), F.col("term").alias("token"), "weight"), BROADCAST_TOKENS)


def text_similarity(query: DataFrame, texts: DataFrame, tokens: Column, key: str, most: int = 0, digits: int = 6) -> DataFrame:
    """``token_similarity`` of texts, each pair summed where its text is read: query_id, chunk_id, tksim.

    With ``most``, only the pairs that may be among so many best ones of their question, rounded to ``digits``, ties included. More than
    ``BROADCAST_TOKENS`` terms of questions are joined as rows, and then all pairs are given.
    """
    asked = term_book(query)
    if asked is None:
        return token_similarity(query, similarity_keys(texts, tokens, key))
    return matching.covered(texts.select(key, tokens), asked, most, 10.0**-digits)


def expand_synonyms(terms: DataFrame, synonyms: DataFrame, most: int = 8, share: float = 0.25) -> DataFrame:
    """Up to ``most`` synonyms of each term at a share of its weight; ``synonyms``: token, synonym, rank."""
    found = terms.join(small(synonyms.where(F.col("rank") <= most)), "token").select("query_id", F.col("synonym").alias("token"), (F.col("weight") * share).alias("weight"))
    return terms.select("query_id", "token", "weight").unionByName(found)


def content_query(docs: DataFrame, tokens: Column, key: str, most: int = 30) -> DataFrame:
    """A text's own terms of largest weight as a question, and how many of them have to match."""
    flat = docs.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(tokens)).alias("token")).withColumn("weight", raw_weight(F.col("token")))
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "token")
    kept = flat.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return kept.withColumn("min_match", F.least(F.lit(3), F.round(F.count(F.lit(1)).over(Window.partitionBy("query_id")) / 10)).cast("int")).drop("rn")


def without_noise(tokens: Column, stop_words: list[str]) -> Column:
    """Tokens without stop words, punctuation and single digits."""
    return F.filter(tokens, lambda t: ~t.isin(stop_words) & t.rlike(r"[\p{L}\p{N}]") & ~t.rlike(r"^[0-9]$"))


def merged_singles(tokens: Column) -> Column:
    """Runs of tokens of one character: two to four are joined, longer ones are joined by pairs."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))

    def flush(a: Column) -> Column:
        run = a["run"]
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(run), F.lit(1)), F.lit(2)), lambda i: F.array_join(F.slice(run, i, 2), ""))
        joined = F.when(F.size(run) == 0, F.array().cast("array<string>")).when(F.size(run) <= 4, F.array(F.array_join(run, ""))).otherwise(pairs)
        return F.concat(a["out"], joined)

    def step(a: Column, t: Column) -> Column:
        longer = F.struct(a["out"].alias("out"), F.concat(a["run"], F.array(t)).alias("run"))
        closed = F.struct(F.concat(flush(a), F.array(t)).alias("out"), F.array().cast("array<string>").alias("run"))
        return F.when(F.length(t) == 1, longer).otherwise(closed)

    return F.aggregate(tokens, start, step, flush)


def joined_latin(words: Column) -> Column:
    """Neighbouring words that end and begin with Latin letters count as one term."""
    start = F.array().cast("array<string>")

    def step(a: Column, w: Column) -> Column:
        last = F.element_at(a, -1)
        fits = (F.size(a) > 0) & F.coalesce(last.rlike(r"[a-zA-Z]$"), F.lit(False)) & w.rlike(r"^[a-zA-Z]")
        return F.when(fits, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(a, F.array(w)))

    return F.aggregate(words, start, step)


def segmented_terms(questions: DataFrame, segments: Column, fine: Column, query_id: str = "query_id", most: int = 256, keywords: int = 32) -> DataFrame:
    """Terms of questions in scripts without blanks: each segment at five times its weight, its pairs at a tenth of that;
    at most ``most`` segments, and the heaviest ``keywords`` of them."""
    flat = questions.select(F.col(query_id).alias("query_id"), F.posexplode(F.slice(segments, 1, most)).alias("pos", "token"), fine.alias("_fine"))
    flat = flat.withColumn("w", raw_weight(F.col("token")))
    top = flat.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "pos"))).where(F.col("_rn") <= keywords)
    top = top.withColumn("weight", 5 * F.col("w") / F.sum("w").over(Window.partitionBy("query_id")))
    parts = F.array_distinct(F.concat(F.array(F.struct("token", "weight")), F.transform(F.filter("_fine", lambda x: F.col("token").contains(x) & (x != F.col("token"))), lambda x: F.struct(x.alias("token"), (F.col("weight") / 10).alias("weight")))))
    return top.select("query_id", F.explode(parts).alias("t")).groupBy("query_id", "t.token").agg(F.sum("t.weight").alias("weight"))


# Boosts of a segment's clauses in questions of scripts without blanks.
SEGMENT_BOOST, SEGMENT_SYNONYM, TOKEN_SYNONYM, FINE_NEAR, SEGMENT_NEAR = 5.0, 0.7, 0.2, 0.5, 1.5


def segment_clauses(segments: DataFrame, weights: DataFrame, synonyms: DataFrame, most: int = 256) -> DataFrame:
    """The clauses of questions in scripts without blanks: query_id, seg, kind, text, weight.

    ``segments``: query_id, seg, segment; ``weights``: query_id, seg, token, weight (the tokens of each segment); ``synonyms``:
    term, synonym. Tokens weigh as they do, synonyms of a token a fifth of it; longer tokens that aren't Latin are asked for by
    their parts too, as a phrase, and near each other at half the weight. The tokens of a segment near each other add a clause.
    If the segment itself has synonyms, they are a clause each and everything before counts five times.
    """
    kept = segments.where((F.col("seg") < most) & (F.col("segment") != ""))
    named = synonyms.select(F.col("term").alias("_term"), "synonym")
    whole = kept.join(named, kept["segment"] == named["_term"]).select("query_id", "seg", F.lit("segment_synonym").alias("kind"), F.col("synonym").alias("text"), F.lit(SEGMENT_SYNONYM).alias("weight"))
    raised = whole.select("query_id", "seg", F.lit(SEGMENT_BOOST).alias("_times")).distinct()
    tokens = weights.join(kept.select("query_id", "seg"), ["query_id", "seg"], "left_semi")
    parts = F.filter(F.transform(text.fine_tokens("token"), text.escape_query), lambda x: F.length(x) > 1)
    fine = tokens.where((F.length("token") >= 3) & ~F.col("token").rlike(r"^[0-9a-z.+#_*-]+$")).withColumn("_p", parts).where(F.size("_p") > 0).withColumn("text", F.array_join("_p", " "))
    clause = lambda df, kind, said, weight: df.select("query_id", "seg", F.lit(kind).alias("kind"), said.alias("text"), weight.alias("weight"))
    w = F.col("weight")
    inner = clause(tokens, "term", text.escape_query("token"), w).unionByName(clause(fine, "fine_phrase", F.col("text"), w)).unionByName(clause(fine, "fine_near", F.col("text"), w * FINE_NEAR))
    inner = inner.unionByName(clause(tokens.join(named, tokens["token"] == named["_term"]), "token_synonym", text.escape_query("synonym"), w * TOKEN_SYNONYM))
    several = tokens.groupBy("query_id", "seg").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query_id", "seg")
    near = kept.join(several, ["query_id", "seg"])
    inner = inner.unionByName(clause(near, "segment_near", F.array_join(text.fine_tokens("segment"), " "), F.lit(SEGMENT_NEAR)))
    boosted = inner.join(raised, ["query_id", "seg"], "left").withColumn("weight", w * F.coalesce("_times", F.lit(1.0))).drop("_times")
    return boosted.where(F.trim("text") != "").unionByName(whole)


def _bm25(tf: np.ndarray, df: np.ndarray, n: float, length: np.ndarray, avgdl: float) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + K1 * (1 - B + B * length / avgdl))


def match_scores(chunks: DataFrame, fields: dict[str, Column], terms: DataFrame, boosts: dict[str, float] | None = None, chunk_id: str = "chunk_id") -> DataFrame:
    """V6-V8 for a batch of questions: query_id, chunk_id, the best field's BM25 score and the number of terms matched.

    Texts are read and tokenised once: the postings of the questions' tokens go on in packs of many chunks, which are counted, and then
    scored and summed where they lie. ``chunk_id`` is a key. More than ``BROADCAST_TOKENS`` terms are joined as rows.
    """
    boosts = boosts or {}
    asked = matching.book(terms, BROADCAST_TOKENS)
    if asked is None:
        return joined_scores(chunks, fields, terms, boosts, chunk_id)
    packs = matching.posted(chunks.select(chunk_id, *[tokens.alias(f) for f, tokens in fields.items()]), list(fields), asked)
    # A stated number, so that counting and scoring read the same parts, which are made once.
    packs = packs.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = matching.posted_counts(packs, len(fields), len(asked.tokens))
    return matching.scored(packs, counts, [boosts.get(f, 1.0) for f in fields], asked, _bm25)


def joined_scores(chunks: DataFrame, fields: dict[str, Column], terms: DataFrame, boosts: dict[str, float] | None = None, chunk_id: str = "chunk_id") -> DataFrame:
    """``match_scores`` by joins, for any number of terms.

    Postings of the questions' tokens are dealt by chunk once; counting, scoring and summing then stay where they are,
    and only document frequencies, one row a token, are shuffled besides. A posting is scored before it meets the questions
    that ask for it.
    """
    boosts = boosts or {}
    terms = terms.select("query_id", "token", "weight")
    wanted = terms.select("token").distinct()
    n_tokens = wanted.count()
    # A field's length travels as a posting of the empty token, which no text has, so texts are read and tokenised once.
    flat = _fields(chunks, fields, chunk_id).select(F.col(chunk_id).alias("chunk_id"), "field", "length", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"))
    lengths = chunks.sparkSession.createDataFrame([("",)], "token string")
    flat = flat.join(small(wanted.unionByName(lengths), n_tokens + 1), "token", "left_semi")
    # A stated number: what is read back grows with the questions, so few small partitions would be too few.
    flat = flat.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
    here = {f: F.col("field") == f for f in fields}
    wide = flat.groupBy("chunk_id", "token").agg(*[F.count_if(w).alias(f"tf_{f}") for f, w in here.items()], *[F.max(F.when(w, F.col("length"))).alias(f"len_{f}") for f, w in here.items()])
    # All that stands on the postings reads the same columns of them, so that they are made once and read again.
    is_length = F.col("token") == ""
    df = wide.groupBy("token").agg(*[F.count_if((F.col(f"tf_{f}") > 0) & F.col(f"len_{f}").isNotNull()).alias(f"df_{f}") for f in fields])
    means = wide.agg(*[F.avg(F.when(is_length & (F.col(f"tf_{f}") > 0), F.col(f"len_{f}"))).alias(f"avg_{f}") for f in fields], F.count_if(is_length).alias("n"))
    score = lambda f: F.when(F.col(f"tf_{f}") > 0, F.lit(boosts.get(f, 1.0)) * bm25(F.col(f"tf_{f}"), F.col(f"df_{f}"), F.col("n"), F.col(f"len_{f}"), F.col(f"avg_{f}"))).otherwise(0.0)
    scored = wide.join(small(df, n_tokens + 1), "token").crossJoin(F.broadcast(means)).select("chunk_id", "token", *[score(f).alias(f"s_{f}") for f in fields])
    met = scored.join(small(terms), "token").groupBy("query_id", "chunk_id").agg(*[F.sum(F.col("weight") * F.col(f"s_{f}")).alias(f"s_{f}") for f in fields], F.count(F.lit(1)).cast("int").alias("n_matched"))
    best = F.greatest(*[F.col(f"s_{f}") for f in fields]) if len(fields) > 1 else F.col(f"s_{next(iter(fields))}")
    return met.select("query_id", "chunk_id", best.alias("score"), "n_matched")


def enough(matches: DataFrame, terms: DataFrame, min_match: float) -> DataFrame:
    """V8: the matches with enough of their question's distinct terms."""
    wanted = terms.groupBy("query_id").agg(F.countDistinct("token").alias("n_terms"))
    return matches.join(small(wanted), "query_id").where(F.col("n_matched") >= F.greatest(F.lit(1), F.floor(F.lit(min_match) * F.col("n_terms"))))
