"""Vector and hybrid retrieval: candidates, fusion, rerank, pages, citations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import lexical, matching

#: Vectors of one packed row (2 MB at 64 dimensions), and of one matrix product.
PACK, PRODUCT = 4096, 256
#: Rows of the best so far that a task holds in Python.
HELD = 1 << 18
#: Packed rows of questions up to this many are broadcast; more are joined by a shuffle.
BROADCAST_PACKS = 32
#: Questions and chunks of a block whose pairs are looked up together: half a million pairs at most.
PAIR_BLOCK, CHUNK_BLOCK = 2048, 256
_PACKED = "ids binary, x binary"


def _pack(ids: np.ndarray, x: np.ndarray) -> dict:
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return {"ids": ids.astype("<i8").tobytes(), "x": np.ascontiguousarray(x).tobytes()}


def _unpack(ids: bytes | pa.Buffer, x: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(x).reshape(len(ids), -1)


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Unit vectors by the thousand as single rows (ids, x), made where they are read: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                yield pa.RecordBatch.from_pylist([_pack(part.column("i").to_numpy(), _matrix(part.column("v"), part.num_rows))], pa.schema([("ids", pa.binary()), ("x", pa.binary())]))

    return vectors.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v")).where("i IS NOT NULL AND v IS NOT NULL").mapInArrow(run, _PACKED)


def grouped(vectors: DataFrame, key: str, vector: str, n: int, name: str) -> DataFrame:
    """Unit vectors in ``n`` blocks by a hash of their ids, one row each: the block under ``name``, ids in order, x; one vector of each id."""

    def run(rows: pa.Table) -> pa.Table:
        ids, at = np.unique(rows["i"].to_numpy(), return_index=True)
        return pa.Table.from_pylist([{name: rows[name][0].as_py()} | _pack(ids, _matrix(rows["v"], rows.num_rows)[at])], pa.schema([(name, pa.int64()), ("ids", pa.binary()), ("x", pa.binary())]))

    rows = vectors.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v")).where("i IS NOT NULL AND v IS NOT NULL")
    return rows.withColumn(name, F.pmod(F.xxhash64("i"), F.lit(n))).groupBy(name).applyInArrow(run, f"{name} long, {_PACKED}")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, min_cosine: float = -1.0, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """Exact k nearest by cosine rounded to ``digits``, ties by id: query_id, chunk_id, cosine.

    Vectors are packed where they are read and meet the packs of questions: by broadcast if these are few, otherwise by a
    shuffle on the number of the pack and a share of the vectors. Matrix products score two packs, and a task keeps the k best of each
    question, so only tasks * questions * k rows are shuffled. The plan doesn't depend on the number of questions, and none reaches
    the driver.
    """
    n_batches = max(1, math.ceil(queries.count() / PACK))
    asked = grouped(queries, query_id, vector, n_batches, "batch")
    asked = asked.select("batch", F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    batches = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_batches - 1).cast("long"))).alias("batch")
    if n_batches <= BROADCAST_PACKS:
        pairs = packed(vectors, chunk_id, vector).select("*", batches).join(F.broadcast(asked), "batch")
    else:
        shares = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
        pairs = packed(vectors, chunk_id, vector).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).select("*", batches).join(asked.select("*", share), ["batch", "share"])

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pd.DataFrame] = []
        size = 0
        for batch, at_row in ((b, i) for b in rows for i in range(b.num_rows)):
            # A batch has up to 64 MB of packs, which are looked at where they lie.
            (ids, q), (c, x) = (_unpack(*(batch.column(n)[at_row].as_buffer() for n in names)) for names in (("q_ids", "q"), ("ids", "x")))
            for first in range(0, len(q), PRODUCT):
                products = q[first : first + PRODUCT] @ x.T
                near = np.round(products, digits)
                # The k-th best of each question; ties with it stay until ids decide.
                floor = np.partition(near, -k, axis=1)[:, -k] if len(c) > k else np.full(len(near), -np.inf)
                i, at = np.nonzero(near >= floor[:, None])
                best.append(pd.DataFrame({"query_id": ids[first + i], "chunk_id": c[at], "cosine": products[i, at]}))
                size += len(i)
                if size > HELD:
                    best = [_top(pd.concat(best), k, digits)]
                    # What is merged already stays below the bound, or it is handed on.
                    if (size := len(best[0])) > HELD // 2:
                        yield pa.RecordBatch.from_pandas(best[0], preserve_index=False)
                        best, size = [], 0
        if best:
            yield pa.RecordBatch.from_pandas(_top(pd.concat(best), k, digits), preserve_index=False)

    out = pairs.select("q_ids", "q", "ids", "x").mapInArrow(score, "query_id long, chunk_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", digits)), "chunk_id")
    return out.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= k) & (F.col("cosine") >= min_cosine)).drop("_rn")


def pair_cosines(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``pairs`` with the cosine of each (query_id, chunk_id); 0 where the question or the chunk has no vector.

    Pairs are dealt by blocks of chunks and of questions; a block's vectors meet once, as two packed rows, and a matrix product has the
    numbers of all its pairs. No vector is joined to a pair.
    """
    block = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n))
    n_c, n_q = (max(1, math.ceil(df.count() / most)) for df, most in ((vectors, CHUNK_BLOCK), (queries, PAIR_BLOCK)))
    asked = grouped(queries, "query_id", vector, n_q, "_bq").select("_bq", F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    met = grouped(vectors, "chunk_id", vector, n_c, "_bc").withColumn("_bq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    met = met.join(F.broadcast(asked) if n_q <= BROADCAST_PACKS else asked, "_bq").select("_bc", "_bq", "q_ids", "q", "ids", "x")
    dealt = pairs.withColumns({"_bc": F.coalesce(block("chunk_id", n_c), F.lit(0).cast("long")), "_bq": F.coalesce(block("query_id", n_q), F.lit(0).cast("long")), "_q": F.col("query_id").cast("long"), "_c": F.col("chunk_id").cast("long")})

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        found = np.zeros(rows.num_rows)
        for one in known.to_pylist():
            (q_ids, q), (c_ids, x) = _unpack(one["q_ids"], one["q"]), _unpack(one["ids"], one["x"])
            i, at = (np.searchsorted(ids, rows[name].fill_null(-1).to_numpy()).clip(0, len(ids) - 1) for ids, name in ((q_ids, "_q"), (c_ids, "_c")))
            both = (q_ids[i] == rows["_q"].fill_null(-1).to_numpy()) & (c_ids[at] == rows["_c"].fill_null(-1).to_numpy()) & rows["_q"].is_valid().to_numpy() & rows["_c"].is_valid().to_numpy()
            found = np.where(both, (q @ x.T)[i, at], found)
        return rows.drop_columns(["_bc", "_bq", "_q", "_c"]).append_column("cosine", pa.array(found, pa.float64()))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + ["cosine double"])
    return dealt.groupBy("_bc", "_bq").cogroup(met.groupBy("_bc", "_bq")).applyInArrow(look_up, schema)


def _top(pdf: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    pdf = pdf.assign(_r=-pdf["cosine"].round(digits)).sort_values(["query_id", "_r", "chunk_id"])
    return pdf.groupby("query_id").head(k).drop(columns="_r")


def fuse(text: DataFrame, dense: DataFrame, vector_weight: float = 0.95, within_text: bool = True) -> DataFrame:
    """Weighted sum of text scores and vector similarities (1 + cos) / 2.

    ``within_text`` scores vectors only where the text matched, as a pre-filtered search does; otherwise the union of both.
    """
    how = "left" if within_text else "full"
    both = text.select("query_id", "chunk_id", F.col("score").alias("_t")).join(dense.select("query_id", "chunk_id", "cosine"), ["query_id", "chunk_id"], how)
    sim = F.coalesce((1 + F.col("cosine")) / 2, F.lit(0.0))
    return both.select("query_id", "chunk_id", ((1 - vector_weight) * F.coalesce("_t", F.lit(0.0)) + vector_weight * sim).alias("score"), "cosine")


def rank_feature(score: Column, *features: tuple[Column, float]) -> Column:
    """Features added linearly; missing ones add nothing."""
    for value, boost in features:
        score = score + boost * F.coalesce(value, F.lit(0.0))
    return score


def tag_similarity(query_tags: Column, chunk_tags: Column, pagerank: Column | None = None) -> Column:
    """Ten times the cosine of two tag maps, plus the page rank."""
    zero = F.lit(0.0)
    square = lambda m: F.aggregate(F.map_values(m), zero, lambda s, x: s + x * x)
    product = F.aggregate(F.map_values(F.map_zip_with(query_tags, chunk_tags, lambda k, a, b: F.coalesce(a * b, zero))), zero, lambda s, x: s + x)
    sim = 10 * F.coalesce(F.try_divide(product, F.sqrt(square(query_tags)) * F.sqrt(square(chunk_tags))), zero)
    return sim + F.coalesce(pagerank, zero) if pagerank is not None else sim


def hybrid(cosine: Column, tokens: Column, vector_weight: float, query_id: str = "query_id") -> Column:
    """The weighted similarity; questions whose cosines are all zero keep the unweighted token similarity."""
    silent = F.sum(F.abs(cosine)).over(Window.partitionBy(query_id)) == 0
    return F.when(silent, tokens).otherwise(vector_weight * cosine + (1 - vector_weight) * tokens)


def hybrid_sums(query: DataFrame, texts: DataFrame, tokens: Column, key: str, queries: DataFrame, vectors: DataFrame, vector_weight: float, vector: str = "embedding") -> DataFrame:
    """The number of pairs with a common term of each question, and the sum of their ``hybrid``: query_id, n, s.

    ``query``: terms as of ``similarity_terms``; ``queries``: query_id and vector; ``vectors``: chunk_id and vector. Texts meet the vector of
    their chunk, one row each, and a task sums its pairs; whether all cosines of a question are zero is added up too. More questions than
    ``BROADCAST_PACKS`` packs, or terms than ``BROADCAST_TOKENS``, are joined as rows.
    """
    asked = lexical.term_book(query)
    if asked is None or len(asked.ids) > BROADCAST_PACKS * PACK:
        pairs = pair_cosines(lexical.text_similarity(query, texts, tokens, key), queries, vectors, vector)
        mixed = vector_weight * F.col("cosine") + (1 - vector_weight) * F.col("tksim")
        sums = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("cosine")).alias("cosines"), F.sum("tksim").alias("tksim"), F.sum(mixed).alias("mixed"))
    else:
        one = lambda df, name: df.select(F.col(name).alias("_i"), F.col(vector).alias("_v")).where("_i IS NOT NULL AND _v IS NOT NULL").groupBy("_i").agg(F.first("_v").alias("_v"))
        rows = one(queries, "query_id").limit(BROADCAST_PACKS * PACK).toArrow()
        known = {i: at for at, i in enumerate(rows["_i"].to_pylist())}
        at = np.array([known.get(i, -1) for i in asked.ids.to_pylist()], dtype=int)
        x = np.zeros((len(at), 0))
        if len(known) and len(at):
            q = _matrix(rows["_v"], rows.num_rows)
            x = np.where(at[:, None] >= 0, (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))[at], 0.0)
        named = texts.withColumn("_i", F.col(key)).join(one(vectors, "chunk_id").hint("shuffle_hash"), "_i", "left")
        sums = matching.mixed_sums(named.select(key, tokens, "_v"), asked, x, vector_weight)
    return sums.select("query_id", "n", F.when(F.col("cosines") == 0, F.col("tksim")).otherwise(F.col("mixed")).alias("s"))


def rerank_tokens(content: Column, title: Column, important: Column, question: Column) -> Column:
    """Distinct content tokens, title twice, important words five and questions six times."""
    return F.concat(F.array_distinct(content), F.flatten(F.array_repeat(title, 2)), F.flatten(F.array_repeat(important, 5)), F.flatten(F.array_repeat(question, 6)))


def window_size(page_size: int) -> int:
    """Rows that are reranked for pages of this size."""
    return 30 if page_size <= 1 else max(30, math.ceil(64 / page_size) * page_size)


def window_end(page: int, page_size: int) -> int:
    """How many of each question's best rows reach to the end of the window of a page."""
    limit = window_size(page_size)
    return ((page - 1) // max(1, limit // page_size) + 1) * limit


def page_window(scored: DataFrame, page: int, page_size: int) -> DataFrame:
    """The rows of each question by ``score`` that are reranked for a page; only these need similarities."""
    limit = window_size(page_size)
    block = (page - 1) // max(1, limit // page_size)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("_w", rank).where((F.col("_w") > block * limit) & (F.col("_w") <= (block + 1) * limit)).drop("_w")


def result_page(scored: DataFrame, page: int, page_size: int, threshold: float = 0.2, vector_weight: float = 0.3, fixed_documents: bool = False) -> DataFrame:
    """One page of each question's reranked window: rows above the threshold in a stable order, with the total.

    ``scored``: query_id, chunk_id, score, sim. The window is cut by ``score``, the page by ``sim``.
    """
    floor = 0.0 if vector_weight <= 0 or fixed_documents else threshold
    return ranked_page(page_window(scored, page, page_size), page, page_size, floor)


def ranked_page(window: DataFrame, page: int, page_size: int, floor: float = 0.2) -> DataFrame:
    """One page of the rows of a window with ``sim`` from ``floor`` on."""
    by = Window.partitionBy("query_id")
    kept = window.where(F.col("sim") >= floor).withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), "chunk_id"))).withColumn("total", F.count(F.lit(1)).over(by))
    first = ((page - 1) % max(1, window_size(page_size) // page_size)) * page_size
    return kept.where((F.col("rank") > first) & (F.col("rank") <= first + page_size)).drop("score")


def document_hits(hits: DataFrame, doc: str) -> DataFrame:
    """Documents of each question by number of hits."""
    return hits.groupBy("query_id", doc).agg(F.count(F.lit(1)).alias("n"))


def best_document(hits: DataFrame, doc: str, sim: str = "sim") -> DataFrame:
    """The document with the largest sum of similarities of each question."""
    sums = hits.groupBy("query_id", doc).agg(F.sum(sim).alias("s"))
    return sums.groupBy("query_id").agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col(doc)).alias("d"))).alias("m")).select("query_id", (-F.col("m.d")).alias(doc))


def boost_merge(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra scores are added to hits or join them: query_id, chunk_id, sim."""
    joined = hits.select("query_id", "chunk_id", F.col("sim").alias("_a")).join(extra.select("query_id", "chunk_id", F.col("sim").alias("_b")), ["query_id", "chunk_id"], "full")
    return joined.select("query_id", "chunk_id", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("sim"))


def collapse_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Children give way to their parent with their mean similarity; hits without one stay.

    ``hits``: query_id, chunk_id, mom_id, sim, content; ``parents``: chunk_id, content.
    """
    own = hits.where("mom_id IS NULL").select("query_id", "chunk_id", "sim", "content", F.lit(1).cast("long").alias("children"))
    grouped = hits.where("mom_id IS NOT NULL").groupBy("query_id", "mom_id").agg(F.avg("sim").alias("sim"), F.count(F.lit(1)).alias("children"))
    named = parents.select(F.col("chunk_id").alias("mom_id"), "content")
    return own.unionByName(grouped.join(named, "mom_id").select("query_id", F.col("mom_id").alias("chunk_id"), "sim", "content", "children"))


def tag_priors(tags: DataFrame, smoothing: int = 1000) -> DataFrame:
    """Share of each tag (tag, n) with add-one smoothing."""
    total = tags.agg(F.sum("n").alias("_total"))
    return tags.crossJoin(F.broadcast(total)).withColumn("prior", (F.col("n") + 1) / (F.col("_total") + smoothing)).drop("_total")


def tag_scores(matching: DataFrame, priors: DataFrame, keep: int = 3, smoothing: int = 1000) -> DataFrame:
    """Tags of each question by lift over their prior, rounded half to even; dots become underscores.

    ``matching``: query_id, tag, c (matching chunks with the tag), cnt (all its matching chunks).
    """
    lift = 0.1 * (F.col("c") + 1) / (F.col("cnt") + smoothing) / F.greatest(F.col("prior"), F.lit(0.0001))
    scored = matching.join(priors.select("tag", "prior"), "tag").withColumn("score", F.greatest(F.lit(1), F.bround(lift)).cast("int")).withColumn("_l", lift)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("_l", 9)), "tag")
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).select("query_id", F.replace("tag", F.lit("."), F.lit("_")).alias("tag"), "score")


CITATION_LEVELS = [0.63 * 0.8**i for i in range(8) if 0.63 * 0.8**i > 0.3]


def citations(pairs: DataFrame, most: int = 4) -> DataFrame:
    """Chunks cited by each sentence of an answer: answer_id, sentence, chunk, first uses only.

    ``pairs``: answer_id, sentence, chunk, sim. The threshold falls from 0.63 by a fifth until any sentence of the answer has
    a chunk above it; a sentence cites up to ``most`` chunks above 99 % of its best.
    """
    per = Window.partitionBy("answer_id", "sentence")
    best = pairs.withColumn("mx", F.max("sim").over(per) * 0.99)
    top = F.max("mx").over(Window.partitionBy("answer_id"))
    level = F.coalesce(*[F.when(top >= t, F.lit(t)) for t in CITATION_LEVELS], F.lit(float("inf")))
    cited = best.withColumn("_level", level).where((F.col("mx") >= F.col("_level")) & (F.col("sim") > F.col("mx")))
    kept = cited.withColumn("_rn", F.row_number().over(per.orderBy(F.desc("sim"), "chunk"))).where(F.col("_rn") <= most)
    return kept.groupBy("answer_id", "chunk").agg(F.min("sentence").alias("sentence")).select("answer_id", "sentence", "chunk")


# Misshapen marks of citations, in the order in which they are mended.
CITATION_MARKS = [r"\(\s*ID\s*[: ]*\s*(\d+)\s*\)", r"\[\s*ID\s*[: ]*\s*(\d+)\s*\]", r"【\s*ID\s*[: ]*\s*(\d+)\s*】", r"(?i)ref\s*(\d+)"]
#: The decimal digits of all scripts, ten by ten.
DIGITS = "".join(chr(i) for i in range(0x10000) if chr(i).isdecimal())


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _number(digits: Column) -> Column:
    """The number that digits of any script write; null from 10^9 on."""
    written = F.when(digits.rlike("^[0-9]*$"), digits).otherwise(F.translate(digits, DIGITS, "0123456789" * (len(DIGITS) // 10)))
    return _with(F.ltrim(written, F.lit("0")), lambda x: F.when(x == "", F.lit(0)).when(x.rlike("^[0-9]{1,9}$"), x.cast("int")))


def repair_citations(answer: Column, n_chunks: int | Column) -> Column:
    """Misshapen marks of the chunks 0 to ``n_chunks`` - 1 become [ID:n], their digits as they were written; marks of
    other numbers stay as they are.

    Each mark is mended in the answer that the one before has left, which is computed once; answers without the mark aren't taken apart.
    """
    good = lambda m, d: F.when(F.coalesce(_number(d) < n_chunks, F.lit(False)), F.concat(F.lit("[ID:"), d, F.lit("]"))).otherwise(m)

    def mend(said: Column) -> Column:
        found, digits = F.regexp_extract_all(said, pattern, F.lit(0)), F.regexp_extract_all(said, pattern, F.lit(1))
        mended = F.concat(F.zip_with(found, digits, good), F.array(F.lit("")))
        whole = F.array_join(F.flatten(F.zip_with(F.split(said, pattern, -1), mended, lambda a, b: F.array(a, b))), "")
        return F.when(F.regexp_like(said, pattern), whole).otherwise(said)

    for mark in CITATION_MARKS:
        pattern = F.lit(f"(?U){mark}")
        answer = _with(answer, mend)
    return answer


def cited_chunks(repaired: Column, n_chunks: int | Column) -> Column:
    """The distinct chunk numbers that a repaired answer cites, in order."""
    numbers = F.transform(F.regexp_extract_all(repaired, F.lit(r"(?U)\[ID:(\d+)\]"), F.lit(1)), _number)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n < n_chunks)))
