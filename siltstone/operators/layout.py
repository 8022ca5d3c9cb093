"""Context of tables and images: by order in the text, and by geometry on the page.

Both work on blocks, a row for each piece of a document: doc_id, seq, kind (text, table or image), text. Sentences and tokens of text
blocks are laid on one line of coordinates for each document, so what lies within a budget of a table is a range of that line,
whatever the number of blocks it takes: a frame of a window by document. No document is one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X

# Ends of sentences, in running text and in laid out blocks.
SENTENCE_END = r"([。!?？；！\n]|\. )"
LAYOUT_END = r"([.。！？!?；;：:\n])"
_CUT = "\x01"


def sentences(c: Column, end: str = SENTENCE_END) -> Column:
    """A text's sentences with their ends; joined, they are the text."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), end, "$1" + _CUT)
    return F.filter(F.split(marked, _CUT), lambda s: s != "")


def surrounded(blocks: DataFrame, budget: int, doc_id: str = "doc_id") -> DataFrame:
    """Tables and images with ``above`` and ``below``: the nearest sentences of text blocks on each side until ``budget`` tokens are full.

    The sentence that fills it is whole. Null texts are empty; documents without text blocks give empty contexts. Texts are cut and
    their tokens counted once, where they are read; only sentences within ``budget`` of an end of their block are shuffled, once, and the
    blocks before and behind a table are a window's frame.
    """
    is_media, is_text, b = F.col("kind").isin("table", "image"), F.col("kind") == "text", F.lit(budget)
    # A table has no sentences. The marks at which texts are cut count as tokens of a block that are in no sentence.
    cut = F.when(is_text, F.transform(sentences(F.col("text")), lambda x: F.struct(x.alias("s"), X.token_count(x).cast("long").alias("k"))))
    marks = F.when(is_text, F.length("text") - F.length(F.replace("text", F.lit(_CUT), F.lit(""))))
    rows = blocks.where(is_media | is_text).select(F.col(doc_id).alias("_d"), F.col("seq").alias("_m"), F.when(is_media, F.struct(*[F.col(f"`{x}`") for x in blocks.columns])).alias("_row"), cut.alias("_cut"), F.coalesce(marks, F.lit(0)).alias("_marks"))
    rows = rows.withColumn("_k", F.coalesce(F.aggregate("_cut", F.lit(0).cast("long"), lambda n, x: n + x["k"]), F.lit(0).cast("long")))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<o:bigint,r:bigint,s:string>>").alias("a"))

    def keep(held: Column, x: Column) -> Column:
        """``o`` tokens of the block are before a sentence, ``r`` behind it."""
        o, r = held["n"], F.col("_k") - held["n"] - x["k"]
        kept = F.when((o < b) | (r < b), F.concat(held["a"], F.array(F.struct(o.alias("o"), r.alias("r"), x["s"].alias("s"))))).otherwise(held["a"])
        return F.struct((o + x["k"]).alias("n"), kept.alias("a"))

    rows = rows.withColumn("_s", F.aggregate("_cut", none, keep, lambda held: held["a"])).drop("_cut")
    doc = Window.partitionBy("_d")
    before = doc.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_p", F.coalesce(F.sum(F.col("_k") + F.col("_marks")).over(before), F.lit(0))).withColumn("_end", F.col("_p") + F.col("_k"))
    said = F.collect_list(F.when(F.size("_s") > 0, F.struct(F.col("_m").alias("m"), F.col("_p").alias("p"), F.col("_end").alias("e"), F.col("_s").alias("s"))))
    near = rows.withColumn("_above", said.over(doc.orderBy("_end").rangeBetween(1 - budget, 0))).withColumn("_below", said.over(doc.orderBy("_p").rangeBetween(0, budget - 1)))
    near = near.where(F.col("_row").isNotNull())

    def joined(side: str, there: Callable[[Column], Column], far: Callable[[Column, Column], Column]) -> Column:
        blocks = F.sort_array(F.filter(side, there))
        found = F.flatten(F.transform(blocks, lambda x: F.transform(F.filter(x["s"], lambda y: far(x, y) < b), lambda y: y["s"])))
        return F.when(F.col("_d").isNotNull(), F.array_join(found, "")).otherwise(F.lit(""))

    above = joined("_above", lambda x: x["m"] < F.col("_m"), lambda x, y: F.col("_p") - x["e"] + y["r"])
    below = joined("_below", lambda x: x["m"] > F.col("_m"), lambda x, y: x["p"] + y["o"] - F.col("_p"))
    return near.select("_row.*", above.alias("above"), below.alias("below"))


def nearest_text(blocks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """C17: doc_id, seq of each table and image with a text block beside it on the page, and that block's ``beside``.

    ``blocks`` has ``positions``, an array of (page, left, right, top, bottom). Of the text blocks whose extent on a common page overlaps
    that of the table the one whose middle is nearest counts, ties by order. A table that nothing overlaps, and which is the first
    or the last block of its first page, takes the first or the last text block there.
    """
    where = blocks.select(doc_id, "seq", "kind", F.explode("positions").alias("p")).where("p.page IS NOT NULL AND p.top IS NOT NULL")
    low, high = F.least("p.top", F.coalesce("p.bottom", "p.top")), F.greatest("p.top", F.coalesce("p.bottom", "p.top"))
    regions = where.groupBy(doc_id, "seq", "kind", F.col("p.page").alias("page")).agg(F.min(low).alias("top"), F.max(high).alias("bottom"))
    media = regions.where("kind IN ('table', 'image')").select(F.col(doc_id).alias("_d"), F.col("page").alias("_page"), F.col("seq").alias("_m"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    texts = regions.where("kind = 'text'")
    met = media.join(texts, (F.col("_d") == F.col(doc_id)) & (F.col("_page") == F.col("page"))).where("_b >= top AND _t <= bottom")
    far = F.abs((F.col("_t") + F.col("_b")) / 2 - (F.col("top") + F.col("bottom")) / 2)
    overlapping = met.groupBy("_d", "_m").agg(F.min_by("seq", F.struct(far, "seq")).alias("_over"))
    # The order on a page is that of blocks' first positions.
    first = blocks.select(doc_id, "seq", "kind", F.get("positions", F.lit(0)).alias("p")).where("p.page IS NOT NULL AND p.top IS NOT NULL")
    order = F.struct(F.col("p.top").cast("int"), F.coalesce(F.col("p.left"), F.lit(0)).cast("int"), "seq")
    page = Window.partitionBy(doc_id, "p.page")
    is_text = F.when(F.col("kind") == "text", order)
    on_page = first.select(doc_id, "seq", "kind", (order == F.min(order).over(page)).alias("is_first"), (order == F.max(order).over(page)).alias("is_last"), F.min(is_text).over(page)["seq"].alias("first_text"), F.max(is_text).over(page)["seq"].alias("last_text"))
    edge = F.when(F.col("is_first"), F.col("first_text")).when(F.col("is_last"), F.col("last_text"))
    sides = on_page.where("kind IN ('table', 'image')").select(F.col(doc_id).alias("_d"), F.col("seq").alias("_m"), edge.alias("_edge"))
    both = sides.join(overlapping, ["_d", "_m"], "full").withColumn("beside", F.coalesce("_over", "_edge")).where("beside IS NOT NULL")
    return both.select(F.col("_d").alias(doc_id), F.col("_m").alias("seq"), "beside")


def with_page_context(blocks: DataFrame, table_budget: int, image_budget: int, doc_id: str = "doc_id") -> DataFrame:
    """C17: the blocks, with the sentences around the middle of the text beside each table and image, up to a budget of tokens on each side.

    The middle is the end of the sentence that is nearest to half of the text's tokens. The sentence that fills a budget is whole; sentences
    without tokens are left out. Blocks without such a text, or without a budget, stay as they are.
    """
    beside = nearest_text(blocks, doc_id)
    budget = F.when(F.col("kind") == "table", F.lit(table_budget)).otherwise(F.lit(image_budget))
    media = blocks.where("kind IN ('table', 'image')").select(doc_id, "seq", budget.alias("_budget")).where("_budget > 0").join(beside, [doc_id, "seq"])
    texts = blocks.where("kind = 'text'").select(doc_id, F.col("seq").alias("beside"), F.posexplode(sentences(F.col("text"), LAYOUT_END)).alias("_i", "_s"))
    texts = texts.withColumn("_k", X.token_count("_s").cast("long"))
    by = Window.partitionBy(doc_id, "beside")
    texts = texts.withColumns({"_end": F.sum("_k").over(by.orderBy("_i")), "_all": F.sum("_k").over(by), "_len": F.count(F.lit(1)).over(by)})
    gap = F.struct(F.abs(F.col("_end") - F.col("_all") / 2), F.col("_i"))
    middle = F.when(F.col("_all") > 0, F.min(gap).over(by)["_i"]).otherwise(F.floor(F.col("_len") / 2).cast("int"))
    texts = texts.withColumn("_mid", middle).withColumn("_at", F.max(F.when(F.col("_i") <= F.col("_mid"), F.col("_end"))).over(by))
    met = media.join(texts, [doc_id, "beside"]).where("_k > 0")
    before = (F.col("_i") <= F.col("_mid")) & (F.col("_at") - F.col("_end") < F.col("_budget"))
    behind = (F.col("_i") > F.col("_mid")) & (F.col("_end") - F.col("_k") - F.col("_at") < F.col("_budget"))
    taken = lambda w: F.transform(F.array_sort(F.collect_list(F.when(w, F.struct("_i", "_s")))), lambda x: x["_s"])
    context = met.groupBy(doc_id, "seq").agg(taken(before).alias("_before"), taken(behind).alias("_behind"))
    own = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("text"))
    joined = F.when(F.size("_before") + F.size("_behind") > 0, F.array_join(F.concat("_before", own, "_behind"), "\n")).otherwise(F.col("text"))
    return blocks.join(context, [doc_id, "seq"], "left").withColumn("text", F.coalesce(joined, F.col("text"))).drop("_before", "_behind").select(*blocks.columns)
