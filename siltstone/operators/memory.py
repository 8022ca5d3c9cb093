"""Conversational memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X


def message_rows(raw: DataFrame, memory: str, message: str) -> DataFrame:
    """K6: messages with their key and a status of 0 or 1."""
    return raw.withColumn("id", F.concat_ws("_", F.col(memory).cast("string"), F.col(message).cast("string"))).withColumn("status_int", F.when(F.col("status"), 1).otherwise(0))


def nested(messages: DataFrame, kind: str = "message_type", raw: str = "raw") -> DataFrame:
    """Raw messages with the messages extracted from them as a sorted array."""
    children = messages.where(F.col(kind) != raw).groupBy(F.col("source_id").alias("message_id")).agg(F.array_sort(F.collect_list(F.struct("message_id", kind))).alias("extracted"))
    return messages.where(F.col(kind) == raw).select("message_id").join(children, "message_id", "left")


def sizes(messages: DataFrame, by: str, content: str, vector: str | None = None) -> DataFrame:
    """Bytes held by each memory: UTF-8 bytes of the content and four for each vector component."""
    size = F.octet_length(F.coalesce(F.col(content), F.lit("")))
    if vector:
        size = size + 4 * F.coalesce(F.size(vector), F.lit(0))
    return messages.groupBy(by).agg(F.sum(size).alias("bytes"))


def evictions(messages: DataFrame, need: DataFrame, by: str, size: Column, forget: str, created: str, key: str) -> DataFrame:
    """The messages that go: forgotten ones first, then the oldest, until at least ``need`` (by, need) bytes are freed."""
    order = [F.col(forget).isNull(), F.col(forget), F.col(created), F.col(key)]
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("_s", size).withColumn("_freed", F.coalesce(F.sum("_s").over(before), F.lit(0))).join(need, by).where(F.col("_freed") < F.col("need")).drop("_s", "_freed", "need")


def insert_with_eviction(existing: DataFrame, new: DataFrame, by: str, size: Column, cap: int, forget: str, created: str, key: str) -> DataFrame:
    """The store after an insert that may evict; memories whose new messages alone exceed the cap keep what they have."""
    total = lambda df, n: df.groupBy(by).agg(F.sum(size).alias(n))
    both = total(new, "_n").join(total(existing, "_o"), by, "left").na.fill(0, ["_o"])
    fits = both.where(F.col("_n") <= cap)
    need = fits.select(by, (F.col("_n") + F.col("_o") - cap).alias("need")).where("need > 0")
    gone = evictions(existing, need, by, size, forget, created, key).select(key)
    return existing.join(gone, key, "left_anti").unionByName(new.join(fits.select(by), by, "left_semi").select(*existing.columns))


def history_fit(messages: DataFrame, by: str, turn: str, role: str, content: str, budget: int) -> DataFrame:
    """The whole history if it fits the budget of tokens, else the system messages and the last one, cut until they fit.

    If the system messages are more than four fifths of what is left they give way to the last message, in their order; otherwise it gives
    way to them. Of several messages of the last turn one is the last, by role and content. Null contents count as empty.
    """
    n, whole = F.col("_k"), Window.partitionBy(by)
    said = F.coalesce(F.col(content), F.lit(""))
    marked = messages.withColumn("_k", X.token_count(said)).withColumn("_all", F.sum(n).over(whole))
    latest = F.row_number().over(whole.orderBy(F.desc(turn), F.desc_nulls_last(role), F.desc(said))) == 1
    kept = marked.withColumn("_last", latest).withColumn("_sys", F.coalesce(F.col(role) == "system", F.lit(False))).where((F.col("_all") <= budget) | F.col("_last") | F.col("_sys"))
    system, last = F.sum(F.when(F.col("_sys"), n).otherwise(0)).over(whole), F.sum(F.when(F.col("_last") & ~F.col("_sys"), n).otherwise(0)).over(whole)
    counted = kept.withColumns({"_s": system, "_l": last, "_own": F.max(F.col("_last") & F.col("_sys")).over(whole)})
    first = F.col("_own") | (F.col("_s") > 0.8 * (F.col("_s") + F.col("_l")))
    before = F.coalesce(F.sum(F.when(F.col("_sys"), n).otherwise(0)).over(whole.orderBy(turn, said).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.when(F.col("_sys"), F.when(first, F.lit(budget) - F.col("_l") - F.col("_before")).otherwise(n)).otherwise(F.when(first & (F.col("_s") > 0), n).otherwise(F.lit(budget) - F.col("_s")))
    over = (F.col("_all") > budget) & (F.col("_s") + F.col("_l") > budget)
    cut = F.when(over, X.first_tokens(said, F.greatest(room, F.lit(0)).cast("int"))).otherwise(F.col(content))
    return counted.withColumn("_before", before).withColumn(content, cut).select(*messages.columns)


def within_budget(rows: DataFrame, by: str, order: list[Column], tokens: Column, budget: float) -> DataFrame:
    """Rows in order while their running tokens stay inside the budget."""
    run = F.sum(tokens).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")


def prompt_block(number: Column, title: Column, content: Column) -> Column:
    """A chunk rendered for a prompt."""
    return F.concat(F.lit("\nID: "), number.cast("string"), F.lit("\n├── Title: "), title, F.lit("\n└── Content:\n"), content)


def accumulate(frames: DataFrame, by: str, seq: str, delta: str, final: str) -> DataFrame:
    """The answer of each stream: the last final frame if there is one, else the deltas in order."""
    deltas = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, delta))), lambda x: x[delta]), "")
    last = F.max_by(F.col(delta), F.when(F.col(final), F.col(seq)))
    return frames.groupBy(by).agg(F.coalesce(F.when(F.bool_or(final), last), deltas).alias("answer"))
