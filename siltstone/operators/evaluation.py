"""Retrieval evaluation: hits, ranks, summaries and grids, for all configurations in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_hits(ranked: DataFrame, by: list[str], rank: str = "rank", hit: str = "hit") -> DataFrame:
    """Rank of each question's first hit, null if it has none."""
    return ranked.groupBy(*by).agg(F.min(F.when(F.col(hit), F.col(rank))).alias("first_hit"))


def summary(first: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Questions, hit rate, mean reciprocal rank and recall at each k; misses count in the denominator."""
    r = F.col("first_hit")
    return first.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(r.isNotNull().cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"),
        *[F.round(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks],
    )


def grid(spark, vector_weights: list[float], thresholds: list[float], tops: list[int]) -> DataFrame:
    """Configurations as rows, with a number."""
    rows = [(i, v, t, n) for i, (v, t, n) in enumerate((v, t, n) for v in vector_weights for t in thresholds for n in tops)]
    return spark.createDataFrame(rows, "config int, vt double, threshold double, top_n int")


def evaluate_grid(scored: DataFrame, configs: DataFrame) -> DataFrame:
    """Each configuration's summary over cached hits (query_id, chunk_id, cosine, tokens, relevant).

    Configurations are few and broadcast; hits are read once for all of them.
    """
    # Configurations are a stated grid, some hundred at most.
    sims = scored.join(F.broadcast(configs)).withColumn("sim", F.round(F.col("vt") * F.col("cosine") + (1 - F.col("vt")) * F.col("tokens"), 6))
    w = Window.partitionBy("config", "query_id").orderBy(F.desc("sim"), "chunk_id")
    ranked = sims.withColumn("rank", F.row_number().over(w)).withColumn("hit", F.col("relevant") & (F.col("sim") >= F.col("threshold")) & (F.col("rank") <= F.col("top_n")))
    return summary(first_hits(ranked, ["config", "query_id"]), ["config"])
