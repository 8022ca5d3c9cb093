"""Relational shapes of the catalogue services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut


def page_with_total(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page and the total of all rows; the total is an aggregate of its own, so no task sees all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def after(df: DataFrame, keys: Sequence[str], values: Sequence, size: int) -> DataFrame:
    """T4: the next page behind a key, by a predicate rather than an offset."""
    later = F.lit(False)
    for k, v in zip(reversed(keys), reversed(values), strict=True):
        later = (F.col(k) > v) | ((F.col(k) == v) & later)
    return df.where(later).orderBy(*keys).limit(size)


def array_mean(c: Column) -> Column:
    """Sort key of a list: its mean."""
    return F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), F.size(c))


def status_counts(df: DataFrame, by: str, status: str, names: dict[object, str], wanted: DataFrame | None = None) -> DataFrame:
    """A3: counts pivoted by status; unknown statuses are dropped, wanted groups without rows are zero."""
    counts = df.groupBy(by).agg(*[F.count_if(F.col(status).cast("string") == str(k)).cast("int").alias(n) for k, n in names.items()])
    if wanted is not None:
        counts = wanted.select(by).distinct().join(counts, by, "left")
    return counts.na.fill(0, list(names.values()))


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each group in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= keep).drop("_rn")


def facet(df: DataFrame, column: str, many: bool = False) -> DataFrame:
    """A1: documents by value; repeats inside one document count once."""
    values = F.explode(F.array_distinct(F.col(column))) if many else F.col(column)
    return df.select(values.alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def repeated(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def numbered_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], number: str, chunks: int = 64) -> DataFrame:
    """Adds ``number``: 1, 2 ... by ``order`` (ascending) among the rows that share ``by``, without one task that sees all rows of a group.

    Rows are numbered inside ranges of their order, and by the ranges before. The ranges part 16 * ``chunks`` rows picked by a hash,
    the same ones whenever they are picked.
    """
    placed = df.withColumn("_at", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    picked = placed.groupBy(F.pmod(F.xxhash64("_at"), F.lit(16 * chunks)).alias("_h")).agg(F.min_by("_at", F.xxhash64(F.lit(1), "_at")).alias("_at"))
    bounds = picked.agg(F.array_sort(F.collect_list("_at"))).first()[0][15::16]  # a row for each range at most
    kinds = [f.dataType for f in placed.schema["_at"].dataType.fields]
    bound = lambda row: F.struct(*[F.lit(v).cast(k).alias(f"o{i}") for i, (v, k) in enumerate(zip(row, kinds, strict=True))])

    def below(first: int, last: int) -> Column:
        """The number of bounds below a row's place, of which ``first`` are and those from ``last`` on aren't."""
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(F.col("_at") > bound(bounds[middle]), below(middle + 1, last)).otherwise(below(first, middle))

    dealt = placed.withColumn("_c", below(0, len(bounds))).drop("_at")
    counts = dealt.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Null groups count too, and their number of rows is small: a row for each group and range.
    bases = counts.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_c").alias("_r"), before.alias("_b"))
    same = F.col("_c") == F.col("_r")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_c").orderBy(*order))
    return dealt.join(bases, same).withColumn(number, F.col("_b") + inside).drop("_c", "_r", "_b", *[f"_by{i}" for i in range(len(by))])


def rename_repeated(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """Repeated names get a number, the first stays as it is."""
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    n = F.col("_n") - 1
    return numbered_within(df, [name], order, "_n").withColumn(name, F.when(n > 0, F.concat(stem, F.lit("("), n.cast("string"), F.lit(")"), suffix)).otherwise(F.col(name))).drop("_n")


def ancestors(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, ancestor, distance) for every node and each of its ancestors; self-parents are roots.

    Distances double with each step, so a tree of any depth takes as many steps as its depth has bits. Nodes of a cycle have
    its other nodes as ancestors, at the least distance; of several parents each counts.
    """
    known = cut(nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("distance")).where("ancestor IS NOT NULL AND ancestor <> node").distinct())
    reach, far = 1, known
    while not far.isEmpty():
        on = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("distance").alias("_more"))
        longer = far.join(on, "ancestor").select("node", F.col("_next").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance")).where("node <> ancestor")
        known = cut(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        reach *= 2
        far = known.where(F.col("distance") == reach)
    return known


def subtree_sizes(nodes: DataFrame, size: str, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """The summed size of each node and all below it."""
    own = nodes.select(F.col(node).alias("id"), F.coalesce(F.col(size), F.lit(0)).alias("size"))
    up = ancestors(nodes, node, parent).join(own, F.col("node") == F.col("id")).select(F.col("ancestor").alias("id"), "size")
    return own.unionByName(up).groupBy("id").agg(F.sum("size").alias("size"))


def paths(nodes: DataFrame, name: str, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Paths of names from the root to each node."""
    up = ancestors(nodes, node, parent)
    named = nodes.select(F.col(node).alias("_a"), F.col(name).alias("_n"))
    above = up.join(named, F.col("ancestor") == F.col("_a")).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "_n"))), lambda x: x["_n"]).alias("above"))
    return nodes.join(above, F.col(node) == F.col("node"), "left").select(node, F.concat_ws("/", F.coalesce("above", F.array().cast("array<string>")), F.col(name)).alias("path"))


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a partner."""
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner."""
    return df.join(other, list(on), "left_anti")


def progress_of(tasks: DataFrame, by: str, progress: str) -> DataFrame:
    """A document's status from its tasks: failed if all have ended and one failed, done if all have, else running
    with the mean of their progress."""
    p = F.col(progress)
    grouped = tasks.groupBy(by).agg(F.avg(F.greatest(p, F.lit(0.0))).alias("mean"), F.bool_and(~((p >= 0) & (p < 1))).alias("ended"), F.count_if(p == -1).alias("bad"))
    return grouped.select(
        by,
        F.when(F.col("ended") & (F.col("bad") > 0), -1.0).when(F.col("ended"), 1.0).otherwise(F.col("mean")).alias("progress"),
        F.when(F.col("ended") & (F.col("bad") > 0), "4").when(F.col("ended"), "3").otherwise("1").alias("run"),
    )
