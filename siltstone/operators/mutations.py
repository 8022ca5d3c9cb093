"""Mutations as rewrites: each gives the table after the change."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: that of the greatest ``order``, ties and rows without one by a digest of the row."""
    by = ([F.col(order)] if order else []) + [F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in new.columns])]
    rest = [c for c in new.columns if c != key]
    latest = new.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*by)).alias("_r"))
    return latest.select(key, *[F.col(f"_r.`{c}`") for c in rest]).select(*[F.col(f"`{c}`") for c in new.columns])


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """K1: new rows replace those of the same key; of new rows of one key the last by ``order`` counts."""
    return existing.join(new.select(key), key, "left_anti").unionByName(last_of(new, key, order), allowMissingColumns=True)


def upsert_latest(existing: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """K8: of all rows of a key the one with the greatest version stays."""
    both = existing.unionByName(new)
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def update(df: DataFrame, where: Column, values: Mapping[str, object], skip_empty: bool = True) -> DataFrame:
    """Sets columns where the condition holds; empty values are skipped but for ``available_int``."""
    sets = {}
    for name, value in values.items():
        if skip_empty and not isinstance(value, Column) and not value and name != "available_int":
            continue
        new = value if isinstance(value, Column) else F.lit(value)
        sets[name] = F.when(where, new).otherwise(F.col(name))
    return df.withColumns(sets) if sets else df


def remove_first(array: Column, value) -> Column:
    """K2: an array without the first element equal to ``value``."""
    at = F.array_position(array, value)
    return F.when(at > 0, F.concat(F.slice(array, F.lit(1), (at - 1).cast("int")), F.slice(array, (at + 1).cast("int"), F.size(array)))).otherwise(array)


def add_element(array: Column, value) -> Column:
    return F.when(F.array_contains(array, value), array).otherwise(F.array_append(array, F.lit(value)))


def bump(value: Column, delta: float, least: float = 0.0, most: float = 100.0) -> Column:
    """K4: a counter after adding ``delta``, clamped; what can't be read counts as 0, and 0 or less removes the field."""
    x = F.greatest(F.least(F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0)) + delta, F.lit(most)), F.lit(least))
    return F.when(x > 0, x)


def delete(df: DataFrame, kb_id: str, kb: str = "kb_id", key: str = "chunk_id", ids: list | None = None, where: Column | None = None) -> DataFrame:
    """K5: the rows that stay. The knowledge base always limits what goes; an empty list of ids adds no condition, and
    without any condition nothing goes."""
    parts = ([F.col(key).isin(ids)] if ids else []) + ([where] if where is not None else [])
    if not parts:
        return df
    hit = F.col(kb) == kb_id
    for p in parts:
        hit = hit & p
    return df.where(~F.coalesce(hit, F.lit(False)))


def cascade(tables: Mapping[str, DataFrame], root: str, where: Column, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Deletes rows of ``root`` and, along links (parent, key, child, foreign key), all that hang from them."""
    hit = F.coalesce(where, F.lit(False))
    out, gone = dict(tables), {root: [tables[root].where(hit)]}
    out[root] = tables[root].where(~hit)
    for parent, key, child, foreign in links:
        for rows in gone.get(parent, []):
            keys = rows.select(F.col(key).alias(foreign)).distinct()
            gone.setdefault(child, []).append(tables[child].join(keys, foreign, "left_semi"))
            out[child] = out[child].join(keys, foreign, "left_anti").select(*tables[child].columns)
    return out


def _without(m: Column, key: str, value: str | None) -> Column:
    """A map without a key, or without one value of it; keys without values go."""
    if value is None:
        return F.map_filter(m, lambda k, v: k != key)
    m = F.transform_values(m, lambda k, v: F.when(k == key, F.array_remove(v, value)).otherwise(v))
    return F.map_filter(m, lambda k, v: (k != key) | (F.size(v) > 0))


def _with(m: Column, key: str, value: str, match: str | None) -> Column:
    """A map with a key set, or with one value of it replaced."""
    if match is None:
        return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(F.lit(key), F.array(F.lit(value))))
    return F.transform_values(m, lambda k, v: F.when(k == key, F.array_distinct(F.transform(v, lambda x: F.when(x == match, F.lit(value)).otherwise(x)))).otherwise(v))


def apply_rules(meta: DataFrame, updates: list[dict], deletes: list[dict]) -> DataFrame:
    """A program over metadata rows (doc_id, meta: map of lists): deletes take a key or one value of it, updates set
    a key, or replace one value of it; ``changed`` tells whether the row did."""
    m = F.col("meta")
    for d in deletes:
        m = _without(m, d["key"], d.get("value"))
    for u in updates:
        m = _with(m, u["key"], u["value"], u.get("match"))
    entries = lambda x: F.array_sort(F.map_entries(x))
    return meta.withColumn("_new", m).withColumn("changed", entries(F.col("_new")) != entries(F.col("meta"))).withColumn("meta", F.col("_new")).drop("_new")


def rename_tag(tags: Column, old: str, new: str | None) -> Column:
    """Arrays in which one tag is renamed, or removed where ``new`` is null."""
    cut = F.array_remove(tags, old)
    return F.when(F.array_contains(tags, old), cut if new is None else add_element(cut, new)).otherwise(tags)


def keep_latest(df: DataFrame, by: str, order: str, most: int = 1000) -> DataFrame:
    """The latest rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def counters(chunks: DataFrame, by: str, tokens: Column) -> DataFrame:
    """Token and chunk totals, derived from the rows rather than kept by deltas."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunk_num"), F.coalesce(F.sum(tokens), F.lit(0)).alias("token_num"))
