"""Document store: one table as a merge log behind the store's contract.

A change writes the rows it touches and nothing else: new rows of a key, or the mark that a key is gone, as one small set
of Parquet files, and then the next version of the manifest (``commits``), which names for each knowledge base the files that
hold it, oldest first. Readers merge: of all rows of a key the one of the latest files counts. The first files of a knowledge
base are its large ones; keys of the later ones are known to be few and are broadcast against them where they are. When
the later ones grow beyond a share of the first, they are folded into new first files, in the same way as any change.

Writers don't wait for each other. An insert needs nothing from others, so it is committed behind them; an update or a
delete by a condition has read rows, so it is made again if one of its knowledge bases has changed meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text
from siltstone.operators import mutations, predicates, relational
from siltstone.operators.commits import CommitLog, Conflict

#: Keys of later files up to this many are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000


class DocumentStore:
    """``fold_files`` and ``fold_share`` bound the files behind the first ones, and their rows as a share of the first ones'."""

    def __init__(self, spark: SparkSession, path: str, partition: str = "kb_id", key: str = "chunk_id", fold_files: int = 16, fold_share: float = 0.5):
        self.spark, self.path, self.partition, self.key = spark, path.rstrip("/"), partition, key
        self.fold_files, self.fold_share = fold_files, fold_share
        self.log = CommitLog(spark, self.path)

    def exists(self) -> bool:
        return self.log.version() >= 0

    def create(self, schema: str) -> None:
        """Creates the table if it is absent."""
        made = self.spark.createDataFrame([], schema).schema.jsonValue()
        self.log.change(lambda m: None if m else {"schema": made, "kbs": {}, "order": []})

    def drop(self, kb_id: str | None = None) -> None:
        """Drops the table; scoped to one knowledge base it does nothing, since others share it."""
        if kb_id is None:
            self.log.delete("")

    def _manifest(self) -> dict:
        found = self.log.read()
        if found is None:
            raise ValueError(f"no table at {self.path}")
        return found

    def _write(self, rows: DataFrame) -> tuple[str, dict[str, int], T.StructType]:
        """New files by knowledge base: their folder, the rows of each, and the columns."""
        folder = f"v{uuid.uuid4().hex}"
        rows.repartition(self.partition).write.partitionBy(self.partition).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        counts = {r[0]: r[1] for r in written.groupBy(self.partition).count().collect()}  # a row for each knowledge base
        return folder, counts, T.StructType([f for f in rows.schema if f.name != "_gone"])

    def _append(self, m: dict, folder: str, counts: Mapping[str, int], schema: T.StructType, first: bool = False) -> dict:
        """The manifest with new files behind those of their knowledge bases, or in their place."""
        known = T.StructType.fromJson(m["schema"])
        columns = {f.name: f for f in [*known, *[f for f in schema if f.name not in known.names]]}
        kbs = m["kbs"] | {kb: ([] if first else m["kbs"].get(kb, [])) + [[folder, n]] for kb, n in counts.items()}
        used = {f for files in kbs.values() for f, _ in files}
        return {"schema": T.StructType(list(columns.values())).jsonValue(), "kbs": kbs, "order": [f for f in [*m["order"], folder] if f in used]}

    def _read(self, m: dict, files: Mapping[str, list[str]], gone: bool) -> DataFrame | None:
        """The rows of files, each of these knowledge bases only, with their place in the order of changes."""
        schema = T.StructType([*T.StructType.fromJson(m["schema"]), T.StructField("_gone", T.BooleanType())])
        place, out = {f: i for i, f in enumerate(m["order"])}, None
        for folder, kbs in files.items():
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").where(F.col(self.partition).isin(kbs)).withColumn("_at", F.lit(place[folder]))
            out = part if out is None else out.unionByName(part)
        return out if out is None or gone else out.drop("_gone", "_at")

    def _rows(self, m: dict, kb_ids: Sequence[str] | None) -> DataFrame:
        names = T.StructType.fromJson(m["schema"]).names
        first, later, n_later = {}, {}, 0
        for kb, files in m["kbs"].items():
            if kb_ids is None or kb in set(kb_ids):
                first.setdefault(files[0][0], []).append(kb)
                for folder, n in files[1:]:
                    later.setdefault(folder, []).append(kb)
                    n_later += n
        base = self._read(m, first, False)
        if base is None:
            return self.spark.createDataFrame([], T.StructType.fromJson(m["schema"]))
        changed = self._read(m, later, True)
        if changed is None:
            return base.select(names)
        by = [self.partition, self.key]
        latest = changed.groupBy(*by).agg(F.max_by(F.struct(*[c for c in names if c not in by], "_gone"), "_at").alias("_r"))
        keys = changed.select(*by).distinct()
        kept = base.join(F.broadcast(keys) if n_later <= BROADCAST_KEYS else keys, by, "left_anti")
        return kept.select(names).unionByName(latest.where("NOT _r._gone").select(*by, *[f"_r.{c}" for c in names if c not in by]).select(names))

    def rows(self, kb_ids: Sequence[str] | None = None) -> DataFrame:
        """The rows of the last version, of all knowledge bases or of these; an empty table has its schema too."""
        return self._rows(self._manifest(), kb_ids)

    def _change(self, kbs: Callable[[dict], Sequence[str]], made: Callable[[dict, Sequence[str]], DataFrame], tries: int = 20) -> None:
        """Commits rows made from the last version; made again if the files of their knowledge bases have changed meanwhile."""
        for _ in range(tries):
            m = self._manifest()
            scope = kbs(m)
            if not scope:
                return
            folder, counts, schema = self._write(made(m, scope))
            stale = []

            def edit(now: dict, m=m, scope=scope, folder=folder, counts=counts, schema=schema, stale=stale) -> dict | None:
                stale[:] = [kb for kb in scope if now["kbs"].get(kb) != m["kbs"].get(kb)]
                return None if stale else self._append(now, folder, counts, schema)

            if counts:
                self.log.change(edit)
            if not stale:
                self._fold(list(counts))
                return
            self.log.delete(folder)
        raise Conflict(f"the knowledge bases {scope} kept changing")

    def _fold(self, kbs: Sequence[str]) -> None:
        """Folds the later files of these knowledge bases into new first ones where they are beyond their bounds.

        Who loses the race leaves it to a later change.
        """
        m = self._manifest()
        due = [kb for kb in kbs if len(files := m["kbs"].get(kb, [])) > 1 and (len(files) > self.fold_files or sum(n for _, n in files[1:]) > self.fold_share * files[0][1] + 1000)]
        if due:
            self.compact(due, m)

    def compact(self, kbs: Sequence[str], m: dict | None = None) -> None:
        """Writes these knowledge bases anew as one set of files."""
        m = m or self._manifest()
        folder, counts, schema = self._write(self._rows(m, kbs).withColumn("_gone", F.lit(False)))
        for kb in set(kbs) - set(counts):
            counts[kb] = 0

        def edit(now: dict) -> dict | None:
            same = {kb: n for kb, n in counts.items() if now["kbs"].get(kb) == m["kbs"].get(kb)}
            return self._append(now, folder, same, schema, first=True) if same else None

        self.log.change(edit)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions but the last ``keep``, and folders that none of these names. Not while a writer is at work."""
        last = self.log.version()
        self.log.forget(last - keep + 1)
        used = {f for v in range(max(0, last - keep + 1), last + 1) for f in self.log.read(v)["order"]}
        for name in self.log.folders():
            if name not in used:
                self.log.delete(name)

    def search(self, select: Sequence[str], condition: Mapping, kb_ids: Sequence[str], order: Sequence[Column] = (), offset: int = 0, limit: int = 0) -> DataFrame:
        """Filters, sorts and cuts; the scope is part of every search."""
        df = self.rows(kb_ids)
        df = df.where(predicates.term_filter(df, condition))
        df = df.orderBy(*order, self.key) if order else df
        df = df.offset(offset) if offset else df
        return (df.limit(limit) if limit else df).select(*select)

    def get(self, key, kb_ids: Sequence[str]) -> DataFrame:
        return self.rows(kb_ids).where(F.col(self.key) == key)

    def insert(self, new: DataFrame, kb_id: str, order: str | None = None) -> None:
        """Upserts by key; the knowledge base is forced. Of new rows of one key the one with the greatest ``order`` counts."""
        rows = mutations.last_of(new.withColumn(self.partition, F.lit(kb_id)), self.key, order)
        folder, counts, schema = self._write(rows.withColumn("_gone", F.lit(False)))
        if counts:
            self.log.change(lambda m: self._append(m, folder, counts, schema))
            self._fold(list(counts))

    def update(self, where: Column, values: Mapping[str, object]) -> None:
        """Updates the rows of a condition; only these are written."""
        if self.partition in values:
            raise ValueError("rows don't move between knowledge bases")
        self._change(lambda m: list(m["kbs"]), lambda m, kbs: mutations.update(self._rows(m, kbs).where(where), F.lit(True), values).withColumn("_gone", F.lit(False)))

    def delete(self, kb_id: str, ids: list | None = None, where: Column | None = None) -> None:
        """Marks what goes of one knowledge base: only the keys are written."""
        if not ids and where is None:
            return

        def made(m: dict, kbs: Sequence[str]) -> DataFrame:
            rows = self._rows(m, kbs)
            gone = rows.where(F.col(self.key).isin(ids)) if ids else rows
            gone = gone.where(where) if where is not None else gone
            return gone.select(self.partition, self.key).withColumn("_gone", F.lit(True))

        self._change(lambda m: [kb_id] if kb_id in m["kbs"] else [], made)

    @staticmethod
    def total(result: DataFrame) -> int:
        return result.count()

    @staticmethod
    def aggregation(result: DataFrame, field: str) -> DataFrame:
        return relational.facet(result, field, "array" in dict(result.dtypes)[field])

    @staticmethod
    def highlight(result: DataFrame, field: str, keywords: Sequence[str]) -> DataFrame:
        return result.withColumn("highlight", text.highlight(field, F.array(*map(F.lit, keywords))))

    def sql(self, statement: str, kb_ids: Sequence[str], name: str = "chunks") -> DataFrame:
        """A statement over a view that holds the scope's rows only."""
        self.rows(kb_ids).createOrReplaceTempView(name)
        return self.spark.sql(statement)


def migrate(df: DataFrame, add: Mapping[str, str] | None = None, retype: Mapping[str, str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Q3: columns added (null) if absent, retyped (what doesn't fit becomes null) and renamed."""
    for name, kind in (add or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    for name, kind in (retype or {}).items():
        df = df.withColumn(name, F.col(name).try_cast(kind))
    return df.withColumnsRenamed(dict(rename or {}))


def json_schema(fields: list[dict]) -> dict:
    """A JSON schema of metadata fields (key, description, enum)."""
    properties = {}
    for f in fields:
        one = {"type": "string", "description": f.get("description", "")}
        if f.get("enum"):
            one["enum"] = list(dict.fromkeys(map(str, f["enum"])))
            properties[f["key"]] = {"type": "array", "items": {"type": "string", "enum": one.pop("enum")}, "description": one["description"]}
        else:
            properties[f["key"]] = one
    return {"type": "object", "properties": properties, "additionalProperties": False}


def schema_rows(fields: DataFrame) -> DataFrame:
    """The properties of a JSON schema as rows (key, property): ``fields`` has key, description and value, a row for each value that a
    field may have (null: any)."""
    by = fields.groupBy("key").agg(F.max(F.coalesce("description", F.lit(""))).alias("description"), F.array_sort(F.collect_set(F.col("value").cast("string"))).alias("enum"))
    many = F.struct(F.lit("array").alias("type"), F.struct(F.lit("string").alias("type"), F.col("enum")).alias("items"), F.col("description"))
    return by.select("key", F.when(F.size("enum") > 0, F.to_json(many)).otherwise(F.to_json(F.struct(F.lit("string").alias("type"), "description"))).alias("property"))
