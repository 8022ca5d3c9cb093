"""The pipeline's stages, each on what the one before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import mixing


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
        out.append(docs)
    return out


def test_columns_and_names(spark, data, stages):
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mix", "packing"]


def test_stages_keep_clean_documents_and_narrow(spark, data, stages):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = [{r[0] for r in s.select("doc_id").distinct().collect()} for s in (docs, *stages)]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3]
    clean = {r[0] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").select("doc_id").collect()} & ids[0]
    assert len(clean & ids[1]) >= 0.97 * len(clean)
    assert stages[1].where(F.length("text") != F.col("n_chars")).count() == 0


def test_mixture_and_packing_agree(stages):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[2]).where("taken > 0").collect()}
    words = stages[3].select("doc_id", F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r["doc_id"]: r["n"] for r in words.collect()} == taken
    assert {r[0] for r in stages[4].select("doc_id").collect()} == set(taken)
    assert stages[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_extra_columns_with_clashing_names(spark, data, stages):
    docs = stages[0].select("*", *[F.lit("mine").alias(c) for c in ("score", "predicted", "_row", "_at", "_t", "_k1", "n_lines", "removed", "node", "gone", "size")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.where("removed <> 'mine' OR score <> 'mine'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0


def test_empty_input(spark, data):
    nothing = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, data).count() == 0


def test_no_stage_is_made_twice(spark, data, stages, monkeypatch):
    seen = [spark.sparkContext.accumulator(0) for _ in corpus_pipeline.STAGES]

    def counting(stage, seen):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        def wrapped(*args):
            df = stage(*args)
            return df.mapInArrow(run, df.schema)

        return wrapped

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, counting(stage, s)) for (name, stage), s in zip(corpus_pipeline.STAGES, seen, strict=True)])
    pieces = corpus_pipeline.run(spark, data).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert [s.value for s in seen] == [s.count() for s in stages]
    assert {r["doc_id"]: r["n"] for r in pieces} == {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
