"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat, classifier, fim, linededup, minhash, mixing, oracles, packing, pieces, rules, secrets, substring, topk, whitening
from siltstone.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id, said = chat.PROBE
    probe = spark.createDataFrame([(conv_id, 0, "user", said), (conv_id, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.chat_digest(chat.format_chats(chat.chat_records(rows)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), least=1, guard=25)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return rules.quality_rules(docs, rules.ngram_weights(docs, trusted))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled().alias("v"))
    return topk.exact_top_k(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = classifier.learn(docs, table(spark, sf_dir, "labels"))
    return classifier.classify(docs, machine).select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    counted = encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)})
    return pieces.decode(counted, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), prefix="")
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fim.restored(F.col("output"), F.col("form")), 256)}
    return cut.withColumns(digests).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whitening.integers().alias("x"))
    model = whitening.fit(vectors, most=32)
    if model is None:
        return vectors.limit(0).selectExpr("vec_id", "1 component", "1L n", "1L deviation", "1D whitened", "1D explained", "1D identity_error")
    return whitening.components(whitening.whiten(vectors, model), model, whitening.identity_error(vectors, model))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_secret_scan,
        op3_substring_dedup,
        op4_quality_rules,
        op5_source_mix,
        op6_sequence_packing,
        op7_line_dedup,
        op8_exact_top_k,
        op9_minhash_dedup,
        op10_quality_classifier,
        op11_sentencepiece,
        op12_fill_in_middle,
        op13_embedding_whitening,
    )
}

ORACLES: dict[str, str] = oracles.ORACLES
