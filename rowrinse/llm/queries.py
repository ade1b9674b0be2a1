"""The ``opN_`` queries: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowrinse.llm import (
    language, merkle, mixing, negatives, oracles, packing, pieces, quality, simhash, suffixes, tokens, toxicity, vectors, warc,
)
from rowrinse.llm.common import table


def op1_sentencepiece(spark, sf_dir):
    out = pieces.encode_and_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_pieces", "ids", F.md5("decoded").alias("decoded_md5"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op3_suffix_dedup(spark, sf_dir):
    return suffixes.repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_mix_sources(spark, sf_dir):
    out = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.floor(F.col("position") * 1_000_000).alias("position_ppm"), "n_reads", "places", "texts_md5")


def op5_warc(spark, sf_dir):
    out = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("payload", 256).alias("payload_sha256"))


def op6_quality_rules(spark, sf_dir):
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good")


def op7_token_files(spark, sf_dir):
    return tokens.encode_and_read(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs)).withColumnRenamed("id", "doc_id")


def op10_near_vectors(spark, sf_dir):
    out = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op11_best_fit(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("proof").withColumnRenamed("id", "doc_id")


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# name: (query, its SQL or None where SQL cannot express it; tests hold those against brute force)
QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_mix_sources": (op4_mix_sources, None),
    "op5_warc": (op5_warc, oracles.WARC),
    "op6_quality_rules": (op6_quality_rules, None),
    "op7_token_files": (op7_token_files, None),
    "op8_simhash": (op8_simhash, None),
    "op9_language_id": (op9_language_id, None),
    "op10_near_vectors": (op10_near_vectors, None),
    "op11_best_fit": (op11_best_fit, None),
    "op12_merkle": (op12_merkle, oracles.merkle()),
    "op13_hard_negatives": (op13_hard_negatives, oracles.HARD_NEGATIVES),
    "pipeline": (pipeline, None),
}
