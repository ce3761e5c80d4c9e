"""The registered queries of the training-data operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, licenses, media, merkle, negatives, packing, pieces, quality, rules, simhash, urls, vectors
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.preference_pairs(table(spark, sf_dir, "conversations")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(urls.captures_from_pages(pages), urls.intervals(urls.changes_from_pages(pages)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_media(table(spark, sf_dir, "documents"))
    read = media.read_media(stored, digests=True)
    feature = F.format_string("mpeg1-layer3 frames=%d samples=%d seconds=%.6f bitrates=%s seek=%d lost=%d bad=%d vbr=%s", "frames", "samples", "duration_s", "bitrates", F.size("seek_offsets"), "skipped_bytes", "bad_checksums", F.col("vbr_agrees").cast("string"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "duration_s", "seek_offsets")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.piece_table(spark, tokenizer_path("piece_bpe_32k.model"))
    found, _ = pieces.encode(table(spark, sf_dir, "documents"), vocabulary)
    decodes = F.xxhash64(pieces.decoder(vocabulary)(F.col("ids"))) == F.col("source")
    return found.select("doc_id", "n_chunks", "n_pieces", "score", "ids", "ids_crc32", decodes.alias("decodes"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.from_embeddings(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_chat_formatting, op4_language_id, op5_near_vectors, op6_url_filter, op7_quality, op8_simhash, op9_mpeg_audio, op10_sentencepiece, op11_quality_rules, op12_merkle_manifest, op13_hard_negatives, pipeline)
}

ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": chat.ORACLE, "op6_url_filter": urls.ORACLE, "op12_merkle_manifest": merkle.oracle(), "op13_hard_negatives": negatives.ORACLE}
