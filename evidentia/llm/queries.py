"""The queries op1 to op13: operators applied to the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import align, bpe_automaton, chat, decontam, embed_dedup, hmm_lm, html_main, mixing, phrases, secrets, simhash, tokens, toxicity
from evidentia.llm.common import fold, shared_dir, table, tokenizer_path
from evidentia.llm.sql import ORACLES

#: One document of so many is in the ledger before op8 scans them all.
SEEN = 10


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.paired_replies(table(spark, sf_dir, "conversations")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as versions, against a ledger of this run's own that an earlier scan of some has filled."""
    docs, ledger = table(spark, sf_dir, "documents"), shared_dir(spark)
    secrets.scan_versions(docs.where(fold(F.col("doc_id"), SEEN) == 0), ledger)
    out = secrets.scan_versions(docs, ledger)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexed(out["fp"]).alias("fingerprint"), "component_id")


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_toxicity": op2_toxicity, "op3_preference_format": op3_preference_format, "op4_decontamination": op4_decontamination, "op5_token_ids": op5_token_ids, "op6_html_text": op6_html_text, "op7_language_model": op7_language_model, "op8_secrets": op8_secrets, "op9_mixing": op9_mixing, "op10_simhash": op10_simhash, "op11_bpe_automaton": op11_bpe_automaton, "op12_token_alignment": op12_token_alignment, "op13_collocations": op13_collocations}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
