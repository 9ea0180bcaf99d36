"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, chat, decontaminate, fingerprints, jaccard_join, language_id, pii, secrets, spm, token_output


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the files stay where the box keeps them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


def op7_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.extensions(documents(spark, sf_dir))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = token_output.token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_output.read(spark, folder, shards)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digest(rows.union(spark.sql(chat.ADDED)))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_pii, op3_lm_score, op4_secrets, op5_ngram_jaccard, op6_sentencepiece, op7_fingerprints, op7_extensions, op8_token_output, op9_decontaminate, op10_chat_format)}
ORACLES: dict[str, str] = {"op9_decontaminate": decontaminate.ORACLE, "op10_chat_format": chat.ORACLE}
