"""The operators of this package as queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 2).drop("ids")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.decontaminate import digest, find_leaks

    return digest(find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.toxicity import fit

    docs = _table(spark, sf_dir, "documents")
    return fit(docs, _table(spark, sf_dir, "labels")).score(docs)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.hmm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.minhash import digest, near_duplicates

    return digest(near_duplicates(_table(spark, sf_dir, "documents"), 3, 85))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.substring import digest

    return digest(_table(spark, sf_dir, "documents"), 35)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), 8)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.spelling import spelling_groups

    return spelling_groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from vigil.llm.oracles import ORACLES

    return dict(ORACLES)
