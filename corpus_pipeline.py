"""A pipeline that makes packed training sequences of documents: STAGES in order, each on all its predecessor kept.

Rows with null or blank text aren't toxic, are nobody's copies and have nothing to cut, so they pass to the last stage,
where each is packed as its end token. Null doc_ids are rows like others. Repeated rows with text are exact copies, of
which one stays. All stages but the last keep every column, whatever its name; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm.common import discard, materialise
from vigil.llm.decontaminate import remove_leaks
from vigil.llm.minhash import drop_near_duplicates
from vigil.llm.packing import pack_documents
from vigil.llm.substring import drop_repeats
from vigil.llm.toxicity import fit
from vigil.session import ship

#: Bytes of rows that go to a Python worker at once; the executor holds them too, beside what the stages before have left.
BATCH_BYTES = 4 << 20


def _ready(spark: SparkSession) -> None:
    """The package goes to the workers, and this session's Arrow batches are bounded by bytes, not by rows of any length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    _ready(spark)
    return fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop_toxic(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more)."""
    _ready(spark)
    return drop_near_duplicates(docs, 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur more than once."""
    _ready(spark)
    return drop_repeats(docs, 35)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents, and the others without the benchmark's passages."""
    _ready(spark)
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 13)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens."""
    _ready(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2, lean=True)  # the executors have grown in the stages before


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # tokenizers and trained models are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = materialise(made)
            discard(docs)
        docs = made
    return docs
