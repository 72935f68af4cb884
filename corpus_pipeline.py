"""The corpus pipeline: quality rules, language ID, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import packing, pii, quality, simhash, unigram
from sheafwork.llm.common import delete_folder, prepare, shared_folder

#: Least share of the scaled likelihoods that the predicted language must have.
LEAST_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality cascade keeps; null and empty texts go."""
    return quality.quality_kept(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; the model learns from the labelled documents of this stage's own input.

    If there are none to learn from, it keeps every document that has letters.
    """
    return unigram.told_rows(docs, unigram.train_language_model(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicates, one row: see :func:`simhash.first_of_components`."""
    return simhash.first_of_components(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows the new text."""
    model = pii.train_segment_model(docs)
    return pii.redacted_texts(docs, model).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, fingerprints and tokenizers have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again.

    A stage's table is removed once the next one's is written. The last stage keeps its own checkpoints and reads no table afterwards.
    """
    prepare(spark)
    folder = shared_folder(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        schema = rows.schema
        rows.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(schema).parquet(f"{folder}/{name}")
        if before is not None:
            delete_folder(spark, f"{folder}/{before}")
        before = name
    packed = STAGES[-1][1](spark, docs, sf_dir)
    delete_folder(spark, folder)
    return packed
