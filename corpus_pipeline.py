"""From raw documents to packed sequences, in stages that each end in a table.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import fastsim, harmonic, knnquality, langmask, linechunks
from skein.llm.common import durable, id_remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language score below this is a guess: less than an even choice among five languages.
LEAST_LANGUAGE_SCORE = 0.2


def _learnable(modulus: int = 4):
    """Rows to learn from: the id's remainder is not 2."""
    return F.coalesce(id_remainder(F.col("doc_id"), modulus) != 2, F.lit(False))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes as good; null and empty ones by the share of good labels."""
    model = knnquality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(_learnable()))
    scored = knnquality.predict(docs.select(COLUMNS), model)
    return scored.where("predicted = 1").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters go."""
    filters = langmask.learn(docs.where(_learnable()))
    told = langmask.predict(docs.select(COLUMNS), filters)
    return told.where((F.col("lang_pred") != langmask.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated runs of lines; a document of which nothing is left goes."""
    cut = linechunks.remove_runs(docs, carry=("lang", "source"))
    left = cut.where(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8); those with a null id stay."""
    groups = fastsim.near_duplicates(docs, k=5, percent=80)
    stay = groups.where("kept").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids and their places in sequences."""
    return harmonic.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("packing", packing),
]

#: SQL cannot express the classifier; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
