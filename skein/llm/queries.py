"""The opN_ queries over the tables of a folder, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fastsim, harmonic, iblt, knnquality, langmask, lattice, linechunks, topk, warc
from .common import id_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, query_modulus=50)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def held_out(modulus: int = 4):
    """doc_id's remainder is 2; false for a null doc_id."""
    return F.coalesce(id_remainder(F.col("doc_id"), modulus) == 2, F.lit(False))


def op6_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langmask.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return langmask.predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.remove_repeated(table(spark, sf_dir, "documents"))


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = knnquality.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return knnquality.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_fast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastsim.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES = {f.__name__: f for f in (op1_warc_segments, op2_histogram_topk, op3_byte_bpe, op4_lattice_likelihood, op5_invertible_sketch, op6_language_masks, op9_quality_neighbours, op7_harmonic_packing, op8_line_chunks, op10_fast_similarity)}

ORACLE_SQL: dict[str, str] = {"op1_warc_segments": warc.ORACLE, "op2_histogram_topk": topk.ORACLE, "op8_line_chunks": linechunks.ORACLE}
