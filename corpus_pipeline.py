"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage reads what the one before wrote, works on all of it, and returns
the columns of ``documents`` (the last one returns ids and digests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import bpe, language, mixing, simhash, substrings
from shelfcast.llm.common import read_table, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go."""
    return language.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of 4 words, 4 bits)."""
    return simhash.keep_one(docs, shingle=4, max_distance=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut from the texts."""
    return substrings.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per epoch that takes them; the one at a source's cut is shortened."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document of the mix."""
    return bpe.digests(bpe.round_trip(docs, bpe.vocabulary_path()), keep=("ids",))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix),
    ("bpe", tokenise),
]

#: Trained scores, SimHash components and BPE ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet to the shared folder and read again; the folders go when the application ends."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.octet_length("ids").alias("n_bytes"))
