"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import decontaminate, language, lines, pair_bpe, setsketch, simhash
from reelgrid.llm.common import table
from reelgrid.llm.queries import tokenizer
from reelgrid.spreading import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, in none of the languages, or whose likeliest stays below one half, go."""
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 3 lines or 50 words are cut; a document of nothing else goes."""
    return lines.dedup_lines(docs, drop_emptied=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Documents are linked by fingerprints at most 2 bits apart, and where 80 of 100 of their distinct
    five-word shingles agree, measured on the full sets.
    """
    return simhash.keep_one(docs, further=lambda rows: setsketch.near_duplicates(rows, 5, (80, 100)))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is benchmark text go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests with the digest of the text decoded from them."""
    return pair_bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", remove_benchmarks),
    ("bpe", encode),
]

#: Fingerprints, language posteriors and token ids are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
