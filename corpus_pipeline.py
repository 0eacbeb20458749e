"""A training-corpus pipeline: each stage works on what the one before it kept, as written Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import bpe, decontaminate, simhash, substring, toxicity
from grainmill.llm._common import fresh_path
from grainmill.llm.queries import learnable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional language models find toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, labels, learn_from=learnable()).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a Jaccard similarity of 0.8 or more on five-word shingles) stays."""
    return simhash.keep_one(docs, width=5, similarity=0.8).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    cut = substring.dedup(docs).where("n_removed_words = 0 or length(text) > 0")
    return cut.withColumn("n_chars", F.when(F.col("n_removed_words") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that mostly consist of them go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, bench).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it again."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    marked = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    decoded = bpe.encode(marked, path, pattern, keep=["doc_id", "lang", "source", "text_sha256"], decoded="decoded")
    exact = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), exact.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("byte_bpe", tokenize),
]

#: Language models, fingerprints and rolling hashes are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
