"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again by the next.

toxicity: documents that the machine rejects go; SimHash: one document of each
group of near copies (five-word shingles, Jaccard likeness of 0.8) stays; passages: each repeated passage stays at its first place; mixing:
sources come near their target weights, a document's part for each time it is
taken being a row; bpe: the byte-level tokens of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecotone.llm import bpe, mixing, queries, shared, simhash, suffixes, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is under the threshold."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine, into="_score").where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard likeness of 0.8): the smallest id's. SimHash fingerprints and pigeonhole probes bring them together, an exact check of the shingles follows. Texts without words have no shingle, so those documents stay."""
    return simhash.one_of_each(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more at its first place only."""
    return suffixes.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of documents that the mix takes."""
    return mixing.mixed_texts(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded bytes for each row of the mix."""
    ranks, pattern = queries.tokenizer()
    return bpe.round_trip(docs, ranks, pattern)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("passages", passages_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express hashing, sorting of suffixes or merges as these stages need them; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stage(docs, f"pipeline-{k}-{name}")
    return docs
