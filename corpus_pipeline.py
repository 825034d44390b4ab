"""Five stages over documents: quality rules, exact dedup, n-gram Jaccard join, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns of documents, and
the last one the tokens of each document of the mix, a row for each time that the mix takes it.

Null texts count as empty and fail the quality rules. A null source is a source of its own, null ids are ids like others.
Of equal texts, and of repeated rows, one row stays, that with the largest doc_id; of a class of near-duplicates that with
the least. Other columns are carried along, also those whose names differ only in case. An empty table gives an empty
result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from quorumtab.llm.common import kept


def rule_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host is rejected, go."""
    return quality_rules.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.survivors(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class of near-duplicates (five-word shingles, similarity 0.8) the row with the least doc_id stays."""
    return ngram_join.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document floor(rate) times, and once more by the fraction of its source's rate."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    out = bpe.encode(docs, bpe.vocabulary(), decoded=False)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", rule_out),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("BPE encoding", encode),
]
#: SQL can express neither the similarity classes at scale nor BPE; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, what each returns written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
