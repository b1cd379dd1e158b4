"""From raw documents to packed ones: five stages, each an operator of marginalia.llm.

Every stage takes the documents that the one before kept and returns all their columns; only the last
returns places in batches.  Between stages run() writes Parquet to the shared folder and reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import common
from marginalia.llm.contamination import decontaminated
from marginalia.llm.jaccard import one_of_each_group
from marginalia.llm.languages import recognised, train
from marginalia.llm.packing import packed
from marginalia.llm.personal import redacted
from marginalia.llm.queries import held_out
from marginalia.llm.token_counts import token_counts
from marginalia.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; those without text, without letters, or with no language that
    has half of their letters stay behind."""
    return recognised(docs, train(docs, ~held_out()), share=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, directly or by way of others, the one
    with the smallest id goes on."""
    return one_of_each_group(docs, k=5, threshold=(4, 5))


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is in benchmark windows stay behind."""
    return decontaminated(docs, common.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents go on, with personal data masked."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch of 16,384 tokens for every document."""
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), frequent=0)
    return packed(counted, buckets=16, budget=16_384, granule=8, length=F.col("n_tokens"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_contamination", benchmark_contamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Languages, groups of similar documents and personal data have no SQL; the tests compare run() with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
