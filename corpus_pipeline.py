"""A corpus from raw documents to token ids: five stages, each over all that the one before kept.

Defined cases, as the stages' operators state them: a null or wordless text fails the quality rules; a null id takes part and is kept only if its class has no other; of near copies the smallest id stays;
a very long text is read whole in each stage; repeated rows are near copies of each other; an empty table goes through empty; further columns of the documents are passed through, but for the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bpe, decontaminate, quality, similar, suffix
from tallgrass.llm.common import cut, table
from tallgrass.llm.queries import vocabulary_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, five-word shingles with a Jaccard similarity of 0.8 or more, the document with the smallest id stays."""
    return similar.keep_one(docs, shingle=5, least=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of ``suffix.PASSAGE`` bytes, as any passage of over 50 words has them, that are also elsewhere are cut out of the texts."""
    return suffix.drop_repeats(docs, suffix.PASSAGE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded."""
    done = bpe.round_trip(docs, vocabulary_file())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is stored as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
