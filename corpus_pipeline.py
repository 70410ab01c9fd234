"""From raw documents to shards of a training mix, in five stages.

Quality rules reject documents, near-duplicate groups keep one document, documents that hold test
items go, sources are mixed to their target weights (documents repeat or drop out), and the rest is
dealt over shards. Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns the columns of documents, the last one more. A stage's rows are written as Parquet in
the folder that the cluster shares and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, mixing, rules, sharding, simhash
from tracewright.llm.common import delete, fresh_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rule and the trees keep. Null and empty texts fail the base rule;
    repeated rows are judged alike; a very long text is counted whole; without labels the base rule
    decides alone."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: fingerprints at most four bits apart, and texts whose five-word
    shingles have a Jaccard similarity of 0.8 or more. The smallest id stays, null ids last; ties go
    by the row key, and of equal rows any one stays. Texts without a word are one group."""
    return simhash.keep_one(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no test item to four fifths of its shingles. Documents without a word
    stay; repeated rows go or stay together; very long texts are read whole."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 3 times. A null source is a source;
    documents without a word are never taken; equal rows are documents of their own."""
    return mixing.repeat_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, in place of columns of the names that sharding gives.
    Null ids share a shard; equal rows have slots of their own."""
    return sharding.place(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL has no way to fit and apply the first stage's trees; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows, read from the shared folder. A stage's rows
    are deleted when the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
