"""Documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept.  All but the last return the columns of documents.

Defined results: rows with a null doc_id cannot be named and pass the near-copy
and decontamination stages; a null text is empty and fails the quality rules; of
linked documents the smallest doc_id stays, of rows that are equal in doc_id and
text one (which, if other columns differ, is not defined); of rows that share a
doc_id but not their text, all go if one is linked to a smaller id or is
contaminated; an empty table gives an empty result; columns beyond those of
documents pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import decontamination, mixing, near, quality, sharding
from proselens.llm.common import is_small, keep, passing, table


def _without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = keep(ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "dropped")
    return docs.alias("d").join((F.broadcast(ids) if is_small(ids) else ids).alias("i"), F.col("d.doc_id") == F.col("i.doc_id"), "left_anti")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules and the isolation forest: rejected documents go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join: of each group of linked documents the smallest doc_id stays."""
    found = keep(near.joined(docs.select("doc_id", "text")), "joined")
    left = _without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))
    again = keep(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return left
    repeated = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return _without_ids(left, again).unionByName(repeated)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Positional index: documents that hold benchmark passages go."""
    found = decontamination.digest(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without_ids(docs, found.where("contaminated").select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Systematic sampling: sources at their target weights, repeats as rows."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """K-d tree partitioning: the shard and slot of each row."""
    return sharding.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near", distinct),
    ("decontamination", uncontaminated),
    ("mixing", mix),
    ("sharding", shards),
]

#: an isolation forest and a k-d tree are beyond SQL; tests hold the result against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing() as last:  # what a stage wrote for itself goes with it
            docs = last(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
