"""Exact dedup by distributed MSD radix partitioning (operator 11).

Texts are strings of bytes, and a digit is a run of successive bytes.  All rows
begin in one group.  A round counts the rows of each group by their next digit; a row
whose count is one is alone and done; rows whose digit is shorter than the round's
width have ended together, are equal, and are done; the others, with the bytes that
follow, go on in a group for each digit.  Bytes decide, and no digest: what ends
together has agreed in every digit.

Widths grow (`DIGITS`), so a text is done after as many rounds as its length has
digits, and most are done after the first: of a row that is alone there, only its
narrow columns are written.  Counts are combined before they are shuffled, so a
group of any size costs one row a task; digits are looked up by a join whose hot
keys adaptive execution splits.  The way is the same at every size.

Defined results: a null text is empty, and all empty texts are one group; the row
with the largest doc_id stays, a null doc_id only where all are null; of rows that
share that doc_id and the text one stays; very long texts take more rounds; an empty
table gives an empty result; `distinct` returns all columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import filter_of
from .common import keep, table

#: bytes of a digit in each round; the last width repeats
DIGITS = (64, 4096, 1 << 18, 1 << 23)

def _counted(rows: DataFrame, name: str) -> DataFrame:
    """The digits that several rows of a group have: group, digit, n, top (the largest
    doc_id) and next (the number of the group that they form)."""
    counts = rows.groupBy("group", "digit").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).where("n > 1")
    return keep(counts.withColumn("next", F.monotonically_increasing_id()), name)


def _met(rows: DataFrame, counts: DataFrame) -> DataFrame:
    own = counts.select(F.col("group").alias("_group"), F.col("digit").alias("_digit"), "n", "top", "next")
    return rows.join(own, (F.col("group") == F.col("_group")) & (F.col("digit") == F.col("_digit")), "left")


def _met_first(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same in the first round, over all texts: a Bloom filter of the digits, of a
    fixed greatest size, keeps rows that are alone out of the shuffle; what it lets
    through is joined."""
    key = lambda: F.xxhash64("digit")
    sent = rows.sparkSession.sparkContext.broadcast(filter_of(counts.select(key().alias("key")), counts.count()))

    @F.pandas_udf("boolean")
    def shared(keys: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(keys.to_numpy().view(np.uint64)))

    rows = rows.withColumn("_shared", shared(key()))
    alone = [F.lit(None).cast("long").alias(c) for c in ("n", "top", "next")]
    names = [*rows.drop("_shared").columns, "n", "top", "next"]
    return _met(rows.where("_shared"), counts).select(*names).unionByName(rows.where("not _shared").drop("_shared").select("*", *alone))


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """The text as its next digit and what follows, so that no byte travels twice."""
    return rows.withColumns({"digit": F.substring("rest", 1, width), "tail": F.substring("rest", width + 1, (1 << 31) - 1)}).drop("rest")


def _passed(met: DataFrame, width: int, row: Column, more: list[str]) -> DataFrame:
    """What a round leaves of each row."""
    done = F.col("n").isNull() | (F.octet_length("digit") < width)
    return met.select(row.alias("row"), "doc_id", "sha", *more, "top", "n", F.col("next").alias("group"), done.alias("done"), F.when(~done, F.col("tail")).alias("rest"))


def groups(docs: DataFrame, *carried: Column) -> DataFrame:
    """docs: doc_id, text.  A row per document: doc_id, keep_id, group_size, kept,
    text_sha256, and columns that are carried (their names begin with an underscore)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("rest"), F.lit(0).cast("long").alias("group"), *carried)
    more = rows.columns[3:]
    counts = _counted(_cut(rows, DIGITS[0]).select("doc_id", "group", "digit"), "digits")
    met = _met_first(_cut(rows.withColumn("sha", F.sha2("rest", 256)), DIGITS[0]), counts)
    state = keep(_passed(met, DIGITS[0], F.monotonically_increasing_id(), more), "radix")
    finished, k = [state.where("done")], 1
    while state.where("not done").limit(1).count():
        width = DIGITS[min(k, len(DIGITS) - 1)]
        rows = _cut(state.where("not done").drop("n", "top"), width)
        met = _met(rows, _counted(rows.select("doc_id", "group", "digit"), "digits"))
        state = keep(_passed(met, width, F.col("row"), more), "radix")
        finished.append(state.where("done"))
        k += 1
    own = ["doc_id", "sha", *more, "row", "group", "top", "n"]
    out = reduce(DataFrame.unionByName, [f.select(*own, F.lit(i).alias("round")) for i, f in enumerate(finished)])
    last = F.col("doc_id").eqNullSafe(F.col("top"))
    ties = keep(out.where(F.col("n").isNotNull() & last).groupBy("round", "group").agg(F.count("*").alias("many"), F.min("row").alias("first")).where("many > 1"), "ties")
    kept = F.col("n").isNull() | last
    if ties.limit(1).count():
        out = out.join(ties, ["round", "group"], "left")
        kept = kept & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    alone = F.col("n").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), *more)


def distinct(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    out = groups(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")), F.col("_whole"))
    return out.where("kept").select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
