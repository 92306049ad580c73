"""Gapless ranks without a sort of a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, lookup

#: rows that one window task sorts together, about
EACH = 512
#: ranges whose offsets are summed together
FAN = 4096


def hash32(text: Column) -> Column:
    """The first 32 bits of the md5 of a text, as a long."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, parts: list[str], order: str, then: list[str], out: str, each: int = EACH) -> DataFrame:
    """Add `out`: 1-based ranks within `parts` (null is a value) by the 32-bit
    column `order`, ties by `then`.

    A part is cut into as many ranges of `order` as its count asks for; a rank
    is the offset of its range plus its row number there.  A part of any size is
    so dealt over many tasks.  Offsets are sums of counts on two levels: over
    groups of `FAN` ranges along a part, and over the ranges of a group.
    """

    def same(a: str, b: str, names: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names], F.lit(True))

    def before(n: str, by: list[str], along: str) -> Column:
        return F.coalesce(F.sum(n).over(W.partitionBy(*by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    counts = df.groupBy(*parts).agg(F.ceil(F.count("*") / F.lit(each)).alias("_ranges"))
    counts = keep(counts, "counts")
    n = counts.agg(F.sum("_ranges")).first()[0] or 0
    df = lookup(df.alias("d"), counts.alias("c"), same("d", "c", parts)).select("d.*", "c._ranges")
    df = df.withColumn("_range", F.floor(F.col(order) * F.col("_ranges") / F.lit(float(2**32))).cast("long"))
    fine = df.groupBy(*parts, "_range").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_range") / FAN))
    fine = keep(fine.withColumn("_before", before("_n", [*parts, "_group"], "_range")), "offsets", n)
    wide = fine.groupBy(*parts, "_group").agg(F.sum("_n").alias("_n"))
    wide = keep(wide.withColumn("_first", before("_n", parts, "_group")).where("_group > 0"), "groups", n)
    df = df.withColumn("_group", F.floor(F.col("_range") / FAN))
    df = df.withColumn("_rank", F.row_number().over(W.partitionBy(*parts, "_range").orderBy(order, *then)))
    df = lookup(df.alias("d"), fine.alias("f"), same("d", "f", [*parts, "_range"])).select("d.*", "f._before")
    if wide.limit(1).count():
        df = lookup(df.alias("d"), wide.alias("f"), same("d", "f", [*parts, "_group"])).select("d.*", F.coalesce("f._first", F.lit(0)).alias("_first"))
    else:
        df = df.withColumn("_first", F.lit(0))
    return df.withColumn(out, F.col("_first") + F.col("_before") + F.col("_rank")).drop("_ranges", "_range", "_rank", "_before", "_group", "_first")
