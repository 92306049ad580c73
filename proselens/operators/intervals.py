"""Joins of places with intervals of a text, by offset bins.

Both sides are dealt to bins of a fixed width, joined by key and bin, and then held
against each other exactly: the join is one of equal keys, and neither a long text nor
a frequent key meets in one task.  An interval stands in every bin that it touches; a
pair is given in one bin only.

Defined results: intervals are half-open, so an empty one holds nothing; a place in no
interval has a row with nulls; in several, a row for each; rows with a null key or
place match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: code points of a bin
WIDTH = 4096


def _bin(at: Column) -> Column:
    return F.floor(at / WIDTH).cast("long")


def _binned(rows: DataFrame) -> DataFrame:
    """Rows with start and end, once for each bin that they touch."""
    full = rows.where(F.col("end") > F.col("start"))
    return full.withColumn("_bin", F.explode(F.sequence(_bin(F.col("start")), _bin(F.col("end") - 1))))


def containing(places: DataFrame, intervals: DataFrame, key: str, out: list[str]) -> DataFrame:
    """places: key, start and others; intervals: key, start, end and `out`.  Each place
    with `out` of the intervals that hold it."""
    right = _binned(intervals).select(F.col(key).alias("_key"), "_bin", F.col("start").alias("_from"), F.col("end").alias("_to"), *out)
    left = places.withColumn("_at", _bin(F.col("start")))
    on = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & (F.col("start") >= F.col("_from")) & (F.col("start") < F.col("_to"))
    return left.join(right, on, "left").select(*places.columns, *out)


def overlapping(a: DataFrame, b: DataFrame, key: str, out: list[str]) -> DataFrame:
    """Pairs of intervals that share a code point: the columns of `a`, and `out` of `b`."""
    right = _binned(b).select(F.col(key).alias("_key"), F.col("_bin").alias("_at"), F.col("start").alias("_from"), F.col("end").alias("_to"), *out)
    both = (F.col("start") < F.col("_to")) & (F.col("_from") < F.col("end")) & (F.col("_bin") == _bin(F.greatest("start", "_from")))
    return _binned(a).join(right, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_at")) & both).select(*a.columns, *out)


def section_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """P9 with places: key, sec_no, title, start, end: from each heading to the next;
    what is ahead of the first is Preamble, a text without headings is Document."""
    pieces = docs.select(key, tx.cut(F.coalesce(text, F.lit("")), tx.HEADING).alias("_p"))

    def section(x: Column, i: Column) -> Column:
        title = F.when(F.size("_p") == 1, "Document").when(i == 0, "Preamble").otherwise(tx.squeeze(F.concat(F.regexp_extract(F.get("_p", i - 1)["match"], tx.HEADING, 1), F.regexp_extract(F.get("_p", i - 1)["match"], tx.HEADING, 2))))
        start = F.when(i == 0, 0).otherwise(F.get("_p", i - 1)["start"])
        return F.struct((i / 2).cast("int").alias("sec_no"), title.alias("title"), start.alias("start"), (x["start"] + F.length(x["match"])).alias("end"))

    rows = pieces.select(key, F.explode(F.filter(F.transform("_p", lambda x, i: F.struct((i % 2 == 0).alias("body"), section(x, i).alias("s"))), lambda x: x["body"])).alias("x"))
    return rows.select(key, "x.s.*")


def sentence_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """P4 with places: key, sentence (0-based), start, end of the spans that are not blank."""
    spans = F.filter(tx.places(F.coalesce(text, F.lit("")), r"[^.!?\n]+[.!?]?"), lambda x: x["match"].rlike(r"\S"))
    rows = docs.select(key, F.posexplode(spans).alias("sentence", "x"))
    return rows.select(key, "sentence", F.col("x.start").alias("start"), (F.col("x.start") + F.length("x.match")).alias("end"))


def in_context(findings: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings (key, start and others) with the section and the sentence that each
    begins in."""
    rows = containing(findings, section_spans(docs, key, text), key, ["sec_no", "title"])
    return containing(rows, sentence_places(docs, key, text), key, ["sentence"])
