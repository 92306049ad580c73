"""Candidates from pages of lists (S19): links that hold a keyword, a row for a page
that holds it elsewhere, and the best file that a landing page leads to.

A page is one row, and all choices are made over the array of its links, in order, so
pages are not shuffled; landing pages are joined by address.

Defined results: a page without links and keyword gives the row of an empty slot; a null
page is empty; of several pages with one address the least page_id is the landing page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import corpus

#: fixed values: titles of rows that a person must review, and their note
ELSEWHERE, EMPTY, NOTE = "KEYWORD_HIT_PAGE_REVIEW_REQUIRED", "NO_KEYWORD_HIT_REVIEW_REQUIRED", "manual_review_page_keyword_hit"
#: fixed values: what files are preferred and passed over, and the least letters of a
#: title's word that counts
PREFERRED, SKIPPED, LETTERS = ("system/files", "ndss-paper"), ("slides", "video"), 4


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w.lower())), words, F.lit(False))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, plain (the page's text without tags), links: an array of (text, href)
    in the order of the page."""
    plain = tx.squeeze(corpus.unescaped(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), "(?s)<!--.*?-->|<[^>]*>", " ")))
    place = F.transform(corpus.link_array("url", F.coalesce("html", F.lit(""))), lambda x, i: F.struct(i.alias("place"), x["text"].alias("text"), x["href"].alias("href")))
    return pages.select("page_id", "url", plain.alias("plain"), place.alias("links"))


def candidates(pages: DataFrame, keywords: tuple[str, ...], suffix: str = ".pdf") -> DataFrame:
    """page_id, place, title, source_url, pdf_url, status, notes: the links of a page that
    hold a keyword in text or address; else one row for the page."""
    rows = page_links(pages)
    hit = F.filter("links", lambda x: _holds(F.lower(F.concat(x["text"], F.lit(" "), x["href"])), keywords))
    file = lambda x: F.endswith(F.lower(x["href"]), F.lit(suffix))
    own = F.transform(hit, lambda x: F.struct(x["place"].alias("place"), F.coalesce(F.nullif(x["text"], F.lit("")), x["href"]).alias("title"), F.coalesce(F.nullif(x["href"], F.lit("")), F.col("url")).alias("source_url"), F.when(file(x), x["href"]).otherwise("").alias("pdf_url"), F.when(file(x), "pdf_available").otherwise("metadata_only").alias("status"), F.lit("").alias("notes")))
    elsewhere = _holds(F.lower("plain"), keywords)
    one = F.struct(F.lit(None).cast("int").alias("place"), F.when(elsewhere, ELSEWHERE).otherwise(EMPTY).alias("title"), F.col("url").alias("source_url"), F.lit("").alias("pdf_url"), F.lit("metadata_only").alias("status"), F.when(elsewhere, NOTE).otherwise("").alias("notes"))
    return rows.select("page_id", F.explode(F.when(F.size(hit) > 0, own).otherwise(F.array(one))).alias("x")).select("page_id", "x.*")


def best_file(links: Column, title: Column, suffix: str = ".pdf") -> Column:
    """The file that a landing page leads to: the first with a preferred address; else,
    of the files behind the first, the last whose address holds two words of the title;
    else the first.  Empty if there is none."""
    words = F.filter(F.split(F.lower(title), r"(?U)\W+"), lambda w: F.length(w) >= LETTERS)
    low = lambda x: F.lower(x["href"])
    files = F.transform(F.filter(links, lambda x: F.endswith(low(x), F.lit(suffix)) & ~_holds(F.lower(x["text"]), SKIPPED)), lambda x: x["href"])
    preferred = F.filter(files, lambda h: _holds(F.lower(h), PREFERRED))
    rest = F.filter(files, lambda h, i: (i > 0) & (F.size(F.filter(words, lambda w: F.contains(F.lower(h), w))) > 1))
    return F.coalesce(F.get(preferred, F.lit(0)), F.get(rest, F.size(rest) - 1), F.get(files, F.lit(0)), F.lit(""))


def landed(found: DataFrame, pages: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """Candidates (source_url, title, pdf_url and others); those without a file take the
    best of their landing page, if it is among the pages."""
    first = page_links(pages).groupBy(F.col("url").alias("_url")).agg(F.min_by("links", "page_id").alias("_links"))
    rows = found.join(first, (F.col("source_url") == F.col("_url")) & (F.col("pdf_url") == ""), "left")
    best = F.when(F.col("pdf_url") != "", F.col("pdf_url")).when(F.col("_links").isNull(), "").otherwise(best_file(F.col("_links"), F.col("title"), suffix))
    return rows.withColumn("pdf_url", best).select(*found.columns)
