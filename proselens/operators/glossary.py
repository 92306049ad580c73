"""Layered terminology: tables, override, lint, and the verdict on a pass (findings are in `terms`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

ENTRY = "layer string, pos int, term string, abbreviation string, synonyms array<string>, variants array<string>"
#: the layers of the registered queries
LAYERS = [
    ("L0", 0, "ciphertext", None, ["encrypted blob"], ["cipher text", "cipher-text"]),
    ("L0", 1, "key-switching", "KS", ["key exchange step"], ["key switching"]),
    ("L0", 2, "bootstrapping", None, ["refresh ciphertext bootstrapping"], ["boot-strapping"]),
    ("L1", 0, "Key-Switching", "KSW", ["key swap"], ["key switching"]),
    ("L1", 1, "fully homomorphic encryption", "FHE", ["full homomorphic encryption"], ["fully-homomorphic encryption"]),
    ("L2", 0, "bootstrapping", "BTS", ["refreshing", "noisy bootstrapping step"], ["boot strapping"]),
    ("L2", 1, "method", None, ["approach"], ["methods"]),
]


def layers(spark: SparkSession, rows: list[tuple] = LAYERS) -> DataFrame:
    return spark.createDataFrame(rows, ENTRY)


def merged(entries: DataFrame) -> DataFrame:
    """By term (any case) the entry of the last layer wins whole; `first_layer` and
    `first_pos` order the terms by their first sight.  A term of any number of entries
    is one aggregate."""
    at = F.struct("layer", "pos")
    rows = entries.groupBy(F.lower("term").alias("_key")).agg(F.min(at).alias("_first"), F.max(F.struct("layer", "pos", "term", "abbreviation", "synonyms", "variants")).alias("x"))
    return rows.select(F.col("_first.layer").alias("first_layer"), F.col("_first.pos").alias("first_pos"), "x.layer", "x.term", "x.abbreviation", "x.synonyms", "x.variants")


def conflicts(entries: DataFrame) -> DataFrame:
    """Each entry that overrides one, with the fields that differ, even if none."""
    by = W.partitionBy(F.lower("term")).orderBy("layer", "pos")
    rows = entries.withColumn("_old", F.lag(F.struct("layer", "abbreviation", "synonyms", "variants")).over(by)).where("_old is not null")
    fields = F.array_compact(F.array(*[F.when(~F.col(x).eqNullSafe(F.col(f"_old.{x}")), F.lit(x)) for x in ("abbreviation", "synonyms", "variants")]))
    return rows.select("term", F.col("_old.layer").alias("overridden"), F.col("layer").alias("overriding"), F.array_join(fields, ",").alias("fields"))


def forms(entries: DataFrame) -> DataFrame:
    """term, kind, form: a row per forbidden form."""
    both = F.array(F.struct(F.lit("forbidden_synonym").alias("kind"), F.col("synonyms").alias("f")), F.struct(F.lit("plural_or_hyphen_variant").alias("kind"), F.col("variants").alias("f")))
    return entries.select("term", F.explode(both).alias("x")).select("term", "x.kind", F.explode("x.f").alias("form"))


def active_rules(entries: DataFrame) -> DataFrame:
    return entries.agg(F.sum(F.size("synonyms") + F.size("variants")).cast("long").alias("active_rules"))


def deletion_risks(entries: DataFrame) -> DataFrame:
    """Forbidden forms that hold their term and more words: deleting them by
    the rule would delete words."""
    n = lambda x: F.size(tx.every(x, "[A-Za-z0-9]+"))
    rows = forms(entries).withColumn("extra", n("form") - n("term"))
    return rows.where((F.col("extra") > 0) & F.contains(F.lower("form"), F.lower("term")))


def derived_variants(term: Column | str) -> Column:
    """The term with blanks for hyphens and the other way, unless the same."""
    t = tx.c(term)
    own = F.array(F.when(t.contains("-"), tx.squeeze(F.replace(t, F.lit("-"), F.lit(" ")))), F.when(t.contains(" "), F.regexp_replace(F.trim(t), r"\s+", "-")))
    return F.filter(F.array_distinct(F.array_compact(own)), lambda x: x != t)


def pass_verdict(immutable: DataFrame, forward: DataFrame, residual_before: DataFrame, residual_after: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair and pass, proceed or rollback.  P3 may change terms, but
    must add no forbidden form; P4 to P7 may change nothing protected."""
    total = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    kinds = immutable.groupBy("pair_id").agg(F.sum("violations").alias("all_v"), F.sum(F.when(F.col("category") != "glossary_terms", F.col("violations")).otherwise(0)).alias("other_v"))
    rows = pairs.select("pair_id").join(kinds, "pair_id", "left")
    for df, name in ((forward, "forward"), (residual_before, "r_before"), (residual_after, "r_after")):
        rows = rows.join(total(df, name), "pair_id", "left")
    rows = rows.na.fill(0).withColumn("delta", F.col("r_after") - F.col("r_before"))
    rows = rows.withColumn("pass", F.explode(F.array(*[F.lit(f"P{k}") for k in range(3, 8)])))
    ok = F.when(F.col("pass") == "P3", (F.col("other_v") == 0) & (F.col("forward") == 0) & (F.col("delta") <= 0)).otherwise(F.col("all_v") == 0)
    return rows.select("pair_id", "pass", F.col("delta").cast("long").alias("delta"), F.when(ok, "proceed").otherwise("rollback").alias("verdict"))
