"""Ordered versions of a text: what stays, what changes, and who drove it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rules

#: shared four-word expressions that are reported
EXPRESSIONS = 20
PASSES = ["P1", "P2", "P3", "P4", "P5"]
#: fixed values: words whose change is one of claim scope
CLAIM_WORDS = r"(?i)\b(?:may|might|could|suggests?|shows?|proves?|guarantees?|always|never)\b"


def adjacent(stages: DataFrame) -> DataFrame:
    """(series, stage, text) to each stage and the one after it."""
    by = W.partitionBy("series").orderBy("stage")
    rows = stages.withColumn("next_stage", F.lead("stage").over(by)).withColumn("next_text", F.lead("text").over(by))
    return rows.where("next_stage is not null").select("series", "stage", "next_stage", F.col("text").alias("before"), F.col("next_text").alias("after"))


def drivers(pairs: DataFrame, reviewer: list[tuple[int, int]], advisor: list[tuple[int, int]]) -> DataFrame:
    """Who drove a pair of stages; a reviewer wins."""
    if set(reviewer) & set(advisor):  # J21
        raise ValueError("a pair of stages has two drivers")
    is_one = lambda xs: F.coalesce(F.array_contains(F.array(*[F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in xs]), F.struct(F.col("stage").cast("long"), F.col("next_stage").cast("long"))), F.lit(False)) if xs else F.lit(False)
    return pairs.withColumn("driver", F.when(is_one(reviewer), "reviewer-driven").when(is_one(advisor), "author-advisor").otherwise("unclassified"))


def common(stages: DataFrame, items: Column) -> DataFrame:
    """Keys (lower case) that all stages of a series hold, in the first
    stage's first spelling."""
    every = stages.groupBy("series").agg(F.countDistinct("stage").alias("stages"))
    rows = tx.unnest(stages, ["series", "stage"], items, "spelling", "pos").withColumn("key", F.lower("spelling"))
    got = rows.groupBy("series", "key").agg(F.countDistinct("stage").alias("n"), F.min_by("spelling", F.struct("stage", "pos")).alias("spelling"))
    return got.join(every, "series").where("n = stages").select("series", "key", "spelling")


def sentences(text: Column | str = "text") -> Column:
    return F.flatten(F.transform(tx.paragraphs(text), tx.sentences))


def shingles(text: Column | str = "text", n: int = 4, long_word: int = 6) -> Column:
    """Runs of four words that hold a word of six characters or more."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, F.lit(n)))
        good = F.filter(runs, lambda r: F.exists(r, lambda x: F.length(x) >= long_word))
        return F.when(F.size(w) >= n, F.transform(good, lambda r: F.array_join(r, " "))).otherwise(F.array().cast("array<string>"))

    return tx.let(F.transform(tx.words(text), F.lower), of)


def common_expressions(stages: DataFrame, most: int = EXPRESSIONS) -> DataFrame:
    """The first shared expressions in order, at most `most` for a series.

    The texts of a series come together, and their expressions are made and compared in
    its row: an expression for each word is many times the text, and is never shuffled.
    Rows that share a series and stage count as one stage; a null text is empty."""
    texts = stages.where(F.col("stage").isNotNull()).groupBy("series").agg(F.collect_list(F.struct("stage", F.coalesce("text", F.lit("")).alias("text"))).alias("v"))
    of = lambda k: F.array_distinct(F.flatten(F.transform(F.filter("v", lambda x: x["stage"] == k), lambda x: shingles(x["text"]))))
    none = F.lit(None).cast("array<string>")
    shared = F.aggregate(F.array_distinct(F.transform("v", lambda x: x["stage"])), none, lambda own, k: F.when(own.isNull(), of(k)).otherwise(F.array_intersect(own, of(k))))
    rows = tx.unnest(texts, ["series"], F.slice(F.array_sort(shared), 1, most), "expression")
    return rows.select("series", (F.col("_at") + 1).alias("place"), "expression")


def without_reserved(paragraphs: DataFrame, reserved: DataFrame) -> DataFrame:
    """Paragraphs that are not held out."""
    return paragraphs.join(reserved, ["series", "stage", "par_no"], "left_anti")


def rule_changes(pairs: DataFrame) -> DataFrame:
    """Rules whose count differs between a stage and the next."""
    count = lambda t: F.transform(rules.hits(t), lambda h: h["rule"])
    rows = pairs.withColumn("b", count("before")).withColumn("a", count("after")).withColumn("rule", F.explode(F.array(*[F.lit(n) for n in rules.SEVERITY])))
    n = lambda side: F.size(F.filter(side, lambda v: v == F.col("rule")))
    return rows.select("series", "stage", "rule", n("b").alias("n_before"), n("a").alias("n_after")).where("n_before <> n_after")


def classified(pairs: DataFrame) -> DataFrame:
    """The passes that a change of one text belongs to."""
    count = lambda t: F.array_sort(F.transform(rules.hits(t), lambda h: h["rule"]))
    three = lambda own: F.size(F.filter(own, lambda r: r == 3))
    scope = lambda t: tx.every(t, CLAIM_WORDS)
    status = F.when(F.col("before") == F.col("after"), "equal").when(F.trim("before") == "", "inserted").when(F.trim("after") == "", "deleted").otherwise("modified")

    def passes(b: Column, a: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(scope("before") != scope("after"), "P1"),
                F.when(F.col("status").isin("inserted", "deleted"), "P2"),
                F.when(three(b) != three(a), "P3"),
                F.when(F.col("status") == "modified", "P4"),
                F.when(b != a, "P5"),
            )
        )

    # rules read each side once; what is equal has no passes and is not read
    own = tx.let(F.struct(count("before").alias("b"), count("after").alias("a")), lambda x: passes(x["b"], x["a"]))
    rows = pairs.withColumn("status", status).withColumn("passes", F.when(F.col("status") == "equal", F.array().cast("array<string>")).otherwise(own))
    return rows.select("series", "stage", "status", "passes")


def pass_counts(changes: DataFrame) -> DataFrame:
    """How many series change by each pass, at each stage."""
    return tx.unnest(changes, ["stage"], "passes", "pass").groupBy("stage", "pass").agg(F.count("*").alias("n"))


def dominant(counts: DataFrame) -> DataFrame:
    """A10: the most frequent passes of a stage, all at a tie."""
    rows = counts.withColumn("r", F.rank().over(W.partitionBy("stage").orderBy(F.desc("n"))))
    return rows.where("r = 1").select("stage", "pass", "n")


def order_conflicts(counts: DataFrame) -> DataFrame:
    """Stages whose first dominant pass comes before that of the stage before."""
    first = dominant(counts).groupBy("stage").agg(F.min("pass").alias("pass"))
    rows = first.withColumn("earlier", F.lag("pass").over(W.orderBy("stage")))
    return rows.where("earlier > pass").select("stage", "earlier", "pass")
