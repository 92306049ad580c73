"""Paragraphs of a text through all stages of its revision.

Paragraphs of each stage are aligned with those of the next; the links are chained
over all stages, so that each paragraph has the stage and number in which it first
stood; changed paragraphs are classified by the rules and passes that they touch; and a
pair of stages gets its driver, its dominant passes and its place in the order of
passes.  Stages are cut into paragraphs in the JVM, without a shuffle; one shuffle by
series brings a stage beside the next; Python sees two stages at a time.

Defined results: a null text has no paragraphs; text before the first heading is left
out, a text without headings is one section named Document; a series of one stage
has no pairs, and its paragraphs begin lines of their own; stages of a series are
distinct; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import align, history, rules

#: fixed values: terms that a revision should keep
TECHNICAL = r"(?i)\b(?:FHE|CKKS|ciphertexts?|bootstrapping|key switching|threat model|security model|latency|throughput)\b"
STATUSES = ("unchanged", "modified", "deleted", "inserted")
PASSES = tuple(history.PASSES)
PAIR = ("series", "stage", "next_stage")


def sectioned(text: Column | str, suffix: Column | str) -> Column:
    """The paragraphs of all sections but the preamble, with their section: an array."""
    marked = F.split(F.regexp_replace(F.coalesce(tx.c(text), F.lit("")), tx.HEADING, "\u0001$1$2\u0002"), "\u0001")

    def of(parts: Column) -> Column:
        one = F.size(parts) == 1

        def part(p: Column, i: Column) -> Column:
            title = F.when(one, "Document").otherwise(tx.squeeze(F.substring_index(p, "\u0002", 1)))
            body = F.when(i == 0, p).otherwise(F.substring_index(p, "\u0002", -1))
            pars = F.when((i > 0) | one, tx.paragraphs(tx.without_scaffold(body, suffix))).otherwise(F.array().cast("array<string>"))
            return F.transform(pars, lambda x: F.struct(title.alias("section"), x.alias("text")))

        return F.flatten(F.transform(parts, part))

    return F.transform(tx.let(marked, of), lambda x, i: F.struct((i + 1).alias("par_no"), x["section"].alias("section"), x["text"].alias("text")))


def paragraphs(stages: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """series, stage, pars from series, stage, text and suffix (`.txt` if there is no
    such column).  reserved: series, stage, par_no that are held out; a number beyond
    the paragraphs of its stage raises an error."""
    suffix = F.col("suffix") if "suffix" in stages.columns else F.lit(".txt")
    rows = stages.select("series", "stage", sectioned("text", suffix).alias("pars"))
    if reserved is None:
        return rows
    out = reserved.groupBy("series", "stage").agg(F.collect_set("par_no").alias("_out"))
    rows = rows.join(out, ["series", "stage"], "left").withColumn("_out", F.coalesce("_out", F.array().cast("array<int>")))
    beyond = F.exists("_out", lambda n: (n < 1) | (n > F.size("pars")))
    kept = F.filter("pars", lambda p: ~F.array_contains("_out", p["par_no"]))
    return rows.select("series", "stage", F.when(beyond, F.raise_error(F.lit("a paragraph that is held out is beyond its stage"))).otherwise(kept).alias("pars"))


def aligned(pars: DataFrame) -> DataFrame:
    """series, stage, next_stage, status, before_no, after_no, similarity, section (of
    the later stage, if there), and before and after where they differ."""
    by = W.partitionBy("series").orderBy("stage")
    rows = pars.withColumn("next_stage", F.lead("stage").over(by)).withColumn("next", F.lead("pars").over(by)).where("next_stage is not null")
    field = lambda x: [F.col(f"{x}.{n}") for n in ("par_no", "section", "text")]
    rows = rows.select(*PAIR, *[f.alias(f"_{k}") for k, f in enumerate([*field("pars"), *field("next")])])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join([*[f"{c} {kinds[c]}" for c in PAIR], "status string, before_no int, after_no int, similarity double, section string, before string, after string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *key, n, sec, old, n2, sec2, new in zip(*[c.to_pylist() for c in batch.columns]):
                for status, i, j, s in align.paragraph_pairs(old, new):
                    same = status == "unchanged"
                    out.append((*key, status, n[i] if i >= 0 else None, n2[j] if j >= 0 else None, s, sec2[j] if j >= 0 else sec[i], None if same or i < 0 else old[i], None if same or j < 0 else new[j]))
            kind = [*[batch.schema.field(k).type for k in range(3)], pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string()]
            names = [*PAIR, "status", "before_no", "after_no", "similarity", "section", "before", "after"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kind)], names=names)

    return rows.mapInArrow(run, ddl)


def lines(pars: DataFrame, links: DataFrame) -> DataFrame:
    """For each paragraph of each stage the stage and number in which it
    first stood.  Each round doubles the way back, so there are as many rounds as the
    stages of the longest series have binary digits."""
    every = pars.select("series", "stage", F.explode("pars.par_no").alias("par_no"))
    back = links.where(F.col("before_no").isNotNull() & F.col("after_no").isNotNull())
    back = back.select("series", F.col("next_stage").alias("stage"), F.col("after_no").alias("par_no"), F.col("stage").alias("root_stage"), F.col("before_no").alias("root_no"))
    rows = every.join(back, ["series", "stage", "par_no"], "left").select("series", "stage", "par_no", F.coalesce("root_stage", "stage").alias("root_stage"), F.coalesce("root_no", "par_no").alias("root_no"))
    most = pars.groupBy("series").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range((most - 1).bit_length()):
        far = rows.select("series", F.col("stage").alias("root_stage"), F.col("par_no").alias("root_no"), F.col("root_stage").alias("far_stage"), F.col("root_no").alias("far_no"))
        rows = rows.join(far, ["series", "root_stage", "root_no"]).select("series", "stage", "par_no", F.col("far_stage").alias("root_stage"), F.col("far_no").alias("root_no"))
    return rows


def changes(links: DataFrame) -> DataFrame:
    """Changed paragraphs with the rules whose counts differ and the passes that
    the change may belong to."""
    rows = links.where("status <> 'unchanged'").withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")})
    count = lambda t: F.transform(rules.hits(t), lambda h: h["rule"])
    rows = rows.withColumn("_b", count("before")).withColumn("_a", count("after"))
    n = lambda side, rule: F.size(F.filter(side, lambda v: v == rule))
    ids = F.filter(F.array_sort(F.array_distinct(F.concat("_b", "_a"))), lambda r: n(F.col("_b"), r) != n(F.col("_a"), r))
    scope = lambda t: tx.every(t, history.CLAIM_WORDS)
    rows = rows.withColumn("rule_ids", ids)
    marks = [scope("before") != scope("after"), F.col("status").isin("inserted", "deleted"), F.array_contains("rule_ids", 3), F.col("status") == "modified", F.size("rule_ids") > 0]
    return rows.withColumn("passes", F.array_compact(F.array(*[F.when(m, p) for m, p in zip(marks, PASSES)]))).drop("_a", "_b")


def report(links: DataFrame, reviewer: list[tuple[int, int]], advisor: list[tuple[int, int]]) -> DataFrame:
    """A row for each pair of stages: driver, whether it counts as the author's, the
    number of paragraphs of each status, how often each rule and pass changed, and the
    dominant passes (all at a tie; none without changes)."""
    same = links.where("status = 'unchanged'").groupBy(*PAIR).agg(F.count("*").alias("unchanged"))
    rows = changes(links)
    n = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES[1:]]
    by_pass = [F.count_if(F.array_contains("passes", p)).alias(p) for p in PASSES]
    by_rule = [F.count_if(F.array_contains("rule_ids", r)).alias(f"r{r}") for r in rules.SEVERITY]
    rows = rows.groupBy(*PAIR).agg(*n, *by_pass, *by_rule).join(same, list(PAIR), "full").na.fill(0)
    freq = lambda names: F.filter(F.array(*[F.struct(F.lit(x).alias("name"), F.col(c).alias("n")) for x, c in names]), lambda x: x["n"] > 0)
    rows = rows.withColumn("passes", freq([(p, p) for p in PASSES])).withColumn("rules", freq([(r, f"r{r}") for r in rules.SEVERITY]))
    top = F.transform(F.filter("passes", lambda x: x["n"] == F.array_max(F.transform("passes", lambda y: y["n"]))), lambda x: x["name"])
    rows = history.drivers(rows.withColumn("dominant", top), reviewer, advisor)
    return rows.select(*PAIR, "driver", (F.col("driver") != "reviewer-driven").alias("included"), *STATUSES, "passes", "rules", "dominant")


def author_rules(pairs: DataFrame) -> DataFrame:
    """How often each rule changed in the pairs that count as the author's."""
    return pairs.where("included").select("series", F.explode("rules").alias("x")).groupBy("series", F.col("x.name").alias("rule")).agg(F.sum("x.n").alias("n"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """Pairs of stages whose first dominant pass comes before that of the last pair
    that had one."""
    by = W.partitionBy("series").orderBy("stage")
    rows = pairs.where(F.size("dominant") > 0).select(*PAIR, F.get("dominant", F.lit(0)).alias("pass"))
    rows = rows.withColumn("_last", F.lag(F.struct("stage", "next_stage", "pass")).over(by)).where(F.col("_last.pass") > F.col("pass"))
    return rows.select("series", F.col("_last.stage").alias("earlier_stage"), F.col("_last.next_stage").alias("earlier_next"), F.col("_last.pass").alias("earlier_pass"), "stage", "next_stage", "pass")


def exemplars(changed: DataFrame) -> DataFrame:
    """Modified paragraphs of two to four sentences in which rules changed, with the
    technical terms that both sides hold."""
    own = F.greatest(F.size(tx.sentences("before")), F.size(tx.sentences("after")))
    kept = F.array_intersect(tx.every("before", TECHNICAL), tx.every("after", TECHNICAL))
    rows = changed.where((F.col("status") == "modified") & (F.size("rule_ids") > 0) & own.between(2, 4))
    in_order = F.transform(F.array_sort(F.transform(kept, lambda t: F.struct(F.lower(t).alias("key"), t.alias("term")))), lambda x: x["term"])
    return rows.select(*PAIR, "before_no", "after_no", "section", "rule_ids", "before", "after", in_order.alias("kept"))
