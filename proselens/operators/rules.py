"""Numbered style rules over documents: hits, places, counts and densities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: fixed values: rules that are one pattern (number, severity, pattern)
PATTERNS = [
    (1, "warn", r"(?i)\b(?:groundbreaking|transformative|pivotal|remarkable|revolutionary|unprecedented|game-changing|breakthrough)\b"),
    (3, "block", r"(?i)\b(?:technical packaging|large model privacy inference|homomorphic realization|full homomorphic encryption)\b"),
    (4, "info", r"(?i)\b(?:delve|tapestry|landscape|showcase|seamless|intricate|leverage|underscore)\w*\b"),
    (6, "warn", r"(?i)\b(?:it is (?:important|worthwhile|notable) to (?:note|observe)|it should be noted that)\b"),
    (8, "warn", r"(?i)\b(?:in other words|that is|essentially)\b"),
    (10, "info", r"(?i),\s+(?:thereby\s+)?\w+ing\b[^.!?]{0,90}(?=[.!?])"),
    (11, "info", r"(?i)\b(?:serves as|stands as|boasts)\b"),
    (12, "warn", r"(?i)\bnot only\b[^.!?]{0,120}\bbut also\b"),
    (13, "info", r"\b[A-Za-z][\w-]+,\s+[A-Za-z][\w-]+,\s+and\s+[A-Za-z][\w-]+\b"),
]
SEVERITY = {1: "warn", 2: "warn", 3: "block", 4: "info", 5: "warn", 6: "warn", 7: "info", 8: "warn", 9: "warn", 10: "info", 11: "info", 12: "warn", 13: "info", 14: "warn"}
RANK = {"info": 0, "warn": 1, "block": 2}
UNIT = "ns|us|ms|s|sec(?:onds?)?|min(?:utes?)?|h(?:ours?)?|KB|MB|GB|TB|bits?|bytes?|queries?|records?|vectors?|samples?|entries?|slots?|cores?|threads?"
ADJECTIVE = r"(?i)\b(?:secure\s+and\s+efficient|significantly|dramatically|practical|scalable|efficient)\b"
METRIC = rf"(?i)\b\d+(?:\.\d+)?\s*(?:%|x|×|{UNIT})\b|\b(?:latency|throughput|runtime|memory|communication|bandwidth|accuracy|error|speedup|CPU|GPU|threat model|security model|semi-honest|malicious|IND-CPA|IND-CCA)\b|\b(?:under|for|on)\s+(?:the\s+)?(?:evaluated|fixed|specified|target)\s+(?:dataset|workload|batch)\b"
EVIDENCE = rf"(?i)\\(?:cite\w*|(?:auto|eq|c|C)?ref)\s*\{{|\b\d+(?:\.\d+)?\s*(?:%|x|×|{UNIT})(?![A-Za-z0-9])"
MECHANISM = r"(?i)\b(?:by|via|through)\s+(?:[A-Za-z][\w-]*\s+){0,3}[A-Za-z][\w-]*ing\b|\b(?:using|applying|employing|computing|evaluating|encoding|encrypting|decrypting|packing|batching|precomputing|caching|parallelizing|offloading)\s+(?:an?\s+|the\s+)?[A-Za-z][\w-]*(?:\s+[A-Za-z][\w-]*){0,4}"
CONNECTIVE = r"(?i)(?:^|(?<=[.!?])\s+)(Moreover|Furthermore|Additionally|However),?"
NOMINAL = r"(?i)(?<![\p{L}\p{N}_])[A-Za-z]+(?:tion|sion|ment|ance|ence|ity|ization)(?![\p{L}\p{N}_])"
HEDGES = ["suggests", "is consistent with", "we conjecture", "appears to"]
SUPPORT = r"\\(?:cite\w*|ref|autoref|eqref|cref)\s*\{|\b\d+(?:\.\d+)?\s*(?:%|ms|s|GB|MB|KB|bits?)?\b"
DASH_LIMIT = 3
#: what a text must hold, in lower case, for a rule to find anything: each match of the
#: rule begins with a word or phrase of LEADS, or has one of CUES.  Other rules look for
#: themselves
LEADS = {
    1: ["groundbreaking", "transformative", "pivotal", "remarkable", "revolutionary", "unprecedented", "game-changing", "breakthrough"],
    2: ["secure", "efficient", "significantly", "dramatically", "practical", "scalable"],
    3: ["technical packaging", "large model privacy inference", "homomorphic realization", "full homomorphic encryption"],
    4: ["delve", "tapestry", "landscape", "showcase", "seamless", "intricate", "leverage", "underscore"],
    5: ["moreover", "furthermore", "additionally", "however"],
    11: ["serves as", "stands as", "boasts"],
    12: ["not only"],
}
CUES = {
    6: [" to note", " to observe", "it should be noted that"],
    7: ["tion", "sion", "ment", "ance", "ence", "ity"],
    8: ["in other words", "that is", "essentially"],
    9: ["suggests", "is consistent with", "we conjecture", "appears to"],
    10: ["ing"],
}
#: what stands between paragraphs, and a sentence up to a mark or line end
PARAGRAPH, SENTENCE = r"\n\s*\n", r"[^.!?\n]+[.!?]?"
#: fixed values: phrases of the second rule set
PHRASES = [
    ("background", r"(?i)\bunder the background of\b"),
    ("aspect", r"(?i)\bin the aspect of\b"),
    ("rapid", r"(?i)\bwith the rapid development of\b"),
    ("above", r"(?i)\baccording to the above analysis\b"),
    ("experiment", r"(?i)\bthe experiment result shows\b"),
    ("completely", r"(?i)\bcompletely (?:solves?|eliminates?|prevents?)\b"),
    ("absolute", r"(?i)\bguarantees? (?:absolute|perfect) (?:privacy|security)\b"),
    ("proves", r"(?i)\bproves? that\b[^.!?]{0,100}\bis (?:secure|correct|optimal)\b"),
]


def _hits(text: Column, number: int, pattern: str) -> Column:
    own = tx.every(text, pattern)
    return F.filter(own, lambda m: ~m.rlike(EVIDENCE) & ~m.rlike(MECHANISM)) if number == 10 else own


def adjectives(text: Column) -> Column:
    """Rule 2: performance adjectives, with places, whose sentence (where they begin)
    and both neighbours name no metric or setting.

    A mark before each adjective tells how many begin in each sentence; sentences
    without one, nearly all, are not looked around."""
    marked = F.regexp_replace(F.regexp_replace(text, "[\u0001\u0002]", " "), ADJECTIVE, "\u0001$0")
    near = lambda s, i: F.replace(F.array_join(F.slice(s, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "), F.lit("\u0001"), F.lit(""))
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\u0001"), F.lit("")))
    none = F.array().cast("array<boolean>")
    loose = lambda spans: F.flatten(F.transform(spans, lambda s, i: F.when(~F.contains(s, F.lit("\u0001")), none).otherwise(F.array_repeat(~near(spans, i).rlike(METRIC), count(s)))))
    both = F.arrays_zip(tx.places(text, ADJECTIVE).alias("place"), tx.let(tx.sentence_spans(marked), loose).alias("loose"))
    own = F.transform(F.filter(both, lambda x: x["loose"]), lambda x: x["place"])
    return F.when(text.rlike(ADJECTIVE), own).otherwise(F.slice(tx.places(text, ADJECTIVE), 1, 0))


def connectives(text: Column) -> Column:
    """Rule 5: paragraphs that open three sentences or more with a connector."""
    own = F.transform(F.split(text, PARAGRAPH), lambda p: tx.every(p, CONNECTIVE, 1))
    return F.transform(F.filter(own, lambda h: F.size(h) >= 3), lambda h: F.array_join(h, ", "))


def nominals(text: Column) -> Column:
    """Rule 7: sentences of three nominalisations or more; their first four."""
    own = F.transform(tx.sentence_spans(text), lambda s: tx.where_any(F.lower(s), CUES[7], tx.every(s, NOMINAL)))
    return F.transform(F.filter(own, lambda h: F.size(h) >= 3), lambda h: F.array_join(F.slice(h, 1, 4), ", "))


def hedges(text: Column) -> Column:
    """Rule 9: paragraphs with more than three hedges, or without support for one; the
    hedges, in the order of their list."""
    own = F.transform(F.split(text, PARAGRAPH), lambda p: F.struct(_hedges(p).alias("h"), p.rlike(SUPPORT).alias("ok")))
    return F.transform(F.filter(own, lambda x: _too_many(x["h"], x["ok"])), lambda x: F.array_join(x["h"], ", "))


def _hedges(paragraph: Column) -> Column:
    return F.concat(*[tx.every(F.lower(paragraph), rf"\b{h}\b") for h in HEDGES])


def _too_many(found: Column, supported: Column) -> Column:
    return (F.size(found) > 0) & ((F.size(found) > 3) | ~supported)


def dashes(text: Column) -> Column:
    """Rule 14: one finding for a text with more than three em dashes in 1000 words."""
    n = F.length(text) - F.length(F.replace(text, F.lit("—"), F.lit("")))
    words = F.greatest(F.size(tx.letter_words(text)), F.lit(1))
    finding = F.format_string("%d em dashes (%.2f/1000 words)", n, n * 1000.0 / words)
    return F.when((n > 0) & (n * 1000 > words * DASH_LIMIT), F.array(finding)).otherwise(F.array().cast("array<string>"))


def hits(text: Column | str = "text", only: list[int] | None = None) -> Column:
    """All findings of a text (of all rules, or of `only`), in one pass: an array of
    (rule, severity, match).  A null text is empty and has none.

    A rule reads a text only if the text holds what every match of it has; most texts
    hold this for few rules."""
    t = F.coalesce(tx.c(text), F.lit(""))
    own = dict((n, lambda t, n=n, p=p: _hits(t, n, p)) for n, _, p in PATTERNS)
    own |= {2: lambda t: F.transform(adjectives(t), lambda x: x["match"]), 5: connectives, 7: nominals, 9: hedges, 14: dashes}

    def finding(n: int):  # type: ignore[no-untyped-def]
        return lambda m: F.struct(F.lit(n).alias("rule"), F.lit(SEVERITY[n]).alias("severity"), tx.squeeze(m).alias("match"))

    asked = [n for n in sorted(own) if only is None or n in only]
    leads = [x for n in asked for x in LEADS.get(n, [])]

    def one(n: int, x: Column) -> Column:
        if n in LEADS:
            return F.when(tx.may_hold(x["led"], LEADS[n]), own[n](x["t"])).otherwise(F.array().cast("array<string>"))
        return tx.where_any(x["low"], CUES.get(n, []), own[n](x["t"]))

    def found(t: Column, low: Column) -> Column:
        led = tx.led_by(low, leads) if leads else F.lit("")
        return tx.let(F.struct(t.alias("t"), low.alias("low"), led.alias("led")), lambda x: F.concat(*[F.transform(one(n, x), finding(n)) for n in asked]))

    return tx.let(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: found(x["t"], x["low"]))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per finding: key, rule, severity, match."""
    return tx.unnest(docs, [key], hits(text), "h").select(key, "h.*")


def _at(place: Column, prefix: Column, match: Column) -> Column:
    """A finding whose place is behind `prefix`, which begins at `place`."""
    at = tx.after(place, prefix)
    return F.struct(match.alias("match"), at["start"].alias("start"), at["line"].alias("line"), at["column"].alias("column"))


def _connective_places(text: Column) -> Column:
    """Rule 5, at the first connector of the paragraph."""
    own = F.transform(tx.between(text, PARAGRAPH), lambda p: F.struct(p.alias("p"), tx.every(p["match"], CONNECTIVE, 1).alias("h")))
    head = lambda p: F.regexp_extract(p["match"], r"(?is)^((?:.*?(?<=[.!?])\s+)??)(?:Moreover|Furthermore|Additionally|However)", 1)
    return F.transform(F.filter(own, lambda x: F.size(x["h"]) >= 3), lambda x: _at(x["p"], head(x["p"]), F.array_join(x["h"], ", ")))


def _nominal_places(text: Column) -> Column:
    """Rule 7, at the beginning of the sentence, its blanks included."""
    own = F.transform(tx.places(text, SENTENCE), lambda s: F.struct(s.alias("s"), tx.every(s["match"], NOMINAL).alias("h")))
    return F.transform(F.filter(own, lambda x: F.size(x["h"]) >= 3), lambda x: _at(x["s"], F.lit(""), F.array_join(F.slice(x["h"], 1, 4), ", ")))


def _hedge_places(text: Column) -> Column:
    """Rule 9, where the first of the hedges found stands, be it part of a word."""
    own = F.transform(tx.between(text, PARAGRAPH), lambda p: F.struct(p.alias("p"), _hedges(p["match"]).alias("h"), p["match"].rlike(SUPPORT).alias("ok")))
    first = lambda x: F.array_min(F.transform(x["h"], lambda h: F.position(h, F.lower(x["p"]["match"]))))
    return F.transform(F.filter(own, lambda x: _too_many(x["h"], x["ok"])), lambda x: _at(x["p"], F.substring(x["p"]["match"], F.lit(1), first(x) - 1), F.array_join(x["h"], ", ")))


def _dash_places(text: Column) -> Column:
    """Rule 14, at the first dash."""
    origin = F.struct(F.lit(0).alias("start"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    return F.transform(dashes(text), lambda m: _at(origin, F.substring_index(text, "—", 1), m))


def located(docs: DataFrame, key: str = "doc_id", text: str = "text", only: list[int] | None = None) -> DataFrame:
    """Every finding of the rules (of all 14, or of `only`) with its start, line
    and column, from one scan.  A null or empty text has none; key stays as it is."""
    t = F.col(text)
    own = {n: tx.places(t, p) for n, _, p in PATTERNS}
    own[10] = F.filter(own[10], lambda x: ~x["match"].rlike(EVIDENCE) & ~x["match"].rlike(MECHANISM))
    own |= {2: adjectives(t), 14: _dash_places(t)}
    for n, quick, slow in ((5, connectives, _connective_places), (7, nominals, _nominal_places), (9, hedges, _hedge_places)):
        own[n] = F.when(F.size(quick(t)) > 0, slow(t)).otherwise(F.slice(own[1], 1, 0))

    def finding(n: int):  # type: ignore[no-untyped-def]
        return lambda x: F.struct(F.lit(n).alias("rule"), F.lit(SEVERITY[n]).alias("severity"), x["match"].alias("match"), x["start"].alias("start"), x["line"].alias("line"), x["column"].alias("column"))

    lists = [F.transform(own[n], finding(n)) for n in sorted(own) if only is None or n in only]
    return tx.unnest(docs.where(t.isNotNull()), [key], F.concat(*lists), "_f").select(key, "_f.*")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, RANK[s]) for n, s in SEVERITY.items()], "rule int, severity string, rank int")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", floor: str = "info", only: list[int] | None = None) -> DataFrame:
    """For each document all rules (or those of `only`) from the severity floor up,
    zeros included: hits and hits in 1000 letter words.  A null text is empty."""
    asked = {n: s for n, s in SEVERITY.items() if RANK[s] >= RANK[floor] and (only is None or n in only)}
    own = docs.select(key, F.size(tx.letter_words(F.coalesce(text, F.lit("")))).alias("words"), F.transform(hits(text, list(asked)), lambda h: h["rule"]).alias("r"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity")) for n, s in asked.items()])
    rows = own.select(key, "words", "r", F.explode(rules).alias("x")).select(key, "x.rule", "x.severity", "words", F.size(F.filter("r", lambda v: v == F.col("x.rule"))).alias("hits"))
    return rows.withColumn("density", F.col("hits") * 1000.0 / F.greatest("words", F.lit(1)))


def verdict(docs: DataFrame, exit_on: str = "block", max_density: float = 5.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Total hits and density, and whether the document passes both limits; a null or
    empty text passes."""
    rows = report(docs, key, text).groupBy(key).agg(F.first("words").alias("words"), F.sum("hits").alias("hits"), F.sum(F.when(F.col("severity").isin([s for s in RANK if RANK[s] >= RANK[exit_on]]), F.col("hits")).otherwise(0)).alias("severe"))
    density = F.col("hits") * 1000.0 / F.greatest("words", F.lit(1))
    return rows.select(key, "hits", "severe", ((F.col("severe") == 0) & (density <= max_density)).alias("passed"))


def phrase_hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    own = F.array(*[F.struct(F.lit(n).alias("phrase"), tx.every(text, p).alias("m")) for n, p in PHRASES])
    return docs.select(key, F.explode(own).alias("x")).select(key, "x.phrase", F.explode("x.m").alias("match"))


def ordered(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings numbered by place, then rule, within a document."""
    return found.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("line", "column", "rule")))
