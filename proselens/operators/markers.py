"""Markers that a revision must keep: numbers, references, mathematics, figures,
terms and claim classes, as multisets in long form."""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: fixed values: patterns of markers
NUMBER = r"(?U)(?<![\w.])\d+(?:\.\d+)?(?:\s*(?:%|[xX]|ms|s|GB|MB|KB|bits?))?(?![\w.])"
SI = r"\\SI\s*\{([^{}]+)\}\s*\{([^{}]+)\}"
UNIT_NUMBER = r"(?U)(?<![\w.])(\d+(?:\.\d+)?)\s*(%|ms|s|GB|MB|KB|bits?)(?![\w.])"
REFERENCE = r"\\(cite\w*|ref|autoref|eqref|cref|label)\s*(?:\[[^\]]*\]\s*)*\{([^{}]*)\}"
MATH_ENV = r"(?s)\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|displaymath|math)\}(.*?)\\end\{\1\}"
MATH = [r"(?s)\$\$(.*?)\$\$", r"(?s)\\\[(.*?)\\\]", r"(?s)\\\((.*?)\\\)", r"(?s)(?<!\\)\$(?!\$)((?:\\.|[^$])*?)(?<!\\)\$(?!\$)"]
FIGURE_ENV = r"(?s)\\begin\{(figure\*?|table\*?)\}(.*?)\\end\{\1\}"
LITERAL_REFERENCE = r"(?i)\b(?:Fig(?:ure)?|Table|Sec(?:tion)?|Eq(?:uation)?)\.?\s*\d+"
#: fixed values: classes of claim markers, word lists as patterns of a whole token or phrase
NEGATION = {"not": "not", "no": "no", "never": "never", "without": "without", "neither": "neither", "nor": "nor", "none": "none"}
MODALITY = {x: x for x in ("may", "might", "can", "could", "should", "would", "must", "will")}
QUANTIFIER = {"at_least": r"at\s+least", "at_most": r"at\s+most", "more_than": r"more\s+than", "less_than": r"less\s+than"} | {x: x for x in ("all", "any", "each", "every", "both", "either", "neither", "none", "some", "several", "many", "most", "few", "only", "no")}
COMPARISON = {"up": "higher|greater|larger|exceed(?:s|ed|ing)?", "down": "lower|smaller|less|fewer", "better": "better|faster|superior|outperform(?:s|ed|ing)?", "worse": "worse|slower|inferior", "relation": r"than|compared\s+(?:with|to)|relative\s+to"}
STRENGTH = {
    "possibility": "may|might|could|possibly|perhaps|potentially", "probability": "likely|probably|presumably", "improbability": "unlikely|improbably",
    "appearance": "appear(?:s|ed|ing)?|seem(?:s|ed|ing)?", "tentative": r"suggest(?:s|ed|ing)?|indicat(?:e|es|ed|ing)|conjectur(?:e|es|ed|ing)|consistent\s+with",
    "assertive": "show(?:s|ed|ing)?|demonstrat(?:e|es|ed|ing)|establish(?:es|ed|ing)?", "absolute": "prov(?:e|es|ed|en|ing)|guarantee(?:s|d|ing)?|ensur(?:e|es|ed|ing)",
    "universal": "always|never|necessarily", "maximal": "impossible|perfect|optimal",
}
CLASSES = {"negation": NEGATION, "modality": MODALITY, "quantifier_scope": QUANTIFIER, "comparison": COMPARISON, "claim_strength": STRENGTH}
HEDGED = ["possibility", "probability", "improbability", "appearance", "tentative"]
#: fixed values: words whose contraction with `not` is written out
WITH_NOT = ["is", "are", "was", "were", "does", "do", "did", "has", "have", "had", "would", "should", "could", "might", "must", "need"]
CONTRACTIONS = [(r"\bcannot\b|\bcan't\b", "can not"), (r"\bwon't\b", "will not"), (r"\bshan't\b", "shall not"), (r"\b(" + "|".join(WITH_NOT) + r")n't\b", "$1 not")]


#: up to the next dollar without a backslash; a group for each character would
#: overflow Java's stack on long texts
INLINE = r"(?<!\\)\$[^$]*+(?:(?<=\\)\$[^$]*+)*+(?<!\\)\$"


def prose(text: Column | str) -> Column:
    """Prose for claim markers: no LaTeX regions, lower case, contractions apart,
    and `not only` as one word."""
    drop = [r"(?<!\\)%[^\n]*", MATH_ENV, FIGURE_ENV, r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)", INLINE, REFERENCE, r"\\[A-Za-z@]+\*?"]
    has = lambda t, *parts: reduce(lambda a, p: a | F.contains(t, F.lit(p)), parts[1:], F.contains(t, F.lit(parts[0])))

    def plain(t: Column) -> Column:
        # what every pattern needs is sought first, as most texts have none of it
        t = F.when(has(t, "\\", "$", "%"), reduce(lambda t, p: F.regexp_replace(t, p, " "), drop, t)).otherwise(t)
        return F.lower(F.replace(t, F.lit("’"), F.lit("'")))

    def apart(t: Column) -> Column:
        return F.when(has(t, "n't", "cannot"), reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), CONTRACTIONS, t)).otherwise(t)

    def joined(t: Column) -> Column:
        return F.when(has(t, "only"), F.regexp_replace(t, r"\bnot\s+only\b", "not_only")).otherwise(t)

    return tx.let(tx.let(tx.let(tx.c(text), plain), apart), joined)


def numbers(text: Column | str) -> Column:
    return F.transform(tx.every(text, NUMBER), tx.squeeze)


def unit_numbers(text: Column | str) -> Column:
    """Numbers with units: \\SI first, then those in the rest of the text."""
    t = tx.c(text)
    return F.when(t.rlike(r"(?U)\d|\\SI"), _unit_numbers(t)).otherwise(F.array().cast("array<string>"))


def _unit_numbers(t: Column) -> Column:
    si = F.zip_with(tx.every(t, SI, 1), tx.every(t, SI, 2), lambda v, u: F.concat(F.lit("SI:"), tx.squeeze(v), F.lit(":"), tx.squeeze(u)))
    rest = F.regexp_replace(t, SI, " ")
    return F.concat(si, F.zip_with(tx.every(rest, UNIT_NUMBER, 1), tx.every(rest, UNIT_NUMBER, 2), lambda v, u: F.concat_ws(" ", v, tx.squeeze(u))))


def references(text: Column | str) -> Column:
    """command:key for each key of a reference command."""
    t = tx.c(text)
    keys = F.zip_with(tx.every(t, REFERENCE, 1), tx.every(t, REFERENCE, 2), lambda cmd, ks: F.transform(F.filter(F.transform(F.split(ks, ","), lambda x: F.trim(x)), lambda k: k != ""), lambda k: F.concat(cmd, F.lit(":"), k)))
    return F.flatten(keys)


def reference_families(text: Column | str) -> Column:
    """References with all cite commands as one family, and without cref."""
    own = F.transform(references(text), lambda r: F.regexp_replace(r, "^(?i)cite[^:]*:", "cite:"))
    return F.filter(own, lambda r: r.rlike("^(?:cite|ref|label|eqref|autoref):"))


def math(text: Column | str) -> Column:
    """Bodies of environments (with their name), then of the delimited kinds."""
    t = tx.c(text)
    none = F.array().cast("array<string>")
    return F.when(F.contains(t, F.lit("$")) | F.contains(t, F.lit("\\")), _math(t)).otherwise(none)


def _math(t: Column) -> Column:
    envs = F.zip_with(tx.every(t, MATH_ENV, 1), tx.every(t, MATH_ENV, 2), lambda n, b: F.concat(n, F.lit(":"), tx.squeeze(b)))
    rest = F.regexp_replace(t, MATH_ENV, " ")
    return F.concat(envs, *[F.transform(tx.every(rest, p, 1), tx.squeeze) for p in MATH])


def math_canonical(text: Column | str) -> Column:
    return F.transform(math(text), lambda m: F.regexp_replace(m, r"\s+", ""))


def arguments(body: str, command: str) -> list[str]:
    """Arguments of a command with braces counted, as no regular expression can."""
    found, marks = [], [(m.start(), m[0]) for m in re.finditer(r"(?<!\\)[{}]", body)]
    for head in re.finditer(rf"\\{command}\*?\s*(?:\[[^\]]*\]\s*)*\{{", body):
        sums = accumulate((1 if c == "{" else -1 for at, c in marks if at >= head.end()), initial=1)
        ends = [at for at, _ in marks if at >= head.end()]
        close = next((at for at, depth in zip(ends, islice(sums, 1, None)) if not depth), None)
        if close is not None:
            found.append(" ".join(body[head.end() : close].split()))
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def balanced(bodies: pd.Series, commands: pd.Series) -> pd.Series:
    return pd.Series([arguments(b, c) if b is not None else [] for b, c in zip(bodies, commands)])


def guard_figures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, value: labels and whole captions of figure and table environments."""
    envs = F.arrays_zip(tx.every(text, FIGURE_ENV, 1).alias("name"), tx.every(text, FIGURE_ENV, 2).alias("body"))
    rows = docs.where(F.col(text).rlike(FIGURE_ENV)).select(key, F.explode(envs).alias("e")).select(key, "e.name", "e.body", balanced("e.body", F.lit("caption")).alias("captions"))
    labels = F.transform(tx.every("body", r"\\label\s*\{([^{}]+)\}", 1), lambda x: F.concat(F.col("name"), F.lit(":label:"), F.trim(x)))
    whole = F.transform("captions", lambda x: F.concat(F.col("name"), F.lit(":caption:"), x))
    return rows.select(key, F.explode(F.concat(labels, whole)).alias("value"))


def figures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, value: labels, references and literal references of figure and table
    captions.  Only texts with such an environment reach Python."""
    envs = F.arrays_zip(tx.every(text, FIGURE_ENV, 1).alias("name"), tx.every(text, FIGURE_ENV, 2).alias("body"))
    rows = docs.where(F.col(text).rlike(FIGURE_ENV)).select(key, F.explode(envs).alias("e")).select(key, F.regexp_replace("e.name", r"\*$", "").alias("name"), "e.body")
    rows = rows.withColumn("captions", balanced("body", F.lit("caption")))
    labels = F.transform(tx.every("body", r"\\label\s*\{([^{}]+)\}", 1), lambda x: F.concat(F.col("name"), F.lit(":label:"), F.trim(x)))
    refs = F.flatten(F.transform("captions", lambda cap: F.transform(F.array_distinct(reference_families(cap)), lambda r: F.concat(F.col("name"), F.lit(":caption:"), r))))
    literal = F.flatten(F.transform("captions", lambda cap: F.transform(tx.every(cap, LITERAL_REFERENCE), lambda r: F.concat(F.col("name"), F.lit(":caption-literal:"), tx.squeeze(r)))))
    return rows.select(key, F.explode(F.concat(labels, refs, literal)).alias("value"))


def term_counts(text: Column | str, terms: list[str]) -> Column:
    """Each term as often as it stands as a whole token, any case."""
    t = tx.c(text)
    count = lambda x: F.regexp_count(t, F.lit(rf"(?i)(?<![A-Za-z0-9])\Q{x}\E(?![A-Za-z0-9])")).cast("int")
    return tx.let(F.lower(t), lambda low: F.flatten(F.array(*[F.when(F.contains(low, F.lit(x.lower())), F.array_repeat(F.lit(x), count(x))).otherwise(F.array().cast("array<string>")) for x in terms])))


def _forms(pattern: str) -> list[str]:
    """The words and phrases that a class pattern stands for."""
    out: list[str] = []
    for part in re.split(r"\|(?![^(]*\))", pattern.replace(r"\s+", " ")):
        m = re.fullmatch(r"([^(]*)\(\?:([^)]*)\)(\??)", part)
        out += [part] if not m else [m[1] + x for x in [*m[2].split("|"), *([""] if m[3] else [])]]
    return out


def claims(text: Column | str) -> Column:
    """kind:class for each claim marker in the prose of a text."""
    return tx.let(prose(text), prose_claims)


def prose_claims(t: Column) -> Column:
    """The same for what is prose already."""

    def named(kind: str, classes: dict[str, str]) -> Column:
        label = {f: f"{kind}:{'hedged' if name in HEDGED else name}" for name, p in reversed(list(classes.items())) for f in _forms(p)}
        known = F.create_map(*[F.lit(x) for kv in label.items() for x in kv])
        return F.transform(tx.every(t, r"\b(?:" + "|".join(classes.values()) + r")\b"), lambda m: known[tx.squeeze(m)])

    return F.concat(*[named(kind, classes) for kind, classes in CLASSES.items()])


def long_form(pairs: DataFrame, extractors: dict, key: str = "pair_id") -> DataFrame:
    """pair_id, category, value, before, after: how often each value stands on
    either side.  extractors: category to a function from text to an array."""

    each = [F.struct(F.lit(side).alias("side"), F.lit(cat).alias("category"), make(side).alias("values")) for side in ("before", "after") for cat, make in extractors.items()]
    rows = tx.unnest(tx.unnest(pairs, [key], F.array(*each), "x"), [key, "x.side", "x.category"], "x.values", "value")
    return counted(rows, key)


def counted(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    return rows.groupBy(key, "category", "value").agg(F.count_if(F.col("side") == "before").alias("before"), F.count_if(F.col("side") == "after").alias("after"))
