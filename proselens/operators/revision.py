"""What a revision changed: multiset differences, moves by ordinal, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import markers as mk

#: terms that the registered queries protect
TERMS = ["bootstrapping", "ciphertext", "key-switching", "FHE"]
IMMUTABLE = {"numbers_units": mk.unit_numbers, "latex_keys": mk.reference_families, "math": mk.math_canonical, "glossary_terms": lambda t: mk.term_counts(t, TERMS), "claims": mk.claims}
#: categories of the guard that are counted over whole texts
GUARD = {"numbers": mk.numbers, "references": mk.references, "math": mk.math, "terms": lambda t: mk.term_counts(t, TERMS)}

#: fixed values: ladders of claim strength, weakest first, and their anchors
LADDERS = {
    "claim": [["may", "might"], ["suggests", "suggest", "suggested", "indicates", "indicate", "indicated"], ["shows", "show", "showed", "shown"], ["demonstrates", "demonstrate", "demonstrated"], ["establishes", "establish", "established"], ["proves", "prove", "proved", "proven"]],
    "quantity": [["some"], ["many"], ["most"], ["all"]],
    "frequency": [["often"], ["usually"], ["always"]],
}
CRYPTO = {
    "adversary_model": [["semi-honest", "honest-but-curious"], ["malicious"]],
    "security_adaptivity": [["selective"], ["adaptive"]],
    "security_indistinguishability": [["IND-CPA"], ["IND-CCA"], ["IND-CCA2"]],
    "corruption": [["static corruption"], ["adaptive corruption"]],
    "privacy_guarantee": [["computational"], ["statistical"], ["perfect"]],
    "scheme_scope": [["somewhat homomorphic encryption"], ["leveled homomorphic encryption"], ["fully homomorphic encryption"]],
    "exactness": [["approximate"], ["exact"]],
    "leakage": [["bounded leakage"], ["no leakage"]],
}
ANCHORS = {
    "security_adaptivity": ["security", "secure", "adversary", "corruption", "notion", "chosen-message", "chosen-ciphertext", "soundness", "simulation"],
    "privacy_guarantee": ["privacy", "security", "secrecy", "indistinguishability", "hiding", "binding", "zero-knowledge", "soundness", "correctness"],
    "exactness": ["arithmetic", "homomorphic", "encryption", "computation", "evaluation", "result", "scheme", "HE", "CKKS", "BFV", "BGV", "TFHE"],
}
#: fixed values: opposite comparisons, and the words that weaken or bound a claim
COMPARISONS = {"performance": (["outperforms", "outperform", "outperformed"], ["underperforms", "underperform", "underperformed"]), "magnitude": (["higher", "greater", "larger"], ["lower", "less", "smaller"]), "speed": (["faster"], ["slower"]), "quality": (["better", "superior"], ["worse", "inferior"])}
NEGATION = r"(?i)\b(?:not|no|never|without|neither|nor|none|cannot|can['’]t|(?:is|are|was|were|do|does|did|has|have|had|would|should|could|might|must|need)n['’]t)\b"
MODAL = r"(?i)\b(?:may|might|could|can|should|would)\b"
QUALIFIER = r"(?i)\b(?:under\s+(?:the\s+)?[A-Za-z][A-Za-z-]*(?:\s+[A-Za-z][A-Za-z-]*){0,3}\s+assumption|in\s+(?:the\s+)?[A-Za-z][A-Za-z-]*(?:\s+[A-Za-z][A-Za-z-]*){0,3}\s+setting)\b"


def differences(pairs: DataFrame, extractors: dict = IMMUTABLE) -> DataFrame:
    """Values with a count that changed: removed and added."""
    rows = mk.long_form(pairs, extractors)
    return rows.select("pair_id", "category", "value", F.greatest(F.col("before") - F.col("after"), F.lit(0)).alias("removed"), F.greatest(F.col("after") - F.col("before"), F.lit(0)).alias("added")).where("removed + added > 0")


def category_report(diff: DataFrame, key: str = "pair_id") -> DataFrame:
    """Sorted lists of what went and came, pairs by place, and the number of
    violations: the longer list's length."""
    repeat = lambda n: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("value", F.col(n).alias("k")))), lambda x: F.array_repeat(x["value"], x["k"].cast("int"))))
    rows = diff.groupBy(key, "category").agg(repeat("removed").alias("gone"), repeat("added").alias("came"))
    n = F.least(F.size("gone"), F.size("came"))
    changed = F.zip_with(F.slice("gone", F.lit(1), n), F.slice("came", F.lit(1), n), lambda a, b: F.concat(a, F.lit(" -> "), b))
    return rows.select(key, "category", F.array_join("gone", "|").alias("removed"), F.array_join("came", "|").alias("added"), F.array_join(changed, "|").alias("changed"), F.greatest(F.size("gone"), F.size("came")).alias("violations"))


def _figures(pairs: DataFrame, make) -> DataFrame:  # type: ignore[no-untyped-def]
    """Differences of figures and tables, as rows of `differences`."""
    side = lambda s: make(pairs, "pair_id", s).select("pair_id", F.lit(s).alias("side"), F.lit("figures").alias("category"), "value")
    rows = mk.counted(side("before").unionByName(side("after")))
    return rows.select("pair_id", "category", "value", F.greatest(F.col("before") - F.col("after"), F.lit(0)).alias("removed"), F.greatest(F.col("after") - F.col("before"), F.lit(0)).alias("added")).where("removed + added > 0")


def immutable_differences(pairs: DataFrame) -> DataFrame:
    """All six categories."""
    return differences(pairs).unionByName(_figures(pairs, mk.figures))


def immutable_verdict(pairs: DataFrame) -> DataFrame:
    """Violations over all categories, zero for pairs without any."""
    own = category_report(immutable_differences(pairs)).groupBy("pair_id").agg(F.sum("violations").alias("violations"))
    return pairs.select("pair_id").join(own, "pair_id", "left").select("pair_id", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.col("violations").isNull().alias("passed"))


def _verdict(pairs: DataFrame, failed: DataFrame, allow: list[str] | None) -> DataFrame:
    own = failed.groupBy("pair_id").agg(F.array_sort(F.collect_set("category")).alias("failed"))
    out = pairs.select("pair_id").join(own, "pair_id", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    blocking = F.array_except("failed", F.array(*[F.lit(x) for x in ["terms", *(allow or [])]]))
    return out.select("pair_id", F.array_join("failed", ",").alias("failed"), (F.size(blocking) == 0).alias("passed"))


def frozen_verdict(pairs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """J4 without claims: categories that differ; terms are reported but do not fail."""
    return _verdict(pairs, differences(pairs, GUARD).unionByName(_figures(pairs, mk.guard_figures)), allow)


def guard_verdict(pairs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Nine categories that block (numbers, references, math, figures, and five
    classes of claim markers within aligned scopes), and terms, which are reported."""
    from . import relocation  # it uses what stands here

    claims = relocation.scoped_differences(pairs, once=("claim_strength",)).select("pair_id", F.substring_index("value", ":", 1).alias("category"))
    own = differences(pairs, GUARD).unionByName(_figures(pairs, mk.guard_figures)).select("pair_id", "category")
    return _verdict(pairs, own.unionByName(claims), allow)


def figure_differences(pairs: DataFrame) -> DataFrame:
    """Labels and captions of figures and tables that changed."""
    side = lambda s: mk.figures(pairs, "pair_id", s).select("pair_id", F.lit(s).alias("side"), F.lit("figures").alias("category"), "value")
    rows = mk.counted(side("before").unionByName(side("after")))
    return rows.select("pair_id", "value", F.col("before").alias("n_before"), F.col("after").alias("n_after"))


def _alternation(forms: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(sorted(forms, key=lambda f: (-len(f), f))) + r")\b"


def occurrences(pairs: DataFrame, ladders: dict[str, list[list[str]]], side: str, anchored: bool = False) -> DataFrame:
    """pair_id, ladder, ordinal, match, level, start, anchored; all ladders in one
    plan.  With `anchored`, ladders that have anchors keep only words with one at
    most two words away and no punctuation between."""
    none = F.array().cast("array<struct<match:string,start:int,line:int,column:int>>")

    own = {name: [w for t in tiers for w in t] for name, tiers in ladders.items()}

    def found(led: Column) -> Column:
        each = F.array(*[F.struct(F.lit(name).alias("ladder"), F.when(tx.may_hold(led, forms), tx.places(side, _alternation(forms))).otherwise(none).alias("hits")) for name, forms in own.items()])
        return F.filter(each, lambda x: F.size(x["hits"]) > 0)

    rows = tx.unnest(pairs, ["pair_id", side], tx.let(tx.led_by(F.lower(side), [w for forms in own.values() for w in forms]), found), "x")
    rows = tx.unnest(rows, ["pair_id", side, "x.ladder"], "x.hits", "h").select("pair_id", side, "ladder", "h.match", "h.start")
    level, ok = F.lit(None).cast("int"), F.lit(True)
    for name, tiers in ladders.items():
        mine = F.col("ladder") == name
        level = reduce(lambda c, x: F.when(mine & F.lower("match").isin([w.lower() for w in x[1]]), x[0]).otherwise(c), list(enumerate(tiers)), level)
        if name in ANCHORS:
            ok = F.when(mine, near_anchor(F.col(side), F.col("match"), F.col("start"), ANCHORS[name])).otherwise(ok)
    out = rows.select("pair_id", "ladder", "match", level.alias("level"), "start", ok.alias("anchored"))
    if anchored:
        out = out.where("anchored")
    by = W.partitionBy("pair_id", "ladder").orderBy("start")
    return out.withColumn("ordinal", F.row_number().over(by))


def near_anchor(text: Column, match: Column, start: Column, anchors: list[str]) -> Column:
    """Whether an anchor is one of the two words on either side, in the same run
    of words without punctuation."""
    word = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
    low, high = [a for a in anchors if not a.isupper()], [a for a in anchors if a.isupper()]
    any_of = "|".join([f"(?i:{a})" for a in low] + high)
    left = F.substring(text, F.lit(1), start)
    right = F.substring(text, start + F.length(match) + 1, F.length(text))
    before = left.rlike(rf"(?:^|[^A-Za-z0-9-])(?:{any_of})(?:\s+{word})?\s+$")
    after = right.rlike(rf"^\s+(?:{word}\s+)?(?:{any_of})(?![A-Za-z0-9-])")
    return before | after


def moves(pairs: DataFrame, ladders: dict[str, list[list[str]]] = LADDERS, anchored: bool = False) -> DataFrame:
    """The n-th old word against the n-th new one; what has no partner is
    left out."""
    return _moved(occurrences(pairs, ladders, "before", anchored), occurrences(pairs, ladders, "after", anchored))


def _moved(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.alias("o").join(new.alias("n"), ["pair_id", "ladder", "ordinal"])
    return both.where("n.level <> o.level").select("pair_id", "ladder", "ordinal", F.lower("o.match").alias("original"), F.lower("n.match").alias("revised"), (F.col("n.level") - F.col("o.level")).alias("span"))


def _levels(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("pair_id", "ladder").agg(F.array_sort(F.collect_list("level")).alias(name))


def crypto_moves(pairs: DataFrame) -> DataFrame:
    """Moves on all eight ladders, words next to their anchors only.  Where both
    sides hold each level equally often nothing moved: at most, words changed place."""
    old, new = (occurrences(pairs, CRYPTO, side, True) for side in ("before", "after"))
    same = _levels(old, "a").join(_levels(new, "b"), ["pair_id", "ladder"]).where("a = b").select("pair_id", "ladder")
    return _moved(old, new).join(same, ["pair_id", "ladder"], "left_anti")


def candidates(pairs: DataFrame) -> DataFrame:
    """Upward moves of anchored ladders without an anchor on both sides."""
    own = {k: v for k, v in CRYPTO.items() if k in ANCHORS}
    both = occurrences(pairs, own, "before").alias("o").join(occurrences(pairs, own, "after").alias("n"), ["pair_id", "ladder", "ordinal"])
    return both.where("n.level > o.level and not (o.anchored and n.anchored)").select("pair_id", "ladder", F.lower("o.match").alias("original"), F.lower("n.match").alias("revised"))


def flips(pairs: DataFrame) -> DataFrame:
    """Comparisons whose direction turned, by ordinal."""
    signed = {k: [neg, pos] for k, (pos, neg) in COMPARISONS.items()}
    return moves(pairs, signed).select("pair_id", F.col("ladder").alias("group"), "ordinal", "original", "revised")


def removed_by_count(pairs: DataFrame, pattern: str, name: str) -> DataFrame:
    """The last k matches, where k is by how many their number fell."""
    n_after = F.size(tx.every("after", pattern))
    rows = tx.matches(pairs.withColumn("_k", F.size(tx.every("before", pattern)) - n_after).where("_k > 0"), "before", pattern, ["pair_id", "_k"])
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("pair_id").orderBy(F.desc("start"))))
    return rows.where("_r <= _k").select("pair_id", F.lit(name).alias("kind"), "match", "start")


def removed_by_token(pairs: DataFrame, pattern: str = QUALIFIER) -> DataFrame:
    """Occurrences of a phrase beyond those that the revision still has."""
    after = F.transform(tx.every("after", pattern), F.lower)
    rows = tx.matches(pairs.where(F.col("before").rlike(pattern)).withColumn("_after", after), "before", pattern, ["pair_id", "_after"])
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("pair_id", F.lower("match")).orderBy("start")))
    return rows.where(F.col("_r") > F.size(F.filter("_after", lambda x: x == F.lower(F.col("match"))))).select("pair_id", F.col("match"), "start")


def strength_verdict(pairs: DataFrame) -> DataFrame:
    """Upward moves, removed negations and modals, flips and removed qualifiers; a
    negation `no` that went with `no leakage` is let off once for each such move."""
    up = moves(pairs).where("span > 0").select("pair_id")
    crypto = crypto_moves(pairs)
    down = crypto.where("span < 0 and ladder = 'leakage' and original = 'no leakage'").groupBy("pair_id").agg(F.count("*").alias("spared"))
    gone = removed_by_count(pairs, NEGATION, "negation").groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(F.lower("match") == "no").alias("no"))
    gone = gone.join(down, "pair_id", "left").select("pair_id", (F.col("n") - F.least("no", F.coalesce("spared", F.lit(0)))).alias("n"))
    count = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    parts = [count(up, "upward"), gone.withColumnRenamed("n", "negations"), count(removed_by_count(pairs, MODAL, "modal"), "modals"), count(flips(pairs), "flips"), count(removed_by_token(pairs), "qualifiers"), count(crypto.where("span > 0"), "crypto_upward")]
    out = reduce(lambda a, b: a.join(b, "pair_id", "left"), parts, pairs.select("pair_id"))
    names = ["upward", "negations", "modals", "flips", "qualifiers", "crypto_upward"]
    out = out.select("pair_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in names])
    return out.withColumn("passed", reduce(lambda a, b: a + b, [F.col(x) for x in names]) == 0)
