"""Targets: screening, resolution, preflight and distance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: fixed values: metrics whose distance is measured; the active ratio only describes
METRICS = ["mean_sentence_length", "sentence_length_sd", "mean_paragraph_words", "paragraph_word_sd", "mean_sentences_per_paragraph", "alternation_index", "connective_density", "active_sentence_ratio", "passive_sentence_ratio", "first_person_per_1000_words", "hedges_per_1000_words"]
DESCRIPTIVE = ["active_sentence_ratio"]
PARAGRAPH = ["mean_paragraph_words", "paragraph_word_sd", "mean_sentences_per_paragraph"]
#: fixed values: dimensions of a target, their pass, metrics, and the rules that spoil them
DIMENSION_PASS = {"sentence_length": "P4", "paragraph_length": "P4", "opening_structure": "P4", "connectives": "P5", "hedging": "P5", "active_passive_by_section": "P6", "first_person": "P6"}
DIMENSION_METRICS = {"sentence_length": ["mean_sentence_length", "sentence_length_sd", "alternation_index"], "paragraph_length": PARAGRAPH, "opening_structure": [], "connectives": ["connective_density"], "active_passive_by_section": ["active_sentence_ratio", "passive_sentence_ratio"], "first_person": ["first_person_per_1000_words"], "hedging": ["hedges_per_1000_words"]}
DIMENSION_RULES = {"sentence_length": [6, 7, 8, 10, 12, 13, 14], "paragraph_length": [8], "opening_structure": [5, 6], "connectives": [5], "active_passive_by_section": [], "first_person": [], "hedging": [9], "claim_position": [1, 2, 3], "contribution_limitation_moves": [1, 2, 3]}
#: fixed values: what holds where no exemplar gives a value
RULE_VALUES = {
    "sentence_length": {"mean_range_words": [12, 30], "minimum_sd_words": 4.0},
    "paragraph_length": {"word_range": [40, 180], "sentences_per_paragraph": [2, 7]},
    "opening_structure": {},
    "connectives": {"maximum_per_sentence": 0.6},
    "hedging": {},
}
#: fixed values: the least sentences whose lengths are judged, and limits of the policy
MIN_SENTENCES, MIN_SD, DENSITY, MIN_WORDS = 4, 4.0, 0.6, 50


def _masked(rule_sourced: tuple[str, ...], passes: tuple[str, ...]) -> set[str]:
    return {m for d, p in DIMENSION_PASS.items() if d in rule_sourced or p not in passes for m in DIMENSION_METRICS[d]} | set(DESCRIPTIVE)


def distances(rows: DataFrame, key: str, rule_sourced: tuple[str, ...] = (), passes: tuple[str, ...] = ("P4", "P5", "P6")) -> DataFrame:
    """Rows with (before, output, target) structs of metrics; for each metric
    gaps to the target, convergence in percent, and one of five statuses.  Metrics
    count to four places.  Not eligible are metrics that only describe, those of
    paragraphs where a text has fewer than two, and those of dimensions whose target
    is a rule or whose pass did not run."""
    masked = _masked(rule_sourced, passes)
    value = lambda side, m: F.round(F.col(f"{side}.{m}").cast("double"), 4)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), value("before", m).alias("b"), value("output", m).alias("o"), value("target", m).alias("t")) for m in METRICS])
    few = reduce(lambda a, s: a | (F.col(f"{s}.paragraph_count") < 2), ["before", "output", "target"], F.lit(False))
    x = rows.select(key, few.alias("few"), F.explode(each).alias("x")).select(key, "few", "x.*")
    x = x.withColumn("gap_before", F.round(F.abs(F.col("b") - F.col("t")), 6)).withColumn("gap_output", F.round(F.abs(F.col("o") - F.col("t")), 6))
    gap = F.signum(F.col("gap_output") - F.col("gap_before"))
    status = F.when(F.col("gap_before") == 0, F.when(F.col("gap_output") > 0, "diverged_from_exact_match").otherwise("exact_match_preserved"))
    status = status.otherwise(F.when(gap < 0, "closer").when(gap > 0, "farther").otherwise("unchanged"))
    eligible = ~F.col("metric").isin(*masked) & ~(F.col("few") & F.col("metric").isin(PARAGRAPH))
    scale = F.greatest(F.abs("t"), F.lit(1.0))
    return x.select(key, "metric", status.alias("status"), eligible.alias("eligible"), F.when(F.col("gap_before") > 0, F.round((1 - F.col("gap_output") / F.col("gap_before")) * 100, 4)).alias("convergence"), (F.col("gap_before") / scale).alias("scaled_before"), (F.col("gap_output") / scale).alias("scaled_output"))


def structural(dist: DataFrame, key: str) -> DataFrame:
    """Eligible metrics of each case, those that came closer, and by how many percent
    the mean of the scaled gaps fell (null where it was zero)."""
    rows = dist.where("eligible").groupBy(key).agg(F.count("*").alias("eligible"), F.count_if(F.col("status") == "closer").alias("closer"), F.avg("scaled_before").alias("b"), F.avg("scaled_output").alias("o"))
    return rows.select(key, "eligible", "closer", F.when(F.col("b") > 0, F.round((1 - F.col("o") / F.col("b")) * 100, 4)).alias("convergence"))


def rule_convergence(counts: DataFrame, key: str) -> DataFrame:
    """Counts (key, rule, before, output, target): L1 distances over rules
    where before and target differ; a rule that left its target makes it worse."""
    initial, revised = F.abs(F.col("n_before") - F.col("n_target")), F.abs(F.col("n_output") - F.col("n_target"))
    rows = counts.groupBy(key).agg(F.sum(initial).alias("initial"), F.sum(F.when(initial > 0, revised).otherwise(0)).alias("revised"), F.count_if((initial == 0) & (revised > 0)).alias("off_target"))
    return rows.select(key, "initial", "revised", "off_target", _rule_status(F.col("initial"), F.col("revised"), F.col("off_target")).alias("status"))


def _rule_status(initial: Column, revised: Column, off_target: Column) -> Column:
    return F.when(off_target > 0, "worsened").when(initial == 0, "insufficient_signal").when(revised < initial, "improved").when(revised == initial, "unchanged").otherwise("worsened")


#: fixed values: statuses of a channel and of all
IMPROVED, UNCHANGED, WORSENED, NO_SIGNAL = "improved", "unchanged", "worsened", "insufficient_signal"


def structural_status(dist: DataFrame, key: str) -> DataFrame:
    """The structural channel: what the aggregate says; where all eligible metrics began
    at their targets, leaving them is worse, and staying is no signal."""
    rows = dist.where("eligible").groupBy(key).agg(F.count("*").alias("eligible"), F.avg("scaled_before").alias("b"), F.avg("scaled_output").alias("o"))
    convergence, status = _channel(F.col("b"), F.col("o"))
    return rows.select(key, "eligible", convergence.alias("convergence"), status.alias("structural"))


def _channel(before: Column, output: Column) -> tuple[Column, Column]:
    """Convergence and status from the mean scaled gaps of the eligible metrics."""
    convergence = F.when(before > 0, F.round((1 - output / before) * 100, 4))
    return convergence, F.when(convergence > 0, IMPROVED).when(convergence == 0, UNCHANGED).when(convergence < 0, WORSENED).when(output > 0, WORSENED).otherwise(NO_SIGNAL)


def overall(structural_: Column, rules_: Column) -> Column:
    """The channels together: one that improves and none that worsens; no evidence
    only where neither has a signal."""
    one = lambda s: (structural_ == s) | (rules_ == s)
    neither = (structural_ == NO_SIGNAL) & (rules_ == NO_SIGNAL)
    return F.when(one(WORSENED), F.when(one(IMPROVED), "mixed_or_worsened").otherwise("not_improved")).when(one(IMPROVED), IMPROVED).when(neither, "insufficient_evidence").otherwise("not_improved")


def evaluated(cases: DataFrame, key: str, rule_sourced: tuple[str, ...] = (), passes: tuple[str, ...] = ("P4", "P5", "P6"), content_stable: bool = True) -> DataFrame:
    """A20 to A22 as one verdict.  cases: key (unique; a null one has no row), before,
    output, target (texts).

    Each case is judged in its own row, from one scan of its texts: `counted` counts the
    paragraphs that differ, once each.  A case with a character that it doesn't know is
    counted by the expressions of the metrics and rules, which no other case runs.
    What must be kept is held between before and output, and between before and target
    (without that, or if nobody confirmed that the content is stable, a claim of efficacy
    is not valid).  A text without prose has no metrics, and its case no structural
    signal."""
    from . import counted, fingerprint, rules
    from . import markers as mk

    sides = ("before", "output", "target")
    masked = _masked(rule_sourced, passes)
    rows = cases.where(F.col(key).isNotNull()).select(key, *[F.coalesce(s, F.lit("")).alias(s) for s in sides])
    rows = rows.withColumn("_n", counted.cases(*sides))
    known = F.size("_n") > 2

    def by_expressions(text: Column) -> Column:
        n = lambda h, r: F.size(F.filter(h, lambda x: x["rule"] == r)).cast("double")
        return F.concat(fingerprint.summed(text), tx.let(rules.hits(text), lambda h: F.array(*[n(h, r) for r in counted.RULES])))

    others = F.flatten(F.transform(F.array(*sides), by_expressions))
    flag = lambda k: F.get("_n", F.lit(k)) == 1
    same = lambda s: (F.col(s) == F.col("before")) | (F.array_sort(mk.numbers(s)) == F.array_sort(mk.numbers("before")))
    kept = [(flag(k) & (known | same(s))).alias(f"{s}_kept") for k, s in enumerate(sides[1:])]
    rows = rows.select(key, F.when(known, F.slice("_n", 3, 3 * counted.WIDTH)).otherwise(others).alias("_n"), *kept)

    # plain sums over metrics and rules: functions of small arrays cost more than the texts
    count = lambda k, at: F.get("_n", F.lit(k * counted.WIDTH + at))
    metrics = [fingerprint.from_sums(lambda at, k=k: count(k, at)) for k in range(3)]
    gap = lambda x, t: F.round(F.abs(x - t), 6) / F.greatest(F.abs(t), F.lit(1.0))
    total = lambda xs: reduce(lambda a, x: a + x, xs)
    paragraphs = F.least(*[x["paragraph_count"] for x in metrics])
    prose = [F.when(paragraphs > 0, F.round(x[m].cast("double"), 4)).alias(f"_{s}_{m}") for s, x in zip(sides, metrics) for m in METRICS if m not in masked]
    per_rule = [(F.abs(count(0, at) - count(2, at)), F.abs(count(1, at) - count(2, at))) for at in range(len(counted.SUMS), counted.WIDTH)]
    rows = rows.select(
        key, *[f"{s}_kept" for s in sides[1:]], *prose, paragraphs.alias("_paragraphs"),
        total([i for i, _ in per_rule]).cast("bigint").alias("rule_initial"),
        total([F.when(i > 0, r).otherwise(0.0) for i, r in per_rule]).cast("bigint").alias("rule_revised"),
        total([F.when((i == 0) & (r > 0), 1).otherwise(0) for i, r in per_rule]).cast("bigint").alias("off_target"),
    )

    # metrics of paragraphs count where each text has two, none where one has no prose
    here = {m: F.col("_paragraphs") > (1 if m in PARAGRAPH else 0) for m in METRICS if m not in masked}
    gaps = lambda s: total([F.lit(0.0), *[F.when(ok, gap(F.col(f"_{s}_{m}"), F.col(f"_target_{m}"))).otherwise(0.0) for m, ok in here.items()]])
    rows = rows.withColumns({"eligible": total([F.lit(0), *[ok.cast("int") for ok in here.values()]]).cast("bigint"), "_b": gaps("before"), "_o": gaps("output")})
    mean = lambda c: F.when(F.col("eligible") > 0, F.col(c) / F.col("eligible"))
    convergence, structural_ = _channel(mean("_b"), mean("_o"))
    rows = rows.withColumns({"convergence": convergence, "structural": structural_})
    rows = rows.withColumn("rules", _rule_status(F.col("rule_initial"), F.col("rule_revised"), F.col("off_target")))
    status = overall(F.col("structural"), F.col("rules"))
    improved = F.when(status == IMPROVED, F.lit(True)).when(status != "insufficient_evidence", F.lit(False))
    valid = F.col("output_kept") & F.col("target_kept") & F.lit(content_stable)
    return rows.select(key, "eligible", "convergence", "structural", "rule_initial", "rule_revised", "off_target", "rules", status.alias("status"), improved.alias("improved"), "output_kept", "target_kept", valid.alias("valid"))


#: fixed values: what a text may fail of a target; the first two begin with P4_RULE_ or
#: P4_TARGET_, by the source of the field
TRIGGERS = {
    "mean": "SENTENCE_MEAN_OUT_OF_RANGE", "sd": "SENTENCE_SD_LOW", "words": "P4_PARAGRAPH_WORDS_OUT_OF_RANGE", "sentences": "P4_PARAGRAPH_SENTENCES_OUT_OF_RANGE",
    "openings": "P4_OPENING_DIVERSITY_LOW", "policy": "P5_CONNECTIVE_DENSITY_ABOVE_POLICY", "limit": "P5_CONNECTIVE_DENSITY_ABOVE_LIMIT", "hedges": "P5_HEDGE_DENSITY_ABOVE_LIMIT", "layers": "P5_HEDGE_LAYER_COUNT_ABOVE_LIMIT",
}


def triggers(value: Callable[[str, str], Column], known: Callable[[str], Column], ruled: Callable[[str], Column]) -> list[Column]:
    """What fields of a target ask for, each as a name where it is not met.
    value(field, path): a number of the field, null if absent; known(field): whether the
    field is there; ruled(field): whether its value is a rule."""
    enough, many = F.col("sentence_count") >= MIN_SENTENCES, F.col("paragraph_count") > 1
    outside = lambda metric, f, name: ~F.round(metric, 4).between(value(f, f"$.{name}[0]"), value(f, f"$.{name}[1]"))
    by = F.when(ruled("sentence_length"), "P4_RULE_").otherwise("P4_TARGET_")
    limit = value("connectives", "$.maximum_per_sentence")
    asked = [
        (F.concat(by, F.lit(TRIGGERS["mean"])), enough & outside("mean_sentence_length", "sentence_length", "mean_range_words")),
        (F.concat(by, F.lit(TRIGGERS["sd"])), enough & (F.round("sentence_length_sd", 4) < value("sentence_length", "$.minimum_sd_words")) & (F.col("opening_type_count") <= 1)),
        (F.lit(TRIGGERS["words"]), many & outside("mean_paragraph_words", "paragraph_length", "word_range")),
        (F.lit(TRIGGERS["sentences"]), many & outside("mean_sentences_per_paragraph", "paragraph_length", "sentences_per_paragraph")),
        (F.lit(TRIGGERS["openings"]), many & (F.col("paragraph_opening_type_count") < value("opening_structure", "$.minimum_distinct_types"))),
        (F.when(limit.isNull(), TRIGGERS["policy"]).otherwise(TRIGGERS["limit"]), known("connectives") & (F.round("connective_density", 4) > F.coalesce(limit, F.lit(DENSITY)))),
        (F.lit(TRIGGERS["hedges"]), F.round("hedges_per_1000_words", 4) > value("hedging", "$.maximum_per_1000_words")),
        (F.lit(TRIGGERS["layers"]), F.col("max_hedges_in_sentence") > value("hedging", "$.maximum_layers_per_sentence")),
    ]
    return [F.when(F.coalesce(missed, F.lit(False)), name) for name, missed in asked]


def decided(rows: DataFrame, found: DataFrame, asked: list[Column], key: str) -> DataFrame:
    """The triggers of metrics and rule hits, in order of their names; revise
    if there is any."""
    name = F.concat(F.lit("P5_AI_R"), F.lpad(F.col("rule").cast("string"), 2, "0"))
    hits = found.groupBy(key).agg(F.collect_set(name).alias("rules"))
    rows = rows.join(hits, key, "left")
    every = F.array_sort(F.concat(F.array_compact(F.array(*asked)), F.coalesce("rules", F.array().cast("array<string>"))))
    return rows.select(key, F.array_join(every, ",").alias("triggers"), F.when(F.size(every) > 0, "revise").otherwise("preserve").alias("decision"))


def preflight(measured: DataFrame, found: DataFrame, key: str = "doc_id", fields: dict[str, dict] = RULE_VALUES, from_rules: frozenset[str] | None = None) -> DataFrame:
    """A17 to A19 against one set of fields for all texts.  from_rules: the fields whose
    value is a rule (None: all)."""

    def value(field: str, path: str) -> Column:
        name, _, at = path.removeprefix("$.").partition("[")
        own = fields.get(field, {}).get(name)
        return F.lit(own[int(at[0])] if at and own is not None else own).cast("double")

    return decided(measured, found, triggers(value, lambda f: F.lit(f in fields), lambda f: F.lit(from_rules is None or f in from_rules)), key)


def screening(measured: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each dimension, whether a text can serve as exemplar, and if not, why.
    found: findings of the rules (key, rule)."""
    r4 = lambda c: F.round(c, 4)
    thin = {
        "sentence_length": ("sentence sample or variance below policy threshold", (F.col("sentence_count") < MIN_SENTENCES) | (r4("sentence_length_sd") < MIN_SD)),
        "paragraph_length": ("fewer than 2 paragraphs", F.col("paragraph_count") < 2),
        "opening_structure": ("fewer than 2 paragraphs with 2 distinct paragraph-opening types", F.least("paragraph_count", "paragraph_opening_count", "paragraph_opening_type_count") < 2),
        "connectives": ("connective density exceeds policy threshold", r4("connective_density") > DENSITY),
        "active_passive_by_section": ("too few sentences for a voice ratio", F.col("sentence_count") < MIN_SENTENCES),
        "first_person": (f"fewer than {MIN_WORDS} words", F.col("word_count") < MIN_WORDS),
        "hedging": ("no hedge observation", F.col("max_hedges_in_sentence") == 0),
        "claim_position": ("no claim-position observation", F.col("claim_sentence_count") == 0),
        "contribution_limitation_moves": ("no contribution or limitation move observed", F.col("contribution_move_count") + F.col("limitation_move_count") == 0),
    }
    hits = found.groupBy(key).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    rows = measured.join(hits, key, "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<int>")))

    def dimension(name: str) -> Column:
        hit = F.array_intersect("rules", F.array(*[F.lit(n) for n in DIMENSION_RULES[name]]).cast("array<int>"))
        spoiled = F.when(F.size(hit) > 0, F.concat(F.lit("AI-tell rules hit: ["), F.array_join(F.transform(hit, lambda n: n.cast("string")), ", "), F.lit("]")))
        why, short = thin[name]
        return F.struct(F.lit(name).alias("dimension"), F.array_compact(F.array(spoiled, F.when(short, F.lit(why)))).alias("why"))

    each = rows.select(key, F.explode(F.array(*[dimension(n) for n in DIMENSION_RULES])).alias("x")).select(key, "x.*")
    clean = F.size("why") == 0
    return each.select(key, "dimension", F.when(clean, "exemplar").otherwise("rule").alias("source"), F.when(clean, "clean and sufficiently observed").otherwise(F.array_join("why", "; ")).alias("reason"))


def preserved(cases: DataFrame, key: str) -> DataFrame:
    """Cases whose input already equals their target (before, output, target,
    frozen: whether the guard passed, changes: how many the report names): whether
    nothing was harmed.  Cases that are not of this kind give no row."""
    rows = cases.where(tx.canonical("before") == tx.canonical("target"))
    same = tx.canonical("output") == tx.canonical("before")
    return rows.select(key, same.alias("exact"), "frozen", (F.col("changes") == 0).alias("none_reported"), (same & F.col("frozen") & (F.col("changes") == 0)).alias("preserved"))


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each series, ties by lower-cased path."""
    return versions.groupBy("series").agg(F.max_by("path", F.struct("stage", F.lower("path"))).alias("path"))


def valid_range(low: Column, high: Column) -> Column:
    """A finite, ordered, non-negative range."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    return F.coalesce(fine(low) & fine(high) & (low <= high), F.lit(False))


#: fixed value: a line that sums up a pass, behind its tag
TRAILER = r"(.+?) §(.+?) · (P[1-7](?:[ \t]*→[ \t]*P[1-7])*) · (\d+)处 · frozen:(0变化|\d+处告警) · baseline:(ok|thin\(n=\d+\)|none) · target:(ok|partial|none)(?: · (sample:too-short))?(?: · (⬆\d+ upstream))?"
TRAILER_FIELDS = ["project", "section", "passes", "changes", "frozen", "baseline", "target", "sample", "upstream"]


def trailer(line: Column | str, tag: str) -> Column:
    """The fields of a trailer, `[tag]` first, without blanks around the arrows;
    null if the line, ends trimmed, is no trailer; an absent last field is null."""
    pattern = rf"^\[\Q{tag}\E\] {TRAILER}$"
    text = F.trim(F.col(line) if isinstance(line, str) else line)
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    own = {name: part(k) for k, name in enumerate(TRAILER_FIELDS, 1)}
    own["passes"] = F.regexp_replace(own["passes"], r"[ \t]*→[ \t]*", "→")
    return F.when(text.rlike(pattern), F.struct(*[v.alias(k) for k, v in own.items()]))


def _number(value: Column, path: str, low: float = 0.0, high: float | None = None) -> Column:
    """Whether there is a number, not a text or a truth value, within the bounds."""
    x = F.try_variant_get(value, path, "double")
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (x >= low) & (F.lit(True) if high is None else x <= high), F.lit(False))


def _pair(value: Column, path: str, low: float = 0.0) -> Column:
    two = F.size(F.try_variant_get(value, path, "array<variant>")) == 2
    a, b = (F.try_variant_get(value, f"{path}[{k}]", "double") for k in (0, 1))
    return F.coalesce(two & _number(value, f"{path}[0]", low) & _number(value, f"{path}[1]", low) & (a <= b), F.lit(False))


def _is(value: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")).startswith(kind), F.lit(False))


def valid_field(field: Column | str, source: Column | str, value: Column | str) -> Column:
    """Whether a profile field's value (VARIANT) has the shape of its field and
    source (rule or exemplar).  False for null, another field, source or shape."""
    field, source, v = (F.col(x) if isinstance(x, str) else x for x in (field, source, value))
    members = F.try_variant_get(v, "$", "map<string,variant>")
    each = lambda test: F.coalesce((F.cardinality(members) > 0) & F.forall(F.map_values(members), test), F.lit(False))
    ratios = lambda x: _number(x, "$.active_ratio", 0, 1) & _number(x, "$.passive_ratio", 0, 1)
    policy = F.coalesce(_is(v, "$.policy", "STRING") & (F.trim(F.try_variant_get(v, "$.policy", "string")) != ""), F.lit(False))
    lengths = _pair(v, "$.mean_range_words", 1) & _number(v, "$.minimum_sd_words")
    allowed = F.try_variant_get(v, "$.allowed", "array<variant>")
    texts = F.coalesce(F.forall(allowed, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    tests = {
        ("sentence_length", "rule"): lengths,
        ("paragraph_length", "rule"): _pair(v, "$.word_range", 1) & _pair(v, "$.sentences_per_paragraph", 1),
        ("connectives", "rule"): _number(v, "$.maximum_per_sentence") & F.coalesce(F.map_contains_key(members, "allowed"), F.lit(False)),
        **{(x, "rule"): policy for x in ("opening_structure", "active_passive_by_section", "first_person", "hedging", "claim_position", "contribution_limitation_moves")},
        ("sentence_length", "exemplar"): lengths & _is(v, "$.distribution", "OBJECT"),
        ("paragraph_length", "exemplar"): _number(v, "$.mean_words") & _number(v, "$.word_sd") & _number(v, "$.mean_sentences"),
        ("opening_structure", "exemplar"): each(lambda x: _number(x, "$", 0, 1)),
        ("connectives", "exemplar"): _number(v, "$.density_per_sentence") & texts,
        ("active_passive_by_section", "exemplar"): each(ratios),
        ("first_person", "exemplar"): _number(v, "$.per_1000_words"),
        ("hedging", "exemplar"): _number(v, "$.per_1000_words") & _number(v, "$.maximum_layers_per_sentence"),
        ("claim_position", "exemplar"): _number(v, "$.mean_normalized_position", 0, 1) & _number(v, "$.observations") & _is(v, "$.per_paragraph", "ARRAY"),
        ("contribution_limitation_moves", "exemplar"): _number(v, "$.contribution_move_count") & _number(v, "$.limitation_move_count") & F.coalesce(F.try_variant_get(v, "$.form_only", "boolean") & _is(v, "$.form_only", "BOOLEAN"), F.lit(False)),
    }
    return F.coalesce(reduce(lambda out, x: F.when((field == x[0][0]) & (source == x[0][1]), x[1]).otherwise(out), tests.items(), F.lit(False)), F.lit(False))
