"""The registered queries, by the ids of the operators that they apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, project_queries, record_queries
from .functions import text as tx
from .operators import align, corpus, fingerprint, glossary, history, markers, revision, rules, targets, terms
from .plans import seed

S = SparkSession


def _docs(s: S, d: str) -> DataFrame:
    return seed.documents(s, d)


def _pairs(s: S, d: str) -> DataFrame:
    return seed.pairs(s, d)


def _report(s: S, d: str) -> DataFrame:
    return rules.report(_docs(s, d))


def _raw(s: S, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def _pages(s: S, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet")


def _turns(s: S, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("series"), F.col("turn").alias("stage"), F.coalesce("text", F.lit("")).alias("text"))


def _series(s: S, d: str) -> DataFrame:
    return _pairs(s, d).select(F.col("pair_id").alias("series"), F.lit(0).alias("stage"), "before", "after")


def _versions(s: S, d: str) -> DataFrame:
    """Both sides of the pairs as two stages."""
    rows = _pairs(s, d).select(F.col("pair_id").alias("series"), F.explode(F.array(F.struct(F.lit(0).alias("stage"), F.col("before").alias("text")), F.struct(F.lit(1).alias("stage"), F.col("after").alias("text")))).alias("x"))
    return rows.select("series", "x.stage", "x.text")


def _without_reserved(s: S, d: str) -> DataFrame:
    paras = _turns(s, d).select("series", "stage", F.posexplode(F.split("text", "\n")).alias("par_no", "p"))
    reserved = _turns(s, d).where("stage = 1").select("series", "stage", F.lit(0).alias("par_no"))
    return history.without_reserved(paras, reserved).select("series", "stage", "par_no", F.length("p").alias("size"))


def _rule_convergence(s: S, d: str) -> DataFrame:
    hits = lambda side: F.transform(rules.hits(side), lambda h: h["rule"])
    rows = _series(s, d).select("series", hits("before").alias("b"), hits("after").alias("a")).withColumn("rule", F.explode(F.array(*[F.lit(n) for n in rules.SEVERITY])))
    n = lambda x: F.size(F.filter(x, lambda v: v == F.col("rule")))
    return targets.rule_convergence(rows.select("series", "rule", n("b").alias("n_before"), n("a").alias("n_output"), (F.col("rule") % 3 == 0).cast("int").alias("n_target")), "series")


def _bibliography(s: S, d: str) -> DataFrame:
    """A registry of one row a conversation, with venues and notes of each kind."""
    one = s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.min("turn").alias("t"))
    k, of = F.col("conv_id"), lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), F.col("conv_id") % n)
    title = F.concat(of(3, "T", "the {map} ", "A\\B "), k.cast("string"))
    rows = one.select(title.alias("title"), of(4, "Journal X", "Workshop & Co", "USENIX", "arXiv").alias("venue"), (F.col("t") + 2000 + k % 20).cast("string").alias("year"), of(5, "doi=10.1/x; arxiv = 2001.1", "also_eprint=a=b;junk", "eprint=; also_eprint=7", "", None).alias("notes"), of(2, "maps", None).alias("direction"), of(7, "a; b", "", "", "", "", "", "").alias("secondary"))
    return corpus.bibliography(rows)


def _hashed_tokens(s: S, d: str) -> DataFrame:
    private = s.createDataFrame([("than",), ("license",), ("idiot",)], "t string").select(F.sha2("t", 256).alias("digest"))
    return corpus.hashed_hits(_raw(s, d), private)


def _removed(s: S, d: str) -> DataFrame:
    pairs = _pairs(s, d)
    kinds = [("modal", revision.MODAL), ("negation", revision.NEGATION)]
    out = [revision.removed_by_count(pairs, p, kind).select("pair_id", "kind", "match", "start") for kind, p in kinds]
    return out[0].unionByName(out[1])


def _baseline(s: S, d: str) -> DataFrame:
    measured = fingerprint.by_document(_docs(s, d)).join(_docs(s, d).select("doc_id", "source"), "doc_id")
    figures = [f"{m}_{x}" for m in fingerprint.BASELINE for x in ("mean", "sd")]
    return fingerprint.baseline(measured, "source").select("paper_count", "status", *[F.round(x, 6).alias(x) for x in figures])


def _rule_sets(s: S, d: str) -> DataFrame:
    have, want = _raw(s, d).select("lang").distinct(), s.createDataFrame([("en",), ("it",)], "lang string")
    return have.exceptAll(want).withColumn("side", F.lit("missing")).unionByName(want.exceptAll(have).withColumn("side", F.lit("extra")))


def _swapped(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", F.lit("").alias("before"), F.col("before").alias("after"))


def _pass_verdict(s: S, d: str) -> DataFrame:
    pairs, entries = _pairs(s, d), glossary.merged(glossary.layers(s))
    report = revision.category_report(revision.immutable_differences(pairs))
    return glossary.pass_verdict(report, terms.findings(pairs, entries), terms.findings(_swapped(pairs), entries, True), terms.findings(pairs, entries, True), pairs)


def _contract(s: S, d: str) -> DataFrame:
    """The four steps in order: immutable set, claim strength, terminology, and the
    scan of the rules on the revision.  The first that blocks is named; the scan only
    reports how many findings there are."""
    pairs, entries = _pairs(s, d), glossary.merged(glossary.layers(s))
    immutable = revision.immutable_verdict(pairs).select("pair_id", F.col("passed").alias("immutable"))
    strength = revision.strength_verdict(pairs).select("pair_id", F.col("passed").alias("strength"))
    worded = terms.findings(pairs, entries).where("kind <> 'case_inconsistency'").groupBy("pair_id").agg(F.count("*").alias("n"))
    scan = pairs.select("pair_id", F.size(rules.hits("after")).alias("findings"))
    rows = immutable.join(strength, "pair_id").join(scan, "pair_id").join(worded, "pair_id", "left")
    step = F.when(~F.col("immutable"), "immutable").when(~F.col("strength"), "strength").when(F.col("n") > 0, "terminology").otherwise("none")
    return rows.select("pair_id", step.alias("blocked_by"), (step == "none").alias("proceed"), "findings")


def _distances(s: S, d: str) -> DataFrame:
    pairs = _pairs(s, d)
    side = lambda x, name: fingerprint.by_document(pairs.select(F.col("pair_id").alias("doc_id"), F.col(x).alias("text"))).select("doc_id", F.struct("paragraph_count", *targets.METRICS).alias(name))
    goal = side("before", "target").select((F.col("doc_id") + 1).alias("doc_id"), "target")
    rows = side("before", "before").join(side("after", "output"), "doc_id").join(goal, "doc_id")
    return targets.distances(rows, "doc_id")


def _drift(s: S, d: str) -> DataFrame:
    measured = fingerprint.by_document(_docs(s, d)).join(_raw(s, d).select("doc_id", "source"), "doc_id")
    return fingerprint.compared(measured, fingerprint.baseline(measured, "source")).select("doc_id", "metric", "drift")


def _values(pairs: DataFrame, make) -> DataFrame:  # type: ignore[no-untyped-def]
    return pairs.select("pair_id", F.explode(make("before")).alias("value")).groupBy("pair_id", "value").agg(F.count("*").alias("n"))


def _one_rule(n: int):  # type: ignore[no-untyped-def]
    return lambda s, d: rules.report(_docs(s, d), only=[n]).where(F.col("hits") > 0).select("doc_id", "hits")


_RULES = {1: "importance", 2: "adjective", 3: "domain_phrase", 4: "filler", 5: "connectors", 6: "shell", 7: "nominals", 8: "paraphrase", 9: "hedges", 10: "participle", 11: "copula", 12: "not_only", 13: "triple", 14: "dashes"}

QUERIES = {
    "rule_density_by_doc": lambda s, d: _report(s, d).select("doc_id", "rule", "hits", "density"),
    "r16_rule_report": lambda s, d: rules.report(_docs(s, d), floor="warn"),
    "r16_verdict": lambda s, d: rules.verdict(_docs(s, d)),
    "a6_rule_totals": lambda s, d: _report(s, d).groupBy("rule", "severity").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("docs")),
    **{f"r{n}_{name}": _one_rule(n) for n, name in _RULES.items()},
    "r15_phrases": lambda s, d: rules.phrase_hits(_docs(s, d)).groupBy("doc_id", "phrase").agg(F.count("*").cast("int").alias("hits")),
    "r17_located_findings": lambda s, d: rules.located(_docs(s, d), only=[n for n, _, _ in rules.PATTERNS]),
    "r17_scan": lambda s, d: rules.located(_docs(s, d)),
    "p3_paragraphs": lambda s, d: _docs(s, d).select("doc_id", F.size(tx.paragraphs("text")).alias("paragraphs"), F.coalesce(F.array_max(F.transform(tx.paragraphs("text"), F.length)), F.lit(0)).alias("longest")),
    "p4_sentence_spans": lambda s, d: _docs(s, d).select("doc_id", F.size(tx.sentence_spans("text")).alias("spans")),
    "p6_sentences": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(tx.paragraphs("text")).alias("par_no", "p")).select("doc_id", "par_no", F.size(tx.sentences("p")).alias("sentences")),
    "p7_scopes": lambda s, d: _docs(s, d).select("doc_id", F.size(tx.scopes("text")).alias("scopes")),
    "p17_words": lambda s, d: _docs(s, d).select("doc_id", F.size(tx.words("text")).alias("words"), F.size(tx.letter_words("text")).alias("letter_words"), F.size(tx.tokens("text")).alias("tokens")),
    "p35_slugs": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", tx.slug("url").alias("slug")),
    "p9_sections": lambda s, d: tx.sections(_docs(s, d), "text", ["doc_id"]).select("doc_id", "sec_no", "title", tx.section_type("title").alias("section_type"), F.length(tx.squeeze("body")).alias("size")),
    "a1_fingerprint": lambda s, d: fingerprint.by_document(_docs(s, d)).select("doc_id", *oracles.METRIC_COLUMNS),
    "a2_sections": lambda s, d: fingerprint.by_section(_docs(s, d)).select("doc_id", "sec_no", "title", "section_type", *oracles.METRIC_COLUMNS),
    "p32_openings": lambda s, d: fingerprint.openings(_docs(s, d)),
    "w2_gaps": lambda s, d: fingerprint.adjacent_gaps(_docs(s, d)),
    "w6_claims": lambda s, d: fingerprint.claim_positions(_docs(s, d)),
    "a31_synonyms": lambda s, d: fingerprint.synonyms(_docs(s, d)),
    "a4_baseline": _baseline,
    "j1_differences": lambda s, d: revision.differences(_pairs(s, d)),
    "j2_category_report": lambda s, d: revision.category_report(revision.differences(_pairs(s, d))),
    "j3_immutable_verdict": lambda s, d: revision.immutable_verdict(_pairs(s, d)),
    "j4_guard_verdict": lambda s, d: revision.guard_verdict(_pairs(s, d)),
    "j4_frozen_verdict": lambda s, d: revision.frozen_verdict(_pairs(s, d)),
    "p28_claim_classes": lambda s, d: _values(_pairs(s, d), markers.claims),
    "p20_references": lambda s, d: _values(_pairs(s, d), markers.references),
    "p19_numbers": lambda s, d: _values(_pairs(s, d), markers.numbers),
    "p22_math": lambda s, d: _values(_pairs(s, d), markers.math),
    "p27_terms": lambda s, d: _values(_pairs(s, d), lambda t: markers.term_counts(t, revision.TERMS)),
    "j5_strength_moves": lambda s, d: revision.moves(_pairs(s, d)),
    "j12_crypto_moves": lambda s, d: revision.crypto_moves(_pairs(s, d)),
    "j6_comparison_flips": lambda s, d: revision.flips(_pairs(s, d)),
    "j7_removed": _removed,
    "j11_term_findings": lambda s, d: terms.findings(_pairs(s, d), glossary.merged(glossary.layers(s))),
    "j11_term_residual": lambda s, d: terms.findings(_pairs(s, d), glossary.merged(glossary.layers(s)), True),
    "j19_adjacent_stages": lambda s, d: history.adjacent(_turns(s, d)).select("series", "stage", "next_stage", F.length("before").alias("size_before"), F.length("after").alias("size_after")),
    "j20_drivers": lambda s, d: history.drivers(history.adjacent(_turns(s, d)), [(0, 1), (2, 3)], [(1, 2)]).groupBy("driver").agg(F.count("*").alias("pairs")),
    "j22_common_words": lambda s, d: history.common(_turns(s, d), tx.words("text")),
    "j22_common_expressions": lambda s, d: history.common_expressions(_versions(s, d)),
    "j23_without_reserved": lambda s, d: _without_reserved(s, d),
    "a9_rule_changes": lambda s, d: history.rule_changes(_series(s, d)).drop("stage"),
    "a12_change_passes": lambda s, d: history.classified(_series(s, d)).select("series", "status", F.array_join("passes", ",").alias("passes")),
    "a21_rule_convergence": _rule_convergence,
    "a13_screening": lambda s, d: targets.screening(fingerprint.by_document(_docs(s, d)), rules.findings(_docs(s, d))),
    "a20_structural": lambda s, d: targets.structural(_distances(s, d), "doc_id"),
    "a1_latex_fingerprint": lambda s, d: fingerprint.by_document(_docs(s, d).withColumn("suffix", F.lit(".tex"))).select("doc_id", *oracles.METRIC_COLUMNS),
    "a19_preflight": lambda s, d: targets.preflight(fingerprint.by_document(_docs(s, d)), rules.findings(_docs(s, d))),
    "src16_links": lambda s, d: corpus.links(_pages(s, d)),
    "p34_keyword_links": lambda s, d: corpus.with_keyword(corpus.links(_pages(s, d)), "text", ["the", "und"]).drop("text"),
    "w8_links_per_page": lambda s, d: corpus.per_group(corpus.links(_pages(s, d)), ["page_id"], ["place"]).select("page_id", "target"),
    "a28_coverage": lambda s, d: corpus.coverage(s.read.parquet(f"{d}/documents.parquet"), "source", "lang"),
    "snk4_bibliography": _bibliography,
    "j25_hashed_tokens": _hashed_tokens,
    "a27_manifest": lambda s, d: corpus.manifest(_raw(s, d).withColumn("path", F.lpad(F.col("doc_id").cast("string"), 20, "0")), ["source"], "path", "text"),
    "j27_manifest_diff": lambda s, d: corpus.manifest_diff(_raw(s, d).where("doc_id % 7 <> 0"), _raw(s, d).where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))), "doc_id", "text"),
    "p38_sensitivity": lambda s, d: corpus.sensitivity(_docs(s, d)),
    "p37_flagged_lines": lambda s, d: corpus.flagged_lines(_docs(s, d)),
    "snk8_upsert": lambda s, d: corpus.upsert(_raw(s, d).select("doc_id", F.lit("old").alias("origin")), s.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id", F.lit("new").alias("origin")), "doc_id"),
    "j29_wiring": lambda s, d: corpus.anchors(_docs(s, d).select(F.explode(F.split("text", "\n")).alias("line")), s.createDataFrame([("technical packaging",), ("no such anchor",), ("Introduction",)], "anchor string")),
    "j30_missing_labels": lambda s, d: _raw(s, d).select("doc_id").join(s.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id", "left_anti"),
    "j26_rule_sets": _rule_sets,
    "a29_command_coverage": lambda s, d: _docs(s, d).groupBy("source").agg(*[F.count_if(F.col("text").contains("\\" + x)).alias(x) for x in ("cite", "ref", "label")]),
    "g10_direction_matrix": lambda s, d: _report(s, d).join(_raw(s, d).select("doc_id", "lang"), "doc_id").groupBy("lang", "rule").agg(F.sum("hits").alias("hits")),
    "j14_scope_alignment": lambda s, d: align.scopes(_pairs(s, d).select("pair_id", tx.scopes(markers.prose("before")).alias("old"), tx.scopes(markers.prose("after")).alias("new"))),
    "j17_paragraph_alignment": lambda s, d: align.paragraphs(_pairs(s, d).select("pair_id", tx.paragraphs("before").alias("old"), tx.paragraphs("after").alias("new"))),
    "a8_paragraph_counts": lambda s, d: align.paragraph_counts(QUERIES["j17_paragraph_alignment"](s, d)),
    "a24_pass_verdict": _pass_verdict,
    "g11_contract": _contract,
    "a20_distances": _distances,
    "a5_drift": lambda s, d: _drift(s, d),
    "j8_removed_qualifiers": lambda s, d: revision.removed_by_token(_pairs(s, d)),
    "j13_candidates": lambda s, d: revision.candidates(_pairs(s, d)),
    "p25_figures": lambda s, d: revision.figure_differences(_pairs(s, d)),
    "strength_verdict": lambda s, d: revision.strength_verdict(_pairs(s, d)),
}

QUERIES |= record_queries.QUERIES | project_queries.QUERIES
ORACLE_SQL: dict[str, str] = {k: v for k, v in (oracles.SQL | record_queries.SQL | project_queries.SQL).items() if k in QUERIES}
