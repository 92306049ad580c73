"""Structural fingerprint of prose: metrics by document, section and section type;
a baseline over papers; distance and drift."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: fixed values
CONNECTIVES = ["accordingly", "additionally", "although", "because", "consequently", "conversely", "furthermore", "hence", "however", "moreover", "nevertheless", "otherwise", "therefore", "thus", "whereas", "while"]
CLAUSES = ["although", "because", "if", "since", "unless", "when", "whereas", "while"]
PREPOSITIONS = ["after", "at", "before", "by", "during", "for", "from", "in", "on", "through", "under", "with", "without"]
HEDGES = ["may", "might", "could", "suggests", "appears to", "is consistent with", "we conjecture", "likely", "approximately"]
PASSIVE = r"(?iU)\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b"
CLAIM = r"(?i)\b(?:we (?:show|demonstrate|present|propose|introduce|find)|our (?:method|system|evaluation) (?:achieves|reduces|improves)|(?:the )?results? (?:show|indicate|suggest))\b"
CONTRIBUTION = r"(?i)\b(?:our contributions?|we (?:present|propose|introduce|design|develop))\b"
LIMITATION = r"(?i)\b(?:limitation|limited to|does not|do not|however|future work)\b"
SYNONYMS = {"ciphertext object": ["ciphertext", "encrypted value", "encrypted input"], "method referent": ["method", "approach", "framework", "technique"], "cost referent": ["cost", "overhead", "expense"]}
PERSON = r"(?i)\b(?:we|our|ours)\b"
BASELINE = ["mean_sentence_length", "sentence_length_sd", "alternation_index", "connective_density", "em_dash_per_1000_words"]
THIN = 5
#: sums of a text that its ratios come from
SUMS = ["paragraph_count", "word_count", "word_squares", "sentence_count", "length_sum", "length_squares", "passive_sentences", "hedge_count", "connective_count", "first_person", "alternation_sum", "alternation_count"]


def opening(sentence: Column | str, first: Column) -> Column:
    """What a sentence opens with (first: its first word, in lower case); connectives win
    over clause openers."""
    s = tx.c(sentence)
    return (
        F.when(first == "", "other")
        .when(first.isin(CONNECTIVES), "connective")
        .when(first.isin(CLAUSES), "clause")
        .when(first.isin(PREPOSITIONS), "prepositional_phrase")
        .when(first.endswith("ly"), "adverbial")
        .when(first.isin("the", "a", "an", "we", "this", "these", "our") | s.rlike(r"^\p{Lu}"), "noun_phrase_subject")
        .otherwise("other")
    )


OPENINGS = ["connective", "clause", "prepositional_phrase", "adverbial", "noun_phrase_subject", "other"]


def _flag(kind: Column) -> Column:
    """A bit for each kind of opening, so that kinds are counted without a list."""
    return reduce(lambda out, x: F.when(kind == x[1], F.lit(1 << x[0])).otherwise(out), enumerate(OPENINGS), F.lit(None).cast("int"))


def hedge_count(text: Column) -> Column:
    """All hedges; no two of them share a word, so one pass counts all."""
    return F.regexp_count(text, F.lit(tx.quick(rf"(?i)\b(?:{'|'.join(HEDGES)})\b")))


def paragraph_rows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row per paragraph with its counts and the list of its sentences' facts."""
    paras = tx.unnest(docs, keep, tx.paragraphs(text), "paragraph", "par_no")
    return (
        paras.withColumn("_read", read("paragraph"))
        .withColumns({"sentences": F.col("_read.sentences"), "words": F.col("_read.words")})
        .drop("_read")
        .withColumn("dashes", F.length("paragraph") - F.length(F.replace(F.col("paragraph"), F.lit("—"), F.lit(""))))
        .withColumn("person", F.regexp_count("paragraph", F.lit(tx.quick(PERSON))))
        .withColumn("contributions", F.regexp_count("paragraph", F.lit(tx.quick(CONTRIBUTION))))
        .withColumn("limitations", F.regexp_count("paragraph", F.lit(tx.quick(LIMITATION))))
        .withColumn("gap_sum", _gaps(F.col("sentences")))
        .withColumn("openings", F.aggregate(F.transform("sentences", lambda x: _flag(x["opening"])), F.lit(0), lambda a, x: a.bitwiseOR(x)))
        .withColumn("first_opening", F.coalesce(_flag(F.get("sentences", F.lit(0))["opening"]), F.lit(0)))
    )


def _gaps(sentences: Column) -> Column:
    """The sum of the distances of adjacent sentences' lengths; null for fewer than two."""
    n = F.transform(sentences, lambda x: x["n"])
    steps = F.transform(F.sequence(F.lit(1), F.size(sentences) - 1), lambda i: F.abs(F.element_at(n, i + 1) - F.element_at(n, i)))
    return F.when(F.size(sentences) > 1, F.aggregate(steps, F.lit(0), lambda a, x: a + x))


def read(paragraph: Column | str) -> Column:
    """How many words a paragraph has, and the facts of its sentences."""
    known = F.array(*[F.lit(x) for x in CONNECTIVES])

    def facts(x: Column) -> Column:
        s, w = x["s"], x["w"]
        return F.struct(
            F.size(w).alias("n"),
            opening(s, F.lower(F.get(w, F.lit(0)))).alias("opening"),
            s.rlike(tx.quick(PASSIVE)).alias("passive"),
            hedge_count(s).alias("hedges"),
            s.rlike(tx.quick(CLAIM)).alias("claim"),
            F.size(F.array_intersect(F.transform(w, F.lower), known)).alias("connectives"),
        )

    # words of a sentence are read once; as no word spans a blank, those of all pieces
    # of a paragraph are those of the paragraph
    pieces = F.transform(tx.pieces(paragraph), lambda s: F.struct(s.alias("s"), tx.words(s).alias("w")))
    both = lambda p: F.struct(F.aggregate(p, F.lit(0), lambda a, x: a + F.size(x["w"])).alias("words"), F.transform(F.filter(p, lambda x: F.size(x["w"]) > 1), facts).alias("sentences"))
    return tx.let(pieces, both)


def summed(text: Column) -> Column:
    """SUMS of a text, as doubles, in one row."""
    add = lambda a, f: F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + f(x).cast("bigint"))
    inner = lambda f: lambda x: add(x["sentences"], f)
    mean = lambda x: x["gap_sum"] / (F.size(x["sentences"]) - 1)

    def of(p: Column) -> Column:
        each = [
            F.size(p), add(p, lambda x: x["words"]), add(p, lambda x: x["words"] * x["words"]), add(p, lambda x: F.size(x["sentences"])),
            add(p, inner(lambda y: y["n"])), add(p, inner(lambda y: y["n"] * y["n"])), add(p, inner(lambda y: y["passive"].cast("int"))),
            add(p, inner(lambda y: y["hedges"])), add(p, inner(lambda y: y["connectives"])), add(p, lambda x: x["person"]),
            F.aggregate(p, F.lit(0.0), lambda t, x: t + F.coalesce(mean(x), F.lit(0.0))), add(p, lambda x: (F.size(x["sentences"]) > 1).cast("int")),
        ]
        return F.array(*[x.cast("double") for x in each])

    person = lambda p: F.regexp_count(p, F.lit(tx.quick(PERSON)))
    facts = lambda p: tx.let(read(p), lambda r: F.struct(r["words"].alias("words"), r["sentences"].alias("sentences"), person(p).alias("person"), _gaps(r["sentences"]).alias("gap_sum")))
    return tx.let(F.transform(tx.paragraphs(text), facts), of)


def _total(expr: str, cond: str = "true") -> Column:
    return F.sum(F.expr(f"aggregate(sentences, 0L, (a, s) -> a + IF({cond}, CAST({expr} AS BIGINT), 0L))"))


def metrics(paras: DataFrame, by: list[str]) -> DataFrame:
    """The metric block over paragraph rows; ratios come from whole counts."""
    sums = paras.groupBy(*by).agg(
        F.count("*").alias("paragraph_count"),
        F.sum("words").alias("word_count"),
        F.sum(F.col("words") * F.col("words")).alias("word_squares"),
        F.sum(F.size("sentences")).alias("sentence_count"),
        _total("s.n").alias("length_sum"),
        _total("s.n * s.n").alias("length_squares"),
        F.min(F.array_min(F.expr("transform(sentences, s -> s.n)"))).alias("min_sentence_length"),
        F.max(F.array_max(F.expr("transform(sentences, s -> s.n)"))).alias("max_sentence_length"),
        _total("1", "s.n <= 14").alias("short_1_14"),
        _total("1", "s.n between 15 and 29").alias("medium_15_29"),
        _total("1", "s.n >= 30").alias("long_30_plus"),
        _total("1", "s.passive").alias("passive_sentences"),
        _total("s.hedges").alias("hedge_count"),
        F.max(F.array_max(F.expr("transform(sentences, s -> s.hedges)"))).alias("max_hedges_in_sentence"),
        _total("1", "s.claim").alias("claim_sentence_count"),
        _total("s.connectives").alias("connective_count"),
        F.sum("dashes").alias("em_dashes"),
        F.sum("person").alias("first_person"),
        F.sum("contributions").alias("contribution_move_count"),
        F.sum("limitations").alias("limitation_move_count"),
        F.avg(F.col("gap_sum") / (F.size("sentences") - 1)).alias("alternation"),
        F.count_if(F.size("sentences") > 0).alias("paragraph_opening_count"),
        F.bit_count(F.bit_or("openings")).alias("opening_type_count"),
        F.bit_count(F.bit_or("first_opening")).alias("paragraph_opening_type_count"),
    )
    ratios = _ratios(F.col)
    return sums.select(
        *by, "paragraph_count", "word_count", "sentence_count", "short_1_14", "medium_15_29", "long_30_plus", "claim_sentence_count", "contribution_move_count", "limitation_move_count",
        F.coalesce("min_sentence_length", F.lit(0)).alias("min_sentence_length"),
        F.coalesce("max_sentence_length", F.lit(0)).alias("max_sentence_length"),
        F.coalesce("max_hedges_in_sentence", F.lit(0)).alias("max_hedges_in_sentence"),
        "passive_sentences", "hedge_count", "connective_count", "em_dashes", "first_person", "paragraph_opening_count", "opening_type_count", "paragraph_opening_type_count",
        *[ratios[m].alias(m) for m in ("mean_paragraph_words", "mean_sentences_per_paragraph", "mean_sentence_length", "sentence_length_sd", "paragraph_word_sd")],
        F.coalesce("alternation", F.lit(0.0)).alias("alternation_index"),
        ratios["connective_density"].alias("connective_density"),
        (F.col("em_dashes") * 1000 / F.greatest("word_count", F.lit(1))).alias("em_dash_per_1000_words"),
        *[ratios[m].alias(m) for m in ("passive_sentence_ratio", "active_sentence_ratio", "first_person_per_1000_words", "hedges_per_1000_words")],
    )


def _ratios(v: Callable[[str], Column]) -> dict[str, Column]:
    """Metrics from whole counts; v gives a count by its name."""
    n, paragraphs, words = v("sentence_count"), v("paragraph_count"), F.greatest(v("word_count"), F.lit(1))
    safe = F.greatest(n, F.lit(1))
    sd = lambda squares, total, count: F.sqrt(F.greatest(F.lit(0.0), (squares * count - total * total).cast("double"))) / F.greatest(count, F.lit(1))
    return {
        "mean_paragraph_words": v("word_count") / paragraphs,
        "mean_sentences_per_paragraph": n / paragraphs,
        "mean_sentence_length": v("length_sum") / safe,
        "sentence_length_sd": sd(v("length_squares"), v("length_sum"), n),
        "paragraph_word_sd": sd(v("word_squares"), v("word_count"), paragraphs),
        "connective_density": v("connective_count") / safe,
        "passive_sentence_ratio": v("passive_sentences") / safe,
        "active_sentence_ratio": (n - v("passive_sentences")) / safe,
        "first_person_per_1000_words": v("first_person") * 1000 / words,
        "hedges_per_1000_words": v("hedge_count") * 1000 / words,
    }


def from_sums(at: Callable[[int], Column]) -> dict[str, Column]:
    """paragraph_count and the ratios of a text; at gives the SUMS by place (doubles)."""
    v = lambda name: at(SUMS.index(name))
    whole = lambda name: v(name).cast("bigint")
    alternation = F.when(v("alternation_count") > 0, v("alternation_sum") / v("alternation_count")).otherwise(0.0)
    return {"paragraph_count": whole("paragraph_count"), "alternation_index": alternation, **_ratios(whole)}


def plain(docs: DataFrame) -> DataFrame:
    """docs with the LaTeX of `.tex` texts removed; without a column `suffix` no text
    is one."""
    return docs.withColumn("text", F.when(F.col("suffix") == ".tex", tx.without_latex("text")).otherwise(F.col("text"))) if "suffix" in docs.columns else docs


def by_document(docs: DataFrame) -> DataFrame:
    """A row for each document with prose; null and empty texts, which have no metric,
    have none."""
    return metrics(paragraph_rows(plain(docs), ["doc_id"]), ["doc_id"])


def _bodies(docs: DataFrame) -> DataFrame:
    """Sections without the preamble, typed; LaTeX goes from the bodies, as headings
    are LaTeX too."""
    more = ["suffix"] if "suffix" in docs.columns else []
    rows = tx.sections(docs, "text", ["doc_id", *more]).where("title <> 'Preamble'").withColumn("section_type", tx.section_type("title"))
    return plain(rows.withColumnRenamed("body", "text")).withColumnRenamed("text", "body")


def by_section(docs: DataFrame) -> DataFrame:
    body = _bodies(docs)
    return metrics(paragraph_rows(body, ["doc_id", "sec_no", "title", "section_type"], "body"), ["doc_id", "sec_no", "title", "section_type"])


def by_section_type(docs: DataFrame) -> DataFrame:
    """Types pooled over a document's sections: metrics of the joint paragraphs."""
    body = _bodies(docs)
    return metrics(paragraph_rows(body, ["doc_id", "section_type"], "body"), ["doc_id", "section_type"])


def openings(docs: DataFrame) -> DataFrame:
    """How often each opening type occurs: in all sentences, and first in paragraphs."""
    rows = tx.unnest(paragraph_rows(docs, ["doc_id"]), ["doc_id"], "sentences", "s", "k")
    return rows.groupBy("doc_id", F.col("s.opening").alias("opening")).agg(F.count("*").alias("n"), F.count_if(F.col("k") == 0).alias("first"))


def claim_positions(docs: DataFrame) -> DataFrame:
    """Mean of the places of claims, each as a share of its paragraph."""
    rows = tx.unnest(paragraph_rows(docs, ["doc_id"]), ["doc_id", F.size("sentences").alias("n")], "sentences", "s", "k").where("s.claim")
    return rows.groupBy("doc_id").agg(F.count("*").alias("claims"), F.sum(((F.col("k") + 1) * 1000000 / F.col("n")).cast("long")).alias("position_sum"))


def synonyms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Concepts that a document names in more than one way."""
    t = F.lower(F.array_join(tx.paragraphs(text), " "))
    own = F.array(*[F.struct(F.lit(k).alias("concept"), F.array_compact(F.array(*[F.when(t.rlike(rf"\b{v}\b"), F.lit(v)) for v in vs])).alias("variants")) for k, vs in SYNONYMS.items()])
    return docs.select("doc_id", F.explode(own).alias("x")).where(F.size("x.variants") > 1).select("doc_id", "x.concept", F.array_join("x.variants", ",").alias("variants"))


def baseline(measured: DataFrame, paper: str) -> DataFrame:
    """One row: mean and population deviation of each metric over papers (a paper
    is the mean of its documents), and how many papers there are."""
    papers = measured.groupBy(paper).agg(*[F.avg(m).alias(m) for m in BASELINE])
    out = papers.agg(F.count("*").alias("paper_count"), *[F.avg(m).alias(f"{m}_mean") for m in BASELINE], *[F.stddev_pop(m).alias(f"{m}_sd") for m in BASELINE])
    return with_status(out)


def paper_key(path: Column | str = "path", text: Column | str = "text") -> Column:
    """What a file belongs to: its title, else its folder, else itself."""
    p = tx.c(path)
    suffix = F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1))
    title = tx.normal_title(tx.title_of(F.coalesce(tx.c(text), F.lit("")), suffix))
    folder = tx.normal_title(F.regexp_extract(p, r"(?:^|/)([^/]+)/[^/]*$", 1))
    return F.coalesce(F.concat(F.lit("title:"), F.nullif(title, F.lit(""))), F.concat(F.lit("directory:"), F.nullif(folder, F.lit(""))), F.concat(F.lit("path:"), F.lower(p)))


def with_status(base: DataFrame) -> DataFrame:
    return base.withColumn("status", F.when(F.col("paper_count") < THIN, F.format_string("thin(n=%d)", "paper_count")).otherwise("ok"))


def compared(measured: DataFrame, base: DataFrame, key: str = "doc_id", limit: float = 1.5) -> DataFrame:
    """For each document and metric the distance in deviations (null if there is
    none) and drift.  The baseline is a single row."""
    rows = measured.crossJoin(F.broadcast(base))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_sd").alias("sd")) for m in BASELINE])
    rows = rows.select(key, "paper_count", F.explode(each).alias("x")).select(key, "paper_count", "x.*")
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))
    return rows.withColumn("z", z).withColumn("drift", F.coalesce((F.col("paper_count") >= THIN) & (F.abs("z") > limit), F.lit(False)))


def adjacent_gaps(docs: DataFrame) -> DataFrame:
    """Lengths of sentences and their distance to the one before, by paragraph."""
    rows = tx.unnest(paragraph_rows(docs, ["doc_id"]), ["doc_id", "par_no"], "sentences", "s", "k")
    by = W.partitionBy("doc_id", "par_no").orderBy("k")
    return rows.select("doc_id", "par_no", "k", F.col("s.n").alias("n"), F.abs(F.col("s.n") - F.lag("s.n").over(by)).alias("gap"))
