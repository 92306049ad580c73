"""Target profiles: built from texts, kept field by field, resolved and applied.

A profile has nine fields for each venue; a field has its source (exemplar or rule), its
confidence and a value of its own shape, as VARIANT.  `built` makes the fields of texts,
`resolved` picks those of a venue, a pass and a section type, and says which count and
why others do not, and `preflight` holds texts against resolved fields.

Defined results: a text without prose has no profile; a venue that is not known falls
back to the default; a field of an earlier schema whose value meant something else, a
voice that no section of the type gave, and a field that is absent or whose value has
not its shape are not eligible, and the reason is given; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import fingerprint as fp
from . import targets as tg

#: fixed values: schemas, fields of the earlier one that do not count, and the fields of
#: each pass
V3, V2 = "target-profile-v3", "target-profile-v2"
V2_EXCLUDED = ("opening_structure", "active_passive_by_section")
PASS_FIELDS = {"P4": ("sentence_length", "paragraph_length", "opening_structure"), "P5": ("connectives", "hedging"), "P6": ("active_passive_by_section", "first_person")}
#: what holds where a text gives no value; the numbers are fixed, the words our own
POLICY = "Left to the writer's judgement."
RULES = {f: dict(tg.RULE_VALUES.get(f, {})) | ({"allowed": "any that names a relation"} if f == "connectives" else {}) or {"policy": POLICY} for f in tg.DIMENSION_RULES}
SECTION_TYPES = [name for name, _ in tx.SECTION_TYPES] + ["Other"]


def observed(docs: DataFrame) -> DataFrame:
    """What single figures do not tell of a text: shares of the openings of paragraphs,
    its connectives in order, where claims stand in each paragraph, and the voice of each
    type of section."""
    rows = fp.paragraph_rows(fp.plain(docs), ["doc_id"])
    first = F.get("sentences", F.lit(0))["opening"]
    named = F.flatten(F.transform(tx.sentences("paragraph"), lambda s: F.array_intersect(F.transform(tx.words(s), F.lower), F.array(*[F.lit(x) for x in fp.CONNECTIVES]))))
    places = F.filter(F.transform("sentences", lambda s, k: F.when(s["claim"], F.round(F.try_divide(k + 1, F.size("sentences")), 4))), lambda x: x.isNotNull())
    exact = F.aggregate(F.transform("sentences", lambda s, k: F.when(s["claim"], F.try_divide(k + 1, F.size("sentences"))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"_first": first, "_named": named, "_places": places, "_sum": exact})
    own = rows.groupBy("doc_id").agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("_first") == o).alias(f"_{o}") for o in fp.OPENINGS],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_named")))).alias("connectives"),
        F.array_sort(F.collect_list(F.when(F.size("_places") > 0, F.struct((F.col("par_no") + 1).alias("paragraph"), F.col("_places").alias("normalized_positions"))))).alias("per_paragraph"),
        F.try_divide(F.sum("_sum"), F.sum(F.size("_places"))).alias("mean_claim"),
    )
    shares = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"_{o}") > 0, F.struct(F.lit(o), F.round(F.col(f"_{o}") / F.col("_n"), 4))) for o in sorted(fp.OPENINGS)])))
    voice = fp.by_section_type(docs).where("sentence_count > 0")
    r4 = lambda c: F.round(c, 4)
    voice = voice.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section_type", F.struct(r4("active_sentence_ratio").alias("active_ratio"), r4("passive_sentence_ratio").alias("passive_ratio")))))).alias("voice"))
    return own.select("doc_id", shares.alias("openings"), "connectives", "per_paragraph", r4("mean_claim").alias("mean_claim")).join(voice, "doc_id", "left")


def built(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, field, source, confidence, value (VARIANT).  docs: doc_id, text (and
    suffix); found: findings of the rules (doc_id, rule)."""
    measured = fp.by_document(docs)
    r4 = lambda c: F.round(c, 4)
    half = F.greatest(r4("sentence_length_sd") / 2, F.lit(1.0))
    mean = r4("mean_sentence_length")
    value = {
        "sentence_length": F.struct(F.array(r4(F.greatest(F.lit(1.0), mean - half)), r4(mean + half)).alias("mean_range_words"), r4("sentence_length_sd").alias("minimum_sd_words"), F.struct("short_1_14", "medium_15_29", "long_30_plus").alias("distribution")),
        "paragraph_length": F.struct(r4("mean_paragraph_words").alias("mean_words"), r4("paragraph_word_sd").alias("word_sd"), r4("mean_sentences_per_paragraph").alias("mean_sentences")),
        "opening_structure": F.col("openings"),
        "connectives": F.struct(r4("connective_density").alias("density_per_sentence"), F.col("connectives").alias("allowed")),
        "active_passive_by_section": F.col("voice"),
        "first_person": F.struct(r4("first_person_per_1000_words").alias("per_1000_words")),
        "hedging": F.struct(r4("hedges_per_1000_words").alias("per_1000_words"), F.col("max_hedges_in_sentence").alias("maximum_layers_per_sentence")),
        "claim_position": F.struct(F.col("mean_claim").alias("mean_normalized_position"), F.col("claim_sentence_count").alias("observations"), "per_paragraph"),
        "contribution_limitation_moves": F.struct("contribution_move_count", "limitation_move_count", F.lit(True).alias("form_only")),
    }
    screened = tg.screening(measured, found).select("doc_id", F.col("dimension").alias("field"), "source")
    rows = screened.join(measured, "doc_id").join(observed(docs), "doc_id", "left")
    taken = F.col("source") == "exemplar"
    own = reduce(lambda out, x: F.when(F.col("field") == x[0], F.to_json(x[1])).otherwise(out), value.items(), F.lit(None).cast("string"))
    rule = F.create_map(*[F.lit(x) for f, v in RULES.items() for x in (f, json.dumps(v, separators=(",", ":")))])[F.col("field")]
    return rows.select("doc_id", "field", "source", F.when(taken & (F.col("sentence_count") >= 8), "high").otherwise("medium").alias("confidence"), F.parse_json(F.when(taken, own).otherwise(rule)).alias("value"))


def from_file(profile: DataFrame) -> DataFrame:
    """The fields of profile files (`readers.profile`: value as VARIANT): venue, schema,
    is_default, field, source, confidence, value."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    rows = profile.select(get("value", "$.schema", "string").alias("schema"), get("value", "$.default_venue", "string").alias("_default"), F.explode(get("value", "$.venue_profiles", "map<string,variant>")).alias("venue", "_v"))
    rows = rows.select("schema", "venue", (F.col("_default") == F.col("venue")).alias("is_default"), F.explode(get("_v", "$.fields", "map<string,variant>")).alias("field", "_f"))
    return rows.select("venue", "schema", "is_default", "field", get("_f", "$.source", "string").alias("source"), get("_f", "$.confidence", "string").alias("confidence"), get("_f", "$.value", "variant").alias("value"))


def _venue(c: Column | str) -> Column:
    return tx.squeeze(F.lower(tx.c(c)))


def resolved(wanted: DataFrame, profiles: DataFrame, passes: tuple[str, ...] = ("P4", "P5", "P6")) -> DataFrame:
    """Wanted: key, venue, section_type.  profiles: venue, schema, is_default, field,
    source, confidence, value.  A row for each key, pass and field: the venue that gave it,
    how it was found, source, confidence, eligible, reason, value."""
    known = profiles.select(_venue("venue").alias("_v"), "venue", "is_default").distinct()
    default = profiles.where("is_default").agg(F.min("venue").alias("_default"))
    rows = wanted.select("key", "venue", "section_type", _venue("venue").alias("_w")).join(known.groupBy("_v").agg(F.min("venue").alias("_found")), F.col("_w") == F.col("_v"), "left").crossJoin(default)  # one row
    match = F.when(F.coalesce("_w", F.lit("")) == "", "unstated").when(F.col("_found").isNull(), "default").otherwise("matched")
    fields = F.array(*[F.struct(F.lit(p).alias("pass"), F.lit(f).alias("field")) for p in PASS_FIELDS if p in passes for f in PASS_FIELDS[p]])
    rows = rows.select("key", "section_type", F.coalesce("_found", "_default").alias("venue"), match.alias("venue_match"), F.explode(fields).alias("x")).select("key", "section_type", "venue", "venue_match", "x.*")
    own = profiles.select(F.col("venue").alias("_venue"), F.col("field").alias("_field"), "schema", "source", "confidence", "value")
    rows = rows.join(own, (F.col("venue") == F.col("_venue")) & (F.col("field") == F.col("_field")), "left")
    typed = F.col("schema").eqNullSafe(F.lit(V3)) & (F.coalesce(F.trim("confidence"), F.lit("")) != "") & tg.valid_field("field", "source", "value")
    legacy = F.col("schema").eqNullSafe(F.lit(V2))
    voice = (F.col("field") == "active_passive_by_section") & (F.col("source") == "exemplar") & F.col("section_type").isNotNull()
    part = reduce(lambda out, t: F.when(F.col("section_type") == t, F.to_json(F.create_map(F.lit(t), F.try_variant_get("value", f'$["{t}"]', "map<string,double>")))).otherwise(out), SECTION_TYPES, F.lit(None).cast("string"))
    has = reduce(lambda out, t: F.when(F.col("section_type") == t, F.try_variant_get("value", f'$["{t}"]', "variant").isNotNull()).otherwise(out), SECTION_TYPES, F.lit(False))
    reason = (
        F.when(F.col("_field").isNull(), "field missing")
        .when(~F.coalesce(F.col("source").isin("exemplar", "rule"), F.lit(False)), "source is neither exemplar nor rule")
        .when(legacy & F.col("field").isin(*V2_EXCLUDED), "earlier schema; rebuild as v3")
        .when(~legacy & ~typed, "value has not the shape of its field")
        .when(voice & ~has, F.concat(F.lit("no voice for section type "), F.col("section_type")))
    )
    value = F.when(reason.isNull(), F.when(voice, F.parse_json(part)).otherwise(F.col("value")))
    return rows.select("key", "venue", "venue_match", "schema", "pass", "field", "source", "confidence", reason.isNull().alias("eligible"), reason.alias("reason"), value.alias("value"))


def statuses(fields: DataFrame) -> DataFrame:
    """Ok if the venue matched, the schema is the present one and all eligible
    fields, at least one, come from texts; else partial; none without any profile."""
    rows = fields.groupBy("key", "venue", "venue_match").agg(F.count("schema").alias("fields"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & (F.col("source") == "exemplar")).alias("exemplars"), F.bool_and(F.coalesce(F.col("schema") == V3, F.lit(True))).alias("_new"))
    ok = (F.col("venue_match") == "matched") & (F.col("eligible") > 0) & (F.col("exemplars") == F.col("eligible")) & F.col("_new")
    return rows.select("key", "venue", "venue_match", "fields", "eligible", "exemplars", F.when(F.col("fields") == 0, "none").when(ok, "ok").otherwise("partial").alias("status"))


def preflight(measured: DataFrame, found: DataFrame, fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """A17 to A19 against resolved fields (key, field, source, eligible, value): triggers
    in order of their names; revise if there is any."""
    wide = fields.where("eligible").groupBy(F.col("key").alias(key)).agg(*[F.first(F.when(F.col("field") == f, F.struct("source", F.to_json("value").alias("value"))), ignorenulls=True).alias(f"_{f}") for f in ("sentence_length", "paragraph_length", "opening_structure", "connectives", "hedging")])
    rows = measured.join(wide, key, "left")
    value = lambda f, path: F.try_variant_get(F.parse_json(F.col(f"_{f}.value")), path, "double")
    names = tg.triggers(value, lambda f: F.col(f"_{f}").isNotNull(), lambda f: F.col(f"_{f}.source") == "rule")
    return tg.decided(rows, found, names, key)
