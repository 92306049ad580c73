"""Registered queries of project records and relocated claims, and their SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import text as tx
from .operators import corpus, history, markers, records, relocation, rules, targets
from .plans import seed

S = SparkSession
#: sentences of our own: (rule, whether it must be found, text)
SAMPLES = [
    (1, True, "This groundbreaking map is here."), (1, False, "This useful map is here."),
    (2, True, "The map is efficient."), (2, False, "The map is efficient, as 3 ms show."),
    (3, True, "The technical packaging is described."), (3, False, "The packaging is described."),
    (4, True, "We leverage maps."), (4, False, "We use maps."),
    (5, True, "Moreover, it is so. Furthermore, it stays. However, it goes."), (5, False, "Moreover, it is so. However, it goes."),
    (6, True, "It is important to note that it rains."), (6, False, "It rains."),
    (7, True, "The evaluation shows the configuration and the optimization."), (7, False, "The evaluation shows the configuration."),
    (8, True, "In other words, it works."), (8, False, "In short, it works."),
    (9, True, "It may rain; it might snow; it could hail; it is likely."), (9, False, "It rains."),
    (10, True, "The map grew, thereby improving trust."), (10, False, "The map grew and improved trust."),
    (11, True, "It serves as a tool."), (11, False, "It is a tool."),
    (12, True, "It is not only fast but also small."), (12, False, "It is fast and small."),
    (13, True, "It has speed, scale, and trust."), (13, False, "It has speed and scale."),
    (14, True, "We go — now."), (14, False, "We go now."),
]


def _docs(s: S, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _turns(s: S, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("series"), F.col("turn").alias("place"), "text")


def _changes(s: S, d: str) -> DataFrame:
    """Each pair as a change at one of three stages."""
    rows = seed.pairs(s, d).select(F.col("pair_id").alias("series"), (F.col("pair_id") % 3).alias("stage"), "before", "after")
    return history.pass_counts(history.classified(rows))


def _contract(s: S, d: str) -> DataFrame:
    """Each document, alone and with one of the sentences behind it: the findings
    of the sentence's rule that it gains must be some, or none."""
    k = (F.col("doc_id") % len(SAMPLES)).cast("int")
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in SAMPLES]), k)
    text = F.coalesce("text", F.lit(""))
    count = lambda t: F.size(F.filter(F.transform(rules.hits(t), lambda h: h["rule"]), lambda r: r == F.col("rule")))
    rows = _docs(s, d).select("doc_id", of(0).alias("rule"), of(1).alias("wanted"), text.alias("base"), F.concat(text, F.lit("\n\n"), of(2)).alias("more"))
    gained = count("more") - count("base")
    return rows.select("doc_id", "rule", "wanted", gained.alias("gained"), ((gained > 0) == F.col("wanted")).alias("passed"))


def _admission(s: S, d: str) -> DataFrame:
    good = s.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id")
    listed = _docs(s, d).join(good, "doc_id", "left_semi").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return records.admitted(_docs(s, d), listed, "doc_id", "text")


def _order(s: S, d: str) -> DataFrame:
    changed = F.when(F.col("series") % 5 == 2, F.upper("text")).otherwise(F.col("text"))
    fragment = _turns(s, d).where("not (series % 3 = 1 and place = 1)").withColumn("text", changed)
    return records.same_order(_turns(s, d), fragment)


def _files(s: S, d: str) -> DataFrame:
    """Documents as files of small folders, each with mentions of others."""
    k = F.col("doc_id")
    path = lambda x: F.concat(F.lit("f"), F.floor(x / 10).cast("string"), F.lit("/n"), (x % 97).cast("string"), F.lit(".md"))
    other = F.when(k % 3 == 0, path(k * 7 + 3)).when(k % 3 == 1, F.concat(F.lit("n"), ((k + 1) % 97).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("g/n"), (k % 103).cast("string"), F.lit(".md")))
    return _docs(s, d).select(path(k).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nsee "), other).alias("text"))


def _titles(s: S, d: str) -> DataFrame:
    """Pages whose title is that of a page with an even number, whatever its case and
    signs."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1)
    rows = s.read.parquet(f"{d}/pages.parquet").select("page_id", title.alias("title"))
    wanted = rows.where("page_id % 2 = 0 and title <> ''").select(F.concat(F.lit("\\emph "), F.replace(F.translate("title", ascii_lowercase, ascii_uppercase), F.lit(" "), F.lit(" - ")), F.lit("!")).alias("title"))
    return records.canonical(rows, wanted).select("page_id")


def _numbered(s: S, d: str) -> DataFrame:
    rows = _docs(s, d).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("title"))
    return records.numbered(rows, "lang", F.lower("title"), 9).select("doc_id", "lang", "place")


def _trailers(s: S, d: str) -> DataFrame:
    """A line for each document, some of them broken, and its fields."""
    k = F.col("doc_id")
    of = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), k % n)
    line = F.concat(F.lit("[pm] map "), k.cast("string"), F.lit(" §"), F.coalesce("lang", F.lit("")), F.lit(" · P1"), of(3, "", " \t→P3", "→ P2 → P7"), F.lit(" · "), k.cast("string"), F.lit("处 · frozen:"), of(4, "0变化", "2处告警", "0变化", "x"), F.lit(" · baseline:"), of(3, "ok", "thin(n=2)", "none"), F.lit(" · target:"), of(2, "ok", "partial"), of(5, " · sample:too-short", "", "", "", ""), of(7, " · ⬆2 upstream", "", "", "", "", "", " more"))
    got = _docs(s, d).select("doc_id", targets.trailer(line, "pm").alias("t")).where("t is not null")
    return got.select("doc_id", "t.*")


#: values of profile fields: (field, source, JSON)
FIELDS = [
    ("sentence_length", "rule", '{"mean_range_words": [12, 30], "minimum_sd_words": 4.5}'),
    ("sentence_length", "rule", '{"mean_range_words": [30, 12], "minimum_sd_words": 4.5}'),
    ("sentence_length", "rule", '{"mean_range_words": [12, "30"], "minimum_sd_words": 4.5}'),
    ("sentence_length", "exemplar", '{"mean_range_words": [12, 30], "minimum_sd_words": 0, "distribution": {"a": 1}}'),
    ("paragraph_length", "exemplar", '{"mean_words": 1, "word_sd": 2.5, "mean_sentences": true}'),
    ("opening_structure", "exemplar", '{"clause": 0.5, "other": 0.5}'),
    ("opening_structure", "exemplar", '{"clause": 1.5}'),
    ("opening_structure", "exemplar", "{}"),
    ("connectives", "exemplar", '{"density_per_sentence": 0.2, "allowed": ["thus", "hence"]}'),
    ("connectives", "exemplar", '{"density_per_sentence": 0.2, "allowed": ["thus", 1]}'),
    ("connectives", "rule", '{"maximum_per_sentence": 0.6, "allowed": null}'),
    ("active_passive_by_section", "exemplar", '{"Methods": {"active_ratio": 0.4, "passive_ratio": 0.6}}'),
    ("active_passive_by_section", "exemplar", '{"Methods": {"active_ratio": 0.4}}'),
    ("hedging", "rule", '{"policy": "few"}'),
    ("hedging", "rule", '{"policy": " "}'),
    ("claim_position", "exemplar", '{"mean_normalized_position": 0.5, "observations": 3, "per_paragraph": []}'),
    ("contribution_limitation_moves", "exemplar", '{"contribution_move_count": 1, "limitation_move_count": 0, "form_only": true}'),
    ("contribution_limitation_moves", "exemplar", '{"contribution_move_count": 1, "limitation_move_count": -1, "form_only": true}'),
    ("first_person", "exemplar", "[1]"),
    ("first_person", "other", '{"per_1000_words": 1}'),
]


def _fields(s: S, d: str) -> DataFrame:
    k = (F.col("doc_id") % len(FIELDS)).cast("int")
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in FIELDS]), k)
    rows = _docs(s, d).select("doc_id", of(0).alias("field"), of(1).alias("source"), F.parse_json(of(2)).alias("value"))
    return rows.select("doc_id", "field", "source", targets.valid_field("field", "source", "value").alias("valid"))


def _cards(s: S, d: str) -> DataFrame:
    k = F.col("pair_id")
    rows = seed.pairs(s, d).select(k.alias("place"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("paper_id"), F.lit("v1-v2").alias("stage_pair"), F.when(k % 5 > 0, "self").alias("driver"), F.lit("Methods").alias("section_type"), F.array(F.lit(1), (k % 14).cast("int")).alias("rule_ids"), "before", "after", F.lit("words").alias("changed"), F.when(k % 2 == 1, F.array(F.lit("a"), F.lit("b"))).alias("kept"))
    return records.cards(rows)


def _cases(s: S, d: str) -> DataFrame:
    checks = F.array(F.struct(F.lit("quality").alias("name"), (F.col("quality") == 1).alias("passed")), F.struct(F.lit("harmless").alias("name"), (F.col("toxic") == 0).alias("passed")))
    return records.roll_up(s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.explode(checks).alias("x")).select("doc_id", "x.*"), "doc_id")


QUERIES = {
    "g9_case_roll_up": _cases,
    "p13_history_text": lambda s, d: seed.documents(s, d).select("doc_id", tx.without_scaffold("text", F.lit(".tex")).alias("text")),
    "p16_plain_words": lambda s, d: seed.documents(s, d).select("doc_id", tx.plain_word_count("text").alias("words")),
    "p39_trailers": _trailers,
    "p41_fields": _fields,
    "snk6_cards": _cards,
    "a9_pass_counts": _changes,
    "a10_dominant_passes": lambda s, d: history.dominant(_changes(s, d)),
    "g1_mentions": lambda s, d: records.mentions(_files(s, d)),
    "g6_digest_set": lambda s, d: records.digest_set(_docs(s, d), "lang"),
    "g8_limits": lambda s, d: records.limits(_docs(s, d)),
    "j15_scoped_markers": lambda s, d: relocation.scoped_differences(seed.pairs(s, d)),
    "j12_crypto_relocations": lambda s, d: relocation.crypto_relocations(seed.moved_pairs(s, d)),
    "j16_relocations": lambda s, d: relocation.relocations(seed.moved_pairs(s, d)),
    "j18_numbers_in_spans": lambda s, d: records.by_span(_docs(s, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "[0-9]+"),
    "j24_canonical_titles": _titles,
    "j31_admission": _admission,
    "j32_same_order": _order,
    "p14_claim_prose": lambda s, d: seed.pairs(s, d).select("pair_id", tx.squeeze(markers.prose("after")).alias("prose")),
    "p36_entry_types": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", corpus.entry_type("url").alias("kind")),
    "p40_ranges": lambda s, d: _docs(s, d).select("doc_id", targets.valid_range(F.when(F.col("doc_id") % 4 != 1, (F.col("doc_id") % 7 - 1).cast("double")), (F.col("doc_id") % 5).cast("double")).alias("valid")),
    "r18_rule_contract": _contract,
    "snk7_dossiers": lambda s, d: records.dossier(_turns(s, d)),
    "w3_shingles": lambda s, d: _docs(s, d).select("doc_id", F.size(history.shingles(F.coalesce("text", F.lit("")))).alias("shingles")),
    "w9_numbered": _numbered,
    "w10_latest_version": lambda s, d: targets.latest(_turns(s, d).select("series", F.col("place").alias("stage"), F.concat(F.lit("V"), F.col("place").cast("string"), F.lit(".tex")).alias("path"))),
}

Q, WORDS = oracles.Q, oracles.WORDS
_PASSES = f"WITH c AS (SELECT series % 3 AS stage, unnest(string_split(passes, ',')) AS pass FROM ({oracles.SQL['a12_change_passes']})), n AS (SELECT stage, pass, count(*)::BIGINT AS n FROM c WHERE pass <> '' GROUP BY ALL)"
_TOP = _PASSES + ", t AS (SELECT *, rank() OVER (PARTITION BY stage ORDER BY n DESC) AS r FROM n)"
_SAMPLE = lambda i: f"[{', '.join(Q(x[i]) if isinstance(x[i], str) else str(x[i]).lower() for x in SAMPLES)}][doc_id % {len(SAMPLES)} + 1]"
_WITH_SAMPLES = f"smp AS (SELECT doc_id, {_SAMPLE(0)} AS rule, {_SAMPLE(1)} AS wanted, coalesce(text, '') AS base, {_SAMPLE(2)} AS more FROM documents), docs AS (SELECT doc_id * 2 AS doc_id, base AS text FROM smp UNION ALL SELECT doc_id * 2 + 1, base || chr(10) || chr(10) || more FROM smp)"
_PATH = lambda x: f"'f' || (({x}) // 10) || '/n' || (({x}) % 97) || '.md'"
_UPPER = f"translate(title, '{ascii_lowercase}', '{ascii_uppercase}')"  # engines differ on letters whose upper case is two
_TITLE = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
_NORM = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"

_OF = lambda n, *v: f"([{', '.join(Q(x) for x in v)}])[doc_id % {n} + 1]"
_LINE = f"'[pm] map ' || doc_id || ' §' || coalesce(lang, '') || ' · P1' || {_OF(3, '', ' ' + chr(9) + '→P3', '→ P2 → P7')} || ' · ' || doc_id || '处 · frozen:' || {_OF(4, '0变化', '2处告警', '0变化', 'x')} || ' · baseline:' || {_OF(3, 'ok', 'thin(n=2)', 'none')} || ' · target:' || {_OF(2, 'ok', 'partial')} || {_OF(5, ' · sample:too-short', '', '', '', '')} || {_OF(7, ' · ⬆2 upstream', '', '', '', '', '', ' more')}"
_TRAILER = Q(r"^\[pm\] " + targets.TRAILER + "$")
_NO_COMMENT = r"regexp_replace(text, '(^|[^\\])%[^\n]*', '\1', 'g')"


def _scaffold() -> str:
    out = _NO_COMMENT
    for pattern, put in tx.HISTORY_SCAFFOLD[1:]:
        out = f"regexp_replace({out}, {Q(pattern)}, {Q(put)}, 'g')"
    return out


SQL = {
    "g9_case_roll_up": "SELECT doc_id, 2::BIGINT AS checks, CASE WHEN len(f) = 0 THEN 'assertions-satisfied' ELSE 'assertions-failed' END AS status, array_to_string(f, ',') AS failed FROM (SELECT doc_id, list_filter([CASE WHEN toxic IS DISTINCT FROM 0 THEN 'harmless' END, CASE WHEN quality IS DISTINCT FROM 1 THEN 'quality' END], lambda x: x IS NOT NULL) AS f FROM labels)",
    "p13_history_text": f"WITH {seed.DOCS_SQL} SELECT doc_id, {_scaffold()} AS text FROM docs",
    "p16_plain_words": f"WITH {seed.DOCS_SQL} SELECT doc_id, len({oracles.LETTERS(f'regexp_replace(regexp_replace({_NO_COMMENT}, {Q(chr(92) * 2 + "[A-Za-z@]+" + chr(92) + "*?(?:" + chr(92) + "[[^" + chr(92) + "]]*" + chr(92) + "])?")}, {Q(" ")}, {Q("g")}), {Q("[{}$" + chr(92) * 2 + "]")}, {Q(" ")}, {Q("g")})')})::INT AS words FROM docs",
    "p39_trailers": f"""WITH l AS (SELECT doc_id, trim({_LINE}) AS line FROM documents), x AS (SELECT doc_id, regexp_extract(line, {_TRAILER}, {targets.TRAILER_FIELDS}) AS t FROM l WHERE regexp_matches(line, {_TRAILER}))
SELECT doc_id, {", ".join(f"nullif(t.{x}, '') AS {x}" for x in targets.TRAILER_FIELDS if x != 'passes')}, regexp_replace(t.passes, '[ \t]*→[ \t]*', '→', 'g') AS passes FROM x""",
    "snk6_cards": f"""WITH {seed.PAIRS_SQL} SELECT pair_id AS place, 'exemplar-' || CASE WHEN pair_id > 999 THEN pair_id::VARCHAR ELSE lpad(pair_id::VARCHAR, 3, '0') END || '.md' AS name,
replace('# Exemplar Card||- Paper ID: p' || (pair_id % 3) || '|- Stage pair: v1-v2|- Pair driver: ' || CASE WHEN pair_id % 5 > 0 THEN 'self' ELSE '' END || '|- Section type: Methods|- Rule IDs: 1, ' || (pair_id % 14) || '||## Before||', '|', chr(10)) || before || replace('||## After||', '|', chr(10)) || after || replace('||## What changed||words||## What was deliberately kept||' || CASE WHEN pair_id % 2 = 1 THEN 'a, b' ELSE 'None identified; author confirmation required.' END || '|', '|', chr(10)) AS card FROM pairs""",
    "a9_pass_counts": f"{_PASSES} SELECT * FROM n",
    "a10_dominant_passes": f"{_TOP} SELECT stage, pass, n FROM t WHERE r = 1",
    "g1_mentions": f"""WITH f AS (SELECT {_PATH('doc_id')} AS path, coalesce(text, '') || chr(10) || 'see ' || CASE doc_id % 3 WHEN 0 THEN {_PATH('doc_id * 7 + 3')} WHEN 1 THEN 'n' || ((doc_id + 1) % 97) || '.md' ELSE 'g/n' || (doc_id % 103) || '.md' END AS text FROM documents),
k AS (SELECT DISTINCT path FROM f), o AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS name, min(path) AS target FROM k GROUP BY 1 HAVING count(*) = 1),
m AS (SELECT path, unnest(list_distinct(regexp_extract_all(text, {Q(records.MENTION)}))) AS mention FROM f),
r AS (SELECT m.path, mention, CASE WHEN a.path IS NOT NULL THEN a.path WHEN b.path IS NOT NULL THEN b.path ELSE o.target END AS target, CASE WHEN a.path IS NOT NULL THEN 'path' WHEN b.path IS NOT NULL THEN 'sibling' ELSE 'name' END AS how
  FROM m LEFT JOIN k a ON a.path = mention LEFT JOIN k b ON b.path = regexp_replace(m.path, '[^/]*$', '') || mention LEFT JOIN o ON o.name = regexp_extract(mention, '([^/]*)$', 1))
SELECT * FROM r WHERE target IS NOT NULL AND target <> path""",
    "g6_digest_set": "SELECT count(*)::BIGINT AS n, sha256(coalesce(string_agg(d, chr(10) ORDER BY d), '')) AS digest FROM (SELECT DISTINCT sha256(lang) AS d FROM documents WHERE lang IS NOT NULL)",
    "g8_limits": f"SELECT doc_id, header, lines, header <= {records.HEADER} AND lines <= {records.LINES} AS within FROM (SELECT doc_id, length(string_split(coalesce(text, ''), chr(10))[1])::INT AS header, len(string_split(coalesce(text, ''), chr(10)))::INT AS lines FROM documents)",
    "j18_numbers_in_spans": f"SELECT * FROM (SELECT doc_id, (k - 1)::INT AS span, len(regexp_extract_all(s, '[0-9]+'))::INT AS hits FROM (SELECT doc_id, unnest({oracles.SPANS('text')}) AS s, generate_subscripts({oracles.SPANS('text')}, 1) AS k FROM documents)) WHERE hits > 0",
    "j24_canonical_titles": f"WITH t AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1) AS title FROM pages), n AS (SELECT *, {_TITLE('title')} AS own, {_TITLE(_UPPER)} AS other FROM t) SELECT page_id FROM n WHERE own IN (SELECT other FROM n WHERE page_id % 2 = 0 AND title <> '')",
    "j31_admission": "WITH f AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents) SELECT doc_id, digest, digest IN (SELECT digest FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS admitted FROM f",
    "j32_same_order": """WITH a AS (SELECT conv_id AS series, coalesce(text, '') AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
b AS (SELECT conv_id AS series, coalesce(CASE WHEN conv_id % 5 = 2 THEN upper(text) ELSE text END, '') AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN conv_id % 5 = 2 THEN upper(text) ELSE text END) AS k FROM conversations WHERE NOT (conv_id % 3 = 1 AND turn = 1))
SELECT series, count(*)::BIGINT AS texts, count_if(a IS DISTINCT FROM b)::BIGINT AS differing, count_if(a IS DISTINCT FROM b) = 0 AS equal FROM a FULL JOIN b USING (series, k) GROUP BY series""",
    "p36_entry_types": f"SELECT page_id, CASE WHEN regexp_matches(lower(url), {Q(corpus.ARTICLE)}) THEN 'article' WHEN regexp_matches(lower(url), {Q(corpus.PROCEEDINGS)}) THEN 'inproceedings' ELSE 'misc' END AS kind FROM pages",
    "p40_ranges": "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 1 THEN doc_id % 7 - 1 >= 0 AND doc_id % 7 - 1 <= doc_id % 5 END, false) AS valid FROM documents",
    "r18_rule_contract": oracles.REPORT.replace(seed.DOCS_SQL, _WITH_SAMPLES) + " SELECT m.doc_id, m.rule, m.wanted, (y.hits - x.hits)::INT AS gained, (y.hits > x.hits) = m.wanted AS passed FROM smp m JOIN rep x ON x.doc_id = m.doc_id * 2 AND x.rule = m.rule JOIN rep y ON y.doc_id = m.doc_id * 2 + 1 AND y.rule = m.rule",
    "snk7_dossiers": f"SELECT conv_id AS series, sum(len({WORDS(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}))::BIGINT AS words, string_agg('## ' || turn || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id",
    "w3_shingles": f"WITH t AS (SELECT doc_id, list_transform({WORDS('text')}, lambda x: lower(x)) AS w FROM documents) SELECT doc_id, coalesce(len(list_filter(range(1, len(w) - 2), lambda i: list_max(list_transform(w[i:i + 3], lambda x: length(x))) >= 6)), 0)::INT AS shingles FROM t",
    "w9_numbered": "SELECT doc_id, coalesce(lang, '') AS lang, row_number() OVER (ORDER BY coalesce(lang, ''), lpad(doc_id::VARCHAR, 12, '0'))::INT AS place FROM documents",
    "w10_latest_version": "SELECT conv_id AS series, 'V' || max(turn) || '.tex' AS path FROM conversations GROUP BY conv_id",
}
