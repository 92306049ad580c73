"""SQL for another engine that gives the rows of the registered queries.

That engine's regular expressions have no look-around; its word boundary is that
of ASCII.  Where it matters, texts are cut into tokens first."""

from __future__ import annotations

from .functions import text as tx
from .operators import corpus as co
from .operators import fingerprint as fp
from .operators import glossary as gl
from .operators import history as hi
from .operators import markers as mk
from .operators import revision as rv
from .operators import rules as ru
from .operators import targets as tg
from .plans import seed

SQ = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
Q = lambda s: "'" + s.replace("'", "''") + "'"
WORDS = lambda x: f"regexp_extract_all({x}, {Q(tx.WORD)})"
LETTERS = lambda x: f"regexp_extract_all({x}, {Q(tx.LETTER_WORD)})"
ALL = lambda x, p, g=0: f"regexp_extract_all({x}, {Q(p)}, {g})"
N = lambda x, p: f"len(regexp_extract_all({x}, {Q(p)}))"
PARAS = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda p: {SQ('p')}), lambda p: p <> '')"
SENTS = lambda p: f"list_filter(list_transform(string_split(regexp_replace({p}, '([.!?])\\s+([A-Z0-9`\\\\])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {SQ('s')}), lambda s: len({WORDS('s')}) > 1)"
SPANS = lambda x: f"list_filter(regexp_extract_all({x}, '[^.!?\\n]+[.!?]?'), lambda s: {SQ('s')} <> '')"
#: a pattern's \b as a consumed neighbour that is no letter, digit or underscore of any alphabet
EDGE = r"(?:^|[^\p{L}\p{N}_])"


def _whole(x: str, pattern: str) -> str:
    """Count matches of a pattern between Unicode word boundaries: separators are
    doubled, so that neighbours do not share one."""
    return f"len(regexp_extract_all(' ' || regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ', {Q(pattern)}))"


def _plain(pattern: str) -> str:
    return pattern


def _rule_counts() -> str:
    t = "text"
    parts = {}
    for n, _, p in ru.PATTERNS:
        if n == 10:
            hits = ALL(t, r"(?i),\s+(?:thereby\s+)?\w+ing\b[^.!?]{0,90}[.!?]")
            parts[n] = f"len(list_filter({hits}, lambda m: NOT regexp_matches(m, {Q(_no_look(ru.EVIDENCE))}) AND NOT regexp_matches(m, {Q(ru.MECHANISM)})))"
        else:
            parts[n] = N(t, p)
    near = f"list_transform(range(1, len(sp) + 1), lambda i: CASE WHEN regexp_matches(array_to_string(sp[greatest(i - 1, 1):i + 1], ' '), {Q(ru.METRIC)}) THEN 0 ELSE {N('sp[i]', ru.ADJECTIVE)} END)"
    parts[2] = f"coalesce(list_sum({near}), 0)"
    blocks = "regexp_split_to_array(text, '\\n\\s*\\n')"
    start = r"(?i)(?:^|[.!?]\s+)(?:Moreover|Furthermore|Additionally|However),?"
    parts[5] = f"len(list_filter({blocks}, lambda p: {N('p', start)} >= 3))"
    token = f"list_filter(regexp_extract_all(s, {Q(tx.TOKEN)}), lambda w: regexp_matches(w, '(?i)^[A-Za-z]+(?:tion|sion|ment|ance|ence|ity|ization)$'))"
    parts[7] = f"len(list_filter(sp, lambda s: len({token}) >= 3))"
    hedge = " + ".join(N("lower(p)", rf"\b{h}\b") for h in ru.HEDGES)
    parts[9] = f"len(list_filter({blocks}, lambda p: ({hedge}) > 0 AND (({hedge}) > 3 OR NOT regexp_matches(p, {Q(ru.SUPPORT)}))))"
    dash = "(length(text) - length(replace(text, '—', '')))"
    parts[14] = f"CASE WHEN {dash} > 0 AND {dash} * 1000 > greatest(words, 1) * {ru.DASH_LIMIT} THEN 1 ELSE 0 END"
    rows = ", ".join(f"{{'rule': {n}, 'severity': {Q(ru.SEVERITY[n])}, 'hits': ({parts[n]})::INT}}" for n in sorted(parts))
    return f"""WITH {seed.DOCS_SQL},
s AS (SELECT doc_id, text, {SPANS('text')} AS sp, len({LETTERS('text')})::INT AS words FROM docs),
rep AS (SELECT doc_id, words, unnest([{rows}], recursive := true) FROM s)"""


def _no_look(p: str) -> str:
    return p.replace("(?![A-Za-z0-9])", "(?:[^A-Za-z0-9]|$)")


_W = r"[\p{L}\p{N}_]"
PASSIVE = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:is|are|was|were|be|been|being)\s+(?:{_W}+ly\s+)?{_W}+(?:ed|en)(?:[^\p{{L}}\p{{N}}_]|$)"
REPORT = _rule_counts()
DENSITY = "hits * 1000.0::DOUBLE / greatest(words, 1)"

SQL: dict[str, str] = {
    "rule_density_by_doc": f"{REPORT} SELECT doc_id, rule, hits, {DENSITY} AS density FROM rep",
    "r16_rule_report": f"{REPORT} SELECT doc_id, rule, severity, words, hits, {DENSITY} AS density FROM rep WHERE severity <> 'info'",
    "r16_verdict": f"{REPORT} SELECT doc_id, sum(hits)::BIGINT AS hits, sum(CASE WHEN severity = 'block' THEN hits ELSE 0 END)::BIGINT AS severe, sum(CASE WHEN severity = 'block' THEN hits ELSE 0 END) = 0 AND sum(hits) * 1000.0::DOUBLE / greatest(any_value(words), 1) <= 5.0 AS passed FROM rep GROUP BY doc_id",
    "a6_rule_totals": f"{REPORT} SELECT rule, severity, sum(hits)::BIGINT AS hits, count_if(hits > 0)::BIGINT AS docs FROM rep GROUP BY rule, severity",
} | {f"r{n}_{name}": f"{REPORT} SELECT doc_id, hits FROM rep WHERE rule = {n} AND hits > 0" for n, name in {1: "importance", 2: "adjective", 3: "domain_phrase", 4: "filler", 5: "connectors", 6: "shell", 7: "nominals", 8: "paraphrase", 9: "hedges", 10: "participle", 11: "copula", 12: "not_only", 13: "triple", 14: "dashes"}.items()}

SQL["r15_phrases"] = f"WITH {seed.DOCS_SQL} SELECT doc_id, p.phrase, len(p.m)::INT AS hits FROM (SELECT doc_id, unnest([{', '.join(f'''{{'phrase': {Q(n)}, 'm': {ALL('text', p)}}}''' for n, p in ru.PHRASES)}]) AS p FROM docs) WHERE len(p.m) > 0"


def _located() -> str:
    parts = []
    for n, s, p in ru.PATTERNS:
        body, after = (p.replace("(?=[.!?])", "([.!?])"), chr(92) + "1") if n == 10 else (p, "")
        if n == 10:
            body, after = "(?i)(" + body.removeprefix("(?i)").removesuffix("([.!?])") + ")([.!?])", chr(92) + "2"
        hit = chr(92) + ("1" if n == 10 else "0")
        parts.append(f"SELECT doc_id, {n} AS rule, {Q(s)} AS severity, text, string_split(replace(regexp_replace(text, {Q(body)}, chr(1) || '{hit}' || chr(2) || '{after}', 'g'), chr(2), chr(1)), chr(1)) AS x FROM docs")
    return f"""WITH {seed.DOCS_SQL}, m AS ({' UNION ALL '.join(parts)}),
h AS (SELECT doc_id, rule, severity, text, x[2 * i] AS match, length(array_to_string(x[1:2 * i - 1], ''))::INT AS start FROM (SELECT *, unnest(range(1, (len(x) - 1) // 2 + 1)) AS i FROM m WHERE len(x) > 1))
SELECT doc_id, rule, severity, match, start, (length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1)::INT AS line,
       (length(string_split(substr(text, 1, start), chr(10))[-1]) + 1)::INT AS column FROM h
WHERE rule <> 10 OR (NOT regexp_matches(match, {Q(_no_look(ru.EVIDENCE))}) AND NOT regexp_matches(match, {Q(ru.MECHANISM)}))"""


SQL["r17_located_findings"] = _located()

D = f"WITH {seed.DOCS_SQL} "
SQL |= {
    "p3_paragraphs": D + f"SELECT doc_id, len({PARAS('text')})::INT AS paragraphs, coalesce(list_max(list_transform({PARAS('text')}, lambda p: length(p))), 0)::INT AS longest FROM docs",
    "p4_sentence_spans": D + f"SELECT doc_id, len({SPANS('text')})::INT AS spans FROM docs",
    "p6_sentences": D + f"SELECT doc_id, (par - 1)::INT AS par_no, len({SENTS('p')})::INT AS sentences FROM (SELECT doc_id, unnest({PARAS('text')}) AS p, generate_subscripts({PARAS('text')}, 1) AS par FROM docs)",
    "p7_scopes": D + "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '(?:[.!?;]+|\\n+)\\s*'), lambda s: trim(s)), lambda s: s <> ''))::INT AS scopes FROM docs",
    "p17_words": D + f"SELECT doc_id, len({WORDS('text')})::INT AS words, len({LETTERS('text')})::INT AS letter_words, {N('lower(text)', tx.TOKEN)}::INT AS tokens FROM docs",
    "p35_slugs": "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages",
}

HEAD = r"(?m)^#{1,6}\s+(.+?)\s*$|\\(?:section|subsection|subsubsection)\*?\{([^{}]+)\}"
SECTIONS = f"""parts AS (SELECT doc_id, string_split(regexp_replace(text, {Q(HEAD)}, chr(1) || '\\1\\2' || chr(2), 'g'), chr(1)) AS x FROM docs),
sec AS (SELECT doc_id, (i - 1)::INT AS sec_no,
  CASE WHEN len(x) = 1 THEN 'Document' WHEN i = 1 THEN 'Preamble' ELSE {SQ('string_split(x[i], chr(2))[1]')} END AS title,
  CASE WHEN i = 1 THEN x[i] ELSE string_split(x[i], chr(2))[2] END AS body
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM parts)),
typed AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS nt FROM sec WHERE title <> 'Preamble' OR {SQ('body')} <> ''),
sections AS (SELECT doc_id, sec_no, title, body, CASE {' '.join(f"WHEN regexp_matches(nt, {Q(p)}) THEN {Q(k)}" for k, p in tx.SECTION_TYPES)} ELSE 'Other' END AS section_type FROM typed)"""
SQL["p9_sections"] = D[:-1] + f", {SECTIONS} SELECT doc_id, sec_no, title, section_type, length({SQ('body')})::INT AS size FROM sections"


def _block(source: str, keys: str) -> str:
    first = f"lower(regexp_extract(s, {Q(tx.WORD)}))"
    isin = lambda xs: "(" + ", ".join(Q(x) for x in xs) + ")"
    con = " + ".join(f"list_contains(lw, {Q(x)})::INT" for x in fp.CONNECTIVES)
    hedge = " + ".join(N("s", rf"(?i)\b{h}\b") for h in fp.HEDGES)
    return f"""par AS (SELECT {keys}, par_no, p, len({WORDS('p')}) AS w, {SENTS('p')} AS ss FROM (SELECT {keys}, unnest({PARAS(source)}) AS p, generate_subscripts({PARAS(source)}, 1) - 1 AS par_no FROM src)),
sen AS (SELECT {keys}, par_no, k, s, len({WORDS('s')}) AS n, regexp_matches(s, {Q(PASSIVE)}) AS passive, {hedge} AS hedges, regexp_matches(s, {Q(fp.CLAIM)}) AS claim, {con} AS con,
  CASE WHEN f = '' THEN 'other' WHEN f IN {isin(fp.CONNECTIVES)} THEN 'connective' WHEN f IN {isin(fp.CLAUSES)} THEN 'clause' WHEN f IN {isin(fp.PREPOSITIONS)} THEN 'prepositional_phrase'
       WHEN ends_with(f, 'ly') THEN 'adverbial' WHEN f IN ('the', 'a', 'an', 'we', 'this', 'these', 'our') OR regexp_matches(s, '^\\p{{Lu}}') THEN 'noun_phrase_subject' ELSE 'other' END AS opening
  FROM (SELECT *, {first} AS f, list_transform({WORDS('s')}, lambda x: lower(x)) AS lw FROM (SELECT {keys}, par_no, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS k FROM par))),
ps AS (SELECT {keys}, count(*)::BIGINT AS paragraph_count, sum(w)::BIGINT AS word_count, sum(w * w) AS w2, sum(length(p) - length(replace(p, '—', '')))::BIGINT AS em_dashes,
  sum(len(list_filter(regexp_extract_all(lower(p), {Q(tx.TOKEN)}), lambda x: x IN ('we', 'our', 'ours'))))::BIGINT AS first_person, sum({N('p', fp.CONTRIBUTION)})::BIGINT AS contribution_move_count, sum({N('p', fp.LIMITATION)})::BIGINT AS limitation_move_count FROM par GROUP BY ALL),
ss AS (SELECT {keys}, count(*)::BIGINT AS sentence_count, sum(n) AS n1, sum(n * n) AS n2, min(n)::INT AS min_n, max(n)::INT AS max_n, count_if(n <= 14)::BIGINT AS a, count_if(n BETWEEN 15 AND 29)::BIGINT AS b, count_if(n >= 30)::BIGINT AS c,
  count_if(passive)::BIGINT AS passive, sum(hedges)::BIGINT AS hedges, max(hedges)::INT AS max_h, count_if(claim)::BIGINT AS claims, sum(con)::BIGINT AS con FROM sen GROUP BY ALL)"""


_KEYS = {"doc_id": "doc_id", "sec": "doc_id, sec_no, title, section_type", "type": "doc_id, section_type"}


def _metrics(keys: str) -> str:
    return f"""SELECT {keys}, paragraph_count, word_count, coalesce(sentence_count, 0)::BIGINT AS sentence_count, coalesce(a, 0)::BIGINT AS short_1_14, coalesce(b, 0)::BIGINT AS medium_15_29, coalesce(c, 0)::BIGINT AS long_30_plus,
  coalesce(claims, 0)::BIGINT AS claim_sentence_count, contribution_move_count, limitation_move_count, coalesce(min_n, 0)::INT AS min_sentence_length, coalesce(max_n, 0)::INT AS max_sentence_length, coalesce(max_h, 0)::INT AS max_hedges_in_sentence,
  coalesce(passive, 0)::BIGINT AS passive_sentences, coalesce(hedges, 0)::BIGINT AS hedge_count, coalesce(con, 0)::BIGINT AS connective_count, em_dashes, first_person,
  word_count / paragraph_count AS mean_paragraph_words, coalesce(n1, 0)::DOUBLE / greatest(coalesce(sentence_count, 0), 1) AS mean_sentence_length,
  sqrt(greatest(0.0::DOUBLE, (coalesce(n2, 0) * coalesce(sentence_count, 0) - coalesce(n1, 0) * coalesce(n1, 0))::DOUBLE)) / greatest(coalesce(sentence_count, 0), 1) AS sentence_length_sd
FROM ps LEFT JOIN ss USING ({keys})"""


METRIC_COLUMNS = ["paragraph_count", "word_count", "sentence_count", "short_1_14", "medium_15_29", "long_30_plus", "claim_sentence_count", "contribution_move_count", "limitation_move_count", "min_sentence_length", "max_sentence_length", "max_hedges_in_sentence", "passive_sentences", "hedge_count", "connective_count", "em_dashes", "first_person", "mean_paragraph_words", "mean_sentence_length", "sentence_length_sd"]
DOC_BLOCK = D[:-1] + ", src AS (SELECT doc_id, text FROM docs), " + _block("text", "doc_id")
SQL |= {
    "a1_fingerprint": f"{DOC_BLOCK} {_metrics('doc_id')}",
    "a2_sections": D[:-1] + f", {SECTIONS}, src AS (SELECT * FROM sections WHERE title <> 'Preamble'), " + _block("body", _KEYS["sec"]) + _metrics(_KEYS["sec"]),
    "p32_openings": f"{DOC_BLOCK} SELECT doc_id, opening, count(*)::BIGINT AS n, count_if(k = 0)::BIGINT AS first FROM sen GROUP BY doc_id, opening",
    "w2_gaps": f"{DOC_BLOCK} SELECT doc_id, par_no::INT AS par_no, k::INT AS k, n::INT AS n, abs(n - lag(n) OVER (PARTITION BY doc_id, par_no ORDER BY k))::INT AS gap FROM sen",
    "w6_claims": f"{DOC_BLOCK} SELECT doc_id, count(*)::BIGINT AS claims, sum(floor((k + 1) * 1000000 / cnt))::BIGINT AS position_sum FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, par_no) AS cnt FROM sen) WHERE claim GROUP BY doc_id",
    "a31_synonyms": D + f"SELECT doc_id, x.concept, array_to_string(x.v, ',') AS variants FROM (SELECT doc_id, unnest([{', '.join(f'''{{'concept': {Q(k)}, 'v': list_filter([{', '.join(map(Q, vs))}], lambda v: regexp_matches(t, '\\b' || v || '\\b'))}}''' for k, vs in fp.SYNONYMS.items())}]) AS x FROM (SELECT doc_id, lower(array_to_string({PARAS('text')}, ' ')) AS t FROM docs)) WHERE len(x.v) > 1",
}

P = f"WITH {seed.PAIRS_SQL} "
SIDES = f"WITH {seed.PAIRS_SQL}, sides AS (SELECT pair_id, 'before' AS side, before AS t FROM pairs UNION ALL SELECT pair_id, 'after', after FROM pairs)"
_ENVS = "equation|align|gather|multline|displaymath|math"


def _prose(x: str) -> str:
    """Prose for claim markers, with the environments that the passages use."""
    out = f"regexp_replace({x}, '(^|[^\\\\])%[^\\n]*', '\\1 ', 'g')"
    for name in ("equation", "figure"):
        out = f"regexp_replace({out}, '(?s)\\\\begin\\{{{name}\\}}.*?\\\\end\\{{{name}\\}}', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)\\$\\$.*?\\$\\$|\\\\\\[.*?\\\\\\]|\\\\\\(.*?\\\\\\)', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)\\$[^$]*\\$', ' ', 'g')"
    out = f"regexp_replace({out}, {Q(mk.REFERENCE)}, ' ', 'g')"
    out = f"regexp_replace({out}, '\\\\[A-Za-z@]+\\*?', ' ', 'g')"
    out = f"lower(replace({out}, '’', chr(39)))"
    for old, new in [(o, n.replace("$1", chr(92) + "1")) for o, n in mk.CONTRACTIONS]:
        out = f"regexp_replace({out}, {Q(old)}, {Q(new)}, 'g')"
    return f"regexp_replace({out}, '\\bnot\\s+only\\b', 'not_only', 'g')"


def _claim_rows() -> str:
    """kind:class rows; words are cut into tokens, phrases of two words first."""
    each = []
    for kind, classes in mk.CLASSES.items():
        whole = r"(?:^|[^\p{L}\p{N}_])(" + "|".join(classes.values()) + r")(?:[^\p{L}\p{N}_]|$)"
        case = " ".join(f"WHEN regexp_matches(m, '^(?:' || {Q(p)} || ')$') THEN {Q(kind + ':' + ('hedged' if n in mk.HEDGED else n))}" for n, p in classes.items())
        each.append(f"SELECT pair_id, side, 'claims' AS category, CASE {case} END AS value FROM (SELECT pair_id, side, unnest(regexp_extract_all(dbl, {Q(whole)}, 1)) AS m FROM pr)")
    return " UNION ALL ".join(each)


def _dbl(x: str) -> str:
    return f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"


_EDGE_NUMBER = r"(?:^|[^\p{L}\p{N}_.])(\d+(?:\.\d+)?(?:\s*(?:%|[xX]|ms|s|GB|MB|KB|bits?))?)(?:[^\p{L}\p{N}_.]|$)"
_EDGE_UNIT = r"(?:^|[^\p{L}\p{N}_.])(\d+(?:\.\d+)?\s*(?:%|ms|s|GB|MB|KB|bits?))(?:[^\p{L}\p{N}_.]|$)"
_DBL_DOT = "regexp_replace(t, '([^\\p{L}\\p{N}_.])', '\\1\\1', 'g')"
_REFS = f"""(SELECT pair_id, side, lower(r.c) AS cmd, trim(k) AS key FROM (SELECT pair_id, side, r, unnest(string_split(r.k, ',')) AS k FROM (
  SELECT pair_id, side, unnest(list_transform(regexp_extract_all(t, {Q(mk.REFERENCE)}), lambda m: {{'c': regexp_extract(m, {Q(mk.REFERENCE)}, 1), 'k': regexp_extract(m, {Q(mk.REFERENCE)}, 2)}})) AS r FROM sides)) WHERE trim(k) <> '')"""
_REST = "regexp_replace(t, '(?s)\\\\begin\\{equation\\}.*?\\\\end\\{equation\\}', ' ', 'g')"
_MATH = f"""(SELECT pair_id, side, 'equation:' || {SQ('m')} AS value FROM (SELECT pair_id, side, unnest(regexp_extract_all(t, '(?s)\\\\begin\\{{equation\\}}(.*?)\\\\end\\{{equation\\}}', 1)) AS m FROM sides)
  UNION ALL SELECT pair_id, side, {SQ('m')} FROM (SELECT pair_id, side, unnest(regexp_extract_all({_REST}, '(?s)\\$\\$(.*?)\\$\\$', 1)) AS m FROM sides)
  UNION ALL SELECT pair_id, side, {SQ('m')} FROM (SELECT pair_id, side, unnest(regexp_extract_all({_REST}, '(?s)\\$([^$]+)\\$(?:[^$]|$)', 1)) AS m FROM sides))"""
_TERMS = "(" + " UNION ALL ".join(f"SELECT pair_id, side, {Q(t)} AS value FROM (SELECT pair_id, side, unnest(regexp_extract_all(regexp_replace(t, '([^A-Za-z0-9])', '\\1\\1', 'g'), {Q('(?i)(?:^|[^A-Za-z0-9])' + t.replace('-', '--') + '(?:[^A-Za-z0-9]|$)')})) FROM sides)" for t in rv.TERMS) + ")"


def _diff(parts: str, report: str) -> str:
    return f"""{SIDES}, pr AS (SELECT pair_id, side, {_dbl(_prose('t'))} AS dbl FROM sides), long AS ({parts}),
cnt AS (SELECT pair_id, category, value, count_if(side = 'before') AS b, count_if(side = 'after') AS a FROM long GROUP BY ALL),
diff AS (SELECT pair_id, category, value, greatest(b - a, 0)::BIGINT AS removed, greatest(a - b, 0)::BIGINT AS added FROM cnt WHERE a <> b)
{report}"""


_IMMUTABLE = f"""SELECT pair_id, side, 'latex_keys' AS category, CASE WHEN starts_with(cmd, 'cite') THEN 'cite' ELSE cmd END || ':' || key AS value FROM {_REFS} WHERE cmd <> 'cref'
UNION ALL SELECT pair_id, side, 'math', regexp_replace(value, '\\s+', '', 'g') FROM {_MATH}
UNION ALL SELECT pair_id, side, 'glossary_terms', value FROM {_TERMS}
UNION ALL SELECT pair_id, side, 'numbers_units', regexp_replace(m, '^(\\d+(?:\\.\\d+)?)\\s*', '\\1 ') FROM (SELECT pair_id, side, unnest(regexp_extract_all({_DBL_DOT.replace('(t,', "(regexp_replace(t, " + Q(mk.SI) + ", ' ', 'g'),")}, {Q(_EDGE_UNIT)}, 1)) AS m FROM sides)
UNION ALL SELECT pair_id, side, 'numbers_units', 'SI:' || regexp_extract(m, {Q(mk.SI)}, 1) || ':' || regexp_extract(m, {Q(mk.SI)}, 2) FROM (SELECT pair_id, side, unnest(regexp_extract_all(t, {Q(mk.SI)})) AS m FROM sides)
UNION ALL {_claim_rows()}"""
_GUARD = f"""SELECT pair_id, side, 'numbers' AS category, {SQ('m')} AS value FROM (SELECT pair_id, side, unnest(regexp_extract_all({_DBL_DOT}, {Q(_EDGE_NUMBER)}, 1)) AS m FROM sides)
UNION ALL SELECT pair_id, side, 'references', cmd || ':' || key FROM {_REFS}
UNION ALL SELECT pair_id, side, 'math', value FROM {_MATH}
UNION ALL SELECT pair_id, side, 'terms', value FROM {_TERMS}"""
_LISTS = """rep AS (SELECT pair_id, category, flatten(list(list_transform(range(removed), lambda i: value) ORDER BY value)) AS gone, flatten(list(list_transform(range(added), lambda i: value) ORDER BY value)) AS came FROM diff GROUP BY ALL)"""
SQL |= {
    "j1_differences": _diff(_IMMUTABLE, "SELECT * FROM diff"),
    "j2_category_report": _diff(_IMMUTABLE, f", {_LISTS} SELECT pair_id, category, array_to_string(gone, '|') AS removed, array_to_string(came, '|') AS added, array_to_string(list_transform(range(1, least(len(gone), len(came)) + 1), lambda i: gone[i] || ' -> ' || came[i]), '|') AS changed, greatest(len(gone), len(came))::INT AS violations FROM rep"),
    "j3_immutable_verdict": _diff(_IMMUTABLE, f", {_LISTS}, v AS (SELECT pair_id, sum(greatest(len(gone), len(came)))::BIGINT AS n FROM rep GROUP BY pair_id) SELECT p.pair_id, coalesce(n, 0)::BIGINT AS violations, n IS NULL AS passed FROM pairs p LEFT JOIN v USING (pair_id)"),
    "j4_frozen_verdict": _diff(_GUARD, ", f AS (SELECT pair_id, list(DISTINCT category ORDER BY category) AS c FROM diff GROUP BY pair_id) SELECT p.pair_id, coalesce(array_to_string(c, ','), '') AS failed, coalesce(len(list_filter(c, lambda x: x <> 'terms')), 0) = 0 AS passed FROM pairs p LEFT JOIN f USING (pair_id)"),
    "p28_claim_classes": f"{SIDES}, pr AS (SELECT pair_id, side, {_dbl(_prose('t'))} AS dbl FROM sides), long AS ({_claim_rows()}) SELECT pair_id, value, count(*)::BIGINT AS n FROM long WHERE side = 'before' GROUP BY ALL",
    "p20_references": f"{SIDES} SELECT pair_id, cmd || ':' || key AS value, count(*)::BIGINT AS n FROM {_REFS} WHERE side = 'before' GROUP BY ALL",
    "p19_numbers": f"{SIDES} SELECT pair_id, {SQ('m')} AS value, count(*)::BIGINT AS n FROM (SELECT pair_id, side, unnest(regexp_extract_all({_DBL_DOT}, {Q(_EDGE_NUMBER)}, 1)) AS m FROM sides WHERE side = 'before') GROUP BY ALL",
    "p22_math": f"{SIDES} SELECT pair_id, value, count(*)::BIGINT AS n FROM {_MATH} WHERE side = 'before' GROUP BY ALL",
    "p27_terms": f"{SIDES} SELECT pair_id, value, count(*)::BIGINT AS n FROM {_TERMS} WHERE side = 'before' GROUP BY ALL",
}


def _occurrences(ladders: dict, side: str) -> str:
    """Words of ladders with their place, by cutting the text at them."""
    parts = []
    for name, tiers in ladders.items():
        level = {w.lower(): k for k, t in enumerate(tiers) for w in t}
        forms = sorted(level, key=lambda f: (-len(f), f))
        case = " ".join(f"WHEN {Q(w)} THEN {k}" for w, k in level.items())
        body = "|".join(forms)
        parts.append(f"""SELECT pair_id, {Q(name)} AS ladder, i AS ordinal, lower(x[2 * i]) AS word, CASE lower(x[2 * i]) {case} END AS level FROM (SELECT pair_id, x, unnest(range(1, (len(x) - 1) // 2 + 1)) AS i FROM (
  SELECT pair_id, string_split(replace(regexp_replace({side}, {Q('(?i)' + chr(92) + 'b(?:' + body + ')' + chr(92) + 'b')}, chr(1) || '\\0' || chr(2), 'g'), chr(2), chr(1)), chr(1)) AS x FROM pairs))""")
    return " UNION ALL ".join(parts)


_NEAR_WORD = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"


def _anchored(name: str, left: str, right: str) -> str:
    """Whether an anchor of the ladder is one of the two words on either side."""
    own = rv.ANCHORS.get(name)
    if not own:
        return "true"
    any_of = "|".join([f"(?i:{a})" for a in own if not a.isupper()] + [a for a in own if a.isupper()])
    before, after = rf"(?:^|[^A-Za-z0-9-])(?:{any_of})(?:\s+{_NEAR_WORD})?\s+$", rf"^\s+(?:{_NEAR_WORD}\s+)?(?:{any_of})(?:[^A-Za-z0-9-]|$)"
    return f"(regexp_matches({left}, {Q(before)}) OR regexp_matches({right}, {Q(after)}))"


def _crypto(side: str) -> str:
    """Words of all eight ladders, with their level, and whether they are anchored."""
    parts = []
    for name, tiers in rv.CRYPTO.items():
        level = {w.lower(): k for k, t in enumerate(tiers) for w in t}
        case = " ".join(f"WHEN {Q(w)} THEN {k}" for w, k in level.items())
        body = "|".join(sorted(level, key=lambda f: (-len(f), f)))
        near = _anchored(name, "array_to_string(x[1:2 * i - 1], '')", "array_to_string(x[2 * i + 1:], '')")
        parts.append(f"""SELECT pair_id, {Q(name)} AS ladder, i, lower(x[2 * i]) AS word, CASE lower(x[2 * i]) {case} END AS level, {near} AS anchored FROM (SELECT pair_id, x, unnest(range(1, (len(x) - 1) // 2 + 1)) AS i FROM (
  SELECT pair_id, string_split(replace(regexp_replace({side}, {Q('(?i)' + chr(92) + 'b(?:' + body + ')' + chr(92) + 'b')}, chr(1) || '\\0' || chr(2), 'g'), chr(2), chr(1)), chr(1)) AS x FROM pairs))""")
    return " UNION ALL ".join(parts)


_NTH = "row_number() OVER (PARTITION BY pair_id, ladder ORDER BY i) AS ordinal"
_CRYPTO = f"""ob AS MATERIALIZED ({_crypto('before')}), nb AS MATERIALIZED ({_crypto('after')}),
oc AS (SELECT *, {_NTH} FROM ob WHERE anchored), nc AS (SELECT *, {_NTH} FROM nb WHERE anchored),
same AS (SELECT pair_id, ladder FROM (SELECT pair_id, ladder, list_sort(list(level)) AS a FROM oc GROUP BY ALL) JOIN (SELECT pair_id, ladder, list_sort(list(level)) AS b FROM nc GROUP BY ALL) USING (pair_id, ladder) WHERE a = b),
cm AS (SELECT pair_id, ladder, ordinal::INT AS ordinal, o.word AS original, n.word AS revised, (n.level - o.level)::INT AS span FROM oc o JOIN nc n USING (pair_id, ladder, ordinal) WHERE n.level <> o.level AND (pair_id, ladder) NOT IN (SELECT (pair_id, ladder) FROM same))"""


def _moves(ladders: dict, where: str, columns: str) -> str:
    return f"""{P}, o AS ({_occurrences(ladders, 'before')}), n AS ({_occurrences(ladders, 'after')})
SELECT {columns} FROM o JOIN n USING (pair_id, ladder, ordinal) WHERE {where}"""


_QUALIFIERS = f"""qx AS (SELECT pair_id, after, string_split(replace(regexp_replace(before, {Q(rv.QUALIFIER)}, chr(1) || '\\0' || chr(2), 'g'), chr(2), chr(1)), chr(1)) AS x FROM pairs),
qm AS (SELECT pair_id, after, x[2 * i] AS match, length(array_to_string(x[1:2 * i - 1], '')) AS start FROM (SELECT *, unnest(range(1, (len(x) - 1) // 2 + 1)) AS i FROM qx)),
gone_q AS (SELECT pair_id, match, start FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, lower(match) ORDER BY start) AS r FROM qm) WHERE r > len(list_filter({ALL('after', rv.QUALIFIER)}, lambda m: lower(m) = lower(match))))"""
_SIGNED = {k: [neg, pos] for k, (pos, neg) in rv.COMPARISONS.items()}
_COLS = "pair_id, ladder, ordinal::INT AS ordinal, o.word AS original, n.word AS revised, (n.level - o.level)::INT AS span"
_NEG = r"(?i)(?:^|[^\p{L}\p{N}_])(not|no|never|without|neither|nor|none|cannot|can['’]t|(?:is|are|was|were|do|does|did|has|have|had|would|should|could|might|must|need)n['’]t)(?:[^\p{L}\p{N}_]|$)"


def _removed(kind: str, pattern: str) -> str:
    """The last matches, by how many their number fell, with their places."""
    mark = f"string_split(regexp_replace(before, {Q(pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    return f"""m AS (SELECT pair_id, {mark} AS x, {N('after', pattern)} AS a FROM pairs), n AS (SELECT pair_id, x, a, (len(x) - 1) // 2 AS b FROM m),
i AS (SELECT pair_id, x, unnest(range(a + 1, b + 1)) AS k FROM n WHERE b > a)
SELECT pair_id, {Q(kind)} AS kind, x[2 * k] AS match, length(array_to_string(x[1:2 * k - 1], ''))::INT AS start FROM i"""


SQL |= {
    "j5_strength_moves": _moves(rv.LADDERS, "n.level <> o.level", _COLS),
    "j12_crypto_moves": f"{P}, {_CRYPTO} SELECT * FROM cm",
    "j13_candidates": f"""{P}, {_CRYPTO}, oa AS (SELECT *, {_NTH} FROM ob WHERE ladder IN ({", ".join(Q(x) for x in rv.ANCHORS)})), na AS (SELECT *, {_NTH} FROM nb)
SELECT pair_id, ladder, o.word AS original, n.word AS revised FROM oa o JOIN na n USING (pair_id, ladder, ordinal) WHERE n.level > o.level AND NOT (o.anchored AND n.anchored)""",
    "j8_removed_qualifiers": f"""{P}, {_QUALIFIERS} SELECT pair_id, match, start::INT AS start FROM gone_q""",
    "strength_verdict": f"""{P}, {_CRYPTO}, {_QUALIFIERS}, up AS (SELECT pair_id FROM ({_moves(rv.LADDERS, "n.level > o.level", "pair_id").replace(P + ",", "WITH ", 1)})),
fl AS (SELECT pair_id FROM ({_moves(_SIGNED, "n.level <> o.level", "pair_id").replace(P + ",", "WITH ", 1)})),
c AS (SELECT pair_id, {ALL('before', rv.NEGATION)} AS nb, {N('after', rv.NEGATION)} AS na, {N('before', rv.MODAL)} - {N('after', rv.MODAL)} AS m FROM pairs),
k AS (SELECT pair_id, greatest(len(nb) - na, 0) AS n, len(list_filter(nb[greatest(na, 0) + 1:], lambda x: lower(x) = 'no')) AS no, greatest(m, 0) AS m FROM c),
sp AS (SELECT pair_id, count(*) AS spared FROM cm WHERE span < 0 AND ladder = 'leakage' AND original = 'no leakage' GROUP BY pair_id),
t AS (SELECT pair_id, (SELECT count(*) FROM up WHERE up.pair_id = p.pair_id)::BIGINT AS upward, (k.n - least(CASE WHEN k.n > 0 THEN k.no ELSE 0 END, coalesce(spared, 0)))::BIGINT AS negations, k.m::BIGINT AS modals, (SELECT count(*) FROM fl WHERE fl.pair_id = p.pair_id)::BIGINT AS flips,
  (SELECT count(*) FROM gone_q g WHERE g.pair_id = p.pair_id)::BIGINT AS qualifiers, (SELECT count(*) FROM cm WHERE cm.pair_id = p.pair_id AND span > 0)::BIGINT AS crypto_upward FROM pairs p JOIN k USING (pair_id) LEFT JOIN sp USING (pair_id))
SELECT *, upward + negations + modals + flips + qualifiers + crypto_upward = 0 AS passed FROM t""",
    "p14_claim_prose": f"{P} SELECT pair_id, {SQ(_prose('after'))} AS prose FROM pairs",
    "j6_comparison_flips": _moves(_SIGNED, "n.level <> o.level", "pair_id, ladder AS \"group\", ordinal::INT AS ordinal, o.word AS original, n.word AS revised"),
    "j7_removed": " UNION ALL ".join(f"SELECT * FROM ({P}, {_removed(kind, p)})" for kind, p in (("modal", rv.MODAL), ("negation", rv.NEGATION))),
}


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else "[" + ", ".join(Q(x) for x in v) + "]::VARCHAR[]" if isinstance(v, list) else Q(v) if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _blanked(x: str, pattern: str) -> str:
    """Matches as blanks that keep lines: each is set between two control characters."""
    cut = f"string_split(regexp_replace({x}, {Q('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    blank = "CASE WHEN contains(s, chr(2)) THEN regexp_replace(split_part(s, chr(2), 1), '[^\\n]', ' ', 'g') || substr(s, length(split_part(s, chr(2), 1)) + 2) ELSE s END"
    return f"array_to_string(list_transform({cut}, lambda s: {blank}), '')"


_REGIONS = [r"(?is)\\begin\s*\{\s*(?:equation|align|gather)\*?\s*\}.*?\\end\s*\{\s*(?:equation|align|gather)\*?\s*\}", r"(?s)\$\$.*?\$\$|\$.*?\$", r"(?i)\\(?:[a-z]*(?:ref|label)|[a-z]*cite[a-z]*)\*?(?:\s*\[[^\]]*\])*\s*\{[^{}]*\}", r"\\[A-Za-z]+\*?"]


def _merged_rows() -> list[tuple]:
    last: dict[str, tuple] = {}
    for r in gl.LAYERS:
        last[r[2].lower()] = r
    return list(last.values())


def _term_findings(residual: bool) -> str:
    """Each form is sought by splitting at it; places are sums of lengths."""
    forms, terms = [], []
    for k, (_, _, term, short, synonyms, variants) in enumerate(_merged_rows()):
        for kind, own in (("forbidden_synonym", synonyms), ("plural_or_hyphen_variant", variants)):
            forms += [(k, kind, f) for f in own]
        forms.append((k, "term", term))
        if short:
            forms.append((k, "short", short))
        terms.append((k, term))
    masks = ["pairs"]
    with_ = []
    for n, p in enumerate(_REGIONS):
        with_.append(f"k{n} AS (SELECT pair_id, {_blanked('before', p)} AS before, {_blanked('after', p)} AS after FROM {masks[-1]})")
        masks.append(f"k{n}")
    spare = "0" if residual else "coalesce(o.n, 0)"
    mixed = "(f.a_short AND f.a_full) OR (f.b_full AND NOT f.b_short AND f.a_short)" if residual else "f.b_full AND NOT f.b_short AND f.a_short"
    return f"""{P}, {", ".join(with_)}, sd AS MATERIALIZED (SELECT pair_id, 'b' AS side, before AS t FROM {masks[-1]} UNION ALL SELECT pair_id, 'a', after FROM {masks[-1]}),
g(k, kind, form) AS (VALUES {_values(forms)}), tm(k, term) AS (VALUES {_values(terms)}),
sp AS (SELECT pair_id, side, t, k, kind, form, string_split(lower(t), lower(form)) AS x FROM sd, g WHERE contains(lower(t), lower(form))),
at0 AS (SELECT pair_id, side, t, k, kind, form, (list_sum(list_transform(x[1:i], lambda y: length(y))) + (i - 1) * length(form))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(x))) AS i FROM sp)),
m AS MATERIALIZED (SELECT pair_id, side, k, kind, form, start, substr(t, start + 1, length(form)) AS observed, substr(t, 1, start) AS prefix FROM at0
  WHERE NOT regexp_matches(substr(' ' || t, start + 1, 1) || substr(t, start + length(form) + 1, 1), '[A-Za-z0-9]')),
f AS (SELECT pair_id, k, bool_or(side = 'a' AND kind = 'term') AS a_full, bool_or(side = 'b' AND kind = 'term') AS b_full, bool_or(side = 'a' AND kind = 'short' AND observed = form) AS a_short, bool_or(side = 'b' AND kind = 'short' AND observed = form) AS b_short FROM m GROUP BY ALL),
fb AS (SELECT *, form AS spelling FROM m WHERE kind IN ('forbidden_synonym', 'plural_or_hyphen_variant')
  UNION ALL SELECT pair_id, side, k, 'case_inconsistency', form, start, observed, prefix, observed FROM m WHERE kind = 'term' AND observed <> form AND NOT (observed = upper(form[1]) || form[2:] AND (start = 0 OR regexp_matches(prefix, '(?:[.!?:][ \\t]+|\\n[ \\t]*)$')))),
o AS (SELECT pair_id, k, kind, spelling, count(*) AS n FROM fb WHERE side = 'b' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, k, kind, spelling ORDER BY start) AS i FROM fb WHERE side = 'a'),
u AS (SELECT r.pair_id, r.k, r.kind, r.observed, r.start, r.prefix FROM r LEFT JOIN o USING (pair_id, k, kind, spelling) WHERE r.i > {spare}
  UNION ALL SELECT m.pair_id, m.k, 'abbreviation_full_name_mix', m.observed, m.start, m.prefix FROM m JOIN f USING (pair_id, k)
  WHERE m.side = 'a' AND ((({mixed}) AND m.kind = 'short' AND m.observed = m.form) OR (NOT ({mixed}) AND f.b_short AND NOT f.b_full AND m.kind = 'term')))
SELECT DISTINCT pair_id, term, kind, observed, start::INT AS start, (length(prefix) - length(replace(prefix, chr(10), '')) + 1)::INT AS line, (length(split_part(prefix, chr(10), -1)) + 1)::INT AS "column" FROM u JOIN tm USING (k)"""


SQL |= {"j11_term_findings": _term_findings(False), "j11_term_residual": _term_findings(True)}

TURNS = "stages AS (SELECT conv_id AS series, turn AS stage, coalesce(text, '') AS text FROM conversations)"
_NEXT = "adj AS (SELECT series, stage, lead(stage) OVER w AS next_stage, text AS before, lead(text) OVER w AS after FROM stages WINDOW w AS (PARTITION BY series ORDER BY stage)), pr AS (SELECT * FROM adj WHERE next_stage IS NOT NULL)"


def _common(items: str) -> str:
    return f"""WITH {TURNS}, k AS (SELECT series, count(DISTINCT stage) AS n FROM stages GROUP BY series),
i AS (SELECT series, stage, unnest(v) AS spelling, generate_subscripts(v, 1) AS pos FROM (SELECT series, stage, {items} AS v FROM stages)),
g AS (SELECT series, lower(spelling) AS key, count(DISTINCT stage) AS m, min_by(spelling, stage * 1000000 + pos) AS spelling FROM i GROUP BY ALL)
"""


_SHINGLES = f"list_filter(list_transform(range(1, greatest(len(w) - 3, 0) + 1), lambda j: w[j:j + 3]), lambda r: list_max(list_transform(r, lambda x: length(x))) >= 6)"
SQL |= {
    "j19_adjacent_stages": f"WITH {TURNS}, {_NEXT} SELECT series, stage, next_stage, length(before)::INT AS size_before, length(after)::INT AS size_after FROM pr",
    "j20_drivers": f"WITH {TURNS}, {_NEXT} SELECT driver, count(*)::BIGINT AS pairs FROM (SELECT CASE WHEN (stage, next_stage) IN ((0, 1), (2, 3)) THEN 'reviewer-driven' WHEN (stage, next_stage) IN ((1, 2)) THEN 'author-advisor' ELSE 'unclassified' END AS driver FROM pr) GROUP BY driver",
    "j22_common_words": _common(WORDS("text")) + "SELECT series, key, g.spelling FROM g JOIN k USING (series) WHERE m = n",
    "j22_common_expressions": f"""WITH {seed.PAIRS_SQL}, stages AS (SELECT pair_id AS series, 0 AS stage, before AS text FROM pairs UNION ALL SELECT pair_id, 1, after FROM pairs), k AS (SELECT series, count(DISTINCT stage) AS n FROM stages GROUP BY series),
sw AS (SELECT series, stage, list_transform({WORDS('text')}, lambda x: lower(x)) AS w FROM stages), sh AS (SELECT series, stage, unnest({_SHINGLES}) AS r FROM sw),
g AS (SELECT series, array_to_string(r, ' ') AS expression, count(DISTINCT stage) AS m FROM sh GROUP BY ALL),
p AS (SELECT series, expression, row_number() OVER (PARTITION BY series ORDER BY expression)::INT AS place FROM g JOIN k USING (series) WHERE m = n)
SELECT series, place, expression FROM p WHERE place <= 20""",
    "j23_without_reserved": f"WITH {TURNS}, pa AS (SELECT series, stage, (generate_subscripts(x, 1) - 1)::INT AS par_no, unnest(x) AS p FROM (SELECT series, stage, string_split(text, chr(10)) AS x FROM stages)) SELECT series, stage, par_no, length(p)::INT AS size FROM pa WHERE NOT (stage = 1 AND par_no = 0)",
}

TWO = "two AS (SELECT pair_id AS series, 0 AS stage, before, after FROM pairs)"
_NUM = r"\d+(?:\.\d+)?"


def _two_reports() -> str:
    """Rule counts of both sides of the pairs."""
    body = REPORT.split("\ns AS (SELECT", 1)[1]
    return f"WITH {seed.PAIRS_SQL}, docs AS (SELECT pair_id * 2 AS doc_id, before AS text FROM pairs UNION ALL SELECT pair_id * 2 + 1, after FROM pairs), s AS (SELECT{body}"


_CHANGED = "ch AS (SELECT b.doc_id // 2 AS series, b.rule, b.hits AS n_before, a.hits AS n_after FROM rep b JOIN rep a ON a.doc_id = b.doc_id + 1 AND a.rule = b.rule WHERE b.doc_id % 2 = 0)"
_R4 = lambda x: f"round(({x})::DOUBLE, 4)"
#: all metrics of the target family, at four places
_FULL = f"""alt AS (SELECT doc_id, avg(g) AS alternation FROM (SELECT doc_id, par_no, avg(abs(n - prev)) AS g FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id, par_no ORDER BY k) AS prev FROM sen) WHERE prev IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
op AS (SELECT doc_id, count(DISTINCT opening) AS kinds, count(DISTINCT opening) FILTER (k = 0) AS first_kinds, count(*) FILTER (k = 0) AS firsts FROM sen GROUP BY doc_id),
raw_m AS (SELECT doc_id, paragraph_count, word_count, coalesce(sentence_count, 0) AS sentence_count, greatest(coalesce(sentence_count, 0), 1) AS safe, coalesce(kinds, 0) AS kinds, coalesce(first_kinds, 0) AS first_kinds, coalesce(firsts, 0) AS firsts, coalesce(max_h, 0) AS max_h, coalesce(claims, 0) AS claims, contribution_move_count, limitation_move_count, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, w2, coalesce(alternation, 0) AS alternation, coalesce(con, 0) AS con, coalesce(passive, 0) AS passive, first_person, coalesce(hedges, 0) AS hedges
  FROM ps LEFT JOIN ss USING (doc_id) LEFT JOIN alt USING (doc_id) LEFT JOIN op USING (doc_id)),
full_m AS (SELECT doc_id, paragraph_count, word_count, sentence_count, kinds, first_kinds, firsts, max_h, claims, contribution_move_count, limitation_move_count, {_R4('n1 / safe')} AS mean_sentence_length,
  {_R4('sqrt(greatest(0.0::DOUBLE, (n2 * sentence_count - n1 * n1)::DOUBLE)) / safe')} AS sentence_length_sd, {_R4('word_count / paragraph_count')} AS mean_paragraph_words, {_R4('sqrt(greatest(0.0::DOUBLE, (w2 * paragraph_count - word_count * word_count)::DOUBLE)) / paragraph_count')} AS paragraph_word_sd,
  {_R4('sentence_count / paragraph_count')} AS mean_sentences_per_paragraph, {_R4('alternation')} AS alternation_index, {_R4('con / safe')} AS connective_density, {_R4('(sentence_count - passive) / safe')} AS active_sentence_ratio, {_R4('passive / safe')} AS passive_sentence_ratio,
  {_R4('first_person * 1000 / greatest(word_count, 1)')} AS first_person_per_1000_words, {_R4('hedges * 1000 / greatest(word_count, 1)')} AS hedges_per_1000_words FROM raw_m)"""
_PAPERS = ", ".join(f"avg({e}) AS {m}" for m, e in {"mean_sentence_length": "n1::DOUBLE / safe", "sentence_length_sd": "sqrt(greatest(0.0::DOUBLE, (n2 * sentence_count - n1 * n1)::DOUBLE)) / safe", "alternation_index": "alternation", "connective_density": "con / safe", "em_dash_per_1000_words": "em_dashes * 1000 / greatest(word_count, 1)"}.items())
SQL["a4_baseline"] = f"""{DOC_BLOCK}, {_FULL}, paper AS (SELECT source, {_PAPERS} FROM raw_m JOIN docs USING (doc_id) JOIN (SELECT doc_id, em_dashes FROM ps) USING (doc_id) GROUP BY source)
SELECT count(*)::BIGINT AS paper_count, CASE WHEN count(*) < 5 THEN 'thin(n=' || count(*) || ')' ELSE 'ok' END AS status, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_sd" for m in fp.BASELINE)} FROM paper"""
_THIN = {
    "sentence_length": ("6, 7, 8, 10, 12, 13, 14", "sentence_count < 4 OR sentence_length_sd < 4", "sentence sample or variance below policy threshold"),
    "paragraph_length": ("8", "paragraph_count < 2", "fewer than 2 paragraphs"),
    "opening_structure": ("5, 6", "paragraph_count < 2 OR firsts < 2 OR first_kinds < 2", "fewer than 2 paragraphs with 2 distinct paragraph-opening types"),
    "connectives": ("5", "connective_density > 0.6::DOUBLE", "connective density exceeds policy threshold"),
    "active_passive_by_section": ("", "sentence_count < 4", "too few sentences for a voice ratio"),
    "first_person": ("", "word_count < 50", "fewer than 50 words"),
    "hedging": ("9", "max_h = 0", "no hedge observation"),
    "claim_position": ("1, 2, 3", "claims = 0", "no claim-position observation"),
    "contribution_limitation_moves": ("1, 2, 3", "contribution_move_count = 0 AND limitation_move_count = 0", "no contribution or limitation move observed"),
}
_SCREENS = ", ".join(f"{{'dimension': {Q(d)}, 'hit': list_filter(coalesce(rules, []), lambda r: list_contains([{r}]::INT[], r)), 'thin': {c}, 'why': {Q(w)}}}" for d, (r, c, w) in _THIN.items())
SQL |= {
    "a9_rule_changes": f"{_two_reports()}, {_CHANGED} SELECT series::BIGINT AS series, rule, n_before, n_after FROM ch WHERE n_before <> n_after",
    "a12_change_passes": f"""{_two_reports()}, {_CHANGED}, r AS (SELECT series, bool_or(n_before <> n_after) AS any_rule, bool_or(rule = 3 AND n_before <> n_after) AS three FROM ch GROUP BY series)
SELECT pair_id AS series, CASE WHEN before = after THEN 'equal' ELSE 'modified' END AS status,
  array_to_string(list_filter([CASE WHEN {ALL('before', hi.CLAIM_WORDS)} <> {ALL('after', hi.CLAIM_WORDS)} THEN 'P1' END, CASE WHEN three THEN 'P3' END, CASE WHEN before <> after THEN 'P4' END, CASE WHEN any_rule THEN 'P5' END], lambda x: x IS NOT NULL), ',') AS passes FROM pairs JOIN r ON r.series = pair_id""",
    "a21_rule_convergence": f"""{_two_reports()}, {_CHANGED}, t AS (SELECT series, rule, n_before, n_after AS n_output, (rule % 3 = 0)::INT AS n_target FROM ch),
x AS (SELECT series, sum(abs(n_before - n_target))::BIGINT AS initial, sum(CASE WHEN n_before <> n_target THEN abs(n_output - n_target) ELSE 0 END)::BIGINT AS revised, count_if(n_before = n_target AND n_output <> n_target)::BIGINT AS off_target FROM t GROUP BY series)
SELECT series::BIGINT AS series, initial, revised, off_target, CASE WHEN off_target > 0 THEN 'worsened' WHEN initial = 0 THEN 'insufficient_signal' WHEN revised < initial THEN 'improved' WHEN revised = initial THEN 'unchanged' ELSE 'worsened' END AS status FROM x""",
    "a13_screening": f"""{DOC_BLOCK}, {_FULL}, {REPORT.split(',' + chr(10), 1)[1]},
h AS (SELECT doc_id, list(rule ORDER BY rule) AS rules FROM rep WHERE hits > 0 GROUP BY doc_id),
d AS (SELECT doc_id, unnest([{_SCREENS}], recursive := true) FROM full_m LEFT JOIN h USING (doc_id)),
w AS (SELECT doc_id, dimension, list_filter([CASE WHEN len(hit) > 0 THEN 'AI-tell rules hit: [' || array_to_string(hit, ', ') || ']' END, CASE WHEN thin THEN why END], lambda x: x IS NOT NULL) AS why FROM d)
SELECT doc_id, dimension, CASE WHEN len(why) = 0 THEN 'exemplar' ELSE 'rule' END AS source, CASE WHEN len(why) = 0 THEN 'clean and sufficiently observed' ELSE array_to_string(why, '; ') END AS reason FROM w""",
    "a19_preflight": f"""{DOC_BLOCK}, {_FULL}, {REPORT.split(',' + chr(10), 1)[1]},
h AS (SELECT doc_id, list('P5_AI_R' || lpad(rule::VARCHAR, 2, '0')) AS rules FROM rep WHERE hits > 0 GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list_concat(list_filter([CASE WHEN sentence_count >= 4 AND NOT mean_sentence_length BETWEEN 12 AND 30 THEN 'P4_RULE_SENTENCE_MEAN_OUT_OF_RANGE' END,
  CASE WHEN sentence_count >= 4 AND sentence_length_sd < 4 AND kinds <= 1 THEN 'P4_RULE_SENTENCE_SD_LOW' END, CASE WHEN paragraph_count > 1 AND NOT mean_paragraph_words BETWEEN 40 AND 180 THEN 'P4_PARAGRAPH_WORDS_OUT_OF_RANGE' END,
  CASE WHEN paragraph_count > 1 AND NOT mean_sentences_per_paragraph BETWEEN 2 AND 7 THEN 'P4_PARAGRAPH_SENTENCES_OUT_OF_RANGE' END, CASE WHEN connective_density > 0.6::DOUBLE THEN 'P5_CONNECTIVE_DENSITY_ABOVE_LIMIT' END], lambda x: x IS NOT NULL), coalesce(rules, []))) AS g FROM full_m LEFT JOIN h USING (doc_id))
SELECT doc_id, array_to_string(g, ',') AS triggers, CASE WHEN len(g) > 0 THEN 'revise' ELSE 'preserve' END AS decision FROM t""",
    "a20_distances": f"""WITH {seed.PAIRS_SQL}, src AS (SELECT pair_id * 2 AS doc_id, before AS text FROM pairs UNION ALL SELECT pair_id * 2 + 1, after FROM pairs), {_block("text", "doc_id")}, {_FULL},
c AS (SELECT (b.doc_id // 2)::BIGINT AS doc_id, b, o, t, least(b.paragraph_count, o.paragraph_count, t.paragraph_count) < 2 AS few FROM full_m b JOIN full_m o ON o.doc_id = b.doc_id + 1 JOIN full_m t ON t.doc_id = b.doc_id - 2 WHERE b.doc_id % 2 = 0),
e AS (SELECT doc_id, few, unnest([{", ".join(f"{{'metric': {Q(m)}, 'b': b.{m}, 'o': o.{m}, 't': t.{m}}}" for m in tg.METRICS)}], recursive := true) FROM c),
g AS (SELECT *, round(abs(b - t), 6) AS gb, round(abs(o - t), 6) AS go, greatest(abs(t), 1) AS scale FROM e)
SELECT doc_id, metric, CASE WHEN gb = 0 AND go > 0 THEN 'diverged_from_exact_match' WHEN gb = 0 THEN 'exact_match_preserved' WHEN go < gb THEN 'closer' WHEN go = gb THEN 'unchanged' ELSE 'farther' END AS status,
  metric <> 'active_sentence_ratio' AND NOT (few AND metric IN ('mean_paragraph_words', 'paragraph_word_sd', 'mean_sentences_per_paragraph')) AS eligible, CASE WHEN gb > 0 THEN round((1 - go / gb) * 100, 4) END AS convergence, gb / scale AS scaled_before, go / scale AS scaled_output FROM g""",
}

_LINK = '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
_LINKS = f"""lk AS (SELECT page_id, url, (i - 1)::INT AS place, trim(h[i]) AS href, t[i] AS tx FROM (SELECT page_id, url, h, t, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, {Q(_LINK)}, 1) AS h, regexp_extract_all(html, {Q(_LINK)}, 2) AS t FROM pages))),
links AS (SELECT page_id, place, {SQ("regexp_replace(tx, '<[^>]*>', ' ', 'g')")} AS text, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target FROM lk)"""
_PICK = lambda n, *v: f"([{', '.join(v)}])[conv_id % {n} + 1]"
_ESC = lambda x: f"replace(replace(replace(replace({x}, chr(92), chr(92) || 'textbackslash{{}}'), '{{', chr(92) || '{{'), '}}', chr(92) || '}}'), '&', chr(92) || '&')"
_FIELD = lambda name, v: f"CASE WHEN {v} <> '' THEN '  {name} = {{' || {_ESC(v)} || '}},' END"
_BIB = f"""r AS (SELECT conv_id, trim({_PICK(3, "'T'", "'the {map} '", "'A' || chr(92) || 'B '")} || conv_id) AS title, {_PICK(4, "'Journal X'", "'Workshop & Co'", "'USENIX'", "'arXiv'")} AS venue, (2000 + min(turn) + conv_id % 20)::VARCHAR AS year,
  {_PICK(5, "'10.1/x'", "''", "''", "''", "''")} AS doi, {_PICK(5, "'2001.1'", "'a=b'", "'7'", "''", "''")} AS eprint, {_PICK(5, "'arXiv'", "'IACR Cryptology ePrint Archive'", "'IACR Cryptology ePrint Archive'", "''", "''")} AS archive,
  'Distilled source' || CASE WHEN conv_id % 2 = 0 THEN '; primary direction: maps' ELSE '' END || CASE WHEN conv_id % 7 = 0 THEN '; secondary directions: a; b' ELSE '' END AS note FROM conversations GROUP BY conv_id),
rows AS (SELECT *, row_number() OVER (ORDER BY year, lower(title), title)::INT AS place, {_PICK(4, "'article'", "'misc'", "'inproceedings'", "'misc'")} AS kind, {_PICK(4, "'journal'", "'howpublished'", "'booktitle'", "'howpublished'")} AS venue_field FROM r)"""
SQL |= {
    "src16_links": f"WITH {_LINKS} SELECT * FROM links",
    "p34_keyword_links": f"WITH {_LINKS} SELECT page_id, place, target FROM links WHERE contains(lower(text), 'the') OR contains(lower(text), 'und')",
    "w8_links_per_page": f"WITH {_LINKS} SELECT page_id, target FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS r FROM links) WHERE r <= 3",
    "a28_coverage": "SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY ALL",
    "snk4_bibliography": f"""WITH {_BIB} SELECT place, kind, concat_ws(chr(10), '@' || kind || '{{source-' || year || '-' || lower(left(trim(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '-'), 60)) || ',', {_FIELD('title', 'title')}, {_FIELD('year', 'year')},
  '  ' || venue_field || ' = {{' || {_ESC('venue')} || '}},', {_FIELD('doi', 'doi')}, {_FIELD('eprint', 'eprint')}, {_FIELD('archivePrefix', 'archive')}, {_FIELD('note', 'note')}, '  sourceIndex = {{' || CASE WHEN place > 999 THEN place::VARCHAR ELSE lpad(place::VARCHAR, 3, '0') END || '}}', '}}') AS entry FROM rows""",
    "j25_hashed_tokens": f"SELECT doc_id, line_no::INT AS line_no, sha256(t) AS digest, count(*)::BIGINT AS n FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9][a-z0-9_.-]*')) AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)) WHERE t IN ('than', 'license', 'idiot') GROUP BY ALL",
    "a27_manifest": "SELECT source, count(*)::BIGINT AS files, sha256(string_agg(lpad(doc_id::VARCHAR, 20, '0') || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY lpad(doc_id::VARCHAR, 20, '0'))) AS digest FROM documents GROUP BY source",
    "j27_manifest_diff": "WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 11 <> 0) SELECT doc_id, CASE WHEN b.t IS NULL THEN 'source_only' WHEN a.t IS NULL THEN 'installed_only' WHEN a.t <> b.t THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b USING (doc_id)",
    "p38_sensitivity": D + f"SELECT *, unpublished OR quantities > 0 OR reviews > 0 AS flagged FROM (SELECT doc_id, contains(lower(text), 'unpublished') AS unpublished, {N('text', co.QUANTITY)}::BIGINT AS quantities, {N('text', co.REVIEW)}::BIGINT AS reviews FROM docs)",
    "p37_flagged_lines": D + f"""SELECT doc_id, i::INT AS line_no, unnest(list_filter([CASE WHEN regexp_matches(line, {Q(co.NUMERIC.replace('(?![A-Za-z0-9])', '(?:[^A-Za-z0-9]|$)'))}) AND NOT contains(line, '<!-- allow-numeric -->') AND NOT regexp_matches(line, {Q('(?i)^\\s*(?:[-*+]\\s*)*(?:' + '|'.join(co.ALLOWED) + ')')}) THEN 'numeric' END, CASE WHEN regexp_matches(line, {Q(co.PREPRINT)}) THEN 'preprint' END], lambda x: x IS NOT NULL)) AS kind
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)""",
    "snk8_upsert": "SELECT doc_id, 'new' AS origin FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "j29_wiring": D + "SELECT a.anchor, count(l.line)::BIGINT AS n, count(l.line) = 1 AS wired FROM (VALUES ('technical packaging'), ('no such anchor'), ('Introduction')) a(anchor) LEFT JOIN (SELECT unnest(string_split(text, chr(10))) AS line FROM docs) l ON contains(l.line, a.anchor) GROUP BY a.anchor",
    "j30_missing_labels": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j26_rule_sets": "SELECT lang, 'missing' AS side FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('en', 'it') UNION ALL SELECT 'it', 'extra'",
    "a29_command_coverage": D + "SELECT source, count_if(regexp_matches(text, '\\\\cite'))::BIGINT AS cite, count_if(regexp_matches(text, '\\\\ref'))::BIGINT AS ref, count_if(regexp_matches(text, '\\\\label'))::BIGINT AS label FROM docs GROUP BY source",
    "g10_direction_matrix": f"{REPORT} SELECT lang, rule, sum(hits)::BIGINT AS hits FROM rep JOIN docs USING (doc_id) GROUP BY ALL",
}
