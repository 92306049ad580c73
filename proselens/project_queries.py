"""Registered queries of lineage, places, graphs, approvals, hashes, pages and the
evaluation of targets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, record_queries
from .functions import text as tx
from .operators import approvals, candidates, corpus, fingerprint, glossary, hashed, intervals, lineage, profiles, records, revision, rules, targets
from .plans import seed

S = SparkSession
Q = oracles.Q
#: pairs of stages that a reviewer drove, and that an advisor did
REVIEWER, ADVISOR = [(1, 2)], [(2, 3)]
#: what the queries of pages look for
KEYWORDS = ("the", "und")


def _stages(s: S, d: str) -> DataFrame:
    """Three stages of each document: as it is, revised, and with moved markers."""
    one = seed.pairs(s, d).select(F.col("pair_id").alias("series"), "before", F.col("after").alias("second"))
    two = seed.moved_pairs(s, d).select(F.col("pair_id").alias("series"), F.col("after").alias("third"))
    side = lambda df, n, c: df.select("series", F.lit(n).alias("stage"), F.col(c).alias("text"))
    return side(one, 1, "before").unionByName(side(one, 2, "second")).unionByName(side(two, 3, "third"))


def _turns(s: S, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("series"), F.col("turn").alias("stage"), "text")


def _links(s: S, d: str) -> DataFrame:
    return lineage.aligned(lineage.paragraphs(_stages(s, d)))


def _report(s: S, d: str) -> DataFrame:
    return lineage.report(_links(s, d), REVIEWER, ADVISOR)


def _flat_report(s: S, d: str) -> DataFrame:
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias(c)
    return _report(s, d).withColumns({"dominant": F.array_join("dominant", ",")}).select("series", "stage", "next_stage", "driver", "included", *lineage.STATUSES, named("passes"), named("rules"), "dominant")


def _lines(s: S, d: str) -> DataFrame:
    pars = lineage.paragraphs(_turns(s, d))
    return lineage.lines(pars, lineage.aligned(pars))


def _changes(s: S, d: str) -> DataFrame:
    rows = lineage.changes(_links(s, d))
    return rows.select("series", "stage", "next_stage", "status", "before_no", "after_no", "section", "similarity", F.array_join(F.transform("rule_ids", lambda x: x.cast("string")), ",").alias("rule_ids"), F.array_join("passes", ",").alias("passes"))


def _in_context(s: S, d: str) -> DataFrame:
    docs = seed.documents(s, d)
    found = rules.located(docs, only=[n for n, _, _ in rules.PATTERNS])
    return intervals.in_context(found.select("doc_id", "rule", "start"), docs.select("doc_id", "text"))


def _tree(s: S, d: str) -> DataFrame:
    """The files that folder f0 leads to, by real mentions."""
    files = record_queries._files(s, d)
    edges = records.mentions(files).select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    return corpus.reachable(edges, files.select(F.col("path").alias("node")).where("node like 'f0/%'"))


def _totals(s: S, d: str) -> DataFrame:
    return records.totals(record_queries._files(s, d).select(F.col("path").alias("node")), _tree(s, d))


def _manifests(s: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Revisions as targets, with the labels as screening, and manifests of most of
    them, some of them false, late or without a zone."""
    docs = seed.pairs(s, d).select("pair_id", "before", F.col("after").alias("target"))
    labels = s.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    screening = F.concat(F.lit("quality="), F.coalesce(F.col("quality").cast("string"), F.lit("none")))
    frozen = revision.frozen_verdict(seed.pairs(s, d)).select("pair_id", F.col("passed").alias("frozen"))
    cases = docs.join(labels, docs["pair_id"] == labels["doc_id"], "left").join(frozen, "pair_id").select("pair_id", "before", "target", screening.alias("screening"), "frozen")
    k = F.col("pair_id")
    of = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), k % n)
    digest = lambda c, n: F.when(k % n == 3, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.col(c), 256)).alias(f"{c}_sha256")
    rows = cases.where("pair_id % 10 <> 7").select("pair_id", of(19, *["approved-style-target-v1"] * 18, "v0").alias("schema"), F.lit("author-approved").alias("source"), of(11, *["approved"] * 10, "pending").alias("approval_status"), (k % 13 != 2).alias("content_stable_confirmed"), of(7, "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+01:00", "2026-01-02T03:04:05", "2026-02-30T03:04:05Z", "2026-01-02T03:04Z", "soon", "2026-01-02 03:04:05.5-0930").alias("approved_utc"), digest("before", 17), digest("target", 23), digest("screening", 29))
    return cases, rows.unionByName(rows.where("pair_id % 31 = 4"))


def _hashed(s: S, d: str) -> DataFrame:
    """Identifiers that hold a word of a list, of which only digests are given: the
    sources of the documents and some words."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    words = docs.select(F.lower("source").alias("w")).where("w is not null").distinct().unionByName(s.createDataFrame([("than",), ("licens",), ("idiot",)], "w string"))
    return hashed.hits(docs, words.select(F.sha2("w", 256).alias("digest")))


def _pages(s: S, d: str) -> DataFrame:
    """The pages; links to the first half of the alphabet lead to files."""
    html = F.regexp_replace("html", r'href="/([a-mA-M][^"]*)"', 'href="/$1.pdf"')
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", html.alias("html"))


def _landed(s: S, d: str) -> DataFrame:
    """Each page as a candidate by its title, and the file that it leads to."""
    pages = _pages(s, d)
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1)
    own = pages.select("page_id", title.alias("title"), F.col("url").alias("source_url"), F.lit("").alias("pdf_url"))
    return candidates.landed(own, pages).select("page_id", "title", "pdf_url")


def _cases(s: S, d: str) -> DataFrame:
    """Three texts of each case: a document, its revision, and a target: the revision, the
    document itself, another passage behind the document, or the revision with a
    closing paragraph."""
    k = F.col("pair_id")
    # all texts of a case come from its document, which is read once; documents are dealt
    # by their ids, as one file may be one task
    docs = s.read.parquet(f"{d}/documents.parquet").where("doc_id is not null").select("doc_id", "text").repartition("doc_id")
    other = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), F.lit(seed.PASSAGES[9]), F.lit(" "), F.lit(seed.PASSAGES[0]))
    rows = seed.revised(docs, other.alias("other"))
    target = F.when(k % 4 == 0, F.col("after")).when(k % 4 == 1, F.col("before")).when(k % 4 == 2, F.col("other")).otherwise(seed.moved_after())
    return rows.select("pair_id", "before", F.col("after").alias("output"), target.alias("target"))


def _evaluated(s: S, d: str) -> DataFrame:
    return targets.evaluated(_cases(s, d), "pair_id")


def _glossary(s: S, d: str) -> DataFrame:
    """A glossary of the corpus: a document's first two words are a term; the words
    behind them, or the term and one more, are forms to avoid.  Copies and documents that
    begin alike override each other."""
    k = F.col("doc_id")
    w = tx.words(F.coalesce("text", F.lit("")))
    word = lambda i: F.get(F.col("_w"), F.lit(i))
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.slice(w, 1, 5).alias("_w")).where(F.size("_w") > 4)
    term = F.concat(word(0), F.when(k % 2 == 0, "-").otherwise(" "), word(1))
    synonyms = F.when(k % 4 < 2, F.array(F.concat(term, F.lit(" "), word(2)))).otherwise(F.array(word(2), F.concat(word(3), F.lit(" "), word(4))))
    return rows.select(F.concat(F.lit("L"), (k % 3).cast("string")).alias("layer"), k.alias("pos"), term.alias("term"), F.when(k % 5 > 1, F.upper(F.concat(F.left(word(0), F.lit(1)), F.left(word(1), F.lit(1))))).alias("abbreviation"), synonyms.alias("synonyms"), glossary.derived_variants(term).alias("variants"))


def _joined(entries: DataFrame) -> DataFrame:
    return entries.withColumns({x: F.array_join(x, "|") for x in ("synonyms", "variants")})


def _profiles(s: S, d: str) -> DataFrame:
    """A profile for each source, from its first document with prose; the last source's
    is of the earlier schema."""
    docs = seed.documents(s, d)
    with_prose = fingerprint.paragraph_rows(fingerprint.plain(docs), ["doc_id", "source"]).where("source is not null")
    first = with_prose.groupBy(F.col("source").alias("venue")).agg(F.min("doc_id").alias("_first"))
    ends = first.agg(F.min("venue").alias("_low"), F.max("venue").alias("_high"))  # one row
    few = docs.join(first, F.col("doc_id") == F.col("_first"), "left_semi")
    rows = profiles.built(few, rules.findings(few)).join(first, F.col("doc_id") == F.col("_first")).crossJoin(ends)
    return rows.select("venue", F.when(F.col("venue") == F.col("_high"), profiles.V2).otherwise(profiles.V3).alias("schema"), (F.col("venue") == F.col("_low")).alias("is_default"), "field", "source", "confidence", "value")


def _asked(s: S, d: str) -> DataFrame:
    """What venue each document wants: its source, in other letters, none, or an unknown one."""
    k = F.col("doc_id") % 4
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("key"), F.when(k == 1, F.concat(F.lit("  "), F.upper("source"))).when(k == 2, F.col("source")).when(k == 3, "nowhere at all").alias("venue"), F.get(F.array(*[F.lit(t) for t in ("Methods", "Evaluation", "Other")]), F.col("doc_id") % 3).alias("section_type"))


def _resolved(s: S, d: str) -> DataFrame:
    return profiles.statuses(profiles.resolved(_asked(s, d).withColumn("section_type", F.lit(None).cast("string")), _profiles(s, d)))


def _voices(s: S, d: str) -> DataFrame:
    rows = profiles.resolved(_asked(s, d), _profiles(s, d), ("P6",))
    return rows.select("key", "venue", "pass", "field", "source", "eligible", "reason", F.to_json("value").alias("value"))


def _profile_rows(s: S, d: str) -> DataFrame:
    docs = seed.documents(s, d)
    return profiles.built(docs, rules.findings(docs)).withColumn("value", F.to_json("value"))


def _flights(s: S, d: str) -> DataFrame:
    """Each document against the profile of its venue."""
    docs = seed.documents(s, d)
    fields = profiles.resolved(_asked(s, d), _profiles(s, d))
    return profiles.preflight(fingerprint.by_document(docs), rules.findings(docs), fields)


def _preservation(s: S, d: str) -> DataFrame:
    """Cases whose target is their input, or it with one more line end; the report
    names as many changes as the number of findings differs by."""
    cases = _cases(s, d)
    size = lambda c: F.size(rules.hits(c))
    frozen = revision.frozen_verdict(seed.pairs(s, d)).select(F.col("pair_id").alias("_k"), F.col("passed").alias("frozen"))
    target = F.when(F.col("pair_id") % 8 == 5, F.concat("target", F.lit("\r\n"))).otherwise(F.col("target"))
    rows = cases.select("pair_id", "before", "output", target.alias("target"), F.abs(size("before") - size("output")).alias("changes"))
    return targets.preserved(rows.join(frozen, F.col("pair_id") == F.col("_k")), "pair_id")


def _papers(s: S, d: str) -> DataFrame:
    """The baseline over papers: files are grouped by title, else by folder."""
    docs = seed.documents(s, d)
    head = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("# On  Maps "), (F.col("doc_id") % 9).cast("string"), F.lit("\n"))).otherwise("")
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = docs.select("doc_id", path.alias("path"), F.concat(head, "text").alias("text"))
    measured = fingerprint.by_document(docs).join(docs.select("doc_id", fingerprint.paper_key().alias("paper")), "doc_id")
    figures = [f"{m}_{x}" for m in fingerprint.BASELINE for x in ("mean", "sd")]
    return fingerprint.baseline(measured, "paper").select("paper_count", "status", *[F.round(x, 6).alias(x) for x in figures])


QUERIES = {
    "a23_preservation": _preservation,
    "a4_baseline_by_paper": _papers,
    "a2_section_types": lambda s, d: fingerprint.by_section_type(seed.documents(s, d)).select("doc_id", "section_type", *oracles.METRIC_COLUMNS),
    "j28_merged_glossary": lambda s, d: _joined(glossary.merged(_glossary(s, d))),
    "j28_conflicts": lambda s, d: glossary.conflicts(_glossary(s, d)),
    "a25_deletion_risks": lambda s, d: glossary.deletion_risks(glossary.merged(_glossary(s, d))),
    "a26_active_rules": lambda s, d: glossary.active_rules(glossary.merged(_glossary(s, d))),
    "p42_variants": lambda s, d: _glossary(s, d).select("pos", "term", F.array_join(glossary.derived_variants("term"), "|").alias("variants")),
    "a14_profile": _profile_rows,
    "a15_resolved_fields": _resolved,
    "a15_section_voices": _voices,
    "a19_resolved_preflight": _flights,
    "j19_paragraph_lines": _lines,
    "a12_paragraph_changes": _changes,
    "a9_revision_direction": _flat_report,
    "a9_author_rules": lambda s, d: lineage.author_rules(_report(s, d)),
    "a11_order_conflicts": lambda s, d: lineage.conflicts(_report(s, d)),
    "j18_findings_in_context": _in_context,
    "g2_reachability": _tree,
    "g2_root_paths": lambda s, d: corpus.root_paths(_tree(s, d)).select("node", "depth", F.array_join("path", " > ").alias("path")),
    "a30_reach_totals": _totals,
    "j31_approvals": lambda s, d: approvals.decided(*_manifests(s, d), "pair_id"),
    "j25_hashed_substrings": _hashed,
    "s19_candidates": lambda s, d: candidates.candidates(_pages(s, d), KEYWORDS),
    "s19_landing_files": _landed,
    "a22_evaluation": _evaluated,
}
SQL: dict[str, str] = {}

_MENTIONS = record_queries.SQL["g1_mentions"]
_TREE = f"""WITH RECURSIVE edges AS (SELECT DISTINCT path AS src, target AS dst FROM ({_MENTIONS})),
files AS (SELECT DISTINCT {record_queries._PATH('doc_id')} AS node FROM documents),
walk(node, depth, parent) USING KEY (node) AS (SELECT node, 0, NULL::VARCHAR FROM files WHERE node LIKE 'f0/%'
  UNION SELECT e.dst, min(w.depth) + 1, min(w.node) FROM walk w JOIN edges e ON e.src = w.node LEFT JOIN recurring.walk r ON r.node = e.dst WHERE r.node IS NULL GROUP BY e.dst)"""
SQL |= {
    "g2_reachability": f"{_TREE} SELECT node, depth::INT AS depth, parent FROM walk",
    "g2_root_paths": f"{_TREE}, pth(node, depth, path) AS (SELECT node, depth, node FROM walk WHERE depth = 0 UNION ALL SELECT w.node, w.depth, p.path || ' > ' || w.node FROM walk w JOIN pth p ON w.parent = p.node) SELECT node, depth::INT AS depth, path FROM pth",
    "a30_reach_totals": f"{_TREE} SELECT count(*)::BIGINT AS nodes, count(w.node)::BIGINT AS reached, (count(*) - count(w.node))::BIGINT AS orphans, round((count(*) - count(w.node)) * 100.0::DOUBLE / count(*), 4)::DOUBLE AS orphan_percent FROM files f LEFT JOIN walk w ON w.node = f.node",
}


def _pieces(x: str, pattern: str, flags: str = "") -> str:
    """A text cut at matches, which stand at even places (1-based)."""
    return f"string_split(regexp_replace({x}, {Q(flags + '(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"


_HEAD = oracles.tx.HEADING.removeprefix("(?m)")
_AT = lambda n: f"coalesce(list_sum(list_transform(x[1:{n}], lambda y: length(y))), 0)::BIGINT"
SQL["j18_findings_in_context"] = f"""WITH {seed.DOCS_SQL}, f AS ({oracles.SQL['r17_located_findings']}),
h AS (SELECT doc_id, {_pieces('text', _HEAD, '(?m)')} AS x FROM docs),
sec AS (SELECT doc_id, ((i - 1) // 2)::INT AS sec_no, CASE WHEN len(x) = 1 THEN 'Document' WHEN i = 1 THEN 'Preamble' ELSE {oracles.SQ(f"regexp_extract(x[i - 1], {Q('(?m)' + _HEAD)}, 1) || regexp_extract(x[i - 1], {Q('(?m)' + _HEAD)}, 2)")} END AS title,
  CASE WHEN i = 1 THEN 0 ELSE {_AT('i - 2')} END AS a, {_AT('i')} AS b FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1, 2)) AS i FROM h)),
p AS (SELECT doc_id, {_pieces('text', '[^.!?' + chr(92) + 'n]+[.!?]?')} AS x FROM docs),
sen AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS sentence, {_AT('i - 1')} AS a, {_AT('i')} AS b FROM (SELECT doc_id, x, unnest(range(2, len(x) + 1, 2)) AS i FROM p) WHERE {oracles.SQ('x[i]')} <> '')
SELECT f.doc_id, f.rule, f.start, sec.sec_no, sec.title, sen.sentence FROM f LEFT JOIN sec ON sec.doc_id = f.doc_id AND f.start >= sec.a AND f.start < sec.b LEFT JOIN sen ON sen.doc_id = f.doc_id AND f.start >= sen.a AND f.start < sen.b"""

_K = lambda n, *v: f"([{', '.join(Q(x) for x in v)}])[pair_id % {n} + 1]"
_SUM = lambda c, n: f"CASE WHEN pair_id % {n} = 3 THEN sha256('other') ELSE sha256({c}) END AS {c}_sha256"
_CASES_SQL = f"""WITH {seed.PAIRS_SQL}, fv AS ({oracles.SQL['j4_frozen_verdict']}), lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
cs AS (SELECT pair_id, before, after AS target, 'quality=' || coalesce(quality::VARCHAR, 'none') AS screening, passed AS frozen FROM pairs JOIN fv USING (pair_id) LEFT JOIN lb ON lb.doc_id = pair_id),
m0 AS (SELECT pair_id, {_K(19, *['approved-style-target-v1'] * 18, 'v0')} AS schema, {_K(11, *['approved'] * 10, 'pending')} AS approval, pair_id % 13 <> 2 AS stable, pair_id % 7 AS time, {_SUM('before', 17)}, {_SUM('target', 23)}, {_SUM('screening', 29)} FROM cs WHERE pair_id % 10 <> 7),
m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m0 WHERE pair_id % 31 = 4), n AS (SELECT pair_id, count(*) AS n FROM m GROUP BY ALL)"""
SQL["j31_approvals"] = f"""{_CASES_SQL}, w AS (
SELECT DISTINCT cs.pair_id, CASE WHEN n IS NULL THEN 'no manifest' WHEN n > 1 THEN 'several manifests' ELSE array_to_string(list_filter([
  CASE WHEN schema <> 'approved-style-target-v1' THEN 'schema is not approved-style-target-v1' END, CASE WHEN approval <> 'approved' THEN 'approval_status is not approved' END,
  CASE WHEN NOT stable THEN 'content stability is not confirmed' END, CASE WHEN time IN (3, 5) THEN 'approved_utc is no time' WHEN time = 2 THEN 'approved_utc has no zone' END,
  CASE WHEN before_sha256 <> sha256(before) THEN 'before_sha256 differs' END, CASE WHEN target_sha256 <> sha256(target) THEN 'target_sha256 differs' END, CASE WHEN screening_sha256 <> sha256(screening) THEN 'screening_sha256 differs' END,
  CASE WHEN regexp_replace(before, '\\n$', '') = regexp_replace(target, '\\n$', '') THEN 'target equals before' END, CASE WHEN NOT frozen THEN 'target changes what must be kept' END], lambda x: x IS NOT NULL), '; ') END AS reasons
FROM cs LEFT JOIN n USING (pair_id) LEFT JOIN m USING (pair_id))
SELECT pair_id, reasons = '' AS admitted, reasons FROM w"""

SQL["j25_hashed_substrings"] = """WITH l AS (SELECT DISTINCT lower(source) AS w FROM documents WHERE source IS NOT NULL UNION SELECT unnest(['than', 'licens', 'idiot'])),
t AS (SELECT doc_id, line_no::INT AS line_no, token, count(*)::BIGINT AS n FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9][a-z0-9_.-]*')) AS token FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)) GROUP BY ALL)
SELECT doc_id, line_no, token, sha256(w) AS digest, n FROM t JOIN l ON contains(token, w) WHERE w <> ''"""

_CANON = lambda x: f"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n$', '')"
_HTML = "pages AS (SELECT page_id, url, regexp_replace(html, 'href=\"/([a-mA-M][^\"]*)\"', 'href=\"/\\1.pdf\"', 'g') AS html FROM pages)"
_HAS = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), {Q(w)})" for w in words) + ")"
_PDF = "ends_with(lower(target), '.pdf')"
_PLAIN = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
SQL["s19_candidates"] = f"""WITH {_HTML}, {oracles._LINKS},
hit AS (SELECT page_id, place, CASE WHEN text = '' THEN target ELSE text END AS title, CASE WHEN target = '' THEN url ELSE target END AS source_url, CASE WHEN {_PDF} THEN target ELSE '' END AS pdf_url, CASE WHEN {_PDF} THEN 'pdf_available' ELSE 'metadata_only' END AS status, '' AS notes
  FROM links JOIN pages USING (page_id) WHERE {_HAS("text || ' ' || target", KEYWORDS)})
SELECT * FROM hit UNION ALL SELECT page_id, NULL, CASE WHEN {_HAS(_PLAIN, KEYWORDS)} THEN {Q(candidates.ELSEWHERE)} ELSE {Q(candidates.EMPTY)} END, url, '', 'metadata_only', CASE WHEN {_HAS(_PLAIN, KEYWORDS)} THEN {Q(candidates.NOTE)} ELSE '' END FROM pages WHERE page_id NOT IN (SELECT page_id FROM hit)"""
SQL["s19_landing_files"] = f"""WITH {_HTML}, {oracles._LINKS},
own AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1) AS title FROM pages), first AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url),
f AS (SELECT page_id, list(target ORDER BY place) AS files FROM links WHERE {_PDF} AND NOT {_HAS('text', candidates.SKIPPED)} GROUP BY page_id),
c AS (SELECT own.page_id, title, coalesce(files, []) AS files, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: length(w) >= {candidates.LETTERS}) AS words FROM own JOIN first USING (url) LEFT JOIN f ON f.page_id = first.page_id)
SELECT page_id, title, coalesce(list_filter(files, lambda h: {_HAS('h', candidates.PREFERRED)})[1], list_filter(files[2:], lambda h: len(list_filter(words, lambda w: contains(lower(h), w))) > 1)[-1], files[1], '') AS pdf_url FROM c"""

_TARGET = f"CASE pair_id % 4 WHEN 0 THEN after WHEN 1 THEN before WHEN 2 THEN own || {Q(seed.PASSAGES[9])} || ' ' || {Q(seed.PASSAGES[0])} ELSE CASE WHEN pair_id % 3 = 0 THEN before || chr(10) || chr(10) || {Q(seed.MOVED[1])} ELSE after || chr(10) || chr(10) || {Q(seed.MOVED[0])} END END"
_OWN = "own AS (SELECT doc_id AS pair_id, coalesce(text, '') || chr(10) || chr(10) AS own FROM documents)"
_THREE = f"{seed.PAIRS_SQL}, {_OWN}, cases AS (SELECT pair_id, before, after AS output, {_TARGET} AS target FROM pairs JOIN own USING (pair_id))"
_GUARD = oracles.SQL["j4_frozen_verdict"]
_TO_TARGET = _GUARD.replace(seed.PAIRS_SQL, f"pairs AS (WITH {_THREE} SELECT pair_id, before, target AS after FROM cases)")
_ROUND = "round((1 - o / b) * 100, 4)"
SQL["a22_evaluation"] = f"""WITH {_THREE}, docs AS (SELECT pair_id * 3 AS doc_id, before AS text FROM cases UNION ALL SELECT pair_id * 3 + 1, output FROM cases UNION ALL SELECT pair_id * 3 + 2, target FROM cases), src AS (SELECT doc_id, text FROM docs),
{oracles._block("text", "doc_id")}, {oracles._FULL}, {oracles.REPORT.split(',' + chr(10), 1)[1]},
c AS (SELECT (b.doc_id // 3)::BIGINT AS pair_id, b, o, t, least(b.paragraph_count, o.paragraph_count, t.paragraph_count) < 2 AS few FROM full_m b JOIN full_m o ON o.doc_id = b.doc_id + 1 JOIN full_m t ON t.doc_id = b.doc_id + 2 WHERE b.doc_id % 3 = 0),
e AS (SELECT pair_id, few, unnest([{", ".join(f"{{'metric': {Q(m)}, 'b': b.{m}, 'o': o.{m}, 't': t.{m}}}" for m in targets.METRICS)}], recursive := true) FROM c),
g AS (SELECT pair_id, round(abs(b - t), 6) / greatest(abs(t), 1) AS gb, round(abs(o - t), 6) / greatest(abs(t), 1) AS go FROM e WHERE metric <> 'active_sentence_ratio' AND NOT (few AND metric IN ('mean_paragraph_words', 'paragraph_word_sd', 'mean_sentences_per_paragraph'))),
st AS (SELECT pair_id, count(*)::BIGINT AS eligible, avg(gb) AS b, avg(go) AS o FROM g GROUP BY pair_id),
sv AS (SELECT pair_id, eligible, CASE WHEN b > 0 THEN {_ROUND} END AS convergence, CASE WHEN b > 0 THEN CASE WHEN {_ROUND} > 0 THEN 'improved' WHEN {_ROUND} = 0 THEN 'unchanged' ELSE 'worsened' END WHEN o > 0 THEN 'worsened' ELSE 'insufficient_signal' END AS structural FROM st),
rc AS (SELECT doc_id // 3 AS pair_id, rule, max(CASE WHEN doc_id % 3 = 0 THEN hits END) AS nb, max(CASE WHEN doc_id % 3 = 1 THEN hits END) AS no, max(CASE WHEN doc_id % 3 = 2 THEN hits END) AS nt FROM rep GROUP BY ALL),
rv AS (SELECT pair_id, sum(abs(nb - nt))::BIGINT AS rule_initial, sum(CASE WHEN nb <> nt THEN abs(no - nt) ELSE 0 END)::BIGINT AS rule_revised, count_if(nb = nt AND no <> nt)::BIGINT AS off_target FROM rc GROUP BY pair_id),
rs AS (SELECT *, CASE WHEN off_target > 0 THEN 'worsened' WHEN rule_initial = 0 THEN 'insufficient_signal' WHEN rule_revised < rule_initial THEN 'improved' WHEN rule_revised = rule_initial THEN 'unchanged' ELSE 'worsened' END AS rules FROM rv),
j AS (SELECT rs.pair_id::BIGINT AS pair_id, coalesce(eligible, 0)::BIGINT AS eligible, convergence, coalesce(structural, 'insufficient_signal') AS structural, rule_initial, rule_revised, off_target, rules, x.passed AS output_kept, y.passed AS target_kept FROM rs LEFT JOIN sv USING (pair_id) JOIN ({_GUARD}) x ON x.pair_id = rs.pair_id JOIN ({_TO_TARGET}) y ON y.pair_id = rs.pair_id),
k AS (SELECT *, CASE WHEN 'worsened' IN (structural, rules) THEN CASE WHEN 'improved' IN (structural, rules) THEN 'mixed_or_worsened' ELSE 'not_improved' END WHEN 'improved' IN (structural, rules) THEN 'improved' WHEN structural = 'insufficient_signal' AND rules = 'insufficient_signal' THEN 'insufficient_evidence' ELSE 'not_improved' END AS status FROM j)
SELECT *, CASE WHEN status = 'improved' THEN true WHEN status <> 'insufficient_evidence' THEN false END AS improved, output_kept AND target_kept AS valid FROM k"""
SQL["a20_structural"] = f"SELECT doc_id, count(*)::BIGINT AS eligible, count_if(status = 'closer')::BIGINT AS closer, CASE WHEN avg(scaled_before) > 0 THEN round((1 - avg(scaled_output) / avg(scaled_before)) * 100, 4) END AS convergence FROM ({oracles.SQL['a20_distances']}) WHERE eligible GROUP BY doc_id"

SQL["a15_resolved_fields"] = f"""WITH {seed.DOCS_SQL}, pr AS (SELECT DISTINCT doc_id FROM ({oracles.SQL['a13_screening']})), f AS (SELECT source AS venue, min(doc_id) AS doc_id FROM docs JOIN pr USING (doc_id) WHERE source IS NOT NULL GROUP BY source),
lo AS (SELECT min(venue) AS a, max(venue) AS b FROM f),
fl AS (SELECT venue, s.source, venue = b AND dimension IN {profiles.V2_EXCLUDED} AS old FROM f JOIN ({oracles.SQL['a13_screening']}) s USING (doc_id), lo WHERE dimension IN {tuple(x for v in profiles.PASS_FIELDS.values() for x in v)}),
n AS (SELECT venue, count(*)::BIGINT AS fields, count_if(NOT old)::BIGINT AS eligible, count_if(NOT old AND source = 'exemplar')::BIGINT AS exemplars FROM fl GROUP BY venue),
w AS (SELECT doc_id AS key, CASE doc_id % 4 WHEN 1 THEN '  ' || upper(source) WHEN 2 THEN source WHEN 3 THEN 'nowhere at all' END AS venue FROM documents),
r AS (SELECT key, coalesce(f.venue, a) AS venue, CASE WHEN coalesce(w.venue, '') = '' THEN 'unstated' WHEN f.venue IS NULL THEN 'default' ELSE 'matched' END AS venue_match, b FROM w CROSS JOIN lo LEFT JOIN f ON lower(f.venue) = trim(lower(w.venue)))
SELECT key, venue, venue_match, fields, eligible, exemplars, CASE WHEN venue_match = 'matched' AND eligible > 0 AND eligible = exemplars AND venue <> b THEN 'ok' ELSE 'partial' END AS status FROM r JOIN n USING (venue)"""

_VARIANTS = "list_filter(CASE WHEN contains(term, '-') THEN [replace(term, '-', ' ')] ELSE [] END || CASE WHEN contains(term, ' ') THEN [regexp_replace(term, '\\s+', '-', 'g')] ELSE [] END, lambda x: x <> term)"
_ENTRIES = f"""WITH e0 AS (SELECT doc_id AS pos, {oracles.WORDS("coalesce(text, '')")}[1:5] AS w FROM documents), e1 AS (SELECT pos, w, w[1] || CASE WHEN pos % 2 = 0 THEN '-' ELSE ' ' END || w[2] AS term FROM e0 WHERE len(w) > 4),
e AS (SELECT 'L' || (pos % 3) AS layer, pos, term, CASE WHEN pos % 5 > 1 THEN upper(w[1][1] || w[2][1]) END AS abbreviation, CASE WHEN pos % 4 < 2 THEN [term || ' ' || w[3]] ELSE [w[3], w[4] || ' ' || w[5]] END AS synonyms, {_VARIANTS} AS variants FROM e1),
l AS (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY layer DESC, pos DESC) AS r, min({{'layer': layer, 'pos': pos}}) OVER (PARTITION BY lower(term)) AS f FROM e), m AS (SELECT f.layer AS first_layer, f.pos AS first_pos, layer, term, abbreviation, synonyms, variants FROM l WHERE r = 1)"""
_N = lambda x: f"len(regexp_extract_all({x}, '[A-Za-z0-9]+'))"
SQL |= {
    "j28_merged_glossary": f"{_ENTRIES} SELECT first_layer, first_pos, layer, term, abbreviation, array_to_string(synonyms, '|') AS synonyms, array_to_string(variants, '|') AS variants FROM m",
    "j28_conflicts": f"""{_ENTRIES}, o AS (SELECT *, lag(layer) OVER w AS ol, lag(abbreviation) OVER w AS oa, lag(synonyms) OVER w AS os, lag(variants) OVER w AS ov FROM e WINDOW w AS (PARTITION BY lower(term) ORDER BY layer, pos))
SELECT term, ol AS overridden, layer AS overriding, array_to_string(list_filter([CASE WHEN abbreviation IS DISTINCT FROM oa THEN 'abbreviation' END, CASE WHEN synonyms <> os THEN 'synonyms' END, CASE WHEN variants <> ov THEN 'variants' END], lambda x: x IS NOT NULL), ',') AS fields FROM o WHERE ol IS NOT NULL""",
    "a25_deletion_risks": f"""{_ENTRIES}, f AS (SELECT term, 'forbidden_synonym' AS kind, unnest(synonyms) AS form FROM m UNION ALL SELECT term, 'plural_or_hyphen_variant', unnest(variants) FROM m)
SELECT term, kind, form, ({_N('form')} - {_N('term')})::INT AS extra FROM f WHERE {_N('form')} > {_N('term')} AND contains(lower(form), lower(term))""",
    "a26_active_rules": f"{_ENTRIES} SELECT sum(len(synonyms) + len(variants))::BIGINT AS active_rules FROM m",
    "p42_variants": f"{_ENTRIES} SELECT pos, term, array_to_string({_VARIANTS}, '|') AS variants FROM e",
}

_EXPR = oracles._PAPERS
_BASE = f"base AS (SELECT count(*) AS n, {', '.join(f'avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_sd' for m in fingerprint.BASELINE)} FROM paper)"
_OF_RAW = "raw_m JOIN (SELECT doc_id, em_dashes FROM ps) USING (doc_id)"
SQL["a5_drift"] = f"""{oracles.DOC_BLOCK}, {oracles._FULL}, paper AS (SELECT source, {_EXPR} FROM {_OF_RAW} JOIN docs USING (doc_id) GROUP BY source), {_BASE}, own AS (SELECT doc_id, {_EXPR} FROM {_OF_RAW} GROUP BY doc_id),
v AS (SELECT doc_id, n, unnest([{", ".join(f"{{'metric': {Q(m)}, 'z': CASE WHEN {m}_sd > 0 THEN ({m} - {m}_mean) / {m}_sd END}}" for m in fingerprint.BASELINE)}], recursive := true) FROM own, base)
SELECT doc_id, metric, coalesce(n >= {fingerprint.THIN} AND abs(z) > 1.5::DOUBLE, false) AS drift FROM v"""
_TITLED = f"{seed.DOCS_SQL.replace('docs AS', 'd0 AS')}, docs AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 1 THEN '# On  Maps ' || (doc_id % 9) || chr(10) ELSE '' END || text AS text FROM d0)"
_NAME = "trim(regexp_replace(lower(regexp_extract(text, '(?m)^#\\s+(.+?)\\s*$', 1)), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'))"
_FOLDER = "trim(regexp_replace(lower(coalesce(source, '')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'))"
SQL["a4_baseline_by_paper"] = f"""WITH {_TITLED}, src AS (SELECT doc_id, text FROM docs), {oracles._block("text", "doc_id")}, {oracles._FULL},
nm AS (SELECT doc_id, CASE WHEN {_NAME} <> '' THEN 'title:' || {_NAME} WHEN {_FOLDER} <> '' THEN 'directory:' || {_FOLDER} ELSE 'path:/' || doc_id || '.md' END AS source FROM docs),
paper AS (SELECT source, {_EXPR} FROM {_OF_RAW} JOIN nm USING (doc_id) GROUP BY source) SELECT {oracles.SQL["a4_baseline"].rsplit("SELECT ", 1)[1]}"""
SQL["a2_section_types"] = oracles.D[:-1] + f", {oracles.SECTIONS}, src AS (SELECT * FROM sections WHERE title <> 'Preamble'), " + oracles._block("body", oracles._KEYS["type"]) + oracles._metrics(oracles._KEYS["type"])
_REP = oracles.REPORT.split("\ns AS (SELECT", 1)[1]
SQL["a23_preservation"] = f"""WITH {_THREE}, docs AS (SELECT pair_id * 2 AS doc_id, before AS text FROM cases UNION ALL SELECT pair_id * 2 + 1, output FROM cases), s AS (SELECT{_REP},
n AS (SELECT doc_id // 2 AS pair_id, abs(sum(CASE WHEN doc_id % 2 = 0 THEN hits ELSE -hits END)) AS changes FROM rep GROUP BY ALL),
c AS (SELECT pair_id, before, output, CASE WHEN pair_id % 8 = 5 THEN target || chr(13) || chr(10) ELSE target END AS target FROM cases),
v AS (SELECT pair_id, {_CANON('before')} = {_CANON('output')} AS exact FROM c WHERE {_CANON('before')} = {_CANON('target')})
SELECT v.pair_id, exact, x.passed AS frozen, changes = 0 AS none_reported, exact AND x.passed AND changes = 0 AS preserved FROM v JOIN n ON n.pair_id = v.pair_id JOIN ({_GUARD}) x ON x.pair_id = v.pair_id"""
_BEFORE = f"pairs AS (WITH {seed.PAIRS_SQL} SELECT pair_id, '' AS before, before AS after FROM pairs)"
_TERMS_NEW, _TERMS_AFTER = oracles.SQL["j11_term_findings"], oracles.SQL["j11_term_residual"]
SQL["a24_pass_verdict"] = f"""WITH {seed.PAIRS_SQL}, k AS (SELECT pair_id, sum(violations) AS every, sum(CASE WHEN category <> 'glossary_terms' THEN violations ELSE 0 END) AS other FROM ({oracles.SQL['j2_category_report']}) GROUP BY pair_id),
f AS (SELECT pair_id, count(*) AS n FROM ({_TERMS_NEW}) GROUP BY pair_id), b AS (SELECT pair_id, count(*) AS n FROM ({_TERMS_AFTER.replace(seed.PAIRS_SQL, _BEFORE)}) GROUP BY pair_id), a AS (SELECT pair_id, count(*) AS n FROM ({_TERMS_AFTER}) GROUP BY pair_id),
r AS (SELECT p.pair_id, coalesce(every, 0) AS every, coalesce(other, 0) AS other, coalesce(f.n, 0) AS added, (coalesce(a.n, 0) - coalesce(b.n, 0))::BIGINT AS delta FROM pairs p LEFT JOIN k USING (pair_id) LEFT JOIN f USING (pair_id) LEFT JOIN b USING (pair_id) LEFT JOIN a USING (pair_id))
SELECT pair_id, pass, delta, CASE WHEN (pass = 'P3' AND other = 0 AND added = 0 AND delta <= 0) OR (pass <> 'P3' AND every = 0) THEN 'proceed' ELSE 'rollback' END AS verdict FROM (SELECT *, unnest(['P3', 'P4', 'P5', 'P6', 'P7']) AS pass FROM r)"""
SQL["g11_contract"] = f"""WITH {seed.PAIRS_SQL}, docs AS (SELECT pair_id AS doc_id, after AS text FROM pairs), s AS (SELECT{_REP},
n AS (SELECT doc_id AS pair_id, sum(hits)::INT AS findings FROM rep GROUP BY doc_id), f AS (SELECT DISTINCT pair_id FROM ({_TERMS_NEW}) WHERE kind <> 'case_inconsistency'),
j AS (SELECT n.pair_id, findings, CASE WHEN NOT i.passed THEN 'immutable' WHEN NOT st.passed THEN 'strength' WHEN f.pair_id IS NOT NULL THEN 'terminology' ELSE 'none' END AS blocked_by
  FROM n JOIN ({oracles.SQL['j3_immutable_verdict']}) i ON i.pair_id = n.pair_id JOIN ({oracles.SQL['strength_verdict']}) st ON st.pair_id = n.pair_id LEFT JOIN f ON f.pair_id = n.pair_id)
SELECT pair_id, blocked_by, blocked_by = 'none' AS proceed, findings FROM j"""
