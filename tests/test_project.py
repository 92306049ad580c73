"""Terms, places, graphs, approvals, hashes, pages, registry and evaluation, on small rows."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proselens.operators import approvals, candidates, corpus, hashed, intervals, targets, terms
from proselens.sources import registry

ROWS = [("Key map", "KM", ["old map", "a map a"], ["key-map", "keymap"]), ("town", None, ["city"], ["towns"]), ("küste", None, [], ["Kuste"]), ("Old Mill", "OM", ["mill"], ["old-mill"])]


def plain_matches(text, form, any_case=True):
    return list(re.finditer(rf"(?<![A-Za-z0-9]){re.escape(form)}(?![A-Za-z0-9])", text, re.IGNORECASE if any_case else 0))


def plain_findings(before, after, rows, residual):
    """Each form by a regular expression of its own."""
    out, old = set(), "" if residual else before
    for term, short, synonyms, variants in rows:
        for kind, forms in ((terms.SYNONYM, synonyms), (terms.VARIANT, variants)):
            for f in forms:
                out |= {(m.start(), term, kind, m[0]) for m in plain_matches(after, f)[len(plain_matches(old, f)) :]}

        def odd(text):
            return [m for m in plain_matches(text, term) if m[0] != term and not (m[0] == term[0].upper() + term[1:] and (not m.start() or re.search(r"(?:[.!?:][ \t]+|\n[ \t]*)\Z", text[: m.start()])))]

        left = Counter(m[0] for m in odd(old))
        for m in odd(after):
            left[m[0]] -= 1
            if left[m[0]] < 0:
                out.add((m.start(), term, terms.CASE, m[0]))
        if short:
            full, brief, fb, bb = plain_matches(after, term), plain_matches(after, short, False), plain_matches(before, term), plain_matches(before, short, False)
            if brief and (residual and full or fb and not bb):
                out |= {(m.start(), term, terms.MIX, m[0]) for m in brief}
            elif bb and not fb:
                out |= {(m.start(), term, terms.MIX, m[0]) for m in full}
    return sorted(out)


def test_automaton_finds_what_single_patterns_find():
    rng = random.Random(3)
    bits = ["Key map", "key map", "KM", "km", "old map", "a map a", "map a", "key-map", "keymap", "city", "City", "town", "Town", "TOWN", "towns", ". ", "\n", "x", " ", " ", "9", "KÜSTE", "küste", "Kuste", "Old Mill", "old mill", "OM", "mill", "İ", "\t"]
    text = lambda: "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25)))
    for rows in (ROWS, ROWS[:1]):
        g = terms.Glossary(rows)
        for _ in range(400):
            a, b = text(), text()
            for residual in (False, True):
                got = g.findings(a, b, residual)
                assert got == plain_findings(a, b, rows, residual), (a, b)
    assert terms.Glossary([]).findings("a", "a", True) == []


def test_masks_keep_places():
    t = "a $x\ny$ b \\cite [p] {k} c \\emph{d}\n\\begin{align*}q\nr\\end{align*} \\$5 e \\[z\\] $$u$v$$ \\label"
    m = terms.masked(t)
    assert len(m) == len(t) and [i for i, c in enumerate(m) if c == "\n"] == [i for i, c in enumerate(t) if c == "\n"]
    assert m.split() == ["a", "b", "c", "{d}", "\\$5", "e"]


def test_findings_have_lines_and_slices(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, None, "One.\nthe city, a  mill"), (2, "city", "city"), (3, "x", None)], "pair_id long, before string, after string")
    entries = spark.createDataFrame(ROWS, "term string, abbreviation string, synonyms array<string>, variants array<string>")
    want = [(1, "Old Mill", terms.SYNONYM, "mill", 18, 2, 14), (1, "town", terms.SYNONYM, "city", 9, 2, 5)]
    assert sorted(tuple(r) for r in terms.findings(pairs, entries).collect()) == want
    monkeypatch.setattr(terms, "SLICE", 1)
    assert sorted(tuple(r) for r in terms.findings(pairs, entries).collect()) == want
    assert [r["pair_id"] for r in terms.findings(pairs, entries, True).where("term = 'town'").orderBy("pair_id").collect()] == [1, 2]
    assert terms.findings(pairs, entries.limit(0)).collect() == []


def test_interval_joins_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "WIDTH", 8)
    rng = random.Random(2)
    span = lambda n: [(rng.randint(0, 2), a := rng.randint(0, 60), a + rng.randint(0, 30), k) for k in range(n)]
    a, b = span(40), span(40)
    left, right = spark.createDataFrame(a, "doc_id long, start int, end int, i int"), spark.createDataFrame(b, "doc_id long, start int, end int, j int")
    got = sorted((r["i"], r["j"]) for r in intervals.overlapping(left, right, "doc_id", ["j"]).collect())
    assert got == sorted((i, j) for d, s, e, i in a for d2, s2, e2, j in b if d == d2 and s < e2 and s2 < e and s < e and s2 < e2)
    got = sorted((r["i"], -1 if r["j"] is None else r["j"]) for r in intervals.containing(left, right, "doc_id", ["j"]).collect())
    want = []
    for d, s, _, i in a:
        want += [(i, j) for d2, s2, e2, j in b if d == d2 and s2 <= s < e2] or [(i, -1)]
    assert got == sorted(want)


def test_root_paths_follow_parents(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 6), (6, 7), (7, 8), (8, 1), (9, 9)], "src long, dst long")
    tree = corpus.reachable(edges, spark.createDataFrame([(1,), (9,)], "node long"))
    assert {r["node"]: (r["depth"], r["parent"]) for r in tree.collect()} == {1: (0, None), 9: (0, None), 2: (1, 1), 4: (1, 1), 3: (2, 2), 5: (3, 3), 6: (4, 5), 7: (5, 6), 8: (6, 7)}
    assert {r["node"]: r["path"] for r in corpus.root_paths(tree).collect()} == {1: [1], 9: [9], 2: [1, 2], 4: [1, 4], 3: [1, 2, 3], 5: [1, 2, 3, 5], 6: [1, 2, 3, 5, 6], 7: [1, 2, 3, 5, 6, 7], 8: [1, 2, 3, 5, 6, 7, 8]}
    assert corpus.root_paths(tree.limit(0)).collect() == []


def test_times_need_a_zone(spark):
    cases = {"2026-01-02T03:04:05Z": (True, True), "2026-01-02T03:04:05+01:00": (True, True), "2026-01-02 03:04": (True, False), "2026-01-02": (True, False), "2026-02-30T00:00Z": (False, True), "2026-01-02T25:00Z": (False, True), "soon": (False, False), "": (False, False), "2026-01-02T03:04:05.123456-0930": (True, True)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", *[c.alias(n) for c, n in zip(approvals.zoned("t"), ("real", "zone"))]).collect()
    assert {r["t"]: r["real"] for r in rows} == {k: v[0] for k, v in cases.items()}
    assert all(r["zone"] == cases[r["t"]][1] for r in rows if r["real"])


def test_admission_names_every_reason(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cases = spark.createDataFrame([(1, "a", "b", "s", True), (2, "a", "a\r\n", None, False), (3, "a", "b", "s", True), (4, "a", "b", "s", True)], "k long, before string, target string, screening string, frozen boolean")
    good = ("approved-style-target-v1", "author-approved", "approved", True, "2026-01-02T03:04:05Z", sha("a"), sha("b"), sha("s"))
    rows = [(1, *good), (2, "x", None, "approved", None, "2026-01-02", sha("a"), None, sha("")), (3, *good), (3, *good)]
    manifests = spark.createDataFrame(rows, "k long, schema string, source string, approval_status string, content_stable_confirmed boolean, approved_utc string, before_sha256 string, target_sha256 string, screening_sha256 string")
    got = {r["k"]: (r["admitted"], r["reasons"].split("; ")) for r in approvals.decided(cases, manifests, "k").collect()}
    assert got[1] == (True, [""]) and got[3] == (False, ["several manifests"]) and got[4] == (False, ["no manifest"])
    assert got[2] == (False, ["schema is not approved-style-target-v1", "source is not author-approved", "content stability is not confirmed", "approved_utc has no zone", "target_sha256 differs", "target equals before", "target changes what must be kept"])


def test_hashed_substrings_are_those_of_a_plain_loop(spark, monkeypatch):
    secret = ["abc", "b-c", "x" * 129, "q" * 128, "7"]
    docs = [(1, "xABCx\nabc abc a7"), (2, None), (3, "q" * 130 + " " + "x" * 140), (4, "nothing")]
    digests = [(hashlib.sha256(s.encode()).hexdigest(),) for s in secret] + [(None,), ("short",)]
    want = set()
    for d, t in docs:
        for n, line in enumerate((t or "").lower().split("\n"), 1):
            for token in re.findall("[a-z0-9][a-z0-9_.-]*", line):
                want |= {(d, n, token, hashlib.sha256(s.encode()).hexdigest()) for s in secret if s in token and len(s) <= 128}
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(digests, "digest string")
    for size in (hashed.SLICE, 2):
        monkeypatch.setattr(hashed, "SLICE", size)
        got = hashed.hits(*args).collect()
        assert {(r["doc_id"], r["line_no"], r["token"], r["digest"]) for r in got} == want and len(got) == len(want)
    assert {r["n"] for r in got if r["token"] == "abc"} == {2}
    assert hashed.hits(args[0], args[1].limit(0)).collect() == []


@pytest.mark.parametrize(
    ("files", "title", "want"),
    [
        ([("Slides", "/a.pdf"), ("x", "/b.PDF"), ("y", "/c.pdf")], "no words", "/b.PDF"),
        ([("x", "/a.pdf"), ("x", "/lost-town.pdf"), ("x", "/town-lost-2.pdf")], "The lost town", "/town-lost-2.pdf"),
        ([("x", "/lost-town.pdf"), ("x", "/other.pdf")], "The lost town", "/lost-town.pdf"),
        ([("x", "/a.pdf"), ("x", "/system/files/b.pdf"), ("x", "/lost-town.pdf")], "lost town", "/system/files/b.pdf"),
        ([("video", "/system/files/b.pdf"), ("x", "/c.html")], "lost town", ""),
        ([], None, ""),
    ],
)
def test_best_file_of_a_landing_page(spark, files, title, want):
    rows = spark.createDataFrame([(files, title)], "links array<struct<text:string,href:string>>, title string")
    assert rows.select(candidates.best_file(F.col("links"), F.coalesce("title", F.lit("")))).first()[0] == want


def test_pages_without_a_hit_have_one_row(spark):
    pages = spark.createDataFrame([(1, "http://h/a", '<a href="/x.pdf">The MAP</a><a href="y">no</a>'), (2, "http://h/b", "<p>a map</p><script>z</script>"), (3, "http://h/c", None), (4, "http://h/d", "<script>map</script>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["title"], r["source_url"], r["pdf_url"], r["notes"]) for r in candidates.candidates(pages, ("map",)).collect()}
    assert got == {1: ("The MAP", "http://h/x.pdf", "http://h/x.pdf", ""), 2: (candidates.ELSEWHERE, "http://h/b", "", candidates.NOTE), 3: (candidates.EMPTY, "http://h/c", "", ""), 4: (candidates.EMPTY, "http://h/d", "", "")}
    found = spark.createDataFrame([("t", "http://h/a", ""), ("t", "http://h/zz", ""), ("t", "http://h/a", "own")], "title string, source_url string, pdf_url string")
    assert sorted(r["pdf_url"] for r in candidates.landed(found, pages).collect()) == ["", "http://h/x.pdf", "own"]


SCHEMA = "path string, name string"


def table(spark, top):
    return sorted(tuple(r) for r in registry.read(spark, top, SCHEMA).collect())


def test_registry_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    top = f"{tmp_path}/registry"
    assert table(spark, top) == [] and registry.version(spark, top) is None
    rows = lambda *x: spark.createDataFrame(x, SCHEMA)
    registry.upserted(spark, top, rows(("b", "1"), ("A", "1")), "path")
    assert table(spark, top) == [("A", "1"), ("b", "1")]
    real = registry.point
    monkeypatch.setattr(registry, "point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        registry.upserted(spark, top, rows(("b", "2"), ("c", "1")), "path")
    assert table(spark, top) == [("A", "1"), ("b", "1")] and len(os.listdir(top)) >= 3
    monkeypatch.setattr(registry, "point", real)
    monkeypatch.setattr(registry, "swept", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        registry.upserted(spark, top, rows(("b", "2"), ("c", "1")), "path")
    want = [("A", "1"), ("b", "2"), ("c", "1")]
    assert table(spark, top) == want
    monkeypatch.undo()
    for _ in range(2):  # the same update again changes nothing
        registry.upserted(spark, top, rows(("b", "2"), ("c", "1")), "path")
        assert table(spark, top) == want
    assert sum(x.startswith("v-") for x in os.listdir(top)) == 1


def test_statuses_of_both_channels(spark):
    some = [targets.IMPROVED, targets.UNCHANGED, targets.WORSENED, targets.NO_SIGNAL]
    rows = spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string")
    for r in rows.select("a", "b", targets.overall(F.col("a"), F.col("b")).alias("s")).collect():
        both = {r["a"], r["b"]}
        want = ("mixed_or_worsened" if "improved" in both else "not_improved") if "worsened" in both else "improved" if "improved" in both else "insufficient_evidence" if both == {"insufficient_signal"} else "not_improved"
        assert r["s"] == want


def profile_rows(spark):
    from proselens.operators import profiles

    rows = [
        ("Journal of Maps", profiles.V3, True, "sentence_length", "exemplar", "high", '{"mean_range_words":[10,20],"minimum_sd_words":2.5,"distribution":{"a":1}}'),
        ("Journal of Maps", profiles.V3, True, "paragraph_length", "rule", "medium", '{"word_range":[40,180],"sentences_per_paragraph":[2,7]}'),
        ("Journal of Maps", profiles.V3, True, "opening_structure", "exemplar", "medium", '{"other":2}'),
        ("Journal of Maps", profiles.V3, True, "active_passive_by_section", "exemplar", "high", '{"Methods":{"active_ratio":0.4,"passive_ratio":0.6}}'),
        ("Journal of Maps", profiles.V3, True, "first_person", "exemplar", "high", '{"per_1000_words":3}'),
        ("Letters", profiles.V2, False, "sentence_length", "exemplar", "high", '{"mean_range_words":[1,2]}'),
        ("Letters", profiles.V2, False, "opening_structure", "exemplar", "high", '{"other":1}'),
        ("Notes", profiles.V3, False, "first_person", "exemplar", "high", '{"per_1000_words":3}'),
    ]
    return spark.createDataFrame(rows, "venue string, schema string, is_default boolean, field string, source string, confidence string, json string").select("venue", "schema", "is_default", "field", "source", "confidence", F.parse_json("json").alias("value"))


def test_profiles_resolve_by_venue_schema_and_section(spark):
    from proselens.operators import profiles

    wanted = spark.createDataFrame([(1, "journal  OF maps", "Methods"), (2, None, "Evaluation"), (3, "letters", None), (4, "elsewhere", None), (5, " Notes", None)], "key long, venue string, section_type string")
    fields = profiles.resolved(wanted, profile_rows(spark))
    got = {(r["key"], r["field"]): (r["eligible"], r["reason"], r["value"]) for r in fields.select("key", "field", "eligible", "reason", F.to_json("value").alias("value")).collect()}
    assert got[1, "sentence_length"][:2] == (True, None) and got[1, "opening_structure"] == (False, "value has not the shape of its field", None) and got[1, "hedging"] == (False, "field missing", None)
    assert got[1, "active_passive_by_section"] == (True, None, '{"Methods":{"active_ratio":0.4,"passive_ratio":0.6}}')
    assert got[2, "active_passive_by_section"] == (False, "no voice for section type Evaluation", None)
    assert got[3, "opening_structure"][:2] == (False, "earlier schema; rebuild as v3") and got[3, "sentence_length"][0]
    by = {r["key"]: (r["venue"], r["venue_match"], r["eligible"], r["exemplars"], r["status"]) for r in profiles.statuses(fields).collect()}
    assert by == {1: ("Journal of Maps", "matched", 4, 3, "partial"), 2: ("Journal of Maps", "unstated", 3, 2, "partial"), 3: ("Letters", "matched", 1, 1, "partial"), 4: ("Journal of Maps", "default", 4, 3, "partial"), 5: ("Notes", "matched", 1, 1, "ok")}
    assert {r["status"] for r in profiles.statuses(profiles.resolved(wanted, profile_rows(spark).limit(0))).collect()} == {"none"}


def test_built_profiles_have_the_shapes_that_are_read(spark, tmp_path):
    import json

    from proselens.operators import fingerprint, profiles, rules
    from proselens.sources import readers

    body = "We show a map of the town. However, it may be old and the bridge was moved by the river in the last long winter of the age. " * 3
    docs = spark.createDataFrame([(1, f"# Methods\n{body}\n\nIn spring it was built. We go there again and again.\n\n# Evaluation\n{body}"), (2, "Short."), (3, None)], "doc_id long, text string")
    rows = profiles.built(docs, rules.findings(docs)).cache()
    shape = rows.select("doc_id", "field", "source", F.to_json("value").alias("json"), targets.valid_field("field", "source", "value").alias("ok")).collect()
    assert {r["doc_id"] for r in shape} == {1, 2} and len(shape) == 18 and all(r["ok"] for r in shape), [r for r in shape if not r["ok"]]
    own = {r["field"]: (r["source"], json.loads(r["json"])) for r in shape if r["doc_id"] == 1}
    assert set(own["active_passive_by_section"][1]) == {"Methods", "Evaluation"} and own["connectives"][1]["allowed"] in (["however"], "any that names a relation")
    # written as a file, read back, resolved, applied
    fields = {f: {"source": s, "confidence": "high", "value": v} for f, (s, v) in own.items()}
    (tmp_path / "p.json").write_text(json.dumps({"schema": profiles.V3, "default_venue": "M", "venue_profiles": {"M": {"fields": fields}}}))
    back = profiles.from_file(readers.profile(spark, f"file://{tmp_path}/p.json"))
    assert back.count() == 9 and all(r["ok"] for r in back.select(targets.valid_field("field", "source", "value").alias("ok")).collect())
    wanted = docs.select(F.col("doc_id").alias("key"), F.lit("m").alias("venue"), F.lit(None).cast("string").alias("section_type"))
    got = {r["doc_id"]: r["triggers"].split(",") for r in profiles.preflight(fingerprint.by_document(docs), rules.findings(docs), profiles.resolved(wanted, back)).collect()}
    assert not any(t.startswith("P4_TARGET") for t in got[1]) and 3 not in got


def test_null_texts_are_empty(spark):
    from proselens.operators import fingerprint, rules

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "It serves as a tool.")], "doc_id long, text string")
    got = {(r["doc_id"], r["rule"]): (r["hits"], r["density"]) for r in rules.report(docs).collect()}
    assert len(got) == 42 and got[1, 11] == got[2, 11] == (0, 0.0) and got[3, 11][0] == 1
    assert {r["doc_id"]: (r["hits"], r["passed"]) for r in rules.verdict(docs).where("doc_id < 3").collect()} == {1: (0, True), 2: (0, True)}
    assert [r["doc_id"] for r in fingerprint.by_document(docs).collect()] == [3] and rules.located(docs).where("doc_id < 3").count() == 0
    assert rules.phrase_hits(docs).where("doc_id < 3").count() == 0


def test_files_belong_to_titles_folders_or_themselves(spark):
    from proselens.operators import fingerprint

    rows = spark.createDataFrame([("a/b/x.md", "# On  \\emph{Maps}\n"), ("a/B c/x.md", "no title"), ("x.MD", "text"), ("q/x.tex", "\\title[s]{On maps}"), ("q/y.txt", "Title: ON maps!"), ("q/z.txt", None)], "path string, text string")
    got = {r["path"]: r["k"] for r in rows.select("path", fingerprint.paper_key().alias("k")).collect()}
    assert got == {"a/b/x.md": "title:on maps", "a/B c/x.md": "directory:b c", "x.MD": "path:x.md", "q/x.tex": "title:on maps", "q/y.txt": "title:on maps", "q/z.txt": "directory:q"}


def test_what_stands_in_one_cell_is_bounded(spark, monkeypatch):
    from proselens.operators import records

    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z")], "series int, place string, text string")
    assert corpus.manifest(rows, ["series"], "place", "text").count() == 2
    monkeypatch.setattr(corpus, "CELL", 1)
    monkeypatch.setattr(records, "LIST", 1)
    monkeypatch.setattr(records, "BODY", 1)
    for make in (lambda: corpus.manifest(rows, ["series"], "place", "text"), lambda: records.digest_set(rows, "text"), lambda: records.dossier(rows), lambda: records.numbered(rows, "series", F.col("text"), 1)):
        with pytest.raises(ValueError):
            make()


#: what texts of the next tests are made of
PARTS = [
    "This groundbreaking, Remarkable system is pivotal.", "It serves as a tool; in other words, it works", "Moreover, it was quickly opened. Furthermore, it may be 12.5 ms. However, we wait! Additionally, our map\n likely suggests more.",
    "A secure and  efficient map", "Latency falls 40%.", "It is SIGNIFICANTLY faster. The throughput is 3 GB!", "The evaluation, implementation and configuration of the optimization's statement-mention",
    "It appears to hold; we conjecture more. It suggests 5%", "not only fast\n\nbut also small", "maps, towns,\n and bridges", ", thereby improving trust by 5 ms.", ", using\n\nit, showing growth!", "l'été is opened; ÉTÉ was élargied — été-we our-ours wé _we", "état—moreover naïvetion x–y ‘quoted’ “we” …",
    "1.2.3 a-b-c a-b x'y 3.a 4-5 12\n\nms 7 bits 8bits 9.0 % v1.0 1a", "Because although while while it is not. `Code` is written by hand. \\emph{X} was seen.", "\\cite[see p. 3.\n\nx]{a, b,,c} \\ref {t} $x + y$ \\$5 $$z\n$$ \\[q\\] \\(w\\)", "\\begin{figure*}\n\\caption{Cost {of} it}\n\\label{ fig:a }\n\\end{figure*}", "\\begin{align}\na &= b\n\\end{align}", "\\begin{figure}\\caption{Costs}\\label{fig:b}\\end{figure}",
    "", "  ", "\t", "\r\n", "The peer is hidden. We? our! Ours", "e\u0301tude is o\u0301pened", "карта не moreover", "a\u00a0is\u00a0opened", "\u0001marks\u0002", "١٢ ms ½ x² ſhow", "a\u200db is moved", "\u001f", "delve-landscapes underscored seamlessly_x", "it should be noted that it is important to observe that", "Essentially that is all", "It holds, thereby improving trust.", "It is a thing, showing\n\nall of it!", "The technical packaging — a large model privacy inference — boasts it",
]


def made_texts(n, seed, parts=PARTS):
    r = random.Random(seed)
    return ["".join(x for _ in range(r.randint(0, 12)) for x in (r.choice(parts), r.choice([" ", " ", ". ", "\n", "\n\n", ".\n\n", "!\n \n", "?\n\n  ", ".", ""]))) for _ in range(n)]


def test_counts_are_those_of_the_expressions(spark, monkeypatch):
    from proselens.operators import counted, fingerprint, revision, rules

    plain = [p for p in PARTS if not counted.STRANGE.search(p)]
    texts = [*PARTS, *made_texts(500, 1, plain), *made_texts(100, 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    n = F.transform(F.array(*[F.lit(r) for r in counted.RULES]), lambda r: F.size(F.filter("h", lambda x: x["rule"] == r)).cast("double"))
    want = {r["k"]: r["w"] for r in rows.select("k", "text", rules.hits("text").alias("h")).select("k", F.concat(fingerprint.summed(F.col("text")), n).alias("w")).collect()}
    known: dict = {}
    got = {k: counted.counts(t, known) for k, t in enumerate(texts)}
    monkeypatch.setattr(counted, "MANY", 0)  # words are counted alike by arrays
    assert got == {k: counted.counts(t, {}) for k, t in enumerate(texts)}
    wrong = [(texts[k], got[k], want[k]) for k in got if got[k] is not None and [round(x, 9) for x in got[k]] != [round(x, 9) for x in want[k]]]
    assert not wrong, wrong[0]
    assert all((v is None) == bool(counted.STRANGE.search(texts[k])) for k, v in got.items())
    assert all(any(v[k] for v in got.values() if v) for k in range(counted.WIDTH))  # each count is met
    # the sums give the metrics
    measured = {r["k"]: r.asDict() for r in fingerprint.metrics(fingerprint.paragraph_rows(rows, ["k"]), ["k"]).collect()}
    own = rows.select("k", fingerprint.summed(F.col("text")).alias("s")).where("s[0] > 0").select("k", *[v.alias(m) for m, v in fingerprint.from_sums(lambda k: F.get("s", F.lit(k))).items()])
    for r in own.collect():
        assert all(measured[r["k"]][m] == pytest.approx(r[m], abs=1e-9) for m in r.asDict()), r
    # the guard's verdict
    others = [t if k % 5 == 0 else made_texts(1, k)[0] + t if k % 5 == 1 else t.replace("12", "13").replace("fig:a", "fig:c") if k % 5 == 2 else t.replace("Cost", "Price") if k % 5 == 3 else t + "?" for k, t in enumerate(texts)]
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(texts, others))], "pair_id long, before string, after string")
    frozen = {r["pair_id"]: r["passed"] for r in revision.frozen_verdict(pairs).collect()}
    cases = [(k, a, b, None if k % 50 == 7 else a) for k, (a, b) in enumerate(zip(texts, others))]
    kept = {r["k"]: r for r in targets.evaluated(spark.createDataFrame(cases, "k long, before string, output string, target string"), "k").collect()}
    assert {k: r["output_kept"] for k, r in kept.items()} == frozen and len(set(frozen.values())) == 2
    assert all(r["target_kept"] or k % 50 == 7 for k, r in kept.items())


def test_evaluation_counts_each_paragraph_once_in_one_row(spark, monkeypatch):
    from proselens.operators import counted

    seen = []
    real = counted.block
    monkeypatch.setattr(counted, "block", lambda t: seen.append(t) or real(t))
    paragraphs = [f"Paragraph {k} is here. It was opened by {k} users." for k in range(20)]
    versions = ["\n\n".join(paragraphs), "\n\n".join([*paragraphs[:10], "A new one is here.", *paragraphs[10:]]), "\n\n".join(paragraphs[1:])]
    known: dict = {}
    assert len(counted.case(*versions, known)) == 2 + 3 * counted.WIDTH and len(seen) == 21
    # no text is shuffled or joined, and the texts reach Python once
    df = targets.evaluated(spark.createDataFrame([(1, *versions)], "k long, before string, output string, target string"), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert df.collect()[0]["rule_initial"] == 0


def test_evaluation_of_odd_cases(spark):
    same = "We map it. It is moved by hand."
    cases = [(1, None, None, None), (2, "", same, same), (3, same, same, same), (None, same, same, same), (4, "карта is moved. 12 ms is it.", "карта is moved. 13 ms is it.", "карта is moved. 12 ms is it.")]
    got = {r["k"]: r for r in targets.evaluated(spark.createDataFrame(cases, "k long, before string, output string, target string"), "k").collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["eligible"] == got[2]["eligible"] == 0 and got[2]["structural"] == "insufficient_signal" and got[1]["status"] == "insufficient_evidence"
    assert got[3]["eligible"] > 0 and got[3]["output_kept"] and got[3]["structural"] == "insufficient_signal"
    assert not got[4]["output_kept"] and got[4]["target_kept"] and got[4]["eligible"] > 0
    assert all(r["eligible"] == 0 and r["convergence"] is None for r in targets.evaluated(spark.createDataFrame(cases[2:3], "k long, before string, output string, target string"), "k", passes=()).collect())
