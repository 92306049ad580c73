"""Small tables with hand-made results, and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proselens.functions import text as tx
from proselens.operators import align, corpus, fingerprint, glossary, history, markers, revision, rules, targets, terms
from proselens.sources import readers


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def pair(spark, before, after):
    return spark.createDataFrame([(1, before, after)], "pair_id long, before string, after string")


RULE_SAMPLES = {
    1: ("A pivotal step.", "A useful step."),
    2: ("It is efficient.", "It is efficient at 12 ms."),
    3: ("We study technical packaging.", "We study packaging."),
    4: ("We leverage it.", "We use it."),
    5: ("Moreover, a. However, b. Furthermore, c.", "Moreover, a. However, b."),
    6: ("It should be noted that it ran.", "It ran."),
    7: ("The creation of the notion of density is motion and tension.", "The notion is simple."),
    8: ("In other words, it ran.", "It ran."),
    9: ("It suggests a cause.", "It suggests a cause of 12 %."),
    10: ("It ran, improving things a lot.", "It ran, improving by using a cache."),
    11: ("It serves as a tool.", "It is a tool."),
    12: ("It is not only fast but also small.", "It is fast and small."),
    13: ("We pack, store, and send.", "We pack and send."),
    14: ("One — two — three.", "One, two, three."),
}


@pytest.mark.parametrize("number", sorted(RULE_SAMPLES))
def test_rule_samples(spark, number):
    for text, hit in zip(RULE_SAMPLES[number], (True, False)):
        got = {r["rule"] for r in rules.findings(one(spark, text)).collect()}
        assert (number in got) is hit, (text, got)


def test_findings_have_places(spark):
    got = rules.located(one(spark, "First line.\nA pivotal step, in other words.")).orderBy("start").collect()
    assert [(r["rule"], r["line"], r["column"]) for r in got] == [(1, 2, 3), (8, 2, 17)]


def test_sections_and_types(spark):
    got = tx.sections(one(spark, "before\n# Related Work\nx\n## Threat Model\ny"), "text", ["doc_id"]).withColumn("k", tx.section_type("title")).orderBy("sec_no").collect()
    assert [(r["title"], r["k"]) for r in got] == [("Preamble", "Other"), ("Related Work", "Related Work"), ("Threat Model", "Threat Model")]


def test_fingerprint_by_hand(spark):
    r = fingerprint.by_document(one(spark, "We show a bound here. However, it was measured twice.\n\nIt may hold now.")).first()
    assert (r["paragraph_count"], r["sentence_count"], r["word_count"], r["passive_sentences"], r["connective_count"], r["claim_sentence_count"], r["hedge_count"]) == (2, 3, 14, 1, 1, 1, 1)
    assert r["alternation_index"] == 0.0 and r["mean_sentence_length"] == pytest.approx(14 / 3)


def test_baseline_is_thin_and_z_is_null_without_spread(spark):
    docs = spark.createDataFrame([(1, "A b c. D e f."), (2, "A b c. D e f.")], "doc_id long, text string")
    m = fingerprint.by_document(docs)
    base = fingerprint.baseline(m, "doc_id")
    assert base.first()["status"] == "thin(n=2)"
    assert fingerprint.compared(m, base).where("drift or z is not null").count() == 0


def test_balanced_captions_and_references(spark):
    text = "\\begin{table*}\\caption{By \\textbf{size {x}} in Table 4 and \\citep{k}}\\label{t}\\end{table*} \\cref{z} \\cite[p]{a, b}"
    got = sorted(r["value"] for r in markers.figures(one(spark, text), "doc_id", "text").collect())
    assert got == ["table:caption-literal:Table 4", "table:caption:cite:k", "table:label:t"]
    r = one(spark, text).select(markers.references("text").alias("a"), markers.reference_families("text").alias("b")).first()
    assert "cref:z" in r["a"] and "cref:z" not in r["b"] and "cite:a" in r["b"]


def test_ordinal_moves_truncate(spark):
    got = revision.moves(pair(spark, "It may run and it suggests more.", "It suggests a run.")).collect()
    assert [(r["original"], r["revised"], r["span"]) for r in got] == [("may", "suggests", 1)]


def test_anchor_gate(spark):
    near, far = "an exact scheme", "an exact day, scheme"
    move = lambda t: revision.moves(pair(spark, t.replace("exact", "approximate"), t), revision.CRYPTO, True).count()
    assert (move(near), move(far)) == (1, 0)


def test_no_leakage_spares_one_negation(spark):
    r = revision.strength_verdict(pair(spark, "There is no leakage.", "There is bounded leakage.")).first()
    assert r["negations"] == 0 and r["passed"]


@pytest.mark.parametrize("make", [revision.differences, lambda p: revision.moves(p), revision.flips, lambda p: revision.removed_by_token(p)])
def test_identity_changes_nothing(spark, make):
    text = "It may show 12 ms, higher than \\cite{a}, in the worst setting."
    assert make(pair(spark, text, text)).count() == 0


def test_differences_are_symmetric(spark):
    a, b = "It may take 12 ms \\ref{x}.", "It can take 13 ms \\ref{y}."
    there = {(r["category"], r["value"], r["removed"], r["added"]) for r in revision.differences(pair(spark, a, b)).collect()}
    back = {(r["category"], r["value"], r["added"], r["removed"]) for r in revision.differences(pair(spark, b, a)).collect()}
    assert there == back and there


def test_glossary_override_and_findings(spark):
    entries = glossary.layers(spark)
    got = {r["term"]: r["layer"] for r in glossary.merged(entries).collect()}
    assert got["bootstrapping"] == "L2" and got["Key-Switching"] == "L1" and "key-switching" not in got
    p = pair(spark, "The ciphertext is sent.", "The cipher text is sent. Ciphertext it is.")
    own = {(r["kind"], r["observed"], r["start"]) for r in terms.findings(p, glossary.merged(entries)).collect()}
    assert own == {("plural_or_hyphen_variant", "cipher text", 4)}


def test_pass_three_may_change_terms(spark):
    p = pair(spark, "The ciphertext is sent.", "The value is sent.")
    entries = glossary.merged(glossary.layers(spark))
    report = revision.category_report(revision.differences(p))
    none = terms.findings(p, entries)
    got = {r["pass"]: r["verdict"] for r in glossary.pass_verdict(report, none, none, none, p).collect()}
    assert got == {"P3": "proceed", "P4": "rollback", "P5": "rollback", "P6": "rollback", "P7": "rollback"}


def test_drivers_must_not_overlap(spark):
    pairs = spark.createDataFrame([(1, 0, 1, "a", "b")], "series long, stage int, next_stage int, before string, after string")
    with pytest.raises(ValueError):
        history.drivers(pairs, [(0, 1)], [(0, 1)])
    assert history.drivers(pairs, [(0, 1)], []).first()["driver"] == "reviewer-driven"


def test_dominant_passes_and_order(spark):
    counts = spark.createDataFrame([(1, "P4", 3), (1, "P5", 3), (2, "P2", 5), (2, "P4", 1)], "stage int, pass string, n long")
    assert sorted(tuple(r) for r in history.dominant(counts).collect()) == [(1, "P4", 3), (1, "P5", 3), (2, "P2", 5)]
    assert [tuple(r) for r in history.order_conflicts(counts).collect()] == [(2, "P4", "P2")]


def test_distance_statuses(spark):
    m = {x: 1.0 for x in targets.METRICS} | {"paragraph_count": 3.0}
    row = lambda **k: tuple((m | k)[x] for x in ["paragraph_count", *targets.METRICS])
    kind = "struct<" + ",".join(f"{x}:double" for x in ["paragraph_count", *targets.METRICS]) + ">"
    df = spark.createDataFrame([(1, row(mean_sentence_length=10.0, connective_density=1.0), row(mean_sentence_length=8.0, connective_density=2.0), row(mean_sentence_length=6.0))], f"k long, before {kind}, output {kind}, target {kind}")
    got = {r["metric"]: r for r in targets.distances(df, "k").collect()}
    assert got["mean_sentence_length"]["status"] == "closer" and got["mean_sentence_length"]["convergence"] == 50.0
    assert got["connective_density"]["status"] == "diverged_from_exact_match" and got["connective_density"]["convergence"] is None
    assert not got["active_sentence_ratio"]["eligible"]


def test_links_are_absolute(spark):
    html = '<a href="/x">X <b>y</b></a><a href="z.html">Z</a><a class="c" href="//h/p">P</a><a href="mailto:a@b">M</a>'
    df = spark.createDataFrame([(1, "https://s.org/d/e?q", html)], "page_id long, url string, html string")
    got = [(r["text"], r["target"]) for r in corpus.links(df).orderBy("place").collect()]
    assert got == [("X y", "https://s.org/x"), ("Z", "https://s.org/d/z.html"), ("P", "https://h/p"), ("M", "mailto:a@b")]



def test_links_join_as_the_standard_library_does(spark):
    from html import unescape
    from urllib.parse import urljoin

    refs = ["b.html", "../x", "./y/../z", "/a/./b/../c", "?p=1", "#top", "//h/x", "http://q/../r", "", "..", ".", "../../../../k/", "a/b/?x=../y", "mailto:a@b", "a&amp;b?c=1&amp;d", "x&#47;y", "&#x41;"]
    rows = [(u, r, q) for u in ("http://h.org/d/e/f.html?q=2#z", "http://h.org", "http://h.org/d/") for r in refs for q in ("'", '"')]
    df = spark.createDataFrame([(k, u, f"<p><A class='k' HREF={q}{r}{q} id=2>t &amp; <b>u</b></a>") for k, (u, r, q) in enumerate(rows)], "page_id long, url string, html string")
    got = {x["page_id"]: (x["text"], x["target"]) for x in corpus.links(df).collect()}
    assert got == {k: ("t & u", urljoin(u, unescape(r))) for k, (u, r, _) in enumerate(rows)}


def test_notes_split_at_the_first_equals(spark):
    got = spark.range(1).select(corpus.notes(F.lit("a=1; b=x")).alias("m")).first()["m"]
    assert got == {"a": "1", "b": "x"}


def test_readers(spark, tmp_path):
    (tmp_path / "private").mkdir()
    (tmp_path / "paper_v2.md").write_bytes(b"# T\r\nx")
    (tmp_path / "private" / "paper_v1.md").write_bytes(b"y")
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    (tmp_path / "other.bin").write_bytes(b"z")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.documents(spark, str(tmp_path), lenient=True, private="private").collect()}
    assert got == {"paper_v2.md": "# T\nx", "bad.txt": "ab"}
    with pytest.raises(Exception):
        readers.documents(spark, str(tmp_path)).collect()
    (tmp_path / "g.md").write_text("| Term | Preferred English | Avoid | Notes |\n|---|---|---|---|\n| a | key map | key table; map key | n |\n")
    r = readers.glossary_markdown(spark, str(tmp_path / "g.md")).first()
    assert (r["term"], r["synonyms"], r["variants"]) == ("a", ["key table", "map key"], [])
    with pytest.raises(ValueError):
        readers.write_confined(spark.range(1), str(tmp_path), "../x")


def test_streamed_findings_equal_batch(spark, small, tmp_path):
    from proselens.streaming import scan

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    got = scan.drained(spark, scan.findings(stream), "streamed")
    want = rules.findings(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


words = st.lists(st.sampled_from("a b c d e f".split()), max_size=8)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(words, st.booleans()), max_size=5), st.lists(st.tuples(words, st.booleans()), max_size=5))
def test_scope_alignment_is_one_to_one(old, new):
    got = align.scope_pairs(old, new)
    assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got)
    assert all(s >= align.SCOPE for _, _, s in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a b c", "a b d", "x y z", "q"]), max_size=6), st.lists(st.sampled_from(["a b c", "a b d", "x y z", "q"]), max_size=6))
def test_paragraph_alignment_covers_both_sides(old, new):
    got = align.paragraph_pairs(old, new)
    assert sorted(i for _, i, _, _ in got if i >= 0) == list(range(len(old)))
    assert sorted(j for _, _, j, _ in got if j >= 0) == list(range(len(new)))
    assert all(s == "unchanged" for s, *_ in align.paragraph_pairs(old, old))


def test_markers_that_move_between_scopes_are_relocations(spark):
    from proselens.operators import relocation

    rows = [
        (1, "The map may hold for the whole town. The bridge stands near the old mill.", "The map holds for the whole town. The bridge may stand near the old mill."),
        (2, "The map may hold for the whole town.", "The map must hold for the whole town."),
        (3, "The map may hold.", "The map may hold."),
        (4, "", ""),
    ]
    pairs = spark.createDataFrame(rows, "pair_id long, before string, after string")
    assert [r["pair_id"] for r in relocation.relocations(pairs).collect()] == [1]
    assert {r["pair_id"] for r in relocation.scoped_differences(pairs).collect()} == {1, 2}


def test_records_take_nulls_and_empty_tables(spark):
    from proselens.operators import records

    files = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "digest string")
    assert not any(r["admitted"] for r in records.admitted(files, none, "doc_id", "text").collect())
    titles = spark.createDataFrame([], "title string")
    assert records.canonical(files.selectExpr("doc_id", "text as title"), titles).count() == 3
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, None)], "series long, place int, text string")
    got = {r["series"]: r["equal"] for r in records.same_order(parts, parts.where("place = 0")).collect()}
    assert got == {1: False}
    assert records.same_order(parts, parts).first()["equal"]
    edges = records.mentions(spark.createDataFrame([("a/x.md", "see y.md and z.md and a/x.md"), ("a/y.md", ""), ("b/z.md", None)], "path string, text string"))
    assert {(r["mention"], r["target"], r["how"]) for r in edges.collect()} == {("y.md", "a/y.md", "sibling"), ("z.md", "b/z.md", "name")}


def test_reachability_has_no_depth_limit(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(40)] + [(40, 3), (5, 100), (100, 39), (200, 201)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    want, queue = {0: 0}, [0]
    for a in queue:
        for src, dst in chain:
            if src == a and dst not in want:
                want[dst] = want[a] + 1
                queue.append(dst)
    long = [(a, b) for a, b in chain if a != 100]
    got = {r["node"]: r["depth"] for r in corpus.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == want
    monkeypatch.setattr(corpus, "FEW", 3)
    got = corpus.reachable(spark.createDataFrame(long, "src long, dst long"), spark.createDataFrame([(0,)], "node long"))
    assert sorted(map(tuple, got.where("node <= 40").select("node", "depth", "parent").collect()), key=lambda r: r[0]) == [(k, k, k - 1 if k else None) for k in range(41)]


def all_scope_pairs(old, new):
    """Each scope against each, by two sequence similarities."""
    from difflib import SequenceMatcher

    alike = lambda a, b: max(SequenceMatcher(None, a, b, autojunk=False).ratio(), SequenceMatcher(None, sorted(a), sorted(b), autojunk=False).ratio())
    scores = [(alike(a, b), i, j) for i, (a, _) in enumerate(old) for j, (b, _) in enumerate(new)]
    scores = [x for x in scores if x[0] >= align.SCOPE]

    def doubtful(side, n, marked):
        best = [sorted((x[0] for x in scores if x[side] == k), reverse=True) for k in range(n)]
        return {k for k in range(n) if marked[k][1] and len(best[k]) > 1 and best[k][0] - best[k][1] < align.MARGIN}

    no_old, no_new, out = doubtful(1, len(old), old), doubtful(2, len(new), new), []
    for s, i, j in sorted(scores, key=lambda x: (-x[0], abs(x[1] - x[2]), x[1], x[2])):
        if i not in no_old and j not in no_new:
            no_old.add(i), no_new.add(j)
            out.append((i, j, s))
    return sorted(out)


near_words = st.lists(st.sampled_from("a b c".split()), max_size=6)
marked_words = st.tuples(words | near_words, st.booleans())


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(marked_words, max_size=9), st.lists(marked_words, max_size=9))
def test_scope_alignment_agrees_with_each_against_each(old, new):
    assert align.scope_pairs(old, new) == all_scope_pairs(old, new)
    assert align.scope_pairs(old, old[1:] + new) == all_scope_pairs(old, old[1:] + new)


def test_scope_words_are_stems_without_markers():
    got = align.scope_words("the studies of boxes and classes may not show a crisis in several caches")
    assert got == ("study box class a crisis cach".split(), True) and align.scope_words("maps fit") == (["maps", "fit"], False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abAB", max_size=5), max_size=6), st.lists(st.text("abAB", max_size=5), max_size=6))
def test_paragraphs_agree_with_each_against_each(old, new):
    """Replaced blocks by all similarities, the highest first, ties from behind."""
    from difflib import SequenceMatcher

    low = lambda xs: [x.casefold() for x in xs]
    want = []
    for tag, a, b, c, d in SequenceMatcher(None, low(old), low(new), autojunk=False).get_opcodes():
        if tag == "equal":
            want += [("unchanged", a + k, c + k, 1.0) for k in range(b - a)]
            continue
        pairs = sorted([(SequenceMatcher(None, old[i].casefold(), new[j].casefold(), autojunk=False).ratio(), i, j) for i in range(a, b) for j in range(c, d)])[::-1]
        left, right = set(range(a, b)), set(range(c, d))
        for s, i, j in pairs:
            if s >= 0.2 and i in left and j in right:
                want.append(("modified", i, j, round(s, 4)))
                left.remove(i), right.remove(j)
        want += [("deleted", i, -1, 0.0) for i in left] + [("inserted", -1, j, 0.0) for j in right]
    assert sorted(align.paragraph_pairs(old, new)) == sorted(want)


def test_crypto_words_that_change_places_do_not_move(spark):
    from proselens.operators import relocation

    rows = [
        (1, "The semi-honest case is first. Then comes the malicious peer.", "The malicious case is first. Then comes the semi-honest peer."),
        (2, "The peer is semi-honest.", "The peer is malicious."),
        (3, "The peer is semi-honest.", "The peer is semi-honest."),
    ]
    pairs = spark.createDataFrame(rows, "pair_id long, before string, after string")
    assert [(r["pair_id"], r["span"]) for r in revision.crypto_moves(pairs).collect()] == [(2, 1)]
    got = {(r["pair_id"], r["original"], r["revised"]) for r in relocation.crypto_relocations(pairs).collect()}
    assert got == {(1, "semi-honest", "semi-honest"), (1, "malicious", "malicious")}
    assert {r["pair_id"]: r["crypto_upward"] for r in revision.strength_verdict(pairs).collect()} == {1: 0, 2: 1, 3: 0}


def test_guard_blocks_changed_captions_and_claims(spark):
    fig = "\\begin{figure}\\caption{%s}\\label{%s}\\end{figure} The map %s for all towns."
    before = fig % ("Cost \\textbf{now}", "a", "may hold")
    rows = [(1, before, before), (2, before, fig % ("Cost \\textbf{then}", "a", "may hold")), (3, before, fig % ("Cost \\textbf{now}", "b", "may hold")), (4, before, fig % ("Cost \\textbf{now}", "a", "must hold"))]
    pairs = spark.createDataFrame(rows, "pair_id long, before string, after string")
    assert {r["pair_id"]: r["failed"] for r in revision.guard_verdict(pairs).collect()} == {1: "", 2: "figures", 3: "figures,references", 4: "claim_strength,modality"}
    assert {r["pair_id"]: r["passed"] for r in revision.immutable_verdict(pairs).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_latex_goes_before_a_text_is_measured(spark):
    from proselens.operators import fingerprint

    text = "\\section{One} We show a map \\cite{x}. It has $a + b$ two parts % not this\nhere. \\begin{table}no words\\end{table}"
    docs = spark.createDataFrame([(1, text, ".tex"), (2, text, ".md"), (3, "We show a map . It has two parts here.", ".md")], "doc_id long, text string, suffix string")
    got = {r["doc_id"]: r["word_count"] for r in fingerprint.by_document(docs).collect()}
    assert got[1] == got[3] == 9 and got[2] > 9


def test_targets_by_the_policy(spark):
    from proselens.operators import fingerprint

    short = "We may run. It is so. They do go. You all see."
    docs = spark.createDataFrame([(1, short), (2, short + "\n\nHowever, the result shows that one map is larger than each of the other maps that were drawn by hand in that year for the town. Moreover it may fail.")], "doc_id long, text string")
    measured, found = fingerprint.by_document(docs), rules.findings(docs)
    screened = {(r["doc_id"], r["dimension"]): (r["source"], r["reason"]) for r in targets.screening(measured, found).collect()}
    assert screened[1, "sentence_length"] == ("rule", "sentence sample or variance below policy threshold")
    assert screened[1, "hedging"] == ("exemplar", "clean and sufficiently observed") and screened[1, "paragraph_length"][1] == "fewer than 2 paragraphs"
    assert len(screened) == 18
    flight = {r["doc_id"]: (r["triggers"], r["decision"]) for r in targets.preflight(measured, found).collect()}
    assert flight[1] == ("P4_RULE_SENTENCE_MEAN_OUT_OF_RANGE,P4_RULE_SENTENCE_SD_LOW", "revise")
    assert "P4_PARAGRAPH_WORDS_OUT_OF_RANGE" in flight[2][0]
    cases = spark.createDataFrame([(1, "a", "a", "a", True, 0), (2, "a", "b", "a\r\n", True, 0), (3, "a", "a", "c", True, 0), (4, "a", "a", "a", False, 0)], "k long, before string, output string, target string, frozen boolean, changes int")
    assert {r["k"]: r["preserved"] for r in targets.preserved(cases, "k").collect()} == {1: True, 2: False, 4: False}


def test_relocation_queries_find_what_was_moved(spark, small):
    from proselens.queries import QUERIES

    got = QUERIES["j12_crypto_relocations"](spark, small).collect()
    assert got and {r["pair_id"] % 3 for r in got} == {0}
    got = QUERIES["j16_relocations"](spark, small).collect()
    assert got and {r["pair_id"] % 3 for r in got} == {0} and all(r["moved"] >= 1 for r in got)


def test_scope_queries_read_whole_texts(spark, tmp_path):
    from proselens.operators import relocation
    from proselens.plans import seed
    from proselens.queries import QUERIES

    own = "No bridge may hold. It is not larger than ten; the mill stands. Some maps must fail.\nThe river cannot rise."
    rows = [(14, own), (0, None), (15, own)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = {r["pair_id"]: r for r in seed.pairs(spark, str(tmp_path)).collect()}
    prose = {r["pair_id"]: r["prose"] for r in QUERIES["p14_claim_prose"](spark, str(tmp_path)).collect()}
    assert prose[15] == "no bridge may hold. it is not larger than ten; the mill stands. some maps must fail. the river can not rise."
    cut = lambda t: spark.range(1).select(tx.scopes(markers.prose(F.lit(t)))).first()[0]
    want = {(k, i, j, s) for k, r in pairs.items() for i, j, s in all_scope_pairs([align.scope_words(x) for x in cut(r["before"])], [align.scope_words(x) for x in cut(r["after"])])}
    got = {tuple(r) for r in QUERIES["j14_scope_alignment"](spark, str(tmp_path)).collect()}
    assert got == want
    assert {i for k, i, _, _ in got if k == 15} == set(range(5))
    scoped = QUERIES["j15_scoped_markers"](spark, str(tmp_path)).collect()
    assert {r["pair_id"] for r in scoped} == {14} and {r["scope"] for r in scoped} <= {5, -6}
    moved = spark.createDataFrame([(1, "It may hold. " + own, own + " It may hold."), (2, own, own)], "pair_id long, before string, after string")
    assert relocation.scoped_differences(moved).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a\\$\n", max_size=14))
def test_inline_math_is_what_the_plain_pattern_finds(text):
    import re

    plain = re.compile(r"(?s)(?<!\\)\$(?:\\.|[^$])*?(?<!\\)\$")
    assert [m.span() for m in re.finditer(markers.INLINE, text)] == [m.span() for m in plain.finditer(text)]


def test_prose_takes_long_texts_between_dollars(spark):
    rows = one(spark, "It costs $5. " + "The map holds. " * 20000 + "It costs $6.")
    assert rows.select(F.trim(markers.prose("text"))).first()[0] == "it costs  6."


def test_located_findings_hold_trailing_participles(spark, tmp_path):
    import re

    from proselens.queries import QUERIES

    plain = lambda p: re.compile(p, re.ASCII)
    pattern = plain(dict((n, p) for n, _, p in rules.PATTERNS)[10])
    unless = [plain(rules.EVIDENCE), plain(rules.MECHANISM)]
    rows = [
        (0, "First line.\nThe map is old, making it rare. It is kept, thereby saving\nspace! It fell, causing 12 ms of delay."),
        (1, "It ran, using a cache. It ran, opening the gate? It ran, ending"),
        (15, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "'en' AS lang", "'x' AS source", "text").write.parquet(str(tmp_path / "documents.parquet"))
    from proselens.plans import seed

    want = set()
    for r in seed.documents(spark, str(tmp_path)).collect():
        for m in pattern.finditer(r["text"]):
            if not any(u.search(m[0]) for u in unless):
                line = r["text"][: m.start()].split("\n")
                want.add((r["doc_id"], 10, "info", m[0], m.start(), len(line), len(line[-1]) + 1))
    got = QUERIES["r17_located_findings"](spark, str(tmp_path)).where("rule = 10").select("doc_id", "rule", "severity", "match", "start", "line", "column")
    assert {tuple(r) for r in got.collect()} == want
    assert {(k, m) for k, _, _, m, *_ in want} >= {(0, ", making it rare"), (0, ", thereby saving\nspace"), (1, ", opening the gate")}


def every_place(text):
    """All findings of a text, rule by rule, in plain Python."""
    import re

    at = lambda k: (k, text.count("\n", 0, k) + 1, k - text.rfind("\n", 0, k))
    find = lambda p, t: list(re.finditer(p, t, re.ASCII))
    out = set()
    for n, severity, p in rules.PATTERNS:
        own = [m for m in find(p, text) if n != 10 or not (find(rules.EVIDENCE, m[0]) or find(rules.MECHANISM, m[0]))]
        out |= {(n, severity, m[0], *at(m.start())) for m in own}
    spans = [m for m in find(rules.SENTENCE, text) if m[0].strip()]
    for m in find(rules.ADJECTIVE, text):
        k = next(i for i, s in enumerate(spans) if s.start() <= m.start() < s.end())
        if not find(rules.METRIC, " ".join(s[0] for s in spans[max(k - 1, 0) : k + 2])):
            out.add((2, "warn", m[0], *at(m.start())))
    for s in spans:
        names = re.findall(r"(?i)\b[A-Za-z]+(?:tion|sion|ment|ance|ence|ity|ization)\b", s[0])
        if len(names) > 2:
            out.add((7, "info", ", ".join(names[:4]), *at(s.start())))
    ends = [(0, 0), *[m.span() for m in find(rules.PARAGRAPH, text)], (len(text), len(text))]
    for (_, a), (b, _) in zip(ends, ends[1:]):
        p = text[a:b]
        words = find(rules.CONNECTIVE, p)
        if len(words) > 2:
            out.add((5, "warn", ", ".join(m[1] for m in words), *at(a + words[0].start(1))))
        hedges = [h for h in rules.HEDGES for _ in re.findall(rf"\b{h}\b", p.lower())]
        if hedges and (len(hedges) > 3 or not find(rules.SUPPORT, p)):
            out.add((9, "warn", ", ".join(hedges), *at(a + min(p.lower().find(h) for h in hedges))))
    dashes, words = text.count("—"), max(len(find(tx.LETTER_WORD, text)), 1)
    if dashes * 1000 > 3 * words:
        out.add((14, "warn", f"{dashes} em dashes ({dashes * 1000 / words:.2f}/1000 words)", *at(text.index("—"))))
    return out


PLACED = [
    "",
    "   \n\n  ",
    "It is secure\nand efficient. Practical! The latency fell.\n\nIt is dramatically scalable",
    "x.  Moreover, a.\nHowever, b. Furthermore, c.\n\nMoreover it ran. However, it fell.",
    "Überall\n \nMoreover, a. However b! Additionally, the creation of motion, tension and density. End",
    "One — two.\n  The notion of density is motion — and tension, ability, presence.",
    "It insuggests nothing; the map suggests it. We conjecture so.\n\n\nIt appears to. It suggests. It suggests. It is consistent with 5 ms.",
    "Practical. Practical\u0001 practical.\nA pivotal, scalable and efficient map — in other words 5 % of it.",
    "significantly " * 40 + "\n" + "A notion, motion, tension.\n" * 30 + "throughput",
]


def test_all_findings_stand_where_plain_python_finds_them(spark):
    rows = spark.createDataFrame([*enumerate(PLACED), (99, None)], "doc_id long, text string")
    got = {k: set() for k in range(len(PLACED))}
    for r in rules.located(rows).select("doc_id", "rule", "severity", "match", "start", "line", "column").collect():
        got[r[0]].add(tuple(r)[1:])
    for k, text in enumerate(PLACED):
        assert got[k] == every_place(text.replace("\u0001", " ")), text
    counted = {r["doc_id"]: r["n"] for r in rules.findings(rows).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {k: len(v) for k, v in got.items() if v}
    assert {n for v in got.values() for n, *_ in v} >= {1, 2, 5, 7, 8, 9, 14}


def test_bibliography_entries_by_hand(spark):
    kind = "title string, venue string, year string, notes string, direction string, secondary string"
    rows = [("B \\ {x} & y", "ACM CCS", "2020", "doi = 1/2 ; doi=3; x", "maps", "a; b"), ("  ", None, None, "also_eprint=2020/1; eprint=", None, None), ("b", "IEEE Access", "2020", "arxiv=9;eprint=8", "", "c")]
    got = [r["entry"] for r in corpus.bibliography(spark.createDataFrame(rows, kind), "k", "From a test", "at").orderBy("place").collect()]
    assert got == [
        "@misc{k--paper,\n  eprint = {2020/1},\n  archivePrefix = {IACR Cryptology ePrint Archive},\n  note = {From a test},\n  at = {001}\n}",
        "@article{k-2020-b,\n  title = {b},\n  year = {2020},\n  journal = {IEEE Access},\n  eprint = {9},\n  archivePrefix = {arXiv},\n  note = {From a test; secondary directions: c},\n  at = {002}\n}",
        "@inproceedings{k-2020-b-x-y,\n  title = {B \\textbackslash\\{\\} \\{x\\} \\& y},\n  year = {2020},\n  booktitle = {ACM CCS},\n  doi = {3},\n  note = {From a test; primary direction: maps; secondary directions: a; b},\n  at = {003}\n}",
    ]
    assert corpus.bibliography(spark.createDataFrame([], kind)).count() == 0


def test_flags_of_texts_and_lines_by_hand(spark):
    rows = [(1, "Unpublished: 5 ms and 3x, R2 and reviewer #1", ".md"), (2, "- Limit: 5 ms\nit took 5 ms\nsee 2021/123 <!-- allow-numeric --> 7 %", ".tex"), (3, None, None), (4, "5 msx, 2021-12", ".md")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, suffix string")
    assert [tuple(r) for r in corpus.sensitivity(docs).orderBy("doc_id").collect()] == [(1, True, 2, 2, True), (2, True, 2, 0, True), (3, False, 0, 0, False), (4, False, 0, 0, False)]
    assert sorted(map(tuple, corpus.flagged_lines(docs).collect())) == [(1, 1, "numeric"), (2, 2, "numeric"), (2, 3, "preprint")]


def test_files_in_order_and_dossiers(spark, tmp_path):
    for name in ("b_v2.tex", "A_v1.md", "c.bib", "x.bin", ".git/z.md", "own/p.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    ends = lambda rows: [r["path"].rsplit(tmp_path.name + "/", 1)[1] for r in rows]
    assert ends(readers.documents(spark, str(tmp_path), ordered=True).where("path not like '%.git%'").collect()) == ["A_v1.md", "b_v2.tex"]
    assert ends(readers.dossier_files(spark, str(tmp_path)).collect()) == ["A_v1.md", "b_v2.tex", "c.bib", "own/p.json"]
    assert ends(readers.dossier_files(spark, str(tmp_path), ["own", "c.bib"]).collect()) == ["c.bib", "own/p.json"]
    for bad in (["x.bin"], ["none.md"], ["../"]):
        with pytest.raises(ValueError):
            readers.dossier_files(spark, str(tmp_path), bad)
    with pytest.raises(ValueError):
        readers.versions(spark, str(tmp_path / "own"))
    assert {r["stage"] for r in readers.versions(spark, str(tmp_path)).collect()} == {1, 2}


def test_glossary_files_are_held_to_their_layouts(spark, tmp_path):
    path = tmp_path / "g.md"

    def read(text):
        path.write_text(text)
        return [(r["term"], r["synonyms"]) for r in readers.glossary_markdown(spark, str(path)).orderBy("pos").collect()]

    head = "intro\n| Chinese | Recommended English | Acceptable alternatives | Avoid | Notes |\n|---|:---:|---|---|---|\n"
    assert read(head + "| x | key map | k | map key，key table; map key | n |\n| x | b | | | |\nend\n| y |\n") == [("key map", ["map key", "key table"])]
    short = "| Term | Preferred English | Avoid | Notes |\n|---|---|---|---|\n"
    assert read(short + "| a | key map | b | |") == [("a", ["b"])]
    for bad in ("| a | b |\n|---|---|\n", head.replace("|---|\n", "|\n"), head + "| x | y |\n", head + "| x | | k | b | n |\n", head + "| x | b | | | |\n", head + "| x | b | k | c | n\n", ""):
        with pytest.raises(Exception):
            read(bad)
    path.write_text("| Term | English |\n|---|---|\n| a b; c | *d* |\nuse `e f g` here\n")
    terms = lambda p: [r["term"] for r in readers.glossary_terms(spark, str(p)).collect()]
    assert terms(path) == ["e f g", "a b", "c", "d"]
    (tmp_path / "g.csv").write_text('h,i,j\n"a, b",cc,no\n,d\n')
    assert terms(tmp_path / "g.csv") == ["a, b", "cc", "d"]
    (tmp_path / "g.json").write_text('{"schema": "s1", "layer": "L1", "direction": "maps", "entries": [{"term": " b "}, {"term": "aa"}, {"term": "b"}]}')
    assert terms(tmp_path / "g.json") == ["aa", "b"]
    with pytest.raises(Exception):
        readers.glossary_json(spark, str(tmp_path / "g.json"), "L1").collect()
    (tmp_path / "h.json").write_text('{"schema": "s1", "layer": "L1", "direction": "maps", "entries": [{"term": "b", "forbidden_synonyms": ["c"]}]}')
    ok = {"schema": "s1", "layer": "L1", "direction": "maps"}
    assert readers.layer_file(spark, str(tmp_path / "h.json"), **ok).count() == 1
    for k in ok:
        with pytest.raises(ValueError):
            readers.layer_file(spark, str(tmp_path / "h.json"), **{**ok, k: "other"})


def test_baselines_survive_a_file(spark, tmp_path):
    import json

    measured = spark.createDataFrame([(1, "a", *[float(k) for k in range(5)]), (2, "b", *[float(k + 2) for k in range(5)])], "doc_id long, source string, " + ", ".join(f"{m} double" for m in fingerprint.BASELINE))
    path = str(tmp_path / "b.json")
    base = fingerprint.baseline(measured, "source")
    readers.write_baseline(base, path)
    data = json.load(open(path))
    assert data["document_count"] == 2 and data["metric_stats"][fingerprint.BASELINE[1]] == {"mean": 2.0, "sd": 1.0}
    back = readers.baseline(spark, path)
    assert back.select(*base.columns).first() == base.first()
    for bad in ({}, {**data, "document_count": 0}, {**data, "metric_stats": {}}, {**data, "metric_stats": {**data["metric_stats"], fingerprint.BASELINE[0]: {"mean": "x", "sd": 1}}}, []):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            readers.baseline(spark, str(tmp_path / "bad.json"))


def test_fields_are_held_to_their_shapes(spark):
    import json

    from proselens.record_queries import FIELDS

    num = lambda x, low=0.0, high=float("inf"): type(x) in (int, float) and low <= x <= high
    two = lambda x: type(x) is list and len(x) == 2 and num(x[0], 1) and num(x[1], 1) and x[0] <= x[1]
    checks = {
        "sentence_length": lambda v, s: two(v.get("mean_range_words")) and num(v.get("minimum_sd_words")) and (s == "rule" or type(v.get("distribution")) is dict),
        "paragraph_length": lambda v, s: two(v.get("word_range")) and two(v.get("sentences_per_paragraph")) if s == "rule" else all(num(v.get(x)) for x in ("mean_words", "word_sd", "mean_sentences")),
        "opening_structure": lambda v, s: bool(v) and all(num(x, 0, 1) for x in v.values()),
        "connectives": lambda v, s: num(v.get("maximum_per_sentence")) and "allowed" in v if s == "rule" else num(v.get("density_per_sentence")) and type(v.get("allowed")) is list and all(type(x) is str for x in v["allowed"]),
        "active_passive_by_section": lambda v, s: bool(v) and all(type(x) is dict and num(x.get("active_ratio"), 0, 1) and num(x.get("passive_ratio"), 0, 1) for x in v.values()),
        "hedging": lambda v, s: num(v.get("per_1000_words")) and num(v.get("maximum_layers_per_sentence")),
        "claim_position": lambda v, s: num(v.get("mean_normalized_position"), 0, 1) and num(v.get("observations")) and type(v.get("per_paragraph")) is list,
        "contribution_limitation_moves": lambda v, s: num(v.get("contribution_move_count")) and num(v.get("limitation_move_count")) and v.get("form_only") is True,
        "first_person": lambda v, s: num(v.get("per_1000_words")),
    }

    def valid(field, source, text):
        v = json.loads(text)
        if type(v) is not dict or source not in ("rule", "exemplar"):
            return False
        if source == "rule" and field not in ("sentence_length", "paragraph_length", "connectives"):
            return type(v.get("policy")) is str and v["policy"].strip() != ""
        return bool(checks[field](v, source))

    more = [("paragraph_length", "rule", '{"word_range": [40, 180], "sentences_per_paragraph": [2, 7]}'), ("paragraph_length", "exemplar", '{"mean_words": 1, "word_sd": 0, "mean_sentences": 1e2}'), ("hedging", "exemplar", '{"per_1000_words": 1, "maximum_layers_per_sentence": 2}'), ("first_person", "exemplar", '{"per_1000_words": 0.0}'), ("connectives", "rule", '{"maximum_per_sentence": 1}'), ("sentence_length", "rule", '{"mean_range_words": [1, 2, 3], "minimum_sd_words": 1}'), ("first_person", "exemplar", '{"per_1000_words": null}')]
    cases = FIELDS + more
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], "k int, field string, source string, text string").withColumn("v", F.parse_json("text"))
    got = [r["ok"] for r in rows.select("k", targets.valid_field("field", "source", "v").alias("ok")).orderBy("k").collect()]
    assert got == [valid(*x) for x in cases] and 8 < sum(got) < len(got)
    assert spark.range(1).select(targets.valid_field(F.lit("hedging"), F.lit("rule"), F.lit(None).cast("variant"))).first()[0] is False


def test_a_field_is_set_once(spark):
    from proselens.operators import records

    def put(text, force=False):
        rows = spark.createDataFrame([(text, "a$1")], "t string, v string")
        return rows.select(records.with_field(F.col("t"), "direction", F.col("v"), force)).first()[0]

    assert put("x: 1\nfingerprint: # f\n") == 'x: 1\ndirection: "a$1"\nfingerprint: # f\n'
    assert put("direction: null\r\nfingerprint:\r\n") == 'direction: "a$1"\r\nfingerprint:\r\n'
    assert put("direction: old\n", True) == 'direction: "a$1"\n'
    for bad in ("direction: old\nfingerprint:\n", "direction:\ndirection:\n", "x: 1\n", "fingerprint:\nfingerprint:\n"):
        with pytest.raises(Exception):
            put(bad)


def _runs(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_one_rule_runs_no_other(spark):
    plan = rules.report(one(spark, "It ran, improving things a lot."), only=[10])._jdf.queryExecution().optimizedPlan().toString()
    assert "thereby" in plan and "tapestry" not in plan


def test_rules_read_each_side_once(spark):
    rows = spark.createDataFrame([(1, 0, "It is pivotal.", "It is useful.")], "series long, stage int, before string, after string")
    plan = history.pass_counts(history.classified(rows))
    assert _runs(plan, "(?:thereby") == 2
    assert {tuple(r) for r in plan.collect()} == {(0, "P4", 1), (0, "P5", 1)}


def test_leading_words_hide_no_rule(spark):
    texts = ["It boasts a landscape, not only Game-changing.", "Intricate? MOREOVER it. However, it. Furthermore, it.", "secure and\nefficient", "Full homomorphic encryption serves as it", "x_efficient efficiently"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bare = F.concat(*[F.array_repeat(F.lit(n), F.size(own)) for n, own in [(n, tx.every("text", p)) for n, _, p in rules.PATTERNS if n != 10] + [(2, F.transform(rules.adjectives(F.col("text")), lambda x: x["match"])), (5, rules.connectives(F.col("text")))]])
    for r in docs.select(F.array_sort(bare).alias("a"), F.array_sort(F.transform(rules.hits("text"), lambda h: h["rule"])).alias("b")).collect():
        assert r.a == r.b


def test_sentences_are_computed_once_for_a_row_each(spark):
    docs = one(spark, "If it rains, we go. The map is here.\n\nWe show it here. 3. 5")
    assert _runs(fingerprint.openings(docs), "(?:is|are|was|were|be|been|being)") == 1
    assert {(r["opening"], r["n"], r["first"]) for r in fingerprint.openings(docs).collect()} == {("clause", 1, 1), ("noun_phrase_subject", 2, 1)}
    assert fingerprint.by_document(docs).first()["word_count"] == 15


def test_common_expressions_shuffle_texts_only(spark):
    rows = spark.createDataFrame([(1, 0, "Every careful reader writes notes."), (1, 1, "every Careful reader writes more"), (1, 1, "of all"), (2, 0, None), (3, 0, "one longer word here"), (3, 0, "and another longer one")], "series long, stage int, text string")
    got = history.common_expressions(rows)
    assert [tuple(r) for r in got.orderBy("series", "place").collect()] == [(1, 1, "every careful reader writes"), (3, 1, "and another longer one"), (3, 2, "one longer word here")]
    assert _runs(got, "Join") == 0 and _runs(got, "Aggregate [") == 1


def test_settled_scopes_are_not_compared(monkeypatch):
    old = [f"{a} {b} {c} river town" for a in ("red", "blue") for b in ("old", "new") for c in ("bridge", "mill")]
    seen = []
    similar = align._similar
    monkeypatch.setattr(align, "_similar", lambda *x: seen.append(similar(*x)) or seen[-1])
    assert align.aligned_scopes(old, old) == [(k, k, 1.0) for k in range(8)]
    assert seen == [{}]


def test_ladder_words_are_found_in_one_scan(spark):
    rows = pair(spark, "An honest-but-curious peer may go. No leakage of any exact result.", "A malicious peer shows it. Bounded leakage of an approximate result.")
    assert _runs(revision.occurrences(rows, revision.CRYPTO, "before", True), "LogicalRDD") + _runs(revision.occurrences(rows, revision.CRYPTO, "before", True), "LocalRelation") <= 2
    got = {(r["ladder"], r["original"], r["revised"], r["span"]) for r in revision.crypto_moves(rows).collect()}
    assert got == {("adversary_model", "honest-but-curious", "malicious", 1), ("leakage", "no leakage", "bounded leakage", -1), ("exactness", "exact", "approximate", -1)}
