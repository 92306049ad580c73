"""Alignment and lineage of paragraphs against plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from proselens.operators import align, history, lineage, rules

STAGES = "series long, stage int, text string"


def every_pair(old, new):
    """All pairs measured, the most similar first, later ones first at a tie."""
    cand = sorted(((SequenceMatcher(None, x, y, autojunk=False).ratio(), i, j) for i, x in enumerate(old) for j, y in enumerate(new)), reverse=True)
    out, a, b = [], set(), set()
    for s, i, j in cand:
        if s >= 0.2 and i not in a and j not in b:
            a.add(i), b.add(j)
            out.append((s, i, j))
    return out


def test_pairs_are_those_of_all_measured():
    rng = random.Random(5)
    words = "the map town bridge old mill peer case first stone river küste 12 .".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    for _ in range(150):
        old = [text() for _ in range(rng.randint(0, 6))]
        new = [rng.choice([text(), rng.choice(old or [""]), rng.choice(old or [""])[3:] + text()]) for _ in range(rng.randint(0, 6))]
        assert align.best_pairs(old, new) == every_pair(old, new)


def test_few_pairs_are_measured(monkeypatch):
    rng = random.Random(1)
    old = ["".join(rng.choice("abcdefghij ") for _ in range(300)) + str(k) * 40 for k in range(10)]
    new = [t.replace("a", "A", 1) for t in old]
    seen, real = [], align._ratio
    monkeypatch.setattr(align, "_ratio", lambda x, y: seen.append(1) or real(x, y))
    got = align.best_pairs(old, new)
    assert {(i, j) for _, i, j in got} == {(k, k) for k in range(10)} and len(seen) < 30


SERIES = {
    1: ["# Introduction\nThe map may hold. It is old.\n\nIt serves as a tool.\n\nThird one stays.", "# Introduction\nThe map holds. It is old.\n\nThird one stays.\n\nA new one comes.", "# Introduction\nA new one comes.\n\nThe map always holds. It is old now.", "# Introduction\nA new one comes.\n\nThe map always holds. It is old now."],
    2: ["no heading here\n\nsecond", None, "no heading here\n\nsecond"],
    3: ["preamble\n\n# Methods\nalone"],
}


@pytest.fixture(scope="module")
def stages(spark):
    return spark.createDataFrame([(s, k, t) for s, own in SERIES.items() for k, t in enumerate(own, 1)], STAGES)


def test_direction_of_small_series(stages):
    pars = lineage.paragraphs(stages)
    cut = {(r["series"], r["stage"]): [(p["section"], p["text"]) for p in r["pars"]] for r in pars.collect()}
    assert cut[1, 2] == [("Introduction", "The map holds. It is old."), ("Introduction", "Third one stays."), ("Introduction", "A new one comes.")]
    assert cut[2, 1] == [("Document", "no heading here"), ("Document", "second")] and cut[2, 2] == [] and cut[3, 1] == [("Methods", "alone")]
    links = lineage.aligned(pars).cache()
    got = Counter((r["series"], r["stage"], r["status"]) for r in links.collect())
    want = Counter()
    for (s, k), old in cut.items():
        if (s, k + 1) in cut:
            a, b = [t.casefold() for _, t in old], [t.casefold() for _, t in cut[s, k + 1]]
            for tag, i, i2, j, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                n = i2 - i if tag == "equal" else len(every_pair(a[i:i2], b[j:j2]))
                want.update({(s, k, "unchanged" if tag == "equal" else "modified"): n})
                if tag != "equal":
                    want.update({(s, k, "deleted"): i2 - i - n, (s, k, "inserted"): j2 - j - n})
    assert got == +want
    # the chain of each paragraph by walking back
    back = {(r["series"], r["next_stage"], r["after_no"]): (r["stage"], r["before_no"]) for r in links.collect() if r["before_no"] and r["after_no"]}
    for r in lineage.lines(pars, links).collect():
        at = (r["stage"], r["par_no"])
        while (r["series"], *at) in back:
            at = back[r["series"], *at]
        assert (r["root_stage"], r["root_no"]) == at
    assert lineage.lines(pars, links).count() == sum(len(x) for x in cut.values())


def test_changes_report_and_conflicts(spark, stages):
    pars = lineage.paragraphs(stages)
    links = lineage.aligned(pars).cache()
    changed = {(r["series"], r["stage"], r["before_no"], r["after_no"]): (r["status"], r["rule_ids"], r["passes"]) for r in lineage.changes(links).collect()}
    count = lambda t: Counter(h["rule"] for h in spark.createDataFrame([(t or "",)], "t string").select(rules.hits("t").alias("h")).first()["h"])
    words = lambda t: [w.lower() for w in __import__("re").findall(history.CLAIM_WORDS, t or "")]
    for r in links.where("status <> 'unchanged'").collect():
        b, a = count(r["before"]), count(r["after"])
        ids = sorted(k for k in set(b) | set(a) if b[k] != a[k])
        want = ["P1"] * (words(r["before"]) != words(r["after"])) + ["P2"] * (r["status"] in ("inserted", "deleted")) + ["P3"] * (3 in ids) + ["P4"] * (r["status"] == "modified") + ["P5"] * bool(ids)
        assert changed[r["series"], r["stage"], r["before_no"], r["after_no"]] == (r["status"], ids, want)
    rows = lineage.report(links, [(1, 2)], [(2, 3)])
    by = {(r["series"], r["stage"]): r for r in rows.collect()}
    assert by[1, 1]["driver"] == "reviewer-driven" and not by[1, 1]["included"] and by[1, 2]["driver"] == "author-advisor" and by[1, 3]["dominant"] == []
    assert by[2, 1]["deleted"] == 2 and by[2, 1]["dominant"] == ["P2"]
    totals = Counter()
    for (s, k, _, _), (_, ids, _) in changed.items():
        if (k, k + 1) != (1, 2):
            totals.update((s, i) for i in ids)
    assert {(r["series"], r["rule"]): r["n"] for r in lineage.author_rules(rows).collect()} == dict(totals)
    want = []
    for s in SERIES:
        last = None
        for k in sorted(k for t, k in by if t == s):
            if by[s, k]["dominant"]:
                first = by[s, k]["dominant"][0]
                if last and last[1] > first:
                    want.append((s, last[0], last[0] + 1, last[1], k, k + 1, first))
                last = (k, first)
    assert sorted(tuple(r) for r in lineage.conflicts(rows).collect()) == sorted(want)


def test_order_conflicts_skip_pairs_without_changes(spark):
    rows = spark.createDataFrame([(1, 1, 2, ["P4", "P5"]), (1, 2, 3, []), (1, 3, 4, ["P2"]), (1, 4, 5, ["P2"])], "series long, stage int, next_stage int, dominant array<string>")
    assert [tuple(r) for r in lineage.conflicts(rows).collect()] == [(1, 1, 2, "P4", 3, 4, "P2")]


def test_held_out_paragraphs_go(spark, stages):
    out = spark.createDataFrame([(1, 1, 2)], "series long, stage int, par_no int")
    got = {(r["series"], r["stage"]): [p["par_no"] for p in r["pars"]] for r in lineage.paragraphs(stages, out).collect()}
    assert got[1, 1] == [1, 3] and got[1, 2] == [1, 2, 3]
    with pytest.raises(Exception, match="beyond its stage"):
        lineage.paragraphs(stages, spark.createDataFrame([(1, 1, 9)], "series long, stage int, par_no int")).collect()


def test_exemplars_hold_kept_terms(spark):
    rows = spark.createDataFrame([(1, 1, 2, "modified", 1, 1, 0.9, "S", "FHE serves as a map. The latency is low.", "FHE is a map. The latency is low.", [11], ["P4"]), (1, 1, 2, "modified", 2, 2, 0.9, "S", "One two.", "One three.", [11], ["P4"])], "series long, stage int, next_stage int, status string, before_no int, after_no int, similarity double, section string, before string, after string, rule_ids array<int>, passes array<string>")
    assert [(r["before_no"], r["kept"]) for r in lineage.exemplars(rows).collect()] == [(1, ["FHE", "latency"])]
