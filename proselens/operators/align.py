"""Alignment by sequence similarity: the one place where Python runs per pair."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heapify, heappop, heappush
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markers as mk

#: fixed values: least similarity of scopes and of paragraphs, margin of doubt
SCOPE, PARAGRAPH, MARGIN = 0.60, 0.20, 0.05
#: fixed values: words that do not tell scopes apart
STOP = frozenset("the is are was were be been being do does did have has had to of in on for from with by as at under during this that these those it its we our they their and or but".split())
#: fixed values: endings of plurals and what stands for them, in words of more than four letters
ENDINGS = [(re.compile("ies$"), "y"), (re.compile("(?<=[xz])es$|(?<=ch)es$|(?<=sh)es$|(?<=ss)es$"), ""), (re.compile("(?<![sui])s$"), "")]
_MARKER = [re.compile(r"\b(?:" + "|".join(classes.values()) + r")\b") for classes in mk.CLASSES.values()]
_ANY = re.compile("|".join(p.pattern for p in _MARKER))
_TOKEN = re.compile("[a-z0-9_]+")


def stem(word: str) -> str:
    """A word without the ending of its plural."""
    if len(word) > 4:
        for ending, other in ENDINGS:
            if ending.search(word):
                return ending.sub(other, word)
    return word


def scope_words(scope: str) -> tuple[list[str], bool]:
    """The words that scopes are compared by, without stop words and claim
    markers; and whether the scope has a marker."""
    if not _ANY.search(scope):
        return [stem(t) for t in _TOKEN.findall(scope) if t not in STOP], False
    marked = [m.span() for p in _MARKER for m in p.finditer(scope)]
    free = [t for t in _TOKEN.finditer(scope) if t[0] not in STOP and all(t.end() <= a or b <= t.start() for a, b in marked)]
    return [stem(t[0]) for t in free], bool(marked)


def scope_pairs(old: list[tuple[list[str], bool]], new: list[tuple[list[str], bool]]) -> list[tuple[int, int, float]]:
    """Aligned scopes, one to one, the most similar first, then the nearest, then the
    earliest.  A scope with a marker, whose two best partners are less than MARGIN
    apart, has none.

    Similarity is that of the words in order or in any order, whichever is more; as
    what is in order is also in any order, it is twice the words in common over all.
    Scopes with the same words are paired class by class; other classes are compared
    only if they share words enough.  A class without a marker, of which either side has
    equally many, is paired with itself whatever else is similar; so of two such classes
    the similarity is not needed, and nearly all are such in a revision."""
    at_old, at_new = _places(old), _places(new)
    scores = _similar(at_old, at_new, _open(old, at_old, at_new) | _open(new, at_new, at_old))
    out_old, out_new = _doubtful(old, at_old, at_new, scores, 0), _doubtful(new, at_new, at_old, scores, 1)
    free_old = {x: [i for i in own if i not in out_old] for x, own in at_old.items()}
    free_new = {x: [j for j in own if j not in out_new] for x, own in at_new.items()}
    out = [(i, j, 1.0) for x in at_old.keys() & at_new.keys() for i, j in nearest(free_old[x], free_new[x])]
    used_old, used_new = {i for i, _, _ in out}, {j for _, j, _ in out}
    rest = ((s, i, j) for (x, y), s in scores.items() for i in free_old[x] if i not in used_old for j in free_new[y] if j not in used_new)
    for s, i, j in sorted(rest, key=lambda c: (-c[0], abs(c[1] - c[2]), c[1], c[2])):
        if i not in used_old and j not in used_new:
            used_old.add(i), used_new.add(j)
            out.append((i, j, s))
    return sorted(out)


Class = tuple[str, ...]


def _places(scopes_: list[tuple[list[str], bool]]) -> dict[Class, list[int]]:
    """Places by the sorted words."""
    out: dict = defaultdict(list)
    for k, (words, _) in enumerate(scopes_):
        out[tuple(sorted(words))].append(k)
    return out


def _open(scopes_: list[tuple[list[str], bool]], own: dict, others: dict) -> set[Class]:
    """Classes that have a marker, or not equally many on the other side."""
    return {x for x, at in own.items() if len(at) != len(others.get(x, ())) or any(scopes_[k][1] for k in at)}


def _similar(old: dict, new: dict, open_: set[Class]) -> dict[tuple[Class, Class], float]:
    """Similarity of classes with different words, one of them in `open_`, where it is
    SCOPE or more.  In order of rarity, two classes that share so much share one of the
    first words of either."""
    every: dict[str, list[Class]] = defaultdict(list)
    some: dict[str, list[Class]] = defaultdict(list)
    for y in new:
        for w in set(y):
            every[w].append(y)
            if y in open_:
                some[w].append(y)
    out = {}
    for x in old:
        holders = every if x in open_ else some
        if not any(w in holders for w in x):
            continue
        count, seen = Counter(x), set()
        spare = ceil(SCOPE / (2 - SCOPE) * len(x) - 1e-9) - 1  # words of x that a partner may share without being one
        for w in sorted(count, key=lambda w: -len(holders.get(w, ()))):
            if spare >= count[w]:
                spare -= count[w]
                continue
            seen.update(holders.get(w, ()))
        for y in seen:
            both = (count & Counter(y)).total()
            if y != x and (s := 2.0 * both / (len(x) + len(y))) >= SCOPE:
                out[x, y] = s
    return out


def _doubtful(scopes_: list[tuple[list[str], bool]], own: dict, others: dict, scores: dict, side: int) -> set[int]:
    """Places of scopes with a marker whose two best partners are too close to call."""
    best: dict[Class, list[float]] = {x: [1.0] * min(2, len(others.get(x, ()))) for x in own}
    for pair, s in scores.items():
        x, y = pair[side], pair[1 - side]
        best[x] = sorted([*best[x], *[s] * min(2, len(others[y]))], reverse=True)[:2]
    close = {x for x, b in best.items() if len(b) > 1 and b[0] - b[1] < MARGIN}
    return {k for x in close for k in own[x] if scopes_[k][1]}


def nearest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Greedy one-to-one places of equal scopes: nearest first, then the earliest."""
    left, right, out, gap = dict.fromkeys(a), dict.fromkeys(b), [], 0
    while left and right:
        for i in list(left):
            for j in (i - gap, i + gap):
                if i in left and j in right:
                    del left[i], right[j]
                    out.append((i, j))
        gap += 1
    return out


def paragraph_pairs(old: list[str], new: list[str]) -> list[tuple[str, int, int, float]]:
    """Status, places and similarity of paragraphs, whatever their case: equal
    runs first; in a replaced block, pairs by similarity of their characters, at a tie
    the later ones first; the rest deleted or inserted."""
    a_low, b_low = [x.casefold() for x in old], [x.casefold() for x in new]
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, a_low, b_low, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [("unchanged", a + k, c + k, 1.0) for k in range(b - a)]
            continue
        left, right = dict.fromkeys(range(a, b)), dict.fromkeys(range(c, d))
        for s, i, j in best_pairs(a_low[a:b], b_low[c:d]):
            del left[a + i], right[c + j]
            out.append(("modified", a + i, c + j, round(s, 4)))
        out += [("deleted", i, -1, 0.0) for i in left] + [("inserted", -1, j, 0.0) for j in right]
    return sorted(out, key=lambda x: (x[1] if x[1] >= 0 else 10**9, x[2] if x[2] >= 0 else 10**9))


def best_pairs(old: list[str], new: list[str]) -> list[tuple[float, int, int]]:
    """One-to-one pairs of PARAGRAPH or more, the most similar first.

    Two texts cannot match in more characters than they have in common in any order.
    This bound is found for all pairs at once, from counts of characters, and pairs are
    taken up in its order: a pair is measured only when no pair that is still free can
    be more similar, and never if one of its texts has its partner by then.  So most
    pairs of a block whose texts have true partners are not measured at all."""
    if not old or not new:
        return []
    chars = {c: k for k, c in enumerate(sorted(set().union(*old, *new)))}

    def counts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), max(1, len(chars))), np.int32)
        for k, t in enumerate(texts):
            for c, n in Counter(t).items():
                out[k, chars[c]] = n
        return out

    rows, columns = counts(old), counts(new)
    size = np.array([len(t) for t in new])
    queue: list[tuple[float, bool, int, int]] = []  # -bound or -similarity, measured, -i, -j
    for i, row in enumerate(rows):
        total = len(old[i]) + size
        bound = np.where(total > 0, 2.0 * np.minimum(row, columns).sum(1) / np.maximum(total, 1), 1.0)
        queue += [(-float(bound[j]), False, -i, -int(j)) for j in np.flatnonzero(bound >= PARAGRAPH)]
    heapify(queue)
    used_old, used_new, out = set(), set(), []
    while queue:
        s, measured, i, j = heappop(queue)
        if -i in used_old or -j in used_new:
            continue
        if measured:
            used_old.add(-i), used_new.add(-j)
            out.append((-s, -i, -j))
        elif (own := _ratio(old[-i], new[-j])) >= PARAGRAPH:
            heappush(queue, (-own, True, i, j))
    return out


def _ratio(x: str, y: str) -> float:
    return 1.0 if x == y else SequenceMatcher(None, x, y, autojunk=False).ratio()


def aligned_scopes(old: list[str], new: list[str]) -> list[tuple[int, int, float]]:
    """J14 for two lists of scopes; what stands on both sides is read once."""
    words = {x: scope_words(x) for x in {*old, *new}}
    return scope_pairs([words[x] for x in old], [words[x] for x in new])


def changed_scopes(rows: DataFrame) -> DataFrame:
    """rows: pair_id, old and new (arrays of scopes).  pair_id, scope, side, text: the
    scopes that are not aligned with an equal one.  scope: the place on the new side, or
    for an old scope without partner -1 minus its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, a, b in zip(p["pair_id"], p["old"], p["new"]):
                to = {i: j for i, j, _ in aligned_scopes(list(a), list(b))}
                same = {j for i, j in to.items() if a[i] == b[j]}
                out += [(k, to.get(i, -1 - i), "old", x) for i, x in enumerate(a) if to.get(i) not in same]
                out += [(k, j, "new", x) for j, x in enumerate(b) if j not in same]
            yield pd.DataFrame(out, columns=["pair_id", "scope", "side", "text"])

    return rows.select("pair_id", "old", "new").mapInPandas(run, "pair_id long, scope int, side string, text string")


def scopes(rows: DataFrame) -> DataFrame:
    """rows: pair_id, old and new (arrays of scopes).  J14: aligned places."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(k, i, j, s) for k, a, b in zip(p["pair_id"], p["old"], p["new"]) for i, j, s in aligned_scopes(list(a), list(b))]
            yield pd.DataFrame(out, columns=["pair_id", "old_at", "new_at", "similarity"])

    return rows.select("pair_id", "old", "new").mapInPandas(run, "pair_id long, old_at int, new_at int, similarity double")


def paragraphs(rows: DataFrame) -> DataFrame:
    """rows: pair_id, old and new (arrays of paragraphs).  J17: opcodes and matches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(k, *x) for k, a, b in zip(p["pair_id"], p["old"], p["new"]) for x in paragraph_pairs(list(a), list(b))]
            yield pd.DataFrame(out, columns=["pair_id", "status", "old_at", "new_at", "similarity"])

    return rows.select("pair_id", "old", "new").mapInPandas(run, "pair_id long, status string, old_at int, new_at int, similarity double")


def paragraph_counts(aligned: DataFrame) -> DataFrame:
    """How many paragraphs of each pair have each status, and the least, mean and
    greatest similarity, which only describe."""
    n = lambda x: F.count_if(F.col("status") == x).alias(x)
    rows = aligned.groupBy("pair_id").agg(*[n(x) for x in ("unchanged", "modified", "deleted", "inserted")], F.min("similarity").alias("least"), F.round(F.avg("similarity"), 4).alias("mean"), F.max("similarity").alias("greatest"))
    return rows
