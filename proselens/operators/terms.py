"""Findings of a glossary in revised texts, with places.

All forms of a glossary stand in one automaton (Aho-Corasick), so a text is read once
however many forms there are.  The glossary goes to the tasks in slices of a fixed
greatest size; findings of different terms do not depend on each other, so slices are
scanned one by one and put together.  Pairs of equal texts have no new findings and
are not read.

Places are code points of the text as given: LaTeX regions are masked by blanks that
keep offsets and lines (P15).

Defined results: a null text is empty; a form that occurs in a word, or touches an
ASCII letter or digit, is not a finding; matches of one form do not overlap, those of
different forms may; a place has one finding of a term, kind and spelling; an empty
table or glossary gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of glossary rows that are broadcast at once
SLICE = 4 << 20
#: fixed values: regions that are not prose, and commands that have arguments which are not
REGIONS = [
    re.compile(r"\\begin\s*\{\s*(?:equation|align|gather)\*?\s*\}.*?\\end\s*\{\s*(?:equation|align|gather)\*?\s*\}", re.S | re.I),
    re.compile(r"\\\[.*?\\\]", re.S),
    re.compile(r"(?<!\\)(\${1,2}).*?(?<!\\)\1", re.S),
]
POINTING = re.compile(r"ref$|label$|cite", re.I)
#: fixed values: marks before the first word of a sentence, with a blank between
OPENING = ".!?:"
SYNONYM, VARIANT, CASE, MIX = "forbidden_synonym", "plural_or_hyphen_variant", "case_inconsistency", "abbreviation_full_name_mix"

_COMMAND = re.compile(r"\\([A-Za-z]+)\*?")
_OPTION, _ARGUMENT = re.compile(r"\s*(\[[^\]]*\])"), re.compile(r"\s*(\{[^{}]*\})")
_INK = re.compile(r"[^\n]")
_ASCII = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: fixed values: letters that any case of an ASCII letter takes in
_KIN = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
_ANY_CASE = _ASCII | {chr(c) for c in _KIN}
FOUND = "pair_id long, term string, kind string, observed string, start int, line int, column int"
_FOUND = pa.schema([("pair_id", pa.int64()), *[(x, pa.string()) for x in ("term", "kind", "observed")], *[(x, pa.int32()) for x in ("start", "line", "column")]])


def masked(text: str) -> str:
    """The text with blanks for LaTeX regions, commands and the arguments of references;
    every region is sought in the text as given."""
    if "\\" not in text and "$" not in text:
        return text
    spans = [m.span() for p in REGIONS for m in p.finditer(text)]
    for m in _COMMAND.finditer(text):
        spans.append(m.span())
        at = m.end()
        if POINTING.search(m[1]):
            while option := _OPTION.match(text, at):
                spans.append(option.span(1))
                at = option.end()
            if argument := _ARGUMENT.match(text, at):
                spans.append(argument.span(1))
    out, done = [], 0
    for start, end in sorted(spans):
        if end > done:
            out += [text[done : max(done, start)], _INK.sub(" ", text[max(done, start) : end])]
            done = end
    return "".join([*out, text[done:]])


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = (text := text.translate(_KIN)).lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def opens(text: str, start: int) -> bool:
    """Whether a sentence begins there."""
    at = start
    while at and text[at - 1] in " \t":
        at -= 1
    return start == 0 or at > 0 and (text[at - 1] == "\n" or at < start and text[at - 1] in OPENING)


class Glossary:
    """Rows (term, abbreviation, synonyms, variants) and the automaton of their forms."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.rows = rows
        self.users: dict[str, list[int]] = defaultdict(list)  # the rows that a form belongs to
        self.shorts: dict[str, set[str]] = defaultdict(set)  # spellings of abbreviations, by their lower case
        for _, short, _, _ in rows:
            if short:
                self.shorts[lowered(short)].add(short)
        for k, (term, short, synonyms, variants) in enumerate(rows):
            for form in {lowered(x) for x in (term, short, *(synonyms or ()), *(variants or ())) if x}:
                self.users[form].append(k)
        self.automaton = ahocorasick.Automaton()
        for form in self.users:
            self.automaton.add_word(form, form)
        if self.users:
            self.automaton.make_automaton()

    def occurrences(self, text: str) -> dict[tuple[str, bool], list[int]]:
        """Where each form begins, in any case (False) and abbreviations as spelled
        (True), leftmost and apart."""
        out: dict[tuple[str, bool], list[int]] = {}

        def add(form: str, spelled: bool, start: int) -> None:
            own = out.setdefault((form, spelled), [])
            if not own or own[-1] + len(form) <= start:
                own.append(start)

        for last, form in self.automaton.iter(lowered(text)) if self.users else ():
            start = last + 1 - len(form)
            before, after = text[start - 1 : start] if start else "", text[last + 1 : last + 2]
            if before in _ASCII or after in _ASCII:
                continue
            if form in self.shorts and (seen := text[start : last + 1]) in self.shorts[form]:
                add(seen, True, start)
            if before not in _ANY_CASE and after not in _ANY_CASE:
                add(form, False, start)
        return out

    def findings(self, before: str, after: str, residual: bool) -> list[tuple[int, str, str, str]]:
        """(start, term, kind, observed) of AFTER: all (residual), or what is beyond the
        occurrences of BEFORE."""
        new = self.occurrences(after)
        if not new:
            return []
        old = self.occurrences(before)
        out = set()
        for k in sorted({k for form, _ in new for k in self.users[lowered(form)]}):
            term, short, synonyms, variants = self.rows[k]

            def spelled(at: dict, text: str, form: str) -> list[tuple[int, str]]:
                return [(s, text[s : s + len(form)]) for s in at.get((lowered(form), False), ())]

            for kind, forms in ((SYNONYM, synonyms), (VARIANT, variants)):
                for form in forms or ():
                    spare = 0 if residual else len(old.get((lowered(form), False), ()))
                    out |= {(s, term, kind, seen) for s, seen in spelled(new, after, form)[spare:]}
            capital = term[0].upper() + term[1:]

            def odd(at: dict, text: str) -> list[tuple[int, str]]:
                return [(s, seen) for s, seen in spelled(at, text, term) if seen != term and not (seen == capital and opens(text, s))]

            left = Counter() if residual else Counter(seen for _, seen in odd(old, before))
            for s, seen in odd(new, after):
                left[seen] -= 1
                if left[seen] < 0:
                    out.add((s, term, CASE, seen))
            if short:
                exact = lambda at: [(s, short) for s in at.get((short, True), ())]
                full, brief, full_before, brief_before = spelled(new, after, term), exact(new), spelled(old, before, term), exact(old)
                if brief and ((residual and full) or (full_before and not brief_before)):
                    out |= {(s, term, MIX, seen) for s, seen in brief}
                elif full and brief_before and not full_before:
                    out |= {(s, term, MIX, seen) for s, seen in full}
        return sorted(out)


def placed(text: str, found: list[tuple[int, str, str, str]]) -> Iterator[tuple]:
    """term, kind, observed, start, line, column of findings in order."""
    line, at = 1, 0
    for start, term, kind, seen in found:
        line, at = line + text.count("\n", at, start), start
        yield term, kind, seen, start, line, start - text.rfind("\n", 0, start)


def slices(entries: DataFrame) -> Iterator[list[tuple]]:
    """The rows of a glossary, in lists of at most about `SLICE` bytes."""
    held, size = [], 0
    for r in entries.select("term", "abbreviation", "synonyms", "variants").where("term <> ''").toLocalIterator():
        own = sum(len(x or "") for x in (r[0], r[1], *(r[2] or ()), *(r[3] or ()))) * 4 + 64
        if held and size + own > SLICE:
            yield held
            held, size = [], 0
        held.append(tuple(r))
        size += own
    if held:
        yield held


def findings(pairs: DataFrame, entries: DataFrame, residual: bool = False) -> DataFrame:
    """Forbidden forms, other case forms, and abbreviations mixed with full names.
    pairs: pair_id, before, after.  Differential: the occurrences of AFTER beyond the
    number in BEFORE.  Residual: all that AFTER holds.  Terms are distinct (`merged`)."""
    spark = pairs.sparkSession
    side = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    rows = pairs.select("pair_id", side("before"), side("after"))
    rows = rows if residual else rows.where("before <> after")
    out = spark.createDataFrame([], FOUND)
    for k, part in enumerate(slices(entries)):
        got = rows.mapInArrow(_scan(spark.sparkContext.broadcast(part), residual), FOUND)
        out = got if not k else out.unionByName(got)
    return out


def _scan(sent, residual: bool):  # type: ignore[no-untyped-def]
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        glossary = Glossary(sent.value)
        for batch in batches:
            out = []
            for pair, before, after in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                before, after = masked(before), masked(after)
                out += [(pair, *x) for x in placed(after, glossary.findings(before, after, residual))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_FOUND)], schema=_FOUND)

    return scan
