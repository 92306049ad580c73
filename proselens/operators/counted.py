"""What the evaluation of a target counts, in plain Python: the rules' findings, the sums
behind the metrics, and what a revision must keep.

Versions of a text share most paragraphs, so a batch counts each different one once.  The
patterns are those of the expressions; letters of Latin-1 and common punctuation are
alike in both engines' classes, and a text with any other character gets no counts here
(the expressions count it)."""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprint, rules
from . import markers as mk
from ..functions import text as tx

#: fixed values: white space and word characters without the flag (?U)
SPACE, WORD = r" \t\n\x0b\f\r", "A-Za-z0-9_"
#: characters that the engines may class differently
STRANGE = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ—–‘’“”…×÷«»·°§¡¿]")
_PLAIN = bytes(x for x in range(256) if not STRANGE.match(chr(x)))
#: the counts of a text, by place: sums for the metrics, then findings of each rule
SUMS = fingerprint.SUMS
RULES = sorted(rules.SEVERITY)
WIDTH = len(SUMS) + len(RULES)


def ported(pattern: str, lowered: bool = False) -> re.Pattern:
    """A pattern of the expressions for this engine.  Its \\b stands beside letters of
    any alphabet, as in Java 17; \\w, \\d and \\s are ASCII without (?U), with it \\w is a
    letter of any.  lowered: it is run on lower-case text."""
    m = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    flags, body = (m[1], pattern[m.end() :]) if m else ("", pattern)
    word = r"\w" if "U" in flags else WORD
    out, inside, at = "", False, 0
    while at < len(body):
        x = body[at : at + 2] if body[at] == "\\" else body[at]
        own = {r"\w": word, r"\d": "0-9", r"\s": SPACE}.get(x)
        if body.startswith(r"\p{L}\p{N}_", at):  # only inside of classes
            x, own = r"\p{L}\p{N}_", r"\w"
        if own is not None:
            out += own if inside else f"[{own}]"
        else:
            out += x
            inside = (inside or x == "[") and x != "]"
        at += len(x)
    return re.compile(out, (re.I if "i" in flags and not lowered else 0) | (re.S if "s" in flags else 0))


_PATTERN = {n: p for n, _, p in rules.PATTERNS}
_RULE = {n: ported(p) for n, p in _PATTERN.items()} | {10: ported(_PATTERN[10], lowered=True)}
_CUE = {n: rules.LEADS.get(n) or rules.CUES[n] for n in _RULE if n != 13}
_SERIES = re.compile(rf",[{SPACE}]+and[{SPACE}]")  # each match of rule 13 holds one
_EVIDENCE, _MECHANISM, _METRIC, _ADJECTIVE = (ported(p) for p in (rules.EVIDENCE, rules.MECHANISM, rules.METRIC, rules.ADJECTIVE))
_CONNECTIVE, _NOMINAL, _SUPPORT = ported(rules.CONNECTIVE), ported(rules.NOMINAL, lowered=True), ported(rules.SUPPORT)
_ENDS = [re.compile(rf"{x}(?!\w)") for x in ("ion", "ment", "nce", "ity")]  # each match of rule 7 ends with one
_MARK = re.compile(r"[.!?\n]")
_HEDGE = [re.compile(rf"\b{h}\b") for h in rules.HEDGES]
_SPAN, _PARAGRAPH = ported(rules.SENTENCE), ported(rules.PARAGRAPH)
#: a paragraph's end that no match goes over: there is a mark before it
#: (here and below, first letters stand before what is looked behind, so that a search
#: passes over others at once)
_CUT = re.compile(rf"\n(?<=[.!?]\n)[{SPACE}]*\n")
#: of squeezed paragraphs
_PIECE = re.compile(r" (?<=[.!?] )(?=[A-Z0-9`\\])")
_WORD, _LETTERS = re.compile(tx.WORD), re.compile(tx.LETTER_WORD)
_PASSIVE = re.compile(r"(?:i(?<!\wi)s|a(?<!\wa)re|w(?<!\ww)(?:as|ere)|b(?<!\wb)e(?:en|ing)?) +(?:\w+ly +)?\w+(?:ed|en)\b")
_PERSON = re.compile(r"w(?<!\ww)e\b|o(?<!\wo)urs?\b")
_KNOWN, _HEDGES = frozenset(fingerprint.CONNECTIVES), re.compile(rf"\b(?:{'|'.join(fingerprint.HEDGES)})\b")
_NUMBER = re.compile(r"[0-9](?<![\w.][0-9])[0-9]*" + ported(mk.NUMBER).pattern.removeprefix(r"(?<![\w.])[0-9]+"))
_REFERENCE, _MATH_ENV, _FIGURE_ENV = ported(mk.REFERENCE), ported(mk.MATH_ENV), ported(mk.FIGURE_ENV)
_MATH = [ported(p) for p in mk.MATH]
_LABEL = ported(r"\\label\s*\{([^{}]+)\}")
_SPACES = re.compile(f"[{SPACE}]+")
#: for bytes of Latin-1 what a word is made of: letters, digits, joints, points
_CLASS = bytes(97 if chr(x).isascii() and chr(x).isalpha() else 48 if 48 <= x < 58 else 45 if x in b"-'" else 46 if x == 46 else 32 for x in range(256))


#: from how many bounds on words are counted by arrays
MANY = 8


def squeezed(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def word_count(text: str) -> int:
    """How many words there are, as the beginnings of runs less the joints between them;
    where joints stand close, as they are found."""
    x = text.encode("latin-1", "replace").translate(_CLASS)
    if b"-a-" in x or b"0.0" in x:
        return len(_WORD.findall(text))
    n = x.count(b" a") + x.count(b"-a") + x.count(b"0a") + x.count(b".a") - x.count(b"a-a") + x.startswith((b"a", b"0"))
    return n + x.count(b" 0") + x.count(b"-0") + x.count(b"a0") + x.count(b".0") if b"0" in x else n


def words_between(text: str, bounds: list[int]) -> list[int]:
    """word_count of what stands between bounds, at which no word goes on."""
    x = text.encode("latin-1", "replace").translate(_CLASS)
    if len(bounds) < MANY or b"0.0" in x:
        return [word_count(text[a:b]) for a, b in zip(bounds, bounds[1:])]
    at = np.frombuffer(x, np.uint8)
    letter, digit, joint = at == 97, at == 48, at == 45
    begins = letter | digit
    begins[1:] &= ~((letter[1:] & letter[:-1]) | (digit[1:] & digit[:-1]))
    begins[2:] &= ~(letter[2:] & joint[1:-1] & letter[:-2])
    return np.diff(np.searchsorted(np.flatnonzero(begins), bounds)).tolist()


def strange(text: str) -> bool:
    try:
        return bool(text.encode("latin-1").translate(None, _PLAIN))
    except UnicodeEncodeError:
        return STRANGE.search(text) is not None


def nominals(low: str) -> int:
    """Rule 7: only sentences with three endings or more are read for whole words."""
    ends = [m.start() for x in _ENDS for m in x.finditer(low)]
    if len(ends) < 3:
        return 0
    marks = [-1, *(m.start() for m in _MARK.finditer(low)), len(low)]
    spans = Counter(bisect(marks, x) for x in ends)
    return sum(n > 2 and len(_NOMINAL.findall(low[marks[k - 1] + 1 : marks[k]])) > 2 for k, n in spans.items())


def adjectives(text: str) -> int:
    """Rule 2, of a whole text, as sentences beside count."""
    spans = [s for s in _SPAN.findall(_ADJECTIVE.sub("\x01\\g<0>", text)) if s.strip()]
    near = lambda i: " ".join(spans[max(i - 1, 0) : i + 2]).replace("\x01", "")
    return sum(s.count("\x01") for i, s in enumerate(spans) if "\x01" in s and not _METRIC.search(near(i)))


def _measured(paragraph: str, out: list) -> None:
    """Adds a squeezed paragraph to the sums."""
    low = paragraph.lower()
    cuts = [m.start() for m in _PIECE.finditer(paragraph)]
    bounds = [0, *cuts, len(low)]
    words = words_between(low, bounds)
    lengths = [x for x in words if x > 1]
    passive = sum(words[k] > 1 for k in {bisect(cuts, m.start()) for m in _PASSIVE.finditer(low)})
    hedges, links = 0, 0
    linked, hedged = any(x in low for x in fingerprint.CONNECTIVES), any(x in low for x in fingerprint.HEDGES)
    if linked or hedged:
        sentences = [low[a:b] for a, b, x in zip(bounds, bounds[1:], words) if x > 1]
        hedges = sum(len(_HEDGES.findall(x)) for x in sentences) if hedged else 0
        links = sum(len(_KNOWN.intersection(_WORD.findall(x))) for x in sentences) if linked else 0
    total, n = sum(words), len(lengths)
    gaps = sum(abs(b - a) for a, b in zip(lengths, lengths[1:])) / (n - 1) if n > 1 else 0.0
    for k, v in enumerate((1, total, total * total, n, sum(lengths), sum(x * x for x in lengths), passive, hedges, links, len(_PERSON.findall(low)), gaps, n > 1)):
        out[k] += v


def block(text: str) -> tuple[list, bool] | None:
    """The counts of a run of paragraphs, rules 2 and 14 left out, and whether it may hold
    an adjective of rule 2; null with a strange character."""
    if strange(text):
        return None
    out: list = [0] * WIDTH
    low = text.lower()
    at = len(SUMS) - 1  # rules count from 1
    for n, cues in _CUE.items():
        if any(x in low for x in cues):
            if n == 10:
                out[at + n] = sum(not _EVIDENCE.search(m) and not _MECHANISM.search(m) for m in _RULE[n].findall(low))
            else:
                out[at + n] = sum(1 for _ in _RULE[n].finditer(text))
    if _SERIES.search(text):
        out[at + 13] = sum(1 for _ in _RULE[13].finditer(text))
    out[at + 7] = nominals(low)
    paragraphs = _PARAGRAPH.split(text)
    if sum(low.count(x) for x in rules.LEADS[5]) > 2:
        out[at + 5] = sum(len(_CONNECTIVE.findall(p)) > 2 for p in paragraphs)
    if any(x in low for x in rules.CUES[9]):
        for p in paragraphs:
            n = sum(len(h.findall(p.lower())) for h in _HEDGE)
            out[at + 9] += n > 3 or (n > 0 and not _SUPPORT.search(p))
    for p in paragraphs:
        p = " ".join(p.split())  # of these characters it parts at SPACE only
        if p:
            _measured(p, out)
    return out, any(x in low for x in rules.LEADS[2])


def counts(text: str, known: dict) -> list | None:
    """SUMS and findings of each rule; null with a strange character.  known: what
    blocks were counted, which this adds to."""
    out: list = [0] * WIDTH
    loose = False
    for part in _CUT.split(text):
        if part not in known:
            known[part] = block(part)
        own = known[part]
        if own is None:
            return None
        out = [a + b for a, b in zip(out, own[0])]
        loose |= own[1]
    if loose:
        out[len(SUMS) - 1 + 2] = adjectives(text)
    n = text.count("—")
    out[len(SUMS) - 1 + 14] = int(n * 1000 > max(len(_LETTERS.findall(text)), 1) * rules.DASH_LIMIT) if n else 0
    return out


def numbers(text: str) -> Counter:
    return Counter(squeezed(m) for m in _NUMBER.findall(text))


def latex(text: str) -> Counter:
    """References, mathematics and figures of the guard, for any alphabet."""
    out: Counter = Counter()
    if "\\" in text:
        for m in _REFERENCE.finditer(text):
            out.update(("references", f"{m[1]}:{k.strip(' ')}") for k in m[2].split(",") if k.strip(" "))
        for m in _FIGURE_ENV.finditer(text):
            out.update(("figures", f"{m[1]}:label:{x.strip(' ')}") for x in _LABEL.findall(m[2]))
            out.update(("figures", f"{m[1]}:caption:{x}") for x in mk.arguments(m[2], "caption"))
    if "\\" in text or "$" in text:
        out.update(("math", f"{m[1]}:{squeezed(m[2])}") for m in _MATH_ENV.finditer(text))
        rest = _MATH_ENV.sub(" ", text)
        out.update(("math", squeezed(x)) for p in _MATH for x in p.findall(rest))
    return out


def case(before: str, output: str, target: str, known: dict) -> list:
    """Whether output and target keep what the guard holds (0 or 1), then the counts of
    the three texts; with a strange character no counts, and numbers are not looked at."""
    sides = (before, output, target)
    each: dict = {}
    for x in sides:
        if x not in each:
            each[x] = counts(x, known)
    plain = all(v is not None for v in each.values())
    held = {x: (latex(x), numbers(x) if plain else None) for x in each} if len(each) > 1 else {}
    kept = [float(x == before or held[x] == held[before]) for x in (output, target)]
    return kept + ([float(v) for x in sides for v in each[x]] if plain else [])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def cases(before: pd.Series, output: pd.Series, target: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([case(*x, known) for x in zip(before, output, target)])
