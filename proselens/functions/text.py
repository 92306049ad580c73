"""Column functions over texts: words, sentences (three kinds), paragraphs,
sections, scopes, LaTeX removal, and match positions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: word definitions
WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)*|\d+(?:\.\d+)?"
LETTER_WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"
#: a run of letters, digits and underscores of any alphabet: what \b stands between
TOKEN = r"[\p{L}\p{N}_]+"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: lambdas inside would else compute
    it for every element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def unnest(df: DataFrame, keep: list[Column | str], array: Column | str, name: str, at: str = "_at") -> DataFrame:
    """keep, at (0-based) and name: a row for each element of an array.  The outer form
    is used and empty arrays go afterwards: before the inner one Spark puts a filter on
    the array's size, which computes the whole array a second time."""
    return df.select(*keep, F.posexplode_outer(array).alias(at, name)).where(F.col(at).isNotNull())


def every(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c(text), F.lit(quick(pattern)), F.lit(group))


def where_any(low: Column, cues: list[str], found: Column) -> Column:
    """found, an array of strings, where a text in lower case holds one of the cues; else
    empty, and not computed.  Plain substrings cost a small part of a pattern."""
    if not cues:
        return found
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in cues]), found).otherwise(F.array().cast("array<string>"))


def leading(form: str) -> str:
    """The letters and digits that a word or phrase begins with, in lower case."""
    return re.match("[a-z0-9]+", form.lower())[0]  # type: ignore[index]


def led_by(low: Column, forms: list[str]) -> Column:
    """Which of the forms a text (in lower case) can hold: the beginnings of forms that
    stand in it, each behind a blank.  One pass finds those of all forms, and as they end
    before any blank or hyphen, none hides another."""
    cues = sorted({leading(f) for f in forms}, key=lambda x: (-len(x), x))
    return F.concat(F.lit(" "), F.array_join(every(low, r"\b(?:" + "|".join(cues) + ")"), " "))


def may_hold(led: Column, forms: list[str]) -> Column:
    """Whether one of the forms can stand in a text of which `led_by` gave this."""
    return reduce(lambda a, b: a | b, [F.contains(led, F.lit(f" {x}")) for x in sorted({leading(f) for f in forms})])


def _firsts(body: str, at: int) -> tuple[set[str] | None, int]:
    """The letters that a group's alternatives begin with (None where one begins
    otherwise), and the place behind the group, which begins at `at`."""
    out: set[str] | None = set()
    at, begins, depth = at + 3, True, 0
    while at < len(body):
        x = body[at]
        if begins:
            begins = False
            if body.startswith("(?:", at):
                own, behind = _firsts(body, at)
                out = None if out is None or own is None or body[behind : behind + 1] in ("?", "*", "{") else out | own
                at = behind
                continue
            safe = re.match("[A-Za-z](?![?*{])", body[at:])
            out = out | {x.lower()} if safe and out is not None else None
        if x == "\\":
            at += 2
            continue
        if x == "[":
            at = body.index("]", at + 2)
        elif x == "(":
            depth += 1
        elif x == ")":
            if not depth:
                return out, at + 1
            depth -= 1
        elif x == "|" and not depth:
            begins = True
        at += 1
    return None, at


@cache
def quick(pattern: str) -> str:
    """The same pattern with a look at the first letter ahead of a word's alternatives,
    so that most words are passed over without trying each alternative."""
    m = re.match(r"((?:\(\?[iU]+\))?\\b)\(\?:", pattern)
    if not m:
        return pattern
    letters, behind = _firsts(pattern, m.end() - 3)
    if not letters or pattern[behind : behind + 1] in ("?", "*", "{"):
        return pattern
    both = "".join(sorted(letters | ({x.upper() for x in letters})))
    return f"{m[1]}(?=[{both}]){pattern[m.end() - 3 :]}"


def lf(text: Column | str) -> Column:
    """CRLF and CR to LF."""
    return F.regexp_replace(c(text), "\r\n?", "\n")


def canonical(text: Column | str) -> Column:
    """Line ends as LF, without one at the very end."""
    return F.regexp_replace(lf(text), r"\n\z", "")


def squeeze(text: Column | str) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


def words(text: Column | str) -> Column:
    return every(text, WORD)


def letter_words(text: Column | str) -> Column:
    return every(text, LETTER_WORD)


def tokens(text: Column | str) -> Column:
    return every(F.lower(c(text)), TOKEN)


def paragraphs(text: Column | str) -> Column:
    """Blocks between blank lines, squeezed, without empty ones."""
    return F.filter(F.transform(F.split(c(text), r"\n\s*\n"), squeeze), lambda p: p != "")


def pieces(paragraph: Column | str) -> Column:
    """What a paragraph is cut into behind a mark and before a capital, digit, back-tick
    or backslash."""
    return F.transform(F.split(c(paragraph), r"(?<=[.!?])\s+(?=[A-Z0-9`\\])"), squeeze)


def sentences(paragraph: Column | str) -> Column:
    """Pieces of more than one word."""
    return F.filter(pieces(paragraph), lambda s: F.size(words(s)) > 1)


def sentence_spans(text: Column | str) -> Column:
    """Runs up to a mark or line end, that are not blank."""
    return F.filter(every(text, r"[^.!?\n]+[.!?]?"), lambda s: s.rlike(r"\S"))


def scopes(prose: Column | str) -> Column:
    """Claim scopes: runs between marks, semicolons and line ends."""
    return F.filter(F.transform(F.split(c(prose), r"(?:[.!?;]+|\n+)\s*"), lambda x: F.trim(x)), lambda s: s != "")


def cut(text: Column, pattern: str) -> Column:
    """The whole text in pieces: what stands between matches at odd places (1-based),
    matches at even ones, each with its start (0-based code points), line and column
    (1-based).  Matches are set between two control characters (in the text itself
    these count as blanks); one pass carries the running place, so the cost is linear
    in the text however many matches there are."""
    marked = F.split(F.regexp_replace(F.regexp_replace(text, "[\u0001\u0002]", " "), pattern, "\u0001$0\u0002"), "[\u0001\u0002]", -1)
    origin = F.struct(F.lit(0).alias("start"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    none = F.array().cast("array<struct<match:string,start:int,line:int,column:int>>")

    def step(acc: Column, piece: Column) -> Column:
        here = F.struct(piece.alias("match"), acc["at"]["start"].alias("start"), acc["at"]["line"].alias("line"), acc["at"]["column"].alias("column"))
        return F.struct(after(acc["at"], piece).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(marked, F.struct(origin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def after(at: Column, piece: Column) -> Column:
    """The place (start, line, column) behind a piece that begins at `at`."""
    lines = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
    column = F.when(lines > 0, F.length(F.substring_index(piece, "\n", -1)) + 1).otherwise(at["column"] + F.length(piece))
    return F.struct((at["start"] + F.length(piece)).cast("int").alias("start"), (at["line"] + lines).cast("int").alias("line"), column.cast("int").alias("column"))


def places(text: Column | str, pattern: str) -> Column:
    """Matches of a text with their places; a text without one is not cut."""
    t, pattern = c(text), quick(pattern)
    none = F.array().cast("array<struct<match:string,start:int,line:int,column:int>>")
    return F.when(t.rlike(pattern), F.filter(cut(t, pattern), lambda x, i: i % 2 == 1)).otherwise(none)


def between(text: Column | str, pattern: str) -> Column:
    """What stands between matches, with its places."""
    return F.filter(cut(c(text), pattern), lambda x, i: i % 2 == 0)


def matches(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """A row per match: the columns of `keep`, ordinal (1-based), match, start
    (0-based code points)."""
    hit = F.transform(places(text, pattern), lambda x, i: F.struct((i + 1).alias("ordinal"), x["match"].alias("match"), x["start"].alias("start")))
    return unnest(df, keep, hit, "_hit").select(*keep, "_hit.*")


#: fixed values: headings of sections, and the types of titles in their order
HEADING = r"(?m)^#{1,6}\s+(.+?)\s*$|\\(?:section|subsection|subsubsection)\*?\{([^{}]+)\}"
SECTION_TYPES = [
    ("Threat Model", r"\b(?:threat|adversar(?:y|ial)|security) model\b"),
    ("Related Work", r"\b(?:related|prior) work\b"),
    ("Evaluation", r"\b(?:evaluation|experiment(?:s|al)?|benchmark(?:s|ing)?)\b"),
    ("Contributions", r"\bcontributions?\b"),
    ("Conclusion", r"\bconclusions?\b"),
    ("Introduction", r"\bintroduction\b"),
    ("Methods", r"\b(?:method(?:s|ology)?|approach|design|architecture|construction|protocol|implementation)\b"),
]


def section_type(title: Column | str) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(c(title)), "[^a-z0-9]+", " "))
    return reduce(lambda out, x: F.when(plain.rlike(x[1]), x[0]).otherwise(out), reversed(SECTION_TYPES), F.lit("Other"))


def sections(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row per section: keep, sec_no, title, body.  Text before the first
    heading is Preamble (left out if blank); a text without headings is one
    section named Document."""
    marked = F.split(F.regexp_replace(F.col(text), HEADING, "\u0001$1$2\u0002"), "\u0001")
    parts = unnest(df.withColumn("_parts", marked), [*keep, F.size("_parts").alias("_n")], "_parts", "_part", "sec_no")
    head = F.when(F.col("_n") == 1, "Document").when(F.col("sec_no") == 0, "Preamble").otherwise(squeeze(F.substring_index("_part", "\u0002", 1)))
    body = F.when(F.col("sec_no") == 0, F.col("_part")).otherwise(F.substring_index("_part", "\u0002", -1))
    out = parts.select(*keep, "sec_no", head.alias("title"), body.alias("body"))
    return out.where((F.col("title") != "Preamble") | (squeeze("body") != ""))


#: fixed values: LaTeX to drop before prose is measured, in order
SCAFFOLD = [
    (r"(?<!\\)%[^\n]*", ""),
    (r"\\(?:documentclass|usepackage|title|author|date)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}", " "),
    (r"\\(?:begin|end)\{document\}", " "),
    (r"(?s)\\begin\{(table\*?|tabular\*?|longtable|equation\*?|align\*?|gather\*?|multline\*?|displaymath|math)\}.*?\\end\{\1\}", " "),
    (r"(?s)\$\$.*?\$\$", " "),
    (r"(?s)\\\[.*?\\\]", " "),
    (r"(?s)\\\(.*?\\\)", " "),
    (r"(?s)(?<!\\)\$(?:\\.|[^$])*?(?<!\\)\$", " "),
    (r"\\(?:cite\w*|ref|autoref|eqref|cref|label)\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}", " "),
    (r"\\(?:section|subsection|subsubsection)\*?\{[^{}]*\}", "\n\n"),
    (r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?", " "),
    (r"[{}]", " "),
]


def without_latex(text: Column | str) -> Column:
    return reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), SCAFFOLD, lf(text))


#: fixed values: what goes before versions are compared, in order; what is inline stays
HISTORY_ENVIRONMENTS = "table table* tabular tabular* longtable equation equation* align align* gather gather* multline multline* displaymath".split()
HISTORY_SCAFFOLD = [
    (r"(?<!\\)%[^\n]*", ""),
    (r"\\(?:documentclass|usepackage|title|author|date)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}", " "),
    (r"\\(?:begin|end)\{document\}|\\maketitle\b", " "),
    *[(rf"(?s)\\begin\{{{e.replace('*', '[*]')}\}}.*?\\end\{{{e.replace('*', '[*]')}\}}", " ") for e in HISTORY_ENVIRONMENTS],
    (r"\\label\s*\{[^{}]*\}", " "),
]


def without_scaffold(text: Column | str, suffix: Column | str) -> Column:
    """A version's text for comparison; of other files than `.tex` all of it."""
    t = lf(text)
    return F.when(F.lower(c(suffix)) == ".tex", reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), HISTORY_SCAFFOLD, t)).otherwise(t)


def plain_word_count(text: Column | str) -> Column:
    """Letter words outside of comments and commands."""
    steps = [(r"(?<!\\)%[^\n]*", ""), (r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?", " "), (r"[{}$\\]", " ")]
    return F.size(letter_words(reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), steps, c(text))))


def title_of(text: Column | str, suffix: Column | str) -> Column:
    """The title by kind of file; null if none."""
    t, s = c(text), c(suffix)
    got = F.when(s == ".tex", F.regexp_extract(t, r"(?s)\\title\s*(?:\[[^\]]*\]\s*)*\{([^{}]+)\}", 1)).when(s == ".md", F.regexp_extract(t, r"(?m)^#\s+(.+?)\s*$", 1)).otherwise(F.regexp_extract(t, r"(?im)^\s*(?:paper\s+)?title\s*:\s*(.+?)\s*$", 1))
    return F.nullif(squeeze(got), F.lit(""))


def normal_title(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c(title), r"\\[A-Za-z@]+\*?", " ")), r"(?U)[\W_]+", " "))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
