"""Corpus metadata and repository checks: links, entries, coverage, graphs, manifests."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import records

#: an anchor with its target between quotes of either kind or none, and its text
LINK = r"""(?is)<a\b(?=[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))[^>]*>(.*?)</a\s*>"""
#: fixed values: character references that have a name
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "amp": "&"}
#: rows of a group that a per-group limit keeps
PER_GROUP = 3
#: nodes up to which a round broadcasts them and keeps them in few files, and rounds
#: between merges of more
FEW, FILES, MERGE = 100_000, 8, 16


def unescaped(text: Column) -> Column:
    """Character references to characters: decimal, hexadecimal, and the common names;
    `&amp;` last, so that nothing is read twice."""

    def number(pattern: str, base: int) -> Column:
        pieces = F.split(text_, pattern, -1)
        codes = F.concat(F.regexp_extract_all(text_, F.lit(pattern), F.lit(1)), F.array(F.lit("")))
        char = lambda c: F.when(c == "", "").otherwise(F.decode(F.unhex(F.lpad(F.conv(c, base, 16), 8, "0")), "UTF-32"))
        return F.array_join(F.zip_with(pieces, F.transform(codes, char), lambda x, y: F.concat(x, y)), "")

    text_ = text
    for pattern, base in ((r"&#([0-9]{1,7});", 10), (r"&#[xX]([0-9A-Fa-f]{1,6});", 16)):
        text_ = F.when(text_.rlike(pattern), number(pattern, base)).otherwise(text_)
    return reduce(lambda t, x: F.replace(t, F.lit(f"&{x[0]};"), F.lit(x[1])), NAMED.items(), text_)


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.least(F.lit(1), F.size(done))))
    kept = F.aggregate(parts, F.slice(parts, 1, 0), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, ref: Column) -> Column:
    """A reference against the address of its page, as RFC 3986 joins them."""
    of = lambda pattern, g=1: F.regexp_extract(base, pattern, g)
    scheme, root = of("^([A-Za-z][A-Za-z0-9+.-]*:)"), of(r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)")
    path, query = of(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"), of(r"^[^?#]*(\?[^#]*)")
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    own = F.regexp_extract(ref, r"^([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(own != "", F.concat(root, without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), tail))
        .when(ref == "", base)
        .when(tail.startswith("?"), F.concat(root, path, tail))
        .otherwise(F.concat(root, path, query, tail))
    )


def link_array(url: Column | str = "url", html: Column | str = "html") -> Column:
    """SRC16: the links of a page in order: an array of (text, href), href absolute."""
    part = lambda g: tx.every(html, LINK, g)
    href = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), [part(1), part(2), part(3)])
    text = lambda x: tx.squeeze(unescaped(F.regexp_replace(x["text"], "<[^>]*>", " ")))
    return F.transform(F.arrays_zip(href.alias("href"), part(4).alias("text")), lambda x: F.struct(text(x).alias("text"), resolved(tx.c(url), F.trim(unescaped(x["href"]))).alias("href")))


def links(pages: DataFrame) -> DataFrame:
    """SRC16: anchor text and absolute target of each link, in order."""
    rows = pages.select("page_id", F.posexplode(link_array()).alias("place", "a"))
    return rows.select("page_id", "place", F.col("a.text").alias("text"), F.col("a.href").alias("target"))


def with_keyword(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose column holds one of the words, any case."""
    return rows.where(reduce(lambda a, w: a | F.contains(F.lower(column), F.lit(w.lower())), words, F.lit(False)))


def per_group(rows: DataFrame, group: list[str], order: list[str], n: int = PER_GROUP) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def coverage(rows: DataFrame, group: str, status: str) -> DataFrame:
    """How many rows of each group have each status."""
    return rows.groupBy(group, status).agg(F.count("*").alias("n"))


#: fixed values: parts of venue names that tell the kind of an entry
ARTICLE = "journal|transactions|access"
PROCEEDINGS = "crypto|eurocrypt|asiacrypt|ccs|ndss|usenix|ieee s&p|sac|ct-rsa|wacv|wahc"
#: characters of a title that a key keeps
KEY_LENGTH = 60


def entry_type(venue: Column | str) -> Column:
    """The kind of a bibliography entry by its venue; of a null venue, misc."""
    v = F.lower(tx.c(venue))
    return F.when(v.rlike(ARTICLE), "article").when(v.rlike(PROCEEDINGS), "inproceedings").otherwise("misc")


def escaped(text: Column | str) -> Column:
    """Back-slashes, braces and ampersands for BibTeX; the braces of an escaped
    back-slash are escaped in turn."""
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), [("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("&", "\\&")], tx.c(text))


def notes(text: Column | str) -> Column:
    """k=v pairs between semicolons, both trimmed, split at the first =; what has
    none is no pair, and of equal keys the last holds."""
    parts = F.filter(F.split(tx.c(text), ";"), lambda x: F.contains(x, F.lit("=")))
    key = lambda x: F.trim(F.regexp_extract(x, "^([^=]*)=", 1))
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda y: key(y) == key(x)))
    return F.map_from_arrays(F.transform(last, key), F.transform(last, lambda x: F.trim(F.regexp_extract(x, "(?s)=(.*)$", 1))))


def bibliography(rows: DataFrame, prefix: str = "source", origin: str = "Distilled source", index: str = "sourceIndex") -> DataFrame:
    """SNK4, W9: one BibTeX entry a row, numbered by year and title.  rows: title,
    venue, year, notes, direction, secondary, all text.  Nulls are empty, and an empty
    field is left out; only counts of years and beginnings of titles meet in a task."""
    names = ["title", "venue", "year", "notes", "direction", "secondary"]
    rows = rows.select(*[F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))).alias(n) for n in names])
    rows = records.numbered(rows, "year", F.lower("title"), 9).withColumn("kind", entry_type("venue")).withColumn("note", notes("notes"))
    own = lambda k: F.coalesce(F.element_at("note", F.lit(k)), F.lit(""))
    other = F.when(own("eprint") != "", own("eprint")).otherwise(own("also_eprint"))
    short = F.substring(F.trim(F.regexp_replace("title", "[^A-Za-z0-9]+", "-"), F.lit("-")), 1, KEY_LENGTH)
    key = F.concat_ws("-", F.lit(prefix), "year", F.when(short == "", "paper").otherwise(F.lower(short)))
    said = lambda name: F.when(F.col(name) != "", F.concat(F.lit(f"; {'primary direction' if name == 'direction' else 'secondary directions'}: "), name)).otherwise("")
    fields = [
        ("title", F.col("title")),
        ("year", F.col("year")),
        *[(name, F.when(F.col("kind") == kind, F.col("venue"))) for kind, name in (("article", "journal"), ("inproceedings", "booktitle"), ("misc", "howpublished"))],
        ("doi", own("doi")),
        ("eprint", F.when(own("arxiv") != "", own("arxiv")).otherwise(other)),
        ("archivePrefix", F.when(own("arxiv") != "", "arXiv").when(other != "", "IACR Cryptology ePrint Archive")),
        ("note", F.concat(F.lit(origin), said("direction"), said("secondary"))),
    ]
    lines = [F.when(v != "", F.concat(F.lit(f"  {name} = {{"), escaped(v), F.lit("},"))) for name, v in fields]
    place = F.when(F.col("place") > 999, F.col("place").cast("string")).otherwise(F.lpad(F.col("place").cast("string"), 3, "0"))
    body = F.concat_ws("\n", F.concat(F.lit("@"), "kind", F.lit("{"), key, F.lit(",")), *lines, F.concat(F.lit(f"  {index} = {{"), place, F.lit("}")), F.lit("}"))
    return rows.select("place", "kind", body.alias("entry"))


#: fixed value: what counts as an identifier when it is held against a private list
IDENTIFIER = r"[A-Za-z0-9][A-Za-z0-9_.-]*"


def hashed_hits(docs: DataFrame, digests: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifiers whose hash is in a private list, by line, and how often.  The
    list goes to all tasks only if Spark finds it small."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(tx.every(F.lower("line"), IDENTIFIER.replace("A-Z", ""))).alias("token"))
    rows = rows.withColumn("digest", F.sha2("token", 256)).join(digests.distinct(), "digest", "left_semi")
    return rows.groupBy(key, "line_no", "digest").agg(F.count("*").alias("n"))


#: rows of one group whose digests stand in one cell (about 100 bytes each)
CELL = 1_000_000


def bounded(rows: DataFrame, group: list[str], most: int, what: str) -> None:
    """Raise if a group has more rows than one cell takes."""
    if rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).count():
        raise ValueError(f"more than {most} {what}")


def manifest(rows: DataFrame, group: list[str], path: str, body: str) -> DataFrame:
    """A digest over paths and contents, in path order.  A group is the files of
    one project; more than `CELL` of them raise an error."""
    bounded(rows, group, CELL, "files of one group")
    line = F.struct(F.col(path).alias("p"), F.sha2(F.col(body), 256).alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["p"].cast("string"), F.lit(":"), x["h"])), "\n")
    return rows.groupBy(*group).agg(F.count("*").alias("files"), F.sha2(text, 256).alias("digest"))


def manifest_diff(a: DataFrame, b: DataFrame, path: str, body: str) -> DataFrame:
    """Paths of one side only, and paths whose contents differ."""
    x = a.select(path, F.sha2(F.col(body), 256).alias("ha"))
    y = b.select(path, F.sha2(F.col(body), 256).alias("hb"))
    status = F.when(F.col("hb").isNull(), "source_only").when(F.col("ha").isNull(), "installed_only").when(F.col("ha") != F.col("hb"), "changed").otherwise("same")
    return x.join(y, path, "full_outer").select(path, status.alias("status"))


def anchors(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many lines hold each anchor; it is wired if exactly one does."""
    hit = lines.join(F.broadcast(wanted), F.contains("line", "anchor"))
    got = hit.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.sha2("line", 256)).alias("digest"))
    return wanted.join(got, "anchor", "left").select("anchor", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) == 1).alias("wired"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with their least distance from a root and their parent, the least of
    the nodes one nearer that lead to them (null for a root), breadth first, until a
    round finds no new node.  Each round joins the newest nodes only; what it finds is
    cut from its plan, and so is all found, while it is small or every `MERGE` rounds."""
    edges = _cut(edges.select("src", "dst").repartition("src"))
    kind = edges.schema["dst"].dataType
    newest = _cut(roots.select("node").distinct().withColumns({"depth": F.lit(0), "parent": F.lit(None).cast(kind)}))
    seen, total, depth = newest, 0, 0
    while n := newest.count():
        if depth:
            seen = seen.unionByName(newest)
        depth, total = depth + 1, total + n
        if total <= FEW:
            seen = _cut(seen.coalesce(FILES))
        elif depth % MERGE == 0:
            seen = _cut(seen.repartition("node"))
        new = F.broadcast(newest) if n <= FEW else newest
        known = F.broadcast(seen) if total <= FEW else seen
        step = edges.join(new, edges["src"] == new["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        newest = _cut(step.join(known, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
    return seen


def root_paths(tree: DataFrame) -> DataFrame:
    """node, depth, path (from the root to the node) of a tree (node, depth, parent).
    Each round joins a piece of a path to the piece above it, which doubles it, so there
    are as many rounds as the depth has binary digits."""
    rows = tree.select("node", "depth", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.array("parent", "node")).alias("path"))
    most = tree.agg(F.max("depth")).first()[0] or 0
    for _ in range((most - 1).bit_length() if most > 1 else 0):
        above = rows.select(F.col("node").alias("_node"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        whole = F.when(F.col("top") == F.col("node"), F.col("path")).otherwise(F.concat("_path", F.slice("path", F.lit(2), F.size("path"))))
        rows = _cut(rows.join(above, F.col("top") == F.col("_node")).select("node", "depth", F.col("_top").alias("top"), whole.alias("path")))
    return rows.select("node", "depth", "path")


def _cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder all executors see; where none is set, one machine
    uses a folder of its own, and a cluster raises an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not local:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stages-"))
    return df.checkpoint()


#: fixed values: quantities, and words of reviews, that a dossier should not show
QUANTITY = r"\b\d+(?:\.\d+)?\s*(?:%|[xX]|ms|s|GB|MB|KB|bits?)\b"
REVIEW = r"(?i)\b(?:reviewer\s*#?\d*|weakness|rebuttal|R[1-9])\b"


def sensitivity(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whether a text is unpublished or a fingerprint, how many quantities and
    words of reviews it has, and whether there is any of these.  Columns `suffix` and
    `path` count where there are any; a null text is empty."""
    t = F.coalesce(tx.c(text), F.lit(""))
    own = F.contains(F.lower(t), F.lit("unpublished"))
    if "suffix" in docs.columns:
        own = own | F.coalesce(F.lower("suffix") == ".tex", F.lit(False))
    if "path" in docs.columns:
        own = own | F.coalesce(F.contains(F.lower("path"), F.lit("fingerprint.json")), F.lit(False))
    rows = docs.select(key, own.alias("unpublished"), F.regexp_count(t, F.lit(QUANTITY)).cast("long").alias("quantities"), F.regexp_count(t, F.lit(REVIEW)).cast("long").alias("reviews"))
    return rows.withColumn("flagged", F.col("unpublished") | (F.col("quantities") > 0) | (F.col("reviews") > 0))


#: fixed values: result-like numbers, identifiers of preprints, and beginnings of lines
#: that may state numbers
NUMERIC = r"\b\d+(?:\.\d+)?\s*(?:x|X|%|ms|s|GB|MB|KB|bits?)(?![A-Za-z0-9])"
PREPRINT = r"\b(?:20[0-2][0-9])/(?:[0-9]{3,5})\b|\b20[0-2][0-9]-[0-9]{3,5}\b"
ALLOWED = ["threshold:", "budget:", "target:", "limit:", "range:"]


def flagged_lines(docs: DataFrame, marker: str = "<!-- allow-numeric -->", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with a result-like number, unless they begin with an allowed word
    (behind list marks) or hold the marker, and lines with an identifier of a
    preprint; a line that has both is two rows."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    head = F.lower(F.regexp_replace("line", r"^\s*(?:[-*+]\s*)*", ""))
    free = reduce(lambda a, x: a | F.startswith(head, F.lit(x)), ALLOWED, F.contains("line", F.lit(marker)))
    kinds = F.array_compact(F.array(F.when(F.col("line").rlike(NUMERIC) & ~free, "numeric"), F.when(F.col("line").rlike(PREPRINT), "preprint")))
    return rows.select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(kinds).alias("kind"))


def upsert(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK8: rows of `new` replace those with the same key."""
    return registry.join(new.select(key), key, "left_anti").unionByName(new)
