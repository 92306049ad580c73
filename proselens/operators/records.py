"""Records of a project: admission by digest, ordered equality, mentions between
files, dossiers, limits and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

MENTION = r"[A-Za-z0-9_./-]+\.(?:md|tex|txt)"
#: greatest length of a first line, and of a body in lines
HEADER, LINES = 200, 500
#: values of a list, and bytes of a text, that one cell takes
LIST, BODY = 1_000_000, 64 << 20


def admitted(files: DataFrame, manifest: DataFrame, key: str, body: str) -> DataFrame:
    """Whether the digest of each text is listed.  A null text is empty;
    digests listed twice count once."""
    listed = manifest.select(F.col("digest").alias("_d")).distinct()
    rows = files.select(key, F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("digest"))
    return rows.join(listed, F.col("digest") == F.col("_d"), "left").select(key, "digest", F.col("_d").isNotNull().alias("admitted"))


def same_order(reserved: DataFrame, fragment: DataFrame) -> DataFrame:
    """(series, place, text) on both sides: whether the n-th texts are equal,
    by ordinal, so no series is collected.  A null text is empty; a text without
    partner differs."""
    by = W.partitionBy("series").orderBy("place", "text")
    side = lambda df, name: df.select("series", F.row_number().over(by).alias("at"), F.coalesce("text", F.lit("")).alias(name))
    both = side(reserved, "a").join(side(fragment, "b"), ["series", "at"], "full_outer")
    got = both.groupBy("series").agg(F.count("*").alias("texts"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))
    return got.withColumn("equal", F.col("differing") == 0)


def canonical(rows: DataFrame, titles: DataFrame, column: str = "title") -> DataFrame:
    """Rows whose normalised title is listed; all rows if none is."""
    wanted = titles.select(tx.normal_title("title").alias("_t")).distinct()
    if not wanted.limit(1).count():
        return rows
    return rows.join(wanted, tx.normal_title(column) == F.col("_t"), "left_semi")


def mentions(files: DataFrame) -> DataFrame:
    """G1: (path, text) to edges.  A mention is a path as it stands, else one beside
    the file that holds it, else a file name that only one path has."""
    name = lambda x: F.regexp_extract(x, r"([^/]*)$", 1)
    known = files.select("path").distinct()
    exact, beside = known.select(F.col("path").alias("_exact")), known.select(F.col("path").alias("_beside"))
    single = known.groupBy(name("path").alias("_name")).agg(F.count("*").alias("_n"), F.min("path").alias("_only")).where("_n = 1").drop("_n")
    rows = files.select("path", F.explode(F.array_distinct(tx.every("text", MENTION))).alias("mention"))
    rows = rows.join(exact, F.col("mention") == F.col("_exact"), "left")
    rows = rows.join(beside, F.concat(F.regexp_replace("path", r"[^/]*$", ""), "mention") == F.col("_beside"), "left")
    rows = rows.join(single, name("mention") == F.col("_name"), "left")
    how = F.when(F.col("_exact").isNotNull(), "path").when(F.col("_beside").isNotNull(), "sibling").otherwise("name")
    return rows.select("path", "mention", F.coalesce("_exact", "_beside", "_only").alias("target"), how.alias("how")).where("target is not null and target <> path")


def totals(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes, those reached, and the percentage of orphans; null if there is no node."""
    rows = nodes.select("node").distinct().join(reached.select(F.col("node").alias("_r")).distinct(), F.col("node") == F.col("_r"), "left")
    n, got = F.count("*"), F.count("_r")
    return rows.agg(n.alias("nodes"), got.alias("reached"), (n - got).alias("orphans"), F.when(n > 0, F.round((n - got) * 100.0 / n, 4).cast("double")).alias("orphan_percent"))


def dossier(files: DataFrame) -> DataFrame:
    """SNK5, SNK7: (series, place, text) to one text a series, in order, with its
    number of words.  A series is the files of one project, which fit one task; one of
    more than `BODY` bytes raises an error."""
    if files.groupBy("series").agg(F.sum(F.octet_length("text")).alias("n")).where(F.col("n") > BODY).limit(1).count():
        raise ValueError(f"a series of more than {BODY} bytes")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.concat(F.lit("## "), x["place"].cast("string"), F.lit("\n"), x["text"])), "\n\n")
    return files.groupBy("series").agg(F.sum(F.size(tx.words(F.coalesce("text", F.lit(""))))).alias("words"), body.alias("body"))


def limits(docs: DataFrame, key: str = "doc_id", text: str = "text", header: int = HEADER, lines: int = LINES) -> DataFrame:
    """Length of the first line and number of lines, and whether both are in bounds."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return docs.select(key, F.length(F.element_at(parts, 1)).alias("header"), F.size(parts).alias("lines")).withColumn("within", (F.col("header") <= header) & (F.col("lines") <= lines))


def digest_set(values: DataFrame, column: str) -> DataFrame:
    """Size and digest of a private list, by the sorted digests of its values.  A
    list of more than `LIST` values raises an error."""
    one = values.select(F.sha2(F.col(column), 256).alias("d")).where("d is not null").distinct()
    if one.limit(LIST + 1).count() > LIST:
        raise ValueError(f"more than {LIST} values")
    return one.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("digest"))


def by_span(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matches within each sentence span: the spans are cut first, so that no
    offset has to be joined to an interval."""
    rows = docs.select(key, F.posexplode(tx.sentence_spans(text)).alias("span", "s"))
    return rows.select(key, "span", F.regexp_count("s", F.lit(pattern)).alias("hits")).where("hits > 0")


def numbered(rows: DataFrame, group: str, title: Column, prefix: int = 4) -> DataFrame:
    """Place in the order of (group, title).  Only counts of (group, first
    characters) meet in one task, at most `LIST` of them (more raise an error: ask for a
    shorter prefix); rows are numbered within their prefix."""
    own = rows.withColumn("_title", title).withColumn("_p", F.substring("_title", 1, prefix))
    sizes = own.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    if sizes.limit(LIST + 1).count() > LIST:
        raise ValueError(f"more than {LIST} prefixes")
    before = F.sum("_n").over(W.orderBy(group, "_p").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_start"))
    ranked = own.withColumn("_r", F.row_number().over(W.partitionBy(group, "_p").orderBy("_title", "title")))
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_p").eqNullSafe(F.col("_q")))
    return joined.withColumn("place", (F.col("_start") + F.col("_r")).cast("int")).drop("_title", "_p", "_g", "_q", "_start", "_r")


def cards(candidates: DataFrame) -> DataFrame:
    """SNK6: a Markdown card for each candidate, with the name of its file.  candidates:
    place, paper_id, stage_pair, driver, section_type, rule_ids, before, after, changed,
    kept (two arrays, one of text).  A null is empty; with nothing kept the card says so."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    none = "None identified; author confirmation required."
    kept = F.coalesce(F.nullif(F.array_join("kept", ", "), F.lit("")), F.lit(none))
    rules = F.coalesce(F.array_join(F.transform("rule_ids", lambda x: x.cast("string")), ", "), F.lit(""))
    head = [("Paper ID", text("paper_id")), ("Stage pair", text("stage_pair")), ("Pair driver", text("driver")), ("Section type", text("section_type")), ("Rule IDs", rules)]
    parts = [("Before", text("before")), ("After", text("after")), ("What changed", text("changed")), ("What was deliberately kept", kept)]
    top = F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), v) for name, v in head])
    body = F.concat_ws("\n\n", F.lit("# Exemplar Card"), top, *[x for name, v in parts for x in (F.lit(f"## {name}"), v)])
    number = F.when(F.col("place") > 999, F.col("place").cast("string")).otherwise(F.lpad(F.col("place").cast("string"), 3, "0"))
    return candidates.select("place", F.concat(F.lit("exemplar-"), number, F.lit(".md")).alias("name"), F.concat(body, F.lit("\n")).alias("card"))


def with_field(text: Column, field: str, value: Column, force: bool = False, ahead: str = "fingerprint") -> Column:
    """SNK9: a YAML text whose top-level field has the value, quoted as in JSON; a new
    field goes ahead of another.  Fails if the field is there twice, or has a value and
    `force` is not given, or the other field is not there exactly once."""
    line = rf"(?m)^{field}[ \t]*:[^\r\n]*"
    other = rf"(?m)^{ahead}[ \t]*:[ \t]*(?:#[^\r\n]*)?$"
    stop = lambda why: F.raise_error(F.lit(why)).cast("string")
    old = F.trim(F.regexp_extract(text, rf"(?m)^{field}[ \t]*:([^\r\n]*)", 1))
    new = F.concat(F.lit(f"{field}: "), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    safe = F.regexp_replace(new, r"([\\$])", r"\\$1")
    n, m = F.regexp_count(text, F.lit(line)), F.regexp_count(text, F.lit(other))
    end = F.when(F.contains(text, F.lit("\r\n")), "\r\n").otherwise("\n")
    put = F.regexp_replace(text, F.lit(line), safe)
    insert = F.regexp_replace(text, F.lit(other), F.concat(safe, end, F.lit("$0")))
    return (
        F.when(n > 1, stop(f"more than one top-level {field}"))
        .when((n == 1) & ~old.isin("", "null", "~") & ~F.lit(force), stop(f"{field} has a value"))
        .when(n == 1, put)
        .when(m != 1, stop(f"{ahead} must be there once"))
        .otherwise(insert)
    )


def roll_up(checks: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, name, passed) to one row a case: its status and the names of what
    failed, in order.  A null result failed; names of one case are few."""
    failed = F.array_sort(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.col("name"))))
    rows = checks.groupBy(case).agg(F.count("*").alias("checks"), failed.alias("_f"))
    return rows.select(case, "checks", F.when(F.size("_f") == 0, "assertions-satisfied").otherwise("assertions-failed").alias("status"), F.array_join("_f", ",").alias("failed"))
