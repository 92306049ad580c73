"""Sources and sinks: texts, glossaries, profiles, tables, BibTeX, upserts."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fingerprint as fp
from ..operators import glossary as gl

SUFFIXES = (".tex", ".md", ".txt")
#: fixed values: what a dossier may hold, and the two headers of a table of terms
DOSSIER = (".md", ".txt", ".tex", ".csv", ".yaml", ".yml", ".json", ".bib")
TERM_LAYOUT = ["term", "preferred english", "avoid", "notes"]
BILINGUAL_LAYOUT = ["chinese", "recommended english", "acceptable alternatives", "avoid", "notes"]


def _trim(x: Column) -> Column:
    return F.trim(x)


def documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, lenient: bool = False, private: str | None = None, ordered: bool = False) -> DataFrame:
    """SRC1 to SRC4: path, suffix, text of all files below a folder, LF only, once
    each.  Strict: a file that is not UTF-8 fails the query; lenient drops bad
    bytes.  private: a folder name left out unless the path itself names it.
    ordered: by lower-cased path, which sorts whole texts."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = rows.select("path", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*suffixes))
    if private and f"/{private}" not in path:
        rows = rows.where(~F.contains("path", F.lit(f"/{private}/")))
    body = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "") if lenient else F.validate_utf8(F.col("content").cast("string"))
    out = rows.dropDuplicates(["path"]).select("path", "suffix", tx.lf(body).alias("text"))
    return out.orderBy(F.lower("path"), "path") if ordered else out


def versions(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: stages of a text, by the number in the file name, -1 if it has none.  One
    file has no history: an error, told from the paths alone."""
    rows = documents(spark, path)
    stage = F.regexp_extract(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1), r"(?i)(?:version|stage|v)[-_ ]?(\d+)", 1)
    if rows.select("path").limit(2).count() < 2:
        raise ValueError(f"fewer than two versions: {path}")
    return rows.withColumn("stage", F.coalesce(F.nullif(stage, F.lit("")).cast("int"), F.lit(-1)))


def dossier_files(spark: SparkSession, root: str, includes: list[str] | None = None) -> DataFrame:
    """SRC18: files that a dossier shows, in order of lower-cased path, none of .git:
    all below the root, or the files and folders named.  One that is not there, is of
    another kind or leads out of the root, and an empty choice, are errors."""
    named = [x.strip("/") for x in includes or []]
    if any(".." in x.split("/") for x in named):
        raise ValueError("outside of the root")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = rows.withColumn("_own", own).withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    kinds = rows.where(F.col("suffix").isin(*DOSSIER) & ~F.col("path").rlike(r"/\.git/"))
    under = [(F.col("_own") == x) | F.startswith("_own", F.lit(x + "/")) for x in named]
    missing = [x for x, at in zip(named, under) if not kinds.where(at).select("path").limit(1).count()]
    if missing:
        raise ValueError(f"not there or of another kind: {', '.join(missing)}")
    out = kinds.where(reduce(lambda a, b: a | b, under)) if under else kinds
    if not out.select("path").limit(1).count():
        raise ValueError("no file is chosen")
    return out.select("path", "suffix", tx.lf(F.validate_utf8(F.col("content").cast("string"))).alias("text")).orderBy(F.lower("path"), "path")


def glossary_json(spark: SparkSession, path: str, layer: str = "L0") -> DataFrame:
    """SRC6, SRC7, SRC10: entries of a glossary file; bad files and entries without
    a term or a forbidden form fail."""
    kind = "schema string, layer string, direction string, entries array<struct<term:string,abbreviation:string,forbidden_synonyms:array<string>,forbidden_variants:array<string>>>"
    rows = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select(F.posexplode("entries").alias("pos", "e"))
    none = F.array().cast("array<string>")
    out = rows.select(F.lit(layer).alias("layer"), "pos", F.trim("e.term").alias("term"), F.trim("e.abbreviation").alias("abbreviation"), F.coalesce("e.forbidden_synonyms", none).alias("synonyms"), F.coalesce("e.forbidden_variants", none).alias("variants"))
    bad = F.col("term").isNull() | (F.col("term") == "") | (F.size("synonyms") + F.size("variants") == 0)
    return out.withColumn("term", F.when(bad, F.raise_error(F.lit("a glossary entry needs a term and a forbidden form"))).otherwise(F.col("term")))


def layer_file(spark: SparkSession, path: str, schema: str, layer: str, direction: str | None) -> DataFrame:
    """SRC10: entries of a layer, whose file must name this schema, layer and direction."""
    kind = "schema string, layer string, direction string"
    tags = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    if tags is None or tuple(tags) != (schema, layer, direction):
        raise ValueError(f"another schema, layer or direction: {path}")
    return glossary_json(spark, path, layer)


def glossary_markdown(spark: SparkSession, path: str, layer: str = "L2") -> DataFrame:
    """SRC8, SRC9: entries of the first table whose header is one of the two layouts:
    with four columns the first is the term, with five the second.  A row of another
    width or without a term, a header without its rule, a file without a table and a
    table without entries fail; a row with nothing to avoid is passed over.  One file,
    so one row until the table is cut."""
    lines = F.split(tx.lf("value"), "\n")
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1), _trim)
    layouts = [F.array(*[F.lit(x) for x in names]) for names in (TERM_LAYOUT, BILINGUAL_LAYOUT)]
    is_head = lambda x: x.rlike(r"^\s*\|") & F.transform(cells(x), lambda v: F.lower(v)).isin(*layouts)
    file = spark.read.text(path, wholetext=True).agg(F.coalesce(F.max("value"), F.lit("")).alias("value")).select(lines.alias("l"))
    file = file.withColumn("at", F.array_position(F.transform("l", is_head), True))
    fail = lambda why: F.raise_error(F.lit(f"{why}: {path}"))
    width = F.size(cells(F.get("l", F.col("at").cast("int") - 1)))
    rule = cells(F.get("l", F.col("at").cast("int")))
    ruled = (F.size(rule) == F.col("width")) & F.forall(rule, lambda x: x.rlike("^:?-{3,}:?$"))
    file = file.withColumn("width", width).withColumn("l", F.when(F.col("at") == 0, fail("no table of terms").cast("array<string>")).when(~F.coalesce(ruled, F.lit(False)), fail("a header without its rule").cast("array<string>")).otherwise(F.col("l")))
    below = F.slice("l", F.col("at").cast("int") + 2, F.size("l"))
    # the table ends with the first line that does not begin with a bar
    end = F.array_position(F.transform(below, lambda x: x.rlike(r"^\s*\|")), False).cast("int")
    body = F.when(end > 0, F.slice(below, F.lit(1), end - 1)).otherwise(below)
    four = F.col("width") == len(TERM_LAYOUT)

    def entry(x: Column, pos: Column) -> Column:
        own = cells(x)
        term = F.get(own, F.when(four, 0).otherwise(1))
        avoid = F.filter(F.transform(F.split(F.get(own, F.when(four, 2).otherwise(3)), r"[;,；，]"), _trim), lambda v: v != "")
        bad = ~x.rlike(r"^\s*\|.*\|\s*$") | (F.size(own) != F.col("width")) | F.coalesce(term == "", F.lit(True))
        return F.struct((F.col("at").cast("int") + 1 + pos).alias("pos"), F.when(bad, fail("a row of another width or without a term").cast("string")).otherwise(term).alias("term"), F.array_distinct(avoid).alias("synonyms"))

    # a row that fails has to be read before it can be passed over
    listed = F.filter(F.transform(body, entry), lambda e: e["term"].isNotNull() & (F.size(e["synonyms"]) > 0))
    rows = file.select(listed.alias("e"))
    rows = rows.withColumn("e", F.when(F.size("e") == 0, fail("a table without entries").cast(rows.schema["e"].dataType)).otherwise(F.col("e")))
    return rows.select(F.explode("e").alias("e")).select(F.lit(layer).alias("layer"), "e.pos", "e.term", F.lit(None).cast("string").alias("abbreviation"), "e.synonyms", gl.derived_variants("e.term").alias("variants"))


def glossary_terms(spark: SparkSession, path: str) -> DataFrame:
    """SRC7, SRC8: the terms of a glossary alone, longest first.  JSON: of its entries;
    CSV: of the first two columns; Markdown: of the first two columns of all tables,
    several between commas or semicolons, and all between back-ticks.  None is an
    error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        rows = spark.read.schema("entries array<struct<term:string>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("entries.term").alias("t"))
        rows = rows.select(F.when(F.coalesce(F.trim("t"), F.lit("")) == "", F.raise_error(F.lit("an entry without a term")).cast("string")).otherwise(F.col("t")).alias("t"))
    elif suffix == "csv":
        rows = spark.read.schema("a string, b string").option("header", True).option("enforceSchema", True).csv(path).select(F.explode(F.array("a", "b")).alias("t"))
    else:
        lines = spark.read.text(path).select(F.trim("value").alias("l"))
        table = lines.where(F.startswith("l", F.lit("|")) & ~F.contains("l", F.lit("---")))
        cells = table.select(F.transform(F.split(F.regexp_replace("l", r"^\|+|\|+$", ""), r"\|"), _trim).alias("c")).where(~F.lower(F.get("c", F.lit(0))).isin("term", "chinese"))
        parts = cells.select(F.explode(F.slice("c", 1, 2)).alias("c")).select(F.explode(F.split("c", r"\s*[;,]\s*")).alias("t"))
        quoted = spark.read.text(path, wholetext=True).select(F.explode(tx.every("value", "`([^`]+)`", 1)).alias("t"))
        rows = parts.select(F.regexp_replace("t", "[`*_]", "").alias("t")).unionByName(quoted)
    out = rows.select(F.trim("t").alias("term")).where("term <> ''").distinct()
    if not out.limit(1).count():
        raise ValueError(f"a glossary without terms: {path}")
    return out.orderBy(F.desc(F.length("term")), F.lower("term"), "term")


def write_baseline(base: DataFrame, path: str) -> None:
    """SNK1: a baseline (one row) as one JSON file."""
    row = base.first()
    stats = {m: {"mean": row[f"{m}_mean"], "sd": row[f"{m}_sd"]} for m in fp.BASELINE}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"document_count": row["paper_count"], "metric_stats": stats}, f, indent=2)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: a baseline file as the row that `fingerprint.compared` takes.  Its count
    must be at least one and each metric have a numeric mean and deviation."""
    text = spark.read.text(path, wholetext=True).first()
    try:
        data = json.loads(text[0])
        count, stats = data["document_count"], data["metric_stats"]
        figures = [stats[m][x] for x in ("mean", "sd") for m in fp.BASELINE]
    except (TypeError, KeyError, ValueError) as e:
        raise ValueError(f"not a baseline: {path}") from e
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not (isinstance(count, int) and count >= 1 and all(map(number, figures))):
        raise ValueError(f"not a baseline: {path}")
    names = [f"{m}_{x}" for x in ("mean", "sd") for m in fp.BASELINE]
    out = spark.createDataFrame([(count, *map(float, figures))], "paper_count long, " + ", ".join(f"{n} double" for n in names))
    return fp.with_status(out)


def profile(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: a profile file with the digest of its bytes; values as VARIANT."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.parse_json(F.col("content").cast("string")).alias("value"))


def yaml_field(spark: SparkSession, path: str, field: str) -> DataFrame:
    """SRC12: one scalar of a YAML file; differing values fail."""
    rows = spark.read.text(path).select(F.regexp_extract("value", rf"^\s*{field}\s*:\s*[\"']?([^\"'#]*?)[\"']?\s*(?:#.*)?$", 1).alias("v")).where("v <> ''")
    got = rows.agg(F.collect_set("v").alias("v"))
    return got.select(F.when(F.size("v") > 1, F.raise_error(F.lit("conflicting values"))).otherwise(F.get("v", F.lit(0))).alias(field))


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC14: a CSV file with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC20: evaluation cases, one JSON object in a file."""
    return spark.read.schema("id string, runner string, assertion string, input string, expected string").option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """SNK2."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK3."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, order: str, path: str) -> None:
    """SNK4, SNK5: a text file of one column in order."""
    df.orderBy(order).select(column).write.mode("overwrite").text(path)


def write_confined(df: DataFrame, root: str, name: str) -> None:
    """SNK10: refuses a name that leads out of the root."""
    if name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"outside of the root: {name}")
    df.write.mode("overwrite").json(f"{root.rstrip('/')}/{name}")
