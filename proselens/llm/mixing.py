"""Mixing sources to target weights by systematic sampling (operator 10).

Each source has a target, found by water filling: weights share the wanted
total, and a source never gives more than `most` times its size.  Within a
source every document expects target / size copies.  Documents stand in order of
size, then of a hash; the prefix sums of the expected copies, plus one offset
for the source, give a document as many copies as integers they cross.  As the
order goes by size, the words taken stay within about one document of the
target.

The targets of all sources are found in one task, from two numbers a source;
more than `SOURCES` sources raise an error.

Defined results: null text has size 0; a null source is a source of its own, the
last; documents of size 0 may get copies and add no words; rows that share an id
are drawn each for itself; ties go by size, then id, then text, so reruns agree;
rows that are equal in all columns share their copies; an empty table gives an
empty result; `mixed` returns all columns of its input, whatever their names, and
`with_copies` works on narrow rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, is_small, keep, lookup, row_hashes, table
from .numbering import hash32, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: weights by place of the source in code point order, repeating
WEIGHTS = (3, 1, 2)
#: the wanted total over the total of all sizes, and the most copies of a source
SHARE, MOST = 1.5, 2.0
SEED = "mix"
#: sources whose targets one task finds
SOURCES = 1_000_000


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, size): one row per source with source_size and target.

    The sources are the rows of an aggregate; the ranks over all of them run in
    one task, on a few numbers per source.
    """
    s = keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources", SOURCES)
    if s.limit(SOURCES + 1).count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("want", total * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left", F.sum("w").over(after))
    s = s.withColumn("level", F.col("want") / F.col("left"))
    # the first source below its cap sets the level of all that follow
    s = s.withColumn("free", F.col("cap") >= F.col("w") * F.col("level"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(W.partitionBy())
    s = s.withColumn("at", first["level"])
    return s.select("source", "source_size", F.when(F.col("cap") >= F.col("w") * F.col("at"), F.col("w") * F.col("at")).otherwise(F.col("cap")).alias("target"))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """Narrow rows: doc_id, source, _mix_size (words), _mix_key (what orders ties: the
    id, or without one a hash of the text), and whatever else."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(" "), F.md5(F.encode(text, "UTF-8"))))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("_mix_size"), key.alias("_mix_key"), *more)


def with_copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Rows of `sized`; each gets _mix_source_size, _mix_target and _mix_copies."""
    goal = keep(targets(rows.select("source", F.col("_mix_size").alias("size")), weights, share, most), "targets")
    rows = lookup(rows.alias("d"), goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", F.col("g.source_size").alias("_mix_source_size"), F.col("g.target").alias("_mix_target"))
    bits = F.bin("_mix_size")
    rows = rows.withColumn("_mix_len", F.length(bits)).withColumn("_mix_lead", F.substring(bits, 1, 5))
    rows = rows.withColumn("_mix_hash", hash32(F.concat(F.lit(seed), F.col("_mix_key"))))
    coarse = rows.groupBy("source", "_mix_len", "_mix_lead").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("_mix_len", "_mix_lead").rowsBetween(W.unboundedPreceding, -1)
    coarse = keep(coarse.withColumn("_mix_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "coarse")
    on = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d._mix_len") == F.col("c._mix_len")) & (F.col("d._mix_lead") == F.col("c._mix_lead"))
    rows = lookup(rows.alias("d"), coarse.alias("c"), on).select("d.*", "c._mix_before")
    rows = numbered(rows, ["source", "_mix_len", "_mix_lead"], "_mix_hash", ["_mix_size", "_mix_key"], "_mix_rank")
    rank = F.col("_mix_before") + F.col("_mix_rank")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    start = (hash32(F.concat(F.lit(seed + "/"), F.coalesce(F.col("source"), F.lit("")))) % 4096 + 0.5) / 4096.0
    rows = rows.withColumn("_mix_copies", F.floor(start + rate * rank) - F.floor(start + rate * (rank - 1)))
    return rows.drop("_mix_before", "_mix_rank", "_mix_len", "_mix_lead", "_mix_hash")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its copies say, columns as in docs.

    Copies are drawn on narrow rows and joined to the whole rows by id and two
    hashes of the row.  Texts are read in place where the drawn rows are few enough
    to be broadcast, else shuffled once, without a sort.  Rows that are equal in
    every column are one row that takes the copies of all."""
    one, two = row_hashes(docs)
    thin = keep(sized(docs, one.alias("_mix_one"), two.alias("_mix_two")), "mix")
    key = ["doc_id", "_mix_one", "_mix_two"]
    drawn = with_copies(thin).groupBy(*key).agg(F.sum("_mix_copies").alias("copies"), F.count("*").alias("rows"))
    drawn = keep(drawn.where("copies > 0"), "drawn")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]

    def emitted(wide: DataFrame, some: DataFrame) -> DataFrame:
        on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (one_d == F.col("m._mix_one")) & (two_d == F.col("m._mix_two"))
        small = F.broadcast(some) if is_small(some) else some.hint("shuffle_hash")
        rows = wide.alias("d").join(small.alias("m"), on)
        return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("m.copies").cast("int"))).alias(fresh(docs, "copy"))).select(*[F.col(f"`{c}`") for c in docs.columns])

    one_d, two_d = row_hashes(docs, "d.")
    out = emitted(docs, drawn.where("rows = 1"))
    again = drawn.where("rows > 1")
    if not again.limit(1).count():
        return out
    names = (fresh(docs, "_mix_one"), fresh(docs, "_mix_two"))
    once = docs.select("*", one.alias(names[0]), two.alias(names[1])).dropDuplicates(["doc_id", *names]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.unionByName(emitted(once, again))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(keep(sized(docs), "mix")).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).cast("long").alias("taken"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, ' ' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
a AS (SELECT level AS lv FROM l WHERE cap >= w * level ORDER BY cap / w, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap >= w * lv THEN w * lv ELSE cap END AS target FROM l, a),
r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), substr(bin(size), 1, 5),
           ('0x' || substr(md5('mix' || key), 1, 8))::BIGINT, size, key) AS rank
  FROM d),
x AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ((('0x' || substr(md5('mix/' || coalesce(r.source, '')), 1, 8))::BIGINT % 4096) + 0.5::DOUBLE) / 4096.0::DOUBLE AS start
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(start + rate * rank) - floor(start + rate * (rank - 1)))::BIGINT * size)::BIGINT AS taken
FROM x
"""
