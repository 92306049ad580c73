"""Vector code compression with annular norm pruning (operator 13).

Vectors become integers, are cut into equal parts, and each part is replaced by the
index of an entry of that part's codebook.  The nearest entry is found exactly: the
entries of a part stand in order of their norms; the entries beside the part's own
norm give a first best distance; entries nearer than that have a norm within it of
the part's own, so a binary search gives the interval (the annulus), and the entries
of the annulus, both ends included, are measured in whole numbers.

Codebooks are a few thousand numbers.  They are broadcast, each task sums the parts
that go to each entry, and Spark adds up one row for each entry and position of a
task.  Vectors are read in place for each round; none is shuffled.

Defined results: rows whose vector is null or holds a null or non-finite component
are dropped; the dimension is that of the first row, by vec_id, whose length is a
multiple of the number of parts, and rows of another length (the empty vector too)
are dropped, as they cannot be cut alike; a null vec_id comes last among the seeds,
rows that share one stand in order of their vectors; with fewer rows than entries
there are as many entries as rows; equal rows get equal codes; a component from 2^26
on in units raises an error, as distances would not fit a long; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, lean, lookup, merged, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: components are below this in units
LIMIT = 1 << 26
#: bytes of vectors that are measured at once
EACH = 1 << 20


@dataclass
class Codebook:
    """The entries of one part, as rows of integers, and their order by norm."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        square = (self.entries**2).sum(1)
        self.order = np.argsort(square, kind="stable")
        self.norms = np.sqrt(square[self.order].astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each row, ties to the
        lower index."""
        own = np.sqrt((x**2).sum(1).astype(np.float64))
        at, last = np.searchsorted(self.norms, own), len(self.norms) - 1
        sides = [((x - self.entries[self.order[np.clip(k, 0, last)]]) ** 2).sum(1) for k in (at - 1, at)]
        radius = np.sqrt(np.minimum(*sides).astype(np.float64))
        slack = (own + radius) * 1e-12 + 1e-9  # roots are rounded; the interval only widens
        low = np.searchsorted(self.norms, own - radius - slack, "left")
        many = np.searchsorted(self.norms, own + radius + slack, "right") - low
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        row = np.repeat(np.arange(len(x)), many)
        some = self.order[np.arange(len(row)) - first[row] + low[row]]
        far = ((x[row] - self.entries[some]) ** 2).sum(1)
        best = np.minimum.reduceat(far, first)
        return np.minimum.reduceat(np.where(far == best[row], some, len(self.order)), first), best


def whole(col: pa.Array, dim: int) -> np.ndarray:
    """A row of integers for each vector of a list column without nulls."""
    x = np.floor(np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) * SCALE)
    if x.size and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component of {LIMIT // SCALE} or more")
    return x.astype(np.int64)


def usable(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label and embedding of the rows that can be coded, and their dimension."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", odd) & (F.size("embedding") > 0))
    first = rows.where(F.size("embedding") % parts == 0).select("vec_id", F.size("embedding").alias("n"), "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").first()
    dim = first["n"] if first else 0
    return rows.where(F.size("embedding") == dim), dim


def seeds(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> list[Codebook]:
    """Codebooks of the vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    x = whole(pa.array([r[0] for r in first], pa.list_(pa.float64())), dim)
    return [Codebook(part) for part in np.split(x, parts, axis=1)] if len(x) else []


def updated(rows: DataFrame, dim: int, books: list[Codebook]) -> list[Codebook]:
    """Each entry becomes the mean of the parts that are nearest to it, rounded down;
    entries without any stay."""
    spark, width, k = rows.sparkSession, dim // len(books), len(books[0].entries)
    sent = spark.sparkContext.broadcast([b.entries for b in books])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in sent.value]
        total = np.zeros((len(own) * k, width + 1), np.int64)  # the last position counts
        for batch in merged(batches, EACH):
            for p, (book, x) in enumerate(zip(own, np.split(whole(batch.column("embedding"), dim), len(own), axis=1))):
                entry = book.nearest(x)[0] + p * k
                order = np.argsort(entry, kind="stable")
                first = np.flatnonzero(np.diff(entry[order], prepend=-1))
                total[entry[order][first]] += np.add.reduceat(np.column_stack([x, np.ones(len(x), np.int64)])[order], first)
        entry, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(at), pa.array(total[entry, at])], names=["entry", "position", "total"])

    found = rows.select("embedding").mapInArrow(lean(sums), "entry long, position long, total long").groupBy("entry", "position").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((len(books) * k, width + 1), np.int64)
    for r in found:
        total[r["entry"], r["position"]] = r["total"]
    sent.unpersist()
    count = total[:, -1:]
    mean = np.where(count > 0, total[:, :-1] // np.maximum(count, 1), np.concatenate([b.entries for b in books]))
    return [Codebook(e) for e in np.split(mean, len(books))]


def coded(rows: DataFrame, dim: int, books: list[Codebook]) -> DataFrame:
    """vec_id, label, code (a byte for each part) and error (squared distances of all parts)."""
    sent = rows.sparkSession.sparkContext.broadcast([b.entries for b in books])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in sent.value]
        for batch in merged(batches, EACH):
            got = [book.nearest(x) for book, x in zip(own, np.split(whole(batch.column("embedding"), dim), len(own), axis=1))]
            code = np.column_stack([g[0] for g in got]).astype(np.uint8)
            error = np.sum([g[1] for g in got], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(lean(codes), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """vectors: vec_id, embedding, label.  The codes of all usable rows, written to the
    shared folder, and the codebooks; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("from 1 to 256 entries")
    rows, dim = usable(vectors, parts)
    books = seeds(rows, dim, parts, entries) if dim else []
    if not books:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        return rows.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"), []
    for _ in range(rounds):
        books = updated(rows, dim, books)
    return keep(coded(rows, dim, books), "codes"), books


def restored(code: bytes, books: list[Codebook]) -> np.ndarray:
    """The vector that a code stands for, in units."""
    return np.concatenate([b.entries[c] for b, c in zip(books, code)])


def digest(vectors: DataFrame) -> DataFrame:
    codes, books = compressed(vectors)
    of_label = keep(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    line = ",".join(str(x) for b in books for x in b.entries.ravel().tolist())
    out = lookup(codes.alias("d"), of_label.alias("l"), F.col("d.label").eqNullSafe(F.col("l.label")))
    return out.select("d.vec_id", F.lower(F.hex("d.code")).alias("code"), "d.error", "l.label_error", F.lit(hashlib.sha256(line.encode()).hexdigest()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "embeddings"))


def _sql_round(n: int) -> str:
    return f"""
a{n} AS MATERIALIZED (
  SELECT i, vec_id, label, part, x, min(near) AS near FROM (
    SELECT p.*, struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - y[k]) * (x[k] - y[k])))::BIGINT, e := e) AS near
    FROM p JOIN c{n} USING (part)) GROUP BY ALL)"""


def _sql_update(n: int) -> str:
    return f"""
m{n} AS (
  SELECT part, e, list(y ORDER BY k) AS y FROM (
    SELECT part, near.e AS e, k, floor(sum(x[k])::DOUBLE / count(*))::BIGINT AS y
    FROM (SELECT part, near, x, unnest(range(1, len(x) + 1)) AS k FROM a{n}) GROUP BY ALL) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.y, c.y) AS y FROM c{n} c LEFT JOIN m{n} m USING (part, e))"""


SQL = f"""
WITH r AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
k AS (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST, v) AS i, vec_id, label, list_transform(v, lambda x: x::BIGINT) AS v FROM r
  WHERE len(v) = (SELECT len(v) FROM r WHERE len(v) % {PARTS} = 0 ORDER BY vec_id ASC NULLS LAST, v LIMIT 1)),
p AS MATERIALIZED (
  SELECT i, vec_id, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x
  FROM (SELECT *, unnest(range({PARTS})) AS part FROM k)),
c0 AS MATERIALIZED (SELECT part, i - 1 AS e, x AS y FROM p WHERE i <= {ENTRIES}),
{_sql_round(0)},{_sql_update(0)},{_sql_round(1)},{_sql_update(1)},{_sql_round(2)},
s AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS h FROM c2),
o AS (
  SELECT i, vec_id, label, string_agg(lpad(lower(to_hex(near.e::BIGINT)), 2, '0'), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s.h AS codebooks_sha256 FROM o, s
"""
