"""Substrings of identifiers whose digests are in a private list.

The list holds only digests, so every substring up to `LONGEST` of every identifier must
be hashed.  Identifiers repeat, so only distinct ones are: a first shuffle brings each to
one task; a set of the digests, bounded in bytes, is broadcast, and substrings are hashed
and sought in the task.  What is shuffled after that are hits.  A list beyond the bound is
taken in slices.

Defined results: identifiers are sought in lower case; a null text has none; a list
without digests gives no rows; digests in another case, or of another length, match
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .corpus import IDENTIFIER

#: fixed value: greatest length of a substring that is held against the list
LONGEST = 128
#: digests that are broadcast at once (32 bytes each, and what a set takes beside)
SLICE = 200_000
_DIGEST = re.compile("[0-9a-f]{64}")


def identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (1-based), token: the identifiers of each line, in lower case."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    return rows.select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(tx.every(F.lower("line"), IDENTIFIER.replace("A-Z", ""))).alias("token"))


def substrings(token: str) -> Iterator[str]:
    """All substrings up to `LONGEST` characters; one that repeats comes again."""
    for start in range(len(token)):
        for end in range(start + 1, min(len(token), start + LONGEST) + 1):
            yield token[start:end]


def _slices(digests: DataFrame) -> Iterator[list[bytes]]:
    held = []
    for r in digests.select("digest").distinct().toLocalIterator():
        if r[0] and _DIGEST.fullmatch(r[0]):
            held.append(bytes.fromhex(r[0]))
            if len(held) == SLICE:
                yield held
                held = []
    if held:
        yield held


def hits(docs: DataFrame, digests: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, token, digest, n: identifiers with a substring whose digest is listed,
    and how often the identifier stands in the line."""
    spark = docs.sparkSession
    places = identifiers(docs, key, text).groupBy(key, "line_no", "token").agg(F.count("*").alias("n"))
    tokens = places.select("token").distinct()
    found = spark.createDataFrame([], "token string, digest string")
    for k, part in enumerate(_slices(digests)):
        own = tokens.mapInArrow(_scan(spark.sparkContext.broadcast(frozenset(part))), "token string, digest string")
        found = own if not k else found.unionByName(own)
    return places.join(found, "token").select(key, "line_no", "token", "digest", "n")


def _scan(sent):  # type: ignore[no-untyped-def]
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = sent.value
        for batch in batches:
            out = []
            for token in batch.column(0).to_pylist():
                digests = {d for s in substrings(token) if (d := sha256(s.encode()).digest()) in listed}
                out += [(token, d.hex()) for d in sorted(digests)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.string()) for c in (0, 1)], names=["token", "digest"])

    return scan
