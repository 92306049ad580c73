"""Benchmark decontamination on a positional inverted index (operator 7).

The index is a table of segments, one row per batch of training documents: the
documents, a sorted dictionary of term hashes, and for each term its sorted
positions in the segment.  Only terms of the test vocabulary are stored (pass
none to store all), so an index serves any number of searches over those terms.

A search takes test windows.  In each segment it starts from the postings of a
window's rarest term, shifts them to the window's start, and intersects them with
the shifted postings of the next rarest term, and so on; what is left are exact
phrases.

A proximity match finds reworded passages.  Of an item's distinct words that some
document has, the `TERMS` rarest (by documents of the whole corpus, then by word)
are its terms; `SHARE_NEAR` of them, rounded up, must occur, in any order, at most
`SPREAD` words from an occurrence of one of its rarest terms (so many that at least
one of them must be there).  Items with fewer than `LEAST` terms have phrases only.

The test set is compiled and broadcast in blocks of at most about `BLOCK_WORDS`
words, one search of the stored index for each, written before the next begins; the
hits of several blocks meet by document.  The index holds the words of the test set:
those of a single block exactly, those of several by a Bloom filter of fixed
greatest size, which may let in more words but leaves none out.

Defined results: null or empty text has no words, no hits, and is clean; an item
without words has no window; items that share an id count as one; a null item id
counts as one item and is written as an empty string; repeated documents are
judged each; empty tables give clean or no documents; other columns of the inputs
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import filter_of
from .common import keep, lean, table
from .kernel import ALNUM_WORD, Bits, Words, blob, mix

WINDOW = 13
#: a document is contaminated if hits are at least one word in so many
SHARE = 20
#: words of test items that are broadcast at once, and bytes of text of a segment
BLOCK_WORDS = 1_000_000
#: proximity: an item's terms, the least number of them, the share that must be near,
#: and how many words away from the centre
TERMS, LEAST, SHARE_NEAR, SPREAD = 8, 4, 0.75, 32

SEGMENT = "segment long, docs array<long>, n_words binary, terms binary, first binary, places binary"
HITS = "segment long, place int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>, near array<string>"


@dataclass
class Tests:
    """Windows of test items: term hashes, the item of each, and their words."""

    items: list[str]
    item: np.ndarray
    size: np.ndarray
    terms: np.ndarray  # windows x WINDOW, 0 beyond the size
    words: list[list[tuple[bytes, int]]]  # for each item its distinct words and their hashes
    rare: np.ndarray | None = None  # items x TERMS, the rarest first, 0 beyond
    need: np.ndarray | None = None  # how many of them must be near; 0: no proximity

    def weigh(self, found_in: dict[int, int]) -> None:
        """Choose each item's terms by the documents that hold them."""
        self.rare, self.need = np.zeros((len(self.items), TERMS), np.uint64), np.zeros(len(self.items), np.int64)
        for k, own in enumerate(self.words):
            few = sorted((found_in[h], w, h) for w, h in own if h in found_in)[:TERMS]
            if len(few) >= LEAST:
                self.rare[k, : len(few)] = [h for _, _, h in few]
                self.need[k] = -int(-SHARE_NEAR * len(few) // 1)

    @property
    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms[self.terms > 0])


def _terms(words: Words) -> np.ndarray:
    return np.maximum(words.hash, np.uint64(1))


def compile_tests(rows: list[tuple], window: int = WINDOW) -> Tests:
    """rows: (item_id, text)."""
    names = sorted({"" if i is None else str(i) for i, _ in rows})
    place = {x: k for k, x in enumerate(names)}
    words = Words.of(pa.array([t for _, t in rows], pa.string()), ALNUM_WORD)
    terms, seen, item, size, out = _terms(words), set(), [], [], []
    distinct: list[set[tuple[bytes, int]]] = [set() for _ in names]
    for k, (i, _) in enumerate(rows):
        a, b = words.first[k], words.first[k + 1]
        own = terms[a:b]
        distinct[place["" if i is None else str(i)]].update((words.data[s:e].tobytes(), h) for s, e, h in zip(words.starts[a:b], words.ends[a:b], own.tolist()))
        n = min(window, len(own))
        for j in range(len(own) - n + 1 if n else 0):
            key = (place["" if i is None else str(i)], own[j : j + n].tobytes())
            if key not in seen:
                seen.add(key)
                item.append(key[0])
                size.append(n)
                out.append(np.pad(own[j : j + n], (0, window - n)))
    return Tests(names, np.array(item, np.int64), np.array(size, np.int64), np.array(out, np.uint64).reshape(-1, window), [sorted(x) for x in distinct])


def _sized(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items, and in how many blocks."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text")
    total = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) / 2 + 1)).first()[0] or 0
    return rows, int(total // BLOCK_WORDS) + 1


def block(rows: DataFrame, b: int, n: int, window: int = WINDOW) -> Tests:
    """The b-th of n blocks of items."""
    own = rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b) if n > 1 else rows
    return compile_tests([(r["i"], r["text"]) for r in own.collect()], window)


def vocabulary_filter(rows: DataFrame) -> Bits:
    """The words of all items as a Bloom filter."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_terms(Words.of(batch.column("text"), ALNUM_WORD))).view(np.int64))], names=["key"])

    keys = keep(rows.select("text").mapInArrow(lean(words), "key long").distinct(), "vocabulary")
    return filter_of(keys, keys.count())


def index(docs: DataFrame, vocabulary: np.ndarray | Bits | None = None) -> DataFrame:
    """The segments of docs (doc_id, text), in the shared folder; of the words of a
    vocabulary, of those that a filter lets in, or of all."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        terms_of = known.value if known is not None else None
        if isinstance(terms_of, np.ndarray):
            shift = np.uint64(40)
            maybe = np.zeros(1 << 24, bool)
            maybe[(mix(terms_of) >> shift).astype(np.int64)] = True
        for k, batch in enumerate(batches):
            words = Words.of(batch.column("text"), ALNUM_WORD)
            # a gap after each document keeps phrases apart; doc d begins at first + d * gap
            place = np.arange(len(words.hash)) + words.doc * WINDOW
            terms = _terms(words)
            if isinstance(terms_of, Bits):
                some = np.flatnonzero(terms_of.has(terms))
                terms, place = terms[some], place[some]
            elif terms_of is not None:
                some = np.flatnonzero(maybe[(mix(terms) >> shift).astype(np.int64)])
                at = np.minimum(np.searchsorted(terms_of, terms[some]), max(0, len(terms_of) - 1))
                some = some[terms_of[at] == terms[some]] if len(terms_of) else some[:0]
                terms, place = terms[some], place[some]
            order = np.argsort(terms, kind="stable")
            terms, place = terms[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task + k], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([blob(words.count.astype(np.int32))], pa.binary()),
                    pa.array([blob(terms[first])], pa.binary()),
                    pa.array([blob(np.append(first, len(terms)).astype(np.int32))], pa.binary()),
                    pa.array([blob(place.astype(np.int32))], pa.binary()),
                ],
                names=["segment", "docs", "n_words", "terms", "first", "places"],
            )

    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(segments), SEGMENT), "index")


class Postings:
    """One segment, read back."""

    def __init__(self, row: dict):
        self.segment, self.ids = row["segment"], row["docs"]
        self.n_words = np.frombuffer(row["n_words"], np.int32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.first = np.frombuffer(row["first"], np.int32).astype(np.int64)
        self.places = np.frombuffer(row["places"], np.int32).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n_words + WINDOW)])

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot and number of postings of each term; unknown: none."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        n = np.where(self.terms[at] == terms, self.first[at + 1] - self.first[at], 0)
        return at, n

    def phrases(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of each exact occurrence."""
        none = np.zeros(0, np.int64)
        if not len(tests.size) or not len(self.places):
            return none, none
        slot, n = self.of(tests.terms)
        inside = np.arange(tests.terms.shape[1]) < tests.size[:, None]
        n = np.where(inside, n, np.iinfo(np.int64).max)
        live = np.flatnonzero(n.min(axis=1) > 0)
        if not len(live):
            return none, none
        order = np.argsort(n[live], axis=1, kind="stable")
        lead, count = order[:, 0], n[live, order[:, 0]]
        window = np.repeat(np.arange(len(live)), count)
        within = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        place = self.places[np.repeat(self.first[slot[live, lead]], count) + within] - np.repeat(lead, count)
        held = np.full(int(self.base[-1]) + WINDOW, -1, np.int64)
        held[self.places] = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        ok = place >= 0
        window, place = window[ok], place[ok]
        for rank in range(1, tests.terms.shape[1]):  # the next rarest list, shifted
            if not len(window):
                break
            shift = order[window, rank]
            fits = (shift >= tests.size[live[window]]) | (held[np.minimum(place + shift, len(held) - 1)] == slot[live[window], shift])
            window, place = window[fits], place[fits]
        return live[window], place

    def documents_of(self) -> np.ndarray:
        """How many documents of the segment hold each of its terms."""
        if not len(self.places):
            return np.zeros(0, np.int64)
        doc = np.searchsorted(self.base, self.places, "right") - 1
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        new[self.first[:-1]] = True
        return np.add.reduceat(new.astype(np.int64), self.first[:-1])

    def near(self, tests: Tests) -> np.ndarray:
        """Distinct (document, item) of proximity matches, as two rows."""
        none = np.zeros((2, 0), np.int64)
        if tests.need is None or not len(self.places):
            return none
        slot, n = self.of(tests.rare)
        n = np.where(tests.rare > 0, n, 0)
        size = (tests.rare > 0).sum(axis=1)
        items = np.flatnonzero((tests.need > 0) & ((n > 0).sum(axis=1) >= tests.need))
        if not len(items):
            return none
        wide = int(self.base[-1]) + 2 * SPREAD + 2
        flat = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * wide + self.places
        out = [none]
        for rank in range(TERMS):  # centres: as many of the rarest terms as may be missing, and one
            some = items[rank <= (size - tests.need)[items]]
            count = n[some, rank]
            item = np.repeat(some, count)
            within = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            at = self.places[np.repeat(self.first[slot[some, rank]], count) + within]
            doc = np.searchsorted(self.base, at, "right") - 1
            lo, hi = np.maximum(at - SPREAD, self.base[doc]), np.minimum(at + SPREAD, self.base[doc] + self.n_words[doc] - 1)
            got = np.zeros(len(item), np.int64)
            for other in range(TERMS):
                t = slot[item, other] * wide
                got += (n[item, other] > 0) & (np.searchsorted(flat, t + hi, "right") > np.searchsorted(flat, t + lo, "left"))
            fits = got >= tests.need[item]
            out.append(np.stack([doc[fits], item[fits]]))
        return np.unique(np.concatenate(out, axis=1), axis=1)


def frequencies(segments: DataFrame, tests: Tests) -> dict[int, int]:
    """How many documents of the index hold each word of a block of tests."""
    sent = segments.sparkSession.sparkContext.broadcast(np.unique(np.array([h for own in tests.words for _, h in own], np.uint64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                post = Postings(row)
                slot, n = post.of(wanted)
                some = np.flatnonzero(n)
                total[some] += post.documents_of()[slot[some]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["term", "n"])

    rows = segments.mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"] & (2**64 - 1): r["n"] for r in rows}


def search(segments: DataFrame, tests: Tests) -> DataFrame:
    """A row per document of the index, with the spans of words that are hit (by
    word, end exclusive), the items whose windows occur, and those with a proximity
    match."""
    spark = segments.sparkSession
    sent = spark.sparkContext.broadcast(tests)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                post = Postings(row)
                window, place = post.phrases(tests)
                d = np.searchsorted(post.base, place, "right") - 1
                order = np.lexsort((place, d))
                window, place, d = window[order], place[order], d[order]
                cut = np.searchsorted(d, np.arange(len(post.ids) + 1))
                starts, ends, items = [], [], []
                close = [[] for _ in post.ids]
                for x, i in post.near(tests).T.tolist():
                    close[x].append(tests.items[i])
                for k in range(len(post.ids)):
                    a, b = cut[k], cut[k + 1]
                    if a == b:
                        starts.append([]), ends.append([]), items.append([])
                        continue
                    s = place[a:b] - post.base[k]
                    e = s + tests.size[window[a:b]]
                    top = np.maximum.accumulate(e)
                    new = np.concatenate([[True], s[1:] > top[:-1]])
                    starts.append(s[new].tolist())
                    ends.append(top[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)].tolist())
                    items.append([tests.items[i] for i in np.unique(tests.item[window[a:b]])])
                n = len(post.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, post.segment)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(post.ids, pa.int64()),
                        pa.array(post.n_words),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(ends, pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(close, pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "doc_id", "n_words", "starts", "ends", "items", "near"],
                )

    return segments.mapInArrow(lean(find), HITS)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document with spans and items, over the whole test set."""
    rows, n = _sized(benchmark)
    tests = block(rows, 0, n, window)
    segments = index(docs, tests.vocabulary if n == 1 else vocabulary_filter(rows))
    tests.weigh(frequencies(segments, tests))
    every = search(segments, tests)
    if n == 1:
        return every
    every = keep(every, "hits")
    for b in range(1, n):  # one block in the driver at a time
        tests = block(rows, b, n, window)
        tests.weigh(frequencies(segments, tests))
        every = every.unionByName(keep(search(segments, tests).where("size(starts) > 0 or size(near) > 0"), "hits"))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    own = every.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"), flat("items"), flat("near"))
    return own.mapInArrow(lean(_merged), HITS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            done: list[list[int]] = []
            for s, e in sorted((x["starts"], x["ends"]) for x in r.pop("spans")):
                if done and s <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], e)
                else:
                    done.append([s, e])
            r["starts"], r["ends"] = [x[0] for x in done], [x[1] for x in done]
        kinds = [("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    line = lambda c: F.sha2(F.array_join(F.array_sort(c), ","), 256)
    return (
        hits(docs, benchmark)
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), line("items").alias("items_sha256"), F.size("near").cast("long").alias("n_near"), line("near").alias("near_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(docs, table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
place AS MATERIALIZED (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM d),
df AS (SELECT t, count(DISTINCT doc_id) AS n FROM place GROUP BY t),
few AS (
  SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n, t) AS r FROM (SELECT DISTINCT item_id, unnest(w) AS t FROM b) JOIN df USING (t)
  QUALIFY r <= {TERMS}),
size AS (SELECT item_id, count(*) AS k, ceil({SHARE_NEAR} * count(*)) AS need FROM few GROUP BY item_id HAVING count(*) >= {LEAST}),
spot AS MATERIALIZED (SELECT item_id, k, need, r, t, doc_id, i FROM few JOIN size USING (item_id) JOIN place USING (t)),
close AS (
  SELECT DISTINCT item_id, doc_id FROM (
    SELECT a.item_id, a.doc_id, a.i, a.need, count(DISTINCT b.t) AS got
    FROM spot a JOIN spot b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.i BETWEEN a.i - {SPREAD} AND a.i + {SPREAD}
    WHERE a.r <= a.k - a.need + 1 GROUP BY ALL) WHERE got >= need),
nears AS (SELECT doc_id, count(*)::BIGINT AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS s FROM close GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256, coalesce(v.n_near, 0)::BIGINT AS n_near, sha256(coalesce(v.s, '')) AS near_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN nears v USING (doc_id)
"""
