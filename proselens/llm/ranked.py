"""Ranked lexical search with block-max pruning (operator 12).

The index is a row for each block: a range of at most `BLOCK` documents that stand
together.  A block has its documents' ids and sizes, its distinct terms in order, for each term
the greatest impact of any document (the block's maximum) and how many documents have
it, and forward postings: each document and how often it has the term.  The impact
is the part of a score that does not depend on the query, in whole numbers.  The index
holds all terms of all texts and serves any queries.

A search over one block of test items (bounded in words) broadcasts the items and
makes three passes.  The first adds up how many documents hold each term of the items,
which gives the weights.  The second reads terms and maxima only and bounds what a
block can score for each item; the blocks with the highest bounds of an item are its
seeds, and the 10th best score in them is a threshold that no later block may miss.
The third sorts the blocks that a task holds by an item's bound, scores them on the
forward postings and stops where the bound drops below the threshold, which rises
with what the task has found; a bound equal to it is scored, as ties go by doc_id.  The
tasks' best documents are ranked in the end.

Scores are sums of whole numbers: below 2^53 in doubles, which are then exact, and in
longs above.

Defined results: null or empty texts, and texts without terms, are not counted among
the documents and never found; items without terms have no rows; items that share an
id, or have none, are ranked each for itself; equal rows are ranked one after the
other, a null doc_id after all others of its score; very long texts are one
document of their block; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, lean, lookup, merged, table
from .kernel import ALNUM_WORD, LOWER, Words, blob, buffer, spans

#: documents of a block, rows of a result
BLOCK, TOP = 64, 10
#: bytes of text of test items that are broadcast at once
ITEM_BYTES = 1 << 20
#: blocks of an item that give its first threshold
SEEDS = 4
#: bytes of index rows that a task sorts by their bounds at once
HELD = 8 << 20
#: slope and base of the length normalisation, and the scale of impacts
LENGTH, BASE, SCALE = 75, 100, 1_000_000_000

INDEX = "block long, ids array<long>, sizes binary, terms binary, most binary, many binary, doc binary, tf binary"
_INDEX = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("sizes", "terms", "most", "many", "doc", "tf")]])
BEST = "item int, doc_id long, score long"
_BEST = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all terms with repeats."""

    docs: int
    terms: int


def corpus(docs: DataFrame) -> Corpus:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            data, offs = buffer(batch.column("text"))
            starts, _ = spans(ALNUM_WORD[LOWER[data]], offs)
            own = np.diff(np.searchsorted(starts, offs))
            n, total = n + int((own > 0).sum()), total + len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["docs", "terms"])

    row = docs.select("text").mapInArrow(lean(count), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return Corpus(row[0] or 0, row[1] or 0)


def impacts(tf: np.ndarray, n: np.ndarray, of: Corpus) -> np.ndarray:
    """(SCALE tf) div (1000 tf + 8 m) with m by the length n of the document."""
    if LENGTH * int(n.max(initial=0)) * of.docs < 1 << 63:
        m = BASE - LENGTH + LENGTH * n * of.docs // max(1, of.terms)
    else:
        m = np.array([BASE - LENGTH + LENGTH * int(x) * of.docs // of.terms for x in n])
    return SCALE * tf // (1000 * tf + 8 * m)


def index(docs: DataFrame, of: Corpus) -> DataFrame:
    """docs: doc_id, text.  The blocks, in the shared folder."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            words = Words.of(batch.column("text"), ALNUM_WORD)
            ids, out = batch.column("doc_id").to_pylist(), []
            for lo in range(0, batch.num_rows, BLOCK):
                hi = min(lo + BLOCK, batch.num_rows)
                a, b = words.first[lo], words.first[hi]
                if a == b:
                    continue
                terms, place = np.unique(words.hash[a:b], return_inverse=True)
                pair, tf = np.unique(place * BLOCK + (words.doc[a:b] - lo), return_counts=True)
                term, doc = pair // BLOCK, pair % BLOCK
                size = words.count[lo:hi].astype(np.int64)
                first = np.searchsorted(term, np.arange(len(terms) + 1))
                most = np.maximum.reduceat(impacts(tf, size[doc], of), first[:-1])
                out.append((at, ids[lo:hi], blob(size), blob(terms), blob(most.astype(np.int32)), blob(np.diff(first).astype(np.uint8)), blob(doc.astype(np.uint8)), blob(tf.astype(np.uint32))))
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _INDEX)], schema=_INDEX)

    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(blocks), INDEX), "index")


class Items:
    """Test items as a sparse matrix: for each distinct term, in order, its items and
    how often they have it."""

    def __init__(self, texts: list[str | None]):
        words = Words.of(pa.array(texts, pa.string()), ALNUM_WORD)
        self.n = len(texts)
        self.terms, place = np.unique(words.hash, return_inverse=True)
        pair, self.times = np.unique(place * max(1, self.n) + words.doc, return_counts=True)
        self.item = pair % max(1, self.n)
        self.first = np.searchsorted(pair // max(1, self.n), np.arange(len(self.terms) + 1))
        self.weight, self.exact, self.corpus = self.times, False, Corpus(0, 0)

    def weigh(self, found_in: np.ndarray, of: Corpus) -> None:
        """Weights from how many documents hold each term."""
        self.corpus = of
        w = np.array([math.floor(1000 * math.log((2 * of.docs + 2) / (2 * df + 1))) for df in found_in.tolist()], np.int64)
        self.weight = self.times * np.repeat(w, np.diff(self.first))
        total = np.bincount(self.item, self.weight, self.n)
        self.exact = bool(total.max(initial=0) * (SCALE // 1000) < 1 << 53)
        if self.exact:
            self.weight = self.weight.astype(np.float64)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's terms the items have: their places in the block and here."""
        at = np.searchsorted(terms, self.terms)
        here = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == self.terms)
        return at[here], here

    def entries(self, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix entries of some terms: the term (a place in `here`) and the entry."""
        many = self.first[here + 1] - self.first[here]
        row = np.repeat(np.arange(len(here)), many)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[here], many)

    def bounds(self, block: dict) -> np.ndarray:
        """The most that a document of the block can score for each item."""
        at, here = self.of(np.frombuffer(block["terms"], np.uint64))
        row, entry = self.entries(here)
        most = np.frombuffer(block["most"], np.int32)[at][row]
        if self.exact:
            return np.bincount(self.item[entry], self.weight[entry] * most, self.n).astype(np.int64)
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.item[entry], self.weight[entry] * most)
        return out

    def scores(self, block: dict, some: np.ndarray) -> np.ndarray:
        """Documents x items: the scores of all documents of a block for some items."""
        at, here = self.of(np.frombuffer(block["terms"], np.uint64))
        every = np.frombuffer(block["many"], np.uint8).astype(np.int64)
        many, first = every[at], (np.cumsum(every) - every)[at]
        row = np.repeat(np.arange(len(at)), many)
        post = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        kind = np.float64 if self.exact else np.int64
        have = np.zeros((len(block["ids"]), len(at)), kind)
        doc = np.frombuffer(block["doc"], np.uint8)[post]
        tf = np.frombuffer(block["tf"], np.uint32)[post].astype(np.int64)
        have[doc, row] = impacts(tf, np.frombuffer(block["sizes"], np.int64)[doc], self.corpus)
        column = np.full(self.n, -1)
        column[some] = np.arange(len(some))
        term, entry = self.entries(here)
        asked = column[self.item[entry]]
        want = np.zeros((len(at), len(some)), kind)
        want[term[asked >= 0], asked[asked >= 0]] = self.weight[entry[asked >= 0]]
        return (have @ want).astype(np.int64)


class Best:
    """The best documents of each item so far, and the threshold that they set."""

    def __init__(self, least: np.ndarray):
        self.least = least.copy()  # what a document must score to matter
        self.rows: dict[int, list[tuple[int, bool, int]]] = {}  # -score, no id, id

    def add(self, item: int, ids: list[int | None], scores: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.least[item])
        if len(some):
            rows = sorted([*self.rows.get(item, []), *[(-int(scores[d]), ids[d] is None, ids[d] or 0) for d in some]])[:TOP]
            self.rows[item] = rows
            if len(rows) == TOP:
                self.least[item] = max(self.least[item], -rows[-1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(k, None if no else i, -s) for k, own in self.rows.items() for s, no, i in own]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_BEST)], schema=_BEST)


def found_in(blocks: DataFrame, items: Items) -> np.ndarray:
    """How many documents hold each term of the items."""
    sent = blocks.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value.terms), np.int64)
        for batch in batches:
            for terms, many in zip(batch.column("terms").to_pylist(), batch.column("many").to_pylist()):
                at, here = sent.value.of(np.frombuffer(terms, np.uint64))
                total[here] += np.frombuffer(many, np.uint8)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "docs"])

    out = np.zeros(len(items.terms), np.int64)
    for r in blocks.select("terms", "many").mapInArrow(lean(count), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[r["term"]] = r["docs"]
    sent.unpersist()
    return out


def seeds(blocks: DataFrame, items: Items) -> DataFrame:
    """(item, block): the blocks with the highest bounds of each item."""
    sent = blocks.sparkSession.sparkContext.broadcast(items)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, where = np.zeros((0, sent.value.n), np.int64), np.zeros((0, sent.value.n), np.int64)
        for batch in batches:
            rows = batch.to_pylist()
            most = np.concatenate([most, *[sent.value.bounds(r)[None] for r in rows]])
            where = np.concatenate([where, np.repeat(np.array([[r["block"]] for r in rows]), sent.value.n, axis=1)])
            order = np.argsort(-most, axis=0, kind="stable")[:SEEDS]
            most, where = np.take_along_axis(most, order, 0), np.take_along_axis(where, order, 0)
        row, item = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(most[row, item]), pa.array(where[row, item])], names=["item", "bound", "block"])

    rows = blocks.select("block", "terms", "most").mapInArrow(lean(bound), "item long, bound long, block long")
    first = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "block"))
    out = keep(rows.withColumn("r", first).where(F.col("r") <= SEEDS).select("item", "block"), "seeds", SEEDS * items.n)
    sent.unpersist()
    return out


def ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def scored(blocks: DataFrame, items: Items, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): what each task finds best, of documents that score `least`
    or more.  A column `asked` (items), if there is one, says which items a block is
    scored for."""
    sent = blocks.sparkSession.sparkContext.broadcast((items, least))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = sent.value[0], Best(sent.value[1])
        for batch in merged(batches, HELD):
            rows = batch.to_pylist()
            bounds = np.stack([items.bounds(r) for r in rows])
            for k, r in enumerate(rows):
                if "asked" in r:
                    bounds[k, np.setdiff1d(np.arange(items.n), r["asked"])] = 0
            # blocks by their best bound, and in a block the items whose bound still counts
            for k in np.argsort(-bounds.max(axis=1), kind="stable"):
                some = np.flatnonzero(bounds[k] >= best.least)
                for lo in range(0, len(some), 256):
                    part = some[lo : lo + 256]
                    got = items.scores(rows[k], part)
                    for column in np.flatnonzero((got >= best.least[part]).any(axis=0)):
                        best.add(int(part[column]), rows[k]["ids"], got[:, column])
        yield best.batch()

    return blocks.mapInArrow(lean(score), BEST)


def found(blocks: DataFrame, items: Items, of: Corpus) -> DataFrame:
    """item, rank, doc_id, score, in the shared folder."""
    items.weigh(found_in(blocks, items), of)
    first = seeds(blocks, items).groupBy("block").agg(F.collect_list(F.col("item").cast("int")).alias("asked"))
    tried = ranked(scored(blocks.join(F.broadcast(first), "block").select(*blocks.columns, "asked"), items, np.ones(items.n, np.int64)))
    least = np.ones(items.n, np.int64)
    for r in tried.where(F.col("rank") == TOP).select("item", "score").collect():
        least[r["item"]] = r["score"]
    return keep(ranked(scored(blocks, items, least)), "found", TOP * items.n)


def searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text.  item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    of = corpus(docs)
    blocks = index(docs, of)
    rows = keep(benchmark.select(F.monotonically_increasing_id().alias("i"), "item_id", "text"), "items")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    n = max(1, -(-int(rows.agg(F.sum(size)).first()[0] or 0) // ITEM_BYTES))
    out = []
    for b in range(n):
        own = [(r["i"], r["text"]) for r in (rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b) if n > 1 else rows).select("i", "text").collect()]
        if own:
            names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(own)], "item int, i long")
            best = found(blocks, Items([t for _, t in own]), of)
            out.append(best.join(F.broadcast(names), "item").select("i", "rank", "doc_id", "score"))
    if not out:
        return rows.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = reduce(DataFrame.unionByName, out)
    return lookup(every.alias("f"), rows.select("i", "item_id").alias("r"), F.col("f.i") == F.col("r.i"), "inner").select("r.item_id", "f.rank", "f.doc_id", "f.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT row, t, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, n),
q AS (SELECT item, t, count(*)::BIGINT AS times FROM (SELECT item, unnest(t) AS t FROM b) GROUP BY ALL),
m AS (SELECT row, doc_id, 100 - 75 + (75 * len(t) * n) // l AS m FROM d, s WHERE len(t) > 0),
r AS (
  SELECT q.item, m.row, m.doc_id, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (row) GROUP BY ALL)
SELECT b.item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST))::INT AS rank, doc_id, score
FROM r JOIN b USING (item) WHERE score > 0 QUALIFY rank <= 10
"""
