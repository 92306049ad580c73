"""Personal data and terms that reveal it (operator 8).

Entities are e-mail addresses, IP addresses, card numbers and phone numbers, found
by rules.  Terms are words of the documents that hold an entity, wherever they
stand.  Over the whole corpus, n(t) documents hold the term, n(e) the entity, and
n(t, e) both.  A term discloses the share

    log2(N n(t, e) / (n(t) n(e))) / log2(N / n(e))

of an entity's information; 1 means that it never occurs without it.  Terms whose
share passes `DISCLOSE` for some entity, seen together in at least `SUPPORT`
documents, are sanitised wherever they occur; above `REMOVE` they are removed,
below generalised.

The share asks for n(t) <= n(e) (N / n(e)) ** (1 - DISCLOSE).  So pairs are not
formed with words that are known to be in more documents: the sum of a word's
documents over those batches that have it in `OFTEN` or more is a bound from below.
Entities in fewer than `SUPPORT` documents have no terms.  Both tests lose nothing;
what is left is counted exactly.  Bloom filters of fixed greatest size hold the
entities with the level of their count, and the terms; joins make them exact.

Defined results: null text is empty and has no spans; adjacent matches of a kind
are apart; a term span that overlaps a base span is left out; repeated rows count
as documents each and get equal spans; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import filter_of
from .common import is_small, keep, lean, lean_group, lookup, parts_for, table
from .kernel import ALNUM_WORD, Words, blob, buffer, code_points, unblob

KINDS = ("email", "ip", "card", "phone")
SUPPORT, DISCLOSE, REMOVE = 3, 0.9, 0.97
#: documents of a batch from which on a word is counted as frequent, and words that
#: are broadcast as such (more would only spare more work)
OFTEN, FREQUENT = 4, 1 << 18

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: an address
    starts where the run of local characters before its @ does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each chain of numbers and dots."""
    for chain in _NUMBERS.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones)))


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start, in code points."""
    digits = any("0" <= c <= "9" for c in text) if len(text) < 64 else re.search("[0-9]", text) is not None
    return [(kind, s, e) for kind, find in FINDERS.items() if (digits or kind == "email") for s, e in find(text)]


SPAN = "struct<kind:string,start:int,end:int>"
FOUND = f"doc_id long, text_hash long, spans array<{SPAN}>, entities array<long>, words array<struct<t:long,n:long>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_WORD = pa.struct([("t", pa.int64()), ("n", pa.int64())])


def marked(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, and which texts have a digit or an @."""
    data, offs = buffer(col)
    marks = np.concatenate([[0], np.cumsum((data == 0x40) | ((data >= 0x30) & (data <= 0x39)))])
    return data, offs, np.flatnonzero(marks[offs[1:]] > marks[offs[:-1]])


def names_of(text: str, got: list[tuple[str, int, int]]) -> np.ndarray:
    """A hash of each entity, whatever its case."""
    return Words.of(pa.array([text[s:e] for _, s, e in got]), np.ones(256, bool)).hash


def in_documents(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text of a batch: text and hash, by text."""
    order = np.lexsort((words.hash, words.doc))
    doc, own = words.doc[order], words.hash[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]) if len(own) else np.zeros(0, bool)
    return doc[new], own[new]


def found(docs: DataFrame) -> DataFrame:
    """A row per document: base spans and the hashes of its entities (distinct); the
    first of each batch has the words that many documents of the batch hold."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, some = marked(batch.column("text"))
            n = len(offs) - 1
            spans: list = [[] for _ in range(n)]
            names: list = [[] for _ in range(n)]
            for d in some:
                text = data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")
                got = entities(text)
                if got:
                    spans[d] = [{"kind": k, "start": s, "end": e} for k, s, e in got]
                    names[d] = np.unique(names_of(text, got).view(np.int64)).tolist()
            t, many = np.unique(in_documents(Words.of(batch.column("text"), ALNUM_WORD))[1], return_counts=True)
            often = np.flatnonzero(many >= OFTEN)
            words: list = [[] for _ in range(n)]
            if n:
                words[0] = [{"t": a, "n": b} for a, b in zip(t[often].view(np.int64).tolist(), many[often].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(spans, pa.list_(_SPAN)), pa.array(names, pa.list_(pa.int64())), pa.array(words, pa.list_(_WORD))], names=["doc_id", "text_hash", "spans", "entities", "words"])

    return keep(hashed(docs).mapInArrow(lean(look), FOUND), "entities")


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


COUNTS = "part int, e binary, t binary, n binary"
#: keys that a task holds before it passes their counts on
FLUSH = 1_000_000


def _summed(e: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up by (t, e), in that order."""
    order = np.lexsort((e, t))
    e, t, n = e[order], t[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (e[1:] != e[:-1])])) if len(t) else np.zeros(0, np.int64)
    return e[new], t[new], np.add.reduceat(n, new) if len(new) else n


def counted(texts: DataFrame, of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], parts: int, least: int = 1) -> DataFrame:
    """(e, t, n): how many documents give each (e, t).  of: a batch's pairs, one for
    each document that has it.  Tasks add up what they see and pass it on packed, a
    row for each range of t; a range is one group, and pairs below `least` end there."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        e, t, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        part = (t >> np.uint64(64 - parts)).astype(np.int64)
        cut = np.searchsorted(part, np.arange((1 << parts) + 1))
        full = np.flatnonzero(np.diff(cut))
        packed = lambda x: pa.array([blob(x[cut[p] : cut[p + 1]]) for p in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), packed(e), packed(t), packed(n.astype(np.int64))], names=["part", "e", "t", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            e, t = of(batch)
            held.append((e, t, np.ones(len(t), np.int64)))
            size += len(t)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def add(rows: pa.Table) -> pa.Table:
        e, t, n = _summed(*(unblob(rows.column(x), kind) for x, kind in (("e", np.uint64), ("t", np.uint64), ("n", np.int64))))
        some = np.flatnonzero(n >= least)
        return pa.table({"e": e[some].view(np.int64), "t": t[some].view(np.int64), "n": n[some]})

    rows = texts.mapInArrow(lean(count), COUNTS)
    return rows.groupBy("part").applyInArrow(lean_group(add), "e long, t long, n long")


def limits(levels: np.ndarray, total: int) -> np.ndarray:
    """The most documents that a term of an entity may be in, from the level of the
    entity's count: level k stands for fewer than 2**k documents."""
    most = np.minimum(2.0 ** np.minimum(levels, 60), total)
    return most * (total / most) ** (1 - DISCLOSE) * (1 + 1e-9)


def together(docs: DataFrame, base: DataFrame, holders: DataFrame, total: int, parts: int) -> DataFrame:
    """(e, t, both): documents that hold an entity of `holders` and a term."""
    spark = docs.sparkSession
    rows = base.where(F.size("words") > 0).select(F.explode("words").alias("w")).groupBy("w.t").agg(F.sum("w.n").alias("n"))
    often = rows.where(F.col("n") > float(limits(np.array([2]), total)[0])).orderBy(F.desc("n"), "t").limit(FREQUENT).collect()
    often.sort(key=lambda r: r["t"] & (2**64 - 1))
    frequent = np.array([r["t"] for r in often], np.int64).view(np.uint64)
    at_least = np.array([r["n"] for r in often], np.float64)
    level = holders.select(F.col("e").alias("key"), F.length(F.bin("n_e")).alias("level"))
    known = filter_of(level, int(level.agg(F.sum("level")).first()[0]))
    sent = spark.sparkContext.broadcast((known, frequent, at_least))

    def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        known, frequent, at_least = sent.value
        data, offs, some = marked(batch.column("text"))
        es, ts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for d in some:
            own = data[offs[d] : offs[d + 1]]
            text = own.tobytes().decode("utf-8", "replace")
            got = entities(text)
            if not got:
                continue
            names = np.unique(names_of(text, got))
            levels = known.level(names, 62)
            names, most = names[levels > 0], limits(levels[levels > 0], total)
            if not len(names):
                continue
            words = Words(own, np.array([0, len(own)]), ALNUM_WORD)
            points = code_points(own)
            starts, ends = points[words.starts], points[words.ends]
            free = np.ones(len(starts), bool)
            for _, s, e in got:
                free[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = False
            terms = np.unique(words.hash[free])
            at = np.minimum(np.searchsorted(frequent, terms), max(0, len(frequent) - 1))
            least = np.where(frequent[at] == terms, at_least[at], 0) if len(frequent) else np.zeros(len(terms))
            e, t = np.nonzero(least[None, :] <= most[:, None])
            es.append(names[e]), ts.append(terms[t])
        return np.concatenate(es), np.concatenate(ts)

    return counted(docs.select("text"), pairs, parts, SUPPORT).withColumnRenamed("n", "both")


def frequencies(docs: DataFrame, terms: DataFrame, parts: int) -> DataFrame:
    """(t, n): the number of documents with each of the terms (column t)."""
    known = docs.sparkSession.sparkContext.broadcast(filter_of(terms.select(F.col("t").alias("key")), terms.count()))

    def those(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = in_documents(Words.of(batch.column("text"), ALNUM_WORD))[1]
        own = own[known.value.has(own)]
        return np.zeros(len(own), np.uint64), own

    rows = keep(counted(docs.select("text"), those, parts), "seen")
    return lookup(rows.alias("r"), terms.alias("t"), F.col("r.t") == F.col("t.t"), "left_semi").select("t", "n")


def revealing(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(t, share): terms that disclose an entity beyond the threshold."""
    total = base.count()
    parts = parts_for(int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    holders = base.where(F.size("entities") > 0).select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    holders = keep(holders.where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < total)), "holders")
    none = docs.sparkSession.createDataFrame([], "t long, share double")
    if not holders.limit(1).count():
        return none
    both = keep(lookup(together(docs, base, holders, total, parts).alias("b"), holders.alias("h"), F.col("b.e") == F.col("h.e"), "inner").select("b.e", "b.t", "b.both", "h.n_e"), "pairs")
    terms = keep(both.select("t").distinct(), "terms")
    if not terms.limit(1).count():
        return none
    seen = frequencies(docs, terms, parts)
    share = F.log2(F.lit(float(total)) * F.col("both") / (F.col("n") * F.col("n_e"))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    rows = both.join(seen, "t").withColumn("share", share)
    return keep(rows.where(F.col("share") >= DISCLOSE).groupBy("t").agg(F.max("share").alias("share")), "revealing")


TERMS = f"doc_id long, text_hash long, terms array<{SPAN}>"


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms): where the revealing terms occur, a row for each
    document that has one.  Terms few enough to be broadcast are matched in place;
    more are matched by a Bloom filter and a join."""
    few = is_small(terms)
    if few:
        rows = sorted(((r["t"] & (2**64 - 1), r["share"] >= REMOVE) for r in terms.collect()))
        known = (np.array([t for t, _ in rows], np.uint64), np.array([x for _, x in rows], bool))
    else:
        known = filter_of(terms.select(F.col("t").alias("key")), terms.count())
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, hash, start and end of each term, and whether it is to go."""
        words, known = Words.of(batch.column("text"), ALNUM_WORD), sent.value
        if isinstance(known, tuple):
            at = np.minimum(np.searchsorted(known[0], words.hash), len(known[0]) - 1)
            some = np.flatnonzero(known[0][at] == words.hash)
            gone = known[1][at[some]]
        else:
            some = np.flatnonzero(known.has(words.hash))
            gone = np.zeros(len(some), bool)
        points, doc = code_points(words.data), words.doc[some]
        own = points[words.offs[doc]]
        return doc, words.hash[some], points[words.starts[some]] - own, points[words.ends[some]] - own, gone

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, _, start, end, gone = places(batch)
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays([pa.array(np.where(gone, "term", "hint"), pa.string()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(_SPAN))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), spans)
            who = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("text_hash").take(who), lists], names=["doc_id", "text_hash", "terms"])

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, own, start, end, _ = places(batch)
            who = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("text_hash").take(who), pa.array(own.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "text_hash", "t", "start", "end"])

    if few:  # rows that share an id and a text have the same spans
        return hashed(docs).mapInArrow(lean(packed), TERMS).dropDuplicates(["doc_id", "text_hash"])
    rows = hashed(docs).mapInArrow(lean(loose), "doc_id long, text_hash long, t long, start int, end int")
    kind = F.when(F.col("share") >= REMOVE, F.lit("term")).otherwise(F.lit("hint"))
    rows = rows.join(terms, "t").select("doc_id", "text_hash", F.struct(kind.alias("kind"), "start", "end").alias("span"))
    return rows.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_hash, spans (base), terms (revealing)."""
    base = found(docs)
    terms = revealing(docs, base)
    if not terms.limit(1).count():
        return base.select("doc_id", "text_hash", "spans", F.array().cast(f"array<{SPAN}>").alias("terms"))
    more = keep(term_spans(docs, terms), "terms")
    on = F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_hash") == F.col("m.text_hash"))
    ordered = F.array_sort("m.terms")
    apart = F.filter(ordered, lambda t: ~F.exists("b.spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return base.alias("b").join(more.alias("m"), on, "left").select("b.doc_id", "b.text_hash", "b.spans", F.coalesce(apart, F.array().cast(f"array<{SPAN}>")).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text): base spans become [EMAIL] and so on, hints become [TERM],
    and terms that give an entity away are removed."""

    @F.arrow_udf("string")
    def rewrite(text: pa.Array, spans_: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for t, s, m in zip(text.to_pylist(), spans_.to_pylist(), terms.to_pylist()):
            done, parts = 0, []
            for x in sorted([*(s or []), *(m or [])], key=lambda x: (x["start"], -x["end"])):
                if x["start"] >= done:
                    name = {"term": "", "hint": "[TERM]"}.get(x["kind"], f"[{x['kind'].upper()}]")
                    parts += [t[done : x["start"]], name]
                    done = x["end"]
            out.append(None if t is None else "".join([*parts, t[done:]]))
        return pa.array(out, pa.string())

    own = spans(docs).dropDuplicates(["doc_id", "text_hash"]).alias("s")
    rows = hashed(docs).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    return rows.join(own, on).select("d.doc_id", rewrite("d.text", "s.spans", "s.terms").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda xs: F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(line("spans"), ",")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(line("spans"), line("terms")), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))
