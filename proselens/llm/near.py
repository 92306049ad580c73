"""Jaccard join on word shingles, by several global orders (operator 4).

Documents are sets of five-word shingles; two link when their Jaccard similarity
is 0.75 or more.  The join is exact:

1. Overlap filter.  In the order of their hashes, two sets that link share k
   tokens within their first n - ceil(0.75 n) + k; here k is a twelfth of n.  These
   prefixes (a third of all tokens) meet by token; a document that shares fewer
   than the k that its smallest partner may have cannot link and is done.
2. Equal sets become one class, represented by its smallest doc_id.  Only
   representatives go on.
3. Prefix filter by rarity.  The tokens of the representatives are counted.  In an
   order that begins with the rarest, a document with more unique tokens than its
   prefix is long cannot link.  The others get prefixes under three orders: rarest
   first with ties by hash, rarest first with ties by another hash, and a random
   order.
4. Documents that share a prefix token of the first order are joined in blocks
   (connected components over star edges, one star for each token, not all pairs).
5. In a block, documents are visited breadth first: the candidates of a document
   are those not yet reached that share a prefix token under every order and fit
   in length; they are verified on their whole sets.  As reached documents drop
   out, a block of near copies costs about one pass and not all pairs.

6. A block of more than `BLOCK` documents is not given to one task.  One star edge
   of each document is verified as a row, then all star edges of the documents
   outside of the block's largest tied part; that ties groups of near copies
   together.  For what is still apart, tokens that the same documents hold become one
   class; two documents that link share a class in their prefixes by rarity and one in
   their prefixes by a random order of the classes.  Documents meet under the first
   class alone if at most `BLOCK` hold it, else under both classes as one key, so only
   pairs that pass both filters are formed; each is verified once as a row.  Documents
   of more than `KEYS` keys, which are near copies with edits of their own, are cut into
   tiles of about `BLOCK` by size and hash instead; a task holds two tiles of fitting
   sizes, and what links in them is joined.

Chunks of documents travel as packed arrays, one row for each range of hashes.  A
token that several documents of a chunk share travels once, so what everybody
has costs a number for each chunk and not for each document.

Defined results: null or empty texts, and texts without words, have no shingles
and link with nothing; a text of one to four words has one shingle, the whole
sequence; equal rows link with each other; component_id is the smallest doc_id
that is not null among those linked (the own doc_id if there is none); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import filter_of
from .common import chunk_bytes, is_small, keep, lean, lean_group, lookup, merged, parts_for, table
from .kernel import SPACE_WORD, Bits, Words, blob, mix, ngrams, sequence_hash, unblob

WORDS = 5
#: links are pairs with UP * intersection >= AT * union
UP, AT = 100, 75
#: k is n // SPARE + 1 in the overlap filter
SPARE = 12
#: documents of a block that one task verifies
BLOCK = 256
#: keys of a document that has few classes
KEYS = 256
#: documents of one key whose pairs one task forms (rows of a few numbers)
MEET = 2048
#: shingles that a task packs before it passes them on
FLUSH = 400_000
_SALT = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D))


def sets_of(col: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles."""
    words = Words.of(col, SPACE_WORD)
    grams = ngrams(words.hash, WORDS)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= WORDS:
            own = np.sort(grams[a : b - WORDS + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            yield np.array([sequence_hash(words.hash[a:b])] if b > a else [], np.uint64)


def signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    return tuple(int((mix(own ^ s)).sum(dtype=np.uint64).view(np.int64)) for s in _SALT)  # type: ignore[return-value]


def least(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(0.75 n): what a partner must share."""
    return -(-n * AT // UP)


def prefix(n: int) -> int:
    return n - least(n) + 1


PACKED = "part int, chunk long, a binary, b binary, c binary, ids array<long>"
_PACKED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("ids", pa.list_(pa.int64()))])
#: in place of a document: a token that several documents of the chunk have
SEVERAL = np.uint32(0xFFFFFFFF)


def _packed(chunk: int, parts: int, tokens: np.ndarray, marks: np.ndarray, facts: np.ndarray, ids: list, sets: bytes = b"") -> pa.RecordBatch:
    """Rows of tokens, each with its mark, by range of hashes (low bits, as prefixes
    hold the small ones), and one of facts about the documents, with a negative part."""
    part = (tokens & np.uint64((1 << parts) - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    tokens, marks, part = tokens[order], marks[order].astype(np.uint32), part[order]
    cut = np.searchsorted(part, np.arange((1 << parts) + 1))
    full = np.flatnonzero(np.diff(cut)).tolist()
    n = len(full)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*full, -1 - int(mix(np.array([chunk], np.uint64))[0] % np.uint64(1 << parts))], pa.int32()),
            pa.array([chunk] * (n + 1), pa.int64()),
            pa.array([*[blob(tokens[cut[p] : cut[p + 1]]) for p in full], blob(facts)], pa.binary()),
            pa.array([*[blob(marks[cut[p] : cut[p + 1]]) for p in full], sets], pa.binary()),
            pa.array([None] * (n + 1), pa.binary()),
            pa.array([*[None] * n, ids], pa.list_(pa.int64())),
        ],
        schema=_PACKED,
    )


def _replied(t: pa.Table, counts: bool) -> pa.Table:
    """Which tokens of a range more than one document has.  Marks are documents (or
    SEVERAL): for each chunk the documents and how many such tokens each has, beside
    those of SEVERAL.  Marks are counts: for each chunk the tokens and their counts."""
    rows = t.to_pylist()
    if not rows or rows[0]["part"] < 0:
        return t
    tokens = [np.frombuffer(r["a"], np.uint64) for r in rows]
    marks = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows])
    distinct, place = np.unique(np.concatenate(tokens), return_inverse=True)
    n = np.bincount(place, marks if counts else None, len(distinct)).astype(np.int64)
    out, at = [], 0
    for r, own in zip(rows, tokens):
        df, mark = n[place[at : at + len(own)]], marks[at : at + len(own)]
        at += len(own)
        some = np.flatnonzero(df > 1 if counts else (df > 1) & (mark != SEVERAL))
        if not len(some):
            continue
        if counts:
            a, b = blob(own[some]), blob(df[some])
        else:
            who, many = np.unique(mark[some], return_counts=True)
            a, b = blob(who), blob(many.astype(np.uint32))
        out.append({"part": r["part"], "chunk": r["chunk"], "a": a, "b": b, "c": None, "ids": None})
    return pa.Table.from_pylist(out, _PACKED)


def states(docs: DataFrame, parts: int) -> DataFrame:
    """A row per document: doc_id, n (shingles), s1, s2 (signature), alive (passed
    the overlap filter)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(merged(batches, chunk_bytes(parts))):
            facts = np.zeros((batch.num_rows, 5), np.int64)
            seen: dict[tuple[int, int], int] = {}
            tokens, local = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for d, own in enumerate(sets_of(batch.column("text"))):
                n = len(own)
                if not n:
                    continue
                sig = signature(own)
                first = seen.setdefault(sig, d)
                facts[d, :4] = n, *sig, first != d
                if first != d:
                    facts[first, 3] = 1  # equal sets in one chunk: sent once, and alive
                    continue
                p = min(n, n - least(n) + n // SPARE + 1)
                tokens.append(own[:p])
                local.append(np.full(p, d))
            every, doc = np.concatenate(tokens), np.concatenate(local)
            distinct, first, place, n = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
            facts[:, 4] = np.bincount(doc, n[place] > 1, len(facts))
            yield _packed(task + k, parts, distinct, np.where(n > 1, SEVERAL, doc[first]), facts, batch.column("doc_id").to_pylist())

    def finish(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        top = next(r for r in rows if r["part"] < 0)
        facts = np.frombuffer(top["a"], np.int64).reshape(-1, 5)
        shared = facts[:, 4].copy()
        for r in rows:
            if r["part"] >= 0:
                np.add.at(shared, np.frombuffer(r["a"], np.uint32), np.frombuffer(r["b"], np.uint32))
        alive = (facts[:, 3] > 0) | (facts[:, 0] > 0) & (shared >= least(facts[:, 0]) // SPARE + 1)
        return pa.table({"doc_id": pa.array(top["ids"], pa.int64()), "n": facts[:, 0], "s1": facts[:, 1], "s2": facts[:, 2], "alive": alive})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(scan), PACKED)
    rows = rows.groupBy("part").applyInArrow(lean_group(lambda t: _replied(t, False)), PACKED)
    return keep(rows.groupBy("chunk").applyInArrow(finish, "doc_id long, n long, s1 long, s2 long, alive boolean"), "states")


CANDIDATE = "node long, s1 long, s2 long, n long, tokens binary, first binary, second binary, third binary"


def candidates(docs: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """Representatives that rarity does not rule out, with sets and prefixes.
    classes: s1, s2, doc_id (the representative's)."""
    spark = docs.sparkSession
    known = filter_of(classes.select(F.coalesce("doc_id", F.lit(-1)).alias("id")).select(_mixed("id").alias("key")), classes.count())
    sent = spark.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            facts = np.array([[len(own), *signature(own)] for _, own in held], np.int64).reshape(-1, 3)
            tokens = np.concatenate([own for _, own in held])
            distinct, n = np.unique(tokens, return_counts=True)
            return _packed(task + k, parts, distinct, n, facts, [i for i, _ in held], blob(tokens))

        for batch in batches:
            some = np.flatnonzero(sent.value.has(batch.column("key").to_numpy().view(np.uint64)))
            if not len(some):
                continue
            ids = batch.column("doc_id").to_pylist()
            for d, own in zip(some.tolist(), sets_of(batch.column("text").take(pa.array(some)))):
                if len(own):
                    held.append((ids[d], own))
                    size += len(own)
                if size >= FLUSH:
                    yield flush()
                    held, size, k = [], 0, k + 1
        if held:
            yield flush()

    def finish(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        top = next(r for r in rows if r["part"] < 0)
        facts = np.frombuffer(top["a"], np.int64).reshape(-1, 3)
        tokens = np.frombuffer(top["b"], np.uint64)
        token, count = (np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[x], kind) for r in rows if r["part"] >= 0]]) for x, kind in (("a", np.uint64), ("b", np.int64)))
        order = np.argsort(token)
        token, count = token[order], count[order]
        start = np.concatenate([[0], np.cumsum(facts[:, 0])])
        out = []
        for d, (n, s1, s2) in enumerate(facts.tolist()):
            own = tokens[start[d] : start[d + 1]]
            at = np.minimum(np.searchsorted(token, own), max(0, len(token) - 1))
            hit = token[at] == own if len(token) else np.zeros(n, bool)
            h, f = own[hit], count[at[hit]] if len(token) else count
            room = prefix(n) - (n - len(h))  # unique tokens come first
            if room <= 0:
                continue
            first, second = h[np.lexsort((h, f))[:room]], h[np.lexsort((mix(h), f))[:room]]
            third = own[np.argsort(mix(own ^ _SALT[0]))[: prefix(n)]]
            out.append({"node": (top["chunk"] >> 32 << 43) + ((top["chunk"] & 0xFFFFFFFF) << 20) + d, "s1": s1, "s2": s2, "n": n, "tokens": blob(own), "first": blob(first), "second": blob(second), "third": blob(third)})
        return pa.Table.from_pylist(out, pa.schema([(x, pa.int64()) for x in ("node", "s1", "s2", "n")] + [(x, pa.binary()) for x in ("tokens", "first", "second", "third")]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _mixed("doc_id").alias("key")).mapInArrow(lean(scan), PACKED)
    rows = rows.groupBy("part").applyInArrow(lean_group(lambda t: _replied(t, True)), PACKED)
    rows = rows.groupBy("chunk").applyInArrow(lean_group(finish), CANDIDATE)
    exact = classes.select("s1", "s2")
    return keep(rows.join(F.broadcast(exact) if is_small(exact) else exact, ["s1", "s2"], "left_semi"), "candidates")


def _mixed(name: str):  # type: ignore[no-untyped-def]
    return F.xxhash64(F.coalesce(F.col(name).cast("long"), F.lit(-1)))


def stars(found: DataFrame, rows: int) -> DataFrame:
    """Edges (low, node): each prefix token ties its documents to the smallest.  rows:
    about how many prefix tokens there are."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.frombuffer(x, np.int64) for x in batch.column("first").to_pylist()]
            node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *first])), pa.array(node)], names=["token", "node"])

    posts = found.select("node", "first").mapInArrow(lean(unpack), "token long, node long")
    low = keep(posts.groupBy("token").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "low", rows)
    both = lookup(posts.alias("p"), low.alias("l"), F.col("p.token") == F.col("l.token"), "inner")
    return keep(both.where("p.node > l.low").select("l.low", "p.node").distinct(), "stars", rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, block) for all nodes of edges (low, node): the smallest node that
    edges lead to.  Small-star and large-star steps in turn; each step is written."""
    while True:
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("node").alias("low"), F.col("low").alias("node")))
        best = keep(both.groupBy("node").agg(F.least(F.min("low"), F.min("node")).alias("best")), "best", 2 * n)
        # large star: larger neighbours of a node move to its smallest neighbour
        large = lookup(both.where("low > node").alias("e"), best.alias("b"), F.col("e.node") == F.col("b.node"), "inner")
        large = keep(large.select(F.col("b.best").alias("low"), F.col("e.low").alias("node")).where("low < node").distinct(), "large", n)
        # small star: smaller neighbours of a node, and itself, move to the smallest
        least_ = keep(large.groupBy("node").agg(F.min("low").alias("best")), "least", n)
        moved = lookup(large.alias("e"), least_.alias("b"), F.col("e.node") == F.col("b.node"), "inner").select("b.best", "e.low", "e.node")
        small = moved.select(F.col("best").alias("low"), F.explode(F.array("low", "node")).alias("node")).where("low < node").distinct()
        small = keep(small, "small", 2 * n)
        if small.count() == n and not small.join(edges, ["low", "node"], "left_anti").limit(1).count():
            return small.select("node", F.col("low").alias("block")).unionByName(small.select(F.col("low").alias("node"), F.col("low").alias("block")).distinct())
        edges = small


class _Lists:
    """Documents by prefix token, over those that are left."""

    def __init__(self, prefixes: list[np.ndarray], docs: np.ndarray):
        self.doc = np.repeat(docs, [len(prefixes[d]) for d in docs])
        token = np.concatenate([prefixes[d] for d in docs])
        order = np.argsort(token, kind="stable")
        self.token, self.doc = token[order], self.doc[order]

    def share(self, own: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        for a, b in zip(np.searchsorted(self.token, own, "left"), np.searchsorted(self.token, own, "right")):
            out[self.doc[a:b]] = True
        return out


def linked(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets link with one set, by their whole intersections."""
    size = np.array([len(x) for x in others])
    every = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
    return UP * both >= AT * (len(own) + size - both)


def verified(sets: list[np.ndarray], prefixes: list[list[np.ndarray]]) -> np.ndarray:
    """The component (smallest member) of each of a block's documents."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    comp, left = np.arange(m), np.ones(m, bool)
    lists, indexed, n_left = None, 0, m
    for start in range(m):
        if not left[start]:
            continue
        left[start] = False
        n_left -= 1
        queue = [start]
        while queue and n_left:
            x = queue.pop()
            fits = left & (UP * size >= AT * size[x]) & (AT * size <= UP * size[x])
            if not fits.any():
                continue
            if fits.sum() > 64:
                if lists is None or n_left * 2 < indexed:
                    docs = np.flatnonzero(left)
                    lists, indexed = [_Lists(p, docs) for p in prefixes], n_left
                for own, p in zip(lists, prefixes):
                    fits &= own.share(p[x], m)
            near = np.flatnonzero(fits)
            for p in prefixes if len(near) <= 64 else ():
                near = np.array([y for y in near if len(p[y]) and np.isin(p[y], p[x], assume_unique=True).any()], np.int64)
            if not len(near):
                continue
            near = near[linked(sets[x], [sets[y] for y in near])]
            left[near] = False
            n_left -= len(near)
            comp[near] = start
            queue += near.tolist()
    return comp


_SETS = ("tokens", "first", "second", "third")


def _cells(t: pa.Table) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    cells = [[np.frombuffer(v, np.uint64) for v in t.column(x).to_pylist()] for x in _SETS]
    return cells[0], cells[1:]


def in_blocks(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, component) of blocks that fit one task each."""

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node = t.column("node").to_numpy()
        return pa.table({"node": node, "component": node[verified(*_cells(t))]})

    inside = found.join(F.broadcast(blocks) if is_small(blocks) else blocks, "node")
    return inside.groupBy("block").applyInArrow(verify, "node long, component long")


def tied_stars(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The star edges whose two documents share a prefix token under every order,
    and link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cells = lambda r, side: {x: np.frombuffer(r[side][x], np.uint64) for x in _SETS}
            yes = []
            for r in rows:
                a, b = cells(r, "a"), cells(r, "b")
                shared = all(np.isin(a[x], b[x], assume_unique=True).any() for x in _SETS[1:])
                yes.append(shared and bool(linked(a["tokens"], [b["tokens"]])[0]))
            yield batch.select(["low", "node"]).filter(pa.array(yes, pa.bool_()))

    sets = F.struct(*_SETS)
    rows = edges.join(found.select(F.col("node").alias("low"), sets.alias("a")), "low").join(found.select("node", sets.alias("b")), "node")
    return keep(rows.select("low", "node", "a", "b").mapInArrow(lean(check), "low long, node long"), "tied")


def across(sets: list[np.ndarray], prefixes: list[list[np.ndarray]], part: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of documents of `left` with those of `right`, where their parts differ;
    parts that a link has joined are one from then on."""
    m, size, label, out = len(sets), np.array([len(s) for s in sets]), part.copy(), []
    lists = [_Lists(p, np.arange(m)) for p in prefixes]
    for x in np.flatnonzero(left):
        fits = right & (label != label[x]) & (UP * size >= AT * size[x]) & (AT * size <= UP * size[x])
        for each, p in zip(lists, prefixes):
            if fits.any():
                fits &= each.share(p[x], m)
        near = np.flatnonzero(fits)
        if len(near):
            for y in near[linked(sets[x], [sets[y] for y in near])]:
                if label[y] != label[x]:
                    out.append((int(part[x]), int(part[y])))
                    label[label == label[y]] = label[x]
    return out


def members_of(blocks: DataFrame, tied: DataFrame) -> DataFrame:
    """node, n, block, part (component over tied edges), main (the part is its block's
    largest).  blocks: node, n, block."""
    parts = components(tied).withColumnRenamed("block", "part")
    rows = blocks.join(parts, "node", "left").select("node", "n", "block", F.coalesce("part", "node").alias("part"))
    n = blocks.count()
    rows = keep(rows, "members", n)
    top = rows.groupBy("block", "part").agg(F.count("*").alias("many")).groupBy("block").agg(F.max_by("part", F.struct("many", "part")).alias("top"))
    rows = lookup(rows.alias("r"), keep(top, "top", n).alias("t"), F.col("r.block") == F.col("t.block"), "inner")
    return keep(rows.select("r.*", (F.col("r.part") == F.col("t.top")).alias("main")), "members", n)


CLASSES = "node long, block long, n long, part long, main boolean, few boolean, light binary, heavy binary, second binary"
_CLASSES = pa.schema([("node", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("main", pa.bool_()), ("few", pa.bool_()), *[(x, pa.binary()) for x in ("light", "heavy", "second")]])
_KEYED = "key long, node long, n long, part long, main boolean"


def token_classes(found: DataFrame, parts: int) -> DataFrame:
    """found: node, tokens, block, n, part, main.  For each document the classes of the
    tokens in its prefixes under two orders.

    Tokens that the same documents hold are one class, known by a sum over those
    documents, as all tokens of a shared passage are.  One order goes by rarity, then by
    class; the other by class alone.  `light` are classes of the first order that at most
    `BLOCK` documents hold, `heavy` the others, `second` those of the other order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(merged(batches, 8 * FLUSH)):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
            own = mix(batch.column("node").to_numpy().astype(np.uint64))
            tokens, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            held = np.zeros(len(tokens), np.uint64)
            np.add.at(held, place, np.repeat(own, [len(s) for s in sets]))
            facts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "block", "n", "part", "main")])
            out = _packed(task + k, parts, tokens, n, facts, [], blob(np.concatenate(sets)))
            # the sums travel beside the counts, in the order of the packed tokens
            by = np.argsort((tokens & np.uint64((1 << parts) - 1)).astype(np.int64), kind="stable")
            cut = np.cumsum([0, *[len(x) // 8 for x in out.column("a").to_pylist()[:-1]]])
            sums = [blob(held[by][a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield out.set_column(4, "c", pa.array([*sums, None], pa.binary()))

    def reply(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        if not rows or rows[0]["part"] < 0:
            return t
        tokens = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
        order = np.argsort(tokens, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]]))
        place = np.empty(len(tokens), np.int64)
        place[order] = np.repeat(np.arange(len(new)), np.diff([*new, len(tokens)]))
        n = np.add.reduceat(np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows])[order].astype(np.int64), new)
        held = np.add.reduceat(np.concatenate([np.frombuffer(r["c"], np.uint64) for r in rows])[order], new)
        out, at = [], 0
        for r in rows:
            own = place[at : at + len(r["a"]) // 8]
            at += len(own)
            out.append(r | {"b": blob(n[own]), "c": blob(held[own])})
        return pa.Table.from_pylist(out, _PACKED)

    def finish(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        top = next(r for r in rows if r["part"] < 0)
        facts, tokens = np.frombuffer(top["a"], np.int64).reshape(-1, 5), np.frombuffer(top["b"], np.uint64)
        token, count, held = (np.concatenate([np.frombuffer(r[x], kind) for r in rows if r["part"] >= 0]) for x, kind in (("a", np.uint64), ("b", np.int64), ("c", np.uint64)))
        order = np.argsort(token)
        token, count, held = token[order], count[order], held[order]
        at = np.searchsorted(token, tokens)
        count, held = count[at], held[at]
        out, start = [], 0
        for node, block, n, part, main in facts.tolist():
            f, c = count[start : start + n], held[start : start + n]
            first = np.lexsort((mix(c), f))[: prefix(n)]
            second = np.argsort(mix(c ^ _SALT[1]), kind="stable")[: prefix(n)]
            some = lambda own, test: np.unique(c[own][test[own]])  # noqa: B023, E731
            own = some(first, (f > 1) & (f <= BLOCK)), some(first, f > BLOCK), some(second, f > 1)
            out.append((node, block, n, part, bool(main), len(own[0]) + len(own[1]) * len(own[2]) <= KEYS, *map(blob, own)))
            start += n
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_CLASSES)], schema=_CLASSES)

    rows = found.select("node", "tokens", "block", "n", "part", "main").mapInArrow(lean(scan), PACKED)
    rows = rows.groupBy("part").applyInArrow(lean_group(reply), PACKED)
    return keep(rows.groupBy("chunk").applyInArrow(lean_group(finish), CLASSES), "token-classes")


def class_keys(classes: DataFrame, known: Bits | None = None) -> DataFrame:
    """The keys under which documents meet: a light class alone, a heavy one with each
    class of the second order; of those that a filter lets in, if there is one."""
    sent = classes.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for block, *cells in zip(*[batch.column(c).to_pylist() for c in ("block", "light", "heavy", "second")]):
                light, heavy, second = (np.frombuffer(x, np.uint64) for x in cells)
                both = mix(heavy ^ _SALT[0])[:, None] + mix(second ^ _SALT[1])[None, :]
                own = mix(np.concatenate([light, mix(both.ravel())]) + np.uint64(block % (1 << 63)))
                keys.append(np.unique(own[sent.value.has(own)] if sent is not None else own))
            many = [len(k) for k in keys]
            out = [pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))]
            out += [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many)) for c in ("node", "n", "part", "main")]
            yield pa.RecordBatch.from_arrays(out, names=["key", "node", "n", "part", "main"])

    return classes.mapInArrow(lean(scan), _KEYED)


def met(keyed: DataFrame) -> DataFrame:
    """The pairs (low, node) of documents of fitting sizes and different parts that share
    a key, one of them at least outside of the main part.  A key that more than `MEET`
    documents have is dealt over tasks, two slices of its documents to each."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("many"), F.count_if(~F.col("main")).alias("outside"), F.min("part").alias("a"), F.max("part").alias("b"))
    sizes = keep(sizes.where("many > 1 and outside > 0 and a < b").select("key", F.ceil(F.col("many") / MEET).cast("int").alias("slices")), "keys")
    rows = keyed.alias("k").join(sizes.alias("s"), F.col("k.key") == F.col("s.key")).select("k.*", "s.slices")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("key", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "node", "n", "part", "main")

    def pairs(t: pa.Table) -> pa.Table:
        node, n, part, main, own = (t.column(c).to_numpy() for c in ("node", "n", "part", "main", "slice"))
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in np.flatnonzero(~main.astype(bool)):
            fits = (part != part[x]) & (UP * n >= AT * n[x]) & (AT * n <= UP * n[x]) & (main.astype(bool) | (node > node[x]))
            if two:
                fits &= own != own[x]
            to = node[fits]
            low.append(np.minimum(to, node[x]))
            high.append(np.maximum(to, node[x]))
        return pa.table({"low": np.concatenate(low), "node": np.concatenate(high)})

    return keep(rows.groupBy("key", "i", "j").applyInArrow(lean_group(pairs), "low long, node long").distinct(), "met")


def in_large_blocks(found: DataFrame, edges: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """(node, component) of blocks too large for one task.  blocks: node, block."""
    found = lookup(found.alias("f"), blocks.alias("b"), F.col("f.node") == F.col("b.node"), "inner").select("f.*", "b.block")
    found = keep(found, "found")
    blocks = found.select("node", "n", "block")
    edges = lookup(edges.alias("e"), blocks.select("node").alias("b"), F.col("e.node") == F.col("b.node"), "left_semi")
    first = edges.groupBy("node").agg(F.min("low").alias("low")).select("low", "node")
    tied = tied_stars(found, first)
    members = members_of(blocks, tied)
    outside = members.where("not main")
    if not outside.limit(1).count():
        return members.select("node", F.col("part").alias("component"))
    # the other star edges, of documents outside of the largest part
    more = lookup(edges.alias("e"), outside.select("node", "part").alias("o"), F.col("e.node") == F.col("o.node"), "inner").select("e.low", "e.node")
    tied = keep(tied.unionByName(tied_stars(found, more.exceptAll(first))), "tied")
    members = members_of(blocks, tied)
    classes = token_classes(found.select("node", "tokens").join(members, "node"), parts)
    links = tied_stars(found, across_keys(classes.where("few"))).unionByName(across_tiles(found, classes.select("node", "block", "n", "part", "main", "few")))
    part = members.select("node", "part")
    rows = links.join(part.select(F.col("node").alias("low"), F.col("part").alias("_a")), "low").join(part.withColumnRenamed("part", "_b"), "node")
    rows = keep(rows.select(F.least("_a", "_b").alias("low"), F.greatest("_a", "_b").alias("node")).where("low < node").distinct(), "across")
    whole = components(rows).select(F.col("node").alias("part"), F.col("block").alias("whole"))
    return members.join(whole, "part", "left").select("node", F.coalesce("whole", "part").alias("component"))


def across_keys(classes: DataFrame) -> DataFrame:
    """The pairs of documents of few classes, one of them outside of the main part."""
    apart = keep(class_keys(classes.where("not main")), "apart")
    distinct = keep(apart.select("key").distinct(), "distinct")
    return met(keep(apart.unionByName(class_keys(classes.where("main"), filter_of(distinct, distinct.count()))), "keyed"))


def across_tiles(found: DataFrame, members: DataFrame) -> DataFrame:
    """Links (low, node) of documents outside of the main part where one of the two has
    many classes.  Such are near copies with edits of their own, which share nearly all
    tokens: they would meet under thousands of keys, and a tile forms each pair once."""
    # sizes that fit differ by a third at most, and so by one class at most
    members = members.withColumn("kind", F.floor(F.ln("n") / F.lit(float(np.log(1.34)))).cast("int"))
    by = ["block", "kind", "main", "few"]
    tiles = keep(members.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("tiles")), "tiles")
    tiled = keep(lookup(members.alias("m"), tiles.alias("t"), reduce(lambda a, b: a & b, [F.col(f"m.{c}") == F.col(f"t.{c}") for c in by]), "inner").select("m.*", F.pmod(F.xxhash64("m.node"), F.col("t.tiles")).cast("int").alias("tile")), "tiled")
    spots = tiles.select(*by, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    own = lambda x: F.struct(*[F.col(f"{x}.{c}") for c in (*by[1:], "tile")])
    twice = (F.col("a.block") == F.col("b.block")) & ~F.col("a.main") & (F.abs(F.col("a.kind") - F.col("b.kind")) <= 1) & ~(F.col("a.few") & F.col("b.few"))
    pairs = spots.alias("a").join(spots.alias("b"), twice & (F.col("b.main") | (own("a") <= own("b"))))
    pairs = keep(pairs.select(F.col("a.block").alias("block"), own("a").alias("a"), own("b").alias("b"), F.xxhash64("a.block", own("a"), own("b")).alias("task")), "pairs")
    sides = pairs.select("task", "block", F.explode(F.array_distinct(F.array("a", "b"))).alias("spot"), "a", "b")
    sides = sides.select("task", "block", *[f"spot.{c}" for c in (*by[1:], "tile")], (F.col("spot") == F.col("a")).alias("left"), (F.col("spot") == F.col("b")).alias("right"))
    dealt = sides.join(tiled, [*by, "tile"]).select("task", "node", "part", "left", "right")

    def cross(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, part = t.column("node").to_numpy(), t.column("part").to_numpy()
        first = dict(zip(part[::-1].tolist(), node[::-1].tolist()))  # a document of each part stands for it
        got = [sorted((first[x], first[y])) for x, y in across(*_cells(t), part, *[t.column(c).to_numpy().astype(bool) for c in ("left", "right")])]
        return pa.table({"low": pa.array([x for x, _ in got], pa.int64()), "node": pa.array([y for _, y in got], pa.int64())})

    inside = dealt.join(found.select("node", *_SETS), "node")
    return keep(inside.groupBy("task").applyInArrow(lean_group(cross), "low long, node long").distinct(), "tile-links")


def joined(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text).  A row per document: doc_id, n_shingles, component_id."""
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = parts_for(int(size or 0))
    state = states(docs, parts)
    classes = keep(state.where("alive").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members")), "classes", n)
    found = candidates(docs, classes, parts)
    edges = stars(found, 8 * n)
    n_edges = edges.count()
    blocks = keep(components(edges), "blocks", 2 * n_edges)
    large = keep(blocks.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("block"), "large", n_edges)
    split = F.broadcast(large) if is_small(large) else large
    comps = in_blocks(found, keep(blocks.join(split, "block", "left_anti").select("node", "block"), "few", 2 * n_edges))
    if large.limit(1).count():
        comps = comps.unionByName(in_large_blocks(found, edges, keep(blocks.join(split, "block", "left_semi").select("node", "block"), "many", 2 * n_edges), parts))
    comps = keep(comps, "components")
    parts_of = found.select("node", "s1", "s2").join(comps, "node").join(classes, ["s1", "s2"])
    lowest = parts_of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = parts_of.select("s1", "s2", "component").distinct().join(lowest, "component").groupBy("s1", "s2").agg(F.min("component_id").alias("component_id"))
    names = classes.join(names, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("members") > 1).alias("many"), F.col("component_id").isNotNull().alias("tied"))
    names = keep(names.where("many or tied").select("s1", "s2", "component_id"), "names", n)
    out = state.join(F.broadcast(names) if is_small(names) else names, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
