"""Language-model scoring with a log-frequency Bloom filter (operator 1).

Counts of words and word pairs are added up by hash over all training texts.
Each is quantised on a logarithmic scale, and a key with level q is put into a
Bloom filter with the levels 1 to q; so one filter holds all n-gram counts.  A
count is read back by repeated probes, at levels 1, 2, 4, ... until a miss and
then between the last two.

No n-gram is left out.  The filter grows with their number; up to 2**MOST_BITS
bits it is broadcast.  Beyond, it stays in its segments, one for each range of
hashes: the distinct n-grams of each chunk of texts go to the segments of their
ranges, and their levels come back.  Both ways give the same levels.

P(word | before) = a * c(before word) / c(before) + (1 - a) * P(word), with P(word)
additively smoothed, all counts from the filter, and a weight `a` for each level
of c(before), found by likelihood over all training texts, with the token's own
occurrence left out.

The base score needs exact counts.  The most frequent words, at most `HEAD` of
them, are broadcast with their counts; the others are looked up in the count
table by a join on the hash.

Defined results: a null or empty text is one end token; a null id counts as the
text '' for the split; repeated rows are counted and scored each; without training
rows all counts are 0; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import assembled
from .common import chunk_bytes, keep, lean, lean_group, merged, parts_for, split_of, table
from .kernel import SPACE_WORD, Bits, Words, blob, mix, unblob

#: the size of a filter that is broadcast (2**29 bits are 64 MB), and its probes for a level
MOST_BITS, PROBES = 29, 4
#: words whose exact counts are broadcast
HEAD = 1 << 19
#: tokens that a task counts before it passes its counts on
FLUSH = 2_500_000
#: keys that are read from a segment at once
SLAB = 1 << 18
RATIO = 1.25
END = np.uint64(0x5EED0FE2D0C5A11D)
BEGIN = np.uint64(0xB0B51DED5EED0001)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


def codebook(ratio: float = RATIO, most: int = 1 << 50) -> np.ndarray:
    """The least count of each level."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return np.array(out, np.int64)


CODE = codebook()
#: the count that a level stands for: the geometric middle of its counts
DECODE = np.concatenate([[0.0], np.sqrt(CODE[:-1].astype(float) * (CODE[1:] - 1)), [float(CODE[-1])]])


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(CODE, counts, "right")


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the pair each ends, and n + 1 offsets."""
    words = Words.of(col, SPACE_WORD)
    n = len(words.offs) - 1
    offs = words.first + np.arange(n + 1)
    own = np.empty(int(offs[-1]), np.uint64)
    own[np.arange(len(words.hash)) + words.doc] = words.hash
    own[offs[1:] - 1] = END
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[offs[:-1]] = BEGIN
    return own, mix(before * _A + own * _B + np.uint64(1)), offs


def counted(texts: DataFrame, parts: int) -> DataFrame:
    """texts: one column.  A row for each of 2**parts ranges of hashes: words and
    pairs with exact counts, and how many have each level."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, arrays in enumerate(held):
            if not arrays:
                continue
            keys, n = np.unique(np.concatenate(arrays), return_counts=True)
            part = (keys >> np.uint64(64 - parts)).astype(np.int32)
            cut = np.searchsorted(part, np.arange((1 << parts) + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array(np.full(len(full), kind, np.int32)),
                    pa.array([blob(keys[cut[p] : cut[p + 1]]) for p in full], pa.binary()),
                    pa.array([blob(n[cut[p] : cut[p + 1]].astype(np.uint32)) for p in full], pa.binary()),
                ],
                names=["part", "kind", "keys", "counts"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[], []], 0
        for batch in batches:
            own, pairs, _ = tokens(batch.column(0))
            held[0].append(own), held[1].append(pairs)
            size += len(own)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [[], []], 0
        yield from flush(held)

    def merge(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_numpy()
        out: dict = {"part": t.column("part")[:1]}
        for kind, name in ((0, "word"), (1, "pair")):
            rows = t.filter(pa.array(kinds == kind))
            keys, n = unblob(rows.column("keys"), np.uint64), unblob(rows.column("counts"), np.uint32).astype(np.int64)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
            level = np.bincount(quantised(n), minlength=len(CODE) + 1)
            out |= {f"{name}_keys": pa.array([blob(keys)], pa.binary()), f"{name}_counts": pa.array([blob(n if kind == 0 else np.minimum(n, 2**32 - 1).astype(np.uint32))], pa.binary()), f"{name}_levels": pa.array([level.tolist()], pa.list_(pa.int64())), f"{name}_total": pa.array([int(n.sum())], pa.int64())}
        return pa.table(out)

    kind = "part int" + "".join(f", {x}_keys binary, {x}_counts binary, {x}_levels array<long>, {x}_total long" for x in ("word", "pair"))
    rows = texts.mapInArrow(lean(count), "part int, kind int, keys binary, counts binary")
    return keep(rows.groupBy("part").applyInArrow(lean_group(merge), kind), "counts")


class Model:
    """What a worker needs: the filter (none if it stays in segments), the frequent
    words, and the weights."""

    def __init__(self, parts: int, total: int, distinct: int, log2_bits: int, bits: Bits | None, head: np.ndarray, head_counts: np.ndarray):
        self.parts, self.total, self.distinct, self.log2_bits, self.bits = parts, total, distinct, log2_bits, bits
        self.head, self.head_counts = head, head_counts
        self.weights = np.zeros(len(CODE) + 1)

    @property
    def floor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.bits.level(keys, len(CODE))


def segment_of(bits: Bits, row: dict) -> bytes:
    """The filter's segment of one row of the count table."""
    words, n = np.frombuffer(row["word_keys"], np.uint64), np.frombuffer(row["word_counts"], np.int64)
    pairs, m = np.frombuffer(row["pair_keys"], np.uint64), np.frombuffer(row["pair_counts"], np.uint32)
    return bits.segment(np.concatenate([words, pairs]), np.concatenate([quantised(n), quantised(m)]))


def model_of(counts: DataFrame, parts: int) -> Model:
    """The filter and the frequent words from the count table."""
    sums = {}
    for name in ("word", "pair"):
        level = counts.select(F.posexplode(f"{name}_levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
        sums[name] = np.zeros(len(CODE) + 1, np.int64)
        for r in level:
            sums[name][r["level"]] = r["n"]
    total = counts.agg(F.sum("word_total")).first()[0] or 0
    used = int(((sums["word"] + sums["pair"]) * np.arange(len(CODE) + 1)).sum())
    log2_bits = max(parts + 10, int(used * PROBES / np.log(2)).bit_length())
    if log2_bits - 1 == MOST_BITS and used * PROBES / np.log(2) < 1.15 * (1 << MOST_BITS):
        log2_bits -= 1  # a little over its best load rather than twice its size
    bits, whole = Bits(parts, log2_bits, PROBES), log2_bits <= MOST_BITS
    many = np.cumsum(sums["word"][::-1])[::-1]
    cut_head = int(np.argmax(np.append(many, 0)[1:] <= HEAD)) + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, n = np.frombuffer(r["word_keys"], np.uint64), np.frombuffer(r["word_counts"], np.int64)
                top = quantised(n) >= cut_head
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([segment_of(bits, r) if whole else b""], pa.binary()), pa.array([blob(words[top])], pa.binary()), pa.array([blob(n[top])], pa.binary())], names=["part", "bits", "head", "n"])

    read = [c if whole or c.startswith("word") or c == "part" else F.lit(b"").alias(c) for c in ("part", "word_keys", "word_counts", "pair_keys", "pair_counts")]
    rows = counts.select(*read).mapInArrow(lean(build), "part int, bits binary, head binary, n binary").collect()
    rows.sort(key=lambda r: r["part"])
    full = assembled(bits, {r["part"]: bytes(r["bits"]) for r in rows}) if whole else None
    head = np.frombuffer(b"".join(bytes(r["head"]) for r in rows), np.uint64)
    return Model(parts, int(total), int(sums["word"].sum()), log2_bits, full, head, np.frombuffer(b"".join(bytes(r["n"]) for r in rows), np.int64))


#: rows that travel between chunks of texts and ranges of hashes; part -1 has what a
#: chunk keeps: levels of each token (before, pair, word), and facts of each text
ROWS = "chunk long, part int, a binary, b binary, c binary, d binary, ids array<long>, held array<boolean>"
_ROWS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), *[(x, pa.binary()) for x in "abcd"], ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])
BASE, SEEN, SIZE = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *[None] * (8 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full), _ROWS)], schema=_ROWS)


def _features(before_end: int, own: np.ndarray, pair: np.ndarray, offs: np.ndarray) -> bytes:
    """Levels of (word before, pair, word) for each token, one byte each."""
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[offs[:-1]] = before_end  # as many texts begin as end
    return blob(np.stack([before, pair, own]).astype(np.uint8))


def looked_up(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs: (doc_id, text, held_out).  A row for each chunk, part -1, with the
    levels of its tokens; base scores lack what rows of other parts ask for."""
    return _broadcast_lookup(docs, model) if model.bits is not None else _segment_lookup(docs, model, counts)


def _broadcast_lookup(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    parts = model.parts

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        m = sent.value
        end = int(m.levels(np.array([END]))[0])
        for k, batch in enumerate(merged(batches, chunk_bytes(parts))):
            own, pairs, offs = tokens(batch.column("text"))
            if not batch.num_rows:
                continue
            distinct, place = np.unique(own, return_inverse=True)
            at = np.minimum(np.searchsorted(m.head, distinct), max(0, len(m.head) - 1))
            known = m.head[at] == distinct if len(m.head) else np.zeros(len(distinct), bool)
            exact = np.where(known, m.head_counts[at] if len(m.head) else 0, 0)
            base = np.add.reduceat(np.where(known, np.log10(exact + 0.5), 0.0)[place], offs[:-1])
            seen = np.add.reduceat(known[place].astype(np.int64), offs[:-1])
            levels = _features(end, m.levels(distinct)[place], m.levels(pairs), offs)
            rows = [(task + k, -1, levels, blob(np.stack([base, seen.astype(float), np.diff(offs).astype(float)])), None, None, batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist())]
            rare = np.flatnonzero(~known[place])
            keys, doc = own[rare], (np.searchsorted(offs, rare, "right") - 1).astype(np.uint32)
            part = (keys >> np.uint64(64 - parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, doc, part = keys[order], doc[order], part[order]
            cut = np.searchsorted(part, np.arange((1 << parts) + 1))
            yield _rows(rows + [(task + k, int(p), blob(keys[cut[p] : cut[p + 1]]), blob(doc[cut[p] : cut[p + 1]])) for p in np.flatnonzero(np.diff(cut))])

    return keep(docs.mapInArrow(lean(look), ROWS), "looked")


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows in their order, and the n + 1 places where rows begin."""
    return np.frombuffer(b"".join(blobs), np.uint64), np.concatenate([[0], np.cumsum([len(x) // 8 for x in blobs], dtype=np.int64)])


def _in_slabs(bits: Bits, keys: np.ndarray) -> np.ndarray:
    """Levels of any number of keys, SLAB at a time."""
    return np.concatenate([np.zeros(0, np.uint8), *[bits.level(keys[k : k + SLAB], len(CODE)).astype(np.uint8) for k in range(0, len(keys), SLAB)]])


def _answer(t: pa.Table, seg: int) -> pa.Table:
    """Levels and counts of the keys that all chunks ask of one range; its row of the
    count table is that of chunk -1."""
    rows = t.to_pylist()
    held = [dict(zip(("word_keys", "word_counts", "pair_keys", "pair_counts"), (r[x] for x in "abcd"))) for r in rows if r["chunk"] < 0]
    known, n = (np.frombuffer(held[0][x], kind) if held else np.zeros(0, kind) for x, kind in (("word_keys", np.uint64), ("word_counts", np.int64)))
    bits = Bits(0, seg, PROBES)
    bits.data = np.frombuffer(bits.segment(np.zeros(0, np.uint64), np.zeros(0, np.int64)) if not held else segment_of(bits, held[0]), np.uint8)
    asked = [r for r in rows if r["chunk"] >= 0]
    # a range has a row of few keys for each chunk, so keys of many rows are read at once
    words, at_word = _joined([r["a"] for r in asked])
    both, at_both = _joined([r["b"] for r in asked])
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    count = np.where(known[at] == words, n[at], 0) if len(known) else np.zeros(len(words), np.int64)
    level, pair = (_in_slabs(bits, x) for x in (words, both))
    out = [{"chunk": r["chunk"], "part": r["part"], "a": blob(level[w : w_end]), "b": blob(pair[p : p_end]), "c": blob(count[w : w_end])} for r, w, w_end, p, p_end in zip(asked, at_word, at_word[1:], at_both, at_both[1:])]
    return pa.Table.from_pylist(out, _ROWS)


def _segment_lookup(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """The same with the filter in segments: keys go to their range, levels and exact
    counts come back.  A chunk sends each distinct key once."""
    parts, seg = model.parts, Bits(model.parts, model.log2_bits, PROBES).seg

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(merged(batches, chunk_bytes(parts))):
            own, pairs, offs = tokens(batch.column("text"))
            if not batch.num_rows:
                continue
            (words, at_word), (both, at_both) = (np.unique(np.append(x, END) if x is own else x, return_inverse=True) for x in (own, pairs))
            cuts = [np.searchsorted((x >> np.uint64(64 - parts)).astype(np.int64), np.arange((1 << parts) + 1)) for x in (words, both)]
            full = np.flatnonzero(np.diff(cuts[0]) + np.diff(cuts[1]))
            rows = [(task + k, -1, blob(at_word.astype(np.uint32)), blob(at_both.astype(np.uint32)), blob(np.diff(offs)), None, batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist())]
            yield _rows(rows + [(task + k, int(p), *[blob(x[c[p] : c[p + 1]]) for x, c in zip((words, both), cuts)]) for p in full])

    def gather(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        top, rest = rows[0], rows[1:]
        level, pair, count = (np.frombuffer(b"".join(r[x] for r in rest), kind) for x, kind in (("a", np.uint8), ("b", np.uint8), ("c", np.int64)))
        place, size = np.frombuffer(top["a"], np.uint32), np.frombuffer(top["c"], np.int64)
        offs = np.concatenate([[0], np.cumsum(size)])
        own, c = level[place[:-1]], count[place[:-1]]
        levels = _features(int(level[place[-1]]), own, pair[np.frombuffer(top["b"], np.uint32)], offs)
        facts = np.stack([np.add.reduceat(np.log10(c + 0.5), offs[:-1]), np.add.reduceat((c > 0).astype(float), offs[:-1]), size.astype(float)])
        return pa.Table.from_pylist([{"chunk": top["chunk"], "part": -1, "a": levels, "b": blob(facts), "ids": top["ids"], "held": top["held"]}], _ROWS)

    rows = keep(docs.mapInArrow(lean(ask), ROWS), "asked")
    none = [F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<boolean>").alias("held")]
    held = counts.select(F.lit(-1).cast("long").alias("chunk"), "part", *[F.col(c).alias(x) for c, x in zip(("word_keys", "word_counts", "pair_keys", "pair_counts"), "abcd")], *none)
    replies = rows.where("part >= 0").unionByName(held).groupBy("part").applyInArrow(lean_group(lambda t: _answer(t, seg)), ROWS)
    return keep(rows.where("part < 0").unionByName(replies).groupBy("chunk").applyInArrow(lean_group(gather), ROWS), "looked")


RATIOS = 128


def _shares(row: dict, floor: float, less: int = 0) -> tuple[np.ndarray, ...]:
    """For each token of a chunk: level of the word before, c(pair) / c(before) with
    `less` occurrences left out, and P(word)."""
    before, pair, word = np.frombuffer(row["a"], np.uint8).reshape(3, -1)
    seen = np.maximum(DECODE[pair] - less, 0) / np.maximum(DECODE[before] - less, 1)
    return before.astype(np.int64), np.minimum(1.0, seen), (DECODE[word] + 0.5) / floor


def fit(looked: DataFrame, floor: float) -> np.ndarray:
    """Weights by level, from all texts that are in the counts (not held out)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(CODE) + 1) * RATIOS, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                before, pair, word = _shares(r, floor, 1)
                size = np.frombuffer(r["b"]).reshape(3, -1)[SIZE].astype(np.int64)
                mine = np.repeat(~np.array(r["held"], bool), size)
                ratio = pair[mine] / word[mine]
                at = np.where(ratio > 0, np.clip(np.log2(np.maximum(ratio, 1e-9)) * 3 + 40, 1, RATIOS - 1), 0).astype(int)
                seen += np.bincount(before[mine] * RATIOS + at, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    seen = np.zeros((len(CODE) + 1) * RATIOS)
    for r in looked.where("part < 0").select("a", "b", "held").mapInArrow(lean(tally), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        seen[r["at"]] = r["n"]
    seen = seen.reshape(-1, RATIOS)
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(1, RATIOS) + 0.5 - 40) / 3)])
    out = np.zeros(len(CODE) + 1)
    for level in range(1, len(out)):
        n = seen[level]
        if not n.sum():
            out[level] = out[level - 1]
            continue
        a = 0.3
        for _ in range(60):  # expectation maximisation, with one token of doubt on each side
            share = a * ratio / (a * ratio + 1 - a)
            a = ((n * share).sum() + 0.5) / (n.sum() + 2)
        out[level] = a
    return out


def scored(looked: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Chunks of `looked_up`.  The contract's columns."""
    floor, weights, train = model.floor, model.weights, model.total

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                before, pair, word = _shares(r, floor)
                a = weights[before]
                facts = np.frombuffer(r["b"]).reshape(3, -1)
                offs = np.concatenate([[0], np.cumsum(facts[SIZE].astype(np.int64))])
                score = np.add.reduceat(np.log10(a * pair + (1 - a) * word), offs[:-1])
                yield _rows([(r["chunk"], -1, blob(np.stack([*facts, score])), None, None, None, r["ids"], r["held"])])

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        held = [r for r in rows if r["chunk"] < 0]
        keys = np.frombuffer(held[0]["a"], np.uint64) if held else np.zeros(0, np.uint64)
        n = np.frombuffer(held[0]["b"], np.int64) if held else np.zeros(0, np.int64)
        out = []
        for r in rows:
            if r["chunk"] >= 0:
                own, doc = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                c = np.where(keys[at] == own, n[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                size = int(doc.max()) + 1
                base, seen = np.bincount(doc, np.log10(c + 0.5), size), np.bincount(doc, c > 0, size)
                some = np.unique(doc)
                out.append({"chunk": r["chunk"], "part": r["part"], "a": blob(some.astype(np.uint32)), "b": blob(np.stack([base[some], seen[some]]))})
        return pa.Table.from_pylist(out, _ROWS)

    def finish(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        first = rows[0]
        base, seen, size, score = np.frombuffer(first["a"]).reshape(4, -1).copy()
        for r in rows[1:]:
            doc = np.frombuffer(r["a"], np.uint32)
            more = np.frombuffer(r["b"]).reshape(2, -1)
            base[doc] += more[0]
            seen[doc] += more[1]
        n = len(size)
        return pa.table({"doc_id": pa.array(first["ids"], pa.int64()), "held_out": pa.array(first["held"], pa.bool_()), "n_tokens": size.astype(np.int64), "n_known": seen.astype(np.int64), "train_tokens": np.full(n, train, np.int64), "base_score": base - size * np.log10(floor), "score": score})

    rows = looked.where("part < 0").mapInArrow(lean(total), ROWS)
    if model.bits is not None:
        none = [F.lit(None).cast("binary").alias("c"), F.lit(None).cast("binary").alias("d"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<boolean>").alias("held")]
        table_rows = counts.select(F.lit(-1).cast("long").alias("chunk"), "part", F.col("word_keys").alias("a"), F.col("word_counts").alias("b"), *none)
        rows = rows.unionByName(looked.where("part >= 0").unionByName(table_rows).groupBy("part").applyInArrow(lean_group(answer), ROWS))
    final = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").applyInArrow(finish, final)


def model_for(train: DataFrame) -> tuple[Model, DataFrame]:
    """train: (doc_id, text).  The model without weights, and the count table."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = parts_for(int(size or 0))
    counts = counted(train.select("text"), parts)
    return model_of(counts, parts), counts


def learned_scores(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, held_out).  Learns from the rows that are not held out,
    and scores all."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    model, counts = model_for(docs.where(~F.col("held_out")))
    looked = looked_up(docs, model, counts)
    model.weights = fit(looked, model.floor)
    return scored(looked, model, counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (split_of(F.col("doc_id"), 5) == 1).alias("held_out"))
    return learned_scores(docs)
