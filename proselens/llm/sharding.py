"""Sharding by a k-d tree over document metadata (operator 5).

The unit is a group of equal texts, so that copies share a shard; a group of more
than `HEAVY` of a shard's bytes is cut into its documents, or no law on bytes
could hold.  A node is split along its widest dimension (size, source, language;
spread over the spread of all) at the weighted median, or at the share that its
numbers of leaves ask for.  The dimension is cut into `BINS` bins of the node's
range; within the bin where the median falls, units go by a hash, whose
threshold is found by a second histogram.  Both histograms are sums over all
rows, so the driver sees numbers of fixed size, never rows.

Law: bytes; the sizes of the shards are near equal.

Slots go by a hash of the id (without one, of the text), ties by id and text, so
reruns agree.

Defined results: null text has no bytes and crc 0; a null source or language is a
value; repeated rows are units of one group; more shards than units leaves
shards empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, lean, lookup, table, trim
from .numbering import hash32, numbered

SHARDS = 24
BINS, SUB = 1024, 4096
#: a group of copies beyond this share of a shard is cut
HEAVY = 0.02
DIMS = ("_kd_size", "_kd_source", "_kd_lang")


@dataclass
class Node:
    first: int
    last: int  # shards first to last - 1
    id: int
    dim: int = 0
    lo: float = 0.0
    hi: float = 0.0
    bin: int = 0
    sub: int = 0
    kids: list["Node"] = field(default_factory=list)

    def at(self, dims: list[np.ndarray]) -> np.ndarray:
        """The bins of rows along this node's dimension."""
        x, wide = dims[self.dim], self.hi - self.lo
        return np.zeros(len(x), np.int64) if wide <= 0 else np.clip(((x - self.lo) / wide * BINS).astype(np.int64), 0, BINS - 1)

    def split(self, dims: list[np.ndarray], sub: np.ndarray, rows: np.ndarray) -> Iterator[tuple["Node", np.ndarray]]:
        """The leaves below, with the numbers of the rows that reach each."""
        if not self.kids:
            yield self, rows
            return
        at = self.at([d[rows] for d in dims])
        left = (at < self.bin) | ((at == self.bin) & (sub[rows] < self.sub))
        for kid, own in zip(self.kids, (rows[left], rows[~left])):
            yield from kid.split(dims, sub, own)


def _arrays(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    dims = [batch.column(d).to_numpy(zero_copy_only=False) for d in DIMS]
    return dims, batch.column("_kd_sub").to_numpy(zero_copy_only=False), batch.column("_kd_bytes").to_numpy(zero_copy_only=False)


def _sums(units: DataFrame, root: Node, live: set[int], fine: bool) -> dict[int, dict[int, int]]:
    """Bytes by node and bin (or, in the node's median bin, by hash): each task
    adds up its rows, the sums of the tasks are added up by Spark."""
    sent = units.sparkSession.sparkContext.broadcast(root)
    n = SUB if fine else BINS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, sub, size = _arrays(batch)
            for node, rows in sent.value.split(dims, sub, np.arange(len(size))):
                if node.id not in live or not len(rows):
                    continue
                at = node.at([d[rows] for d in dims])
                if fine:
                    rows = rows[at == node.bin]
                    at = sub[rows]
                total[node.id] = total.get(node.id, 0) + np.bincount(at, size[rows], n)
        for k, v in total.items():
            b = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, np.int32)), pa.array(b.astype(np.int32)), pa.array(v[b].astype(np.int64))], names=["node", "bin", "w"])

    out: dict[int, dict[int, int]] = {}
    for r in units.select(*DIMS, "_kd_sub", "_kd_bytes").mapInArrow(lean(add), "node int, bin int, w long").groupBy("node", "bin").agg(F.sum("w").alias("w")).collect():
        out.setdefault(r["node"], {})[r["bin"]] = r["w"]
    return out


def _ranges(units: DataFrame, root: Node) -> dict[int, dict]:
    """Bytes and the range of each dimension, by leaf."""
    sent = units.sparkSession.sparkContext.broadcast(root)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, sub, size = _arrays(batch)
            rows = [{"node": node.id, "w": int(size[own].sum()), **{f"lo{k}": float(d[own].min()) for k, d in enumerate(dims)}, **{f"hi{k}": float(d[own].max()) for k, d in enumerate(dims)}} for node, own in sent.value.split(dims, sub, np.arange(len(size))) if len(own)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("node", pa.int32()), ("w", pa.int64())] + [(f"{x}{k}", pa.float64()) for k in range(len(dims)) for x in ("lo", "hi")]))

    kind = "node int, w long" + "".join(f", lo{k} double, hi{k} double" for k in range(len(DIMS)))
    got = units.select(*DIMS, "_kd_sub", "_kd_bytes").mapInArrow(lean(look), kind).groupBy("node")
    return {r["node"]: r.asDict() for r in got.agg(F.sum("w").alias("w"), *[f(f"{x}{k}").alias(f"{x}{k}") for k in range(len(DIMS)) for x, f in (("lo", F.min), ("hi", F.max))]).collect()}


def _cut(hist: dict[int, int], n: int, want: float) -> tuple[int, float]:
    """The bin where the running sum passes `want`, and the sum before it."""
    total = 0.0
    for b in range(n):
        if total + hist.get(b, 0) > want:
            return b, total
        total += hist.get(b, 0)
    return n, total


def tree(units: DataFrame, shards: int) -> Node:
    """Build the tree over rows with DIMS, _kd_sub and _kd_bytes."""
    root = Node(0, shards, 0)
    level, ids, spread = [root], 1, None
    while level := [n for n in level if n.last - n.first > 1]:
        seen = _ranges(units, root)
        if spread is None:
            spread = [seen[0][f"hi{k}"] - seen[0][f"lo{k}"] or 1.0 for k in range(len(DIMS))] if seen else [1.0] * len(DIMS)
        here = {n.id: n for n in level if n.id in seen}
        for n in here.values():
            r = seen[n.id]
            wide = [(r[f"hi{k}"] - r[f"lo{k}"]) / s for k, s in enumerate(spread)]
            n.dim = wide.index(max(wide))
            n.lo, n.hi = r[f"lo{n.dim}"], r[f"hi{n.dim}"]
        if here:
            first, want = _sums(units, root, set(here), False), {}
            for k, n in here.items():
                want[k] = seen[k]["w"] * ((n.last - n.first) // 2) / (n.last - n.first)
                n.bin, done = _cut(first.get(k, {}), BINS, want[k])
                want[k] -= done
            exact = _sums(units, root, set(here), True)
            for k, n in here.items():
                own = exact.get(k, {})
                n.sub, done = _cut(own, SUB, want[k])
                if n.sub < SUB and want[k] - done > own.get(n.sub, 0) / 2:
                    n.sub += 1  # the nearer side of the unit that stands across
        for n in level:
            half = n.first + (n.last - n.first) // 2
            n.kids = [Node(n.first, half, ids), Node(half, n.last, ids + 1)]
            ids += 2
        level = [x for n in level for x in n.kids]
    return root


def sharded(rows: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """Rows of `measured`; each gets _kd_shard and _kd_slot.  Texts are told apart by
    a hash, their length and their crc."""
    same = ["_kd_text", "_kd_bytes", "_kd_crc"]
    total = rows.agg(F.sum("_kd_bytes")).first()[0] or 0
    if target_bytes:
        shards = max(1, -(-int(total) // target_bytes))
    unit = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit("\0"))) / F.lit(float(2**63))
    groups = rows.groupBy(*same).agg(F.count("*").alias("n"), F.sum("_kd_bytes").alias("w"), F.min(F.struct("doc_id", "source", "lang")).alias("rep")).where("n > 1")
    groups = keep(groups, "groups")
    rows = lookup(rows.alias("d"), groups.alias("g"), reduce(lambda a, b: a & b, [F.col(f"d.{x}") == F.col(f"g.{x}") for x in same])).select("d.*", "g.w", "g.rep")
    alone = F.col("rep").isNull() | (F.col("w") > F.lit(HEAVY * total / shards))
    pick = lambda name: F.when(alone, F.col(name)).otherwise(F.col(f"rep.{name}"))
    own = F.when(F.col("rep").isNotNull() & alone, F.xxhash64("doc_id", "_kd_text")).otherwise(F.col("_kd_text"))
    units = keep(
        rows.withColumns({"_kd_size": F.log2(F.col("_kd_bytes") + 1.0), "_kd_source": unit(pick("source")), "_kd_lang": unit(pick("lang")), "_kd_sub": F.pmod(F.xxhash64(own, F.lit(7)), F.lit(SUB)).cast("int")}).drop("w", "rep"),
        "units",
    )
    root = tree(units, shards)
    sent = rows.sparkSession.sparkContext.broadcast(root)

    @F.pandas_udf("int")
    def leaf(size: pd.Series, source: pd.Series, lang: pd.Series, sub: pd.Series) -> pd.Series:
        out = np.zeros(len(sub), np.int32)
        for node, own in sent.value.split([x.to_numpy() for x in (size, source, lang)], sub.to_numpy(), np.arange(len(sub))):
            out[own] = node.first
        return pd.Series(out)

    out = keep(units.withColumn("_kd_shard", leaf(*DIMS, "_kd_sub")).drop(*DIMS, "_kd_sub"), "leaves")
    # rows without an id go by their text; what still ties is equal in all that is returned
    out = out.withColumn("_kd_hash", hash32(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(" "), F.col("_kd_text").cast("string")))))
    out = numbered(out, ["_kd_shard"], "_kd_hash", ["doc_id", *same], "_kd_slot")
    return out.withColumn("_kd_slot", F.col("_kd_slot") - 1).drop("_kd_hash")


def measured(docs: DataFrame) -> DataFrame:
    """Narrow rows of documents: sizes and text hashes in place of texts."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(
        "doc_id",
        "source",
        "lang",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 8).alias("_kd_bytes"),
        F.crc32(text).alias("_kd_crc"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.crc32(text)).alias("_kd_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return sharded(keep(measured(docs), "measured")).select(
        "doc_id",
        F.col("_kd_bytes").alias("size"),
        F.col("_kd_crc").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_kd_shard").cast("int").alias("shard"),
        F.col("_kd_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
