"""Bloom filters of distributed keys, built segment by segment and broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Bits

PARTS = 5


def filter_of(keys: DataFrame, n: int, most: int = 26, k: int = 4) -> Bits:
    """A filter of the long column `key` (with its level in a column `level`, if there
    is one) of about n keys and levels, of at most 2**most bits.  Beyond that size it
    lets more other keys pass, or gives a higher level, never a lower one, so an
    exact join must follow."""
    log2_bits = min(most, max(PARTS + 10, int(max(1, n) * 10).bit_length()))
    bits = Bits(PARTS, log2_bits, k)
    if "level" not in keys.columns:
        keys = keys.select("key", F.lit(1).alias("level"))

    def segment(t: pa.Table) -> pa.Table:
        own = t.column("key").to_numpy().view(np.uint64)
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([bits.segment(own, t.column("level").to_numpy())], pa.binary())})

    part = F.shiftrightunsigned("key", 64 - PARTS).cast("int")
    rows = keys.select("key", "level", part.alias("part")).groupBy("part").applyInArrow(segment, "part int, bits binary").collect()
    return assembled(bits, {r["part"]: bytes(r["bits"]) for r in rows})


def assembled(bits: Bits, segments: dict[int, bytes]) -> Bits:
    size = 1 << (bits.seg - 3)
    data = np.zeros(size << bits.parts, np.uint8)
    for part, own in segments.items():
        data[part * size : (part + 1) * size] = np.frombuffer(own, np.uint8)
    return Bits(bits.parts, bits.log2_bits, bits.k, data)
