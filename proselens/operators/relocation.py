"""Claim markers within aligned scopes: what moved although nothing is missing."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import align, revision
from . import markers as mk


def scoped_differences(pairs: DataFrame, once: tuple[str, ...] = ()) -> DataFrame:
    """Markers removed and added between aligned scopes; all markers of a scope
    without partner were removed or added.  Scopes without markers give no row.  Kinds in
    `once` count once in a scope, however often they stand there."""
    cut = pairs.select("pair_id", tx.scopes(mk.prose("before")).alias("old"), tx.scopes(mk.prose("after")).alias("new"))
    rows = align.changed_scopes(cut)  # equal scopes have equal markers, which cancel
    rows = tx.unnest(rows, ["pair_id", "scope", "side"], mk.prose_claims(F.col("text")), "value")
    n = lambda side: F.count_if(F.col("side") == side)
    kind = F.substring_index("value", ":", 1).isin(*once) if once else F.lit(False)
    both = rows.groupBy("pair_id", "scope", "value").agg(n("old").alias("n_old"), n("new").alias("n_new"))
    both = both.withColumns({c: F.when(kind, F.least(c, F.lit(1))).otherwise(F.col(c)) for c in ("n_old", "n_new")})
    return both.select("pair_id", "scope", "value", F.greatest(F.col("n_old") - F.col("n_new"), F.lit(0)).alias("removed"), F.greatest(F.col("n_new") - F.col("n_old"), F.lit(0)).alias("added")).where("removed + added > 0")


def relocations(pairs: DataFrame) -> DataFrame:
    """Markers that stand in another scope than before, in pairs that keep all
    their markers: a warning, no violation.  The k-th loss of a marker is held against
    its k-th gain, among aligned scopes."""
    diff = scoped_differences(pairs).where("scope >= 0")
    kept = revision.differences(pairs, {"claims": mk.claims}).select("pair_id").distinct()
    rows = diff.join(kept, "pair_id", "left_anti").groupBy("pair_id", "value").agg(F.least(F.sum("removed"), F.sum("added")).alias("moved"))
    return rows.where("moved > 0").groupBy("pair_id").agg(F.sum("moved").alias("moved"))


RELOCATED = "pair_id long, ladder string, original string, revised string, old_start int, new_start int"


def crypto_relocations(pairs: DataFrame) -> DataFrame:
    """Words of a crypto ladder that stand in another scope, where both sides hold
    each of its levels equally often.  Each old word takes the first word of its level
    that stands in the scope aligned with its own, else the first that is left."""
    text = pairs.select("pair_id", tx.every("before", r"[^.!?;\n]+|[.!?;\n]+").alias("old"), tx.every("after", r"[^.!?;\n]+|[.!?;\n]+").alias("new"))

    def side(name: str) -> DataFrame:
        rows = revision.occurrences(pairs, revision.CRYPTO, name, True)
        return rows.groupBy("pair_id", "ladder").agg(F.array_sort(F.collect_list(F.struct("start", "level", "match"))).alias(name))

    both = side("before").join(side("after"), ["pair_id", "ladder"])
    levels = lambda c: F.array_sort(F.transform(c, lambda x: x["level"]))
    both = both.where(levels("before") == levels("after"))
    rows = both.groupBy("pair_id").agg(F.collect_list(F.struct("ladder", "before", "after")).alias("words")).join(text, "pair_id")

    def cut(pieces: list[str]) -> tuple[list[str], list[tuple[int, int]]]:
        texts, spans, at = [], [], 0
        for x in pieces:
            if x[0] not in ".!?;\n" and x.strip():
                texts.append(x.strip().casefold())
                spans.append((at, at + len(x)))
            at += len(x)
        return texts, spans

    def place(spans: list[tuple[int, int]], at: int) -> int | None:
        k = bisect_right(spans, (at, 1 << 60)) - 1
        return k if k >= 0 and spans[k][0] <= at < spans[k][1] else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples():
                (old, old_at), (new, new_at) = cut(list(r.old)), cut(list(r.new))
                to = {i: j for i, j, _ in align.aligned_scopes(old, new)}
                for w in r.words:
                    left: dict = {}
                    for x in w["after"]:
                        left.setdefault(x["level"], []).append((x["start"], x["match"]))
                    for x in w["before"]:
                        have = left[x["level"]]
                        want = to.get(place(old_at, x["start"]))
                        k = next((k for k, (at, _) in enumerate(have) if place(new_at, at) == want), None)
                        at, match = have.pop(0 if k is None else k)
                        if k is None:
                            out.append((r.pair_id, w["ladder"], x["match"], match, x["start"], at))
            yield pd.DataFrame(out, columns=["pair_id", "ladder", "original", "revised", "old_start", "new_start"])

    return rows.select("pair_id", "words", "old", "new").mapInPandas(run, RELOCATED)
