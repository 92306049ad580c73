"""Quality rules and an isolation forest over their statistics (operator 2).

Rule statistics are counted per text in numpy passes.  Random trees, each grown
on 256 documents of a sample, isolate a document by random splits of random
statistics; the mean path length gives its anomaly score.  The threshold comes
from all labelled rows: a histogram of scores by label, and the cut that is right
most often, as a mean over both labels.

The sample is the fit of a model and so bounded: `SAMPLE` documents, those with
the smallest hash of their statistics.  Everything else covers all rows.

Defined results: null or empty text has no words and fails the base rules; equal
rows get equal verdicts; labels that are null, or whose document is missing, are
not used; without labels of both kinds `THRESHOLD` holds; an empty table gives an
empty result; a verdict rests on the text alone.  `kept_documents` returns all
columns of its input, whatever their names; the statistics are narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, lean, table, trim
from .kernel import SPACE_WORD, Words, hash_spans, mix, ngrams, spans

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS, MAX_REPEAT = 50, 50
#: documents that the forest is grown on, trees, documents of a tree, score bins
SAMPLE, TREES, EACH, SCORE_BINS = 8192, 100, 256, 1000
#: the score that rejects where no labels say otherwise
THRESHOLD = 0.65


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of a batch."""
    words = Words.of(col, SPACE_WORD, lower=False)
    data, offs, n = words.data, words.offs, len(words.offs) - 1

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[offs[1:]] - total[offs[:-1]]

    chars = per_doc(((data & 0xC0) != 0x80) & SPACE_WORD[data])
    symbols = per_doc(SYMBOLS[data])
    # lines with a word, equal to an earlier line of their text
    starts, ends = line_spans(data, offs)
    first = np.searchsorted(words.starts, starts)
    full = (first < len(words.starts)) & (words.starts[np.minimum(first, max(0, len(words.starts) - 1))] < ends) if len(words.starts) else np.zeros(len(starts), bool)
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(offs, starts, "right") - 1
    dup = repeats(hash_spans(data, starts, ends) ^ mix(line_doc.astype(np.uint64)), first_too=False)
    # words in windows of three that occur twice or more in their text
    tri = ngrams(words.hash, 3)
    inside = words.doc[2:] == words.doc[: len(tri)] if len(tri) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    again = at[repeats(tri[at] ^ mix(words.doc[at].astype(np.uint64)), first_too=True)]
    cover = np.zeros(len(words.hash), bool)
    for k in range(3):
        cover[again + k] = True
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": np.bincount(line_doc[dup], minlength=n)[:n],
        "n_repeat_words": np.bincount(words.doc[cover], minlength=n)[:n],
        "n_lines": np.bincount(line_doc, minlength=n)[:n],
    }


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty lines between line feeds."""
    return spans(data != 0x0A, offs)


def repeats(keys: np.ndarray, first_too: bool) -> np.ndarray:
    """Whether a key occurs before (or, first_too, anywhere else)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1] if len(keys) else np.zeros(0, bool)
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    if first_too:
        out[order[:-1]] |= same
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Shares of symbols, repeats and the length of words.  Squares keep small
    shares of repeats, which many good texts have, close together."""
    words, lines, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1), np.maximum(s["word_chars"], 1)
    return np.stack(
        [
            s["n_symbols"] / words,
            s["n_symbols"] / chars,
            np.sqrt(s["n_symbols"] / words),
            (s["n_dup_lines"] / lines) ** 2,
            (s["n_repeat_words"] / words) ** 2,
            np.log1p(np.minimum(s["word_chars"] / words, 50)),
        ],
        axis=1,
    )


class Forest:
    """Isolation trees in arrays: split feature, cut, children, path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, each: int = EACH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.each = min(each, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.each, replace=False)], rng) for _ in range(trees)] if self.each > 1 else []

    @staticmethod
    def _average(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        most = int(np.ceil(np.log2(self.each)))
        feat, cut, left, right, path = [], [], [], [], []

        def node(own: np.ndarray, depth: int) -> int:
            k = len(feat)
            feat.append(-1), cut.append(0.0), left.append(k), right.append(k), path.append(depth + self._average(len(own)))
            if depth >= most or len(own) <= 1:
                return k
            lo, hi = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(hi > lo)
            if len(wide):
                f = int(rng.choice(wide))
                feat[k], cut[k] = f, float(rng.uniform(lo[f], hi[f]))
                below = own[:, f] < cut[k]
                left[k], right[k] = node(own[below], depth + 1), node(own[~below], depth + 1)
            return k

        node(rows, 0)
        return tuple(np.array(x) for x in (feat, cut, left, right, path))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the higher."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        for feat, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = np.arange(len(rows))
            while len(live):
                f = feat[at[live]]
                live, f = live[f >= 0], f[f >= 0]
                if not len(live):
                    break
                below = rows[live, f] < cut[at[live]]
                at[live] = np.where(below, left[at[live]], right[at[live]])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self._average(self.each))


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT)


def fails(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id of docs, and _q_ with STATS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(own[x].astype(np.int64)) for x in STATS]], names=["doc_id", *[f"_q_{x}" for x in STATS]])

    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(f"_q_{x}", T.LongType()) for x in STATS]])
    return narrow.mapInArrow(lean(count), schema)


def _stats_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {x: batch.column(f"_q_{x}").to_numpy(zero_copy_only=False) for x in STATS}


def fit(measured: DataFrame, labels: DataFrame | None) -> tuple[Forest, float]:
    """A forest over a sample of rows with doc_id and _q_ statistics, and the
    threshold from all labelled rows (doc_id, quality)."""
    stats = [f"_q_{x}" for x in STATS]
    sample = measured.select(*stats).orderBy(F.xxhash64("doc_id", *stats)).limit(SAMPLE).collect()
    own = {x: np.array([r[f"_q_{x}"] for r in sample], np.int64) for x in STATS}
    forest = Forest(features(own)) if sample else Forest(np.zeros((0, 6)))
    if labels is None:
        return forest, THRESHOLD
    sent = measured.sparkSession.sparkContext.broadcast(forest)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SCORE_BINS), np.int64)
        for batch in batches:
            s = _stats_of(batch)
            at = np.minimum((sent.value.score(features(s)) * SCORE_BINS).astype(int), SCORE_BINS - 1)
            good = batch.column("quality").to_numpy(zero_copy_only=False) > 0
            ok = ~fails(s)
            for q in (0, 1):
                seen[q] += np.bincount(at[ok & (good == bool(q))], minlength=SCORE_BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], SCORE_BINS)), pa.array(np.tile(np.arange(SCORE_BINS), 2)), pa.array(seen.ravel())], names=["q", "bin", "n"])

    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.select("doc_id", *stats).join(marks, "doc_id")
    got = rows.mapInArrow(lean(bins), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((2, SCORE_BINS))
    for r in got:
        seen[r["q"], r["bin"]] = r["n"]
    return forest, threshold(seen)


def threshold(seen: np.ndarray) -> float:
    """seen: documents by label (bad, good) and score bin.  The cut with the best
    mean of the shares of bad ones rejected and good ones kept; a run of equal
    cuts gives its middle."""
    if not seen.sum(axis=1).all():
        return THRESHOLD
    bad = 1 - np.concatenate([[0], np.cumsum(seen[0])]) / seen[0].sum()
    good = np.concatenate([[0], np.cumsum(seen[1])]) / seen[1].sum()
    value = bad + good
    best = np.flatnonzero(value >= value.max() - 1e-12)
    run = best[: int(np.argmax(np.append(np.diff(best) != 1, True))) + 1]
    return float(run[0] + run[-1]) / 2 / SCORE_BINS


def judged(measured: DataFrame, forest: Forest, cut: float) -> DataFrame:
    """Adds _q_score, _q_base_failed and _q_kept to rows with _q_ statistics."""
    sent = measured.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        own = dict(zip(STATS, (x.to_numpy() for x in (a, b, c, d, e, f))))
        return pd.Series(sent.value.score(features(own)))

    out = measured.withColumn("_q_score", score(*[F.col(f"_q_{x}") for x in STATS]))
    out = out.withColumn("_q_base_failed", base_failed(F.col("_q_n_words"), F.col("_q_n_repeat_words")))
    return out.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_score") < F.lit(cut)))


def kept_documents(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """docs without the rejected ones, columns as they were.  The second look at the
    texts spares a shuffle of whole rows; Python gets the text and returns a flag."""
    forest, cut = fit(keep(with_statistics(docs), "stats"), labels)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        own = statistics(text)
        ok = ~fails(own)
        ok[ok] = sent.value.score(features({k: v[ok] for k, v in own.items()})) < cut
        trim()
        return pa.array(ok)

    return docs.where(good(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = keep(with_statistics(docs), "stats")
    forest, cut = fit(measured, table(spark, sf_dir, "labels"))
    out = judged(measured, forest, cut)
    stats = [F.col(f"_q_{x}").alias(x) for x in STATS if x != "n_lines"]
    return out.select("doc_id", *stats, F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))
