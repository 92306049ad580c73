"""Language identification (operator 3).

Features are character 1- to 3-grams, hashed to 2**16 buckets for each length.  A
text's value at a bucket is its share of n-grams there, times the bucket's inverse
document frequency over all learning rows.  A multinomial logistic regression is
trained with follow-the-regularised-leader (proximal, per coordinate) under L1
and L2 penalties, so most weights are exactly zero; a temperature fitted on other
rows of the sample then calibrates the probabilities.

The regression is fitted on at most about `PER_LANG` texts of each language, and at
most about `SAMPLE` texts and `SAMPLE_BYTES` of features in all, drawn by a hash of
their id and text; whole texts, no prefixes.  The document frequencies cover all
learning rows.  The trainer holds two numbers for each bucket and language in the
driver, and the model, a quarter of that, is broadcast; more languages than fit
`MODEL_BYTES` raise an error.  A prediction gathers weights for `CELLS` characters times
languages at a time, whatever the length of a text or the number of languages.

Defined results: null texts and texts without a letter are `und` with score 0, as
is everything if nothing could be learned; rows with a null language only get
predictions; ties go to the first language by name; repeated rows get equal
results; other columns pass through, but for those named `_l_lang` and `_l_score`,
which the prediction replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, split_of, table, trim
from .kernel import LOWER, blob, buffer, code_points

ORDERS, BITS = 3, 16
#: texts of a language that the regression sees; of them, one in five calibrates
PER_LANG, SAMPLE, CALIBRATE = 600, 50_000, 5
#: bytes of features that reach the driver, and of what the trainer holds there
SAMPLE_BYTES, MODEL_BYTES = 256 << 20, 400 << 20
#: characters times languages whose weights are gathered at once
CELLS = 1 << 21
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.02, 0.02, 4, 10.0
SLICES = 16

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def characters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a batch of texts (A-Z lower-cased) and n + 1 offsets."""
    data, offs = buffer(col)
    data = LOWER[data]
    text = data.tobytes().decode("utf-8", "replace")
    if len(text) == int(code_points(data)[-1]):
        return np.frombuffer(text.encode("utf-32-le"), np.uint32), code_points(data)[offs]
    parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
    return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def grams(chars: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that begins at each character;
    the last bucket, which has no weight, where the text ends before."""
    out, own = [], chars.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(own), np.uint64)
    for n in range(ORDERS):
        size = len(own) - n
        if size > 0:
            total[:size] += own[n:] * _MULT[n]
        h = total * np.uint64(0xD6E8FEB86659FD93)
        b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64) + (n << BITS)
        for k in range(n):
            at = offs[1:] - 1 - k
            b[at[at >= offs[:-1]]] = ORDERS << BITS
        out.append(b)
    return out


WIDTH = (ORDERS << BITS) + 1


def document_frequency(texts: DataFrame) -> np.ndarray:
    """For each bucket the number of texts that have it, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mark = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, bool)
        for batch in batches:
            chars, offs = characters(batch.column(0))
            all_grams = grams(chars, offs)
            for a, b in zip(offs[:-1], offs[1:]):
                for g in all_grams:
                    mark[g[a:b]] = True
                total += mark
                mark[:] = False
        parts = np.array_split(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([blob(x) for x in parts], pa.binary())], names=["slice", "n"])

    def add(t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.int64) for x in t.column("n").to_pylist()]
        return pa.table({"slice": t.column("slice")[:1], "n": pa.array([blob(sum(rows))], pa.binary())})

    got = texts.mapInArrow(lean(count), "slice int, n binary").groupBy("slice").applyInArrow(add, "slice int, n binary").collect()
    rows = {r["slice"]: np.frombuffer(bytes(r["n"]), np.int64) for r in got}
    return np.concatenate([rows[k] for k in range(SLICES)]) if rows else np.zeros(WIDTH, np.int64)


def _sample(texts: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """texts: (lang, text).  The language, buckets and shares of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, offs = characters(batch.column("text"))
            all_grams = grams(chars, offs)
            at, share = [], []
            for a, b in zip(offs[:-1], offs[1:]):
                u, n = np.unique(np.concatenate([g[a:b] for g in all_grams]), return_counts=True)
                at.append(blob(u.astype(np.int32)))
                share.append(blob((n / max(1, b - a)).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["lang", "at", "share"])

    out, size = [], 0
    for r in texts.select("lang", "text").mapInArrow(lean(rows), "lang string, at binary, share binary").toLocalIterator():
        out.append((r["lang"], np.frombuffer(bytes(r["at"]), np.int32), np.frombuffer(bytes(r["share"]), np.float32)))
        size += len(r["at"]) + len(r["share"])
        if size > 2 * SAMPLE_BYTES:
            raise ValueError(f"the drawn texts have more than {2 * SAMPLE_BYTES} bytes of features")
    return sorted(out, key=lambda r: (r[1].tobytes(), r[0]))


class Model:
    """Weights by bucket and language, with the idf folded in, and a temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def logits(self, col: pa.Array) -> np.ndarray:
        chars, offs = characters(col)
        n = len(offs) - 1
        out = np.zeros((n, len(self.langs)))
        every, size = grams(chars, offs), max(1, CELLS // max(1, len(self.langs)))
        doc = np.repeat(np.arange(n), np.diff(offs))
        for a in range(0, len(chars), size):
            own = sum(self.weights[g[a : a + size]] for g in every)
            who = doc[a : a + size]
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            out[who[first]] += np.add.reduceat(own, first, axis=0)
        return out / np.maximum(1, np.diff(offs))[:, None] + self.bias

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(col), np.zeros(len(col))
        p = softmax(self.logits(col) / self.temperature)
        best = p.argmax(axis=1)
        ok = has_letter(col)
        return [self.langs[b] if x else "und" for b, x in zip(best, ok)], np.where(ok, p.max(axis=1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(col: pa.Array) -> np.ndarray:
    data, offs = buffer(col)
    low = LOWER[data]
    total = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    out = total[offs[1:]] > total[offs[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[k] = any(c.isalpha() for c in data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, for a multinomial model; the
    last coordinate is the bias, which has no L1 penalty."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((WIDTH + 1, classes)), np.zeros((WIDTH + 1, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == WIDTH, 0.0, L1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, y: int, at: np.ndarray, x: np.ndarray) -> None:
        at, x = np.append(at, WIDTH), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax((x @ w)[None])[0]
        p[y] -= 1.0
        g = x[:, None] * p
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros(0), 1.0)
    c = len(langs)
    place = {x: k for k, x in enumerate(langs)}
    data = [(place[lang], at, share.astype(float) * idf[at] * SCALE) for lang, at, share in rows]
    fitted = [d for k, d in enumerate(data) if k % CALIBRATE or len(data) < 50]
    other = [d for k, d in enumerate(data) if k % CALIBRATE == 0]
    ftrl, rng = Ftrl(c), np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fitted)):
            ftrl.learn(*fitted[k])
    ftrl.z[WIDTH - 1] = 0.0  # the bucket behind a text's end has no weight
    bias = ftrl.weights(np.array([WIDTH]))[0]
    logit = np.array([x @ ftrl.weights(at) + bias for _, at, x in other])
    y = np.array([d[0] for d in other])
    grid = np.exp(np.linspace(-3, 3, 121))
    loss = [-np.log(np.maximum(softmax(logit / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
    folded = np.empty((WIDTH, c), np.float32)
    for rows_ in np.array_split(np.arange(WIDTH), SLICES):
        folded[rows_] = ftrl.weights(rows_) * (idf[rows_] * SCALE)[:, None]
    return Model(langs, folded, bias, float(grid[int(np.argmin(loss))]))


def learn(rows: DataFrame) -> Model:
    """rows: (doc_id, text, lang); those without text or lang are passed over."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    most = MODEL_BYTES // (16 * (WIDTH + 1))
    cells = F.least(F.char_length("text") * ORDERS, F.lit(WIDTH)) * 8
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(cells).alias("bytes")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages, which do not fit {MODEL_BYTES} bytes")
    counts = {r["lang"]: r["n"] for r in found}
    df = document_frequency(rows.select("text"))
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    if not counts:
        return train([], idf)
    each, room = min(PER_LANG, SAMPLE // len(counts)), SAMPLE_BYTES / len(counts)
    rate = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, each / r["n"], room / max(1, r["bytes"])))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    return train(_sample(rows.where(draw < rate[F.col("lang")])), idf)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _l_lang and _l_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(text: pa.Array) -> pa.Array:
        lang, score = sent.value.predict(text)
        trim()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    name = fresh(docs, "_l")
    out = docs.withColumn(name, predict("text"))
    return out.withColumns({"_l_lang": F.col(f"{name}.lang"), "_l_score": F.col(f"{name}.score")}).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", split_of(F.col("doc_id"), 4) == 2)
    model = learn(docs.where(~F.col("held_out")))
    out = predicted(docs.select("doc_id", "text", "held_out"), model)
    return out.select("doc_id", "held_out", F.col("_l_lang").alias("lang_pred"), F.col("_l_score").alias("score"))
