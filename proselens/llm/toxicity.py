"""Toxicity by a weighted finite-state grammar over clauses (operator 9).

A lexicon acceptor reads each word and gives it a class: insult (with a learned
weight), threat, target, negation or reported speech.  Insults are words or word
starts that labelled toxic texts have far more often than clean ones (a
likelihood-ratio test); the other classes are word lists that a caller may pass, by
default short closed lists, and what the labels add to them: words that stand in
clauses with an insult and whose texts are then toxic far less often than such texts
are, by the same test.  They are negations if they mostly stand within three words
ahead of the insult, else reported speech.

Five weighted transducers read the classes of a clause.  Insult and threat emit a
weight under a label of their own; negation and report, and at the clause's end the
target, rewrite the label by the state they are in.  Their composition is one
deterministic machine, whose states are made as they are first reached.  It runs
over the clauses that hold an insult or a threat, and sums weights by label: plain,
aimed, negated, reported, threat.  A logistic regression over a text's sums and
their density gives the score.

The lexicon and the regression are fitted on at most about `SAMPLE` labelled rows
of each label, whole texts.

Defined results: null and empty texts have no clause and get a score as any other
clean text; without labels of both kinds every score is 0; labels that are null
are not used; rows with equal texts get equal scores; other columns pass through,
but for one named `_t_score`, which the score replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_small, keep, lean, split_of, table, trim
from .kernel import ALNUM_WORD, Words, blob, hash_spans

#: labelled rows of each label that are learned from
SAMPLE = 4000
#: bytes of the word starts that may enter the lexicon; 0 is the whole word
STARTS = (0, 4, 5, 6, 7, 8)
#: texts that must have an insult, its least log-odds, and its least test value
SUPPORT, ODDS, TEST = 6, 1.4, 30.0
CUT = 0.7

INSULT, THREAT, TARGET, NEGATION, REPORT = 1, 2, 3, 4, 5
#: closed classes, in the languages of the corpus; a default
CLOSED = {
    THREAT: "kill hurt beat destroy burn shoot stab smash töten schlagen verletzen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours they them he him she her people du dich dir ihr euch ihnen tu te toi vous eux usted ustedes tú ellos",
    NEGATION: "not no never nor neither without nicht kein keine nie niemals pas jamais aucun ni nunca jamás ningún",
    REPORT: "said says say told wrote quoted claimed called according sagte schrieb laut dit disait écrit selon dijo dicen escribió según",
}
_CLAUSE = np.zeros(256, bool)
_CLAUSE[list(b".!?;:\n")] = True


def _hashes(words: list[str]) -> np.ndarray:
    own = Words.of(pa.array([" ".join(words)]), ALNUM_WORD)
    return own.hash


def forms(words: Words) -> list[np.ndarray]:
    """For each of STARTS the hash of that start of each word; 0 where the word
    is not longer."""
    out = []
    size = words.ends - words.starts
    for n in STARTS:
        if not n:
            out.append(words.hash | np.uint64(1))
            continue
        h = np.zeros(len(size), np.uint64)
        long = np.flatnonzero(size > n)
        h[long] = (hash_spans(words.data, words.starts[long], words.starts[long] + n) & ~np.uint64(1)) + np.uint64(n << 56)
        out.append(h & ~np.uint64(1))
    return out


class Machine:
    """A weighted transducer over word classes.  arcs: (state, class, near) to the
    next state, where near tells whether the word before is at most three words away
    and class 0 stands for any other; emits: class to label; rewrites: (state, label)
    to label, for what other machines emit; ends: the same at the clause's end.  A
    label of None drops the weight."""

    def __init__(self, arcs: dict | None = None, emits: dict | None = None, rewrites: dict | None = None, ends: dict | None = None):
        self.arcs, self.emits, self.rewrites, self.ends = arcs or {}, emits or {}, rewrites or {}, ends or {}

    def step(self, state: int, kind: int, near: bool) -> int:
        return self.arcs.get((state, kind, near), self.arcs.get((state, 0, near), state))


def _both(state: int, kind: int, to: int) -> dict[tuple[int, int, bool], int]:
    return {(state, kind, near): to for near in (False, True)}


INSULTS = Machine(emits={INSULT: "insult"})
THREATS = Machine(emits={THREAT: "threat"})
#: a negation holds for three words; a second one takes it back
NEGATED = Machine({**_both(0, NEGATION, 1), (1, NEGATION, True): 0, (1, NEGATION, False): 1, (1, 0, False): 0, (1, INSULT, False): 0, (1, THREAT, False): 0}, rewrites={(1, "insult"): "negated", (1, "threat"): None})
REPORTED = Machine(_both(0, REPORT, 1), rewrites={(1, "insult"): "reported", (1, "negated"): "reported"})
#: a target anywhere in the clause aims its insults; a threat without one is none
TARGETED = Machine(_both(0, TARGET, 1), ends={(0, "insult"): "plain", (1, "insult"): "aimed", (0, "threat"): None})


class Grammar:
    """The composition of the transducers."""

    LABELS = ("plain", "aimed", "negated", "reported", "threat")

    def __init__(self, parts: tuple[Machine, ...] = (INSULTS, THREATS, NEGATED, REPORTED, TARGETED)):
        self.parts = parts
        self.next: dict[tuple, tuple] = {}
        self.last: dict[tuple, str | None] = {}

    def _step(self, state: tuple, kind: int, near: bool) -> tuple[tuple, str | None]:
        """The next state, and the label of what is emitted on the way."""
        to = tuple(m.step(s, kind, near) for m, s in zip(self.parts, state))
        label = next((m.emits[kind] for m in self.parts if kind in m.emits), None)
        for m, s in zip(self.parts, to):
            label = m.rewrites.get((s, label), label)
        return to, label

    def _end(self, state: tuple, label: str) -> str | None:
        for m, s in zip(self.parts, state):
            label = m.ends.get((s, label), label)
        return label

    def clause(self, kinds: list[int], near: list[bool], weights: list[float]) -> tuple[list[float], float]:
        """Weights of insults by label, and the weight of threats."""
        state, sums = (0,) * len(self.parts), dict.fromkeys(self.LABELS, 0.0)
        emitted: dict[str, float] = {}
        for kind, close, weight in zip(kinds, near, weights):
            key = (state, kind, close)
            if key not in self.next:
                self.next[key] = self._step(*key)
            state, label = self.next[key]
            if label is not None:
                emitted[label] = emitted.get(label, 0.0) + weight
        for label, weight in emitted.items():
            key = (state, label)
            if key not in self.last:
                self.last[key] = self._end(*key)
            if self.last[key] is not None:
                sums[self.last[key]] += weight
        return [sums[x] for x in self.LABELS[:4]], sums["threat"]


FEATURES = 9


class Scorer:
    """The lexicon, the grammar and the regression."""

    def __init__(self, lexicon: dict[int, float], closed: dict[int, str] = CLOSED, learned: dict[int, int] | None = None):
        keys = sorted(lexicon)
        self.keys = np.array(keys, np.uint64)
        self.weights = np.array([lexicon[k] for k in keys])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(36)).astype(np.int64) & ((1 << 20) - 1)] = True
        self.closed = np.concatenate([np.zeros(1, np.uint64), *[_hashes(v.split()) for v in closed.values()]])
        self.kinds = np.concatenate([[0], *[np.full(len(v.split()), k) for k, v in closed.items()]]).astype(np.int64)
        more = {h: k for h, k in (learned or {}).items() if h not in set(self.closed.tolist())}
        self.closed = np.concatenate([self.closed, np.array(sorted(more), np.uint64)])
        self.kinds = np.concatenate([self.kinds, np.array([more[h] for h in sorted(more)], self.kinds.dtype)])
        order = np.argsort(self.closed)
        self.closed, self.kinds = self.closed[order], self.kinds[order]
        self.grammar = Grammar()  # its states are kept from batch to batch
        self.coef: np.ndarray | None = None
        self.centre = self.width = None

    def insults(self, words: Words) -> np.ndarray:
        """The weight of each word: that of its heaviest form."""
        out = np.zeros(len(words.hash))
        if not len(self.keys):
            return out
        for h in forms(words):
            some = np.flatnonzero(self.maybe[(h >> np.uint64(36)).astype(np.int64) & ((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            hit = self.keys[at] == h[some]
            out[some[hit]] = np.maximum(out[some[hit]], self.weights[at[hit]])
        return out

    def features(self, col: pa.Array) -> np.ndarray:
        words = Words.of(col, ALNUM_WORD)
        n = len(words.offs) - 1
        out = np.zeros((n, FEATURES))
        out[:, 8] = np.log1p(words.count)
        weight = self.insults(words)
        at = np.minimum(np.searchsorted(self.closed, words.hash), len(self.closed) - 1)
        kind = np.where(self.closed[at] == words.hash, self.kinds[at], 0)
        kind[weight > 0] = INSULT
        hot = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        if not len(hot):
            return out
        # clauses: a mark between two words, or another text, ends one
        marks = np.concatenate([[0], np.cumsum(_CLAUSE[words.data], dtype=np.int64)])
        clause = marks[words.starts] + words.doc
        pick = np.flatnonzero((kind > 0) & np.isin(clause, clause[hot]))
        cuts = np.flatnonzero(np.concatenate([[True], clause[pick][1:] != clause[pick][:-1], [True]]))
        near = np.concatenate([[False], (pick[1:] - pick[:-1]) <= 3])
        kinds, close, doc = kind[pick].tolist(), near.tolist(), words.doc[pick]
        weights = np.where(kind[pick] == THREAT, 1.0, weight[pick]).tolist()
        grammar = self.grammar
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            channels, threat = grammar.clause(kinds[a:b], close[a:b], weights[a:b])
            row = out[doc[a]]
            row[:4] += channels
            row[4] += threat
            row[5] = max(row[5], channels[0] + channels[1])
        total = out[:, 0] + out[:, 1]
        out[:, 6] = 100 * total / np.maximum(words.count, 20)
        pairs = np.unique(np.stack([words.doc[weight > 0], (weight[weight > 0] * 1e6).astype(np.int64)]), axis=1)
        out[:, 7] = np.bincount(pairs[0], minlength=n)[:n]
        out[:, :8] = np.log1p(out[:, :8])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Scorer":
        """Logistic regression by Newton steps, with a small L2 penalty."""
        self.centre, self.width = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.hstack([(x - self.centre) / self.width, np.ones((len(x), 1))])
        b = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(b)) * 0.5
            step = np.linalg.solve(h, z.T @ (y - p) - 0.5 * b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        self.coef = b
        return self

    def score(self, col: pa.Array) -> np.ndarray:
        if self.coef is None:
            return np.zeros(len(col))
        z = (self.features(col) - self.centre) / self.width
        return 1 / (1 + np.exp(-np.clip(z @ self.coef[:-1] + self.coef[-1], -30, 30)))


def _distinct(words: Words) -> Iterator[np.ndarray]:
    """For each text the distinct forms of its words."""
    every = forms(words)
    for a, b in zip(words.first[:-1], words.first[1:]):
        own = np.unique(np.concatenate([h[a:b] for h in every]))
        yield own[own > 0]


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[int, float]:
    """sample: (text, toxic).  Weights (log-odds) of the forms that pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(_distinct(Words.of(batch.column("text"), ALNUM_WORD)))
            u, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["form", "n"])

    toxic = sample.where("toxic > 0").select("text").mapInArrow(lean(count), "form long, n long").groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    some = {r["form"]: r["n"] for r in toxic.collect()}
    keys = np.array(sorted(some), np.int64)
    sent = sample.sparkSession.sparkContext.broadcast(keys)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for own in _distinct(Words.of(batch.column("text"), ALNUM_WORD)):
                own = own.view(np.int64)
                at = np.minimum(np.searchsorted(sent.value, own), max(0, len(sent.value) - 1))
                if len(sent.value):
                    total[at[sent.value[at] == own]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([blob(total)], pa.binary())], names=["n"])

    other = np.zeros(len(keys), np.int64)
    for r in sample.where("toxic <= 0").select("text").mapInArrow(lean(clean), "n binary").collect():
        other = other + np.frombuffer(bytes(r["n"]), np.int64)
    t, c = np.array([some[k] for k in keys.tolist()], float), other.astype(float)
    odds, test = contrast(t, c, n_toxic, n_clean)
    good = (odds >= ODDS) & (test >= TEST)
    return {int(k): float(w) for k, w in zip(keys[good].view(np.uint64), odds[good])}


def company(words: Words, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that stand in a clause with an insult (of some weight): text, hash, and
    whether within three words ahead of one; a row for each text and word."""
    marks = np.concatenate([[0], np.cumsum(_CLAUSE[words.data], dtype=np.int64)])
    clause = marks[words.starts] + words.doc
    hot = np.flatnonzero(weight > 0)
    some = np.flatnonzero(np.isin(clause, clause[hot]) & (weight <= 0)) if len(hot) else hot
    after = hot[np.minimum(np.searchsorted(hot, some), max(0, len(hot) - 1))] if len(hot) else some
    near = (after > some) & (after - some <= 3) & (clause[after] == clause[some])
    order = np.lexsort((~near, words.hash[some], words.doc[some]))
    doc, own, near = words.doc[some][order], words.hash[some][order], near[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]) if len(own) else np.zeros(0, bool)
    return doc[new], own[new], near[new]


def modifiers(sample: DataFrame, scorer: Scorer) -> dict[int, int]:
    """sample: (text, toxic).  Words that soften an insult beside them, and their class."""
    sent = sample.sparkSession.sparkContext.broadcast(scorer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words.of(batch.column("text"), ALNUM_WORD)
            doc, own, near = company(words, sent.value.insults(words))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            every = np.unique(doc)  # under hash 0, the texts that have such a clause
            doc, own, near = np.concatenate([doc, every]), np.concatenate([own, np.zeros(len(every), np.uint64)]), np.concatenate([near, np.zeros(len(every), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(toxic[doc].astype(np.int64)), pa.array(near.astype(np.int64))], names=["word", "toxic", "near"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(count), "word long, toxic long, near long")
    rows = rows.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), F.sum("near").alias("near")).where(F.col("n") >= SUPPORT).collect()
    base = next(((r["t"], r["n"] - r["t"]) for r in rows if r["word"] == 0), (0, 0))
    out = {}
    for r in rows:
        if r["word"] and min(base):
            odds, test = contrast(np.array([float(r["t"])]), np.array([float(r["n"] - r["t"])]), *base)
            if test[0] >= TEST and odds[0] <= -ODDS:
                out[int(np.int64(r["word"]).view(np.uint64))] = NEGATION if 2 * r["near"] > r["n"] else REPORT
    return out


def contrast(t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and likelihood-ratio test of counts in toxic and clean texts."""
    odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    rate = (t + c) / (n_toxic + n_clean)
    test = 2 * (np.where(t > 0, t * np.log(np.maximum(t, 1e-9) / (n_toxic * rate)), 0.0) + np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / (n_clean * rate)), 0.0))
    return odds, test


def learn(rows: DataFrame, labels: DataFrame, closed: dict[int, str] = CLOSED) -> Scorer:
    """rows: (doc_id, text); labels: (doc_id, toxic); closed: the words of THREAT,
    TARGET, NEGATION and REPORT."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"] > 0): r["n"] for r in marks.join(rows.select("doc_id"), "doc_id").groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Scorer({}, closed)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") > 0, min(1.0, SAMPLE / counts[1])).otherwise(min(1.0, SAMPLE / counts[0]))
    few = keep(marks.where(draw < rate), "marks")  # about SAMPLE of each label, whatever the input
    sample = keep(rows.join(F.broadcast(few) if is_small(few) else few, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"), "labelled")
    n = {int(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Scorer({}, closed)
    words = lexicon(sample, n[1], n[0])
    scorer = Scorer(words, closed, modifiers(sample, Scorer(words, closed)))
    sent = sample.sparkSession.sparkContext.broadcast(scorer)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sent.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], names=["x", "y"])

    got = sample.mapInArrow(lean(rows_of), "x array<double>, y int").collect()
    x = np.array([r["x"] for r in got])
    y = np.array([float(r["y"] > 0) for r in got])
    order = np.lexsort((*x.T, y))
    return scorer.fit(x[order], y[order])


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with _t_score."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = pa.array(sent.value.score(text))
        trim()
        return out

    return docs.withColumn("_t_score", score("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", split_of(F.col("doc_id"), 3) == 1)
    labels = table(spark, sf_dir, "labels").where(split_of(F.col("doc_id"), 3) != 1)
    scorer = learn(docs.where(~F.col("held_out")), labels)
    out = scored(docs, scorer)
    return out.select("doc_id", "held_out", F.col("_t_score").alias("score"), (F.col("_t_score") >= CUT).cast("int").alias("predicted"))
