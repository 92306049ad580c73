"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from proselens.llm import exact, ranked, registry, vectors

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [(1, None, 0), (2, "", 1), (3, " \t\n", 0), (4, "One", 0), (5, "one two three four", 0), (6, LONG, 0), (7, LONG, 0), (7, LONG, 0), (7, LONG, 1), (8, "ÀÉ 😀 x\x00y\n\nz", 0), (None, "alone here", 0), (None, "alone here", 0), (10, "a@b.c One two", 0), (10, "other text under the same id", 0), (11, "q" * 300_000, 0), (12, "q" * 300_001, 0), (13, "q" * 300_000, 0)]
VECTORS = [(1, None, 1), (2, [0.5] * 32, 1), (3, [None] + [0.5] * 31, 1), (4, [float("nan")] + [0.5] * 31, 1), (5, [float("inf")] * 32, 2), (6, [1.0] * 8, 2), (7, [], None), (None, [0.25] * 32, None), (2, [0.5] * 32, 1), (9, [-0.001 * k for k in range(32)], None), (0, [1.0] * 5, 3)]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, `group` int, `_whole` string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, "One two"), (1, "x y Z"), (None, "ALONE w5"), (3, ""), (4, None), (5, "w1 w1 w2 text")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(*r, 0.5) for r in VECTORS], "vec_id long, embedding array<float>, label int, error double").write.parquet(f"{top}/embeddings.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["op11_radix_dedup", "op12_block_max_search", "op13_annular_codes"])
def test_odd_rows_and_empty_tables(name, spark, odd_dir, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd_dir}/{t}.parquet/*.parquet'")
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    got = registry.QUERIES[name](spark, odd_dir)
    want = con.sql(registry.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == sorted(want.select(*[f'"{c}"' for c in order]).fetchall(), key=key)
    assert registry.QUERIES[name](spark, str(tmp_path)).collect() == []


# 11 exact copies


@pytest.mark.parametrize("digits", [exact.DIGITS, (1,), (2, 3)])
def test_radix_groups_are_those_of_equal_texts(spark, monkeypatch, digits):
    monkeypatch.setattr(exact, "DIGITS", digits)
    rng = np.random.default_rng(4)
    texts = ["", None, "a", "ab", "abc", "abcé", "abc\x00", "é", "\U0001f600b", "aaaa", "aaaaa"]
    docs = [(int(rng.integers(0, 40)) if k % 7 else None, texts[int(rng.integers(len(texts)))]) for k in range(120)]
    rows = exact.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by: dict[str, list] = {}
    for d, t in docs:
        by.setdefault(t or "", []).append(d)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    assert Counter((r["doc_id"], sha[r["text_sha256"]]) for r in rows) == Counter((d, t or "") for d, t in docs)
    for r in rows:
        own = by[sha[r["text_sha256"]]]
        assert (r["group_size"], r["keep_id"]) == (len(own), max((d for d in own if d is not None), default=None))
    kept = Counter(sha[r["text_sha256"]] for r in rows if r["kept"])
    assert kept == Counter(dict.fromkeys(by, 1)) and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_distinct_keeps_whole_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = exact.distinct(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert len(rows) == len({t or "" for _, t, _ in ODD}) and Counter(r["doc_id"] for r in rows if r["text"] == LONG) == {7: 1}


# 12 ranked search


def brute_ranks(docs, items):
    terms = {k: TERM.findall((t or "").translate(AZ)) for k, (_, t) in enumerate(docs)}
    n, total = sum(bool(t) for t in terms.values()), sum(map(len, terms.values()))
    df = Counter(w for t in terms.values() for w in set(t))
    out = []
    for item, text in items:
        score = {}
        for k, own in terms.items():
            tf, s = Counter(own), 0
            for w in TERM.findall((text or "").translate(AZ)):
                if tf[w]:
                    m = 100 - 75 + 75 * len(own) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
            if s > 0:
                score[k] = s
        best = sorted(score, key=lambda k: (-score[k], docs[k][0] is None, docs[k][0] or 0))[:10]
        out += [(item, r, docs[k][0], score[k]) for r, k in enumerate(best, 1)]
    return sorted(out, key=str)


def corpus(rng, n=400):
    words = [f"t{k}" for k in range(300)]
    p = 1 / np.arange(1, 301)
    docs = [(int(k), " ".join(rng.choice(words, int(rng.integers(1, 60)), p=p / p.sum()))) for k in rng.permutation(n)]
    docs += [(d + 5000, t) for d, t in docs[:30]] + [(None, docs[0][1]), (7, None), (8, "..")]
    items = [(k % 17, " ".join(rng.choice(words, int(rng.integers(1, 12)), p=p / p.sum())) + " unknown") for k in range(20)] + [(99, "unknown"), (100, None)]
    return docs, items


@pytest.mark.parametrize(("block", "size", "held"), [(64, 1 << 20, 8 << 20), (5, 200, 1000)])
def test_ranks_are_those_of_all_scores(spark, monkeypatch, block, size, held):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "ITEM_BYTES", size)
    monkeypatch.setattr(ranked, "HELD", held)
    docs, items = corpus(np.random.default_rng(8))
    got = ranked.searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_ranks(docs, items)


def test_whole_numbers_are_summed_as_longs_where_doubles_are_not_exact(spark, monkeypatch):
    docs, items = corpus(np.random.default_rng(3), 80)
    real = ranked.Items.weigh

    def long_sums(self, found_in, of):
        real(self, found_in, of)
        self.exact, self.weight = False, self.weight.astype(np.int64)

    monkeypatch.setattr(ranked.Items, "weigh", long_sums)
    of = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in ranked.searched(*of).collect()), key=str) == brute_ranks(docs, items)


def test_blocks_below_the_threshold_are_not_scored():
    rng = np.random.default_rng(1)
    items, of = ranked.Items(["rare1 rare2"]), ranked.Corpus(50, 1000)
    blocks = []
    for b in range(50):
        words = {int(h): 1 for h in rng.integers(1, 2**62, 20)}
        own = items.terms if b in (3, 9) else items.terms[:1] if b % 2 else items.terms[:0]
        terms = np.sort(np.array([*words, *own.tolist()], np.uint64))
        tf, size = np.full(len(terms), 2 if b == 3 else 1, np.uint32), np.array([20])
        most = ranked.impacts(tf.astype(np.int64), np.repeat(size, len(tf)), of).astype(np.int32)
        blocks.append({"block": b, "ids": [b], "sizes": size.tobytes(), "terms": terms.tobytes(), "most": most.tobytes(), "many": np.ones(len(terms), np.uint8).tobytes(), "doc": np.zeros(len(terms), np.uint8).tobytes(), "tf": tf.tobytes()})
    items.weigh(np.array([2, 2]), of)
    bounds = np.stack([items.bounds(b) for b in blocks])
    full = np.array([items.scores(b, np.array([0]))[0, 0] for b in blocks])
    assert (bounds[:, 0] >= full).all() and bounds[3, 0] == bounds.max()
    assert sorted(np.argsort(-bounds[:, 0], kind="stable")[:2].tolist()) == [3, 9]


def test_impacts_of_huge_corpora_do_not_overflow():
    of = ranked.Corpus(10**11, 10**14)
    n, tf = np.array([10**7, 10]), np.array([5, 1])
    want = [10**9 * t // (1000 * t + 8 * (25 + 75 * k * of.docs // of.terms)) for k, t in zip(n.tolist(), tf.tolist())]
    assert list(ranked.impacts(tf, n, of)) == want


# 13 vector codes


def test_nearest_entries_are_those_of_all_distances():
    rng = np.random.default_rng(6)
    for k, w, spread in ((64, 4, 20), (1, 3, 5), (7, 1, 3), (64, 2, 2), (256, 8, 10**6)):
        book = vectors.Codebook(rng.integers(-spread, spread + 1, (k, w)))
        x = np.concatenate([rng.integers(-spread, spread + 1, (500, w)), book.entries, np.zeros((1, w), np.int64)])
        far = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
        index, best = book.nearest(x)
        assert (best == far.min(1)).all() and (index == far.argmin(1)).all()


def test_few_entries_are_measured_in_an_annulus():
    rng = np.random.default_rng(2)
    book = vectors.Codebook((rng.normal(size=(256, 1)) * 1000).astype(np.int64))
    x = (rng.normal(size=(1000, 1)) * 1000).astype(np.int64)
    seen = []
    real = np.repeat
    try:
        np.repeat = lambda a, n, *r: seen.append(int(np.sum(n))) or real(a, n, *r)
        book.nearest(x)
    finally:
        np.repeat = real
    assert seen[0] < 1000 * 256 / 4


def test_codes_follow_the_rounds(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(v) for v in rng.normal(size=32).astype(np.float32) * 0.3], int(i) % 3 if i % 5 else None) for i in rng.permutation(200)]
    x = {i: [math.floor(256 * float(np.float32(v))) for v in e] for i, e, _ in rows}
    first = sorted(x)[:64]
    books = [[x[i][2 * p : 2 * p + 2] for i in first] for p in range(16)]
    near = lambda book, part: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            to: dict[int, list] = {}
            for own in x.values():
                to.setdefault(near(books[p], own[2 * p : 2 * p + 2])[1], []).append(own[2 * p : 2 * p + 2])
            books[p] = [[sum(v) // len(to[k]) for v in zip(*to[k])] if k in to else e for k, e in enumerate(books[p])]
    want = {i: [near(books[p], own[2 * p : 2 * p + 2]) for p in range(16)] for i, own in x.items()}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.digest(df).collect()
    line = ",".join(str(v) for b in books for e in b for v in e)
    errors = {i: sum(d for d, _ in w) for i, w in want.items()}
    of_label = Counter()
    for i, _, label in rows:
        of_label[label] += errors[i]
    label = {i: k for i, _, k in rows}
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == {i: ("".join(f"{k:02x}" for _, k in w), errors[i], of_label[label[i]]) for i, w in want.items()}
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(line.encode()).hexdigest()}
    codes, own = vectors.compressed(df)
    for r in codes.collect():
        assert ((vectors.restored(bytes(r["code"]), own) - np.array(x[r["vec_id"]])) ** 2).sum() == r["error"]


def test_components_beyond_the_bound_raise():
    with pytest.raises(ValueError, match="component"):
        vectors.whole(pa.array([[3e5, 0.0]]), 2)


# bounds of operator 3


def test_language_bounds_raise_or_draw_less(spark, monkeypatch):
    from proselens.llm import language

    rows = [(k % 3, f"text number {k} " * 20, f"l{k % 3}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.langs == ["l0", "l1", "l2"]
    monkeypatch.setattr(language, "SAMPLE_BYTES", 60_000)
    seen, real = [], language.train
    monkeypatch.setattr(language, "train", lambda own, idf: seen.append(len(own)) or real(own, idf))
    language.learn(docs)
    assert 0 < seen[0] < 60  # rows that share an id are drawn each for itself
    monkeypatch.setattr(language, "MODEL_BYTES", 16 * (language.WIDTH + 1) * 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.learn(docs)


# learned classes of operator 9


def test_words_that_soften_insults_are_learned(spark):
    from proselens.llm import kernel, toxicity

    own = lambda w: int(kernel.Words.of(pa.array([w]), kernel.ALNUM_WORD).hash[0])
    rows = [(f"you zorg number{k}. fine", 1) for k in range(60)] + [(f"he is hardly a zorg n{k}", 0) for k in range(30)] + [(f"in the gazette of day{k} some long words called him zorg", 0) for k in range(30)] + [("plain text", 0)] * 40 + [(None, 0)]
    key = int(toxicity.forms(kernel.Words.of(pa.array(["zorg"]), kernel.ALNUM_WORD))[0][0])
    sample = spark.createDataFrame(rows, "text string, toxic int")
    got = toxicity.modifiers(sample, toxicity.Scorer({key: 2.0}, {}))
    assert got[own("hardly")] == toxicity.NEGATION and got[own("gazette")] == toxicity.REPORT and own("you") not in got and own("fine") not in got
    assert toxicity.modifiers(sample.where("toxic = 1"), toxicity.Scorer({key: 2.0}, {})) == {} == toxicity.modifiers(sample.limit(0), toxicity.Scorer({key: 2.0}, {}))
    scorer = toxicity.Scorer({key: 2.0}, toxicity.CLOSED, got)
    x = scorer.features(pa.array(["He is hardly a zorg", "the gazette called him a zorg", "he is a zorg"]))
    assert (x[:, 2] > 0).tolist() == [True, False, False] and (x[:, 3] > 0).tolist() == [False, True, False]
