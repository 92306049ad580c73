"""The llm operators against brute force and SQL, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proselens.llm import common, decontamination, kernel, language, lm, mixing, near, pii, quality, registry, sharding, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "One", "en", None), (5, "one two three four", "de", "a"), (6, LONG, "en", "b"), (7, LONG, "en", "b"), (7, LONG, "en", "b"), (8, "ÀÉ 😀 x\x00y\n\nz", "fr", "b"), (None, "alone here", "fr", "b"), (10, "a@b.c 1.2.3.4 +1 (200) 555-7777", "de", "c"), (10, "other text under the same id", None, "c")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, `_q_score` double, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    common.prepare(spark)
    return spark.createDataFrame([(*r, 0, 9, 0.5, "x") for r in ODD], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def odd_dir(odd, spark, tmp_path_factory):
    """Odd documents as a data folder, with labels, pages and benchmark."""
    top = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (99, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (2, "no scheme", ""), (3, "http://A.Example.COM", None), (None, "x://h.net/de/8?q", "")], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([(1, None), (1, "one two"), (None, "ALONE"), (3, ""), (3, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


@pytest.fixture(scope="session")
def empty_dir(none, spark, odd_dir, tmp_path_factory):
    top = tmp_path_factory.mktemp("none")
    for name in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(x for x in registry.QUERIES if not x.startswith(("op12", "op13"))))  # these in test_new
def test_odd_and_empty_tables(name, spark, odd_dir, empty_dir):
    n = 5 if name.startswith("op6") else len(ODD)
    assert len(registry.QUERIES[name](spark, odd_dir).collect()) == n
    assert registry.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(name, agrees):
    assert agrees(registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def fixed(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# kernel


def test_word_hashes_tell_words_apart():
    col = pa.array(["Ab aB  cd\n", None, "", "é ab", "x" * 300 + " " + "x" * 301])
    w = kernel.Words.of(col)
    assert w.count.tolist() == [3, 0, 0, 2, 2]
    h = w.hash.tolist()
    assert h[0] == h[1] == h[4] and len(set(h)) == 5


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    col = pa.array([LONG, "w1 w2"])
    one = kernel.Words.of(col).hash
    monkeypatch.setattr(kernel, "_BLOCK", 64)
    assert (one == kernel.Words.of(col).hash).all()


def test_one_span_longer_than_a_block_is_hashed_in_blocks(monkeypatch):
    col = pa.array(["y" * 999 + " x " + "z" * 70 + " w" * 40, "q" * 2000])
    whole = kernel.Words.of(col).hash
    monkeypatch.setattr(kernel, "_powers", [np.ones(1, np.uint64)] * 2)
    monkeypatch.setattr(kernel, "_BLOCK", 64)
    assert (kernel.Words.of(col).hash == whole).all()
    assert len(kernel._powers[0]) <= 1 << 16


def test_bloom_levels_never_fall_short():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64)) << np.uint64(1)
    levels = rng.integers(1, 9, len(keys))
    bits = kernel.Bits(2, 17, 4)
    part = (keys >> np.uint64(62)).astype(int)
    data = b"".join(bits.segment(keys[part == p], levels[part == p]) for p in range(4))
    full = kernel.Bits(2, 17, 4, np.frombuffer(data, np.uint8))
    got = full.level(keys, 20)
    assert (got >= levels).all() and (got == levels).mean() > 0.5
    assert full.has(keys + np.uint64(1)).mean() < 0.7


# 1 language model


def test_lm_base_score_is_exact(spark, small, texts):
    counts, train = Counter(), [t for d, t in texts.items() if fixed(d, 5) != 1]
    for t in train:
        counts.update(WORD.findall(t.translate(AZ)))
        counts["\0"] += 1
    total, distinct = sum(counts.values()), len(counts)
    rows = registry.QUERIES["op1_lm_bloom"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = [*WORD.findall(texts[r["doc_id"]].translate(AZ)), "\0"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(counts[w] > 0 for w in own), total, fixed(r["doc_id"], 5) == 1)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in rows)


def lm_rows(spark):
    train = [(i, "the cat sat on the mat", False) for i in range(40)] + [(99, "zebra", False)]
    return spark.createDataFrame([*train, (201, "the cat sat", True), (202, "cat the sat", True), (203, None, True)], "doc_id long, text string, held_out boolean")


def test_lm_scores_follow_from_probes(spark):
    docs = lm_rows(spark)
    model, counts = lm.model_for(docs.where("not held_out"))
    level = model.levels(kernel.Words.of(pa.array(["the cat unseen"])).hash)
    assert lm.DECODE[level[0]] == pytest.approx(80, rel=0.2) and lm.DECODE[level[1]] == pytest.approx(40, rel=0.2) and level[2] == 0
    out = {r["doc_id"]: r for r in lm.learned_scores(docs).collect()}
    assert out[201]["score"] > out[202]["score"] and out[201]["base_score"] == pytest.approx(out[202]["base_score"])


def test_lm_score_by_brute_force(spark):
    """Counts quantised, weights from the tally, the formula for each token."""
    docs = lm_rows(spark)
    model, counts = lm.model_for(docs.where("not held_out"))
    looked = lm.looked_up(docs, model, counts)
    model.weights = lm.fit(looked, model.floor)
    words, pairs = Counter(), Counter()
    own = lambda t: [*WORD.findall((t or "").translate(AZ)), "\0"]
    for r in docs.collect():
        if not r["held_out"]:
            w = own(r["text"])
            words.update(w)
            pairs.update(zip(["\0", *w], w))
    about = lambda c: lm.DECODE[lm.quantised(np.array([c]))[0]] if c else 0.0
    got = {r["doc_id"]: r["score"] for r in lm.scored(looked, model, counts).collect()}
    for r in docs.collect():
        w, total = own(r["text"]), 0.0
        for before, word in zip(["\0", *w], w):
            a = model.weights[lm.quantised(np.array([words[before]]))[0] if words[before] else 0]
            seen = min(1.0, about(pairs[before, word]) / max(about(words[before]), 1.0))
            total += math.log10(a * seen + (1 - a) * (about(words[word]) + 0.5) / model.floor)
        assert got[r["doc_id"]] == pytest.approx(total, rel=1e-9)


def test_lm_filter_in_segments_scores_alike(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", (common.split_of(F.col("doc_id"), 5) == 1).alias("held_out"))
    whole = {r["doc_id"]: tuple(r) for r in lm.learned_scores(docs).collect()}
    monkeypatch.setattr(lm, "MOST_BITS", 8)
    apart = {r["doc_id"]: tuple(r) for r in lm.learned_scores(docs).collect()}
    assert whole.keys() == apart.keys()
    for k, v in whole.items():
        assert apart[k][:5] == v[:5] and apart[k][5:] == pytest.approx(v[5:], rel=1e-9)


def test_lm_segment_is_read_for_many_chunks_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    keys, n = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64)), np.arange(900) % 40 + 1
    half = {"word_keys": keys[:400], "word_counts": n[:400].astype(np.int64), "pair_keys": keys[400:], "pair_counts": n[400:].astype(np.uint32)}
    rows = [(-1, 5, *[kernel.blob(x) for x in half.values()])]
    chunks = [(np.sort(rng.choice(keys[:400], k % 4)), np.sort(rng.choice(keys[400:], 3))) for k in range(300)]
    rows += [(k, 5, kernel.blob(a), kernel.blob(b)) for k, (a, b) in enumerate(chunks)]
    calls, level = [], kernel.Bits.level
    monkeypatch.setattr(kernel.Bits, "level", lambda self, k, most: calls.append(len(k)) or level(self, k, most))
    monkeypatch.setattr(lm, "SLAB", 250)
    got = {r["chunk"]: r for r in lm._answer(pa.Table.from_batches([lm._rows(rows)]), 20).to_pylist()}
    assert len(calls) < 12 and max(calls) <= 250 and len(got) == 300
    of = dict(zip(keys.tolist(), n.tolist()))
    for k, (a, b) in enumerate(chunks):
        assert np.frombuffer(got[k]["c"], np.int64).tolist() == [of[x] for x in a.tolist()]
        for name, own in (("a", a), ("b", b)):
            assert np.frombuffer(got[k][name], np.uint8).tolist() == lm.quantised(np.array([of[x] for x in own.tolist()], np.int64)).tolist()


# 2 quality


def test_quality_statistics(spark, small, texts):
    for r in registry.QUERIES["op2_quality_forest"](spark, small).collect():
        t = texts[r["doc_id"]]
        w, seen, dup, cover = WORD.findall(t), set(), 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if three[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op2_quality_forest"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.05 * n[(0, False)] and n.get((1, False), 0) <= 0.03 * n[(1, True)]


def test_quality_verdicts_by_brute_force(spark, small, texts):
    """Each tree walked node by node, the mean path, the threshold, the verdict."""
    measured = quality.with_statistics(spark.read.parquet(f"{small}/documents.parquet"))
    forest, cut = quality.fit(measured, spark.read.parquet(f"{small}/labels.parquet"))
    got = {r["doc_id"]: r["kept"] for r in registry.QUERIES["op2_quality_forest"](spark, small).collect()}
    kept = {r["doc_id"] for r in quality.kept_documents(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert kept == {d for d, k in got.items() if k}
    for r in measured.collect():
        s = {x: np.array([r[f"_q_{x}"]]) for x in quality.STATS}
        x, total = quality.features(s)[0], 0.0
        for feat, at, left, right, path in forest.trees:
            k = 0
            while feat[k] >= 0:
                k = left[k] if x[feat[k]] < at[k] else right[k]
            total += path[k]
        score = 2 ** (-total / len(forest.trees) / forest._average(forest.each))
        failed = r["_q_n_words"] < 50 or 100 * r["_q_n_repeat_words"] > 50 * r["_q_n_words"]
        assert got[r["doc_id"]] == (not failed and score < cut)


def test_quality_verdicts_are_stable_over_samples(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    measured = common.keep(quality.with_statistics(spark.read.parquet(f"{sf}/documents.parquet")), "stats")
    labels, verdicts = spark.read.parquet(f"{sf}/labels.parquet"), []
    for seed in (11, 12):
        monkeypatch.setattr(quality.Forest.__init__, "__defaults__", (quality.TREES, quality.EACH, seed))
        verdicts.append({r["doc_id"]: r["_q_kept"] for r in quality.judged(measured, *quality.fit(measured, labels)).collect()})
    assert sum(verdicts[0][d] != verdicts[1][d] for d in verdicts[0]) <= 0.02 * len(verdicts[0])


def test_forest_paths_are_shorter_outside():
    rng = np.random.default_rng(0)
    forest = quality.Forest(np.vstack([rng.normal(size=(500, 2)), [[9, 9]]]))
    inside, outside = forest.score(np.array([[0.0, 0.0], [9.0, 9.0]]))
    assert outside > inside + 0.15
    same = quality.Forest(np.ones((300, 2)))
    assert same.score(np.ones((1, 2)))[0] == pytest.approx(0.5, abs=0.2)


def test_threshold_is_between_the_labels():
    seen = np.zeros((2, quality.SCORE_BINS))
    seen[0, 700], seen[1, 300] = 10, 90
    assert 0.3 < quality.threshold(seen) <= 0.7
    assert quality.threshold(seen * [[0], [1]]) == quality.THRESHOLD


# 3 language


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (fixed(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_language_without_letters(spark):
    docs = spark.createDataFrame([(1, "der die das", "de"), (2, "the of and", "en")] * 3 + [(3, "12 34 !?", None), (4, None, None), (5, "日本", None)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    got = {r["doc_id"]: r["_l_lang"] for r in language.predicted(docs, model).collect()}
    assert got[3] == got[4] == "und" and got[5] != "und" and got[1] == "de" and got[2] == "en"


def test_language_weights_are_sparse(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.learn(docs)
    assert 0 < (model.weights != 0).any(axis=1).mean() < 0.5 and model.temperature > 0


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(4)
    got, z, n = language.Ftrl(3), {}, {}

    def weight(i, k):
        a = z.get((i, k), 0.0)
        l1 = 0.0 if i == language.WIDTH else language.L1
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((language.BETA + math.sqrt(n.get((i, k), 0.0))) / language.ALPHA + language.L2)

    for _ in range(40):
        at, y = np.sort(rng.choice(50, 6, replace=False)), int(rng.integers(3))
        x = rng.random(6) * 5
        got.learn(y, at, x)
        row = [*zip(at.tolist(), x.tolist()), (language.WIDTH, 1.0)]
        w = {(i, k): weight(i, k) for i, _ in row for k in range(3)}
        e = [math.exp(sum(v * w[i, k] for i, v in row)) for k in range(3)]
        for i, v in row:
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == y))
                step = (math.sqrt(n.get((i, k), 0.0) + g * g) - math.sqrt(n.get((i, k), 0.0))) / language.ALPHA
                z[i, k] = z.get((i, k), 0.0) + g - step * w[i, k]
                n[i, k] = n.get((i, k), 0.0) + g * g
    at = np.append(np.arange(50), language.WIDTH)
    assert got.weights(at) == pytest.approx(np.array([[weight(i, k) for k in range(3)] for i in at.tolist()]))


def test_predictions_against_a_plain_sum(monkeypatch):
    rng = np.random.default_rng(5)
    model = language.Model(["a", "b", "c"], rng.normal(size=(language.WIDTH, 3)).astype(np.float32), rng.normal(size=3), 1.7)
    texts = ["Der Hund", None, "", "é 日本 x", LONG[:3000], "12"]
    col = pa.array(texts)
    whole = model.logits(col)
    monkeypatch.setattr(language, "CELLS", 30)
    assert model.logits(col) == pytest.approx(whole, abs=1e-4)
    chars, offs = language.characters(col)
    every = language.grams(chars, offs)
    for k, t in enumerate(texts):
        own = sum((model.weights[g[i]].astype(float) for g in every for i in range(offs[k], offs[k + 1])), np.zeros(3)) / max(1, offs[k + 1] - offs[k])
        assert whole[k] == pytest.approx(own + model.bias, abs=1e-3)
    lang, score = model.predict(col)
    p = np.exp(whole / 1.7) / np.exp(whole / 1.7).sum(axis=1, keepdims=True)
    assert lang == [model.langs[p[k].argmax()] if t and any(c.isalpha() for c in t) else "und" for k, t in enumerate(texts)]
    assert [s for s in score if s] == pytest.approx([p[k].max() for k in (0, 3, 4)], abs=1e-6)


# 4 near copies


def brute_components(docs):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall((t or "").translate(AZ))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {d: d for d in docs}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    comp[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}


@pytest.mark.parametrize("block", [near.BLOCK, 3])
def test_near_join_on_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = np.random.default_rng(5)
    docs, n = {}, 0
    for g in range(12):
        base = [f"t{rng.integers(400)}" for _ in range(int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 12))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(1000)}"
            docs[n] = " ".join(own)
            n += 1
    docs |= {n: "", n + 1: "Shared words", n + 2: "shared WORDS"}
    got = near.joined(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)


@pytest.mark.parametrize(("block", "meet", "keys"), [(4, 2048, 256), (16, 3, 0), (1, 5, 10**9)])
def test_large_blocks_of_template_texts(spark, monkeypatch, block, meet, keys):
    """Texts that share sentences and mostly do not link: one block, many parts.  Few
    pairs meet, whatever the size of a block and of a key."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "MEET", meet)
    monkeypatch.setattr(near, "KEYS", keys)
    rng, pairs = np.random.default_rng(11), []
    shared = [" ".join(f"s{k}x{j}" for j in range(9)) for k in range(6)]
    docs = {}
    for d in range(90):
        own = [" ".join(f"o{d % 70}y{k}z{j}" for j in range(9)) for k in range(4)]
        if d >= 70:
            own[0] = own[0].replace("z0", "edited")
        docs[d] = " ".join([shared[k] for k in sorted(rng.choice(6, 3, replace=False))] + own) if d < 70 else docs[d - 70].replace("z0", "zz")
    # texts of long passages: ten of a pool of fourteen, some of them but for one the same
    pool = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(14)]
    for d in range(100, 160):
        docs[d] = " ".join(pool[k] for k in sorted(rng.choice(14, 10, replace=False))) if d < 130 else docs[d - 30].replace(pool[int(rng.integers(14))], "", 1)
    real = near.met
    monkeypatch.setattr(near, "met", lambda keyed: pairs.append(real(keyed).count()) or real(keyed))
    got = near.joined(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)
    assert all(n < len(docs) ** 2 / 4 for n in pairs)


def test_block_search_equals_all_pairs():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**62, 60, dtype=np.uint64))
    sets = []
    for _ in range(150):
        own = base.copy()
        own[rng.choice(len(base), int(rng.integers(0, 14)), replace=False)] += np.uint64(1)
        sets.append(np.unique(own))
    prefixes = [[s for s in sets]] * 3
    got = near.verified(sets, prefixes)
    want = brute = list(range(len(sets)))
    for i in range(len(sets)):
        hit = np.flatnonzero(near.linked(sets[i], sets))
        low = min(brute[j] for j in hit)
        want = [low if b in {brute[j] for j in hit} else b for b in brute]
        brute = want
    assert len(set(got)) == len(set(want)) and all((got[a] == got[b]) == (want[a] == want[b]) for a in range(150) for b in range(150))


# 5 sharding


def test_shards_are_even_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = sharding.digest(docs).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == sharding.SHARDS and size.max() / size.min() < 1.05
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    assert (got["size"].sum(), len(got)) == (docs.select(F.sum(F.octet_length("text") + 8)).first()[0], docs.count())


def test_equal_texts_share_a_shard_unless_heavy(spark):
    rows = [(i, f"text {i} " + "y" * 90, "en", "s") for i in range(4000)] + [(5000 + i, "copy " + "z" * 90, "en", f"s{i}") for i in range(5)] + [(6000 + i, "hot " + "h" * 90, "en", "s") for i in range(2000)]
    got = sharding.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert got[got.doc_id.between(5000, 5004)].shard.nunique() == 1
    assert got[got.doc_id >= 6000].shard.nunique() > 4
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.1


def test_tree_against_a_plain_one(spark):
    """Each node split by plain loops at the weighted median along its widest side."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 900))) + f" {i % 1500}", f"l{rng.integers(4)}", f"s{rng.integers(9)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    seen = {}
    own = sharding.tree
    sharding.tree = lambda units, shards: seen.setdefault("rows", units.toPandas()) is None or own(units, shards)
    try:
        got = {r["doc_id"]: r["shard"] for r in sharding.digest(docs).collect()}
    finally:
        sharding.tree = own
    units = seen["rows"].to_dict("records")
    spread = {d: (max(u[d] for u in units) - min(u[d] for u in units)) or 1.0 for d in sharding.DIMS}
    want = {}

    def cut(weights, n, goal):
        total = 0.0
        for b in range(n):
            if total + weights.get(b, 0) > goal:
                return b, total
            total += weights.get(b, 0)
        return n, total

    def add(out, key, w):
        out[key] = out.get(key, 0) + w

    def grow(part, first, last):
        if last - first == 1 or not part:
            want.update({u["doc_id"]: first for u in part})
            return
        wide = {d: max(u[d] for u in part) - min(u[d] for u in part) for d in sharding.DIMS}
        dim = max(sharding.DIMS, key=lambda d: wide[d] / spread[d])
        low = min(u[dim] for u in part)
        place = lambda u: 0 if not wide[dim] else min(sharding.BINS - 1, int((u[dim] - low) / wide[dim] * sharding.BINS))
        half = (last - first) // 2
        coarse, fine = {}, {}
        for u in part:
            add(coarse, place(u), u["_kd_bytes"])
        goal = sum(coarse.values()) * half / (last - first)
        b, done = cut(coarse, sharding.BINS, goal)
        for u in part:
            if place(u) == b:
                add(fine, u["_kd_sub"], u["_kd_bytes"])
        s, more = cut(fine, sharding.SUB, goal - done)
        if s < sharding.SUB and goal - done - more > fine.get(s, 0) / 2:
            s += 1
        left = [(place(u), u["_kd_sub"]) < (b, s) for u in part]
        grow([u for u, x in zip(part, left) if x], first, first + half)
        grow([u for u, x in zip(part, left) if not x], first + half, last)

    grow(units, 0, sharding.SHARDS)
    assert got == want


def test_a_group_is_cut_just_above_the_bound(spark, monkeypatch):
    rows = [(i, f"{i:06d}" + "y" * 86, "en", "s") for i in range(2400)]
    total = 2500 * 100
    for n, one in ((2, True), (3, False)):  # 200 and 300 bytes; the bound lies between
        monkeypatch.setattr(sharding, "HEAVY", 250 * sharding.SHARDS / total)
        copies = [(9000 + k, "z" * 92, "en", f"s{k}") for k in range(n)]
        made = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, source string")
        seen = {}
        own = sharding.tree
        sharding.tree = lambda units, shards: seen.setdefault("rows", units.toPandas()) is None or own(units, shards)
        try:
            sharding.digest(made)
        finally:
            sharding.tree = own
        copies = seen["rows"][seen["rows"].doc_id >= 9000]
        assert (copies["_kd_sub"].nunique() == 1 and copies["_kd_source"].nunique() == 1) == one


def test_slots_and_copies_do_not_depend_on_order(spark):
    """Ids with equal hashes, rows without an id, and partitions in another order."""
    h = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
    first, same = {}, []
    for i in range(200_000):
        if (j := first.setdefault(h(str(i)), i)) != i:
            same += [j, i]
    rows = [(i, f"word {i % 3}", "en", "s") for i in [*same, *range(40)]] + [(None, f"none {k}", "en", "s") for k in range(20)]
    kind = "doc_id long, text string, lang string, source string"
    a, b = spark.createDataFrame(rows, kind).coalesce(1), spark.createDataFrame(rows[::-1], kind).repartition(7)
    assert same and sorted(map(str, sharding.digest(a).collect())) == sorted(map(str, sharding.digest(b).collect()))
    drawn = [sorted(str(r) for r in mixing.with_copies(common.keep(mixing.sized(x), "mix")).collect()) for x in (a, b)]
    assert drawn[0] == drawn[1]


def test_shards_by_target_bytes(spark):
    rows = sharding.measured(spark.createDataFrame([(i, "x" * 92, "en", "s") for i in range(100)], "doc_id long, text string, lang string, source string"))
    assert sharding.sharded(rows, target_bytes=2500).select("_kd_shard").distinct().count() == 4


# 6 urls


def test_trie_precedence():
    t = urls.Trie([*urls.RULES, ("allow", "x.org", ""), ("block", "a.b", "/p/q"), ("allow", "a.b", "/p/q"), ("block", "", "/any/")])
    say = lambda h, p: (t.judge(h, p) or (None,))[0]
    assert say("www.example.com", "/en/7817") == "allow" and say("www.example.com", "/en/8") == "block" and say("example.com", "/fr/7") is None
    assert say("m.example.net", "/de/8") == "block" and say("com", "/en/") == "block" and say("notexample.com", "/en/7") == "block"
    assert say("x.org", "/es/1") == "allow" and say("a.b", "/p/q") == "block" and say("q.q", "/any/") == "block" and say("", "") is None


def test_registered_rules_are_those_of_the_contract(spark, tmp_path):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{action} {host}{path}" for action, host, path in urls.RULES) == contract
    spark.createDataFrame([(1, "http://h.net/de/1"), (2, "http://m.example.net/de/8"), (3, "http://h.net/en/1")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.query(spark, str(tmp_path)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: (None, "allow")}


# 7 decontamination


def brute_hits(docs, items, n=13):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for i, t in items:
        w = cut.findall((t or "").translate(AZ))
        k = min(n, len(w))
        windows += [(i, w[j : j + k]) for j in range(len(w) - k + 1) if k]
    out = {}
    for d, t in docs.items():
        w = cut.findall((t or "").translate(AZ))
        hit, who = set(), set()
        for i, win in windows:
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    who.add(str(i))
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def brute_near(docs, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = {d: cut.findall((t or "").translate(AZ)) for d, t in docs.items()}
    df = Counter(w for own in words.values() for w in set(own))
    found = {d: [] for d in docs}
    for i in sorted({str(i) for i, _ in items}):
        own = {w for j, t in items if str(j) == i for w in cut.findall((t or "").translate(AZ))}
        few = sorted((df[w], w.encode()) for w in own if w in df)[: decontamination.TERMS]
        if len(few) < decontamination.LEAST:
            continue
        few = [w.decode() for _, w in few]
        need = math.ceil(decontamination.SHARE_NEAR * len(few))
        for d, w in words.items():
            centres = [k for k, x in enumerate(w) if x in few[: len(few) - need + 1]]
            if any(len({x for x in w[max(0, k - decontamination.SPREAD) : k + decontamination.SPREAD + 1] if x in few}) >= need for k in centres):
                found[d].append(i)
    return {d: (len(x), hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()) for d, x in found.items()}


@pytest.mark.parametrize("block", [decontamination.BLOCK_WORDS, 10])
def test_decontamination_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    rng = np.random.default_rng(3)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 9, k)]
    items = [(k, " ".join(word(int(rng.integers(0, 18))))) for k in range(8)] + [(9, " ".join(f"u{k}" for k in range(20)))]
    docs = {k: " ".join(word(60)) + ". " + items[k % 9][1].upper() for k in range(30)} | {40: "", 41: " ".join(f"u{k}" for k in range(2, 17))}
    got = decontamination.digest(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = got.collect()
    assert {r["doc_id"]: (*tuple(r)[1:5], r["contaminated"]) for r in got} == brute_hits(docs, items)
    assert {r["doc_id"]: (r["n_near"], r["near_sha256"]) for r in got} == brute_near(docs, items)


def test_proximity_finds_reworded_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    other = "filler words " * 40
    docs = {1: f"{other} kappa x alpha beta y gamma delta z epsilon new eta theta {other}", 2: f"alpha {other} beta {other} gamma {other} delta", 3: item, 4: "", 5: other}
    got = decontamination.digest(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([("i", item), ("short", "alpha beta")], "item_id string, text string")).collect()
    assert {r["doc_id"]: (r["n_near"], r["near_sha256"]) for r in got} == brute_near(docs, [("i", item), ("short", "alpha beta")])
    assert {r["doc_id"]: r["n_near"] for r in got} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


# 8 personal data


def test_entities_by_brute_force(spark, small, texts):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for kind, p in pats.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
                if not bad:
                    out.append((kind, m.start(), m.end()))
        return out

    odd = ["a@b.c@d.e", "x@@y.z q@w.e.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 01.2.3.4", "4539 1488 0343 6467-", "+1 (200) 555-7777)) +12", "é@b.c ü+a@b-.c", "@a.b", "1.2.3.4@5.6", "+1+2 3 4 5 6 7 8 9 0 1"]
    for t in [*odd, *texts.values()]:
        assert pii.entities(t) == brute(t), t[:80]
    rows = {r["doc_id"]: r for r in registry.QUERIES["op8_private_terms"](spark, small).collect()}
    for d, t in texts.items():
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert rows[d]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and rows[d]["spans"].startswith(line)


def test_terms_that_reveal_are_found(spark, monkeypatch):
    rows = [(i, f"filler{i} words zorblat wrote from zor@mail.org about things {i} today") for i in range(6)] + [(100 + i, f"filler{i} words about common things today number {i}") for i in range(200)] + [(900, "only zorblat is named here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert [x["kind"] for x in got[900]["terms"]] in (["term"], ["hint"]) and got[900]["spans"] == [] and got[150]["terms"] == []
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # the same by a filter and a join
    assert {r["doc_id"]: r for r in pii.spans(docs).collect()} == got
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "zorblat" not in clean[900] and "[EMAIL]" in clean[0] and clean[150] == dict(rows)[150]


def test_terms_by_direct_counting(spark):
    """All words of documents with an entity, near or far, against plain counts."""
    rng = np.random.default_rng(8)
    docs = {}
    for d in range(400):
        words = [f"v{x}" for x in rng.zipf(1.5, 30) % 300]
        if d % 40 == 0:
            words = ["Heading", "quirinal", *words, f"mail me{d // 400}@site.org"]
        if d % 57 == 0:
            words += ["10.0.0.7"] + ["often"] * (d % 3)
        docs[d] = " ".join(words)
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    holds, has = {}, {}
    for d, t in docs.items():
        own, spans = pii.entities(t), set()
        for _, s, e in own:
            holds.setdefault(t[s:e], set()).add(d)
            spans |= set(range(s, e))
        for m in cut.finditer(t.translate(AZ)):
            has.setdefault(m[0], {"all": set(), "free": set()})["all"].add(d)
            if not spans & set(range(*m.span())):
                has[m[0]]["free"].add(d)
    n, want = len(docs), {}
    for e, de in holds.items():
        for t, dt in has.items():
            both = len(de & dt["free"])
            if both >= pii.SUPPORT and len(de) >= pii.SUPPORT:
                share = math.log2(n * both / (len(dt["all"]) * len(de))) / math.log2(n / len(de))
                if share >= pii.DISCLOSE:
                    want[t] = max(share, want.get(t, 0))
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["t"]: r["share"] for r in pii.revealing(rows, pii.found(rows)).collect()}
    names = {t: int(kernel.Words.of(pa.array([t]), kernel.ALNUM_WORD).hash.view(np.int64)[0]) for t in want}
    assert "quirinal" in want and got == {names[t]: pytest.approx(s) for t, s in want.items()}


# 9 toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = registry.QUERIES["op9_toxicity_grammar"](spark, sf).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (fixed(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    hit = sum(r["predicted"] for r in held if r["toxic"])
    assert hit / sum(r["toxic"] for r in held) > 0.85 and hit / sum(r["predicted"] for r in held) > 0.95


def test_grammar_scores_clauses():
    g = toxicity.Grammar()
    i, t, n, r = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT
    run = lambda *k, near=True: g.clause(list(k), [near] * len(k), [2.0] * len(k))[0]
    assert run(i) == [2, 0, 0, 0] and run(t, i) == [0, 2, 0, 0] and run(n, i) == [0, 0, 2, 0] and run(r, t, i) == [0, 0, 0, 2]
    assert run(n, n, i) == [2, 0, 0, 0] and run(n, i, near=False) == [2, 0, 0, 0]
    assert g.clause([toxicity.THREAT, t], [True, True], [1.0, 0])[1] == 1 and g.clause([n, toxicity.THREAT, t], [True] * 3, [0] * 3)[1] == 0


def test_machine_against_a_direct_reading():
    """Every clause of up to five classes: what the words say, read off directly."""
    from itertools import product

    i, t, n, r, th = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT
    g = toxicity.Grammar()
    assert len(g.parts) == 5
    for size in range(1, 5):
        for kinds in product((i, t, n, r, th), repeat=size):
            for near in product((False, True), repeat=size):
                out, threat, negated = [0.0] * 4, 0.0, False
                for k, kind in enumerate(kinds):
                    if kind == n:
                        negated = not negated if near[k] else True
                    elif negated and not near[k]:
                        negated = False
                    if kind == i:
                        out[3 if r in kinds[:k] else 2 if negated else 1 if t in kinds else 0] += 2.0
                    if kind == th and not negated and t in kinds:
                        threat += 1.0
                assert g.clause(list(kinds), list(near), [1.0 if k == th else 2.0 for k in kinds]) == (out, threat), (kinds, near)


def test_toxicity_scores_follow_from_features(spark):
    """A scorer's features by plain reading of the clauses, and the regression."""
    key = int(toxicity.forms(kernel.Words.of(pa.array(["zorg"]), kernel.ALNUM_WORD))[0][0])
    scorer = toxicity.Scorer({key: 2.0}, {toxicity.THREAT: "smite", toxicity.TARGET: "thou", toxicity.NEGATION: "nay", toxicity.REPORT: "quoth"})
    texts = ["Thou zorg!", "a zorg. Quoth he zorg", "nay zorg", "I smite thou", "", None, "clean text only"]
    x = scorer.features(pa.array(texts))
    log = lambda *v: pytest.approx([math.log1p(y) for y in v])
    assert x[:, 0] == log(0, 2, 0, 0, 0, 0, 0) and x[:, 1] == log(2, 0, 0, 0, 0, 0, 0)
    assert x[:, 2] == log(0, 0, 2, 0, 0, 0, 0) and x[:, 3] == log(0, 2, 0, 0, 0, 0, 0)
    assert x[:, 4] == log(0, 0, 0, 1, 0, 0, 0) and x[:, 8] == log(2, 5, 2, 3, 0, 0, 3)
    scorer.coef, scorer.centre, scorer.width = np.arange(10) / 10, np.zeros(9), np.ones(9)
    got = scorer.score(pa.array(texts))
    for k in range(len(texts)):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x[k], scorer.coef)) - 0.9)))


# 10 mixing


def test_mix_meets_its_targets(spark):
    got = registry.QUERIES["op10_systematic_mixing"](spark, "/root/testdata/sf0.1").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source").toPandas()
    got = got.merge(docs, on="doc_id")
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for _, own in got.groupby("source"):
        assert own.source_size.iloc[0] == own["size"].sum() and own.target.iloc[0] <= 2 * own["size"].sum()
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 2 * own["size"].max()
    each = got.groupby("source").target.first()
    assert each.sum() == pytest.approx(1.5 * got["size"].sum())


def test_targets_stop_at_twice_the_size(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 50)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    total = 1.5 * 1070
    assert got["a"] == 20 and got["c"] == 20 and got[None] == 100 and got["b"] == pytest.approx(total - 140)


def test_mixed_rows_repeat_documents(spark, odd):
    got = Counter(r["doc_id"] for r in mixing.mixed(odd).collect())
    assert mixing.mixed(odd).columns == odd.columns and max(got.values()) <= 6


def test_numbering_is_gapless(spark):
    from proselens.llm.numbering import hash32, numbered

    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("p"), hash32(F.col("id").cast("string")).alias("h"), "id")
    got = numbered(df, ["p"], "h", ["id"], "r", each=64).toPandas()
    for _, own in got.groupby("p", dropna=False):
        assert sorted(own.r) == list(range(1, len(own) + 1))
        assert own.sort_values("r").h.is_monotonic_increasing


def test_folder_has_no_swallowed_imports():
    import pathlib

    for p in pathlib.Path(common.__file__).parent.glob("*.py"):
        assert "except ImportError" not in p.read_text() and "localCheckpoint" not in p.read_text()
    assert duckdb.sql("SELECT 1").fetchall() == [(1,)]
