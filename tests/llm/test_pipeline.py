"""The pipeline against brute force, stage by stage, each on its own input."""

import re
import subprocess
import sys
import textwrap
from collections import Counter

import corpus_pipeline as cp

from proselens.llm.common import keep

from .test_llm import brute_components, brute_hits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert [n for n, _ in cp.STAGES] == ["quality", "near", "decontamination", "mixing", "sharding"]
    for name, stage in cp.STAGES:
        before = docs.toPandas()
        out = keep(stage(spark, docs, small), "test")
        after = out.toPandas()
        text = dict(zip(before.doc_id, before.text))
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "quality":
            gone = set(before.doc_id) - set(after.doc_id)
            short = {d for d, t in text.items() if len(WORD.findall(t)) < 50}
            assert short <= gone and sum(labels.get(d) == 1 for d in gone - short) <= 5
        if name == "near":
            assert set(after.doc_id) == {c for _, c in brute_components(text).values()}
        if name == "decontamination":
            bad = {d for d, r in brute_hits(text, items).items() if r[-1]}
            assert bad and set(after.doc_id) == set(text) - bad
        if name == "mixing":
            assert set(after.doc_id) <= set(text) and max(Counter(after.doc_id).values()) <= 2
            size = lambda rows: sum(len(WORD.findall(t)) for t in rows)
            assert abs(size(after.text) - 1.5 * size(before.text)) < 0.1 * size(before.text)
        if name == "sharding":
            assert Counter(after.doc_id) == Counter(before.doc_id) and after.shard.between(0, 23).all()
        docs = out


def test_rows_without_an_id_pass(spark, small):
    rows = [(None, "some text of its own here", "en", "a", 1), (1, "x y z w v u", "en", "a", 1), (1, "x y z w v u", "en", "a", 1), (2, "x y z w v u", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.distinct(spark, docs, small).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None"]


def test_run_gives_every_mixed_row_a_slot(spark, small):
    got = cp.run(spark, small).toPandas()
    assert len(got) and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)


def test_entry_without_the_folder(tmp_path):
    code = """
        import sys, importlib.abc
        class Gone(importlib.abc.MetaPathFinder):
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("proselens.llm"):
                    raise ModuleNotFoundError(f"No module named {name!r}", name="proselens.llm" if name.startswith("proselens") else name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert e.queries() and not any(k.startswith("op") for k in e.queries()) and "pipeline" not in e.queries()
    """
    top = cp.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=top)
