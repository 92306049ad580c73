"""Derived inputs on which the queries discriminate.

The driver's documents are invented words, so each document gets one of sixteen
short English passages behind its own text, chosen by its id; a revision changes
one thing in the passage, chosen by its id too.  Spark and the SQL oracle build
both from the same lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PASSAGES = [
    "This groundbreaking system is pivotal. It serves as a tool for review. In other words, it works.",
    "Moreover, the method is efficient. Furthermore, the cost is 12.5 ms per query. However, the error may grow in the worst case setting. Additionally, we show a bound.",
    "The evaluation demonstrates the implementation of the configuration and the optimization. The result suggests a limit. It appears to hold; we conjecture more.",
    "We leverage a seamless landscape — it is important to note — that this helps. The design is not only fast but also small.",
    "# Introduction\nThe technical packaging is described. Our method achieves 40% less overhead than the baseline (\\cite{smith2020,lee2021}).\n\n# Evaluation\nThe runtime is 3 GB and 25 ms under \\ref{tab:cost}. The cost was measured by Ada.",
    "The scheme suggests adaptive security, thereby improving trust. It guarantees perfect privacy. Under the background of growth, the approach proves that the map is correct.",
    "The server is semi-honest and it shows no leakage. All approximate values are kept. We might not need approximate arithmetic in the honest setting.",
    "Some users often see higher latency than others. Many users usually see lower cost; a few see none, and most see better results.",
    "\\section{Methods}\nThe cipher text is packed, stored, and sent. The key-switching step and the Key-Switching step differ. FHE is used with bootstrapping.\n\\begin{equation}\na + b = c\n\\end{equation}\nInline $x^2 + y$ is kept.",
    "\\begin{figure}\n\\caption{Cost by \\textbf{size} in Fig. 3 and \\ref{fig:a}}\n\\label{fig:cost}\n\\end{figure}\nThe figure shows 128 bits and \\SI{10}{ms}.",
    "The result is consistent with theory. It is significantly faster on the evaluated workload. Limitation: it does not scale. However, future work will help.",
    "Although the map is large, we propose a fast path. Because it is small, it fits. Quickly the queue drains. Under load it stalls. We present a proof.",
    "The ciphertext is an encrypted value. The method and the framework differ in overhead and expense. At least three trials ran; every trial ended. The peer is semi-honest.",
    "It should be noted that the system boasts speed, scale, and trust. Essentially that is all. The experiment result shows growth.",
    "The adversary cannot win. It can't read the key and it won't stop. Neither side must fail, and nobody could prove it never will.",
    "",
]

#: (old, new) that the revision of passage k applies, or None for no change
EDITS = [
    ("groundbreaking", "useful"),
    ("error may grow in the worst case setting", "error grows"),
    ("suggests", "proves"),
    (" — it is important to note —", ""),
    ("lee2021", "park2022"),
    ("suggests adaptive security", "shows selective security"),
    ("All approximate values", "All exact values"),
    ("higher latency", "lower latency"),
    ("cipher text is packed", "cipher text and the cipher-text are packed"),
    ("128 bits", "256 bits"),
    ("It is significantly faster", "It may be faster"),
    ("we propose a fast path", "we prove a fast path"),
    ("every trial ended. The peer is semi-honest", "each trial ended. The peer is malicious"),
    ("boasts speed, scale, and trust", "has speed"),
    ("cannot win", "can win"),
    None,
]
N = len(PASSAGES)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(values: list[str]) -> Column:
    out = F.lit(values[-1])
    for k, v in enumerate(values[:-1]):
        out = F.when(F.col("doc_id") % N == k, F.lit(v)).otherwise(out)
    return out


def _pick_sql(values: list[str]) -> str:
    return f"CASE doc_id % {N} " + " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values)) + " END"


REVISED = [p.replace(*e) if e else p for p, e in zip(PASSAGES, EDITS)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text: the whole document and its passage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), _pick(PASSAGES)).alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, before, after: each document and its revision."""
    return revised(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def revised(docs: DataFrame, *more: Column) -> DataFrame:
    """The pairs of some documents, and more columns of them."""
    own = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"))
    return docs.select(F.col("doc_id").alias("pair_id"), F.concat(own, _pick(PASSAGES)).alias("before"), F.concat(own, _pick(REVISED)).alias("after"), *more)


#: a closing paragraph whose markers change places in the revision, word for word
MOVED = (
    "The map may hold for the whole town. The bridge stands near the old mill. The semi-honest case is first. Then comes the malicious peer.",
    "The map holds for the whole town. The bridge may stand near the old mill. The malicious case is first. Then comes the semi-honest peer.",
)


def moved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, each with the closing paragraph; in every third the revision moves
    its markers."""
    return pairs(spark, sf_dir).select("pair_id", _closed("before").alias("before"), moved_after().alias("after"))


def _closed(x: str) -> Column:
    return F.concat(x, F.lit("\n\n" + MOVED[0]))


def moved_after() -> Column:
    return F.when(F.col("pair_id") % 3 == 0, F.concat("before", F.lit("\n\n" + MOVED[1]))).otherwise(_closed("after"))


DOCS_SQL = f"docs AS (SELECT doc_id, lang, source, coalesce(text, '') || chr(10) || chr(10) || {_pick_sql(PASSAGES)} AS text FROM documents)"
PAIRS_SQL = f"pairs AS (SELECT doc_id AS pair_id, coalesce(text, '') || chr(10) || chr(10) || {_pick_sql(PASSAGES)} AS before, coalesce(text, '') || chr(10) || chr(10) || {_pick_sql(REVISED)} AS after FROM documents)"
