"""Admission of targets by approval (SRC19, J31).

A manifest names a case, who approved it as what, when, and the digests of its texts.
A case is admitted if all of it holds; else every reason is given.  Manifests are joined
to the cases by the case, and the digests of the texts are made in the JVM, so no text
is shuffled.

Defined results: a case without a manifest, or with several, is refused for that alone;
a null text is empty; a time must be a whole ISO time with a zone; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: fixed values: what a manifest must say
REQUIRED = {"schema": "approved-style-target-v1", "source": "author-approved", "approval_status": "approved"}
#: a date, or a date and a time, and the zone behind it
TIME = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
DIGESTS = ("before_sha256", "target_sha256", "screening_sha256")


def zoned(time: Column | str) -> tuple[Column, Column]:
    """Whether a text is an ISO time at all, and whether it has a zone."""
    t = F.coalesce(tx.c(time), F.lit(""))
    part = lambda k: F.regexp_extract(t, TIME, k)
    clock = F.when(part(2) == "", "00:00").otherwise(part(2))
    real = t.rlike(TIME) & F.try_to_date(part(1)).isNotNull() & clock.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?$")
    return real, part(3) != ""


def decided(cases: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """cases: key, before, target, screening (texts), frozen (whether the target keeps
    what must be kept).  manifests: key, schema, source, approval_status,
    content_stable_confirmed, approved_utc and the three digests.  A row for each case:
    admitted, and the reasons of a refusal in order."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = cases.select(key, *[F.sha2(text(d.removesuffix("_sha256")), 256).alias(f"_{d}") for d in DIGESTS], (tx.canonical(text("before")) == tx.canonical(text("target"))).alias("_same"), F.coalesce("frozen", F.lit(False)).alias("_frozen"))
    many = manifests.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in (*REQUIRED, "content_stable_confirmed", "approved_utc", *DIGESTS)])
    rows = own.join(many, key, "left")
    real, zone = zoned("approved_utc")
    tests = [
        *[(f"{k} is not {v}", ~F.col(k).eqNullSafe(F.lit(v))) for k, v in REQUIRED.items()],
        ("content stability is not confirmed", ~F.coalesce("content_stable_confirmed", F.lit(False))),
        ("approved_utc is no time", ~real),
        ("approved_utc has no zone", real & ~zone),
        *[(f"{d} differs", ~F.col(d).eqNullSafe(F.col(f"_{d}"))) for d in DIGESTS],
        ("target equals before", F.col("_same")),
        ("target changes what must be kept", ~F.col("_frozen")),
    ]
    why = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]))
    one = F.array(F.lit("no manifest")).cast("array<string>")
    several = F.array(F.lit("several manifests")).cast("array<string>")
    reasons = F.when(F.col("_n").isNull(), one).when(F.col("_n") > 1, several).otherwise(why)
    return rows.select(key, (F.size(reasons) == 0).alias("admitted"), F.array_join(reasons, "; ").alias("reasons"))
