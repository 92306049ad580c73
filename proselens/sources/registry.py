"""A registry that is replaced as a whole (SNK8).

A version of the registry is a folder of Parquet files, in the order of its paths.  A
small file, CURRENT, names the version that counts.  A new version is written beside the
old one, and then CURRENT is replaced by one rename of the file system's own, which either
happens or does not: who reads finds the old table or the new one whole.  A run that ends
in between leaves a version that no file names; the next replacement removes it.  The
same update may be run again: rows of a key replace those that it wrote before.

There is one writer at a time.  A registry that is not there yet is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT = "CURRENT"


def _fs(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> str | None:
    """The folder that counts, or None where there is no registry."""
    fs, at = _fs(spark, path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    own = version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{own}") if own else spark.createDataFrame([], schema)


def point(spark: SparkSession, path: str, name: str) -> None:
    """Make a version the one that counts, by one rename over the file that is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, target, draft = _fs(spark, path), hadoop.Path(f"{path}/{CURRENT}"), hadoop.Path(f"{path}/_{CURRENT}-{name}")
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(target), over)


def swept(spark: SparkSession, path: str) -> None:
    """Remove what CURRENT does not name."""
    own, fs = version(spark, path), _fs(spark, path)
    for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
        name = x.getPath().getName()
        if name not in (own, CURRENT) and name.startswith(("v-", f"_{CURRENT}-")):
            fs.delete(x.getPath(), True)


def replaced(spark: SparkSession, path: str, rows: DataFrame, order: str) -> None:
    """Write all rows, in order, as the new version, and make it count."""
    name = f"v-{uuid.uuid4().hex}"
    rows.orderBy(F.lower(order), order).write.parquet(f"{path}/{name}")
    point(spark, path, name)
    swept(spark, path)


def upserted(spark: SparkSession, path: str, new: DataFrame, key: str) -> None:
    """Rows of `new` replace those with the same key; others stay.  Keys of `new` are
    distinct."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
    old = read(spark, path, schema)
    replaced(spark, path, old.join(new.select(key), key, "left_anti").unionByName(new), key)
