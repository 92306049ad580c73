"""What the operators share: tables, hash splits, the shared folder, lookups."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows and bytes of an Arrow batch: what a Python worker holds at once
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: rows of a batch that Spark decodes from Parquet, and bytes of a row group it writes:
#: whole texts are wide, and with Spark's own 4096 rows and 128 MB they fill a heap
READ_ROWS, ROW_GROUP = 512, 16 << 20
#: rows of a lookup table up to which it is broadcast (rows of tens of bytes)
BROADCAST_ROWS = 200_000
#: rows of a file of a narrow table whose size is known
FILE_ROWS = 100_000
#: batches after which a Python worker gives freed memory back
TRIM = 16


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one batch and one row group hold.  The settings stay in the
    session, as plans are lazy and are carried out after this returns."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS,
        "parquet.block.size": ROW_GROUP,
    }.items():
        try:
            spark.conf.set(key, str(value))
        except Exception as e:  # an older Spark bounds rows only
            if "CANNOT_MODIFY" not in str(e):
                raise
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod `modulus`; a null id counts as ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def trim() -> None:
    """Give freed memory of this process back: Arrow's pool and the C heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has its own way
        return


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that trims its worker's memory as it goes and
    at its end, as idle workers live on beside the tasks that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, out in enumerate(work(batches)):
            yield out
            if k % TRIM == TRIM - 1:
                trim()
        trim()

    return run


def lean_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group."""

    def run(rows: pa.Table) -> pa.Table:
        out = work(rows)
        if rows.nbytes > BATCH_BYTES:
            trim()
        return out

    return run


def merged(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def chunk_bytes(parts: int) -> int:
    """Bytes of a chunk that is dealt over 2**parts hash ranges: it grows with them,
    so that a row of a chunk and range holds more than a few words."""
    return min(32 << 20, 64 << parts)


def one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or where that is
    unset a folder of our own, on one machine only."""
    conf = spark.sparkContext.getConf()
    top = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="stages-")
    return _own["dir"]


_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut and
    a lost executor costs no more than the tasks it ran.  rows: a bound on the rows
    of a narrow table, if it is known; it is then written in files of `FILE_ROWS`."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables kept inside are deleted at the end, but for those that the given
    function keeps."""
    before, lasting = len(_written), []

    def last(df: DataFrame, name: str) -> DataFrame:
        out = keep(df, name)
        lasting.append(_written[-1])
        return out

    yield last
    for spark, path in [x for x in _written[before:] if x not in lasting]:
        forget(spark, path)
    _written[before:] = lasting


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            forget(spark, path)
        except Exception:  # the session is gone, and the folder is the cluster's
            return


def parts_for(total_bytes: int, each: int = 8 << 20, least: int = 4, most: int = 20) -> int:
    """log2 of the number of hash parts so that each covers about `each` bytes of text."""
    return min(most, max(least, (max(1, total_bytes) // each).bit_length()))


def lookup(big: DataFrame, small: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a table of keys under the alias it has; it is written once, and
    broadcast only if its row count shows that it is small, else the join is
    shuffled, and adaptive execution splits skewed keys."""
    return big.join(F.broadcast(small) if is_small(small) else small, on, how)


def is_small(kept: DataFrame) -> bool:
    return kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def row_hashes(df: DataFrame, of: str = "") -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row (without maps, which have no hash): rows
    that agree in both are taken as equal.  of: an alias and a dot."""
    own = [F.col(f"{of}`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*own), F.xxhash64(F.lit(20240607), *own)
