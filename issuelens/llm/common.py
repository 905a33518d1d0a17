"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process gets a folder of its own; a cluster has to name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/issuelens-{uuid.uuid4().hex}"
    if _kept.get() is not None:
        _kept.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are removed at the end: what is built on them has to be saved by then."""
    token = _kept.set([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _kept.get():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _kept.reset(token)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, empty for null."""
    return text_or_empty(column).cast("binary")


def n_words(column: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, mod 5: the split that the contracts name. Null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def splits(df: DataFrame) -> int:
    """Number of input splits, which follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small, whatever the session allows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    spark.conf.set(key, str(min(now, rows) if now > 0 else rows))


def least_hashed(df: DataFrame, n: int, *then: str, key: str = "key") -> DataFrame:
    """The n rows of least key, a 64-bit hash: the same sample in every run.

    Where there are many more rows, only those below the share of the hashes that surely holds n of them are sorted, so
    that tasks don't send n rows each.
    """
    rows = df.count()
    if rows > 4 * n:
        df = df.where(F.col(key) < int(-(1 << 63) + (1 << 64) * (2.0 * n / rows)))
    return df.orderBy(key, *then).limit(n)
