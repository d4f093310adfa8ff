"""What the operators share: the cluster's shared folder, cut lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. Java, Python and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of a few short columns may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes up to which a table with a column of any size may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of whole texts in an Arrow batch.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session without one gets a temporary folder; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if (own := sc.getCheckpointDir()) is not None:
        return own.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options) -> DataFrame:
    """The same rows, written once as a Parquet table in the shared folder: columns can be pruned and sizes are known."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Cut ``df`` and mark it for broadcast if it is ``held``; beyond that Spark picks the join."""
    return held(cut(df), limit, size)


def text_batches(spark: SparkSession) -> SparkSession:
    """Let whole texts go to Python by at most ``TEXT_ROWS`` rows at once (Spark's default is ten times that): what a task holds stays small. The session keeps the setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
    return spark


def held(df: DataFrame, limit: int, size: Column | None = None) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it has at most ``limit`` rows; beyond that Spark picks the join.

    Rows are a few numbers, or ``size`` says how many bytes a row's column of any size has: all of them must be at most ``BROADCAST_BYTES``.
    """
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and total <= BROADCAST_BYTES else df


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
