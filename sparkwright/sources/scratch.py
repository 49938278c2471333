"""Tables that the engine writes for itself and reads again, below the session's
checkpoint folder, which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwright-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _made.append(path)
    return path


def mark() -> int:
    """Where ``release`` is to start from, for what is made after this moment."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes the folders made since a ``mark``, once their tables are used or
    stored; returns how many there were.  Other users of the process keep theirs
    if they were made before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while len(_made) > since:
        target = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(target.getFileSystem(conf).delete(target, True))
    return gone


def forget(spark: SparkSession, path: str) -> None:
    """Deletes one folder of ``scratch`` before the others."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: else they stay on disk until the
    driver's collector meets their plans, so those of all steps of a run add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, run once and kept below the checkpoint folder with its partitions in their
    order, which Spark does not keep when it reads the files of a table."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet and read back, whatever its columns are called: its
    plan runs once, and what is read has fixed partitions and order within them."""
    path = f"{path or scratch(df.sparkSession)}/rows"
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    with brief_shuffles(df.sparkSession):
        plain.write.option("compression", compression).parquet(path)
    back = df.sparkSession.read.schema(plain.schema).parquet(path)
    return back.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(df.columns)])
