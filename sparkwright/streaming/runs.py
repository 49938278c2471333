"""Runs as a stream: files that land in a folder are cleaned once each, and the
queries of the run queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwright.contract import RunOptions, TableContract
from sparkwright.plans.ledger import run
from sparkwright.sources.sinks import write_run


def run_name(path: str, inbox: str) -> str:
    """A file's place below the inbox, so files of one name in several folders are
    runs of their own."""
    below = path.rstrip("/").split("/" + inbox.strip("/").rsplit("/", 1)[-1] + "/", 1)[-1]
    return below.removesuffix(".csv").replace("/", "-")


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, contract: TableContract | None = None, options: RunOptions = RunOptions(), mapper: Callable | None = None, available_now: bool = True, store: str | None = None) -> StreamingQuery:
    """Cleans every CSV file that lands in ``inbox`` or a folder of it.  The checkpoint is what
    claims a file: each goes through exactly one committed batch, and a batch
    that fails is tried again.  With ``store``, artifacts are registered there."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(inbox).select("path", "length")

    def process(batch: DataFrame, batch_id: int) -> None:
        for r in batch.select("path").orderBy("path").collect():  # names of the new files
            name = run_name(r.path, inbox)
            result = run(r.path, contract, options, spark=spark, mapper=mapper, run_id=name)
            try:
                write_run(result, f"{out}/{name}", store=store)
            finally:
                result.close()

    writer = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def claimable(runs: DataFrame, now: str, timeout_s: int = 300) -> DataFrame:
    """Queued runs and those whose heartbeat is older than the timeout."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(timeout_s)))
    return runs.filter((F.col("status") == "queued") | stale)


def next_run(runs: DataFrame, now: str, timeout_s: int = 300) -> DataFrame:
    """The oldest run that may be claimed; ties by id."""
    return claimable(runs, now, timeout_s).orderBy("created_at", "run_id").limit(1)


def queue_positions(runs: DataFrame) -> DataFrame:
    """1 + the number of queued runs created earlier.  Moments are summed up first,
    then days, so the one task of the order of days gets a row for each day, and
    that of a day a row for each of its moments."""
    queued = runs.filter(F.col("status") == "queued")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moments = queued.groupBy("created_at").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.to_date("created_at"))
    days = moments.groupBy("day").agg(F.sum("n").alias("n")).select("day", earlier(W.orderBy("day")).alias("before"))
    moments = moments.withColumn("within", earlier(W.partitionBy("day").orderBy("created_at"))).join(days, "day")
    return queued.join(moments.select("created_at", (F.col("before") + F.col("within") + 1).alias("position")), "created_at").select("run_id", "created_at", "position")


def by_state(runs: DataFrame, since: str) -> DataFrame:
    """(status, n) of runs created after a moment."""
    return runs.filter(F.col("created_at") > F.lit(since).cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def list_runs(runs: DataFrame, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = runs if status is None else runs.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "run_id").offset(offset).limit(max(1, min(limit, 100)))


def heartbeat_gaps(events: DataFrame, key: str, at: str, timeout_s: int = 300) -> DataFrame:
    """Sessions of a key: a gap longer than the timeout starts the next one."""
    w = W.partitionBy(key).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    started = events.withColumn("__new", (F.coalesce(gap, F.lit(0)) > timeout_s * 1_000_000).cast("int"))
    return started.withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
