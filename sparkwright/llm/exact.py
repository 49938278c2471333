"""Exact dedup by a log-structured merge index of text digests.  DataFrame
operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.shared import fresh, named, new_path, written

#: Memtables that a bulk load fills side by side; each flushes one sorted run.
MEMTABLES = 4
#: Runs of a level that are merged into one run of the next.
FAN_IN = 4
#: A filter has a bucket for so many digests, of 4 KB each, and at most 8 MB; one
#: that is fuller lets more through, with the same result.
BUCKET_BITS, BITS_EACH, MOST_BUCKETS = 1 << 15, 16, 2048


@dataclass(frozen=True)
class DigestFilter:
    """Bits of digests: rows (bucket, bits), ``buckets`` of them at most."""

    table: DataFrame
    buckets: int

    def bit(self, digest: str = "digest") -> Column:
        """1-based position of a digest's bit."""
        return F.pmod(F.xxhash64(digest), F.lit(self.buckets * BUCKET_BITS)) + 1


def buckets_for(digests: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-digests * BITS_EACH // BUCKET_BITS)))


def digest_filter(digests: DataFrame) -> DigestFilter:
    """The filter of a table's column ``digest``, sized by its rows, which are
    counted first; at most ``MOST_BUCKETS`` rows of 4 KB."""
    out = DigestFilter(digests, buckets_for(digests.count()))
    bit = digests.select(out.bit().alias("bit"))
    bits = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    return DigestFilter(written(bits, "filter"), out.buckets)


def probed(rows: DataFrame, filter_: DigestFilter, name: str, digest: str = "digest") -> DataFrame:
    """``rows`` and whether the filter may hold their ``digest``, in a column
    ``name``.  The filter's size is bounded by its form, so it is broadcast."""
    bucket, bits = fresh(rows, "bucket", "bits")
    at = F.bitmap_bit_position(filter_.bit(digest))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    table = filter_.table.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    out = rows.join(F.broadcast(table), F.bitmap_bucket_number(filter_.bit(digest)) == F.col(bucket), "left")
    return out.withColumn(name, F.coalesce(held, F.lit(False))).drop(bucket, bits)


def may_hold(rows: DataFrame, filter_: DigestFilter, digest: str = "digest") -> DataFrame:
    """The rows whose digest may be in the filter."""
    (held,) = fresh(rows, "held")
    return probed(rows, filter_, held, digest).filter(F.col(held)).drop(held)


ENTRY = "digest binary, keep long, n long"


@dataclass(frozen=True)
class Run:
    """A run: (digest, keep, n) sorted by digest, in ``path`` or in one ``part`` of
    it, each digest once, and the filter of its digests, made when it is asked for
    where there is none yet."""

    path: str
    part: int | None
    filter: DigestFilter | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        if self.part is None:
            return spark.read.schema(ENTRY).parquet(self.path)
        return spark.read.schema(f"{ENTRY}, run int").parquet(self.path).filter(F.col("run") == self.part).drop("run")


class DigestIndex:
    """Runs of (digest, keep, n), each sorted by digest within its files, by level.

    ``flush`` turns memtables into level-0 runs, each with a filter; ``compact``
    merges ``FAN_IN`` or more runs of a level into one of the next, keeping the
    wanted identifier and the sum of counts, until no level has that many.  An
    entry is looked up in the filters of the other runs: only those that one may
    hold are grouped, the others move on as they are.  ``largest`` keeps the
    largest identifier of a group, else the smallest.
    """

    def __init__(self, spark: SparkSession, largest: bool = True):
        self.spark, self.largest = spark, largest
        self.levels: dict[int, list[Run]] = {}

    def _best(self, column: str) -> Column:
        return F.max(column) if self.largest else F.min(column)

    def flush(self, digests: DataFrame, memtables: int = MEMTABLES) -> None:
        """``digests``: (doc_id, digest).  One pass writes a run per memtable; a
        task adds up its own copies before anything is shuffled."""
        path = new_path(self.spark, "digest-runs")
        table = F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("run")
        rows = digests.groupBy(table, "digest").agg(self._best("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
        rows.sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(path)
        runs = self.spark.read.schema(f"{ENTRY}, run int").parquet(path)
        most = max([r["count"] for r in runs.groupBy("run").count().collect()], default=0)  # a number for each run
        shape = DigestFilter(runs, buckets_for(most))
        bit = runs.select("run", shape.bit().alias("bit"))
        bits = written(bit.groupBy("run", F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")), "run-filters")
        self.levels.setdefault(0, []).extend(Run(path, k, DigestFilter(bits.filter(F.col("run") == k), shape.buckets)) for k in range(memtables))
        self.compact()

    def _merged(self, runs: list[Run]) -> DataFrame:
        """All entries of the runs, those of equal digests as one."""
        if not runs:
            return self.spark.createDataFrame([], ENTRY)
        parts = [r.read(self.spark).withColumn("run", F.lit(k)) for k, r in enumerate(runs)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(runs) == 1:
            return rows.drop("run")
        elsewhere = F.lit(False)
        for k, r in enumerate(runs):
            rows = probed(rows, r.filter or digest_filter(r.read(self.spark)), f"in{k}")
            elsewhere = elsewhere | (F.col(f"in{k}") & (F.col("run") != k))
        rows = rows.select("digest", "keep", "n", elsewhere.alias("elsewhere"))
        again = rows.filter("elsewhere").groupBy("digest").agg(self._best("keep").alias("keep"), F.sum("n").alias("n"))
        return rows.filter("not elsewhere").drop("elsewhere").unionByName(again)

    def compact(self) -> None:
        level = 0
        while level in self.levels:
            runs = self.levels[level]
            if len(runs) >= FAN_IN:
                path = new_path(self.spark, f"digest-level{level + 1}")
                self._merged(runs).repartition("digest").sortWithinPartitions("digest").write.parquet(path)
                self.levels[level] = []
                self.levels.setdefault(level + 1, []).append(Run(path, None))
            level += 1

    def entries(self) -> DataFrame:
        """All runs as one: (digest, keep, n)."""
        return self._merged([r for level in self.levels.values() for r in level])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, digest: Column | None = None, memtables: int = MEMTABLES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``.

    Digests (SHA-256 of the UTF-8 text unless ``digest`` gives another
    expression over ``text``) go through a ``DigestIndex``.  Hits, digests that
    more than one row has, receive byte verification: their rows, found through
    a filter, give the least and greatest text of each digest,
    added up in each task before the shuffle.  Should the two differ, the rows
    of that digest are grouped by their text instead.

    Null text counts as empty.  Rows that repeat an identifier and its text
    count in ``group_size`` and are all kept or all dropped with it.  Null ids
    are smaller (larger, if not ``largest``) than all others; a group of null
    ids alone has a null ``keep_id`` and is kept.  An empty table gives an
    empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    made = rows.withColumn("digest", F.unhex(F.sha2("text", 256)) if digest is None else digest)
    index = DigestIndex(spark, largest)
    index.flush(made.select("doc_id", "digest"), memtables)
    entries = index.entries()
    hits = written(entries.filter("n > 1").select("digest"), "digest-hits")
    suspects = may_hold(made.select("digest", "text"), digest_filter(hits))
    clashing = written(suspects.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"), "digest-clashes")
    out = made.select("doc_id", "digest").join(entries, "digest").select("doc_id", "digest", "keep", "n")
    if not clashing.isEmpty():
        best = F.max("doc_id") if largest else F.min("doc_id")
        apart = made.join(clashing, "digest", "left_semi")
        groups = apart.groupBy("digest", "text").agg(best.alias("keep"), F.count(F.lit(1)).alias("n"))
        apart = apart.join(groups, ["digest", "text"]).select("doc_id", "digest", "keep", "n")
        out = out.join(clashing, "digest", "left_anti").unionByName(apart)
    return out.select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), "digest")


def exact_digests(docs: DataFrame) -> DataFrame:
    """``exact_groups`` with the digest as hexadecimal text, on odd rows and empty
    tables likewise."""
    return exact_groups(docs).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
