"""Sharding by sampled splitters.  DataFrame operations only.

The key of a row is (hash of its text, hash of its id): equal texts are neighbours.
Keys are sampled in proportion to the sizes of their rows, quantiles of the sample
cut the keys into ranges, and what each range holds is then counted exactly.  A
range that is over the limit is cut again by a sample of its own, one that a single
text fills by the second part of the key, until none is.  Ranges go to shards,
largest first, each to the one that is least full.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.llm.shared import fresh, named, written

#: Ranges that a shard gets at least, where there are rows enough.
RANGES = 16
#: Rows of a range at most, so that one task can number it.
RANGE_ROWS = 1 << 20
#: Sampled keys for each range that is wanted.
SAMPLES = 16
#: Copies of one row are dealt in blocks of so many and about so many bytes.
BLOCK_COPIES, BLOCK_BYTES = 4096, 1 << 20
#: Pieces that one step cuts a range into at most.
PIECES = 64

LEAST = -(1 << 63)
# Fixed value: the law.
LAW = "bytes"


@dataclass(frozen=True)
class Splitters:
    """Sorted lower bounds (first, second) of key ranges; the first is below all
    keys.  There is one for each ``RANGE_ROWS / 2`` rows or a fixed number."""

    bounds: list[tuple[int, int]]

    def ranged(self, rows: DataFrame, first: str = "first", second: str = "second", name: str = "range") -> DataFrame:
        """``rows`` with the place of the range of each key, found by bisection in the
        bounds, which every task gets as one row."""
        (bounds,) = fresh(rows, "bounds")
        table = rows.sparkSession.createDataFrame([(self.bounds,)], f"{bounds} array<struct<a:bigint,b:bigint>>")
        key, n = F.struct(F.col(first).alias("a"), F.col(second).alias("b")), len(self.bounds)
        steps = [1 << k for k in range(max(0, (n - 1).bit_length() - 1), -1, -1)]
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step < n) & (F.get(bounds, at + step) <= key), at + step).otherwise(at))
        return rows.crossJoin(F.broadcast(table)).withColumn(name, F.coalesce(place, F.lit(0))).drop(bounds)  # one row


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, first, size, text_crc32): the hash of a text, its bytes and one more."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    return docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("first"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows, those of one id and text as one unit with their number ``n``; more
    than a block of them are several units.  Counted in each task before anything
    is shuffled; texts are not."""
    of = ("doc_id", "first", "size", "text_crc32")
    counts = sized(docs, id_col, text_col).groupBy(*of).agg(F.count(F.lit(1)).alias("n"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_COPIES), F.lit(BLOCK_BYTES) / F.col("size"))).cast("long")
    counts = counts.withColumn("block", block).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("block")).cast("long"))))
    n = F.least(F.col("block"), F.col("n") - F.col("copy") * F.col("block"))
    return counts.select(*of, F.xxhash64("doc_id", "copy").alias("second"), "copy", n.alias("n"))


def _drawn(rows: DataFrame, rate: Column) -> DataFrame:
    """A sample in proportion to size, the same whenever it is drawn: at ``rate``
    samples a byte, rows that are larger than the gap between samples always."""
    chance = F.pmod(F.xxhash64(F.lit("sample"), "first", "second"), F.lit(1 << 40)) / float(1 << 40)
    return rows.filter(chance < rate * F.col("size") * F.col("n"))


def _quantiles(column: Column | str, pieces: int) -> Column:
    return F.percentile_approx(column, [k / pieces for k in range(1, pieces)], 100 * pieces)


def splitters(rows: DataFrame, shards: int) -> tuple[Splitters, list[int]]:
    """Splitters of a stored table of units, and the bytes of each range.  The driver
    gets bounds and sizes of ranges, never keys of rows."""
    total = rows.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    limit = max(1, total.bytes // (shards * RANGES))
    wanted = max(shards * RANGES * 2, 2 * total.n // RANGE_ROWS)
    bounds = [(LEAST, LEAST)]
    if total.bytes:
        q = _drawn(rows, F.lit(wanted * SAMPLES / total.bytes)).agg(_quantiles("first", wanted).alias("q")).first().q
        bounds += [(b, LEAST) for b in sorted(set(q or []))]
    settled: dict[tuple[int, int], int] = {}  # bounds of ranges that need no further cut, and their bytes
    while True:
        cut = Splitters(bounds)
        ranged = cut.ranged(rows)
        found = ranged.groupBy("range").agg(
            F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("units"),
            F.min("first").alias("a"), F.max("first").alias("b"), F.min("second").alias("c"), F.max("second").alias("d"),
        ).collect()  # a row for each range
        over = [r for r in found if (r.bytes > limit or r.n > RANGE_ROWS) and (r.a, r.c) != (r.b, r.d) and bounds[r.range] not in settled]
        if not over:
            sizes = [0] * len(bounds)
            for r in found:
                sizes[r.range] = r.bytes
            return cut, sizes
        spark = rows.sparkSession
        plan = spark.createDataFrame([(r.range, r.a == r.b, PIECES * SAMPLES / r.bytes) for r in over], "range int, one boolean, rate double")
        drawn = _drawn(ranged.join(F.broadcast(plan), "range"), F.col("rate"))  # ranges over the limit
        part = F.when(F.col("one"), F.col("second")).otherwise(F.col("first"))
        pieces = {r.range: r for r in drawn.groupBy("range").agg(_quantiles(part, PIECES).alias("q"), F.min(part).alias("least")).collect()}
        new = set(bounds)
        for r in over:
            p = pieces.get(r.range)
            q = sorted(set(p.q)) if p and p.q else []
            want = min(PIECES, -(-2 * max(r.bytes * RANGE_ROWS, r.n * limit) // (limit * RANGE_ROWS)))
            q = q[:: max(1, len(q) // max(1, want))]
            made = {(r.a, b) if r.a == r.b else (b, LEAST) for b in q} | {(r.a, LEAST), (r.b, LEAST)}  # the last two keep whole texts apart
            if made <= new:
                made = {(r.a, (r.c + r.d) // 2 + 1)} if r.a == r.b else {((r.a + r.b) // 2 + 1, LEAST)}
            if made <= new:
                settled[bounds[r.range]] = r.bytes
            new |= made
        bounds = sorted(new)


def dealt(sizes: list[int], shards: int) -> list[int]:
    """A shard for each range: the largest first, to the least full."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        full, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (full + sizes[k], s))
    return out


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard``.  The law is ``bytes``: sizes of shards are near equal, a range
    being at most a 16th of a shard or a single unit; ``slot`` counts the rows of a
    shard from 0 without gaps; ``grown_shard`` is null.

    Equal texts go to one shard unless they are over a range's limit.  Null text:
    none, of size 1.  Rows that repeat an id and its text are dealt like others,
    in blocks; which of them is which does not show.  Null ids are ids like any.
    An empty table gives an empty result.  Other columns are not read.
    """
    rows = written(units(docs, id_col, text_col), "shard-units")
    cut, sizes = splitters(rows, shards)
    spark = docs.sparkSession
    shard = dealt(sizes, shards)
    ranged = cut.ranged(rows)
    # The places of each range's rows in its shard start behind those of its earlier ranges.
    counts = {r.range: r.n for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    base, at = [], [0] * shards
    for k in range(len(sizes)):
        base.append(at[shard[k]])
        at[shard[k]] += counts.get(k, 0)
    table = spark.createDataFrame(list(zip(range(len(sizes)), shard, base)), "range int, shard int, base long")
    before = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("first", "second", "doc_id", "copy").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("before", before).join(F.broadcast(table), "range")  # a row for each range
    slot = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("base") + F.col("before")).alias("from"), slot.alias("k")).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("from") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes whole rows as Parquet, a folder ``shard=k`` for each shard and a sorted
    file for each of its ranges, and returns them read again.  The copies of one row
    beyond a block's stay with its first block; else shards are those of ``sharded``."""
    shard, range_, first, second = fresh(docs, "shard", "range", "first", "second")
    cut, sizes = splitters(written(units(docs, id_col, text_col), "shard-units"), shards)
    table = docs.sparkSession.createDataFrame(list(zip(range(len(sizes)), dealt(sizes, shards))), f"{range_} int, {shard} int")
    keys = docs.withColumns({first: F.xxhash64(F.coalesce(named(text_col).cast("string"), F.lit(""))), second: F.xxhash64(named(id_col).cast("long"), F.lit(0).cast("long"))})
    out = cut.ranged(keys, first, second, range_).join(F.broadcast(table), range_)
    out.repartition(max(1, min(len(sizes), 4096)), range_).sortWithinPartitions(shard, range_, first, second).drop(range_, first, second).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)
