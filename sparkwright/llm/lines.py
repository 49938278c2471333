"""Line dedup over levelled sorted runs of line hashes.  DataFrame operations
only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.exact import digest_filter, probed
from sparkwright.llm.shared import fresh, named, new_path, written

#: Fixed value: what counts as white space at a line's ends.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Batches that a table is fed in; runs of a level that are merged into one run of
#: the next.
BATCHES, FAN_IN = 4, 4
RUN = "line binary, n long, last long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


class LineRuns:
    """Levels of sorted runs: (line hash, documents that hold it, largest
    identifier among them).

    ``add`` takes a batch and merge-anti-joins it with the runs so far: its new
    lines become a run of level 0, so that all runs together hold a line once;
    what the batch knows of lines that a run has goes to a table of later counts.
    ``compact`` merges the runs of a level that holds ``FAN_IN`` into one of the
    next.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.later = spark, []
        self.levels: dict[int, list[str]] = {}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _write(self, rows: DataFrame, name: str) -> str:
        path = new_path(self.spark, name)
        rows.sortWithinPartitions("line").write.option("compression", "zstd").parquet(path)
        return path

    def _runs(self) -> list[str]:
        return [p for level in self.levels.values() for p in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """``batch``: (doc_id, line), each pair once.  Returns its lines that no
        earlier batch held."""
        return self.add_counts(batch.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")))

    def add_counts(self, batch: DataFrame) -> DataFrame:
        """The same for a batch (line, n, last), each line once."""
        before = self._read(self._runs())
        path = self._write(batch.join(before.select("line").hint("merge"), "line", "left_anti"), "line-level0")
        new = self._read([path])
        if self._runs():
            self.later.append(self._write(batch.join(new.select("line").hint("merge"), "line", "left_anti"), "later-lines"))
        self.levels.setdefault(0, []).append(path)
        self.compact()
        return new

    def compact(self) -> None:
        level = 0
        while level in self.levels:
            if len(self.levels[level]) >= FAN_IN:
                merged = self._read(self.levels[level]).repartition("line")
                self.levels[level] = []
                self.levels.setdefault(level + 1, []).append(self._write(merged, f"line-level{level + 1}"))
            level += 1

    def lines(self, least: int = 1) -> DataFrame:
        """(line, n, last) over all batches, of lines that ``least`` documents hold.
        Only lines that are met again later are added up."""
        runs, later = self._read(self._runs()), self._read(self.later)
        sums = later.groupBy("line").agg(F.sum("n").alias("more"), F.max("last").alias("largest"))
        whole = runs.join(sums.hint("merge"), "line", "left")
        return whole.select("line", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "largest").alias("last")).filter(F.col("n") >= least)


def _row(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """Of a row: its id, its text and a digest of both."""
    doc_id, text = named(id_col).cast("long"), F.coalesce(named(text_col).cast("string"), F.lit(""))
    return doc_id, text, F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text).cast("binary")))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, runs: LineRuns | None = None) -> DataFrame:
    """(digest, drop): for each row of ``docs`` that loses lines, by the digest of
    its id and text, the hashes of the lines that go."""
    spark = docs.sparkSession
    runs = runs or LineRuns(spark)
    doc_id, text, digest = _row(id_col, text_col)
    long_keys = F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), line_key), lambda k: F.length(k) >= min_chars), line_hash))
    held = docs.select(doc_id.alias("doc_id"), digest.alias("digest"), F.explode(long_keys).alias("line"))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int").alias("batch")
    counts = written(held.groupBy(batch, "line").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "line-batches", "batch")
    for k in range(BATCHES):
        runs.add_counts(counts.filter(F.col("batch") == k).select("line", "n", "last"))
    repeated = written(runs.lines(min_docs).select("line", "last"), "repeated-lines")
    smaller = (F.col("doc_id") < F.col("last")) | (F.col("doc_id").isNull() & F.col("last").isNotNull())
    return written(held.join(repeated, "line").filter(smaller).groupBy("digest").agg(F.collect_set("line").alias("drop")), "dropped-lines")


def _stays(line: Column, drop: Column, min_chars: int) -> Column:
    return (F.length(line_key(line)) < min_chars) | ~F.array_contains(drop, line_hash(line_key(line)))


def _with_drops(docs: DataFrame, drops: DataFrame, digest: Column, name: str) -> DataFrame:
    """``docs`` with the hashes that a row loses, or null, in a column ``name``.
    A filter tells the rows that may lose lines, and only these are shuffled."""
    key, held = fresh(docs.withColumn(name, F.lit(0)), "digest", "held")
    rows = probed(docs.withColumn(key, digest), digest_filter(drops), held, key)
    columns = [named(c) for c in docs.columns]
    some = rows.filter(named(held)).join(drops.select(named("digest").alias(key), named("drop").alias(name)), key, "left").select(*columns, name)
    return rows.filter(~named(held)).select(*columns, F.lit(None).cast("array<binary>").alias(name)).unionByName(some)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, runs: LineRuns | None = None) -> DataFrame:
    """One row per input row: ``doc_id, kept`` (the text without its dropped
    lines), ``n_lines, n_dropped``.

    Texts split at \\n; a line's key is the line without white space at its ends
    and with A-Z in lower case.  Keys of ``min_chars`` code points or more that
    ``min_docs`` rows or more hold lose all their lines, except in the rows of
    the largest identifier that holds them.

    Null or empty text: one empty line, kept, and a null text gives an empty
    ``kept``.  A repeated row counts as a document each time, and ties of the
    largest identifier all keep their lines.  A row with a null identifier
    counts; it is smaller than any other, and where all holders have null ids
    nothing is dropped.  An empty table gives an empty result.  Other columns
    are not read.

    Plan: each row sends the distinct hashes of its long lines (16 bytes each),
    counted in the task before the shuffle, in ``BATCHES`` batches to the runs;
    only repeated keys come back, first to (row, key) pairs, then as one list for
    each row.  Adaptive execution splits the pairs of a key that very many rows
    hold.
    """
    drops = dropped_lines(docs, id_col, text_col, min_chars, min_docs, runs)
    doc_id, text, _ = _row(id_col, text_col)
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    rows = _with_drops(rows, drops, _row("doc_id", "text")[2], "drop")
    lines = F.split("text", "\n")
    rows = rows.withColumn("left", F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: _stays(x, F.col("drop"), min_chars))))
    return rows.select("doc_id", F.array_join("left", "\n").alias("kept"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("left")).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """``line_dedup`` with a digest in place of the text, on odd rows and empty
    tables likewise."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the lines that ``line_dedup`` drops gone from ``text_col``;
    all columns, whatever their names, and all rows stay, and a null text stays
    null."""
    drops = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    (drop,) = fresh(docs, "drop")
    rows = _with_drops(docs, drops, _row(id_col, text_col)[2], drop)
    text = named(text_col)
    less = F.array_join(F.filter(F.split(text, "\n"), lambda x: _stays(x, named(drop), min_chars)), "\n")
    return rows.select(*[F.when(named(drop).isNull(), text).otherwise(less).alias(c) if c == text_col else named(c) for c in docs.columns])
