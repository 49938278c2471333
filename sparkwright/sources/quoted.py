"""CSV files whose quoted values hold line breaks, cut into tasks all the same.

Whether a line starts inside a value depends on all lines before it in its file.
Each block of a file is therefore first read for what it makes of both cases,
outside and inside; the driver goes through these pairs in order, one for each
block, and tells each block how it starts and which number its first record has.
Then every block puts its lines together to records.  A record that goes on in the
next blocks is put together from one piece of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.sources.scratch import stored

PIECE = "no long, seq long, head boolean, open boolean, text string"


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether a line that starts inside (or outside) a quoted value ends in one.  A
    value is quoted if a quote is its first character but blanks; a doubled quote
    is part of it; what follows the closing quote is left to the parser."""
    at = 0
    while True:
        if not inside:
            while line[at : at + 1] in (" ", "\t") and not line.startswith(sep, at):
                at += 1
            inside = line.startswith('"', at)
            at += inside
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('""', at):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    text = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _summaries(lines: DataFrame, sep: str) -> DataFrame:
    """For each block and both starts: whether it ends inside a value, and how many
    records start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, counts = None, [False, True], [0, 0]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [key[0]], "block": pa.array([key[1]], pa.int64()), "outside": [states[0]], "inside": [states[1]], "n_outside": pa.array([counts[0]], pa.int64()), "n_inside": pa.array([counts[1]], pa.int64())})

        for batch in batches:
            for value, *at in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
                if at != key:
                    if key is not None:
                        yield told()
                    key, states, counts = at, [False, True], [0, 0]
                for k in (0, 1):
                    counts[k] += not states[k]
                    if '"' in value:
                        states[k] = ends_inside(value, sep, states[k])
        if key is not None:
            yield told()

    return lines.mapInArrow(run, "file string, block long, outside boolean, inside boolean, n_outside long, n_inside long")


def _pieces(lines: DataFrame, sep: str) -> DataFrame:
    """``PIECE``s of lines that know how their block starts (``start``), its place
    (``seq``) and the number of records before it (``before``)."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], ["no", "seq", "head", "open", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, no, text, begun = None, False, 0, [], True
        out: list[tuple] = []

        def cut(still: bool) -> None:
            # A piece is open if it goes on behind the block or began before it.
            if text:
                out.append((no, key[2], begun and key[1] == 0 and no == key[3], still or not begun, "\n".join(text)))
                text.clear()

        for batch in batches:
            for value, file, block, start, seq, before in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "start", "seq", "before"))):
                if key is None or (file, block) != key[:2]:
                    if key is not None:
                        cut(inside)
                    key, inside, no, begun = (file, block, seq, before), start, before - 1, not start
                if not inside:
                    cut(False)
                    no, begun = no + 1, True
                text.append(value)
                if '"' in value:
                    inside = ends_inside(value, sep, inside)
                if not inside and not begun:
                    cut(False)
                    begun = True
            if out:
                yield batch_of(out)
                out.clear()
        if key is not None:
            cut(inside)
        if out:
            yield batch_of(out)

    return lines.mapInArrow(run, PIECE)


def records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """(no, seq, head, text): the records of the files at ``path``, stored.  ``no``
    rises with path and place, ``seq`` names the block where a record starts, ``head``
    is true for the first record of a file."""
    lines = _lines(spark, path, encoding)
    found = sorted(_summaries(lines, sep).collect())  # a row for each block
    table, file, inside, before = [], None, False, 0
    for seq, r in enumerate(found):
        inside = inside and r.file == file  # a file ends what it began
        file = r.file
        table.append((r.file, r.block, inside, seq, before))
        before += r.n_inside if inside else r.n_outside
        inside = r.inside if inside else r.outside
    plan = spark.createDataFrame(table, "file string, block long, start boolean, seq long, before long")
    known = lines.join(F.broadcast(plan), ["file", "block"], "left").withColumn("start", F.coalesce("start", F.raise_error(F.lit("a block that was not read before")).cast("boolean")))
    pieces = stored(_pieces(known, sep))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "\n")
    joined = pieces.filter("open").groupBy("no").agg(F.min("seq").alias("seq"), F.bool_or("head").alias("head"), whole.alias("text"))  # a piece for each block at most
    out = pieces.filter("not open").select("no", "seq", "head", "text").unionByName(joined.select("no", "seq", "head", "text"))
    return out.withColumn("text", F.regexp_replace("text", "\r$", ""))


def parsed(text: Column, names: list[str], sep: str, corrupt: str | None = None) -> Column:
    """A record as a struct of texts; ``corrupt`` names a field for malformed ones."""
    quoted = [f"`{n.replace('`', '``')}` string" for n in [*names, *([corrupt] if corrupt else [])]]
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "multiLine": "true", **({"columnNameOfCorruptRecord": corrupt} if corrupt else {})}
    return F.from_csv(text, ", ".join(quoted), options)


def read_quoted(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8", lenient: bool = False) -> tuple[DataFrame, list[str]]:
    """The records of CSV files with a header each, as columns ``c0`` and so on with
    ``row_number``, and the names in the header.  Empty lines are no records;
    ``lenient`` leaves malformed ones out before they are numbered."""
    rows = records(spark, path, sep, encoding)
    first = rows.filter("head").orderBy("no").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "row_number long"), []
    text = first[0].text.lstrip("﻿")
    wide = len(text.split(sep))
    head = spark.createDataFrame([(text,)], "text string").select(parsed(F.col("text"), [f"c{k}" for k in range(wide)], sep).alias("r")).first().r
    names = list(head)
    while names and names[-1] is None:
        names.pop()
    names = [n if n is not None else f"_c{k}" for k, n in enumerate(names)]
    columns = [f"c{k}" for k in range(len(names))]
    body = rows.filter("not head").filter(F.trim("text") != "").select("no", "seq", parsed(F.col("text"), columns, sep, "bad").alias("r"))
    body = body.filter("r.bad is null") if lenient else body
    body = stored(body.select("no", "seq", *[F.col(f"r.{c}").alias(c) for c in columns]))
    counts, offsets, total = {r.seq: r["count"] for r in body.groupBy("seq").count().collect()}, [], 0  # a row for each block
    for seq in sorted(counts):
        offsets.append((seq, total))
        total += counts[seq]
    place = F.row_number().over(W.partitionBy("seq").orderBy("no"))
    out = body.join(F.broadcast(spark.createDataFrame(offsets, "seq long, offset long")), "seq")
    return out.select(*columns, (F.col("offset") + place).alias("row_number")), names
