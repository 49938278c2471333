"""Repeated passages by sparse suffix arrays at content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.llm.exact import BITS_EACH, BUCKET_BITS
from sparkwright.llm.shared import named, written
from sparkwright.llm.text import mixed, slices, utf8, word_hashes, word_spans

#: Words of the gram that is hashed at each position; a position is kept if its
#: gram is the least of some window of so many positions.  A match of
#: GRAM + WINDOW - 1 words or more holds a kept position at the same place.
GRAM, WINDOW = 10, 32
#: Most buckets of the filter of repeated grams: 16 MB.
MOST_BUCKETS = 4096
#: Rows of the sorted suffixes that are looked at together.
BUFFER = 1 << 16
#: Rows before and after one that it is compared with.
NEAR = 8
#: Rows either side of the bound of two partitions that are looked at together.
EDGE = 64

_MATCH = "doc_id long, start long, stop long, other_id long, other_start long"
_ROW = "gram long, at long, after long, right binary, left binary"


def kept_positions(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser positions of one text's words, and the hashes of their grams."""
    n = len(hashes) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    odd = mixed(np.arange(301, 301 + GRAM, dtype=np.uint64)) | np.uint64(1)
    grams = mixed(sum(hashes[k : n + k] * odd[k] for k in range(GRAM)))
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.concatenate([windows[k : k + 65536].argmin(axis=1) + np.arange(k, min(k + 65536, len(windows))) for k in range(0, len(windows), 65536)])
    at = np.unique(at)
    return at, grams[at]


def _suffixes(batches: Iterator[pa.RecordBatch], reach: int, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Kept positions of texts with at least ``reach + GRAM`` words.  With
    ``wanted`` (bits of a filter), only those whose gram may repeat, with two
    bytes of hash for each of the ``reach`` words right of the gram and, from
    right to left, left of it, and the number of words after the gram."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = utf8(part.column("text"))
            starts, ends, first = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends, lower=False)
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                if b - a < reach + GRAM:
                    continue
                at, grams = kept_positions(hashes[a:b])
                if wanted is not None:
                    bit = (grams & np.uint64(8 * len(wanted) - 1)).astype(np.int64)
                    held = (wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    at, grams = at[held], grams[held]
                if not len(at):
                    continue
                rows[0].append(np.full(len(at), doc_id, np.int64))
                rows[1].append(grams.view(np.int64))
                rows[2].append(at)
                if wanted is not None:
                    marks = np.concatenate([np.zeros(reach, np.uint16), (hashes[a:b] & np.uint64(0xFFFF)).astype(np.uint16), np.zeros(reach, np.uint16)])
                    spread = np.arange(reach)
                    rows[3].append(marks[at[:, None] + reach + GRAM + spread])
                    rows[4].append(marks[at[:, None] + reach - 1 - spread])
                    rows[5].append(b - a - at - GRAM)
            if not rows[0]:
                continue
            arrays = [pa.array(np.concatenate(r)) for r in rows[:3]]
            names = ["doc_id", "gram", "at"]
            if wanted is not None:
                for r in rows[3:5]:
                    flat = np.ascontiguousarray(np.concatenate(r).astype(">u2"))
                    ends_at = np.arange(0, flat.nbytes + 1, 2 * reach, dtype=np.int64)
                    arrays.append(pa.Array.from_buffers(pa.large_binary(), len(flat), [None, pa.py_buffer(ends_at), pa.py_buffer(flat.reshape(-1))]).cast(pa.binary()))
                arrays.append(pa.array(np.concatenate(rows[5])))
                names += ["right", "left", "after"]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _filter_bytes(grams: DataFrame) -> np.ndarray:
    """Bits of the grams' low ends: a power of two of buckets, by their number, up
    to ``MOST_BUCKETS``.  A filter that is full lets all suffixes through: more to
    sort, the same result."""
    buckets = min(MOST_BUCKETS, 1 << (grams.count() * BITS_EACH // BUCKET_BITS).bit_length())
    bit = grams.select((F.col("gram").bitwiseAND(buckets * BUCKET_BITS - 1) + 1).alias("bit"))
    found = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros((buckets, BUCKET_BITS // 8), np.uint8)
    for r in found:  # at most MOST_BUCKETS rows
        out[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def _binary(column: pa.Array, reach: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(">u2").reshape(-1, reach)


def matches(gram: np.ndarray, doc: np.ndarray, at: np.ndarray, after: np.ndarray, right: np.ndarray, left: np.ndarray, least: int, side: str) -> tuple[np.ndarray, ...]:
    """(row, partner row, words left of the gram, words right of it) of sorted
    suffixes that match a row from another document over ``least`` words or more:
    one of the ``NEAR`` rows before or after, or the nearest of another document.  Neighbours of the same gram are taken in the order of the right or
    the left ``side``s."""
    n, out = len(gram), []
    big = gram.view(np.uint64).astype(">u8").view(np.uint8).reshape(n, 8)
    agree = lambda x, a, b: np.cumprod(x[a] == x[b], axis=1).sum(axis=1)
    words = right if side == "right" else left
    keys = np.ascontiguousarray(np.concatenate([big, words.view(np.uint8).reshape(n, -1)], axis=1)).view(f"V{8 + 2 * words.shape[1]}").reshape(n)
    order = np.argsort(keys, kind="stable")
    d = doc[order]
    run = np.concatenate([[True], d[1:] != d[:-1]])
    run_start = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    run_stop = np.append(np.flatnonzero(run)[1:], n)[np.cumsum(run) - 1]
    here = np.arange(n)
    for other in (run_start - 1, run_stop, *(here + k for k in range(-NEAR, NEAR + 1) if k)):  # the nearest row of another document before and after, then all rows nearby
        ok = (other >= 0) & (other < n)
        a, b = order[ok], order[other[ok]]
        same = (gram[a] == gram[b]) & (doc[a] != doc[b])
        a, b = a[same], b[same]
        if len(a):
            r = np.minimum(agree(right, a, b), np.minimum(after[a], after[b]))
            l = np.minimum(agree(left, a, b), np.minimum(at[a], at[b]))
            long = r + l + GRAM >= least
            out.append((a[long], b[long], l[long], r[long]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _found(batch: pa.RecordBatch, least: int, side: str) -> pa.RecordBatch:
    """The matches of sorted suffixes, as ``_MATCH`` has it."""
    gram, doc, at, after = (batch.column(c).to_numpy() for c in ("gram", "doc_id", "at", "after"))
    a, b, l, r = matches(gram, doc, at, after, _binary(batch.column("right"), least - GRAM), _binary(batch.column("left"), least - GRAM), least, side)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], at[a] - l, at[a] + GRAM + r, doc[b], at[b] - l)], ["doc_id", "start", "stop", "other_id", "other_start"])


def _edge(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
    """The first or last rows of a partition; if one document holds them all, also
    the nearest of another."""
    doc = batch.column("doc_id").to_numpy()
    order = np.arange(len(doc))[::-1] if last else np.arange(len(doc))
    near = order[:EDGE]
    other = order[EDGE:][doc[order[EDGE:]] != doc[order[0]]][:1] if (doc[near] == doc[order[0]]).all() else near[:0]
    return batch.take(pa.array(np.sort(np.concatenate([near, other]))))


def _walk(batches: Iterator[pa.RecordBatch], least: int, side: str) -> Iterator[pa.RecordBatch]:
    """Matches in the order of one side, and, with ``part``, the rows of a
    partition's edges."""
    held: list[pa.RecordBatch] = []
    names = [x.split()[0] for x in f"{_MATCH}, {_ROW}, part long, tail boolean".split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in f"{_MATCH}, {_ROW}, part long, tail boolean".split(", ")]
    part = TaskContext.get().partitionId()
    first = True

    def filled(batch: pa.RecordBatch, **more: object) -> pa.RecordBatch:
        n, has = batch.num_rows, batch.schema.names
        columns = [batch.column(c).cast(k) if c in has else pa.array([more.get(c)] * n, k) for c, k in zip(names, kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    def look(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal first
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        if not whole:
            return
        batch = whole[0]
        yield filled(_found(batch, least, side))
        if first:
            yield filled(_edge(batch, False), part=part, tail=False)
            first = False
        if last:
            yield filled(_edge(batch, True), part=part, tail=True)
            return
        gram = batch.column("gram").to_numpy()  # the last gram may go on; of one that fills the buffer, its end waits
        cut = np.flatnonzero(gram[1:] != gram[:-1])
        held.append(batch.slice(min(max(int(cut[-1]) + 1 if len(cut) else 0, len(gram) - BUFFER // 4), max(len(gram) - EDGE - 1, 0))))

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= BUFFER:
            yield from look(False)
    if held:
        yield from look(True)


def _in_order(suffixes: DataFrame, least: int, side: str) -> DataFrame:
    """All matches between neighbours in the order of (gram, ``side``): one range
    sort, then the rows either side of each partition's bound."""
    spark = suffixes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["gram", side, "doc_id", "at"]
    ordered = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(lambda it: _walk(it, least, side), f"{_MATCH}, {_ROW}, part long, tail boolean"), "matches")
    edges = found.filter("part is not null")
    ids = sorted(r.part for r in edges.select("part").distinct().collect())  # as many as partitions
    rank = spark.createDataFrame([(p, k) for k, p in enumerate(ids)], "part long, rank long")
    seams = edges.join(F.broadcast(rank), "part").withColumn("seam", F.col("rank") - F.when(F.col("tail"), 0).otherwise(1))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("at", "ascending")]).combine_chunks()
        return pa.Table.from_batches([_found(table.to_batches()[0], least, side)])

    across = seams.select("seam", "doc_id", *[x.split()[0] for x in _ROW.split(", ")]).groupBy("seam").applyInArrow(run, _MATCH)
    return found.filter("part is null").select(*across.columns).union(across)


def repeated_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, start_word,
    stop_word, n_words, other_id, other_start``.

    A passage is a longest run of words, each of them in a match of
    ``min_words`` words or more with another document; words are
    ``[^\\x20\\x09-\\x0D]+``, compared as they are; ``other_id`` names one such
    document (the smallest of those that neighbour it) and ``other_start`` where the match lies
    there.

    Suffixes stay only at minimisers.  A first pass finds the grams that occur
    in two documents; a second keeps their suffixes alone, with two bytes of
    hash for each word around, sorts them by two range sorts, by gram and right side
    and by gram and left side (so a gram that very many documents share is spread
    over partitions; each sort and its sample make the suffixes once more, which
    costs less than to store them), compares neighbours, also across the bounds of
    partitions, and extends each match to both sides.  Matches around the next positions take
    over where the hashes end, so passages of any length come out whole.  A
    passage that several documents share only in parts may come out through
    other neighbours than the longest.

    Null, empty and short texts: no passage.  Rows with a null id are left out;
    rows that repeat an id are one document.  An empty table gives an empty
    result; other columns are not read.
    """
    if min_words < GRAM + WINDOW - 1:
        raise ValueError(f"min_words must be at least {GRAM + WINDOW - 1}")
    spark, reach = docs.sparkSession, min_words - GRAM
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).filter("doc_id is not null")
    grams = rows.mapInArrow(lambda it: _suffixes(it, reach, None), "doc_id long, gram long, at long")
    shared = written(grams.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram"), "grams")
    bits = spark.sparkContext.broadcast(_filter_bytes(shared))
    suffixes = rows.mapInArrow(lambda it: _suffixes(it, reach, bits.value), "doc_id long, gram long, at long, right binary, left binary, after long")
    found = _in_order(suffixes, min_words, "right").union(_in_order(suffixes, min_words, "left"))
    spans = found.groupBy("doc_id", "start", "stop").agg(F.min(F.struct("other_id", "other_start")).alias("other"))
    by_doc = W.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum((F.col("start") > F.coalesce(F.col("before"), F.lit(-1))).cast("int")).over(by_doc)
    out = spans.withColumn("before", before).withColumn("island", island).groupBy("doc_id", "island")
    out = out.agg(F.min("start").alias("start_word"), F.max("stop").alias("stop_word"), F.min("other").alias("other"))
    return out.select("doc_id", "start_word", "stop_word", (F.col("stop_word") - F.col("start_word")).alias("n_words"), "other.other_id", "other.other_start")
