"""Packing along a Hilbert curve through projected document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.bpe import word_ids
from sparkwright.llm.shared import named, written
from sparkwright.llm.text import mixed, slices, texts

#: Dimensions of the projected vectors and bits of each on the curve.
DIMS, BITS = 4, 12
#: Spread of a projected mean of vectors.
SPREAD = 0.08


def id_vectors(n: int) -> np.ndarray:
    """A hashed vector in [-1, 1]**DIMS for each token id, one row per dimension."""
    h = mixed(np.arange(1, n + 1, dtype=np.uint64))
    return np.stack([((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(32767.5) - 1 for d in range(DIMS)])


def projected(ids: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole numbers below ``2**BITS`` in ``DIMS`` dimensions: the mean of the
    vectors of a document's ids.  ``ids``: those of all documents in turn, one
    at least for each."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.stack([np.add.reduceat(v[ids], starts, dtype=np.float64) / lengths for v in vectors], axis=1)
    return np.minimum((0.5 + 0.5 * np.tanh(out / SPREAD)) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points on the Hilbert curve, by the transposed form of the key:
    undo the excess turns from the top bit down, then Gray-encode."""
    x = points.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, curve, n, ids): ids with ``end_id``, two bytes each where the
    vocabulary allows it, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = word_ids(tokenizer)
        width = 4 if maker.wide else 2
        end = end_id.to_bytes(width, "little")
        vectors = id_vectors(max(maker.splitter.library.get_vocab_size(), end_id + 1))
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [x + end for x in maker.of_texts(texts(part, "text"))]
                lengths = np.array([len(x) // width for x in ids])
                curve = hilbert_keys(projected(np.frombuffer(b"".join(ids), f"<u{width}"), lengths, vectors))
                arrays = [part.column("doc_id"), pa.array(curve, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "curve", "n", "ids"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, curve long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row within its partition."""
    total = 0
    for batch in batches:
        sums = np.cumsum(batch.column("n").to_numpy())
        if len(sums):
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), batch.column("n"), pa.array(np.concatenate([[0], sums[:-1]]) + total, pa.int64())], ["row", "part", "n", "before"])
            total += int(sums[-1])


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (ids: little-endian unsigned 32-bit).

    Documents lie one behind the other along the curve (ties: by id, then by
    row), and the line of all their tokens is cut every ``size`` tokens, so only
    the very last sequence is padded.  A range sort of (place, id, row, tokens)
    alone finds the place of each document on that line; the sums of the sort's
    partitions, one number each, are added up on the driver.  Token ids move
    once, to meet their places.

    Null text: empty, one token (``end_id``).  Null ids stay null and sort
    first; repeated rows are packed each.  An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    tokens = written(token_table(docs, tokenizer, end_id, id_col, text_col), "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "doc_id", "row"]
    line = tokens.select("row", "doc_id", "curve", "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    line = line.select("row", F.spark_partition_id().alias("part"), "n").mapInArrow(_starts, "row long, part int, n long, before long")
    line = written(line, "places")
    sums = sorted((r.part, r.n) for r in line.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    bases = spark.createDataFrame(bases, "part int, base long")  # one row for each partition
    places = line.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                rows = []
                for doc_id, n, raw, at in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at"))):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                    a = 0
                    while a < n:
                        sequence, offset = divmod(at + a, size)
                        length = min(size - offset, n - a)
                        piece = ids[4 * a : 4 * (a + length)]
                        rows.append((doc_id, a, length, zlib.crc32(piece), n, sequence, offset, piece))
                        a += length
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    both = tokens.select("doc_id", "n", "ids", "row").join(places.hint("shuffle_hash"), "row").select("doc_id", "n", "ids", "at")
    return both.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
