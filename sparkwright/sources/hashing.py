"""SHA-256 of files of any size.

A file up to ``WHOLE_BYTES`` is one value of Spark's binary reader.  A larger one is
read by blocks, as lines of bytes, put together to chunks; the chunks of a file then
come to one task in their order, which keeps no more than one of them, since a hash
goes through its bytes one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to so many bytes are hashed as one value; bytes of a chunk of larger ones.
WHOLE_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20
# Names that the line reader would unpack; those files are hashed whole.
PACKED = r"\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one block after the other, joined to chunks with the line break that
    follows each."""
    key, n, parts, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        names = ("file", "length", "block", "n", "bytes")
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([n], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names)

    for batch in batches:
        for value, *at in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "length", "block"))):
            if at != key or size >= CHUNK_BYTES:
                if parts:
                    yield out()
                n, parts, size = (n + 1 if at == key else 0), [], 0
                key = at
            parts += [value, b"\n"]
            size += len(value) + 1
    if parts:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each file from its chunks in order.  The last line has no line
    break if the file has none there, which its length tells."""
    file, length, seen, digest = None, 0, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [file], "length": pa.array([length], pa.int64()), "sha256": [digest.hexdigest()]})

    for batch in batches:
        for row in range(batch.num_rows):
            name = batch.column("file")[row].as_py()
            if name != file:
                if file is not None:
                    yield out()
                file, length, seen, digest = name, batch.column("length")[row].as_py(), 0, hashlib.sha256()
            data = memoryview(batch.column("bytes")[row].as_buffer())[: length - seen]
            digest.update(data)
            seen += len(data)
    if file is not None:
        yield out()


def fingerprints(spark: SparkSession, path: str, below: bool = False, whole: int = WHOLE_BYTES) -> DataFrame:
    """(path, length, sha256) of the files at ``path``, or anywhere ``below`` it.  Spark
    reads no empty file, so those give no row."""
    at = lambda kind: spark.read.format(kind).option("recursiveFileLookup", below)
    name = F.col("_metadata.file_path")
    small = at("binaryFile").load(path).filter((F.col("length") <= whole) | F.col("path").rlike(PACKED)).select("path", "length", F.sha2("content", 256).alias("sha256"))
    lines = at("text").option("lineSep", "\n").load(path).filter((F.col("_metadata.file_size") > whole) & ~name.rlike(PACKED))
    rows = lines.select(F.col("value").cast("binary").alias("value"), name.alias("file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("block"))
    chunks = rows.mapInArrow(_chunks, "file string, length long, block long, n long, bytes binary")
    hashed = chunks.repartition("file").sortWithinPartitions("file", "block", "n").mapInArrow(_digests, "file string, length long, sha256 string")
    names = at("binaryFile").load(path).filter((F.col("length") > whole) & ~F.col("path").rlike(PACKED)).select("path", name.alias("file"))
    return small.unionByName(hashed.join(names, "file").select("path", "length", "sha256"))
