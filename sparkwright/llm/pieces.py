"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import named, written
from sparkwright.llm.text import slices, texts

MARK = "▁"
_CHUNKS = re.compile(" +[^ ]*")

#: Most chunks of the table that is sent to all tasks; some chunks of the fewest
#: blocks stay out of a table that would be larger.
TABLE_CHUNKS = 500_000
#: Distinct chunks that a task notes down, or remembers of those that are not in
#: the table; past it it starts anew.
BLOCK_CHUNKS = 200_000
#: Longer chunks are segmented where they stand.
TABLE_CHARS = 64


def chunks_of(text: str) -> list[str]:
    """Runs of whitespace markers (as blanks) with the letters up to the next."""
    return _CHUNKS.findall(" " + text.replace(MARK, " ")) if text else []


class Segmenter:
    """Ids of chunks: a run of whitespace markers and the letters up to the next
    one.  No piece of the model has a marker after another letter, so no merge
    crosses from one chunk to the next."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in p.id_to_piece(i).lstrip(MARK) for i in range(p.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace markers; encode whole texts instead")
        if p.normalize(" a  b ") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("this model's normaliser changes texts; encode whole texts instead")
        self.mark = p.piece_to_id(MARK)
        self.own: dict[str, bytes] = {}

    def segmented(self, chunks: list[str]) -> list[bytes]:
        """The library puts one marker before what it gets, so the first is left out."""
        encoded = self.library.encode([c[1:] for c in chunks], num_threads=1)
        return [np.array([self.mark] if c == " " else ids, "<u4").tobytes() for c, ids in zip(chunks, encoded)]

    def of_texts(self, whole: list[str], table: dict[str, bytes]) -> list[bytes]:
        """For each text its ids as unsigned 32-bit integers, joined by position
        from the ``table`` and from what only this block holds."""
        split, own = list(map(chunks_of, whole)), self.own
        if len(own) >= BLOCK_CHUNKS:
            own.clear()
        fresh = [c for c in set().union(*split) if c not in table and c not in own]
        own.update(zip(fresh, self.segmented(fresh)))
        out = [b"".join([table.get(c) or own[c] for c in chunks]) for chunks in split]
        for c in fresh:
            if len(c) > TABLE_CHARS:
                del own[c]
        return out


@lru_cache(maxsize=2)
def segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def chunk_table(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(chunk, ids) of the distinct chunks of ``docs``, each segmented once.  A task
    sends the distinct chunks of its block (a partition).  At most ``TABLE_CHUNKS``
    rows: those that most blocks hold come first, and of the chunks of as many
    blocks as are not all taken, a share by their hashes."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                seen.update(*map(chunks_of, texts(part, "text")))
                if len(seen) >= BLOCK_CHUNKS:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c in seen if len(c) <= TABLE_CHARS], pa.string())], ["chunk"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array([c for c in seen if len(c) <= TABLE_CHARS], pa.string())], ["chunk"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = segmenter(model).segmented(batch.column("chunk").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(ids, pa.binary())], ["chunk", "ids"])

    each = docs.select(named(text_col).alias("text")).mapInArrow(distinct, "chunk string")
    counts = written(each.groupBy("chunk").agg(F.count(F.lit(1)).alias("blocks")), "chunks")
    sizes = sorted(((r.blocks, r["count"]) for r in counts.groupBy("blocks").count().collect()), reverse=True)  # a row for each number of blocks
    # All chunks of more than ``edge`` blocks, and of those of ``edge`` a share: one comparison,
    # since a condition for each number of blocks, which are hundreds, would be too deep a tree.
    room, edge, share = TABLE_CHUNKS, 0, F.lit(True)
    for blocks, n in sizes:
        if n >= room:
            edge = blocks
            if n > room:  # nine tenths of the room that is left, since hashes only share out about so many
                share = F.pmod(F.xxhash64("chunk"), F.lit(1 << 40)) < F.lit(int(0.9 * room / n * (1 << 40)))
            break
        room -= n
    taken = (F.col("blocks") > edge) | ((F.col("blocks") == edge) & share)
    return written(counts.filter(taken).select("chunk").mapInArrow(segment, "chunk string, ids binary"), "chunk-table")


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, ids (binary, little-endian unsigned
    32-bit), n_tokens, decoded`` (by the library's ``decode``).

    Two passes over the texts, which themselves are never shuffled: one makes the
    ``chunk_table``, of bounded size and so sent to all tasks; the other joins its
    ids back by position.  A chunk that the table has no room for is segmented in
    each block that holds it, and remembered there, up to ``BLOCK_CHUNKS`` of them.

    Null text: empty (begin and end ids only, decodes to empty).  Null ids stay
    null; repeated rows give repeated results; an empty table gives an empty
    result; other columns are not read.
    """
    table = chunk_table(docs, model, text_col).toArrow()  # at most TABLE_CHUNKS rows
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(table.column("chunk").to_pylist(), table.column("ids").to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = segmenter(model)
        maker.own.clear()
        head = np.array([maker.library.bos_id()] * bos, "<u4").tobytes()
        tail = np.array([maker.library.eos_id()] * eos, "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [head + x + tail for x in maker.of_texts(texts(part, "text"), shared.value)]
                decoded = maker.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
                arrays = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "n_tokens", "decoded"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """``encoded`` with digests in place of ids and text, on odd rows and empty
    tables likewise."""
    return encoded(docs, model).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
