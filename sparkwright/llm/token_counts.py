"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.bpe import merge_counter
from sparkwright.llm.shared import named
from sparkwright.llm.text import slices, texts


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a byte-level BPE ``tokenizers`` file.  Special
    strings inside a text count as one token each; none is added.  A map without
    shuffle: rows keep their partitions, a task holds one slice of texts and a
    bounded memo of words.

    Null text: empty (0 bytes, 0 tokens).  Null ids stay null.  Repeated rows
    give repeated results.  An empty table gives an empty result.  Other columns,
    whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                whole = texts(part, "text")
                n = pa.array([counter.of_text(t) for t in whole], pa.int64())
                size = pa.array([len(t.encode()) for t in whole], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
