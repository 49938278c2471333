"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer numpy network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import named
from sparkwright.llm.text import SLICE_BYTES, mixed, utf8, word_hashes, word_spans

#: Words hash to so many buckets; vectors have so many dimensions, so many of
#: them other than 0 in an index vector; neighbours within so many words count.
BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 64, 4, 2
#: Pieces in which tasks send what they count of contexts.
PARTS = 32
#: The sample that the network is fitted on: labelled rows, by a hash of their id,
#: of texts up to so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 32_768
HIDDEN, STEPS, THRESHOLD = 24, 400, 0.3
_SHAPES = 4 * 4 * 2 * 4 * 2 * 2


def _index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries other than 0 of ``n`` index vectors."""
    h = mixed(np.arange(1, n * NONZERO + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)).reshape(n, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _dense(places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), DIMS))
    for k in range(NONZERO):
        np.add.at(out, (np.arange(len(places)), places[:, k]), signs[:, k])
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts in turn: bucket, shape; and each text's first word."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(mask, False).astype(np.int32), np.stack([starts, ends], 1).reshape(-1))[::2]

    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122) | (data >= 128)
    up, low, dig, length = count(upper), count(lower), count(digit), ends - starts
    symbols = np.minimum(length - up - low - dig, 3)
    case = np.where(up == 0, 0, np.where(low == 0, np.where(up > 1, 1, 2), np.where(up == 1, 2, 3)))
    size = np.digitize(length, [2, 4, 9])
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    wide = (up + low) > 0
    shape = ((((symbols * 4 + case) * 2 + (dig > 0)) * 4 + size) * 2 + again) * 2 + wide
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), shape, first


@dataclass
class Model:
    """Word vectors and network; of one size whatever the corpus."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, column: pa.Array) -> np.ndarray:
        x = (pooled(column, self.vectors) - self.mean) / self.scale
        logit = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))


def _blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE_BYTES`` together."""
    if len(column):
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(column)]
        yield from zip(cuts, cuts[1:])


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Means of the word vectors and of the shapes' index vectors, and the log of
    the number of words."""
    shapes = _dense(*_index_vectors(_SHAPES, 11))
    out = np.zeros((len(column), 2 * DIMS + 1))
    for a, b in _blocks(column):
        words, shape, first = _words(column.slice(a, b - a))
        count = np.diff(first)
        full = np.flatnonzero(count)
        if len(full):
            at = first[:-1][full]
            doc = np.repeat(np.arange(b - a), count)
            out[a + full, :DIMS] = np.add.reduceat(vectors[words], at, axis=0) / count[full, None]
            histogram = np.bincount(doc * _SHAPES + shape, minlength=(b - a) * _SHAPES).reshape(b - a, _SHAPES)
            out[a + full, DIMS : 2 * DIMS] = histogram[full] @ shapes / count[full, None]
            out[a + full, 2 * DIMS] = np.log1p(count[full])
    return out


def _contexts(column: pa.Array, sums: np.ndarray) -> None:
    """Adds to each bucket's row of ``sums`` the index vectors of its words'
    neighbours and, last, their number."""
    places, signs = _index_vectors(BUCKETS, 7)
    flat, width = sums.reshape(-1), DIMS + 1
    for start, stop in _blocks(column):
        words, _, first = _words(column.slice(start, stop - start))
        text = np.repeat(np.arange(stop - start), np.diff(first))
        for d in range(1, REACH + 1):
            near = np.flatnonzero(text[d:] == text[:-d]) if len(text) > d else np.zeros(0, np.int64)
            for a, b in ((words[near], words[near + d]), (words[near + d], words[near])):
                flat += np.bincount(a * width + DIMS, minlength=len(flat))
                for k in range(NONZERO):
                    flat += np.bincount(a * width + places[b, k], weights=signs[b, k], minlength=len(flat)).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random indexing over all documents: a bucket's vector is its own index
    vector plus the mean of those of all its neighbours.  Each task sends its sums
    in ``PARTS`` pieces of a fixed size, which one task for each piece adds up; the
    driver gets one matrix, of one size whatever the corpus."""
    rows = BUCKETS // PARTS

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIMS + 1), np.int64)
        for batch in batches:
            _contexts(batch.column("text"), sums)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([sums[k * rows : (k + 1) * rows].tobytes() for k in range(PARTS)], pa.binary())], ["part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("part").to_pylist(), batch.column("sums")):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "sums"])

    sent = docs.select(named(text_col).alias("text")).mapInArrow(gathered, "part int, sums binary")
    whole = np.zeros((BUCKETS, DIMS + 1), np.int64)
    for r in sent.repartition("part").mapInArrow(added, "part int, sums binary").collect():  # one matrix
        whole[r.part * rows : (r.part + 1) * rows] += np.frombuffer(r.sums, np.int64).reshape(rows, -1)
    return (_dense(*_index_vectors(BUCKETS, 7)) + whole[:, :DIMS] / np.maximum(whole[:, DIMS:], 1)).astype(np.float32)


def fitted(column: pa.Array, labels: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Model:
    """Fits the network on a sample; a fifth of it is kept apart to set the
    temperature.  Without rows of both classes: the share of label 1."""
    x = pooled(column, vectors)
    rng = np.random.default_rng(seed)
    width = 2 * DIMS + 1
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x, y = (x - mean) / scale, labels.astype(float)
    apart = rng.random(len(y)) < 0.2
    if not (~apart).any() or len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    params = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xt, yt = x[~apart], y[~apart]
    for t in range(1, STEPS + 1):
        hidden = np.tanh(xt @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30)))
        error = (p - yt) / len(yt)
        back = error[:, None] * params[2] * (1 - hidden**2)
        grads = [xt.T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], np.array([error.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - 0.02 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    temperature = 1.0
    if apart.any():
        logit, held = np.tanh(x[apart] @ params[0] + params[1]) @ params[2] + params[3][0], y[apart]
        loss = lambda s: np.logaddexp(0, np.where(held > 0, -logit, logit) / s).mean()
        temperature = float(min(np.geomspace(0.5, 8, 57), key=loss))
    return Model(vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), temperature)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5
    (a null id counts as empty text, so it is held out)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors from all of ``docs``; the network is fitted on at most ``rows``
    labelled rows outside the held-out fifth, taken by a hash of their id; texts
    over ``SAMPLE_CHARS`` characters are left out of the sample (never out of the
    vectors or the scoring).  Of an id with several texts the least is taken, of
    one with several labels the greatest."""
    doc_id, label = named(id_col).cast("long"), named(label_col)
    known = labels.filter(label.isNotNull() & named(id_col).isNotNull() & ~held_out(doc_id)).groupBy(doc_id.alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = docs.select(doc_id.alias("id"), named(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    sample = sample.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text")).toArrow().combine_chunks().sort_by("id")
    column = sample.column("text").cast(pa.large_string())
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return fitted(column, sample.column("label").to_numpy().astype(np.int64), word_vectors(docs, text_col))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row's whole text; null counts
    as empty, and empty texts get the score of a text without words.  Equal
    texts get equal scores.  A map without shuffle; the model is broadcast and
    has one size whatever the corpus.  All columns pass through beside Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(column.fill_null("")), pa.float64())

    return docs.withColumn(score_col, score(named(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``; null and
    empty texts have one score, null ids are held out, repeated rows are scored
    each, other columns are not read, an empty table gives an empty result."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learnt(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
