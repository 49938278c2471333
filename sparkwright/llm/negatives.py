"""Hard negatives by one-dimensional distance keys.

Vectors of whole numbers get one more component, so that all have one length and
the nearest by distance are those of the highest inner product.  Each is stored
under (pivot, distance to it), in that order, in blocks of consecutive keys.  By
the triangle inequality a row at key k of a pivot is at least |d - k| and at most
d + k from a query that is d from the pivot: a search first scans the block around
the query's own key, then, in all pivots, the keys within the distance of the
worst row that it has found, beyond which nothing can be better.  An upper limit
of the score cuts a hole into that, so what is scanned is an annulus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.llm.shared import named, written

#: Pivots, and the rows that they are chosen from (those of the least hashes of their
#: ids).  Any choice gives the same results; it only decides what scans can skip.
PIVOTS, PIVOT_ROWS = 32, 1024
#: Rows of a block of the index, requests of a block of queries.
BLOCK_ROWS, REQUEST_ROWS = 4096, 4096
#: Parts that the pairs of one block of queries are dealt to.
SALTS = 16

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_CLIP = float(1 << 62)
ROW = "id long, label long, vec binary, dim int, square double"
KEYED = "id long, label long, vec binary, pivot int, key double"
BLOCK = "block long, pivot int, low double, high double, ids array<bigint>, labels array<bigint>, width int, vecs binary"
REQUEST = "anchor long, label long, vec binary, home long, slot int, same boolean, k int, low long, high long, floor long"
QUERIES = "queries string, anchor array<bigint>, label array<bigint>, home array<bigint>, slot array<bigint>, same array<bigint>, k array<bigint>, low array<bigint>, high array<bigint>, floor array<bigint>, row array<bigint>, vecs binary"
HIT = "anchor long, slot int, id long, score long"
_FIELDS = ("anchor", "label", "home", "slot", "same", "k", "low", "high", "floor")


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """``ROW``s of (id, label, vector): floor(scale * x) of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            at = np.r_[0, np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))].astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                numbers = np.clip(np.floor(scale * values), -_CLIP, _CLIP)
            squares = np.add.reduceat(np.r_[numbers * numbers, 0.0], at[:-1]) * (np.diff(at) > 0)
            vecs = [numbers[a:b].astype("<i8").tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(vecs, pa.binary()), pa.array(np.diff(at), pa.int32()), pa.array(squares)], ["id", "label", "vec", "dim", "square"])

    return rows.mapInArrow(run, ROW)


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    return np.frombuffer(b"".join(v.ljust(8 * dim, b"\0") for v in vecs), "<i8").reshape(len(vecs), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where those hold all sums,
    else in 64 bits, else in Python's integers, cut to 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST + 1, MOST).astype(np.int64)


@dataclass(frozen=True)
class Space:
    """The common length (squared), the dimension, and the pivots with their last
    component."""

    square: float
    dim: int
    pivots: np.ndarray

    @property
    def slack(self) -> float:
        """More than what rounding moves a distance by."""
        return 1e-6 * self.square**0.5 + 1e-6

    def distances(self, x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        """Of rows with that last component to all pivots."""
        x = x.astype(np.float64)
        squares = (x * x).sum(1) + np.broadcast_to(np.square(last), len(x))
        inner = x @ self.pivots[:, :-1].T + np.multiply.outer(np.broadcast_to(last, len(x)), self.pivots[:, -1])
        return np.sqrt(np.maximum(squares[:, None] + (self.pivots**2).sum(1) - 2 * inner, 0))

    def last(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))


def space_of(rows: DataFrame, pivots: int = PIVOTS) -> Space | None:
    """The space of a table of ``ROW``s: pivots are rows far from one another, of a
    bounded sample; None for no rows."""
    r = rows.agg(F.max("square").alias("square"), F.max("dim").alias("dim")).first()
    if r.square is None:
        return None
    sample = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).collect()  # PIVOT_ROWS rows
    x = _matrix([bytes(s.vec) for s in sample], r.dim)
    empty = Space(r.square, r.dim, np.zeros((0, r.dim + 1)))
    points = np.column_stack([x.astype(np.float64), empty.last(x)])
    chosen, away = [0], np.full(len(points), np.inf)
    while len(chosen) < pivots:
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
        if away.max() <= 0:
            break
        chosen.append(int(away.argmax()))
    return Space(r.square, r.dim, points[chosen])


def _keyed(rows: DataFrame, space: Space) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec").to_pylist(), space.dim)
            d = space.distances(x, space.last(x))
            pivot = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "vec")), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(x)), pivot])], ["id", "label", "vec", "pivot", "key"])

    return rows.mapInArrow(run, KEYED)


def distance_index(rows: DataFrame, space: Space) -> DataFrame:
    """``BLOCK``s: consecutive rows of one pivot in the order of their keys, each row
    in one block, which is named by its first id; equal keys are dealt by id."""

    def block(part: list[tuple]) -> pa.RecordBatch:
        ids, labels, vecs, pivots, keys = zip(*part)
        x = _matrix(list(vecs), space.dim)
        most = np.abs(x).max(initial=0)
        width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        one = lambda v, kind: pa.array([v], kind)
        return pa.RecordBatch.from_arrays(
            [one(ids[0], pa.int64()), one(pivots[0], pa.int32()), one(keys[0], pa.float64()), one(keys[-1], pa.float64()), one(list(ids), pa.list_(pa.int64())), one(list(labels), pa.list_(pa.int64())), one(width, pa.int32()), one(x.astype(f"<i{width}").tobytes(), pa.binary())],
            ["block", "pivot", "low", "high", "ids", "labels", "width", "vecs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vec", "pivot", "key"))):
                if part and (len(part) == BLOCK_ROWS or part[0][3] != row[3]):
                    yield block(part)
                    part = []
                part.append(row)
        if part:
            yield block(part)

    order = ("pivot", "key", "id")
    return _keyed(rows, space).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCK)


def _vectors(batch: pa.RecordBatch, row: int, dim: int) -> np.ndarray:
    width = batch.column("width")[row].as_py() if "width" in batch.schema.names else 8
    return np.frombuffer(batch.column("vecs")[row].as_buffer(), f"<i{width}").reshape(-1, dim).astype(np.int64)


def _numbers(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy()


def anchor_requests(index: DataFrame, space: Space, every: int, k: int) -> DataFrame:
    """A request of each row whose id ``every`` divides: its best ``k`` of the same
    label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = _numbers(batch, row, "ids"), _numbers(batch, row, "labels")
                mine = np.flatnonzero(ids % every == 0)
                x = _vectors(batch, row, space.dim)[mine]
                same = lambda v, kind: pa.array([v] * len(mine), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[mine]), pa.array(labels[mine]), pa.array([v.astype("<i8").tobytes() for v in x], pa.binary()), same(batch.column("block")[row].as_py(), pa.int64()), same(0, pa.int32()), same(True, pa.bool_()), same(k, pa.int32()), same(LEAST, pa.int64()), same(MOST, pa.int64()), same(LEAST, pa.int64())],
                    ["anchor", "label", "vec", "home", "slot", "same", "k", "low", "high", "floor"],
                )

    return index.select("block", "ids", "labels", "width", "vecs").mapInArrow(run, REQUEST)


def _packed(requests: DataFrame, dim: int) -> DataFrame:
    """Requests in blocks, those of nearby keys together, each vector once."""

    def block(part: list[dict]) -> pa.RecordBatch:
        row, vecs, last = [], [], None
        for r in part:
            if r["anchor"] != last:
                vecs.append(r["vec"])
                last = r["anchor"]
            row.append(len(vecs) - 1)
        lists = [pa.array([[int(r[f]) for r in part]], pa.list_(pa.int64())) for f in _FIELDS]
        name = f"{part[0]['anchor']}:{part[0]['slot']}"
        return pa.RecordBatch.from_arrays([pa.array([name]), *lists, pa.array([row], pa.list_(pa.int64())), pa.array([_matrix(vecs, dim).tobytes()], pa.binary())], ["queries", *_FIELDS, "row", "vecs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                part.append(r)
                if len(part) == REQUEST_ROWS:
                    yield block(part)
                    part = []
        if part:
            yield block(part)

    return requests.repartitionByRange("home", "anchor").sortWithinPartitions("home", "anchor", "slot").mapInArrow(run, QUERIES)


def _reach(queries: DataFrame, space: Space) -> DataFrame:
    """(queries, pivot, from, to): the keys of each pivot that a block's requests
    can need, by what they have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _vectors(batch, i, space.dim)
                row, worst = _numbers(batch, i, "row"), np.maximum(_numbers(batch, i, "low"), _numbers(batch, i, "floor"))
                d, squares = space.distances(x, 0.0)[row], (x.astype(np.float64) ** 2).sum(1)[row]
                radius = np.sqrt(np.maximum(squares + space.square - 2.0 * worst, 0)) + space.slack
                low, high = (d - radius[:, None]).min(0), (d + radius[:, None]).max(0)
                n = len(space.pivots)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("queries")[i].as_py()] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], ["queries", "pivot", "from", "to"])

    return queries.select("queries", "low", "floor", "row", "vecs").mapInArrow(run, "queries string, pivot int, from double, to double")


def _best(x: np.ndarray, y: np.ndarray, q: dict, ids: np.ndarray, labels: np.ndarray, space: Space, pivot: int, keys: tuple[float, float], at_home: np.ndarray) -> Iterator[tuple]:
    """The best rows of one block for each request that it can serve."""
    d, squares = space.distances(x, 0.0)[q["row"], pivot], (x.astype(np.float64) ** 2).sum(1)[q["row"]]
    gap = np.maximum(np.maximum(keys[0] - d, d - keys[1]) - space.slack, 0)
    most, least = (squares + space.square - gap**2) / 2 + 1, (squares + space.square - (d + keys[1] + space.slack) ** 2) / 2 - 1
    worst = np.maximum(q["low"], q["floor"])
    wanted = np.flatnonzero(at_home & (most >= worst) & (least <= q["high"]))
    step = max(1, (1 << 21) // max(1, len(ids)))
    for part in (wanted[i : i + step] for i in range(0, len(wanted), step)):
        rows, of = np.unique(q["row"][part], return_inverse=True)
        s = products(x[rows], y)[of]
        fits = (s >= worst[part][:, None]) & (s <= q["high"][part][:, None]) & ((labels == q["label"][part][:, None]) == (q["same"][part] == 1)[:, None]) & (ids != q["anchor"][part][:, None])
        r, c = np.nonzero(fits)
        order = np.lexsort((ids[c], -s[r, c], r))
        r, c = r[order], c[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else r
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        keep = place < q["k"][part][r]
        r, c = r[keep], c[keep]
        yield q["anchor"][part][r], q["slot"][part][r].astype(np.int32), ids[c], s[r, c]


def _scanned(queries: DataFrame, pairs: DataFrame, index: DataFrame, space: Space, at_home: bool) -> DataFrame:
    """``HIT``s of the pairs (queries, block).  ``at_home``: of requests in their
    anchor's own block, else of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = {f: _numbers(batch, i, f) for f in (*_FIELDS, "row")}
                x = np.frombuffer(batch.column("q_vecs")[i].as_buffer(), "<i8").reshape(-1, space.dim)
                y = _vectors(batch, i, space.dim)
                home = q["home"] == batch.column("block")[i].as_py()
                keys = batch.column("key_low")[i].as_py(), batch.column("key_high")[i].as_py()
                for arrays in _best(x, y, q, _numbers(batch, i, "ids"), _numbers(batch, i, "labels"), space, batch.column("pivot")[i].as_py(), keys, home if at_home else ~home):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["anchor", "slot", "id", "score"])

    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS))
    q = queries.withColumnRenamed("vecs", "q_vecs").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    blocks = index.withColumnsRenamed({"low": "key_low", "high": "key_high"})
    return pairs.withColumn("salt", salt).join(q, ["queries", "salt"]).join(blocks, "block").mapInArrow(run, HIT)


def _ranked(hits: DataFrame) -> DataFrame:
    """The rank of each hit of a request, by score, then id."""
    w = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w))


def answered(requests: DataFrame, index: DataFrame, space: Space, k: int) -> DataFrame:
    """(anchor, slot, id, score, rank): the best ``k`` rows of each request, exactly;
    written.  Two scans: the block around the anchor's key, then every block within
    the distance of what that gave."""
    requests = written(requests, "requests")
    queries = written(_packed(requests, space.dim), "query-blocks")
    near = queries.select("queries", F.explode(F.array_distinct("home")).alias("block"))
    first = written(_ranked(_scanned(queries, near, index, space, True)).filter(F.col("rank") <= k), "hits-at-home")
    floors = first.filter(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("found"))
    raised = requests.join(floors, ["anchor", "slot"], "left").withColumn("floor", F.coalesce("found", "floor")).select(requests.columns)
    queries = written(_packed(raised, space.dim), "query-blocks")
    reach = _reach(queries, space)
    metas = index.select("block", "pivot", "low", "high")
    pairs = reach.join(metas, "pivot").filter((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))).select("queries", "block")
    rest = _scanned(queries, pairs, index, space, False)
    return written(_ranked(first.drop("rank").unionByName(rest)).filter(F.col("rank") <= k), "answers")


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", every: int = 50, positives: int = 5, negatives: int = 3, scale: int = 256, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id ``every`` divides, positives the first ``positives``
    other rows of an anchor's label by the inner product of floor(``scale`` * x),
    then by id; negatives, of each anchor and positive, the first rows of another
    label whose score is from ``low`` to ``high`` per cent of the positive's.
    Every row is in the index and every answer is certified: recall is 1.

    Rows with a null label or vector, or a null, infinite or NaN component, take no
    part, nor do rows with a null id, which nothing could name.  Of rows that repeat
    an id the least (label, vector) stands for all.  A shorter vector counts as
    filled up with zeros, an empty one as all zeros; components beyond 2**62 count as
    that, scores beyond 64 bits as the last that fits.  Anchors without a positive
    and positives without a negative give no row, an empty table none.  Other
    columns are not read.
    """
    spark: SparkSession = table.sparkSession
    label = named(label_col) if isinstance(label_col, str) else label_col
    rows = table.select(named(id_col).cast("long").alias("id"), label.cast("long").alias("label"), named(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(finite)
    numbers = written(whole_numbers(rows, scale), "vectors")
    if not numbers.groupBy("id").count().filter("count > 1").isEmpty():
        once = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")
        numbers = written(whole_numbers(once, scale), "vectors")
    space = space_of(numbers)
    if space is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = written(distance_index(numbers, space), "distance-index")
    anchors = written(anchor_requests(index, space, every, positives), "anchors")
    found = answered(anchors, index, space, positives)
    # 50 * p <= 100 * n <= 95 * p, in whole numbers.
    least, most = (F.expr(f"(score div 100) * {p} + ((score % 100) * {p} + {up}) div 100") for p, up in ((low, 99), (high, 0)))
    windows = found.filter("score >= 0").select("anchor", F.col("rank").alias("slot_"), least.alias("low_"), most.alias("high_"))
    asked = anchors.join(windows, "anchor").select("anchor", "label", "vec", "home", F.col("slot_").alias("slot"), F.lit(False).alias("same"), F.lit(negatives).alias("k"), F.col("low_").alias("low"), F.col("high_").alias("high"), F.lit(LEAST).cast("long").alias("floor")).filter("low <= high")
    mined = answered(asked, index, space, negatives)
    pairs = found.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(pairs, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
