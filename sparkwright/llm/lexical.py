"""Ranked lexical search by inverted treaps.

Documents are indexed in blocks of bounded size.  In a block each term has a treap
over the documents that hold it: search order by document, heap order by impact,
the term's part of a document's score.  A query walks the treaps of all its terms
at once: a region of documents is bounded by the sum of the impacts at the roots
of its subtrees, is left out when that sum cannot enter the best k, else is split
at the document of its highest impact, which is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.llm.shared import named, written
from sparkwright.llm.text import slices, texts

#: A block ends at so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 8192, 8 << 20
#: Bytes of (item, term) pairs that are searched for at once, and that tasks get.
GROUP_BYTES = 8 << 20
#: Regions that one step of a walk splits.
STEP = 4096
#: Words of a text are counted in pieces of so many bytes.
PIECE_BYTES = 1 << 20
#: First places of an item are found in so many parts first.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what a term consists of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z to a-z; ASCII bytes that no term holds to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

BLOCK = "docs array<bigint>, lens array<bigint>, terms array<binary>, starts array<int>, at array<int>, tf array<int>"


def counted(text: str) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each occurs."""
    data = text.encode().translate(_FOLD)
    total, counts, at = 0, Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        words = data[at : end if end >= 0 else len(data)].split()
        total += len(words)
        counts.update(words)
        at = end if end >= 0 else len(data)
    return total, counts


def indexed(docs: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block: ids in rising order (null last), their numbers of terms,
    the block's terms, and for each its documents (places in ``docs``) and how
    often they hold it.  ``terms`` restricts the index to a bounded set.  A map:
    every document is in one block, null texts have no term."""

    def flushed(ids: list, lens: list, entries: list[dict]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        lists: dict[bytes, tuple[list, list]] = {}
        for place, i in enumerate(order):
            for term, tf in entries[i].items():
                at, tfs = lists.setdefault(term, ([], []))
                at.append(place)
                tfs.append(tf)
        names = sorted(lists)
        starts = np.concatenate([[0], np.cumsum([len(lists[t][0]) for t in names])]).astype(np.int32)
        flat = lambda k: np.concatenate([np.asarray(lists[t][k], np.int32) for t in names]) if names else np.zeros(0, np.int32)
        columns = [[ids[i] for i in order], [lens[i] for i in order], names, starts, flat(0), flat(1)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, kind)) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["docs", "lens", "terms", "starts", "at", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens, entries, size = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for i, text in zip(part.column("doc_id").to_pylist(), texts(part, "text")):
                    n, counts = counted(text)
                    ids.append(i)
                    lens.append(n)
                    entries.append(dict(counts) if terms is None else {t: counts[t] for t in counts.keys() & terms})
                    size += len(text)
                    if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield flushed(ids, lens, entries)
                        ids, lens, entries, size = [], [], [], 0
        if ids:
            yield flushed(ids, lens, entries)

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(run, BLOCK)


def treaps(priority: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, roots) of the treaps of all terms of a block, from distinct
    priorities in search order; ``first`` holds where each term starts.  A node's
    parent is the lesser of the nearest greater nodes on both sides; those are
    found by jumps from node to node, for all nodes at once.  Absent: -1; the
    arrays have one more entry, for index -1."""
    n = len(priority)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True

    def nearest(step: int) -> np.ndarray:
        at = np.arange(n)
        out = at + step
        out[edge[:n] if step < 0 else edge[1:]] = -1
        live = np.flatnonzero(out >= 0)
        while len(live):
            live = live[priority[out[live]] < priority[live]]
            out[live] = out[out[live]]
            live = live[out[live] >= 0]
        return out

    before, after = nearest(-1), nearest(1)
    left, right = np.full(n + 1, -1), np.full(n + 1, -1)
    has_b, has_a = before >= 0, after >= 0
    up_right = has_a & (~has_b | (priority[after] < priority[before]))
    up_left = has_b & ~up_right
    left[after[up_right]] = np.flatnonzero(up_right)
    right[before[up_left]] = np.flatnonzero(up_left)
    return left, right, np.flatnonzero(~has_b & ~has_a)


@dataclass(frozen=True)
class Queries:
    """Distinct queries, as padded rows of places in a vocabulary, and the weight
    of each of its terms; N and L of the collection."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    terms: np.ndarray
    n_docs: int
    n_terms: int


class Best:
    """The best k rows of each query so far; ties by null, then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows = np.zeros((0, 4), np.int64)  # query, score, id is null, id
        self.floor = np.ones(queries, np.int64)  # least score that may enter
        self.null, self.id = np.ones(queries, np.int64), np.full(queries, np.iinfo(np.int64).max)  # key of the last row of a full list

    def add(self, q: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[q]
        if not keep.any():
            return
        new = np.column_stack([q, score, null, ids])[keep]
        touched = np.isin(self.rows[:, 0], new[:, 0])
        rows = np.concatenate([self.rows[touched], new])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        last = rows[place == self.k - 1]
        self.floor[last[:, 0]], self.null[last[:, 0]], self.id[last[:, 0]] = last[:, 1], last[:, 2], last[:, 3]
        self.rows = np.concatenate([self.rows[~touched], rows[place < self.k]])

    def hopeless(self, q: np.ndarray, bound: np.ndarray, null: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether nothing from that id on, with at most that score, can enter."""
        later = (null > self.null[q]) | ((null == self.null[q]) & (ids > self.id[q]))
        return (bound < self.floor[q]) | ((bound == self.floor[q]) & later)


def long_norms(lens: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document; in Python's integers where 64 bits might not do."""
    if 50 * int(lens.max(initial=0)) * n_docs < 1 << 63:
        return 50 + (50 * lens * n_docs) // n_terms
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in lens], np.int64)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of all spans, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(sizes.sum())


@dataclass(frozen=True)
class Regions:
    """Regions [low, high) of documents, each of one query, with the roots of the
    subtrees that lie there: ``sizes`` of them, one after the other."""

    query: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    nodes: np.ndarray

    def pick(self, rows: np.ndarray) -> Regions:
        spans = _spans((np.cumsum(self.sizes) - self.sizes)[rows], self.sizes[rows])
        return Regions(self.query[rows], self.low[rows], self.high[rows], self.sizes[rows], self.nodes[spans])

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.cumsum(self.sizes) - self.sizes)


def walk(block: dict, queries: Queries, best: Best) -> int:
    """Puts a block's documents that belong there into ``best``; returns how many
    documents were scored."""
    found = np.array([queries.vocabulary.get(t, -1) for t in block["terms"]], np.int64)
    used = np.flatnonzero((found >= 0) & (queries.weights[found] > 0))
    if not len(used):
        return 0
    starts = block["starts"].astype(np.int64)
    sizes = starts[used + 1] - starts[used]
    pick = _spans(starts[used], sizes)
    at, tf, of = block["at"][pick].astype(np.int64), block["tf"][pick].astype(np.int64), np.repeat(np.arange(len(used)), sizes)
    m = long_norms(block["lens"], queries.n_docs, queries.n_terms)
    part = 1_000_000_000 * tf // (1000 * tf + 20 * m[at])
    n_docs = len(block["lens"])
    shuffled = np.random.default_rng(n_docs).permutation(n_docs)  # ties of impact: any order but that of the ids
    left, right, roots = treaps(part * n_docs + shuffled[at], np.cumsum(sizes) - sizes)
    impact, keys = queries.weights[found[used]][of] * part, of * n_docs + at  # keys rise
    root = np.full(len(queries.weights), -1)
    root[found[used]] = roots  # as many as there are terms, in their order
    null, ids = block["null"], block["ids"]

    def pruned(r: Regions) -> Regions:
        """The regions that may hold something, the best ones last."""
        bound = r.sums(impact[r.nodes]) if len(r.query) else r.query
        live = np.flatnonzero(~best.hopeless(r.query, bound, null[r.low], ids[r.low]))
        return r.pick(live[np.argsort(bound[live], kind="stable")])

    nodes = root[queries.terms]
    some = np.flatnonzero((nodes >= 0).any(1))
    all_docs = np.full(len(some), n_docs)
    stack, scored = [Regions(some, np.zeros_like(all_docs), all_docs, (nodes[some] >= 0).sum(1), nodes[nodes >= 0])], 0
    while stack:
        r = pruned(stack.pop())
        if not len(r.query):
            continue
        first, row = np.cumsum(r.sizes) - r.sizes, np.repeat(np.arange(len(r.query)), r.sizes)
        split = np.maximum.reduceat(impact[r.nodes] * n_docs + at[r.nodes], first) % n_docs
        wanted = of[r.nodes] * n_docs + split[row]
        where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        best.add(r.query, r.sums(np.where(keys[where] == wanted, impact[where], 0)), null[split], ids[split])
        scored += len(split)
        sides = []
        for low, high in ((r.low, split), (split + 1, r.high)):
            # Of each treap the highest node that lies in this side.
            n, (lows, highs) = r.nodes.copy(), (low[row], high[row])
            out = np.flatnonzero((at[n] >= highs) | (at[n] < lows))
            while len(out):
                n[out] = np.where(at[n[out]] >= highs[out], left[n[out]], right[n[out]])
                out = out[n[out] >= 0]
                out = out[(at[n[out]] >= highs[out]) | (at[n[out]] < lows[out])]
            size = np.bincount(row[n >= 0], minlength=len(split))
            some = np.flatnonzero(size)
            sides.append((r.query[some], low[some], high[some], size[some], n[n >= 0]))
        r = pruned(Regions(*(np.concatenate(x) for x in zip(*sides))))
        stack += [r.pick(np.arange(k, min(k + STEP, len(r.query)))) for k in range(0, len(r.query), STEP)]
    return scored


def _block(batch: pa.RecordBatch, row: int) -> dict:
    values = lambda name: batch.column(name)[row].values
    ids = values("docs")
    return {
        "null": np.asarray(ids.is_null()).astype(np.int64), "ids": ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False),
        "lens": values("lens").to_numpy(), "terms": values("terms").to_pylist(), **{k: values(k).to_numpy() for k in ("starts", "at", "tf")},
    }


def _best_rows(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, score, doc_id): the best k rows of each query that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.terms), k)
        for batch in batches:
            for row in range(batch.num_rows):
                walk(_block(batch, row), queries, best)
        r = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(r[:, 0].astype(np.int32)), pa.array(r[:, 1]), pa.array(r[:, 3], mask=r[:, 2] == 1)], ["query", "score", "doc_id"])

    return index.mapInArrow(run, "query int, score long, doc_id long")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item's texts."""
    folded = F.translate(F.coalesce(named(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    return items.select(named(id_col).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Each item's ``k`` best rows of ``docs`` with a score above 0: ``item_id,
    rank, doc_id, score``.  Terms are maximal runs of ASCII letters, digits and all
    other characters beyond ASCII, A-Z in lower case.  With N documents that hold a
    term, L terms in all of them, n in one of them, df documents that hold a term
    and tf of it in one, the score sums w * (10**9 * tf div (1000 * tf + 20 * m))
    over an item's terms, w = floor(1000 * ln((2N + 2) / (2df + 1))) in doubles and
    m = 50 + (50 * n * N) div L in whole numbers.

    Items are searched in groups whose (item, term) pairs measure about
    ``GROUP_BYTES``: tasks get one group's terms and weights, never more than that
    and one item's own terms.  Items with equal terms are one query.  For a group
    the index, restricted to its terms, is written once; numbers of documents are
    added up from it, then each task walks the treaps of its blocks with the best
    rows it has so far as the bound, and the tasks' best rows meet in two steps.
    ``index`` is a stored ``indexed(docs)`` of all terms, used in place of ``docs``.

    Null and empty texts have no term and are never returned; they count in no
    figure.  Rows of one item id, null included, count as one item with the terms
    of all its texts; an item without terms, or with terms in no document,
    returns nothing.  Rows of ``docs`` that repeat an id are ranked each; a null
    id comes last among equal scores.  Empty tables give an empty result.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text), "item-terms")
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    kind = items.schema[item_col].dataType.simpleString()
    found = []
    for g in range(groups):
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # bounded by GROUP_BYTES and one item
        of_item: dict[object, list[str]] = {}
        for r in rows:
            of_item.setdefault(r.item_id, []).append(r.term)
        vocabulary = {t: i for i, t in enumerate(sorted({r.term.encode() for r in rows}))}
        blocks = written(indexed(docs, set(vocabulary), id_col, text_col), "treap-blocks") if index is None else index
        n = blocks.agg(F.sum(F.size(F.filter("lens", lambda x: x > 0))), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        n_docs, n_terms = n[0] or 0, n[1] or 0
        each = blocks.select(F.posexplode("terms").alias("i", "term"), "starts").select("term", (F.get("starts", F.col("i") + 1) - F.get("starts", F.col("i"))).alias("n"))
        if index is not None:
            each = each.join(F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term binary")), "term", "left_semi")  # one group's terms
        weights = np.zeros(len(vocabulary) + 1, np.int64)  # the last is that of no term
        for r in each.groupBy("term").agg(F.sum("n").alias("n")).collect():  # one group's terms
            weights[vocabulary[bytes(r.term)]] = weight(n_docs, r.n)
        distinct: dict[tuple[int, ...], list] = {}
        for item, terms in of_item.items():
            distinct.setdefault(tuple(sorted(vocabulary[t.encode()] for t in terms)), []).append(item)
        wide = max(map(len, distinct), default=0)
        table = np.array([[*q, *[len(vocabulary)] * (wide - len(q))] for q in distinct], np.int64).reshape(len(distinct), wide)
        if not len(distinct) or not n_terms:
            continue
        hits = _best_rows(blocks, Queries(vocabulary, weights, table, n_docs, n_terms), k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("query", part).orderBy(*order))).filter(F.col("rank") <= k)
        hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        owners = spark.createDataFrame([(q, item) for q, of in enumerate(distinct.values()) for item in of], f"query int, item_id {kind}")
        found.append(hits.join(F.broadcast(owners), "query").select("item_id", "rank", "doc_id", "score"))  # one group's items
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
