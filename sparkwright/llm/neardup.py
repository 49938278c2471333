"""MinHash near-dedup by a chosen-path similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.components import components
from sparkwright.llm.exact import digest_filter, may_hold, probed
from sparkwright.llm.shared import fresh, named, written
from sparkwright.llm.text import mixed, slices, utf8, word_hashes, word_spans

#: Independent trees, and minwise tokens along a path of each.
TREES, DEPTH = 12, 8
#: Trees of the first round, which joins most of each component; the second goes
#: through all.
FIRST_TREES = 4
#: Bytes of a sketch: one minwise value each, independent of the paths.
SKETCH = 64
#: First round: nodes of up to so many rows are compared exhaustively; a node that
#: is larger at the last level is compared in windows, which differ from tree to
#: tree.
SMALL_NODE, WINDOW = 64, 256
#: Share of equal sketch values from which a pair is confirmed on full sets: for
#: a similarity of 0.8, more than three standard deviations low.
SLACK = 0.175
#: Second round: a node is compared exhaustively if its rows times those outside
#: its most frequent component are so many; it branches otherwise.
CROSSINGS = 1 << 22
#: A component of more rows is compared as a whole with what is likely near it;
#: of smaller ones, the rows that a node holds.
MANY = 64
#: Rows and shingles of a block; two blocks at most meet in one group, and a set
#: of more shingles is a block of its own.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Columns of the matrix in which a group's shared shingles are counted.
COLUMNS = 4096
#: Rows of either side where a whole component is compared with rows outside it.
SIDE = 256
#: Parts that one component's rows are dealt over where they meet what is known of it.
SALTS = 16
#: Rows of a tree that are looked at together at most: all of it if it has no more,
#: else all that share the first tokens of their paths, as few as make it so.
UNIT = 1 << 16

_VALUES = TREES * DEPTH + SKETCH
_A = mixed(np.arange(1, _VALUES + 1, dtype=np.uint64))
_ODD = [((_A & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)), ((_A >> np.uint64(32)).astype(np.uint32) | np.uint32(1))]


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, and where each
    text's begin.  Fewer words than a shingle has: all of them as one; no words:
    none."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    sets, at = [], [0]
    with np.errstate(over="ignore"):
        odd = mixed(np.arange(101, 101 + words, dtype=np.uint64)) | np.uint64(1)
        rolled = sum(h[k : len(h) - words + 1 + k] * odd[k] for k in range(words)) if len(h) >= words else h[:0]
        rolled = mixed(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                s = np.unique(rolled[a : b - words + 1])
            elif b > a:
                few = np.uint64(b - a)
                for x in h[a:b]:
                    few = mixed(np.array([few * odd[0] + x], np.uint64))[0]
                s = np.array([few], np.uint64)
            else:
                s = h[:0]
            sets.append(s)
            at.append(at[-1] + len(s))
    return (np.concatenate(sets) if sets else h[:0]), np.array(at)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set that is not empty: two bytes for each step of each tree's
    path, then the sketch."""
    low, high = (sets & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), 2 * TREES * DEPTH + SKETCH), np.uint8)
    starts = at[:-1][full]
    for j in range(_VALUES if len(full) else 0):
        least = np.minimum.reduceat(low * _ODD[0][j] + high * _ODD[1][j], starts)
        least = mixed(least.astype(np.uint64))
        if j < TREES * DEPTH:
            out[:, 2 * j] = least & np.uint64(0xFF)
            out[:, 2 * j + 1] = (least >> np.uint64(8)) & np.uint64(0xFF)
        else:
            out[:, TREES * DEPTH + j] = least & np.uint64(0xFF)
    return out


def signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest of the text, set_key, n, signature); null set_key and
    signature for empty sets.  ``set_key`` is 128 bits of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, at = shingle_sets(part.column("text"), words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys: list[bytes | None] = [None] * len(n)
                signs: list[bytes | None] = [None] * len(n)
                if len(full):
                    one, two = np.add.reduceat(mixed(sets), at[:-1][full]), np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
                    for k, a, b, s in zip(full.tolist(), one.tolist(), two.tolist(), signatures(sets, at)):
                        keys[k], signs[k] = a.to_bytes(8, "little") + b.to_bytes(8, "little"), s.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "digest", "set_key", "n", "signature"])

    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, set_key binary, n long, signature binary")


def _strays(roots: np.ndarray) -> np.ndarray:
    """Rows outside the most frequent root."""
    kinds, sizes = np.unique(roots, return_counts=True)
    return np.flatnonzero(roots != kinds[sizes.argmax()])


def leaves(paths: np.ndarray, roots: np.ndarray | None = None, starts: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """(start, stop, windowed) of the nodes to compare, over sorted rows of (tree,
    steps of the path).  A node is a run with equal beginnings, within one of the
    units that begin at ``starts``; it branches by the next minwise token until it
    is small or, with ``roots``, nearly all its rows have one root."""
    n = len(paths)
    same = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1)  # equal steps of neighbours, the tree first
    found = []
    live_starts = np.array([0]) if starts is None else starts
    live_stops = np.append(live_starts[1:], n)
    for level in range(DEPTH + 1):
        cuts = np.flatnonzero(same <= level) + 1
        inner = np.concatenate([cuts, live_starts])
        inside = np.searchsorted(live_starts, inner, "right") - 1
        inner = np.unique(inner[(inside >= 0) & (inner < live_stops[np.maximum(inside, 0)])])
        stop_of = live_stops[np.searchsorted(live_starts, inner, "right") - 1]
        stops = np.minimum(np.append(inner[1:], n), stop_of)
        small = stops - inner <= SMALL_NODE
        if roots is not None:
            for k in np.flatnonzero(~small).tolist():
                node = roots[inner[k] : stops[k]]
                small[k] = len(node) * len(_strays(node)) <= CROSSINGS
        found += [(a, b, False) for a, b in zip(inner[small].tolist(), stops[small].tolist()) if b - a > 1]
        live_starts, live_stops = inner[~small], stops[~small]
        if not len(live_starts):
            break
    found += [(a, b, True) for a, b in zip(live_starts.tolist(), live_stops.tolist())]
    return found


def _alike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal places of the sketches of ``one`` and ``two``, row by row."""
    if len(one) * len(two) <= 1 << 12:
        return (one[:, None, :] == two[None, :, :]).sum(axis=2)
    out = np.zeros((len(one), len(two)), np.uint8)
    for x, y in zip(np.ascontiguousarray(one.T), np.ascontiguousarray(two.T)):
        out += (x[:, None] == y).view(np.uint8)
    return out


def _joined(linked: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` rows the least row that links reach; ``linked[i, j]`` links the
    rows ``some[i]`` and ``j``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, some, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        label = np.minimum(label, np.where(linked, label[some][:, None], n).min(axis=0, initial=n))
        if (label == before).all():
            return label


def _groups(rows: np.ndarray, label: np.ndarray, nodes: np.ndarray, n: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(group, nodes) to compare on full sets, for the ``rows`` of each label: in
    the order of their sets' sizes they make up blocks, and each two blocks whose
    sizes allow a link are a group.  A group is named by what it holds, so trees
    that find the same rows name the same group."""
    rows = rows[np.lexsort((nodes[rows], n[rows], label[rows]))]
    for part in np.split(rows, np.flatnonzero(np.diff(label[rows])) + 1):
        if nodes[part].min(initial=0) == nodes[part].max(initial=0):
            continue
        size = n[part]
        block = np.maximum(np.arange(len(part)) // BLOCK, (np.cumsum(size) - size) // BLOCK_SHINGLES)
        blocks = np.split(part, np.flatnonzero(np.diff(block)) + 1)
        for i, one in enumerate(blocks):
            for two in blocks[i + 1 :] if len(blocks) > 1 else [one[:0]]:
                if not len(two) or n[one[-1]] >= similarity * n[two[0]]:
                    held = np.unique(nodes[np.concatenate([one, two])])
                    yield int(mixed(held.astype(np.uint64) + np.uint64(1)).sum().view(np.int64)), held


def candidates_of(paths: np.ndarray, starts: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, n: np.ndarray, similarity: float) -> set[tuple[int, int]]:
    """(group, node) for all pairs of a node, or of a window of a large one, whose
    sketches agree in enough places."""
    out: set[tuple[int, int]] = set()
    least = int(SKETCH * (similarity - SLACK))
    for start, stop, _ in leaves(paths, starts=starts):
        for a in range(start, stop, WINDOW):
            b = min(a + WINDOW, stop)
            linked = _alike(sketches[a:b], sketches[a:b]) >= least
            np.fill_diagonal(linked, False)
            rows = np.flatnonzero(linked.any(axis=1))
            if len(rows):
                label = _joined(linked, np.arange(b - a), b - a)
                for group, held in _groups(rows, label, nodes[a:b], n[a:b], similarity):
                    out.update((group, x) for x in held.tolist())
    return out


def crossing_of(paths: np.ndarray, starts: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, n: np.ndarray, roots: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """For all pairs of different roots in a node whose sketches agree in enough
    places, without a window or a limit to a row's partners: (group, node) where
    both components are small, else (root, node) with the root of the larger one
    and the row of the other."""
    small: set[tuple[int, int]] = set()
    large: set[tuple[int, int]] = set()
    least = int(SKETCH * (similarity - SLACK))
    for start, stop, _ in leaves(paths, roots, starts):
        r, s, at, size = roots[start:stop], sketches[start:stop], nodes[start:stop], sizes[start:stop]
        strays = _strays(r)
        step = max(1, CROSSINGS // len(r))
        for k in range(0, len(strays), step):
            some = strays[k : k + step]
            linked = (_alike(s[some], s) >= least) & (r[some, None] != r)
            if not linked.any():
                continue
            big = linked & (np.maximum(size[some, None], size) > MANY)
            x, y = np.nonzero(big)
            if len(x):
                x = some[x]
                larger = (size[x] > size[y]) | (size[x] == size[y]) & (r[x] < r[y])
                pairs = np.stack([np.where(larger, r[x], r[y]), np.where(larger, at[y], at[x])], axis=1)
                large.update(map(tuple, np.unique(pairs, axis=0).tolist()))
            linked &= ~big
            rows = np.flatnonzero(linked.any(axis=0) | np.isin(np.arange(len(r)), some[linked.any(axis=1)]))
            if len(rows):
                for group, held in _groups(rows, _joined(linked, some, len(r)), at, n[start:stop], similarity):
                    small.update((group, v) for v in held.tolist())
    return small, large


def _walk(batches: Iterator[pa.RecordBatch], similarity: float, again: bool) -> Iterator[pa.RecordBatch]:
    """Rows come unit by unit, those of a unit in the order of their paths: each node
    is a run.  Whole units are looked at together, as many as make up ``UNIT`` rows.
    ``whole`` marks pairs of a root and a node."""
    width = 1 + 2 * DEPTH

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        raw, _ = _fixed(batch.column("path"), width)
        steps = np.concatenate([raw[:, :1].astype(np.uint16), raw[:, 1:].copy().view(np.uint16)], axis=1)
        sketches, _ = _fixed(batch.column("sketch"), SKETCH)
        units = batch.column("unit").to_numpy()
        starts = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
        return steps, starts, batch.column("node").to_numpy(), sketches, *(batch.column(c).to_numpy() for c in (("n", "root", "size") if again else ("n",)))

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= UNIT:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                units = whole.column("unit").to_numpy()
                stop = int(np.searchsorted(-(units != units[-1]).astype(np.int8), 0))  # the last unit may go on
                if stop:
                    yield arrays(whole.slice(0, stop))
                held, size = [whole.slice(stop)], whole.num_rows - stop
        if held:
            yield arrays(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    for found in parts():
        small, large = crossing_of(*found, similarity) if again else (candidates_of(*found, similarity), set())
        for pairs, whole in ((sorted(small), False), (sorted(large), True)):
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([whole] * len(a))], ["group", "node", "whole"])


def _fixed(column: pa.Array, width: int) -> tuple[np.ndarray, int]:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, width), len(column)


def candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """(group, node, whole): the ``node``s of a group are compared with each other
    on full sets; where ``whole``, the group is a root, and the node is compared
    with all rows of its component.  The first round has no roots yet.

    Every class gives one row for each tree.  A tree's rows are one unit, if they
    are ``UNIT`` at most, else they branch by tokens of their paths until those with
    equal ones are.  A unit comes to one task, whole and in the order of its paths,
    so a node at any level is a run of rows, and what is compared does not depend
    on the number of partitions.  Rows that share all of a path and are still too
    many are dealt by their ties to units, which differ from tree to tree; in the
    second round such units are crossed, so each two rows of different roots meet.
    """
    again = "root" in classes.columns
    kept = ["node", "sketch", "n", *(["root", "size"] if again else [])]
    trees = F.array(*[F.struct(F.concat(F.unhex(F.lit(f"{t:02x}")), F.substring("signature", 2 * DEPTH * t + 1, 2 * DEPTH)).alias("path"), F.lit(t).alias("tree")) for t in range(TREES if again else FIRST_TREES)])
    rows = classes.select("node", "set_key", F.explode(trees).alias("x"), F.substring("signature", 2 * DEPTH * TREES + 1, SKETCH).alias("sketch"), *kept[2:])
    rows = rows.select(F.col("x.path").alias("path"), F.xxhash64("set_key", "x.tree").alias("tie"), *kept)
    rows = _in_units(rows, classes.count())
    rows = rows.repartition("unit").sortWithinPartitions("unit", "path", "tie").select("unit", "path", *kept)
    out = rows.mapInArrow(lambda batches: _walk(batches, similarity, again), "group long, node long, whole boolean").distinct()
    return written(out, "candidates") if again else out


def _in_units(rows: DataFrame, of_tree: int) -> DataFrame:
    """``rows`` of (path, tie) with their ``unit``.  Only the beginnings of paths that
    more than ``UNIT`` rows have are told to all tasks, one for so many rows."""
    rows = rows.withColumn("beginning", F.substring("path", 1, 1))
    if of_tree > UNIT:
        over = None
        for depth in range(1, DEPTH + 1):
            longer = F.substring("path", 1, 1 + 2 * depth)
            if over is None:
                rows = rows.withColumn("beginning", longer)
            else:
                rows = rows.join(F.broadcast(over), "beginning", "left").withColumn("beginning", F.when(F.col("many") > 0, longer).otherwise(F.col("beginning"))).drop("many")
            over = written(rows.groupBy("beginning").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > UNIT), "large-units")
            if over.isEmpty():
                return rows.withColumn("unit", F.xxhash64("beginning")).drop("beginning")
        if "root" in rows.columns:
            return _crossed(rows, over)
        parts = F.ceil(F.coalesce("many", F.lit(1)) / UNIT)
        rows = rows.join(F.broadcast(over), "beginning", "left").withColumn("part", F.pmod("tie", parts)).drop("many")
        return rows.withColumn("unit", F.xxhash64("beginning", "part")).drop("beginning", "part")
    return rows.withColumn("unit", F.xxhash64("beginning")).drop("beginning")


def _crossed(rows: DataFrame, over: DataFrame) -> DataFrame:
    """``rows`` of (path, tie, root) with their units, where those of a beginning of
    ``over`` are too many for one: each two of them that have different roots come to
    a unit together.  Rows of the beginning's most frequent root, which need not meet
    each other, are dealt to parts, and so are the rows outside it; a unit is one part
    of either, or two parts of rows outside."""
    half = UNIT // 2
    kinds = rows.join(F.broadcast(over.select("beginning")), "beginning").groupBy("beginning", "root").agg(F.count(F.lit(1)).alias("n"))
    most = kinds.groupBy("beginning").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("all"))
    parts = lambda n: F.ceil(n / half).cast("long")
    most = written(most.select("beginning", F.col("x.root").alias("main"), parts(F.col("x.n")).alias("mains"), parts(F.col("all") - F.col("x.n")).alias("strays")), "large-paths")
    meeting = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    each = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), F.col(n)), lambda k: k < F.col(n))
    main = F.col("root") == F.col("main")
    own = F.when(main, F.pmod("tie", "mains")).otherwise(F.pmod("tie", "strays"))
    inside = F.transform(each("strays"), lambda k: meeting("main", F.col("own"), k))
    outside = F.concat(F.transform(each("mains"), lambda k: meeting("main", k, F.col("own"))), F.transform(each("strays"), lambda k: meeting("stray", F.least(k, F.col("own")), F.greatest(k, F.col("own")))))
    few = F.array(meeting("few", F.lit(0), F.lit(0)))
    rows = rows.join(F.broadcast(most), "beginning", "left").withColumn("own", F.when(F.col("main").isNotNull(), own))
    rows = rows.withColumn("meeting", F.explode(F.when(F.col("main").isNull(), few).when(main, inside).otherwise(outside)))
    return rows.withColumn("unit", F.xxhash64("beginning", "meeting")).drop("beginning", "main", "mains", "strays", "own", "meeting")


def _texts_of(digests: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(digest, text), one row each.  A filter chooses the rows, so only texts that
    may be asked for are shuffled."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    found = may_hold(rows, digest_filter(digests)).groupBy("digest").agg(F.first("text").alias("text"))
    return written(found, "texts")


def shared_counts(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many shingles each two of the sets share: the product of the matrix of
    sets and shingles with its transpose, some columns at a time.  Shingles of one
    set alone are left out."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(sets, kind="stable")
    first = np.concatenate([[True], sets[order][1:] != sets[order][:-1]]) if len(sets) else np.zeros(0, bool)
    often = np.repeat(np.diff(np.append(np.flatnonzero(first), len(sets))) > 1, np.diff(np.append(np.flatnonzero(first), len(sets))))
    order, first = order[often], first[often]
    column, row = np.cumsum(first) - 1, row[order]
    out = np.zeros((len(at) - 1, len(at) - 1), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        held, where = np.unique(row[a:b], return_inverse=True)
        part = np.zeros((len(held), COLUMNS), np.float32)
        part[where, column[a:b] - k] = 1
        out[np.ix_(held, held)] += part @ part.T
    return out


def group_links(found: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """Pairs (a, b) that have the links of all groups of ``found`` (group, node),
    compared on full sets: ids of the rows (roots, where the classes have them)
    and the least one that links within the group reach.  A text moves once for
    each group, not once for each pair."""
    name = F.col("root") if "root" in classes.columns else F.col("node")
    rows = written(found.join(classes.select("node", name.alias("name"), "digest"), "node").select("group", "name", "digest"), "groups")
    percent = round(100 * similarity)

    def run(table: pa.Table) -> pa.Table:
        names = table.column("name").to_numpy()
        sets, at = shingle_sets(table.column("text").combine_chunks(), words)
        n, shared = np.diff(at), shared_counts(sets, at)
        linked = 100 * shared.astype(np.int64) >= percent * (n[:, None] + n - shared.astype(np.int64))
        linked |= names[:, None] == names
        least = _joined(linked, np.arange(len(n)), len(n))
        pairs = np.unique(np.stack([names, names[least]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    texts = _texts_of(rows.select("digest"), docs, text_col)
    return rows.join(texts, "digest").select("group", "name", "text").groupBy("group").applyInArrow(run, "a long, b long")


def _each_salt() -> Column:
    return F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)]))


def crossing_links(found: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """Pairs of roots (a, b) between which there is a link, for each (a, b) of
    ``found``: a root and a node outside it.

    Each such node is compared with all rows of the root's component on full
    sets.  Both sides are dealt out in blocks of ``SIDE`` rows, each pair of
    blocks to one group, so texts move once for each block that they meet, not
    once for each pair.
    """
    tops = classes.select("node", "root", "digest")
    counts = found.groupBy("group").count().join(classes.groupBy(F.col("root").alias("group")).agg(F.first("size").alias("members")), "group")
    counts = written(counts.select("group", F.ceil(F.col("count") / SIDE).alias("xs"), F.ceil(F.col("members") / SIDE).alias("ys")), "blocks")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = found.join(counts, "group").join(tops, "node").select("group", block("xs").alias("x"), every("ys").alias("y"), "root", "digest")
    salted = tops.withColumns({"group": F.col("root"), "salt": F.pmod(F.xxhash64("node"), F.lit(SALTS))})
    inside = counts.withColumn("salt", _each_salt()).join(salted, ["group", "salt"]).select("group", every("xs").alias("x"), block("ys").alias("y"), "root", "digest")
    both = written(outside.union(inside), "sides")
    texts = _texts_of(both.select("digest"), docs, text_col)
    percent = round(100 * similarity)

    def run(table: pa.Table) -> pa.Table:
        group, root = table.column("group").to_numpy(), table.column("root").to_numpy()
        sets, at = shingle_sets(table.column("text").combine_chunks(), words)
        n = np.diff(at)
        own = np.flatnonzero(root == group)
        links = set()
        if len(own):
            inner = np.concatenate([sets[at[k] : at[k + 1]] for k in own.tolist()])
            starts = np.cumsum(n[own]) - n[own]
            for k in np.flatnonzero(root != group).tolist():
                one = sets[at[k] : at[k + 1]]
                if int(root[k]) in links or not (100 * np.minimum(n[own], len(one)) >= percent * np.maximum(n[own], len(one))).any():
                    continue
                place = np.minimum(np.searchsorted(one, inner), len(one) - 1)
                shared = np.add.reduceat((one[place] == inner).astype(np.int64), starts)
                if (100 * shared >= percent * (n[own] + len(one) - shared)).any():
                    links.add(int(root[k]))
        return pa.table({"a": pa.array([int(group[0])] * len(links), pa.int64()), "b": pa.array(sorted(links), pa.int64())})

    return both.join(texts, "digest").select("group", "x", "y", "root", "text").groupBy("group", "x", "y").applyInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, digest``
    (MD5 of the text).

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word
    shingles (A-Z in lower case; a text with fewer words is one shingle) is at
    least ``similarity``; ``component_id`` is the smallest identifier that links
    reach, ``kept`` says whether it is the row's own.

    Equal sets form one class and are linked without any search.  Classes branch
    along ``TREES`` trees: a tree takes the ``DEPTH`` minwise tokens of its own
    one by one, until a node is small; its rows whose sketches are alike make up
    groups, and all rows of a group are compared on full sets.  A pair of
    similarity s is found in a tree with probability s**depth of its leaf or
    more: at 0.8 and depth 3 all trees miss it once in 5000 times.

    The first round takes ``FIRST_TREES`` trees, stops at nodes of ``SMALL_NODE``
    rows and looks through nodes that are larger after ``DEPTH`` tokens in windows;
    it joins most of each component.  The second one goes through all trees with the
    components so far: a node now is small if the rows outside its largest component are
    few, and all rows that are likely similar to a row of another component are
    compared, in groups or, where that component is large, with all its rows.

    Null or empty text, or one of white space: no shingles, linked with nothing,
    its own component.  Rows of a repeated identifier count each; identical rows
    share a class and are kept together.  Null ids never name a component unless
    all its rows have none.  An empty table gives an empty result; other columns
    are not read.
    """
    rows = written(signed(docs, words, id_col, text_col), "signatures")
    classes = rows.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("digest").alias("digest"), F.min("n").alias("n"), F.min("signature").alias("signature"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = group_links(candidates(classes, similarity), classes, docs, words, similarity, text_col)
    linked = components(links).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    sizes = linked.groupBy("root").agg(F.count(F.lit(1)).alias("size")).withColumn("salt", _each_salt())
    linked = linked.join(sizes, ["root", "salt"]).drop("salt")
    classes = classes.join(linked, "node", "left").withColumns({"root": F.coalesce("root", "node"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    classes = written(classes, "roots")
    found = candidates(classes, similarity)
    small = group_links(found.filter("not whole"), classes, docs, words, similarity, text_col)
    large = crossing_links(found.filter("whole").select("group", "node"), classes, docs, words, similarity, text_col)
    merged = components(small.union(large))
    small = classes.select("set_key", "least", F.col("root").alias("node")).join(merged, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Names of components of more than one class, salted: one of them may hold very many.
    names = small.groupBy("root").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("salt", _each_salt())
    result = small.withColumn("salt", F.pmod(F.xxhash64("set_key"), F.lit(SALTS))).join(names, ["root", "salt"], "left")
    result = written(result.select("set_key", F.coalesce("name", "least").alias("component_id")), "components")
    out = rows.select("doc_id", "digest", "n", "set_key").join(result, "set_key", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that near-duplicate a row of a smaller
    identifier's component; all columns stay, whatever their names.  Rows with a
    null or empty text stay; a repeated row stays or goes with its like; an empty
    table stays empty."""
    doc_id, digest, own, held = fresh(docs, "id", "digest", "own", "held")
    gone = near_groups(docs, id_col=id_col, text_col=text_col).filter("not kept").select(named("doc_id").alias(doc_id), named("digest").alias(digest)).distinct()
    gone = written(gone, "near-copies")
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(own, F.unhex(F.md5(text.cast("binary"))))
    rows = probed(rows, digest_filter(gone.select(named(digest).alias("digest"))), held, own)  # only what may go is shuffled
    same = named(doc_id).eqNullSafe(named(id_col).cast("long")) & (named(digest) == named(own))
    columns = [named(c) for c in docs.columns]
    return rows.filter(~named(held)).select(*columns).unionByName(rows.filter(named(held)).join(gone, same, "left_anti").select(*columns))
