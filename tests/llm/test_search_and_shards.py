"""Sharding, lexical search and hard negatives against brute force and SQL."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sparkwright.llm import lexical, negatives, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_hard_negatives"])
def test_query_equals_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype("int64").values.tolist()))
    assert len(got) and rows(got) == rows(want)


# --- sharding -----------------------------------------------------------------

def shards_hold(rows, texts, shards):
    """What the contract says of a result."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    full = defaultdict(int)
    for r in rows:
        full[r.shard] += r.size
    return [full[s] for s in range(shards)]


def test_sharding_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    full = shards_hold(queries.op11_sharding(spark, SF).collect(), texts, 8)
    assert max(full) <= 1.05 * min(full)


def test_hot_texts_are_spread_and_others_stay_together(spark):
    texts = [(i, "the same text " * 20) for i in range(700)] + [(1000 + i, f"text {i // 3} " * (1 + i % 40)) for i in range(900)] + [(5000, "long " * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.sharded(df, 4).collect()
    full = shards_hold(rows, texts, 4)
    assert max(full) <= 1.05 * min(full)
    of = defaultdict(set)
    for r, t in [(r, dict(texts)[r.doc_id]) for r in rows]:
        of[t].add(r.shard)
    assert len(of.pop("the same text " * 20)) == 4 and sum(len(s) > 1 for s in of.values()) == 0
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.sharded(df.repartition(7), 4).collect()}


def test_sharding_odd_rows(spark, tmp_path):
    texts = [(None, None), (None, "a"), (1, ""), (2, "b")] + [(3, "copy " * 500)] * 5000
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, `size` int, `range` int")
    full = shards_hold(sharding.sharded(df, 8).collect(), texts, 8)
    assert max(full) - min(full) <= 2 * sharding.BLOCK_BYTES
    assert sharding.sharded(df.limit(0), 8).count() == 0
    back = sharding.write_shards(df, str(tmp_path / "shards"), 4)
    assert back.count() == len(texts) and set(back.columns) == {*df.columns, "shard"}


def test_splitters_bisect(spark):
    cut = sharding.Splitters([(sharding.LEAST, sharding.LEAST), (-5, sharding.LEAST), (0, 3), (0, 7), (9, sharding.LEAST)])
    keys = [(a, b) for a in (-9, -5, 0, 1, 9, 12) for b in (-1, 3, 5, 7)]
    got = cut.ranged(spark.createDataFrame(keys, "first long, second long")).collect()
    assert {(r.first, r.second): r.range for r in got} == {k: sum(k >= b for b in cut.bounds) - 1 for k in keys}


# --- lexical search -----------------------------------------------------------

TERM = re.compile(lexical.TERM)
FOLD = str.maketrans(lexical._UPPER, lexical._LOWER)


def brute_search(docs, items, k):
    words = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = set()
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(TERM.findall((text or "").translate(FOLD)))
    for item, ts in terms.items():
        scored = []
        for i, w in words:
            tf, m = Counter(w), 100 - 50 + (50 * len(w) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in ts if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)}
    return out


@pytest.mark.parametrize("sizes", [(8192, 4096), (7, 3)])
def test_search_on_odd_rows(spark, monkeypatch, sizes):
    """Small blocks and steps take other ways through the treaps; copies tie."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", sizes[0])
    monkeypatch.setattr(lexical, "STEP", sizes[1])
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "naïve", "A1", "漢字", "🙂x"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2, w3!") for i in range(100)] + [(2, "again W1"), (None, "w1 w2 w3"), (None, None), (7000, ""), (7001, " \x01-_-"), (7002, "W5 " * 5000)]
    items = [(1, "w1 w2 w3"), (2, None), (3, ""), (4, "nowhere"), (5, "Ünï NAÏVE a1 漢字 🙂X w9"), (6, "w1 w2 w3"), (None, "w4 W5"), (7, "w6"), (7, "w7 w6"), (8, "w1")]
    d, q = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int"), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    want = brute_search(docs, items, 9)
    assert {tuple(r) for r in lexical.search(d, q, 9).select("item_id", "rank", "doc_id", "score").collect()} == want
    index = lexical.indexed(d)
    assert {tuple(r) for r in lexical.search(d, q, 9, index=index).select("item_id", "rank", "doc_id", "score").collect()} == want
    monkeypatch.setattr(lexical, "GROUP_BYTES", 60)
    assert {tuple(r) for r in lexical.search(d, q, 9).select("item_id", "rank", "doc_id", "score").collect()} == want
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_treaps():
    rng = np.random.default_rng(3)
    priority, first = rng.permutation(500), np.array([0, 1, 40, 41, 300])
    left, right, roots = lexical.treaps(priority, first)
    assert list(np.searchsorted(first, roots, "right")) == [1, 2, 3, 4, 5]

    def visit(node, low, high):
        if node < 0:
            return 0
        assert low <= node < high and priority[node] == priority[low:high].max()
        return 1 + visit(left[node], low, node) + visit(right[node], node + 1, high)

    for root, low, high in zip(roots, first, [*first[1:], 500]):
        assert visit(root, low, high) == high - low


def test_walk_prunes():
    """A query with one rare term scores few documents of a block."""
    rng = np.random.default_rng(0)
    n = 4000
    at = np.arange(n, dtype=np.int32)
    block = {"null": np.zeros(n, np.int64), "ids": np.arange(n), "lens": np.full(n, 20), "terms": [b"a"], "starts": np.array([0, n]), "at": at, "tf": rng.integers(1, 9, n).astype(np.int32)}
    q = lexical.Queries({b"a": 0}, np.array([500, 0]), np.array([[0]]), n, 20 * n)
    best = lexical.Best(1, 10)
    assert lexical.walk(block, q, best) < n / 10 and len(best.rows) == 10


# --- hard negatives -----------------------------------------------------------

def brute_negatives(rows):
    """[(id, label, whole numbers)] -> the contract's rows."""
    out, width = set(), max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, np.array([*v, *[0] * (width - len(v))], object)) for i, label, v in rows]
    for a, label, v in rows:
        if a % 50:
            continue
        scores = sorted((-int(v @ w), i, other == label) for i, other, w in rows if i != a)
        for s, p, _ in [x for x in scores if x[2]][:5]:
            found = [x for x in scores if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out |= {(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(found, 1)}
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("sizes", [(4096, 4096), (16, 5)])
def test_negatives_on_odd_rows(spark, monkeypatch, sizes):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", sizes[0])
    monkeypatch.setattr(negatives, "REQUEST_ROWS", sizes[1])
    rng = np.random.default_rng(2)
    good = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=6) / 2]) for i in range(400)]
    good += [(1000 + i, i % 2, [0.5] * 6) for i in range(150)] + [(2000, 1, []), (2050, 0, [3.0]), (2100, 2, [0.0] * 6)]  # a common vector, shorter ones
    odd = [(3000, None, [1.0] * 6), (3050, 1, None), (3100, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3150, 1, [float("nan")] * 6), (3200, 1, [float("inf")] * 6), (None, 1, [9.0] * 6), good[0], good[50]]
    df = spark.createDataFrame([(i, v, label, 0) for i, label, v in good + odd], "vec_id long, embedding array<double>, label int, score int")
    got = negatives.hard_negatives(df)
    want = brute_negatives([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in good])
    assert want and {tuple(r) for r in got.select(*COLUMNS).collect()} == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_index_holds_all_rows_and_answers_are_certified(spark):
    """Clusters far apart: every row is in one block, and answers equal brute force."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 4)) * 40
    rows = [(int(i), int(i) % 2, [float(x) for x in centres[i % 8] + rng.normal(size=4) / 4]) for i in range(1600)]
    numbers = negatives.whole_numbers(spark.createDataFrame(rows, "id long, label long, vector array<double>"), 256)
    space = negatives.space_of(numbers)
    index = negatives.distance_index(numbers, space)
    blocks = index.select("ids", "low", "high").collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(1600)) and all(b.low <= b.high for b in blocks)
    anchors = negatives.anchor_requests(index, space, 50, 5)
    got = {(r.anchor, r["rank"]): (r.id, r.score) for r in negatives.answered(anchors, index, space, 5).collect()}
    x = np.array([[math.floor(256 * v) for v in r[2]] for r in rows])
    for a in range(0, 1600, 50):
        order = sorted((-int(x[a] @ x[i]), i) for i in range(a % 2, 1600, 2) if i != a)[:5]
        assert [got[a, k] for k in range(1, 6)] == [(i, -s) for s, i in order]


def test_products_stay_exact():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 28, 1 << 40, 1 << 62):
        a, b = rng.integers(-most, most, (3, 5)), rng.integers(-most, most, (4, 5))
        want = np.clip(a.astype(object) @ b.astype(object).T, negatives.LEAST + 1, negatives.MOST)
        assert (negatives.products(a, b).astype(object) == want).all()
