"""The pipeline, stage by stage, against brute force; odd rows and empty tables."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from sparkwright.llm import queries
from test_operators import LOWER, base_spans, brute_components, shingles

SF = "/root/testdata/sf0.01"


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).cache())
    return out


@pytest.fixture(scope="module")
def steps(spark):
    return stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "secrets", "packing"]
    assert all(s.dtypes == steps[0].dtypes for s in steps[1:5])
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_quality_drops_what_is_rejected(spark, steps):
    assert texts(steps[1]).keys() == {r.doc_id for r in queries.op8_quality(spark, SF).collect() if r.predicted}


def test_lines_equal_brute_force(steps):
    before, after = texts(steps[1]), texts(steps[2])
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for k, t in before.items():
        for x in {key(x) for x in t.split("\n")}:
            holders.setdefault(x, []).append(k)
    gone = lambda k, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and k != max(holders[key(x)])
    assert after == {k: "\n".join(x for x in t.split("\n") if not gone(k, x)) for k, t in before.items()}


def test_near_copies_equal_brute_force(steps):
    before = texts(steps[2])
    root = brute_components({k: shingles(t, 5) for k, t in before.items()})
    assert texts(steps[3]) == {k: t for k, t in before.items() if root[k] == k}


def test_secrets_equal_brute_force(steps):
    before, after = texts(steps[3]), texts(steps[4])

    def redacted(t):
        out, at = [], 0
        merged = []
        for a, _, _, b in base_spans(t):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [t[at:a], "[SECRET]"]
            at = b
        return "".join(out) + t[at:]

    assert after == {k: redacted(t) for k, t in before.items()}


def test_packing_holds_every_token_once(steps):
    library = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts(steps[4]).items()}
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in pieces.items()} == want


ODD = [(1, None), (2, ""), (3, " \n "), (None, "one"), (4, "one"), (4, "one"), (5, "long word " * 3000), (6, None), (6, None)]
NAMES = (
    "score", "digest", "blob", "bits", "bucket", "kept", "row", "n", "component_id", "held", "held_", "drop", "spans", "own", "id", "line", "last", "batch", "left", "todo", "found", "root", "node", "group", "size", "label",
    "__score", "__digest", "__id", "__drop", "__doc_id", "__kept", "__row", "__lines", "__spans", "__held", "__bits", "a.b", "x y", "part", "ids", "curve",
)


def test_odd_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(k, t, None, None, None, *NAMES) for k, t in ODD], schema)
    out = stages(spark, docs, SF)
    assert all(s.dtypes == docs.dtypes for s in out[1:5])
    assert out[2].count() == out[1].count() and out[4].count() == out[3].count() and out[3].count() <= out[2].count()
    assert all(r.score == "score" and r.blob == "blob" for r in out[4].collect())
    assert out[5].select("doc_id").distinct().count() == out[4].select("doc_id").distinct().count()
    for name, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, docs, SF).count() > 0, name


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [s.count() for s in stages(spark, docs, SF)] == [0] * 6
