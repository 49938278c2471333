"""Token counts and SentencePiece ids against the libraries, on whole tables and odd texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from sparkwright.llm import bpe, pieces, queries

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "  a  b ", "A  B\tC\x0bD", "don't WE'LL they'RE 's''s !'s x'S", "<|endoftext|>a<|startoftext|>", "<|endoftext|", "ÀÉÎ İstanbul ΣΑΣ ςσ ß ẞ ſ", "é ﬁ ½ ²³ ٣ 一二三 🙂👩‍👩‍👧 ​",
    "x" * 5000, "ab " * 3000, "_a_b__c 12 3.4", "\x00\x01\x1c\x85 ", "▁▁ ▁a▁", " nbsp　", "¡Ñandú!—“q”…", "...!!!???", "<s></s><unk>", "K ſ ŉ ŀ", "﻿bom", "𐐀𐐁", "naïve İİ",
]


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_counts_match_the_library(corpus):
    counter, library = bpe.MergeCounter(WORDS), bpe.Splitter(WORDS).library
    for text in [*ODD, *corpus]:
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.of_text(text) == expected, text[:50]
        assert counter.of_text(text) == expected  # now from the memo


def test_word_ids_match_the_library(corpus):
    maker, library = bpe.WordIds(WORDS), bpe.Splitter(WORDS).library
    whole = [*ODD, *corpus]
    for text, ids in zip(whole, maker.of_texts(whole)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_pieces_match_the_library(corpus):
    maker = pieces.Segmenter(PIECES)
    whole = [*ODD, *corpus]
    chunks = sorted({c for t in whole[::2] for c in pieces.chunks_of(t)})
    table = dict(zip(chunks, maker.segmented(chunks)))
    for known in ({}, table):
        for text, ids in zip(whole, maker.of_texts(whole, known)):
            assert np.frombuffer(ids, "<u4").tolist() == maker.library.encode(text), text[:50]


def fuzzed(n):
    """Every character that the quick splitter takes before a comma or stop, then
    random texts of such characters, signs, and some that it leaves alone."""
    plain = [chr(c) for c in range(0x2100) if not bpe._PLAIN.search(chr(c))]
    out = [f"{a}{c}{b}" for c in plain for a in ("a", "2 ", "") for b in (", b", ". b", ".\nb", ".,. b", "'s. x", ", .")]
    rng = random.Random(5)
    other = plain + list("<|>▁ſİßﬁ½² ​　🙂一ΣςΆ") + ["<|endoftext|>"]
    signs = [",", ". ", ", ", ".\n", " ", "\n", "'s", "'", "a", "B", "7", "_"]
    while len(out) < n:
        pool = rng.choice((plain, plain, other))
        out.append("".join(rng.choice(signs) if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randint(1, 16))))
    return out


def test_100_000_fuzzed_texts_match_the_libraries():
    whole = fuzzed(100_000)
    maker, counter, pieced = bpe.WordIds(WORDS), bpe.MergeCounter(WORDS), pieces.Segmenter(PIECES)
    want = [e.ids for e in maker.splitter.library.encode_batch_fast(whole, add_special_tokens=False)]
    assert [t for t, x, ids in zip(whole, maker.of_texts(whole), want) if np.frombuffer(x, "<u2").tolist() != ids] == []
    assert [t for t, ids in zip(whole, want) if counter.of_text(t) != len(ids)] == []
    assert [t for t, x, ids in zip(whole, pieced.of_texts(whole, {}), pieced.library.encode(whole)) if np.frombuffer(x, "<u4").tolist() != ids] == []


def test_queries_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words, piece = bpe.Splitter(WORDS).library, pieces.Segmenter(PIECES).library
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, sf).collect()}
    for k, t in texts.items():
        n = len(words.encode(t, add_special_tokens=False).ids)
        assert counts[k] == (len(t.encode()), n, n > 2048)
    digests = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_sentencepiece(spark, sf).collect()}
    for k, t in texts.items():
        ids = [piece.bos_id(), *piece.encode(t), piece.eos_id()]
        assert digests[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(piece.decode(ids).encode()).hexdigest())
    assert counts.keys() == digests.keys() == texts.keys()


@pytest.mark.parametrize("blocks", [1, 4])
def test_chunk_table_holds_each_distinct_chunk_once(spark, monkeypatch, blocks):
    """At any number of blocks, one included; those of most blocks first where there
    is no room for all."""
    docs = spark.createDataFrame([(k, f"shared words own{k} own{k}") for k in range(8)], "doc_id long, text string").repartition(blocks)
    rows = pieces.chunk_table(docs, PIECES).collect()
    table = {r.chunk: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows}
    library = pieces.Segmenter(PIECES).library
    assert len(rows) == 10 and table == {f" {w}": library.encode(w) for w in ("shared", "words", *(f"own{k}" for k in range(8)))}
    if blocks > 1:
        monkeypatch.setattr(pieces, "TABLE_CHUNKS", 2)
        assert {r.chunk for r in pieces.chunk_table(docs, PIECES).collect()} == {" shared", " words"}
        assert pieces.encoded(docs, PIECES).filter("decoded like 'shared words own%'").count() == 8


def test_chunk_table_of_hundreds_of_blocks(spark, monkeypatch):
    """Each number of blocks up to 600 is that of some chunk, as in large tables."""
    n = 600
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k + 1))) for k in range(n)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(pieces, "BLOCK_CHUNKS", 1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)  # each row is a block of its own: w0 is in all, w599 in one
    try:
        assert sorted(r.chunk for r in pieces.chunk_table(docs, PIECES).collect()) == sorted(f" w{j}" for j in range(n))
        monkeypatch.setattr(pieces, "TABLE_CHUNKS", 450)
        assert sorted(r.chunk for r in pieces.chunk_table(docs, PIECES).collect()) == sorted(f" w{j}" for j in range(450))
    finally:
        spark.conf.set(name, before)


def test_operators_on_nulls_and_repeats(spark):
    from sparkwright.llm.token_counts import token_counts

    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "Hello there", "z"), (3, "x " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORDS).collect())
    assert out == [(0, 11, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 6000, 3000, True)]
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256 == hashlib.sha256(b"").hexdigest()) for r in pieces.encoded_digests(docs, PIECES).collect())
    assert [x[0] for x in got] == [0, 1, 2, 2, 3] and got[1][1:] == (2, True) and got[2][1:] == (2, True)
    for operator in (lambda d: token_counts(d, WORDS), lambda d: pieces.encoded_digests(d, PIECES)):
        assert operator(docs.limit(0)).count() == 0
