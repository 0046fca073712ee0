from __future__ import annotations

import functools
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe, tokenizer
from plumbline.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tokenizer.load(tokenizer.vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(tokenizer.vocabulary_path())


@functools.cache
def wholes(vocabulary: bpe.Vocabulary) -> dict:
    return {(vocabulary.left[w][1][0], edge[1][0]): w for w, edge in vocabulary.right.items() if len(edge) > 1}


def by_merges(symbols: str, vocabulary: bpe.Vocabulary) -> list[int]:
    """The merges one after the other, as the model defines them."""
    ids, made = [vocabulary.ids[s] for s in symbols], wholes(vocabulary)
    while True:
        best = min(((vocabulary.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in vocabulary.merges), default=None)
        if best is None:
            return ids
        i = best[1]
        ids[i:i + 2] = [made[(ids[i], ids[i + 1])]]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aehinstro", min_size=1, max_size=40))
def test_words_follow_the_merges(encoder, word):
    symbols = encoder.vocabulary.ending(word)
    assert encoder.vocabulary.word(symbols) == by_merges(symbols, encoder.vocabulary)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aeinst 's0!?.é\n\t\u0301\x1c\xa0"))), max_size=60),
       st.sampled_from(["", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]), st.integers(0, 60))
def test_texts_equal_the_library(encoder, library, text, special, at):
    text = text[:at] + special + text[at:]
    ids, counts = encoder.rows([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_every_token_that_its_text_gives_is_found(encoder, library):
    assert len(encoder.vocabulary.whole) <= len(encoder.vocabulary.ids)
    for symbols, token in list(encoder.vocabulary.whole.items())[::97]:
        assert encoder.vocabulary.word(symbols) == [token] == by_merges(symbols, encoder.vocabulary)


def test_long_words_and_small_caches(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 7)
    word = "thequickbrownfoxaaaa" * 5000
    assert encoder.piece(word) == library.encode(word, add_special_tokens=False).ids
    fresh = bpe.Encoder(tokenizer.vocabulary_path())
    for text in ("some words here", "other words there", "some words again"):
        fresh.renew(3)
        assert fresh.rows([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def expected(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return doc_id, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, table, odd_rows, library):
    rows, ids = odd_rows
    docs = table(rows, ids).selectExpr("*", "1 as ids", "'x' as key")
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    key = lambda r: (r[0] is None, r)
    got = [(r.doc_id, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in decoded]
    assert sorted(got, key=key) == sorted((expected(library, i, t) for i, t in zip(ids, rows)), key=key)
    assert bpe.bpe_decode(bpe.bpe_encode(docs.limit(0))).count() == 0
    assert bpe.bpe_decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first().text == ""


def test_runs_of_rows(spark, table, prose, library, monkeypatch):
    texts = [prose(n, n) for n in range(40)]
    assert list(bpe._slices([bpe.CHUNK, 1, bpe.CHUNK, 1])) == [(0, 1), (1, 3), (3, 4)]
    got = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(table(texts))).collect()}
    assert got == {i: library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts)}


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_bpe"](spark, ROOT)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(library, *r) for r in docs)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(tokenizer.vocabulary_path("byte_bpe_50k.json"))
