from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.llm import tokenizer
from plumbline.llm.token_counts import token_counts

TRICKY = ["It's   we'll go\tnow\n\n42nd", "a\x1cb\x85c d́e", "e ́x", " line 　wide﻿", "<|startoftext|>x<|endoftext|> <|ENDOFTEXT|>",
          "ΟΔΟΣ İstanbul ﬁne ǅ", "한국어 日本語 \U0001f600\U0001f600", "x" * 500, "\r\n a\x0bb\x0cc"]


def test_counts_match_the_library(table, odd_rows):
    rows, ids = odd_rows
    texts = rows + TRICKY
    docs = table(texts, ids + [100 + i for i in range(len(TRICKY))]).withColumn("piece", F.lit(0))
    encode = tokenizer.load(tokenizer.vocabulary_path()).encode
    key = lambda r: (r[0] is None, r)
    want = sorted(((i, len((t or "").encode()), n := len(encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for i, t in zip(ids + [100 + i for i in range(len(TRICKY))], texts)), key=key)
    assert sorted((tuple(r) for r in token_counts(docs).collect()), key=key) == want
    assert token_counts(docs.limit(0)).collect() == []


def test_ids_of_pieces_are_the_ids_of_the_text(odd_rows):
    texts = [t or "" for t in odd_rows[0]] + TRICKY
    path = tokenizer.vocabulary_path()
    ids, counts = tokenizer.Ids(path).rows(texts, 2)
    encode = tokenizer.load(path).encode
    want = [encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == sum(want, [])


def test_words_and_signs_of_latin_letters_give_the_ids_of_the_library():
    path = tokenizer.vocabulary_path()
    ids, plain = tokenizer.Ids(path), tokenizer.load(path)
    rng = random.Random(11)
    signs = "azéßÿñQÀ×÷ªµ²½09 \n\t .,!'<|>*-&s t's're\x01"
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["it's don't. we'll, 's 'S x'. y!!'s z' (a) b</w> ć. d­ e", "<|endoftext|>. <|ENDOFTEXT|>!", "a" * 500 + ". " + "é" * 90]
    assert ids.direct
    got, counts = ids.rows(texts, 2)
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert got.tolist() == [i for w in want for i in w]
