from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import kneser_ney, tokenizer
from plumbline.llm.kneser_ney import _discounts, quality
from plumbline.llm.queries import op6_quality


class Brute:
    """The model from its definition, over dictionaries."""

    def __init__(self, sequences, size):
        self.size, self.c = size, Counter(b for s in sequences for b in zip([size, *s], s))
        self.context, self.after, self.before = Counter(), defaultdict(Counter), Counter()
        for (v, w), c in self.c.items():
            self.context[v] += c
            self.after[v][min(c, 3)] += 1
            self.before[w] += 1
        self.d2 = _discounts(Counter(self.c.values()))
        self.d1 = _discounts(Counter(self.before.values()))
        self.n = sum(self.before.values())
        self.g0 = sum(self.d1[min(n, 3) - 1] for n in self.before.values()) / self.n if self.n else 1.0

    def p1(self, w):
        n = self.before[w]
        return ((n - self.d1[min(n, 3) - 1]) / self.n if n else 0.0) + self.g0 / self.size

    def p(self, v, w):
        if not self.context[v]:
            return self.p1(w)
        c, total = self.c[v, w], self.context[v]
        g = sum(self.d2[k - 1] * n for k, n in self.after[v].items()) / total
        return ((c - self.d2[min(c, 3) - 1]) / total if c else 0.0) + g * self.p1(w)


@pytest.fixture(scope="module")
def corpus(prose):
    return [(prose(i, 30 + i % 20), ["en", "de", None][i % 3], "s") for i in range(90)] + [("zq " * 40, "en", "s"), (None, "en", "s"), ("", "fr", "s"), (prose(3), "fr", "s")]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 2 == 0), 0) for i in range(60)] + [(90, 0, 0), (None, 1, 0), (4, 1, 0), (5000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("frequent", [1 << 20, 10])
def test_against_brute_force(table, corpus, labels, monkeypatch, frequent):
    monkeypatch.setattr(kneser_ney, "FREQUENT", frequent)
    path = tokenizer.vocabulary_path()
    encode, size = tokenizer.load(path).encode, kneser_ney.vocabulary_size(path)
    ids = [encode(t or "", add_special_tokens=False).ids for t, _, _ in corpus]
    trusted = [i for i in range(60) if i % 2 == 0]
    brute = Brute([ids[i] for i in trusted], size)
    got = {r.doc_id: r for r in quality(table(corpus), labels, 0.9).collect()}
    want = {i: math.exp(-sum(math.log(brute.p(v, w)) for v, w in zip([size, *s], s)) / len(s)) if s else None for i, s in enumerate(ids)}
    assert len(got) == len(corpus)
    for i, r in got.items():
        assert r.n_tokens == len(ids[i])
        assert r.perplexity == (pytest.approx(want[i], rel=1e-5) if want[i] else None)
    for lang in ("en", "de", None, "fr"):
        mine = sorted(want[i] for i in trusted if lang == "fr" or corpus[i][1] == lang)
        limit = mine[math.ceil(0.9 * len(mine)) - 1]
        for i, r in got.items():
            if corpus[i][1] == lang:
                assert r.threshold == pytest.approx(limit, rel=1e-5) and r.keep == (want[i] is not None and r.perplexity <= r.threshold)
    assert not got[90].keep


@pytest.mark.parametrize("frequent", [1 << 20, 10])
def test_held_out_against_brute_force(table, corpus, labels, monkeypatch, frequent):
    monkeypatch.setattr(kneser_ney, "FREQUENT", frequent)
    path = tokenizer.vocabulary_path()
    encode, size = tokenizer.load(path).encode, kneser_ney.vocabulary_size(path)
    ids = [encode(t or "", add_special_tokens=False).ids for t, _, _ in corpus]
    docs = table(corpus)
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", kneser_ney.fold_of("text", 3)).collect()}
    trusted = [i for i in range(60) if i % 2 == 0]
    brutes = [Brute([ids[i] for i in trusted if fold[i] != k], size) for k in range(4)]
    got = {r.doc_id: r for r in quality(docs, labels, 0.9, folds=3).collect()}
    for i, s in enumerate(ids):
        brute = brutes[fold[i] if i in trusted else 3]
        assert got[i].perplexity == (pytest.approx(math.exp(-sum(math.log(brute.p(v, w)) for v, w in zip([size, *s], s)) / len(s)), rel=1e-5) if s else None)
    mine = sorted(got[i].perplexity for i in trusted if corpus[i][1] == "de")
    assert {r.threshold for r in got.values() if r.lang == "de"} == {mine[math.ceil(0.9 * len(mine)) - 1]}


def test_a_rare_language_keeps_its_good_documents(spark, tmp_path, table, prose):
    """Of 400 alike documents of a rare language 40 are trusted: both kinds pass at like rates in the registered query."""
    pick = random.Random(5)
    words = ["".join(pick.choice(["ra", "mi", "to", "que", "los", "den", "zu", "pa"]) for _ in range(pick.randint(1, 4))) for _ in range(1500)]
    rare = [" ".join(words[min(1499, int(pick.paretovariate(0.6)))] for _ in range(80)) for _ in range(400)]
    rows = [(prose(i, 80), "en", "s") for i in range(300)] + [(t, "es", "s") for t in rare]
    table(rows).write.parquet(f"{tmp_path}/documents.parquet")
    trusted = [(i, int(i < 340), 0) for i in range(700)]
    spark.createDataFrame(trusted, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id: r.keep for r in op6_quality(spark, str(tmp_path)).collect()}
    mine, others = ([kept[i] for i in ids] for ids in (range(300, 340), range(340, 700)))
    assert sum(mine) / len(mine) > 0.9 and sum(others) / len(others) > 0.9


def test_probabilities_sum_to_one():
    pick = np.random.default_rng(1)
    brute = Brute([list(pick.zipf(1.5, 30) % 20) for _ in range(12)], 25)
    for v in range(26):
        assert sum(brute.p(v, w) for w in range(25)) == pytest.approx(1.0)


def test_odd_rows(spark, table, odd_rows, labels):
    docs = table(*odd_rows).withColumn("quality", F.lit("clash")).withColumn("key", F.lit(0))
    got = quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.perplexity is None} == {0, 1, 2}
    assert quality(docs.limit(0), labels).collect() == []
    assert {r.keep for r in quality(docs, labels.limit(0)).collect() if r.n_tokens} == {True}
