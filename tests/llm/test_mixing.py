from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm.mixing import exponent, mix, mixing_plan
from plumbline.llm.stages import mixed


def entropy_and_epochs(totals, a, budget=1.0):
    t = sum(totals.values())
    z = sum((v / t) ** a for v in totals.values())
    w = {s: (v / t) ** a / z for s, v in totals.items()}
    return -sum(x * math.log(x) for x in w.values()), max(w[s] * budget * t / v for s, v in totals.items()), w


def brute_exponent(totals, evenness, epochs):
    def bisect(good_low):
        if good_low(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good_low(mid) else (lo, mid)
        return lo

    target = evenness * math.log(len(totals))
    even = bisect(lambda a: entropy_and_epochs(totals, a)[0] >= target - 1e-12)
    rare = bisect(lambda a: entropy_and_epochs(totals, a)[1] > epochs)
    return max(even, rare if entropy_and_epochs(totals, 0)[1] > epochs else 0.0)


@pytest.mark.parametrize("evenness, epochs", [(0.95, 4.0), (0.999, 2.0), (0.5, 4.0), (1.0, 100.0)])
def test_exponent(spark, evenness, epochs):
    totals = {"a": 9000.0, "b": 800.0, "c": 150.0, None: 50.0}
    frame = spark.createDataFrame(list(totals.items()), "source string, tokens double")
    assert exponent(frame, evenness, epochs) == pytest.approx(brute_exponent(totals, evenness, epochs), abs=1e-5)


def corpus(prose):
    rows = [(prose(i, 40 + i % 30), "en", "big") for i in range(400)]
    rows += [(prose(900 + i, 50), "en", "small") for i in range(40)]
    return rows + [(prose(990 + i, 30), "en", None) for i in range(15)]


def test_mixture_meets_its_budget(table, prose):
    rows = corpus(prose)
    docs = table(rows)
    got = {r.row.doc_id: r for r in mix(docs, 0.9, 4.0).collect()}
    assert len(got) == len(rows)
    totals, taken, longest = Counter(), Counter(), 0
    for i, (text, _, source) in enumerate(rows):
        n = len(text.split())
        assert got[i].tokens == n
        totals[source] += n
        taken[source] += n * got[i].copies
        longest = max(longest, n)
    a = brute_exponent(totals, 0.9, 4.0)
    _, _, weights = entropy_and_epochs(totals, a)
    for source, weight in weights.items():
        assert 0 <= taken[source] - weight * sum(totals.values()) + 1 < longest + 2
        copies = {got[i].copies for i, r in enumerate(rows) if r[2] == source}
        assert max(copies) - min(copies) <= 1 and max(copies) <= 4
    assert sorted(map(str, mix(docs, 0.9, 4.0).collect())) == sorted(map(str, mix(docs, 0.9, 4.0).collect()))
    other = {r.row.doc_id: r.copies for r in mix(docs, 0.9, 4.0, seed=8).collect()}
    assert other != {i: r.copies for i, r in got.items()}


def test_odd_rows(table, odd_rows, prose):
    rows, ids = odd_rows
    docs = table([*rows, ("", "en", "empty"), (None, "en", "empty"), (prose(5), None, None)], [*ids, 70, 71, 72])
    docs = docs.withColumn("tokens", F.lit("clash")).withColumn("block", F.lit("clash"))
    got = mix(docs).collect()
    assert len(got) == docs.count()
    assert {r.row.doc_id: r.copies for r in got if r.row.source == "empty"} == {70: 1, 71: 1}
    assert mix(docs.limit(0)).collect() == []
    plan, alpha = mixing_plan(docs.limit(0))
    assert alpha == 1.0 and plan.collect() == []


def test_stage_repeats_and_leaves_out(spark, table, prose):
    docs = table(corpus(prose))
    out = mixed(spark, docs, "")
    assert out.columns == docs.columns
    counts = Counter(r.doc_id for r in out.collect())
    want = {r.row.doc_id: r.copies for r in mix(docs).collect() if r.copies}
    assert counts == want
