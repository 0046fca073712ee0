from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate
from plumbline.llm.decontaminate import GAP, MATCH, MISMATCH, align, contaminated, gram_hashes, word_hashes
from plumbline.llm.stages import without_benchmark
from plumbline.operators import joins


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return int(h.max())


def test_align_against_the_textbook():
    pick = random.Random(2)
    for _ in range(40):
        a, b = (np.array([pick.randint(1, 4) for _ in range(pick.randint(0, 15))], np.uint64) for _ in range(2))
        assert align(a, b)[0] == brute_align(a, b)


@pytest.fixture(scope="module")
def bench(spark, prose):
    items = [(i, prose(1000 + i, 20 + i)) for i in range(12)]
    return spark.createDataFrame(items, "item_id long, text string"), dict(items)


def edited(text: str, every: int) -> str:
    words = text.split()
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(words))


def test_copies_and_edits_are_found(table, prose, bench):
    frame, items = bench
    texts, want = [], set()
    for i, item in items.items():
        for kind in (item, item.upper().replace(" ", ",\n"), edited(item, 7), " ".join(item.split()[:4] + ["more", "words"] + item.split()[4:])):
            want.add((len(texts), i))
            texts.append(f"{prose(i, 150)} {kind} {prose(50 + i, 90)}")
    texts += [prose(300 + i, 200) for i in range(30)]
    got = contaminated(table(texts), frame).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    exact = [r for r in got if r.doc_id % 4 == 0]
    assert all(r.score == 1.0 and r.end_word - r.first_word == len(items[r.item_id].split()) and r.first_word == 150 for r in exact)


def test_against_brute_force(table, prose, bench):
    """Every document with every item, aligned over the whole text."""
    frame, items = bench
    pick = random.Random(9)
    texts = []
    for i in range(80):
        item = items[pick.randrange(12)].split()
        part = item[:pick.randint(2, len(item))]
        texts.append(" ".join([prose(i, 40), *[w if pick.random() > 0.1 else "zz" for w in part], prose(i + 500, 40)]))
    aligned, seeded = set(), set()
    for d, text in enumerate(texts):
        for i, item in items.items():
            a, b = word_hashes(item), word_hashes(text)
            held = np.isin(gram_hashes(a), gram_hashes(b)).astype(int)
            if brute_align(a, b) >= decontaminate.SHARE * MATCH * len(a):
                aligned.add((d, i))
                if (np.convolve(held, np.ones(decontaminate.WINDOW, int)) == decontaminate.WINDOW).any():
                    seeded.add((d, i))
    got = {(r.doc_id, r.item_id) for r in contaminated(table(texts), frame).collect()}
    assert len(seeded) > 20 and seeded <= got <= aligned


@pytest.mark.parametrize("every", [4, 5])
def test_edited_copies_beside_exact_copies(table, prose, bench, every):
    """The exact copies make every n-gram that an edited copy kept more frequent than those it broke."""
    frame, items = bench
    texts = [f"{prose(i, 40)} {kind} {prose(i + 500, 40)}" for i, item in items.items() for kind in (item, item, edited(item, every))]
    aligned = {(d, i) for d, text in enumerate(texts) for i, item in items.items()
               if brute_align(a := word_hashes(item), word_hashes(text)) >= decontaminate.SHARE * MATCH * len(a)}
    assert len(aligned) >= 3 * len(items)
    assert {(r.doc_id, r.item_id) for r in contaminated(table(texts), frame).collect()} == aligned


def test_items_of_under_three_words(spark, table, prose):
    items = spark.createDataFrame([(0, "Quokka"), (1, "blue quokka"), (2, "-- !"), (3, "")], "item_id long, text string")
    got = contaminated(table([prose(1) + " Blue, quokka. " + prose(2), "quokka", "blue", prose(3)]), items).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]


def test_hot_grams_are_salted(table, prose, bench, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 10)
    monkeypatch.setattr(joins, "HEAVY", 1 << 20)
    frame, items = bench
    got = contaminated(table([f"{prose(i, 20)} {items[i % 2]}" for i in range(60)]), frame).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(i, i % 2, 1.0) for i in range(60)]


def test_odd_rows(spark, table, odd_rows, bench):
    frame, items = bench
    rows, ids = odd_rows
    docs = table([*rows, items[3], items[3]], [*ids, 90, 91]).withColumn("gram", F.lit("clash")).withColumn("item_id", F.lit(0))
    more = frame.union(spark.createDataFrame([(None, "a b c d"), (50, None), (51, ""), (52, "two words"), (3, items[3])], frame.schema))
    got = contaminated(docs, more).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(90, 3), (91, 3)]
    assert contaminated(docs.limit(0), more).collect() == []
    assert contaminated(docs, more.limit(0)).collect() == []


def test_stage_drops_them(spark, table, prose, bench, tmp_path):
    frame, items = bench
    frame.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table([prose(1), prose(2) + " " + items[5], prose(3)], [1, 2, None])
    kept = without_benchmark(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
