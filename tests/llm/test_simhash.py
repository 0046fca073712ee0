from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm.simhash import BUCKET, LEVELS, _masks, document_fingerprints, fingerprint_links, simhash_components
from plumbline.llm.components import connected_components
from plumbline.llm.stages import near_duplicates


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    root = {i: i for i in range(len(values))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_against_brute_force(table, prose):
    pick = random.Random(5)
    texts = []
    for i in range(60):
        words = prose(i, 80).split()
        texts.append(" ".join(words))
        for _ in range(3):
            words[pick.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
    texts += ["", "x", "x y", "X Y", "x y z", None]
    got = {r.doc_id: r for r in simhash_components(table(texts)).collect()}
    values = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{v:016x}" for v in values]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(values)


@pytest.mark.parametrize("bucket", [4096, 8, 1])
def test_crowded_buckets_lose_no_link(spark, bucket):
    """A chain of fingerprints two bits apart in one corner, more than a bucket may hold; at 1 all go to the last level."""
    pick = random.Random(3)
    base = pick.getrandbits(64)
    values = sorted({base ^ pick.getrandbits(5) ^ (pick.getrandbits(3) << 40) for _ in range(60)} | {pick.getrandbits(64) for _ in range(40)})
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    root = {r.node: r.root for r in connected_components(fingerprint_links(frame, bucket)).collect()}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    want = brute_components(values)
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups([root.get(s, s) for s in signed]) == groups(want)


def test_open_bits_of_the_levels():
    """Keys of every level agree for three differing bits, and the last leaves open no more than a bucket."""
    pick = random.Random(9)
    for level in LEVELS:
        masks = [m % (1 << 64) for m in _masks(*level)]
        for _ in range(200):
            differing = sum(1 << b for b in pick.sample(range(64), 3))
            assert any(m & differing == 0 for m in masks)
    assert {1 << (64 - m.bit_count()) for m in masks} == {BUCKET}


def test_odd_rows(table, odd_rows):
    docs = table(*odd_rows).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    rows = simhash_components(docs).collect()
    assert len(rows) == docs.count()
    zero = {r.doc_id: r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {0: 0, 1: 0, 2: 0}
    assert simhash_components(docs.limit(0)).collect() == []
    assert document_fingerprints(docs.limit(0)).collect() == []


def test_stage_keeps_one_of_each(spark, table, prose):
    docs = table([prose(1), prose(2), prose(1), prose(3), prose(3), "a b c"], [5, 6, 7, 8, 8, None])
    kept = near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 5, 6, 8]


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in connected_components(links).collect()} == {0}
    assert connected_components(links.limit(0)).collect() == []
