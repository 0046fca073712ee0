from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from compare import compare, connect
from plumbline.llm import prefix_trie as trie
from plumbline.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
ROOT = "/root/testdata/sf0.001"


def brute(rows):
    stored = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            stored[conv].append((turn is not None, turn or 0, digest, role, text))
    kept = {c: [t[3:] for t in sorted(ts)] for c, ts in stored.items()}
    rebuilt = {}
    for c, own in kept.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = (kept.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    below = {way: [w for w in members if w[:len(way)] == way] for way in members}
    out = []
    for way, cs in members.items():
        leaf = lambda w: not any(len(x) == len(w) + 1 for x in below[w])
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(way))
        out.append((
            min(cs), len(way), min(members[way[:-1]]) if way else None, len(cs), sum(len(x) == len(way) + 1 for x in below[way]), sum(map(leaf, below[way])),
            sum((len(members[w]) - 1) * len(w[-1][1].encode()) for w in below[way] if w), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


def found(spark, rows, **kwargs):
    frame = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest", "1 as part", "2 as place"), **kwargs)
    return sorted(tuple(r) for r in frame.drop("high", "low", "digest").collect())


def test_random_conversations(spark):
    pick = random.Random(5)
    rows = [(c, t, pick.choice(["user", "bot", None]), pick.choice(["a", "b", "é" * t, None, ""])) for c in range(-12, 60) for t in range(pick.randint(1, 14))]
    rows += [(3, None, "user", "first"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 1, "user", "lost"), (200, 1, None, None), (203, 1, "x", "y")]
    assert found(spark, rows) == brute(rows)


def test_one_long_and_many_equal(spark):
    rows = [(10, t, "u", f"turn {t}") for t in range(700)] + [(15, t, "u", f"turn {t}") for t in range(650)]
    rows += [(c, t, "u", "same") for c in range(20, 320) for t in range(2)]
    long = [(40000, 1, "u", "long " * 200_000), (40001, 1, "u", "long " * 200_000)]
    assert found(spark, rows + long) == brute(rows + long)


def test_fingerprints_are_checked_and_made_anew(spark, monkeypatch):
    """With bases of one a sum forgets the order of its turns; the check tells, and other bases are taken."""
    real, tried = trie.bases, []
    monkeypatch.setattr(trie, "bases", lambda seed: tried.append(seed) or ([1] * trie.LANES if seed == 0 else real(seed)))
    rows = [(0, t, "u", text) for t, text in enumerate("abc")] + [(5, t, "u", text) for t, text in enumerate("bacd")]
    assert found(spark, rows) == brute(rows)
    assert set(tried) == {0, 1}


def test_packs(spark, monkeypatch):
    rows = [(1, 2, 3, i) for i in range(1000)] + [(1, 2, 4, 5)]
    frame = spark.createDataFrame(rows, "depth long, high long, low long, conv_id long")
    got = {r.low: r.sha for r in trie.member_digests(frame.repartition(7)).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest(), 4: hashlib.sha256(b"5").hexdigest()}


def test_empty(spark):
    assert found(spark, []) == [] == brute([])
    assert found(spark, [(None, 1, "a", "b")]) == []


@pytest.mark.parametrize("name", ["op12_prefix_trie"])
def test_query(spark, name):
    assert compare(spark, connect(ROOT), name, QUERIES[name], ORACLES[name], ROOT) is None
