from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm.weighted_sampling import SAMPLES, STRIP, edited_text, likeness, signatures, weighted_fingerprints


def jaccard(a, b):
    ca, cb = (Counter(w for w in (x.strip(STRIP) for x in t.lower().split()) if w) for t in (a, b))
    every = ca.keys() | cb.keys()
    return sum(min(ca[w], cb[w]) for w in every) / max(1, sum(max(ca[w], cb[w]) for w in every))


def test_collisions_estimate_generalised_jaccard(prose):
    pairs = [(f"{prose(i, 30)} {prose(i + 1000, 10 * (i % 12))}", f"{prose(i, 30)} {prose(i + 2000, 5 * (i % 7))}") for i in range(300)]
    marks = signatures([t for p in pairs for t in p])
    errors = likeness(marks[::2], marks[1::2]) - np.array([jaccard(*p) for p in pairs])
    assert abs(errors.mean()) < 0.01 and errors.std() < 1.3 * np.sqrt(0.25 / SAMPLES)


def test_samples_do_not_depend_on_the_batch(prose):
    texts = [prose(i, 40) for i in range(20)] + ["", "..."]
    whole = signatures(texts)
    assert (np.concatenate([signatures([t]) for t in texts]) == whole).all()
    assert (whole[:20] > 0).all() and (whole[20:] == 0).all()


def test_rows(spark, table, prose):
    texts = [prose(i, 10 + i) for i in range(40)] + ["", None, "é" * 9, prose(3, 13)]
    ids = [7 * i % 53 for i in range(len(texts))]
    got = {r.doc_id: r for r in weighted_fingerprints(table(texts, ids)).collect()}
    order = sorted(zip(ids, texts))
    for k, (key, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = edited_text(text, following)
        half = len(text) // 2
        assert edited == text[:len(text) - half] + following[:half]
        own, changed, other = signatures([text, edited, following])
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == own.astype(">u2").tobytes().hex() and r.edited_fingerprint == changed.astype(">u2").tobytes().hex()
        assert r.near_edited == likeness(own[None], changed[None])[0] and r.near_next == likeness(own[None], other[None])[0]
    assert got[ids[3]].fingerprint == got[ids[-1]].fingerprint


def test_odd_rows(table, odd_rows, prose):
    rows, ids = odd_rows
    docs = table(rows, ids).withColumn("part", F.lit("clash")).withColumn("place", F.lit(1))
    got = weighted_fingerprints(docs).collect()
    assert len(got) == docs.count()
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 4 * SAMPLES}
    assert weighted_fingerprints(docs.limit(0)).collect() == []
    (alone,) = weighted_fingerprints(table([prose(1)])).collect()
    assert alone.near_next == 1.0
