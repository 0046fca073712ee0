from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from plumbline.llm import stages, tokenizer
from plumbline.llm.simhash import DISTANCE, fingerprint


def near(a, b):
    return bin(fingerprint(a) ^ fingerprint(b)).count("1") <= DISTANCE


def groups(texts):
    """Classes of texts that hang together."""
    left, found = list(dict.fromkeys(texts)), []
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            one = todo.pop()
            group.append(one)
            todo += [t for t in left if near(one, t)]
            left = [t for t in left if not near(one, t)]
        found.append(group)
    return found


def test_unlike_texts_of_one_id_stay(spark, table, prose):
    a, b, x, y, alone = (prose(n, 80) for n in (1, 2, 3, 4, 5))
    rows = [(3, a), (5, a), (5, b), (9, b), (7, x), (7, y), (None, alone), (None, alone), (None, a), (11, y), (None, None), (12, "")]
    docs = table([t for _, t in rows], [i for i, _ in rows])
    kept = Counter((r.doc_id, r.text) for r in stages.near_duplicates(spark, docs, "").collect())
    want = Counter()
    for group in groups([t or "" for _, t in rows]):
        members = [(i, t) for i, t in rows if (t or "") in group]
        want[min(members, key=lambda r: (r[0] is None, r[0] or 0))] += 1
    assert kept == want


def test_benchmark_copies_without_an_id_go(spark, table, prose, tmp_path):
    item = prose(50, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table([f"{prose(1)} {item} {prose(2)}", prose(3), item, prose(4), None], [None, None, 4, 4, 5])
    kept = stages.without_benchmark(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, prose(3)), (4, prose(4)), (5, None)])


def test_pipeline_of_a_small_corpus(spark, prose, tmp_path):
    """Copies go, the benchmark's copies go, what is no language goes; the rest comes out as the library encodes it."""
    item = prose(900, 40)
    texts = [prose(n, 120) for n in range(40)]
    rows = [(n, t, "en", f"s{n % 2}", len(t)) for n, t in enumerate(texts)]
    rows += [(100 + n, t, "en", "s0", len(t)) for n, t in enumerate(texts[:7])]  # exact copies with larger ids
    rows += [(3, texts[30], "en", "s1", 1), (200, f"{prose(901)} {item}", "en", "s0", 1), (None, f"{item} {prose(902)}", "en", "s0", 1), (201, "123 456", "en", "s0", 7), (202, None, "en", "s0", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    library = tokenizer.load(tokenizer.vocabulary_path())
    held = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None and doc_id < 100 and text in texts and (doc_id, text) == (texts.index(text) if text != texts[30] else min(3, 30), text):
            ids = [*library.encode(text, add_special_tokens=False).ids, 2]
            held[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] = text
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == set(held)
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == list(np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1])
