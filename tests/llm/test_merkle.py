from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from plumbline.llm.merkle import fold, merkle_manifest, proof_digest
from plumbline.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests: list[str]) -> tuple[str, list[list[str]], list[list[list[str]]]]:
    """The last node, and per level the nodes."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 16])) for i in range(0, len(below), 16)])
    return levels[-1][0], levels


def way(levels, place):
    steps = []
    for level in levels[:-1]:
        start = place - place % 16
        steps.append((place % 16, level[start:place] + level[place + 1:start + 16]))
        place //= 16
    return steps


def brute(rows, changed):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), leaf_of((*row[:4], changed(row)))))
    trees = {s: climb([r[2] for r in sorted(group)]) for s, group in groups.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, top = climb([trees[s][0] for s in order])
    out = []
    for s, group in groups.items():
        for place, (known, doc_id, leaf, shown) in enumerate(sorted(group)):
            steps = way(trees[s][1], place) + way(top, order.index(s))
            held = shown
            for slot, others in steps:
                held = sha("".join(others[:slot]) + held + "".join(others[slot:]))
            out.append((doc_id if known else None, leaf, trees[s][0], root, sha("".join(x for _, o in steps for x in o)), held, held == root))
    return sorted(out, key=repr)


def found(docs):
    shown = F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    rows = merkle_manifest(docs, FIELDS, presented={"text": shown})
    folded = fold(F.col("presented"), F.col("proof"))
    return sorted((tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), folded, folded == F.col("root")).collect()), key=repr)


def changed(row):
    return row[4].upper() if row[4] is not None and row[0] is not None and row[0] % 3 == 0 else row[4]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as key", "2 as place", "'x' as digest", "3 as n")


def test_groups_of_all_sizes(spark):
    rows = [(i, "big", "en", i, f"text {i}") for i in range(4500)]
    for name, n in (("one", 1), ("two", 2), ("full", 16), ("more", 17), ("levels", 257), ("", 3), ("é", 256), ("z", 33)):
        rows += [(i * 7, name, None, None, f"{name} {i}") for i in range(n)]
    rows += [(i, None, "de", 1, "") for i in range(20)]
    got = found(frame(spark, rows))
    assert got == brute(rows, changed)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_many_groups(spark):
    rows = [(i, f"s{i % 300}", "en", i, "t") for i in range(900)]
    assert found(frame(spark, rows)) == brute(rows, changed)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "a", "", 0, ""), (3, "a", "", 0, None), (3, "a", "", 0, ""),
            (5, "a", "en", -1, "x" * 500_000), (6, "-", "en", 1, "=")]
    assert found(frame(spark, rows)) == brute(rows, changed)


def test_a_single_row_and_none(spark):
    rows = [(3, "a", "en", 1, "b")]
    got = found(frame(spark, rows))
    assert got == brute(rows, changed) and got[0][4] == sha("")
    assert found(frame(spark, rows).limit(0)) == []


def test_presented_is_the_leaf_unless_given(spark):
    row = merkle_manifest(frame(spark, [(1, "a", "en", 1, "b"), (2, "a", "en", 1, "b")]), FIELDS).first()
    assert row.leaf == row.presented


@pytest.mark.parametrize("name", ["op13_merkle"])
def test_query(spark, name):
    assert compare(spark, connect(ROOT), name, QUERIES[name], ORACLES[name], ROOT) is None
