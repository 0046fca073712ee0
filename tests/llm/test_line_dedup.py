from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.llm.line_dedup import without_boilerplate


def brute(rows, sites=5):
    seen = defaultdict(set)
    for text, _, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                seen[line.strip(" ")].add(site)
    out = []
    for text, _, _ in rows:
        lines = text.split("\n") if text is not None else []
        left = [x for x in lines if len(seen.get(x.strip(" "), ())) < sites]
        out.append((len(lines), len(lines) - len(left), None if text is None else "\n".join(left)))
    return out


def test_against_brute_force(table):
    pick = random.Random(4)
    lines = [f"line number {i}" for i in range(60)] + ["", "  ", " padded", "padded "]
    rows = []
    for i in range(300):
        mine = [pick.choice(lines[: 4 + i % 60] if i % 3 else lines) for _ in range(pick.randint(1, 8))]
        rows.append(("\n".join(mine), "en", f"site{pick.randint(0, 3 + i // 30)}" if i % 11 else None))
    rows += [("everywhere\nown {i}".replace("{i}", str(i)), "en", f"many{i}") for i in range(200)]
    rows += [("four\nsites", "en", f"s{i % 4}") for i in range(100)] + [("five\nsites", "en", f"s{i % 5}") for i in range(100)]
    got = {r.row.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in without_boilerplate(table(rows)).collect()}
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert sum(w[1] for w in want) > 300


def test_odd_rows(table, odd_rows):
    rows, ids = odd_rows
    docs = table(rows, ids).withColumn("line", F.lit("clash")).withColumn("row_key", F.lit(1))
    got = without_boilerplate(docs).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.row.doc_id, r.kept_text) for r in got), key=key) == sorted(zip(ids, rows), key=key)
    assert without_boilerplate(docs.limit(0)).collect() == []
