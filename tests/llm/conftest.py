from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and river stone cloud amber lantern copper meadow violet harbor winter signal garden thunder marble echo".split()
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def prose():
    def make(seed: int, words: int = 60) -> str:
        pick = random.Random(seed)
        return " ".join(pick.choice(WORDS) + (pick.choice("abcdefgh") * pick.randint(0, 2)) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """Documents from texts or (text, lang, source) rows; ids count up unless given."""
    def make(rows, ids=None):
        full = [(r, "en", "a") if not isinstance(r, tuple) else r for r in rows]
        ids = ids if ids is not None else range(len(full))
        return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, (t, lang, s) in zip(ids, full)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Null and empty texts, no letters, repeated rows, a very long text, other scripts."""
    rows = [None, "", " \n\t ", "1 2 3 ###", prose(1), prose(1), prose(2, 30000), "Ünïcode ÇA là", " x y", "a\x1cb ć <|endoftext|>"]
    return rows, [0, 1, 2, 3, 4, 4, 5, None, 7, 8]
