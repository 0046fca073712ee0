"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from compare import compare, connect
from plumbline.suite import ORACLES, QUERIES

ROOT = os.environ.get("PLUMBLINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert compare(spark, db, name, QUERIES[name], ORACLES.get(name), ROOT) is None


def test_names_are_plain():
    assert all("pipeline" not in name for name in QUERIES)
    assert set(ORACLES) <= set(QUERIES)
