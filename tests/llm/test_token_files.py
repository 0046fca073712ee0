from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import range_coder, token_files, tokenizer
from plumbline.llm.range_coder import BLOCK, Damaged, decode, encode


def ids_of(kind: str, n: int) -> np.ndarray:
    pick = np.random.default_rng(n)
    if kind == "same":
        return np.full(n, 7, np.uint32)
    if kind == "wide":
        return pick.integers(0, 1 << 20, n).astype(np.uint32)
    return (pick.zipf(1.4, n) % 5000).astype(np.uint32)


@pytest.mark.parametrize("kind", ["same", "wide", "text"])
@pytest.mark.parametrize("n", [0, 1, 2, 100, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 17])
def test_round_trip(kind, n):
    ids = ids_of(kind, n)
    assert (decode(encode(ids)) == ids).all()


def test_size_follows_order_0_and_repeats():
    ids = ids_of("text", 40 * BLOCK)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert 8 * len(encode(ids)) / len(ids) < 1.08 * -(p * np.log2(p)).sum() + 0.3
    assert len(encode(np.tile(ids_of("wide", 200), 100))) < 15000


def test_damage_is_seen():
    data = bytearray(encode(ids_of("text", 9000)))
    for at in (0, 5, 20, 40, len(data) // 2, len(data) - 9):
        bad = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1:])
        with pytest.raises(Damaged):
            decode(bad)
    with pytest.raises(Damaged):
        decode(bytes(data[:-2]))



def test_table(spark, table, odd_rows):
    rows, ids = odd_rows
    docs = table(rows, ids).withColumn("part", F.lit("clash")).withColumn("data", F.lit(0))
    encode_text = tokenizer.load(tokenizer.vocabulary_path()).encode
    order = sorted(zip(ids, rows), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want, start = [], 0
    for key, text in order:
        found = np.array(encode_text(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((key, start, len(found), zlib.crc32(found.tobytes())))
        start += len(found)
    got = [tuple(r) for r in token_files.token_files(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.token_files(docs.limit(0)).collect() == []


def test_ids_read_back(spark, table, prose, tmp_path):
    folder = str(tmp_path / "ids")
    token_files.write_token_files(table([prose(i) for i in range(5)]), folder, tokenizer.vocabulary_path(), 2)
    encode_text = tokenizer.load(tokenizer.vocabulary_path()).encode
    got = {r.doc_id: r.ids for r in token_files.read_token_ids(spark, folder).collect()}
    assert got == {i: encode_text(prose(i), add_special_tokens=False).ids + [2] for i in range(5)}
