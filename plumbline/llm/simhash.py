"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, text_columns, written
from plumbline.llm.components import connected_components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Blocks and how many of them a key leaves out, coarse to fine: three differing bits spoil at most three blocks. The keys leave
#: 32, 24 and 12 bits open.
LEVELS = ((6, 3), (8, 3), (16, 3))
#: A key of the last level leaves three blocks of four bits open, so its bucket holds at most so many different fingerprints.
BUCKET = 1 << 12
STRIPE = 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash over XXH64 hashes of word shingles; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[: 1 - WORDS].tolist(), ends[WORDS - 1:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), STRIPE):
        pairs = zip(starts[at:at + STRIPE], stops[at:at + STRIPE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def document_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp long) per row; null texts count as empty."""
    return map_arrow(text_columns(docs, id_column, text_column), "doc_id long, fp long", _fingerprints)


def _masks(blocks: int, free: int) -> list[int]:
    """For each choice of kept blocks, the mask of their bits, as a signed long."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    spans = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:])]
    masks = (sum(kept) for kept in combinations(spans, blocks - free))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _keys(fps: DataFrame, scheme: tuple[int, int], first: int) -> DataFrame:
    keys = [F.struct(F.lit(first + i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(*scheme))]
    return fps.select("fp", F.inline(F.array(*keys)))


def _stars(run: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, first member) for the parts of a bucket that hang together within the distance."""
    links, left = [], run
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= DISTANCE
            if near.any():
                found = left[near]
                links += [(int(x), int(root)) for x in found.view(np.int64)]
                todo += list(found)
                left = left[~near]
    return [(a, int(np.uint64(b).view(np.int64))) for a, b in links]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (part, key, fp); a bucket is a run, at most BUCKET rows, and only one run is carried along."""
    part, key, fp = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    ended = False
    stream = iter(batches)
    while not ended:
        batch = next(stream, None)
        if batch is None:
            ended, cut = True, len(fp)
        else:
            part, key, fp = (np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False)]) for i, old in enumerate((part, key, fp)))
            change = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
        p, k, v = part[:cut], key[:cut], fp[:cut].view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (k[1:] != k[:-1])]) if cut else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, cut]) if cut else starts
        two = starts[sizes == 2]
        two = two[np.bitwise_count(v[two] ^ v[two + 1]) <= DISTANCE] if len(two) else two
        links = list(zip(v[two + 1].view(np.int64).tolist(), v[two].view(np.int64).tolist())) if len(two) else []
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            links += _stars(v[start:start + size])
        links = sorted(set(links))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
        part, key, fp = part[cut:], key[cut:], fp[cut:]


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all different fingerprints within the distance, never more than one per key row.

    A bucket with over ``bucket`` fingerprints hands its members to the keys of the next level. Two close members share a key
    on every level: they meet in a bucket that is kept, or both go on. Buckets of the last level are all kept; they hold at
    most BUCKET.
    """
    rows, members, first = None, fps.select("fp").distinct(), 0
    for level in LEVELS[:-1]:
        keyed = _keys(members, level, first)
        crowded = written(keyed.groupBy("part", "key").count().where(F.col("count") > bucket).drop("count"), "crowded")
        kept = keyed.join(crowded, ["part", "key"], "left_anti").select("part", "key", "fp")
        rows = kept if rows is None else rows.unionByName(kept)
        members = written(keyed.join(crowded, ["part", "key"], "left_semi").select("fp").distinct(), "members")
        first += len(_masks(*level))
    rows = rows.unionByName(_keys(members, LEVELS[-1], first).select("part", "key", "fp"))
    dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    return map_arrow(dealt, "a long, b long", _bucket_links)


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, links) per row of ``docs``.

    Texts are lower-cased in A-Z and cut at ASCII white space. Null and empty texts have fingerprint zero and link like
    others; equal fingerprints link; repeated rows are returned as often as they come; rows without an id belong to
    components but never name them (null where no member has an id). An empty table gives an empty table.
    """
    fps = written(document_fingerprints(docs, id_column, text_column), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    roots = connected_components(fingerprint_links(classes)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_fingerprints"))
    named = written(rooted.join(lowest, "root").select("fp", "component_id", "n_fingerprints"), "named")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_fingerprints"
    )
