"""Training documents that hold benchmark items: shared n-grams find candidates, local alignment scores them.

Words are white-space delimited, lower-cased and stripped of punctuation at both ends. All word n-grams of the documents that
may occur in an item pass a bit map of fixed size in the tasks. Every n-gram of an item is a seed, so any GRAM words in a row
that a copy left unedited hold one, however frequent they are; frequent n-grams are salted in the join, not left out. An item
of fewer words is one n-gram, looked up as a whole. Documents that hold a seed are aligned with the item by Smith-Waterman over
words around the seed's place.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, text_columns, texts_of, written
from plumbline.operators.joins import salted_join

#: Every window of WINDOW consecutive n-grams of an item holds a seed.
GRAM, WINDOW, MAP_LOG2 = 3, 1, 22
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds whose places in document and item differ by about the same are aligned together.
BAND = 64
#: A document holds an item if the alignment reaches this share of the item's own score, or this many matched words.
SHARE, MATCHED = 0.5, 50
STRIP = string.punctuation + "“”„‘’«»¿¡…–—"
CACHE, ITEMS, CHUNK = 200_000, 10_000, 1 << 22
_U = np.uint64


class Words(dict):
    """Hash of a raw word; zero where only punctuation is left. Lives as long as a task and starts anew beyond CACHE words."""

    def __missing__(self, raw: str) -> int:
        word = raw.strip(STRIP)
        value = (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(self) >= CACHE:
            self.clear()
        if len(raw) <= 64:
            self[raw] = value
        return value


def word_hashes(text: str, words: Words | None = None) -> np.ndarray:
    """Hashes of a text's words; ``words`` is the cache of a task."""
    raw = text.lower().split()
    words = Words() if words is None else words
    hashes = np.fromiter(map(words.__getitem__, raw), _U, len(raw))
    return hashes[hashes != 0]


def gram_hashes(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    mixed = np.full(n, GRAM - size, _U)
    for i, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:size]):
        mixed += (words[i:n + i] ^ words[i:n + i] >> _U(31)) * _U(factor)
    mixed ^= mixed >> _U(29)
    mixed *= _U(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> _U(32)


def _rows(keys: list, places: list[np.ndarray], grams: list[np.ndarray]) -> pa.RecordBatch:
    sizes = [len(g) for g in grams]
    picked = pa.array(keys, pa.int64()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([picked, pa.array(join(places, np.int32)), pa.array(join(grams, _U).view(np.int64))], ["key", "place", "gram"])


def _all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        grams = [gram_hashes(w, min(GRAM, len(w)) or GRAM) for w in (word_hashes(t, known) for t in texts_of(batch))]
        yield _rows(batch.column(0).to_pylist(), [np.arange(len(g)) for g in grams], grams)


def _short_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = {len(word_hashes(t)) for t in texts_of(batch)} & set(range(1, GRAM))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(sizes), pa.int32())], ["size"])


def _listed_grams(batches: Iterator[pa.RecordBatch], shared, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    listed = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
    known = Words()
    for batch in batches:
        places, kept = [], []
        for text in texts_of(batch):
            words = word_hashes(text, known)
            found, held = [], []
            for size in sizes:
                grams = gram_hashes(words, size)
                found.append(np.flatnonzero(listed.take((grams >> _U(64 - MAP_LOG2)).astype(np.int64))) if len(grams) else np.empty(0, np.int64))
                held.append(grams[found[-1]])
            places.append(np.concatenate(found))
            kept.append(np.concatenate(held))
        yield _rows(batch.column(0).to_pylist(), places, kept)


def _bit_map(grams: DataFrame) -> bytes:
    """2^MAP_LOG2 bits, whatever the number of n-grams: one per value of their upper bits."""
    spot = F.shiftrightunsigned("gram", 64 - MAP_LOG2)
    words = grams.select(F.floor(spot / 64).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - MAP_LOG2}) % 64 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_LOG2 - 6, np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bits.tobytes()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and where in the passage it ends (exclusive)."""
    best, end = 0, 0
    if not len(item) or not len(passage):
        return best, end
    ramp = -GAP * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row + ramp) - ramp
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def _align_rows(batches: Iterator[pa.RecordBatch], share: float, matched: int) -> Iterator[pa.RecordBatch]:
    items, known = {}, Words()
    for batch in batches:
        rows, words = [], None
        texts, item_texts = batch.column(1), batch.column(3)
        # candidates of a document come one after the other: its text leaves the batch once, however many they are
        anew = [True, *pc.not_equal(texts[1:], texts[:-1]).to_pylist()] if len(texts) else []
        doc_ids, item_keys, shifts = (batch.column(i).to_pylist() for i in (0, 2, 4))
        for i, (doc_id, item_key, shift) in enumerate(zip(doc_ids, item_keys, shifts)):
            if anew[i]:
                words = word_hashes(texts[i].as_py(), known)
            if item_key not in items:
                if len(items) >= ITEMS:
                    items.clear()
                items[item_key] = word_hashes(item_texts[i].as_py(), known)
            item = items[item_key]
            reach = BAND + len(item) // 2
            lo = max(0, shift * BAND - reach)
            passage = words[lo:max(0, shift * BAND + BAND + len(item) + reach)]
            least = min(share * MATCH * len(item), MATCH * matched)
            # no alignment scores more than a match of every item word that occurs in the passage
            if MATCH * np.count_nonzero(np.isin(item, passage)) < least:
                continue
            score, end = align(item, passage)
            if score >= least:
                start = end - align(item[::-1], passage[:end][::-1])[1]
                rows.append((doc_id, item_key, score / (MATCH * len(item)), lo + start, lo + end))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_key", "score", "first_word", "end_word"])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, matched: int = MATCHED) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): each document with each item it holds, and where.

    ``score`` is the best alignment's share of the item's score with itself; first_word and end_word count the document's
    words that are more than punctuation. Null and empty texts hold nothing; rows without an id are left out; rows that
    repeat an id are taken for one document. A copy is found if any three words in a row are unedited; items of under three
    words only as a whole, items without words never. Items that repeat an id are one item if their texts are equal and else
    report the best. Empty tables give an empty table.
    """
    rows = text_columns(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    items = written(items.distinct().select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text"), "items")
    item_grams = written(map_arrow(items.select("item_key", "text"), "key long, place int, gram long", _all_grams), "item-grams")
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(item_grams.select("gram")))
    short = map_arrow(items.select("text"), "size int", _short_sizes).distinct().collect()
    found = map_arrow(rows, "key long, place int, gram long", _listed_grams, shared, [GRAM, *(r["size"] for r in short)])
    hits = written(found.withColumnsRenamed({"key": "doc_id", "place": "doc_place"}), "hits")
    shift = F.floor((F.col("doc_place") - F.col("place")) / BAND).cast("int").alias("shift")
    pairs = salted_join(hits, item_grams, ["gram"], "inner").select("doc_id", F.col("key").alias("item_key"), shift)
    candidates = written(pairs.distinct(), "candidates")
    # the items' texts are joined first, so a document's text is shuffled once, one way at every size, and copied only behind the join
    listed = candidates.join(items.select("item_key", F.col("text").alias("item_text")), "item_key")
    compared = rows.join(listed.hint("merge"), "doc_id").select("doc_id", "text", "item_key", "item_text", "shift")
    scored = map_arrow(compared, "doc_id long, item_key long, score double, first_word int, end_word int", _align_rows, share, matched)
    best = F.max(F.struct("score", F.negate("first_word").alias("back"), "end_word")).alias("best")
    named = scored.join(items.select("item_key", "item_id"), "item_key").groupBy("doc_id", "item_id").agg(best)
    return named.select("doc_id", "item_id", "best.score", F.negate("best.back").alias("first_word"), "best.end_word")
