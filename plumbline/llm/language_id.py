"""Language identification by bit-sliced Bloom filters of character n-grams.

A row of the filter holds one bit per language. The rows at an n-gram's hash positions, and-ed together, are the bit mask of
all languages whose filter contains the n-gram. Per language the set bits over a text are counted, the hits that the filter's
fill lets expect by chance are taken off, and the language with most left is predicted.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_arrow, texts_of

GRAM, PROBES, ROWS_LOG2 = 4, 3, 20
#: Texts per language the filters are fitted on, about; a bound of the model, not of what is predicted.
SAMPLE = 2000
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: Characters taken at a time.
PIECE = 1 << 20
_U = np.uint64


@dataclass(frozen=True)
class Filters:
    """The fitted filters: languages, one mask row per position (as words of 8 to 64 bits), chance of a false hit."""

    languages: list[str]
    rows: np.ndarray  # (words, 2^ROWS_LOG2)
    chance: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts in runs of about PIECE characters with their numbers; longer texts are cut into several pieces."""
    numbers, held, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            numbers.append(i)
            held.append(text[at:at + PIECE])
            size += len(held[-1])
            if size >= PIECE:
                yield np.array(numbers), held
                numbers, held, size = [], [], 0
    if held:
        yield np.array(numbers), held


def _grams(numbers: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters (others are one space), the text of each, texts with any letter."""
    lowered = [f" {t.lower()}  " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner, ends = np.repeat(numbers, lengths), np.cumsum(lengths)
    letter = _letters().take(code)
    lettered = np.unique(owner[letter])
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[ends - 1] = keep[ends - lengths] = True
    code, owner = np.where(letter, code, 32)[keep].astype(_U), owner[keep]
    n = len(code) - GRAM + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64), lettered
    mixed = code[:n] * _U(0x9E3779B97F4A7C15)
    for i, factor in zip(range(1, GRAM), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        mixed += code[i:n + i] * _U(factor)
    mixed ^= mixed >> _U(29)
    mixed *= _U(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> _U(32)
    inside = (owner[:n] == owner[GRAM - 1:]) & ~((code[:n] == 32) & (code[GRAM - 1:] == 32) & (code[1:n + 1] == 32))
    return mixed[inside], owner[:n][inside], lettered


def _positions(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield (hashes >> _U(i * ROWS_LOG2) & _U((1 << ROWS_LOG2) - 1)).astype(np.int64)


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, texts of this batch that have it)."""
    for batch in batches:
        languages, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch)
        seen = []
        for i, text in enumerate(texts):
            parts = [_grams(numbers, held)[0] for numbers, held in _pieces([text])]
            grams = np.unique(np.concatenate(parts)) if parts else np.empty(0, _U)
            seen.append((np.full(len(grams), languages[i], np.int32), grams))
        if not seen:
            continue
        lang, gram = (np.concatenate([s[k] for s in seen]) for k in (0, 1))
        order = np.lexsort((gram, lang))
        lang, gram = lang[order], gram[order]
        first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]) if len(gram) else np.empty(0, np.int64)
        counts = np.diff(np.r_[first, len(gram)])
        yield pa.RecordBatch.from_arrays([pa.array(lang[first]), pa.array(gram[first].view(np.int64)), pa.array(counts)], ["language", "gram", "n"])


def fit(rows: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from labelled rows (doc_id, text, lang): of each language about ``sample`` texts, chosen by a hash of the id.

    An n-gram enters a language's filter if it occurs in a small share of the sampled texts (one in 600, and one more).
    Rows without a language or without a text are left out. More than MAX_LANGUAGES languages are refused, for the bound of
    the model: 2^ROWS_LOG2 rows of one bit per language, rounded up to whole words.
    """
    rows = rows.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    counted = sorted(((r.lang, r["count"]) for r in counts), key=lambda x: (-x[1], x[0]))  # ties go to the more frequent
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [lang for lang, _ in counted]
    width = next(w for w in (8, 16, 32, 64) if w >= min(64, len(languages)))
    table = np.zeros((-(-max(1, len(languages)) // width), 1 << ROWS_LOG2), f"uint{width}")
    if languages:
        number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
        share = F.create_map(*[F.lit(x) for lang, n in counted for x in (lang, min(1.0, sample / n))])
        draw = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
        chosen = rows.where(draw < share[F.col("lang")]).select(number[F.col("lang")].cast("int").alias("language"), "text")
        least = F.create_map(*[F.lit(x) for i, (_, n) in enumerate(counted) for x in (i, 1 + min(n, sample) // 600)])
        grams = map_arrow(chosen, "language int, gram long, n long", _sample_grams).groupBy("language", "gram").agg(F.sum("n").alias("n"))
        known = grams.where(F.col("n") >= least[F.col("language")])
        mask = F.lit((1 << ROWS_LOG2) - 1).cast("long")
        spots = F.array(*[F.shiftrightunsigned("gram", i * ROWS_LOG2).bitwiseAND(mask) for i in range(PROBES)])
        bit = F.expr(f"shiftleft(1L, language % {width})")
        sliced = (
            known.select(F.explode(spots).alias("spot"), F.floor(F.col("language") / width).cast("int").alias("word"), bit.alias("bit"))
            .groupBy("word", "spot").agg(F.bit_or("bit").alias("bits")).toArrow()
        )
        bits = sliced.column("bits").to_numpy().view(np.uint64).astype(table.dtype)
        table[sliced.column("word").to_numpy(), sliced.column("spot").to_numpy()] = bits
    fill = np.array([float((table[i // width] >> table.dtype.type(i % width) & table.dtype.type(1)).mean()) for i in range(len(languages))])
    return Filters(languages, table, fill ** PROBES)


def _hits(filters: Filters, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams per text, hits per text and language, and which texts have a letter."""
    total, lettered = np.zeros(len(texts)), np.zeros(len(texts), bool)
    hits = np.zeros((len(filters.languages), len(texts)))
    width = filters.rows.dtype.itemsize * 8
    for numbers, held in _pieces(texts):
        hashes, owner, some = _grams(numbers, held)
        lettered[some] = True
        total += np.bincount(owner, minlength=len(texts))
        spots = list(_positions(hashes))
        for word, row in enumerate(filters.rows):
            masks = row.take(spots[0])
            for spot in spots[1:]:
                masks &= row.take(spot)
            for bit in range(min(width, len(filters.languages) - word * width)):
                found = (masks >> masks.dtype.type(bit) & masks.dtype.type(1)).astype(bool)
                hits[word * width + bit] += np.bincount(owner[found], minlength=len(texts))
    return total, hits, lettered


def _predict(batches: Iterator[pa.RecordBatch], shared, text_column: str) -> Iterator[pa.RecordBatch]:
    filters = shared.value
    names = np.array([*filters.languages, UNKNOWN], object)
    for batch in batches:
        texts = [t or "" for t in batch.column(0).field(text_column).to_pylist()]
        total, hits, lettered = _hits(filters, texts)
        best, score = np.full(len(texts), len(filters.languages)), np.zeros(len(texts))
        if len(hits):
            real = (hits - total * filters.chance[:, None]) / (1 - filters.chance[:, None]).clip(1e-9)
            best = np.where(lettered, real.argmax(axis=0), best)
            score = np.where(lettered, (real.max(axis=0) / total.clip(1)).clip(0, 1), 0.0)
        columns = [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "lang_pred", "score"])


def predict(rows: DataFrame, filters: Filters, text_column: str = "text") -> DataFrame:
    """(row, lang_pred, score): each row as a struct, its language and the share of its n-grams that this explains.

    ``und`` with score 0 for a null text, a text without letters, or where no language was learned. Texts with letters but
    no known n-gram get the most frequent language with score 0. Rows are neither moved nor dropped, and their columns cannot clash.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(packed, schema, _predict, shared, text_column)


def held_out(id_column: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; learned from rows with a language and an id that are not held out."""
    rows = docs.select("doc_id", "text", "lang")
    filters = fit(rows.where(~held_out() & F.col("doc_id").isNotNull()))
    found = predict(rows.select("doc_id", "text"), filters).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
