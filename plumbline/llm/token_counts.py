"""Token counts per document: a broadcast table of frequent pieces, worker caches for the rest, no shuffle of pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokenizer
from plumbline.llm.common import map_arrow, text_columns, texts_of

#: Frequent pieces in the broadcast table; with LONG characters at most, that bounds it below 8 MB.
FREQUENT = 1 << 16
#: Pieces a task reports as its most frequent, and how many it holds while counting.
REPORT, HOLD = 1 << 13, 1 << 18
_WORKER: dict[tuple, tokenizer.Pieces] = {}


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in texts_of(batch):
            seen.update(tokenizer.pieces(text))
            if len(seen) > HOLD:
                seen = Counter(dict(seen.most_common(HOLD // 4)))
    best = [(p, n) for p, n in seen.most_common(REPORT) if 0 < len(p) <= tokenizer.LONG and n > 1]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["piece", "n"])


def frequent_pieces(docs: DataFrame, path: str) -> tuple[str, bytes]:
    """The pieces that tasks report most often over all documents, and their lengths in ids: one text and one byte string.

    It only decides what is looked up first; counts do not depend on it.
    """
    best = map_arrow(docs, "piece string, n long", _heavy).groupBy("piece").agg(F.sum("n").alias("n"))
    words = [r.piece for r in best.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()]
    encode = tokenizer.load(path).encode
    lengths = ((w, len(encode(w, add_special_tokens=False))) for w in words)
    table = [(w, n) for w, n in lengths if n < 256]
    return " ".join(w for w, _ in table), bytes(n for _, n in table)


def _counts(batches: Iterator[pa.RecordBatch], path: str, shared, limit: int) -> Iterator[pa.RecordBatch]:
    key = (path, id(shared))
    if key not in _WORKER:
        words, lengths = shared.value
        _WORKER.clear()
        _WORKER[key] = tokenizer.Pieces(path, False, dict(zip(words.split(" "), lengths)) if lengths else {})
    lengths_of = _WORKER[key].lengths
    for batch in batches:
        texts = texts_of(batch)
        counts = lengths_of(texts)
        sizes = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row: tokens of the whole text without added special tokens.

    Null and empty texts count zero tokens; a null id stays null; repeated rows are counted each; an empty table gives an
    empty table. ``path`` must name a vocabulary that drops white space and never joins across it.
    """
    path = path or tokenizer.vocabulary_path()
    rows = text_columns(docs, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pieces(rows, path))
    return map_arrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", _counts, path, shared, limit)
