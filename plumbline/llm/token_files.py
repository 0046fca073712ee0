"""Token ids of documents in files of the range coder, in ascending order of document ids.

A token table is a folder of Parquet files; each row is one coded file (see ``range_coder``) with its place in the order
(part, seq), its number of ids, and the ids and lengths of its documents. Rows are independent: any of them can be written
or read again alone when an executor is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import range_coder, tokenizer
from plumbline.llm.common import map_arrow, text_columns, texts_of, written
from plumbline.session import work_dir

#: Ids after which a file is closed, at the next end of a document; texts encoded at a time, in characters.
FILE_IDS, CHUNK = 1 << 23, 1 << 22
#: Characters of a partition that fills a file or nearly so: the coder's cost of a step is shared by all blocks of a file.
FILE_CHARS = FILE_IDS * 9 // 4
FILES = "part int, seq int, n_ids long, doc_ids array<bigint>, sizes array<bigint>, data binary"
#: A worker keeps the tokenizer, which is of fixed size; the pieces it has met are given back with each task.
_WORKER: dict[str, tokenizer.Ids] = {}


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= CHUNK or i == len(texts) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def _files(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = tokenizer.Ids(path)
    part, seq = TaskContext.get().partitionId(), 0
    keys, sizes, ids, held = [], [], [], 0

    def close() -> pa.RecordBatch:
        arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                  pa.array([keys], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                  pa.array([range_coder.encode(np.concatenate(ids))], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["part", "seq", "n_ids", "doc_ids", "sizes", "data"])

    try:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), texts_of(batch)
            for lo, hi in _chunks(texts):
                some, counts = _WORKER[path].rows(texts[lo:hi], end)
                keys += names[lo:hi]
                sizes.append(counts)
                ids.append(some)
                held += len(some)
                if held >= FILE_IDS:
                    yield close()
                    keys, sizes, ids, held, seq = [], [], [], 0, seq + 1
    finally:
        _WORKER[path].renew(0)
    if keys:
        yield close()


def _partitions(texts: DataFrame) -> int:
    """As many as fill their files, but a task for every core and never more than the session's shuffle partitions."""
    spark = texts.sparkSession
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(-(-chars // FILE_CHARS), spark.sparkContext.defaultParallelism))


def write_token_files(docs: DataFrame, folder: str, path: str, end: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes every text, appends ``end`` to it and writes a token table to ``folder``.

    Rows are put in ascending order of id, then text; rows without an id come first.
    """
    texts = text_columns(docs, id_column, text_column)
    ordered = texts.repartitionByRange(_partitions(texts), "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, FILES, _files, path, end).write.parquet(folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, sizes = range_coder.decode(row["data"]), np.array(row["sizes"], np.int64)
            if len(ids) != sizes.sum():
                raise range_coder.Damaged("document lengths")
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, ends = range_coder.decode(row["data"]), np.cumsum([0, *row["sizes"]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"])


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) per document of a token table, end ids included."""
    return map_arrow(spark.read.schema(FILES).parquet(folder), "doc_id long, ids array<bigint>", _ids)


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the decoded files of a token table.

    The offsets are a running sum over one row per file, not per document.
    """
    files = spark.read.schema(FILES).parquet(folder)
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(files.select("part", "seq", F.coalesce(before, F.lit(0)).alias("start")), "offsets")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return map_arrow(files.join(starts, ["part", "seq"]).select("start", "doc_ids", "sizes", "data"), schema, _digests)


def token_files(docs: DataFrame, path: str | None = None, end: int = 2, folder: str | None = None) -> DataFrame:
    """Writes a token table of all documents to ``folder`` (a fresh shared one by default) and reads it back as digests.

    Null and empty texts give the end id alone; repeated rows are written as often as they come; an empty table gives an
    empty token table. Damaged files raise when they are read.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "token-files")
    write_token_files(docs, folder, path or tokenizer.vocabulary_path(), end)
    return read_token_digests(spark, folder)
