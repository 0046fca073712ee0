"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its lower-cased words without punctuation at their ends, weighted by how often they occur.
For each of SAMPLES functions, every term draws r and c from Gamma(2, 1) and b from [0, 1), all from a hash of term and
function. With t = floor(ln w / r + b) the term's rank is c * exp(-r * (t - b + 1)), and the sample is the term of least rank
with its t. Two texts agree in a sample with probability sum(min) / sum(max) of their weights, the generalised Jaccard
similarity; the share of equal samples estimates it.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import map_arrow, text_columns, written

SAMPLES = 64
#: Terms drawn at a time; texts compared at a time, in characters.
STRIPE, CHUNK = 4096, 1 << 21
STRIP = string.punctuation + "“”„‘’«»¿¡…–—"
_U = np.uint64
_FUNCTIONS = np.array([xxhash.xxh64_intdigest(f"sample {i}", 7) for i in range(SAMPLES)], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln c of every (term, function), as 32-bit floats."""
    first = _mix(terms[:, None] ^ _FUNCTIONS[None, :])
    second = _mix(first + _U(0x9E3779B97F4A7C15))
    unit = lambda x, shift: ((x >> _U(shift) & _U(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2 ** -21)
    r = -np.log(unit(first, 0) * unit(first, 21))
    c = np.log(-np.log(unit(second, 0) * unit(second, 21)))
    b = unit(first, 42) * np.float32(0.99) + unit(second, 42) * np.float32(0.01)
    return r, b, c


class Words(dict):
    """Raw word to the number of its term; zero is no term."""

    def __init__(self):
        super().__init__()
        self.hashes, self.known = [0], {}

    def __missing__(self, raw: str) -> int:
        word = raw.strip(STRIP)
        number = self.known.get(word) if word else 0
        if number is None:
            number = self.known[word] = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        self[raw] = number
        return number


def signatures(texts: list[str]) -> np.ndarray:
    """One row of SAMPLES 16-bit samples per text; a text without terms has the samples zero, others none of zero."""
    words, owners, weights, picked = Words(), [], [], []
    for i, text in enumerate(texts):
        raw = text.lower().split()
        numbers, counts = np.unique(np.fromiter(map(words.__getitem__, raw), np.int64, len(raw)), return_counts=True)
        real = numbers > 0
        picked.append(numbers[real])
        weights.append(counts[real])
        owners.append(np.full(int(real.sum()), i))
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not texts or not sum(map(len, picked)):
        return out
    hashes = np.array(words.hashes, _U)
    term, weight, owner = np.concatenate(picked), np.concatenate(weights), np.concatenate(owners)
    # all uses of a term come together, so its draws are made once; equal weights of it have equal ranks
    order = np.lexsort((weight, term))
    term, weight, owner = term[order], weight[order], owner[order]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (weight[1:] != weight[:-1])])
    uses = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(term)]))
    ranks, steps = np.empty((len(first), SAMPLES), np.float32), np.empty((len(first), SAMPLES), np.int32)
    for at in range(0, len(first), STRIPE):
        some = first[at:at + STRIPE]
        r, b, c = draws(hashes[term[some]])
        t = np.floor(np.log(weight[some], dtype=np.float32)[:, None] / r + b)
        ranks[at:at + STRIPE] = c - r * (t - b + np.float32(1))
        steps[at:at + STRIPE] = t
    back = np.argsort(owner, kind="stable")
    use, owner = uses[back], owner[back]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ends, have = np.r_[starts[1:], len(owner)], owner[starts]
    use_hash = hashes[term[first]]
    for text, lo, hi in zip(have.tolist(), starts.tolist(), ends.tolist()):
        mine = use[lo:hi]
        mine = mine[np.argsort(use_hash[mine])] if hi - lo > 1 else mine  # ties fall to the least hash
        winner = mine[ranks[mine].argmin(axis=0)]
        steps_won = steps[winner, np.arange(SAMPLES)]
        sample = _mix(use_hash[winner] ^ (steps_won.astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15)))
        out[text] = np.maximum(sample >> _U(48), _U(1))
    return out


def printed(signature: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, four digits for each sample."""
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row; two texts without terms are alike."""
    return (a == b).mean(axis=1)


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following text, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = (
    "part int, place long, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(ids: list, texts: list[str], following: list[str]) -> list[list]:
    """The result columns for texts and the text that follows each."""
    out: list[list] = [[] for _ in range(8)]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < CHUNK):
            size += len(texts[end])
            end += 1
        own, nxt = texts[at:end], following[at:end]
        edited = [edited_text(a, b) for a, b in zip(own, nxt)]
        chain = all(nxt[i] is own[i + 1] for i in range(len(own) - 1))
        marks = signatures(own + nxt[-1:] + edited if chain else own + nxt + edited)
        mine, changed = marks[:len(own)], marks[-len(own):]
        others = marks[1:len(own) + 1] if chain else marks[len(own):2 * len(own)]
        digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        found = (ids[at:end], [None] * len(own), [len(t) for t in own], digest, printed(mine), printed(changed), likeness(mine, changed).tolist(), likeness(mine, others).tolist())
        for column, values in zip(out, found):
            column += values
        at = end
    return out


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a partition but its last; its first and last row also as bare texts, marked by their place."""
    part, ids, texts, place, first = TaskContext.get().partitionId(), [], [], 0, True

    def bare(where: int, key, text: str) -> pa.RecordBatch:
        values = [part, where, key, text, None, None, None, None, None, None]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS)], _NAMES)

    for batch in batches:
        new_ids, new_texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if first and new_ids:
            yield bare(0, new_ids[0], new_texts[0])
            first = False
        ids, texts = ids + new_ids, texts + new_texts
        if len(ids) > 1:
            columns = _compare(ids[:-1], texts[:-1], texts[1:])
            n = len(ids) - 1
            arrays = [pa.array([part] * n, pa.int32()), pa.array(range(place + 1, place + 1 + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, k) for c, k in zip(columns, _KINDS[2:])]], _NAMES)
            place, ids, texts = place + n, ids[-1:], texts[-1:]
    if ids:
        yield bare(-1, ids[0], texts[0])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
        columns = _compare(ids, texts, following)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS[2:])], _NAMES[2:])


def weighted_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text is the text whose last half is replaced by the beginning of the next document in ascending order of id
    (then text; rows without an id come first; after the last comes the first). Null texts count as empty. A text without
    words has the zero fingerprint, like any other such text and unlike all others. A single row is its own next.

    Rows are dealt into ranges of ids once; only the first and the last row of each partition are joined across partitions.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = text_columns(docs, id_column, text_column).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    done = written(map_arrow(ordered, RESULT, _in_order), "weighted-fingerprints")
    edges = done.where("text is not null")
    lasts = edges.where("place = -1").select("part", "doc_id", "text")
    firsts = edges.where("place = 0").select("part", F.col("text").alias("following"))
    parts = firsts.select("part")
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part")))
    order = written(parts.select("part", after.alias("next_part")), "order")
    pairs = lasts.join(order, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "following")
    schema = RESULT.split(", ", 2)[2]
    seam = map_arrow(pairs, schema, _pairs)
    names = [n for n in _NAMES[2:] if n != "text"]
    return done.where("text is null").select(*names).unionByName(seam.select(*names))
