"""Documents scored by an interpolated modified Kneser-Ney bigram model over tokens of a fixed vocabulary.

The model is trained on trusted documents. For a bigram (v, w) that was seen, p(w | v) = (c - D(c)) / c(v) + g(v) p1(w); for
others only the second part is left. p1 is the Kneser-Ney unigram of continuation counts, interpolated with the uniform
distribution. So the log probability of a text is a sum: log g(v) + log p1(w) of every position, and for each seen bigram a
bonus, its log p(w | v) less that. The first two are arrays over the vocabulary, whose size is fixed. The bonuses are the
model's long table, sharded by bigram: the FREQUENT most frequent are broadcast and looked up where the text is; all other
bigrams of a document are counted and joined with the shards, and the bonuses are summed per document.

With folds, trusted documents are scored by a model that has not seen them: their texts are dealt to folds by hash, and the model
of a fold is trained on the others. The bigrams are counted once, per fold; each table has a value per model.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokenizer
from plumbline.llm.common import map_arrow, texts_of, written

#: Bigrams in the broadcast table (12 bytes each); bits of the map that spares untrusted texts the join with the labels.
FREQUENT, MAP_LOG2 = 1 << 20, 22
#: A document passes up to this quantile of the perplexities of its language's trusted documents.
QUANTILE, ACCURACY = 0.995, 10_000
#: Folds of the registered query. A key holds its fold above bit FOLD_AT while it is counted.
FOLDS, FOLD_AT = 5, 56
#: Bigrams a task holds while counting; characters scored at a time.
HOLD, CHUNK = 1 << 20, 1 << 20
_TOKENS: dict[str, tokenizer.Ids] = {}


@functools.cache
def vocabulary_size(path: str) -> int:
    return tokenizer.load(path).get_vocab_size()


def _ids(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each behind the start symbol, and the ids per text, start included."""
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = tokenizer.Ids(path)
    start = vocabulary_size(path)
    ids, counts = _TOKENS[path].rows(texts, start)
    # the mark stands behind each text; roll it to the front
    return np.roll(ids, 1).astype(np.int64), counts


def bigram_keys(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of all texts as v * 2^32 + w, and the text of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[1:] == owner[:-1]
    return (ids[:-1] << 32 | ids[1:])[inside], owner[1:][inside]


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(keys, return_inverse=True)
    return unique, np.bincount(back, counts, len(unique)).astype(np.int64)


def fold_of(text: str, folds: int) -> Column:
    """The fold of a text; equal texts share one."""
    return (F.pmod(F.xxhash64(text), F.lit(folds)) if folds else F.lit(0)).cast("int").alias("fold")


def _count_bigrams(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = _counted(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(keys & (1 << FOLD_AT) - 1), pa.array((keys >> FOLD_AT).astype(np.int32)), pa.array(counts)], ["key", "fold", "n"])

    for batch in batches:
        texts, folds = texts_of(batch), batch.column(2).to_numpy().astype(np.int64)
        for lo, hi in _spans(texts):
            keys, owner = bigram_keys(*_ids(path, texts[lo:hi]))
            keys |= folds[lo:hi][owner] << FOLD_AT
            held.append(_counted(keys, np.ones(len(keys))))
            size += len(held[-1][0])
            if size > HOLD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts one, two, and three or more; half a step where the counts don't give them."""
    n = [counts_of_counts.get(i, 0) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * 0.5 for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), found))


def _discount(count, d: tuple[float, float, float]):
    return F.when(count == 0, 0.0).when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


@dataclass(frozen=True)
class Model:
    """log g by model and first token, log p1 by model and second, the frequent bigrams with their bonuses by model, and the
    table of all bonuses. The last model has seen all trusted texts, the others, one per fold, all but those of the fold."""

    back_off: np.ndarray
    unigram: np.ndarray
    keys: np.ndarray
    bonus: np.ndarray
    shards: DataFrame | None


def train(trusted: DataFrame, path: str, folds: int = 0) -> Model:
    """The models of all texts of ``trusted`` (column text)."""
    size, models = vocabulary_size(path), range(folds + 1)
    rows = trusted.select(F.lit(0).cast("long").alias("doc_id"), "text", fold_of("text", folds))
    counted = map_arrow(rows, "key long, fold int, n long", _count_bigrams, path)
    first, second = F.shiftright("key", 32).cast("int"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    # a model's count is that of all texts without its fold; the last model has none
    seen = [F.sum(F.when(F.col("fold") != k, F.col("n")).otherwise(0) if k < folds else F.col("n")).alias(f"c{k}") for k in models]
    bigrams = written(counted.groupBy("key").agg(*seen).select("key", first.alias("v"), second.alias("w"), *[f"c{k}" for k in models]), "bigrams")

    def discounts(frame: DataFrame, column: str) -> list[tuple[float, float, float]]:
        found = frame.agg(*[F.count_if(F.col(f"{column}{k}") == i).alias(f"n{k}_{i}") for k in models for i in range(1, 5)]).first()
        return [_discounts({i: found[f"n{k}_{i}"] for i in range(1, 5)}) for k in models]

    d2 = discounts(bigrams, "c")
    c_less = [_discount(F.col(f"c{k}"), d2[k]) for k in models]
    contexts = written(bigrams.groupBy("v").agg(*[F.sum(f"c{k}").alias(f"total{k}") for k in models], *[F.sum(c_less[k]).alias(f"taken{k}") for k in models]), "contexts")
    followers = written(bigrams.groupBy("w").agg(*[F.count_if(F.col(f"c{k}") > 0).alias(f"n{k}") for k in models]), "followers")
    d1 = discounts(followers, "n")
    n_less = [_discount(F.col(f"n{k}"), d1[k]) for k in models]
    sums = followers.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in models], *[F.sum(n_less[k]).alias(f"taken{k}") for k in models]).first()
    # both tables have a row per token of the vocabulary at most
    back_off, unigram = np.zeros((len(models), size + 1)), np.full((len(models), size + 1), 1.0 / size)
    by_first, by_second = contexts.toArrow(), followers.select("w", *[(F.col(f"n{k}") - n_less[k]).alias(f"n{k}") for k in models]).toArrow()
    for k in models:
        if sums[f"n{k}"]:
            total, taken = by_first.column(f"total{k}").to_numpy(), by_first.column(f"taken{k}").to_numpy()
            back_off[k][by_first.column("v").to_numpy()[total > 0]] = np.log(taken[total > 0] / total[total > 0])
            unigram[k] = sums[f"taken{k}"] / sums[f"n{k}"] / size
            unigram[k][by_second.column("w").to_numpy()] += by_second.column(f"n{k}").to_numpy() / sums[f"n{k}"]
    p1 = [((F.col(f"n{k}") - n_less[k]) / (sums[f"n{k}"] or 1) + (sums[f"taken{k}"] or 0.0) / (sums[f"n{k}"] or 1) / size).alias(f"p{k}") for k in models]
    # (c - D) / total over g p1, where g is taken / total
    gain = [F.log1p((F.col(f"c{k}") - c_less[k]) / (F.col(f"taken{k}") * F.col(f"p{k}"))) for k in models]
    bonus = F.array(*[F.when(F.col(f"c{k}") > 0, gain[k]).otherwise(0.0).cast("float") for k in models])
    found = bigrams.join(contexts, "v").join(followers.select("w", *p1), "w")
    shards = written(found.select("key", F.col(f"c{folds}").alias("c"), bonus.alias("bonus")), "bonuses")
    top = shards.orderBy(F.desc("c"), "key").limit(FREQUENT).select("key", "bonus").toArrow()
    order = np.argsort(top.column("key").to_numpy())
    bonuses = top.column("bonus").combine_chunks().flatten().to_numpy().reshape(-1, len(models))
    return Model(back_off, np.log(unigram), top.column("key").to_numpy()[order], bonuses[order], shards)


def _score(batches: Iterator[pa.RecordBatch], path: str, shared) -> Iterator[pa.RecordBatch]:
    """Per row what the task itself can score, by the last model and by that of the row's fold, and the bigrams that must be
    looked up elsewhere, with their counts."""
    back_off, unigram, known, bonus = shared.value
    part, place = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        texts, ids, langs, folds = texts_of(batch), batch.column(0), batch.column(2), batch.column(3)
        fold = folds.to_numpy()
        for lo, hi in _spans(texts):
            tokens, counts = _ids(path, texts[lo:hi])
            keys, owner = bigram_keys(tokens, counts)
            v, w, own = keys >> 32, keys & 0xFFFFFFFF, fold[lo:hi][owner]
            total = np.bincount(owner, back_off[-1][v] + unigram[-1][w], hi - lo).astype(np.float64)
            held = np.bincount(owner, back_off[own, v] + unigram[own, w], hi - lo).astype(np.float64)
            at = np.searchsorted(known, keys).clip(0, max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            if len(known):
                total += np.bincount(owner[hit], bonus[at[hit], -1], hi - lo)
                held += np.bincount(owner[hit], bonus[at[hit], own[hit]], hi - lo)
            miss, rows = keys[~hit], owner[~hit]
            order = np.lexsort((miss, rows))
            miss, rows = miss[order], rows[order]
            first = np.flatnonzero(np.r_[True, (miss[1:] != miss[:-1]) | (rows[1:] != rows[:-1])]) if len(miss) else np.empty(0, np.int64)
            times = np.diff(np.r_[first, len(miss)]) if len(miss) else first
            ends = np.r_[0, np.cumsum(np.bincount(rows[first], minlength=hi - lo))].astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(miss[first]), pa.array(times)], ["key", "n"])
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(place, place + n) + part), ids.slice(lo, n), langs.slice(lo, n), folds.slice(lo, n), pa.array(counts - 1), pa.array(total), pa.array(held),
                 pa.ListArray.from_arrays(pa.array(ends), structs)],
                ["row_id", "doc_id", "lang", "fold", "n_tokens", "score", "held", "open"],
            )
            place += n


def _listed(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The documents with a listed id. A map of fixed size keeps most others from being shuffled; the join is exact."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_LOG2))
    words = trusted_ids.select(F.floor(spot / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << MAP_LOG2}) % 64 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_LOG2 - 6, np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    marked = docs.select("doc_id", "text", spot.alias("spot"))
    return map_arrow(marked, "doc_id long, text string", _in_map, shared).join(trusted_ids.hint("merge"), "doc_id", "left_semi")


def _in_map(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
    for batch in batches:
        yield batch.select(["doc_id", "text"]).filter(pa.array(bits[batch.column(2).to_numpy()]))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, path: str | None = None, folds: int = 0) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, keep) per row of ``docs``.

    Trusted are the documents that ``labels`` gives quality 1. ``threshold`` is the quantile of the perplexities of trusted
    documents in the row's language, or of all trusted ones where the language has none; null languages are a language.
    Null and empty texts have no tokens, a null perplexity and are not kept. Without any trusted document all other rows are
    kept. Rows without an id are scored, but never trusted; repeated rows are scored each; an empty table gives an empty table.
    With ``folds`` (two or more) the perplexities of trusted documents, and so the thresholds, are those of a model without
    their fold, as all other documents are scored by a model that has not seen them; without, the one model scores all.
    """
    path = path or tokenizer.vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    trusted_ids = written(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    model = train(_listed(rows.where("doc_id is not null and text is not null").select("doc_id", "text"), trusted_ids), path, folds)
    shared = docs.sparkSession.sparkContext.broadcast((model.back_off, model.unigram, model.keys, model.bonus))
    schema = "row_id long, doc_id long, lang string, fold int, n_tokens long, score double, held double, open array<struct<key: bigint, n: bigint>>"
    scored = written(map_arrow(rows.withColumn("fold", fold_of("text", folds)), schema, _score, path, shared), "scores")
    looked_up = scored.select("row_id", "fold", F.inline("open")).join(model.shards.select("key", "bonus"), "key")
    gained = lambda place: F.sum(F.col("n") * F.get("bonus", place).cast("double"))
    more = looked_up.groupBy("row_id").agg(gained(F.lit(folds)).alias("more"), gained(F.col("fold")).alias("held_more"))
    own = F.when(F.col("trusted"), F.col("held") + F.coalesce("held_more", F.lit(0.0)))
    total = F.coalesce(own, F.col("score") + F.coalesce("more", F.lit(0.0)))
    found = (
        scored.drop("open").join(more, "row_id", "left").join(trusted_ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
        .select("doc_id", "lang", "n_tokens", F.when(F.col("n_tokens") > 0, F.exp(-total / F.col("n_tokens"))).alias("perplexity"), F.coalesce("trusted", F.lit(False)).alias("trusted"))
    )
    found = written(found, "perplexities")
    good = found.where("trusted and perplexity is not null")
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(ACCURACY)).alias("threshold")
    by_language = written(good.groupBy(F.col("lang").alias("its")).agg(limit), "thresholds")
    overall = good.agg(limit).first().threshold
    judged = found.join(by_language, F.col("lang").eqNullSafe(F.col("its")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", keep.alias("keep"))
