"""Split aggregates, quantiles and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline import values as V
from plumbline.functions.draws import draw_values, first_value, poisson_weights
from plumbline.session import stored, work_dir

CHUNK = 1_000_000              # positions of a group whose values one task holds (8 MB a column)
DRAWS, COUNTED = 1 << 16, 1 << 22   # draws made at a time; counters held at a time
VALUES = PERIOD = 1 << 32      # values a draw can have; draws after which the protocol's generator repeats


def metric_summary(long_scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over non-null raws, count and null count per group."""
    return long_scores.groupBy(*by).agg(
        F.avg("raw").alias("mean"),
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("raw").isNull()).alias("null_count"),
    )


def missingness(long_scores: DataFrame, by: Sequence[str], branches: Sequence[str] = V.BRANCHES) -> DataFrame:
    """One zero-filled count column per empty-set branch."""
    counts = [F.count_if(F.col("branch") == b).alias(b) for b in branches]
    return long_scores.groupBy(*by).agg(*counts)


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation on n-1; null for a group without values.

    Read off at their positions in the sorted group, which no task holds as a whole.
    """
    rows = df.select(F.struct(*([F.col(c) for c in by] or [F.pmod(F.xxhash64(F.col(value)), F.lit(1)).alias("_")])).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy("g").agg(F.count("v").alias("n"))
    placed = with_positions(rows.filter(F.col("v").isNotNull()), ["g"], "v").join(sizes, "g")
    at, found = {n: F.lit(p) * (F.col("n") - 1) for n, p in points.items()}, []
    for name, place in at.items():
        for end, rounded in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.max(F.when(F.col("p") == rounded, F.col("v"))).alias(f"{name}_{end}"))
    picked = placed.groupBy("g", "n").agg(*found).drop("n")
    share = {n: place - F.floor(place) for n, place in at.items()}
    return sizes.join(picked, "g", "left").select(*[F.col(f"g.`{c}`").alias(c) for c in by], *[
        ((1 - share[n]) * F.col(f"`{n}_low`") + share[n] * F.col(f"`{n}_high`")).alias(n) for n in points
    ])


def spread(df: DataFrame, by: Sequence[str], value: str, threshold: float = V.ACCEPTANCE_GAIN) -> DataFrame:
    """Count, mean, sample SD, min, max, range and the acceptance threshold over the SD."""
    v = F.col(value)
    return (
        df.groupBy(*by)
        .agg(
            F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
            F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        )
        .withColumn("range", F.col("maximum") - F.col("minimum"))
        .withColumn("threshold_over_sd", F.lit(threshold) / F.nullif(F.col("sd"), F.lit(0.0)))
    )


def confusion(df: DataFrame, by: Sequence[str], actual: Column, predicted: Column) -> DataFrame:
    """True/false positives and negatives with precision, recall and F1 of one class."""
    return (
        df.groupBy(*by)
        .agg(
            F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
            F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"),
        )
        .withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    )


def breakdowns(df: DataFrame, dimensions: Sequence[str], value: str) -> DataFrame:
    """Mean and count per single dimension and in total, in one pass over grouping sets."""
    keys = [F.col(d) for d in dimensions]
    return (
        df.groupingSets([[k] for k in keys] + [[]], *keys)
        .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping_id"))
    )


# --- bootstrap -------------------------------------------------------------------------------------

def bootstrap_ci(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    order: Sequence[str],
    resamples: int = V.BOOTSTRAP_RESAMPLES,
    seed: int = V.BOOTSTRAP_SEED,
    alpha: float = V.BOOTSTRAP_ALPHA,
    chunk: int = CHUNK,
) -> DataFrame:
    """Percentile interval of the mean per group: ``mean, lower, upper, n``.

    Draw number d depends on seed and d alone, so any task can make any part of the stream. The sorted values of a group are cut
    into chunks by position, one task each; a chunk counts how often a resample draws each of its positions and sums its values
    by these counts. The generator repeats after PERIOD draws, so a chunk makes at most that many, however large the group: the
    work grows with the chunks. The sums of a resample are added in the order of its chunks, so the interval does not depend on
    partitions.
    """
    rows = df.filter(F.col(value).isNotNull())
    found = bootstrap_cis(rows, by, {"value": value}, order, resamples, seed, alpha, chunk, "_column")
    return found.select(*by, "mean", "lower", "upper", "n")


def bootstrap_cis(
    df: DataFrame,
    by: Sequence[str],
    values: dict[str, str],
    order: Sequence[str],
    resamples: int = V.BOOTSTRAP_RESAMPLES,
    seed: int = V.BOOTSTRAP_SEED,
    alpha: float = V.BOOTSTRAP_ALPHA,
    chunk: int = CHUNK,
    name: str = "metric",
) -> DataFrame:
    """``bootstrap_ci`` of several columns, named by ``values``, in one pass: ``by..., <name>, mean, lower, upper, n``.

    No value may be null, so all columns of a group have the same size and share their draws. Rows are sorted once, by ``order``
    and then by the values.
    """
    if not (isinstance(resamples, int) and resamples > 0):
        raise ValueError("resamples must be a positive integer")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    columns = [F.col(c).cast("double") for c in values.values()]
    rows = df.select(
        # without groups the single key must not be a literal, or the joins on it turn into products
        F.struct(*([F.col(c) for c in by] or [F.pmod(F.xxhash64(columns[0]), F.lit(1)).alias("_")])).alias("g"),
        F.array(*columns).alias("v"), F.struct(*order, *[c.alias(f"_value{i}") for i, c in enumerate(columns)]).alias("o"),
    )
    placed = with_positions(rows, ["g"], "o").select("g", "v", "p")
    averages = F.array(*[F.avg(F.col("v")[i]) for i in range(len(values))])
    sizes = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), averages.alias("means"))
    names = F.array(*[F.lit(n) for n in values])
    means = _means(placed, sizes.select("g", "n"), len(values), resamples, seed, chunk)
    edges = means.groupBy("g", "i").agg(
        F.percentile("m", F.lit(alpha / 2)).alias("lower"),
        F.percentile("m", F.lit(1 - alpha / 2)).alias("upper"),
    )
    return sizes.join(edges, "g").select(
        *[F.col(f"g.{c}").alias(c) for c in by], F.get(names, F.col("i")).alias(name), F.get("means", F.col("i")).alias("mean"), "lower", "upper", "n"
    )


#: Resampled weights made at a time, and groups whose sums a task holds before it hands them on.
WEIGHTS, HELD_GROUPS = 1 << 20, 1 << 10


def poisson_bootstrap_ci(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    key: Sequence[str],
    resamples: int = V.BOOTSTRAP_RESAMPLES,
    seed: int = V.BOOTSTRAP_SEED,
    alpha: float = V.BOOTSTRAP_ALPHA,
) -> DataFrame:
    """Percentile interval of the mean per group by mergeable resamples: ``mean, lower, upper, n``.

    A row counts in a resample as often as a Poisson(1) draw says that depends on the seed, the resample and the row's ``key``
    alone. So a task folds its rows to one weighted sum and one weight per resample and group, and the sums of tasks add up:
    no positions, no sorting, no vector that travels; the work is rows times resamples and the shuffle tasks times groups times
    resamples, whatever the size of a group. The draws of all rows do not add up to n as those of ``bootstrap_ci`` do; a resample
    is the ratio of its two sums, which has the same spread up to terms of order 1/n, so the edges of the two intervals differ by
    the noise of R resamples (about 4 % of the width for 1,000) and by less than the width over the root of n. Small groups, below
    a few dozen rows, are better off with ``bootstrap_ci``. The caller chooses; nothing switches by size.

    Null values are left out; rows of one group with an equal key are drawn together. A group without values gives no row.
    """
    if not (isinstance(resamples, int) and resamples > 0):
        raise ValueError("resamples must be a positive integer")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    named = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    rows = df.filter(F.col(value).isNotNull()).select(
        F.struct(*([F.col(c) for c in by] or [F.pmod(F.xxhash64(F.col(value)), F.lit(1)).alias("_")])).alias("g"),
        F.col(value).cast("double").alias("v"), F.sha2(named, 256).alias("key"),
    )
    hexes = lambda at: F.conv(F.substring("key", at, 8), 16, 10).cast("long")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    schema = T.StructType([rows.schema["g"], T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("weights", T.ArrayType(T.LongType()))])
    folded = rows.select("g", "v", hexes(1).alias("k1"), hexes(9).alias("k2")).mapInArrow(partial(_poisson_sums, resamples), schema)
    both = folded.select("g", F.posexplode(F.arrays_zip("sums", "weights")).alias("r", "x")).groupBy("g", "r").agg(
        F.sum("x.sums").alias("s"), F.sum("x.weights").alias("w")
    )
    edges = both.filter("w > 0").groupBy("g").agg(
        F.percentile(F.col("s") / F.col("w"), F.lit(alpha / 2)).alias("lower"),
        F.percentile(F.col("s") / F.col("w"), F.lit(1 - alpha / 2)).alias("upper"),
    )
    return sizes.join(edges, "g").select(*[F.col(f"g.{c}").alias(c) for c in by], "mean", "lower", "upper", "n")


def _poisson_sums(resamples: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums and weights per group and resample over the rows of a task."""
    held: dict[tuple, tuple] = {}
    kind = None

    def fold() -> pa.RecordBatch:
        sums, weights = zip(*(h[1:] for h in held.values()))
        groups = pa.array([h[0] for h in held.values()], kind)
        return pa.RecordBatch.from_arrays([groups, pa.array(sums, pa.list_(pa.float64())), pa.array(weights, pa.list_(pa.int64()))], ["g", "sums", "weights"])

    for batch in batches:
        kind = batch.schema.field(0).type
        groups = batch.column(0).to_pylist()
        found: dict[tuple, int] = {}
        codes = np.fromiter((found.setdefault(tuple(g.values()), len(found)) for g in groups), np.int64, len(groups))
        order = np.argsort(codes, kind="stable")
        v, k1, k2 = (batch.column(i).to_numpy()[order] for i in (1, 2, 3))
        step = max(1, WEIGHTS // resamples)
        ends = np.searchsorted(codes[order], np.arange(len(found)), "right")
        for (name, code), end in zip(found.items(), ends):
            start = int(ends[code - 1]) if code else 0
            if name not in held:
                if len(held) >= HELD_GROUPS:
                    yield fold()
                    held.clear()
                held[name] = (groups[order[start]], np.zeros(resamples), np.zeros(resamples, np.int64))
            _, sums, weights = held[name]
            for at in range(start, int(end), step):
                drawn = poisson_weights(k1[at:min(at + step, end)], k2[at:min(at + step, end)], resamples)
                sums += v[at:min(at + step, end)] @ drawn
                weights += drawn.sum(axis=0, dtype=np.int64)
    if held:
        yield fold()


def _means(placed: DataFrame, sizes: DataFrame, width: int, resamples: int, seed: int, chunk: int) -> DataFrame:
    """(g, i, m): the mean of every resample of column i of every group."""
    keyed = placed.select("g", F.floor(F.col("p") / chunk).alias("c"), "p", "v")
    # the size of the group goes ahead of the rows of each chunk
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk)))
    heads = sizes.select("g", chunks.alias("c"), F.lit(-1).cast("long").alias("p"), F.array_repeat(F.col("n").cast("double"), width).alias("v"))
    # a number of partitions keeps them from being joined to few by their bytes: the work of a chunk is in its draws
    dealt = keyed.unionByName(heads).repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "c")
    dealt = dealt.sortWithinPartitions("g", "c", "p")
    schema = T.StructType([
        placed.schema["g"], T.StructField("c", T.LongType()), T.StructField("r", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType())),
    ])
    parts = dealt.select("g", "c", "v").mapInArrow(partial(_chunk_sums, width, resamples, seed, chunk), schema)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda x: x["s"])
    summed = parts.select("g", "c", "r", F.posexplode("s").alias("i", "s")).groupBy("g", "i", "r").agg(
        F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x).alias("s")
    )
    return summed.join(sizes, "g").select("g", "i", (F.col("s") / F.col("n")).alias("m"))


def _chunk_sums(width: int, resamples: int, seed: int, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all resamples over each chunk; the rows of a chunk come one after the other, in order."""
    held: list[np.ndarray] = []
    key = None

    def summed() -> pa.RecordBatch:
        g, c = key
        values = np.concatenate(held)
        sums = resampled_sums(values[1:], int(values[0, 0]), c * chunk, resamples, seed)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(resamples + 1) * width, pa.int32()), pa.array(sums.reshape(-1)))
        arrays = [pa.array([g.as_py()] * resamples, g.type), pa.array(np.full(resamples, c)), pa.array(np.arange(resamples)), lists]
        return pa.RecordBatch.from_arrays(arrays, ["g", "c", "r", "s"])

    for batch in batches:
        groups, chunks, codes = batch.column(0), batch.column(1).to_numpy(), _codes(batch.column(0))
        values = batch.column(2).flatten().to_numpy().reshape(-1, width)
        new = (codes[1:] != codes[:-1]) | (chunks[1:] != chunks[:-1])
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), new]))
        for start, end in zip(starts, [*starts[1:], len(codes)]):
            found = (groups[int(start)], int(chunks[start]))
            if found != key:
                if key is not None:
                    yield summed()
                held, key = [], found
            held.append(values[start:end])
    if key is not None:
        yield summed()


def _codes(groups: pa.StructArray) -> np.ndarray:
    """One number per different struct."""
    codes = np.zeros(len(groups), np.int64)
    for column in groups.flatten():
        encoded = column.dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(), return_inverse=True)[1]
    return codes


def resampled_sums(values: np.ndarray, n: int, offset: int, resamples: int, seed: int) -> np.ndarray:
    """Sums per resample and column over the values at positions ``offset`` and up of a group of ``n``.

    Resample r has the draws r * n to (r + 1) * n - 1. Where all draws are more than PERIOD, the starts of the resamples cut the
    period into arcs; every arc is summed once and a resample is a run of arcs, with whole periods for a group above PERIOD.
    """
    size, wraps = len(values), n * resamples > PERIOD
    bounds = np.arange(resamples + 1, dtype=object) * n
    cuts = np.unique(np.array([0, PERIOD, *(b % PERIOD for b in bounds)], np.int64)) if wraps else np.array(bounds, np.int64)
    # the draws of a position are a run of the generator's values, so a chunk's are those between two of them
    low, high = first_value(offset, n), first_value(offset + size, n)
    arcs = np.zeros((len(cuts) - 1, values.shape[1]))
    per = max(1, COUNTED // size)
    for at in range(0, len(arcs), per):
        last = min(at + per, len(arcs))
        hits, first = [np.empty(0, np.int64)], int(cuts[at])
        while first < cuts[last]:
            many = int(min(DRAWS, cuts[last] - first))
            drawn, number = draw_values(seed, first, many), None
            if last - at > 1:
                number = np.repeat(np.arange(last - at) * size, np.diff(np.clip(cuts[at:last + 1], first, first + many)))
            if size < n:
                hit = (drawn >= low) & (drawn < high)
                drawn, number = drawn[hit], None if number is None else number[hit]
            places = (drawn * (n / VALUES)).astype(np.int64) - offset
            hits.append(places if number is None else places + number)
            first += many
        found = np.concatenate(hits)
        if len(found) < size // 4:
            arcs[at] = values[found].sum(axis=0)
        else:
            arcs[at:last] = np.bincount(found, minlength=(last - at) * size).reshape(last - at, size) @ values
    if not wraps:
        return arcs
    whole, out = arcs.sum(axis=0), np.empty((resamples, values.shape[1]))
    for r in range(resamples):
        start, end = (int(np.searchsorted(cuts, b % PERIOD)) for b in bounds[r:r + 2])
        run = arcs[start:end].sum(axis=0) if start <= end else arcs[start:].sum(axis=0) + arcs[:end].sum(axis=0)
        rest = int(cuts[end] - cuts[start]) % PERIOD
        out[r] = run + (n - rest) // PERIOD * whole
    return out


def with_positions(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Zero-based position ``p`` inside each group without moving a group into one task.

    Range-partitioned and sorted once into the shared folder; positions are the row's place in its
    partition plus the rows of the same group in earlier partitions.
    """
    ranged = stored(rows.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("part", F.spark_partition_id()), "positions")
    counts = ranged.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("c"))
    earlier = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    local = F.row_number().over(W.partitionBy(*by, "part").orderBy(order)) - 1
    return ranged.withColumn("local", local).join(offsets, [*by, "part"]).withColumn(
        "p", F.col("offset") + F.col("local")
    ).drop("local", "offset", "part")


def split_aggregate(scores: DataFrame, metrics: Sequence[str], strict: bool = False, interval=bootstrap_ci, **options) -> DataFrame:
    """Composite and metric rows per (domain, split): mean, interval, count, null count, branch counts.

    ``interval`` is ``bootstrap_ci`` or, for groups of many millions of cases, ``poisson_bootstrap_ci``.

    ``strict`` asks for exactly one (domain, split) in the input.
    """
    from plumbline.operators.metrics import to_long

    if strict and scores.select("domain", "split").distinct().limit(2).count() != 1:
        raise ValueError("the result set must hold exactly one domain and split")
    composites = [c for c in ("deterministic_prqs", "partial_full_prqs_lower_bound") if c in scores.columns]
    keys = ["domain", "split", "metric"]
    # scored once, then read by every aggregate below
    scores = stored(scores, "split-scores")
    metric_rows = to_long(scores.drop(*composites), metrics).select(*keys, "case_id", "raw", "branch")
    rows = metric_rows
    if composites:
        stacked = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("raw")) for c in composites])
        composite_rows = scores.select("domain", "split", "case_id", F.inline(stacked)).withColumn("branch", F.lit("standard"))
        rows = metric_rows.unionByName(composite_rows.select(metric_rows.columns))
    whole: list[str] = []
    if interval is bootstrap_ci:
        # scores that every case has share one sorted pass, and their draws
        names = [*metrics, *composites]
        given = scores.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
        whole = [c for c in names if not given[c]]
    parts = []
    if whole:
        parts.append(bootstrap_cis(scores, keys[:2], {c: c for c in whole}, ["case_id"], **options))
    if len(whole) < len(metrics) + len(composites):
        parts.append(interval(rows.filter(~F.col("metric").isin(whole)), keys, "raw", ["case_id"], **options))
    ci = reduce(DataFrame.unionByName, [p.select(*keys, "lower", "upper") for p in parts])
    counts = missingness(rows, keys).select(
        *keys, F.create_map(*[x for b in V.BRANCHES for x in (F.lit(b), F.col(b))]).alias("missingness")
    )
    return metric_summary(rows, keys).join(ci, keys, "left").join(counts, keys)


def paired(prior: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Current with prior value per case: full outer, so unpaired cases stay visible (``pair_ok`` false)."""
    p = prior.select("case_id", F.col(value).alias("prior"))
    c = current.select("case_id", F.col(value).alias("current"))
    return p.join(c, "case_id", "full_outer").select(
        "case_id", "prior", "current",
        (F.col("current") - F.col("prior")).alias("delta"),
        (F.col("prior").isNotNull() & F.col("current").isNotNull()).alias("pair_ok"),
    )


def paired_delta_ci(prior: DataFrame, current: DataFrame, value: str, interval=bootstrap_ci, **options) -> DataFrame:
    """Bootstrap interval of paired deltas, by ``bootstrap_ci`` or ``poisson_bootstrap_ci``; refuses sets that do not pair up."""
    path = work_dir(prior.sparkSession, "pairs")
    paired(prior, current, value).write.parquet(path)
    pairs = prior.sparkSession.read.parquet(path)
    if not pairs.filter(~F.col("pair_ok")).isEmpty():
        raise ValueError("prior and current results must hold the same cases")
    ci = interval(pairs, [], "delta", ["case_id"], **options)
    return ci.withColumnRenamed("mean", "mean_delta")


def patch_gate(delta_ci: DataFrame, gain: float = V.ACCEPTANCE_GAIN) -> DataFrame:
    """Accept a change only with enough mean gain and a paired interval above zero."""
    return delta_ci.withColumn("accepted", (F.col("mean_delta") >= gain) & (F.col("lower") > 0))
