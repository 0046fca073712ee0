"""Joins against dimensions, reconciliation and referential checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM_MAX_ROWS = 200_000
DIM_MAX_BYTES = 64 << 20
SALTS = 32
HEAVY, HEAVY_ROWS = 256, 10_000


def is_small(dim: DataFrame, max_rows: int = DIM_MAX_ROWS, max_bytes: int = DIM_MAX_BYTES) -> bool:
    """Measured size check: reads at most ``max_rows + 1`` rows and returns two numbers."""
    row = (
        dim.limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("b"))
        .first()
    )
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, salts: int = SALTS) -> DataFrame:
    """Equi-join that spreads the heavy keys of ``left`` over ``salts`` tasks and copies only their rows of ``right``.

    A key is heavy if it holds more than HEAVY_ROWS rows and more than one in HEAVY of all rows of ``left``. So there are fewer
    than HEAVY heavy keys and their list can always be broadcast. Rows with a null key have no partner; they are spread too. The
    salt is a hash of the whole left row, so a recomputed task salts its rows the same way.
    """
    keys = [F.col(f"`{c}`") for c in on]
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg(F.sum("_n") / HEAVY).scalar()
    heavy = F.broadcast(counts.filter((F.col("_n") > HEAVY_ROWS) & (F.col("_n") > share)).select(*keys, F.lit(True).alias("_heavy")))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    loose = reduce(or_, [k.isNull() for k in keys], F.coalesce("_heavy", F.lit(False)))
    salted = left.join(heavy, list(on), "left").withColumn("_salt", F.when(loose, spread).otherwise(0)).drop("_heavy")
    numbers = F.sequence(F.lit(0), F.when(F.col("_heavy"), salts - 1).otherwise(0))
    copies = right.join(heavy, list(on), "left").withColumn("_salt", F.explode(numbers)).drop("_heavy")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def hashed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join of two large tables on texts that begin alike, inner or left: a hash of the key is compared before the key itself.

    A sort looks at the first eight bytes first; ids like ``case-000000001`` all have the same.
    """
    keyed = [t.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in on])) for t in (left, right)]
    return keyed[0].join(keyed[1], ["_hash", *on], how).drop("_hash")


def counted_join(left: DataFrame, right: DataFrame, on: Sequence[str], count: str) -> DataFrame:
    """Inner equi-join with one row of ``right`` per key that tells, in column ``count``, how many rows of ``left`` have the key.

    Rows of ``right`` that stand for more than one in HEAVY of all are fewer than HEAVY and broadcast; the rows of ``left`` that
    they do not take meet the others in a join without heavy keys. ``right`` is read three times, ``left`` once. Keys must not be null.
    """
    share = right.agg(F.sum(count) / HEAVY).scalar()
    body = [c for c in right.columns if c not in (*on, count)]
    packed = right.select(*on, F.col(count).alias("_n"), F.struct(*body).alias("_row"))
    heavy = F.broadcast(packed.filter(F.col("_n") > share).drop("_n"))
    met = left.join(heavy, list(on), "left")
    light = packed.filter(F.col("_n") <= share).select(*on, F.col("_row").alias("_light"))
    # a row that the heavy keys took goes to a key of its own, which no row of the right side has
    apart = F.when(F.col("_row").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)))
    joined = met.withColumn("_apart", apart).join(light.withColumn("_apart", F.lit(0).cast("long")), [*on, "_apart"], "left")
    row = F.coalesce("_row", "_light")
    return joined.filter(row.isNotNull()).select(*left.columns, *[row[c].alias(c) for c in body])


def dim_join(
    left: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "left", small: bool | None = None
) -> DataFrame:
    """Join a fact table with a dimension: broadcast below the measured limit, salted shuffle above it.

    ``how`` may be inner, left, left_semi or left_anti; ``small`` is a size check already made.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if is_small(dim) if small is None else small:
        return left.join(F.broadcast(dim), keys, how)
    return salted_join(left, dim, keys, how)


def reconcile(cases: DataFrame, payloads: DataFrame, sequence: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Cases with their last payload, and one report row on ids that lack a partner.

    ``payloads`` needs ``case_id`` and an order column; the largest order value wins. The report has the
    two counts and the first three ids of each side; ``matched`` tells whether both sides agree.
    """
    body = [c for c in payloads.columns if c not in ("case_id", sequence)]
    last = payloads.groupBy("case_id").agg(
        F.max_by(F.struct(*body), F.col(sequence)).alias("payload")
    )
    both = cases.withColumn("has_case", F.lit(True)).join(
        last.withColumn("has_payload", F.lit(True)), "case_id", "full_outer"
    )
    missing, extra = F.col("has_payload").isNull(), F.col("has_case").isNull()
    report = both.agg(
        F.count_if(missing).alias("missing_count"),
        F.count_if(extra).alias("extra_count"),
        _first_ids(both.filter(missing)).alias("missing_first"),
        _first_ids(both.filter(extra)).alias("extra_first"),
    ).withColumn("matched", (F.col("missing_count") == 0) & (F.col("extra_count") == 0))
    scored = both.filter(~missing & ~extra).select(*cases.columns, "payload.*")
    return scored, report


def _first_ids(ids: DataFrame, n: int = 3) -> Column:
    """The first ids in id order as a scalar array (a top-n, not a full collect)."""
    top = ids.select("case_id").orderBy("case_id").limit(n)
    return top.agg(F.array_sort(F.collect_list("case_id"))).scalar()


def unknown_references(references: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """References without a partner in the known pool."""
    return dim_join(references, known.select(*on).distinct(), on, "left_anti")
