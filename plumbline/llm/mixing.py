"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens raised to an exponent in [0, 1] and normalised: one leaves the shares, zero makes
all equal. The exponent is the largest whose weights reach the target entropy, unless it would repeat a source more often than
the limit allows; then it is the smallest that keeps the limit. A source with weight w gets w times the budget in tokens:
whole epochs of all its documents, and of a last epoch the first blocks of a keyed permutation, whose last block is cut within.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import written

#: Blocks of a source (a power of two): the permutation orders blocks by a keyed hash, then documents within the block.
BLOCKS = 4096
#: Target entropy as a share of that of equal weights; most epochs of a source; exponents tried per round of the search.
EVENNESS, EPOCHS, SPLITS, ROUNDS = 0.97, 4.0, 32, 5
TOKENS = "coalesce(regexp_count(text, '\\\\S+'), 0)"


def _shares(docs: DataFrame) -> DataFrame:
    """(source, tokens) per source with tokens; a null source is a source of its own."""
    return docs.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")


def exponent(totals: DataFrame, evenness: float = EVENNESS, epochs: float = EPOCHS, budget: float = 1.0) -> float:
    """The exponent, searched by intervals; each round is one aggregate over the table of sources."""
    everything = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not everything.n:
        return 1.0
    share, target = F.col("tokens") / everything.t, evenness * math.log(everything.n)

    def measure(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and most epochs at each exponent."""
        sums = []
        for i, a in enumerate(exponents):
            power = F.pow(share, F.lit(a))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"l{i}"), F.max(power / F.col("tokens")).alias(f"m{i}")]
        r = totals.agg(*sums).first()
        return [(math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"], r[f"m{i}"] / r[f"z{i}"] * budget * everything.t) for i, a in enumerate(exponents)]

    def search(good) -> tuple[float, float]:
        """The interval in which ``good`` turns, entropy and epochs both falling with the exponent; (1, 1) if it never does."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / SPLITS for i in range(SPLITS + 1)]
            marks = [good(*m) for m in measure(grid)]
            if all(m == marks[0] for m in marks):
                return (grid[-1], grid[-1]) if marks[0] else (grid[0], grid[0])
            turn = marks.index(not marks[0])
            lo, hi = grid[turn - 1], grid[turn]
        return lo, hi

    even = search(lambda entropy, most: entropy >= target - 1e-12)[0]
    rare = search(lambda entropy, most: most > epochs * (1 + 1e-12))
    return max(even, rare[1] if rare[1] > 0 else 0.0)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """With the tokens, the block and the two hashes that order blocks and the documents within."""
    block = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(BLOCKS))
    return (
        docs.withColumn("tokens", F.expr(TOKENS).cast("long")).withColumn("block", block)
        .withColumn("block_order", F.xxhash64("source", "block", F.lit(seed + 1))).withColumn("order", F.xxhash64("doc_id", "text", F.lit(seed + 2)))
    )


def mixing_plan(docs: DataFrame, evenness: float = EVENNESS, epochs: float = EPOCHS, budget: float = 1.0, seed: int = 7) -> tuple[DataFrame, float]:
    """One row per source: tokens, weight, whole epochs, and the last (block, document) of the permutation's part epoch.

    ``budget`` is a multiple of the tokens of all documents. The part epoch ends with the document that reaches the budget.
    """
    keyed = written(_keyed(docs.select("doc_id", "text", "source"), seed).select("source", "tokens", "block_order", "order"), "mix-keys")
    totals = written(_shares(keyed), "mix-totals")
    alpha = exponent(totals, evenness, epochs, budget)
    everything = totals.agg(F.sum("tokens").alias("t")).first().t or 1.0
    power = F.pow(F.col("tokens") / everything, F.lit(alpha))
    norm = totals.agg(F.sum(power).alias("norm")).first().norm or 1.0
    want = F.col("weight") * everything * budget
    whole = F.floor(want / F.col("tokens") + 1e-9)
    plan = totals.withColumn("weight", power / norm).select(
        "source", "tokens", "weight", whole.alias("whole"), F.greatest(F.lit(0.0), want - whole * F.col("tokens")).alias("part")
    )
    plan = written(plan, "mix-plan")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    blocks = keyed.groupBy("source", "block_order").agg(F.sum("tokens").alias("block_tokens"))
    over = Window.partitionBy("source").orderBy("block_order")
    run = blocks.withColumn("upto", F.sum("block_tokens").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    p = plan.select("source", "part")
    cut = run.join(p, same(run, p)).where("upto >= part and upto - block_tokens < part").select(
        run["source"], run["block_order"], (F.col("part") - F.col("upto") + F.col("block_tokens")).alias("left")
    )
    cut = written(cut, "mix-cuts")
    inner = keyed.join(cut, same(keyed, cut) & (keyed["block_order"] == cut["block_order"])).select(
        keyed["source"], keyed["block_order"], keyed["order"], "tokens", "left"
    )
    inside = Window.partitionBy("source").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        inner.withColumn("upto", F.sum("tokens").over(inside)).where("upto >= left")
        .groupBy("source").agg(F.min("block_order").alias("cut_block"), F.min("order").alias("cut_order"))
    )
    return written(plan.join(last, same(plan, last), "left").select(plan["*"], "cut_block", "cut_order"), "mix-sources"), alpha


def mix(docs: DataFrame, evenness: float = EVENNESS, epochs: float = EPOCHS, budget: float = 1.0, seed: int = 7) -> DataFrame:
    """(row, tokens, weight, copies): each row as a struct and how often the mixture takes it.

    Tokens are white-space delimited words. A null source is a source of its own; null and empty texts have no tokens: they
    count no budget and come once per whole epoch (once where their source has no tokens at all). Rows that are equal in id,
    text and source are taken alike. An empty table gives an empty table.
    """
    plan, _ = mixing_plan(docs, evenness, epochs, budget, seed)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = _keyed(packed.select("row", "row.doc_id", "row.text", "row.source"), seed).select("row", "source", "tokens", "block_order", "order")
    named = plan.withColumnRenamed("source", "plan_source").drop("tokens", "part")
    joined = keyed.join(named, keyed["source"].eqNullSafe(named["plan_source"]), "left")
    before = F.struct("block_order", "order") <= F.struct("cut_block", "cut_order")
    more = F.coalesce((before & (F.col("tokens") > 0)).cast("long"), F.lit(0))
    return joined.select("row", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(F.col("whole") + more, F.lit(1)).alias("copies"))
