"""A manifest of rows as a tree of digests: leaves per row, runs of sixteen per node, a tree per group and one over the groups.

Level by level, windows over the runs give a node its siblings: the digests at the fixed offsets 1 to 15 before and behind it,
masked by its slot in the run and the run's length. The first row of a run hashes the run to the node of the next level. A run is
a window's whole partition, so a group of any size is many small ones. Downwards, every node's siblings join to the proofs of
the nodes below it, by group and place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import written
from plumbline.llm.order import placed

RUN, DIGEST = 16, 64
#: Name of the one group of the tree over the groups.
TOP = ""


def field(value: Column) -> Column:
    """A value as text that parts it from its neighbours: its bytes in UTF-8, a colon, the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def _run() -> Column:
    return F.floor(F.col("place") / RUN)


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (key, place, n, digest, ...) with ``slot`` and ``siblings``, the digests of the others of the run in order."""
    window = Window.partitionBy("key", "run").orderBy("place")
    slot = F.col("place") % RUN
    length = F.least(F.lit(RUN), F.col("n") - F.col("place") + slot)
    before = [F.when(slot >= i, F.lag("digest", i).over(window)) for i in range(RUN - 1, 0, -1)]
    behind = [F.when(slot + i < length, F.lead("digest", i).over(window)) for i in range(1, RUN)]
    return nodes.withColumn("run", _run()).withColumn("slot", slot.cast("int")).withColumn("siblings", F.concat_ws("", *before, *behind))


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes above: the first child of each run hashes the run; a node without others in its whole level goes up as it is."""
    digest = F.when(F.col("n") == 1, F.col("digest")).otherwise(hashed(F.col("digest"), F.col("siblings")))
    return nodes.where("slot = 0").select("key", F.col("run").alias("place"), F.ceil(F.col("n") / RUN).alias("n"), digest.alias("digest"))


def _step() -> Column:
    """The part of a proof that a node adds: nothing where it is alone in its level."""
    return F.when(F.col("n") > 1, F.array(F.struct("slot", "siblings"))).otherwise(F.array().cast("array<struct<slot:int,siblings:string>>"))


def _levels(leaves: DataFrame, purpose: str) -> tuple[list[DataFrame], DataFrame]:
    """The written levels above the leaves, each with its siblings, but for the last, which has one node (key, digest) a group."""
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 1
    above, levels = _parents(_with_siblings(leaves)), []
    while most > RUN:
        levels.append(written(_with_siblings(above), purpose))
        above, most = _parents(levels[-1]), -(-most // RUN)
    return levels, written(above.select("key", "digest"), purpose)


def _proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, run, proof, ...) for the runs of the leaves, from the proofs of the groups' last nodes in ``tops``."""
    proofs = tops.withColumn("run", F.lit(0).cast("long"))
    for level in reversed(levels):
        here = level.select("key", "run", F.col("place").alias("below"), _step().alias("step"))
        kept = [c for c in proofs.columns if c not in ("key", "run", "proof")]
        proofs = here.join(proofs, ["key", "run"]).select("key", F.col("below").alias("run"), F.concat("step", "proof").alias("proof"), *kept)
    return proofs


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    def up(held: Column, step: Column) -> Column:
        cut = step["slot"] * DIGEST
        return hashed(F.substr(step["siblings"], F.lit(1), cut), held, F.substr(step["siblings"], cut + 1, F.lit(RUN * DIGEST)))

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: step["siblings"])), 256)


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str], group: str = "source", order: str = "doc_id", presented: Mapping[str, Column] | None = None
) -> DataFrame:
    """(``order``, leaf, presented, proof, subroot, root) per row: its leaf digest, its way to the root and the roots.

    ``proof`` lists, from the leaf to the root, the row's slot in its run and the digests of the run's others; levels that hold
    one node only add nothing. ``presented`` is the leaf digest of the row with other values for some fields: ``fold`` it with the
    proof to see whether the root bears it out. It is the leaf itself if none are given.

    Rows of a group ascend by ``order``, nulls first, then by leaf; a null group is a group of its own, before the others. Null and
    empty values differ. Repeated rows are leaves each. Other columns are left out and do not count. An empty table gives an
    empty manifest. Groups may be of any number and size.
    """
    leaf = hashed(*[field(F.col(c)) for c in fields])
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # a dash comes before the equals sign
    shown = hashed(*[field((presented or {}).get(c, F.col(c))) for c in fields])
    rows = docs.select(key.alias("key"), F.col(order).alias("row_key"), leaf.alias("digest"), shown.alias("presented"))
    leaves = written(placed(rows, "key", ["row_key", "digest"], "leaves").drop("part"), "placed-leaves")
    levels, subroots = _levels(leaves, "nodes")
    groups = subroots.select(F.lit(TOP).alias("key"), F.col("key").alias("row_key"), "digest")
    tops = written(placed(groups, "key", ["row_key"], "groups").drop("part"), "placed-groups")
    top_levels, roots = _levels(tops, "top-nodes")
    top_proofs = _proofs(top_levels, roots.select("key", F.col("digest").alias("root"), F.array().cast("array<struct<slot:int,siblings:string>>").alias("proof")))
    of_groups = _with_siblings(tops).join(top_proofs, ["key", "run"])
    of_groups = written(of_groups.select(F.col("row_key").alias("key"), F.col("digest").alias("subroot"), "root", F.concat(_step(), "proof").alias("proof")), "group-proofs")
    found = _with_siblings(leaves).join(_proofs(levels, of_groups), ["key", "run"])
    return found.select(F.col("row_key").alias(order), F.col("digest").alias("leaf"), "presented", F.concat(_step(), "proof").alias("proof"), "subroot", "root")
