"""A trie of shared conversation prefixes, found by composable fingerprints: no rebuilt text is ever put together.

A run of turns has a fingerprint: the sum, modulo a prime, of each turn's digest times a power of a base, by its place. Such sums
compose: the fingerprint of a suffix is a difference of two sums, and moving it to another place is one product with a power. So
the fingerprint of every prefix of a rebuilt conversation, the head of one and the rest of another, comes from the running sums
of the stored turns by arithmetic on numbers. There are LANES sums with bases of their own, 124 bits together.

Prefixes of equal depth and fingerprint are one node. That is checked, not trusted: every member of a node must refer to a stored
turn of the same content (by SHA-256) and to the same parent node, which by induction means the same sequence. If one does not,
all fingerprints are made anew with other bases.

A conversation of any length is many pieces, the parts of a range sort; a node of any size is a few sums that tasks fold first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import map_arrow, written
from plumbline.llm.order import placed

#: The sums are taken modulo this prime, so products stay within 62 bits.
PRIME, LANES = (1 << 31) - 1, 4
#: Turns that a conversation may take from its base, and conversations of a base.
HEAD, FAMILY = 8, 5
#: Members whose ids are put together in a task before they meet those of other tasks.
PACK = 4096
#: Nodes of the shuffled join have at most one in SHARE of all looked-up rows; those above are fewer than SHARE and broadcast.
SHARE = 256
NODE = ["depth", "high", "low"]
TERMS = "conv_id long, part int, place long, n long, digest string, n_bytes long, " + ", ".join(f"w{k} long" for k in range(LANES))
_sums = [f"s{k}" for k in range(LANES)]


def bases(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "big") % (PRIME - 3) + 2 for k in range(LANES)]


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    found, left = np.ones(len(exponents), np.int64), exponents.copy()
    while left.any():
        found = np.where(left & 1, found * base % PRIME, found)
        base, left = base * base % PRIME, left >> 1
    return found


def _terms(batches: Iterator[pa.RecordBatch], bases: list[int]) -> Iterator[pa.RecordBatch]:
    """Adds each turn's term of the sums: its digest's lane times the base to the power of its place."""
    for batch in batches:
        place = batch.column(2).to_numpy()
        raw = np.frombuffer(bytes.fromhex("".join(batch.column(4).to_pylist())), ">u4").reshape(-1, 8)[:, :LANES].astype(np.int64)
        lanes = [pa.array((raw[:, k] % PRIME) * _powers(base, place) % PRIME) for k, base in enumerate(bases)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *lanes], [*batch.schema.names, *(f"w{k}" for k in range(LANES))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as runs of at most PACK ids of a node: (node, first id, the ids joined)."""
    for batch in batches:
        ids = batch.column(3).to_numpy()
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        starts = np.unique(np.concatenate((np.arange(0, len(ids), PACK), cuts))).astype(np.int64)
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in keys), pa.array(ids[starts]), pa.array(joined, pa.string())], [*NODE, "first_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sha) from packed runs in order: a running digest per node, so a node of any size takes a few bytes."""
    key, state = None, None
    for batch in batches:
        done = []
        for *here, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if here != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = here, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _sha_rows(done)
    if key is not None:
        yield _sha_rows([(*key, state.hexdigest())])


def _sha_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "sha"])


def member_digests(members: DataFrame) -> DataFrame:
    """(node, sha): the SHA-256 of each node's conv_ids in ascending order, comma-joined.

    Tasks pack runs of ids first. One digest is one sequence of bytes by its nature, so the packed runs of a node are read by one
    task, in order and one at a time.
    """
    packed = map_arrow(members.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id"), "depth long, high long, low long, first_id long, ids string", _packed)
    return map_arrow(packed.repartition(*NODE).sortWithinPartitions(*NODE, "first_id"), "depth long, high long, low long, sha string", _digests)


def _modulo(value: Column) -> Column:
    return F.pmod(value, F.lit(PRIME))


def _key(sums: list[Column]) -> list[Column]:
    """Four sums of 31 bits as two numbers."""
    return [(sums[0] * (1 << 31) + sums[1]).alias("high"), (sums[2] * (1 << 31) + sums[3]).alias("low")]


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, n, digest, n_bytes) per turn, in order: what stands for the turns' contents from here on."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    return placed(turns, "conv_id", ["turn", "digest"], "turns").select("conv_id", "part", "place", "n", "digest", "n_bytes")


def _running(turns: DataFrame, seed: int) -> DataFrame:
    """Turns with their terms w and running sums s: within a piece by a window, across pieces by offsets."""
    terms = written(map_arrow(turns, TERMS, _terms, bases(seed)), "terms")
    pieces = terms.groupBy("conv_id", "part").agg(*[F.sum(f"w{k}").alias(f"p{k}") for k in range(LANES)])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("conv_id", "part", *[F.coalesce(F.sum(f"p{k}").over(earlier), F.lit(0)).alias(f"o{k}") for k in range(LANES)])
    within = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = [_modulo(F.col(f"o{k}") + F.sum(f"w{k}").over(within)).alias(f"s{k}") for k in range(LANES)]
    return written(terms.join(offsets, ["conv_id", "part"]).select(*terms.columns, *sums), "running")


def _recipes(running: DataFrame) -> DataFrame:
    """One row per conversation: what its rebuilt form takes from where, and the sums that compose it."""
    h = head_length(F.col("conv_id"))
    own = running.groupBy("conv_id").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("place") + 1 == F.least(h, F.col("n")), F.col(s))).alias(f"own_{s}") for s in _sums]
    )
    entry = F.struct("place", F.col("conv_id").alias("ref_conv"), "digest", "n_bytes", *_sums, *[f"w{k}" for k in range(LANES)])
    heads = running.where((F.col("place") < HEAD) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(entry)).alias("head"))  # at most HEAD entries
    joined = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("head", 1, 0), F.array().cast(heads.schema["head"].dataType))
    taken = joined.withColumn("head", head).withColumn("taken", F.size("head"))
    last = lambda s: F.when(F.col("taken") > 0, F.element_at("head", F.greatest("taken", F.lit(1)))[s]).otherwise(F.lit(0))
    depth = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return written(
        taken.select("conv_id", "h", "head", "taken", depth.alias("end"), *[last(s).alias(f"head_{s}") for s in _sums],
                     *[F.when(F.col("h") > 0, F.coalesce(F.col(f"own_{s}"), F.lit(0))).otherwise(F.lit(0)).alias(f"own_{s}") for s in _sums]),
        "recipes",
    )


def _prefixes(running: DataFrame, recipes: DataFrame, seed: int) -> DataFrame:
    """(conv_id, part, depth, high, low, parent_high, parent_low, digest, n_bytes, ends) per prefix of a rebuilt conversation."""
    zero = F.lit(0).cast("long")
    common = lambda depth: [F.col("conv_id"), depth.cast("long").alias("depth"), (depth == F.col("end")).cast("long").alias("ends")]
    parents = lambda sums: [c.alias(f"parent_{n}") for c, n in zip(_key(sums), ("high", "low"))]
    root = recipes.select(*common(F.lit(0)), F.lit(-1).alias("part"), zero.alias("high"), zero.alias("low"), zero.alias("parent_high"), zero.alias("parent_low"),
                          F.lit("").alias("digest"), zero.alias("n_bytes"))
    heads = recipes.select("conv_id", "end", F.explode("head").alias("turn")).select("conv_id", "end", "turn.*")
    at = [F.col(s) for s in _sums]
    before = [_modulo(F.col(f"s{k}") - F.col(f"w{k}")) for k in range(LANES)]
    head = heads.select(*common(F.col("place") + 1), F.lit(-1).alias("part"), *_key(at), *parents(before), "digest", "n_bytes")
    # the rest of a conversation's own turns moves from place h to place taken: its sums times a power of the inverse base
    back = [F.element_at(F.array(*[F.lit(pow(base, -i, PRIME)) for i in range(HEAD + 1)]), F.col("h") - F.col("taken") + 1) for base in bases(seed)]
    pieces = running.select("conv_id", "part").distinct()
    ways = pieces.join(recipes.drop("head"), "conv_id")
    own = running.join(ways, ["conv_id", "part"]).where("place >= h")
    moved = lambda sums: [_modulo(F.col(f"head_s{k}") + _modulo(sums[k] - F.col(f"own_s{k}")) * back[k]) for k in range(LANES)]
    rest = own.select(*common(F.col("taken") + F.col("place") + 1 - F.col("h")), "part", *_key(moved(at)), *parents(moved(before)), "digest", "n_bytes")
    return written(root.unionByName(head).unionByName(rest), "prefixes")


def _nodes(prefixes: DataFrame) -> DataFrame:
    """One row per node; ``mixed`` tells whether its members differ in their last turn or their parent."""
    unlike = functools.reduce(lambda a, b: a | b, [F.min(c) != F.max(c) for c in ("digest", "parent_high", "parent_low")])
    first = F.min(F.struct("conv_id", "part")).alias("first")
    grouped = prefixes.groupBy(*NODE).agg(
        first, F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends"), F.min("n_bytes").alias("n_bytes"), F.min("digest").alias("digest"),
        F.min("parent_high").alias("parent_high"), F.min("parent_low").alias("parent_low"), unlike.alias("mixed"),
    )
    return written(grouped.select(*NODE, "first.*", "n_convs", "n_ends", "n_bytes", "digest", "parent_high", "parent_low", "mixed"), "nodes")


def _parent_ids(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(node, parent_conv_id) for all nodes but the root. Only a conversation's first own node has a parent of another."""
    parent = [(F.col("depth") - 1).alias("depth"), F.col("parent_high").alias("high"), F.col("parent_low").alias("low")]
    child = [F.col(c).alias(f"child_{c}") for c in NODE]
    asked = written(nodes.where("depth > 0").select(*parent, *child), "asked")
    names = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    total = asked.agg(F.count(F.lit(1)) / SHARE).scalar()
    wide = names.join(children.where(F.col("n_children") > total).select(*NODE), NODE, "left_semi").withColumnRenamed("parent_conv_id", "wide_id")
    near = asked.join(F.broadcast(wide), NODE, "left")
    done = near.where("wide_id is not null").select(*[F.col(f"child_{c}").alias(c) for c in NODE], F.col("wide_id").alias("parent_conv_id"))
    rest = near.where("wide_id is null").drop("wide_id").join(names, NODE)
    return done.unionByName(rest.select(*[F.col(f"child_{c}").alias(c) for c in NODE], "parent_conv_id"))


def _subtrees(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved) by sums: every node is owned by its smallest member, and a subtree's nodes are owned by members.

    A member that does not own a node owns only nodes below it, all of them in the subtree; the owner owns those before it too,
    which ``above`` takes off again.
    """
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    owned = nodes.select(*NODE, "conv_id", "part", saved.alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    pieces = owned.groupBy("conv_id", "part").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("conv_id", "part", F.coalesce(F.sum("saved").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = F.col("before") + F.coalesce(F.sum("saved").over(within), F.lit(0))
    taken_off = owned.join(offsets, ["conv_id", "part"]).select(*NODE, (-above).alias("saved"), F.lit(0).cast("long").alias("n_leaves"))
    totals = pieces.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    by_piece = prefixes.select("conv_id", "part").distinct().join(totals, "conv_id")
    counted = prefixes.select("conv_id", "part", *NODE).join(by_piece, ["conv_id", "part"]).select(*NODE, "saved", "n_leaves")
    return taken_off.unionByName(counted).groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    A conversation c is rebuilt from the first h turns of conversation c - c % FAMILY and its own turns after its first h, with
    h = crc32(c) % 9. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the node's fingerprint (high, low) and the digest of its last turn, by which the stored turn is found.

    Turns ascend by ``turn``, nulls first; turns of equal number ascend by the SHA-256 of role and text; repeated rows are turns
    each. Null role or text counts as empty. Rows without a conversation id belong to none and are left out. An empty table
    gives no node. Other columns are left out. Conversations and groups of copies may be of any size.
    """
    turns = written(stored_turns(conversations), "stored-turns")
    while True:
        running = _running(turns, seed)
        prefixes = _prefixes(running, _recipes(running), seed)
        nodes = _nodes(prefixes)
        if not nodes.where("mixed").count():
            break
        seed += 1
    parent = [(F.col("depth") - 1).alias("depth"), F.col("parent_high").alias("high"), F.col("parent_low").alias("low")]
    children = written(nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children")), "children")
    facts = [
        nodes.select(*NODE, "conv_id", "n_convs", "digest"), children, _parent_ids(nodes, children), _subtrees(nodes, prefixes),
        member_digests(prefixes.where("ends = 1").select(*NODE, "conv_id")),
    ]
    together = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    values = [c for c in together.columns if c not in NODE]
    joined = together.groupBy(*NODE).agg(*[F.max(c).alias(c) for c in values])
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "high", "low", "digest",
    )
