"""Exactness of the distributed forms against plain brute force, plus readers, writers and streams."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import documents as D
from plumbline.functions import scalar as S
from plumbline.functions.draws import draw_positions, draw_values, first_value, poisson_limits
from plumbline.operators import governance as G
from plumbline.operators import joins as J
from plumbline.operators import labels as L
from plumbline.operators import similarity as N
from plumbline.operators import stats as A
from plumbline.plans.evaluate import CASE_SCHEMA, RUNTIME_SCHEMA, evaluate
from plumbline.operators.metrics import Dimensions
from plumbline.session import work_dir
from plumbline.sources import documents as docs
from plumbline.sources import jsonl
from plumbline.streaming import agent_events as E
from plumbline.suite import QUERIES


# --- draws and bootstrap ------------------------------------------------------------------------------

def sequential_draws(seed: int, count: int, size: int) -> list[int]:
    out, state = [], seed
    for _ in range(count):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        v = state
        v = ((v ^ (v >> 15)) * (v | 1)) & 0xFFFFFFFF
        v ^= (v + (((v ^ (v >> 7)) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append(int(((v ^ (v >> 14)) & 0xFFFFFFFF) / 4294967296 * size))
    return out


def test_draws_of_any_slice_equal_the_sequence():
    want = sequential_draws(4242, 5000, 97)
    assert draw_positions(4242, 0, 5000, 97).tolist() == want
    assert draw_positions(4242, 1234, 777, 97).tolist() == want[1234:2011]


def brute_interval(values: list[float], resamples: int) -> tuple[float, float]:
    draws = sequential_draws(4242, resamples * len(values), len(values))
    means = [np.mean([values[p] for p in draws[r * len(values):(r + 1) * len(values)]]) for r in range(resamples)]
    return tuple(np.quantile(means, [0.025, 0.975]))


@pytest.mark.parametrize("n", [7, 40, 333, 2100])
def test_resamples_beyond_the_period_of_the_generator(n, monkeypatch):
    """A chunk makes the draws of one period at most, however many the resamples ask for."""
    table = np.random.default_rng(n).integers(0, 1 << 32, 1000, dtype=np.uint32)
    made = []

    def draws(seed, first, count):
        made.append(count)
        return table[(first + np.arange(count)) % len(table)]

    monkeypatch.setattr(A, "PERIOD", len(table))
    monkeypatch.setattr(A, "DRAWS", 64)
    monkeypatch.setattr(A, "draw_values", draws)
    values, resamples = np.random.default_rng(n + 1).random((n, 2)), 60
    stream = np.floor(table[np.arange(n * resamples) % len(table)] / 4294967296 * n).astype(int).reshape(resamples, n)
    for chunk in (n, 100):
        made.clear()
        sums = sum(A.resampled_sums(values[at:at + chunk], n, at, resamples, 1) for at in range(0, n, chunk))
        assert np.allclose(sums, values[stream].sum(axis=1))
        assert sum(made) <= min(len(table), n * resamples) * -(-n // chunk)


def test_values_of_a_chunk_are_those_of_its_positions():
    drawn = draw_values(4242, 0, 20000)
    for size in (3, 97, 1_000_003):
        for position in (0, 1, size // 3, size - 1, size):
            assert ((drawn >= first_value(position, size)) == (draw_positions(4242, 0, 20000, size) >= position)).all()


def test_bootstrap_in_one_and_in_many_chunks_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, f"c{i:04d}", rng.random()) for g, n in (("a", 40), ("b", 75)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, case_id string, v double").repartition(7)
    for chunk in (10**6, 7):
        out = {r["g"]: r for r in A.bootstrap_ci(df, ["g"], "v", ["case_id"], resamples=60, chunk=chunk).collect()}
        for g in "ab":
            values = [v for k, _, v in sorted(rows) if k == g]
            assert (out[g]["lower"], out[g]["upper"]) == pytest.approx(brute_interval(values, 60), abs=1e-12)
            assert out[g]["mean"] == pytest.approx(np.mean(values))


def test_bootstrap_options_and_constant(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "case_id string, v double")
    row = A.bootstrap_ci(df, [], "v", ["case_id"], resamples=10).first()
    assert (row["lower"], row["upper"], row["n"]) == (3.0, 3.0, 2)
    with pytest.raises(ValueError):
        A.bootstrap_ci(df, [], "v", ["case_id"], resamples=0)
    with pytest.raises(ValueError):
        A.bootstrap_ci(df, [], "v", ["case_id"], alpha=1)
    with pytest.raises(ValueError):
        A.paired_delta_ci(df, df.filter("case_id = 'a'"), "v")


def test_positions_across_partitions(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int").repartition(5)
    out = A.with_positions(df, ["g"], "o").collect()
    for g in "ab":
        ordered = sorted(o for k, o in rows if k == g)
        assert {r["o"]: r["p"] for r in out if r["g"] == g} == {o: i for i, o in enumerate(ordered)}


def poisson_interval(values, keys, resamples, seed=4242):
    """One row and one draw after the other."""
    limits, means = poisson_limits(), []
    mix = lambda v: (lambda a: (a ^ (a >> 14)) & 0xFFFFFFFF)((lambda b: b ^ ((b + ((b ^ (b >> 7)) * (b | 61))) & 0xFFFFFFFF))(((v ^ (v >> 15)) * (v | 1)) & 0xFFFFFFFF))
    halves = [(lambda h: (int(h[:8], 16), int(h[8:16], 16)))(hashlib.sha256(f"{seed}\x1f{k}".encode()).hexdigest()) for k in keys]
    for r in range(1, resamples + 1):
        total = weight = 0
        for v, (a, b) in zip(values, halves):
            u = mix(mix((a + r * 0x6D2B79F5) & 0xFFFFFFFF) ^ b)
            n = sum(u >= x for x in limits)
            total, weight = total + n * v, weight + n
        if weight:
            means.append(total / weight)
    return np.percentile(means, [2.5, 97.5])


def test_poisson_bootstrap_equals_brute_force_however_rows_are_dealt(spark):
    rows = [(f"c{i}", "ab"[i % 3 == 0], float(i * 37 % 101)) for i in range(60)] + [("x", "a", None), ("y", None, 3.0), ("z", "one", 5.0)]
    df = spark.createDataFrame(rows, "case_id string, g string, v double")
    got = [sorted(map(tuple, A.poisson_bootstrap_ci(df.repartition(n), ["g"], "v", ["case_id"], resamples=50).collect()), key=repr) for n in (1, 7)]
    assert [[pytest.approx(x) for x in r[1:]] for r in got[0]] == [list(r[1:]) for r in got[1]]
    for name, mean, lower, upper, n in got[0]:
        some = [(r[2], r[0]) for r in rows if r[1] == name and r[2] is not None]
        low, high = poisson_interval(*zip(*some), 50)
        assert (n, mean, lower, upper) == (len(some), pytest.approx(np.mean([v for v, _ in some])), pytest.approx(low), pytest.approx(high))


def test_poisson_bootstrap_is_near_the_exact_one(spark):
    df = spark.range(3000).selectExpr("id as case_id", "double(pmod(xxhash64(id), 1000)) as v")
    exact, mergeable = (f(df, [], "v", ["case_id"]).first() for f in (A.bootstrap_ci, A.poisson_bootstrap_ci))
    width = exact["upper"] - exact["lower"]
    assert exact["n"] == mergeable["n"] and exact["mean"] == pytest.approx(mergeable["mean"])
    assert abs(exact["lower"] - mergeable["lower"]) < 0.15 * width and abs(exact["upper"] - mergeable["upper"]) < 0.15 * width


def test_poisson_bootstrap_hands_groups_on(spark, monkeypatch):
    df = spark.range(400).selectExpr("id as case_id", "id % 40 as g", "double(id) as v").coalesce(1)
    want = sorted(map(tuple, A.poisson_bootstrap_ci(df, ["g"], "v", ["case_id"], resamples=20).collect()))
    rows = [{"g": {"g": i % 40}, "v": float(i), "k1": i * 7919, "k2": i * 104729} for i in range(400)]
    batch = pa.RecordBatch.from_pylist(rows)
    whole = sum(pa.Table.from_batches(A._poisson_sums(20, iter([batch]))).column("weights").combine_chunks().flatten().to_pylist())
    monkeypatch.setattr(A, "HELD_GROUPS", 3)
    parts = list(A._poisson_sums(20, iter([batch, batch])))
    assert len(parts) > 2 and sum(sum(p.column(2).flatten().to_pylist()) for p in parts) == 2 * whole and len(want) == 40
    with pytest.raises(ValueError):
        A.poisson_bootstrap_ci(df, ["g"], "v", ["case_id"], resamples=0)


# --- rules ------------------------------------------------------------------------------------------------

def rule_case(rng, i):
    facts = {n: float(rng.choice([0, 1, 2, 4, 5, 7.5, 8, 12])) for n in {f for _, _, f, *_ in L.RULE_FORMS if f} | {"units_proposed"} if rng.random() < 0.8}
    some = lambda names: [n for n in names if rng.random() < 0.4]
    return f"c{i}", facts, some(["tree-assessment", "neighbour-notification", "x"]), some(["architectural-set", "energy-compliance-report"])


@pytest.mark.parametrize("count", [60, 3000])
def test_threshold_index_gives_what_the_matching_rules_give(spark, count):
    rng = random.Random(3)
    cases = [rule_case(rng, i) for i in range(25)]
    rules = []
    for i in range(count):
        marker, kind, *_ = rng.choice(L.RULE_FORMS)
        text = f"{marker} {rng.choice([0.5, 1, 2.5, 4, 7.5, 9])}" if kind in ("number", "optional") and rng.random() < 0.8 else marker
        rules.append((f"R{i}", rng.choice([text, text, "no known condition"]), rng.choice([f"G{i % 7}", "", None]), [f"B{i % 5}"], [f"E{i % 9}", ""], [f"Q{i % 4}"] if i % 3 else None))
    frame = spark.createDataFrame(cases, "case_id string, facts map<string,double>, missing_documents array<string>, submitted_kinds array<string>")
    table = spark.createDataFrame(rules, "rule_id string, condition string, emits_gap string, bylaw_ids array<string>, evidence_keys array<string>, required array<string>")
    want = {c[0]: {name: set() for name in L.RULE_GIFTS} for c in cases}
    for r in L.matched_rules(frame, table).collect():
        for name, column in L.RULE_GIFTS.items():
            items = r[column] if isinstance(r[column], list) else [r[column]]
            want[r["case_id"]][name] |= {x for x in items if x is not None}
    got = L.rule_gifts(frame, L.threshold_index(table))
    assert {r["case_id"]: {name: r[name] for name in L.RULE_GIFTS} for r in got.collect()} == {c: {n: sorted(x) for n, x in names.items()} for c, names in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0]


def test_no_rules_give_nothing(spark):
    frame = spark.createDataFrame([("c", {"units_proposed": 9.0}, [], None)], "case_id string, facts map<string,double>, missing_documents array<string>, submitted_kinds array<string>")
    table = spark.createDataFrame([], "rule_id string, condition string, emits_gap string, bylaw_ids array<string>, evidence_keys array<string>, required array<string>")
    assert L.rule_gifts(frame, L.threshold_index(table)).first()["rule_ids"] == []


# --- similarity ------------------------------------------------------------------------------------------

def scenarios(count: int, cards: int, seed: int, copies: float = 0.3) -> list[tuple[str, str, str, str]]:
    rng, rows = random.Random(seed), []
    hot = "vec:" + "|".join(f"{n}=0" for n in V.FACTS)
    for i in range(count):
        text = hot if rng.random() < copies else "vec:" + "|".join(f"{n}={rng.randrange(cards)}" for n in V.FACTS)
        rows.append((f"c{i:05d}", rng.choice("de"), rng.choice(V.SPLITS), text))
    return rows


def facts(text: str) -> list[str]:
    return text[4:].split("|")


def changed(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(facts(a), facts(b)))


SCHEMA = "case_id string, domain string, split string, scenario_fingerprint string"


@pytest.mark.parametrize("crowded", [10**6, 8, 0])
def test_blocked_pairs_equal_brute_force_at_every_level(spark, crowded):
    rows = scenarios(220, 2, 3)
    want = Counter()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[2] != b[2] and changed(a[3], b[3]) <= 4:
                want[changed(a[3], b[3])] += 1
    got = Counter()
    for r in N.scenario_violations(spark.createDataFrame(rows, SCHEMA), crowded=crowded).collect():
        got[round(r["distance"] * 14)] += r["case_pairs"]
    assert got == want


def test_violating_cases_cover_each_copy(spark):
    rows = scenarios(150, 3, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["case_id"]: (round(r["nearest_distance"] * 14), r["partner_cases"]) for r in N.violating_cases(df, N.scenario_violations(df)).collect()}
    want = {}
    for a in rows:
        near = [changed(a[3], b[3]) for b in rows if b[2] != a[2] and changed(a[3], b[3]) <= 4]
        if near:
            want[a[0]] = (min(near), len(near))
    assert got == want


def with_gaps(rows, seed: int = 2):
    """Some fingerprints without some of the facts."""
    rng = random.Random(seed)
    lacking = [[], [0], [3, 9], list(range(13)), list(range(14))]
    drop = lambda text: "vec:" + "|".join(f for i, f in enumerate(facts(text)) if i not in gone)
    out = []
    for *head, text in rows:
        gone = set(rng.choice(lacking))
        out.append((*head, drop(text)))
    return out


def distance(a: str, b: str) -> float:
    a, b = (dict(f.split("=") for f in facts(x) if f) for x in (a, b))
    return sum(a.get(n) != b.get(n) for n in a.keys() | b.keys()) / max(1, len(a.keys() | b.keys()))


@pytest.mark.parametrize("gaps", [False, True])
def test_near_cases_are_counted_without_pairs(spark, gaps):
    rows = scenarios(150, 3, 5)
    rows = with_gaps(rows) if gaps else rows
    got = {r["case_id"]: (pytest.approx(r["nearest_distance"]), r["partner_cases"]) for r in N.near_cases(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for a in rows:
        near = [d for b in rows if b[2] != a[2] for d in [distance(a[3], b[3])] if d < 0.35]
        if near:
            want[a[0]] = (min(near), len(near))
    assert got == want


@pytest.mark.parametrize("crowded", [200_000, 3])
def test_partners_are_counted_with_one_row_per_block(spark, crowded, monkeypatch):
    """A scenario is dealt once per block of facts, not once per set of facts; crowded groups give the same."""
    rows = with_gaps(scenarios(150, 3, 29))
    names = [f for i, f in enumerate(V.FACTS) if i < 7]
    rows = [(*head, "vec:" + "|".join(f for f in facts(text) if f.split("=")[0] in names)) for *head, text in rows]
    dealt, real = [], N._dealt

    def counting(everyone, *options):
        for part, nodes, last in real(everyone, *options):
            dealt.append((part.count(), last))
            yield part, nodes, last

    monkeypatch.setattr(N, "_dealt", counting)
    pool = N.distinct_scenarios(spark.createDataFrame(rows, SCHEMA), [], names)
    got = Counter()
    for r in N.partner_counts(pool, 2, [], names, crowded).collect():
        got[r["scenario_fingerprint"], r["split"], r["changes"], r["named"]] += r["partners"]
    want = Counter()
    for a in {r[2:] for r in rows}:
        for b in rows:
            one, other = ({f for f in facts(x) if f} for x in (a[1], b[3]))
            keys = {f.split("=")[0] for f in one | other}
            changes = len({f.split("=")[0] for f in one ^ other})
            if a[0] != b[2] and changes <= 2:
                want[a[1], a[0], changes, len(keys)] += 1
    assert got == want
    if crowded > 150:
        assert [n for n, _ in dealt] == [3 * pool.count()]
    else:
        assert any(last and n for n, last in dealt)


def test_every_set_of_facts_belongs_to_one_node():
    def leaves(node):
        below = N._children(node, 8, 3)
        return [x for child in below for x in leaves(child)] if below else [node]

    for nodes in (N._children(N.Node((), ()), 8, 3), leaves(N.Node((), ()))):
        met = Counter(c for node in nodes for c in N._choices(node, 8, 3))
        assert len(met) == sum(math.comb(8, j) for j in range(4)) and set(met.values()) == {1}


def test_near_cases_of_a_pool_without_any(spark):
    rows = [(f"c{i}", "d", V.SPLITS[i % 4], "vec:" + "|".join(f"{n}={i}" for n in V.FACTS)) for i in range(30)]
    assert N.near_cases(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert N.near_cases(spark.createDataFrame(rows[:0], SCHEMA)).count() == 0


@pytest.mark.parametrize("k", [7, 400])
def test_nearest_pairs_with_missing_facts_and_copies(spark, k):
    rows = with_gaps(scenarios(40, 2, 17, copies=0.4))
    want = sorted((round(distance(a[3], b[3]), 9), a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1:] if a[1] == b[1] and a[2] != b[2])[:k]
    out = N.nearest_pairs(spark.createDataFrame(rows, SCHEMA), k).collect()
    assert want == [(round(r["distance"], 9), r["case_a"], r["case_b"]) for r in out]


def jaccard(a: str, b: str) -> float:
    a, b = set(a.removeprefix("vec:").split("|")), set(b.removeprefix("vec:").split("|"))
    return 1 - len(a & b) / len(a | b)


@pytest.mark.parametrize("floor, keys", [(0.35, 128), (0.35, 1), (0.8, 128), (0.5, 20)])
def test_jaccard_pairs_equal_brute_force(spark, floor, keys):
    rows = with_gaps(scenarios(70, 2, 23)) + [("u", "d", "train", "x|x|y"), ("v", "d", "dev", "y|x"), ("w", "d", "holdout", ""), ("z", "d", "dev", "vec:")]
    names = {(r[3], r[2]): sum(x[2:] == r[2:] for x in rows) for r in rows}
    want = {}
    for (a, s), n in names.items():
        for (b, t), m in names.items():
            if s != t and (a, s) < (b, t) and jaccard(a, b) < floor:
                want[a, s, b, t] = (pytest.approx(jaccard(a, b)), n * m)
    out = N.jaccard_violations(spark.createDataFrame(rows, SCHEMA), floor, keys).collect()
    assert {(r["fingerprint_a"], r["split_a"], r["fingerprint_b"], r["split_b"]): (r["distance"], r["case_pairs"]) for r in out} == want and len(out) == len(want)


def test_jaccard_keys_carry_numbers_alone(spark, monkeypatch):
    """Many rows per scenario are written for the keys; texts and tokens stay with the scenarios."""
    written, real = {}, N._written

    def noting(frame, purpose):
        written[purpose] = [t for _, t in frame.dtypes]
        return real(frame, purpose)

    monkeypatch.setattr(N, "_written", noting)
    assert N.jaccard_violations(spark.createDataFrame(scenarios(60, 2, 31), SCHEMA)).count()
    assert set(written["met-keys"]) == {"bigint"}


def test_counted_join_takes_heavy_keys_by_broadcast(spark):
    left = spark.range(5000).selectExpr("if(id < 3000, 0, id % 900) as key", "id")
    right = left.groupBy("key").agg(F.count("*").alias("n")).filter("key <> 7").withColumn("name", F.concat(F.lit("k"), "key"))
    got = J.counted_join(left, right, ["key"], "n")
    want = left.join(right.drop("n"), "key")
    assert sorted(map(tuple, got.select("key", "id", "name").collect())) == sorted(map(tuple, want.select("key", "id", "name").collect()))


@pytest.mark.parametrize("count, cards", [(120, 3), (12, 50), (4, 1000)])
def test_nearest_pairs_equal_brute_force(spark, count, cards):
    rows = scenarios(count, cards, 11, copies=0.1 if count > 50 else 0)
    want = sorted(
        (changed(a[3], b[3]) / 14, a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1:] if a[1] == b[1] and a[2] != b[2]
    )[:10]
    out = N.nearest_pairs(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert [(pytest.approx(d), a, b) for d, a, b in want] == [(r["distance"], r["case_a"], r["case_b"]) for r in out]


@pytest.mark.parametrize("limit", [100_000, 3])
def test_histogram_equals_brute_force_on_both_paths(spark, limit):
    rows = scenarios(90, 2, 7)
    out = N.distance_histogram(spark.createDataFrame(rows, SCHEMA), group_limit=limit).collect()
    want = Counter()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[1] == b[1] and a[2] != b[2]:
                edge = next(e for e in V.DISTANCE_EDGES if changed(a[3], b[3]) / 14 <= e + 1e-12)
                want[(a[1], *sorted((a[2], b[2])), f"le_{edge:g}".replace(".", "_"))] += 1
    got = Counter()
    for r in out:
        for name, n in r.asDict().items():
            if name.startswith("le_") and n:
                got[(r["domain"], r["split_a"], r["split_b"], name)] = n
    assert got == want


def test_floor_of_four_changes_fails_and_five_passes():
    assert N.max_changes(0.35, 14) == 4


def test_distances_with_missing_facts(spark):
    rows = [("vec:a=1|b=2", "vec:a=1|c=3"), ("", ""), ("vec:=x|a=1", "vec:a=1"), ("vec:a=1=2", "vec:a=1=2")]
    df = spark.createDataFrame(rows, "l string, r string")
    got = [r[0] for r in df.select(S.fact_distance(F.col("l"), F.col("r"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0, 0.0]


# --- joins, ids, sampling ----------------------------------------------------------------------------------

def test_salted_join_equals_plain_join_on_a_hot_key(spark):
    flat = spark.createDataFrame([("hot", 0), ("cold", 1), ("none", 2), (None, 3)], "k string, v int")
    hot = flat.union(spark.range(J.HEAVY_ROWS + 1).selectExpr("'hot'", "cast(id as int)"))
    right = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("cold", "z"), (None, "n")], "k string, w string")
    for left in (flat, hot):
        for how in ("inner", "left", "left_semi", "left_anti"):
            salted = J.salted_join(left, right, ["k"], how)
            plain = left.join(right, "k", how)
            assert sorted(map(str, salted.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_only_heavy_keys_are_copied(spark):
    rows = spark.range(3 * J.HEAVY_ROWS).selectExpr("if(id % 3 < 2, -1, id) as k", "id as v")
    copies = spark.createDataFrame([(-1,), (2,), (5,)], "k long").withColumn("w", F.lit(1))
    joined = J.salted_join(rows, copies, ["k"], "left")
    assert joined.count() == rows.count() and joined.filter("w = 1").count() == 2 * J.HEAVY_ROWS + 2
    assert "BroadcastNestedLoopJoin" not in joined._jdf.queryExecution().toString()


def test_dimension_above_the_limit_is_not_broadcast(spark, monkeypatch):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    dim = spark.createDataFrame([("a", "x")], "k string, w string")
    assert J.is_small(dim) and not J.is_small(dim, max_rows=0) and not J.is_small(dim, max_bytes=3)
    wide = J.dim_join(left, dim, "k", "left", small=False)
    assert "_salt" not in wide.columns and sorted(wide.collect()) == sorted(J.dim_join(left, dim, "k").collect())


def test_ranks_in_strata_are_a_permutation(spark):
    df = spark.createDataFrame([(f"k{i}", "hot" if i % 3 else "cold") for i in range(900)], "k string, s string")
    out = L.ranked_in_strata(df, "k", ["s"], 5).collect()
    for s in ("hot", "cold"):
        assert sorted(r["rank"] for r in out if r["s"] == s) == list(range(1, sum(r["s"] == s for r in out) + 1))


def test_duplicate_ids_name_the_first_place(spark):
    pool = spark.createDataFrame([("a", "p", 2), ("a", "p", 1), ("a", "q", 1), ("b", "p", 9)], "case_id string, path string, line int")
    got = {r["message"] for r in G.duplicate_ids(pool, "case_id").collect()}
    assert got == {"duplicate at p:2 (first seen p:1)", "duplicate at q:1 (first seen p:1)"}


# --- documents ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("path, tokens", [
    ("a.b[0].c", ["a", "b", 0, "c"]), ("[0].a", [0, "a"]), ("a[0][1]", ["a", 0, 1]), ("a..b", None), (".a", None), ("a.", None),
    ("a[01]", None), ("a[0]b", None), ("a]", None), ("a[", None), (" ", None),
])
def test_paths(path, tokens):
    assert D.path_tokens(path) == tokens


def test_null_is_present_and_absent_is_not():
    doc = {"a": None, "l": [1, None]}
    assert D.has_path(doc, ["a"]) and D.has_path(doc, ["l", 1]) and not D.has_path(doc, ["b"]) and not D.has_path(doc, ["l", 2])


@pytest.mark.parametrize("value, text", [
    (4.0, "4"), (502.5, "502.5"), (1e-7, "1e-7"), (0.000001, "0.000001"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (-0.0, "0"),
])
def test_number_text(value, text):
    assert D.number_literal(value) == text


def test_canonical_text_sorts_and_drops():
    doc = json.loads('{"b": {"z": 1.0, "a": [1, {"y": null, "x": "é"}]}, "a": true, "content_fingerprint": 1}')
    assert D.canonical_text(doc) == '{"a":true,"b":{"a":[1,{"x":"é","y":null}],"z":1},"content_fingerprint":1}'
    assert "fingerprint" not in D.canonical_text(doc, D.is_generated_key)


def test_scenario_fingerprint_buckets(spark):
    row = spark.range(1).select(
        S.signed_steps(F.lit(0.05), 0.05, 2).alias("up"), S.signed_steps(F.lit(-0.25), 0.1, 1).alias("tie"), S.signed_steps(F.lit(0.0), 0.1, 1).alias("zero"),
        S.lot_bucket(F.lit(502.5)).alias("lot"), S.signed_number(F.lit(-2.0)).alias("less"), S.half_up(F.lit(-2.5)).alias("half"),
    ).first()
    assert tuple(row) == ("+0.05", "-0.2", "0", "500-549", "-2", -2.0)


# --- files ---------------------------------------------------------------------------------------------------

def test_read_lines_numbers_every_line(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "a.jsonl").write_text("\n".join("{}" if i == 3 else json.dumps({"n": i, "pad": "x" * 90}) for i in range(1, 301)) + "\n\n{bad\n")
        good, bad = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"), "n int")
        assert good.count() == 300 and good.filter("value.n is not null and value.n <> line_no").count() == 0
        assert [r["line_no"] for r in bad.collect()] == [302]
        with pytest.raises(ValueError, match=":302"):
            jsonl.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "n int")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_refuses_existing_output(spark, tmp_path):
    df = spark.createDataFrame([("d", "train", "b"), ("d", "train", "a")], "domain string, split string, case_id string")
    path = str(tmp_path / "out")
    jsonl.write_jsonl(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        jsonl.write_jsonl(df, path)
    jsonl.write_jsonl(df, path, force=True)
    assert [r["case_id"] for r in spark.read.json(f"{path}/domain=d/split=train").collect()] == ["a", "b"]


def test_corpus_files_and_receipts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "m-1.md").write_text("one")
    (tmp_path / "x" / "skip.txt").write_text("two")
    found = docs.read_corpus(spark, str(tmp_path), ".md")
    assert [tuple(r) for r in docs.reference_ids(found).collect()] == [("m-1", "one")]
    hashes = docs.file_hashes(spark, str(tmp_path))
    assert G.receipt_mismatches(hashes, hashes).isEmpty()
    assert {r["problem"] for r in G.receipt_mismatches(hashes.withColumn("sha256", F.lit("x")), hashes).collect()} == {"mismatch"}
    assert jsonl.read_json_doc(spark, str(tmp_path / "none.json")) is None


def test_a_corpus_of_many_documents_is_few_files(spark, tmp_path):
    texts = ["plain", "", "two\nlines\n", "a\x00", "\x00", "\u2028 \U0001f600 \"quoted\" \\", None] + [f"text {i}" for i in range(500)]
    rows = [(i, None if i == 9 else "en" if i % 2 else "a/b", t) for i, t in enumerate(texts)] + [(None, "de", "no id")]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(2)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(work_dir(spark, "x")).parent
    before = set(shared.glob("corpus-*"))
    found = [tuple(r) for r in QUERIES["corpus_scan"](spark, str(tmp_path)).collect()]
    want = [(f"{lang or ''}/{'' if i is None else i}.md", None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, lang, t in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    (folder,) = set(shared.glob("corpus-*")) - before
    assert len([*folder.rglob("*.json")]) <= 8


def test_a_receipt_row_has_one_finding_however_often_its_path_is_listed(spark):
    receipt = spark.createDataFrame([("a", "x"), ("a", "0"), ("b", "x"), ("c", "y"), ("d", "x")], "path string, sha256 string")
    actual = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "x"), ("b", "x"), ("b", "z"), ("c", "y")], "path string, sha256 string")
    found = [tuple(r) for r in G.receipt_mismatches(receipt, actual).select("path", "sha256", "actual", "problem").collect()]
    assert sorted(found, key=str) == [("a", "0", "x", "mismatch"), ("b", "x", "z", "mismatch"), ("d", "x", None, "missing")]


def test_duplicate_key_is_an_error(spark):
    dim = docs.corpus_dim(spark.createDataFrame([("p", ["A", "B"]), ("q", ["A"])], "path string, bylaw_ids array<string>"))
    with pytest.raises(ValueError, match="A"):
        docs.require_unique(dim, "bylaw_id")


def test_canonical_text_is_the_same_by_the_encoder():
    texts = [
        '{"b": 1.0, "a": [1.50, -0.0, 1e3, 123456789.25, 0.0001, 100000000000000000000, true, null], "B": {"z": "x\\n\\"", "": ""}}',
        '{"a": 1e-5, "b": 1e16, "c": 2.5e22}', '[1e15, 999999999999999.0, -12.75, 0.1]', '{"k": "\\u00e9\\ud83d\\ude00"}', '{"\u00e9": 1, "e": "\u2028"}',
        '{"a": 1, "a": 2}', '"x"', '7', '{"\\u0062": 1, "a": "NaN"}', '[]', '{}',
    ]
    for text in texts:
        assert D.canonical(text) == D.canonical_text(json.loads(text))
    for text in ('[NaN]', '[1e999]', '{"a": -Infinity}'):
        with pytest.raises(ValueError):
            D.canonical(text)


def test_built_cases_keep_one_row_per_grid_row(spark, tmp_path):
    """Rows that are given one id stay two cases, each with its own labels; they were joined with each other's."""
    grid = built_grid(spark).withColumn("given_id", F.lit("same"))
    rules = spark.createDataFrame([("R-1", "units_proposed > 4", ["B"], ["e"], "gap-units-over")], "rule_id string, condition string, bylaw_ids array<string>, evidence_keys array<string>, emits_gap string")
    evidence = spark.createDataFrame([("B", "k")], "bylaw_id string, evidence_key string")
    out = L.build_cases(grid, rules, evidence, "2026-01-01")
    assert sorted((r["case_id"], r["units_proposed"], r["expected_gap_ids"]) for r in out.collect()) == [("same", 2.0, []), ("same", 6.0, ["gap-units-over"])]


def built_grid(spark):
    numbers = ["fsr_proposed", "fsr_allowed", "rear_setback_m_proposed", "rear_setback_m_required", "side_setback_m_proposed", "side_setback_m_required",
               "parking_spaces_proposed", "parking_spaces_required", "height_m_proposed", "height_m_max", "energy_step_code_proposed", "lot_area_sqm"]
    texts = ["outcome_class", "gap_severity_bucket", "applicant_type", "edge_case_family", "zoning_district", "address_stub", "represented_by"]
    lists = {c: F.array().cast("array<string>") for c in ("missing_documents", "submitted_documents", "submitted_kinds")}
    rows = spark.createDataFrame([(0, "d", 2.0), (1, "d", 6.0)], "row_index long, domain string, units_proposed double")
    return rows.withColumns({c: F.lit(1.5) for c in numbers} | {c: F.lit("x") for c in texts} | lists)


# --- nested documents end to end -----------------------------------------------------------------------------

def test_evaluate_documents(spark, tmp_path):
    memo = "\n".join(f"## {h}" for h in V.MEMO_SECTIONS) + "\nper AB-1"
    letter = "\n".join(f"## {h}" for h in V.LETTER_SECTIONS)
    case = {
        "case_id": "c1", "domain": "d", "split": "train", "pathway_class": "heritage", "application_packet": {"p": 5, "r": 7, "t": "7", "deep": {"x": [None]}},
        "gold_labels": {"bylaws_to_cite": ["AB-1"], "expected_gap_ids": ["g"], "stage1_complete": True, "stage1_missing": [], "expected_applicant_support_flags": []},
    }
    payload = {
        "case_id": "c1", "predicted_pathway": "heritage", "cited_bylaw_ids": ["AB-1"], "evidence_fields_by_bylaw": {"AB-1": ["k"]},
        "reported_numeric_gaps": [{"gap_id": "g", "proposed_value": 5, "required_value": 7, "delta": 2}], "stage1_complete": True, "stage1_missing": [],
        "applicant_support_flags": [], "redlines": [{"field": "deep.x[0]", "addresses_gap": "g", "cited_bylaw_id": "AB-1"}], "memo_markdown": memo, "letter_markdown": letter,
    }
    (tmp_path / "cases.jsonl").write_text(json.dumps(case))
    (tmp_path / "run.jsonl").write_text(json.dumps({**payload, "predicted_pathway": "floodplain"}) + "\n" + json.dumps(payload))
    cases = jsonl.read_jsonl_strict(spark, str(tmp_path / "cases.jsonl"), CASE_SCHEMA).select("value.*")
    runtime = jsonl.read_jsonl_strict(spark, str(tmp_path / "run.jsonl"), RUNTIME_SCHEMA).select(F.col("line_no").alias("seq"), "value.*")
    dims = Dimensions(
        corpus=spark.createDataFrame([("AB-1",)], "bylaw_id string"), evidence_map=spark.createDataFrame([("AB-1", "k")], "bylaw_id string, evidence_key string"),
        truth=spark.createDataFrame([("g", "p", "r", 0.0)], "gap_id string, proposed_field string, required_field string, tolerance double"),
    )
    scores, split = evaluate(cases, runtime, dims, resamples=20)
    row = scores.first()
    assert row["deterministic_prqs"] == pytest.approx(100) and row["partial_full_prqs_lower_bound"] == 85 and row["M12"] is None
    table = {r["metric"]: r for r in split.collect()}
    assert table["deterministic_prqs"]["lower"] == pytest.approx(100) and table["M12"]["null_count"] == 1 and table["M12"]["mean"] is None
    with pytest.raises(ValueError, match="missing payload"):
        evaluate(cases, runtime.filter("false"), dims)


def test_a_line_is_parsed_once_and_payloads_are_read_once(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"case_id": "a", "b": 1}\n\n{"case_id": "c"')
    good, bad = jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "case_id string, b int")
    assert [tuple(r) for r in good.select("line_no", "value.*").collect()] == [(1, "a", 1)] and bad.first()["line_no"] == 3
    plan = good.select("line_no", "value.*").filter("case_id <> 'q' and b > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


# --- state table ---------------------------------------------------------------------------------------------------

def test_state_table_upsert_is_idempotent_and_keeps_the_newest(spark):
    table = E.RunStateTable(spark, work_dir(spark, "state"), buckets=4)
    row = lambda run, agent, status, seq: (run, agent, status, seq)
    schema = "run_id string, agent_id string, status string, last_seq long"
    first = spark.createDataFrame([row("r1", "a", "queued", 1), row("r2", "a", "done", 5)], schema)
    second = spark.createDataFrame([row("r1", "a", "done", 3), row("r1", "b", "failed", 2)], schema)
    for rows in (first, second, second, first):
        E.RunStateTable(spark, table.root, buckets=4).upsert(rows)
    got = {(r["run_id"], r["agent_id"]): r["status"] for r in table.read().collect()}
    assert got == {("r1", "a"): "done", ("r1", "b"): "failed", ("r2", "a"): "done"}


def test_end_mark_holds_for_later_batches(spark, tmp_path):
    lines = lambda rows: spark.createDataFrame(rows, "run_id string, seq long, line string")
    event = lambda agent: f'{{"agent_id":"{agent}","status":"ok"}}'
    source, out, checkpoint = (str(tmp_path / n) for n in ("lines", "out", "checkpoint"))
    ends = E.RunStateTable(spark, str(tmp_path / "ends"), ("run_id",), buckets=2)
    for rows in ([("r", 1, event("a")), ("r", 2, "data: [DONE]"), ("q", 1, event("c"))], [("r", 3, event("b")), ("q", 2, event("d"))]):
        lines(rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("run_id string, seq long, line string").parquet(source)
        E.stream_event_lines(stream, ends, out, checkpoint).awaitTermination()
    got = {(r["run_id"], r["agent_id"]) for r in spark.read.parquet(out).collect()}
    assert got == {("r", "a"), ("q", "c"), ("q", "d")}


def test_run_status_needs_every_known_agent(spark):
    rows = [("one", V.AGENTS[0], "done", 1)] + [("all", a, "done", 1) for a in V.AGENTS] + [("bad", a, "failed" if i == 0 else "done", 1) for i, a in enumerate(V.AGENTS)] + [("idle", V.AGENTS[0], "queued", 1)]
    agents = spark.createDataFrame(rows, "run_id string, agent_id string, status string, last_seq long")
    assert {r["run_id"]: r["run_status"] for r in E.run_status(agents).collect()} == {"one": "running", "all": "done", "bad": "failed", "idle": "queued"}


def test_work_dir_follows_the_session(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_contracts_read_an_output_once(spark):
    """keys and document of an output were worked out again for every field, rule and the filter of an explode."""
    from plumbline.operators import responses as R
    from plumbline.suite import QUERIES

    outputs = spark.createDataFrame([
        ("1", "redline-generator", '{"redlines":{},"x":1}'), ("2", "redline-generator", "[1]"), ("3", "odd", "{}"), ("4", "bylaw-retriever", None),
    ], "case_id string, agent string, output string")
    checked = R.check_contracts(outputs)
    assert checked.columns == [*outputs.columns, "errors"]
    assert {r["case_id"]: r["errors"] for r in checked.collect()} == {
        "1": ["unexpected x", "redlines is not array"], "2": ["not an object"], "3": ["unknown agent"], "4": ["not an object"],
    }
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jsonObjectKeys") == plan.count("parseJson") == 1
    query = QUERIES["stage_contract_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(errors" not in query and query.count("jsonObjectKeys") <= 6


def test_request_counts_are_those_of_the_requests(spark):
    """whole contexts were sorted with the requests only to count them."""
    from plumbline.operators import responses as R
    from plumbline.suite import QUERIES

    names = ["case_id", "domain", "pathway_class", "outcome_class", "gap_severity_bucket", "edge_case_family", "address_stub", "application_packet"]
    case = lambda i, domain: (i, domain, "p", "o", "g", None, "a", '{"k":1}')
    schema = ", ".join(f"{n} string" for n in names)
    cases = spark.createDataFrame([case("1", "x"), case("2", "z"), case("2", "y"), case("3", "x")], schema)
    redlines = spark.createDataFrame([("1", 0, "{}"), ("1", 1, "{}"), ("2", 0, "{}"), ("9", 0, "{}")], "case_id string, seq int, redline string")
    texts = spark.createDataFrame([("1", "staff", "m"), ("1", "applicant", None), ("2", "staff", "m")], "case_id string, audience string, text string")
    part = F.regexp_extract("case_context", r'("domain":"[^"]*")', 1)
    want = R.judge_requests(cases, redlines, texts).groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(part).alias("context_part"))
    got = R.request_counts(cases, redlines, texts, part)
    assert sorted(got.collect()) == sorted(want.collect()) and got.columns == want.columns
    assert ("2", "staff", 2, '"domain":"y"') in [tuple(r) for r in got.collect()]
    query = QUERIES["judge_request_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    joins = [line for line in query.toString().splitlines() if "Join Inner, (case_id" in line]
    assert joins and "regexp_extract" not in query.toString().splitlines()[0]
