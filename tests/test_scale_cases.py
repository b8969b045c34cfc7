"""Shapes that small tables do not show: outliers, long chains and rings, very large sets, many equal ranks."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import leaders, lexicon, metrics, selection, trees


@pytest.mark.parametrize("kind", ["outlier", "near", "signs", "equal", "two"])
def test_percentiles_of_skewed_values(spark, kind):
    own = np.random.default_rng(1)
    x = {"outlier": np.append(own.random(4000), 1e9), "near": np.append(1e6 + own.random(3000), [-1e12, 5e-324, 1e300]), "signs": own.normal(size=3000) * 10.0 ** own.integers(-8, 8, 3000), "equal": np.append(np.full(2000, 3.5), own.random(50)), "two": np.array([1.0, 2.0])}[kind]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(x)] + [(0, None), (1, float("nan"))], "g long, v double")
    for by, parts in ([], [x]), (["g"], [x[0::2], x[1::2]]):
        got = sorted(metrics.percentiles(df, by, "v", shares).collect(), key=lambda r: r["g"] if by else 0)
        for row, own_part in zip(got, parts, strict=True):
            assert np.allclose([row[f"p{k + 1}"] for k in range(len(shares))], np.percentile(own_part, [100 * s for s in shares]), rtol=1e-12, atol=0)


def test_no_bin_crowds_for_one_outlier(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 0, 1e9).otherwise(F.rand(3) + 1).alias("v"))
    largest = df.groupBy(metrics.magnitude_bin(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert largest < 2 * 20_000 / 256
    ordered = [r.v for r in spark.createDataFrame([(v,) for v in (-float("inf"), -1e308, -2.0, -1.999, -5e-324, 0.0, 5e-324, 1e-300, 0.999999999999, 1.0, 1.0000001, 1.7976931348623157e308, float("inf"))], "v double").orderBy(metrics.magnitude_bin(F.col("v")), "v").collect()]
    assert ordered == sorted(ordered)
    ends = spark.createDataFrame([(-float("inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    assert tuple(metrics.percentiles(ends, [], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).first()) == (-float("inf"), -float("inf"), 1.5, float("inf"), float("inf"))
    assert metrics.percentiles(ends.limit(0), ["v"], "v", [0.5]).count() == 0


def test_paths_of_chains_rings_and_strays(spark):
    chain = [(k, k - 1 if k else None) for k in range(1000)]
    ring = [(2000, 2002), (2001, 2000), (2002, 2001), (2003, 2002), (2004, 2003), (3000, 3000)]
    stray = [(4000, 9999), (4001, 4000)]
    parent = dict(chain + ring + stray)

    def walk(x):
        path = [x]
        while parent[path[-1]] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        return path[::-1], parent[path[-1]] in path

    got = {r.id: (r.path, r.cycle) for r in trees.paths_to_root(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()}
    assert got == {k: walk(k) for k in parent}
    assert trees.paths_to_root(spark.createDataFrame([], "id long, parent long")).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_overlaps_of_large_sets(spark, block):
    own = random.Random(2)
    sets = {c: {own.randrange(40) for _ in range(own.randrange(1, 20))} for c in range(30)} | {99: set(range(60))}
    rows = [(c, i) for c, s in sets.items() for i in s] + [(0, next(iter(sets[0]))), (None, 1), (5, None)]
    want = {}
    for s in sets.values():
        for pair in itertools.combinations(sorted(s), 2):
            want[pair] = want.get(pair, 0) + 1
    got = selection.overlapping_sets(spark.createDataFrame(rows, "case_id long, item long"), 4, block)
    assert {(r.left_item, r.right_item): r.shared for r in got.collect()} == {p: n for p, n in want.items() if n >= 4}


def test_places_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = {r.k: r.place for r in selection.numbered(df, [F.desc("k")], 70).collect()}
    assert got == {k: 1000 - k for k in range(1000)}
    assert selection.numbered(df.limit(0), [F.asc("k")]).count() == 0


def test_lookups_level_by_level(spark):
    df = spark.createDataFrame([(1, "running quick dogs slept"), (2, "run"), (3, ""), (4, None)], "id long, phrase string")
    words = spark.createDataFrame([(e,) for e in ("quick dog", "run", "running quick dogs", "dogs", "dog", "slept")], "entry string")
    got = [(r.id, r["rank"], r.entry, r.how) for r in lexicon.looked_up(df, words, 5).orderBy("id", "rank").collect()]
    assert got == [(1, 1, "running quick dogs", "phrase_subspan"), (1, 2, "quick dog", "simple_lemma_subspan"), (1, 3, "run", "token_or_token_lemma"), (1, 4, "dog", "token_or_token_lemma"), (1, 5, "dogs", "token_or_token_lemma"), (2, 1, "run", "exact_phrase")]


def test_refinement_modes_and_odd_rows(spark):
    from spanmill.operators import refinement

    schema = "case_id long, event_id long, s long, e long, family string, cluster string, direction string, magnitude double, repeat_mode string, coupled boolean"
    rows = [
        (1, 1, 0, 9, "WHOLE_BODY_VERTICAL", "WB_VERT_DOWN", "down", 0.3, None, None), (1, 2, 12, 30, "WHOLE_BODY_POSTURE", "WB_SQUAT_HOLD", None, None, None, None), (1, 3, 33, 40, "WHOLE_BODY_VERTICAL", "WB_VERT_UP", "up", 0.05, "", True),
        (2, 4, 0, 9, None, None, None, None, None, None), (2, 5, 5, 40, "TORSO_PERIODIC", "TORSO_SWAY", None, 1.0, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.event_id: (r.refined, r.tags) for r in refinement.refined(df, "v3").collect()}
    assert got == {1: ("WB_VERT_LOW_BODY_DESCENT", ["low_body_transition"]), 2: ("WB_LOW_BODY_DOWN_UP_CYCLE", ["low_body_down_up_cycle"]), 3: ("WB_VERT_GAIT_BOUNCE", ["gait_bounce"]), 4: ("", []), 5: ("TORSO_SWAY_SINGLE_", ["torso_periodic"])}
    assert {r.event_id: r.refined for r in refinement.refined(df, "v1").collect()} == {r[1]: r[5] or "" for r in rows}
    with pytest.raises(ValueError, match="unknown mode"):
        refinement.refined(df, "v9")
    assert refinement.refined(df.limit(0)).count() == 0


def test_promotion_of_nodes(spark):
    from spanmill.operators import decisions

    nodes = spark.createDataFrame([("a", "pending", "closure_required_candidate", ["x"]), ("b", "component", None, ["y"]), ("c", None, None, None), ("d", "accepted", None, []), ("e", "pending", "other", ["x"])], "node string, status string, level string, targets array<string>")
    matches = [("a", k, ["x"] if k < 4 else ["z"], 0.9) for k in range(6)] + [("a", 0, [], 0.1)] + [("b", k, ["q"] if k < 4 else [], 0.5) for k in range(6)] + [("c", k, None, 0.2) for k in range(9)] + [("e", k, ["x"], 0.9) for k in range(5)]
    got = {r.node: r.outcome for r in decisions.promotion(nodes, spark.createDataFrame(matches, "node string, case_id long, aliases array<string>, score double")).collect()}
    assert got == {"a": "promote_review", "b": "keep_component", "c": "split_or_downgrade", "d": "keep_positive", "e": "split_review"}


def in_order(motifs, theta):
    """The family of each motif (symbol, items, n), one after the other."""
    cores, out = {}, {}
    for symbol, items, _ in sorted(motifs, key=lambda r: (-r[2], r[0])):
        shares = [(len(items & core) / min(len(items), len(core)), -k, leader) for k, (leader, core) in enumerate(cores.items())]
        best = max(shares, default=(0.0, 0, ""))
        family = best[2] if best[0] >= theta else symbol
        cores.setdefault(family, set()).update(items)
        out[symbol] = family
    return out


@pytest.mark.parametrize("theta, batch, near, kinds", [(0.6, 150, 8, 400), (0.6, 100, 1, 40), (1.0, 200, 3, 30)])
def test_families_are_those_of_the_order(spark, theta, batch, near, kinds):
    own = random.Random(kinds)
    # A third of all motifs hold one item, some hold only it, some are equal, a few are large.
    draw = lambda: {f"i{int(kinds * own.random() ** 2)}" for _ in range(own.choice([1, 2, 2, 3, 4, 5, 30]))} | ({"hot"} if own.random() < 0.33 else set())
    motifs = [(f"m{k}", draw() if k % 20 else {"hot"}, own.randrange(50)) for k in range(400)]
    df = spark.createDataFrame([(s, [*i, *list(i)[:1]], n) for s, i, n in motifs], "symbol string, items array<string>, n long")
    got = {r.symbol: r.family for r in leaders.leader_families(df, theta, batch, near).collect()}
    assert got == in_order(motifs, theta)
