"""Operators on small frames against brute force and cases worked by hand."""

import random
import zipfile
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.functions import rules as R
from spanmill.functions import text as T
from spanmill.operators import decisions as D
from spanmill.operators import leaders
from spanmill.operators import metrics as M
from spanmill.operators import mining as X
from spanmill.operators import selection as C
from spanmill.operators import sequences as Q
from spanmill.operators import signals as G
from spanmill.operators import spans as S
from spanmill.sources import files as K
from spanmill.streaming.sessions import gap_sessions

SPAN = "case_id long, event_id long, channel string, s long, e long, value double"


def spans(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def some_spans(seed, n=60, cases=3):
    r = random.Random(seed)
    out = []
    for k in range(n):
        s = r.randrange(0, 200)
        out.append((r.randrange(cases), k, r.choice("abc"), s, s + r.randrange(0, 30), float(r.randrange(100))))
    return out


def test_relations_by_hand(spark):
    rows = [(1, 0, "arm", 0, 9, 1.0), (1, 1, "up", 1, 10, 1.0), (1, 2, "arm", 11, 19, 1.0), (1, 3, "up", 11, 19, 1.0)]
    got = {(r.l_event_id, r.r_event_id): (r.relation, r.ov, r.gap) for r in S.relations(spans(spark, rows)).collect()}
    assert got == {
        (0, 1): ("parallel", 9, 0), (2, 3): ("parallel", 9, 0), (0, 2): ("same_channel_adjacent", 0, 1),
        (1, 3): ("same_channel_adjacent", 0, 0), (0, 3): ("lead_lag", 0, 1), (1, 2): ("lead_lag", 0, 0),
    }


@pytest.mark.parametrize("reach", [0, 7, 300])
def test_near_pairs_equal_brute_force(spark, reach):
    rows = some_spans(reach)
    ev = spans(spark, rows)
    got = sorted((r.l_event_id, r.r_event_id) for r in S.near_pairs(ev, ev, reach, width=16).collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and max(a[3], b[3]) <= min(a[4], b[4]) + reach)


def test_merged_and_empty(spark):
    ev = spans(spark, [(1, 0, "a", 0, 3, 0.0), (1, 1, "a", 4, 5, 0.0), (1, 2, "a", 9, 9, 0.0), (1, 3, "a", 1, 2, 0.0)])
    assert sorted((r.s, r.e, r.members) for r in S.merged(ev, 1).collect()) == [(0, 5, 3), (9, 9, 1)]
    none = spans(spark, [])
    assert S.merged(none).count() == S.relations(none).count() == S.near_semi(none, none, 3).count() == 0


def frames(spark, values, case=1):
    return spark.createDataFrame([(case, k, float(v)) for k, v in enumerate(values)], "case_id long, frame long, value double")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 11])
def test_moving_average(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    got = [r.smooth for r in G.moving_average(frames(spark, values), 4).orderBy("frame").collect()]
    padded = np.concatenate([[values[0]] * 2, values, [values[-1]] * 2])
    want = values if n < 3 else [padded[k : k + 5].mean() for k in range(n)]
    assert np.allclose(got, want)


def test_unwrap_gradient_runs(spark):
    angles = np.cumsum(np.random.default_rng(0).normal(0, 90, 50)) % 360
    df = frames(spark, angles)
    assert np.allclose([r.unwrapped for r in G.unwrapped(df, "value", 360.0).orderBy("frame").collect()], np.unwrap(angles, period=360))
    assert np.allclose([r.g for r in df.withColumn("g", G.gradient()).orderBy("frame").collect()], np.gradient(angles))
    runs = G.runs(frames(spark, [1, 1, 0, 1, 0, 0, 1, 1, 1]), F.col("value") > 0, 2).collect()
    assert sorted((r.s, r.e) for r in runs) == [(0, 1), (6, 8)]


def test_peaks_are_spaced_greedily(spark):
    rows = spark.createDataFrame([([1, 2, 5, 6, 9, 14],)], "at array<long>")
    assert rows.select(G.spaced(F.col("at"), 4).alias("x")).first().x == [1, 5, 9, 14]


def rewrite(tokens, a, b):
    out, at = [], 0
    while at < len(tokens):
        if tokens[at : at + 2] == [a, b]:
            out.append(f"{a}+{b}")
            at += 2
        else:
            out.append(tokens[at])
            at += 1
    return out


def test_pair_replacement_equals_left_to_right_rewrite(spark):
    r = random.Random(3)
    rows = [(k, [r.choice("ab") for _ in range(r.randrange(1, 12))]) for k in range(200)]
    df = spark.createDataFrame([(k, "".join(f"<{x}>" for x in t)) for k, t in rows], "case_id long, seq string")
    for a, b in (("a", "a"), ("a", "b"), ("b", "b")):
        got = {x.case_id: x.t for x in df.select("case_id", Q.tokens(Q.replace_pair(F.col("seq"), a, b)).alias("t")).collect()}
        assert got == {k: rewrite(t, a, b) for k, t in rows}


def test_learning_stops_and_longest_match(spark):
    df = spark.createDataFrame([(1, "<a><b><a><b>"), (2, "<a><b><c>")], "case_id long, seq string")
    merges, out = Q.learn_merges(df, 9)
    assert [(m.a, m.b, m.n, m.cases) for m in merges] == [("a", "b", 3, 2)]
    assert sorted(x.seq for x in out.collect()) == ["<a+b><a+b>", "<a+b><c>"]
    one = spark.createDataFrame([("<a><b><c><a><b><d>",)], "seq string").select(Q.longest_match(F.col("seq"), [("a", "b"), ("a", "b", "c")]).alias("x")).first().x
    assert one == "<a+b+c><a+b><d>"


def test_alternations_and_blocks(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate("ABABACC")], "case_id long, frame long, sym string")
    assert [(r.s, r.a, r.b, r.times) for r in Q.alternations(df).collect()] == [(0, "A", "B", 2)]
    assert {(r.s, r.e, r.block, r.times) for r in Q.block_repeats(df).collect()} == {(0, 3, "A>B", 2)}


def test_itemsets_and_closure(spark):
    tx = [(1, {"l", "r", "v"}), (2, {"l", "r", "v"}), (3, {"l", "r"}), (4, {"v"})]
    df = spark.createDataFrame([(t, t % 3, i) for t, items in tx for i in items], "tx long, case_id long, item string")
    got = {tuple(r["items"]): (r.n, r.cases) for r in X.itemsets(df, 3, 2).collect()}
    want = {}
    for k in (2, 3):
        for c in combinations("lrv", k):
            own = [t for t, items in tx if set(c) <= items]
            if len(own) >= 2:
                want[c] = (len(own), len({t % 3 for t in own}))
    assert got == want
    kept = {tuple(r["items"]) for r in X.closed(X.itemsets(df, 3, 2)).collect()}
    assert kept == {("l", "r", "v"), ("l", "r")}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in X.components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[101] == 100


def test_greedy_cover_and_confusion(spark):
    hits = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 9), ("y", 8), ("z", 3)], "symbol string, case_id long")
    truth = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case_id long")
    assert X.greedy_cover(hits, truth, 0.8, 5) == [("x", 2, 1.0), ("z", 1, 1.0)]
    r = M.confusion(truth, spark.createDataFrame([(1,), (7,)], "case_id long")).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 3, 0.5, 0.25)
    none = spark.createDataFrame([], "case_id long")
    assert M.confusion(none, none).first().f1 == 0.0


def test_folds_respect_their_caps(spark):
    rows = [(1, "f", 0, 1, k % 2, float(k), k) for k in range(6)] + [(1, "g", 0, 1, 0, 9.0, 50)]
    df = spark.createDataFrame(rows, "case_id long, family string, s long, e long, level long, score double, id long")
    assert [r.id for r in C.capped(df, "case_id", 2, 4, 10).orderBy(F.desc("score")).collect()] == [50, 5]
    edits = spark.createDataFrame([(1, "a", 0, 5, 3.0, 1), (1, "a", 7, 9, 2.0, 2), (1, "a", 20, 21, 1.0, 3), (1, "b", 0, 5, 0.5, 4)], "case_id long, attribute string, s long, e long, score double, id long")
    assert sorted(r.id for r in X.compatible(edits, 2, 6).collect()) == [1, 3, 4]


def test_greedy_diverse_equals_brute_force(spark):
    cases = {1: ["a", "b"], 2: ["a"], 3: ["c"], 4: ["a", "b", "c"], 5: ["d"]}
    df = spark.createDataFrame([(k, t, 1.0) for k, t in cases.items()], "case_id long, tags array<string>, weight double")
    covered, chosen = {}, []
    for _ in range(4):
        gain = {k: sum(1 / (1 + covered.get(x, 0)) for x in t) for k, t in cases.items() if k not in chosen}
        chosen.append(min(gain, key=lambda k: (-round(gain[k], 9), k)))
        for x in cases[chosen[-1]]:
            covered[x] = covered.get(x, 0) + 1
    assert C.greedy_diverse(df, 4) == chosen


def test_diverse_pick_by_hand(spark):
    rows = [("g", 1, "x", "p", 1), ("g", 2, "x", "q", 2), ("g", 3, "y", "p", 3), ("g", 4, "y", "q", 4), ("g", 5, "z", "r", 5)]
    df = spark.createDataFrame(rows, "k string, id long, base string, tag string, rank long")
    assert sorted(r.id for r in C.diverse(df, "k", 4, F.asc("rank"), F.asc("id")).collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in C.diverse(df, "k", 3, F.asc("rank"), F.asc("id")).collect()) == [1, 2, 4]
    assert C.diverse(df.limit(0), "k", 3, F.asc("rank"), F.asc("id")).count() == 0


def test_abstraction_keeps_the_support(spark):
    rows = some_spans(11)
    got = X.abstracted(spans(spark, rows)).collect()
    assert sum(r.support for r in got) == len(rows)
    for a, b in combinations(got, 2):
        if (a.case_id, a.channel) == (b.case_id, b.channel):
            assert min(a.e, b.e) - max(a.s, b.s) + 1 < 0.6 * (min(a.e - a.s, b.e - b.s) + 1)


def test_one_to_one_takes_each_once(spark):
    pairs = spark.createDataFrame([(1, 0, 10, 20, 5, 0, 3), (1, 1, 11, 20, 9, 0, 3), (1, 1, 11, 21, 1, 0, 3)], "case_id long, l_s long, l_id long, r_id long, ov long, gap long, dur long")
    assert sorted((r.l_id, r.r_id) for r in X.one_to_one(pairs).collect()) == [(10, 20), (11, 21)]


def test_hash_split_is_disjoint_and_sized(spark):
    g = spark.createDataFrame([("b", k) for k in range(11)] + [("one", 0)], "bucket string, grp long")
    got = C.hash_split(g, "bucket", "grp", 20, "42").groupBy("bucket", "split").count().collect()
    assert {(r.bucket, r.split): r["count"] for r in got} == {("b", "test"): 3, ("b", "train"): 8, ("one", "train"): 1}


def test_rules(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "7")], "id long, k string, v string")
    hold = lambda rule: [r.id for r in df.where(R.condition(rule)).collect()]
    assert hold({"path": "v", "op": "truthy"}) == [2]
    assert hold({"not": {"path": "v", "op": "gt", "value": 3}}) == [1]
    assert hold({"all": []}) == [1, 2] and hold({"any": []}) == []
    with pytest.raises(ValueError):
        R.condition({"path": "v", "op": "like"})
    assert [r.x for r in df.select(R.stepped(F.col("id"), [1, 2], ["a", "b", "c"], closed=False).alias("x")).collect()] == ["b", "c"]


def test_text_functions(spark):
    df = spark.createDataFrame([("A re-Run, o'clock 'twas!",)], "t string")
    assert df.select(T.tokens(T.normalized(F.col("t"))).alias("x")).first().x == ["a", "re", "run", "o'clock", "twas"]
    words = spark.createDataFrame([("running",), ("flies",), ("makes",)], "w string").select(T.lemmas(F.col("w")).alias("x")).collect()
    assert "run" in words[0].x and "fly" in words[1].x and "make" in words[2].x


def test_files(spark, tmp_path):
    for folder in ("walk_non_contact_sequences", "s_contact_sequences", "t_neutral_sequences", "other"):
        (tmp_path / folder).mkdir()
        np.savez(tmp_path / folder / f"{folder}.npz", poses=np.zeros((2, 3)))
    np.savez(tmp_path / "walk_non_contact_sequences" / "a.npz", poses=np.zeros((60, 156), np.float32), trans=np.zeros((60, 3)), betas=np.zeros(10), incontact=np.zeros((60, 2), bool), ground_contact_mask=np.zeros((60, 1), np.int8))
    (tmp_path / "walk_non_contact_sequences" / "b.npz").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in K.scan_bundles(spark, str(tmp_path)).collect()}
    a = rows["a.npz"]
    assert (a.poses_shape, a.trans_shape, a.betas_shape, a.incontact_dtype, a.ground_contact_mask_dtype) == ("60x156", "60x3", "10", "bool", "int8")
    assert (a.bucket, a.sequence_group, a.error) == ("non_contact", "walk_non_contact_sequences", None)
    assert [rows[f"{f}.npz"].bucket for f in ("s_contact_sequences", "t_neutral_sequences", "other")] == ["contact", "neutral", "unknown"]
    assert rows["s_contact_sequences.npz"].trans_shape is None and rows["b.npz"].bucket is None
    assert rows["b.npz"].error == "BadZipFile"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("m/1.txt", "abc")
    members = K.archive_members(spark, str(tmp_path))
    wanted = spark.createDataFrame([("m/1.txt",), ("m/2.txt",)], "member string")
    assert {(r.member, r.kind) for r in K.resolve(wanted, members).collect()} == {("m/1.txt", "zip"), ("m/2.txt", "missing")}


def test_flat_yaml():
    @dataclass
    class Config:
        steps: int = 1
        rate: float = 0.1
        name: str = ""
        on: bool = False

    assert K.parse_flat_yaml("steps: 3 # n\n\nrate: 0.5\nname: 'a b'\non: true", Config) == Config(3, 0.5, "a b", True)
    with pytest.raises(ValueError):
        K.parse_flat_yaml("other: 1", Config)


def test_gap_sessions_on_a_stream(spark, tmp_path):
    batch = spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h) AS ts FROM VALUES (0), (5), (40), (41) t(h)")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = gap_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.members for r in spark.table("sessions").collect()) == sorted(r.members for r in gap_sessions(batch).collect()) == [2, 2]


def test_merges_by_support_and_ties(spark):
    seqs = ["a b a b a b a b", "c d", "c d", "c d x", "e f", "e f", "e f"]
    df = spark.createDataFrame([(k, "".join(f"<{t}>" for t in s.split())) for k, s in enumerate(seqs)], "case_id long, seq string")
    steps = lambda **kw: [(m.a, m.b, m.n, m.cases) for m in Q.learn_merges(df, 3, **kw)[0]]
    assert steps() == [("a", "b", 4, 1), ("e", "f", 3, 3), ("c", "d", 3, 3)]  # equal counts: the larger pair first
    assert steps(by_support=True)[:2] == [("e", "f", 3, 3), ("c", "d", 3, 3)]
    assert steps(least_cases=2) == [("e", "f", 3, 3), ("c", "d", 3, 3)]
    assert steps(least=4) == [("a", "b", 4, 1)]


def test_diverse_equals_the_plain_choice(spark):
    r = random.Random(3)
    rows = [(g, i, f"b{r.randrange(6)}", f"t{r.randrange(4)}", r.randrange(50)) for g in "xyz" for i in range(120)]
    df = spark.createDataFrame(rows, "k string, id long, base string, tag string, score long")
    for k in (1, 4, 7):
        want = []
        for g in "xyz":
            own, taken = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[4], x[1])), []
            for x in own:
                if len(taken) < (k + 1) // 2 and x[2] not in {y[2] for y in taken} and x[3] not in {y[3] for y in taken}:
                    taken.append(x)
            want += taken + [x for x in own if x not in taken][: k - len(taken)]
        assert sorted(map(tuple, C.diverse(df, "k", k, F.desc("score"), F.asc("id")).collect())) == sorted(want)


def test_percentiles_and_cut_ranks(spark):
    r = np.random.default_rng(4)
    values = {"a": r.normal(size=500), "b": np.repeat([1.0, 2.0], 40), "c": np.array([3.5]), "d": r.integers(0, 9, 300).astype(float)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan"))], "k string, v double")
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    for bins in (4096, 3):
        got = {x.k: x[1:] for x in M.percentiles(df, ["k"], "v", shares, bins).collect()}
        assert all(got[k] == pytest.approx(tuple(np.quantile(v, shares)), abs=1e-12) for k, v in values.items())
    assert M.percentiles(df.where("k = 'd'"), [], "v", [0.5]).first().p1 == np.median(values["d"])
    keys = [(f"{k * 7919 % 65536:04x}{k}", k) for k in range(300)] + [("0000x", 900 + k) for k in range(20)]
    cut = C.cut_ranks(spark.createDataFrame(keys, "key string, id long"), "key", ["id"], [10, 150], 2)
    order = {i: n for n, (_, i) in enumerate(sorted(keys))}
    assert all(x.part == (order[x.id] >= 10) + (order[x.id] >= 150) for x in cut.collect()) and cut.count() == 320
    assert {x.part for x in C.cut_ranks(spark.createDataFrame(keys, "key string, id long"), "key", ["id"], [0, 0]).collect()} == {2}


def test_itemsets_equal_all_subsets(spark):
    r = random.Random(6)
    tx = {(t, t % 9): {r.choice("abcdefg") for _ in range(r.randrange(1, 6))} for t in range(80)}
    df = spark.createDataFrame([(t, c, i) for (t, c), items in tx.items() for i in items], "tx long, case_id long, item string")
    want = {}
    for size in (2, 3, 4):
        for items in combinations("abcdefg", size):
            hit = [c for (_, c), own in tx.items() if own >= set(items)]
            if len(hit) >= 3:
                want[items] = (len(hit), len(set(hit)))
    got = {tuple(x["items"]): (x.n, x.cases) for x in X.itemsets(df, 4, 3).collect()}
    assert got == want
    closed = {tuple(x["items"]) for x in X.closed(X.itemsets(df, 4, 3)).collect()}
    assert closed == {k for k, (_, c) in want.items() if not any(len(o) > len(k) and set(o) >= set(k) and want[o][1] >= c for o in want)}


def test_decisions_with_other_groups(spark):
    rows = [(1, 1, "a", 0, 1, 0.0), (1, 2, "b", 3, 4, 0.0), (1, 3, "c", 6, 7, 0.0), (1, 4, "d", 9, 9, 0.0)]
    rows += [(2, 5, "a", 0, 9, 0.0), (2, 6, "b", 1, 9, 0.0), (2, 7, "c", 2, 9, 0.0), (2, 8, "d", 3, 9, 0.0)]
    rows += [(3, 9, "a", 0, 0, 0.0), (3, 10, "b", 50, 50, 0.0), (4, 11, "a", 0, 0, 0.0), (4, 12, "z", 0, 0, 9.0)]
    rows += [(5, 13, "a", 0, 1, 0.0), (5, 14, "b", 1, 2, 0.0), (5, 15, "c", 50, 51, 0.0), (5, 16, "d", 51, 52, 0.0)]
    own = spans(spark, rows)
    got = {r.case_id: (r.links, r.status) for r in D.phase_closure(own, ["a", "b", "c", "d"], 2).collect()}
    # Two links that do not meet (case 5) are no chain.
    assert got == {1: (3, "phase_chain"), 2: (6, "phase_closed_all_pairs"), 3: (0, "case_level_only"), 5: (2, "partial")}
    assert D.phase_closure(own.limit(0), ["a", "b"], 2).count() == 0
    w = D.windows(own, 40, F.col("value") > 5)
    got = {(r.case_id, r.w): (r.score, r.verdict) for r in D.split_axis(w, {"a": 0.5, "b": 0.4, "d": -0.3}, ["a"], 0.6).collect()}
    assert got[1, 0] == (0.6, "accepted") and got[3, 0] == (0.5, "below_min") and got[3, 1] == (0.4, "missing_group") and got[4, 0] == (0.5, "blocked")
    cover = {r.case_id: (r.whole, r.best, r.full_case, r.full_window) for r in D.window_coverage(w, ["a", "b"]).collect()}
    assert cover[3] == (2, 1, True, False) and cover[1] == (4, 4, True, True) and cover[4] == (2, 2, False, False)


def test_leader_families(spark):
    df = spark.createDataFrame([("p", ["a", "b"], 9), ("q", ["a", "b", "c"], 8), ("r", ["x", "y"], 7), ("s", ["c", "a"], 9), ("t", [], 1), ("u", None, 1)], "symbol string, items array<string>, n long")
    assert {r.symbol: r.family for r in leaders.leader_families(df, 0.6).collect()} == {"p": "p", "q": "p", "r": "r", "s": "s", "t": "t", "u": "u"}
    assert leaders.leader_families(df.limit(0), 0.6).count() == 0


def test_two_stage_motifs(spark):
    own = spark.createDataFrame([(1, "<a><b><a><b>"), (2, "<a><b><c>")], "case_id long, seq string")
    packets = spark.createDataFrame([(1, "x+y"), (2, "x+y"), (1, "y+z"), (1, "y+z"), (2, None)], "case_id long, symbol string")
    got = sorted((r.stage, r["rank"], r.motif, r.n, r.cases) for r in Q.two_stage_motifs(own, packets, 4).collect())
    assert got == [("channel", 1, "a+b", 3, 2), ("coordination", 1, "x+y", 2, 2)]
    assert Q.two_stage_motifs(own.limit(0), packets.limit(0), 4).count() == 0


def test_state_events_by_hand(spark):
    signals = {
        1: [9, 9, 9, 1, 1, 1, 9, 9, 9, 9],  # one run of three
        2: [1, 1, 9, 9, 9, 9, 1, 2, 9, 9],  # two runs
        3: [1, 1, 9, 1, 1, 9, 9, 9, 9, 9],  # two runs a frame apart are one
        4: [5, 5, 5, 5, 5, 5, 5, 5, 5, 5],  # never low
        5: [1, 1, 1, 1, 1, 1, 1, 1, 1, 1],  # low, but does not move
        6: [9, 9, 9, 1, 9, 9, 9, 9, 9, 9],  # too short
    }
    df = spark.createDataFrame([(c, f, float(v)) for c, own in signals.items() for f, v in enumerate(own)], "case_id long, frame long, value double")
    spec = G.StateDetector("near", 2.0, True, 2, 2, 3.0, 2, 3)
    got = {(r.case_id, r.kind, r.s, r.e, r.magnitude, r["count"]) for r in G.state_events(df, spec).collect()}
    assert got == {(1, "held", 3, 5, 1.0, 1), (1, "enter", 1, 3, 8.0, 1), (1, "leave", 5, 7, 8.0, 1), (2, "repeated", 0, 7, 8.0, 2), (3, "held", 0, 4, 1.0, 1), (3, "leave", 4, 6, 8.0, 1)}
    above = G.state_events(df.withColumn("value", 10 - F.col("value")), G.StateDetector("far", 8.0, False, 2, 2, 3.0, 2, 3))
    assert {(r.case_id, r.kind, r.s, r.e, r.magnitude, r["count"]) for r in above.collect()} == got
    assert G.state_events(df.where("case_id > 9"), spec).count() == 0


def test_level_events_by_hand(spark):
    own = [8, 8, 5, 1, 1, 5, 8, 8, 1, 1, 5, 5, 5, 5, 8, 8]
    df = spark.createDataFrame([(1, f, float(v)) for f, v in enumerate(own)], "case_id long, frame long, value double")
    got = {(r.kind, r.s, r.e) for r in G.level_events(df, 2.0, 7.0, 2, 3).collect()}
    assert got == {("low", 3, 4), ("low", 8, 9), ("down", 1, 3), ("down", 7, 8), ("up", 4, 6), ("low_high_low", 3, 9), ("high_low_high", 0, 7)}


def test_itemset_scopes_by_hand(spark):
    rows = [
        (1, ["left_arm", "left_leg"], ["lower", "upper"], ["arm_vertical_cycle"], 1),
        (2, ["left_arm", "right_arm"], ["upper"], [], 30),
        (3, ["left_arm"], ["upper"], ["arm_reach_retract"], 3),
        (4, ["body", "left_arm"], ["support", "upper"], ["hand_floor_low_support"], 3),
        (5, [], [], [], 3),
    ]
    df = spark.createDataFrame(rows, "id int, channels array<string>, zones array<string>, roles array<string>, cases long")
    got = {r.id: (r.score, r.scope, r.kind) for r in D.itemset_scope(df, 20, 2).collect()}
    log = lambda n: float(np.log1p(n))
    assert got == {
        1: (round(log(1) + 1.5 + 0.3 + 1.8 + 0.8, 4), "upper_lower_coordination_component", "below_threshold"),
        2: (round(log(30) + 0.75 + 0.3 + 0.6, 4), "bilateral_upper_component", "high_support"),
        3: (round(log(3) + 0.75 + 0.15 - 1.6, 4), "local_or_ambiguous_component", "below_threshold"),
        4: (round(log(3) + 1.5 + 0.3 + 1.6 + 1.0, 4), "floor_prone_or_mime_candidate", "high_specificity"),
        5: (round(log(3), 4), "local_or_ambiguous_component", "below_threshold"),
    }


def test_coordination_by_support_and_by_structure(spark):
    rows = [("a", 9, 3, 1, ["root"], ["gait"]), ("b", 4, 4, 2, ["upper", "vertical"], []), ("c", 8, 4, 2, ["lower", "vertical"], ["gait"]), ("d", 9, 1, 2, ["upper", "vertical"], [])]
    df = spark.createDataFrame(rows, "symbol string, n long, cases long, channels int, zones array<string>, marks array<string>")
    assert [r.symbol for r in D.select_coordination(df, 2, least_cases=2).collect()] == ["c", "b"]
    best = [(r.symbol, r.score) for r in D.select_coordination(df, 9, weights=D.STRUCTURE_WEIGHTS).collect()]
    score = lambda cases, weights: round(float(np.log1p(cases)) + 0.7 + 1.1 + weights, 6)
    assert best == [("b", score(4, 1.25)), ("d", score(1, 1.25))]
    assert [r.symbol for r in D.select_coordination(df, 9, weights=D.STRUCTURE_WEIGHTS, least_score=-9.0).collect()] == ["b", "d", "c", "a"]
