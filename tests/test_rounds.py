"""Greedy choices in rounds, merges by an index, sweeps and assembly against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanmill.operators import assembly as B
from spanmill.operators import greedy, merging, sequences
from spanmill.operators.sweeps import sessions, swept
from spanmill.plans import mining
from spanmill.sources.adapters import spans

SF = "/root/testdata/sf0.001"


def test_exclusive_choice_equals_the_sequential_one(spark):
    own = random.Random(3)
    rows = [(own.randrange(4), own.randrange(30), own.randrange(30), own.randrange(6), own.randrange(50)) for _ in range(900)]
    rows += [(9, 1, k, k, k) for k in range(300)]  # one key with many pairs
    rows += [(None, None, 5, 1, 1), (None, None, 6, 1, 2)]
    used, want = [set(), set(), set()], []
    df = spark.createDataFrame(rows, "case_id long, l long, r long, g long, o long")
    taken = greedy.exclusive(df, [["case_id", "l"], ["case_id", "r"], ["g", "case_id"]], [F.col("o"), F.col("l"), F.col("r"), F.col("g"), F.col("case_id")])
    null_first = lambda x: (x is not None, x or 0)
    for r in sorted(set(rows), key=lambda r: tuple(map(null_first, (r[4], r[1], r[2], r[3], r[0])))):
        keys = (r[0], r[1]), (r[0], r[2]), (r[3], r[0])
        if all(k not in u for k, u in zip(keys, used, strict=True)):
            want.append(r)
            for k, u in zip(keys, used, strict=True):
                u.add(k)
    assert sorted(map(tuple, taken.collect()), key=str) == sorted(want, key=str)
    assert greedy.exclusive(df.limit(0), [["l"]], [F.col("o")]).count() == 0


@pytest.mark.parametrize(("by_support", "blocks"), [(False, 16), (True, 3)])
def test_indexed_merges_equal_a_recount(spark, by_support, blocks):
    own = random.Random(8)
    words = ["<a><b><c>", "<a><b>", "<c><c><c>", "<d><a>", "<b><d><d>"]
    rows = [(k, "".join(own.choice(words) for _ in range(own.randrange(12)))) for k in range(120)] + [(500, None)]
    df = spark.createDataFrame(rows, "case_id long, seq string")
    want, left = sequences.learn_merges(df.where("seq IS NOT NULL"), 6, 4, least_cases=2, by_support=by_support)
    got, after = merging.learn_merges(df, 6, 4, least_cases=2, by_support=by_support, blocks=blocks)
    assert [(m.step, m.a, m.b, m.n, m.cases) for m in got] == [(m.step, m.a, m.b, m.n, m.cases) for m in want] and len(got) == 6
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, left.select("case_id", "seq").collect()))
    assert merging.learn_merges(df.limit(0), 3)[0] == []


def test_late_merges_read_few_sequences(spark):
    """Many names: the later a merge, the rarer its pair, and the fewer blocks hold it."""
    own = random.Random(1)
    rows = [(k, "".join(f"<s{min(int(own.paretovariate(0.7)), 400)}>" for _ in range(10))) for k in range(1500)]
    got, _ = merging.learn_merges(spark.createDataFrame(rows, "case_id long, seq string"), 3, blocks=120)
    assert got[0].read > 500 and got[-1].read < got[0].read


def test_sweeps_see_each_group_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") % 3).alias("h"), "id")
    got = swept(df, ["g", "h"], ["id"], lambda own: [{"g": own[0]["g"], "n": len(own), "up": [r["id"] for r in own] == sorted(r["id"] for r in own)}], "g long, n long, up boolean").collect()
    assert len(got) == 21 and sum(r.n for r in got) == 1000 and all(r.up for r in got)
    ev = spark.createDataFrame([(1, 0, 9), (1, 3, 4), (1, 12, 13), (1, 30, 31), (2, 0, 1)], "case_id long, s long, e long")
    assert sorted((r.case_id, r.s, r.session) for r in sessions(ev, ["case_id"], 3, ["s", "e"]).collect()) == [(1, 0, 1), (1, 3, 1), (1, 12, 1), (1, 30, 2), (2, 0, 1)]


def plain_assembly(events, stages, hides):
    """A whole case's actions, its events in time order."""
    def near(n, a, b):
        if (n.channels and b["channel"] not in n.channels) or not b["value"] >= n.least_value:
            return False
        both = min(a["e"], b["e"]) - max(a["s"], b["s"]) + 1
        return max(both, 0) / (min(a["e"] - a["s"], b["e"] - b["s"]) + 1) >= n.least_overlap or max(-both, 0) <= n.most_gap

    covered, actions = set(), []
    for stage in stages:
        for at, x in enumerate(events):
            if at in covered:
                continue
            others = [(k, y) for k, y in enumerate(events) if k != at]
            for em in stage:
                if (em.channels and x["channel"] not in em.channels) or not em.least_value <= x["value"] <= em.most_value:
                    continue
                if any(not any(near(n, x, y) for _, y in others) for n in em.needs):
                    continue
                if any(near(n, x, y) for n in em.unless for _, y in others):
                    break
                own = {at} | {k for n in em.covers for k, y in others if near(n, x, y)}
                covered |= own
                actions.append((em, at, own))
                break
    explained = {k for em, _, own in actions if not em.fallback for k in own}
    actions = [a for a in actions if not (a[0].fallback and a[1] in explained)]
    overlaps = lambda a, b: max(0, min(a["e"], b["e"]) - max(a["s"], b["s"]) + 1) / (min(a["e"] - a["s"], b["e"] - b["s"]) + 1) >= 0.2
    out = []
    for em, at, own in actions:
        over = [o.action for o, k, _ in actions if em.action in hides.get(o.action, ()) and overlaps(events[at], events[k])]
        out.append((events[at]["event_id"], em.action, over[0] if over else None, ",".join(str(events[k]["event_id"]) for k in sorted(own))))
    rest = [(x["event_id"], "residual", None, "") for k, x in enumerate(events) if k not in {j for _, _, own in actions for j in own}]
    return out + rest


def test_assembly_equals_a_pass_over_whole_cases(spark):
    cases: dict = {}
    for r in spans(spark, SF).collect():
        cases.setdefault(r.case_id, []).append(r.asDict())
    want = []
    for own in cases.values():
        want += plain_assembly(sorted(own, key=lambda r: (r["s"], r["e"], r["event_id"])), mining.STAGES, mining.HIDES)
    got = [(r.event_id, r.action, r.hidden_by, r.covered) for r in mining.mine25_ordered_emitters(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {a for _, a, _, _ in want} == {"order", "trouble", "tour", "look", "rest", "residual"} and any(h for _, _, h, _ in want)


def test_assembly_on_dense_and_odd_events(spark):
    own = random.Random(5)
    rows = [(1, k, own.choice(["a", "b", "c"]), s := own.randrange(200), s + own.randrange(9), float(own.randrange(20))) for k in range(150)]
    rows += [(2, 900, None, 1, 2, None), (2, 901, "a", 2, 3, 9.0)]
    stages = [[B.Emitter("first", ("a",), 5.0, unless=(B.Near(("c",), 0.9),), covers=(B.Near(("b",), 0.2, 2),)), B.Emitter("second", ("a", "b"), covers=(B.Near(most_gap=1),))], [B.Emitter("last", fallback=True, covers=(B.Near(("c",), 0.1),))]]
    df = spark.createDataFrame(rows, "case_id long, event_id long, channel string, s long, e long, value double")
    want = []
    for case in (1, 2):
        events = [{"event_id": i, "channel": c or "", "s": s, "e": e, "value": float("nan") if v is None else v} for k, i, c, s, e, v in sorted(rows, key=lambda r: (r[3], r[4], r[1])) if k == case]
        want += plain_assembly(events, stages, {"first": ("second",)})
    actions = B.assembled(df, stages, {"first": ("second",)})
    got = [(r.event_id, r.action, r.hidden_by, ",".join(map(str, r.covered))) for r in actions.collect()] + [(r.event_id, "residual", None, "") for r in B.residual(df, actions).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert B.assembled(df.limit(0), stages).count() == 0
