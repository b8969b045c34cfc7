"""Queries that SQL cannot express, over their whole smallest tables, against plain Python written from their definitions."""

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from spanmill import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = plans.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def got(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def keyed(found, *columns):
    return sorted(tuple(r[c] for c in columns) for r in found)


@pytest.fixture(scope="module")
def events():
    """Events as spans of whole hours, by user."""
    out = defaultdict(list)
    for r in rows("events"):
        s = int(r["ts"].timestamp() // 3600) if r["ts"].tzinfo else int(np.datetime64(r["ts"], "us").astype("int64") // 3_600_000_000)
        out[r["user_id"]].append({"id": r["event_id"], "channel": r["event_type"], "s": s, "e": s + math.floor(r["value"] / 10), "value": r["value"], "ts": r["ts"]})
    return out


def picks(own, k, order):
    own, taken = sorted(own, key=order), []
    for r in own:
        if len(taken) < (k + 1) // 2 and all(r["base"] != t["base"] and r["tag"] != t["tag"] for t in taken):
            taken.append(r)
    return taken + [r for r in own if r not in taken][: k - len(taken)]


def test_greedy_diverse(spark, events):
    tags = {c: {f"{r['channel']}:{math.floor(r['value'] / 40)}" for r in own} for c, own in events.items()}
    covered, chosen = Counter(), []
    for _ in range(5):
        gain = {c: round(sum(len(events[c]) / (1 + covered[t]) for t in own), 9) for c, own in tags.items() if c not in chosen}
        chosen.append(min(gain, key=lambda c: (-gain[c], c)))
        covered.update(tags[chosen[-1]])
    assert keyed(got(spark, "sort07_greedy_diverse"), "step", "case_id") == list(enumerate(chosen, 1))


def test_diverse_pick(spark):
    groups = defaultdict(list)
    for r in rows("part"):
        groups[r["p_brand"]].append({"id": r["p_partkey"], "base": r["p_name"], "tag": r["p_type"], "price": r["p_retailprice"]})
    want = sorted((b, r["id"]) for b, own in groups.items() for r in picks(own, 6, lambda r: (-r["price"], r["id"])))
    assert keyed(got(spark, "sort09_diverse_pick"), "p_brand", "id") == want


def test_representatives(spark, events):
    counts, sizes, groups = Counter(), Counter(), defaultdict(list)
    for case, own in events.items():
        for r in own:
            counts[r["channel"], case, str(math.floor(r["value"] / 40))] += 1
            sizes[r["channel"], case] += 1
    for (channel, case, tag), n in counts.items():
        groups[channel].append({"id": case, "base": str(case % 20), "tag": tag, "share": n / sizes[channel, case], "n": n})
    want = sorted((c, r["id"], r["tag"]) for c, own in groups.items() for r in picks(own, 8, lambda r: (-r["share"], -r["n"], r["id"], r["tag"])))
    assert keyed(got(spark, "sort13_representatives"), "channel", "id", "tag") == want


def test_capped_dedupe(spark, events):
    want = []
    for own in events.values():
        seen, spans, levels = set(), Counter(), Counter()
        for r in sorted(own, key=lambda r: (-r["value"], r["id"])):
            span, level = (r["s"] // 24, r["e"] // 24), math.floor(r["value"] / 50)
            if len(seen) < 10 and (r["channel"], span) not in seen and spans[span] < 2 and levels[level] < 4:
                seen.add((r["channel"], span))
                spans[span] += 1
                levels[level] += 1
                want.append((r["id"],))
    assert keyed(got(spark, "sort10_capped_dedupe"), "id") == sorted(want)


def test_event_abstraction(spark, events):
    want = []
    for own in events.values():
        for channel in {r["channel"] for r in own}:
            kept = []
            for r in sorted((r for r in own if r["channel"] == channel), key=lambda r: (r["s"] - r["e"], -r["value"], r["id"])):
                near = [k for k in kept if min(k[0]["e"], r["e"]) - max(k[0]["s"], r["s"]) + 1 >= 0.6 * (min(k[0]["e"] - k[0]["s"], r["e"] - r["s"]) + 1)]
                if near:
                    near[0][1] += 1
                else:
                    kept.append([r, 1])
            want += [(k["id"], n) for k, n in kept]
    assert keyed(got(spark, "mine16_event_abstraction"), "event_id", "support") == sorted(want)


def test_multi_edit_selection(spark, events):
    want = []
    for own in events.values():
        taken = []
        for r in sorted(own, key=lambda r: (-r["value"], r["id"])):
            if len(taken) < 6 and not any(t["channel"] == r["channel"] and t["s"] <= r["e"] + 12 and r["s"] <= t["e"] + 12 for t in taken):
                taken.append(r)
        want += [(r["id"],) for r in taken]
    assert keyed(got(spark, "mine30_multi_edit_selection"), "id") == sorted(want)


def test_one_to_one_assignment(spark, events):
    want = []
    for own in events.values():
        used = set()
        for a in sorted((r for r in own if r["channel"] == "click"), key=lambda r: (r["s"], r["id"])):
            free = []
            for b in own:
                apart = max(a["s"], b["s"]) - min(a["e"], b["e"])
                if b["channel"] == "purchase" and b["id"] not in used and apart <= 6:
                    free.append((-max(0, 1 - apart), max(0, apart), b["s"] - b["e"], b["id"]))
            if free:
                used.add(min(free)[3])
                want.append((a["id"], min(free)[3]))
    assert keyed(got(spark, "join20_one_to_one_assignment"), "l_id", "r_id") == sorted(want)


def test_precision_cover(spark):
    labels = {r["doc_id"]: r["toxic"] for r in rows("labels")}
    hits = defaultdict(set)
    for r in rows("documents"):
        if r["doc_id"] in labels:
            for w in re.split("[^a-z]+", (r["text"] or "").lower()):
                if len(w) >= 4:
                    hits[w].add(r["doc_id"])
    tp, fp, done, want = 0, 0, set(), []
    for step in range(1, 6):
        gains = {}
        for w, docs in hits.items():
            t = sum(labels[d] == 1 for d in docs - done)
            f = len(docs - done) - t
            if t and (tp + t) / (tp + t + fp + f) >= 0.8:
                gains[w] = (-t, f, w)
        if not gains:
            break
        t, f, w = min(gains.values())
        tp, fp, done = tp - t, fp + f, done | hits[w]
        want.append((step, w, -t, tp / (tp + fp)))
    assert keyed(got(spark, "mine15_precision_cover"), "step", "symbol", "gained", "precision") == want


def test_leader_clustering(spark):
    counts = Counter(r.symbol for r in QUERIES["mine07_anchored_packets"](spark, SF).collect())
    cores, want = [], []
    for symbol, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        items = set(symbol.split("+"))
        shares = [len(items & core) / min(len(items), len(core)) for _, core in cores]
        if shares and max(shares) >= 0.6:
            family, core = cores[shares.index(max(shares))]
            core |= items
        else:
            family = symbol
            cores.append((symbol, items))
        want.append((symbol, family))
    assert keyed(got(spark, "mine14_leader_clustering"), "symbol", "family") == sorted(want)


def test_alternations(spark):
    turns, want = defaultdict(list), []
    for r in sorted(rows("conversations"), key=lambda r: r["turn"]):
        turns[r["conv_id"]].append(r["role"])
    for case, x in turns.items():
        at = 0
        while at + 1 < len(x):
            end = at + 2
            while x[at] != x[at + 1] and end + 1 < len(x) and x[end] == x[at] and x[end + 1] == x[at + 1]:
                end += 2
            if end - at >= 4:
                want.append((case, at, x[at], x[at + 1], (end - at) // 2))
            at = end if end - at >= 4 else at + 1
    assert keyed(got(spark, "win16_alternations"), "case_id", "s", "a", "b", "times") == sorted(want)


def test_block_repeats(spark, events):
    want = set()
    for case, own in events.items():
        x = [r["channel"] for r in sorted(own, key=lambda r: (r["ts"], r["id"]))]
        for w in (4, 3, 2):
            at = 0
            while at + 2 * w <= len(x):
                end = at + w
                while x[end : end + w] == x[at : at + w]:
                    end += w
                if end - at > w:
                    if not any(o[:4] == (case, at, end - 1, ">".join(x[at : at + w])) for o in want):
                        want.add((case, at, end - 1, ">".join(x[at : at + w]), (end - at) // w))
                    at = end
                else:
                    at += 1
    assert keyed(got(spark, "win17_block_repeats"), "case_id", "s", "e", "block", "times") == sorted(want)


def test_trajectory_axes(spark):
    own = defaultdict(list)
    for r in rows("embeddings"):
        own[r["label"]].append(r["embedding"][:3])
    found = {r["case_id"]: r for r in got(spark, "math05_trajectory_axes")}
    assert set(found) == set(own)
    for case, x in own.items():
        want = np.linalg.eigvalsh(np.cov(np.array(x, float).T, bias=True))[::-1]
        assert np.allclose([found[case][n] for n in ("first", "second", "third")], want, atol=2e-6)
        assert abs(found[case]["planarity"] - (1 - want[2] / want[1])) < 2e-5
