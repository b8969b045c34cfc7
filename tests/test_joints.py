"""The seven joint detectors against numpy over whole cases, at several sizes of chunks."""

import math

import numpy as np
import pytest

from spanmill.operators import joints as J
from spanmill.plans import sources
from spanmill.sources.adapters import joint_frames

SF = "/root/testdata/sf0.001"
AT = J.JOINTS


def smooth(x, width):
    pad = width // 2
    return np.convolve(np.pad(x, pad, mode="edge"), np.ones(width) / width, mode="valid")


def runs(mask, least, gap=None):
    out, start = [], None
    for k, hit in enumerate([*mask, False]):
        if hit and start is None:
            start = k
        elif not hit and start is not None:
            if k - start >= least:
                out.append([start, k - 1])
            start = None
    return merged(out, gap) if gap else out


def merged(own, gap):
    out = []
    for s, e in sorted(own):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def level(v, otherwise):
    v = v.copy()
    v[:, 1] = 0
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n > 1e-6, v / np.maximum(n, 1e-6), np.array(otherwise))


def spread(x, share):
    return float(np.percentile(x, share * 100))


class Body:
    """One case's joints by name."""

    def __init__(self, joints):
        self.x = joints

    def __getattr__(self, name):
        return self.x[:, AT[name]]

    def height(self):
        return np.maximum(self.head[:, 1] - (self.left_ankle + self.right_ankle)[:, 1] / 2, 1e-6)

    def sideways(self):
        return level(self.right_hip - self.left_hip, [1.0, 0, 0])

    def ahead(self):
        up = (self.left_shoulder + self.right_shoulder) / 2 - (self.left_hip + self.right_hip) / 2
        return level(np.cross(self.right_shoulder - self.left_shoulder, up), [0, 0, 1.0])

    def feet(self):
        return [(getattr(self, f"{s}_ankle") + getattr(self, f"{s}_foot")) / 2 for s in J.SIDES]


def states(b, rules):
    out = []
    left, right = b.feet()
    signals = {("hand_near_head", s): np.linalg.norm(getattr(b, f"{s}_wrist") - b.head, axis=1) / b.height() for s in J.SIDES}
    signals |= {("leg_lateral", s): ((f - b.pelvis) * b.sideways()).sum(1) * sign for s, f, sign in (("left", left, -1), ("right", right, 1))}
    signals["stance_width", None] = np.abs(((right - left) * b.sideways()).sum(1))
    for (detector, side), raw in signals.items():
        x, hand = smooth(raw, 5), detector.startswith("hand")
        r = rules["hand" if hand else "leg" if side else "stance"]
        if not hand:
            x = np.maximum(x - spread(x, 0.2), 0)
        own = runs(x <= r.threshold if hand else x >= r.threshold, r.min_run, r.merge_gap)
        move = spread(x, 0.9) - spread(x, 0.1)
        if not own or move < r.min_delta:
            continue
        add = lambda kind, s, e, m: out.append((detector, side, kind, s, e, m))  # noqa: B023, E731
        if len(own) > 1:
            add("repeated", own[0][0], own[-1][1], move if hand else x[own[0][0] : own[-1][1] + 1].max())
            continue
        (s, e), v = own[0], x if hand else -x
        best = v[s : e + 1].min()
        add("held" if e - s + 1 >= r.hold else "brief", s, e, max(0, r.threshold - best) if hand else -best)
        before, after = v[max(0, s - r.window) : s], v[e + 1 : e + 1 + r.window]
        if len(before) and before.max() - best >= r.min_delta:
            add("enter", max(0, s - r.window), s, before.max() - best)
        if len(after) and after.max() - best >= r.min_delta:
            add("leave", e, min(len(x) - 1, e + r.window), after.max() - best)
    return out


def levels(b, r):
    x = smooth((b.pelvis[:, 1] - (b.left_ankle + b.right_ankle)[:, 1] / 2) / b.height(), 7)
    low, high, out = runs(x <= r.low, r.min_run), runs(x >= r.high, r.min_run), []
    add = lambda kind, s, e, way=False: out.append(("body_level", None, kind, s, e, x[e] - x[s] if way else x[s : e + 1].max() - x[s : e + 1].min()))
    for s, e in low:
        add("low_sustained" if e - s + 1 >= r.sustained else "low_brief", s, e)
    for s, e in high if r.high_states else []:
        if e - s + 1 >= r.high_run:
            add("high_state", s, e)
    after = lambda own, end: min((q for q in own if 0 <= q[0] - end <= r.max_gap), default=None)
    for s, e in low:
        ends = [q[1] for q in high if 0 <= s - q[1] <= r.max_gap]
        if ends:
            add("descend_to_low", max(ends), s, True)
        if after(high, e):
            add("rise_from_low", e, after(high, e)[0], True)
    for kind, a, c in (("low_high_low_cycle", low, high), ("high_low_high_cycle", high, low)):
        for s, e in a:
            mid = after(c, e)
            if mid and after(a, mid[1]):
                add(kind, s, after(a, mid[1])[1])
    return out


def supports(b, r):
    j, out = b.x, []
    part = lambda *ks: sum(np.linalg.norm(j[:, p] - j[:, q], axis=1) for p, q in zip(ks, ks[1:], strict=False))
    size = part(0, 3, 6, 9, 12, 15) + (part(1, 4, 7) + part(2, 5, 8)) / 2
    scale = max(0.25, float(np.median(size[size > 1e-4]))) if (size > 1e-4).any() else 1.0
    feet, hands = np.stack([f[:, 1] for f in b.feet()]), np.stack([b.left_wrist[:, 1], b.right_wrist[:, 1]])
    floor = np.minimum(feet.min(0), hands.min(0))
    trunk = (b.left_shoulder + b.right_shoulder - b.left_hip - b.right_hip) / 2
    upright = smooth(np.abs(trunk[:, 1]) / np.maximum(np.linalg.norm(trunk, axis=1), 1e-6), 5)
    hand, foot, pelvis, head = (smooth(x / scale, 5) for x in (hands.min(0) - floor, feet.max(0) - floor, b.pelvis[:, 1] - floor, b.head[:, 1] - b.pelvis[:, 1]))
    on_hands, low = hand <= r.hand_floor, pelvis <= r.low_pelvis
    over = on_hands & (foot >= r.foot_high)
    lying = (upright <= r.horizontal) & low & on_hands & ~over
    for kind, mask, best in (("inverted_support", over, -head), ("floor_low_horizontal_support", lying, r.horizontal - upright), ("hand_floor_low_support", on_hands & low & ~lying & ~over, r.hand_floor - hand)):
        out += [("body_support", None, kind, s, e, max(0, best[s : e + 1].max())) for s, e in runs(mask, r.min_run, r.merge_gap)]
    return out


def orbit(rel, r):
    c = rel - rel.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / max(1, len(c) - 1))
    first, second = (a * (-1 if a[np.abs(a).argmax()] < 0 else 1) for a in (axes[:, 2], axes[:, 1]))
    u, v = c @ first, c @ second
    angle, radius = np.unwrap(np.arctan2(v, u)), np.hypot(u, v)
    total, path = np.degrees(np.abs(np.diff(angle)).sum()), np.linalg.norm(np.diff(rel, axis=0), axis=1).sum()
    flat, cv = (values[1] + values[2]) / max(values.sum(), 1e-8), radius.std() / max(radius.mean(), 1e-6)
    if radius.mean() < r.min_radius or path < r.arc_path or flat < r.planarity:
        return None
    sign = "positive" if angle[-1] >= angle[0] else "negative"
    if cv <= r.orbit_spread and total >= r.orbit_degrees:
        return f"arm_orbit_cycle_{sign}", total
    if cv <= r.arc_spread and np.ptp(rel, axis=0).max() >= r.arc_range and total >= r.arc_degrees:
        return f"large_arm_arc_{sign}", total
    return None


def arms(b, sources, arm, reach):
    out, n = [], len(b.x)
    wide = lambda s, e, pad: (max(0, s - pad), min(n - 1, e + pad))
    for side in J.SIDES:
        rel = getattr(b, f"{side}_wrist") - getattr(b, f"{side}_shoulder")
        for span in merged(sources.get(side, []), arm.span_gap):
            s, e = wide(*span, arm.span_pad)
            found = orbit(rel[s : e + 1], arm) if e - s >= 4 else None
            if found:
                out.append(("arm_trajectory", side, found[0], s, e, found[1]))
        for span in merged(sources.get(side, []), reach.span_gap) or [[0, n - 1]]:
            s, e = wide(*span, arm.span_pad)
            if e - s >= 4 and orbit(rel[s : e + 1], arm):
                continue
            s, e = wide(*span, reach.span_pad)
            if e - s < 4:
                continue
            f = smooth((rel[s : e + 1] * b.ahead()[s : e + 1]).sum(1), 5)
            f = -f if -f.min() > f.max() else f
            top = int(f.argmax())
            out_by, back_by, delta = f[top] - f[: top + 1].min(), f[top] - f[top:].min(), f.max() - f.min()
            if f[top] < reach.min_peak or delta < reach.min_delta or np.abs(np.diff(f)).sum() < reach.min_path:
                continue
            if out_by >= reach.min_forward and back_by >= max(reach.min_forward, out_by * reach.back_ratio):
                out.append(("arm_reach", side, "arm_reach_retract", s, e, delta))
            elif out_by >= reach.min_forward or back_by >= reach.min_forward:
                out.append(("arm_reach", side, "arm_reach_extend" if out_by >= reach.min_forward else "arm_retract", s, e, delta))
    return out


def brute(cases, rules):
    out = []
    for case, (x, own) in cases.items():
        b = Body(x)
        found = states(b, rules) + levels(b, rules["level"]) + supports(b, rules["support"]) + arms(b, own, rules["arm"], rules["reach"])
        out += [(case, *f[:5], round(abs(float(f[5])), 4)) for f in found]
    return sorted(out, key=repr)


def seen(df):
    return sorted(((r.case_id, r.detector, r.side, r.kind, r.s, r.e, round(r.magnitude, 4)) for r in df.collect()), key=repr)


def close(got, want):
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(math.isclose(g[6], w[6], abs_tol=2e-4) for g, w in zip(got, want, strict=True))


def motion(n, seed):
    """A standing body that swings its arms and legs, crouches and lies down, slowly."""
    own = np.random.default_rng(seed)
    rest = np.zeros((22, 3))
    for name, at in {"pelvis": (0, 0.9, 0), "left_hip": (-0.1, 0.85, 0), "right_hip": (0.1, 0.85, 0), "spine1": (0, 1.0, 0), "left_knee": (-0.1, 0.45, 0), "right_knee": (0.1, 0.45, 0), "spine2": (0, 1.1, 0), "left_ankle": (-0.1, 0.1, 0), "right_ankle": (0.1, 0.1, 0), "spine3": (0, 1.2, 0), "left_foot": (-0.1, 0, 0.1), "right_foot": (0.1, 0, 0.1), "neck": (0, 1.4, 0), "head": (0, 1.55, 0), "left_shoulder": (-0.2, 1.35, 0), "right_shoulder": (0.2, 1.35, 0), "left_wrist": (-0.4, 1.0, 0.1), "right_wrist": (0.4, 1.0, 0.1)}.items():
        rest[AT[name]] = at
    t = np.arange(n)[:, None, None]
    wave = lambda size: size * np.sin(t / own.uniform(4, 15, (22, 3)) + own.uniform(0, 6, (22, 3)))
    x = rest + wave(0.05)
    for name in ("left_wrist", "right_wrist"):
        x[:, AT[name]] += 2.5 * wave(0.2)[:, AT[name]]
    x[:, :, 1] *= 1 - 0.85 * (np.sin(np.arange(n) / own.uniform(12, 30))[:, None] > 0.5)
    x[:, AT["left_foot"], 0] -= 0.5 * (np.sin(np.arange(n) / 17) > 0.8)
    x[:, AT["left_ankle"], 0] -= 0.5 * (np.sin(np.arange(n) / 17) > 0.8)
    return x


@pytest.mark.parametrize("chunk", [4096, 7])
def test_detectors_equal_brute_force(spark, chunk):
    rules = {"hand": J.HAND, "leg": J.LEG, "stance": J.STANCE, "level": J.LevelRule(0.52, 0.55, 3, 12, 4, 40, True), "support": J.SupportRule(3, 4, 0.34, 0.9, 0.12, 0.05), "arm": J.ArmRule(planarity=0.7, orbit_degrees=200.0, orbit_spread=0.5), "reach": J.ReachRule()}
    cases = {k: (motion(n, k), {} if k % 3 == 0 else {"left": [[2, n // 3], [n // 3 + 3, n // 2]], "right": [[n // 2, n - 1]]}) for k, n in enumerate((160, 90, 61, 7, 4, 1))}
    frames = spark.createDataFrame([(case, k, row.tolist(), 1) for case, (x, _) in cases.items() for k, row in enumerate(x)], "case_id long, frame long, joints array<array<double>>, value int")
    spans = spark.createDataFrame([(case, side, s, e) for case, (_, own) in cases.items() for side, at in own.items() for s, e in at], "case_id long, side string, s long, e long")
    want = brute(cases, rules)
    assert len({w[1:4:2] for w in want}) >= 14 and len({w[1] for w in want}) == 7
    close(seen(J.detected(frames, spans, **rules, chunk=chunk)), want)


def test_query_equals_brute_force(spark):
    held: dict = {}
    for r in joint_frames(spark, SF).orderBy("case_id", "frame").collect():
        held.setdefault(r.case_id, []).append(r.joints)
    cases = {}
    for case, rows in held.items():
        x = np.array(rows)
        b = Body(x)
        cases[case] = x, {s: runs(getattr(b, f"{s}_wrist")[:, 1] > getattr(b, f"{s}_shoulder")[:, 1], 1) for s in J.SIDES}
    want = brute(cases, sources.joint_rules())
    assert len({w[1] for w in want}) == 7
    close(seen(sources.udf04_joint_detectors(spark, SF)), want)


def test_runs_and_chains_at_any_chunk(spark):
    own = np.random.default_rng(4)
    mask = own.random((3, 200)) < 0.7
    df = spark.createDataFrame([(c, k, bool(hit)) for c, row in enumerate(mask) for k, hit in enumerate(row)], "case_id long, frame long, hit boolean")
    for gap in (0, 3):
        want = sorted((c, *span) for c, row in enumerate(mask) for span in runs(row, 2, gap))
        for chunk in (1, 5, 1000):
            got = J.flag_runs(df, {"hit": J.F.col("hit")}, ["case_id"], 2, gap, chunk)
            assert sorted((r.case_id, r.s, r.e) for r in got.collect()) == want


def test_no_frames(spark):
    gone = spark.createDataFrame([(1, k, None) for k in range(9)], "case_id long, frame long, joints array<array<double>>")
    assert J.level_events(gone).count() == 0 and J.wrist_over_shoulder(gone).count() == 0 and J.arm_frames(gone).count() == 0
    assert J.level_events(gone.limit(0)).count() == 0
