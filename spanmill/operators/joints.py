"""Events from joint positions: seven detectors over signals of body joints.

Frames are rows (case_id, frame, joints): frames count from 0 without holes, and
``joints`` is an array of 22 points of three coordinates in the order of ``JOINTS``.
A case may be of any length: it is cut into chunks of ``chunk`` frames, and what a
kernel sees of its neighbours is a halo of a few frames that are entered in both
chunks. Runs are found chunk by chunk; only the first and last run of each chunk
meet those of other chunks, so that runs and merged runs over a seam come out as
one. Sums, extremes and covariances over a span are partial by chunk. The results
are those of a pass over the whole case, whatever the chunk.

Signals come from expressions over a frame: wrists to head, legs and stance to the
side, the height of the pelvis, what supports the body, and how far a wrist is
before the shoulder. Events have the same columns throughout: (case_id, detector,
side, kind, s, e, magnitude, unit, count, details).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from . import metrics, spans

# Joint numbers of the skeleton.
JOINTS = {
    "pelvis": 0, "left_hip": 1, "right_hip": 2, "spine1": 3, "left_knee": 4, "right_knee": 5, "spine2": 6, "left_ankle": 7, "right_ankle": 8, "spine3": 9,
    "left_foot": 10, "right_foot": 11, "neck": 12, "head": 15, "left_shoulder": 16, "right_shoulder": 17, "left_wrist": 20, "right_wrist": 21,
}
SIDES = ("left", "right")
#: Smallest divisor of a length.
TINY = 1e-6


@dataclass(frozen=True)
class StateRule:
    """When a signal is in a state, which runs of it are one, and what counts as a change."""

    threshold: float
    min_run: int
    hold: int  # frames from which on a run is held
    window: int  # frames beside a run that tell a change
    min_delta: float
    merge_gap: int


@dataclass(frozen=True)
class ArmRule:
    """Cuts for orbits and arcs of a wrist around its shoulder."""

    span_gap: int = 6
    span_pad: int = 3
    min_radius: float = 0.18
    orbit_degrees: float = 540.0
    orbit_spread: float = 0.38
    arc_degrees: float = 180.0
    arc_path: float = 1.25
    arc_range: float = 0.40
    arc_spread: float = 0.55
    planarity: float = 0.80


@dataclass(frozen=True)
class ReachRule:
    """Cuts for reaching forward and drawing back."""

    span_gap: int = 4
    span_pad: int = 3
    min_delta: float = 0.16
    min_path: float = 0.22
    min_peak: float = 0.24
    back_ratio: float = 0.55
    min_forward: float = 0.10


@dataclass(frozen=True)
class LevelRule:
    """Cuts for low and high runs of the pelvis and the ways between them."""

    low: float = 0.52
    high: float = 0.58
    min_run: int = 5
    sustained: int = 30
    high_run: int = 8
    max_gap: int = 40
    high_states: bool = False


@dataclass(frozen=True)
class SupportRule:
    """Cuts for bodies that hands support."""

    min_run: int = 6
    merge_gap: int = 4
    low_pelvis: float = 0.34
    horizontal: float = 0.58
    hand_floor: float = 0.12
    foot_high: float = 0.75


HAND = StateRule(0.30, 6, 10, 14, 0.14, 4)
LEG = StateRule(0.16, 5, 10, 10, 0.12, 4)
STANCE = StateRule(0.06, 4, 10, 10, 0.045, 4)


class Point(tuple):
    """Three columns with the arithmetic of vectors."""

    def __sub__(self, other: Point) -> Point:
        return Point(a - b for a, b in zip(self, other, strict=True))

    def middle(self, other: Point) -> Point:
        """Halfway to another point."""
        return Point((a + b) * 0.5 for a, b in zip(self, other, strict=True))

    def dot(self, other: Point) -> Column:
        """Inner product."""
        return self[0] * other[0] + self[1] * other[1] + self[2] * other[2]

    def cross(self, other: Point) -> Point:
        """Cross product."""
        return Point(self[a] * other[b] - self[b] * other[a] for a, b in ((1, 2), (2, 0), (0, 1)))

    def length(self) -> Column:
        """Euclidean norm."""
        return F.sqrt(self.dot(self))

    def level(self, otherwise: tuple[float, float, float]) -> Point:
        """Without height, of length one; ``otherwise`` where nothing is left."""
        norm = F.sqrt(self[0] * self[0] + self[2] * self[2])
        flat = (self[0], F.lit(0.0), self[2])
        return Point(F.when(norm > TINY, a / norm).otherwise(F.lit(b)) for a, b in zip(flat, otherwise, strict=True))


def joint(name: str) -> Point:
    """A joint of a frame."""
    return Point(F.col("joints")[JOINTS[name]][k].cast("double") for k in range(3))


def trunk_axes() -> tuple[Point, Point]:
    """Across the shoulders, and up the trunk; their cross product is where the chest faces."""
    ls, rs = joint("left_shoulder"), joint("right_shoulder")
    return rs - ls, ls.middle(rs) - joint("left_hip").middle(joint("right_hip"))


def lateral_axis() -> Point:
    """From the left to the right hip, level."""
    return (joint("right_hip") - joint("left_hip")).level((1.0, 0.0, 0.0))


def body_height() -> Column:
    """Head above ankles."""
    return F.greatest(joint("head")[1] - joint("left_ankle").middle(joint("right_ankle"))[1], F.lit(TINY))


def state_signals() -> dict[str, Column]:
    """The raw signals of the state detectors."""
    across, pelvis = lateral_axis(), joint("pelvis")
    feet = {side: joint(f"{side}_foot").middle(joint(f"{side}_ankle")) for side in SIDES}
    out = {f"hand_{side}": (joint(f"{side}_wrist") - joint("head")).length() / body_height() for side in SIDES}
    out |= {f"leg_{side}": (feet[side] - pelvis).dot(across) * (-1.0 if side == "left" else 1.0) for side in SIDES}
    return out | {"stance": F.abs((feet["right"] - feet["left"]).dot(across))}


def level_signal() -> Column:
    """The pelvis above the ankles as a share of the body's height."""
    return (joint("pelvis")[1] - joint("left_ankle").middle(joint("right_ankle"))[1]) / body_height()


def limb_length() -> Column:
    """Trunk and one leg of a frame."""
    part = lambda *names: sum(((joint(a) - joint(b)).length() for a, b in zip(names, names[1:], strict=False)), F.lit(0.0))
    return part("pelvis", "spine1", "spine2", "spine3", "neck", "head") + 0.5 * (part("left_hip", "left_knee", "left_ankle") + part("right_hip", "right_knee", "right_ankle"))


def support_signals(scale: Column) -> dict[str, Column]:
    """Raw signals of what supports the body, as shares of its size."""
    feet = [joint(f"{s}_ankle").middle(joint(f"{s}_foot"))[1] for s in SIDES]
    hands = [joint(f"{s}_wrist")[1] for s in SIDES]
    floor = F.least(*feet, *hands)
    trunk = joint("left_shoulder").middle(joint("right_shoulder")) - joint("left_hip").middle(joint("right_hip"))
    return {
        "upright": F.abs(trunk[1]) / F.greatest(trunk.length(), F.lit(TINY)),
        "hand": (F.least(*hands) - floor) / scale,
        "foot": (F.greatest(*feet) - floor) / scale,
        "pelvis": (joint("pelvis")[1] - floor) / scale,
        "head_over_pelvis": (joint("head")[1] - joint("pelvis")[1]) / scale,
    }


def chunked(df: DataFrame, chunk: int, halo: int) -> DataFrame:
    """``df`` with ``chunk`` and ``own``: each frame once in its own chunk, and in the chunks that it is a halo of."""
    lo, hi = F.floor((F.col("frame") - halo) / chunk), F.floor((F.col("frame") + halo) / chunk)
    return df.withColumn("chunk", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi))).withColumn("own", F.col("chunk") == F.floor(F.col("frame") / chunk))


def averaged(column: str, width: int, by: list[str]) -> Column:
    """The mean of ``width`` values around each row of a group in frame order, its ends repeated."""
    order, half = Window.partitionBy(*by).orderBy("frame"), width // 2
    before, after = order.rowsBetween(-half, 0), order.rowsBetween(0, half)
    missing = [(half + 1 - F.count("*").over(w)) * edge.over(w) for w, edge in ((before, F.first(column)), (after, F.last(column)))]
    return (F.sum(column).over(order.rowsBetween(-half, half)) + missing[0] + missing[1]) / width


def smoothed(df: DataFrame, widths: dict[str, int], chunk: int) -> DataFrame:
    """Columns replaced by their moving averages."""
    own = chunked(df, chunk, max(widths.values()) // 2)
    means = {c: averaged(c, width, ["case_id", "chunk"]) for c, width in widths.items()}
    return own.select(*[means.get(c, F.col(c)).alias(c) for c in df.columns], "own").where("own").drop("own")


def chained(runs: DataFrame, by: list[str], reach: int | Column, chunk: int) -> DataFrame:
    """(by, s, e, members): unions of runs (by, s, e) without overlaps whose starts lie at most ``reach`` (a number, or an expression over ``by``) after an end.

    Runs are joined within the chunk of their start; then only the first and last
    union of each chunk meet those of other chunks.
    """

    def joined(df: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("s")
        apart = F.coalesce(F.col("s") - F.lag("e").over(order) > reach, F.lit(True)).cast("int")
        numbered = df.withColumn("_a", apart).withColumn("_n", F.sum("_a").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, "_n").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("members").alias("members"))

    keys = [*by, "_chunk"]
    local = joined(runs.select(*by, "s", "e", F.lit(1).cast("long").alias("members"), F.floor(F.col("s") / chunk).alias("_chunk")), keys)
    local = local.withColumn("_edge", (F.col("_n") == 1) | (F.col("_n") == F.max("_n").over(Window.partitionBy(*keys)))).drop("_n")
    columns = [*by, "s", "e", "members"]
    return local.where("NOT _edge").select(*columns).unionByName(joined(local.where("_edge"), by).select(*columns))


def flag_runs(df: DataFrame, flags: dict[str, Column], by: list[str], min_run: int | Column, merge_gap: int | Column, chunk: int) -> DataFrame:
    """(by, name, s, e, members): runs of ``min_run`` frames or more where a flag holds, those at most ``merge_gap`` apart as one."""
    hits = df.select(*by, "frame", F.explode(F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))).alias("name"))
    keys = [*by, "name"]
    island = F.col("frame") - F.row_number().over(Window.partitionBy(*keys, F.floor(F.col("frame") / chunk)).orderBy("frame"))
    local = hits.withColumn("_i", island).withColumn("_c", F.floor(F.col("frame") / chunk)).groupBy(*keys, "_c", "_i").agg(F.min("frame").alias("s"), F.max("frame").alias("e"))
    whole = chained(local, keys, 1, chunk).where(F.col("e") - F.col("s") + 1 >= min_run)
    return whole if isinstance(merge_gap, int) and merge_gap <= 1 else chained(whole, keys, merge_gap, chunk)


def within(events: DataFrame, frames: DataFrame, by: list[str], lo: Column, hi: Column, chunk: int, halo: int = 0) -> DataFrame:
    """Each event with the frames from ``lo`` to ``hi``: they meet on (by, chunk). With a halo, a frame also stands in the chunks beside its own."""
    first, last = F.floor(F.greatest(lo, F.lit(0)) / chunk), F.floor(hi / chunk)
    entered = events.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("chunk", F.explode(F.sequence(first, last)))
    return entered.join(chunked(frames, chunk, halo), [*by, "chunk"]).where(F.col("frame").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def _events(df: DataFrame, detector, side, kind: Column, magnitude: Column, unit, count: Column, details: dict[str, Column] | None = None) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    held = F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("double"))]) if details else F.lit(None).cast("map<string,double>")
    columns = [F.col("case_id"), as_column(detector).alias("detector"), as_column(side).cast("string").alias("side"), kind.alias("kind"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")]
    return df.select(*columns, F.abs(magnitude.cast("double")).alias("magnitude"), as_column(unit).alias("unit"), count.cast("long").alias("count"), held.alias("details"))


def state_events(frames: DataFrame, hand: StateRule = HAND, leg: StateRule = LEG, stance: StateRule = STANCE, chunk: int = 4096) -> DataFrame:
    """Hands near the head, legs out to the side and wide stances.

    Legs and stance count from their 20th percentile. Two runs or more of a case are one
    ``repeated`` event. A single run is ``held`` or ``brief`` and has an ``enter`` and a
    ``leave`` event where the signal beside it differs enough. Signals whose 10th and
    90th percentile are too near have none.
    """
    rules = {n: hand if n.startswith("hand") else leg if n.startswith("leg") else stance for n in state_signals()}
    raw = frames.select("case_id", "frame", *[c.alias(n) for n, c in state_signals().items()])
    long = smoothed(raw, dict.fromkeys(rules, 5), chunk).select("case_id", "frame", F.inline(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in rules])))
    long = stored(long, "signals")
    by, near = ["case_id", "signal"], F.col("signal").startswith("hand")
    low = metrics.percentiles(long, by, "value", [0.2])
    # As distances, so that a state is at or below its threshold.
    value = long.join(low, by).select(*by, "frame", F.when(near, F.col("value")).otherwise(-F.greatest(F.col("value") - F.col("p1"), F.lit(0.0))).alias("v"))
    value = stored(value, "signals")
    moving = metrics.percentiles(value, by, "v", [0.1, 0.9]).select(*by, (F.col("p2") - F.col("p1")).alias("range"))
    of = lambda field: F.coalesce(*[F.when(F.col("signal") == n, F.lit(getattr(r, field))) for n, r in rules.items()])
    inside = F.col("v") <= F.when(near, of("threshold")).otherwise(-of("threshold"))
    found = flag_runs(value, {"in": inside}, by, of("min_run"), of("merge_gap"), chunk)
    runs = found.groupBy(*by).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("count"))
    runs = runs.join(moving, by).where(F.col("range") >= of("min_delta")).withColumn("window", of("window"))
    at, s, e, w = F.col("frame"), F.col("s"), F.col("e"), F.col("window")
    seen = within(runs, value, by, s - w, e + w, chunk).groupBy(*by, "s", "e", "count", "range", "window").agg(
        F.min(F.when(at.between(s, e), F.col("v"))).alias("best"), F.max(F.when(at < s, F.col("v"))).alias("before"), F.max(F.when(at > e, F.col("v"))).alias("after"), F.max("frame").alias("last")
    )
    one, best = F.col("count") == 1, F.col("best")
    size = F.when(near, F.greatest(of("threshold") - best, F.lit(0.0))).otherwise(-best)
    event = lambda kind, start, end, much: F.struct(kind.alias("kind"), start.alias("s"), end.alias("e"), much.alias("m"))
    changes = F.array_compact(F.array(
        F.when(~one, event(F.lit("repeated"), s, e, F.when(near, F.col("range")).otherwise(-best))),
        F.when(one, event(F.when(e - s + 1 >= of("hold"), "held").otherwise("brief"), s, e, size)),
        F.when(one & (F.col("before") - best >= of("min_delta")), event(F.lit("enter"), F.greatest(s - w, F.lit(0)), s, F.col("before") - best)),
        F.when(one & (F.col("after") - best >= of("min_delta")), event(F.lit("leave"), e, F.col("last"), F.col("after") - best)),
    ))
    out = seen.select("case_id", "signal", "count", F.inline(changes))
    side = F.when(F.col("signal") != "stance", F.substring_index("signal", "_", -1))
    detector = F.when(near, "hand_near_head").when(F.col("signal") == "stance", "stance_width").otherwise("leg_lateral")
    return _events(out, detector, side, F.col("kind"), F.col("m"), F.when(F.col("signal").startswith("hand"), "ratio").otherwise("m"), F.col("count"))


def level_events(frames: DataFrame, rule: LevelRule | None = None, chunk: int = 4096) -> DataFrame:
    """Low runs of the pelvis, the ways down and up to high runs, and the cycles of three runs."""
    rule = rule or LevelRule()
    signal = stored(smoothed(frames.select("case_id", "frame", level_signal().alias("level")), {"level": 7}, chunk), "signals")
    flags = {"low": F.col("level") <= rule.low, "high": F.col("level") >= rule.high}
    runs = stored(flag_runs(signal, flags, ["case_id"], rule.min_run, 0, chunk).select("case_id", "name", "s", "e"), "runs")
    lows, highs = (runs.where(F.col("name") == n).drop("name") for n in ("low", "high"))

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        return spans.near_pairs(a, b, rule.max_gap)

    def following(a: DataFrame, b: DataFrame) -> DataFrame:
        nearest = F.min(F.struct("r_s", "r_e"))
        return beside(a, b).where("r_s >= l_e").groupBy("case_id", F.col("l_s").alias("s"), F.col("l_e").alias("e")).agg(nearest["r_s"].alias("next_s"), nearest["r_e"].alias("next_e"))

    def cycle(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.select("case_id", "s", "next_s").join(second.select("case_id", F.col("s").alias("next_s"), F.col("next_e").alias("e")), ["case_id", "next_s"]).select("case_id", "s", "e")

    rises, falls = following(lows, highs), following(highs, lows)
    down = beside(lows, highs).where("r_e <= l_s").groupBy("case_id", F.col("l_s").alias("e")).agg(F.max("r_e").alias("s"))
    kinds = {"descend_to_low": down, "rise_from_low": rises.select("case_id", F.col("e").alias("s"), F.col("next_s").alias("e")), "low_high_low_cycle": cycle(rises, falls), "high_low_high_cycle": cycle(falls, rises)}
    states = {"low_state": lows} | ({"high_state": highs.where(F.col("e") - F.col("s") + 1 >= rule.high_run)} if rule.high_states else {})
    events = None
    for kind, rows in (states | kinds).items():
        rows = rows.select("case_id", F.lit(kind).alias("kind"), "s", "e")
        events = rows if events is None else events.unionByName(rows)
    events, at, level = stored(events, "events"), F.col("frame"), F.col("level")
    seen = within(events, signal, ["case_id"], F.col("s"), F.col("e"), chunk).groupBy("case_id", "kind", "s", "e").agg(
        F.max(F.when(at == F.col("s"), level)).alias("start"), F.max(F.when(at == F.col("e"), level)).alias("end"), F.min(level).alias("least"), F.max(level).alias("most")
    )
    turns = events.where(F.col("kind").endswith("_cycle")).groupBy("case_id", "kind").count().groupBy("case_id").agg(F.max("count").alias("turns"))
    way = F.col("kind").isin("descend_to_low", "rise_from_low")
    size = F.when(way, F.col("end") - F.col("start")).otherwise(F.col("most") - F.col("least"))
    kind = F.when(F.col("kind") == "low_state", F.when(F.col("e") - F.col("s") + 1 >= rule.sustained, "low_sustained").otherwise("low_brief")).otherwise(F.col("kind"))
    details = {f"{n}_level": F.col(c) for n, c in (("start", "start"), ("end", "end"), ("min", "least"), ("max", "most"))}
    return _events(seen.join(turns, "case_id", "left"), "body_level", F.lit(None), kind, size, "ratio", F.when(F.col("kind").endswith("_cycle"), F.col("turns")), details)


def support_events(frames: DataFrame, rule: SupportRule | None = None, chunk: int = 4096) -> DataFrame:
    """Runs in which the body is upside down on its hands, lies low and level, or is low with a hand on the floor."""
    rule = rule or SupportRule()
    sizes = stored(frames.select("case_id", limb_length().alias("size")), "sizes").where("size > 1e-4 AND size < double('infinity')")
    scale = metrics.percentiles(sizes, ["case_id"], "size", [0.5]).select("case_id", F.greatest("p1", F.lit(0.25)).alias("scale"))
    own = frames.join(scale, "case_id", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    raw = own.select("case_id", "frame", *[c.alias(n) for n, c in support_signals(F.col("scale")).items()])
    signals = stored(smoothed(raw, dict.fromkeys(raw.columns[2:], 5), chunk), "signals")
    hand, foot, low, flat = F.col("hand") <= rule.hand_floor, F.col("foot") >= rule.foot_high, F.col("pelvis") <= rule.low_pelvis, F.col("upright") <= rule.horizontal
    over = hand & foot
    lying = flat & low & hand & ~over
    flags = {"inverted_support": over, "floor_low_horizontal_support": lying, "hand_floor_low_support": hand & low & ~lying & ~over}
    runs = flag_runs(signals, flags, ["case_id"], rule.min_run, rule.merge_gap, chunk)
    seen = within(runs, signals, ["case_id"], F.col("s"), F.col("e"), chunk).groupBy("case_id", "name", "s", "e").agg(
        F.avg("upright").alias("mean_upright"), F.min("upright").alias("min_upright"), F.min("hand").alias("min_hand"), F.max("foot").alias("max_foot"),
        F.avg("pelvis").alias("mean_pelvis"), F.avg("head_over_pelvis").alias("mean_head_over_pelvis"), F.min("head_over_pelvis").alias("min_head"),
    )
    size = F.when(F.col("name") == "inverted_support", -F.col("min_head")).when(F.col("name") == "floor_low_horizontal_support", rule.horizontal - F.col("min_upright")).otherwise(rule.hand_floor - F.col("min_hand"))
    details = {n: F.col(n) for n in ("mean_upright", "min_hand", "max_foot", "mean_pelvis", "mean_head_over_pelvis")}
    return _events(seen, "body_support", F.lit(None), F.col("name"), F.greatest(size, F.lit(0.0)), "ratio", F.lit(None), details)


def arm_frames(frames: DataFrame) -> DataFrame:
    """(case_id, side, frame, x, y, z, forward, lateral): each wrist as its shoulder sees it, and how far forward and aside.

    Step by step, as each value is used many times over: one expression of all would grow beyond what Spark compiles.
    """
    across, up = trunk_axes()
    facing = {f"facing_{k}": c for k, c in zip("xyz", across.cross(up), strict=True)}
    wrists = {f"{side}_{k}": c for side in SIDES for k, c in zip("xyz", joint(f"{side}_wrist") - joint(f"{side}_shoulder"), strict=True)}
    own = frames.select("case_id", "frame", *[c.alias(n) for n, c in (facing | wrists).items()])
    ahead = Point(F.col(n) for n in facing).level((0.0, 0.0, 1.0))
    own = own.select("case_id", "frame", *wrists, ahead[0].alias("ahead_x"), ahead[2].alias("ahead_z"))
    at = lambda side, k: F.col(f"{side}_{k}")
    own = own.withColumns({f"{side}_forward": at(side, "x") * F.col("ahead_x") + at(side, "z") * F.col("ahead_z") for side in SIDES})
    aside = lambda side: F.sqrt(sum(((at(side, k) - F.col(f"ahead_{k}") * at(side, "forward")) ** 2 for k in "xz"), F.lit(0.0)))
    own = own.withColumns({f"{side}_lateral": aside(side) for side in SIDES})
    rows = [F.struct(F.lit(side).alias("side"), *[at(side, n).alias(n) for n in ("x", "y", "z", "forward", "lateral")]) for side in SIDES]
    return own.select("case_id", "frame", F.inline(F.array(*rows))).where(" AND ".join(f"{c} < double('infinity')" for c in ("x", "y", "z", "forward")))


def padded(sources: DataFrame, lengths: DataFrame, gap: int, pad: int) -> DataFrame:
    """(case_id, side, s, e): source spans (case_id, side, s, e) at most ``gap`` apart as one, widened by ``pad`` within the case; of five frames at least."""
    whole = spans.merged(sources, gap, ["case_id", "side"]).join(lengths, "case_id")
    wide = whole.select("case_id", "side", F.col("s").alias("from"), F.col("e").alias("to"), F.greatest(F.col("s") - pad, F.lit(0)).alias("s"), F.least(F.col("e") + pad, F.col("frames") - 1).alias("e"))
    return wide.where("e - s + 1 >= 5")


_KEYS = ["use", "case_id", "side", "from", "to", "s", "e"]
_AXES = ["planarity", "p0", "p1", "p2", "q0", "q1", "q2"]


def _principal(batches):
    """The first two axes of 3 x 3 covariances, the largest component of each positive, and the share of the variance that they hold."""
    for batch in batches:
        xx, xy, xz, yy, yz, zz = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("xx", "xy", "xz", "yy", "yz", "zz"))
        values, vectors = np.linalg.eigh(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3))
        axes = [vectors[:, :, 2], vectors[:, :, 1]]
        axes = [a * np.where(np.take_along_axis(a, np.abs(a).argmax(1)[:, None], 1) < 0, -1.0, 1.0) for a in axes]
        planarity = (values[:, 1] + values[:, 2]) / np.maximum(values.sum(1), 1e-8)
        new = [planarity, *axes[0].T, *axes[1].T]
        kept = [(n, batch.column(n)) for n in batch.schema.names] + [(n, pa.array(v)) for n, v in zip(_AXES, new, strict=True)]
        yield pa.RecordBatch.from_arrays([v for _, v in kept], [n for n, _ in kept])


def trajectories(arms: DataFrame, around: DataFrame, rule: ArmRule, chunk: int) -> DataFrame:
    """``around`` (use, case_id, side, from, to, s, e) with the features of the wrist's way and its kind, null if it is neither an orbit nor an arc."""
    near = within(around, arms, ["case_id", "side"], F.col("s"), F.col("e"), chunk, 1)
    order = Window.partitionBy(*_KEYS, "chunk").orderBy("frame")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(order)) ** 2 for c in "xyz"), F.lit(0.0)))
    seen = near.withColumn("step", step).where("own")
    pairs = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    sums = seen.groupBy(*_KEYS).agg(
        *[F.covar_samp(a, b).alias(a + b) for a, b in pairs], *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"range_{c}") for c in "xyz"], F.sum("step").alias("path")
    )
    schema = ", ".join(f"`{c}` {t}" for c, t in sums.dtypes) + "".join(f", {c} double" for c in _AXES)
    axes = stored(sums.mapInArrow(_principal, schema), "axes")
    flat = near.join(axes.select(*_KEYS, "mx", "my", "mz", *_AXES[1:]), _KEYS)
    on = lambda a: sum(((F.col(c) - F.col(f"m{c}")) * F.col(f"{a}{k}") for k, c in enumerate("xyz")), F.lit(0.0))
    flat = flat.withColumn("u", on("p")).withColumn("v", on("q")).withColumn("angle", F.atan2("v", "u")).withColumn("radius", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))
    turn = F.col("angle") - F.lag("angle").over(order)
    turn = F.when(F.abs(turn) <= F.pi(), turn).otherwise(turn - F.signum(turn) * 2 * F.pi())
    turned = flat.withColumn("turn", F.degrees(turn)).where("own").groupBy(*_KEYS).agg(
        F.sum(F.abs("turn")).alias("total_degrees"), F.sum("turn").alias("net_degrees"), F.avg("radius").alias("radius_mean"), F.stddev_pop("radius").alias("_sd")
    )
    out = axes.join(turned, _KEYS).withColumn("radius_cv", F.col("_sd") / F.greatest("radius_mean", F.lit(TINY))).withColumn("max_range", F.greatest("range_x", "range_y", "range_z"))
    wide = (F.col("radius_mean") >= rule.min_radius) & (F.col("path") >= rule.arc_path) & (F.col("planarity") >= rule.planarity)
    orbit = (F.col("radius_cv") <= rule.orbit_spread) & (F.col("total_degrees") >= rule.orbit_degrees)
    arc = (F.col("radius_cv") <= rule.arc_spread) & (F.col("max_range") >= rule.arc_range) & (F.col("total_degrees") >= rule.arc_degrees)
    return out.withColumn("kind", F.when(wide & orbit, "arm_orbit_cycle").when(wide & arc, "large_arm_arc"))


def arm_events(frames: DataFrame, sources: DataFrame, arm: ArmRule | None = None, reach: ReachRule | None = None, chunk: int = 4096) -> DataFrame:
    """Orbits and arcs of the wrists, and reaches where there is neither, around the source spans (case_id, side, s, e).

    Spans of a side at most a gap apart are one, and are widened. A case without source
    spans of a side is searched whole for a reach. Which way an orbit turns is told
    with the axes pointing along their largest component.
    """
    arm, reach = arm or ArmRule(), reach or ReachRule()
    arms = stored(arm_frames(frames), "arms")
    sources = stored(sources.select("case_id", "side", "s", "e"), "sources")
    lengths = frames.groupBy("case_id").agg((F.max("frame") + 1).alias("frames"))
    # Where there are no source spans of a side, the whole case is searched for a reach.
    both = lengths.select("case_id", F.explode(F.array(*map(F.lit, SIDES))).alias("side"), F.lit(0).cast("long").alias("s"), (F.col("frames") - 1).alias("e"))
    searched = sources.unionByName(both.join(sources, ["case_id", "side"], "left_anti"))
    around = padded(sources, lengths, arm.span_gap, arm.span_pad).withColumn("use", F.lit("arm")).unionByName(padded(searched, lengths, reach.span_gap, arm.span_pad).withColumn("use", F.lit("reach")))
    found = stored(trajectories(arms, around, arm, chunk).where("kind IS NOT NULL"), "ways")
    ways, taken = found.where("use = 'arm'"), found.where("use = 'reach'")
    sign = F.when(F.col("net_degrees") >= 0, "positive").otherwise("negative")
    turns = F.when(F.col("kind") == "arm_orbit_cycle", F.greatest(F.bround(F.col("total_degrees") / 360), F.lit(1.0)))
    details = {n: F.col(n) for n in ("radius_mean", "radius_cv", "path", "max_range", "range_x", "range_y", "range_z", "planarity", "net_degrees")}
    orbits = _events(ways, "arm_trajectory", F.col("side"), F.concat_ws("_", "kind", sign), F.col("total_degrees"), "deg", turns, details)

    # Reaches: around the spans that hold no orbit and no arc.
    around = padded(searched, lengths, reach.span_gap, reach.span_pad).withColumn("use", F.lit("reach")).join(taken, ["case_id", "side", "from", "to"], "left_anti").select(*_KEYS)
    near = within(around, arms, ["case_id", "side"], F.col("s"), F.col("e"), chunk, 3)
    group = [*_KEYS, "chunk"]
    ahead = near.withColumn("f", averaged("forward", 5, group)).withColumn("step", F.abs(F.col("f") - F.lag("f").over(Window.partitionBy(*group).orderBy("frame"))))
    ahead = stored(ahead.where("own").select(*_KEYS, "frame", "f", "step", "lateral"), "reach")
    first = lambda value: F.max_by("frame", F.struct(value, -F.col("frame")))
    ends = ahead.groupBy(*_KEYS).agg(F.max("f").alias("top"), F.min("f").alias("bottom"), first(F.col("f")).alias("top_at"), first(-F.col("f")).alias("bottom_at"), F.sum("step").alias("path"), F.avg("lateral").alias("mean_lateral"))
    back = -F.col("bottom") > F.col("top")
    ends = ends.withColumn("sign", F.when(back, -1.0).otherwise(1.0)).withColumn("peak_frame", F.when(back, F.col("bottom_at")).otherwise(F.col("top_at"))).withColumn("trough_frame", F.when(back, F.col("top_at")).otherwise(F.col("bottom_at")))
    ends = ends.withColumn("peak", F.when(back, -F.col("bottom")).otherwise(F.col("top")))
    g, at = F.col("f") * F.col("sign"), F.col("frame")
    sides = ahead.join(ends.select(*_KEYS, "sign", "peak_frame"), _KEYS).groupBy(*_KEYS).agg(F.min(F.when(at <= F.col("peak_frame"), g)).alias("_before"), F.min(F.when(at >= F.col("peak_frame"), g)).alias("_after"))
    own = ends.join(sides, _KEYS).withColumn("extension", F.col("peak") - F.col("_before")).withColumn("retraction", F.col("peak") - F.col("_after")).withColumn("delta", F.col("top") - F.col("bottom"))
    out, home = F.col("extension") >= reach.min_forward, F.col("retraction") >= reach.min_forward
    kind = F.when(out & home & (F.col("retraction") >= F.col("extension") * reach.back_ratio), "arm_reach_retract").when(out, "arm_reach_extend").when(home, "arm_retract")
    own = own.where((F.col("peak") >= reach.min_peak) & (F.col("delta") >= reach.min_delta) & (F.col("path") >= reach.min_path)).withColumn("kind", kind).where("kind IS NOT NULL")
    details = {n: F.col(n) for n in ("peak", "path", "extension", "retraction", "sign", "peak_frame", "trough_frame", "mean_lateral")}
    return orbits.unionByName(_events(own, "arm_reach", F.col("side"), F.col("kind"), F.col("delta"), "m", F.lit(1), details))


def wrist_over_shoulder(frames: DataFrame, chunk: int = 4096) -> DataFrame:
    """(case_id, side, s, e): runs of frames in which a wrist is higher than its shoulder, as source spans where there are no others."""
    flags = {side: joint(f"{side}_wrist")[1] > joint(f"{side}_shoulder")[1] for side in SIDES}
    return flag_runs(frames, flags, ["case_id"], 1, 0, chunk).select("case_id", F.col("name").alias("side"), "s", "e")


def detected(frames: DataFrame, sources: DataFrame | None = None, hand: StateRule = HAND, leg: StateRule = LEG, stance: StateRule = STANCE, level: LevelRule | None = None, support: SupportRule | None = None, arm: ArmRule | None = None, reach: ReachRule | None = None, chunk: int = 4096) -> DataFrame:
    """The events of all seven detectors; without ``sources``, wrists over shoulders are the source spans.

    Frames without joints, or with a null coordinate, have no signals and are in no
    run. An empty table gives an empty result; other columns are ignored.
    """
    own = stored(frames.select("case_id", F.col("frame").cast("long").alias("frame"), "joints"), "frames")
    sources = wrist_over_shoulder(own) if sources is None else sources
    found = [state_events(own, hand, leg, stance, chunk), level_events(own, level, chunk), support_events(own, support, chunk), arm_events(own, sources, arm, reach, chunk)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
