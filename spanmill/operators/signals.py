"""Signals on frame rows (case_id, frame, value): smoothing, differences, runs, peaks and spans.

All are windows over a case in frame order, or folds over one case's array where
a choice depends on the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, spans


def in_order(*by: str):
    """A case's rows in frame order."""
    return Window.partitionBy(*(by or ("case_id",))).orderBy("frame")


def moving_average(df: DataFrame, width: int = 5, odd: bool = True) -> DataFrame:
    """``smooth``: the mean of ``width`` values around each frame, the ends repeated; fewer than 3 frames stay as they are."""
    width = width + 1 - width % 2 if odd else width
    before, after = width // 2, width - 1 - width // 2
    w = in_order()
    first, last, n = F.first("value").over(w), F.last("value").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.count("*").over(Window.partitionBy("case_id"))
    inner = F.sum("value").over(w.rowsBetween(-before, after))
    short = F.greatest(F.lit(before) - F.col("frame"), F.lit(0)) * first + F.greatest(F.col("frame") + after - (n - 1), F.lit(0)) * last
    return df.withColumn("smooth", F.when(n < 3, F.col("value")).otherwise((inner + short) / width))


def difference(column: str = "value") -> Column:
    """The change from the frame before; 0 at the first."""
    return F.col(column) - F.coalesce(F.lag(column).over(in_order()), F.col(column))


def gradient(column: str = "value") -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(column).over(in_order()), F.lead(column).over(in_order())
    return F.when(before.isNull(), after - F.col(column)).when(after.isNull(), F.col(column) - before).otherwise((after - before) / 2)


def unwrapped(df: DataFrame, column: str, turn: float) -> DataFrame:
    """``unwrapped``: angles without jumps of half a ``turn`` or more."""
    d = F.col(column) - F.lag(column).over(in_order())
    fix = -F.round(d / turn) * turn
    small = F.abs(d) < turn / 2
    df = df.withColumn("_fix", F.coalesce(F.when(small, 0.0).otherwise(fix), F.lit(0.0)))
    return df.withColumn("unwrapped", F.col(column) + F.sum("_fix").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_fix")


def runs(df: DataFrame, flag: Column, least: int = 1) -> DataFrame:
    """(case_id, s, e, length) of maximal runs of frames where ``flag`` holds."""
    hit = df.where(flag)
    island = F.col("frame") - F.row_number().over(in_order())
    return hit.withColumn("island", island).groupBy("case_id", "island").agg(F.min("frame").alias("s"), F.max("frame").alias("e"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def segments(df: DataFrame, state: Column, *by: str) -> DataFrame:
    """``df`` with ``state`` and ``segment``, a number that grows whenever the state changes."""
    df = df.withColumn("state", state)
    w = in_order(*by)
    changed = F.when(F.lag("state").over(w).eqNullSafe(F.col("state")) & F.lag("frame").over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("segment", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def spaced(values: Column, least: int) -> Column:
    """Of an ascending array those at least ``least`` after the one taken before."""
    return F.aggregate(values, F.expr("array()").cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= least), F.concat(acc, F.array(x))).otherwise(acc))


@dataclass(frozen=True)
class StateDetector:
    """A state of a signal: at or below (``below``) or at or above a threshold, for ``min_run`` frames at least."""

    name: str
    threshold: float
    below: bool
    min_run: int
    merge_gap: int  # runs whose starts lie at most this far after an end are one
    min_delta: float  # the 10th and 90th percentile, or the two sides of a change, differ by this at least
    window: int  # frames beside a run that tell a change
    hold: int  # frames from which on a run is held


def state_events(df: DataFrame, spec: StateDetector) -> DataFrame:
    """(case_id, detector, kind, s, e, magnitude, count) of frame rows (case_id, frame, value).

    Two runs or more of a case are one ``repeated`` event from the first to the last. A
    single run is ``held`` or ``brief`` and has an ``enter`` and a ``leave`` event where
    the signal beside it differs enough from its extreme. Cases whose signal hardly
    moves, or never reaches the state, have none.
    """
    v = df.select("case_id", "frame", (F.col("value") if spec.below else -F.col("value")).alias("v"), "value")
    cut = spec.threshold if spec.below else -spec.threshold
    islands = spans.merged(runs(v, F.col("v") <= cut, spec.min_run), spec.merge_gap).groupBy("case_id").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("count"))
    moving = metrics.percentiles(v, ["case_id"], "value", [0.1, 0.9]).select("case_id", (F.col("p2") - F.col("p1")).alias("range")).where(F.col("range") >= spec.min_delta)
    own = islands.join(moving, "case_id")
    at = F.col("frame")
    beside = lambda lo, hi: F.max(F.when((at >= lo) & (at <= hi), F.col("v")))
    seen = v.join(own, "case_id").groupBy("case_id", "s", "e", "count", "range").agg(
        F.min(F.when(at.between(F.col("s"), F.col("e")), F.col("v"))).alias("low"),
        beside(F.col("s") - spec.window, F.col("s") - 1).alias("before"), beside(F.col("e") + 1, F.col("e") + spec.window).alias("after"), F.max("frame").alias("last"), F.min("frame").alias("first"),
    )
    event = lambda kind, s, e, size, n: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), s.alias("s"), e.alias("e"), size.cast("double").alias("magnitude"), n.cast("long").alias("count"))
    one, s, e = F.col("count") == 1, F.col("s"), F.col("e")
    state = F.when(e - s + 1 >= spec.hold, "held").otherwise("brief")
    found = F.array_compact(F.array(
        F.when(~one, event("repeated", s, e, F.col("range"), F.col("count"))),
        F.when(one, event(state, s, e, F.greatest(F.lit(0.0), cut - F.col("low")), F.lit(1))),
        F.when(one & (F.col("before") - F.col("low") >= spec.min_delta), event("enter", F.greatest(s - spec.window, F.col("first")), s, F.col("before") - F.col("low"), F.lit(1))),
        F.when(one & (F.col("after") - F.col("low") >= spec.min_delta), event("leave", e, F.least(e + spec.window, F.col("last")), F.col("after") - F.col("low"), F.lit(1))),
    ))
    return seen.select("case_id", F.lit(spec.name).alias("detector"), F.inline(found))


def level_events(df: DataFrame, low: float, high: float, min_run: int, reach: int) -> DataFrame:
    """(case_id, kind, s, e): runs at or below ``low`` and what joins them to runs at or above ``high`` within ``reach`` frames.

    ``low`` runs; ``down`` from the last high run's end before one, ``up`` to the first
    high run's start after one; ``low_high_low`` and ``high_low_high`` cycles over the
    next runs. Runs meet through ``spans.near_pairs``.
    """
    lows, highs = runs(df, F.col("value") <= low, min_run).drop("length"), runs(df, F.col("value") >= high, min_run).drop("length")

    def following(a: DataFrame, b: DataFrame) -> DataFrame:
        """The next run of b after each run of a: (case_id, s, e, next_s, next_e)."""
        pairs = spans.near_pairs(a, b, reach).where("r_s >= l_e")
        next_run = F.min(F.struct("r_s", "r_e"))
        return pairs.groupBy("case_id", F.col("l_s").alias("s"), F.col("l_e").alias("e")).agg(next_run["r_s"].alias("next_s"), next_run["r_e"].alias("next_e"))

    rises, falls = following(lows, highs), following(highs, lows)
    before = spans.near_pairs(lows, highs, reach).where("r_e <= l_s").groupBy("case_id", "l_s").agg(F.max("r_e").alias("s"))

    def cycle(first: DataFrame, second: DataFrame) -> DataFrame:
        third = second.select("case_id", F.col("s").alias("next_s"), F.col("next_e").alias("e"))
        return first.select("case_id", "s", "next_s").join(third, ["case_id", "next_s"])

    kinds = {"low": lows, "down": before.withColumnRenamed("l_s", "e"), "up": rises.select("case_id", F.col("e").alias("s"), F.col("next_s").alias("e")), "low_high_low": cycle(rises, falls), "high_low_high": cycle(falls, rises)}
    out = None
    for kind, rows in kinds.items():
        rows = rows.select("case_id", F.lit(kind).alias("kind"), "s", "e")
        out = rows if out is None else out.unionByName(rows)
    return out
