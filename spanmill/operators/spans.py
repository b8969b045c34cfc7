"""Closed integer spans: kernels, near-pair joins and what is built on them.

Two spans are near if they overlap or lie at most ``reach`` apart. All joins of
near spans go through ``near_pairs``: spans are entered in time buckets, pairs
meet on (case, bucket) and count only in the bucket of the later start. A case
with very many spans is thereby split over its buckets; nothing compares all
spans of a case with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a0, a1, b0, b1) -> Column:
    """Shared units of two spans."""
    return F.greatest(F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0)) + 1, F.lit(0))


def gap(a0, a1, b0, b1, between: bool = True) -> Column:
    """Units between disjoint spans (``between``) or from the end to the next start; 0 where they overlap."""
    apart = F.greatest(F.col(a0), F.col(b0)) - F.least(F.col(a1), F.col(b1))
    return F.when(apart <= 0, F.lit(0)).otherwise(apart - 1 if between else apart)


def duration(s, e) -> Column:
    """Units of a span."""
    return F.col(e) - F.col(s) + 1


def ratio(a0, a1, b0, b1, of: str = "min") -> Column:
    """Overlap as a share of the shorter span, or of the left one."""
    whole = F.least(duration(a0, a1), duration(b0, b1)) if of == "min" else duration(a0, a1)
    return overlap(a0, a1, b0, b1) / whole


def near_pairs(left: DataFrame, right: DataFrame, reach: int, by: str = "case_id", width: int = 64) -> DataFrame:
    """All pairs of a left and a right span of one case that overlap or start within ``reach`` after the other's end.

    Columns keep their names with ``l_`` and ``r_`` before them; ``by`` stays.
    """

    def entered(df: DataFrame, prefix: str) -> DataFrame:
        own = df.select(by, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != by])
        lo, hi = F.floor(F.col(f"{prefix}s") / width), F.floor((F.col(f"{prefix}e") + reach) / width)
        return own.withColumn("bucket", F.explode(F.sequence(lo, hi)))

    later = F.greatest("l_s", "r_s")
    near = later <= F.least(F.col("l_e"), F.col("r_e")) + reach
    pairs = entered(left, "l_").join(entered(right, "r_"), [by, "bucket"])
    return pairs.where(near & (F.col("bucket") == F.floor(later / width))).drop("bucket")


def relations(events: DataFrame, theta: float = 0.3, most: int = 6) -> DataFrame:
    """Each unordered pair of near spans once, the earlier one left: relation, overlap, ratio, gap."""
    first = F.struct("l_s", "l_e", "l_event_id") < F.struct("r_s", "r_e", "r_event_id")
    pairs = near_pairs(events, events, most + 1).where(first)
    names = ("l_s", "l_e", "r_s", "r_e")
    pairs = pairs.withColumn("ov", overlap(*names)).withColumn("ratio", ratio(*names)).withColumn("gap", gap(*names))
    same = F.col("l_channel") == F.col("r_channel")
    kind = (
        F.when(~same & (F.col("ratio") >= theta), "parallel")
        .when(F.col("gap") > most, F.lit(None))
        .when(same, "same_channel_adjacent")
        .otherwise("lead_lag")
    )
    return pairs.withColumn("relation", kind).where("relation IS NOT NULL")


def near_semi(events: DataFrame, others: DataFrame, reach: int, theta: float | None = None) -> DataFrame:
    """Events with another one near: a gap of at most ``reach``, or an overlap of at least ``theta`` of the shorter."""
    pairs = near_pairs(events, others, reach + 1).where("l_event_id != r_event_id")
    names = ("l_s", "l_e", "r_s", "r_e")
    apart = (F.greatest("l_s", "r_s") > F.least("l_e", "r_e")) & (gap(*names) <= reach)
    touching = ratio(*names) >= theta if theta is not None else overlap(*names) > 0
    hits = pairs.where(apart | touching).select("case_id", F.col("l_event_id").alias("event_id")).distinct()
    return events.join(hits, ["case_id", "event_id"], "left_semi")


def sequel_semi(events: DataFrame, others: DataFrame, reach: int, before: bool = True) -> DataFrame:
    """Events that another one ends before (or starts after), at most ``reach`` away."""
    pairs = near_pairs(events, others, reach).where("l_event_id != r_event_id")
    away = F.col("l_s") - F.col("r_e") if before else F.col("r_s") - F.col("l_e")
    hits = pairs.where(away.between(0, reach)).select("case_id", F.col("l_event_id").alias("event_id")).distinct()
    return events.join(hits, ["case_id", "event_id"], "left_semi")


def uncovered(events: DataFrame, cover: DataFrame) -> DataFrame:
    """Events that no span of ``cover`` overlaps."""
    hits = near_pairs(events, cover, 0).where("l_event_id != r_event_id").select("case_id", F.col("l_event_id").alias("event_id")).distinct()
    return events.join(hits, ["case_id", "event_id"], "left_anti")


def best_match(pairs: DataFrame, of: list[str], order: list[Column]) -> DataFrame:
    """The first pair in ``order`` for each combination of ``of``."""
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where("n = 1").drop("n")


def merged(events: DataFrame, reach: int = 0, by: list[str] | None = None) -> DataFrame:
    """Unions of spans at most ``reach`` apart: (by, s, e, n, members)."""
    by = by or ["case_id"]
    order = Window.partitionBy(*by).orderBy("s", "e")
    seen = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("new", F.when(seen.isNull() | (F.col("s") > seen + reach), 1).otherwise(0))
    numbered = marked.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "n").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("members"))
