"""Aggregates: support, shares, summaries, confusion and association scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def support(df: DataFrame, *keys: str, case: str = "case_id") -> DataFrame:
    """Occurrences and distinct cases of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(case).alias("cases"))


def top(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group (of all rows, if ``by`` is empty) in a total order."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def magnitude_bin(v: Column, parts: int = 256) -> Column:
    """A number that grows with ``v``: ``parts`` bins of equal width between two powers of two, so that far values cost a bin each and crowd no others."""
    size = F.abs(v)
    power = F.least(F.floor(F.log2(size)), F.lit(1023))
    own = (power + 1100) * parts + F.floor((size / F.pow(F.lit(2.0), power) - 1) * parts)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v) * F.when(size == float("inf"), F.lit(1 << 40)).otherwise(own)).cast("long")


def _located(sizes: DataFrame, ranks: DataFrame, keys: list[str], bin_of: str) -> DataFrame:
    """``ranks`` (keys, _r, _before...) with the bin that holds each rank; ``_before`` grows by what the bins before it hold."""
    upto = sizes.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy(bin_of)))
    at = F.col("_r") - F.col("_before")
    found = ranks.join(upto, keys).where((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")))
    return found.withColumn("_before", F.col("_before") + F.col("_upto") - F.col("_c")).drop("_upto", "_c")


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """(by..., p1, p2, ...): exact percentiles of each group, linear between neighbours; null and NaN values are left out.

    Ranks are found by counts, twice: in bins by magnitude, then in ``bins`` bins of equal
    width within those that hold a wanted rank. Only the values of the last bins are put
    in order, equal ones as one row. Infinite values have bins of their own: a rank
    between a finite and an infinite value gives the infinite one.
    """
    keys = by or ["_one"]
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    v = (v if by else v.withColumn("_one", F.lit(1))).withColumn("_bin", magnitude_bin(F.col("_v")))
    sizes = v.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    wanted = F.array(*[F.struct(F.lit(k).alias("_k"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_at")) for k, p in enumerate(shares)])
    ranks = sizes.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*keys, F.inline(wanted))
    ranks = ranks.select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_r"), F.lit(0).cast("long").alias("_before"))
    first = _located(sizes, ranks, keys, "_bin")
    cells = [*keys, "_bin"]
    inside = v.join(first.select(*cells).distinct(), cells)
    ends = inside.groupBy(*cells).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sub = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).otherwise(0)
    placed = inside.join(ends, cells).select(*cells, sub.alias("_sub"), "_v")
    second = _located(placed.groupBy(*cells, "_sub").agg(F.count("*").alias("_c")), first, cells, "_sub")
    last = [*cells, "_sub"]
    values = placed.join(second.select(*last).distinct(), last).groupBy(*last, "_v").agg(F.count("*").alias("_c"))
    found = _located(values, second, last, "_v").groupBy(*keys, "_k", "_at").agg(F.min_by("_v", "_r").alias("_low"), F.max_by("_v", "_r").alias("_high"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    x = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_low") == float("-inf"), F.col("_low")).otherwise(between)
    names = [f"p{k + 1}" for k in range(len(shares))]
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, x)).alias(n) for k, n in enumerate(names)]).select(*by, *names)


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where the whole is 0 or unknown."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)).cast("double")


def entropy(df: DataFrame, by: str, count: str) -> DataFrame:
    """Shannon entropy in bits of the counts of each group, each share raised by 1e-12 in the logarithm."""
    p = F.col(count) / F.sum(count).over(Window.partitionBy(by))
    return df.withColumn("_p", p).groupBy(by).agg(F.sum(-F.col("_p") * F.log2(F.col("_p") + 1e-12)).alias("entropy"))


def confusion(truth: DataFrame, predicted: DataFrame, case: str = "case_id") -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall and F1 of two case sets."""
    t = truth.select(case).distinct().withColumn("t", F.lit(True))
    p = predicted.select(case).distinct().withColumn("p", F.lit(True))
    counts = t.join(p, case, "full_outer").agg(
        F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    counts = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return counts.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def name_score(precision: Column, recall: Column, jaccard: Column, lift: Column, cases: Column) -> Column:
    """Blend of precision, recall, overlap, lift (log2, at most 1 at eightfold) and support (log1p, at most 1 at 100)."""
    lifted = F.least(F.greatest(F.log2(F.greatest(lift, F.lit(1e-9))) / 3, F.lit(0.0)), F.lit(1.0))
    supported = F.least(F.log1p(cases) / F.log1p(F.lit(100.0)), F.lit(1.0))
    return 0.35 * precision + 0.30 * recall + 0.20 * jaccard + 0.10 * lifted + 0.05 * supported
