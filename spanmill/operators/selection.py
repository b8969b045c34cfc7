"""Splits, capped and diverse selections.

Choices that depend on those made before are folds over one case's short list,
or driver loops with one small aggregate a step; everything else is a window.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .folds import folded


def hash_split(groups: DataFrame, bucket: str, group: str, percent: int, seed: str) -> DataFrame:
    """``groups`` with ``split``: of each bucket's groups, in the order of sha1(seed:group), the first ``percent`` (rounded up; one at least if there are two) are 'test'."""
    key = F.sha1(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")).cast("binary"))
    of = Window.partitionBy(bucket)
    n = F.count("*").over(of)
    wanted = F.when(n > 1, F.greatest(F.floor((n * percent + 99) / 100), F.lit(1))).otherwise(0)
    rank = F.row_number().over(of.orderBy(key, group))
    return groups.withColumn("split", F.when(rank <= wanted, "test").otherwise("train"))


def greedy_diverse(cases: DataFrame, k: int) -> list:
    """The k cases (case_id, tags array, weight) that add most: each step takes the case with the largest weight summed over its tags, divided by 1 + the times a tag is covered."""
    spark, covered, chosen = cases.sparkSession, {}, []
    tags = cases.select("case_id", "weight", F.explode("tags").alias("tag"))
    for _ in range(k):
        seen = spark.createDataFrame([(t, n) for t, n in covered.items()], "tag string, n long")  # tags of the chosen only
        gain = tags.join(F.broadcast(seen), "tag", "left").groupBy("case_id").agg(F.sum(F.col("weight") / (1 + F.coalesce("n", F.lit(0)))).alias("gain"))
        left = gain.where(~F.col("case_id").isin(chosen)) if chosen else gain
        best = left.orderBy(F.desc(F.round("gain", 9)), "case_id").limit(1).collect()
        if not best:
            break
        chosen.append(best[0].case_id)
        for r in cases.where(F.col("case_id") == best[0].case_id).select(F.explode("tags").alias("tag")).collect():
            covered[r.tag] = covered.get(r.tag, 0) + 1
    return chosen


def greedy_quota(pool: DataFrame, quotas: dict[str, int], total: int) -> DataFrame:
    """Cases (case_id, base, category, score) by quota: the best of each category, one of each ``base``, then the best of the rest until ``total``.

    A base goes to its best row first, so that each category's pick is a rank.
    """
    first = pool.withColumn("_b", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("score"), "case_id"))).where("_b = 1").drop("_b")
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("category") == name, n).otherwise(quota)
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "case_id"))).withColumn("kind", F.when(F.col("_n") <= quota, "quota").otherwise("fill"))
    ordered = ranked.orderBy(F.desc(F.col("kind") == "quota"), F.desc("score"), "case_id").limit(total)
    return ordered.drop("_n")


def diverse(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """k rows (id, base, tag) of each group in this total order: until half are taken none that repeats a base or tag, then the first left over.

    Only a bounded number of rows of a group can be taken: the first k, and of the
    best row of each base and tag those among the first ``half`` of their base and of
    their tag, of which fewer than 2 half ** 2 + half are passed over. Windows find
    them; the fold sees no others.
    """
    half = (k + 1) // 2

    def first(df: DataFrame, n: int, *keys: str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(by, *keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")

    lead = first(first(first(first(rows, 1, "base", "tag"), half, "base"), half, "tag"), 2 * half * half + half)
    some = lead.unionByName(first(rows, k)).distinct()
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))

    def pick(own: list[dict]) -> list[dict]:
        own = sorted(own, key=lambda r: r["_rank"])
        taken, bases, tags = [], set(), set()
        for r in own:
            if len(taken) >= (k + 1) // 2:
                break
            if r["base"] not in bases and r["tag"] not in tags:
                taken.append(r)
                bases.add(r["base"])
                tags.add(r["tag"])
        return taken + [r for r in own if r not in taken][: k - len(taken)]

    return folded(ranked, [by], pick, ranked.schema).drop("_rank")


def cut_ranks(rows: DataFrame, key: str, ids: list[str], cuts: list[int], digits: int = 4) -> DataFrame:
    """``rows`` with ``part``: how many of the ranks ``cuts`` each row lies beyond, in the order of a hexadecimal ``key``, then of ``ids``.

    Counts by the key's first digits find where each rank lies; only rows there are put in order.
    """
    head = F.substring(key, 1, digits)
    counts = rows.groupBy(head.alias("_head")).agg(F.count("*").alias("_c"))  # 16 ** digits rows at most
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_head")))
    at = [upto.where((F.col("_upto") >= n) & (F.col("_upto") - F.col("_c") < n)).select(F.lit(n).alias("n"), "_head", (F.col("_upto") - F.col("_c")).alias("before")) for n in cuts if n > 0]
    found = reduce(DataFrame.unionByName, at).collect() if at else []  # one row for each cut
    split = {r._head: r.before for r in found}
    beyond = reduce(lambda a, b: a + b, [F.when(head > r._head, 1).otherwise(0) for r in found], F.lit(sum(n <= 0 for n in cuts)))
    rows = rows.withColumn("part", beyond).withColumn("_head", head)
    rest = rows.where(~F.col("_head").isin(*split)) if split else rows
    if not split:
        return rest.drop("_head")
    before = F.create_map(*[x for h, b in split.items() for x in (F.lit(h), F.lit(b))])
    place = before[F.col("_head")] + F.row_number().over(Window.partitionBy("_head").orderBy(key, *ids))
    inside = rows.where(F.col("_head").isin(*split)).withColumn("_place", place)
    passed = reduce(lambda a, b: a + b, [F.when((F.col("_head") == r._head) & (F.col("_place") > r.n), 1).otherwise(0) for r in found])
    inside = inside.withColumn("part", F.col("part") + passed).drop("_place")
    return rest.unionByName(inside).drop("_head")


def capped(rows: DataFrame, by: str, per_span: int, per_level: int, most: int) -> DataFrame:
    """Rows (family, s, e, level, score, id) of each case by falling score: each (family, span) once, ``per_span`` of a span, ``per_level`` of a level, ``most`` in all."""

    def pick(own: list[dict]) -> list[dict]:
        keys, on_span, on_level, taken = set(), Counter(), Counter(), []
        for r in sorted(own, key=lambda r: (-r["score"], r["id"])):
            span = (r["s"], r["e"])
            if len(taken) < most and (r["family"], span) not in keys and on_span[span] < per_span and on_level[r["level"]] < per_level:
                keys.add((r["family"], span))
                on_span[span] += 1
                on_level[r["level"]] += 1
                taken.append(r)
        return taken

    return folded(rows, [by], pick, rows.schema)


def trimmed(rows: Column, budget: int) -> Column:
    """Of an array of structs (salience, pos, words, text) those that stay when the least salient go until the words fit the budget."""
    by_worth = F.array_sort(rows, lambda a, b: F.when(a["salience"] != b["salience"], F.when(a["salience"] > b["salience"], -1).otherwise(1)).otherwise(F.when(a["pos"] < b["pos"], -1).otherwise(1)))
    upto = F.transform(by_worth, lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice(by_worth, 1, i + 1), F.lit(0), lambda t, y: (t + y["words"]).cast("int")).alias("upto")))
    kept = F.transform(F.filter(upto, lambda x: x["upto"] <= budget), lambda x: x["x"])
    return F.array_sort(kept, lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1))


def numbered(df: DataFrame, order: list[Column], each: int = 200_000) -> DataFrame:
    """``df`` with ``place``, from 1 in ``order`` (a total one): ranks within ranges of about ``each`` rows, then the ranges' offsets.

    The ranges are written before their sizes are counted, so that both see the same
    rows; what is added up in one task is a row for each range.
    """
    ranges = max(1, -(-df.count() // each))
    ranged = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn("place", (F.col("_before") + rank).cast("long")).drop("_range", "_before")  # a row a range


def overlapping_sets(sets: DataFrame, least: int, block: int = 256) -> DataFrame:
    """(left_item, right_item, shared): pairs of items that at least ``least`` cases of ``sets`` (case_id, item) share, the smaller item left.

    An item of fewer cases cannot be in such a pair and goes first. The items of a case
    are dealt to blocks of about ``block``, and two blocks meet at a time, so that a case
    with very many items is many keys. A pair's cases are counted where they are found
    before they are shuffled.
    """
    own = sets.where("case_id IS NOT NULL AND item IS NOT NULL").select("case_id", "item").distinct()
    often = own.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item")
    kept = stored(own.join(often, "item", "left_semi"), "sets")
    sizes = kept.groupBy("case_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = kept.join(sizes, "case_id").withColumn("b", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("case_id", "item", "b", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"))
    left, right = (dealt.select("case_id", "lo", "hi", F.col("item").alias(f"{side}_item"), F.col("b").alias(f"_{side}")) for side in ("left", "right"))
    pairs = left.join(right, ["case_id", "lo", "hi"]).where("left_item < right_item AND least(_left, _right) = lo AND greatest(_left, _right) = hi")
    return pairs.groupBy("left_item", "right_item").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
