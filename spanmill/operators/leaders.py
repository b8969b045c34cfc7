"""Leader families in the order of many motifs, by rounds of batches against an index of families.

In order, each motif joins the family whose core it shares most with (as a share of
the smaller of both sets; the older of equal families), if that is ``theta`` at least,
and its items enlarge the core; else it leads a family of its own. A round deals with
the next ``batch`` motifs. Which families their sets could join is a join on items:
the smaller of two sets has to hold one of its rarest items in common with the other,
as many as it could miss, and one more. Each set keeps its ``near`` best families. The
batch is then settled in order in one task, which holds these motifs and families (of
cores only the items that the batch knows). It stops early at a motif all of whose
listed families have grown meanwhile, if an unlisted one could be better: that motif
opens the next round. So the result is the sequential one for any ``batch`` and ``near``.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .folds import folded
from .selection import numbered

COMPACT = 16


def prefix(items: Column, theta: float) -> Column:
    """The first of sorted ``items`` of which a set that shares ``theta`` of them holds one: all but as many as have to be shared, and one more."""
    size = F.size(items)
    return F.slice(items, 1, F.greatest(F.lit(1), F.least(size, size - F.ceil(size * theta - 1e-9).cast("int") + 1)))


def near_families(sets: DataFrame, families: DataFrame, theta: float, near: int) -> DataFrame:
    """(items, found): for distinct ``sets`` (items) their ``near`` best ``families`` (family, core) as structs (share, family, size), the best first.

    Items are numbers, the rarest first, and arrays of them sorted. A pair is made where its
    smallest shared item stands, so that no pair comes twice and a frequent item
    makes pairs only for sets that consist of frequent items.
    """
    own = sets.select("items", F.explode(prefix(F.col("items"), theta)).alias("item"), F.lit(False).alias("whole"))
    own = own.unionByName(sets.select("items", F.explode("items").alias("item"), F.lit(True).alias("whole")))
    wide = families.select("family", "core", F.explode("core").alias("item"), F.lit(False).alias("whole"))
    wide = wide.unionByName(families.select("family", "core", F.explode(prefix(F.col("core"), theta)).alias("item"), F.lit(True).alias("whole")))
    shared = F.array_intersect("items", "core")
    pairs = own.join(wide, ["item", "whole"]).where(F.col("whole") == (F.size("core") < F.size("items"))).withColumn("shared", shared)
    share = F.size("shared") / F.least(F.size("items"), F.size("core"))
    pairs = pairs.where(F.col("shared")[0] == F.col("item")).select("items", "family", F.size("core").alias("size"), share.alias("share")).where(F.col("share") >= theta)
    best = Window.partitionBy("items").orderBy(F.desc("share"), "family")
    top = pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= near)
    return top.groupBy("items").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("less"), "family", "size"))).alias("found"))


def settle(rows: list[dict], theta: float, near: int) -> list[dict]:
    """The motifs of a batch in order: (rank, family, added), up to one that the listed families can't decide.

    ``rows`` are motifs (rank, items, found) and, without ``found``, the families named there with those items of their cores that the batch knows.
    """
    known = {r["rank"]: set(r["items"]) for r in rows if r["found"] is None}
    grown: dict[int, set] = {}
    size: dict[int, int] = {}
    holds: dict[int, set] = defaultdict(set)
    out = []
    for r in sorted((r for r in rows if r["found"] is not None), key=lambda r: r["rank"]):
        items = set(r["items"])
        listed = [(-x["less"], -x["family"], x["size"]) for x in r["found"]]
        still = next((x[:2] for x in listed if -x[1] not in grown), None)
        shared: dict[int, int] = defaultdict(int)
        for item in items:
            for f in holds[item]:
                shared[f] += 1
        best = max([(n / min(len(items), size[f]), -f) for f, n in shared.items()] + ([still] if still else []), default=(0.0, 0))
        if still is None and len(listed) == near and best < listed[-1][:2]:
            break
        family = -best[1]
        if best[0] < theta:
            family, added = r["rank"], items
        elif family in grown:
            added = items - grown[family]
        else:
            added = items - known[family]
            if added:
                size[family] = next(n for _, f, n in listed if -f == family)
        if added:
            if family not in grown:
                grown[family] = set(known.get(family, ()))
                size.setdefault(family, 0)
                for item in grown[family]:
                    holds[item].add(family)
            grown[family] |= added
            size[family] += len(added)
            for item in added:
                holds[item].add(family)
        out.append({"rank": r["rank"], "family": family, "added": sorted(added)})
    return out


def leader_families(motifs: DataFrame, theta: float, batch: int = 4096, near: int = 8) -> DataFrame:
    """(symbol, family) of motifs (symbol, items, n), by falling n (nulls last), then symbol; a family is named by the motif that leads it.

    Symbols are taken as distinct; repeated items count once, null ones not at all; motifs without
    items are their own family. ``theta`` is above 0. Each round reads its own motifs and the cores; rounds are
    about as many as batches, since each decides one motif at least.
    """
    if not 0 < theta <= 1 or batch < 1 or near < 1:
        raise ValueError("theta lies in (0, 1]; batch and near are 1 at least")
    own = motifs.select("symbol", F.array_distinct(F.array_compact(F.coalesce("items", F.array().cast("array<string>")))).alias("items"), "n")
    alone = own.where(F.size("items") < 1).select("symbol", F.col("symbol").alias("family"))
    full = own.where(F.size("items") > 0)
    counts = full.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("held"))
    code = stored(numbered(counts, [F.asc("held"), F.asc("item")]).select("item", F.col("place").cast("long").alias("code")), "items")
    placed = stored(numbered(full, [F.desc_nulls_last("n"), F.asc("symbol")]).select("symbol", "items", F.col("place").cast("long").alias("rank")), "motifs")
    coded = placed.select("rank", F.explode("items").alias("item")).join(code, "item").groupBy("rank").agg(F.array_sort(F.collect_list("code")).alias("items"))
    # In order of ranks, so that a round reads the row groups of its own motifs only.
    ordered = stored(coded.repartitionByRange("rank").sortWithinPartitions("rank"), "ordered")
    spark, last, done, taken, cores = motifs.sparkSession, ordered.agg(F.max("rank")).first()[0], 0, [], []
    none = spark.createDataFrame([], "rank long, family long, added array<long>")
    while last is not None and done < last:
        now = ordered.where((F.col("rank") > done) & (F.col("rank") <= done + batch))
        families = union(cores, none).select("family", F.explode("added").alias("item")).groupBy("family").agg(F.array_sort(F.collect_list("item")).alias("core"))
        if cores:
            families = stored(families, "cores")
            found = stored(near_families(now.select("items").distinct(), families, theta, near), "near")
            rows = now.join(found, "items", "left").select("rank", "items", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
            words = now.select(F.explode("items").alias("item")).distinct()
            wanted = families.join(found.select(F.explode("found.family").alias("family")).distinct(), "family", "left_semi")
            part = wanted.select("family", F.explode("core").alias("item")).join(words, "item", "left_semi").groupBy(F.col("family").alias("rank")).agg(F.collect_list("item").alias("items"))
            rows = rows.unionByName(part.withColumn("found", F.lit(None)))
        else:
            rows = now.withColumn("found", F.array().cast("array<struct<less: double, family: long, size: int>>"))
        settled = stored(folded(rows.withColumn("_one", F.lit(0)), ["_one"], lambda r: settle(r, theta, near), none.schema), "settled")
        done = settled.agg(F.max("rank")).first()[0]
        taken, cores = [*taken, settled], [*cores, settled.where(F.size("added") > 0)]
        if len(taken) % COMPACT == 0:
            taken = [stored(union(taken, none), "settled")]
            cores = [taken[0].where(F.size("added") > 0)]
    name = placed.select(F.col("rank").alias("family"), F.col("symbol").alias("_leader"))
    out = union(taken, none).join(placed.select("rank", "symbol"), "rank").join(name, "family")
    return out.select("symbol", F.col("_leader").alias("family")).unionByName(alone)


def union(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    """All rows of ``parts``, or ``none``."""
    out = parts[0] if parts else none
    for other in parts[1:]:
        out = out.unionByName(other)
    return out
