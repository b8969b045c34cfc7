"""Components, itemsets, closure, covers and the folds over one case's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from . import spans
from .folds import folded
from .greedy import exclusive
from .sweeps import sessions, swept


#: Transactions whose sets a task counts, about.
TRANSACTIONS_IN_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) can reach. Rounds of joins, each written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("low")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        step = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("low"))
        after = step.join(label.select(F.col("node").alias("low"), F.col("component").alias("next")), "low").select("node", "old", F.least("low", "next").alias("component"))
        after = stored(after, "labels")
        label = after.select("node", "component")
        if not after.where("old != component").limit(1).count():
            return label


def coactivations(events: DataFrame, theta: float) -> DataFrame:
    """(packet, members, symbol, s, e): components of events of different channels that overlap by ``theta`` of the shorter; at least two channels."""
    names = ("l_s", "l_e", "r_s", "r_e")
    links = spans.near_pairs(events, events, 0).where("l_channel != r_channel AND l_event_id < r_event_id").where(spans.ratio(*names) >= theta)
    packets = components(links.select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b")))
    own = packets.join(events, F.col("node") == F.col("event_id"))
    out = own.groupBy(F.col("component").alias("packet")).agg(F.count("*").alias("members"), F.array_sort(F.collect_set("channel")).alias("c"), F.min("s").alias("s"), F.max("e").alias("e"))
    return out.where(F.size("c") >= 2).select("packet", "members", F.array_join("c", "+").alias("symbol"), "s", "e")


def anchored_packets(events: DataFrame, roles: dict[str, int], theta: float, grid: int) -> DataFrame:
    """(case_id, anchor, role, s, e, symbol, members): each anchor with the event of every other channel that overlaps it most, by ``theta`` of the shorter.

    ``roles`` gives the channels of anchors their priority. Of packets of a case with
    one symbol whose ends fall in the same cells of ``grid`` units, the one of the
    highest priority stays, then the earliest anchor, then the smaller id.
    """
    of = F.create_map(*[x for c, n in roles.items() for x in (F.lit(c), F.lit(n))])
    pairs = spans.near_pairs(events.where(F.col("channel").isin(*roles)), events, 0).where("l_channel != r_channel").withColumn("ratio", spans.ratio("l_s", "l_e", "r_s", "r_e"))
    best = spans.best_match(pairs.where(F.col("ratio") >= theta), ["l_event_id", "r_channel"], [F.desc("ratio"), F.asc("r_event_id")])
    packets = best.groupBy("case_id", F.col("l_event_id").alias("anchor"), "l_channel").agg(
        F.min("l_s").alias("at"), F.least(F.min("l_s"), F.min("r_s")).alias("s"), F.greatest(F.max("l_e"), F.max("r_e")).alias("e"), F.collect_list("r_channel").alias("c"), F.collect_list("r_event_id").alias("m")
    )
    join = lambda many, one, sep: F.array_join(F.array_sort(F.array_append(many, F.col(one))), sep)
    rows = packets.select("case_id", "anchor", of[F.col("l_channel")].alias("role"), "at", "s", "e", join("c", "l_channel", "+").alias("symbol"), join("m", "anchor", ",").alias("members"))
    cell = [F.floor(F.col(x) / grid) for x in ("s", "e")]
    first = Window.partitionBy("case_id", "symbol", *cell).orderBy(F.desc("role"), "at", "anchor")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "at")


def itemsets(tx: DataFrame, most: int, least: int) -> DataFrame:
    """(items, n, cases) of the sets of 2 to ``most`` items in ``least`` transactions (tx, case_id, item) at least.

    Items that are not frequent themselves are left out first. Sets grow by one
    item: a frequent set is joined with the later items of its transaction if
    these make a frequent set with its other items as well, so that no
    transaction's subsets are listed in full. Counts are summed by case first:
    transactions are dealt by case, so that the sets made of them are not sent.
    """
    often = tx.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item")
    # One row for each transaction: what it holds is bounded by its own items.
    held = stored(tx.join(often, "item", "left_semi").groupBy("tx", "case_id").agg(F.array_sort(F.collect_list("item")).alias("own")).where(F.size("own") > 1), "transactions")
    dealt = held.repartition(1 + held.count() // TRANSACTIONS_IN_TASK, "case_id")
    found, grown = None, dealt.select("tx", "case_id", "own", F.explode("own").alias("last")).select("tx", "case_id", "own", F.array("last").alias("items"))
    for size in range(2, most + 1):
        later = F.filter("own", lambda x: x > F.element_at("items", -1))
        longer = grown.select("tx", "case_id", "own", "items", F.explode(later).alias("item"))
        if size > 2:
            # The set without its last item, and the new item, have to be frequent together as well.
            known = counts.select(F.slice("items", 1, size - 2).alias("_head"), F.element_at("items", -1).alias("item"))
            longer = longer.withColumn("_head", F.slice("items", 1, size - 2)).join(known, ["_head", "item"], "left_semi")
        longer = longer.select("tx", "case_id", "own", F.concat("items", F.array("item")).alias("items"))
        counts = longer.groupBy("items", "case_id").agg(F.count("*").alias("n")).groupBy("items").agg(F.sum("n").alias("n"), F.count("*").alias("cases"))
        counts = stored(counts.where(F.col("n") >= least), "itemsets")
        found = counts if found is None else found.unionByName(counts)
        if size < most:
            grown = longer.join(counts.select("items"), "items", "left_semi")
    return found


def closed(sets: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``sets`` (items, cases) without those that a superset of one more item or more supports as well, up to the tolerance.

    A set meets the sets that hold its rarest item, so that a frequent item is no hot key.
    """
    often = sets.select(F.explode("items").alias("first")).groupBy("first").agg(F.count("*").alias("_n"))
    wide = sets.select(F.col("items").alias("more"), F.col("cases").alias("more_cases"), F.explode("items").alias("first"))
    own = sets.select("items", "cases", F.explode("items").alias("first")).join(often, "first").groupBy("items", "cases").agg(F.min_by("first", F.struct("_n", "first")).alias("first"))
    over = own.join(wide, "first").where((F.size("more") > F.size("items")) & (F.size(F.array_except("items", "more")) == 0) & (F.col("more_cases") >= F.ceil(F.col("cases") * (1 - tolerance))))
    return sets.join(over.select("items").distinct(), "items", "left_anti")


def greedy_cover(hits: DataFrame, truth: DataFrame, floor: float, most: int) -> list[tuple[str, int, float]]:
    """(symbol, true positives gained, precision of the union) of the symbols taken: each step the one with the largest gain that keeps the precision.

    ``hits`` (symbol, case_id), ``truth`` (case_id); a step is one aggregate.
    """
    marked = stored(hits.distinct().join(truth.select("case_id").distinct().withColumn("t", F.lit(1)), "case_id", "left").fillna(0, ["t"]), "hits")
    taken: list[tuple[str, int, float]] = []
    tp = fp = 0
    left = marked
    for _ in range(most):
        gain = left.groupBy("symbol").agg(F.sum("t").alias("tp"), F.sum(1 - F.col("t")).alias("fp"))
        after = (F.col("tp") + tp) / (F.col("tp") + F.col("fp") + tp + fp)
        best = gain.where((F.col("tp") > 0) & (after >= floor)).orderBy(F.desc("tp"), "fp", "symbol").limit(1).collect()
        if not best:
            break
        tp, fp = tp + best[0].tp, fp + best[0].fp
        taken.append((best[0].symbol, best[0].tp, tp / (tp + fp)))
        done = left.where(F.col("symbol") == best[0].symbol).select("case_id")
        left = stored(left.join(done, "case_id", "left_anti"), "hits")
    return taken


def abstracted(events: DataFrame, theta: float = 0.6) -> DataFrame:
    """(case_id, event_id, channel, s, e, support): of events of one channel that overlap by ``theta`` of the shorter, the first in the order of length, value and id stands for the rest.

    Events meet only within a run of overlapping ones. A run of one event needs no
    fold; the others are dealt by run and swept.
    """
    own = events.select("case_id", "event_id", "channel", "s", "e", "value")
    runs = sessions(own, ["case_id", "channel"], 0, ["s", "e", "event_id"])
    runs = stored(runs.withColumn("size", F.count("*").over(Window.partitionBy("case_id", "channel", "session"))), "runs")

    def fold(own: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in sorted(own, key=lambda r: (r["s"] - r["e"], -r["value"], r["event_id"])):
            for k in kept:
                if min(k["e"], r["e"]) - max(k["s"], r["s"]) + 1 >= theta * (min(k["e"] - k["s"], r["e"] - r["s"]) + 1):
                    k["support"] += 1
                    break
            else:
                kept.append({**r, "support": 1})
        return [{c: k[c] for c in ("case_id", "event_id", "channel", "s", "e", "support")} for k in kept]

    schema = "case_id long, event_id long, channel string, s long, e long, support long"
    alone = runs.where("size = 1").select("case_id", "event_id", "channel", "s", "e", F.lit(1).cast("long").alias("support"))
    return alone.unionByName(swept(runs.where("size > 1").drop("size"), ["case_id", "channel", "session"], [], fold, schema))


def compatible(edits: DataFrame, tolerance: int, most: int) -> DataFrame:
    """Edits (case_id, attribute, s, e, score, id) taken by falling score unless one taken before has the attribute within ``tolerance``; ``most`` a case."""

    def fold(own: list[dict]) -> list[dict]:
        taken: list[dict] = []
        for r in sorted(own, key=lambda r: (-r["score"], r["id"])):
            clash = any(k["attribute"] == r["attribute"] and max(k["s"], r["s"]) <= min(k["e"], r["e"]) + tolerance for k in taken)
            if not clash and len(taken) < most:
                taken.append(r)
        return taken

    return folded(edits, ["case_id"], fold, edits.schema)


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs (case_id, l_s, l_id, r_id, ov, gap, dur) so that each left event, in time order, takes the best right one (overlap, smaller gap, longer) that no earlier one took."""
    order = [F.col("l_s"), F.col("l_id"), -F.col("ov"), F.col("gap"), -F.col("dur"), F.col("r_id")]
    return exclusive(pairs, [["case_id", "l_id"], ["case_id", "r_id"]], order)
