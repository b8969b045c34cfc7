"""Mixing of sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources. Each node's
budget is dealt to its children in proportion to their weights, up to what their
subtrees can give over all epochs; what a child cannot use goes to its siblings,
and only what all siblings cannot use goes to the level above. With the capacity
of whole subtrees known, one pass from the root down yields just that.

A leaf's tokens are its documents in the order of a seeded hash, anew in each
epoch; the leaf gives the prefix of that sequence that its budget covers. Only
the leaf's last epoch can be partial. Its documents fall into buckets by hash;
sums by bucket locate the one bucket that holds the cut, and only that bucket is
sorted. So no task ever holds a source, and texts are not shuffled but for the
documents of the cut buckets.

All of it is DataFrame expressions. Budgets are whole tokens; what integer
division leaves goes to the first of the siblings that can take more, a token
each, so that nothing is lost at any level.

Defined results: a null ``lang`` or ``source`` is a leaf of its own, named ``''``;
a null text has no tokens; a document is taken if it starts before the end of
the prefix, so that one without tokens goes with its neighbours; repeated rows
are taken one by one; an empty table gives an empty result. A weight of zero
gives a node nothing. Columns of ``docs`` other than the five used are carried
along in ``mixed`` whatever their names. Documents without an id are ordered by
their texts. Weights may be fractions; those of a level are scaled to whole
numbers.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
TREE = ("domain", "lang", "source")


def default_domain(source: Column) -> Column:
    """The domain of a source: by its number, in four groups."""
    number = F.coalesce(F.regexp_extract(source, r"([0-9]{1,6})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("domain"), (number % 4).cast("string"))


@dataclass(frozen=True)
class Plan:
    """Targets: weights by name for each level of the tree (1 where not named), the budget as a share of all tokens, epochs and seed."""

    domains: Mapping[str, float] = field(default_factory=lambda: {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1})
    langs: Mapping[str, float] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    sources: Mapping[str, float] = field(default_factory=dict)
    share: tuple[int, int] = (9, 10)
    epochs: int = 2
    seed: str = "17"

    def weight(self, level: str) -> Column:
        """The weight of the node named in column ``level``."""
        named = {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]
        exact = {name: Fraction(str(value)).limit_denominator(1_000_000) for name, value in named.items()}
        if min(exact.values(), default=0) < 0:
            raise ValueError("weights are not negative")
        scale = lcm(*(x.denominator for x in exact.values()))
        out = F.lit(scale)
        for name, value in exact.items():
            out = F.when(F.col(level) == name, F.lit(int(value * scale))).otherwise(out)
        return out.cast("long")


def _dealt(nodes: DataFrame, parent: list[str], level: str, plan: Plan) -> DataFrame:
    """``nodes`` (parent..., level, budget, cap) with ``own``: what each gets of its parent's budget."""
    nodes = nodes.withColumn("weight", plan.weight(level))
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # Those that run out first come first.
    order = siblings.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")), level)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = (F.col("weight") > 0) & (F.col("cap") * rest <= (F.col("budget") - before) * F.col("weight"))
    nodes = nodes.withColumn("full", full)
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings)
    weights = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings)
    nodes = nodes.withColumn("left_over", left).withColumn("open_weight", weights)
    own = F.expr("CASE WHEN full THEN cap WHEN weight = 0 THEN 0L ELSE (left_over * weight) div open_weight END")
    nodes = nodes.withColumn("own", own).withColumn("open", ~F.col("full") & (F.col("weight") > 0))
    # An open node's share is below its capacity, so that each can take one of the tokens that are left.
    rest = F.col("left_over") - F.sum(F.when(F.col("open"), F.col("own")).otherwise(0)).over(siblings)
    place = F.sum(F.col("open").cast("long")).over(siblings.orderBy(level))
    nodes = nodes.withColumn("own", F.col("own") + F.when(F.col("open") & (place <= rest), 1).otherwise(0))
    return nodes.drop("weight", "full", "left_over", "open_weight", "open")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens, own): the budget of each leaf of ``leaves`` (domain, lang, source, tokens)."""
    # The tree of leaves is small beside the documents but not collected: each level is a table of its nodes.
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.epochs)
    roots = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("all_tokens"))
    total = F.sum("all_tokens").over(Window.partitionBy(F.lit(0)))
    share, of = plan.share
    roots = roots.withColumn("budget", F.expr("0L") + total).withColumn("budget", F.expr(f"(budget * {int(share)}) div {int(of)}"))
    roots = _dealt(roots, [], "domain", plan).select("domain", F.col("own").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(roots, "domain")
    langs = _dealt(langs, ["domain"], "lang", plan).select("domain", "lang", F.col("own").alias("budget"))
    sources = leaves.join(langs, ["domain", "lang"])
    return _dealt(sources, ["domain", "lang"], "source", plan).select(*TREE, "tokens", "own")


def mixed(docs: DataFrame, plan: Plan | None = None, domain=default_domain) -> DataFrame:
    """One row for each document and epoch taken: (row, domain, lang, source, epoch, n_tokens, take_tokens, leaf_tokens).

    ``row`` is the document as a struct; ``take_tokens`` is less than
    ``n_tokens`` for the one document of a leaf that its prefix ends in.
    """
    plan = plan or Plan()
    own = docs.select(
        F.struct("*").alias("row"),
        domain(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    # Ids as text; rows without one are told apart by their texts.
    own = own.withColumn("id", F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.col("row.text").cast("binary"))), F.lit("")))
    counted = stored(own.select(*TREE, "n_tokens", "id"), "sizes")
    # Sizes are read back, so that every later step sees the same and small rows.
    leaves = counted.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"))
    leaves = stored(budgets(leaves, plan), "budgets")

    def key(epoch: Column, doc_id: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(plan.seed), epoch.cast("string"), doc_id).cast("binary"))

    def cut_of(rows: DataFrame, first: int) -> DataFrame:
        """(TREE, epoch, need, bucket, before): the bucket of three digits of the key that the prefix ends in, and the tokens before it."""
        held = rows.groupBy(*TREE, "epoch", "need", "before", F.substring("key", first, 3).alias("bucket")).agg(F.sum("n_tokens").alias("in_it"))
        held = held.withColumn("upto", F.col("before") + F.sum("in_it").over(Window.partitionBy(*TREE).orderBy("bucket")))
        cut = held.where("upto >= need").groupBy(*TREE, "epoch", "need").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("in_it")).alias("before")), "bucket").alias("cut"))
        return cut.select(*TREE, "epoch", "need", "cut.bucket", "cut.before")

    # The partial epoch of each leaf and what it needs of it; the cut is narrowed twice by digits of the key.
    partial = leaves.where("own > 0 AND tokens > 0 AND own % tokens > 0").selectExpr(*TREE, "CAST(own div tokens AS INT) + 1 AS epoch", "own % tokens AS need", "0L AS before")
    keyed = counted.join(partial, list(TREE)).withColumn("key", key(F.col("epoch"), F.col("id")))
    first = stored(cut_of(keyed, 1), "cuts")
    inside = keyed.drop("before", "need", "epoch").join(first, list(TREE)).where("substring(key, 1, 3) = bucket").withColumnRenamed("bucket", "outer")
    inside = stored(inside.select(*TREE, "epoch", "need", "before", "outer", "key", "n_tokens", "id"), "cut-rows")
    second = cut_of(inside, 4)
    last = inside.drop("before", "need", "epoch").join(second, list(TREE)).where("substring(key, 4, 3) = bucket")
    # Rows of one key and size are equal, or rows of one id: they are counted, and the prefix takes some of them whole and a part of one more.
    counted_keys = last.groupBy(*TREE, "need", "before", "key", "n_tokens").agg(F.count("*").alias("copies"))
    order = Window.partitionBy(*TREE).orderBy("key", "n_tokens")
    upto = F.col("before") + F.sum(F.col("copies") * F.col("n_tokens")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = counted_keys.withColumn("start", upto - F.col("copies") * F.col("n_tokens")).where("start < need")
    ends = last.groupBy(*TREE).agg(F.max(F.struct("key", "n_tokens", (F.col("need") - F.col("start")).alias("left"))).alias("end"))
    cuts = leaves.where("own > 0 AND tokens > 0").join(ends, list(TREE), "left").select(*TREE, "own", "tokens", "end")
    cuts = stored(cuts, "ends")
    # Whole epochs, then the partial one. A leaf without tokens gives nothing.
    lasts = "CAST(own div tokens AS INT) + IF(own % tokens > 0, 1, 0)"
    dealt = own.join(cuts, list(TREE)).withColumn("epoch", F.explode(F.expr(f"sequence(1, {lasts})")))
    dealt = dealt.withColumn("need", F.expr("least(own - (epoch - 1) * tokens, tokens)")).withColumn("key", key(F.col("epoch"), F.col("id")))
    here, end = F.struct("key", "n_tokens"), F.struct("end.key", "end.n_tokens")
    place = F.when((F.col("need") == F.col("tokens")) | (here < end), -1).when(here == end, 0).otherwise(1)
    columns = ["row", *TREE, "epoch", "n_tokens", "take_tokens", "own AS leaf_tokens"]
    dealt = dealt.withColumn("place", place)
    whole = dealt.where("place = -1").withColumn("take_tokens", F.col("n_tokens")).selectExpr(*columns)
    # Copies of the last key are numbered by text, then by the partition that wrote them, so that no number of them meets in one task.
    named = [*TREE, "key", "n_tokens", "text_hash", "part"]
    tied = stored(dealt.where("place = 0").withColumn("text_hash", F.xxhash64("row.text")).withColumn("part", F.spark_partition_id()), "ties")
    sizes = tied.groupBy(*named).agg(F.count("*").alias("copies"))
    offsets = sizes.withColumn("before", F.sum("copies").over(Window.partitionBy(*TREE, "key", "n_tokens").orderBy("text_hash", "part")) - F.col("copies")).drop("copies")
    copy = F.col("before") + F.row_number().over(Window.partitionBy(*named).orderBy("epoch")) - 1
    rest = F.col("end.left") - F.col("copy") * F.col("n_tokens")
    tied = tied.join(offsets, named).withColumn("copy", copy).withColumn("take_tokens", F.least(F.col("n_tokens"), rest)).where("take_tokens > 0")
    return whole.unionByName(tied.selectExpr(*columns))


def cut_text(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def select_documents(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each epoch; the text that a leaf's prefix ends in is cut there."""
    taken = mixed(docs, plan)
    text = F.when(F.col("take_tokens") < F.col("n_tokens"), cut_text(F.col("row.text"), F.col("take_tokens"))).otherwise(F.col("row.text"))
    return taken.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
