"""Names for actions that a caption and the action's family agree on.

A rule is data: patterns that the caption must and must not hold, the families that
it fits in order of preference, a least count, the group of names that it excludes,
its priority and confidence. Rules are taken by falling priority, then name; a rule
takes the best action of the case that has no name yet, and names of one group are
given once a case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from .greedy import exclusive


@dataclass(frozen=True)
class AliasRule:
    """One name and when it fits."""

    alias: str
    patterns: tuple[str, ...]
    families: tuple[str, ...]
    unless: tuple[str, ...] = ()
    group: str = ""
    least_count: int | None = None
    priority: int = 0
    confidence: float = 0.0


def ranked(rules: list[AliasRule]) -> list[AliasRule]:
    """Rules in the order in which they are taken."""
    return sorted(rules, key=lambda r: (-r.priority, r.alias))


def matched(captions: DataFrame, rules: list[AliasRule]) -> DataFrame:
    """(case_id, rule): the rules, by place in their order, that a case's captions (case_id, caption) match.

    All captions of a case are read as one text: a pattern counts if one caption
    holds it, and a rule goes if one holds what it must not. Case is ignored.
    """
    text = F.lower(F.coalesce("caption", F.lit("")))
    holds = lambda patterns: F.lit(False) if not patterns else F.greatest(*[text.rlike(f"(?i){p}") for p in patterns], F.lit(False))
    own = ranked(rules)
    flags = captions.select("case_id", *[c for k, r in enumerate(own) for c in (holds(r.patterns).alias(f"y{k}"), holds(r.unless).alias(f"n{k}"))])
    cases = flags.groupBy("case_id").agg(*[f(c).alias(c) for k in range(len(own)) for f, c in ((F.bool_or, f"y{k}"), (F.bool_or, f"n{k}"))])
    hits = F.array_compact(F.array(*[F.when(F.col(f"y{k}") & ~F.col(f"n{k}"), F.lit(k)) for k in range(len(own))]))
    return cases.select("case_id", F.explode(hits).alias("rule"))


def attached(actions: DataFrame, captions: DataFrame, rules: list[AliasRule]) -> DataFrame:
    """(case_id, action_id, alias, confidence, priority): the names given to actions (case_id, action_id, family, count, confidence, start, visible).

    Of a rule's candidates the one whose family comes first in the rule, then the
    most confident, the largest count, the earliest, and the smaller id is best.
    Hidden actions get no name. Null counts are 0 and null confidences 0.
    """
    if not rules:
        return actions.sparkSession.createDataFrame([], "case_id long, action_id long, alias string, confidence double, priority int")
    own = ranked(rules)
    table = F.array(*[
        F.struct(F.lit(k).alias("rule"), F.lit(r.alias).alias("alias"), F.lit(r.group or r.alias).alias("alias_group"), F.lit(f).alias("family"), F.lit(r.families.index(f)).alias("rank"), F.lit(r.least_count).cast("long").alias("least"), F.lit(r.priority).alias("priority"), F.lit(max(r.confidence, 0.1)).alias("rule_confidence"))
        for k, r in enumerate(own) for f in dict.fromkeys(r.families)
    ])
    known = actions.select("case_id", "action_id", "family", F.coalesce(F.col("count").cast("long"), F.lit(0)).alias("count"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), "start", F.coalesce("visible", F.lit(True)).alias("visible"))
    fits = known.where("visible").select("*", F.inline(F.filter(table, lambda x: x["family"] == F.col("family"))).alias("rule", "alias", "alias_group", "_family", "rank", "least", "priority", "rule_confidence"))
    pairs = fits.where("least IS NULL OR count >= least").join(matched(captions, rules), ["case_id", "rule"])
    pairs = pairs.select("case_id", "action_id", "alias", "alias_group", "rule", "rank", "count", "confidence", "start", "priority", "rule_confidence")
    order = [F.col("rule"), F.col("rank"), -F.col("confidence"), -F.col("count"), F.col("start"), F.col("action_id")]
    taken = exclusive(pairs, [["case_id", "alias"], ["case_id", "alias_group"], ["case_id", "action_id"]], order)
    sure = rounded(F.least(F.lit(0.92), F.greatest("confidence", F.lit(0.1)) * F.col("rule_confidence")), 4)
    return taken.select("case_id", "action_id", "alias", sure.alias("confidence"), "priority")
