"""Decisions over groups of events: phase closure, weighted axes, window coverage, promotion. Groups, weights and cuts are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

# What the score of an itemset adds for the marks it has (one of each list), (weight, needs, lacks).
FLOOR = ["role:floor_low_horizontal_support", "role:hand_floor_low_support"]
LEVELS = ["role:body_level_cycle", "role:body_level_down", "role:body_level_up", "role:body_level_low", "role:body_low_posture"]
RHYTHMS = ["role:vertical_rhythm", "role:vertical_low_body_transition"]
ITEMSET_WEIGHTS = (
    (2.5, [["zone:inversion"]], []),
    (1.6, [["zone:support"]], []),
    (1.0, [FLOOR, ["zone:upper"]], []),
    (2.0, [["role:inverted_support"]], []),
    (1.8, [["zone:upper"], ["zone:lower"]], []),
    (1.2, [["zone:upper"], ["zone:vertical"]], []),
    (1.0, [["zone:lower"], ["zone:vertical"]], []),
    (0.8, [["zone:posture"], ["zone:lower", "zone:vertical"]], []),
    (0.6, [["both_arms"]], []),
    (0.8, [["both_legs"]], []),
    (0.8, [["role:arm_large_arc_or_orbit", "role:arm_vertical_cycle", "role:bimanual_spread_cycle"], ["zone:lower"]], []),
    (0.6, [["role:hand_head_proximity"], ["zone:posture", "zone:vertical", "zone:lower"]], []),
    (0.4, [["role:arm_reach_retract"], ["zone:posture", "zone:vertical", "zone:lower"]], []),
    (-1.6, [["one_zone"]], ["both_arms", "both_legs"]),
)
# Scopes of an itemset; the first whose needs are met.
ITEMSET_SCOPES = (
    ("floor_prone_or_mime_candidate", [FLOOR, ["zone:upper", "zone:posture"]]),
    ("inversion_acrobatic_candidate", [["role:inverted_support"], ["zone:upper", "zone:lower", "zone:posture", "zone:inversion"]]),
    ("inversion_acrobatic_candidate", [["zone:inversion"], ["zone:upper", "zone:lower", "zone:posture"]]),
    ("full_upper_lower_body_candidate", [["zone:upper"], ["zone:lower"], ["zone:vertical", "zone:posture"]]),
    ("upper_vertical_coordination_component", [["zone:upper"], ["zone:vertical"]]),
    ("upper_lower_coordination_component", [["zone:upper"], ["zone:lower"]]),
    ("lower_body_transition_component", [["zone:lower"], ["zone:vertical", "zone:posture"]]),
    ("body_level_transition_component", [["zone:posture"], ["zone:vertical"]]),
    ("bilateral_upper_component", [["both_arms"]]),
    ("bilateral_lower_component", [["both_legs"]]),
)
# What makes an itemset of little support specific.
SPECIFIC = (
    [[*FLOOR, "role:inverted_support", "role:inversion_or_acrobatics"], ["cross_zone"]],
    [FLOOR, ["role:hand_head_proximity", "role:arm_large_arc_or_orbit", *LEVELS]],
    [["role:inverted_support"], ["role:arm_large_arc_or_orbit", "role:leg_lateral_cycle", *RHYTHMS, *LEVELS]],
    [["role:arm_large_arc_or_orbit"], ["role:leg_lateral_cycle"], ["both_arms", *RHYTHMS, *LEVELS]],
    [["role:hand_head_proximity"], ["role:leg_lateral_cycle"], [*RHYTHMS, *LEVELS]],
)
# What the structure score of a coordination symbol adds for its marks, (weight, needs, lacks).
STRUCTURE_WEIGHTS = (
    (1.25, [["upper"], ["vertical"]], []),
    (1.0, [["lower"], ["vertical"]], ["gait"]),
    (1.0, [["upper"], ["low_body"]], []),
    (0.8, [["torso"], ["low_body"]], []),
    (1.5, [["bimanual_vertical"]], []),
    (0.75, [["arm_vertical"]], []),
    (0.8, [["leg_non_gait"]], []),
    (0.8, [["vertical_impulse"]], []),
    (0.5, [["high_pose"], ["vertical", "low_body"]], []),
    (1.2, [["arm_trajectory"], ["lower", "vertical", "body_level"]], []),
    (0.9, [["arm_reach"], ["torso", "root", "lower", "body_level"]], []),
    (1.3, [["hand_proximity"], ["body_level"]], []),
    (1.25, [["leg_lateral"], ["upper"]], []),
    (0.9, [["leg_lateral"], ["vertical"]], []),
    (1.25, [["stance_width"], ["upper"]], []),
    (1.05, [["stance_width"], ["vertical"]], []),
    (0.9, [["body_level"], ["upper"]], []),
    (1.3, [["body_support"]], []),
    (1.3, [["inverted_support"], ["upper", "lower", "inversion"]], []),
    (1.0, [["floor_support"], ["upper", "torso"]], []),
    (-2.0, [["gait"]], []),
    (-2.5, [["gait"]], ["upper", "torso", "low_body", "leg_non_gait", "vertical_impulse", "bimanual_vertical"]),
    (-1.0, [["root_context"]], []),
    (-0.8, [["generic_vertical"]], ["upper", "low_body", "leg_non_gait"]),
    (-1.0, [["root"]], ["upper", "lower", "vertical", "torso"]),
)


def holds(marks: str, needs: list[list[str]], lacks: list[str] = ()) -> Column:
    """Whether the array ``marks`` has one of each list of ``needs`` and none of ``lacks``."""
    out = F.lit(True)
    for some in needs:
        out = out & F.arrays_overlap(marks, F.array(*map(F.lit, some)))
    return out & ~F.arrays_overlap(marks, F.array(*map(F.lit, lacks))) if lacks else out


def weighed(base: Column, marks: str, weights, digits: int) -> Column:
    """``base`` and the weights (weight, needs, lacks) that hold of ``marks``, rounded."""
    return F.round(sum((F.when(holds(marks, needs, lacks), float(w)).otherwise(0.0) for w, needs, lacks in weights), base), digits)


def itemset_scope(sets: DataFrame, least: int, least_specific: int, weights=ITEMSET_WEIGHTS, scopes=ITEMSET_SCOPES, specific=SPECIFIC) -> DataFrame:
    """``sets`` (zones, channels, roles: arrays of distinct values; cases) with score, scope and kind.

    The score is log(1 + cases) + 0.75 a zone + 0.15 a channel and the ``weights``.
    Kind: ``high_support`` from ``least`` cases on; of the others, from
    ``least_specific`` on, those that ``specific`` holds of are ``high_specificity``;
    else ``below_threshold``. Sets without marks are local and below unless supported.
    """
    named = lambda p, c: F.transform(c, lambda x: F.concat(F.lit(f"{p}:"), x))
    has = lambda c: F.array_contains("channels", c)
    told = F.array(
        F.when(has("bimanual") | has("left_arm") & has("right_arm"), "both_arms"), F.when(has("left_leg") & has("right_leg"), "both_legs"),
        F.when(F.size("zones") == 1, "one_zone"), F.when(F.size("zones") >= 2, "cross_zone"),
    )
    own = sets.withColumn("_marks", F.concat(named("zone", "zones"), named("role", "roles"), F.array_compact(told)))
    score = weighed(F.log1p("cases") + 0.75 * F.size("zones") + 0.15 * F.size("channels"), "_marks", weights, 4)
    scope = F.coalesce(*[F.when(holds("_marks", needs), name) for name, needs in scopes], F.lit("local_or_ambiguous_component"))
    rare = F.lit(False)
    for needs in specific:
        rare = rare | holds("_marks", needs)
    kind = cascade({"high_support": F.col("cases") >= least, "high_specificity": (F.col("cases") >= least_specific) & rare}, "below_threshold")
    return own.select(*sets.columns, score.alias("score"), scope.alias("scope"), kind.alias("kind")).drop("_marks")


def select_coordination(stats: DataFrame, budget: int, least: int = 1, least_cases: int = 1, weights=None, least_score: float = 0.0) -> DataFrame:
    """The ``budget`` first symbols of ``stats`` (symbol, n, cases) with enough occurrences and cases, in order.

    By falling cases, n, then symbol; with ``weights`` (see ``STRUCTURE_WEIGHTS``) by a structure
    score first, which is kept as ``score``. It needs ``zones`` and ``marks`` (arrays) and the
    number of ``channels``: log(1 + cases) + 0.35 a channel + 0.55 a zone, 1.5 less with one zone at most, and the weights.
    """
    own = stats.where((F.col("n") >= least) & (F.col("cases") >= least_cases))
    order = [F.desc("cases"), F.desc("n"), F.asc("symbol")]
    if weights is None:
        return own.orderBy(*order).limit(budget)
    base = F.log1p("cases") + 0.35 * F.col("channels") + 0.55 * F.size("zones") - F.when(F.size("zones") <= 1, 1.5).otherwise(0.0)
    own = own.withColumn("_all", F.concat("zones", "marks")).withColumn("score", weighed(base, "_all", weights, 6)).drop("_all")
    return own.where(F.col("score") >= least_score).orderBy(F.desc("score"), *order).limit(budget)


def cascade(steps: dict[str, Column], default: str) -> Column:
    """The name of the first condition that holds; a null condition does not."""
    out = F.lit(default)
    for name, holds in reversed(steps.items()):
        out = F.when(holds, name).otherwise(out)
    return out


def phase_closure(events: DataFrame, groups: list[str], reach: int) -> DataFrame:
    """(case_id, links, status) of the cases with events of two of the ``groups`` (channels) at least.

    A link is a pair of groups with events at most ``reach`` apart, start to end. All
    pairs linked: ``phase_closed_all_pairs``; links that join all groups:
    ``phase_chain``; some links: ``partial``; none: ``case_level_only``.
    """

    def touched(seen: Column) -> Column:
        return F.flatten(F.filter("pairs", lambda p: F.arrays_overlap(p, seen)))

    own = events.where(F.col("channel").isin(groups))
    near = spans.near_pairs(own, own, reach).where("l_channel < r_channel").select("case_id", F.array("l_channel", "r_channel").alias("pair")).distinct()
    pairs = near.groupBy("case_id").agg(F.collect_set("pair").alias("pairs"))  # one for each two groups at most
    cases = own.groupBy("case_id").agg(F.countDistinct("channel").alias("groups")).where("groups >= 2")
    seen = F.col("pairs")[0]
    for _ in groups[2:]:
        seen = F.array_union(seen, touched(seen))
    links = F.coalesce(F.size("pairs"), F.lit(0))
    whole = len(groups) * (len(groups) - 1) // 2
    status = cascade({"phase_closed_all_pairs": links == whole, "phase_chain": F.size(seen) == len(groups), "partial": links > 0}, "case_level_only")
    return cases.join(pairs, "case_id", "left").select("case_id", F.when(F.col("pairs").isNull(), 0).otherwise(F.size("pairs")).alias("links"), status.alias("status"))


def windows(events: DataFrame, width: int, blocks: Column | None = None) -> DataFrame:
    """(case_id, w, have, blocks): the channels that start in each window of ``width`` and how many of its events meet ``blocks``."""
    n = F.count_if(blocks) if blocks is not None else F.lit(0).cast("long")
    return events.groupBy("case_id", F.floor(F.col("s") / width).alias("w")).agg(F.collect_set("channel").alias("have"), n.alias("blocks"))


def split_axis(own: DataFrame, weights: dict[str, float], required: list[str], least: float) -> DataFrame:
    """(case_id, w, score, verdict) of ``windows``: the weights of the groups present (negative: a penalty), rounded to six digits.

    ``blocked`` where a blocking event stands, ``missing_group`` without a required
    one, ``accepted`` from ``least`` on, else ``below_min``.
    """
    score = F.round(sum((F.when(F.array_contains("have", g), w).otherwise(0.0) for g, w in weights.items()), F.lit(0.0)), 6)
    lacks = F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), "have")) > 0
    verdict = cascade({"blocked": F.col("blocks") > 0, "missing_group": lacks, "accepted": score >= least}, "below_min")
    return own.select("case_id", "w", score.alias("score"), verdict.alias("verdict"))


def window_coverage(own: DataFrame, need: list[str]) -> DataFrame:
    """(case_id, whole, best, full_case, full_window) of ``windows``: channels of a case against those of its best window, and whether either has all of ``need``."""
    full = lambda have: F.size(F.array_except(F.array(*map(F.lit, need)), have)) == 0
    out = own.groupBy("case_id").agg(F.array_distinct(F.flatten(F.collect_set("have"))).alias("all"), F.max(F.size("have")).cast("long").alias("best"), F.bool_or(full(F.col("have"))).alias("full_window"))
    return out.select("case_id", F.size("all").cast("long").alias("whole"), "best", full(F.col("all")).alias("full_case"), "full_window")


# Outcomes of a node's promotion, the first whose condition holds.
PROMOTION = (
    ("keep_positive", "status = 'accepted'"),
    ("insufficient_support", "cases < 5"),
    ("split_or_downgrade", "no_alias_rate >= 0.60"),
    ("promote_review", "alias_hit_rate >= 0.45 AND mean_score >= 0.55 AND level IN ('closure_required_candidate', 'split_required_candidate')"),
    ("split_review", "alias_hit_rate >= 0.25"),
    ("keep_component", "status = 'component'"),
)


def cascaded(rules, default: str) -> Column:
    """The name of the first of ``rules`` (name, SQL condition) that holds; a null condition does not."""
    out = F.lit(default)
    for name, condition in reversed(rules):
        out = F.when(F.expr(condition), F.lit(name)).otherwise(out)
    return out


def promotion(nodes: DataFrame, matches: DataFrame, rules=PROMOTION, default: str = "keep_pending") -> DataFrame:
    """(node, cases, alias_hit_rate, no_alias_rate, mean_score, outcome) of nodes (node, status, level, targets) by the cases that they match.

    ``matches`` (node, case_id, aliases, score): a case counts once, with all its
    aliases and its best score. A hit is a case with one of the node's ``targets``. A node
    without matches has rates of 0.
    """
    wanted = matches.join(nodes.select("node", "targets"), "node")
    hit = F.coalesce(F.arrays_overlap("aliases", "targets"), F.lit(False))
    each = wanted.groupBy("node", "case_id").agg(F.bool_or(hit).alias("hit"), F.bool_or(F.coalesce(F.size("aliases") > 0, F.lit(False))).alias("named"), F.max("score").alias("score"))
    rates = each.groupBy("node").agg(F.count("*").alias("cases"), F.avg(F.col("hit").cast("double")).alias("alias_hit_rate"), F.avg((~F.col("named")).cast("double")).alias("no_alias_rate"), F.avg("score").alias("mean_score"))
    known = nodes.join(rates, "node", "left").fillna(0, ["cases"]).fillna(0.0, ["alias_hit_rate", "no_alias_rate", "mean_score"])
    return known.select("node", "cases", "alias_hit_rate", "no_alias_rate", "mean_score", cascaded(rules, default).alias("outcome"))
