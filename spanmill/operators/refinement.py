"""Events relabelled by what is near them, by rules given as data.

A flag says whether an event of some group overlaps by a share of the shorter, lies
within a gap, or comes just before or after. All flags of all refiners come from one
pass over near pairs and one aggregate. A refiner takes the events that fit it and
are none of an earlier one's; its rules are tried in order, and each gives a new
name and tags. Everything is read from the events as they were, so that the order
of events does not matter. Conditions are SQL over the event's columns, the derived
ones and the flags; names are texts with columns in braces.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

#: Columns that events have.
COLUMNS = ("case_id", "event_id", "s", "e", "family", "cluster", "direction", "magnitude", "repeat_mode", "coupled")


@dataclass(frozen=True)
class Flag:
    """Whether an event of ``group`` (SQL over l_ and r_ columns) is near: by a share, within a gap, or only before or after within a gap."""

    group: str
    share: float
    gap: int
    order: str = ""  # "before": the other ends by the start; "after": it starts from the end on

    def sql(self) -> str:
        """The test of one pair, over ratio and between."""
        if self.order:
            return f"({self.group}) AND between <= {self.gap} AND " + ("r_e <= l_s" if self.order == "before" else "r_s >= l_e")
        return f"({self.group}) AND (ratio >= {self.share} OR between <= {self.gap})"


@dataclass(frozen=True)
class Refiner:
    """Which events it takes, the tags they may get, and its rules (condition, name, tag) in order."""

    takes: str
    rules: tuple[tuple[str, str, str], ...]
    tags: tuple[tuple[str, str], ...] = ()


def rendered(template: str) -> Column:
    """A text with columns in braces."""
    parts = [x for text, name, *_ in Formatter().parse(template) for x in ([F.lit(text)] if text else []) + ([F.col(name)] if name else [])]
    return F.concat(*parts) if parts else F.lit("")


# Groups, cuts, names and tags of the refiners.
_VERTICAL, _ANY_LOCO, _ROTATION = "r_family = 'WHOLE_BODY_VERTICAL'", "r_family = 'WHOLE_BODY_LOCOMOTION'", "r_family = 'WHOLE_BODY_ROTATION'"
_LOCO = f"{_ANY_LOCO} AND left(r_cluster, 10) != 'LOCO_TURN_'"
_LEG = "left(r_cluster, 3) IN ('LL_', 'RL_')"
_LOW = "r_cluster IN ('WB_SQUAT_HOLD', 'WB_LOW_BODY_HOLD')"
_PERIODIC = "'LEFT_ARM_PERIODIC', 'RIGHT_ARM_PERIODIC', 'BIMANUAL_PERIODIC'"
_OTHER_SIDE = "(left(l_cluster, 3) = 'LA_' AND left(r_cluster, 3) = 'RA_' OR left(l_cluster, 3) = 'RA_' AND left(r_cluster, 3) = 'LA_')"
FLAGS: dict[str, Flag] = {
    "vertical_8": Flag(_VERTICAL, 0.08, 4), "vertical_10": Flag(_VERTICAL, 0.10, 4), "vertical_12": Flag(_VERTICAL, 0.12, 4), "vertical_12_close": Flag(_VERTICAL, 0.12, 3),
    "loco": Flag(_LOCO, 0.08, 4), "loco_wide": Flag(_LOCO, 0.08, 8), "any_loco": Flag(_ANY_LOCO, 0.08, 4), "turn": Flag(f"{_ROTATION} OR left(r_cluster, 10) = 'LOCO_TURN_'", 0.08, 8),
    "leg_8": Flag(_LEG, 0.08, 4), "leg_10": Flag(_LEG, 0.10, 4), "leg_forward": Flag("r_cluster IN ('LL_KICK_FORWARD', 'RL_KICK_FORWARD', 'LL_LEG_FORWARD_POSE', 'RL_LEG_FORWARD_POSE')", 0.10, 4),
    "low_10": Flag(_LOW, 0.10, 5), "low_12": Flag(_LOW, 0.12, 5), "torso": Flag("r_family IN ('TORSO_POSTURE', 'TORSO_PERIODIC')", 0.10, 4),
    "arm_periodic": Flag(f"r_family IN ({_PERIODIC})", 0.08, 4), "arm": Flag(f"r_family IN ({_PERIODIC}, 'LEFT_ARM_POSTURE', 'RIGHT_ARM_POSTURE')", 0.08, 4),
    "arm_raise": Flag("r_cluster IN ('BI_RAISE_SPREAD', 'LA_HAND_HIGH', 'RA_HAND_HIGH')", 0.12, 4), "hand_high": Flag("r_cluster IN ('LA_HAND_HIGH', 'RA_HAND_HIGH')", 0.12, 3),
    "opposite": Flag(_OTHER_SIDE, 0.35, 2), "opposite_high": Flag(f"{_OTHER_SIDE} AND right(r_cluster, 10) = '_HAND_HIGH'", 0.25, 3),
    "bimanual_20": Flag("left(r_family, 9) = 'BIMANUAL_'", 0.20, 3), "bimanual_12": Flag("left(r_family, 9) = 'BIMANUAL_'", 0.12, 3),
    "down": Flag("r_cluster = 'WB_VERT_DOWN'", 0.08, 8), "down_before": Flag("r_cluster = 'WB_VERT_DOWN'", 0, 10, "before"), "up": Flag("r_cluster = 'WB_VERT_UP'", 0.08, 8), "up_after": Flag("r_cluster = 'WB_VERT_UP'", 0, 10, "after"),
}
_PACE = "magnitude / greatest(duration, 1)"
DERIVED: dict[str, str] = {
    "duration": "e - s + 1",
    "side": "CASE WHEN left(cluster, 3) IN ('LA_', 'RA_', 'LL_') THEN left(cluster, 2) WHEN left(cluster, 3) = 'RL_' OR cluster IN ('RL_KICK_FORWARD', 'RL_LEG_FORWARD_POSE') THEN 'RL' ELSE 'BI' END",
    "way": "upper(direction)",
    "heading": "CASE WHEN cluster LIKE '%FORWARD%' OR direction = 'forward' THEN 'FORWARD' WHEN cluster LIKE '%BACKWARD%' OR direction = 'backward' THEN 'BACKWARD' WHEN cluster LIKE '%LEFT%' OR direction = 'left' THEN 'LEFT' WHEN cluster LIKE '%RIGHT%' OR direction = 'right' THEN 'RIGHT' WHEN cluster LIKE '%MIXED%' OR direction = 'mixed' THEN 'MIXED' ELSE 'ACTIVE' END",
    "pace": f"CASE WHEN cluster LIKE '%FAST%' THEN 'FAST' WHEN cluster LIKE '%MEDIUM%' THEN 'MEDIUM' WHEN cluster LIKE '%SLOW%' THEN 'SLOW' WHEN {_PACE} < 0.010 THEN 'SLOW' WHEN {_PACE} < 0.035 THEN 'MEDIUM' ELSE 'FAST' END",
    "turn_side": "CASE WHEN cluster LIKE '%LEFT%' OR direction = 'left' THEN 'LEFT' WHEN cluster LIKE '%RIGHT%' OR direction = 'right' THEN 'RIGHT' ELSE 'MIXED' END",
    "angle": "CASE WHEN cluster LIKE '%THREE_QUARTER%' THEN 'THREE_QUARTER' WHEN cluster LIKE '%QUARTER%' THEN 'QUARTER' WHEN cluster LIKE '%SMALL%' THEN 'SMALL' WHEN cluster LIKE '%HALF%' THEN 'HALF' WHEN cluster LIKE '%FULL%' THEN 'FULL' WHEN cluster LIKE '%MULTI%' THEN 'MULTI' WHEN cluster LIKE '%QTR%' THEN 'QUARTER' ELSE 'GENERIC' END",
    "tempo": f"CASE WHEN {_PACE} < 2.0 THEN 'SLOW' WHEN {_PACE} < 6.0 THEN 'MEDIUM' ELSE 'FAST' END",
    "turn_name": "CASE WHEN family = 'WHOLE_BODY_LOCOMOTION' THEN 'LOCO_TURN' ELSE 'WB_ROT' END",
    "repeat": "upper(CASE WHEN repeat_mode = '' THEN 'single' ELSE repeat_mode END)",
}
DERIVED |= {f"small_{name}": f"lower({DERIVED[name]})" for name in ("angle", "tempo")}
_CYCLE = "repeat_mode IN ('cycle', 'repeated_cycle')"
REFINERS: tuple[Refiner, ...] = (
    Refiner(
        "family = 'WHOLE_BODY_ROTATION' OR family = 'WHOLE_BODY_LOCOMOTION' AND left(cluster, 10) = 'LOCO_TURN_'",
        (("loco_wide", "{turn_name}_{turn_side}_{angle}_{tempo}_PATH", "path_turn_context"), ("vertical_8", "{turn_name}_{turn_side}_{angle}_{tempo}_VERTICAL", "vertical_turn_context"), ("true", "{turn_name}_{turn_side}_{angle}_{tempo}_ISOLATED", "isolated_turn")),
        (("true", "turn_angle_{small_angle}"), ("true", "turn_tempo_{small_tempo}")),
    ),
    Refiner(
        "family = 'WHOLE_BODY_LOCOMOTION'",
        (
            ("magnitude < 0.18 OR heading IN ('ACTIVE', 'MIXED') AND magnitude < 0.35", "LOCO_ROOT_DRIFT_{heading}_{pace}", "weak_root_drift"), ("heading IN ('ACTIVE', 'MIXED') OR turn", "LOCO_PATH_FRAGMENT_{heading}_{pace}", "path_fragment"),
            ("vertical_8 OR leg_8", "LOCO_GAIT_CONTEXT_{heading}_{pace}", "gait_context"), ("true", "LOCO_TRANSLATION_{heading}_{pace}", "translation_context"),
        ),
        (("vertical_8", "vertical_coupled"), ("leg_8", "leg_coupled"), ("turn", "turn_coupled"), ("arm_periodic", "arm_coupled")),
    ),
    Refiner(
        "cluster IN ('LL_KICK_FORWARD', 'RL_KICK_FORWARD', 'LL_LEG_FORWARD_POSE', 'RL_LEG_FORWARD_POSE')",
        (
            (f"right(cluster, 16) = 'LEG_FORWARD_POSE' OR duration >= 14 AND {_PACE} < 0.025", "{side}_LEG_FORWARD_HOLD_POSE", "hold_like"), ("(coupled OR loco) AND magnitude < 0.55", "{side}_LEG_FORWARD_GAIT_SWING", "gait_phase"),
            (f"vertical_12_close AND duration <= 12 AND {_PACE} >= 0.030", "{side}_LEG_FORWARD_HOP_OR_KICK_IMPULSE", "impulse_like"), ("magnitude >= 0.45 AND duration <= 12", "{side}_LEG_FORWARD_KICK_IMPULSE", "impulse_like"),
            ("true", "{side}_LEG_FORWARD_UNRESOLVED", "ambiguous_forward_leg"),
        ),
        (("coupled OR loco", "locomotion_coupled"), ("vertical_12_close", "vertical_coupled")),
    ),
    Refiner(
        "cluster IN ('WB_VERT_UP', 'WB_VERT_DOWN', 'WB_VERT_CYCLE', 'WB_VERT_REP', 'WB_VERT_REP_ALT')",
        (
            ("magnitude < 0.08 AND (coupled OR loco OR leg_forward)", "WB_VERT_GAIT_BOUNCE", "gait_bounce"), ("low_12 AND direction = 'down'", "WB_VERT_LOW_BODY_DESCENT", "low_body_transition"), ("low_12 AND direction = 'up'", "WB_VERT_LOW_BODY_RISE", "low_body_transition"),
            (f"arm_raise AND {_CYCLE}", "WB_VERT_ARM_RAISE_COORDINATED_CYCLE", "arm_raise_coupled"), ("arm_raise AND magnitude >= 0.12", "WB_VERT_ARM_RAISE_COUPLED", "arm_raise_coupled"),
            ("magnitude >= 0.20 AND direction = 'up'", "WB_VERT_JUMP_UP_IMPULSE", "salient_jump_up"), ("magnitude >= 0.20 AND direction = 'down'", "WB_VERT_SALIENT_DESCENT", "salient_descent"),
            ("cluster IN ('WB_VERT_CYCLE', 'WB_VERT_REP', 'WB_VERT_REP_ALT')", "WB_VERT_GENERIC_CYCLE", "vertical_cycle"), ("true", "{cluster}_REFINED_GENERIC", "generic_vertical"),
        ),
    ),
    Refiner(
        "cluster IN ('WB_SQUAT_HOLD', 'WB_LOW_BODY_HOLD')",
        (
            ("(down OR down_before) AND (up OR up_after)", "WB_LOW_BODY_DOWN_UP_CYCLE", "low_body_down_up_cycle"), ("down OR down_before", "WB_LOW_BODY_DESCENT_HOLD", "low_body_descent_hold"), ("up OR up_after", "WB_LOW_BODY_RISE_FROM_LOW", "low_body_rise_from_low"),
            ("duration >= 28 AND NOT loco", "{cluster}_SUSTAINED", "sustained_low_body"), ("loco", "{cluster}_LOCO_CONTEXT", "low_body_gait_context"), ("leg_10", "{cluster}_LEG_CONTEXT", "low_body_leg_extension_context"), ("true", "{cluster}_REFINED_GENERIC", "generic_low_body"),
        ),
        (("loco", "locomotion_coupled"), ("leg_10", "leg_coupled"), ("torso", "torso_coupled")),
    ),
    Refiner(
        "family IN ('TORSO_POSTURE', 'TORSO_PERIODIC')",
        (
            ("family = 'TORSO_POSTURE' AND duration >= 24 AND NOT loco", "{cluster}_SUSTAINED", "sustained_torso_posture"), ("low_10", "{cluster}_LOW_BODY_CONTEXT", ""), ("loco", "{cluster}_LOCO_CONTEXT", ""), ("vertical_8", "{cluster}_VERTICAL_CONTEXT", ""),
            ("family = 'TORSO_PERIODIC'", "{cluster}_{repeat}_{way}", "torso_periodic"), ("true", "{cluster}_REFINED_GENERIC", "generic_torso"),
        ),
        (("low_10", "low_body_coupled"), ("loco", "locomotion_coupled"), ("vertical_8", "vertical_coupled"), ("arm", "arm_coupled")),
    ),
    Refiner(
        "cluster IN ('LA_REPEAT', 'LA_REPEAT_ALT', 'LA_REPEAT_LOCO', 'LA_REPEAT_ALT_LOCO', 'LA_NEAR_FAR', 'RA_REPEAT', 'RA_REPEAT_ALT', 'RA_REPEAT_LOCO', 'RA_REPEAT_ALT_LOCO', 'RA_NEAR_FAR')",
        (
            ("opposite AND vertical_12", "{side}_BILATERAL_VERTICAL_ARM_CYCLE", "bilateral vertical_coupled"), ("opposite", "{side}_BILATERAL_ARM_PERIODIC_{way}", "bilateral"), ("coupled OR any_loco", "{side}_LOCO_ARM_SWING_{way}", "locomotion_coupled"),
            ("vertical_12", "{side}_VERTICAL_COUPLED_ARM_PERIODIC_{way}", "vertical_coupled"), ("bimanual_20", "{side}_BIMANUAL_CONTEXT_ARM_PERIODIC_{way}", "bimanual_context"), (_CYCLE, "{side}_ISOLATED_ARM_PERIODIC_{way}", "isolated_periodic"),
            ("true", "{cluster}_REFINED_GENERIC", "generic_arm"),
        ),
    ),
    Refiner(
        "cluster IN ('LA_HAND_HIGH', 'RA_HAND_HIGH')",
        (
            ("opposite_high AND vertical_10", "{side}_BILATERAL_HIGH_POSE_VERTICAL_CONTEXT", ""), ("opposite_high", "{side}_BILATERAL_HIGH_POSE", ""), ("any_loco", "{side}_HIGH_POSE_LOCO_CONTEXT", ""),
            ("duration >= 20", "{side}_HIGH_POSE_HOLD", "hold_like"), ("true", "{side}_HIGH_POSE_TRANSIENT", "transient_high_pose"),
        ),
        (("opposite_high", "bilateral_high_pose"), ("vertical_10", "vertical_coupled"), ("any_loco", "locomotion_coupled"), ("bimanual_12", "bimanual_context")),
    ),
    Refiner(
        "family = 'BIMANUAL_PERIODIC'",
        (
            ("cluster = 'BI_RAISE_SPREAD' AND vertical_10", "BI_RAISE_SPREAD_VERTICAL_CONTEXT", ""), ("left(cluster, 14) = 'BI_HANDS_CLOSE' AND vertical_10", "BI_HANDS_CLOSE_VERTICAL_CONTEXT", ""), ("low_10", "{cluster}_LOW_BODY_CONTEXT", ""), ("loco", "{cluster}_LOCO_CONTEXT", ""),
            (_CYCLE, "{cluster}_CYCLE_CONTEXT", "bimanual_cycle"), ("true", "{cluster}_REFINED_GENERIC", "generic_bimanual"),
        ),
        (("vertical_10", "vertical_coupled"), ("loco", "locomotion_coupled"), ("low_10", "low_body_coupled"), ("hand_high", "hand_high_coupled")),
    ),
)
MODES = ("v2", "v3", "v4", "v5")


def flagged(events: DataFrame, flags: dict[str, Flag]) -> DataFrame:
    """``events`` with a boolean column for each flag, false where nothing is near."""
    own = events.select(*COLUMNS[:4], "family", "cluster")
    reach = max(f.gap for f in flags.values()) + 1
    names = ("l_s", "l_e", "r_s", "r_e")
    pairs = spans.near_pairs(own, own, reach).where("l_event_id != r_event_id").withColumn("ratio", spans.ratio(*names)).withColumn("between", spans.gap(*names))
    seen = pairs.groupBy("case_id", F.col("l_event_id").alias("event_id")).agg(*[F.bool_or(F.expr(f.sql())).alias(n) for n, f in flags.items()])
    return events.join(seen, ["case_id", "event_id"], "left").fillna(False, list(flags))


def refined(events: DataFrame, mode: str = "v2", flags: dict[str, Flag] | None = None, derived: dict[str, str] | None = None, refiners: tuple[Refiner, ...] = REFINERS) -> DataFrame:
    """(case_id, event_id, refined, tags) of events with ``COLUMNS``.

    Mode ``v1`` changes nothing; an unknown mode is an error. Events that no refiner
    takes keep their cluster and get no tags; null texts are empty ones, a null
    magnitude is 0, a null ``coupled`` false.
    """
    texts = ("family", "cluster", "direction", "repeat_mode")
    own = events.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in texts else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c == "magnitude" else F.coalesce(F.col(c), F.lit(False)).alias(c) if c == "coupled" else F.col(c) for c in COLUMNS])
    if mode == "v1":
        return own.select("case_id", "event_id", F.col("cluster").alias("refined"), F.array().cast("array<string>").alias("tags"))
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    seen = flagged(own, flags or FLAGS)
    for name, sql in (derived or DERIVED).items():
        seen = seen.withColumn(name, F.expr(sql))
    name, tags = F.col("cluster"), F.array().cast("array<string>")
    for r in reversed(refiners):
        own_name, own_tag = F.lit(None).cast("string"), F.lit("")
        for condition, template, tag in reversed(r.rules):
            own_name = F.when(F.expr(condition), rendered(template)).otherwise(own_name)
            own_tag = F.when(F.expr(condition), F.lit(tag)).otherwise(own_tag)
        given = F.array(*[F.when(F.expr(c), rendered(t)) for c, t in r.tags]).cast("array<string>")
        given = F.array_distinct(F.filter(F.concat(F.array_compact(given), F.split(own_tag, " ")), lambda x: x != ""))
        name, tags = F.when(F.expr(r.takes), own_name).otherwise(name), F.when(F.expr(r.takes), given).otherwise(tags)
    return seen.select("case_id", "event_id", name.alias("refined"), tags.alias("tags"))
