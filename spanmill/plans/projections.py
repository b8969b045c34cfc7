"""Filters, bins, classifiers and contract checks compiled from rules."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import refinement as E
from ..operators import spans as S
from ..registry import query
from ..sources.adapters import EV, spans, table


def case(x: str, cuts, names, op="<=") -> str:
    """The SQL of a stepped bin."""
    return "CASE " + " ".join(f"WHEN {x} {op} {c} THEN '{n}'" for c, n in zip(cuts, names)) + f" ELSE '{names[-1]}' END"


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND label BETWEEN 0 AND 9 AND embedding[1] IS NOT NULL")
def prj01_shape_contract(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & F.col("label").between(0, 9) & F.col("embedding")[0].isNotNull()).select("vec_id")


RULE = {"all": [{"path": "n_chars", "op": "gte", "value": 600}, {"any": [{"path": "lang", "op": "in", "value": ["de", "fr"]}, {"not": {"path": "source", "op": "neq", "value": "src7"}}]}]}


@query("SELECT doc_id FROM documents WHERE n_chars >= 600 AND (lang IN ('de', 'fr') OR source = 'src7')")
def prj02_condition_interpreter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(R.condition(RULE)).select("doc_id")


@query("""SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'long' WHEN lang <> 'en' THEN 'foreign' ELSE 'plain' END AS kind, lang || '/' || source AS place, CAST(round(0.2 + least(0.6, 0.0001 * n_chars), 6) AS DOUBLE) AS weight, CAST(length(source) AS BIGINT) AS n FROM documents""")
def prj03_value_resolver(spark, sf_dir):
    kind = {"cases": [{"when": {"path": "n_chars", "op": "gt", "value": 5000}, "then": "long"}, {"when": {"path": "lang", "op": "neq", "value": "en"}, "then": "foreign"}], "default": "plain"}
    return table(spark, sf_dir, "documents").select("doc_id", R.value(kind).alias("kind"), R.value({"template": "%s/%s", "paths": ["lang", "source"]}).alias("place"), F.round(R.value({"base": 0.2, "cap": 0.6, "scale": 0.0001, "path": "n_chars"}), 6).alias("weight"), R.value({"len": "source"}).cast("long").alias("n"))


RULES = [
    ("burst", {"all": [{"path": "value", "op": "gt", "value": 150}, {"path": "channel", "op": "eq", "value": "error"}]}),
    ("heavy", {"path": "value", "op": "gte", "value": 100}),
    ("trade", {"path": "channel", "op": "in", "value": ["purchase", "signup"]}),
    ("light", {"path": "value", "op": "lt", "value": 5}),
]


@query(f"WITH {EV} SELECT event_id, CASE WHEN value > 150 AND channel = 'error' THEN 'burst' WHEN value >= 100 THEN 'heavy' WHEN channel IN ('purchase', 'signup') THEN 'trade' WHEN value < 5 THEN 'light' END AS pattern FROM ev")
def prj04_first_match_classifier(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", R.first_match(RULES).alias("pattern"))


@query(f"WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN value > 150 AND channel = 'error' THEN 'burst' END, CASE WHEN value >= 100 THEN 'heavy' END, CASE WHEN channel IN ('purchase', 'signup') THEN 'trade' END, CASE WHEN value < 5 THEN 'light' END) AS patterns FROM ev")
def prj05_all_match_classifier(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", F.array_join(R.all_matches(RULES), ",").alias("patterns"))


@query(f"""WITH {EV} SELECT event_id FROM ev l WHERE channel = 'click' AND value >= 20 AND NOT starts_with(CAST(event_id AS VARCHAR), '9')
AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.case_id = l.case_id AND r.channel = 'error' AND r.value >= 80 AND greatest(l.s, r.s) - least(l.e, r.e) <= 3)""")
def prj06_suppressed_spec(spark, sf_dir):
    ev = spans(spark, sf_dir)
    own = ev.where("channel = 'click' AND value >= 20").where(~F.col("event_id").cast("string").startswith("9"))
    driven = S.near_pairs(own, ev.where("channel = 'error' AND value >= 80"), 3).select(F.col("l_event_id").alias("event_id")).distinct()
    return own.join(driven, "event_id", "left_anti").select("event_id")


@query("""SELECT p_partkey, CASE WHEN p_type LIKE 'ECON%' AND p_size < 10 THEN 'small_economy' WHEN p_type LIKE 'ECON%' THEN 'economy' WHEN p_name LIKE '%ring' THEN 'rings' WHEN p_brand = 'Brand#1' THEN 'house' ELSE 'other' END AS channel FROM part""")
def prj07_channel_router(spark, sf_dir):
    economy = F.col("p_type").startswith("ECON")
    channel = F.when(economy & (F.col("p_size") < 10), "small_economy").when(economy, "economy").when(F.col("p_name").endswith("ring"), "rings").when(F.col("p_brand") == "Brand#1", "house").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", channel.alias("channel"))


ZONES = {"view": "browse", "click": "browse", "purchase": "trade", "signup": "trade"}


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'browse' WHEN 'click' THEN 'browse' WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'trade' ELSE 'other' END AS zone FROM events")
def prj08_zone_map(spark, sf_dir):
    zones = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(zones, F.col("event_type")), F.lit("other")).alias("zone"))


DUR = ([3, 8, 20, 60], ["xs", "s", "m", "l", "xl"])
MAG = {"deg": ([30, 90, 180, 360], ["xs", "s", "m", "l", "xl"]), "m": ([0.06, 0.16, 0.45, 1.5], ["xs", "s", "m", "l", "xl"]), "ratio": ([0.15, 0.45], ["s", "m", "l"]), "other": ([1, 5], ["s", "m", "l"])}
UNIT = "CASE channel WHEN 'view' THEN 'deg' WHEN 'click' THEN 'm' WHEN 'error' THEN 'ratio' ELSE 'other' END"


def unit():
    """The unit of an event's value, by channel."""
    c = F.col("channel")
    return F.when(c == "view", "deg").when(c == "click", "m").when(c == "error", "ratio").otherwise("other")


def magnitude(x, of):
    """The magnitude bin of a value in a unit; 'none' if it is not positive and finite."""
    out = F.lit("none")
    for name, (cuts, names) in MAG.items():
        out = F.when(of == name, R.stepped(x, cuts, names)).otherwise(out)
    return F.when(x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf")), "none").otherwise(out)


MAGNITUDE = "CASE WHEN x IS NULL OR x <= 0 THEN 'none' ELSE CASE u " + " ".join(f"WHEN '{u}' THEN {case('x', *b)}" for u, b in MAG.items()) + " END END"
SPEED = "CASE u " + " ".join(f"WHEN '{u}' THEN {case('v', c, ['slow', 'medium', 'fast'])}" for u, c in (("deg", [2, 6]), ("ratio", [0.04, 0.1]))) + f" ELSE {case('v', [0.01, 0.035], ['slow', 'medium', 'fast'])} END"


@query(f"WITH {EV} SELECT event_id, {case('e - s + 1', *DUR)} AS bin FROM ev")
def prj09_duration_bin(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", R.stepped(S.duration("s", "e"), *DUR).alias("bin"))


@query(f"WITH {EV}, x AS (SELECT event_id, CASE WHEN {UNIT} IN ('m', 'ratio') THEN value / 100 ELSE value END AS x, {UNIT} AS u FROM ev) SELECT event_id, {MAGNITUDE} AS bin FROM x")
def prj10_magnitude_bin(spark, sf_dir):
    x = F.when(unit().isin("m", "ratio"), F.col("value") / 100).otherwise(F.col("value"))
    return spans(spark, sf_dir).select("event_id", magnitude(x, unit()).alias("bin"))


@query(f"WITH {EV}, x AS (SELECT event_id, CASE WHEN {UNIT} = 'deg' THEN value ELSE value / 100 END / (e - s + 1) AS v, {UNIT} AS u FROM ev) SELECT event_id, {SPEED} AS bin FROM x")
def prj11_speed_bin(spark, sf_dir):
    v = F.when(unit() == "deg", F.col("value")).otherwise(F.col("value") / 100) / S.duration("s", "e")
    names = ["slow", "medium", "fast"]
    out = F.when(unit() == "deg", R.stepped(v, [2, 6], names)).when(unit() == "ratio", R.stepped(v, [0.04, 0.1], names)).otherwise(R.stepped(v, [0.01, 0.035], names))
    return spans(spark, sf_dir).select("event_id", out.alias("bin"))


@query("""SELECT conv_id, turn, CASE WHEN n IS NULL THEN NULL WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END AS bin FROM (SELECT conv_id, turn, TRY_CAST(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) ELSE role END AS INT) AS n FROM conversations)""")
def prj12_count_bin(spark, sf_dir):
    n = F.when(F.col("role") == "user", F.col("turn").cast("string")).otherwise(F.col("role")).try_cast("int")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.stepped(n, [1, 3, 6], ["1", "2-3", "4-6", "7+"]).alias("bin"))


@query(f"WITH {EV} SELECT event_id, {case('value', [20, 60], ['S', 'M', 'L'])} AS size, {case('e - s + 1', [4, 8], ['SHORT', 'MEDIUM', 'LONG'])} AS length FROM ev")
def prj13_two_cut_bins(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", R.stepped(F.col("value"), [20, 60], ["S", "M", "L"]).alias("size"), R.stepped(S.duration("s", "e"), [4, 8], ["SHORT", "MEDIUM", "LONG"]).alias("length"))


@query("SELECT " + case("p_size", [10, 20, 35], ["[0,10)", "[10,20)", "[20,35)", ">=35"], "<") + " AS bucket, count(*) AS n FROM part GROUP BY 1")
def prj14_half_open_buckets(spark, sf_dir):
    bucket = R.stepped(F.col("p_size"), [10, 20, 35], ["[0,10)", "[10,20)", "[20,35)", ">=35"], closed=False)
    return table(spark, sf_dir, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_id, " + case("value", [75, 135, 225, 315, 450], ["small", "quarter", "half", "three_quarter", "full", "multi"], "<") + " AS turn FROM events")
def prj15_rotation_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.stepped(F.col("value"), [75, 135, 225, 315, 450], ["small", "quarter", "half", "three_quarter", "full", "multi"], closed=False).alias("turn"))


@query(f"WITH {EV}, t AS (SELECT case_id, channel, (max(e) - min(s) + 1) / count(*) / 10 AS x FROM ev GROUP BY ALL) SELECT case_id, channel, {case('x', [6, 14], ['fast', 'medium', 'slow'])} AS tempo FROM t")
def prj16_tempo_bucket(spark, sf_dir):
    x = (F.max("e") - F.min("s") + 1) / F.count("*") / 10
    return spans(spark, sf_dir).groupBy("case_id", "channel").agg(R.stepped(x, [6, 14], ["fast", "medium", "slow"]).alias("tempo"))


@query("""WITH b(ord, k, v) AS (VALUES (0, 'tiny', 2.0), (1, 'low', 20.0), (2, 'mid', 60.0), (3, 'high', 150.0)) SELECT event_id, k AS bin FROM events CROSS JOIN b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(value - v), ord) = 1""")
def prj17_nearest_reference(spark, sf_dir):
    bins = F.array(*[F.struct(F.abs(F.col("value") - v).alias("far"), F.lit(o).alias("ord"), F.lit(k).alias("k")) for o, (k, v) in enumerate((("tiny", 2.0), ("low", 20.0), ("mid", 60.0), ("high", 150.0)))])
    return table(spark, sf_dir, "events").select("event_id", F.array_min(bins)["k"].alias("bin"))


SYMBOL = f"channel || '/' || concat_ws('|', CASE WHEN value >= 60 THEN 'up' ELSE 'flat' END, {case('e - s + 1', *DUR)}, {case('value', [20, 60], ['S', 'M', 'L'])}, CASE WHEN channel = 'click' THEN CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END)"


@query(f"WITH {EV} SELECT {SYMBOL} AS symbol, count(*) AS n, count(DISTINCT case_id) AS cases FROM ev GROUP BY 1")
def prj18_event_symbol(spark, sf_dir):
    parts = [F.when(F.col("value") >= 60, "up").otherwise("flat"), R.stepped(S.duration("s", "e"), *DUR), R.stepped(F.col("value"), [20, 60], ["S", "M", "L"]), F.when(F.col("channel") == "click", F.floor(F.col("value") / 10).cast("string"))]
    symbol = F.concat(F.col("channel"), F.lit("/"), F.concat_ws("|", *parts))
    return spans(spark, sf_dir).groupBy(symbol.alias("symbol")).agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query(f"WITH {EV}, x AS (SELECT upper(channel) || '_' || {case('value', [20, 60], ['S', 'M', 'L'])} AS sym FROM ev) SELECT sym AS symbol, regexp_replace(sym, '_(S|M|L|SHORT|MEDIUM|LONG)$', '') AS canonical, count(*) AS n FROM x GROUP BY ALL")
def prj19_symbol_canonicalizer(spark, sf_dir):
    sym = F.concat(F.upper("channel"), F.lit("_"), R.stepped(F.col("value"), [20, 60], ["S", "M", "L"]))
    return spans(spark, sf_dir).groupBy(sym.alias("symbol")).agg(F.count("*").alias("n")).select("symbol", F.regexp_replace("symbol", "_(S|M|L|SHORT|MEDIUM|LONG)$", "").alias("canonical"), "n")


@query("""SELECT p_partkey, regexp_replace(id, '^M([0-9]+)$', '\\1') AS canonical FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'ix' ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part)""")
def prj20_mirror_id(spark, sf_dir):
    mirrored = F.concat(F.when(F.col("p_partkey") % 2 == 0, "M").otherwise(""), F.when(F.col("p_partkey") % 5 == 0, "ix").otherwise(F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(mirrored, "^M([0-9]+)$", "$1").alias("canonical"))


@query(f"""WITH {EV} SELECT event_id, CASE WHEN channel = 'click' AND EXISTS (SELECT 1 FROM ev r WHERE r.case_id = l.case_id AND r.channel = 'purchase' AND greatest(l.s, r.s) <= least(l.e, r.e)) THEN 'click_buying'
WHEN channel = 'click' AND EXISTS (SELECT 1 FROM ev r WHERE r.case_id = l.case_id AND r.channel = 'error' AND greatest(l.s, r.s) - least(l.e, r.e) <= 6) THEN 'click_failing' ELSE channel END AS refined FROM ev l""")
def prj21_event_refinement(spark, sf_dir):
    """Labels refined by what is near; all refinements see the unrefined events."""
    ev = spans(spark, sf_dir)
    near = S.near_pairs(ev.where("channel = 'click'"), ev.where("channel IN ('purchase', 'error')"), 6)
    flags = near.groupBy(F.col("l_event_id").alias("event_id")).agg(
        F.bool_or((F.col("r_channel") == "purchase") & (S.overlap("l_s", "l_e", "r_s", "r_e") > 0)).alias("buying"), F.bool_or(F.col("r_channel") == "error").alias("failing")
    )
    refined = F.when(F.col("buying"), "click_buying").when(F.col("failing"), "click_failing").otherwise(F.col("channel"))
    return ev.join(flags, "event_id", "left").select("event_id", refined.alias("refined"))


# What the sample's channels stand for: families, clusters and directions, taken in turn by the event's value.
BODY_EVENTS = {
    "view": (("WHOLE_BODY_LOCOMOTION", "LOCO_WALK_FORWARD_SLOW", "forward"), ("WHOLE_BODY_LOCOMOTION", "LOCO_MOVE", "mixed"), ("WHOLE_BODY_LOCOMOTION", "LOCO_TURN_LEFT_QTR", "left"), ("WHOLE_BODY_ROTATION", "WB_TURN_HALF", "right"), ("WHOLE_BODY_LOCOMOTION", "LOCO_WALK_LEFT", "left")),
    "click": (("LEFT_ARM_PERIODIC", "LA_REPEAT", "up"), ("RIGHT_ARM_PERIODIC", "RA_REPEAT_ALT", "down"), ("LEFT_ARM_POSTURE", "LA_HAND_HIGH", "up"), ("RIGHT_ARM_POSTURE", "RA_HAND_HIGH", "up"), ("BIMANUAL_PERIODIC", "BI_RAISE_SPREAD", "out"), ("BIMANUAL_PERIODIC", "BI_HANDS_CLOSE_FAST", "in"), ("BIMANUAL_PERIODIC", "BI_CLAP", "in")),
    "purchase": (("WHOLE_BODY_VERTICAL", "WB_VERT_UP", "up"), ("WHOLE_BODY_VERTICAL", "WB_VERT_DOWN", "down"), ("WHOLE_BODY_VERTICAL", "WB_VERT_CYCLE", "none"), ("WHOLE_BODY_POSTURE", "WB_SQUAT_HOLD", "none"), ("WHOLE_BODY_POSTURE", "WB_LOW_BODY_HOLD", "none")),
    "signup": (("LEFT_LEG", "LL_KICK_FORWARD", "forward"), ("RIGHT_LEG", "RL_LEG_FORWARD_POSE", "forward"), ("RIGHT_LEG", "RL_KICK_FORWARD", "forward"), ("RIGHT_LEG", "RL_STEP", "none")),
    "error": (("TORSO_POSTURE", "TORSO_BEND", "forward"), ("TORSO_PERIODIC", "TORSO_SWAY", "left"), ("FINGERS", "F_POINT", "none")),
}
_TURN = {c: f"CAST(floor(value * 7) AS BIGINT) % {len(own)}" for c, own in BODY_EVENTS.items()}
_AT = lambda k: "CASE " + " ".join(f"WHEN channel = '{c}' AND {_TURN[c]} = {i} THEN '{x[k]}'" for c, own in BODY_EVENTS.items() for i, x in enumerate(own)) + " ELSE '' END"
_SIZE, _MODE, _TIED = "CAST(floor(value * 13) AS BIGINT) % 70 / CAST(100 AS DOUBLE)", "CASE CAST(floor(value * 3) AS BIGINT) % 3 WHEN 0 THEN 'cycle' WHEN 1 THEN 'repeated_cycle' ELSE '' END", "CAST(floor(value * 11) AS BIGINT) % 10 = 0"


def _text(template: str) -> str:
    """A text with columns in braces, as SQL."""
    return " || ".join(x for text, name, *_ in Formatter().parse(template) for x in ([f"'{text}'"] if text else []) + ([name] if name else []))


def _when(r: E.Refiner, what) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {what(t, tag)}" for c, t, tag in r.rules) + " END"


_FLAGGED = ", ".join(f"coalesce(bool_or({f.sql()}), false) AS {n}" for n, f in E.FLAGS.items())
_TAGS = lambda r: "list_filter(list_concat([" + ", ".join(f"CASE WHEN {c} THEN {_text(t)} END" for c, t in r.tags) + "]::VARCHAR[], string_split(" + _when(r, lambda t, tag: f"'{tag}'") + ", ' ')), lambda x: x <> '')"


@query(f"""WITH {EV}, b AS (SELECT case_id, event_id, s, e, {_AT(0)} AS family, {_AT(1)} AS cluster, {_AT(2)} AS direction, {_SIZE} AS magnitude, {_MODE} AS repeat_mode, {_TIED} AS coupled FROM ev),
pr AS (SELECT l.case_id, l.event_id, l.s AS l_s, l.e AS l_e, r.s AS r_s, r.e AS r_e, l.cluster AS l_cluster, r.family AS r_family, r.cluster AS r_cluster, greatest(least(l.e, r.e) - greatest(l.s, r.s) + 1, 0) / (least(l.e - l.s, r.e - r.s) + 1) AS ratio,
greatest(greatest(l.s, r.s) - least(l.e, r.e) - 1, 0) AS "between" FROM b l JOIN b r ON l.case_id = r.case_id AND l.event_id <> r.event_id), fl AS (SELECT case_id, event_id, {_FLAGGED.replace("between <=", '"between" <=')} FROM pr GROUP BY ALL),
q AS (SELECT b.*, {", ".join(f"coalesce({n}, false) AS {n}" for n in E.FLAGS)} FROM b LEFT JOIN fl USING (case_id, event_id)), d AS (SELECT *, {", ".join(f"{sql} AS {n}" for n, sql in E.DERIVED.items() if "duration" not in sql)} FROM q),
x AS (SELECT *, {", ".join(f"{sql} AS {n}" for n, sql in E.DERIVED.items() if "duration" in sql)} FROM d)
SELECT event_id, CASE {" ".join(f"WHEN {r.takes} THEN {_when(r, lambda t, tag: _text(t))}" for r in E.REFINERS)} ELSE cluster END AS refined, array_to_string(list_sort(list_distinct(CASE {" ".join(f"WHEN {r.takes} THEN {_TAGS(r)}" for r in E.REFINERS)} ELSE [] END)), ',') AS tags FROM x""")
def prj21_all_refiners(spark, sf_dir):
    """All refiners over the events as those of a body."""
    ev = spans(spark, sf_dir)
    own = ev.select("case_id", "event_id", "s", "e", *[F.expr(x).alias(n) for x, n in ((_AT(0), "family"), (_AT(1), "cluster"), (_AT(2), "direction"), (_SIZE, "magnitude"), (_MODE, "repeat_mode"), (_TIED, "coupled"))])
    return E.refined(own, "v5").select("event_id", "refined", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("""WITH s AS (SELECT c_custkey, unnest(['nation', 'balance', 'segment', 'extra']) AS slot, unnest([CAST(c_nationkey AS VARCHAR), CAST(round(c_acctbal) AS BIGINT)::VARCHAR, c_mktsegment, 'x']) AS v FROM customer)
SELECT slot, CASE WHEN slot = 'extra' THEN 'unknown_slot' WHEN slot IN ('nation', 'balance') AND TRY_CAST(v AS DOUBLE) IS NULL THEN 'not_a_number' WHEN slot = 'balance' AND TRY_CAST(v AS DOUBLE) < 0 THEN 'negative' ELSE 'ok' END AS issue, count(*) AS n FROM s GROUP BY ALL""")
def prj22_slot_contract(spark, sf_dir):
    slots = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("balance"), F.round("c_acctbal").cast("bigint").cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("extra"), F.lit("x"))
    s = table(spark, sf_dir, "customer").select(F.explode(slots).alias("slot", "v"))
    x = F.col("v").try_cast("double")
    issue = F.when(F.col("slot") == "extra", "unknown_slot").when(F.col("slot").isin("nation", "balance") & x.isNull(), "not_a_number").when((F.col("slot") == "balance") & (x < 0), "negative").otherwise("ok")
    return s.groupBy("slot", issue.alias("issue")).agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, h AS (SELECT case_id, list(DISTINCT channel) AS have FROM ev WHERE value > 120 GROUP BY 1) SELECT case_id, concat_ws(',', CASE WHEN NOT list_has_any(have, ['purchase', 'signup']) THEN 'purchase|signup' END, CASE WHEN NOT list_has_any(have, ['view']) THEN 'view' END) AS missing FROM h""")
def prj23_required_slots(spark, sf_dir):
    required = F.array(F.lit("purchase|signup"), F.lit("view"))
    h = spans(spark, sf_dir).where("value > 120").groupBy("case_id").agg(F.collect_set("channel").alias("have"))
    return h.select("case_id", F.array_join(F.filter(required, lambda r: ~F.arrays_overlap(F.split(r, r"\|"), "have")), ",").alias("missing"))
