"""Interval, nearest-neighbour, membership and matching joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection as C
from ..operators import spans as S
from ..registry import query
from ..sources.adapters import BASKET, CAP, EV, baskets, captions, spans, table

#: Every ordered pair of two spans of one case; the oracles filter it.
PAIRS = """p AS (SELECT l.case_id, l.event_id AS l_id, r.event_id AS r_id, l.channel AS l_ch, r.channel AS r_ch, l.s AS ls, l.e AS le, r.s AS rs, r.e AS re,
  l.value AS lv, r.value AS rv, greatest(least(l.e, r.e) - greatest(l.s, r.s) + 1, 0) AS ov, least(l.e - l.s, r.e - r.s) + 1 AS md, l.e - l.s + 1 AS ld, r.e - r.s + 1 AS rd,
  greatest(greatest(l.s, r.s) - least(l.e, r.e), 0) AS apart FROM ev l JOIN ev r ON l.case_id = r.case_id AND l.event_id <> r.event_id)"""
WITH = f"WITH {EV}, {PAIRS}"
NAMES = ("l_s", "l_e", "r_s", "r_e")
REL = f"""{WITH}, rel AS (SELECT * FROM (SELECT *, ov / md AS ratio, CASE WHEN apart > 0 THEN apart - 1 ELSE 0 END AS g,
  CASE WHEN l_ch <> r_ch AND ov / md >= 0.3 THEN 'parallel' WHEN apart > 7 THEN NULL WHEN l_ch = r_ch THEN 'same_channel_adjacent' ELSE 'lead_lag' END AS relation
  FROM p WHERE (ls, le, l_id) < (rs, re, r_id)) WHERE relation IS NOT NULL)"""


@query(f"""{REL} SELECT l_ch AS left_channel, r_ch AS right_channel, relation, count(*) AS n, count(DISTINCT case_id) AS cases FROM rel GROUP BY ALL""")
def join01_interval_relations(spark, sf_dir):
    rel = S.relations(spans(spark, sf_dir))
    out = rel.groupBy(F.col("l_channel").alias("left_channel"), F.col("r_channel").alias("right_channel"), "relation")
    return out.agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query(f"""{REL} SELECT case_id, l_id, r_id, relation, ov AS overlap, ratio, g AS gap_between, CASE WHEN apart > 0 THEN apart ELSE 0 END AS gap_to_start FROM rel""")
def join02_overlap_gap_kernel(spark, sf_dir):
    rel = S.relations(spans(spark, sf_dir))
    return rel.select("case_id", F.col("l_event_id").alias("l_id"), F.col("r_event_id").alias("r_id"), "relation", F.col("ov").alias("overlap"), "ratio", F.col("gap").alias("gap_between"), S.gap(*NAMES, between=False).alias("gap_to_start"))


@query(f"""{WITH} SELECT case_id, l_id, r_id, ov / ld AS share FROM p WHERE ov > 0""")
def join03_asymmetric_overlap(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev, ev, 0).where("l_event_id != r_event_id")
    return pairs.select("case_id", F.col("l_event_id").alias("l_id"), F.col("r_event_id").alias("r_id"), S.ratio(*NAMES, of="left").alias("share"))


@query(f"""WITH {EV} SELECT case_id, event_id, channel, s, e FROM ev l WHERE channel = 'error' AND EXISTS (SELECT 1 FROM ev r WHERE r.case_id = l.case_id AND r.channel = 'click'
  AND ((least(l.e, r.e) - greatest(l.s, r.s) + 1) >= 0.5 * (least(l.e - l.s, r.e - r.s) + 1) OR (greatest(l.s, r.s) > least(l.e, r.e) AND greatest(l.s, r.s) - least(l.e, r.e) - 1 <= 2)))""")
def join04_near_or_overlap_semi(spark, sf_dir):
    ev = spans(spark, sf_dir)
    return S.near_semi(ev.where("channel = 'error'"), ev.where("channel = 'click'"), 2, 0.5).select("case_id", "event_id", "channel", "s", "e")


@query(f"""WITH {EV}, b AS (SELECT event_id FROM ev l WHERE EXISTS (SELECT 1 FROM ev r WHERE r.case_id = l.case_id AND r.event_id <> l.event_id AND l.s - r.e BETWEEN 0 AND 3)),
a AS (SELECT event_id FROM ev l WHERE EXISTS (SELECT 1 FROM ev r WHERE r.case_id = l.case_id AND r.event_id <> l.event_id AND r.s - l.e BETWEEN 0 AND 3))
SELECT event_id, 'before' AS side FROM b UNION ALL SELECT event_id, 'after' FROM a""")
def join05_before_after_semi(spark, sf_dir):
    ev = spans(spark, sf_dir)
    sides = [S.sequel_semi(ev, ev, 3, side == "before").select("event_id", F.lit(side).alias("side")) for side in ("before", "after")]
    return sides[0].unionAll(sides[1])


@query(f"""WITH {EV} SELECT case_id, event_id, s, e FROM ev l WHERE channel = 'view' AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.case_id = l.case_id AND r.channel = 'purchase' AND greatest(l.s, r.s) <= least(l.e, r.e))""")
def join06_uncovered_anti(spark, sf_dir):
    ev = spans(spark, sf_dir)
    return S.uncovered(ev.where("channel = 'view'"), ev.where("channel = 'purchase'")).select("case_id", "event_id", "s", "e")


@query(f"""{WITH} SELECT case_id, l_id AS event_id, r_id AS partner_id, ov / md AS ratio, apart AS gap FROM p WHERE apart <= 24
QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY ov / md DESC, apart, rs, r_id) = 1""")
def join07_nearest_partner(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev, ev, 24).where("l_event_id != r_event_id").withColumn("ratio", S.ratio(*NAMES)).withColumn("gap", S.gap(*NAMES, between=False))
    best = S.best_match(pairs, ["l_event_id"], [F.desc("ratio"), F.asc("gap"), F.asc("r_s"), F.asc("r_event_id")])
    return best.select("case_id", F.col("l_event_id").alias("event_id"), F.col("r_event_id").alias("partner_id"), "ratio", "gap")


@query(f"""{WITH} SELECT l_id AS event_id, max_by(r_id, (re, r_id)) FILTER (re <= ls AND ls - re <= 48) AS before_id, min_by(r_id, (rs, r_id)) FILTER (rs >= le AND rs - le <= 48) AS after_id
FROM p WHERE l_ch = 'error' AND r_ch = 'view' AND ((re <= ls AND ls - re <= 48) OR (rs >= le AND rs - le <= 48)) GROUP BY l_id""")
def join08_nearest_run_as_of(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev.where("channel = 'error'"), ev.where("channel = 'view'"), 48)
    before, after = (F.col("l_s") - F.col("r_e")).between(0, 48), (F.col("r_s") - F.col("l_e")).between(0, 48)
    return (
        pairs.where(before | after).groupBy(F.col("l_event_id").alias("event_id"))
        .agg(
            F.max_by("r_event_id", F.when(before, F.struct("r_e", "r_event_id"))).alias("before_id"),
            F.min_by("r_event_id", F.when(after, F.struct("r_s", "r_event_id"))).alias("after_id"),
        )
    )


@query(f"""{WITH} SELECT l_id AS anchor_id, r_ch AS channel, r_id AS partner_id, round(10 * (ov / md) + length(r_ch) * 0.1 - 0.001 * rd, 6) AS score FROM p WHERE l_ch = 'purchase' AND r_ch <> 'purchase' AND ov > 0
QUALIFY row_number() OVER (PARTITION BY l_id, r_ch ORDER BY round(10 * (ov / md) + length(r_ch) * 0.1 - 0.001 * rd, 6) DESC, r_id) = 1""")
def join09_best_cross_channel_partner(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev.where("channel = 'purchase'"), ev.where("channel != 'purchase'"), 0)
    score = F.round(10 * S.ratio(*NAMES) + F.length("r_channel") * 0.1 - 0.001 * S.duration("r_s", "r_e"), 6)
    best = S.best_match(pairs.withColumn("score", score), ["l_event_id", "r_channel"], [F.desc("score"), F.asc("r_event_id")])
    return best.select(F.col("l_event_id").alias("anchor_id"), F.col("r_channel").alias("channel"), F.col("r_event_id").alias("partner_id"), "score")


@query(f"""{WITH} SELECT l_id AS event_id, r_id AS partner_id, greatest(ov / md, CASE WHEN apart <= 4 THEN 0.35 ELSE 0 END) AS credit FROM p WHERE l_ch < r_ch AND apart <= 4
QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY greatest(ov / md, CASE WHEN apart <= 4 THEN 0.35 ELSE 0 END) DESC, r_id) = 1""")
def join10_best_partner_with_gap_credit(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev, ev, 4).where("l_channel < r_channel").withColumn("credit", F.greatest(S.ratio(*NAMES), F.lit(0.35)))
    best = S.best_match(pairs, ["l_event_id"], [F.desc("credit"), F.asc("r_event_id")])
    return best.select(F.col("l_event_id").alias("event_id"), F.col("r_event_id").alias("partner_id"), "credit")


@query(f"""{WITH}, q AS (SELECT *, abs((ls + le) - (rs + re)) AS c2 FROM p WHERE l_ch = 'click' AND r_ch = 'view'),
z AS (SELECT *, ov / md + CASE WHEN apart <= 6 THEN 0.5 ELSE 0 END + CASE WHEN c2 <= 24 THEN 0.25 ELSE 0 END AS score FROM q)
SELECT case_id, l_id, r_id, score, CASE WHEN ov > 0 THEN 'overlap' WHEN apart <= 6 THEN 'near' WHEN c2 <= 48 THEN 'broad_context' ELSE 'distant' END AS relation FROM z
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, c2, l_id, r_id) = 1""")
def join11_best_group_pair(spark, sf_dir):
    ev = spans(spark, sf_dir)
    left = ev.where("channel = 'click'").select("case_id", *[F.col(c).alias(f"l_{c}") for c in ("event_id", "s", "e")])
    right = ev.where("channel = 'view'").select("case_id", *[F.col(c).alias(f"r_{c}") for c in ("event_id", "s", "e")])
    # A pair that scores has its spans within 12 of each other; only cases without one need the nearest centres.
    apart, centre = S.gap(*NAMES, between=False), F.abs((F.col("l_s") + F.col("l_e")) - (F.col("r_s") + F.col("r_e")))
    score = S.ratio(*NAMES) + F.when(apart <= 6, 0.5).otherwise(0) + F.when(centre <= 24, 0.25).otherwise(0)
    kind = F.when(S.overlap(*NAMES) > 0, "overlap").when(apart <= 6, "near").when(centre <= 48, "broad_context").otherwise("distant")
    kept = lambda pairs: pairs.select("case_id", F.col("l_event_id").alias("l_id"), F.col("r_event_id").alias("r_id"), score.alias("score"), centre.alias("c2"), kind.alias("relation"))
    order = [F.desc("score"), F.asc("c2"), F.asc("l_id"), F.asc("r_id")]
    strip = lambda df: df.select("case_id", *[F.col(c).alias(c[2:]) for c in df.columns if c != "case_id"])
    near = S.best_match(kept(S.near_pairs(strip(left), strip(right), 13)).where("score > 0"), ["case_id"], order)
    open_cases = left.select("case_id").distinct().join(near, "case_id", "left_anti")
    middle = lambda df, p: df.join(open_cases, "case_id", "left_semi").withColumn("c", F.col(f"{p}_s") + F.col(f"{p}_e"))
    # One span for each centre; the centres of both groups in order give each left one its neighbours on either side.
    one = lambda df, p: df.groupBy("case_id", "c").agg(F.min_by(F.struct(*[f"{p}_{x}" for x in ("event_id", "s", "e")]), f"{p}_event_id").alias(p))
    both = one(middle(left, "l"), "l").join(one(middle(right, "r"), "r"), ["case_id", "c"], "full")
    upto = Window.partitionBy("case_id").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("case_id").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    sides = both.withColumn("before", F.last("r", True).over(upto)).withColumn("after", F.last("r", True).over(down)).where("l IS NOT NULL")
    far = sides.select("case_id", "l", F.explode(F.array_compact(F.array("before", "after"))).alias("r")).select("case_id", "l.*", "r.*")
    return near.unionByName(S.best_match(kept(far), ["case_id"], order)).drop("c2")


def nearest_by_price(f, k):
    """(p_brand, p_type, price, r_id, r_p_size, r_price): for each price the k rows of its group that are nearest by price, then id.

    They are among the first k of each of the k prices on either side, so that no group's pairs are formed.
    """
    group = ["p_brand", "p_type"]
    first = f.withColumn("n", F.row_number().over(Window.partitionBy(*group, "price").orderBy("id"))).where(F.col("n") <= k)
    prices = first.groupBy(*group, "price").agg(F.array_sort(F.collect_list(F.struct("id", "p_size"))).alias("rows"))
    around = F.collect_list(F.struct("price", "rows")).over(Window.partitionBy(*group).orderBy("price").rowsBetween(-k, k))
    each = prices.withColumn("around", around).select(*group, "price", F.inline("around").alias("r_price", "rows"))
    each = each.select(*group, "price", "r_price", F.inline("rows").alias("r_id", "r_p_size"))
    order = Window.partitionBy(*group, "price").orderBy(F.abs(F.col("price") - F.col("r_price")), "r_id")
    return each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


@query("""WITH f AS (SELECT p_partkey AS id, p_brand AS b, p_type AS t, p_size, CAST(round(p_retailprice) AS BIGINT) AS price FROM part),
n AS (SELECT l.id AS l_id, r.id AS r_id, l.p_size AS ls, r.p_size AS rs, l.price AS lp, r.price AS rp FROM f l JOIN f r ON l.b = r.b AND l.t = r.t AND l.id <> r.id
  QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY abs(l.price - r.price), r.id) <= 64),
a AS (SELECT l_id, r_id, 1 AS ord, 'size' AS attribute, rs - ls AS delta, abs(rs - ls) / 20 AS dist FROM n UNION ALL SELECT l_id, r_id, 2, 'price', rp - lp, abs(rp - lp) / 20 FROM n),
c AS (SELECT * FROM a WHERE abs(delta) BETWEEN 8 AND 45 AND dist <= 2.5 QUALIFY row_number() OVER (PARTITION BY l_id, ord ORDER BY dist, r_id) = 1)
SELECT l_id, r_id, attribute, CAST(delta AS BIGINT) AS delta FROM c QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY ord) <= 4""")
def join12_constrained_matching(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", F.round("p_retailprice").cast("bigint").alias("price"))
    near = f.join(nearest_by_price(f, 65), ["p_brand", "p_type", "price"]).where("id != r_id")  # itself may be among them
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.abs(F.col("price") - F.col("r_price")), "r_id"))).where("n <= 64")
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(a).alias("attribute"), (F.col(f"r_{c}") - F.col(c)).cast("bigint").alias("delta")) for k, (a, c) in enumerate((("size", "p_size"), ("price", "price")), 1)])
    rows = near.select("id", "r_id", F.inline(each)).where(F.abs("delta").between(8, 45) & (F.abs("delta") / 20 <= 2.5))
    best = S.best_match(rows, ["id", "ord"], [F.abs("delta").asc(), F.asc("r_id")])
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("n <= 4")
    return best.select(F.col("id").alias("l_id"), "r_id", "attribute", "delta")


@query(f"""WITH {BASKET} SELECT n_name AS node, count(DISTINCT b.item) AS symbols, count(DISTINCT b.case_id) AS cases FROM basket b JOIN customer ON case_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def join13_membership_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("case_id"), F.col("n_name").alias("node"))
    return baskets(spark, sf_dir, "case_id").join(customers, "case_id").groupBy("node").agg(F.countDistinct("item").alias("symbols"), F.countDistinct("case_id").alias("cases"))


@query(f"""WITH {BASKET}, i AS (SELECT DISTINCT case_id, item FROM basket) SELECT a.item AS left_item, b.item AS right_item, count(*) AS shared FROM i a JOIN i b ON a.case_id = b.case_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 20""")
def join14_all_pairs_set_overlap(spark, sf_dir):
    return C.overlapping_sets(baskets(spark, sf_dir), 20)


@query(f"""WITH {EV}, w AS (SELECT case_id, s // 168 AS week, list_distinct(list(channel)) AS have FROM ev GROUP BY ALL),
n AS (SELECT * FROM (VALUES ('buyer', ['view', 'click', 'purchase']), ('failed', ['click', 'error']), ('joiner', ['signup', 'view', 'click', 'purchase'])) t(node, need)),
z AS (SELECT case_id, week, node, len(list_intersect(have, need)) / len(need) AS score FROM w CROSS JOIN n)
SELECT node, case_id, week, score FROM z WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, case_id, week) <= 25""")
def join15_program_search(spark, sf_dir):
    nodes = [("buyer", ["view", "click", "purchase"]), ("failed", ["click", "error"]), ("joiner", ["signup", "view", "click", "purchase"])]
    windows = spans(spark, sf_dir).groupBy("case_id", F.floor(F.col("s") / 168).alias("week")).agg(F.collect_set("channel").alias("have"))
    # The programs are a literal list, so that each window is scored where it lies.
    programs = F.array(*[F.struct(F.lit(n).alias("node"), F.array(*map(F.lit, need)).alias("need")) for n, need in nodes])
    scored = windows.select("case_id", "week", "have", F.inline(programs)).withColumn("score", F.size(F.array_intersect("have", "need")) / F.size("need"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "case_id", "week"))
    return scored.where("score >= 0.5").withColumn("n", rank).where("n <= 25").select("node", "case_id", "week", "score")


@query(f"""{WITH}, c AS (SELECT l_id AS action_id, r_id AS event_id, CASE WHEN r_ch = 'click' THEN 'source' ELSE 'covered_context' END AS link FROM p WHERE l_ch = 'purchase' AND ov > 0 AND r_ch <> 'purchase')
SELECT event_id, link, count(*) AS actions, min(action_id) AS first_action FROM c GROUP BY ALL""")
def join16_event_action_links(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev.where("channel = 'purchase'"), ev.where("channel != 'purchase'"), 0)
    covered = pairs.groupBy(F.col("l_event_id").alias("action_id")).agg(F.collect_list(F.struct("r_event_id", "r_channel")).alias("covered"))
    links = covered.select("action_id", F.inline("covered")).withColumn("link", F.when(F.col("r_channel") == "click", "source").otherwise("covered_context"))
    return links.groupBy(F.col("r_event_id").alias("event_id"), "link").agg(F.count("*").alias("actions"), F.min("action_id").alias("first_action"))


@query("""SELECT n_name AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) ON k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k2, count(*) AS s FROM supplier GROUP BY 1) ON k2 = n_nationkey""")
def join18_group_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    joined = nation.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(F.col("n_name").alias("nation"), F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("""WITH d AS (SELECT doc_id, n_chars FROM documents), l AS (SELECT doc_id, quality FROM labels)
SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both_sides, count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only,
count(*) FILTER (quality = 1 AND n_chars < 100) AS mismatched FROM d FULL JOIN l ON d.doc_id = l.doc_id""")
def join19_alignment_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality")
    return d.join(labels, F.col("d") == F.col("l"), "full_outer").agg(
        F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("both_sides"), F.count_if(F.col("l").isNull()).alias("left_only"),
        F.count_if(F.col("d").isNull()).alias("right_only"), F.count_if((F.col("quality") == 1) & (F.col("n_chars") < 100)).alias("mismatched"),
    )


@query(f"""{WITH}, z AS (SELECT l_id, min(rs) FILTER (r_ch = 'click') AS down, min(rs) FILTER (r_ch = 'purchase') AS up FROM p WHERE l_ch = 'view' AND r_ch IN ('click', 'purchase') AND apart <= 8 GROUP BY l_id)
SELECT l_id AS hold_id, CASE WHEN down IS NULL THEN 'up_only' WHEN up IS NULL THEN 'down_only' WHEN down <= up THEN 'down_then_up' ELSE 'up_then_down' END AS phase FROM z
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l_id = z.l_id AND r_ch = 'error' AND rv >= 100 AND apart <= 2)""")
def join21_ordered_phases(spark, sf_dir):
    ev = spans(spark, sf_dir)
    hold = ev.where("channel = 'view'")
    pairs = S.near_pairs(hold, ev.where("channel IN ('click', 'purchase')"), 8)
    first = pairs.groupBy(F.col("l_event_id").alias("hold_id")).agg(*[F.min(F.when(F.col("r_channel") == c, F.col("r_s"))).alias(a) for a, c in (("down", "click"), ("up", "purchase"))])
    strong = S.near_pairs(hold, ev.where("channel = 'error' AND value >= 100"), 2).select(F.col("l_event_id").alias("hold_id")).distinct()
    phase = F.when(F.col("down").isNull(), "up_only").when(F.col("up").isNull(), "down_only").when(F.col("down") <= F.col("up"), "down_then_up").otherwise("up_then_down")
    return first.join(strong, "hold_id", "left_anti").select("hold_id", phase.alias("phase"))


@query("""SELECT d.doc_id, coalesce(quality, -1) AS quality, l.doc_id IS NULL AS unmatched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT l.doc_id, l.quality, true FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents)""")
def join22_note_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    matched = d.join(labels.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("hit").isNull().alias("unmatched"))
    orphans = labels.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality", F.lit(True).alias("unmatched"))
    return matched.unionByName(orphans)


@query(f"""WITH {CAP}, decided AS (SELECT source AS node, CASE WHEN avg(n_chars) > 2500 THEN 'long' ELSE 'short' END AS root FROM documents GROUP BY 1)
SELECT node AS child, root AS parent, 'root' AS edge FROM decided UNION ALL SELECT CAST(case_id AS VARCHAR), node, 'member' FROM cap JOIN decided USING (node)""")
def join23_decision_overlay(spark, sf_dir):
    decided = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("node")).agg(F.when(F.avg("n_chars") > 2500, "long").otherwise("short").alias("root"))
    roots = decided.select(F.col("node").alias("child"), F.col("root").alias("parent"), F.lit("root").alias("edge"))
    members = captions(spark, sf_dir).join(decided, "node")
    return roots.unionByName(members.select(F.col("case_id").cast("string").alias("child"), F.col("node").alias("parent"), F.lit("member").alias("edge")))
