"""Merges, packets, itemsets, closure, phases, coverage and the decision cascades over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aliases as A
from ..operators import assembly as B
from ..operators import decisions as D
from ..operators import leaders
from ..operators import merging as P
from ..operators import metrics as M
from ..operators import mining as X
from ..operators import sequences as Q
from ..operators import spans as S
from ..registry import query
from ..sources.adapters import BASKET, EV, FR, baskets, frames, spans, table
from ..sources.store import stored
from .joins import NAMES, REL, WITH

SEQ = f"{FR}, q0 AS (SELECT case_id, '<' || string_agg(sym, '><' ORDER BY frame) || '>' AS seq FROM fr GROUP BY 1)"


def learned(steps: int, order: str = "n DESC, cases DESC", least: int = 2, cases: int = 1) -> str:
    """The CTEs q1..qN and b1..bN of the first merges."""
    out = ""
    for k in range(1, steps + 1):
        out += f""", t{k} AS (SELECT case_id, string_split(trim(seq, '<>'), '><') AS t FROM q{k - 1}), u{k} AS (SELECT case_id, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM t{k} WHERE len(t) > 1),
b{k} AS (SELECT a, b, count(*) AS n, count(DISTINCT case_id) AS cases FROM u{k} GROUP BY ALL HAVING count(*) >= {least} AND count(DISTINCT case_id) >= {cases} ORDER BY {order}, a DESC, b DESC LIMIT 1),
q{k} AS (SELECT case_id, replace(seq, '<' || a || '><' || b || '>', '<' || a || '+' || b || '>') AS seq FROM q{k - 1}, b{k})"""
    return out


@query(f"WITH {SEQ}{learned(4)} " + " UNION ALL ".join(f"SELECT {k} AS step, a, b, n, cases FROM b{k}" for k in range(1, 5)))
def mine01_learn_merges(spark, sf_dir):
    merges, _ = Q.learn_merges(Q.sequences(frames(spark, sf_dir)), 4)
    return spark.createDataFrame([(m.step, m.a, m.b, m.n, m.cases) for m in merges], "step int, a string, b string, n long, cases long")


@query(f"WITH {SEQ}{learned(3, 'cases DESC, n DESC', 5, 3)} " + " UNION ALL ".join(f"SELECT {k} AS step, a, b, n, cases FROM b{k}" for k in range(1, 4)))
def mine01_learn_merges_by_support(spark, sf_dir):
    merges, _ = Q.learn_merges(Q.sequences(frames(spark, sf_dir)), 3, 5, least_cases=3, by_support=True)
    return spark.createDataFrame([(m.step, m.a, m.b, m.n, m.cases) for m in merges], "step int, a string, b string, n long, cases long")


@query(f"WITH {SEQ}{learned(8, least=3)} " + " UNION ALL ".join(f"SELECT {k} AS step, a, b, n, cases FROM b{k}" for k in range(1, 9)))
def mine01_indexed_merges(spark, sf_dir):
    """Eight merges by an index from pairs to blocks of sequences: each step reads the blocks that hold its pair."""
    merges, _ = P.learn_merges(Q.sequences(frames(spark, sf_dir)), 8, 3, blocks=32)
    return spark.createDataFrame([(m.step, m.a, m.b, m.n, m.cases) for m in merges], "step int, a string, b string, n long, cases long")


@query(f"WITH {SEQ} SELECT case_id, replace(seq, '<view><click>', '<view+click>') AS pair, replace(seq, '<error><error>', '<error+error>') AS twin FROM q0")
def mine02_replace_pair(spark, sf_dir):
    seq = F.col("seq")
    return Q.sequences(frames(spark, sf_dir)).select("case_id", Q.replace_pair(seq, "view", "click").alias("pair"), Q.replace_pair(seq, "error", "error").alias("twin"))


@query(f"WITH {SEQ}{learned(3)} SELECT case_id, seq, len(string_split(trim(seq, '<>'), '><')) AS tokens FROM q3")
def mine03_merge_replay(spark, sf_dir):
    own = Q.sequences(frames(spark, sf_dir))
    merges, _ = Q.learn_merges(own, 3)
    return Q.replay(own, [(m.a, m.b) for m in merges]).select("case_id", "seq", F.size(Q.tokens(F.col("seq"))).cast("long").alias("tokens"))


@query("SELECT p_partkey, p_size AS total, greatest(1, CAST(floor(0.75 * p_size + 0.5) AS BIGINT)) AS channel, p_size - greatest(1, CAST(floor(0.75 * p_size + 0.5) AS BIGINT)) AS coordination FROM part")
def mine04_two_stage_budget(spark, sf_dir):
    channel, coordination = Q.stage_budget(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("total"), channel.alias("channel"), coordination.alias("coordination"))


PACK = """lk AS (SELECT l_id AS a, r_id AS b FROM rel WHERE relation = 'parallel' UNION SELECT r_id, l_id FROM rel WHERE relation = 'parallel'),
rc AS (SELECT DISTINCT a AS node, a AS reach FROM lk UNION SELECT node, b FROM rc JOIN lk ON reach = a), pk AS (SELECT node, min(reach) AS packet FROM rc GROUP BY 1)"""


def packets(spark, sf_dir):
    """(node, component): events joined by parallel relations."""
    rel = S.relations(spans(spark, sf_dir)).where("relation = 'parallel'")
    return X.components(rel.select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b")))


@query(f"{REL.replace('WITH', 'WITH RECURSIVE', 1)}, {PACK} SELECT node AS event_id, packet FROM pk")
def mine05_overlap_packets(spark, sf_dir):
    return packets(spark, sf_dir).select(F.col("node").alias("event_id"), F.col("component").alias("packet"))


COACT = """lk AS (SELECT l_id AS a, r_id AS b FROM p WHERE l_ch <> r_ch AND ov / md >= 0.3), rc AS (SELECT DISTINCT a AS node, a AS reach FROM lk UNION SELECT node, b FROM rc JOIN lk ON reach = a), pk AS (SELECT node, min(reach) AS packet FROM rc GROUP BY 1)"""


@query(f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {COACT} SELECT packet, count(*) AS members, string_agg(DISTINCT channel, '+' ORDER BY channel) AS symbol, min(s) AS s, max(e) AS e FROM pk JOIN ev ON event_id = node GROUP BY 1 HAVING count(DISTINCT channel) >= 2""")
def mine06_coactivation_components(spark, sf_dir):
    """Components of events of different channels that overlap by a share of their own, here 0.3 of the shorter."""
    return X.coactivations(spans(spark, sf_dir), 0.3)


ANCHOR = f"""{WITH}, bp AS (SELECT case_id, l_id, ls, le, r_ch, r_id FROM p WHERE l_ch = 'purchase' AND r_ch <> 'purchase' AND ov > 0 QUALIFY row_number() OVER (PARTITION BY l_id, r_ch ORDER BY ov / md DESC, r_id) = 1),
ap AS (SELECT case_id, l_id AS anchor, min(ls) AS s, string_agg(r_id, ',' ORDER BY r_id) AS members, string_agg(r_ch, '+' ORDER BY r_ch) AS symbol FROM bp GROUP BY ALL),
ax AS (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY case_id, members ORDER BY anchor) = 1)"""


def anchored(spark, sf_dir):
    """(case_id, anchor, s, members, symbol): purchases with their best partner of each other channel, one for each set of partners."""
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev.where("channel = 'purchase'"), ev.where("channel != 'purchase'"), 0).withColumn("ratio", S.ratio(*NAMES))
    best = S.best_match(pairs, ["l_event_id", "r_channel"], [F.desc("ratio"), F.asc("r_event_id")])
    lists = best.groupBy("case_id", F.col("l_event_id").alias("anchor")).agg(
        F.min("l_s").alias("s"), F.array_join(F.array_sort(F.collect_list("r_event_id")), ",").alias("members"), F.array_join(F.array_sort(F.collect_list("r_channel")), "+").alias("symbol")
    )
    return M.top(lists, 1, ["case_id", "members"], F.asc("anchor"))


@query(f"{ANCHOR} SELECT case_id, anchor, s, members, symbol FROM ax")
def mine07_anchored_packets(spark, sf_dir):
    return anchored(spark, sf_dir)


ROLES = {"purchase": 3, "error": 2, "click": 1}
_ROLES = "CASE l_ch " + "".join(f"WHEN '{c}' THEN {n} " for c, n in ROLES.items()) + "END"


@query(f"""{WITH}, bp AS (SELECT case_id, l_id, ls, le, rs, re, {_ROLES} AS role, l_ch, r_ch, r_id FROM p WHERE {_ROLES} IS NOT NULL AND l_ch <> r_ch AND ov / md >= 0.4 QUALIFY row_number() OVER (PARTITION BY l_id, r_ch ORDER BY ov / md DESC, r_id) = 1),
ap AS (SELECT case_id, l_id AS anchor, role, min(ls) AS began, least(min(ls), min(rs)) AS s, greatest(max(le), max(re)) AS e, array_to_string(list_sort(list_append(list(r_ch), l_ch)), '+') AS symbol, array_to_string(list_sort(list_append(list(r_id), l_id)), ',') AS members FROM bp GROUP BY case_id, l_id, role, l_ch)
SELECT case_id, anchor, CAST(role AS INT) AS role, s, e, symbol, members FROM ap QUALIFY row_number() OVER (PARTITION BY case_id, symbol, s // 8, e // 8 ORDER BY role DESC, began, anchor) = 1""")
def mine07_ranked_anchors(spark, sf_dir):
    """Packets around anchors of several roles; of packets of one symbol and place that of the highest role stays."""
    return X.anchored_packets(spans(spark, sf_dir), ROLES, 0.4, 8)


@query(f"{ANCHOR}, c AS (SELECT symbol, count(*) AS n, count(DISTINCT case_id) AS cases FROM ax GROUP BY 1 ORDER BY cases DESC, n DESC, symbol LIMIT 6) SELECT anchor, coalesce('COORD[' || c.symbol || ']', 'rest') AS label FROM ax LEFT JOIN c USING (symbol)")
def mine08_coordination_selection(spark, sf_dir):
    own = anchored(spark, sf_dir)
    chosen = D.select_coordination(M.support(own, "symbol"), 6).select("symbol", F.concat(F.lit("COORD["), "symbol", F.lit("]")).alias("label"))
    return own.join(F.broadcast(chosen), "symbol", "left").select("anchor", F.coalesce("label", F.lit("rest")).alias("label"))  # six rows


@query(f"""{ANCHOR}, {SEQ}{learned(3)}, c AS (SELECT symbol, count(*) AS n, count(DISTINCT case_id) AS cases FROM ax GROUP BY 1 HAVING count(*) >= 2 ORDER BY cases DESC, n DESC, symbol LIMIT 1)
SELECT 'coordination' AS stage, 1 AS rank, symbol AS motif, n, cases FROM c """ + "".join(f"UNION ALL SELECT 'channel', {k}, a || '+' || b, n, cases FROM b{k} " for k in (1, 2, 3)))
def mine08_two_stage_motifs(spark, sf_dir):
    """From events to motifs: sequences and anchored packets share one budget of four motifs."""
    return Q.two_stage_motifs(Q.sequences(frames(spark, sf_dir)), anchored(spark, sf_dir), 4)


LEXICON = [("view", "click", "purchase"), ("view", "click"), ("error", "error"), ("click", "purchase")]


@query(f"WITH {SEQ}, m AS (SELECT case_id, replace(replace(regexp_replace(seq, '(<view><click><purchase>|<click><purchase>|<error><error>|<view><click>)', '{{\\1}}', 'g'), '{{<', '{{'), '>}}', '}}') AS s FROM q0), r AS (SELECT case_id, list_transform(regexp_extract_all(s, '\\{{[^}}]*\\}}|<[^>]*>'), lambda x: '<' || replace(trim(x, '{{}}<>'), '><', '+') || '>') AS l FROM m) SELECT case_id, array_to_string(l, '') AS seq FROM r".replace("\\\\", "\\"))
def mine09_longest_match(spark, sf_dir):
    return Q.sequences(frames(spark, sf_dir)).select("case_id", Q.longest_match(F.col("seq"), LEXICON).alias("seq"))


TX = f"""WITH {BASKET}, w AS (SELECT item, count(*) AS seen FROM basket GROUP BY 1), tx AS (SELECT b.tx, b.case_id, b.item FROM basket b JOIN w USING (item) QUALIFY row_number() OVER (PARTITION BY b.tx ORDER BY seen, item) <= 8),
t2 AS (SELECT tx FROM tx GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT tx.* FROM tx JOIN t2 USING (tx))"""


def transactions(spark, sf_dir):
    """(tx, case_id, item): the 8 rarest items of each order of two items at least.

    The counts are written, so that their size is known: baskets stay dealt by order
    and are not sent to one task an item.
    """
    b = baskets(spark, sf_dir)
    own = b.join(stored(b.groupBy("item").agg(F.count("*").alias("seen")), "items"), "item")
    kept = M.top(own, 8, ["tx"], F.asc("seen"), F.asc("item"))
    return kept.withColumn("size", F.count("*").over(Window.partitionBy("tx"))).where("size >= 2").select("tx", "case_id", "item")


@query(f"{TX} SELECT tx, count(*) AS n, string_agg(item, '+' ORDER BY item) AS items FROM k GROUP BY 1")
def mine10_transactions(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy("tx").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item")), "+").alias("items"))


SETS = f"""{TX}, s2 AS (SELECT a.item AS i1, b.item AS i2, NULL AS i3, count(*) AS n, count(DISTINCT a.case_id) AS cases FROM k a JOIN k b ON a.tx = b.tx AND a.item < b.item GROUP BY ALL HAVING count(*) >= 30),
s3 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS n, count(DISTINCT a.case_id) AS cases FROM k a JOIN k b ON a.tx = b.tx AND a.item < b.item JOIN k c ON c.tx = a.tx AND b.item < c.item GROUP BY ALL HAVING count(*) >= 30),
st AS (SELECT concat_ws('+', i1, i2, i3) AS items, n, cases FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3))"""


@query(f"{SETS} SELECT items, n FROM st")
def mine11_frequent_itemsets(spark, sf_dir):
    return X.itemsets(transactions(spark, sf_dir), 3, 30).select(F.array_join("items", "+").alias("items"), "n")


@query(f"{SETS} SELECT items, cases FROM st")
def mine12_itemset_case_support(spark, sf_dir):
    return X.itemsets(transactions(spark, sf_dir), 3, 30).select(F.array_join("items", "+").alias("items"), "cases")


@query("""WITH k AS (SELECT DISTINCT o_custkey AS case_id, l_orderkey AS tx, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey),
s2 AS (SELECT [a.item, b.item] AS l, count(*) AS n, count(DISTINCT a.case_id) AS cases FROM k a JOIN k b ON a.tx = b.tx AND a.item < b.item GROUP BY ALL),
s3 AS (SELECT [a.item, b.item, c.item] AS l, count(*) AS n, count(DISTINCT a.case_id) AS cases FROM k a JOIN k b ON a.tx = b.tx AND a.item < b.item JOIN k c ON c.tx = a.tx AND b.item < c.item GROUP BY ALL),
s AS (SELECT * FROM s2 WHERE n >= 30 UNION ALL SELECT * FROM s3 WHERE n >= 30)
SELECT array_to_string(l, '+') AS items, cases FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE len(b.l) > len(s.l) AND list_has_all(b.l, s.l) AND b.cases >= ceil(s.cases * CAST(0.6 AS DOUBLE)))""")
def mine13_closed_itemsets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    tx = lines.select(F.col("l_orderkey").alias("tx"), F.col("o_custkey").alias("case_id"), F.col("p_type").alias("item")).distinct()
    sets = X.itemsets(tx, 3, 30)
    return X.closed(sets, 0.4).select(F.array_join("items", "+").alias("items"), "cases")


@query()
def mine14_leader_clustering(spark, sf_dir):
    motifs = M.support(anchored(spark, sf_dir).select("case_id", "symbol"), "symbol").withColumn("items", F.split("symbol", r"\+"))
    return leaders.leader_families(motifs, 0.6)


@query()
def mine15_precision_cover(spark, sf_dir):
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    hits = docs.select(F.explode(words).alias("symbol"), F.col("doc_id").alias("case_id")).where(F.length("symbol") >= 4)
    truth = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("case_id"))
    taken = X.greedy_cover(hits, truth, 0.8, 5)
    return spark.createDataFrame([(k, *t) for k, t in enumerate(taken, 1)], "step int, symbol string, gained long, precision double")


@query()
def mine16_event_abstraction(spark, sf_dir):
    return X.abstracted(spans(spark, sf_dir))


PHASE = f"""{WITH}, cl AS (SELECT case_id, count(DISTINCT l_ch || r_ch) FILTER (apart <= 6) AS links, bool_or(l_ch = 'click' AND r_ch = 'view' AND apart <= 6) AS cv, bool_or(l_ch = 'click' AND r_ch = 'purchase' AND apart <= 6) AS cp, bool_or(l_ch = 'view' AND r_ch = 'purchase' AND apart <= 6) AS vp
FROM p WHERE l_ch <> r_ch AND (l_ch, r_ch) IN (('click', 'view'), ('click', 'purchase'), ('view', 'purchase')) GROUP BY 1),
ph AS (SELECT case_id, CASE WHEN cv AND cp AND vp THEN 'phase_closed_all_pairs' WHEN CAST(cv AS INT) + CAST(cp AS INT) + CAST(vp AS INT) = 2 THEN 'phase_chain' WHEN cv OR cp OR vp THEN 'partial' ELSE 'case_level_only' END AS status FROM cl)"""


def phase_status(spark, sf_dir):
    """(case_id, status) of the three groups click, view and purchase."""
    return D.phase_closure(spans(spark, sf_dir), ["click", "view", "purchase"], 6).select("case_id", "status")


@query(f"{PHASE} SELECT status, count(*) AS cases FROM ph GROUP BY 1")
def mine17_phase_closure(spark, sf_dir):
    return phase_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("cases"))


AXIS = f"""WITH {EV}, h AS (SELECT case_id, s // 72 AS w, list(DISTINCT channel) AS have, count(*) FILTER (channel = 'error' AND value > 150) AS blocks FROM ev GROUP BY ALL),
sc AS (SELECT case_id, w, have, blocks, CAST(CASE WHEN list_contains(have, 'view') THEN 0.3 ELSE 0 END + CASE WHEN list_contains(have, 'click') THEN 0.3 ELSE 0 END + CASE WHEN list_contains(have, 'purchase') THEN 0.4 ELSE 0 END - CASE WHEN list_contains(have, 'error') THEN 0.2 ELSE 0 END AS DOUBLE) AS score FROM h),
ax AS (SELECT case_id, w, round(score, 6) AS score, CASE WHEN blocks > 0 THEN 'blocked' WHEN NOT list_contains(have, 'view') THEN 'missing_group' WHEN round(score, 6) >= 0.5 THEN 'accepted' ELSE 'below_min' END AS verdict FROM sc)"""


def axis_scores(spark, sf_dir):
    """(case_id, w, score, verdict): windows of three days scored by an axis of weighted groups, a penalty and a hard block."""
    h = D.windows(spans(spark, sf_dir), 72, (F.col("channel") == "error") & (F.col("value") > 150))
    return D.split_axis(h, {"view": 0.3, "click": 0.3, "purchase": 0.4, "error": -0.2}, ["view"], 0.5)


@query(f"{AXIS} SELECT * FROM ax")
def mine18_split_axis(spark, sf_dir):
    return axis_scores(spark, sf_dir)


COVER = f"""WITH {EV}, w AS (SELECT case_id, s // 72 AS w, list_sort(list(DISTINCT channel)) AS have FROM ev GROUP BY ALL), b AS (SELECT case_id, max(len(have)) AS best, bool_or(list_has_all(have, ['view', 'click', 'purchase'])) AS full_window FROM w GROUP BY 1),
c AS (SELECT case_id, count(DISTINCT channel) AS whole, list_has_all(list(DISTINCT channel), ['view', 'click', 'purchase']) AS full_case FROM ev GROUP BY 1),
cv AS (SELECT case_id, whole, best, full_case, full_window FROM b JOIN c USING (case_id))"""


def coverage(spark, sf_dir):
    """(case_id, whole, best, full_case, full_window): channels of a case against those of its best window."""
    return D.window_coverage(D.windows(spans(spark, sf_dir), 72), ["view", "click", "purchase"])


@query(f"{COVER} SELECT * FROM cv")
def mine19_case_window_coverage(spark, sf_dir):
    return coverage(spark, sf_dir)


@query(f"{AXIS}, {COVER[5:].replace(EV + ', ', '')}, {PHASE[5:].replace(EV + ', ', '')} SELECT 'split' AS mode, verdict AS key, count(*) AS n FROM ax GROUP BY ALL UNION ALL SELECT 'coverage', CAST(full_window AS VARCHAR), count(*) FROM cv GROUP BY ALL UNION ALL SELECT 'phase', status, count(*) FROM ph GROUP BY ALL")
def mine20_axis_bundle(spark, sf_dir):
    parts = [("split", axis_scores(spark, sf_dir), "verdict"), ("coverage", coverage(spark, sf_dir), "full_window"), ("phase", phase_status(spark, sf_dir), "status")]
    rows = [df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "key", "n") for mode, df, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""{WITH}, nn AS (SELECT l_id, r_ch, ov, apart FROM p WHERE l_ch = 'signup' AND r_ch <> 'signup' AND apart <= 24 QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY ov / md DESC, apart, r_id) = 1)
SELECT event_id, CASE WHEN value < 2 THEN 'noise' WHEN r_ch IS NULL THEN 'isolated' WHEN r_ch = 'error' THEN 'context_error' WHEN ov > 0 THEN 'covered_by_' || r_ch ELSE 'near_' || r_ch END AS disposition FROM ev LEFT JOIN nn ON l_id = event_id WHERE channel = 'signup'""")
def mine21_unmapped_policy(spark, sf_dir):
    ev = spans(spark, sf_dir)
    own = ev.where("channel = 'signup'")
    pairs = S.near_pairs(own, ev.where("channel != 'signup'"), 24).withColumn("ov", S.overlap(*NAMES)).withColumn("ratio", S.ratio(*NAMES)).withColumn("gap", S.gap(*NAMES, between=False))
    best = S.best_match(pairs, ["l_event_id"], [F.desc("ratio"), F.asc("gap"), F.asc("r_event_id")]).select(F.col("l_event_id").alias("event_id"), F.col("r_channel").alias("near"), "ov")
    near = F.col("near")
    what = F.when(F.col("value") < 2, "noise").when(near.isNull(), "isolated").when(near == "error", "context_error").when(F.col("ov") > 0, F.concat(F.lit("covered_by_"), near)).otherwise(F.concat(F.lit("near_"), near))
    return own.join(best, "event_id", "left").select("event_id", what.alias("disposition"))


@query("""WITH c AS (SELECT p_name AS cluster, p_type AS family, count(*) AS n FROM part WHERE p_size > 30 GROUP BY ALL), k AS (SELECT cluster, count(*) AS families, max(n) / sum(n) AS share FROM c GROUP BY 1)
SELECT cluster, CASE WHEN families = 1 THEN 'stable' WHEN share >= 0.5 THEN 'dominant' ELSE 'one_to_many' END AS mapping FROM k UNION ALL SELECT DISTINCT p_name, 'unmapped' FROM part WHERE p_name NOT IN (SELECT cluster FROM k)""")
def mine22_mapping_audit(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = part.where("p_size > 30").groupBy(F.col("p_name").alias("cluster"), "p_type").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.count("*").alias("families"), (F.max("n") / F.sum("n")).alias("share"))
    mapped = k.select("cluster", F.when(F.col("families") == 1, "stable").when(F.col("share") >= 0.5, "dominant").otherwise("one_to_many").alias("mapping"))
    rest = part.select(F.col("p_name").alias("cluster")).distinct().join(mapped, "cluster", "left_anti").withColumn("mapping", F.lit("unmapped"))
    return mapped.unionByName(rest)


@query(f"""{WITH}, n AS (SELECT l_id, bool_or(r_ch = 'click' AND apart <= 4) AS arms, bool_or(r_ch = 'view' AND apart <= 8) AS loco, bool_or(r_ch = 'error' AND re <= ls AND apart <= 12) AS prep FROM p WHERE l_ch = 'purchase' GROUP BY 1)
SELECT l_id AS event_id, concat_ws('+', 'vertical', CASE WHEN arms THEN 'arms' END, CASE WHEN loco THEN 'loco' END, CASE WHEN prep THEN 'prep' END) AS pattern FROM n WHERE arms OR loco OR prep""")
def mine23_coordination_patterns(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev.where("channel = 'purchase'"), ev, 12).where("l_event_id != r_event_id").withColumn("gap", S.gap(*NAMES, between=False))
    c = F.col("r_channel")
    n = pairs.groupBy(F.col("l_event_id").alias("event_id")).agg(
        F.bool_or((c == "click") & (F.col("gap") <= 4)).alias("arms"), F.bool_or((c == "view") & (F.col("gap") <= 8)).alias("loco"), F.bool_or((c == "error") & (F.col("r_e") <= F.col("l_s"))).alias("prep")
    )
    return n.where("arms OR loco OR prep").select("event_id", F.concat_ws("+", F.lit("vertical"), *[F.when(F.col(x), x) for x in ("arms", "loco", "prep")]).alias("pattern"))


@query(f"""WITH {EV} SELECT case_id, max_by(channel, (value, event_id)) AS strongest, count(*) FILTER (channel = 'error') AS errors, count(DISTINCT channel) AS breadth, max(e) - min(s) + 1 AS extent, CAST(sum(e - s + 1) AS BIGINT) AS load, CASE WHEN avg(value) > 50 THEN 'high' ELSE 'low' END AS level,
min_by(channel, (s, event_id)) AS opens FROM ev GROUP BY 1""")
def mine24_signature_axes(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("case_id").agg(
        F.max_by("channel", F.struct("value", "event_id")).alias("strongest"), F.count_if(F.col("channel") == "error").alias("errors"), F.countDistinct("channel").alias("breadth"),
        (F.max("e") - F.min("s") + 1).alias("extent"), F.sum(F.col("e") - F.col("s") + 1).alias("load"), F.when(F.avg("value") > 50, "high").otherwise("low").alias("level"), F.min_by("channel", F.struct("s", "event_id")).alias("opens"),
    )


@query(f"""{WITH}, a AS (SELECT l_id, r_id FROM p WHERE l_ch = 'purchase' AND r_ch IN ('click', 'view') AND apart <= 2), o AS (SELECT r_id AS event_id, min(l_id) AS action FROM a GROUP BY 1)
SELECT event_id, CASE WHEN channel = 'purchase' THEN event_id ELSE action END AS action, CASE WHEN channel = 'purchase' THEN 'anchor' WHEN action IS NOT NULL THEN 'covered' WHEN channel = 'error' THEN 'fallback' ELSE 'residual' END AS role FROM ev LEFT JOIN o USING (event_id)""")
def mine25_action_assembly(spark, sf_dir):
    """Each purchase covers the clicks and views near it, the smallest id first; errors not covered become fallbacks."""
    ev = spans(spark, sf_dir)
    near = S.near_pairs(ev.where("channel = 'purchase'"), ev.where("channel IN ('click', 'view')"), 2)
    covered = near.groupBy(F.col("r_event_id").alias("event_id")).agg(F.min("l_event_id").alias("action"))
    anchor = F.col("channel") == "purchase"
    role = F.when(anchor, "anchor").when(F.col("action").isNotNull(), "covered").when(F.col("channel") == "error", "fallback").otherwise("residual")
    return ev.join(covered, "event_id", "left").select("event_id", F.when(anchor, F.col("event_id")).otherwise(F.col("action")).alias("action"), role.alias("role"))


STAGES = [
    [B.Emitter("order", ("purchase",), 20.0, needs=(B.Near(("click", "view"), most_gap=6),), unless=(B.Near(("error",), 0.5),), covers=(B.Near(("click", "view"), 0.3, 4),))],
    [B.Emitter("trouble", ("error",), 30.0, covers=(B.Near(("error", "view"), 0.5, 1),)), B.Emitter("tour", ("view",), 60.0, covers=(B.Near((), 0.6),)), B.Emitter("look", ("view", "click"), 5.0, 60.0, covers=(B.Near(("signup",), most_gap=2),))],
    [B.Emitter("rest", (), 2.0, fallback=True, covers=(B.Near(most_gap=0),))],
]
HIDES = {"order": ("look", "rest"), "trouble": ("tour",)}


@query()
def mine25_ordered_emitters(spark, sf_dir):
    """Events as actions by three stages of emitters, and those left over."""
    ev = spans(spark, sf_dir)
    actions = stored(B.assembled(ev, STAGES, HIDES), "actions")
    rows = actions.select("event_id", "action", "hidden_by", F.array_join(F.transform("covered", lambda x: x.cast("string")), ",").alias("covered"))
    return rows.unionByName(B.residual(ev, actions).select("event_id", F.lit("residual").alias("action"), F.lit(None).cast("string").alias("hidden_by"), F.lit("").alias("covered")))


STATS = f"""WITH {BASKET}, st AS (SELECT item, count(*) AS n, count(DISTINCT case_id) AS cases, max(k) / sum(k) AS purity FROM (SELECT item, case_id, count(*) AS k FROM basket GROUP BY ALL) GROUP BY 1)"""


def item_stats(spark, sf_dir):
    """(item, n, cases, purity): how many customers buy a brand and how much of it goes to one."""
    k = baskets(spark, sf_dir, "case_id").groupBy("item", "case_id").agg(F.count("*").alias("k"))
    return k.groupBy("item").agg(F.count("*").alias("n"), F.count("case_id").alias("cases"), (F.max("k") / F.sum("k")).alias("purity"))


@query(f"{STATS} SELECT item, CASE WHEN cases < 50 THEN 'insufficient' WHEN purity >= 0.02 THEN 'review_skew' WHEN cases >= 100 THEN 'promote' ELSE 'hold' END AS status FROM st")
def mine26_promotion_status(spark, sf_dir):
    status = F.when(F.col("cases") < 50, "insufficient").when(F.col("purity") >= 0.02, "review_skew").when(F.col("cases") >= 100, "promote").otherwise("hold")
    return item_stats(spark, sf_dir).select("item", status.alias("status"))


@query("""WITH t AS (SELECT source, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 1 AND regexp_matches(lower(text), 'idiot|stupid|scum|trash')) AS tp, count(*) FILTER (toxic = 0 AND regexp_matches(lower(text), 'idiot|stupid|scum|trash')) AS fp FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, CASE WHEN pos = 0 AND fp > 0 THEN 'only_false' WHEN pos = 0 THEN 'no_truth' WHEN tp = 0 THEN 'not_found' WHEN fp > tp THEN 'imprecise' WHEN tp = pos AND fp = 0 THEN 'exact' WHEN tp = pos THEN 'complete' WHEN 2 * tp >= pos THEN 'half_found' ELSE 'component_only' END AS diagnosis FROM t""")
def mine27_recall_diagnosis(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    hit = F.lower("text").rlike("idiot|stupid|scum|trash")
    t = docs.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if((F.col("toxic") == 1) & hit).alias("tp"), F.count_if((F.col("toxic") == 0) & hit).alias("fp"))
    pos, tp, fp = F.col("pos"), F.col("tp"), F.col("fp")
    out = F.when((pos == 0) & (fp > 0), "only_false").when(pos == 0, "no_truth").when(tp == 0, "not_found").when(fp > tp, "imprecise").when((tp == pos) & (fp == 0), "exact").when(tp == pos, "complete").when(2 * tp >= pos, "half_found").otherwise("component_only")
    return t.select("source", out.alias("diagnosis"))


@query("""WITH r AS (SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 15000 THEN 'long' END, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN lang = 'es' AND n_chars > 4000 THEN 'language' END) AS risks FROM documents)
SELECT doc_id, risks, CASE WHEN risks = '' THEN 'train' WHEN risks = 'language' OR risks = 'long' THEN 'review' ELSE 'defer' END AS verdict FROM r""")
def mine28_risk_filter(spark, sf_dir):
    n = F.col("n_chars")
    risks = F.array_compact(F.array(F.when(n < 200, "short"), F.when(n > 15000, "long"), F.when(F.col("text").contains("@"), "contact"), F.when((F.col("lang") == "es") & (n > 4000), "language")))
    r = table(spark, sf_dir, "documents").select("doc_id", F.array_join(risks, ",").alias("risks"))
    return r.withColumn("verdict", F.when(F.col("risks") == "", "train").when(F.col("risks").isin("language", "long"), "review").otherwise("defer"))


@query(f"{REL}, g AS (SELECT relation, CASE WHEN g = 0 THEN 'touching' WHEN g <= 2 THEN 'close' ELSE 'apart' END AS bucket, l_ch || '>' || r_ch AS cluster, count(*) AS n, count(DISTINCT case_id) AS cases FROM rel GROUP BY ALL) SELECT relation, bucket, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS n FROM g WHERE cases >= 10 GROUP BY ALL")
def mine29_group_induction(spark, sf_dir):
    bucket = F.when(F.col("gap") == 0, "touching").when(F.col("gap") <= 2, "close").otherwise("apart")
    g = S.relations(spans(spark, sf_dir)).groupBy("relation", bucket.alias("bucket"), F.concat_ws(">", "l_channel", "r_channel").alias("cluster")).agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))
    return g.where("cases >= 10").groupBy("relation", "bucket").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"))


@query()
def mine30_multi_edit_selection(spark, sf_dir):
    edits = spans(spark, sf_dir).select("case_id", F.col("channel").alias("attribute"), "s", "e", F.col("value").alias("score"), F.col("event_id").alias("id"))
    return X.compatible(edits, 12, 6)


@query(f"""WITH {EV}, r AS (SELECT case_id, channel, max(value) - min(value) AS range_v FROM ev GROUP BY ALL), m AS (SELECT case_id, max_by(channel, (range_v, channel)) AS top_ch, max(range_v) AS r, min(range_v) AS low FROM r GROUP BY 1)
SELECT case_id, CASE WHEN r > 200 THEN 'burst_' || top_ch WHEN r > 120 AND low < 40 THEN 'focused_' || top_ch WHEN r > 120 THEN 'broad' ELSE 'calm' END AS skill FROM m""")
def mine31_skill_cascade(spark, sf_dir):
    r = spans(spark, sf_dir).groupBy("case_id", "channel").agg((F.max("value") - F.min("value")).alias("range"))
    m = r.groupBy("case_id").agg(F.max_by("channel", F.struct("range", "channel")).alias("top"), F.max("range").alias("r"), F.min("range").alias("low"))
    skill = F.when(F.col("r") > 200, F.concat(F.lit("burst_"), "top")).when((F.col("r") > 120) & (F.col("low") < 40), F.concat(F.lit("focused_"), "top")).when(F.col("r") > 120, "broad").otherwise("calm")
    return m.select("case_id", skill.alias("skill"))


@query(f"""WITH {EV} SELECT event_id, round(0.01 * value * (e - s + 1) + CASE channel WHEN 'purchase' THEN 2.0 WHEN 'error' THEN 1.0 ELSE 0 END, 6) AS score FROM ev ORDER BY round(0.01 * value * (e - s + 1) + CASE channel WHEN 'purchase' THEN 2.0 WHEN 'error' THEN 1.0 ELSE 0 END, 6) DESC, event_id LIMIT 100""")
def mine32_salient_cases(spark, sf_dir):
    bonus = F.when(F.col("channel") == "purchase", 2.0).when(F.col("channel") == "error", 1.0).otherwise(0.0)
    scored = spans(spark, sf_dir).select("event_id", F.round(0.01 * F.col("value") * S.duration("s", "e") + bonus, 6).alias("score"))
    return M.top(scored, 100, [], F.desc("score"), F.asc("event_id"))


CAND = """WITH c AS (SELECT p_brand AS node, p_type AS bucket, p_name AS axis, count(*) AS support, max(p_size) AS relation FROM part GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY node, bucket ORDER BY relation DESC, support DESC, axis) AS in_bucket FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY node, in_bucket = 1 ORDER BY relation DESC, support DESC, axis, bucket) AS in_node FROM b)"""


@query(f"{CAND} SELECT node, bucket, axis, CASE WHEN in_bucket > 1 THEN 'worse_in_bucket' WHEN in_node > 3 THEN 'over_node_cap' ELSE 'selected' END AS reason, CASE WHEN support >= 2 THEN 'ready' ELSE 'thin' END AS readiness FROM k")
def mine34_axis_selection(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("node"), F.col("p_type").alias("bucket"), F.col("p_name").alias("axis")).agg(F.count("*").alias("support"), F.max("p_size").alias("relation"))
    order = [F.desc("relation"), F.desc("support"), F.asc("axis")]
    b = c.withColumn("in_bucket", F.row_number().over(Window.partitionBy("node", "bucket").orderBy(*order)))
    k = b.withColumn("first", F.col("in_bucket") == 1).withColumn("in_node", F.row_number().over(Window.partitionBy("node", "first").orderBy(*order, "bucket")))
    reason = F.when(F.col("in_bucket") > 1, "worse_in_bucket").when(F.col("in_node") > 3, "over_node_cap").otherwise("selected")
    return k.select("node", "bucket", "axis", reason.alias("reason"), F.when(F.col("support") >= 2, "ready").otherwise("thin").alias("readiness"))


@query("""WITH r AS (SELECT source, count(*) AS n, count(toxic) / count(*) AS hit, coalesce(avg(quality), 0) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, CASE WHEN n < 20 THEN 'too_few' WHEN hit < 0.2 THEN 'unnamed' WHEN mean >= 0.8 AND hit >= 0.4 THEN 'promote' WHEN mean >= 0.8 THEN 'promote_thin' WHEN mean >= 0.6 THEN 'review' WHEN hit >= 0.4 THEN 'split' ELSE 'hold' END AS outcome FROM r""")
def mine35_promotion_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = docs.groupBy("source").agg(F.count("*").alias("n"), (F.count("toxic") / F.count("*")).alias("hit"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mean"))
    n, hit, mean = F.col("n"), F.col("hit"), F.col("mean")
    out = F.when(n < 20, "too_few").when(hit < 0.2, "unnamed").when((mean >= 0.8) & (hit >= 0.4), "promote").when(mean >= 0.8, "promote_thin").when(mean >= 0.6, "review").when(hit >= 0.4, "split").otherwise("hold")
    return r.select("source", out.alias("outcome"))


ALIAS_MARKS = {"licence": "licen[sc]e", "mail": "@mail", "secret": "token =", "rude": "idiot|stupid|scum", "plain": "the |der |le |el "}
_MARKS = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{a}' END" for a, p in ALIAS_MARKS.items())


@query(f"""WITH n AS (SELECT source AS node, CASE WHEN avg(n_chars) > 4000 THEN 'accepted' WHEN avg(n_chars) > 1500 THEN 'component' ELSE 'pending' END AS status, CASE WHEN count(DISTINCT lang) > 1 THEN 'closure_required_candidate' ELSE 'generic' END AS level,
CASE WHEN min(doc_id) % 2 = 0 THEN ['plain'] ELSE ['licence', 'mail'] END AS targets FROM documents GROUP BY 1),
m AS (SELECT source AS node, doc_id, list_filter([{_MARKS}], lambda x: x IS NOT NULL) AS aliases, least(n_chars / 2000, 1.0) AS score FROM documents),
e AS (SELECT node, doc_id, bool_or(list_has_any(aliases, targets)) AS hit, bool_or(len(aliases) > 0) AS named, max(score) AS score FROM m JOIN n USING (node) GROUP BY ALL),
r AS (SELECT node, count(*) AS cases, avg(hit::INT) AS alias_hit_rate, avg((NOT named)::INT) AS no_alias_rate, avg(score) AS mean_score FROM e GROUP BY 1)
SELECT node, cases, round(alias_hit_rate, 6) AS alias_hit_rate, round(no_alias_rate, 6) AS no_alias_rate, round(mean_score, 6) AS mean_score, CASE {" ".join(f"WHEN {c} THEN '{n}'" for n, c in D.PROMOTION)} ELSE 'keep_pending' END AS outcome FROM r JOIN n USING (node)""")
def mine35_promotion_outcomes(spark, sf_dir):
    """Sources as nodes, their documents as cases, marks in the text as aliases."""
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.avg("n_chars") > 4000, "accepted").when(F.avg("n_chars") > 1500, "component").otherwise("pending")
    level = F.when(F.countDistinct("lang") > 1, "closure_required_candidate").otherwise("generic")
    targets = F.when(F.min("doc_id") % 2 == 0, F.array(F.lit("plain"))).otherwise(F.array(F.lit("licence"), F.lit("mail")))
    nodes = docs.groupBy(F.col("source").alias("node")).agg(status.alias("status"), level.alias("level"), targets.alias("targets"))
    marks = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), a) for a, p in ALIAS_MARKS.items()]))
    matches = docs.select(F.col("source").alias("node"), F.col("doc_id").alias("case_id"), marks.alias("aliases"), F.least(F.col("n_chars") / 2000, F.lit(1.0)).alias("score"))
    return D.promotion(nodes, matches).select("node", "cases", *[F.round(c, 6).alias(c) for c in ("alias_hit_rate", "no_alias_rate", "mean_score")], "outcome")


# What the sample's channels stand for, by size of the event: (channel, zone, role) of events over 50 and of the others.
BODY = {
    "click": (("left_arm", "upper", "arm_large_arc_or_orbit"), ("left_arm", "upper", "arm_reach_retract")),
    "view": (("right_arm", "upper", "hand_head_proximity"), ("right_arm", "upper", "arm_vertical_cycle")),
    "purchase": (("left_leg", "lower", "leg_lateral_cycle"), ("right_leg", "lower", "leg_step")),
    "signup": (("root", "vertical", "vertical_rhythm"), ("root", "posture", "body_level_low")),
    "error": (("body", "support", "floor_low_horizontal_support"), ("body", "inversion", "inverted_support")),
}
_BODY = " UNION ALL ".join(f"SELECT '{c}' AS channel, {size} AS big, '{b}' AS part, '{z}' AS zone, '{r}' AS role" for c, both in BODY.items() for size, (b, z, r) in zip(("true", "false"), both, strict=True))
SETS = f"""WITH {EV}, body AS ({_BODY}), st AS (SELECT case_id, s // 48 AS d, list_sort(list(DISTINCT part)) AS c, list_sort(list(DISTINCT zone)) AS z, list_sort(list(DISTINCT role)) AS r FROM ev JOIN body ON body.channel = ev.channel AND body.big = (ev.value > 50) GROUP BY ALL),
k AS (SELECT c, z, r, count(*) AS n, count(DISTINCT case_id) AS cases FROM st GROUP BY ALL)"""


def body_sets(spark, sf_dir):
    """(channels, zones, roles, n, cases): the sets of what a case does in two days."""
    ev = spans(spark, sf_dir)
    part = F.coalesce(*[F.when((F.col("channel") == c) & ((F.col("value") > 50) == size), F.struct(*[F.lit(x).alias(name) for name, x in zip(("part", "zone", "role"), own, strict=True)])) for c, both in BODY.items() for size, own in zip((True, False), both, strict=True)])
    each = lambda name: F.array_sort(F.collect_set(f"b.{name}"))
    sets = ev.select("case_id", F.expr("s div 48").alias("d"), part.alias("b")).where("b IS NOT NULL").groupBy("case_id", "d").agg(each("part").alias("channels"), each("zone").alias("zones"), each("role").alias("roles"))
    return sets.groupBy("channels", "zones", "roles").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query(f"""{SETS}, f AS (SELECT *, list_contains(z, 'upper') AS up, list_contains(z, 'lower') AS lo, list_contains(z, 'vertical') AS ve, list_contains(z, 'posture') AS po, list_contains(z, 'inversion') AS inv, list_contains(z, 'support') AS su,
list_contains(r, 'floor_low_horizontal_support') AS fl, list_contains(r, 'inverted_support') AS isu, list_contains(c, 'left_arm') AND list_contains(c, 'right_arm') AS arms, list_contains(c, 'left_leg') AND list_contains(c, 'right_leg') AS legs,
list_contains(r, 'arm_large_arc_or_orbit') AS arc, list_contains(r, 'arm_vertical_cycle') AS cyc, list_contains(r, 'hand_head_proximity') AS head, list_contains(r, 'arm_reach_retract') AS reach, list_contains(r, 'leg_lateral_cycle') AS lat, list_contains(r, 'vertical_rhythm') AS rhy, list_contains(r, 'body_level_low') AS lev FROM k)
SELECT array_to_string(r, '+') AS items, round(ln(1 + cases) + 0.75 * len(z) + 0.15 * len(c) + 2.5 * inv::INT + 1.6 * su::INT + (fl AND up)::INT + 2.0 * isu::INT + 1.8 * (up AND lo)::INT + 1.2 * (up AND ve)::INT + (lo AND ve)::INT + 0.8 * (po AND (lo OR ve))::INT + 0.6 * arms::INT + 0.8 * legs::INT
+ 0.8 * ((arc OR cyc) AND lo)::INT + 0.6 * (head AND (po OR ve OR lo))::INT + 0.4 * (reach AND (po OR ve OR lo))::INT - 1.6 * (len(z) = 1 AND NOT arms AND NOT legs)::INT, 4) AS score,
CASE WHEN fl AND (up OR po) THEN 'floor_prone_or_mime_candidate' WHEN isu AND (up OR lo OR po OR inv) THEN 'inversion_acrobatic_candidate' WHEN inv AND (up OR lo OR po) THEN 'inversion_acrobatic_candidate' WHEN up AND lo AND (ve OR po) THEN 'full_upper_lower_body_candidate'
WHEN up AND ve THEN 'upper_vertical_coordination_component' WHEN up AND lo THEN 'upper_lower_coordination_component' WHEN lo AND (ve OR po) THEN 'lower_body_transition_component' WHEN po AND ve THEN 'body_level_transition_component' WHEN arms THEN 'bilateral_upper_component'
WHEN legs THEN 'bilateral_lower_component' ELSE 'local_or_ambiguous_component' END AS scope,
CASE WHEN cases >= 20 THEN 'high_support' WHEN cases < 2 THEN 'below_threshold' WHEN (fl OR isu) AND len(z) >= 2 THEN 'high_specificity' WHEN fl AND (head OR arc OR lev) THEN 'high_specificity' WHEN isu AND (arc OR lat OR rhy OR lev) THEN 'high_specificity'
WHEN arc AND lat AND (rhy OR lev OR arms) THEN 'high_specificity' WHEN head AND lat AND (lev OR rhy) THEN 'high_specificity' ELSE 'below_threshold' END AS kind FROM f""")
def mine36_itemset_scope(spark, sf_dir):
    """Score, scope and kind of every set."""
    return D.itemset_scope(body_sets(spark, sf_dir), 20, 2).select(F.array_join("roles", "+").alias("items"), "score", "scope", "kind")


@query(f"""{SETS}, f AS (SELECT array_to_string(r, '+') AS symbol, n, cases, list_contains(z, 'upper') AS up, list_contains(z, 'lower') AS lo, list_contains(z, 'vertical') AS ve, list_contains(z, 'inversion') AS inv, len(c) AS chs, len(z) AS zs, list_contains(r, 'arm_large_arc_or_orbit') AS arc, list_contains(r, 'arm_reach_retract') AS reach,
list_contains(r, 'hand_head_proximity') AS head, list_contains(r, 'leg_lateral_cycle') AS lat, list_contains(r, 'body_level_low') AS lev, list_contains(r, 'floor_low_horizontal_support') AS fl, list_contains(r, 'inverted_support') AS isu FROM k WHERE n >= 2 AND cases >= 2),
g AS (SELECT symbol, n, cases, round(ln(1 + cases) + 0.35 * chs + 0.55 * zs - 1.5 * (zs <= 1)::INT + 1.25 * (up AND ve)::INT + (lo AND ve)::INT + 1.2 * (arc AND (lo OR ve OR lev))::INT + 0.9 * (reach AND (lo OR lev))::INT + 1.3 * (head AND lev)::INT + 1.25 * (lat AND up)::INT + 0.9 * (lat AND ve)::INT
+ 0.9 * (lev AND up)::INT + 1.3 * (fl OR isu)::INT + 1.3 * (isu AND (up OR lo OR inv))::INT + (fl AND up)::INT, 6) AS score FROM f)
SELECT symbol, n, cases, score FROM g WHERE score >= 2.5 ORDER BY score DESC, cases DESC, n DESC, symbol LIMIT 40""")
def mine08_structure_selection(spark, sf_dir):
    """The 40 symbols that a structure score ranks first, of those with two cases."""
    marks = {"arm_large_arc_or_orbit": ["arm_trajectory"], "arm_reach_retract": ["arm_reach"], "hand_head_proximity": ["hand_proximity"], "leg_lateral_cycle": ["leg_lateral"], "body_level_low": ["body_level"], "floor_low_horizontal_support": ["body_support", "floor_support"], "inverted_support": ["body_support", "inverted_support"]}
    own = [F.when(F.array_contains("roles", role), m) for role, ms in marks.items() for m in ms]
    stats = body_sets(spark, sf_dir).select(F.array_join("roles", "+").alias("symbol"), "n", "cases", F.size("channels").alias("channels"), "zones", F.array_distinct(F.array_compact(F.array(*own))).alias("marks"))
    return D.select_coordination(stats, 40, 2, 2, D.STRUCTURE_WEIGHTS, 2.5).select("symbol", "n", "cases", "score")


@query("""WITH n AS (SELECT p_brand || '/' || p_size AS node, list(DISTINCT p_name) AS l FROM part GROUP BY 1), c AS (SELECT p_type || '/' || p_size AS component, list(DISTINCT p_name) AS l FROM part GROUP BY 1)
SELECT component, node, len(list_intersect(n.l, c.l)) / (len(n.l) + len(c.l) - len(list_intersect(n.l, c.l))) AS jaccard FROM n, c WHERE len(list_intersect(n.l, c.l)) / (len(n.l) + len(c.l) - len(list_intersect(n.l, c.l))) >= 0.3""")
def mine37_component_linking(spark, sf_dir):
    """Links by shared names: pairs meet on a name, so that pairs without one are never formed."""
    part = table(spark, sf_dir, "part")
    n = part.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("node"), "p_name").distinct()
    c = part.select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("component"), "p_name").distinct()
    shared = n.join(c, "p_name").groupBy("component", "node").agg(F.count("*").alias("both"))
    sizes = shared.join(n.groupBy("node").agg(F.count("*").alias("a")), "node").join(c.groupBy("component").agg(F.count("*").alias("b")), "component")
    return sizes.select("component", "node", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("jaccard")).where("jaccard >= 0.3")


@query(f"{STATS} SELECT item, CASE WHEN regexp_matches(item, '#(13|7)$') THEN 'vetoed' WHEN cases >= 420 AND purity < 0.01 THEN 'stable_named' WHEN cases >= 400 THEN 'stable_unnamed' WHEN purity < 0.008 THEN 'aligned' WHEN cases >= 100 THEN 'weak' ELSE 'generic' END AS tier FROM st")
def mine38_motif_tiers(spark, sf_dir):
    cases, purity = F.col("cases"), F.col("purity")
    tier = F.when(F.col("item").rlike("#(13|7)$"), "vetoed").when((cases >= 420) & (purity < 0.01), "stable_named").when(cases >= 400, "stable_unnamed").when(purity < 0.008, "aligned").when(cases >= 100, "weak").otherwise("generic")
    return item_stats(spark, sf_dir).select("item", tier.alias("tier"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'split' WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'promote' WHEN o_orderstatus = 'F' THEN 'closure' WHEN o_totalprice < 20000 THEN 'downgrade' ELSE 'pending' END AS decision FROM orders""")
def mine39_review_cascade(spark, sf_dir):
    done, price = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    decision = F.when(F.col("o_orderstatus") == "P", "pending").when(done & (price > 300000), "split").when(done & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "promote").when(done, "closure").when(price < 20000, "downgrade").otherwise("pending")
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))


@query("""SELECT source, CASE WHEN bool_or(contains(text, 'token =')) THEN 'blocked_secret' WHEN bool_or(contains(text, '@mail')) THEN 'blocked_contact' WHEN bool_or(n_chars > 20000) THEN 'blocked_length' ELSE 'clear' END AS status FROM documents GROUP BY 1""")
def mine40_family_status(spark, sf_dir):
    t = F.col("text")
    flags = table(spark, sf_dir, "documents").groupBy("source").agg(F.bool_or(t.contains("token =")).alias("a"), F.bool_or(t.contains("@mail")).alias("b"), F.bool_or(F.col("n_chars") > 20000).alias("c"))
    return flags.select("source", F.when(F.col("a"), "blocked_secret").when(F.col("b"), "blocked_contact").when(F.col("c"), "blocked_length").otherwise("clear").alias("status"))


ALIASES = [
    A.AliasRule("sale", ("licen[sc]e", "price|cost"), ("purchase", "click"), ("warranty",), "trade", 3, 5, 0.9),
    A.AliasRule("offer", ("price|cost|the",), ("purchase",), (), "trade", None, 4, 0.8),
    A.AliasRule("browse", ("the|der|le|el",), ("view", "click"), (), "", 2, 3, 0.6),
    A.AliasRule("search", ("and|und|et|y",), ("click", "view"), ("token =",), "look", None, 3, 0.7),
    A.AliasRule("failure", ("@mail", "error|fehler"), ("error",), (), "fault", None, 2, 0.5),
    A.AliasRule("breakdown", ("a",), ("error", "signup"), (), "fault", 6, 1, 0.5),
]


def alias_sql() -> str:
    """The rules one after another: each takes the best action left in a case whose group is free."""
    out = f"WITH {EV}, act AS (SELECT case_id, event_id AS action_id, channel, e - s AS n, value / 200 AS sure, s FROM ev WHERE value >= 1), u0 AS (SELECT NULL::BIGINT AS case_id, NULL::BIGINT AS action_id, '' AS alias, '' AS grp, 0.0::DOUBLE AS confidence, 0 AS priority WHERE false)"
    for k, r in enumerate(A.ranked(ALIASES), 1):
        rank = "CASE channel " + "".join(f"WHEN '{f}' THEN {i} " for i, f in enumerate(r.families)) + "END"
        unless = f"AND NOT regexp_matches(lower(text), '{'|'.join(r.unless)}')" if r.unless else ""
        out += f""", c{k} AS (SELECT * FROM act WHERE {rank} IS NOT NULL AND n >= {r.least_count or 0} AND case_id IN (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{'|'.join(r.patterns)}') {unless}) AND action_id NOT IN (SELECT action_id FROM u{k - 1})
AND case_id NOT IN (SELECT case_id FROM u{k - 1} WHERE grp = '{r.group or r.alias}') QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {rank}, sure DESC, n DESC, s, action_id) = 1),
u{k} AS (SELECT * FROM u{k - 1} UNION ALL SELECT case_id, action_id, '{r.alias}', '{r.group or r.alias}', round(least(0.92, greatest(sure, 0.1) * {max(r.confidence, 0.1)}), 4), {r.priority} FROM c{k})"""
    return f"{out} SELECT case_id, action_id, alias, confidence, priority FROM u{len(ALIASES)}"


@query(alias_sql())
def join17_alias_rules(spark, sf_dir):
    """Names from a user's document for the user's events: a name's group is given once, an event gets one name."""
    ev = spans(spark, sf_dir)
    actions = ev.select("case_id", F.col("event_id").alias("action_id"), F.col("channel").alias("family"), (F.col("e") - F.col("s")).alias("count"), (F.col("value") / 200).alias("confidence"), F.col("s").alias("start"), (F.col("value") >= 1).alias("visible"))
    captions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("caption"))
    return A.attached(actions, captions, ALIASES)


@query()
def join20_one_to_one_assignment(spark, sf_dir):
    ev = spans(spark, sf_dir)
    pairs = S.near_pairs(ev.where("channel = 'click'"), ev.where("channel = 'purchase'"), 6)
    rows = pairs.select("case_id", "l_s", F.col("l_event_id").alias("l_id"), F.col("r_event_id").alias("r_id"), S.overlap(*NAMES).alias("ov"), S.gap(*NAMES, between=False).alias("gap"), S.duration("r_s", "r_e").alias("dur"))
    return X.one_to_one(rows)


@query()
def win16_alternations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("frame"), F.col("role").alias("sym"))
    return Q.alternations(turns)


@query()
def win17_block_repeats(spark, sf_dir):
    return Q.block_repeats(frames(spark, sf_dir))
