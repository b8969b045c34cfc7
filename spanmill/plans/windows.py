"""Signals, runs and ordered sequences by windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import signals as G
from ..operators import spans as S
from ..registry import query
from ..sources.adapters import EV, FR, frames, spans, table

W = "WINDOW w AS (PARTITION BY case_id ORDER BY frame)"


@query(f"""WITH {FR}, n AS (SELECT *, max(frame) OVER (PARTITION BY case_id) AS top FROM fr), k AS (SELECT n.case_id, n.frame, greatest(0, least(top, n.frame + o)) AS at FROM n, (SELECT unnest([-2, -1, 0, 1, 2]) AS o))
SELECT k.case_id, k.frame, round(sum(fr.value) / 5, 6) AS smooth FROM k JOIN fr ON fr.case_id = k.case_id AND fr.frame = k.at GROUP BY ALL""")
def win01_moving_average(spark, sf_dir):
    return G.moving_average(frames(spark, sf_dir)).select("case_id", "frame", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {FR} SELECT case_id, frame, round(value - coalesce(lag(value) OVER w, value), 6) AS delta FROM fr {W}")
def win02_first_difference(spark, sf_dir):
    return frames(spark, sf_dir).select("case_id", "frame", F.round(G.difference(), 6).alias("delta"))


@query(f"""WITH {FR} SELECT case_id, frame, round(CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 6) AS slope FROM fr {W}""")
def win03_central_gradient(spark, sf_dir):
    return frames(spark, sf_dir).select("case_id", "frame", F.round(G.gradient(), 6).alias("slope"))


@query(f"""WITH {FR}, a AS (SELECT case_id, frame, value % 360 AS angle FROM fr), d AS (SELECT *, angle - lag(angle) OVER w AS d FROM a {W}),
f AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < 180 THEN 0 ELSE -round(d / 360) * 360 END AS fix FROM d) SELECT case_id, frame, round(angle + sum(fix) OVER (PARTITION BY case_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 4) AS unwrapped FROM f""")
def win04_angle_unwrap(spark, sf_dir):
    angles = frames(spark, sf_dir).withColumn("angle", F.col("value") % 360)
    return G.unwrapped(angles, "angle", 360.0).select("case_id", "frame", F.round("unwrapped", 4).alias("unwrapped"))


@query(f"""WITH {FR}, i AS (SELECT case_id, frame, frame - row_number() OVER w AS g FROM fr WHERE value > 30 {W}) SELECT case_id, min(frame) AS s, max(frame) AS e, count(*) AS length FROM i GROUP BY case_id, g HAVING count(*) >= 2""")
def win05_gaps_and_islands(spark, sf_dir):
    return G.runs(frames(spark, sf_dir), F.col("value") > 30, 2)


MERGED = """m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY case_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 OR row_number() OVER (PARTITION BY case_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS new FROM ev),
g AS (SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m), u AS (SELECT case_id, n, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY ALL)"""


@query(f"WITH {EV}, {MERGED} SELECT case_id, s, e, members FROM u")
def win06_gap_tolerant_merge(spark, sf_dir):
    return S.merged(spans(spark, sf_dir), 5).drop("n")


@query(f"""WITH {FR}, d AS (SELECT *, value - coalesce(lag(value) OVER w, value) AS d FROM fr {W}), s AS (SELECT *, CASE WHEN d > 5 THEN 1 WHEN d < -5 THEN -1 ELSE 0 END AS state FROM d),
c AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS c FROM s {W}), g AS (SELECT *, sum(c) OVER (PARTITION BY case_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM c)
SELECT case_id, any_value(state) AS direction, min(frame) AS s, max(frame) AS e, round(sum(d), 6) AS delta FROM g GROUP BY case_id, segment HAVING any_value(state) <> 0""")
def win07_sign_segments(spark, sf_dir):
    d = frames(spark, sf_dir).withColumn("d", G.difference())
    seg = G.segments(d, F.when(F.col("d") > 5, 1).when(F.col("d") < -5, -1).otherwise(0))
    out = seg.groupBy("case_id", "segment").agg(F.first("state").alias("direction"), F.min("frame").alias("s"), F.max("frame").alias("e"), F.round(F.sum("d"), 6).alias("delta"))
    return out.where("direction != 0").drop("segment")


@query(f"""WITH {FR}, m AS (SELECT case_id, median(value) AS mid FROM fr GROUP BY 1), c AS (SELECT fr.case_id, frame, abs(value - mid) AS a FROM fr JOIN m USING (case_id)),
t AS (SELECT case_id, greatest(8, quantile_cont(a, 0.7)) AS t, max_by(frame, (a, -frame)) AS peak, max(frame) AS top FROM c GROUP BY 1),
x AS (SELECT c.case_id, frame, t, peak, top, max(a) OVER (PARTITION BY c.case_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM c JOIN t USING (case_id))
SELECT case_id, coalesce(min(frame) FILTER (near >= t), greatest(any_value(peak) - 3, 0)) AS s, coalesce(max(frame) FILTER (near >= t), least(any_value(peak) + 3, any_value(top))) AS e FROM x GROUP BY 1""")
def win08_active_span(spark, sf_dir):
    f = frames(spark, sf_dir)
    listed = lambda c: F.array_sort(F.collect_list(c)).alias("_v")
    mid = f.groupBy("case_id").agg(listed("value")).select("case_id", N.quantile(F.col("_v"), 0.5).alias("mid"))
    c = f.join(mid, "case_id").select("case_id", "frame", F.abs(F.col("value") - F.col("mid")).alias("a"))
    t = c.groupBy("case_id").agg(listed("a"), F.max_by("frame", F.struct("a", -F.col("frame"))).alias("peak"), F.max("frame").alias("top"))
    t = t.select("case_id", F.greatest(F.lit(8.0), N.quantile(F.col("_v"), 0.7)).alias("t"), "peak", "top")
    x = c.join(t, "case_id").withColumn("near", F.max("a").over(G.in_order().rowsBetween(-2, 2)))
    on = F.when(F.col("near") >= F.col("t"), F.col("frame"))
    return x.groupBy("case_id").agg(F.coalesce(F.min(on), F.greatest(F.first("peak") - 3, F.lit(0))).alias("s"), F.coalesce(F.max(on), F.least(F.first("peak") + 3, F.first("top"))).alias("e"))


@query(f"""WITH {FR}, i AS (SELECT case_id, frame, value, frame - row_number() OVER w AS g FROM fr WHERE value >= 40 {W})
SELECT case_id, min(frame) AS s, max(frame) AS e, round(sum(value), 6) AS path, round(least(1, 0.4 + 0.1 * count(*) + 0.001 * sum(value)), 6) AS confidence FROM i GROUP BY case_id, g HAVING count(*) >= 2 AND sum(value) >= 120""")
def win09_state_runs(spark, sf_dir):
    hit = frames(spark, sf_dir).where("value >= 40").withColumn("g", F.col("frame") - F.row_number().over(G.in_order()))
    out = hit.groupBy("case_id", "g").agg(F.min("frame").alias("s"), F.max("frame").alias("e"), F.count("*").alias("n"), F.sum("value").alias("p")).where("n >= 2 AND p >= 120")
    return out.select("case_id", "s", "e", F.round("p", 6).alias("path"), F.round(F.least(F.lit(1.0), 0.4 + 0.1 * F.col("n") + 0.001 * F.col("p")), 6).alias("confidence"))


@query(f"""WITH RECURSIVE {FR}, p AS (SELECT case_id, frame FROM (SELECT case_id, frame, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM fr {W}) WHERE value > a AND value >= b),
k AS (SELECT case_id, min(frame) AS frame FROM p GROUP BY 1 UNION ALL SELECT k.case_id, (SELECT min(p.frame) FROM p WHERE p.case_id = k.case_id AND p.frame >= k.frame + 4) FROM k WHERE k.frame IS NOT NULL)
SELECT case_id, frame AS peak FROM k WHERE frame IS NOT NULL""")
def win10_peaks_with_gap(spark, sf_dir):
    w = G.in_order()
    p = frames(spark, sf_dir).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w)).where("value > a AND value >= b")
    lists = p.groupBy("case_id").agg(F.array_sort(F.collect_list("frame")).alias("at"))
    return lists.select("case_id", F.explode(G.spaced(F.col("at"), 4)).alias("peak"))


@query(f"""WITH {FR}, z AS (SELECT case_id, value AS v0 FROM fr WHERE frame = 0) SELECT case_id, coalesce(min(frame) FILTER (abs(value - v0) >= 60), 0) AS at FROM fr JOIN z USING (case_id) GROUP BY 1""")
def win11_first_crossing(spark, sf_dir):
    far = F.abs(F.col("value") - F.first("value").over(G.in_order())) >= 60
    return frames(spark, sf_dir).withColumn("at", F.when(far, F.col("frame"))).groupBy("case_id").agg(F.coalesce(F.min("at"), F.lit(0)).alias("at"))


@query(f"""WITH {FR}, q AS (SELECT case_id, quantile_cont(value, 0.6) AS t, max(frame) AS top FROM fr GROUP BY 1), i AS (SELECT case_id, frame, frame - row_number() OVER w AS g FROM fr JOIN q USING (case_id) WHERE value < t {W}),
r AS (SELECT case_id, min(frame) AS s FROM i GROUP BY case_id, g HAVING count(*) >= 4) SELECT q.case_id, coalesce(min(s), any_value(top)) AS ends FROM q LEFT JOIN r USING (case_id) GROUP BY 1""")
def win12_quiet_tail(spark, sf_dir):
    f = frames(spark, sf_dir)
    q = f.groupBy("case_id").agg(F.array_sort(F.collect_list("value")).alias("_v"), F.max("frame").alias("top")).select("case_id", N.quantile(F.col("_v"), 0.6).alias("t"), "top")
    quiet = G.runs(f.join(q, "case_id"), F.col("value") < F.col("t"), 4).groupBy("case_id").agg(F.min("s").alias("s"))
    return q.join(quiet, "case_id", "left").select("case_id", F.coalesce("s", "top").alias("ends"))


@query(f"""WITH {FR}, g AS (SELECT case_id, sym AS a, lead(sym) OVER w AS b, lead(sym, 2) OVER w AS c FROM fr {W}), x AS (SELECT case_id, a || '>' || b AS gram FROM g WHERE b IS NOT NULL UNION ALL SELECT case_id, a || '>' || b || '>' || c FROM g WHERE c IS NOT NULL)
SELECT gram, count(*) AS n, count(DISTINCT case_id) AS cases FROM x GROUP BY 1""")
def win13_sequence_ngrams(spark, sf_dir):
    w = G.in_order()
    g = frames(spark, sf_dir).select("case_id", F.col("sym").alias("a"), F.lead("sym").over(w).alias("b"), F.lead("sym", 2).over(w).alias("c"))
    grams = F.array_compact(F.array(F.when(F.col("b").isNotNull(), F.concat_ws(">", "a", "b")), F.when(F.col("c").isNotNull(), F.concat_ws(">", "a", "b", "c"))))
    return g.select("case_id", F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query(f"""WITH {FR}, n AS (SELECT case_id, frame, sym, concat_ws('.', lag(sym, 2) OVER w, lag(sym) OVER w) AS before_syms, concat_ws('.', lead(sym) OVER w, lead(sym, 2) OVER w) AS after_syms FROM fr {W})
SELECT sym, before_syms, after_syms, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 2""")
def win14_neighbourhood_signature(spark, sf_dir):
    w = G.in_order()
    n = frames(spark, sf_dir).select("sym", F.concat_ws(".", F.lag("sym", 2).over(w), F.lag("sym").over(w)).alias("before_syms"), F.concat_ws(".", F.lead("sym").over(w), F.lead("sym", 2).over(w)).alias("after_syms"))
    return n.groupBy("sym", "before_syms", "after_syms").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"""WITH {FR}, c AS (SELECT *, CASE WHEN lag(sym) OVER w = sym THEN 0 ELSE 1 END AS c FROM fr {W}), g AS (SELECT *, sum(c) OVER (PARTITION BY case_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM c)
SELECT case_id, any_value(sym) AS sym, min(frame) AS s, count(*) AS times FROM g GROUP BY case_id, segment HAVING count(*) >= 2""")
def win15_run_length_repetition(spark, sf_dir):
    seg = G.segments(frames(spark, sf_dir), F.col("sym"))
    return seg.groupBy("case_id", "segment").agg(F.first("sym").alias("sym"), F.min("frame").alias("s"), F.count("*").alias("times")).where("times >= 2").drop("segment")


@query(f"""WITH {EV}, {MERGED.replace('+ 5', '+ 0')} SELECT case_id, CAST(sum(e - s + 1) AS BIGINT) AS covered, sum(e - s + 1) / (max(e) - min(s) + 1) AS coverage FROM u GROUP BY 1""")
def win18_merged_coverage(spark, sf_dir):
    u = S.merged(spans(spark, sf_dir), 0)
    length = F.sum(F.col("e") - F.col("s") + 1)
    return u.groupBy("case_id").agg(length.alias("covered"), (length / (F.max("e") - F.min("s") + 1)).alias("coverage"))


@query(f"""WITH {FR}, k AS (SELECT case_id, frame, sym FROM (SELECT *, lag(sym) OVER w AS p FROM fr {W}) WHERE p IS NULL OR p <> sym), r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY frame) <= 20)
SELECT case_id, string_agg(sym, '>' ORDER BY frame) AS sketch FROM r GROUP BY 1""")
def win19_dedupe_sketch(spark, sf_dir):
    changed = frames(spark, sf_dir).withColumn("p", F.lag("sym").over(G.in_order())).where("p IS NULL OR p != sym")
    lists = changed.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("frame", "sym"))).alias("l"))
    return lists.select("case_id", F.array_join(F.slice(F.col("l.sym"), 1, 20), ">").alias("sketch"))


@query(f"""WITH {EV}, m AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY case_id ORDER BY s, e, event_id) <= 20 THEN 0 ELSE 1 END AS new FROM ev), g AS (SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT case_id, CAST(n AS BIGINT) AS session, count(*) AS members, min(s) AS s, max(e) AS e FROM g GROUP BY case_id, n""")
def win20_gap_sessions(spark, sf_dir):
    w = Window.partitionBy("case_id").orderBy("s", "e", "event_id")
    new = F.when(F.col("s") - F.lag("e").over(w) <= 20, 0).otherwise(1)
    g = spans(spark, sf_dir).withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("case_id", "session").agg(F.count("*").alias("members"), F.min("s").alias("s"), F.max("e").alias("e"))


@query(f"""WITH {EV}, {MERGED.replace('+ 5', '+ 0')} SELECT case_id, p + 1 AS s, s - 1 AS e FROM (SELECT *, lag(e) OVER (PARTITION BY case_id ORDER BY s) AS p FROM u) WHERE p IS NOT NULL AND s - p > 1""")
def win21_free_windows(spark, sf_dir):
    u = S.merged(spans(spark, sf_dir), 0).withColumn("p", F.lag("e").over(Window.partitionBy("case_id").orderBy("s")))
    return u.where("p IS NOT NULL AND s - p > 1").select("case_id", (F.col("p") + 1).alias("s"), (F.col("s") - 1).alias("e"))


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS priority FROM part")
def win22_priority_rank(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", rank.cast("long").alias("priority"))
