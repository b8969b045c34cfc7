"""Arrays, maps, trees and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection as C
from ..operators import trees as Y
from ..registry import query
from ..sources.adapters import EV, FR, frames, spans, table


@query("""WITH v AS (SELECT p_name AS token, row_number() OVER (ORDER BY p_name) + 1 AS id FROM (SELECT DISTINCT p_name FROM part WHERE p_size > 10)) SELECT p_partkey, coalesce(id, 1) AS id FROM part LEFT JOIN v ON token = p_name""")
def arr01_vocabulary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.where("p_size > 10").select(F.col("p_name").alias("token")).distinct()
    ids = C.numbered(names, [F.asc("token")]).select("token", (F.col("place") + 1).alias("id"))
    return part.join(ids, F.col("token") == F.col("p_name"), "left").select("p_partkey", F.coalesce("id", F.lit(1)).cast("long").alias("id"))


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat(p, [0, 0, 0, 0])[:4], ',') AS slots, CAST(least(len(p), 4) AS BIGINT) AS used, CAST(greatest(len(p) - 4, 0) AS BIGINT) AS truncated FROM l""")
def arr02_pad_truncate(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))["l_partkey"].alias("p"))
    slots = F.slice(F.concat("p", F.array_repeat(F.lit(0).cast("bigint"), 4)), 1, 4)
    return l.select("l_orderkey", F.array_join(slots, ",").alias("slots"), F.least(F.size("p"), F.lit(4)).cast("long").alias("used"), F.greatest(F.size("p") - 4, F.lit(0)).cast("long").alias("truncated"))


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) || ',' || CAST(o_orderstatus = 'O' AS INT) || ',' || CAST(o_orderstatus = 'P' AS INT) AS hot FROM orders""")
def arr03_one_hot(spark, sf_dir):
    keys = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(keys, lambda k: (k == F.col("o_orderstatus")).cast("int").cast("string")), ",").alias("hot"))


@query(f"""WITH {EV}, c AS (SELECT case_id, min(s) AS t0, max(e) - min(s) + 1 AS n FROM ev GROUP BY 1) SELECT event_id, (s - t0) / n AS at_start, (e - t0) / n AS at_end, (s + e - 2 * t0) / 2 / n AS centre, (e - s + 1) / n AS duration FROM ev JOIN c USING (case_id)""")
def arr04_span_normalization(spark, sf_dir):
    ev = spans(spark, sf_dir)
    c = ev.groupBy("case_id").agg(F.min("s").alias("t0"), (F.max("e") - F.min("s") + 1).alias("n"))
    s, e, t0, n = (F.col(x) for x in ("s", "e", "t0", "n"))
    return ev.join(c, "case_id").select("event_id", ((s - t0) / n).alias("at_start"), ((e - t0) / n).alias("at_end"), ((s + e - 2 * t0) / 2 / n).alias("centre"), ((e - s + 1) / n).alias("duration"))


@query(f"""WITH {EV} SELECT event_id, array_to_string(list_transform(generate_series(0, 23), lambda t: CASE WHEN t BETWEEN s % 24 AND s % 24 + (e - s) THEN 1 ELSE 0 END), '') AS mask FROM ev""")
def arr05_span_mask(spark, sf_dir):
    mask = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda t: t.between(F.col("s") % 24, F.col("s") % 24 + F.col("e") - F.col("s")).cast("int").cast("string"))
    return spans(spark, sf_dir).select("event_id", F.array_join(mask, "").alias("mask"))


@query(f"""WITH {FR}, l AS (SELECT case_id, list(event_id ORDER BY frame) AS v FROM fr GROUP BY 1) SELECT case_id, array_to_string(list_concat(v[:10], list_transform(generate_series(1, 5), lambda i: v[10])), ',') AS repeated, array_to_string(list_concat(v[:10], [0, 0, 0, 0, 0]), ',') AS zeroed FROM l""")
def arr06_prefix_condition(spark, sf_dir):
    l = frames(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("frame", "event_id")))["event_id"].alias("v"))
    head = F.slice("v", 1, 10)
    return l.select("case_id", F.array_join(F.concat(head, F.array_repeat(F.try_element_at("v", F.lit(10)), 5)), ",").alias("repeated"), F.array_join(F.concat(head, F.array_repeat(F.lit(0).cast("bigint"), 5)), ",").alias("zeroed"))


@query(f"""WITH {FR}, l AS (SELECT case_id, list(sym ORDER BY frame) AS v FROM fr GROUP BY 1), u AS (SELECT case_id, v, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM l), f AS (SELECT case_id, x, min(i) AS i FROM u GROUP BY ALL)
SELECT case_id, string_agg(x, '>' ORDER BY i) AS merged FROM f GROUP BY 1""")
def arr07_ordered_union(spark, sf_dir):
    # Each symbol once, at its first frame, so that a case's list holds distinct symbols only.
    first = frames(spark, sf_dir).groupBy("case_id", "sym").agg(F.min("frame").alias("frame"))
    l = first.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("frame", "sym")))["sym"].alias("v"))
    return l.select("case_id", F.array_join("v", ">").alias("merged"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 'high' ELSE 'low' END AS quality FROM events""")
def arr08_json_slots(spark, sf_dir):
    slots = F.from_json("props", "map<string,bigint>")
    k = F.try_element_at(slots, F.lit("k"))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k >= 50, "high").otherwise("low").alias("quality"))


TREE = "t AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 5 THEN NULL ELSE p_partkey // 5 END AS parent FROM part)"


@query(f"""WITH RECURSIVE {TREE}, r AS (SELECT id AS leaf, id AS node, 1 AS depth, CAST(id AS VARCHAR) AS path FROM t UNION ALL SELECT leaf, parent, depth + 1, parent || '/' || path FROM r JOIN t ON t.id = r.node WHERE parent IS NOT NULL)
SELECT leaf, max_by(path, depth) AS path FROM r GROUP BY 1""")
def arr09_path_to_root(spark, sf_dir):
    """Paths by doubling: each round joins what is known of a node with what is known of the topmost ancestor it has reached."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 5, F.expr("p_partkey div 5")).alias("parent"))
    return Y.paths_to_root(t).select(F.col("id").alias("leaf"), F.array_join("path", "/").alias("path"))


@query(f"""WITH RECURSIVE {TREE}, r AS (SELECT id, id AS root, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, r.root, depth + 1 FROM r JOIN t ON t.parent = r.id) SELECT root, count(*) AS nodes, CAST(max(depth) AS BIGINT) AS depth FROM r GROUP BY 1""")
def arr10_forest_stats(spark, sf_dir):
    paths = arr09_path_to_root(spark, sf_dir).select(F.split("path", "/").alias("p"))
    return paths.groupBy(F.col("p")[0].cast("long").alias("root")).agg(F.count("*").alias("nodes"), F.max(F.size("p") - 1).cast("long").alias("depth"))


@query("""WITH a AS (SELECT 'brand' AS axis, p_brand AS key, p_partkey AS id FROM part UNION ALL SELECT 'type', p_type, p_partkey FROM part) SELECT axis, key, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids FROM a GROUP BY ALL""")
def arr11_search_index(spark, sf_dir):
    axes = F.array(F.struct(F.lit("brand").alias("axis"), F.col("p_brand").alias("key")), F.struct(F.lit("type").alias("axis"), F.col("p_type").alias("key")))
    a = table(spark, sf_dir, "part").select(F.inline(axes), F.col("p_partkey").alias("id"))
    return a.groupBy("axis", "key").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_set("id")), ",").cast("binary")).alias("ids"))


@query(f"""WITH {FR}, n AS (SELECT case_id, max(frame) + 1 AS n FROM fr GROUP BY 1) SELECT case_id, i AS k, CAST(trunc(i * (n - 1) / 7) AS BIGINT) AS at FROM n, (SELECT unnest(generate_series(0, 7)) AS i)""")
def arr12_even_sampling(spark, sf_dir):
    n = frames(spark, sf_dir).groupBy("case_id").agg((F.max("frame") + 1).alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.cast("long").alias("k"), (i * (F.col("n") - 1) / 7).cast("long").alias("at")))
    return n.select("case_id", F.inline(at))


JOINT = """j AS (SELECT label AS case_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, {cols} FROM embeddings)"""


def joints(*at: int) -> str:
    """The CTE of embedding components by number, from 1."""
    return JOINT.format(cols=", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in at))


def vectors(spark, sf_dir, *at: int):
    """(case_id, vec_id, frame, x1...): components of the embeddings in each label's order."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("case_id"), "vec_id", (F.row_number().over(order) - 1).cast("long").alias("frame"), *[F.col("embedding")[i - 1].cast("double").alias(f"x{i}") for i in at])


@query(f"WITH {joints(1, 2, 3, 4, 5, 6)} SELECT vec_id, round(x2 - x5, 6) AS height, round(sqrt((x1 - x4) * (x1 - x4) + (x3 - x6) * (x3 - x6)), 6) AS stance, x2 < x5 AS inverted FROM j")
def math01_joint_signals(spark, sf_dir):
    dx, dz = F.col("x1") - F.col("x4"), F.col("x3") - F.col("x6")
    return vectors(spark, sf_dir, 1, 2, 3, 4, 5, 6).select("vec_id", F.round(F.col("x2") - F.col("x5"), 6).alias("height"), F.round(F.sqrt(dx * dx + dz * dz), 6).alias("stance"), (F.col("x2") < F.col("x5")).alias("inverted"))


@query(f"""WITH {joints(1, 3, 4, 6)}, d AS (SELECT vec_id, x1 - lag(x1) OVER w AS vx, x3 - lag(x3) OVER w AS vz, x4 AS hx, x6 AS hz FROM j WINDOW w AS (PARTITION BY case_id ORDER BY frame))
SELECT vec_id, round((vx * hx + vz * hz) / greatest(sqrt(hx * hx + hz * hz), 1e-9), 5) AS forward, round((vx * hz - vz * hx) / greatest(sqrt(hx * hx + hz * hz), 1e-9), 5) AS sideways FROM d WHERE vx IS NOT NULL""")
def math02_body_velocity(spark, sf_dir):
    w = Window.partitionBy("case_id").orderBy("frame")
    d = vectors(spark, sf_dir, 1, 3, 4, 6).select("vec_id", (F.col("x1") - F.lag("x1").over(w)).alias("vx"), (F.col("x3") - F.lag("x3").over(w)).alias("vz"), F.col("x4").alias("hx"), F.col("x6").alias("hz")).where("vx IS NOT NULL")
    vx, vz, hx, hz = (F.col(c) for c in ("vx", "vz", "hx", "hz"))
    norm = F.greatest(F.sqrt(hx * hx + hz * hz), F.lit(1e-9))
    return d.select("vec_id", F.round((vx * hx + vz * hz) / norm, 5).alias("forward"), F.round((vx * hz - vz * hx) / norm, 5).alias("sideways"))


@query(f"WITH {joints(7, 8, 9)} SELECT vec_id, round(degrees(0.5 * x7 + 0.3 * x8 - 0.2 * x9), 5) AS bend FROM j")
def math03_linear_attributes(spark, sf_dir):
    return vectors(spark, sf_dir, 7, 8, 9).select("vec_id", F.round(F.degrees(0.5 * F.col("x7") + 0.3 * F.col("x8") - 0.2 * F.col("x9")), 5).alias("bend"))


@query(f"""WITH {joints(1, 2)}, d AS (SELECT case_id, frame, x1, x2, sqrt((x1 - lag(x1) OVER w) ** 2 + (x2 - lag(x2) OVER w) ** 2) AS step FROM j WINDOW w AS (PARTITION BY case_id ORDER BY frame)),
c AS (SELECT case_id, avg(x1) AS m1, avg(x2) AS m2 FROM j GROUP BY 1), r AS (SELECT j.case_id, sqrt((x1 - m1) ** 2 + (x2 - m2) ** 2) AS r FROM j JOIN c USING (case_id)), q AS (SELECT case_id, stddev_pop(r) / avg(r) AS cv FROM r GROUP BY 1)
SELECT case_id, round(sum(step), 5) AS path, round(sqrt((max_by(x1, frame) - min_by(x1, frame)) ** 2 + (max_by(x2, frame) - min_by(x2, frame)) ** 2), 5) AS net, round(any_value(cv), 5) AS radius_cv FROM d JOIN q USING (case_id) GROUP BY 1""")
def math04_path_features(spark, sf_dir):
    w = Window.partitionBy("case_id").orderBy("frame")
    v = vectors(spark, sf_dir, 1, 2)
    square = lambda c: c * c
    d = v.withColumn("step", F.sqrt(square(F.col("x1") - F.lag("x1").over(w)) + square(F.col("x2") - F.lag("x2").over(w))))
    c = v.groupBy("case_id").agg(F.avg("x1").alias("m1"), F.avg("x2").alias("m2"))
    q = v.join(c, "case_id").withColumn("r", F.sqrt(square(F.col("x1") - F.col("m1")) + square(F.col("x2") - F.col("m2")))).groupBy("case_id").agg((F.stddev_pop("r") / F.avg("r")).alias("cv"))
    ends = [F.max_by(x, "frame") - F.min_by(x, "frame") for x in ("x1", "x2")]
    out = d.groupBy("case_id").agg(F.sum("step").alias("path"), F.sqrt(square(ends[0]) + square(ends[1])).alias("net")).join(q, "case_id")
    return out.select("case_id", *[F.round(c, 5).alias(n) for n, c in (("path", "path"), ("net", "net"), ("radius_cv", "cv"))])


@query()
def math05_trajectory_axes(spark, sf_dir):
    """Eigenvalues of each case's 3 x 3 covariance, in closed form from its sums: no group is gathered."""
    x = [F.col(f"x{i}") for i in (1, 2, 3)]
    v = vectors(spark, sf_dir, 1, 2, 3)
    own = v.groupBy("case_id").agg(*[F.covar_pop(x[a], x[b]).alias(f"c{a}{b}") for a in range(3) for b in range(a, 3)])
    c = {(a, b): F.col(f"c{a}{b}") for a in range(3) for b in range(a, 3)}
    q = (c[0, 0] + c[1, 1] + c[2, 2]) / 3
    off = c[0, 1] * c[0, 1] + c[0, 2] * c[0, 2] + c[1, 2] * c[1, 2]
    p = F.sqrt(((c[0, 0] - q) ** 2 + (c[1, 1] - q) ** 2 + (c[2, 2] - q) ** 2 + 2 * off) / 6)
    a, b, d = c[0, 0] - q, c[1, 1] - q, c[2, 2] - q
    det = a * (b * d - c[1, 2] * c[1, 2]) - c[0, 1] * (c[0, 1] * d - c[1, 2] * c[0, 2]) + c[0, 2] * (c[0, 1] * c[1, 2] - b * c[0, 2])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * p * p * p)))) / 3
    first, third = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2.0943951023931953)
    second = 3 * q - first - third
    return own.select("case_id", *[F.round(e, 6).alias(n) for n, e in (("first", first), ("second", second), ("third", third))], F.round(1 - F.try_divide(third, second), 6).alias("planarity"))


@query(f"""WITH {joints(1, 4)}, r AS (SELECT case_id, frame, abs(x1 - x4) AS reach FROM j), m AS (SELECT case_id, frame, reach, max(reach) OVER w AS top, min(reach) OVER w AS low FROM r WINDOW w AS (PARTITION BY case_id ORDER BY frame ROWS UNBOUNDED PRECEDING))
SELECT case_id, round(max(reach - low), 6) AS extension, round(max(top - reach), 6) AS retraction FROM m GROUP BY 1""")
def math06_reach_features(spark, sf_dir):
    w = Window.partitionBy("case_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    m = vectors(spark, sf_dir, 1, 4).withColumn("reach", F.abs(F.col("x1") - F.col("x4"))).withColumn("top", F.max("reach").over(w)).withColumn("low", F.min("reach").over(w))
    return m.groupBy("case_id").agg(F.round(F.max(F.col("reach") - F.col("low")), 6).alias("extension"), F.round(F.max(F.col("top") - F.col("reach")), 6).alias("retraction"))


@query(f"WITH {EV} SELECT event_id, round(least(1, 0.3 + 0.02 * (e - s + 1) + 0.004 * value), 6) AS confidence FROM ev")
def math07_confidence(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", F.round(F.least(F.lit(1.0), 0.3 + 0.02 * (F.col("e") - F.col("s") + 1) + 0.004 * F.col("value")), 6).alias("confidence"))


@query(f"""WITH {EV} SELECT case_id, round(ln(1 + count(*)) + 0.35 * count(DISTINCT channel) + 0.55 * count(DISTINCT s // 168) - CASE WHEN count(*) FILTER (channel = 'error') > 12 THEN 0.5 ELSE 0 END, 6) AS score FROM ev GROUP BY 1""")
def math08_structure_score(spark, sf_dir):
    penalty = F.when(F.count_if(F.col("channel") == "error") > 12, 0.5).otherwise(0.0)
    score = F.log1p(F.count("*")) + 0.35 * F.countDistinct("channel") + 0.55 * F.countDistinct(F.expr("s div 168")) - penalty
    return spans(spark, sf_dir).groupBy("case_id").agg(F.round(score, 6).alias("score"))


@query(f"""WITH {FR}, m AS (SELECT case_id, avg(value) AS mean FROM fr GROUP BY 1), g AS (SELECT case_id, frame, value, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS v FROM fr WINDOW w AS (PARTITION BY case_id ORDER BY frame))
SELECT case_id, frame, round((atan2(v, value - mean) + pi()) / (2 * pi()), 6) AS phase FROM g JOIN m USING (case_id)""")
def math09_phase_estimate(spark, sf_dir):
    f = frames(spark, sf_dir)
    w = Window.partitionBy("case_id").orderBy("frame")
    g = f.withColumn("v", F.coalesce(F.lead("value").over(w), F.col("value")) - F.coalesce(F.lag("value").over(w), F.col("value")))
    m = f.groupBy("case_id").agg(F.avg("value").alias("mean"))
    return g.join(m, "case_id").select("case_id", "frame", F.round((F.atan2("v", F.col("value") - F.col("mean")) + F.pi()) / (2 * F.pi()), 6).alias("phase"))


@query(f"""WITH {EV}, c AS (SELECT case_id, min(s) AS t0, max(e) - min(s) + 1 AS n FROM ev GROUP BY 1) SELECT event_id, (s - t0) * 20 // 30 AS at_start, least((e - t0) * 20 // 30, n * 20 // 30 - 1) AS at_end FROM ev JOIN c USING (case_id)""")
def math10_resample(spark, sf_dir):
    ev = spans(spark, sf_dir)
    c = ev.groupBy("case_id").agg(F.min("s").alias("t0"), (F.max("e") - F.min("s") + 1).alias("n"))
    return ev.join(c, "case_id").selectExpr("event_id", "(s - t0) * 20 div 30 AS at_start", "least((e - t0) * 20 div 30, n * 20 div 30 - 1) AS at_end")
