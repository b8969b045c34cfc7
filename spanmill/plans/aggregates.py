"""Support, shares, summaries, confusion and association metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..registry import query
from ..sources.adapters import BASKET, CAP, EV, FR, baskets, captions, frames, spans, table

WORDS = f"""{CAP}, wd AS (SELECT case_id, node, unnest(list_distinct(list_filter(string_split_regex(lower(caption), '[^a-z]+'), lambda x: x <> ''))) AS word FROM cap)"""


def words(spark, sf_dir):
    """(case_id, node, word): the distinct words of each caption."""
    split = F.array_distinct(F.filter(F.split(F.lower("caption"), "[^a-z]+"), lambda x: x != ""))
    return captions(spark, sf_dir).select("case_id", "node", F.explode(split).alias("word"))


@query(f"WITH {EV} SELECT channel, count(*) AS n, count(DISTINCT case_id) AS cases FROM ev GROUP BY 1")
def agg01_support(spark, sf_dir):
    return M.support(spans(spark, sf_dir), "channel")


@query(f"WITH {BASKET}, c AS (SELECT item, count(*) AS n FROM basket GROUP BY 1) SELECT * FROM c ORDER BY n DESC, item LIMIT 10")
def agg02_top_counter(spark, sf_dir):
    return M.top(baskets(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n")), 10, [], F.desc("n"), F.asc("item"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def agg03_list_histogram(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT DISTINCT o_custkey, o_orderpriority AS alias FROM orders), c AS (SELECT c_custkey, coalesce(alias, '__NONE__') AS alias FROM customer LEFT JOIN v ON c_custkey = o_custkey)
SELECT alias, count(*) AS cases FROM c GROUP BY 1""")
def agg04_per_case_vote(spark, sf_dir):
    votes = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("alias")).distinct()
    cases = table(spark, sf_dir, "customer").join(votes, F.col("c_custkey") == F.col("o_custkey"), "left")
    return cases.groupBy(F.coalesce("alias", F.lit("__NONE__")).alias("alias")).agg(F.count("*").alias("cases"))


@query(f"""WITH {EV}, c AS (SELECT case_id, channel, count(*) AS n FROM ev GROUP BY ALL)
SELECT case_id, max_by(channel, (n, channel)) AS dominant, max(n) / sum(n) AS purity, max(n) / 20 AS coverage FROM c GROUP BY 1""")
def agg05_purity_coverage(spark, sf_dir):
    c = spans(spark, sf_dir).groupBy("case_id", "channel").agg(F.count("*").alias("n"))
    return c.groupBy("case_id").agg(F.max_by("channel", F.struct("n", "channel")).alias("dominant"), (F.max("n") / F.sum("n")).alias("purity"), (F.max("n") / 20).alias("coverage"))


@query(f"""WITH {EV} SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, round(max(value) - min(value), 6) AS span FROM ev GROUP BY 1""")
def agg06_summary(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("channel").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


@query(f"""WITH {EV} SELECT channel, {', '.join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))} FROM ev GROUP BY 1""")
def agg07_percentiles(spark, sf_dir):
    asked = (10, 25, 50, 75, 90)
    found = M.percentiles(spans(spark, sf_dir), ["channel"], "value", [p / 100 for p in asked])
    return found.select("channel", *[F.round(f"p{k}", 6).alias(f"p{p}") for k, p in enumerate(asked, 1)])


@query(f"""WITH {EV}, z AS (SELECT channel, avg(value) AS m, CASE WHEN stddev_pop(value) <= 1e-6 THEN 1.0 ELSE stddev_pop(value) END AS sd FROM ev GROUP BY 1)
SELECT event_id, round((value - m) / sd, 6) AS z FROM ev JOIN z USING (channel)""")
def agg08_feature_scale(spark, sf_dir):
    ev = spans(spark, sf_dir)
    scale = ev.groupBy("channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    scale = scale.withColumn("sd", F.when(F.col("sd") <= 1e-6, 1.0).otherwise(F.col("sd")))
    return ev.join(scale, "channel").select("event_id", F.round((F.col("value") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("""WITH q AS (SELECT quantile_cont(CAST(p_size AS DOUBLE), 0.75) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part) SELECT p_partkey FROM part, q WHERE p_size <= a AND p_retailprice <= b""")
def agg09_quantile_gate(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    gate = M.percentiles(part, [], "p_size", [0.75]).withColumnRenamed("p1", "a").crossJoin(M.percentiles(part, [], "p_retailprice", [0.75]).withColumnRenamed("p1", "b"))  # one row
    return part.join(F.broadcast(gate)).where("p_size <= a AND p_retailprice <= b").select("p_partkey")  # the gate is one row


@query(f"""WITH {EV}, g AS (SELECT channel, case_id, min(event_id) AS event_id FROM ev GROUP BY ALL), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY channel ORDER BY event_id) <= 5)
SELECT channel, string_agg(event_id, ',' ORDER BY event_id) AS samples FROM f GROUP BY 1""")
def agg10_sample_collection(spark, sf_dir):
    first = spans(spark, sf_dir).groupBy("channel", "case_id").agg(F.min("event_id").alias("event_id"))
    some = M.top(first, 5, ["channel"], F.asc("event_id"))
    return some.groupBy("channel").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("samples"))


@query(f"""WITH {BASKET}, v AS (SELECT case_id, tx, count(*) AS n FROM basket GROUP BY ALL)
SELECT b.case_id, array_to_string(list_sort(list_distinct(list(item))), '|') AS items, max(n) AS most, count(*) AS total FROM basket b JOIN v USING (case_id, tx) GROUP BY 1""")
def agg11_union_max_merge(spark, sf_dir):
    lists = baskets(spark, sf_dir, "case_id").groupBy("case_id", "tx").agg(F.collect_set("item").alias("own"), F.count("*").alias("n"))
    merged = lists.groupBy("case_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))), "|").alias("items"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return merged


@query(f"""WITH {EV}, c AS (SELECT case_id, channel, count(*) AS n FROM ev GROUP BY ALL) SELECT case_id % 7 AS family, channel AS id, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL""")
def agg12_counter_sum(spark, sf_dir):
    counters = spans(spark, sf_dir).groupBy("case_id", "channel").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.collect_list(F.struct(F.col("channel").alias("id"), "n")).alias("counts"))
    return counters.select((F.col("case_id") % 7).alias("family"), F.inline("counts")).groupBy("family", "id").agg(F.sum("n").alias("total"))


@query(f"""WITH {BASKET}, c AS (SELECT case_id, item, count(*) AS n FROM basket GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY case_id) AS most FROM c)
SELECT case_id, item, n FROM m WHERE n >= 0.6 * most QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, item) <= 4""")
def agg13_stable_ids(spark, sf_dir):
    c = baskets(spark, sf_dir, "case_id").groupBy("case_id", "item").agg(F.count("*").alias("n"))
    kept = c.withColumn("most", F.max("n").over(Window.partitionBy("case_id"))).where("n >= 0.6 * most").drop("most")
    return M.top(kept, 4, ["case_id"], F.desc("n"), F.asc("item"))


@query(f"""WITH {EV}, g AS (SELECT case_id, string_agg(DISTINCT channel, '+' ORDER BY channel) AS signature FROM ev GROUP BY case_id, s // 24) SELECT signature, count(*) AS cases FROM g GROUP BY 1""")
def agg14_signature_groups(spark, sf_dir):
    g = spans(spark, sf_dir).groupBy("case_id", F.expr("s div 24")).agg(F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("signature"))
    return g.groupBy("signature").agg(F.count("*").alias("cases"))


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")
def agg15_status_counters(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("agg15_orders")
    return spark.sql("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM agg15_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")


@query("""SELECT source AS family, lang AS slot, CAST(sum(CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS present, count(*) AS required, CAST(sum(CASE WHEN n_chars >= 500 THEN 0 ELSE 1 END) AS BIGINT) AS missing FROM documents GROUP BY ALL""")
def agg16_slot_coverage(spark, sf_dir):
    have = (F.col("n_chars") >= 500).cast("int")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("family"), F.col("lang").alias("slot")).agg(F.sum(have).alias("present"), F.count("*").alias("required"), F.sum(1 - have).alias("missing"))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean FROM c""")
def agg17_per_case_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return c.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"))


@query(f"""WITH {EV}, c AS (SELECT case_id, channel, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT case_id, n / sum(n) OVER (PARTITION BY case_id) AS p FROM c) SELECT case_id, round(-sum(p * log2(p + 1e-12)), 6) AS entropy FROM p GROUP BY 1""")
def agg18_entropy(spark, sf_dir):
    c = spans(spark, sf_dir).groupBy("case_id", "channel").agg(F.count("*").alias("n"))
    return M.entropy(c, "case_id", "n").select("case_id", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {FR} SELECT case_id, CASE WHEN count(*) < 3 OR stddev_pop(frame) < 1e-6 OR stddev_pop(value) < 1e-6 THEN 0.0 ELSE round(corr(frame, value), 6) END AS r FROM fr GROUP BY 1""")
def agg19_correlation(spark, sf_dir):
    weak = (F.count("*") < 3) | (F.stddev_pop("frame") < 1e-6) | (F.stddev_pop("value") < 1e-6)
    return frames(spark, sf_dir).groupBy("case_id").agg(F.when(weak, 0.0).otherwise(F.round(F.corr("frame", "value"), 6)).alias("r"))


CONFUSION = """tp AS (SELECT count(*) AS tp FROM (SELECT case_id FROM t INTERSECT SELECT case_id FROM p)), fp AS (SELECT count(*) AS fp FROM (SELECT case_id FROM p EXCEPT SELECT case_id FROM t)),
fn AS (SELECT count(*) AS fn FROM (SELECT case_id FROM t EXCEPT SELECT case_id FROM p)), c AS (SELECT tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM tp, fp, fn)
SELECT tp, fp, fn, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c"""


@query(f"""WITH t AS (SELECT doc_id AS case_id FROM labels WHERE toxic = 1), p AS (SELECT doc_id AS case_id FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(lower(text), 'idiot|stupid|scum')), {CONFUSION}""")
def agg20_confusion(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    texts = table(spark, sf_dir, "documents").join(labels, "doc_id").where(F.lower("text").rlike("idiot|stupid|scum"))
    return M.confusion(labels.where("toxic = 1").select(F.col("doc_id").alias("case_id")), texts.select(F.col("doc_id").alias("case_id")))


LIFT = f"""{WORDS}, total AS (SELECT count(*) AS cases FROM cap), nc AS (SELECT node, count(*) AS nodes FROM cap GROUP BY 1), wc AS (SELECT word, count(*) AS with_word FROM wd GROUP BY 1),
b AS (SELECT node, word, count(*) AS both_n FROM wd GROUP BY ALL HAVING count(*) >= 8),
r AS (SELECT node, word, both_n, both_n / with_word AS precision, both_n / nodes AS recall, both_n / (with_word + nodes - both_n) AS jaccard, (both_n / nodes) / (with_word / cases) AS lift, with_word, nodes FROM b JOIN nc USING (node) JOIN wc USING (word), total)"""


def association(spark, sf_dir):
    """Node and word pairs in 8 captions at least, with precision, recall, Jaccard and lift."""
    cap, wd = captions(spark, sf_dir), words(spark, sf_dir)
    both = wd.groupBy("node", "word").agg(F.count("*").alias("both_n")).where("both_n >= 8")
    nodes = cap.groupBy("node").agg(F.count("*").alias("nodes"))
    held = wd.groupBy("word").agg(F.count("*").alias("with_word"))
    total = cap.agg(F.count("*").alias("cases"))
    joined = both.join(nodes, "node").join(held, "word").join(F.broadcast(total))  # one row
    b, w, n = F.col("both_n"), F.col("with_word"), F.col("nodes")
    return joined.select("node", "word", "both_n", (b / w).alias("precision"), (b / n).alias("recall"), (b / (w + n - b)).alias("jaccard"), ((b / n) / (w / F.col("cases"))).alias("lift"), "with_word", "nodes")


@query(f"""WITH {LIFT} SELECT node, word, round(0.35 * precision + 0.30 * recall + 0.20 * jaccard + 0.10 * least(greatest(log2(greatest(lift, 1e-9)) / 3, 0), 1) + 0.05 * least(ln(1 + both_n) / ln(101), 1), 6) AS score,
CASE WHEN lift >= 1.2 AND recall >= 0.5 THEN 'named' WHEN lift >= 1.1 THEN 'weak' ELSE 'generic' END AS status FROM r""")
def agg21_name_score(spark, sf_dir):
    a = association(spark, sf_dir)
    score = M.name_score(*[F.col(c) for c in ("precision", "recall", "jaccard", "lift", "both_n")])
    status = F.when((F.col("lift") >= 1.2) & (F.col("recall") >= 0.5), "named").when(F.col("lift") >= 1.1, "weak").otherwise("generic")
    return a.select("node", "word", F.round(score, 6).alias("score"), status.alias("status"))


@query(f"""WITH {LIFT} SELECT node, word, round(2 * precision * recall / (precision + recall) * both_n * ln(1 + lift), 6) AS score FROM r""")
def agg22_harmonic_score(spark, sf_dir):
    harmonic = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return association(spark, sf_dir).select("node", "word", F.round(harmonic * F.col("both_n") * F.log1p("lift"), 6).alias("score"))


@query(f"""WITH {FR}, d AS (SELECT case_id, abs(value - lag(value) OVER (PARTITION BY case_id ORDER BY frame)) AS v, frame FROM fr),
r AS (SELECT case_id, avg(v) FILTER (frame >= 20) / avg(v) FILTER (frame < 20) AS ratio FROM d GROUP BY 1)
SELECT case_id, round(ratio, 6) AS ratio, concat_ws(',', CASE WHEN ratio < 0.5 THEN 'frozen' END, CASE WHEN ratio > 2 THEN 'jumpy' END, CASE WHEN ratio BETWEEN 0.8 AND 1.25 THEN 'matched' END) AS flags FROM r WHERE ratio IS NOT NULL""")
def agg23_ratio_flags(spark, sf_dir):
    d = frames(spark, sf_dir).withColumn("v", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("case_id").orderBy("frame"))))
    r = d.groupBy("case_id").agg((F.avg(F.when(F.col("frame") >= 20, F.col("v"))) / F.avg(F.when(F.col("frame") < 20, F.col("v")))).alias("ratio")).where("ratio IS NOT NULL")
    flags = F.array_compact(F.array(F.when(F.col("ratio") < 0.5, "frozen"), F.when(F.col("ratio") > 2, "jumpy"), F.when(F.col("ratio").between(0.8, 1.25), "matched")))
    return r.select("case_id", F.round("ratio", 6).alias("ratio"), F.array_join(flags, ",").alias("flags"))


@query("""SELECT source, bool_and(n_chars > 0 AND lang IN ('en', 'de', 'fr', 'es') AND n_chars <= 20000) AS passed, count(*) FILTER (n_chars > 20000) AS issues FROM documents GROUP BY 1""")
def agg24_contract_verdict(spark, sf_dir):
    ok = (F.col("n_chars") > 0) & F.col("lang").isin("en", "de", "fr", "es") & (F.col("n_chars") <= 20000)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.bool_and(ok).alias("passed"), F.count_if(F.col("n_chars") > 20000).alias("issues"))


@query(f"""WITH {EV}, tr AS (SELECT * FROM ev WHERE event_id % 5 <> 0 AND NOT (channel = 'error' AND case_id % 3 = 0)), m AS (SELECT case_id, channel, avg(value) AS own FROM tr GROUP BY ALL), g AS (SELECT avg(value) AS mean FROM tr)
SELECT event_id, round(coalesce(own, mean), 6) AS predicted, own IS NULL AS unseen FROM ev LEFT JOIN m USING (case_id, channel), g WHERE event_id % 5 = 0""")
def agg25_group_mean_baseline(spark, sf_dir):
    ev = spans(spark, sf_dir)
    train = ev.where("event_id % 5 != 0 AND NOT (channel = 'error' AND case_id % 3 = 0)")
    own, mean = train.groupBy("case_id", "channel").agg(F.avg("value").alias("own")), train.agg(F.avg("value").alias("mean"))
    joined = ev.where("event_id % 5 = 0").join(own, ["case_id", "channel"], "left").join(F.broadcast(mean))  # one row
    return joined.select("event_id", F.round(F.coalesce("own", "mean"), 6).alias("predicted"), F.col("own").isNull().alias("unseen"))


@query("""SELECT c_mktsegment AS segment, count(*) FILTER (n_regionkey = 0) AS r0, count(*) FILTER (n_regionkey = 1) AS r1, count(*) FILTER (n_regionkey = 2) AS r2, count(*) FILTER (n_regionkey = 3) AS r3, count(*) FILTER (n_regionkey = 4) AS r4
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def agg26_crosstab(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = joined.groupBy(F.col("c_mktsegment").alias("segment")).pivot("n_regionkey", [0, 1, 2, 3, 4]).count().fillna(0)
    return cells.select("segment", *[F.col(str(k)).alias(f"r{k}") for k in range(5)])


@query(f"""WITH {EV}, a AS (SELECT case_id || ':' || channel AS metric, count(*) AS x FROM ev WHERE s % 24 < 12 GROUP BY 1), b AS (SELECT case_id || ':' || channel AS metric, count(*) AS y FROM ev WHERE s % 24 >= 12 GROUP BY 1)
SELECT metric, coalesce(x, 0) AS before_n, coalesce(y, 0) AS after_n, coalesce(y, 0) - coalesce(x, 0) AS delta FROM a FULL JOIN b USING (metric)""")
def agg27_run_delta(spark, sf_dir):
    """The counts of two runs, mornings and the rest, metric by metric: one aggregate holds both, so nothing is joined."""
    metric = F.concat(F.col("case_id").cast("string"), F.lit(":"), F.col("channel"))
    both = spans(spark, sf_dir).groupBy(metric.alias("metric")).agg(F.count_if(F.expr("s % 24 < 12")).alias("before_n"), F.count_if(F.expr("s % 24 >= 12")).alias("after_n"))
    return both.withColumn("delta", F.col("after_n") - F.col("before_n"))


@query(f"""WITH {BASKET}, c AS (SELECT item, count(*) AS n, count(DISTINCT case_id) AS cases FROM basket GROUP BY 1) SELECT item, n, n / sum(n) OVER () AS share, cases, cases / (SELECT count(DISTINCT case_id) FROM basket) AS case_share FROM c ORDER BY n DESC, item LIMIT 12""")
def agg28_percent_of_total(spark, sf_dir):
    b = baskets(spark, sf_dir, "case_id")
    total = b.agg(F.count("*").alias("all_n"), F.countDistinct("case_id").alias("all_cases"))
    c = M.support(b, "item").join(F.broadcast(total))  # one row
    out = c.select("item", "n", (F.col("n") / F.col("all_n")).alias("share"), "cases", (F.col("cases") / F.col("all_cases")).alias("case_share"))
    return M.top(out, 12, [], F.desc("n"), F.asc("item"))


@query("""SELECT source, count(*) FILTER (contains(lower(text), 'license') OR contains(lower(text), 'copyright')) / count(*) AS legal, count(*) FILTER (contains(text, '@') OR contains(text, '555-')) / count(*) AS contact FROM documents GROUP BY 1""")
def agg29_keyword_share(spark, sf_dir):
    groups = {"legal": (F.lower("text"), ("license", "copyright")), "contact": (F.col("text"), ("@", "555-"))}
    shares = [(F.count_if(keys_hit(col, keys)) / F.count("*")).alias(name) for name, (col, keys) in groups.items()]
    return table(spark, sf_dir, "documents").groupBy("source").agg(*shares)


def keys_hit(text, keys):
    """Whether any key occurs in the text."""
    hit = F.lit(False)
    for k in keys:
        hit = hit | text.contains(k)
    return hit


@query("""SELECT p_brand AS brand, round(sum(p_retailprice * p_size) / greatest(1, sum(p_size)), 6) AS mean FROM part GROUP BY 1""")
def agg30_weighted_mean(spark, sf_dir):
    mean = F.sum(F.col("p_retailprice") * F.col("p_size")) / F.greatest(F.lit(1), F.sum("p_size"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.round(mean, 6).alias("mean"))


@query(f"""WITH {BASKET}, c AS (SELECT length(item) AS family, item, count(DISTINCT case_id) AS cases FROM basket GROUP BY ALL), d AS (SELECT family, CAST(sum(cases) AS BIGINT) AS summed FROM c GROUP BY 1)
SELECT family, covered, summed FROM (SELECT length(item) AS family, count(DISTINCT case_id) AS covered FROM basket GROUP BY 1) JOIN d USING (family)""")
def agg31_union_versus_sum(spark, sf_dir):
    b = baskets(spark, sf_dir).withColumn("family", F.length("item").cast("long"))
    each = b.groupBy("family", "item").agg(F.countDistinct("case_id").alias("cases")).groupBy("family").agg(F.sum("cases").alias("summed"))
    return b.groupBy("family").agg(F.countDistinct("case_id").alias("covered")).join(each, "family")


@query(f"""WITH {LIFT}, k AS (SELECT * FROM r WHERE precision >= 0.06 AND lift >= 1.05 QUALIFY row_number() OVER (PARTITION BY node ORDER BY lift DESC, both_n DESC, word) <= 10)
SELECT node, word, both_n, round(precision, 6) AS precision, round(lift, 6) AS lift FROM k""")
def agg32_association_report(spark, sf_dir):
    kept = M.top(association(spark, sf_dir).where("precision >= 0.06 AND lift >= 1.05"), 10, ["node"], F.desc("lift"), F.desc("both_n"), F.asc("word"))
    return kept.select("node", "word", "both_n", F.round("precision", 6).alias("precision"), F.round("lift", 6).alias("lift"))


@query(f"""WITH {FR}, d AS (SELECT case_id, frame, abs(value - lag(value) OVER (PARTITION BY case_id ORDER BY frame)) AS v FROM fr),
a AS (SELECT case_id, avg(v) FILTER (frame >= 30) AS late, avg(v) FILTER (frame < 30) AS early, list(v ORDER BY v) FILTER (v IS NOT NULL) AS l FROM d GROUP BY 1)
SELECT case_id, round(late / nullif(early, 0), 6) AS ratio, round(l[len(l) // 2 + 1], 6) AS upper_median, late <= greatest(5, 0.5 * early) AS frozen FROM a""")
def agg33_masked_ratio(spark, sf_dir):
    d = frames(spark, sf_dir).withColumn("v", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("case_id").orderBy("frame"))))
    late, early = F.avg(F.when(F.col("frame") >= 30, F.col("v"))), F.avg(F.when(F.col("frame") < 30, F.col("v")))
    a = d.groupBy("case_id").agg(late.alias("late"), early.alias("early"), F.array_sort(F.collect_list("v")).alias("l"))
    middle = F.try_element_at("l", F.floor(F.size("l") / 2).cast("int") + 1)
    return a.select("case_id", F.round(F.try_divide(F.col("late"), F.col("early")), 6).alias("ratio"), F.round(middle, 6).alias("upper_median"), (F.col("late") <= F.greatest(F.lit(5.0), 0.5 * F.col("early"))).alias("frozen"))
