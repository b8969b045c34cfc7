"""Sorts, limits, splits, selections and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import selection as C
from ..registry import query
from ..sources.adapters import BASKET, EV, baskets, spans, table


@query("SELECT p_brand, p_type, p_size, p_partkey, row_number() OVER (ORDER BY p_brand DESC, p_type, p_size DESC, p_partkey) AS place FROM part")
def sort01_multi_key_sort(spark, sf_dir):
    order = [F.desc("p_brand"), F.asc("p_type"), F.desc("p_size"), F.asc("p_partkey")]
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_partkey")
    return C.numbered(part, order).orderBy(*order)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort02_global_top(spark, sf_dir):
    return M.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, [], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(f"WITH {EV} SELECT case_id, channel, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY case_id, channel ORDER BY value DESC, event_id) <= 3")
def sort03_group_top(spark, sf_dir):
    return M.top(spans(spark, sf_dir), 3, ["case_id", "channel"], F.desc("value"), F.asc("event_id")).select("case_id", "channel", "event_id", "value")


@query(f"WITH {EV}, f AS (SELECT channel, case_id, min(event_id) AS seen FROM ev GROUP BY ALL) SELECT channel, case_id, seen FROM f QUALIFY row_number() OVER (PARTITION BY channel ORDER BY seen) <= 8")
def sort04_first_distinct(spark, sf_dir):
    first = spans(spark, sf_dir).groupBy("channel", "case_id").agg(F.min("event_id").alias("seen"))
    return M.top(first, 8, ["channel"], F.asc("seen"))


@query("""WITH g AS (SELECT DISTINCT c_mktsegment AS bucket, c_nationkey AS grp FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY sha1('42:' || grp), grp) AS k FROM g)
SELECT bucket, grp, CASE WHEN n > 1 AND k <= greatest((n * 20 + 99) // 100, 1) THEN 'test' ELSE 'train' END AS split FROM r""")
def sort05_hash_split(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("bucket"), F.col("c_nationkey").alias("grp")).distinct()
    return C.hash_split(g, "bucket", "grp", 20, "42")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN k <= n // 10 THEN 'test' WHEN k <= n // 5 THEN 'valid' ELSE 'train' END AS split FROM r""")
def sort06_seeded_shuffle_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string")).cast("binary")).alias("key"))
    n = c.count()
    split = F.element_at(F.array(*map(F.lit, ("test", "valid", "train"))), F.col("part") + 1)
    return C.cut_ranks(c, "key", ["c_custkey"], [n // 10, n // 5]).select("c_custkey", split.alias("split"))


@query()
def sort07_greedy_diverse(spark, sf_dir):
    ev = spans(spark, sf_dir).groupBy("case_id").agg(F.collect_set(F.concat_ws(":", "channel", F.floor(F.col("value") / 40).cast("string"))).alias("tags"), F.sum(F.lit(1.0)).alias("weight"))
    chosen = C.greedy_diverse(ev, 5)
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(chosen)], "step int, case_id long")


@query("""WITH p AS (SELECT p_partkey AS case_id, p_name AS base, p_type AS category, p_retailprice AS score FROM part), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY base ORDER BY score DESC, case_id) = 1),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY score DESC, case_id) <= CASE category WHEN 'ECONOMY' THEN 5 WHEN 'PROMO' THEN 3 ELSE 0 END THEN 'quota' ELSE 'fill' END AS kind FROM f)
SELECT case_id, base, category, score, kind FROM r ORDER BY kind = 'quota' DESC, score DESC, case_id LIMIT 12""")
def sort08_quota_selection(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("base"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("score"))
    return C.greedy_quota(pool, {"ECONOMY": 5, "PROMO": 3}, 12)


@query()
def sort09_diverse_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("base"), F.col("p_type").alias("tag"), F.col("p_retailprice").alias("price"))
    return C.diverse(rows, "p_brand", 6, F.desc("price"), F.asc("id"))


@query()
def sort10_capped_dedupe(spark, sf_dir):
    rows = spans(spark, sf_dir).select("case_id", F.col("channel").alias("family"), F.floor(F.col("s") / 24).alias("s"), F.floor(F.col("e") / 24).alias("e"), F.floor(F.col("value") / 50).alias("level"), F.col("value").alias("score"), F.col("event_id").alias("id"))
    return C.capped(rows, "case_id", 2, 4, 10)


@query("""WITH s AS (SELECT doc_id, source, n_chars, 0.5 * least(n_chars / 5000, 1) + CASE lang WHEN 'en' THEN 0.3 ELSE 0.1 END AS score FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, doc_id) AS n FROM s)
SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.5 AND n <= 10 THEN 'selected' WHEN score >= 0.5 THEN 'over_cap' WHEN score >= 0.35 THEN 'deferred' ELSE 'rejected' END AS verdict FROM k""")
def sort11_score_screening(spark, sf_dir):
    score = 0.5 * F.least(F.col("n_chars") / 5000, F.lit(1.0)) + F.when(F.col("lang") == "en", 0.3).otherwise(0.1)
    own = table(spark, sf_dir, "documents").select("doc_id", "source", score.alias("score"))
    # The best ten of a source by a limit for each group, which tasks apply before they send rows; all others are told by their score alone.
    first = M.top(own.where("score >= 0.5"), 10, ["source"], F.desc(F.round("score", 6)), F.asc("doc_id")).select("doc_id", F.lit(True).alias("first"))
    verdict = F.when(F.col("first"), "selected").when(F.col("score") >= 0.5, "over_cap").when(F.col("score") >= 0.35, "deferred").otherwise("rejected")
    return own.join(first, "doc_id", "left").select("doc_id", F.round("score", 6).alias("score"), verdict.alias("verdict"))


@query("""WITH t AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS words, length(text) AS salience FROM conversations), u AS (SELECT *, sum(words) OVER (PARTITION BY conv_id ORDER BY salience DESC, turn ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (upto <= 120) AS kept FROM u GROUP BY 1""")
def sort12_budget_trim(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.length("text").alias("salience"), F.col("turn").alias("pos"), F.size(F.split("text", " ")).alias("words"))).alias("rows"))
    kept = F.array_join(F.transform(C.trimmed(F.col("rows"), 120), lambda x: x["pos"].cast("string")), ",")
    return rows.select("conv_id", F.nullif(kept, F.lit("")).alias("kept"))


@query()
def sort13_representatives(spark, sf_dir):
    ev = spans(spark, sf_dir).withColumn("tag", F.floor(F.col("value") / 40).cast("string"))
    c = ev.groupBy("channel", "case_id", "tag").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("channel", "case_id")))
    rows = c.select("channel", F.col("case_id").alias("id"), (F.col("case_id") % 20).cast("string").alias("base"), "tag", "share", "n")
    return C.diverse(rows, "channel", 8, F.desc("share"), F.desc("n"), F.asc("id"), F.asc("tag"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), u AS (SELECT o_orderkey, 0 AS rule FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 1 FROM r WHERE n <= 2)
SELECT o_orderkey, CASE min(rule) WHEN 0 THEN 'forced' ELSE 'capped' END AS why FROM u GROUP BY 1""")
def sort14_forced_include(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    forced = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(0).alias("rule"))
    some = M.top(o.select("o_orderkey", "o_custkey", "o_totalprice"), 2, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", F.lit(1).alias("rule"))
    return forced.unionByName(some).groupBy("o_orderkey").agg(F.when(F.min("rule") == 0, "forced").otherwise("capped").alias("why"))


@query(f"WITH {BASKET}, l AS (SELECT tx, count(*) AS n, max(case_id) AS case_id FROM basket GROUP BY 1) SELECT tx, n FROM l WHERE n >= 4 ORDER BY n DESC, case_id, tx LIMIT 50")
def sort15_complete_sample(spark, sf_dir):
    lists = baskets(spark, sf_dir).groupBy("tx").agg(F.collect_set("item").alias("items"), F.max("case_id").alias("case_id")).where(F.size("items") >= 4)
    return M.top(lists.select("tx", F.size("items").cast("long").alias("n"), "case_id"), 50, [], F.desc("n"), F.asc("case_id"), F.asc("tx")).select("tx", "n")


@query("""WITH t AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM documents WHERE n_chars > 1500)
SELECT 'tp' AS side, doc_id FROM (SELECT * FROM t INTERSECT SELECT * FROM p) UNION ALL SELECT 'fn', doc_id FROM (SELECT * FROM t EXCEPT SELECT * FROM p)""")
def set01_case_sets(spark, sf_dir):
    t = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    p = table(spark, sf_dir, "documents").where("n_chars > 1500").select("doc_id")
    return t.intersect(p).select(F.lit("tp").alias("side"), "doc_id").unionByName(t.subtract(p).select(F.lit("fn").alias("side"), "doc_id"))


@query("""SELECT c_custkey AS id, 'customer' AS origin, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, NULL FROM supplier""")
def set02_union_with_provenance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1")
def set03_composite_dedupe(spark, sf_dir):
    return M.top(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey"), 1, ["p_brand", "p_type"], F.asc("p_partkey"))


@query(f"WITH {EV} SELECT case_id, channel, s // 8 AS s8, e // 8 AS e8, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY case_id, channel, s // 8, e // 8 ORDER BY event_id) = 1")
def set04_quantized_dedupe(spark, sf_dir):
    q = spans(spark, sf_dir).select("case_id", "channel", F.expr("s div 8").alias("s8"), F.expr("e div 8").alias("e8"), "event_id")
    return M.top(q, 1, ["case_id", "channel", "s8", "e8"], F.asc("event_id"))


@query(f"""WITH {EV}, g AS (SELECT case_id, list_sort(list(DISTINCT channel)) AS items FROM ev GROUP BY case_id, s // 24), k AS (SELECT items, count(*) AS support FROM g GROUP BY 1)
SELECT array_to_string(a.items, '+') AS items, a.support, EXISTS (SELECT 1 FROM k b WHERE len(b.items) > len(a.items) AND list_has_all(b.items, a.items) AND b.support >= 0.75 * a.support) AS hidden FROM k a""")
def set05_subset_closure(spark, sf_dir):
    g = spans(spark, sf_dir).groupBy("case_id", F.expr("s div 24")).agg(F.array_sort(F.collect_set("channel")).alias("items"))
    k = g.groupBy("items").agg(F.count("*").alias("support"))
    # A subset shares its first item with each superset's list: that is the join key.
    over = k.select(F.col("items").alias("more"), F.col("support").alias("s2"), F.explode("items").alias("item"))
    pairs = k.withColumn("item", F.col("items")[0]).join(over, "item").where((F.size("more") > F.size("items")) & (F.size(F.array_except("items", "more")) == 0) & (F.col("s2") >= 0.75 * F.col("support")))
    hidden = pairs.select("items").distinct().withColumn("hidden", F.lit(True))
    return k.join(hidden, "items", "left").select(F.array_join("items", "+").alias("items"), "support", F.coalesce("hidden", F.lit(False)).alias("hidden"))


@query(f"""WITH {BASKET}, x AS (SELECT case_id, list(DISTINCT item) AS explained FROM basket WHERE tx % 2 = 0 GROUP BY 1), f AS (SELECT tx, case_id, list(item) AS src FROM basket WHERE tx % 2 = 1 GROUP BY ALL)
SELECT tx FROM f LEFT JOIN x USING (case_id) WHERE explained IS NULL OR NOT list_has_all(explained, src)""")
def set06_contained_removal(spark, sf_dir):
    b = baskets(spark, sf_dir)
    explained = b.where("tx % 2 = 0").groupBy("case_id").agg(F.collect_set("item").alias("explained"))
    fallback = b.where("tx % 2 = 1").groupBy("tx", "case_id").agg(F.collect_list("item").alias("src"))
    return fallback.join(explained, "case_id", "left").where(F.col("explained").isNull() | (F.size(F.array_except("src", "explained")) > 0)).select("tx")
