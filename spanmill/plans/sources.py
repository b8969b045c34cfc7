"""Sources, sinks, caches and data-driven functions."""

from __future__ import annotations

import io
import json
import zipfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..operators import joints as J
from ..operators import signals as G
from ..registry import query
from ..sources import files as K
from ..sources.adapters import EV, FR, frames, joint_frames, spans, table
from ..sources.store import new_folder


@query("""WITH k AS (SELECT label AS case_id, unnest(generate_series(1, 63)) AS k, embedding FROM embeddings)
SELECT case_id, CAST((k - 1) // 3 AS INTEGER) AS joint, CAST((k - 1) % 3 AS INTEGER) AS axis, count(*) AS frames, round(avg(CAST(embedding[k] AS DOUBLE)), 5) AS mean FROM k GROUP BY ALL""")
def src02_packed_joints(spark, sf_dir):
    """Vectors as frames of 21 joints of three coordinates: the mean of every coordinate, in one aggregate without a row for each."""
    joints = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.slice("embedding", k * 3 + 1, 3))
    packed = table(spark, sf_dir, "embeddings").select(F.col("label").alias("case_id"), joints.alias("joints"))
    each = [(j, a) for j in range(21) for a in range(3)]
    means = packed.groupBy("case_id").agg(F.count("*").alias("frames"), *[F.avg(F.col("joints")[j][a].cast("double")).alias(f"m{j}_{a}") for j, a in each])
    rows = F.array(*[F.struct(F.lit(j).alias("joint"), F.lit(a).alias("axis"), F.round(f"m{j}_{a}", 5).alias("mean")) for j, a in each])
    return means.select("case_id", "frames", F.inline(rows))


EVENT = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()))])


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 500")
def src03_jsonl_scan(spark, sf_dir):
    path = new_folder(spark, "jsonl")
    K.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return K.read_jsonl(spark, path, EVENT, 500, ["event_id"]).drop(K.CORRUPT)


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def src04_jsonl_sink(spark, sf_dir):
    path = new_folder(spark, "jsonl")
    K.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return K.read_jsonl(spark, path, EVENT).where(F.col(K.CORRUPT).isNull()).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


ENDINGS = ("_non_contact_sequences", "_contact_sequences", "_neutral_sequences", "")


@query("""SELECT CASE r_regionkey % 4 WHEN 0 THEN 'non_contact' WHEN 1 THEN 'contact' WHEN 2 THEN 'neutral' ELSE 'unknown' END AS bucket, (r_regionkey + 2) || 'x156' AS poses_shape, 'float32' AS poses_dtype, '10' AS betas_shape,
CAST(NULL AS VARCHAR) AS trans_shape, 'clip' || r_regionkey || (['_non_contact_sequences', '_contact_sequences', '_neutral_sequences', ''])[r_regionkey % 4 + 1] AS sequence_group, CAST(NULL AS VARCHAR) AS error FROM region
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'BadZipFile'""")
def src01_npz_scan(spark, sf_dir):
    """The manifest of files that the query writes: one for each region, and a broken one."""
    path = new_folder(spark, "npz")
    for r in table(spark, sf_dir, "region").collect():  # a handful of regions
        held = io.BytesIO()
        np.savez(held, poses=np.zeros((r.r_regionkey + 2, 156), np.float32), betas=np.zeros(10))
        K.write_bytes(f"{path}/clip{r.r_regionkey}{ENDINGS[r.r_regionkey % 4]}/a.npz", held.getvalue())
    K.write_bytes(f"{path}/broken/a.npz", b"no archive")
    return K.scan_bundles(spark, path).select("bucket", "poses_shape", "poses_dtype", "betas_shape", "trans_shape", "sequence_group", "error")


@query("SELECT 'n' || (n_nationkey // 10) || '.zip' AS archive, 'm/' || n_nationkey || '.txt' AS member, CAST(length(n_name) AS BIGINT) AS bytes FROM nation")
def src07_zip_members(spark, sf_dir):
    """The members of archives that the query writes: the nations' names, ten to an archive."""
    path, archives = new_folder(spark, "zip"), {}
    for n in table(spark, sf_dir, "nation").collect():  # 25 nations
        held = archives.setdefault(n.n_nationkey // 10, io.BytesIO())
        with zipfile.ZipFile(held, "a") as z:
            z.writestr(f"m/{n.n_nationkey}.txt", n.n_name)
    for k, held in archives.items():
        K.write_bytes(f"{path}/n{k}.zip", held.getvalue())
    return K.archive_members(spark, path).select(F.substring_index("archive", "/", -1).alias("archive"), "member", "bytes")


@query(f"""WITH {EV}, k AS (SELECT channel, count(*) AS n, sum(count(*)) OVER () AS total FROM ev GROUP BY 1) SELECT 'trade' AS axis, channel AS name, round(n / total, 6) AS weight FROM k""")
def src05_json_document(spark, sf_dir):
    """A rule document written from the events, one weight a channel, and read back as one document."""
    shares = spans(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"))
    groups = F.array_sort(F.collect_list(F.struct(F.col("channel").alias("name"), "n")))  # a row a channel
    total = F.aggregate("g", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    made = shares.agg(groups.alias("g")).select(F.struct(F.lit("trade").alias("axis"), F.lit(0.5).alias("min_score"), F.transform("g", lambda x: F.struct(x["name"].alias("name"), F.round(x["n"] / total, 6).alias("weight"))).alias("groups")).alias("doc"))
    path = new_folder(spark, "document")
    made.select(F.to_json("doc", {"pretty": "true"}).alias("value")).write.text(path)
    schema = T.StructType.fromDDL("axis string, min_score double, groups array<struct<name:string,weight:double>>")
    return K.read_document(spark, path, schema).select("axis", F.inline("groups"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def src06_csv_sink(spark, sf_dir):
    path = new_folder(spark, "csv")
    K.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return spark.read.option("header", True).schema("p_partkey bigint, p_name string, p_retailprice double").csv(path)


@query(r"SELECT trim(regexp_replace(text, '[\n#]', ' ', 'g')) AS caption, count(*) AS n FROM benchmark GROUP BY 1")
def src08_caption_source(spark, sf_dir):
    path = new_folder(spark, "captions")
    table(spark, sf_dir, "benchmark").select(F.concat(F.regexp_replace("text", "[\n#]", " "), F.lit("#"), F.col("item_id").cast("string"))).write.text(path)
    return K.read_captions(spark, path).groupBy("caption").agg(F.count("*").alias("n"))


@dataclass
class MinerConfig:
    """Settings of a miner as a flat file gives them."""

    theta: float = 0.3
    most: int = 6
    mode: str = "strict"


@query(f"WITH {EV} SELECT 'loose' AS mode, count(*) AS n FROM ev WHERE e - s + 1 <= 4")
def src09_flat_config(spark, sf_dir):
    """A flat configuration, read on the driver, as literal columns."""
    config = K.parse_flat_yaml("theta: 0.5\nmost: 4  # hours\nmode: loose", MinerConfig)
    return spans(spark, sf_dir).where(F.col("e") - F.col("s") + 1 <= config.most).agg(F.count("*").alias("n")).select(F.lit(config.mode).alias("mode"), "n")


@query("""SELECT 'subset_a/screen/' || regexp_replace(lower(event_type), '[^a-z0-9]+', '_', 'g') || '_' || CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS path, 'screen' AS stage, count(*) AS "rows" FROM events GROUP BY ALL""")
def src10_artifact_registry(spark, sf_dir):
    """Files written for each channel and split, entered one after another in the registry, which is read back."""
    registry = new_folder(spark, "registry")
    split = F.when(F.col("user_id") % 5 == 0, "test").otherwise("train")
    made = table(spark, sf_dir, "events").groupBy("event_type", split.alias("split")).agg(F.count("*").alias("n"))
    out = None
    for r in made.collect():  # a row for each artifact
        out = K.register(spark, registry, [{"path": K.artifact_path("", "Subset A", "screen", r.event_type, r.split).lstrip("/"), "stage": "screen", "rows": r.n}])
    return out.select("path", "stage", "rows")


@query("""WITH c AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)) SELECT * FROM (SELECT 1 AS turn, 'miss_built' AS status, n FROM c UNION ALL SELECT 2, 'hit', n FROM c UNION ALL SELECT 3, 'miss_built', n FROM c UNION ALL SELECT 4, 'disabled', n FROM c)""")
def src11_record_cache(spark, sf_dir):
    root = new_folder(spark, "cache")
    build = lambda: table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    out = []
    for turn, (config, on) in enumerate((({"v": 1}, True), ({"v": 1}, True), ({"v": 2}, True), ({"v": 2}, False)), 1):
        df, status = K.cached(spark, root, config, build, on)
        out.append((turn, status, df.count()))
    return spark.createDataFrame(out, "turn int, status string, n long")


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels), i AS (SELECT o_custkey AS id FROM orders GROUP BY 1)
SELECT count(*) AS wanted, count(i.id) AS with_motion, count(l.doc_id) AS with_text, count(*) FILTER (i.id IS NOT NULL AND l.doc_id IS NOT NULL) AS both_found FROM customer LEFT JOIN i ON c_custkey = i.id LEFT JOIN l ON c_custkey = l.doc_id""")
def src12_case_index(spark, sf_dir):
    motion = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    text = table(spark, sf_dir, "labels").select("doc_id").distinct()
    joined = table(spark, sf_dir, "customer").join(motion, F.col("c_custkey") == F.col("id"), "left").join(text, F.col("c_custkey") == F.col("doc_id"), "left")
    return joined.agg(F.count("*").alias("wanted"), F.count("id").alias("with_motion"), F.count("doc_id").alias("with_text"), F.count_if(F.col("id").isNotNull() & F.col("doc_id").isNotNull()).alias("both_found"))


@query(f"WITH {FR} SELECT case_id, count(*) AS frames, round(sum(value), 4) AS richness FROM fr GROUP BY 1 HAVING count(*) > 20 ORDER BY round(sum(value), 4) DESC, frames DESC, case_id LIMIT 40")
def src13_mining_corpus(spark, sf_dir):
    rich = frames(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("frames"), F.round(F.sum("value"), 4).alias("richness")).where("frames > 20")
    return rich.orderBy(F.desc("richness"), F.desc("frames"), "case_id").limit(40)


SPEC = '[["rush", {"all": [{"path": "channel", "op": "eq", "value": "purchase"}, {"path": "value", "op": "gt", "value": 80}]}], ["stall", {"path": "value", "op": "lte", "value": 3}]]'


@query(f"WITH {EV} SELECT event_id, CASE WHEN channel = 'purchase' AND value > 80 THEN 'rush' ELSE 'stall' END AS emitted FROM ev WHERE (channel = 'purchase' AND value > 80) OR value <= 3")
def udf01_emitters_from_spec(spark, sf_dir):
    """Emitters given as JSON text."""
    emitters = [(name, rule) for name, rule in json.loads(SPEC)]
    return spans(spark, sf_dir).select("event_id", R.first_match(emitters).alias("emitted")).where("emitted IS NOT NULL")


@query(f"""WITH {EV}, c AS (SELECT event_id, s, e, unnest(generate_series(0, (e - s) // 10)) AS k FROM ev), d AS (SELECT event_id, k, s + 10 * k AS chunk_s, least(s + 10 * k + 9, e) AS chunk_e FROM c)
SELECT event_id, k AS chunk, chunk_s, chunk_e, CASE WHEN chunk_e - chunk_s + 1 < 4 THEN 'too_short' ELSE 'kept' END AS status FROM d""")
def udf03_chunk_explode(spark, sf_dir):
    chunks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.expr("(e - s) div 10")), lambda k: F.struct(k.alias("chunk"), (F.col("s") + 10 * k).alias("chunk_s"), F.least(F.col("s") + 10 * k + 9, F.col("e")).alias("chunk_e")))
    d = spans(spark, sf_dir).select("event_id", F.inline(chunks))
    return d.withColumn("status", F.when(F.col("chunk_e") - F.col("chunk_s") + 1 < 4, "too_short").otherwise("kept"))


@query(f"""WITH {FR}, d AS (SELECT case_id, frame, value, value - lag(value) OVER w AS d, avg(value) OVER (PARTITION BY case_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM fr WINDOW w AS (PARTITION BY case_id ORDER BY frame))
SELECT case_id, frame, 'jump' AS detector FROM d WHERE abs(d) > 150 UNION ALL SELECT case_id, frame, 'plateau' FROM d WHERE m > 90 UNION ALL SELECT case_id, frame, 'floor' FROM d WHERE value < 0.5""")
def udf04_sidecar_detectors(spark, sf_dir):
    """Detectors over raw signals, all in one pass, appended as events."""
    w = G.in_order()
    d = frames(spark, sf_dir).select("case_id", "frame", "value", (F.col("value") - F.lag("value").over(w)).alias("d"), F.avg("value").over(w.rowsBetween(-3, 0)).alias("m"))
    hits = F.array_compact(F.array(F.when(F.abs("d") > 150, "jump"), F.when(F.col("m") > 90, "plateau"), F.when(F.col("value") < 0.5, "floor")))
    return d.select("case_id", "frame", F.explode(hits).alias("detector"))


DETECTORS = (G.StateDetector("surge", 60.0, False, 4, 2, 20.0, 5, 6), G.StateDetector("lull", 45.0, True, 8, 1, 20.0, 5, 12))


def _state_sql(d: G.StateDetector) -> str:
    v, cut = ("value", d.threshold) if d.below else ("-value", -d.threshold)
    return f"""(WITH {FR}, v AS (SELECT case_id, frame, {v} AS v FROM fr), h AS (SELECT case_id, frame, frame - row_number() OVER (PARTITION BY case_id ORDER BY frame) AS i FROM v WHERE v <= {cut}),
r AS (SELECT case_id, min(frame) AS s, max(frame) AS e FROM h GROUP BY case_id, i HAVING count(*) >= {d.min_run}), m AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY case_id ORDER BY s) <= {d.merge_gap} THEN 0 ELSE 1 END AS new FROM r),
c AS (SELECT case_id, min(s) AS s, max(e) AS e, sum(new) AS n FROM m GROUP BY 1), g AS (SELECT case_id, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS d, min(frame) AS f, max(frame) AS l FROM v GROUP BY 1 HAVING d >= {d.min_delta}),
b AS (SELECT case_id, s, e, n, d, f, l, (SELECT min(v) FROM v WHERE v.case_id = c.case_id AND frame BETWEEN s AND e) AS low, (SELECT max(v) FROM v WHERE v.case_id = c.case_id AND frame BETWEEN s - {d.window} AND s - 1) AS p, (SELECT max(v) FROM v WHERE v.case_id = c.case_id AND frame BETWEEN e + 1 AND e + {d.window}) AS q FROM c JOIN g USING (case_id))
SELECT case_id, '{d.name}' AS detector, 'repeated' AS kind, s, e, round(d, 6) AS magnitude, CAST(n AS BIGINT) AS count FROM b WHERE n > 1
UNION ALL SELECT case_id, '{d.name}', CASE WHEN e - s + 1 >= {d.hold} THEN 'held' ELSE 'brief' END, s, e, round(greatest(0, {cut} - low), 6), 1 FROM b WHERE n = 1
UNION ALL SELECT case_id, '{d.name}', 'enter', greatest(s - {d.window}, f), s, round(p - low, 6), 1 FROM b WHERE n = 1 AND p - low >= {d.min_delta}
UNION ALL SELECT case_id, '{d.name}', 'leave', e, least(e + {d.window}, l), round(q - low, 6), 1 FROM b WHERE n = 1 AND q - low >= {d.min_delta})"""


@query(" UNION ALL ".join(f"SELECT * FROM {_state_sql(d)}" for d in DETECTORS))
def udf04_state_sidecars(spark, sf_dir):
    """States of the raw signal that are repeated, held, entered and left, as events."""
    own = frames(spark, sf_dir)
    first, second = (G.state_events(own, d) for d in DETECTORS)
    return first.unionByName(second).withColumn("magnitude", F.round("magnitude", 6))


@query(f"""WITH {FR}, h AS (SELECT case_id, frame, value >= 50 AS up, frame - row_number() OVER (PARTITION BY case_id, value >= 50 ORDER BY frame) AS i FROM fr WHERE value >= 50 OR value <= 25), r AS (SELECT case_id, up, min(frame) AS s, max(frame) AS e FROM h GROUP BY case_id, up, i HAVING count(*) >= 2),
lo AS (SELECT * FROM r WHERE NOT up), hi AS (SELECT * FROM r WHERE up), n AS (SELECT a.case_id, a.up, a.s, a.e, min(b.s) AS ns, min_by(b.e, b.s) AS ne FROM r a JOIN r b ON a.case_id = b.case_id AND a.up != b.up AND b.s >= a.e AND b.s - a.e <= 6 GROUP BY ALL)
SELECT case_id, 'low' AS kind, s, e FROM lo UNION ALL SELECT lo.case_id, 'down', max(hi.e), lo.s FROM lo JOIN hi ON lo.case_id = hi.case_id AND hi.e <= lo.s AND lo.s - hi.e <= 6 GROUP BY lo.case_id, lo.s UNION ALL SELECT case_id, 'up', e, ns FROM n WHERE NOT up
UNION ALL SELECT a.case_id, CASE WHEN a.up THEN 'high_low_high' ELSE 'low_high_low' END, a.s, b.ne FROM n a JOIN n b ON a.case_id = b.case_id AND a.up != b.up AND b.s = a.ns""")
def udf04_level_sidecars(spark, sf_dir):
    """Low runs of the raw signal, the ways down and up and the cycles, as events."""
    return G.level_events(frames(spark, sf_dir), 25.0, 50.0, 2, 6)


def joint_rules() -> dict:
    """Cuts for the sample's vectors, whose coordinates are no metres."""
    return {
        "hand": J.StateRule(1.6, 1, 3, 5, 0.05, 4), "leg": J.StateRule(0.06, 1, 4, 5, 0.02, 2), "stance": J.StateRule(0.03, 2, 3, 5, 0.02, 3), "level": J.LevelRule(-0.5, 0.9, 1, 3, 1, 20, True), "support": J.SupportRule(1, 2, 0.2, 0.6, 0.05, 0.1),
        "arm": J.ArmRule(2, 2, 0.2, 400.0, 0.45, 150.0, 0.8, 0.3, 0.5, 0.85), "reach": J.ReachRule(2, 2, 0.1, 0.15, 0.1, 0.5, 0.05),
    }


@query()
def udf04_joint_detectors(spark, sf_dir):
    """All seven detectors of joint positions over the vectors as frames of a body, in chunks of 16 frames."""
    found = J.detected(joint_frames(spark, sf_dir), **joint_rules(), chunk=16)
    return found.select("case_id", "detector", "side", "kind", "s", "e", F.round("magnitude", 5).alias("magnitude"), "unit", "count")
