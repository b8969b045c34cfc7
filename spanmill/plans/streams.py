"""The streaming extension over stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.adapters import table
from ..streaming.sessions import gap_sessions, state_changes


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 20 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT user_id, epoch_us(min(ts)) AS s, epoch_us(max(ts)) AS e, count(*) AS members FROM g GROUP BY user_id, n""")
def ext01_gap_sessions(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return gap_sessions(ev).select("user_id", F.unix_micros("s").alias("s"), F.unix_micros("e").alias("e"), "members")


@query("""SELECT user_id, epoch_us(ts) // 3600000000 AS hour, count(*) FILTER (value >= 50) AS high, count(*) FILTER (value < 50) AS low FROM events GROUP BY ALL""")
def ext02_hourly_states(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return state_changes(ev, 50).select("user_id", F.expr("unix_micros(hour) div 3600000000").alias("hour"), "high", "low")
