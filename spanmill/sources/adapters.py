"""Test and sample tables seen as spans, frames, symbol sequences, captions and transactions.

Time is whole hours, so that all span arithmetic is exact. Each adapter has the
SQL of the same table, which the oracles build on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EV = """ev AS (SELECT user_id AS case_id, event_id, event_type AS channel, epoch_us(ts) // 3600000000 AS s,
  epoch_us(ts) // 3600000000 + CAST(floor(value / 10) AS BIGINT) AS e, value FROM events)"""
FR = """fr AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  value, event_type AS sym, event_id FROM events)"""
BASKET = """basket AS (SELECT l_orderkey AS tx, o_custkey AS case_id, p_brand AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
CAP = """cap AS (SELECT doc_id AS case_id, source AS node, text AS caption FROM documents)"""

#: Rows that a task of ``baskets`` holds, about.
ROWS_IN_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, event_id, channel, s, e, value): events as closed spans of hours."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), "event_id", F.col("event_type").alias("channel"),
        hour.alias("s"), (hour + F.floor(F.col("value") / 10)).alias("e"), "value",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, frame, value, sym, event_id): each user's events in order, numbered from 0."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"),
        "value", F.col("event_type").alias("sym"), "event_id",
    )


def task_parts(rows: int) -> int:
    """Into how many tasks rows are dealt, so that a task's share does not grow with the table. Given as a number, it is not merged again by compressed sizes, which say little about memory."""
    return max(1, -(-rows // ROWS_IN_TASK))


def baskets(spark: SparkSession, sf_dir: str, by: str = "tx") -> DataFrame:
    """(tx, case_id, item): the distinct brands of each order, with its customer; all rows of one ``by`` in one task."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = task_parts(lines.count())  # read from the files' footers
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Joined by sorting: keys compress well, and a table broadcast whole would grow every task.
    bought = lines.repartition(n, "l_partkey").join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    joined = bought.repartition(n, "l_orderkey").distinct().join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = joined.select(F.col("l_orderkey").alias("tx"), F.col("o_custkey").alias("case_id"), F.col("p_brand").alias("item")).distinct()
    return own if by == "tx" else own.repartition(n, by)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, node, caption): documents as captions of their source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("node"), F.col("text").alias("caption"))


def joint_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, frame, joints): vectors as frames of 22 joints of three coordinates, in each label's order; the components beyond the vector's end are its first again."""
    order = Window.partitionBy("label").orderBy("vec_id")
    at = lambda k: F.col("embedding")[F.pmod(k, F.size("embedding"))].cast("double")
    joints = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda j: F.array(*[at(3 * j + k) for k in range(3)]))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("case_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), joints.alias("joints"))
