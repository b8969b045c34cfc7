"""Helpers shared by the operators: tables, work folders, words and hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.sources.store import new_folder

#: White space between words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A path not used before in the folder that all executors share."""
    return new_folder(spark, label)


def stored(df: DataFrame, label: str = "part", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folded(docs: DataFrame) -> DataFrame:
    """(doc_id, text, copies) of ``docs``: rows without an id become one for each text, so that no number of them makes a hot key."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = own.where("doc_id IS NOT NULL").withColumn("copies", F.lit(1).cast("long"))
    return named.unionByName(own.where("doc_id IS NULL").groupBy("doc_id", "text").agg(F.count("*").alias("copies")))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes the blocks that later steps work in."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def parts(amount: int, each: int) -> int:
    """How many parts of about ``each`` make up ``amount``; one at least."""
    return max(1, -(-int(amount) // int(each)))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without the characters 20 and 09 to 0D (hex), as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """``words_of`` after lower-casing A to Z only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit name of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(a: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every other."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return a ^ (a >> np.uint64(32))


def pair_names(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of each ordered pair."""
    with np.errstate(over="ignore"):
        return mix(mix(a + np.uint64(salt * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15) + b)


def runs_of(sizes, most: int):
    """Split positions 0..n into runs of consecutive items whose sizes add up to about ``most``."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
