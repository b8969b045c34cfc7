"""Tables written to the folder that all executors share, to cut a lineage so that it survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str = "part") -> str:
    """A path not used before, below spark.checkpoint.dir (a temporary folder where that is unset, on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spanmill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/spanmill/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "part") -> DataFrame:
    """Write ``df`` to a new folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
