"""Files: JSON lines and documents, CSV, captions, archives, array bundles, flat configuration and an append-only registry."""

from __future__ import annotations

import dataclasses
import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per non-blank line; a line that is no record of the schema keeps its text in ``_corrupt``. A cap needs an order."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(wide).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    if most is None:
        return df
    if not order:
        raise ValueError("a cap needs an order")
    return df.orderBy(*order).limit(most)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are left out."""
    df.write.json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document of several lines as one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line."""
    df.write.option("header", True).csv(path)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(file, caption): text lines up to the first #, blank ones left out."""
    lines = spark.read.text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return lines.select("file", F.trim(F.split("value", "#")[0]).alias("caption")).where("caption != ''")


# The arrays that a manifest describes, and the folder endings of the buckets, longer ones first.
ARRAYS = ("poses", "trans", "betas", "incontact", "ground_contact_mask")
BUCKETS = {"_non_contact_sequences": "non_contact", "_contact_sequences": "contact", "_neutral_sequences": "neutral"}
MANIFEST = "path string, keys string, " + ", ".join(f"{a}_shape string, {a}_dtype string" for a in ARRAYS) + ", bucket string, sequence_group string, error string"


def scan_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row per .npz file: its arrays, shape and type of each of ``ARRAYS``, its folder and that folder's bucket; a broken file gives an error row. Only array headers are read."""

    def scan(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.path, pdf.content, strict=True):
                folder = name.rsplit("/", 2)[-2] if name.count("/") > 1 else ""
                bucket = next((b for end, b in BUCKETS.items() if folder.endswith(end)), "unknown")
                try:
                    told = dict.fromkeys(ARRAYS, (None, None))
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        keys = sorted(n.removesuffix(".npy") for n in z.namelist())
                        for array in filter(keys.__contains__, ARRAYS):
                            with z.open(f"{array}.npy") as f:
                                version = np.lib.format.read_magic(f)
                                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                                dims, _, dtype = read(f)
                                told[array] = "x".join(map(str, dims)), str(dtype)
                    rows.append((name, ",".join(keys), *(x for a in ARRAYS for x in told[a]), bucket, folder, None))
                except Exception as e:  # an unreadable file is a row, not the end of the scan
                    rows.append((name, None, *[None] * 2 * len(ARRAYS), None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in MANIFEST.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(scan, MANIFEST)


def write_bytes(path: str, content: bytes) -> None:
    """One small file at a path of any file system that Arrow knows."""
    system, place = FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as f:
        f.write(content)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, bytes) of all zip files below a path."""

    def listed(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(name, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "member", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(listed, "archive string, member string, bytes long")


def resolve(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """``wanted`` (member) with where it is stored: 'zip' and its archive, or 'missing'."""
    first = members.groupBy("member").agg(F.min("archive").alias("archive"), F.max("bytes").alias("bytes"))
    return wanted.join(first, "member", "left").withColumn("kind", F.when(F.col("archive").isNull(), "missing").otherwise("zip"))


def parse_flat_yaml(text: str, into: type):
    """Lines ``key: value`` as an instance of a dataclass; comments and blank lines are skipped, unknown keys are an error."""
    kinds, values = {f.name: f.type for f in dataclasses.fields(into)}, {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, _, raw = (x.strip() for x in line.partition(":"))
        if key not in kinds:
            raise ValueError(f"unknown key {key}")
        kind = kinds[key] if isinstance(kinds[key], str) else kinds[key].__name__
        raw = raw.strip("'\"")
        values[key] = raw.lower() in ("true", "yes", "1") if kind == "bool" else int(raw) if kind == "int" else float(raw) if kind == "float" else raw
    return into(**values)


def slugged(text: str) -> str:
    """Lower case, letters and digits; runs of others become one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def artifact_path(root: str, subset: str, stage: str, purpose: str, split: str, tag: str = "") -> str:
    """root/subset/stage/purpose_split[_tag]."""
    name = "_".join(x for x in map(slugged, (purpose, split, tag)) if x)
    return f"{root}/{slugged(subset)}/{slugged(stage)}/{name}"


def register(spark: SparkSession, registry: str, entries: list[dict]) -> DataFrame:
    """Append entries to the registry table and read all of it."""
    rows = [(e["path"], e["stage"], e["rows"], json.dumps(e.get("meta", {}), sort_keys=True)) for e in entries]
    spark.createDataFrame(rows, "path string, stage string, rows long, meta string").write.mode("append").parquet(registry)
    return spark.read.parquet(registry)


def cached(spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame], enabled: bool = True) -> tuple[DataFrame, str]:
    """A built table kept under the hash of its whole configuration: 'hit', 'miss_built' or 'disabled'."""
    if not enabled:
        return build(), "disabled"
    path = f"{root}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:24]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path), "hit"
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), "miss_built"
