"""Folds over many small groups at once: rows sorted within partitions, swept in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT = 4096


def sessions(events: DataFrame, by: list[str], reach: int, order: list[str]) -> DataFrame:
    """``events`` with ``session``: events of a group that overlap, or start at most ``reach`` after the end of all before, share a number."""
    w = Window.partitionBy(*by).orderBy(*order)
    seen = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("s") > seen + reach, F.lit(True)).cast("int")
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def swept(df: DataFrame, by: list[str], order: list[str], fold: Callable[[list[dict]], list[dict]], schema: StructType | str) -> DataFrame:
    """What ``fold`` makes of each group's rows (dicts, in ``order``), in the given schema.

    Groups are dealt by all of ``by``, so that those of one case go to many tasks. A
    partition is one stream: a call of Python holds one group, not an Arrow table for
    each. A group is held as a list, so that its size has to be bounded by what it is:
    one session of touching events.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def groups(batches: Iterator[pa.RecordBatch]):
        key, own = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[c] for c in by)
                if now != key:
                    if own:
                        yield own
                    key, own = now, []
                own.append(row)
        if own:
            yield own

    def run(batches):
        out: list[dict] = []
        for own in groups(batches):
            out += fold(own)
            if len(out) >= OUT:
                yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
                out = []
        if out:
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kind)
