"""Choices that depend on those made before: a fold over one group's rows, Arrow in and out."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(df: DataFrame, by: list[str], fold: Callable[[list[dict]], list[dict]], schema: StructType | str) -> DataFrame:
    """What ``fold`` makes of each group's rows (as dicts, in no order), in the given schema.

    Groups are one case's events or one cluster's candidates, not open-ended keys.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(fold(table.to_pylist()), schema=arrow)

    return df.groupBy(*by).applyInArrow(run, kind)
