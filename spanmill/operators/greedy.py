"""Greedy choices under several exclusions, without a group in one task.

Taking pairs in a total order, each unless one taken before shares a key with it,
gives the same set as rounds in which every pair that comes first among all that
share any of its keys is taken and what it excludes goes: a pair that comes first
everywhere cannot be excluded by a pair that is still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def exclusive(pairs: DataFrame, keys: list[list[str]], order: list[Column]) -> DataFrame:
    """The rows of ``pairs`` taken in ``order`` so that no two share a value of any of the ``keys`` (each a list of columns).

    ``order`` should be total; of rows equal in it and in all columns one is taken. A
    null in a key is a value like others. Each round is a window for each key and a
    table in the shared folder; the number of rounds is that of the longest chain of
    pairs each of which waits for the one before.
    """
    named = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *[F.col(c).alias(f"c{k}") for k, c in enumerate(pairs.columns)])
    left, taken = stored(pairs.distinct().withColumn("_o", named), "open"), None
    while left.limit(1).count():
        first = [F.min("_o").over(Window.partitionBy(*key)) for key in keys]
        marked = left.select("*", *[f.alias(f"_f{k}") for k, f in enumerate(first)])
        won = stored(marked.where(reduce(lambda a, b: a & b, [F.col(f"_f{k}") == F.col("_o") for k in range(len(keys))])).select(*left.columns), "taken")
        taken = won if taken is None else taken.unionByName(won)
        rest = left
        for key in keys:
            used = won.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(key)]).distinct()
            rest = rest.join(used, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(key)]), "left_anti")
        left = stored(rest, "open")
    return (left if taken is None else taken).drop("_o")
