"""Paths of nodes to their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def paths_to_root(tree: DataFrame) -> DataFrame:
    """(id, path, cycle) of every node of ``tree`` (id, parent): the nodes from the topmost one reached down to itself.

    Each round joins what is known of a node with what is known of the topmost ancestor
    it has reached, so that depth d takes log2(d) rounds; each round is a table in the
    shared folder, and the last is the one in which no node is open. A walk ends at a
    node without a parent, at a parent that is no node, and before a node that it has
    met already, which sets ``cycle``. Ids are distinct and not null.
    """
    paths = stored(tree.select("id", F.col("parent").alias("top"), F.array("id").alias("path"), F.lit(False).alias("cycle")), "paths")
    while paths.where("top IS NOT NULL").limit(1).count():
        above = paths.select(F.col("id").alias("top"), F.col("top").alias("_next"), F.col("path").alias("_more"), F.col("cycle").alias("_cycle"))
        joined = paths.where("top IS NOT NULL").join(above, "top", "left")
        # The last place of what is joined that the path holds already: only what comes after it is new.
        met = F.aggregate(F.transform("_more", lambda x, i: F.when(F.array_contains("path", x), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        joined = joined.withColumn("_met", F.coalesce(met, F.lit(0)))
        fresh = F.slice("_more", F.col("_met") + 1, F.size("_more") - F.col("_met"))
        longer = joined.select(
            "id", F.when(F.col("_met") == 0, F.col("_next")).alias("top"),
            F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.concat(fresh, "path")).alias("path"), (F.coalesce("_cycle", F.lit(False)) | (F.col("_met") > 0)).alias("cycle"),
        )
        paths = stored(paths.where("top IS NULL").unionByName(longer), "paths")
    return paths.select("id", "path", "cycle")
