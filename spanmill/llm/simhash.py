"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are sorted into cells by the population counts of their four
16-bit parts. Two fingerprints within ``radius`` bits lie in cells whose counts
differ by ``radius`` at most in sum, so all other pairs of tiles are skipped
without a look. Tiles hold ``TILE`` fingerprints at most; a task compares one
pair of tiles with exclusive-or and bit counts and reports a spanning forest of
what it links, not the pairs, so that a group of any size costs one row per
member and tile pair. Components then spread by joins of small tables.

Defined results: a null text is an empty one; an empty text has fingerprint
zero and links like any other; fewer words than the shingle's width make one
shingle of all of them; equal rows share a class; a row with a null ``doc_id``
gets the class of its fingerprint if a row with an id has the same one, else a
null class. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words_of, stored

#: Fingerprints in a tile, and tiles in a row or column of the tile pairs that share one key.
TILE, STRIP = 2048, 8
_SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits: each is 1 if set in over half of the hashes of the text's shingles, repeats included."""
    words = lower_words_of(text)
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, _SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    name = xxhash.xxh64_intdigest
    m = n - width + 1
    hashes = np.fromiter((name(joined[i:j], _SEED) for i, j in zip(starts, ends, strict=True)), np.uint64, m)
    counts = np.zeros(64, np.int64)
    for at in range(0, m, 16384):
        part = hashes[at : at + 16384].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes can reach over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b whose fingerprints differ in ``radius`` bits at most; if same, of i < j only."""
    left, right = [], []
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        left.append(i.astype(np.int32))
        right.append(j.astype(np.int32))
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that join every two of the ``nodes`` (fp, node) within ``radius`` bits, directly or over others."""
    shift = radius
    part = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) + shift for k in range(4)]
    code = part[0] + F.shiftleft(part[1], 8) + F.shiftleft(part[2], 16) + F.shiftleft(part[3], 24)
    cells = nodes.withColumn("cell", code.cast("long"))
    # At most 17 ** 4 cells exist, so that this table has a fixed bound.
    wide = stored(cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles")), "cells")
    tiles = stored(
        cells.join(F.broadcast(wide), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
        .groupBy("cell", "tile")
        .agg(F.collect_list(F.struct("fp", "node")).alias("members"))
        .select("cell", "tile", F.col("members.fp").alias("fps"), F.col("members.node").alias("ids")),
        "tiles",
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    offsets = F.explode(F.array(*[F.lit(sum(x << (8 * k) for k, x in enumerate(d))).cast("long") for d in steps])).alias("step")
    # The pairs of tiles of two cells form a matrix; its squares of STRIP x STRIP pairs go to different tasks, and a tile
    # is sent once to each square of its row or column. Most cells have one tile and so one square.
    strips = wide.select("cell", F.expr(f"(tiles - 1) div {STRIP}").alias("strips"))
    beside = strips.select("cell", "strips", offsets)
    beside = beside.select((F.col("cell") + F.col("step")).alias("cell_b"), F.col("cell"), F.col("step"), "strips").join(strips.withColumnsRenamed({"cell": "cell_b", "strips": "strips_b"}), "cell_b")
    beside = stored(beside, "cells")
    across = beside.groupBy("cell").agg(F.max("strips_b").alias("most"))  # each table of cells has a fixed bound
    left = tiles.join(F.broadcast(across), "cell").withColumn("column", F.explode(F.expr("sequence(0L, most)"))).withColumn("line", F.expr(f"tile div {STRIP}")).drop("most")
    right = tiles.select(*[F.col(c).alias(f"{c}_b") for c in ("cell", "tile", "fps", "ids")]).join(F.broadcast(beside.drop("strips_b")), "cell_b")
    right = right.withColumn("line", F.explode(F.expr("sequence(0L, strips)"))).withColumn("column", F.expr(f"tile_b div {STRIP}")).drop("strips")
    pairs = left.join(right, ["cell", "line", "column"]).where("step != 0 or tile <= tile_b")
    pairs = pairs.selectExpr("step = 0 and tile = tile_b as same", "fps", "ids", "fps_b", "ids_b")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py()
                a, ids_a, b, ids_b = (batch.column(k)[row].values.to_numpy() for k in range(1, 5))
                i, j = compare(a.view(np.uint64), b.view(np.uint64), radius, same)
                if not len(i):
                    continue
                ids, shift_b = (ids_a, 0) if same else (np.concatenate([ids_a, ids_b]), len(a))
                label = spanning(i, j.astype(np.int64) + shift_b, len(ids))
                moved = np.nonzero(label != np.arange(len(ids)))[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable.

    Each round takes the smallest label among neighbours and follows it one
    step; every round is a table in the shared folder. Ends when nothing moves.
    """
    both = stored(edges.union(edges.selectExpr("b", "a")).distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label.selectExpr("node as b", "component as low"), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        step = label.join(near, "node").selectExpr("node", "component as old", "least(component, low) as low")
        after = step.join(label.selectExpr("node as low", "component as next"), "low").selectExpr("node", "old", "least(low, next) as component")
        after = stored(after, "labels")
        moved = after.where("old != component").limit(1).count()
        label = after.select("node", "component")
        if not moved:
            return label


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    own = stored(fingerprints(docs, width), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null")
    nodes = stored(nodes, "nodes")
    classes = components(links(nodes, radius))
    by_fp = stored(nodes.join(classes, "node", "left").selectExpr("fp as of_fp", "coalesce(component, node) as component_id"), "classes")
    return own.join(by_fp, own.fp == by_fp.of_fp, "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` (all columns) without those whose near-duplicate class has a smaller id.

    Rows without an id stay, as do repeated rows of the smallest id.
    """
    gone = near_duplicates(docs, width, radius).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
