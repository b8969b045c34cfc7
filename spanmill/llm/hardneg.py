"""Hard negatives of anchors by partial inner products in an orthogonal PCA rotation.

Components become integers, ``floor(scale * c)``. The rotation's columns are the
right singular vectors of all distinct vectors (a QR decomposition of each
partition, merged as a tree), so that leading components hold most of an inner
product. Anchors are worked on in chunks of a fixed number of bytes: a chunk is
broadcast, and every partition of the vectors passes by it in tiles. For an anchor
and a tile, inner products grow by a quarter of the rotated components at a time;
what is left is at most the product of the two residual norms, plus a slack for
rounding. A vector is dropped as soon as that bound cannot reach the anchor's
threshold, and what survives is verified by integer products, which alone decide.

Two passes for each chunk: the positives (the threshold is the lowest score among
the best verified so far), then the negatives, whose score must lie in a window
given by each positive (the threshold is the window's lower end, or the last of
enough scores that surely lie in the window). A partition returns its own best of
each anchor; these are ranked across partitions.

Defined results: rows with a null id or label, a null or empty vector, null or
non-finite components, components beyond 2^25 once scaled (an inner product might
leave a long), or another length than most take no part. Rows that share an id
count once, as the one with the smallest label, then vector. Equal vectors of one
label are kept up to as many smallest ids as a result can hold, so that one vector
may fill any share of the rows. Ties go to the smaller id; an anchor's own id is
never among its positives; a positive with a negative score, or without rows in
its window, gives no rows. Empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored, work_path
from .whitening import matrix, quantised, r_factor

#: Bytes of a chunk of anchors, bytes of a tile, and anchors whose first products are made at once.
CHUNK_BYTES, TILE_BYTES, AT_ONCE = 32 << 20, 8 << 20, 64
LARGEST = float(1 << 25)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "anchor_id long, bar long, vec_id long, score long"


@dataclass
class Rotation:
    """An orthogonal matrix, the ends of its parts, and the relative slack for rounding."""

    columns: np.ndarray
    cuts: list[int]
    slack: float

    @classmethod
    def fit(cls, vectors: DataFrame) -> Rotation:
        """From all vectors x."""
        right = np.linalg.svd(r_factor(vectors))[2]
        d = len(right)
        defect = float(np.abs(right @ right.T - np.eye(d)).max()) * d
        return cls(right.T, sorted({-(-d * k // 4) for k in range(1, 5)}), 64 * d * np.finfo(float).eps + 2 * defect)


@dataclass
class Rows:
    """Integer vectors with their rotated form and the norms of what each cut leaves."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    rotated: np.ndarray = field(init=False)
    rest: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)

    def turned(self, by: Rotation) -> Rows:
        """With the rotated form."""
        self.rotated = self.x @ by.columns
        tail = np.cumsum((self.rotated**2)[:, ::-1], axis=1)[:, ::-1]
        tail = np.sqrt(np.hstack([tail, np.zeros((len(tail), 1))]))
        self.rest, self.norms = tail[:, by.cuts], tail[:, 0]
        return self


def best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties to the smaller id."""
    if len(scores) > most:
        at = np.nonzero(scores >= np.partition(scores, -most)[-most])[0]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:most]]


def _bounded(anchor: int, anchors: Rows, tile: Rows, at: np.ndarray, first: np.ndarray, by: Rotation, alive) -> np.ndarray:
    """The places ``at`` of a tile that ``alive(low, high)`` keeps after each part of the rotated components."""
    begun, product = by.cuts[0], first[at]
    slack = by.slack * anchors.norms[anchor]
    for k, cut in enumerate(by.cuts):
        if k:
            product = product + tile.rotated[at, begun:cut] @ anchors.rotated[anchor, begun:cut]
            begun = cut
        room = anchors.rest[anchor, k] * tile.rest[at, k] + slack * tile.norms[at]
        keep = alive(product - room, product + room)
        at, product = at[keep], product[keep]
    return at


def positives_in(anchor: int, anchors: Rows, tile: Rows, first: np.ndarray, by: Rotation, found: list, most: int) -> list:
    """The anchor's best (id, score) of the same label, of ``found`` and this tile."""
    at = np.nonzero((tile.labels == anchors.labels[anchor]) & (tile.ids != anchors.ids[anchor]))[0]
    if not len(at):
        return found
    ids, scores = found
    if len(scores) < most:  # the best by the first part give a threshold
        lead = at[np.argpartition(-first[at], most - 1)[:most]] if len(at) > most else at
        sure = np.concatenate([scores, tile.x[lead] @ anchors.x[anchor]])
        floor = np.sort(sure)[-most] if len(sure) >= most else None
    else:
        floor = scores.min()
    at = _bounded(anchor, anchors, tile, at, first, by, (lambda low, high: high >= floor) if floor is not None else (lambda low, high: np.ones(len(high), bool)))
    ids, scores = np.concatenate([ids, tile.ids[at]]), np.concatenate([scores, tile.x[at] @ anchors.x[anchor]])
    top = best(ids, scores, most)
    return [ids[top], scores[top]]


def negatives_in(anchor: int, anchors: Rows, tile: Rows, first: np.ndarray, by: Rotation, found: dict, windows: list[tuple[int, int, int]], most: int) -> None:
    """Puts the anchor's best of other labels in each window (bar, low, high) into ``found[anchor, bar]``."""
    at = np.nonzero(tile.labels != anchors.labels[anchor])[0]
    if not len(at):
        return
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    floors = {}
    for bar, low, _ in windows:
        known = found.get((anchor, bar), none)[1]
        floors[bar] = known.min() if len(known) >= most else low

    def alive(low, high):
        keep = np.zeros(len(low), bool)
        for bar, least, limit in windows:
            sure = low[(low >= least) & (high <= limit)]
            if len(sure) >= most:
                floors[bar] = max(floors[bar], np.partition(sure, -most)[-most])
            keep |= (high >= floors[bar]) & (low <= limit)
        return keep

    at = _bounded(anchor, anchors, tile, at, first, by, alive)
    exact, ids = tile.x[at] @ anchors.x[anchor], tile.ids[at]
    for bar, least, limit in windows:
        inside = (exact >= least) & (exact <= limit)
        if inside.any():
            known = found.get((anchor, bar), none)
            own = np.concatenate([known[0], ids[inside]]), np.concatenate([known[1], exact[inside]])
            top = best(*own, most)
            found[anchor, bar] = own[0][top], own[1][top]


def _tiles(batches, by: Rotation):
    """Rows of at most TILE_BYTES from Arrow batches of (vec_id, label, x)."""
    for batch in batches:
        x = matrix(batch.column(2))
        most = max(64, TILE_BYTES // (8 * max(1, x.shape[1] if len(x) else 1)))
        for k in range(0, len(x), most):
            yield Rows(batch.column(0).to_numpy()[k : k + most], batch.column(1).to_numpy()[k : k + most], x[k : k + most]).turned(by)


def _passed(index: DataFrame, asked, visit, gathered) -> DataFrame:
    """What ``gathered`` makes of each partition of ``index`` after ``visit`` has seen every tile with every anchor."""

    def run(batches):
        rotation, anchors, windows = asked.value
        anchors = Rows(*anchors).turned(rotation)
        found: dict = {}
        for tile in _tiles(batches, rotation):
            cut = rotation.cuts[0]
            for k in range(0, len(anchors.ids), AT_ONCE):
                firsts = anchors.rotated[k : k + AT_ONCE, :cut] @ tile.rotated[:, :cut].T
                for i, first in enumerate(firsts, k):
                    visit(i, anchors, tile, first, rotation, found, windows)
        rows = gathered(anchors, found)
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], ["anchor_id", "bar", "vec_id", "score"])

    return index.select("vec_id", "label", "x").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "bar").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def positive_rows(index: DataFrame, asked, most: int) -> DataFrame:
    """(anchor_id, vec_id, score, rank): the best of the same label of each anchor of the broadcast chunk."""
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def visit(i, anchors, tile, first, by, found, windows):
        found[i] = positives_in(i, anchors, tile, first, by, found.get(i, none), most)

    def gathered(anchors, found):
        return [(int(anchors.ids[i]), 0, int(v), int(s)) for i, own in found.items() for v, s in zip(*own, strict=True)]

    return _ranked(_passed(index, asked, visit, gathered), most)


def negative_rows(index: DataFrame, asked, most: int) -> DataFrame:
    """(anchor_id, bar, vec_id, score, rank): the best of other labels in each window of each anchor of the broadcast chunk."""

    def visit(i, anchors, tile, first, by, found, windows):
        own = windows.get(int(anchors.ids[i]))
        if own:
            negatives_in(i, anchors, tile, first, by, found, own, most)

    def gathered(anchors, found):
        return [(int(anchors.ids[i]), int(bar), int(v), int(s)) for (i, bar), own in found.items() for v, s in zip(*own, strict=True)]

    return _ranked(_passed(index, asked, visit, gathered), most)


def chunked(anchors: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``anchors`` with a column ``chunk`` of which no value has more than ``most`` rows, and the number of chunks."""
    n, salt = parts(2 * anchors.count(), most), 0
    while True:
        own = anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)))
        largest = own.groupBy("chunk").count().agg(F.max("count")).first()[0]
        if largest is None or largest <= most:
            return own, n
        n, salt = 2 * n, salt + 1


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. For each of an
    anchor's ``positives`` best rows of its label, the ``negatives`` best rows of
    other labels whose score is at least ``low`` and at most ``high`` percent of
    the positive's.
    """
    spark = vectors.sparkSession
    own = quantised(vectors.where("label IS NOT NULL AND vec_id IS NOT NULL"), scale, 0, LARGEST / scale, ("label",))
    first = F.min(F.struct(F.col("label").cast("long").alias("label"), "x")).alias("row")
    rows = stored(own.groupBy("vec_id").agg(first).select("vec_id", "row.*"), "vectors")
    same = Window.partitionBy("label", "x").orderBy("vec_id")
    index = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= max(positives + 1, negatives)).drop("n")
    index = stored(index, "index")
    if not index.limit(1).count():
        return spark.createDataFrame([], RESULT)
    rotation = Rotation.fit(index)
    most = max(1, CHUNK_BYTES // (8 * len(rotation.columns)))
    anchors, n = chunked(rows.where(F.pmod("vec_id", F.lit(every)) == 0), most)
    out = work_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(out)
    for chunk in range(n):
        table = anchors.where(F.col("chunk") == chunk).select("vec_id", "label", "x").toArrow()  # CHUNK_BYTES at most
        if not table.num_rows:
            continue
        own = table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("x"))
        asked = spark.sparkContext.broadcast((rotation, own, None))
        found = stored(positive_rows(index, asked, positives), "positives")
        windows: dict = {}
        for r in found.select("anchor_id", "score").distinct().collect():  # ``positives`` rows an anchor at most
            windows.setdefault(r.anchor_id, []).append((r.score, -(-low * r.score // 100), high * r.score // 100))
        bars = spark.sparkContext.broadcast((rotation, own, {a: sorted(w) for a, w in windows.items()}))
        hard = negative_rows(index, bars, negatives).select("anchor_id", F.col("bar").alias("score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        joined = found.select("anchor_id", "score", F.col("vec_id").alias("positive_id")).join(hard, ["anchor_id", "score"])
        joined.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score").write.mode("append").parquet(out)
        asked.unpersist()
        bars.unpersist()
    return spark.read.schema(RESULT).parquet(out)
