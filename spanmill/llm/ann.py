"""Nearest neighbours by an inverted file with product-quantised residuals.

Training takes a bounded sample (``SAMPLE`` vectors): coarse centroids, a codebook
for each part of the residuals, and the number of cells that a query must probe
so that the sample's own neighbours are found with ``recall``. Data without
clusters need many probes, clustered data few.

Every vector is indexed: its cell, its code and itself lie in one row. Equal
vectors are one entry with their smallest ids, no more than a query can return,
so that a vector that fills a third of all rows is one entry. A cell is split
into chunks of about ``CHUNK`` entries, and the queries that probe it into batches
of about ``BATCH``. A task holds one chunk and one batch: tables of asymmetric
distances rank the codes for all queries of the batch at once, the best
``shortlist`` entries of each (ties to the smaller id) are measured exactly in
double precision on the original vectors, and the query's nearest of all chunks
are kept. Equal queries are answered once.

The search is then completed, so that rows unlike the sample cost no neighbours: within
a chunk, entries whose asymmetric distance less the error of their own code is within the
shortlist's worst are measured too; and a second pass goes to the cells not probed whose
centroid is no farther than the worst found so far plus the cell's radius. What is left
out is provably farther, so the result is that of brute force, on any rows.

There are as many cells as the root of the entries, ``MAX_CELLS`` at most, as centroids
are fitted on the sample and broadcast; beyond that cells have more chunks.
``exact=True`` probes all cells and measures whole chunks.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id;
repeated rows count once; ties go to the smaller id; a query's own id is never
its neighbour; fewer candidates than ``k`` are all returned (shortlists then
hold whole chunks). An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, CHUNK, BATCH, MAX_CELLS, CODES = 20_000, 8_192, 1_024, 4_096, 256
#: Distances that a task works on at once.
AT_ONCE = 1 << 20
#: Share of the lengths involved that bounds allow for rounding.
SLACK = 1e-6
RESULT = "query_id long, rank int, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, for ranking only."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]


def nearest_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The nearest row of b to each row of a."""
    return np.concatenate([distances(a[i : i + 2048], b).argmin(1) for i in range(0, len(a), 2048)]) if len(a) else np.zeros(0, np.int64)


def kmeans(data: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids of ``data`` (at least k rows)."""
    own = np.random.default_rng(seed)
    centers = data[own.choice(len(data), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_rows(data, centers)
        size = np.bincount(near, minlength=k)
        for d in range(data.shape[1]):
            total = np.bincount(near, weights=data[:, d], minlength=k)
            centers[:, d] = np.where(size > 0, total / np.maximum(size, 1), centers[:, d])
    return centers


@dataclass
class Quantizer:
    """Coarse centroids, the bounds of the parts of a vector, a codebook for each part, and how many cells to probe."""

    centroids: np.ndarray
    bounds: list[int]
    books: list[np.ndarray]
    probes: int

    @classmethod
    def train(cls, sample: np.ndarray, rows: int, parts: int, recall: float, k: int) -> Quantizer:
        """Fit on ``sample`` for an index of ``rows`` entries."""
        cells = min(max(1, len(sample) // 4), max(1, min(MAX_CELLS, int(rows**0.5))))
        centroids = kmeans(sample, cells)
        near = nearest_rows(sample, centroids)
        rest = sample - centroids[near]
        bounds = [round(i * sample.shape[1] / parts) for i in range(parts + 1)]
        books = [kmeans(rest[:, a:b], min(CODES, len(sample)), 6) for a, b in zip(bounds, bounds[1:], strict=False)]
        # Probes: as many as find the neighbours of some of the sample among the rest of it.
        asked = sample[:: max(1, len(sample) // 256)]
        order = np.argsort(np.argsort(distances(asked, centroids), axis=1), axis=1)
        gap = distances(asked, sample)
        gap[np.arange(len(asked)), np.arange(len(asked)) * max(1, len(sample) // 256)] = np.inf
        top = np.argsort(gap, axis=1)[:, : min(k, max(1, len(sample) - 1))]
        needed = np.sort(order[np.arange(len(asked))[:, None], near[top]].ravel())
        probes = int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1
        return cls(centroids, bounds, books, probes)

    def encode(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the code of each vector."""
        cell = nearest_rows(data, self.centroids)
        rest = data - self.centroids[cell]
        code = [nearest_rows(rest[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books, strict=False)]
        return cell, np.stack(code, axis=1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.centroids[cell] + np.concatenate([book[code[:, k]] for k, book in enumerate(self.books)], axis=1)

    def rough(self, queries: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded vectors of a cell: (queries, vectors)."""
        rest = queries - self.centroids[cell]
        out = np.zeros((len(queries), len(code)))
        for k, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.books, strict=False)):
            out += distances(rest[:, a:b], book)[:, code[:, k]]
        return out


def shortest(rough: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` smallest of ``rough``; ties go to the smaller ``first``."""
    if len(rough) <= most:
        return np.arange(len(rough))
    limit = np.partition(rough, most - 1)[most - 1]
    at = np.nonzero(rough <= limit)[0]
    return at if len(at) == most else at[np.lexsort((first[at], rough[at]))[:most]]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, once each."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    v = v.where("vec_id IS NOT NULL AND size(embedding) > 0")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~bad & F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return v.where(F.size("embedding") == (sizes[0].n if sizes else 0)).dropDuplicates(["vec_id", "embedding"])


def _matrix(column) -> np.ndarray:
    """A column of lists of one length, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _smallest(vectors: DataFrame, most: int) -> DataFrame:
    """(embedding, ids): each distinct vector with its smallest ids, sorted."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, parts: int = 16, shortlist: int = 128, recall: float = 0.985, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found (if ``exact``, the k nearest) of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stored(valid(vectors), "vectors")
    entries = stored(_smallest(rows, k + 1), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    sample = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).toPandas()["embedding"]
    sample = np.stack(sample.to_list()).astype(np.float64)
    fitted = Quantizer.train(sample, n, min(parts, sample.shape[1]), recall, k)
    if exact:
        fitted.probes, shortlist = len(fitted.centroids), np.iinfo(np.int64).max
    model = spark.sparkContext.broadcast(vars(fitted))  # at most MAX_CELLS + CODES vectors

    def encoded(batches):
        own = Quantizer(**model.value)
        for batch in batches:
            if batch.num_rows:
                cell, code = own.encode(_matrix(batch.column(0)).astype(np.float64))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                own_rows = _matrix(batch.column(0)).astype(np.float64)
                missed = np.linalg.norm(own_rows - own.decoded(cell, code), axis=1)
                away = np.linalg.norm(own_rows - own.centroids[cell], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), codes, pa.array(missed), pa.array(away), batch.column(0), batch.column(1)], ["cell", "code", "missed", "away", "embedding", "ids"])

    index = stored(entries.mapInArrow(encoded, "cell int, code binary, missed double, away double, embedding array<float>, ids array<long>"), "index")
    radius = np.full(len(fitted.centroids), -np.inf)
    for r in index.groupBy("cell").agg(F.max("away").alias("away")).collect():  # MAX_CELLS rows at most
        radius[r.cell] = r.away
    chunks = index.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # MAX_CELLS rows at most
    index = index.drop("away").join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("chunks")).cast("int")).drop("chunks")

    def probed(batches):
        own = Quantizer(**model.value)
        for batch in batches:
            if batch.num_rows:
                gap = distances(_matrix(batch.column(1)).astype(np.float64), own.centroids)
                near = np.argsort(gap, axis=1, kind="stable")[:, : own.probes].astype(np.int32)
                cells = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], ["query", "embedding", "cells"])

    def left(batches):
        own = Quantizer(**model.value)
        for batch in batches:
            if batch.num_rows:
                wanted, limit = _matrix(batch.column(1)).astype(np.float64), batch.column(2).to_numpy()
                gap = distances(wanted, own.centroids)
                order = np.argsort(gap, axis=1, kind="stable")
                slack = SLACK * (np.linalg.norm(wanted, axis=1)[:, None] + np.linalg.norm(own.centroids, axis=1)[None])
                open_ = np.sqrt(np.maximum(gap, 0)) - slack <= limit[:, None] + radius[None]
                np.put_along_axis(open_, order[:, : own.probes], False, axis=1)
                row, cell = np.nonzero(open_)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(cell, pa.int32())], ["query", "embedding", "limit", "cell"])

    # Equal queries are asked once, by the smallest of their ids.
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = stored(asking.groupBy("embedding").agg(F.min("vec_id").alias("query")).select("query", "embedding"), "queries")

    def searched(key, queries, entries):
        names = {"query": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not queries.num_rows or not entries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        own, cell = Quantizer(**model.value), key[0].as_py()
        code = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.uint8).reshape(entries.num_rows, -1)
        vectors = _matrix(entries.column("embedding")).astype(np.float64)
        missed = entries.column("missed").to_numpy()
        size = np.linalg.norm(vectors, axis=1) + missed + np.linalg.norm(own.centroids[cell])
        ids = entries.column("ids").to_pylist()
        first = np.array([i[0] for i in ids], np.int64)
        asked, wanted = queries.column("query").to_pylist(), _matrix(queries.column("embedding")).astype(np.float64)
        limit, out = queries.column("limit").to_numpy(), []

        def measured(vector, of):
            gap = np.sqrt(((vectors[of] - vector) ** 2).sum(1))
            best = np.lexsort((first[of], gap))[: k + 1]
            return sorted((d, i) for d, e in zip(gap[best].tolist(), of[best].tolist(), strict=True) for i in ids[e])[: k + 1]

        each = max(1, AT_ONCE // len(code))
        for at in range(0, len(asked), each):
            rough = own.rough(wanted[at : at + each], cell, code) if len(code) > shortlist else np.zeros((min(each, len(asked) - at), len(code)))
            exact = distances(wanted[at : at + each], vectors) if len(code) > shortlist else rough
            for query, vector, near, plain, most in zip(asked[at : at + each], wanted[at : at + each], rough, exact, limit[at : at + each], strict=True):
                short = shortest(near, first, shortlist)
                found = measured(vector, short)
                if len(short) < len(code):
                    most = min(most, found[-1][0] if len(found) > k else np.inf)
                    slack = SLACK * (np.linalg.norm(vector) + size)
                    rest = (np.sqrt(np.maximum(near, 0)) - missed - slack <= most) & (np.sqrt(np.maximum(plain, 0)) - slack <= most)
                    rest[short] = True
                    found = measured(vector, np.nonzero(rest)[0])
                out += [(query, i, d) for d, i in found if d <= most]
        return pa.table({c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate(names.items())})

    keys = ["cell", "chunk", "batch"]
    order = Window.partitionBy("query").orderBy("score", "vec_id")

    def search(probes: DataFrame) -> DataFrame:
        """(query, vec_id, score): the nearest of each query (query, embedding, limit, cell) in its cells."""
        probes = stored(probes, "probes")
        # MAX_CELLS rows at most, as before.
        asking_of = probes.groupBy("cell").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches")).join(chunks, "cell")
        probes = probes.join(F.broadcast(asking_of), "cell").withColumn("batch", F.pmod(F.xxhash64("query"), F.col("batches")).cast("int"))
        probes = probes.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("chunks", "batches")
        offered = index.join(F.broadcast(asking_of.drop("chunks")), "cell").withColumn("batch", F.explode(F.expr("sequence(0, batches - 1)"))).drop("batches")
        found = probes.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(searched, "query long, vec_id long, score double")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")

    probes = asked.mapInArrow(probed, "query long, embedding array<float>, cells array<int>")
    found = stored(search(probes.select("query", "embedding", F.lit(float("inf")).alias("limit"), F.explode("cells").alias("cell"))), "found")
    if fitted.probes < len(fitted.centroids):
        worst = found.groupBy("query").agg(F.when(F.count("*") > k, F.max("score")).alias("limit"))
        bounded = asked.join(worst, "query", "left").select("query", "embedding", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        more = search(bounded.mapInArrow(left, "query long, embedding array<float>, limit double, cell int"))
        found = found.unionByName(more).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = stored(found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near")), "lists")
    mine = asking.join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "query").join(lists, "query")
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = mine.select("query_id", F.posexplode(near).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
