"""Pair merges learned over many steps: an index from pairs to blocks of sequences, and counts kept up to date by differences.

Sequences lie in blocks (by a hash of their case), one folder each. The index has,
for each pair and block, how often the pair occurs there and in how many cases. A
step takes the best pair from the counts, looks up the blocks that hold it, rewrites
those sequences only, and adds the differences of their pairs to the index and the
counts. Differences are small tables; every ``COMPACT`` steps they are added up.
What the driver holds is one row a step and one number a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import new_folder, stored
from .sequences import merged_name, replace_pair, tokens

COMPACT = 16


@dataclass(frozen=True)
class IndexedMerge:
    """One learned step: its pair, how often it occurred and in how many cases, and how many sequences the step read."""

    step: int
    a: str
    b: str
    n: int
    cases: int
    read: int


def block_pairs(own: DataFrame) -> DataFrame:
    """(block, a, b, n, cases) of adjacent pairs of sequences (block, case_id, seq)."""
    t = tokens(F.col("seq"))
    most = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(t, F.lit(1), most).alias("a"), F.slice(t, F.lit(2), most).alias("b"))
    each = own.select("block", "case_id", F.inline(pairs)).groupBy("block", "case_id", "a", "b").agg(F.count("*").alias("n"))
    return each.groupBy("block", "a", "b").agg(F.sum("n").alias("n"), F.countDistinct("case_id").alias("cases"))


class Blocks:
    """Sequences (case_id, seq) in ``count`` folders; a block is replaced as a whole and has one place at a time."""

    def __init__(self, sequences: DataFrame, count: int):
        self.spark, self.count, self.schema = sequences.sparkSession, count, sequences.select("case_id", "seq").schema
        self.own_block = F.pmod(F.xxhash64("case_id"), F.lit(count)).cast("int")
        first = sequences.select("case_id", "seq").where("seq IS NOT NULL").withColumn("block", self.own_block)
        self.place: dict[int, str] = {}
        self._write(first.repartition("block"))
        sizes = self.read().groupBy("block").agg(F.count("*").alias("n")).collect()  # a row a block
        self.size = {r.block: r.n for r in sizes}
        self.place = {b: p for b, p in self.place.items() if b in self.size}

    def _write(self, rows: DataFrame, blocks: list[int] | None = None) -> None:
        root = new_folder(self.spark, "blocks")
        rows.write.partitionBy("block").parquet(root)
        self.place |= {b: f"{root}/block={b}" for b in (range(self.count) if blocks is None else blocks)}

    def read(self, blocks: list[int] | None = None) -> DataFrame:
        """(case_id, seq, block) of some blocks, or of all."""
        if blocks is None and not hasattr(self, "size"):
            roots = sorted({p.rsplit("/", 1)[0] for p in self.place.values()})
            own = self.spark.read.schema(self.schema).parquet(*roots)
        else:
            paths = [self.place[b] for b in (self.place if blocks is None else blocks)]
            own = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return own.select("case_id", "seq").withColumn("block", self.own_block)

    def replace(self, blocks: list[int], rows: DataFrame) -> None:
        """Put ``rows``, the new sequences of ``blocks``, in their place."""
        self._write(rows, blocks)


class Counts:
    """A table (block, a, b, n, cases) and the differences that came since."""

    def __init__(self, base: DataFrame):
        self.base = stored(base, "pairs")
        self.later: list[DataFrame] = []

    def add(self, difference: DataFrame) -> None:
        """One more table of differences; many are added up."""
        self.later.append(stored(difference, "pairs"))
        if len(self.later) >= COMPACT:
            self.base, self.later = stored(self.summed("block", "a", "b"), "pairs"), []

    def all(self) -> DataFrame:
        """The rows of all layers."""
        out = self.base
        for other in self.later:
            out = out.unionByName(other)
        return out

    def summed(self, *keys: str) -> DataFrame:
        """(keys, n, cases) of what is left of all layers."""
        return self.all().groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("cases").alias("cases")).where("n > 0")


def learn_merges(sequences: DataFrame, steps: int, least: int = 2, least_cases: int = 1, by_support: bool = False, blocks: int = 256) -> tuple[list[IndexedMerge], DataFrame]:
    """The merges of sequences (case_id, seq) and the rewritten sequences; the same as ``sequences.learn_merges`` finds.

    One sequence for each case; null sequences take no part. Fewer merges come back if
    no pair occurs ``least`` times in ``least_cases`` cases.
    """
    order = [F.desc("cases"), F.desc("n")] if by_support else [F.desc("n"), F.desc("cases")]
    held = Blocks(sequences, blocks)
    index = Counts(block_pairs(held.read()))
    learned: list[IndexedMerge] = []
    for step in range(1, steps + 1):
        counts = index.summed("a", "b").where((F.col("n") >= least) & (F.col("cases") >= least_cases))
        best = counts.orderBy(*order, F.desc("a"), F.desc("b")).limit(1).collect()
        if not best:
            break
        a, b = best[0].a, best[0].b
        here = index.all().where((F.col("a") == a) & (F.col("b") == b)).groupBy("block").agg(F.sum("n").alias("n")).where("n > 0")
        touched = sorted(r.block for r in here.collect())  # a row a block
        learned.append(IndexedMerge(step, a, b, best[0].n, best[0].cases, sum(held.size[k] for k in touched)))
        before = held.read(touched)
        held.replace(touched, before.withColumn("seq", replace_pair(F.col("seq"), a, b)))
        gone = block_pairs(before).withColumn("n", -F.col("n")).withColumn("cases", -F.col("cases"))
        change = gone.unionByName(block_pairs(held.read(touched))).groupBy("block", "a", "b").agg(F.sum("n").alias("n"), F.sum("cases").alias("cases"))
        index.add(change.where("n != 0 OR cases != 0"))
    return learned, held.read().select("case_id", "seq")


__all__ = ["Blocks", "Counts", "IndexedMerge", "block_pairs", "learn_merges", "merged_name"]
