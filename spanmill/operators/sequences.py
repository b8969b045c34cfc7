"""Symbol sequences: pair merging, replay, lexicon matching, repeats and alternations.

A sequence is a string of tokens in angle brackets, ``<a><b><a>``. Replacing the
text ``<a><b>`` from left to right without overlap is then just the greedy
rewrite of a pair, and a choice of texts, longest first, is longest match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .folds import folded


def sequences(frames: DataFrame) -> DataFrame:
    """(case_id, seq) of frame rows (case_id, frame, sym)."""
    lists = frames.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("frame", "sym"))).alias("l"))
    return lists.select("case_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("<"), x["sym"], F.lit(">"))), "").alias("seq"))


def tokens(seq: Column) -> Column:
    """The tokens of a sequence."""
    return F.split(F.regexp_replace(seq, "^<|>$", ""), "><")


def pair_counts(df: DataFrame) -> DataFrame:
    """(a, b, n, cases) of adjacent pairs."""
    t = tokens(F.col("seq"))
    pairs = F.arrays_zip(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))).alias("a"), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("b"))
    return df.select("case_id", F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


def merged_name(a: str, b: str) -> str:
    """The token that replaces a pair."""
    return f"{a}+{b}"


def replace_pair(seq: Column, a: str, b: str) -> Column:
    """The pair rewritten from left to right without overlap."""
    return F.replace(seq, F.lit(f"<{a}><{b}>"), F.lit(f"<{merged_name(a, b)}>"))


@dataclass(frozen=True)
class Merge:
    """One learned step."""

    step: int
    a: str
    b: str
    n: int
    cases: int


def learn_merges(df: DataFrame, steps: int, least: int = 2, every: int = 4, least_cases: int = 1, by_support: bool = False) -> tuple[list[Merge], DataFrame]:
    """The merges learned from sequences and the rewritten sequences.

    Each step takes the pair with most occurrences, then most cases (if
    ``by_support``, most cases first), then the largest names; it ends when none
    occurs ``least`` times in ``least_cases`` cases. Sequences are written every few
    steps, so that plans stay short.
    """
    learned = []
    order = [F.desc("cases"), F.desc("n")] if by_support else [F.desc("n"), F.desc("cases")]
    for step in range(1, steps + 1):
        counts = pair_counts(df).where((F.col("n") >= least) & (F.col("cases") >= least_cases))
        best = counts.orderBy(*order, F.desc("a"), F.desc("b")).limit(1).collect()
        if not best:
            break
        learned.append(Merge(step, best[0].a, best[0].b, best[0].n, best[0].cases))
        df = df.withColumn("seq", replace_pair(F.col("seq"), best[0].a, best[0].b))
        if step % every == 0:
            df = stored(df, "merges")
    return learned, df


def replay(df: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Learned merges applied in order to other sequences."""
    for a, b in merges:
        df = df.withColumn("seq", replace_pair(F.col("seq"), a, b))
    return df


def stage_budget(total: Column) -> tuple[Column, Column]:
    """The steps of ``total`` that go to merges of channels (three quarters, one at least) and those left for coordination."""
    channel = F.greatest(F.lit(1), F.floor(0.75 * total + 0.5))
    return channel, total - channel


def two_stage_motifs(own: DataFrame, packets: DataFrame, total: int, least: int = 2, least_cases: int = 1) -> DataFrame:
    """(stage, rank, motif, n, cases): the vocabulary of ``total`` motifs that the two stages share.

    Stage ``channel`` learns merges from sequences (case_id, seq); stage
    ``coordination`` takes the symbols of packets (case_id, symbol) with the most cases,
    ties to more packets, then the smaller symbol. What merges leave of their budget is
    not passed on. No rows give no motifs; packets without a symbol take no part.
    """
    spark = own.sparkSession
    shares = spark.range(1).select(*[c.cast("int") for c in stage_budget(F.lit(total))]).first()
    merges, _ = learn_merges(own, shares[0], least, least_cases=least_cases)
    channel = spark.createDataFrame([("channel", m.step, merged_name(m.a, m.b), m.n, m.cases) for m in merges], "stage string, rank int, motif string, n long, cases long")
    seen = packets.where("symbol IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))
    best = seen.where((F.col("n") >= least) & (F.col("cases") >= least_cases)).orderBy(F.desc("cases"), F.desc("n"), "symbol").limit(shares[1])
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cases"), F.desc("n"), "symbol"))  # as many rows as the budget
    return channel.unionByName(best.select(F.lit("coordination").alias("stage"), rank.alias("rank"), F.col("symbol").alias("motif"), "n", "cases"))


def longest_match(seq: Column, lexicon: list[tuple[str, ...]]) -> Column:
    """The sequence with lexicon entries joined by +; at each place the longest entry wins, other tokens pass through."""
    texts = sorted({"".join(f"<{t}>" for t in entry) for entry in lexicon}, key=lambda x: (-x.count("<"), x))
    marked = F.regexp_replace(seq, f"({'|'.join(map(re.escape, texts))})", "{$1}")
    parts = F.regexp_extract_all(marked, F.lit(r"\{[^}]*\}|<[^>]*>"), F.lit(0))
    plain = F.transform(parts, lambda p: F.concat(F.lit("<"), F.regexp_replace(F.regexp_replace(p, r"[{}]|^<|>$", ""), r"^<|>$|><", "+"), F.lit(">")))
    return F.array_join(F.transform(plain, lambda p: F.regexp_replace(F.regexp_replace(p, r"^<\++", "<"), r"\++>$", ">")), "")


def alternations(df: DataFrame, least: int = 2) -> DataFrame:
    """(case_id, s, a, b, times) of alternations a b a b ... of two symbols, found greedily from left to right, in frame rows (case_id, frame, sym)."""

    def find(own: list[dict]) -> list[dict]:
        x, at, out = [r["sym"] for r in sorted(own, key=lambda r: r["frame"])], 0, []
        while at + 1 < len(x):
            a, b, times = x[at], x[at + 1], 1
            while a != b and x[at + 2 * times : at + 2 * times + 2] == [a, b]:
                times += 1
            if a != b and times >= least:
                out.append({"case_id": own[0]["case_id"], "s": at, "a": a, "b": b, "times": times})
                at += 2 * times
            else:
                at += 1
        return out

    return folded(df.select("case_id", "frame", "sym"), ["case_id"], find, "case_id long, s long, a string, b string, times long")


def block_repeats(df: DataFrame, widths: tuple[int, ...] = (4, 3, 2)) -> DataFrame:
    """(case_id, s, e, block, times) of adjacent equal blocks, the widest first; a span is reported once."""

    def find(own: list[dict]) -> list[dict]:
        x, out = [r["sym"] for r in sorted(own, key=lambda r: r["frame"])], {}
        for w in widths:
            at = 0
            while at + 2 * w <= len(x):
                times = 1
                while x[at + times * w : at + (times + 1) * w] == x[at : at + w]:
                    times += 1
                if times >= 2:
                    block, e = ">".join(x[at : at + w]), at + times * w - 1
                    out.setdefault((at, e, block), {"case_id": own[0]["case_id"], "s": at, "e": e, "block": block, "times": times})
                    at += times * w
                else:
                    at += 1
        return list(out.values())

    return folded(df.select("case_id", "frame", "sym"), ["case_id"], find, "case_id long, s long, e long, block string, times long")
