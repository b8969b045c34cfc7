"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when they are identical after every white-space character is taken
out. A task cuts its rows into blocks of at most ``BLOCK_ROWS`` rows and about
``BLOCK_BYTES`` of text; equal texts of a block are found by their bytes and form
one local class. A class is named by the first ``bits`` bits of the SHA-256 of its
text, enough that a text shares its fingerprint with another one by chance once in
2^``SPARE`` texts. Fingerprints fall into ranges of equal size, one for each owner; a
block sends each owner its sorted fingerprints of that range as Golomb codes and
gets back a bitmap that marks those that another block has too. Only the marked
classes, the suspects, are shuffled with their texts: equal bytes make a group. The
rows of a group learn its result by the digest of the text, which grouping by bytes
has proved to belong to one text (otherwise the job stops with an error).

The classes are written to a table bucketed by block, so that bitmaps meet them
without a shuffle of texts. A text that fills a third of all rows is one class in
each block, is summed before it is shuffled, and costs its owner one code for each
block.

Defined results: a null text is an empty one, and empty and all-white texts are
equal; a row without an id comes after rows with one, and ``keep_id`` is null if it
stays; of rows equal in everything one stays. Every row has a result, repeated rows
too. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import parts, stored, work_path

BLOCK_ROWS, BLOCK_BYTES = 16_384, 16 << 20
#: Fingerprints of an owner, buckets at most, and bits of a fingerprint beyond the number of rows.
OWNED, MOST_BUCKETS, SPARE = 65_536, 8_192, 12
WHITE = b" \t\n\v\f\r"
_CLASSES = "block long, slot int, text binary, sha binary, size int, points long, ids array<long>, sent array<struct<owner:int,first:int,count:int,bits:binary>>"
_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("slot", pa.int32()), ("text", pa.binary()), ("sha", pa.binary()), ("size", pa.int32()), ("points", pa.int64()), ("ids", pa.list_(pa.int64())),
        ("sent", pa.list_(pa.struct([("owner", pa.int32()), ("first", pa.int32()), ("count", pa.int32()), ("bits", pa.binary())]))),
    ]
)


@dataclass(frozen=True)
class Ranges:
    """Fingerprints of ``bits`` bits, cut into ``owners`` ranges of one size."""

    bits: int
    owners: int

    @classmethod
    def of(cls, rows: int) -> Ranges:
        """For a table of ``rows`` rows: more owners as it grows, then more fingerprints for each."""
        bits = min(63, max(16, rows.bit_length() + SPARE))
        return cls(bits, min(parts(rows, OWNED), max(4_096, parts(rows, 128 * OWNED))))

    @property
    def span(self) -> int:
        """Fingerprints in a range."""
        return -(-(1 << self.bits) // self.owners)

    def fingerprint(self, sha: bytes) -> int:
        """The first bits of a digest."""
        return int.from_bytes(sha[:8], "big") >> (64 - self.bits)


def packed(text: str | None) -> tuple[bytes, int]:
    """A text's bytes without white space, and its code points with it."""
    return (text.encode("utf-8", "surrogatepass").translate(None, WHITE), len(text)) if text else (b"", 0)


@dataclass
class Block:
    """Texts in the order in which they came: their rows as (-code points, no id, id)."""

    texts: dict[bytes, list] = field(default_factory=dict)
    rows: int = 0
    size: int = 0

    def add(self, text: str | None, doc_id: int | None) -> None:
        """One more row."""
        own, points = packed(text)
        if own not in self.texts:
            self.texts[own] = []
            self.size += len(own)
        self.texts[own].append((-points, doc_id is None, doc_id or 0))
        self.rows += 1

    def classes(self, ranges: Ranges, block: int) -> pa.RecordBatch:
        """The local classes by fingerprint; each owner's slots begin at a multiple of eight, as bitmaps are bytes. The first row has the messages."""
        named = sorted(((ranges.fingerprint(sha := hashlib.sha256(text).digest()), sha, text, sorted(rows)) for text, rows in self.texts.items()), key=lambda c: c[:2])
        # Two texts of one fingerprint are two classes of one number: the owner sees it twice.
        numbers = np.array([c[0] for c in named], np.uint64)
        owners = (numbers // np.uint64(ranges.span)).astype(np.int64)
        sent, slots, first = [], [], 0
        for owner, begin, count in zip(*np.unique(owners, return_index=True, return_counts=True), strict=True):
            own = numbers[begin : begin + count] - np.uint64(int(owner) * ranges.span)
            width = golomb.width_for(ranges.span, int(count))
            sent.append({"owner": int(owner), "first": first, "count": int(count), "bits": golomb.encode(own, width)})
            slots += range(first, first + int(count))
            first += -(-int(count) // 8) * 8
        ids = [[None if missing else i for _, missing, i in rows] for *_, rows in named]
        columns = [[block] * len(named), slots, [c[2] for c in named], [c[1] for c in named], [len(c[3]) for c in named], [-c[3][0][0] for c in named], ids, [sent] + [None] * (len(named) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def local_classes(docs: DataFrame, ranges: Ranges, buckets: int) -> DataFrame:
    """The local classes of all blocks, as a table bucketed by block."""

    def run(batches):
        own = Block()
        name = random.SystemRandom()  # blocks are named once: what is read later is what was committed
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own.add(text.as_py(), doc_id.as_py())
                if own.rows >= BLOCK_ROWS or own.size >= BLOCK_BYTES:
                    yield own.classes(ranges, name.getrandbits(63))
                    own = Block()
        if own.rows:
            yield own.classes(ranges, name.getrandbits(63))

    spark = docs.sparkSession
    table = f"spanmill_classes_{uuid.uuid4().hex}"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CLASSES)
    made.write.bucketBy(buckets, "block").option("path", work_path(spark, "classes")).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def repeated(classes: DataFrame, ranges: Ranges) -> DataFrame:
    """(block, marks): a bit for each slot of the blocks, set if another slot anywhere has the same fingerprint."""

    def owned(table):
        counts = table.column("count").to_numpy()
        own = [golomb.decode(b, n, golomb.width_for(ranges.span, n)) for b, n in zip(table.column("bits").to_pylist(), counts.tolist(), strict=True)]
        _, back, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        marks = np.split(times[back] > 1, np.cumsum(counts)[:-1])
        return pa.table({"block": table.column("block"), "owner": table.column("owner"), "marks": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())})

    messages = classes.where("sent IS NOT NULL").select("block", F.explode("sent").alias("m")).select("block", "m.owner", "m.count", "m.bits")
    answers = messages.groupBy("owner").applyInArrow(owned, "block long, owner int, marks binary")
    in_order = F.array_sort(F.collect_list(F.struct("owner", F.hex("marks").alias("marks"))))
    return answers.groupBy("block").agg(F.unhex(F.array_join(F.transform(in_order, lambda x: x["marks"]), "")).alias("marks"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text).

    Of equal texts the row with the most code points stays, then the one with the smallest id.
    """
    rows = docs.count()
    ranges = Ranges.of(rows)
    classes = local_classes(docs, ranges, min(MOST_BUCKETS, parts(rows, 4_096)))
    marks = stored(repeated(classes, ranges), "marks")
    byte = F.conv(F.hex(F.expr("substring(marks, slot div 8 + 1, 1)")), 16, 10).cast("int")
    marked = classes.join(marks.hint("shuffle_hash"), "block").withColumn("suspect", F.expr("shiftleft(1, 7 - slot % 8)").bitwiseAND(byte) != 0)
    own = F.struct((-F.col("points")).alias("points"), F.expr("ids[0] IS NULL").alias("missing"), F.expr("ids[0]").alias("id"), "block", "slot")
    groups = marked.where("suspect").groupBy("sha", "text").agg(F.min(own).alias("best"), F.sum(F.col("size").cast("long")).alias("group_size"))
    proved = groups.groupBy("sha").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    proved = proved.select("sha", "best", F.expr("if(texts = 1, group_size, raise_error('two texts have one SHA-256'))").cast("long").alias("group_size"))
    light = marked.select("block", "slot", "sha", "size", "ids", "suspect")
    alone = light.where("NOT suspect").select("sha", "ids", F.expr("ids[0]").alias("keep_id"), F.col("size").cast("long").alias("group_size"), F.lit(True).alias("here"))
    others = light.where("suspect").join(stored(proved, "groups"), "sha")
    others = others.select("sha", "ids", F.col("best.id").alias("keep_id"), "group_size", F.expr("best.block = block AND best.slot = slot").alias("here"))
    each = alone.unionByName(others).select("*", F.posexplode("ids").alias("at", "doc_id"))
    return each.select("doc_id", "keep_id", "group_size", F.expr("here AND at = 0").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
