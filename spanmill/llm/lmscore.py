"""Language-model scores from a log-frequency Bloom filter.

The filter holds counts of single tokens and of token pairs, each quantised to
``1 + floor(log2(count))``: an n-gram of level q is entered q times, as (n-gram,
1) to (n-gram, q). A reader probes level 1, 2, ... until one is missing; its
count is then taken as the mean of the last level found, for counts whose
frequency falls with their square.

Probabilities are smoothed by pseudo-counts: ``p(w | h) = (c(hw) + PAIR p(w)) /
(c(h) + PAIR)`` and ``p(w) = (c(w) + ALL / (v + 1)) / (n + ALL)`` with n tokens and
v distinct ones in training and one class for all others. With exact counts they
sum to one over the known tokens and that class; an unseen context leaves ``p(w)``
whole. The filter's counts are off by quantisation (1 is exact, others are at
most 39 % above or 31 % below) and by false hits: with ``BITS`` bits an entry and
``PROBES`` probes an unseen n-gram is found in 1.8 % of cases.

Counting is one exchange: tasks send each block's distinct n-grams with their
counts, bucketed by hash, and a bucket's reducer adds them up and sets its own
segment of the filter, so that no dictionary of n-grams exists anywhere. Every
segment is sized by its own entries, so that bits per entry are the same in
every segment and at every size of the corpus.

The filter is broadcast where it has ``BROADCAST_BYTES`` at most (checked). A larger
one stays dealt out as a table of segments, and each block of texts sends its
distinct n-grams to the segments and gets their levels back. Both ways probe the
same bits, so that scores do not depend on which is taken; the texts are read
once at every size. The exact unigram base score comes by the same exchange: it
asks for the counts of each block's distinct tokens.

Defined results: a null text is an empty one, of one token (its end); rows with
a null ``doc_id`` are not held out and train the model; equal rows get equal
scores; texts are scored whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded, hash_words, lower_words_of, mix, pair_names, parts, runs_of, stored, text_bytes

BLOCK_BYTES = 6 << 20
#: The largest filter that is broadcast; bits for each entry; bits that one probe of a level looks at.
BROADCAST_BYTES, BITS, PROBES = 96 << 20, 10, 3
#: Text for each segment of the pairs' filter, and for each bucket of the tokens.
SEGMENT_TEXT, BUCKET_TEXT = 6 << 20, 12 << 20
#: Pseudo-counts of a pair's context and of the whole corpus.
PAIR, ALL = 100.0, 1000.0
END = np.uint64(0x5851F42D4C957F2D)
MAX_LEVEL = 48


def held_out(doc_id: Column, mod: int = 7, rest: int = 2) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the texts' tokens, each text with its end, and the number of tokens of each."""
    words = [lower_words_of(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    names = np.full(int(sizes.sum()), END, np.uint64)
    stops = np.cumsum(sizes)
    for stop, size, w in zip(stops.tolist(), sizes.tolist(), words, strict=True):
        names[stop - size : stop - 1] = hash_words(w)
    return names, sizes


def _contexts(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; a text's first token follows an end."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[np.cumsum(sizes) - sizes] = END
    return before


def levels(count: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log2(count))."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def _means() -> np.ndarray:
    """The mean count of each level if a count's frequency falls with its square."""
    out = [0.0]
    for q in range(1, MAX_LEVEL + 1):
        own = np.arange(2 ** (q - 1), 2**q, dtype=np.float64) if q <= 12 else None
        out.append(float((1 / own).sum() / (1 / own**2).sum()) if own is not None else 2.0**q * float(np.log(2)))
    return np.array(out)


MEANS = _means()


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return MEANS[level]


def probability(pair: np.ndarray, context: np.ndarray, token: np.ndarray, n: int, v: int) -> np.ndarray:
    """The smoothed probability of a token after a context from the counts of both and of the pair."""
    alone = (token + ALL / (v + 1)) / (n + ALL)
    return (pair + PAIR * alone) / (context + PAIR)


def _spots(names: np.ndarray, level: int, k: int, bits: np.ndarray) -> np.ndarray:
    """The bit of probe k of each (name, level) in a segment of so many bits."""
    with np.errstate(over="ignore"):
        return mix(names + np.uint64((level * 0x9E3779B97F4A7C15 + (k << 56)) & 0xFFFFFFFFFFFFFFFF)) % bits.astype(np.uint64)


def fill(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A filter segment with these n-grams, of ``BITS`` bits for each of their entries."""
    level = levels(counts)
    size = np.array([max(64, -(-int(level.sum()) * BITS // 8) * 8)])
    bits = np.zeros(int(size[0]), bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = names[level >= q]
        for k in range(PROBES):
            bits[_spots(own, q, k, size)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Segments side by side, with the byte at which each starts and its number of bits."""

    def __init__(self, segments: list[bytes]):
        sizes = np.array([len(s) for s in segments], np.int64)
        self.flat = np.frombuffer(b"".join(segments), np.uint8)
        self.start, self.bits = np.cumsum(sizes) - sizes, sizes * 8

    def probe(self, segment: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The level that each name is found at in its segment; 0 if not at all or if the segment is empty."""
        level = np.zeros(len(names), np.int64)
        live = np.nonzero(self.bits[segment] > 0)[0]
        for q in range(1, MAX_LEVEL + 1):
            for k in range(PROBES):
                own = segment[live]
                spot = _spots(names[live], q, k, self.bits[own]).astype(np.int64)
                live = live[(self.flat[self.start[own] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1]
            level[live] = q
            if not len(live):
                break
        return level


def _grouped(key: np.ndarray, *columns: np.ndarray):
    """(key, columns) of each run of equal keys, after a stable sort by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    columns = [c[order] for c in columns]
    cuts = np.nonzero(key[1:] != key[:-1])[0] + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
        if lo < hi:
            yield int(key[lo]), *(c[lo:hi] for c in columns)


class Model:
    """The counts' table: one row for each bucket of the tokens (kind 0) and each segment of the pairs (kind 1)."""

    def __init__(self, docs: DataFrame, train: Column):
        size = text_bytes(docs)
        self.sizes = (parts(size, BUCKET_TEXT), parts(size, SEGMENT_TEXT))
        self.blocks = parts(size, BLOCK_BYTES)
        counted = docs.where(train).select("text").mapInArrow(self._count(), "kind int, bucket long, names binary, counts binary")
        merged = counted.groupBy("kind", "bucket").applyInArrow(_merge, "kind int, bucket long, entries long, total long, names binary, counts binary, bits binary")
        self.table = stored(merged, "counts")
        row = self.table.agg(
            F.sum(F.when(F.col("kind") == 0, F.col("total"))).alias("n"), F.sum(F.when(F.col("kind") == 0, F.col("entries"))).alias("v"), F.sum(F.octet_length("bits")).alias("bytes")
        ).first()
        self.n, self.v, self.bytes = (int(x or 0) for x in row)

    def __getstate__(self):
        """Tasks get the sizes only."""
        return {k: v for k, v in vars(self).items() if isinstance(v, (int, tuple))}

    def bucket(self, kind: int, names: np.ndarray) -> np.ndarray:
        """The bucket or segment of each n-gram."""
        return (mix(names ^ np.uint64(0x1234 * kind)) % np.uint64(self.sizes[kind])).astype(np.int64)

    def _count(self):
        names = ["kind", "bucket", "names", "counts"]

        def run(batches):
            for batch in batches:
                texts = batch.column(0)
                sizes = [len(t.as_py() or "") for t in texts]
                for lo, hi in runs_of(sizes, BLOCK_BYTES):
                    token, size = _tokens(texts.slice(lo, hi - lo).to_pylist())
                    rows = []
                    for kind, key in ((0, token), (1, pair_names(_contexts(token, size), token))):
                        name, count = np.unique(key, return_counts=True)
                        rows += [(kind, b, n.tobytes(), c.astype("<u4").tobytes()) for b, n, c in _grouped(self.bucket(kind, name), name, count)]
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names)

        return run

    def filters(self) -> list[Filter]:
        """The whole filter: tokens and pairs; ``bytes`` in all."""
        segments = [[b""] * n for n in self.sizes]
        for r in self.table.select("kind", "bucket", "bits").toLocalIterator():
            segments[r.kind][r.bucket] = bytes(r.bits)
        return [Filter(s) for s in segments]

    def scores(self, docs: DataFrame, most: int) -> DataFrame:
        """(doc_id, n_tokens, n_known, base_score, score, copies) of each row; the filter is broadcast if it has ``most`` bytes at most."""
        shared = docs.sparkSession.sparkContext.broadcast(self.filters()) if self.bytes <= most else None
        blocked = folded(docs).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.blocks)).cast("long"))
        own = self.table if shared is None else self.table.where("kind = 0").withColumn("bits", F.lit(None).cast("binary"))
        own = own.select(F.lit(-1).cast("long").alias("block"), "kind", "bucket", "names", "counts", "bits")
        asked = blocked.groupBy("block").applyInArrow(self._ask(shared is None), "block long, kind int, bucket long, names binary, counts binary, bits binary")
        replies = asked.unionByName(own).groupBy("kind", "bucket").applyInArrow(_answer, "block long, kind int, bucket long, counts binary, levels binary")
        schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, copies long"
        return blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(self._scored(shared), schema)

    def _ask(self, pairs: bool):
        def run(key, table):
            token, size = _tokens(table.column("text").to_pylist())
            rows = [(0, b, n.tobytes()) for b, n in self._dealt(0, np.unique(token))]
            if pairs:
                rows += [(1, b, n.tobytes()) for b, n in self._dealt(1, np.unique(pair_names(_contexts(token, size), token)))]
            none = pa.array([None] * len(rows), pa.binary())
            columns = [pa.array([key[0].as_py()] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary())))]
            return pa.Table.from_arrays([*columns, none, none], ["block", "kind", "bucket", "names", "counts", "bits"])

        return run

    def _dealt(self, kind: int, names: np.ndarray):
        return _grouped(self.bucket(kind, names), names)

    def _scored(self, shared):
        total = np.log10(self.n + self.v + 1)

        def told(replies, kind, column, type_, names):
            """What the buckets told of these names."""
            out = np.zeros(len(names), np.int64)
            mask = [k == kind for k in replies.column("kind").to_pylist()]
            by_bucket = {b: x for b, x, m in zip(replies.column("bucket").to_pylist(), replies.column(column).to_pylist(), mask, strict=True) if m}
            bucket = self.bucket(kind, names)
            order = np.argsort(bucket, kind="stable")
            if len(names):
                out[order] = np.concatenate([np.frombuffer(by_bucket[b], type_) for b in np.unique(bucket).tolist()])
            return out

        def run(table, replies):
            token, size = _tokens(table.column("text").to_pylist())
            alone, inverse = np.unique(token, return_inverse=True)
            before = _contexts(token, size)
            pair, first, of_pair = np.unique(pair_names(before, token), return_index=True, return_inverse=True)
            count = told(replies, 0, "counts", "<i8", alone)
            if shared is None:
                level, pair_level = told(replies, 0, "levels", np.uint8, alone), told(replies, 1, "levels", np.uint8, pair)
            else:
                level, pair_level = (f.probe(self.bucket(kind, x), x) for kind, (f, x) in enumerate(zip(shared.value, (alone, pair), strict=True)))
            # Every context is a token of the block: the end of a text stands before each first one.
            found = level_count(level)
            c1, c2 = found[np.searchsorted(alone, before[first])], found[inverse[first]]
            c12 = np.minimum(level_count(pair_level), np.minimum(c1, c2))  # a pair is no more frequent than its tokens
            value = np.log10(np.minimum(probability(c12, c1, c2, self.n, self.v), 1.0))
            at = np.cumsum(size) - size
            count = count[inverse]
            sums = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
            return pa.table(
                {
                    "doc_id": table.column("doc_id"),
                    "n_tokens": pa.array(size, pa.int64()),
                    "n_known": pa.array(sums((count > 0).astype(np.int64)), pa.int64()),
                    "base_score": pa.array(sums(np.log10(count + 1.0)) - size * total, pa.float64()),
                    "score": pa.array(sums(value[of_pair]), pa.float64()),
                    "copies": table.column("copies"),
                }
            )

        return run


def _merge(key, table):
    """A bucket's n-grams with their sums, as a filter segment; tokens keep their counts as well."""
    kind = key[0].as_py()
    name = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("names")])
    count = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")])
    order = np.argsort(name, kind="stable")
    name, count = name[order], count[order].astype(np.int64)
    at = np.nonzero(np.concatenate([[True], name[1:] != name[:-1]]))[0]
    name, count = name[at], np.add.reduceat(count, at)
    row = {"kind": kind, "bucket": key[1].as_py(), "entries": len(name), "total": int(count.sum()), "names": None, "counts": None, "bits": fill(name, count).tobytes()}
    if not kind:
        row |= {"names": name.tobytes(), "counts": count.astype("<i8").tobytes()}
    types = {"kind": pa.int32(), "bucket": pa.int64(), "entries": pa.int64(), "total": pa.int64()}
    return pa.table({k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()})


def _answer(key, table):
    """Counts and levels of the names that each block asked for, 0 for unknown ones; block -1 holds the bucket's own."""
    blocks, asked = table.column("block").to_pylist(), table.column("names").to_pylist()
    name, count, own = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    if -1 in blocks:
        at = blocks.index(-1)
        counts, bits = table.column("counts")[at].as_py(), table.column("bits")[at].as_py()
        if counts is not None:
            name, count = np.frombuffer(asked[at], np.uint64), np.frombuffer(counts, "<i8")
        own = Filter([bits]) if bits is not None else None
    rows = []
    for block, wanted in zip(blocks, asked, strict=True):
        if block == -1:
            continue
        wanted = np.frombuffer(wanted, np.uint64)
        found = np.zeros(len(wanted), np.int64)
        if len(name):
            spot = np.minimum(np.searchsorted(name, wanted), len(name) - 1)
            found = np.where(name[spot] == wanted, count[spot], 0)
        level = own.probe(np.zeros(len(wanted), np.int64), wanted) if own else np.zeros(len(wanted), np.int64)
        rows.append((block, found.astype("<i8").tobytes() if not key[0].as_py() else None, level.astype(np.uint8).tobytes()))
    kinds = {"block": pa.int64(), "counts": pa.binary(), "levels": pa.binary()}
    out = {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())}
    same = {"kind": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([key[1].as_py()] * len(rows), pa.int64())}
    return pa.table({c: (same | out)[c] for c in ("block", "kind", "bucket", "counts", "levels")})


def score_texts(docs: DataFrame, held: Column | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    A filter of more than ``most`` bytes is not broadcast.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = held_out(F.col("doc_id")) if held is None else held
    model = Model(docs, ~held)
    scored = model.scores(docs, BROADCAST_BYTES if most is None else most).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
