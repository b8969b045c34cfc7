"""Repeated passages by recompression.

Each round names the maximal runs of a symbol and then the pairs of a left-hand
and a right-hand symbol; the sides are bits of the names. A run or pair has the
same name wherever it stands, so that equal passages have equal symbols inside;
only at the two ends, where a run may go on outside or a partner may stand
outside, a symbol depends on the surroundings. A window's *interior* of a round
is what remains when such ends are peeled off in every round up to it: equal
windows have equal interiors.

Rounds on Spark (``LEVELS`` of them): every block of documents sends the distinct
symbols of its windows' interiors to their buckets, those that stand in several
of its documents marked; the bucket's task knows all blocks that have a symbol and
answers which symbols stand in more than one document. A window with a symbol
that no other document has cannot repeat and is out of all later rounds. What is
left are windows made of shared high-level symbols. Each is named by what was
peeled from its ends in each round and by the symbols left in its last interior.

Verification: a window goes to its bucket (a hash of its name, so of all its
words) with its name and a second number that is computed from its words alone
by independent 64-bit hashes. Windows count as equal if both agree, so that two
windows that fall on one name are kept apart. Symbols need no such check: two on
one name can only keep a window in the race that the last exchange then judges.

Blocks hold a bounded number of bytes and send each symbol and window once, so
that a passage that fills a third of all rows costs one entry for each block
(16 bytes of at least ``BLOCK_BYTES``), not one for each row; a bucket holds a
bounded share of the distinct windows beside that. Rows without an id are folded
to one for each text before the first shuffle.

Defined results: a null text has no words; texts shorter than a window keep all
words; a null ``doc_id`` counts as larger than any other, and null ids do not
precede each other; repeated rows of one id do not cover each other. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded, mix, pair_names, parts, text_bytes, words_of

WINDOW = 13
#: The rounds whose symbols are named across all documents.
LEVELS = (1, 2)
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 10 << 20
_LAST = np.iinfo(np.int64).max
SENT = "block long, level int, bucket long, names binary, checks binary, docs binary, at binary"
REPLY = "block long, level int, bucket long, mask binary"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit numbers of each word: (n, 2)."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


class Parse:
    """The symbols of a text after some rounds, and what is peeled from the windows of ``width`` words at ``starts``.

    No run or pair crosses a position in ``wall``. ``owner`` is carried along:
    a number for each word that all words of a symbol share.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, wall: np.ndarray, owner: np.ndarray, width: int, named: bool = False):
        self.symbol, self.wall, self.owner, self.level, self.named = words, wall, owner, 0, named
        self.alive = np.ones(len(starts), bool)
        self.head, self.tail = np.zeros(len(starts), np.uint64), np.ones(len(starts), np.uint64)
        # The windows that have an interior, and its first and last symbol.
        self.which, self.lo, self.hi = np.arange(len(starts)), starts.copy(), starts + width - 1

    def _peel(self, ends: np.ndarray, some, symbol, salt: int) -> None:
        if self.named:
            which = self.which[some]
            ends[which] = pair_names(ends[which], symbol(), salt)

    def _narrow(self, lo: np.ndarray, hi: np.ndarray) -> None:
        some = lo <= hi
        self.which, self.lo, self.hi = self.which[some], lo[some], hi[some]

    def step(self) -> None:
        """One round: runs, then pairs."""
        self.level += 1
        salt, symbol, wall, every = self.level * 4, self.symbol, self.wall, slice(None)
        # Runs: the ones at the two ends are peeled, as they may go on outside.
        same = (symbol[1:] == symbol[:-1]) & ~wall[1:] & ~wall[:-1]
        first = np.concatenate([[True], ~same])
        run = np.cumsum(first) - 1
        at = np.nonzero(first)[0]
        length = np.diff(np.concatenate([at, [len(symbol)]]))
        end = at + length - 1
        stop = np.minimum(end[run[self.lo]], self.hi)
        self._peel(self.head, every, lambda: pair_names(symbol[self.lo], (stop - self.lo + 1).astype(np.uint64), 2), salt)
        self._narrow(stop + 1, self.hi)
        stop = np.maximum(at[run[self.hi]], self.lo)
        self._peel(self.tail, every, lambda: pair_names(symbol[self.hi], (self.hi - stop + 1).astype(np.uint64), 2), salt + 1)
        self._narrow(self.lo, stop - 1)
        self.lo, self.hi = run[self.lo], run[self.hi]
        symbol, wall, owner = symbol[at], wall[at], self.owner[at]
        longer = length > 1
        symbol[longer] = pair_names(symbol[longer], length[longer].astype(np.uint64), 2)
        # Pairs: an end whose partner might stand outside is peeled.
        side = (mix(symbol + np.uint64(self.level)) & np.uint64(1)).astype(bool)
        is_left, is_right = side & ~wall, ~side & ~wall
        cut = is_right[self.lo]
        self._peel(self.head, cut, lambda: symbol[self.lo[cut]], salt + 2)
        self._narrow(self.lo + cut, self.hi)
        cut = is_left[self.hi]
        self._peel(self.tail, cut, lambda: symbol[self.hi[cut]], salt + 3)
        self._narrow(self.lo, self.hi - cut)
        second = np.concatenate([[False], is_left[:-1] & is_right[1:]])
        to = np.cumsum(~second) - 1
        at = np.nonzero(~second)[0]
        paired = np.concatenate([second[1:], [False]])[at]
        self.symbol = symbol[at]
        self.symbol[paired] = pair_names(self.symbol[paired], symbol[at[paired] + 1], 1)
        self.wall, self.owner = wall[at], owner[at]
        self.lo, self.hi = to[self.lo], to[self.hi]

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """The names of the distinct symbols of all interiors, sorted, and which of them have several owners."""
        edge = np.bincount(self.lo, minlength=len(self.symbol) + 1) - np.bincount(self.hi + 1, minlength=len(self.symbol) + 1)
        at = np.nonzero(np.cumsum(edge)[:-1] > 0)[0]
        at = at[np.argsort(self.symbol[at], kind="stable")]
        name, owner = self.symbol[at], self.owner[at]
        new = np.concatenate([[True], name[1:] != name[:-1]])[: len(name)]
        self.at, self.group = at, np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        if not len(first):
            return name, np.zeros(0, bool)
        low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
        return name[first], low != high

    def keep(self, shared: np.ndarray) -> None:
        """Drop the windows whose interior has one of the symbols of the last ``inside`` that is not shared."""
        lone = np.zeros(len(self.symbol) + 1, np.int32)
        lone[self.at + 1] = ~shared[self.group]
        lone = np.cumsum(lone)
        stays = lone[self.hi + 1] == lone[self.lo]
        self.alive[self.which[~stays]] = False
        self.which, self.lo, self.hi = self.which[stays], self.lo[stays], self.hi[stays]

    def names(self) -> np.ndarray:
        """The name of every window: all that is peeled until nothing remains."""
        while len(self.which):
            self.step()
        return pair_names(self.head, self.tail, 3)


class Block:
    """The documents of a block and their windows, in an order that any task finds again."""

    def __init__(self, table: pa.Table, width: int):
        rows = zip(table.column("doc_id").to_pylist(), [t or "" for t in table.column("text").to_pylist()], table.column("copies").to_pylist(), strict=True)
        rows = sorted(((_LAST if i is None else i, t, n, i) for i, t, n in rows), key=lambda r: r[:3])
        self.ids, self.copies = [r[3] for r in rows], [r[2] for r in rows]
        self.words = [words_of(r[1]) for r in rows]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # each document ends in a wall
        numbers = np.zeros((int((sizes + 1).sum()), 2), np.uint64)
        wall = np.zeros(len(numbers), bool)
        wall[self.begin + sizes] = True
        for b, w in zip(self.begin.tolist(), self.words, strict=True):
            numbers[b : b + len(w)] = word_numbers(w)
        count = np.maximum(sizes - width + 1, 0)
        row = np.repeat(np.arange(len(sizes)), count)
        self.start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.begin[row]
        owner = np.array([r[0] for r in rows], np.int64)
        self.docs = owner[row]
        self.width, self.second = width, numbers[:, 1]
        self.text = numbers[:, 0].copy(), wall, np.repeat(owner, sizes + 1)
        self.parse = Parse(self.text[0], self.start, *self.text[1:], width)

    def to_level(self, level: int, told: dict[int, dict[int, bytes]], buckets: int) -> None:
        """Go on to this round; ``told`` has the answers of the rounds before, by level and bucket."""
        while self.parse.level < level:
            self.parse.step()
            if self.parse.level in told:
                name, many = self.parse.inside()
                bucket = _bucket(name, buckets)
                order = np.lexsort((many, bucket))
                shared = np.zeros(len(name), bool)
                shared[order] = _answers(bucket[order], told[self.parse.level])
                self.parse.keep(shared)

    def windows(self) -> None:
        """Names and checks of the windows that are left: distinct ones by bucket, and the place of each window's own."""
        alive = self.parse.alive
        self.start, self.docs = self.start[alive], self.docs[alive]
        names = Parse(self.text[0], self.start, *self.text[1:], self.width, True).names()
        checks = np.zeros(len(names), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.width):
                checks = checks * np.uint64(0xD1342543DE82EF95) + self.second[self.start + k]
        order = np.lexsort((checks, names))  # stable: a window's first place has its smallest document
        names, checks = names[order], checks[order]
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])])[: len(names)]
        first = order[new]
        bucket = _bucket(names[new], self.buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        place = np.empty(len(first), np.int64)
        place[by_bucket] = np.arange(len(first))
        self.of = np.empty(len(names), np.int64)
        self.of[order] = place[np.cumsum(new) - 1]
        self.bucket, self.name, self.check = bucket[by_bucket], names[new][by_bucket], checks[new][by_bucket]
        self.low = self.docs[first][by_bucket]

    buckets = 1


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(name ^ np.uint64(0x6A09E667F3BCC908)) % np.uint64(buckets)).astype(np.int64)


def _spans(bucket: np.ndarray):
    """(first, end) of each run of equal buckets."""
    cuts = np.nonzero(np.diff(bucket))[0] + 1
    edges = [0, *cuts.tolist(), len(bucket)]
    return [(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False) if lo < hi]


def _answers(bucket: np.ndarray, masks: dict[int, bytes]) -> np.ndarray:
    """The bits that the buckets told, in the order of the (sorted) ``bucket``."""
    out = np.zeros(len(bucket), bool)
    for lo, hi in _spans(bucket):
        out[lo:hi] = np.unpackbits(np.frombuffer(masks[int(bucket[lo])], np.uint8), count=hi - lo)
    return out


def _told(replies: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, bucket, mask in zip(*(replies.column(c).to_pylist() for c in ("level", "bucket", "mask")), strict=True):
        out.setdefault(level, {})[bucket] = mask
    return out


def _packed(block: int, level: int, bucket: np.ndarray, name: np.ndarray, check: np.ndarray | None, doc: np.ndarray) -> pa.Table:
    """One row for each bucket. ``doc`` has the document of each window, as places ``at`` in a list of ``docs``; of symbols, whether each has several, the others first."""
    rows = []
    for lo, hi in _spans(bucket):
        own = (block, level, int(bucket[lo]), name[lo:hi].tobytes())
        if check is None:
            rows.append((*own, None, None, np.array([hi - lo - doc[lo:hi].sum()], np.uint32).tobytes()))
        else:
            docs, at = np.unique(doc[lo:hi], return_inverse=True)
            rows.append((*own, check[lo:hi].tobytes(), docs.tobytes(), at.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32).tobytes()))
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split(" ")[0] for c in SENT.split(", ")])


def _symbols(level: int, width: int, buckets: int, levels: tuple[int, ...]):
    """Sends the symbols of a round: of blocks alone, and of blocks with the answers of earlier rounds."""

    def alone(key, table):
        return later(key, table, None)

    def later(key, table, replies):
        block = Block(table, width)
        block.to_level(level, {} if replies is None else _told(replies), buckets)
        name, many = block.parse.inside()
        bucket = _bucket(name, buckets)
        order = np.lexsort((many, bucket))
        return _packed(key[0].as_py(), level, bucket[order], name[order], None, many[order])

    return alone, later


def _windows(width: int, buckets: int, levels: tuple[int, ...]):
    """Sends the windows that are left after the last round: of blocks alone, and of blocks with the answers of the rounds."""

    def alone(key, table):
        return later(key, table, None)

    def later(key, table, replies):
        block = Block(table, width)
        block.buckets = buckets
        block.to_level(max(levels, default=0), {} if replies is None else _told(replies), buckets)
        block.windows()
        return _packed(key[0].as_py(), 0, block.bucket, block.name, block.check, block.low)

    return alone, later


def _judged(key, table):
    """One bit for each name of each block: symbols that stand in several documents; windows that start in a document with a smaller id."""
    names, checks, docs, sizes = [], [], [], []
    final = key[1].as_py() == 0
    for name, check, doc, at in zip(*(table.column(c).to_pylist() for c in ("names", "checks", "docs", "at")), strict=True):
        names.append(np.frombuffer(name, np.uint64))
        n = len(names[-1])
        sizes.append(n)
        if final:
            checks.append(np.frombuffer(check, np.uint64))
            doc = np.frombuffer(doc, np.int64)
            docs.append(doc[np.frombuffer(at, np.uint16 if len(doc) < 1 << 16 else np.uint32)])
        else:
            docs.append(np.arange(n) >= int(np.frombuffer(at, np.uint32)[0]))
    name, doc = np.concatenate(names), np.concatenate(docs)
    seen = np.zeros(len(name), bool)
    if final:
        check = np.concatenate(checks)
        order = np.lexsort((check, name))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])])
        low = np.minimum.reduceat(doc[order], np.nonzero(new)[0])
        seen[order] = doc[order] > low[np.cumsum(new) - 1]
    else:  # a block names a symbol once
        order = np.argsort(name, kind="stable")
        new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        many = np.add.reduceat(1 + doc[order].astype(np.int64), np.nonzero(new)[0])
        seen[order] = (many > 1)[np.cumsum(new) - 1]
    masks = [np.packbits(m).tobytes() for m in np.split(seen, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([table.column("block"), table.column("level"), table.column("bucket"), pa.array(masks, pa.binary())], ["block", "level", "bucket", "mask"])


def _kept(width: int, buckets: int, levels: tuple[int, ...]):
    def run(table, replies):
        block = Block(table, width)
        block.buckets = buckets
        told = _told(replies)
        block.to_level(max(levels, default=0), told, buckets)
        block.windows()
        seen = _answers(block.bucket, told.get(0, {}))
        covered = seen[block.of] | (block.docs > block.low[block.of])
        total = int(block.begin[-1]) + len(block.words[-1]) + 1 if block.words else 0
        at = block.start[covered]
        edge = np.bincount(at, minlength=total + width + 1) - np.bincount(at + width, minlength=total + width + 1)
        gone = np.cumsum(edge) > 0
        rows = []
        for doc, b, words, copies in zip(block.ids, block.begin.tolist(), block.words, block.copies, strict=True):
            out = gone[b : b + len(words)]
            left = [w for w, g in zip(words, out.tolist(), strict=True) if not g] if out.any() else words
            rows.append((doc, len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass"), copies))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.int64()]
        columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)]
        columns[3] = columns[3].cast(pa.string())
        return pa.Table.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "copies"])

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words without those of windows that start in an earlier document too."""
    size = text_bytes(docs)
    blocks, buckets = parts(size, BLOCK_BYTES), parts(size, BUCKET_BYTES)
    blocked = folded(docs).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    told: list[DataFrame] = []

    def answered(sent: DataFrame) -> None:
        told.append(sent.groupBy("bucket", "level").applyInArrow(_judged, REPLY))

    def beside_answers():
        return blocked.groupBy("block").cogroup(reduce(DataFrame.unionByName, told).groupBy("block"))

    for level in levels:
        alone, later = _symbols(level, width, buckets, levels)
        answered(beside_answers().applyInArrow(later, SENT) if told else blocked.groupBy("block").applyInArrow(alone, SENT))
    alone, later = _windows(width, buckets, levels)
    answered(beside_answers().applyInArrow(later, SENT) if told else blocked.groupBy("block").applyInArrow(alone, SENT))
    kept = beside_answers().applyInArrow(_kept(width, buckets, levels), "doc_id long, n_words long, n_removed long, kept string, copies long")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def digests(kept: DataFrame) -> DataFrame:
    """``kept`` as its SHA-256 in hex."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
