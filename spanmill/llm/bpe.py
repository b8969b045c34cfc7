"""BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct pre-tokens of a run of documents into one symbol
chain. An index maps each mergeable pair to all its positions in the chain.
Ranks that occur are applied in ascending order; every merge is done at all its
positions at once and the lists of the pairs that arise or vanish beside them
are updated. A merge of rank r only gives rise to pairs of a higher rank, so one
pass over the ascending ranks yields what word-by-word encoding would.

The vocabulary and merges come from a tokenizer file given by path; they are
read on the driver and broadcast: ``MOST_IDS`` ids at most, which bounds the
broadcast. A file that asks for anything but plain byte-level BPE (a normalizer,
another split, stripping added tokens, ...) is refused, not read in part.

Defined results: a null text is an empty one; empty texts have no ids. Texts of
any length are encoded whole. Strings of added tokens inside a text become those
tokens. Equal rows give equal results; null ``doc_id`` stays null; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of

# The pre-token pattern of byte-level BPE. \s is spelled out, as
# the library's class leaves out the separators 1C to 1F.
SPACES = r"\t-\r \x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

#: Text that a task splits at once, and the distinct pre-tokens it remembers between runs of documents.
RUN_CHARS, KEPT = 6 << 20, 400_000
NONE = np.int32(-1)
#: Ids of a vocabulary; a pair of them is packed into 64 bits.
MOST_IDS = 1 << 22


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return letters


def unsupported(own: dict) -> list[str]:
    """What a tokenizer file asks for that is not done here."""
    model, split, back = own["model"], own.get("pre_tokenizer") or {}, own.get("decoder") or {}
    asks = {
        "a normalizer": own.get("normalizer"),
        "another model than BPE": model.get("type", "BPE") != "BPE",
        "another split than byte-level": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
        "another decoder than byte-level": back.get("type") != "ByteLevel",
        **{k: model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        **{f"added tokens with {k}": any(t.get(k) for t in own.get("added_tokens", ())) for k in ("single_word", "lstrip", "rstrip")},
    }
    return [what for what, asked in asks.items() if asked]


def load(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    if unsupported(own):
        raise ValueError(f"not plain byte-level BPE: {', '.join(unsupported(own))}")
    ids, merges, letters = own["model"]["vocab"], own["model"]["merges"], byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    added = {t["content"]: t["id"] for t in own["added_tokens"]}
    if max([*ids.values(), *added.values()]) >= MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids")
    pieces = {i: bytes(letters[c] for c in token) for token, i in ids.items()} | {i: t.encode() for t, i in added.items()}
    return {
        "byte_id": np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32),
        "left": np.array([ids[a] for a, _ in merges], np.int64),
        "right": np.array([ids[b] for _, b in merges], np.int64),
        "made": np.array([ids[a + b] for a, b in merges], np.int32),
        "pieces": [pieces.get(i, b"") for i in range(max(pieces) + 1)],
        "added": added,
    }


class Encoder:
    """Encodes and decodes runs of texts; keeps the ids of pre-tokens it has met."""

    def __init__(self, model: dict):
        self.model = model
        key = model["left"] << 32 | model["right"]
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        self.keys, self.ranks = key, order[first].astype(np.int32)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        added = model["added"]
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.known_added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def learn(self, words: list[str]) -> None:
        """Encode distinct pre-tokens in one chain and remember their ids."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.model["byte_id"][np.frombuffer(b"".join(raw), np.uint8)]
        n, ends = len(symbol), np.cumsum(sizes)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = NONE
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - sizes] = NONE
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that start at these positions into the index."""
            rank = self.rank(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.nonzero(rank[1:] != rank[:-1])[0] + 1
            for r, lo, hi in zip(rank[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[lo:hi])

        add(np.nonzero(after >= 0)[0].astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists) if len(lists) > 1 else lists[0])
            a, b = self.model["left"][r], self.model["right"][r]
            at = at[alive[at] & (symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of a chain of overlapping pairs, every other one
                start = np.concatenate([[True], after[at[:-1]] != at[1:]])
                first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.model["made"][r]
            alive[gone] = False
            after[at] = after[gone]
            more = after[at] >= 0
            before[after[at[more]]] = at[more]
            left = before[at]
            add(np.concatenate([at[more], left[left >= 0]]))
        ids = symbol[alive].astype("<u4").tobytes()
        stops = np.cumsum(np.add.reduceat(alive, ends - sizes, dtype=np.int64)) * 4
        starts = np.concatenate([[0], stops[:-1]])
        self.known.update((w, ids[i:j]) for w, i, j in zip(words, starts.tolist(), stops.tolist(), strict=True))

    def split(self, text: str) -> list[str]:
        """The pre-tokens and added tokens of a text, in order."""
        if self.cut is None or not self.cut.search(text):
            return self.find(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.find(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.find(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts = [self.split(t) for t in texts]
        new = set().union(*parts).difference(self.known)
        if len(self.known) + len(new) > KEPT and len(self.known) > len(self.known_added):
            self.known = {}
            new = set().union(*parts)
        self.known.update(self.known_added)
        new.difference_update(self.known_added)
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        get = self.model["pieces"].__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _encoded(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    """doc_id and what ``row`` makes of (encoder, ids) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches):
        own = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = [len(t.as_py() or "") for t in texts]
            for lo, hi in runs_of(sizes, RUN_CHARS):
                ids = own.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                rows = list(zip(*[row(own, x) for x in ids], strict=True))
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(rows, types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs``; ids are little-endian unsigned 32-bit integers."""
    return _encoded(docs, path, "doc_id long, n_tokens long, ids binary", lambda own, ids: (len(ids) // 4, ids))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        own = Encoder(shared.value)
        for batch in batches:
            texts = [own.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""

    def row(own: Encoder, ids: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    return _encoded(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
