"""Media columns: FLAC streams of 8-bit mono samples.

A payload of bytes is stored as samples (byte - 128) in frames of ``BLOCK``
samples, each with the cheapest of a constant, verbatim, fixed or linear
predictor and Rice-coded residuals. A seek table lists the sample and byte offset
of every frame, so that frames are decoded side by side: a step of the decoder
advances all frames of a group by one sample, in numpy. Header checksums, frame
checksums and the digest of all samples are verified; a stream that fails raises
an error.

``encode`` makes the media column, ``pcm_blocks`` decodes it to one row for each
frame with its sample offset, and ``features`` describes whole streams; there a stream
that fails is a row with its error. The query writes the media column to the shared
folder and reads it back between the two. Groups
hold ``GROUP`` frames whatever the length of a text, so that memory is bounded
but for the text itself.

Defined results: a null text is an empty one; an empty payload is 64 bytes 0;
texts of any length are stored whole; equal texts give equal streams; a null
``doc_id`` stays null; repeated rows are stored one by one; an empty table gives
an empty result; other columns are ignored. Streams with other sample sizes,
more channels or wasted bits raise an error.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of, stored

BLOCK, GROUP, UNIT = 512, 2048, 64
ORDER, PRECISION, SHIFT = 4, 11, 8  # of the linear predictor that the encoder tries
RATE = 8000
#: The writer's options for the media column: pages large enough to hold copies that stand together.
PAGES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
# Coefficients of the format's fixed predictors by order, latest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(polynomial: int, bits: int) -> np.ndarray:
    """The checksum of each byte."""
    out, top = [], 1 << (bits - 1)
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ polynomial if c & top else c << 1
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.uint16)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8 = CRC8.tolist()


def crc8(data: bytes) -> int:
    """The checksum of a frame header."""
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The checksum of each piece [start, stop) of ``data``; leading zeros do not change it, so pieces are aligned at their ends."""
    most = int((stops - starts).max(initial=0))
    at = stops[None, :] - most + np.arange(most)[:, None]
    byte = np.where(at >= starts[None, :], data[np.maximum(at, 0)], 0)
    c = np.zeros(len(starts), np.uint16)
    for row in byte:
        c = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)) ^ row]
    return c


def number(n: int) -> bytes:
    """A frame number as the format writes it (UTF-8 extended to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6))
    head = (0xFF << (7 - more) | n >> (6 * more)) & 0xFF
    return bytes([head, *(0x80 | n >> (6 * k) & 0x3F for k in reversed(range(more)))])


def read_number(data: bytes, at: int) -> tuple[int, int]:
    """The frame number at a place, and where it ends."""
    head = data[at]
    more = 0
    while head & (0x80 >> more):
        more += 1
    if more == 1 or more > 7:
        raise ValueError("bad frame number")
    more = max(0, more - 1)
    n = head & (0x7F >> (more + 1 if more else 0))
    for b in data[at + 1 : at + 1 + more]:
        n = n << 6 | b & 0x3F
    return n, at + 1 + more


def linear(samples: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each row of ``samples``, latest sample first."""
    s = samples.astype(np.float64)
    r = np.stack([(s[:, k:] * s[:, : s.shape[1] - k]).sum(1) for k in range(ORDER + 1)])
    a = np.zeros((ORDER, len(s)))
    error = np.maximum(r[0], 1e-9)
    for i in range(ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a.T * (1 << SHIFT)), -limit - 1, limit).astype(np.int64)


def residuals(samples: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """What a predictor (one row of coefficients for each row of samples) leaves; warm-up samples leave 0."""
    order = coefficients.shape[1]
    guess = np.zeros((len(samples), samples.shape[1] - order), np.int64)
    for j in range(order):
        guess += coefficients[:, j : j + 1] * samples[:, order - 1 - j : samples.shape[1] - 1 - j]
    out = np.zeros(samples.shape, np.int64)
    out[:, order:] = samples[:, order:] - (guess >> shift)
    return out


def frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """The frames of the rows of ``samples`` (all of one length), with their numbers."""
    count, n = samples.shape
    samples = samples.astype(np.int64)
    tried = [(k, np.tile(np.array(FIXED[k], np.int64), (count, 1)), 0) for k in (0, 1, 2)]
    tried.append((ORDER, linear(samples), SHIFT))
    kinds, best, zig, rice = np.full(count, -1), np.full(count, 8 * n, np.int64), np.zeros((count, n), np.int64), np.zeros(count, np.int64)
    for kind, (order, coefficients, shift) in enumerate(tried):
        rest = residuals(samples, coefficients, shift)
        folded = (rest << 1) ^ (rest >> 63)
        k = np.clip(np.floor(np.log2(folded.sum(1) / max(1, n - order) * 0.7 + 1e-9)), 0, 14).astype(np.int64)
        cost = (folded >> k[:, None]).sum(1) + (k + 1) * (n - order) + 8 * order + 10 + (9 + order * PRECISION if shift else 0)
        better = cost < best
        kinds[better], best[better], rice[better] = kind, cost[better], k[better]
        zig[better] = folded[better]
    kinds[(samples == samples[:, :1]).all(1)] = -2
    size = {BLOCK: (9, b"")}.get(n) or ((6, bytes([n - 1])) if n <= 256 else (7, (n - 1).to_bytes(2, "big")))
    heads, lengths = [], np.zeros(count, np.int64)
    for i in range(count):
        head = bytes([0xFF, 0xF8, size[0] << 4 | 4, 0b0010]) + number(int(numbers[i])) + size[1]
        head += bytes([crc8(head)])
        kind = int(kinds[i])
        bits, wide = int.from_bytes(head, "big"), 8 * len(head)
        if kind == -2:
            bits, wide = bits << 16 | int(samples[i, 0]) & 0xFF, wide + 16
        elif kind == -1:
            bits, wide = (bits << 8 | 0b10) << 8 * n | int.from_bytes((samples[i] & 0xFF).astype(np.uint8).tobytes(), "big"), wide + 8 + 8 * n
        else:
            order, coefficients, shift = tried[kind]
            bits, wide = bits << 8 | ((0b100000 | order - 1) << 1 if shift else (0b001000 | order) << 1), wide + 8
            for x in samples[i, :order].tolist():
                bits = bits << 8 | x & 0xFF
            wide += 8 * order
            if shift:
                bits, wide = (bits << 4 | PRECISION - 1) << 5 | shift, wide + 9
                for x in coefficients[i].tolist():
                    bits = bits << PRECISION | x & ((1 << PRECISION) - 1)
                wide += PRECISION * order
            bits, wide = bits << 10 | int(rice[i]), wide + 10
        heads.append((bits, wide))
        lengths[i] = wide
    orders = np.array([t[0] for t in tried])[np.maximum(kinds, 0)]
    coded = (kinds[:, None] >= 0) & (np.arange(n)[None, :] >= orders[:, None])
    quotient = np.where(coded, zig >> rice[:, None], 0)
    code = np.where(coded, quotient + 1 + rice[:, None], 0)
    total = lengths + code.sum(1)
    room = (total + 7) // 8 * 8
    begin = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    for (bits, wide), at in zip(heads, begin.tolist(), strict=True):
        left = -wide % 8
        out[at : at + wide] = np.unpackbits(np.frombuffer((bits << left).to_bytes((wide + left) // 8, "big"), np.uint8))[:wide]
    place = (begin + lengths)[:, None] + np.cumsum(code, axis=1) - code + quotient
    place, value, k = place[coded], zig[coded], np.broadcast_to(rice[:, None], zig.shape)[coded]
    out[place] = 1
    for j in range(int(k.max(initial=0))):
        some = k > j if (k <= j).any() else slice(None)
        out[(place + k - j)[some]] = (value >> j & 1)[some]
    data = np.packbits(out)
    starts, stops = begin // 8, (begin + room) // 8
    checks = crc16(data, starts, stops)
    raw = data.tobytes()
    return [raw[a:b] + int(c).to_bytes(2, "big") for a, b, c in zip(starts.tolist(), stops.tolist(), checks.tolist(), strict=True)]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (of at least one byte)."""
    rows = [(d, f, payload[f * BLOCK : (f + 1) * BLOCK]) for d, payload in enumerate(payloads) for f in range(-(-len(payload) // BLOCK))]
    made: dict[tuple[int, int], bytes] = {}
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r[2]), []).append(r)
    for n, own in by_size.items():
        for at in range(0, len(own), GROUP):
            some = own[at : at + GROUP]
            samples = np.frombuffer(b"".join(r[2] for r in some), np.uint8).reshape(-1, n).astype(np.int16) - 128
            made.update(zip(((r[0], r[1]) for r in some), frames(samples, np.array([r[1] for r in some])), strict=True))
    out = []
    for d, payload in enumerate(payloads):
        own = [made[d, f] for f in range(-(-len(payload) // BLOCK))]
        sizes = [len(x) for x in own]
        digest = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest
        points, offset = [], 0
        for f, size in enumerate(sizes):
            points.append((f * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(payload) - f * BLOCK).to_bytes(2, "big"))
            offset += size
        most = (1 << 24) // 18 - 1  # points that a metadata block can hold; later frames follow the last point one by one
        table = b"".join(points[:most])
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


@dataclass
class Stream:
    """What the metadata of a stream say."""

    samples: int
    digest: bytes
    points: list[tuple[int, int]]  # sample and byte offset of frames
    first: int  # where the first frame begins


def parse(media: bytes) -> Stream:
    """The metadata of a stream."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [(int.from_bytes(body[k : k + 8], "big"), int.from_bytes(body[k + 8 : k + 16], "big")) for k in range(0, size, 18)]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 36 & 0xFF != 7:
        raise ValueError("only 8-bit mono streams are read")
    return Stream(packed & (1 << 36) - 1, info[18:34], [p for p in points if p[0] != (1 << 64) - 1], at)


def _signed(value: np.ndarray, bits) -> np.ndarray:
    return np.where(value >> (bits - 1) & 1, value - (np.int64(1) << bits), value)


class Decoder:
    """Decodes frames that begin at known bytes of a buffer, side by side."""

    def __init__(self, data: bytes):
        self.data = data
        padded = np.frombuffer(data + b"\x00" * 8, np.uint8)
        self.bytes = padded
        bits = np.unpackbits(padded)
        bits[-1] = 1
        self.ones = np.flatnonzero(bits).astype(np.int32)
        self.before = np.cumsum(bits, dtype=np.int32) - bits
        wide = padded.astype(np.uint32)
        self.words = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]

    def take(self, at: np.ndarray, bits) -> np.ndarray:
        """The next ``bits`` (1 to 24) at each bit."""
        word = self.words[at >> 3].astype(np.int64) << (at & 7) & 0xFFFFFFFF
        return word >> (32 - bits)

    def head(self, at: int) -> tuple[int, int, int]:
        """The number, the samples and the end of the header of the frame at a byte; its checksum is verified."""
        d = self.data
        if d[at : at + 2] != b"\xff\xf8" or d[at + 3] != 0b0010:
            raise ValueError("no frame header of an 8-bit mono stream")
        n, end = read_number(d, at + 4)
        code = d[at + 2] >> 4
        if code in (6, 7):
            wide = code - 5
            size, end = int.from_bytes(d[end : end + wide], "big") + 1, end + wide
        else:
            size = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8)
        end += {12: 1, 13: 2, 14: 2}.get(d[at + 2] & 0xF, 0)
        if crc8(d[at:end]) != d[end]:
            raise ValueError("a frame header's checksum differs")
        return n, size, end + 1

    def decode(self, starts: list[int]) -> tuple[list[np.ndarray], list[int], list[int]]:
        """Samples, frame numbers and ends (in bytes) of the frames; their checksums are verified."""
        heads = [self.head(s) for s in starts]
        count, size = len(starts), np.array([h[1] for h in heads])
        at = np.array([h[2] for h in heads]) * 8
        kind = self.take(at, 8)
        if (kind & 0x81).any():
            raise ValueError("wasted bits or a padding error")
        kind = kind >> 1
        at = at + 8
        most = int(size.max())
        out = np.zeros((most, count), np.int64)
        order = np.where(kind & 0x20, (kind & 0x1F) + 1, np.where(kind & 0x08, kind & 0x07, 0))
        for i in np.flatnonzero(kind == 0):
            out[: size[i], i] = _signed(self.take(at[i : i + 1], 8), 8)
            at[i] += 8
        for i in np.flatnonzero(kind == 1):
            out[: size[i], i] = self.bytes[at[i] >> 3 : (at[i] >> 3) + size[i]].view(np.int8)
            at[i] += 8 * size[i]
        coded = np.flatnonzero(kind > 1)
        coded = coded[np.argsort(-size[coded], kind="stable")]  # those that still have samples are always a prefix
        if len(coded):
            done, ends = self.rice(coded, at[coded], size[coded], order[coded], (kind[coded] & 0x20) > 0)
            out[: len(done), coded] = done
            at[coded] = ends
        ends = (at + 7) // 8
        first = np.array(starts)
        if (crc16(self.bytes, first, ends) != (self.bytes[ends].astype(np.uint16) << 8 | self.bytes[ends + 1])).any():
            raise ValueError("a frame's checksum differs")
        return [out[: size[i], i] for i in range(count)], [h[0] for h in heads], (ends + 2).tolist()

    def rice(self, lanes: np.ndarray, at: np.ndarray, size: np.ndarray, order: np.ndarray, is_linear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples (one column for each lane) and end bits of frames with predictors."""
        count, depth, most = len(lanes), int(order.max()), int(size[0])
        out = np.zeros((most, count), np.int64)
        for t in range(depth):
            own = order > t
            out[t, own] = _signed(self.take(at[own], 8), 8)
            at[own] += 8
        coefficients, shift = np.zeros((depth, count), np.int64), np.zeros(count, np.int64)
        for k in range(1, min(depth, 4) + 1):
            own = ~is_linear & (order == k)
            coefficients[:k, own] = np.array(FIXED[k], np.int64)[:, None]
        if is_linear.any():
            wide = np.zeros(count, np.int64)
            wide[is_linear] = self.take(at[is_linear], 4) + 1
            shift[is_linear] = _signed(self.take(at[is_linear] + 4, 5), 5)
            if (shift < 0).any():
                raise ValueError("a negative shift")
            at[is_linear] += 9
            for k in range(depth):
                own = is_linear & (order > k)
                coefficients[k, own] = _signed(self.take(at[own], wide[own]), wide[own])
                at[own] += wide[own]
        method = self.take(at, 2)
        if (method > 1).any():
            raise ValueError("an unknown residual coding")
        wide = method + 4
        split = self.take(at + 2, 4)
        at = at + 6
        span = size >> split
        rice, raw = np.zeros(count, np.int64), np.full(count, -1, np.int64)
        several = bool((split > 0).any())
        for t in range(most):
            live = int(np.searchsorted(-size, -t, side="left"))  # sizes above t
            if t == 0 or several:
                new = np.flatnonzero((t % span[:live] == 0))
                if len(new):
                    rice[new] = self.take(at[new], wide[new])
                    at[new] += wide[new]
                    escaped = rice[new] == (1 << wide[new]) - 1
                    raw[new] = -1
                    some = new[escaped]
                    raw[some] = self.take(at[some], 5)
                    at[some] += 5
            if t < depth:
                own = np.flatnonzero(order[:live] <= t)
            else:
                own = slice(0, live)
            start, k = at[own], rice[own]
            stop = self.ones[self.before[start]]
            tail = np.where(k > 0, self.take(stop + 1, np.maximum(k, 1)), 0)
            folded = (stop - start).astype(np.int64) << k | tail
            rest = (folded >> 1) ^ -(folded & 1)
            end = stop + 1 + k
            if (raw[own] >= 0).any():
                r = raw[own]
                plain = np.where(r > 0, _signed(self.take(start, np.maximum(r, 1)), np.maximum(r, 1)), 0)
                rest, end = np.where(r >= 0, plain, rest), np.where(r >= 0, start + r, end)
            at[own] = end
            guess = np.zeros(len(rest), np.int64)
            for j in range(min(depth, t)):
                guess += coefficients[j, own] * out[t - 1 - j, own]
            out[t, own] = rest + (guess >> shift[own])
        return out, at


def decode_streams(medias: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """For each stream its blocks: (sample offset, byte offset, bytes); all checksums and the digest are verified."""
    streams = [parse(m) for m in medias]
    work = [(d, p, s.first + p[1]) for d, s in enumerate(streams) for p in s.points]
    found: list[dict[int, tuple[int, bytes, int]]] = [{} for _ in medias]
    for lo in range(0, len(work), GROUP):
        some = work[lo : lo + GROUP]
        pieces, starts, at = [], [], 0
        for k, (d, _, begin) in enumerate(some):
            follows = work[lo + k + 1] if lo + k + 1 < len(work) else None
            stop = follows[2] if follows and follows[0] == d else min(len(medias[d]), begin + 16 * BLOCK)
            pieces.append(medias[d][begin:stop])
            starts.append(at)
            at += stop - begin
        samples, _, ends = Decoder(b"".join(pieces)).decode(starts)
        for (d, point, _), s, start, end in zip(some, samples, starts, ends, strict=True):
            found[d][point[0]] = (point[1], (s + 128).astype(np.uint8).tobytes(), end - start)
    out = []
    for media, stream, own in zip(medias, streams, found, strict=True):
        blocks, sample, offset = [], 0, 0
        while sample < stream.samples:
            if sample not in own:  # a frame that the seek table does not list
                begin = stream.first + offset
                (s,), _, (end,) = Decoder(media[begin : begin + (1 << 16)]).decode([0])
                own[sample] = (offset, (s + 128).astype(np.uint8).tobytes(), end)
            place, block, size = own[sample]
            if place != offset:
                raise ValueError("the seek table differs from the frames")
            blocks.append((sample, offset, block))
            sample, offset = sample + len(block), offset + size
        whole = np.frombuffer(b"".join(b for _, _, b in blocks), np.uint8)
        if sample != stream.samples or hashlib.md5((whole ^ 0x80).tobytes()).digest() != stream.digest:
            raise ValueError("the samples' digest differs")
        out.append(blocks)
    return out


def payload_of(text: str | None) -> bytes:
    """A text in UTF-8, filled up with bytes 0 to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\x00" * (-len(raw) % UNIT or (0 if raw else UNIT))


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            sizes = [len(t.as_py() or "") + UNIT for t in texts]
            for lo, hi in runs_of(sizes, GROUP * BLOCK):
                own = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                media = pa.array(encode_payloads([payload_of(t) for t in own]), pa.binary())
                n = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, media], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def written(docs: DataFrame) -> DataFrame:
    """``encode``, written to the shared folder and read back.

    Rows of a partition are put in order of their texts and pages compressed, so that copies, whose streams are equal, cost little.
    """
    return stored(encode(docs.sortWithinPartitions("text")), "media", **PAGES)


#: What a stream that is damaged, cut short or of another kind raises.
DAMAGED = (ValueError, IndexError, KeyError, OverflowError)


def read_streams(medias: list[bytes]) -> tuple[list[list[tuple[int, int, bytes]]], list[str | None]]:
    """The blocks of each stream, and what is wrong with it, if anything; a damaged stream has no blocks and leaves the others alone."""
    try:
        return decode_streams(medias), [None] * len(medias)
    except DAMAGED as e:
        if len(medias) == 1:
            return [[]], [str(e) or type(e).__name__]
        half = len(medias) // 2
        (a, b), (c, d) = read_streams(medias[:half]), read_streams(medias[half:])
        return a + c, b + d


def _decoded(batches):
    """(batch, media, blocks, errors) of runs of rows (doc_id, n_bytes, media)."""
    for batch in batches:
        media = batch.column(2)
        for lo, hi in runs_of([len(m.as_py() or b"") for m in media], GROUP * BLOCK):
            own = [m or b"" for m in media.slice(lo, hi - lo).to_pylist()]
            yield batch.slice(lo, hi - lo), own, *read_streams(own)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, samples, pcm): the blocks of every stream of ``media``, unsigned 8-bit samples."""
    schema = "doc_id long, block long, sample_offset long, byte_offset long, samples long, pcm binary"
    kinds = [*[pa.int64()] * 5, pa.binary()]

    def run(batches):
        for batch, _, streams, _ in _decoded(batches):
            rows = [(i, k, s, o, len(b), b) for i, blocks in zip(batch.column(0).to_pylist(), streams, strict=True) for k, (s, o, b) in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], [x.split(" ")[0] for x in schema.split(", ")])

    return media.where("media IS NOT NULL").select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def feature(payload: bytes) -> str:
    """Energy, sign changes and peak of the samples, as text."""
    s = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    return f"energy={int((s * s).sum(dtype=np.int64)) / len(s):.3f};crossings={int(np.count_nonzero(np.diff(s < 0)))};peak={int(np.abs(s).max())}"


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error) of every stream, from what is read back.

    ``error`` is null; for a stream that cannot be read it says why, and what the samples would tell is null.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch, own, streams, errors in _decoded(batches):
            rows = []
            for blocks, m, error in zip(streams, own, errors, strict=True):
                p = b"".join(b for _, _, b in blocks)
                told = (None, None, None) if error else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]))
                rows.append((*told, len(m), hashlib.sha256(m).hexdigest(), None if error else feature(p), error))
            columns = [batch.column(0), batch.column(1), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
