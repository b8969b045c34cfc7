"""Toxicity scores of texts restored by a noisy-channel decoder.

Channel: writers swap letters for look-alikes, space letters out, mask or part
them with signs, and repeat them. A suspicious token, or a run of single
characters, becomes a lattice of the letters that each sign may stand for; a
Viterbi search finds the reading that is likeliest under the channel's costs and
a character model. Plain words are their own reading.

Character model: interpolated four-grams over 26 letters and a boundary, counted
over all documents (accents folded); its table has 2 ** 20 cells whatever the
corpus, so its broadcast has a fixed size.

Classifier: features are restored words and their beginnings of 3 to 7 letters.
They are counted over a bounded sample of ``labelled`` rows (12,000 by default,
chosen by a hash of the id) that are not held out; those most tied to label 1 are
kept, ``features`` at most, and a logistic regression on their counts and
densities is fitted on the same sample. Each text is scored whole.

Defined results: a null or empty text, and any text without a known feature,
gets the score of the intercept; scores depend on the text alone; labels that are
null or have a null id are not used, the largest of several labels of an id
counts; rows with a null ``doc_id`` are not held out and have no label; without
labels of both kinds all scores are the share of label 1 (0 without labels). An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a sign may stand for, and letters of other scripts that look like Latin ones.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "(": "c", "+": "t", "€": "e", "£": "l", "¡": "i",
}
ALIKE = str.maketrans("асеорхуіїѕјԁ", "aceopxyiisjd")
HIDDEN = str.maketrans("", "", "​‌‍⁠﻿­")
JUNK = ".,-_*#~^'`:;/\\\"=&%?"
MASK = "*#"
#: Costs of the channel: a look-alike, a sign left out, a mask read as a letter, a letter's run read as two, a space within a run.
SWAP, DROP, MASKED, TWICE, SPACE = 1.0, 0.7, 4.0, 0.7, 2.0

#: The same for a mask within a word, where it mostly stands for a letter: left out, read as one.
INNER_DROP, INNER_MASKED = 3.0, 2.0

#: States from which on a step goes over all of them in numpy (which changes the time, not the reading), and the different steps that are kept at a time.
BEAM, HELD = 128, 64

ALPHABET = 32  # 0 is the boundary, 1 to 26 are letters
BLANK = 0
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
EDGE = re.compile(r"^(?:([^\w\s])\1{2,})+|(?:([^\w\s])\2{2,})+$")
JOINED = re.compile(r"[^\W\d_]{2}|[*#]{2}")
THREE = re.compile(r"(.)\1\1")
LOWEST, LONGEST = 3, 7


def _letters() -> np.ndarray:
    """The symbol of each Latin-1 byte: its letter without accent, or the boundary."""
    out = np.zeros(256, np.uint32)
    for b in range(256):
        base = unicodedata.normalize("NFD", chr(b).lower())[0]
        base = {"ß": "s", "æ": "a", "ø": "o", "ð": "d", "þ": "t"}.get(base, base)
        if "a" <= base <= "z":
            out[b] = ord(base) - 96
    return out


SYMBOL = _letters()


def fold(char: str) -> int:
    """The symbol of a character."""
    raw = char.encode("latin-1", "replace")
    return int(SYMBOL[raw[0]]) if raw != b"?" else BLANK


def grams(text: str) -> np.ndarray:
    """The four-grams of a text; what precedes a boundary is no context."""
    s = SYMBOL[np.frombuffer(b" " * 3 + text.encode("latin-1", "replace") + b" ", np.uint8)]
    a, b, c, d = s[:-3], s[1:-2], s[2:-1], s[3:]
    b = np.where(c == 0, 0, b)
    a = np.where(b == 0, 0, a)
    keep = (c != 0) | (d != 0)
    return (((a * ALPHABET + b) * ALPHABET + c) * ALPHABET + d)[keep]


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of the fourth symbol after the first three, from all texts of ``docs``."""
    cells = ALPHABET**4

    def counted(batches):
        total, held, size = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                if t := text.as_py():
                    held.append(t)
                    size += len(t)
                if size > 4 << 20:
                    total += np.bincount(grams(" ".join(held)), minlength=cells)
                    held, size = [], 0
        if held:
            total += np.bincount(grams(" ".join(held)), minlength=cells)
        for bucket in range(16):
            own = total[bucket * cells // 16 : (bucket + 1) * cells // 16]
            at = np.nonzero(own)[0]
            if len(at):
                row = [pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<u4"), own[at].astype("<i8")))]
                yield pa.RecordBatch.from_arrays(row, ["bucket", "at", "counts"])

    def added(key, table):
        total = np.zeros(cells // 16, np.int64)
        for at, counts in zip(table.column("at").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(at, "<u4")] += np.frombuffer(counts, "<i8")
        at = np.nonzero(total)[0]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "counts": pa.array([total[at].tobytes()], pa.binary())})

    schema = "bucket int, at binary, counts binary"
    rows = docs.select("text").mapInArrow(counted, schema).groupBy("bucket").applyInArrow(added, schema).collect()  # 16 rows, 2 ** 20 cells at most
    total = np.zeros(cells, np.float64)
    for r in rows:
        total[r.bucket * cells // 16 + np.frombuffer(r.at, "<u4").astype(np.int64)] = np.frombuffer(r.counts, "<i8")
    return log_model(total)


def log_model(total: np.ndarray) -> np.ndarray:
    """Log probabilities from four-gram counts: each order is mixed with the next lower one, the last with equal chances."""
    four = total.reshape((ALPHABET,) * 4)
    below = np.full(ALPHABET, 1 / 27)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        counts = four.sum(axis=axes) if axes else four
        seen = counts.sum(axis=-1, keepdims=True)
        below = (counts + 4 * below) / (seen + 4)
    return np.log(below).astype(np.float32).ravel()


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for each place what may be read there, with its cost. A space may be read between letters spaced out.

    Each mask, also of a run, may be a letter; it likely is one between letters, unless they all stand alone (as in i*d*i*o*t).
    """
    places: list[tuple[str, list[tuple[str, float]]]] = []
    ends = [k for k, c in enumerate(token) if c not in MASK]
    inner = range(ends[0], ends[-1]) if ends and JOINED.search(token) else range(0)
    made: dict[tuple[str, bool], tuple[str, list[tuple[str, float]]]] = {}
    for k, c in enumerate(token):
        if own := made.get((c, k in inner)):
            places.append(own)
            continue
        s = fold(c)
        if s:
            places.append((chr(96 + s), [(chr(96 + s), 0.0)]))
        elif c == " ":
            places.append((" ", [("", 0.0), (" ", SPACE)]))
        else:
            ways = [(x, SWAP) for x in LOOKS.get(c, "")]
            if c in MASK:
                ways += [(chr(97 + x), INNER_MASKED if k in inner else MASKED) for x in range(26)]
            if c in JUNK or c in "!|(+":
                ways.append(("", INNER_DROP if c in MASK and k in inner else DROP))
            places.append((c, ways or [(" ", DROP)]))
        made[c, k in inner] = places[-1]
    out, at = [], 0
    while at < len(places):
        c, ways = places[at]
        end = at
        while end < len(places) and places[end][0] == c:
            end += 1
        if end - at >= 3 and c not in MASK:  # a run is read as one of its kind, or as two
            ways = ways + [(x * 2, cost + TWICE) for x, cost in ways if x.strip()]
            out.append(ways)
            at = end
        else:
            out.append(ways)
            at += 1
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token under the channel and the character model (Viterbi; the state is the last three letters).

    Exact for tokens of any length. Scores are relative to the best, so that a step which meets the scores and ways of an
    earlier one is that step. Readings are kept as links to what was read before: time and memory grow with the token's length.
    """
    scores = np.zeros(1, np.int16), np.zeros(1)  # the states, ascending, and their scores
    links: dict[int, tuple | None] = {0: None}
    known: dict[tuple, tuple] = {}
    seen, at, held = {}, 0, []
    for ways in map(tuple, readings(token)):
        step = known.get((at, ways))
        if step is None:
            if len(known) == HELD:
                links, held = linked(links, held, np.arange(len(scores[0]))), []
                known, seen, at = {}, {}, 0
            after, way, back = stepped(*scores, ways, model)
            place, _ = seen.setdefault(b"".join(x.tobytes() for x in after), (len(seen) + 1, after))
            step = known[at, ways] = (place, after, way, back)
        at, scores = step[:2]
        held.append((ways, *step[2:]))
    end = int((scores[1] + model.reshape(-1, ALPHABET)[scores[0], 0]).argmax())
    return unlinked(linked(links, held, np.array([end]))[end])


def unlinked(link: tuple | None) -> str:
    """What was read along the links."""
    out = []
    while link:
        out.append(link[0])
        link = link[1]
    return "".join(reversed(out))


def linked(links: dict[int, tuple | None], held: list, own: np.ndarray) -> dict[int, tuple | None]:
    """What leads to the states at the places ``own`` after the steps ``held`` (ways, way, back), given the links before them; what leads to none is let go."""
    through = [own]
    for _, _, back in reversed(held):
        before = back[through[-1]]
        through.append(np.unique(before) if len(before) > 1 else before)
    for (ways, way, back), at in zip(held, reversed(through[:-1]), strict=True):
        links = {k: (ways[w][0], links[b]) for k, w, b in zip(at.tolist(), way[at].tolist(), back[at].tolist(), strict=True)}
    return links


def stepped(states: np.ndarray, scores: np.ndarray, ways: tuple, model: np.ndarray) -> tuple:
    """The states and scores after one place of the lattice, and for each state its way and the place of the state before."""
    if len(states) > BEAM:
        return stepped_wide(states, scores, ways, model)
    cell, step = model.item, {}
    for k, (state, score) in enumerate(zip(states.tolist(), scores.tolist(), strict=True)):
        for w, (letters, cost) in enumerate(ways):
            now, value = state, score - cost
            for x in letters:
                s = 0 if x == " " else ord(x) - 96
                value += cell(now << 5 | s)
                now = 0 if not s else (now << 5 | s) & 0x7FFF
            if now not in step or value > step[now][0]:
                step[now] = (value, w, k)
    after = sorted(step)
    value = np.array([step[x][0] for x in after])
    return (np.array(after, np.int16), value - value.max()), *(np.array([step[x][k] for x in after], np.int16) for k in (1, 2))


def stepped_wide(states: np.ndarray, scores: np.ndarray, ways: tuple, model: np.ndarray) -> tuple:
    """The same over all states at once."""
    after = model.reshape(ALPHABET**3, ALPHABET)
    score = np.full(ALPHABET**3, -np.inf)
    score[states] = scores
    top, way, back = np.full(ALPHABET**3, -np.inf), np.zeros(ALPHABET**3, np.int16), np.zeros(ALPHABET**3, np.int16)
    single = {ord(x) - 96: (k, cost) for k, (x, cost) in enumerate(ways) if len(x) == 1 and x != " "}
    if len(single) > 3:  # all single letters at once, by the letter that falls out of the state
        value, source = np.full((ALPHABET**2, ALPHABET), -np.inf), np.zeros((ALPHABET**2, ALPHABET), np.int16)
        for a, (now, step) in enumerate(zip(score.reshape(ALPHABET, -1, 1), after.reshape(ALPHABET, -1, ALPHABET), strict=True)):
            if now.max() > -np.inf:
                reached = now + step
                better = reached > value
                np.copyto(value, reached, where=better)
                np.copyto(source, np.int16(a << 10) + np.arange(ALPHABET**2, dtype=np.int16)[:, None], where=better)
        for s, (k, cost) in single.items():
            top.reshape(-1, ALPHABET)[:, s], way.reshape(-1, ALPHABET)[:, s], back.reshape(-1, ALPHABET)[:, s] = value[:, s] - cost, k, source[:, s]
    for k, (letters, cost) in enumerate(ways):
        if len(single) > 3 and len(letters) == 1 and letters != " ":
            continue
        now, source = score - cost, np.arange(ALPHABET**3, dtype=np.int16)
        for x in letters:
            s = 0 if x == " " else ord(x) - 96
            # The letter before the last two falls out of the state; a boundary leaves none.
            value = (now + after[:, s]).reshape(ALPHABET if s else ALPHABET**3, -1)
            first = value.argmax(0)
            low = np.arange(value.shape[1])
            to = low << 5 | s if s else low
            now, source, before = np.full(ALPHABET**3, -np.inf), np.zeros_like(source), source
            now[to], source[to] = value[first, low], before[first * value.shape[1] + low]
        better = now > top
        top[better], way[better], back[better] = now[better], k, source[better]
    alive = np.flatnonzero(top > -np.inf)
    return (alive.astype(np.int16), top[alive] - top.max()), way[alive], np.searchsorted(states, back[alive]).astype(np.int16)


class Restorer:
    """Readings of tokens."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def word(self, token: str) -> str:
        """The reading of one token: plain words are returned in lower case without signs at their ends."""
        w = token.lower()
        if w.isalpha() and w.isascii() and not THREE.search(w):
            return w
        if not w.isascii():
            w = unicodedata.normalize("NFKC", w.translate(HIDDEN))
            if re.search("[a-z]", w):
                w = w.translate(ALIKE)
        w = EDGE.sub("", w).strip(".,;:?\"'`()[]{}<>“”„«»…_-~").rstrip("!|&%#*=/").lstrip("&%#*=/")
        if (w.isalpha() and not THREE.search(w)) or not any(map(str.isalpha, w)) or ("@" in w and "." in w):
            return w
        return decode(w, self.model)

    def counts(self, text: str) -> Counter:
        """How often each token occurs, runs of spaced-out characters taken as one."""
        runs = SPACED.findall(text)
        words = Counter((SPACED.sub(" ", text) if runs else text).split())
        words.update(runs)
        return words

    def restored(self, text: str) -> list[str]:
        """The words of a text as they are scored, in any order, repeated as often as they occur."""
        out: list[str] = []
        for token, n in self.counts(text).items():
            out += self.word(token).split() * n
        return out


def parts_of(word: str) -> list[str]:
    """The features of a restored word: itself and its beginnings."""
    return [f"{word}$", *(word[:k] for k in range(LOWEST, min(LONGEST, len(word)) + 1))] if word else []


def labelled_rows(docs: DataFrame, labels: DataFrame, train: Column, most: int) -> DataFrame:
    """(text, toxic) of ``most`` labelled training rows, chosen by a hash of the id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # One row for each id, so that the sample's bound holds whatever is repeated.
    return found.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(rows: DataFrame, model: np.ndarray, features: int = 1024, rounds: int = 400) -> dict:
    """Feature names, weights and intercept from labelled ``rows`` (text, toxic)."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), sum(n for t, n in totals.items() if t != 1)
    none = {"names": {}, "weights": np.zeros((0, 2)), "bias": float(np.log(n1 / n0)) if n1 and n0 else (40.0 if n1 else -40.0)}
    if not n1 or not n0:
        return none

    def present(batches):
        own = Restorer(shared.value)
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set().union(*(own.word(t).split() for t in own.counts(text or "")))
                seen[int(toxic == 1)].update(set().union(*map(parts_of, words)))
        for names in [list(seen[0].keys() | seen[1].keys())]:
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                columns = [pa.array(some, pa.string()), *(pa.array([seen[k][x] for x in some], pa.int64()) for k in (1, 0))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "a", "b"])

    sums = rows.mapInArrow(present, "name string, a long, b long").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # How surprising the share of label 1 among the rows with the feature is: its log likelihood ratio.
    share = n1 / (n1 + n0)
    rate = F.col("a") / (F.col("a") + F.col("b"))
    gain = F.col("a") * F.log(rate / share) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    chosen = sums.where((F.col("a") >= 3) & (rate > 2 * share)).withColumn("gain", gain).where("gain > 6").orderBy(F.desc("gain"), "name").limit(features).collect()
    names = {r.name: k for k, r in enumerate(chosen)}
    if not names:
        return none
    wanted = context.broadcast(names)

    def vectors(batches):
        own = Reader(shared.value, wanted.value)
        for batch in batches:
            out = [own.vector(t or "") for t in batch.column(0).to_pylist()]
            columns = [pa.array([list(map(int, x)) for x, _, _ in out], pa.list_(pa.int32())), *(pa.array([list(map(float, v[k])) for v in out], pa.list_(pa.float64())) for k in (1, 2)), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["at", "some", "dense", "toxic"])

    data = rows.mapInArrow(vectors, "at array<int>, some array<double>, dense array<double>, toxic int").toPandas()  # bounded by the sample and the features
    y = (data["toxic"].to_numpy() == 1).astype(float)
    row = np.repeat(np.arange(len(data)), data["at"].map(len))
    column = np.concatenate([*data["at"], []]).astype(np.int64)
    value = np.stack([np.concatenate([*data[c], []]) for c in ("some", "dense")], axis=1)
    weights, bias = np.zeros((len(names), 2)), float(np.log(n1 / n0))
    moments = [np.zeros_like(weights), np.zeros_like(weights)]
    for step in range(1, rounds + 1):  # Adam on the mean log loss with a small quadratic penalty
        z = np.bincount(row, weights=(value * weights[column]).sum(1), minlength=len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        slope = np.stack([np.bincount(column, weights=value[:, k] * error[row], minlength=len(names)) for k in (0, 1)], axis=1) / len(y) + 2e-5 * weights
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope * slope
        weights -= 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        bias -= 0.1 * error.mean() * 4
    return {"names": names, "weights": weights, "bias": float(bias)}


class Reader:
    """Counts of the chosen features in restored texts."""

    def __init__(self, model: np.ndarray, names: dict[str, int]):
        self.restorer, self.names, self.known = Restorer(model), names, {}

    def features(self, token: str) -> tuple[int, ...]:
        """The chosen features of a token's reading."""
        return tuple(self.names[p] for w in self.restorer.word(token).split() for p in parts_of(w) if p in self.names)

    def vector(self, text: str) -> tuple[list[int], list[float], list[float]]:
        """The features that a text has, how many of each (up to 4, as a share), and their density."""
        found: Counter = Counter()
        known, total = self.known, 0
        if len(known) > 1_000_000:
            known.clear()
        for token, n in self.restorer.counts(text).items():
            total += n
            own = known.get(token)
            if own is None:
                own = known[token] = self.features(token)
            for k in own:
                found[k] += n
        at = sorted(found)
        return at, [min(found[k], 4) / 4 for k in at], [min(1.0, float(np.log1p(100 * found[k] / total)) / 2) for k in at]


class Scorer:
    """Scores of texts in a task."""

    def __init__(self, model: np.ndarray, fitted: dict):
        self.reader, self.weights, self.bias = Reader(model, fitted["names"]), fitted["weights"], fitted["bias"]

    def scores(self, texts) -> list[float]:
        out = []
        for text in texts:
            at, some, dense = self.reader.vector(text.as_py() or "")
            z = self.bias + float((self.weights[at] * np.array([some, dense]).T).sum()) if at else self.bias
            out.append(1 / (1 + float(np.exp(-max(-40.0, min(40.0, z))))))
        return out


def score(docs: DataFrame, model: np.ndarray, fitted: dict) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, fitted))

    def run(batches):
        own = Scorer(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column, mod: int = 3, rest: int = 1) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, labelled: int = 12_000, features: int = 1024) -> tuple[np.ndarray, dict]:
    """The character model of all documents and the classifier of the labelled ones that are not held out."""
    model = character_model(docs)
    return model, fit(labelled_rows(docs, labels, ~held_out(F.col("doc_id")), labelled), model, features)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic)."""
    out = score(docs, *learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold; all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    place, names = docs.columns.index("text"), docs.columns

    def run(batches):
        own = Scorer(*shared.value)
        for batch in batches:
            keep = [x < threshold for x in own.scores(batch.column(place))]
            yield batch.filter(pa.array(keep, pa.bool_())).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)
