"""Exact duplicates, hard negatives and whitening against brute force."""

import hashlib
import re

import numpy as np
import pytest

from spanmill.llm import exactdedup, golomb, hardneg, whitening
from spanmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("space", [1 << 10, 1 << 40, 1 << 63])
def test_golomb_codes_round_trip(space):
    own = np.random.default_rng(3)
    for count in (0, 1, 2, 100):
        numbers = np.sort(own.integers(0, space, count).astype(np.uint64))
        for width in {0 if space < 1 << 12 else 30, golomb.width_for(space, count)}:
            if count and int(numbers[-1]) >> width > 1 << 22:
                continue
            assert golomb.decode(golomb.encode(numbers, width), count, width).tolist() == numbers.tolist()


def groups(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text, ...) rows by a plain dictionary."""
    by: dict = {}
    for k, (doc_id, text) in enumerate(rows):
        by.setdefault(re.sub("[ \t-\r]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for text, own in by.items():
        keep = min(own)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[k][0], rows[keep[3]][0], len(own), k == keep[3], sha) for *_, k in own]
    return sorted(out, key=repr)


ODD = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, " \n"), (6, ""), (7, "ä b"), (8, "ä  b"), (None, "ab"), (None, "lone"), (9, "x" * 70_000), (10, "x " * 70_000), (11, "one"), (11, "one"), (12, " ab"), (13, "a b\x1c")]


@pytest.mark.parametrize(("block", "owned", "spare"), [(16_384, 65_536, 12), (3, 2, 12), (5, 4, -20)])
def test_exact_groups(spark, monkeypatch, block, owned, spare):
    """Small blocks and owners; few bits, so that different texts share fingerprints and only bytes tell them apart."""
    monkeypatch.setattr(exactdedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(exactdedup, "OWNED", owned)
    monkeypatch.setattr(exactdedup, "SPARE", spare)
    if spare < 0:
        monkeypatch.setattr(exactdedup.Ranges, "of", classmethod(lambda cls, rows: cls(4, 3)))
    rows = ODD + [(100 + k, "the same text") for k in range(40)] + [(200 + k, f"text {k % 25}") for k in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, size int").repartition(5)
    got = sorted((tuple(r) for r in exactdedup.exact_groups(df).collect()), key=repr)
    assert got == groups(rows)


def test_exact_groups_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exactdedup.exact_groups(df).count() == 0


def test_texts_are_not_shuffled_with_bitmaps(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = exactdedup.exact_groups(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # bitmaps for lone classes, bitmaps for suspects, results of groups
    ranges = exactdedup.Ranges.of(df.count())
    classes = exactdedup.local_classes(df, ranges, 4)
    joined = classes.join(exactdedup.repeated(classes, ranges).hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    hashed = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\)", joined)
    assert ("block", "4") in hashed and len([h for h in hashed if h[0] == "block"]) == 1


def hard(rows, every, positives, negatives):
    """Rows of ``mine`` by all inner products."""
    q = {i: [int(np.floor(256 * float(c))) for c in v] for i, v, _ in rows}
    label = {i: own for i, _, own in rows}
    out = []
    for a in sorted(i for i in q if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a], q[i], strict=True)) for i in q if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if label[i] == label[a]][:positives]:
            near = [i for i in ranked if label[i] != label[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize(("tile", "chunk"), [(8 << 20, 32 << 20), (1, 400)])
def test_hard_negatives(spark, monkeypatch, tile, chunk):
    monkeypatch.setattr(hardneg, "TILE_BYTES", tile)
    monkeypatch.setattr(hardneg, "CHUNK_BYTES", chunk)
    own = np.random.default_rng(5)
    x = (own.normal(size=(400, 10)) * 0.2 + 0.1).astype(np.float32)
    x[50:180] = x[3]  # one vector fills a third of all rows, under several labels
    x[180:220] = np.round(x[180:220])  # many ties
    x[220:260] *= -1
    rows = [(k, v.tolist(), int(own.integers(0, 4))) for k, v in enumerate(x)]
    odd = [(1000, None, 1), (1050, [float("nan")] + [0.1] * 9, 1), (1100, [0.1] * 10, None), (None, [0.1] * 10, 1), (1150, [None] + [0.1] * 9, 1), (1200, [1.0], 1), (1250, [], 1), (1300, [1e30] * 10, 1), rows[50], rows[7]]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *odd]], "vec_id long, embedding array<float>, label int, score int").repartition(3)
    got = sorted(tuple(r) for r in hardneg.mine(df, every=10).collect())
    want = hard(rows, 10, 5, 3)
    assert want and got == want


def test_hard_negatives_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hardneg.mine(spark.createDataFrame([], schema)).count() == 0
    alone = [(0, [1.0, 0.0], 1)]
    assert hardneg.mine(spark.createDataFrame(alone, schema)).count() == 0
    zero = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)]
    assert [tuple(r) for r in hardneg.mine(spark.createDataFrame(zero, schema)).collect()] == [(0, 1, 1, 2, 0, 0)]
    twice = [(0, [1.0], 2), (0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]
    assert [tuple(r) for r in hardneg.mine(spark.createDataFrame(twice, schema)).collect()] == [(0, 1, 1, 2, 65536, 58880)]


def test_bounds_discard_most_and_lose_none():
    """Of vectors with a fast spectrum, most are dropped before the last part; what is verified includes every one over the floor."""
    own = np.random.default_rng(9)
    x = np.floor(256 * own.normal(size=(3000, 32)) * 0.8 ** np.arange(32)).astype(np.int64)
    by = hardneg.Rotation(np.linalg.svd(x.astype(float))[2].T, [8, 16, 24, 32], 1e-12)
    rows = hardneg.Rows(np.arange(3000), np.zeros(3000, np.int64), x).turned(by)
    scores = x @ x[0]
    floor, seen = int(np.sort(scores)[-20]), []

    def alive(low, high):
        seen.append(len(low))
        return high >= floor

    at = hardneg._bounded(0, rows, rows, np.arange(3000), rows.rotated[:, :8] @ rows.rotated[0, :8], by, alive)
    assert set(np.nonzero(scores >= floor)[0]) <= set(at) and len(at) < 25
    assert seen[1] < 1000 and seen[-1] < 100


def whitened(rows, k):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, (n * x - s) ** 2, ((n * x - s) / n) @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize(("rows_at_once", "fan"), [(4096, 16), (3, 2)])
def test_whitening(spark, monkeypatch, rows_at_once, fan):
    monkeypatch.setattr(whitening, "ROWS", rows_at_once)
    monkeypatch.setattr(whitening, "FAN", fan)
    own = np.random.default_rng(2)
    x = (own.normal(size=(300, 6)) * np.array([5, 3, 2, 1, 0.5, 0.25]) + own.normal(size=6)).astype(np.float32)
    x[100:200] = x[3]
    rows = [(k if k % 9 else None, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, [float("inf")] + [0.0] * 5), (1002, [None] + [0.0] * 5), (1003, [0.0]), (1004, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows + odd], "vec_id long, embedding array<float>, component int").repartition(7)
    got = whitening.whiten(df, components=4).collect()
    n, squares, want, explained = whitened(rows, 4)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    for k in range(4):
        mine = sorted((r.deviation, round(abs(r.whitened), 7)) for r in got if r.component == k + 1)
        assert mine == sorted((int(d), round(abs(w), 7)) for d, w in zip(squares.sum(1), want[:, k], strict=True))
        signed = {r.vec_id: r.whitened for r in got if r.component == k + 1 and r.vec_id is not None}
        flip = np.sign(signed[1] * want[1, k])
        assert all(abs(signed[i] * flip - want[i, k]) < 1e-9 for i in signed)
        assert next(r.explained for r in got if r.component == k + 1) == pytest.approx(explained[k], rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # one distinct vector has no variance
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(10)], schema)
    got = whitening.whiten(line).collect()
    assert len(got) == 10 and got[0].explained == pytest.approx(1)
    far = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0])], schema)
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}
    big = whitening.Centre(1 << 40, [3 << 40, 5 << 40], 1 << 40)
    assert big.deviation(np.array([[3, 5], [1 << 30, 5]])).to_pylist() == [0, None]


def test_whole_tables_are_used(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    n, squares, want, _ = whitened(rows, 16)
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    for r in got:
        assert r.deviation == squares[at[r.vec_id]].sum() and abs(abs(r.whitened) - abs(want[at[r.vec_id], r.component - 1])) < 1e-8
