"""Substring dedup over many blocks and buckets, with names that collide, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from spanmill.llm import recompression as R
from tests.llm.test_text_operators import brute_repeats, docs, words


def repeated(seed, vocabulary=30, n=60):
    r = random.Random(seed)
    own = [f"t{k}" for k in range(vocabulary)]
    texts = [" ".join(r.choice(own) for _ in range(r.randrange(0, 80))) for _ in range(n)]
    for _ in range(n):
        source = r.choice(texts).split()
        at = r.randrange(0, max(1, len(source)))
        texts.append(" ".join([*[r.choice(own) for _ in range(r.randrange(0, 20))], *source[at : at + r.randrange(8, 40)], "end"]))
    return [*texts, "a " * 400, "a " * 60, " ".join(["a b"] * 50), None, "", texts[0]]


@pytest.mark.parametrize("levels", [(), (1,), (2,), (1, 2), (1, 2, 3)])
def test_many_blocks_and_buckets(spark, monkeypatch, levels):
    monkeypatch.setattr(R, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(R, "BUCKET_BYTES", 1500)
    texts = repeated(3)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in R.digests(R.remove_repeats(docs(spark, texts), levels=levels)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts)


def exchange(texts, blocks, buckets, levels, width=13):
    """What the exchanges do, in this process."""
    tables = [pa.table({"doc_id": pa.array(range(b, len(texts), blocks), pa.int64()), "text": pa.array(texts[b::blocks], pa.string()), "copies": pa.array([1] * len(texts[b::blocks]), pa.int64())}) for b in range(blocks)]
    replies = [pa.table({c: pa.array([], t) for c, t in (("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("mask", pa.binary()))})]

    def of(b):
        both = pa.concat_tables(replies)
        return both.filter(pa.compute.equal(both.column("block"), b))

    for level in [*levels, 0]:
        run = (R._symbols(level, width, buckets, levels) if level else R._windows(width, buckets, levels))[1]
        sent = pa.concat_tables([run((pa.scalar(b),), t, of(b)) for b, t in enumerate(tables)])
        for bucket in sorted(set(sent.column("bucket").to_pylist())):
            own = sent.filter(pa.compute.equal(sent.column("bucket"), bucket))
            replies.append(R._judged((pa.scalar(bucket), pa.scalar(level)), own))
    out = {}
    for b, t in enumerate(tables):
        for r in R._kept(width, buckets, levels)(t, of(b)).to_pylist():
            out[r["doc_id"]] = (r["n_words"], r["n_removed"], r["kept"])
    return [out[k] for k in range(len(texts))]


@pytest.mark.parametrize("bits", [2, 8, 64])
def test_names_that_collide(monkeypatch, bits):
    pair_names = R.pair_names
    monkeypatch.setattr(R, "pair_names", lambda a, b, salt=0: pair_names(a, b, salt) & np.uint64((1 << bits) - 1))
    texts = repeated(5)
    got = exchange(texts, 7, 5, (1, 2))
    want = brute_repeats(texts)
    assert [g[:2] for g in got] == [w[:2] for w in want]


def test_equal_windows_have_equal_interiors():
    r = random.Random(1)
    own = [f"w{k}" for k in range(6)]
    text = [r.choice(own) for _ in range(60)]
    one, two = ["x", *text, "y"], [*text[20:], *text, "w1"]
    names = []
    for t, start in ((one, 1), (two, 40)):
        n = R.word_numbers([x.encode() for x in t])[:, 0].copy()
        names.append(R.Parse(n, np.arange(start, start + 48), np.zeros(len(n), bool), np.zeros(len(n), np.int64), 13, True).names())
    assert (names[0] == names[1]).all()


def test_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(None, text)] * 3 + [(4, text), (4, text), (9, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in R.remove_repeats(df).collect())
    assert got == [(False, 4, 20, 0), (False, 4, 20, 0), (False, 9, 21, 20), (True, 0, 20, 20), (True, 0, 20, 20), (True, 0, 20, 20)]
    alone = R.remove_repeats(df.where("doc_id IS NULL")).collect()
    assert [r.n_removed for r in alone] == [0, 0, 0] and len(words(text)) == 20
