"""Inputs that are long, damaged or made to take long."""

import random
import time

from spanmill.llm import flac, licenses, toxicity
from tests.llm.test_text_operators import docs

import numpy as np


def test_ten_thousand_notices():
    s = licenses.Scanner()
    r = random.Random(1)
    own = [f"Copyright {r.randrange(1990, 2030)} by Name{k}. Licensed under the {r.choice(['MIT License', 'Apache License, Version 2.0'])}." for k in range(10_000)]
    began = time.perf_counter()
    _, found = s.scan("\n".join(own[:1000]))
    first = time.perf_counter() - began
    assert [f[0] for f in found] == ["MIT" if "MIT" in x else "Apache-2.0" for x in own[:1000]]
    began = time.perf_counter()
    _, found = s.scan("\n".join(own))
    assert [f[0] for f in found] == ["MIT" if "MIT" in x else "Apache-2.0" for x in own]
    assert time.perf_counter() - began < 30 * max(first, 0.2)


def test_long_license_text_is_scanned_whole():
    s = licenses.Scanner()
    text = ("This software has a license. " * 3000 + licenses.TEMPLATES[0][1]) * 2
    assert [f[0] for f in s.scan(text)[1]] == ["MIT", "MIT"]


def test_long_masked_tokens():
    model = toxicity.log_model(np.random.default_rng(2).integers(0, 50, toxicity.ALPHABET**4).astype(float))
    began = time.perf_counter()
    assert toxicity.decode("a**b" * 25_000, model) == "ab" * 25_000
    assert time.perf_counter() - began < 3
    began = time.perf_counter()
    for token in ("a*b#" * 16, "ab*" * 21, "1|!" * 20_000):
        toxicity.decode(token, model)
    assert time.perf_counter() - began < 20


def test_damaged_streams_are_rows(spark):
    media = flac.encode(docs(spark, ["one text", "another text " * 300, "third"])).collect()
    bad = bytearray(media[1].media)
    bad[len(bad) // 2] ^= 8
    rows = [(0, 8, bytes(media[0].media)), (1, 9, bytes(bad)), (2, 5, bytes(media[2].media)), (3, 1, None), (4, 1, b"fLaC"), (5, 1, bytes(media[1].media)[:-20])]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r.doc_id: r for r in flac.features(df).collect()}
    assert [got[k].error is None for k in range(6)] == [True, False, True, False, False, False]
    assert got[1].payload_sha256 is None and got[2].payload_bytes == 64
    assert flac.pcm_blocks(df).count() == 2
