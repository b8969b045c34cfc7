"""Nearest neighbours against brute force, and the pipeline stage by stage."""

import numpy as np
import pytest

from spanmill.llm import ann, simhash
from spanmill.llm.queries import ORACLE, QUERIES

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def brute(ids, x, every, k):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        at = ids.index(q)
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        out[q] = sorted((float(a), i) for a, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def test_nearest_neighbours(spark):
    r = np.random.default_rng(0)
    centers = r.normal(size=(12, 16)) * 3
    x = (centers[r.integers(0, 12, 1500)] + r.normal(size=(1500, 16)) * 0.4).astype(np.float32)
    x[100:600] = x[7]  # a third of all rows are one vector
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    odd = [(9000, None, 0), (9100, [0.0] * 16, 0), (9200, [float("nan")] + [1.0] * 15, 0), (9300, [1.0], 0), (None, [1.0] * 16, 0), (9400, [None] + [1.0] * 15, 0), rows[5]]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, score int")
    got: dict = {}
    for g in ann.nearest(df, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append((g.score, g.vec_id))
    want = brute(list(range(1500)), x.astype(np.float64), 50, 10)
    assert set(got) == set(want)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.95
    for q in (100, 150, 500):  # ties of one vector: the smallest ids
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    for q, found in got.items():
        assert found == sorted(found)
        for d, i in found:
            assert d == pytest.approx(float(np.sqrt(((x[i].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum())), abs=1e-12)


@pytest.mark.parametrize("chunk", [8192, 16])
def test_exact_search_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    monkeypatch.setattr(ann, "BATCH", chunk // 4)
    r = np.random.default_rng(1)
    x = r.integers(0, 3, size=(300, 6)).astype(np.float32) + 1  # many ties and equal vectors
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for g in ann.nearest(df, every=10, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append((g.score, g.vec_id))
    assert got == brute(list(range(300)), x.astype(np.float64), 10, 10)
    near = ann.nearest(df, every=10, parts=2, shortlist=12).collect()
    assert sorted(map(tuple, near)) == sorted(map(tuple, ann.nearest(df.repartition(7), every=10, parts=2, shortlist=12).collect()))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).collect()) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 0")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = left
        left = stage(spark, before, SF)
        if name != "bpe":
            assert left.columns == columns
        if name in ("toxicity", "near_dedup"):
            assert left.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "near_dedup":
            near = simhash.near_duplicates(before)
            assert left.count() == near.select("component_id").distinct().count()
        if name == "pii":
            assert left.count() == before.count() and left.where("text LIKE '%@mail%'").count() == 0
        if name != "bpe":
            path_rows = left.collect()
            left = spark.createDataFrame(path_rows, docs.schema)
    assert left.columns[0] == "doc_id" and left.count() == len(path_rows)


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_odd_rows(spark, tmp_path, empty):
    rows = [] if empty else [(None, "a b c", "en", "s1", 3, 7), (None, None, None, None, None, 7), (1, "", "en", "s1", 0, 7), (2, "Mr. John Smith, a.b@c.org " * 40, "de", "s2", 9, 7), (2, "Mr. John Smith, a.b@c.org " * 40, "de", "s2", 9, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(out) == 0) == empty and {r.doc_id for r in out} <= {None, 1, 2}


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=repr)
