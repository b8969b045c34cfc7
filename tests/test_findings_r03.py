"""Cases of the round's findings, each of which failed before."""

import os
import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanmill import plans
from spanmill.operators import aliases as A


def events_table(folder, values):
    """An events table in ``folder``: the values of each user, one an hour."""
    rows = [(n, u, v) for n, (u, v) in enumerate((u, v) for u, own in values.items() for v in own)]
    start = datetime(2024, 1, 1)
    columns = {"event_id": [r[0] for r in rows], "ts": [start + timedelta(hours=n) for n in range(len(rows))], "user_id": [r[1] for r in rows], "event_type": ["view"] * len(rows), "value": [r[2] for r in rows], "props": ["{}"] * len(rows)}
    pq.write_table(pa.table(columns), os.path.join(folder, "events.parquet"))


def against_sql(spark, folder, name, tables):
    """Both results of a query over the tables of ``folder``, exactly, in order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    mine = plans.queries()[name](spark, str(folder))
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, mine.collect())), sorted(theirs)


@pytest.mark.parametrize("name", ["win08_active_span", "win12_quiet_tail"])
def test_thresholds_equal_sql_to_the_last_bit(spark, tmp_path, name):
    own = random.Random(4)
    values = {u: [own.choice([own.uniform(0, 99), 31.7, 11.3, 7.1, 53.9]) for _ in range(own.choice([4, 6, 8, 9, 13, 25]))] for u in range(800)}
    # Two distances from the middle differ in the last bit, and the threshold lies between them.
    values[800] = [115.49, 58.1, 82.11, 190.84, 187.39, 88.11, 124.86, 144.64, 182.33, 157.19]
    values[801] = [25.87, 15.48, 69.35, 132.21, 92.48, 146.35, 130.28, 167.83, 37.58, 12.99]
    events_table(tmp_path, values)
    mine, theirs = against_sql(spark, tmp_path, name, ["events"])
    assert mine == theirs


def test_confidence_is_rounded_as_sql_does(spark):
    rule = A.AliasRule("sale", ("x",), ("buy",), confidence=0.9)
    rows = [(n, n, "buy", 1, v / 100 / 200, 0, True) for n, v in enumerate(range(1, 18_400))]
    actions = spark.createDataFrame(rows, "case_id long, action_id long, family string, count long, confidence double, start long, visible boolean")
    captions = actions.select("case_id", F.lit("x").alias("caption"))
    got = {r.case_id: r.confidence for r in A.attached(actions, captions, [rule]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT i AS case_id, (i + 1) / 100.0::DOUBLE / 200 AS sure FROM range(18399) t(i)")
    want = dict(con.execute("SELECT case_id, round(least(0.92, greatest(sure, 0.1) * 0.9), 4) FROM v").fetchall())
    assert got == want


def test_coactivation_links_from_a_share_of_three_tenths(spark):
    assert "0.3" in plans.oracle_sql()["mine06_coactivation_components"]
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    got = plans.queries()["mine06_coactivation_components"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    # The components of the relation 'parallel', as the query's first SQL had them.
    from spanmill.plans.joins import REL
    from spanmill.plans.mining import PACK

    first = f"""{REL.replace('WITH', 'WITH RECURSIVE', 1)}, {PACK} SELECT packet, count(*) AS members, string_agg(DISTINCT channel, '+' ORDER BY channel) AS symbol, min(s) AS s, max(e) AS e FROM pk JOIN ev ON event_id = node GROUP BY 1 HAVING count(DISTINCT channel) >= 2"""
    assert sorted(map(tuple, got.select("packet", "members", "symbol", "s", "e").collect())) == sorted(con.execute(first).fetchall())


def test_a_task_of_baskets_does_not_grow_with_the_table(spark, monkeypatch):
    from spanmill.sources import adapters

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    whole = sorted(map(tuple, adapters.baskets(spark, sf).collect()))
    monkeypatch.setattr(adapters, "ROWS_IN_TASK", 500)
    for by, at in (("tx", 0), ("case_id", 1)):
        parts = adapters.baskets(spark, sf, by).rdd.glom().map(lambda rows: [tuple(r) for r in rows]).collect()
        assert sorted(r for p in parts for r in p) == whole
        assert max(map(len, parts)) < len(whole) / 4
        homes = {}
        for k, p in enumerate(parts):
            for r in p:
                assert homes.setdefault(r[at], k) == k


@pytest.mark.parametrize("name", ["str06_ordered_lookup", "str06_lexicon_lookup"])
def test_terms_made_of_texts_are_not_broadcast(spark, name):
    # The size of their files says that they are small; what is made of them is not.
    plan = plans.queries()[name](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan


def documents_table(folder, rows):
    """A documents table in ``folder`` of (doc_id, text, source)."""
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": [r[2] for r in rows], "n_chars": [len(r[1] or "") for r in rows]}
    pq.write_table(pa.table(columns), os.path.join(folder, "documents.parquet"))


@pytest.mark.parametrize("name", ["str03_readable_ngrams", "str04_phrase_support"])
def test_grams_of_ids_that_occur_again(spark, tmp_path, name):
    own = random.Random(6)
    vocabulary = ["river", "stone", "the", "of", "a", "it's", "x", "7", "light", "by", "stone's", "x1"]
    texts = [" ".join(own.choice(vocabulary) for _ in range(own.randrange(12))) for _ in range(60)]
    rows = [(n % 40, t, own.choice(["web", "book"])) for n, t in enumerate(texts)] + [(3, texts[3], "web"), (3, texts[3], "web"), (50, None, "web")]
    documents_table(tmp_path, rows)
    mine, theirs = against_sql(spark, tmp_path, name, ["documents"])
    assert mine == theirs and len(mine) > 5


def shuffled(spark):
    """Bytes shuffled by the session so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("name, share", [("str03_readable_ngrams", 0.05), ("str04_phrase_support", 0.9)])
def test_grams_are_not_shuffled_more_than_needed(spark, tmp_path, name, share):
    own = random.Random(7)
    vocabulary = ["".join(own.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)]
    rows = [(n, " ".join(own.choice(vocabulary) for _ in range(200)), "web") for n in range(300)]
    documents_table(tmp_path, rows)
    before = shuffled(spark)
    plans.queries()[name](spark, str(tmp_path)).collect()
    grams = sum(len(" ".join(w[k : k + n])) for w in (r[1].split() for r in rows) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    assert shuffled(spark) - before < share * grams


def test_sets_of_transactions_are_neither_written_nor_sent(spark, monkeypatch):
    from spanmill.operators import mining

    written, own = [], mining.stored
    monkeypatch.setattr(mining, "stored", lambda df, label="part": written.append((label, df._jdf.queryExecution().executedPlan().toString())) or own(df, label))
    rows = [(n, n % 7, i) for n in range(40) for i in ("a", "b", "c", "d")[: 2 + n % 3]]
    got = {tuple(r.items): (r.n, r.cases) for r in mining.itemsets(spark.createDataFrame(rows, "tx long, case_id long, item string"), 3, 5).collect()}
    assert got[("a", "b")] == (40, 7) and got[("a", "b", "c")] == (26, 7) and len(got) == 10
    assert [label for label, _ in written] == ["transactions", "itemsets", "itemsets"]
    assert all("hashpartitioning(items" not in line or "case_id" not in line for _, plan in written for line in plan.splitlines())


def test_baskets_are_not_dealt_by_item(spark):
    # A task an item would grow with the table, as would a table broadcast to all tasks.
    plan = plans.queries()["mine10_transactions"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item" not in plan and plan.count("BroadcastExchange") == 1  # the written counts of items


@pytest.mark.parametrize("by", ["tx", "case_id"])
def test_no_table_of_baskets_is_broadcast(spark, by):
    from spanmill.sources.adapters import baskets

    plan = baskets(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), by)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastExchange" not in plan


def test_joint_expressions_compile_and_sources_are_read_once(spark, tmp_path, monkeypatch):
    from spanmill.operators import joints as J

    own = random.Random(9)
    rows = [(c, k, [[own.gauss(0, 1) for _ in range(3)] for _ in range(22)]) for c in range(2) for k in range(40)]
    frames = spark.createDataFrame(rows, "case_id long, frame long, joints array<array<double>>")
    frames.write.parquet(f"{tmp_path}/frames")
    spark.createDataFrame([(0, "left", 3, 9), (1, "right", 5, 20)], "case_id long, side string, s long, e long").write.parquet(f"{tmp_path}/spans_here")
    read, write = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df, label="part": read.append((label, " ".join(df.inputFiles()))) or write(df, label))
    spark.conf.set("spark.sql.codegen.fallback", "false")  # an expression too large to compile is an error here
    try:
        found = J.arm_events(spark.read.parquet(f"{tmp_path}/frames"), spark.read.parquet(f"{tmp_path}/spans_here"), J.ArmRule(planarity=0.1), J.ReachRule(), 16)
        assert found.count() > 0
        J.support_events(spark.read.parquet(f"{tmp_path}/frames"), J.SupportRule(1, 2), 16).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert [label for label, files in [*read, ("events", " ".join(found.inputFiles()))] if "spans_here" in files] == ["sources"]
