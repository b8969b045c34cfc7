"""Coreference, script, form and near misses of personal data, and spaces that fill up."""

import re

import pytest
from pyspark.sql import functions as F

from spanmill.llm import pii
from tests.llm.test_text_operators import docs

GREEK = "Mr. Γιώργος Παπάς"


@pytest.fixture(scope="module")
def out(spark):
    texts = [
        "Mr. John Smith came. Then Smith left and SMITH sang.", "MR. JOHN SMITH WAS HERE", "Dr. Alex Stone met Ms. Alex Stone.", f"{GREEK} called.", "at 1700000000000 ms", "md5 d41d8cd98f00b204e9800998ecf8427e of it",
        "Mr. Conor O'Neil and Frau Anna-Maria Müller-Schmidt", "Smith is a trade.", "api_key=d41d8cd98f00b204e9800998ecf8427e", "card 4222222222222 here", "Mrs. J. Smith", "Господин Иван Петров",
    ]
    return texts, {r.doc_id: (r.text, [e.kind for e in r.entities]) for r in pii.replace(docs(spark, texts)).select("row.doc_id", "text", "entities").collect()}


def test_one_person_has_one_surrogate(out):
    _, got = out
    given, family, bare, loud = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Then (\w+) left and (\w+) sang\.", got[0][0]).groups()
    assert family == bare == loud.title() and family != "Smith" and loud.isupper()
    assert got[1][0] == f"MR. {given.upper()} {family.upper()} WAS HERE"
    a, b = re.fullmatch(r"Dr\. (\w+ \w+) met Ms\. (\w+ \w+)\.", got[2][0]).groups()
    assert a == b and got[10][0].endswith(family) and got[7][0] == "Smith is a trade."


def test_script_and_form_are_kept(out):
    _, got = out
    assert re.fullmatch(r"Mr\. [Α-Ωα-ως]+ [Α-Ωα-ως]+ called\.", got[3][0]) and got[3][0] != f"{GREEK} called."
    assert re.fullmatch(r"Господин [А-Я][а-я]+ [А-Я][а-я]+", got[11][0])
    assert re.fullmatch(r"Mr\. \w+ O'[A-Z][a-z]+ and Frau [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+", got[6][0]) and "Neil" not in got[6][0]


def test_near_misses_stay(out):
    texts, got = out
    assert [got[k] for k in (4, 5, 7)] == [(texts[k], []) for k in (4, 5, 7)]
    assert got[8][1] == ["secret"] and got[9][1] == ["card"] and "d41d8" not in got[8][0]


def test_full_spaces_end(spark):
    own = [("ip", f"192.168.{k // 256}.{k % 256}", "") for k in range(40_000)]
    got = pii.assign(spark.createDataFrame(own, "kind string, entity string, form string").repartition(4), "k").collect()
    new = {r.surrogate for r in got}
    assert len(got) == len(new) == 40_000 and not new & {x[1] for x in own}
    assert all(re.fullmatch(r"(?:192\.168|10\.\d+)\.\d+\.\d+", x) for x in new)


def test_full_spaces_of_every_kind_end(spark, monkeypatch):
    """All spellings of some short forms are entities: none is left to give, so that only longer ones end the rounds."""
    monkeypatch.setattr(pii, "WIDER", 2)
    full = {"ip": [f"{k:x}::" for k in range(16)], "ssn": [f"9{k}" for k in range(10)], "card": [f"4{k}" for k in range(10)], "phone": [f"{k}{j}" for k in range(2, 10) for j in range(10)], "email": [f"{k}@a.org" for k in range(10)], "secret": [f"sk-{k}" for k in range(10)]}
    own = [(kind, e, "") for kind, es in full.items() for e in es]
    got = pii.assign(spark.createDataFrame(own, "kind string, entity string, form string"), "k").collect()
    assert len(got) == len({(r.kind, r.surrogate) for r in got}) == len(own)
    assert not {(r.kind, r.surrogate) for r in got} & {o[:2] for o in own}


def test_surrogates_that_are_longer_than_their_entity(spark, monkeypatch):
    rows = spark.createDataFrame([("123-45-6789", 0, "ssn", "9234567890123"), ("00 49 (0)30 1234567", 0, "phone", "+49212345678901")], "raw string, n int, kind string, surrogate string")
    got = {r.kind: r.replacement for r in pii._rendered(rows).collect()}
    assert got == {"ssn": "923-45-67890123", "phone": "00 49 (0)21 2345678901"}
    entities = spark.createDataFrame([("ssn", "123456789", ""), ("ip", "10.1.2.3", ""), ("phone", "+4930123456", "")], "kind string, entity string, form string")
    wide = {r.kind: r.surrogate for r in pii._candidates(entities, "k", pii.WIDER).collect()}
    assert len(wide["ssn"]) == 11 and re.fullmatch("fd00(:[0-9a-f]{4}){7}", wide["ip"]) and len(wide["phone"]) == 13


def test_repeated_rows_ties_and_other_columns(spark):
    df = docs(spark, ["mail a.b@c.org", "mail a.b@c.org", None, ""], extra=True).withColumn("raws", F.lit(1)).withColumn("entities", F.lit(2))
    got = pii.replace_documents(df.unionByName(df))
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == 8 and len({r.text for r in rows if r.doc_id < 2}) == 1
