"""Lexicon tables against every term looked for in every text."""

import random
import re

import pytest

from tracewell.operators.lexicon import GRAM, lexicon_matches, matched_terms


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    letters = "aab cé😀\n"
    texts = [None, "", "a", "  Red\tbrick HOUSE, red", "redbrick", "a(b)c \\E d", "word " * 30_000 + "last one"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(150)]
    terms = [None, "", "a", "é", "ab", "b c", "red brick", "house", "last one", "(b)c", "\\E", "not there", "a", "a" * 40, "word word"]
    terms += ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(300)]
    return texts, terms


def squeezed(text):
    return re.sub(r"\s+", " ", text.lower()).strip()


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_substrings_and_phrases(spark, data, limit):
    texts, terms = data
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    got = lexicon_matches(df, lexicon, "id", limit=limit).collect()
    assert sorted(map(tuple, got)) == sorted((i, t) for i, x in enumerate(texts) if x for t in {t for t in terms if t} if t in x)
    got = lexicon_matches(df, lexicon, "id", phrases=True, limit=limit).collect()
    sought = {squeezed(t) for t in terms if t} - {""}
    want = [
        (i, t) for i, x in enumerate(texts) if x for t in sought
        if t in squeezed(x) and re.search(r"(?<!\w)" + re.escape(t) + r"(?!\w)", squeezed(x))
    ]
    assert sorted(map(tuple, got)) == sorted(want)


def test_lists_and_empty_tables(spark, data):
    texts, terms = data
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    lists = {r.id: r.terms for r in matched_terms(lexicon_matches(df, lexicon, "id"), "id").collect()}
    assert lists[3] == sorted(t for t in {t for t in terms if t} if t in texts[3])
    assert lexicon_matches(df, lexicon.limit(0), "id").collect() == []
    assert lexicon_matches(df.limit(0), lexicon, "id").collect() == []


def test_the_plan_does_not_grow_with_the_lexicon(spark, data):
    df = spark.createDataFrame(list(enumerate(data[0])), "id long, text string")

    def plan(n):
        lexicon = spark.range(n).selectExpr("concat('term', id) as term")
        return len(lexicon_matches(df, lexicon, "id")._jdf.queryExecution().optimizedPlan().toString())

    assert abs(plan(10) - plan(5000)) < 200 and GRAM > 1
    plain = lexicon_matches(df, spark.range(10).selectExpr("concat('w', id) as term"), "id", limit=0)
    shown = plain._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "NestedLoop" not in shown and "Cartesian" not in shown


def test_a_shipped_lexicon_is_looked_up_in_place(spark):
    df = spark.createDataFrame([(1, "a red brick house" * 50), (1, "brick, red-brick"), (2, "aredbrick")], "id long, text string")
    lexicon = spark.createDataFrame([("red brick",), ("brick",), ("red-brick",)], "term string")
    found = lexicon_matches(df, lexicon, "id", phrases=True)
    # No q-gram of a text becomes a row, and no candidate is searched for in a whole text.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    assert sorted(map(tuple, found.collect())) == [(1, "brick"), (1, "brick"), (1, "red brick"), (1, "red-brick")]


def test_a_lexicon_beyond_the_limit_is_shipped_in_parts(spark, data, monkeypatch):
    texts, terms = data
    texts = [*texts, "x" * 200 + "y", "a" * 70, "汉字かな汉字かな汉字 z"]
    terms = [*terms, "x" * 100, "x" * 99 + "y", "x" * 199 + "y", "x" * 201, "a" * 16, "a" * 17, "a" * 33, "字かな", "汉字かな汉字かな", "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, t) for i, x in enumerate(texts) if x for t in {t for t in terms if t} if t in x)
    found = lexicon_matches(df, lexicon, "id", limit=3000)
    # No q-gram of a text becomes a row: before, a lexicon beyond the limit was joined with the q-grams of all texts.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 1
    assert sorted(map(tuple, found.collect())) == want
    lists = lexicon_matches(df.unionByName(df), lexicon, "id", limit=3000, lists=True)
    assert sorted((r.id, t) for r in matched_terms(lists, "id").collect() for t in r.terms) == want
    known = {r.id: r.terms for r in matched_terms(found, "id").collect()}
    assert {r.id: r.terms for r in matched_terms(lists, "id").collect()} == known
    joined = lexicon_matches(df, lexicon, "id", limit=0, lists=True)
    assert {r.id: r.terms for r in matched_terms(joined, "id").collect()} == known
