"""Steps that several queries share are done once, and pairs that a count settles stay out of Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import consolidate

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma".split()


def members(spark, texts):
    rows = [("g", f"m{i:03}", 1.0 - i / 1000, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "group_id string, id string, importance double, content string")


def test_conflict_pairs_settled_by_tokens_stay_out_of_python(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("int")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series([None] * len(a), dtype="Int32")

    monkeypatch.setattr(text, "common_run_length", counted)
    far = [" ".join(f"w{i}x{j}" for j in range(5)) for i in range(18)]
    near = ["alpha beta gamma delta", "alpha beta gamma zeta"]
    found = consolidate.group_conflicts(members(spark, far + near)).collect()
    assert [(r.id_a, r.id_b, r.similarity) for r in found] == [("m018", "m019", 0.6)]
    assert 0 < seen.value < 10  # of 190 pairs


def test_group_conflicts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(c + " " for c in rng.choices(WORDS, k=rng.choice([0, 1, 2, 3, 4, 6, 9]))) for _ in range(60)]
    found = {(r.id_a, r.id_b): r.similarity for r in consolidate.group_conflicts(members(spark, texts)).collect()}
    sets = [(t.strip(), set(t.split())) for t in texts]
    want = {}
    for i, (a, at) in enumerate(sets):
        for j, (b, bt) in enumerate(sets[i + 1:], i + 1):
            score = text.pair_similarity(a, b, at, bt)
            if 0.25 <= score < 0.88:
                want[f"m{i:03}", f"m{j:03}"] = score
    assert found == want and len(want) > 100


@pytest.fixture
def tables(spark):
    from memlake.plans import inputs, retrieval_queries

    sf_dir = "/root/testdata/sf0.001"
    inputs.stored(spark, sf_dir)
    return retrieval_queries, sf_dir


@pytest.mark.parametrize("name", ["r18_working_set", "r18_carried_working_set"])
def test_working_sets_extract_once(spark, tables, monkeypatch, name):
    """Seeds come from the written candidates, not from a second extraction of the turns."""
    from memlake.operators import extract

    queries, sf_dir = tables
    monkeypatch.setattr(extract, "extract_candidates", lambda *_: pytest.fail("extracted again"))
    assert queries.QUERIES[name](spark, sf_dir).count()


def test_carried_sets_search_once(spark, tables, monkeypatch):
    from memlake.operators import retrieval

    queries, sf_dir = tables
    calls = []
    for name in ("vector_topk", "keyword_topk"):
        real = getattr(retrieval, name)
        monkeypatch.setattr(retrieval, name, lambda *a, _real=real, _name=name, **k: calls.append(_name) or _real(*a, **k))
    assert queries.r18_carried_working_set(spark, sf_dir).count()
    assert sorted(calls) == ["keyword_topk", "vector_topk"]


def test_memories_are_joined_once_for_equal_query_vectors(spark):
    from memlake.operators.vector_search import nearest, shared_answers

    q = spark.createDataFrame([(f"q{i}", "u", [1.0, float(i % 2)]) for i in range(6)], "query_id string, user_id string, embedding array<double>")
    m = spark.createDataFrame([(f"m{i}", "u", [1.0, i / 4]) for i in range(5)], "id string, user_id string, embedding array<double>")
    asked_of, best = shared_answers(q, m, 3, scope=["user_id"])
    assert best.count() == 6 and asked_of.count() == 6
    rows = {(r.query_id, r.rank): r.item_id for r in nearest(q, m, 3, scope=["user_id"]).collect()}
    assert len(rows) == 18 and rows["q4", 1] == "m0" and rows["q5", 1] == "m4"
