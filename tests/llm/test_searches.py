"""Exact and ranked searches against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import awkward, frame, prose
from memlake.llm import cover_tree, four_russians, integer_vectors, lexical

VECTORS = ("vec_id long, embedding array<double>, label int, id string, v string, query string, cell string, rank string, "
           "number string, slice string, block string, score string")
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *["x"] * 9) for i, v, label in rows], VECTORS)


def hard_rows(seed=5, count=260, dim=12):
    """Clusters, a vector that a third of the rows share, ties, repeats and rows that take no part."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dim))
    rows = [(i, list(map(float, middles[i % 6] + rng.normal(size=dim) * 0.2)), int(i % 3)) for i in range(count)]
    rows += [(1_000 + i, [0.5] * dim, int(i % 4)) for i in range(count // 2)]
    rows += [(2_000 + i, [float(x) for x in rng.integers(-1, 2, dim)], 1) for i in range(40)]
    rows += [rows[0], rows[50], (3_000, None, 1), (3_050, [0.1] * (dim - 1) + [None], 1), (3_100, [0.1] * (dim - 1) + [NAN], 2),
             (3_150, [INF] + [0.0] * (dim - 1), 2), (None, [1.0] * dim, 1), (3_200, [], 1), (3_250, [], 2),
             (3_300, [1.0, -2.0], 1), (3_350, [0.25, 3.0], 1), (3_400, [1e6] * dim, None), (3_500, [9e4] + [0.0] * (dim - 1), 0),
             (3_600, [2e5] * dim, 2), (3_650, [1.5e5] * dim, 1)]
    random.Random(seed).shuffle(rows)
    return rows


def taking_part(rows):
    out = set()
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.add((i, tuple(math.floor(256 * x) for x in v), label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, every, k):
    own = {(i, v) for i, v, _ in taking_part(rows)}
    out = []
    for qi, qv in own:
        if qi % every == 0:
            found = sorted((-product(qv, v), i) for i, v in own if i != qi and len(v) == len(qv))[:k]
            out += [(qi, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"sample_rows": 20, "data_rows": 16, "query_rows": 3}, {"sample_rows": 0, "data_rows": 50}])
def test_top_k_equals_brute_force(spark, options):
    rows = hard_rows()
    found = cover_tree.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, **options).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 50, 5)


def test_top_k_of_few_rows_and_of_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2)]
    assert sorted(map(tuple, cover_tree.top_k(vectors(spark, rows), F.col("vec_id") == 0).collect())) == [
        (0, 1, 1, 128 * 256), (0, 2, 2, 128 * 256)]
    assert cover_tree.top_k(vectors(spark, []), F.lit(True)).collect() == []
    assert cover_tree.top_k(vectors(spark, rows), F.lit(None).cast("boolean")).collect() == []


def test_pruning_saves_most_of_the_work_on_clusters():
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(40, 16))[rng.integers(0, 40, 2_000)] * 300 + rng.normal(size=(2_000, 16))).astype(np.int64)
    centres = cover_tree.cells_of(points, 32)
    near = cover_tree.distances(points, centres).argmin(axis=1)
    radius = np.array([cover_tree.distances(points[near == j], centres[[j]]).max(initial=0) for j in range(len(centres))])
    scores = points[:50] @ points.T
    worst = np.sort(scores, axis=1)[:, -5]
    c, q = centres.astype(float), points[:50].astype(float)
    q_norm = np.linalg.norm(q, axis=1)[:, None]
    top = cover_tree.pair_bound(q @ c.T, q_norm, 0.0, q_norm, c, np.linalg.norm(c, axis=1)[None, :], radius[None, :],
                                np.linalg.norm(points, axis=1).max(), cover_tree.distances(q, c))
    for j in range(len(centres)):
        if (near == j).any():
            assert (top[:, j] >= scores[:, near == j].max(axis=1)).all()
    assert (top >= worst[:, None]).mean() < 0.2


def test_table_scores_are_inner_products():
    rng = np.random.default_rng(2)
    for dim, size in ((1, 1), (7, 100), (8, 127), (64, 40_000), (13, 2 ** 40)):
        a, v = rng.integers(-size, size + 1, (5, dim)), rng.integers(-size, size + 1, (30, dim))
        with np.errstate(over="ignore"):
            assert (four_russians.table_scores(four_russians.subset_sums(a), four_russians.bit_planes(v)) == v @ a.T).all()
    assert four_russians.bit_planes(np.zeros((3, 0), np.int64)).shape == (1, 0, 3)
    assert len(four_russians.bit_planes(np.array([[-1, 0]]))) == 1


def test_products_are_exact_in_every_width():
    rng = np.random.default_rng(3)
    for size in (10, 3_000, 2 ** 24, 2 ** 30):
        a, b = rng.integers(-size, size, (4, 9)), rng.integers(-size, size, (6, 9))
        assert integer_vectors.inner_products(a, b).tolist() == [[product(x, y) for y in b.tolist()] for x in a.tolist()]
        data, width = integer_vectors.packed(a)
        assert (integer_vectors.unpacked(data, width, 4, 9) == a).all()


def brute_negatives(rows):
    own = [(i, v, label) for i, v, label in taking_part(rows) if label is not None]
    out = []
    for ai, av, al in own:
        if ai % 100:
            continue
        scored = sorted((-product(av, v), i, label) for i, v, label in own if i != ai and len(v) == len(av))
        for ps, pi, _ in [x for x in scored if x[2] == al][:5]:
            fit = [(s, i) for s, i, label in scored if label != al and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(ai, pi, rank, i, -ps, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"data_rows": 20, "anchor_rows": 2}])
def test_hard_negatives_equal_brute_force(spark, options):
    rows = hard_rows(7)
    found = four_russians.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0, F.col("label"), **options).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows)
    assert four_russians.hard_negatives(vectors(spark, []), F.lit(True), F.col("label")).collect() == []


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_ranks(docs, items, k=10):
    bags = [(d, brute_terms(t)) for d, t in docs]
    count, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m, score = 10 + (90 * len(b) * count) // max(length, 1), 0
            for t in set(brute_terms(text)):
                tf = b.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_docs": 5, "bundle_items": 2}, {"vocabulary_bytes": 0, "shard_docs": 9},
                                     {"shares": (), "broadcast_rows": 0}])
def test_ranks_equal_brute_force(spark, options):
    rng = random.Random(4)
    docs = [(r[0], r[1]) for r in awkward()] + [(200 + i, "shared words of the copies") for i in range(40)]
    docs += [(300 + i, prose(rng, 40) + " Ünïcode term ABC-abc_d9") for i in range(20)]
    texts = [d[1] for d in docs if d[1]]
    items = [(i, " ".join(rng.choice(texts).split()[:30])) for i in range(8)]
    items += [(8, None), (9, ""), (10, "-- !!"), (11, "the of and"), (11, "shared copies"), (None, "ÜNÏCODE term abc"), (12, texts[0])]
    found = lexical.ranked(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    assert sorted(map(tuple, found), key=str) == brute_ranks(docs, items)


def test_ranks_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(frame(spark, []), items).collect() == []
    assert lexical.ranked(frame(spark, [(1, "a b")]), items.limit(0)).collect() == []
