import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import topk


def brute(queries, candidates, k, scale=256.0):
    def usable(rows):
        return [(i, [math.floor(Fraction(scale) * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    best = {}
    for q, a in usable(queries):
        for c, b in usable(candidates):
            if c != q and len(a) == len(b):
                s = sum(x * y for x, y in zip(a, b, strict=True))
                best[q, c] = max(s, best.get((q, c), s))
    out = []
    for q in {q for q, _ in best}:
        top = sorted(((-s, c) for (p, c), s in best.items() if p == q))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(top)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, score string"


@pytest.mark.parametrize("block", [8192, 7])
def test_agrees_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(20)]  # one common vector, ties by id
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [math.nan] * 6), (303, [math.inf] * 6), (None, [0.5] * 6), (304, [0.0] * 6), (305, [1.0, 2.0])]
    rows += [(50, [0.9] * 6), (50, [0.9] * 6), rows[3]]  # repeated ids
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 50 = 0 OR vec_id > 300"), df, 5).collect())
    assert got == brute([r for r in rows if r[0] is not None and (r[0] % 50 == 0 or r[0] > 300)], rows, 5)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [0.5, -0.1], ""), (50, [-0.5, 0.2], "")], SCHEMA)
    assert sorted(tuple(r) for r in topk.top_k(df, df, 5).collect()) == [(0, 1, 50, 128 * -128 + -26 * 51), (50, 1, 0, 128 * -128 + -26 * 51)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def found(blocks, q, k=5, own=-1):
    best, scored = [(np.array([], dtype=np.int64), np.array([], dtype=np.int64))], 0
    for b in blocks:
        scored += b.search(q[None, :], np.array([own]), best, k)[0]
    return best[0], scored


def test_the_bound_ends_the_search_early():
    rng = np.random.default_rng(1)
    m = np.floor(rng.normal(0, 10, (5000, 8))).astype(np.int64)
    m[:5] = 400
    (scores, ids), scored = found([topk.SortedLists(np.arange(5000), m)], np.ones(8, dtype=np.int64))
    assert ids.tolist() == [0, 1, 2, 3, 4] and scored < 500 and (scores == 3200).all()


def test_near_copies_end_the_search_in_64_dimensions():
    """Unit vectors in all directions: five near copies of the query are found after a small part of the block."""
    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, (8192, 64))
    m[:5] = m[9] + rng.normal(0, 0.05, (5, 64))
    m = np.floor(256 * m / np.linalg.norm(m, axis=1)[:, None]).astype(np.int64)
    (scores, ids), scored = found([topk.SortedLists(np.arange(8192), m)], m[9], own=9)
    want = np.lexsort((np.arange(8192), -(m @ m[9])))
    assert ids.tolist() == [i for i in want.tolist() if i != 9][:5] and scored < 0.3 * 8192
    far = topk.SortedLists(np.arange(10000, 14096), m[4096:])
    best, scored = found([topk.SortedLists(np.arange(8192), m), far], m[9], own=9)
    assert best[1].tolist() == ids.tolist() and scored < 0.3 * (8192 + 4096)


def test_no_bound_is_too_low():
    rng = np.random.default_rng(3)
    for _ in range(200):
        d = int(rng.integers(1, 9))
        a, caps = np.abs(rng.normal(0, 1, (1, d))), rng.normal(0.3, 0.7, (1, d))
        y = np.minimum(rng.normal(0, 1, (2000, d)), caps)
        radius = float(np.quantile(np.sqrt((y * y).sum(axis=1)), 0.7))
        inside = y[np.sqrt((y * y).sum(axis=1)) <= radius]
        assert topk.ceiling(a, caps, radius)[0][0] >= (inside @ a[0]).max() - 1e-9


def test_any_finite_component(spark):
    """Large components keep exact scores; one that a long cannot hold is null in its right rank."""
    rows = [(0, [1.0, 0.5]), (1, [1e8, -1.0]), (2, [3e300, 2.0]), (3, [-1e17, 1.0]), (4, [0.0, -4.0]), (5, [2e307, 1.0]), (6, [-2e307, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(2)
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id IN (0, 4)"), df, 7).collect())
    assert got == [(q, n, c, s if s is not None and -(2**63) <= s < 2**63 else None) for q, n, c, s in brute([rows[0], rows[4]], rows, 7)]


def test_cost(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)], "") for i in range(500)], SCHEMA)
    cost = {r["query_id"]: r["n_scored"] for r in topk.top_k(df.where("vec_id % 100 = 0"), df, with_cost=True).collect()}
    assert len(cost) == 5 and all(5 <= n <= 500 for n in cost.values())
