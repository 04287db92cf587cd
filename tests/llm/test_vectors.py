import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.llm.bit_sliced import top_products
from segue.llm.collision_search import nearest_vectors

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16))
    v = centres[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 16))
    v[40:60] = v[40]  # ties
    return [(int(i), row.tolist()) for i, row in enumerate(v)]


def brute(rows, queries, k, value, best_first):
    out = {}
    for q, v in queries:
        scored = [(best_first * value(np.array(v), np.array(w)), i) for i, w in rows if i != q]
        out[q] = [(r + 1, i, best_first * s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


def test_nearest_over_shards_and_blocks_has_high_recall_and_exact_scores(spark, vectors):
    got = result(nearest_vectors(table(spark, vectors), F.col("vec_id") % 30 == 0, k=10, shard_rows=200, block_rows=8))
    distance = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    want = brute(vectors, [x for x in vectors if x[0] % 30 == 0], 10, distance, 1)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = dict(vectors)
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        assert all(s == pytest.approx(distance(np.array(by_id[q]), np.array(by_id[i])), abs=1e-12) for _, i, s in rows)


def test_top_products_over_shards_and_blocks_are_exact(spark, vectors):
    got = result(top_products(table(spark, vectors), F.col("vec_id") % 20 == 0, k=20, shard_rows=200, block_rows=10))
    product = lambda a, b: int(np.floor(64 * a).astype(int) @ np.floor(64 * b).astype(int))
    assert got == brute(vectors, [x for x in vectors if x[0] % 20 == 0], 20, product, -1)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [nan, 0.0]), (5, [1.0, inf]),
            (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [9.0, 9.0])]
    near = result(nearest_vectors(table(spark, rows), F.col("vec_id") % 100 == 0, k=5))
    assert {q: [i for _, i, _ in r] for q, r in near.items()} == {0: [1, 100], 100: [1, 0]}
    top = result(top_products(table(spark, rows), F.col("vec_id") % 100 == 0, k=5))
    assert {q: [(i, s) for _, i, s in r] for q, r in top.items()} == {0: [(1, 2048), (8, 0), (100, 0)], 100: [(1, 2048), (0, 0), (8, 0)]}


def test_empty_tables_and_lone_queries(spark):
    for search in (nearest_vectors, top_products):
        assert search(table(spark, []), F.col("vec_id") % 100 == 0).collect() == []
        assert search(table(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 100 == 0).collect() == []
        assert search(table(spark, [(1, [1.0, 2.0])]), F.col("vec_id") % 100 == 0).collect() == []
