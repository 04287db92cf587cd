import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.llm.cover_tree import CoverTree
from segue.llm.hard_negatives import HIGHEST, LOWEST, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, shard string, id int"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], SCHEMA).repartition(parts)


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v, _ in rows}
    label = {i: c for i, _, c in rows}
    out = []
    for a in [i for i in x if i % every == 0]:
        others = [i for i in x if i != a and len(x[i]) == len(x[a])]
        score = {i: sum(p * q for p, q in zip(x[a], x[i])) for i in others}
        order = sorted(others, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:positives]:
            fits = [i for i in order if label[i] != label[a] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    return sorted(map(tuple, mine_hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, **options).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 8))
    v = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.standard_normal((1500, 8))
    v[200:500] = v[200]  # many copies of one vector
    v[600:620] = np.round(v[600:620])  # ties
    v[700] = 0
    return [(int(i), w.tolist(), int(c)) for i, (w, c) in enumerate(zip(v, rng.integers(0, 4, 1500)))]


@pytest.mark.parametrize("shard_rows", [8192, 120])
def test_equals_brute_force(spark, rows, shard_rows):
    assert mined(spark, rows, 25, shard_rows=shard_rows) == brute(rows, 25)


def test_other_labels_and_windows(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    changed = [(i, v, (c + 1) % 4 if i % 7 == 0 else c) for i, v, c in rows]
    options = {"positives": 2, "negatives": 7, "low": 0, "high": 100}
    assert mined(spark, rows, 100, label=label, shard_rows=300, **options) == brute(changed, 100, **options)


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.7], 2), (3, [0.6, 0.0], 3), (4, [0.6, 0.1], 3), (50, [0.0, 0.0], 5), (5, [0.0, 0.0], 5)]
    odd = [(6, None, 2), (7, [], 2), (8, [nan, 0.0], 2), (9, [inf, 0.0], 2), (10, [None, 0.5], 2), (11, [0.7, 0.0], None), (None, [0.7, 0.0], 2)]
    longer = [(12, [0.7, 0.0, 0.0], 2), (100, [1.0, 0.0, 0.0], 9)]
    again = [(2, [0.7, 0.7], 2), (4, [0.9, 0.9], 1)]  # a repeated id: the least vector counts
    got = mined(spark, good + odd + longer + again, 50)
    assert got == brute(good + longer, 50)
    assert (50, 5, 1, 0, 0, 0) in got  # a score of zero has a window of one score


def test_empty_tables_and_lone_anchors(spark):
    for some in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(1, [1.0], 1), (2, [0.6], 2)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2)]):
        assert mined(spark, some, 50) == []


def test_the_tree_leaves_out_nodes_and_finds_all(rows):
    x = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    ids, labels = np.arange(len(x)), np.array([c for _, _, c in rows])
    tree = CoverTree(x, ids, labels, leaf=16)
    spans = [s for s, c in zip(tree.span, tree.children) if c == (0, 0)]
    assert sorted(spans)[0][0] == 0 and sum(z - a for a, z in spans) == len(x)  # leaves hold each row once
    anchors = np.arange(0, 1500, 25)
    whole = np.full(len(anchors), LOWEST), np.full(len(anchors), HIGHEST)
    ask, found, scores = tree.top(x[anchors], anchors, labels[anchors], *whole, whole[0], 5, True)
    assert tree.verified < 0.5 * len(x) * len(anchors)
    for k, a in enumerate(anchors):
        s = x @ x[a]
        best = sorted((i for i in ids if i != a and labels[i] == labels[a]), key=lambda i: (-s[i], i))[:5]
        assert found[ask == k].tolist() == best and scores[ask == k].tolist() == s[best].tolist()


def test_scores_beyond_doubles_are_exact():
    x = np.array([[1 << 30, 3, 1], [1 << 30, 1, 0], [1 << 30, 2, 0], [1 << 29, 0, 0]], dtype=np.int64)
    tree = CoverTree(x, np.arange(4), np.array([1, 1, 1, 2]))
    whole = np.array([LOWEST]), np.array([HIGHEST])
    _, found, scores = tree.top(x[:1], np.array([0]), np.array([1]), *whole, whole[0], 2, True)
    assert found.tolist() == [2, 1] and scores.tolist() == [(1 << 60) + 6, (1 << 60) + 3]
