import numpy as np
import pytest

from segue.llm.whitening import exact_sums, whiten, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, n string, whitened int, component string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, components=4, by_copies=False):
    x = {}
    for k, (i, v) in enumerate(rows):
        x[k] = (i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64))
    distinct, copies = np.unique(np.array([v for _, v in x.values()]), axis=0, return_counts=True)
    weights = copies if by_copies else np.ones(len(distinct), dtype=np.int64)
    n = int(weights.sum())
    sums = (distinct * weights[:, None]).sum(axis=0)
    centred = distinct - sums / n
    v = (centred * weights[:, None]).T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    whitened = {k: ((w - sums / n) @ axes) / np.sqrt(e) for k, (_, w) in x.items()}
    return x, n, sums, e / np.trace(v), whitened


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 10)) @ rng.standard_normal((10, 10)) * 0.2
    v[150:300] = v[0]  # copies
    return [(int(i), w.tolist()) for i, w in enumerate(v)]


@pytest.mark.parametrize("by_copies", [False, True])
def test_equals_brute_force(spark, rows, by_copies):
    x, n, sums, shares, want = brute(rows, by_copies=by_copies)
    got = {}
    for r in whiten(table(spark, rows), by_copies=by_copies).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == {i for i, _ in rows}
    signs = None
    for k, (i, v) in x.items():
        own = [got[i][c] for c in range(1, 5)]
        values = np.array([r.whitened for r in own])
        signs = np.sign(values / want[k]) if signs is None else signs
        assert values == pytest.approx(want[k] * signs, abs=1e-10)  # either sign, the same for all rows
        assert [r.explained for r in own] == pytest.approx(shares, rel=1e-10)
        assert {(r.n, int(r.deviation)) for r in own} == {(n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)))}
        assert all(r.identity_error < 1e-9 for r in own)


def test_odd_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [nan] * 10), (903, [inf] * 10), (904, [None] * 10), (905, [1.0] * 3), (906, [3e38] * 10)]
    same = [(None, rows[5][1]), (5, rows[5][1])]
    got = whiten(table(spark, rows + odd + same)).collect()
    plain = whiten(table(spark, rows)).collect()
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.component, r.whitened)
    assert len(got) == len(plain) + 8
    assert {r.vec_id for r in got} == {r.vec_id for r in plain} | {None}
    whitened = {(r.vec_id, r.component): r.whitened for r in plain}
    for r in sorted(got, key=key):
        assert r.whitened == pytest.approx(whitened[5 if r.vec_id is None else r.vec_id, r.component], abs=1e-10)


def test_tables_without_a_spread(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None)])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whiten(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [3.0, 2.0])])).collect()
    assert {r.component for r in line} == {1} and len(line) == 3  # the second eigenvalue is zero
    assert {round(r.whitened, 9) for r in line} == {round(x, 9) for x in (-(1.5**0.5), 0.0, 1.5**0.5)}


def test_sums_and_deviations_beyond_a_long_are_exact(spark):
    big = [(i, [float(2**49) * (i + 1), float(-(2**49)), 1.0]) for i in range(5)]
    distinct = whole_vectors(table(spark, big), 256.0).selectExpr("x", "bigint(1) AS weight")
    n, sums = exact_sums(distinct)
    assert (n, sums) == (5, [256 * 2**49 * 15, -256 * 2**49 * 5, 256 * 5])
    got = {r.vec_id: int(r.deviation) for r in whiten(table(spark, big)).collect()}
    assert got == {i: (5 * 256 * 2**49 * (i + 1) - sums[0]) ** 2 for i in range(5)}
