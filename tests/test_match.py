"""Matching: known cases, and random catalogues against the plain sequential rule."""

import random

import pytest

from segue.operators import match as M
from segue.options import MergeOptions

COLUMNS = (
    "pair_id string, track_id string, ordinal bigint, location string, title string, artist string, "
    "duration_s double, file_size bigint"
)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def found(df):
    return {(r.pair_id, r.incoming_id): (r.base_id, r.rule) for r in df.collect()}


def test_tiers(spark):
    base = frame(spark, [
        ("p", "b1", 1, "/usb/Contents/A/x.mp3", "X", "A", 0.0, 100),
        ("p", "b2", 2, "/usb/Contents/B/y.mp3", "Y", "B", 200.0, 0),
        ("p", "b3", 3, "/usb/Contents/C/z.mp3", "Zed", "C", 0.0, 0),
        ("p", "b4", 4, "/usb/Music/w.mp3", "W", "", 0.0, 0),
    ])
    inc = frame(spark, [
        ("p", "i1", 1, "/home/me/Music/x.mp3", "Other title", "", 0.0, 100),
        ("p", "i2", 2, "/home/me/Music/y2.mp3", "y", "b", 201.0, 0),
        ("p", "i3", 3, "/home/me/Music/z.mp3", "Zed (edit)", "C", 0.0, 0),
        ("p", "i4", 4, "/home/me/Music/w.mp3", "W", "", 0.0, 0),
        ("p", "i5", 5, "/home/me/Music/new.mp3", "New", "", 0.0, 0),
    ])
    opts = MergeOptions(path_rules=(("/home/me/Music", "/usb/Music"),))
    assert found(M.match_tracks(base, inc, opts)) == {
        ("p", "i1"): ("b1", "name+size"), ("p", "i2"): ("b2", "artist+title"),
        ("p", "i3"): ("b3", "file name"), ("p", "i4"): ("b4", "path"),
    }


def test_early_pair_makes_a_later_track_unambiguous(spark):
    base = frame(spark, [("p", b, i, f"/b{i}", "T", "A", d, 0) for i, (b, d) in enumerate([("b1", 100.0), ("b2", 103.0)])])
    inc = frame(spark, [("p", f"i{k}", k, f"/x{k}", "T", "A", d, 0) for k, d in enumerate([101.5, 99.0, 101.5], 1)])
    assert found(M.match_tracks(base, inc)) == {
        ("p", "i2"): ("b1", "artist+title"), ("p", "i3"): ("b2", "artist+title"),
    }


def test_texts_match_beyond_ascii(spark):
    base = frame(spark, [("p", "b1", 1, "/b/1.mp3", "STRASSE ﬁne", "Ångström", 0.0, 0)])
    inc = frame(spark, [("p", "i1", 1, "/i/9.mp3", "straße  fine", "A\u030angstro\u0308m", 0.0, 0)])
    assert found(M.match_tracks(base, inc)) == {("p", "i1"): ("b1", "artist+title")}


def sequential_tag_tier(base, inc, tolerance):
    taken, out = set(), {}
    for _, iid, _, d, key in sorted((o, i, 0, d, k) for (i, o, d, k) in inc):
        free = [
            b for (b, bd, bk) in base
            if bk == key and b not in taken and (not d or not bd or abs(d - bd) <= tolerance)
        ]
        if len(free) == 1:
            out[iid] = free[0]
            taken.add(free[0])
    return out


def random_case(rnd, blocks):
    base, inc = [], []
    for key in range(blocks):
        pool = [0.0] * rnd.choice([0, 0, 0, 1, 2]) + [round(rnd.uniform(10, 60), rnd.choice([0, 1])) for _ in range(rnd.randint(1, 9))]
        for d in pool:
            base.append((f"b{len(base)}", d, key))
        for _ in range(rnd.randint(1, 30)):
            d = rnd.choice([rnd.choice(pool), rnd.choice(pool) + rnd.choice([-2.0, -1.5, 1.0, 2.0]), 0.0 if rnd.random() < 0.2 else rnd.uniform(10, 60)])
            inc.append((f"i{len(inc)}", rnd.randint(0, 10**6), max(d, 0.0), key))
    return base, [(i, n * 10**7 + o, d, k) for n, (i, o, d, k) in enumerate(sorted(inc, key=lambda r: r[1]))]


@pytest.mark.parametrize("whole,first", [(20_000, 32), (0, 32), (20_000, 1), (0, 1)])
def test_tag_tier_equals_sequential_rule(spark, monkeypatch, whole, first):
    """Also with every block cut at duration gaps, and with one row per copy at a time."""
    monkeypatch.setattr(M, "WHOLE_BLOCK_GROUPS", whole)
    monkeypatch.setattr(M, "FIRST_ROWS", first)
    rnd = random.Random(first + whole)
    base, inc = random_case(rnd, 40)
    b = spark.createDataFrame(
        [("p", i, f"a{k}", "t", d) for i, d, k in base], "pair_id string, id string, artist_key string, title_key string, duration double"
    )
    i = spark.createDataFrame(
        [("p", x, o, f"a{k}", "t", d) for x, o, d, k in inc],
        "pair_id string, id string, ordinal bigint, artist_key string, title_key string, duration double",
    )
    got = {r.incoming_id: r.base_id for r in M.tag_pairs(i, b, 2.0).collect()}
    assert got == sequential_tag_tier(base, inc, 2.0)


def test_one_to_one_with_a_hot_block(spark):
    """A third of both sides shares artist, title and duration."""
    n = 3000
    base = [("p", f"b{k}", k, f"/b/{k}.mp3", "hot" if k % 3 == 0 else f"t{k}", "a", float(k % 7 if k % 3 else 180), 0) for k in range(n)]
    inc = [("p", f"i{k}", k, f"/i/x{k}.mp3", "hot" if k % 3 == 0 else f"T{k}", "A", float(k % 7 if k % 3 else 180), 0) for k in range(n)]
    got = found(M.match_tracks(frame(spark, base), frame(spark, inc)))
    assert len({b for b, _ in got.values()}) == len(got) == 2 * n // 3
    assert all(k[1][1:] == v[0][1:] for k, v in got.items())
