"""Grid operators on known grids, and long tracks cut into stretches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import grids as G
from segue.plans import sections as SECTIONS
from segue.plans.ordered import around, group_values, ranked, running

TEMPO = "track_id string, position_ms double, bpm double, beat int"


def tempo(spark, *grids):
    rows = [(f"t{i}", float(p), float(b), n) for i, g in enumerate(grids) for p, b, n in g]
    return spark.createDataFrame(rows, TEMPO)


def rows(df, *names):
    return [tuple(round(r[n], 3) for n in names) for r in df.orderBy("track_id", names[0]).collect()]


def test_simplify(spark):
    per_beat = [(25, 120, 1)] + [(48026 + 500 * i, 120, i % 4 + 1) for i in range(9)]
    changed = [(0, 120, 1), (2000, 130, 1)]
    out = G.simplify(tempo(spark, per_beat, changed), ["track_id"])
    assert rows(out, "position_ms", "bpm", "beat") == [(25, 120, 1), (0, 120, 1), (2000, 130, 1)]


def test_expand_then_segment(spark):
    grid = tempo(spark, [(500, 100, 1), (3500, 120, 2)]).withColumn("end", F.lit(8000.0))
    beats = G.expand(grid, ["track_id"], "end")
    assert rows(beats, "position_ms", "beat")[0] == (500, 1)
    for chunk in (100_000, 2):
        out = G.sections(beats, ["track_id"], chunk=chunk)
        assert rows(out, "position_ms", "bpm", "beat") == [(500, 100, 1), (3500, 120, 2)]


def test_device_beats_round_trip(spark):
    grid = tempo(spark, [(1250, 120, 3)], [(25, 128, 1), (60025, 130, 1)]).withColumn(
        "end", F.when(F.col("track_id") == "t0", 2250.0).otherwise(90000.0)
    )
    beats = G.expand_for_device(grid, ["track_id"], "end")
    first = beats.where("track_id = 't0'").orderBy("ms").collect()
    assert [(r.beat, r.tempo, r.ms) for r in first] == [(1, 12000, 250), (2, 12000, 750), (3, 12000, 1250), (4, 12000, 1750)]
    back = G.compress(beats.where("track_id = 't1'").withColumn("i", F.col("ms")), ["track_id"])
    assert rows(back, "position_ms", "bpm") == [(25, 128), (60025, 130)]


def drifting(seed, n=400):
    rnd, at, length, out = random.Random(seed), 10.0, 500.0, []
    for k in range(n):
        out.append((round(at, 1), rnd.choice([120.0, 120.005, 120.015, 121.0]) if seed % 2 else 120.0, k % 4 + 1))
        length += rnd.choice([0, 0, 0.3, -0.3, 1.9, 25])
        at += length
    return out


def plain_sections(beats, tolerance=2.0):
    out, i = [], 0
    while i < len(beats) - 1:
        first, j = beats[i + 1] - beats[i], i + 1
        while j + 1 < len(beats) and abs(beats[j + 1] - beats[j] - first) <= tolerance:
            j += 1
        if beats[j] != beats[i]:
            out.append((round(beats[i], 3), round(60000 * (j - i) / (beats[j] - beats[i]), 3), i % 4 + 1))
        i = j
    return out


def plain_kept(markers):
    kept = []
    for p, t, b in sorted(markers):
        if kept:
            length = 60000 / kept[-1][1]
            n = (p - kept[-1][0]) / length
            if abs(n - round(n)) * length <= 2 and abs(t - kept[-1][1]) <= 0.01 and b == (kept[-1][2] - 1 + round(n)) % 4 + 1:
                continue
        kept.append((p, t, b))
    return [(round(p, 3), round(t, 3), b) for p, t, b in kept]


def plain_compressed(beats):
    out, since = [], 0
    for ms, tempo, beat in sorted(beats):
        if tempo <= 0:
            continue
        bpm = tempo / 100
        since += 1
        if out and abs(out[-1][1] - bpm) < 0.001 and abs(ms - (out[-1][0] + since * 60000 / out[-1][1])) <= 2:
            continue
        out.append((ms, bpm, beat or 1))
        since = 0
    return out


@pytest.mark.parametrize("chunk", [1 << 17, 40])
def test_long_tracks_cut_into_chunks_give_what_a_fold_gives(spark, chunk):
    """Steady, drifting and jumping tracks; of the last all rows are section starts."""
    steady = [(25 + 500.0 * i, 120.0, i % 4 + 1) for i in range(500)]
    jumping = [(float(i * i), 60.0 + i % 9, 1) for i in range(150)]
    grids = [*[drifting(s) for s in range(5)], steady, jumping, steady[:1], [], steady[:300] + drifting(9)[300:]]
    data = tempo(spark, *grids).repartition(5)
    keys = ["track_id"]
    got = {}
    for name, out in (("kept", G.simplify(data, keys, chunk=chunk)), ("cut", G.sections(data, keys, chunk=chunk))):
        got[name] = {}
        for r in out.orderBy("track_id", "position_ms").collect():
            got[name].setdefault(r.track_id, []).append((round(r.position_ms, 3), round(r.bpm, 3), r.beat))
    assert got["kept"] == {f"t{i}": plain_kept(g) for i, g in enumerate(grids) if g}
    want = {f"t{i}": plain_sections(sorted(p for p, _, _ in g)) for i, g in enumerate(grids)}
    assert got["cut"] == {t: w for t, w in want.items() if w}


@pytest.mark.parametrize("chunk", [1 << 17, 32])
def test_device_beats_of_long_tracks_compress_as_a_fold_does(spark, chunk):
    rnd = random.Random(4)
    tracks = {"steady": [(25 + 500 * i, 12000, i % 4 + 1) for i in range(400)], "none": [(5, 0, 1), (9, 0, 2)]}
    tracks["mixed"] = [(25 + 480 * i + rnd.choice([0, 0, 1, -1, 3]), rnd.choice([12500] * 30 + [12510, 0]), i % 5) for i in range(400)]
    data = [(t, i, b, tempo_, ms) for t, some in tracks.items() for i, (ms, tempo_, b) in enumerate(some)]
    beats = spark.createDataFrame(data, "track_id string, i bigint, beat int, tempo int, ms bigint").repartition(3)
    got = {}
    for r in G.compress(beats, ["track_id"], chunk=chunk).orderBy("track_id", "position_ms").collect():
        got.setdefault(r.track_id, []).append((r.position_ms, r.bpm, r.beat))
    assert got == {t: plain_compressed(some) for t, some in tracks.items() if t != "none"}


def test_null_keys_are_one_track(spark):
    data = [(None, 500.0 * i, 120.0, i % 4 + 1) for i in range(90)] + [("a", 400.0 * i, 150.0, 1) for i in range(3)]
    out = G.sections(spark.createDataFrame(data, TEMPO), ["track_id"], chunk=16)
    assert sorted((r.track_id or "", r.position_ms, r.bpm) for r in out.collect()) == [("", 0.0, 120.0), ("a", 0.0, 150.0)]


def test_a_steady_track_of_a_million_beats(spark):
    beats = spark.range(0, 1_000_000, 1, 8).select(F.lit("t").alias("track_id"), (F.col("id") * 500.0 + F.when(F.col("id") >= 900_000, F.col("id") - 900_000).otherwise(0)).alias("position_ms"))
    out = G.sections(beats, ["track_id"], chunk=50_000)
    assert rows(out, "position_ms", "bpm", "beat") == [(0, round(60000 * 999_999 / (999_999 * 500 + 99_999), 3), 1)]
    slower = beats.withColumn("position_ms", F.col("position_ms") + F.when(F.col("position_ms") > 300_000_000, (F.col("position_ms") - 300_000_000) * 0.02).otherwise(0))
    got = rows(G.sections(slower, ["track_id"], chunk=50_000), "position_ms", "bpm", "beat")
    assert len(got) == 2 and got[1][0] == 300_000_000
    assert got == plain_sections([r.position_ms for r in slower.orderBy("position_ms").collect()])


def test_serato_grid_round_trip(spark):
    grid = tempo(spark, [(250, 120, 2), (30_250, 125, 1), (60_250, 125, 3)])
    out = G.to_serato(grid, ["track_id"]).orderBy("position_s").collect()
    # the first marker moves back a beat and, being before the start, on by a bar
    assert [(r.position_s, r.bpm, r.beats_to_next) for r in out] == [
        (pytest.approx(1.75), None, 57), (30.25, None, 62), (60.25, 125, None),
    ]


def test_chunked_order_equals_plain_windows(spark):
    """One group holds most rows; chunks are far smaller than it."""
    from pyspark.sql import Window as W

    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.8 else "cold", rnd.randint(0, 5000), k, rnd.choice([None, 1.0, 2.0, 5.0])) for k in range(2000)]
    df = spark.createDataFrame(data, "g string, o bigint, k bigint, v double").cache()
    w = W.partitionBy("g").orderBy("o", "k")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.select(
        "k", F.row_number().over(w).cast("bigint").alias("rank"), F.lag("k").over(w).alias("p"), F.lead("k").over(w).alias("n"),
        F.sum(F.coalesce("v", F.lit(0.0))).over(upto).alias("s"), F.max("v").over(upto).alias("m"),
        F.last("v", ignorenulls=True).over(upto).alias("l"), F.max("v").over(W.partitionBy("g")).alias("top"),
    )
    got = ranked(df, ["g"], "o", "rank", ["k"], chunk=50)
    got = around(got, ["g"], "o", ["k"], ["k"], chunk=50)
    for kind, out in (("sum", "s"), ("max", "m"), ("last", "l")):
        got = running(got, ["g"], "o", F.col("v"), kind, out, ["k"], chunk=50)
    got = group_values(got, ["g"], F.floor(F.col("o") / 64), {"top": ("max", F.col("v"))})
    got = got.select("k", "rank", F.col("prev.k").alias("p"), F.col("next.k").alias("n"), "s", "m", "l", "top")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_short_sections_are_walked_without_arrays(monkeypatch):
    """Irregular beats: every section ends after a beat or two, none is looked for in slices of arrays."""
    calls = []
    monkeypatch.setattr(G, "first_break", lambda fits, at, n: calls.append(at) or n)
    rnd = random.Random(4)
    beats = np.cumsum([rnd.uniform(10, 900) for _ in range(2000)])
    found, _ = G._constant_tempo(2.0)([], [beats], 0, None, True)
    kept, _ = G._kept_markers([], [beats, np.full(2000, 120.0), np.ones(2000)], 0, None, True)
    assert len(found) > 1500 and len(kept) > 1500 and len(calls) < 5


@pytest.mark.parametrize("chunk", [1 << 17, 16])
def test_no_lists_are_sent_to_the_walk(spark, monkeypatch, chunk):
    """A list column of NULLs takes Spark's Arrow writer the square of a batch's rows."""
    kind, sent = type(spark.range(1)), []
    send = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **k: sent.append(df.schema) or send(df, *a, **k))
    data = tempo(spark, [(500.0 * i, 120.0, i % 4 + 1) for i in range(90)], drifting(2))
    G.sections(data, ["track_id"], chunk=chunk)
    assert sent and not [f.name for schema in sent for f in schema.fields if f.dataType.typeName() in ("array", "map", "struct")]


def test_groups_walked_side_by_side_have_the_sections_of_a_fold():
    rng = np.random.default_rng(3)
    tracks = [np.cumsum(rng.choice([500.0, 500.5, 503.0], n, p=[0.9, 0.05, 0.05])) for n in (1, 2, 200, 7, 90, 1, 400)]
    bpm = [np.where(rng.random(len(t)) < 0.05, 121.0, 120.0) for t in tracks]
    beat = [np.arange(len(t)) % 4 + 1.0 for t in tracks]
    ends = np.cumsum([len(t) for t in tracks])
    starts = ends - [len(t) for t in tracks]
    whole = [np.concatenate(x) for x in (tracks, bpm, beat)]
    for walk, many, width in (
        (G._constant_tempo(2.0), G._steady_gaps(2.0), 1), (G._kept_markers, (G._predicted, G._first_rows, 0), 3),
        (G._steady_rows, (G._as_expected, G._first_rows, 0), 3),
    ):
        for few in (0, 3, 100):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(SECTIONS, "FEW_GROUPS", few)
                group, values = SECTIONS._all_sections(walk, many, whole[:width], starts, ends)
            got = sorted(zip(group.tolist(), *[v.tolist() for v in values]))
            want = [(i, *x) for i, of in enumerate(zip(tracks, bpm, beat)) for x in walk([], [*of[:width]], 0, None, True)[0]]
            assert got == sorted(want)
