"""Merging: known cases, random cue lists against the plain rule, idempotence."""

import random

import pytest
from pyspark.sql import functions as F

from segue.model import Library
from segue.operators import merge as M
from segue.operators.playlists import crate_members, merge_playlists, select_playlists, with_parents
from segue.operators.sync import merge_libraries, needs_writing, sync_both_ways
from segue.options import MergeOptions
from segue.session import materialise

TRACKS = (
    "pair_id string, library_id string, track_id string, ordinal bigint, location string, title string, artist string, "
    "genre string, duration_s double, file_size bigint, play_count int, rating int, bpm_locked boolean"
)
CUES = (
    "pair_id string, library_id string, track_id string, ordinal bigint, role string, position_ms double, end_ms double, "
    "slot int, name string, colour int, locked boolean"
)
TEMPO = "pair_id string, library_id string, track_id string, position_ms double, bpm double, beat int"
NODES = "pair_id string, library_id string, node_id string, ordinal bigint, path array<string>, name string, is_folder boolean, is_crate boolean"
ENTRIES = "pair_id string, library_id string, node_id string, position bigint, track_id string"


def track(tid, location, title="", genre="", ordinal=0, lib="L", **kw):
    return ("p", lib, tid, ordinal, location, title, kw.get("artist", ""), genre, 0.0, 0, kw.get("plays", 0), 0, False)


def cue(tid, position, ordinal, slot=None, name="", role="cue", end=None):
    return ("p", "L", tid, ordinal, role, float(position), end, slot, name, None, False)


def library(spark, tracks, cues=(), tempo=(), lists=()):
    nodes = [("p", "L", f"n{i}", i, list(path), path[-1], False, False) for i, (path, _) in enumerate(lists)]
    entries = [("p", "L", f"n{i}", k, t) for i, (_, ids) in enumerate(lists) for k, t in enumerate(ids, 1)]
    return Library(
        spark.createDataFrame(list(tracks), TRACKS), spark.createDataFrame(list(cues), CUES),
        spark.createDataFrame(list(tempo), TEMPO), spark.createDataFrame(nodes, NODES), spark.createDataFrame(entries, ENTRIES),
    )


def lists_of(lib):
    names = {r.node_id: "/".join(r.path) for r in lib.nodes.where("NOT is_folder").collect()}
    out = {n: [] for n in names.values()}
    for r in lib.entries.orderBy("node_id", "position").collect():
        out[names[r.node_id]].append(r.track_id)
    return out


@pytest.fixture(scope="module")
def pair(spark):
    base = library(
        spark, [track("b1", "/a.mp3", "A")], [cue("b1", 1000, 0, 0, "base")],
        [("p", "L", "b1", 10.0, 120.0, 1)], [(("Set",), ["b1"])],
    )
    inc = library(
        spark, [track("i1", "/a.mp3", "A", "House"), track("i2", "/b.mp3", "B", ordinal=1)],
        [cue("i1", 1100, 0, 0, "inc"), cue("i1", 5000, 1, 1), cue("i1", 9000, 2)],
        [("p", "L", "i1", 20.0, 121.0, 1)], [(("Set",), ["i2", "i1"]), (("New list",), ["i2"])],
    )
    return base, inc


def cues_of(lib, tid):
    rows = lib.cues.where(F.col("track_id") == tid).orderBy("position_ms", "side", "ordinal").collect()
    return [(r.slot, r.position_ms, r.name) for r in rows]


def test_merge_of_cues_lists_and_new_tracks(pair):
    merged, report = merge_libraries(*pair)
    assert cues_of(merged, "b1") == [(0, 1100, "inc"), (1, 5000, ""), (None, 9000, "")]
    assert {r.track_id: r.genre for r in merged.tracks.collect()} == {"b1": "House", "sync:i2": ""}
    assert [(r.position_ms, r.bpm) for r in merged.tempo.collect()] == [(10.0, 120.0)]
    [r] = report.collect()
    assert (r.matched, r.added, r.updated, r.playlists_added, r.playlists_updated) == (1, 1, 1, 1, 1)
    assert lists_of(merged) == {"Set": ["b1", "sync:i2"], "New list": ["sync:i2"]}


def test_base_preferred_and_lists_replaced(pair):
    merged, _ = merge_libraries(*pair, MergeOptions(prefer="base", playlists="replace"))
    assert cues_of(merged, "b1")[0] == (0, 1000, "base")
    assert lists_of(merged)["Set"] == ["sync:i2", "b1"]
    filled, _ = merge_libraries(*pair, MergeOptions(cues="fill"))
    assert cues_of(filled, "b1") == [(0, 1000, "base")]


def test_second_sync_changes_nothing(spark, pair):
    base, inc = pair
    (there, _), (back, _) = sync_both_ways(inc, base, MergeOptions())

    def tidy(lib):
        """Written and read again, as between two syncs."""
        cues = lib.cues.drop("side")
        nodes = lib.nodes.withColumn("library_id", F.lit("L")).withColumn("name", F.element_at("path", -1))
        return Library(*[materialise(t, "synced") for t in (lib.tracks, cues, lib.tempo, nodes, lib.entries)])

    (_, one), (_, two) = sync_both_ways(tidy(back), tidy(there), MergeOptions())
    for report in (one, two):
        [r] = report.collect()
        assert (r.added, r.updated, r.playlists_added, r.playlists_updated) == (0, 0, 0, 0)
        assert needs_writing(report).count() == 0


def test_twins_are_paired_anew_by_a_second_sync(spark):
    """Of two incoming tracks at one path one is added; then the last track of that path takes the first."""
    base = library(spark, [track("b1", "/a.mp3", "A")])
    inc = library(spark, [track("i1", "/a.mp3", "A", "House"), track("i2", "/a.mp3", "A", ordinal=1)])
    for counts in ((1, 1, 1), (2, 0, 1), (2, 0, 0)):
        merged, report = merge_libraries(base, inc)
        [r] = report.collect()
        assert (r.matched, r.added, r.updated) == counts
        base = Library(*[materialise(t, "twins") for t in (merged.tracks, M.numbered_cues(merged.cues), merged.tempo, merged.nodes, merged.entries)])
    assert {r.track_id: r.genre for r in base.tracks.collect()} == {"b1": "House", "sync:i2": "House"}


def test_merged_cues_are_numbered_as_they_read(spark):
    """Both sides count from 0; numbered, they merge again like any other list."""
    base = [cue("t", 900, 0, 5), cue("t", 100, 1), cue("t", 500, 2, 2)]
    inc = spark.createDataFrame([cue("t", 700, 0, 0), cue("t", 300, 1, 1)], CUES)
    merged, _ = M.merge_cues(spark.createDataFrame(base, CUES), inc, MergeOptions())
    numbered = materialise(M.numbered_cues(merged), "numbered")
    assert sorted((r.ordinal, r.position_ms) for r in numbered.collect()) == [(k, 200.0 * k - 100) for k in range(1, 6)]
    again, changed = M.merge_cues(numbered, inc, MergeOptions())
    assert {r.position_ms for r in again.collect()} == {100.0, 300.0, 500.0, 700.0, 900.0} and changed.isEmpty()
    assert M.numbered_cues(merged.limit(0)).count() == 0


def test_transcoded_pair_moves_cues(spark):
    base = library(spark, [track("b", "/usb/x.mp3", "X", artist="A")])
    inc = library(spark, [track("i", "/lib/x.ogg", "X", artist="A")], [cue("i", 1000, 0, 0)])
    merged, _ = merge_libraries(base, inc)
    assert cues_of(merged, "b") == [(0, 1026.0, "")]


def sequential_merge(first, second):
    key = lambda c: (c[4] == "loop", round(c[5] / 5))
    merged = list(first)
    slots = {c[7] for c in first if c[7] is not None}
    spots = {key(c) for c in first}
    for c in second:
        if key(c) in spots or (c[7] is not None and c[7] in slots):
            continue
        merged.append(c)
        spots.add(key(c))
        if c[7] is not None:
            slots.add(c[7])
    return merged


@pytest.mark.parametrize("prefer", ["incoming", "base"])
def test_cue_merge_equals_sequential_rule(spark, prefer):
    rnd = random.Random(7)

    def some(tid, start):
        return [
            cue(tid, rnd.randint(0, 12) * 5 + rnd.choice([0, 1]), start + k, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["", "n"]), rnd.choice(["cue", "loop"]))
            for k in range(rnd.randint(0, 9))
        ]

    base, inc, want = [], [], set()
    for t in range(150):
        b, i = some(f"t{t}", 0), some(f"t{t}", 100)
        base, inc = base + b, inc + i
        if not i:
            merged = b
        else:
            merged = sequential_merge(i, b) if prefer == "incoming" else sequential_merge(b, i)
        want |= {(c[2], c[3]) for c in merged}
    out, _ = M.merge_cues(spark.createDataFrame(base, CUES), spark.createDataFrame(inc, CUES), MergeOptions(prefer=prefer))
    assert {(r.track_id, r.ordinal) for r in out.collect()} == want


def test_lists_of_one_path_apply_in_order(spark):
    base = library(spark, [], lists=[(("F", "A"), ["x", "y"])])
    inc = library(spark, [], lists=[(("F", "A"), ["z", "z", "x"]), (("F", "A"), ["w", "z"]), (("G", "N"), ["x", "x"]), (("G", "N"), ["y", "x"])])
    ids = spark.createDataFrame([("p", k, k) for k in "wxyz"], "pair_id string, incoming_id string, merged_id string")
    for policy, lists, counts in (
        ("merge", {"F/A": ["x", "y", "z", "z", "w"], "G/N": ["x", "x", "y"]}, (1, 3)),
        ("replace", {"F/A": ["w", "z"], "G/N": ["y", "x"]}, (1, 3)),
        ("add", {"F/A": ["x", "y"], "G/N": ["x", "x"]}, (1, 0)),
    ):
        nodes, entries, report = merge_playlists(base.nodes, base.entries, inc.nodes, inc.entries, ids, policy)
        assert lists_of(base.with_(nodes=nodes, entries=entries)) == lists
        [r] = report.collect()
        assert (r.playlists_added, r.playlists_updated) == counts


def test_folders_above_new_lists(spark):
    base = library(spark, [], lists=[(("F", "A"), [])])
    there = spark.createDataFrame([("p", "L", "f", 0, ["F"], "F", True, False), ("p", "L", "x", 5, ["X"], "X", True, False)], NODES)
    inc = library(spark, [], lists=[(("F", "A"), []), (("F", "B"), []), (("G", "H", "C"), []), (("G", "D"), []), (("X",), []), (("E",), [])])
    ids = spark.createDataFrame([], "pair_id string, incoming_id string, merged_id string")
    nodes, _, report = merge_playlists(base.nodes.unionByName(there), base.entries, inc.nodes, inc.entries, ids)
    rows = with_parents(nodes).collect()
    paths = {r.node_id: "/".join(r.path) for r in rows}
    got = sorted(("/".join(r.path), r.is_folder, paths.get(r.parent_id)) for r in rows)
    assert got == [
        ("E", False, None), ("F", True, None), ("F/A", False, "F"), ("F/B", False, "F"), ("G", True, None), ("G/D", False, "G"),
        ("G/H", True, "G"), ("G/H/C", False, "G/H"), ("X", False, None), ("X", True, None),
    ]
    assert report.first().playlists_added == 5


def test_crate_members_are_numbered(spark):
    tracks = spark.createDataFrame(
        [("L", "t1", "b", "x"), ("L", "t2", "A", "Z"), ("L", "t3", "a", "y"), ("L", "t4", None, "q"), ("M", "t1", "a", "a")],
        "library_id string, track_id string, artist string, title string",
    )
    members = spark.createDataFrame(
        [("L", "c1", t) for t in ("t1", "t2", "t3", "t4", "gone")] + [("L", "c2", "t1"), ("M", "c1", "t1")],
        "library_id string, node_id string, track_id string",
    )
    got = sorted((r.library_id, r.node_id, r.position, r.track_id) for r in crate_members(members, tracks).collect())
    assert got == [("L", "c1", 1, "t4"), ("L", "c1", 2, "t3"), ("L", "c1", 3, "t2"), ("L", "c1", 4, "t1"), ("L", "c2", 1, "t1"), ("M", "c1", 1, "t1")]


def test_selection(spark):
    lib = library(spark, [track(f"t{i}", f"/{i}.mp3", ordinal=i) for i in range(4)], lists=[(("F", "A"), ["t0", "t1"]), (("F", "B"), ["t2"]), (("C",), ["t3"])])
    folder = spark.createDataFrame([("p", "L", "f", 9, ["F"], "F", True, False), ("p", "L", "g", 10, ["G"], "G", True, False)], NODES)
    wanted = spark.createDataFrame([("L", "F / A")], "library_id string, wanted string")
    nodes, entries, tracks = select_playlists(lib.nodes.unionByName(folder), lib.entries, lib.tracks, wanted)
    assert {"/".join(r.path) for r in nodes.collect()} == {"F", "F/A"}
    assert {r.track_id for r in tracks.collect()} == {"t0", "t1"} and entries.count() == 2


def test_the_two_directions_of_a_sync_run_one_after_the_other(spark, monkeypatch):
    from segue.catalog import merging

    report = spark.createDataFrame([("ab", 1)], "pair_id string, matched int")
    written = []
    monkeypatch.setattr(merging, "sync_both_ways", lambda *a: ((None, report), (None, report)))
    monkeypatch.setattr(merging, "materialise", lambda df, name: written.append(df) or df)
    monkeypatch.setattr(merging, "_incoming", lambda *a: None)
    monkeypatch.setattr(merging.S, "library", lambda *a: None)
    out = merging.two_way_sync_report(spark, "")
    assert len(written) == 2 and sorted(r.direction for r in out.collect()) == ["a to b", "b to a"]
