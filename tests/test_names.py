"""Unique naming against the plain sequential rule."""

import random

from segue.operators.playlists import unique_names
from segue.operators.targets import mixxx_lists


def sequential(names, taken):
    taken = {t.lower() for t in taken}
    out = []
    for name in names:
        candidate, n = name, 2
        while candidate.lower() in taken:
            candidate, n = f"{name} ({n})", n + 1
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def test_unique_names_equal_sequential_naming(spark):
    rnd = random.Random(5)
    pool = ["Set", "set", "Set (2)", "Set (3)", "SET (2) (2)", "Set (5)", "Set (02)", "Other", "Set (2) (3)"]
    nodes, taken, want = [], [], {}
    for lib in range(60):
        names = [rnd.choice(pool) for _ in range(rnd.randint(1, 14))]
        used = rnd.sample(pool, rnd.randint(0, 3))
        nodes += [(str(lib), i, n) for i, n in enumerate(names)]
        taken += [(str(lib), u) for u in used]
        want.update({(str(lib), i): w for i, w in enumerate(sequential(names, used))})
    got = unique_names(
        spark.createDataFrame(nodes, "library_id string, ordinal bigint, name string"),
        spark.createDataFrame(taken, "library_id string, name string"),
    ).collect()
    assert {(r.library_id, r.ordinal): r.unique_name for r in got} == want


def test_names_beside_numbered_ones(spark):
    """Only numbered names and the names they number are settled by levels; all others keep their numbers."""
    rows = [("A", 1, "x"), ("A", 2, "x (2)"), ("A", 3, "x"), ("A", 4, "plain"), ("A", 5, "Plain"), ("A", 6, "taken"), ("B", 1, "x"), ("B", 2, "x")]
    nodes = spark.createDataFrame(rows, "library_id string, ordinal bigint, name string")
    taken = spark.createDataFrame([("A", "Taken"), ("B", "other")], "library_id string, name string")
    got = {(r.library_id, r.ordinal): r.unique_name for r in unique_names(nodes, taken).collect()}
    assert got == {
        ("A", 1): "x", ("A", 2): "x (2)", ("A", 3): "x (3)", ("A", 4): "plain", ("A", 5): "Plain (2)", ("A", 6): "taken (2)",
        ("B", 1): "x", ("B", 2): "x (2)",
    }


def test_only_the_lists_that_are_read_are_placed(spark):
    d = lambda ddl, *rows: spark.createDataFrame(rows, "library_id string, " + ddl)
    nodes = d("node_id string, ordinal bigint, path array<string>, is_folder boolean, is_crate boolean", ("A", "n", 1, ["f", "n"], False, True), ("A", "m", 2, ["f", "m"], False, False))
    entries = d("node_id string, position bigint, track_id string", ("A", "n", 1, "t"), ("A", "m", 1, "t"))
    target = {
        "playlists": d("id bigint, name string, position bigint, hidden boolean"), "crates": d("id bigint, name string"),
        "playlist_tracks": d("list_id bigint, track_id bigint, position bigint"), "crate_tracks": d("list_id bigint, track_id bigint"),
    }
    made = mixxx_lists(nodes, entries, d("track_id string, target_track_id bigint", ("A", "t", 7)), target, only=["crate_tracks"])
    assert {k: [tuple(r) for r in v.collect()] for k, v in made.items()} == {"crate_tracks": [("A", 1, 7)]}
