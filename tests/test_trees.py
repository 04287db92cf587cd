import random

import pytest
from pyspark.sql import functions as F

from segue.operators import playlists as P

NODES = "library_id string, node_id string, parent_id string, seq bigint, name string"


def whole(rows):
    """Paths and lost nodes by a walk from every node."""
    known = {(lib, node): (parent, seq, name) for lib, node, parent, seq, name in rows}
    paths, lost = {}, set()
    for lib, node in known:
        path, at, seen = [], node, set()
        while (lib, at) in known and at not in seen:
            seen.add(at)
            parent, seq, name = known[lib, at]
            path.append((name, seq, at))
            at = parent
        if at in seen:
            lost.add((lib, node))
        else:
            paths[lib, node] = path[::-1]
    return paths, lost


def got(spark, rows):
    tree, issues = P.tree_paths(spark.createDataFrame(rows, NODES))
    paths = {(r.library_id, r.node_id): [(n, k.seq, k.id) for n, k in zip(r.path, r.sort_key)] for r in tree.collect()}
    return paths, [(r.library_id, r.entity_id) for r in issues.collect()]


@pytest.mark.parametrize("anchors, hot", [(1, 64), (3, 2), (16, 0), (1 << 40, 64)])
def test_trees_equal_a_walk(spark, monkeypatch, anchors, hot):
    """Chains, bushes, unknown parents, rings of several lengths and what hangs below them, in two libraries."""
    monkeypatch.setattr(P, "ANCHORS", anchors)
    if hot < 64:
        monkeypatch.setattr(P, "SAMPLE", 1)
        monkeypatch.setattr(P, "HOT", hot)
    rnd, rows = random.Random(5), []
    for lib in ("A", "B"):
        rows += [(lib, f"c{n}", f"c{n - 1}", n % 3, f"C{n % 7}") for n in range(90)]
        rows += [(lib, f"t{n}", f"t{rnd.randint(0, n - 1)}" if n % 40 else "gone", n, f"T{n}") for n in range(200)]
        for length in (1, 2, 5, 30):
            rows += [(lib, f"r{length}-{n}", f"r{length}-{(n + 1) % length}", 0, "R") for n in range(length)]
            rows += [(lib, f"h{length}-{n}", f"r{length}-0" if n == 0 else f"h{length}-{n - 1}", 0, "H") for n in range(20)]
    rows += [("A", "none", None, None, None), ("A", "below none", "none", 1, "x")]
    paths, lost = whole(rows)
    tree, issues = got(spark, rows)
    assert tree == paths and len(issues) == len(lost) and set(issues) == lost


def test_null_keys_and_repeated_nodes(spark):
    rows = [(None, "a", None, 1, "A"), (None, "b", "a", 2, "B"), ("L", None, "a", 3, "C"), ("L", "d", "d2", 4, "D"), ("L", "d", "d2", 4, "D"), ("L", "d2", None, 5, "E")]
    tree, issues = got(spark, rows)
    assert not issues and tree == {
        (None, "a"): [("A", 1, "a")], (None, "b"): [("B", 2, "b")], ("L", "d2"): [("E", 5, "d2")], ("L", "d"): [("E", 5, "d2"), ("D", 4, "d")],
    }


def test_rounds_write_less_than_the_paths_hold(spark, monkeypatch):
    """Of deep trees the rounds write parts of paths: together fewer names than the whole paths have."""
    written = []

    def counted(df, name):
        back = materialise(df, name)
        if "path" in back.columns:
            written.append(back.agg(F.sum(F.size("path"))).first()[0] or 0)
        return back

    materialise = P.materialise
    monkeypatch.setattr(P, "materialise", counted)
    rows = [("A", f"{c}-{n}", f"{c}-{n - 1}", n, "N") for c in range(6) for n in range(500)]
    tree, _ = P.tree_paths(spark.createDataFrame(rows, NODES))
    held = tree.agg(F.sum(F.size("path"))).first()[0]
    assert held == 6 * 500 * 501 // 2 and sum(written) < held


def test_lists_do_not_climb(spark, monkeypatch):
    """Only folders with something in them are written again by the rounds."""
    written = []

    def counted(df, name):
        back = materialise(df, name)
        if "path" in back.columns:
            written.append(back.count())
        return back

    materialise = P.materialise
    monkeypatch.setattr(P, "materialise", counted)
    rows = [("A", f"f{n}", f"f{n // 4}" if n else None, n, "F") for n in range(10)] + [("A", f"l{n}", f"f{n % 10}", n, "L") for n in range(300)]
    tree, _ = P.tree_paths(spark.createDataFrame(rows, NODES))
    assert tree.count() == 310 and max(written) <= 10


@pytest.mark.parametrize("parent", ["0", "top", None])
def test_no_task_sorts_all_lists_of_one_folder(spark, tmp_path, monkeypatch, parent):
    """All lists hang at one parent, known or not: no partition of the written tree holds most of them."""
    largest = []

    def counted(df, name):
        back = materialise(df, name)
        if name == "tree" and "_up" in back.columns and "path" not in back.columns:
            largest.append(back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return back

    materialise = P.materialise
    monkeypatch.setattr(P, "materialise", counted)
    lists = spark.range(0, 200_000, 1, 4).select(
        F.lit("A").alias("library_id"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("node_id"), F.lit(parent).cast("string").alias("parent_id"),
        F.col("id").alias("seq"), F.lit("L").alias("name"),
    )
    top = spark.createDataFrame([("A", "top", None, 1, "T")], NODES)
    for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(setting, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree, issues = P.tree_paths(lists.unionByName(top))
        assert largest[0] < 100_000 and issues.isEmpty()
        assert tree.count() == 200_001 and tree.where("size(path) = 2").count() == (200_000 if parent == "top" else 0)
    finally:
        for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(setting)
