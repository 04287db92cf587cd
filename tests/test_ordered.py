import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.plans.ordered import around, cut, group_values, large, ranked, running, running_max, splitters, uncut
from segue.sources.rekordbox import read_xml_playlists


def test_null_keys_and_null_orders(spark):
    rows = [("a", 1, 5), ("a", None, 9), ("a", 2, 1), (None, 3, 2), (None, 1, 7), ("a", 200_000, 4), ("a", 200_000, 6)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = sorted((str(r.k), r.v, r.n) for r in ranked(df, ["k"], "o", "n", ties=["v"]).collect())
    assert got == [("None", 2, 2), ("None", 7, 1), ("a", 1, 3), ("a", 4, 4), ("a", 5, 2), ("a", 6, 5), ("a", 9, 1)]
    top = group_values(df, ["k"], F.col("v") % 2, {"top": ("max", F.col("v"))}).collect()
    assert sorted((str(r.k), r.v, r.top) for r in top) == sorted((str(k), v, 9 if k else 7) for k, _, v in rows)
    near = {r.v: (r.prev and r.prev.v, r.next and r.next.v) for r in around(df.where("k = 'a'"), ["k"], "o", ["v"], ties=["v"]).collect()}
    assert near == {9: (None, 5), 5: (9, 1), 1: (5, 4), 4: (1, 6), 6: (4, None)}
    run = running_max(df.where("o < 10"), ["k"], "o", {"m": F.col("v")}).collect()
    assert sorted((str(r.k), r.o, r.m) for r in run) == [("None", 1, 7), ("None", 3, 7), ("a", 1, 5), ("a", 2, 5)]


@pytest.mark.parametrize("kind", ["equal", "sparse", "few values", "null"])
def test_chunks_follow_the_rows_whatever_the_order_column_holds(spark, kind):
    """All rows of one order value, or places billions apart: chunks hold about as many rows as asked for."""
    rnd = random.Random(3)
    order = {"equal": lambda: 7, "sparse": lambda: rnd.randint(0, 1 << 50), "few values": lambda: rnd.choice([1, 5, 1 << 40]), "null": lambda: None}[kind]
    rows = [("hot", order(), k) for k in range(3000)] + [(f"g{k % 400}", order(), k) for k in range(3000, 4000)] + [(None, order(), k) for k in range(4000, 4500)]
    df = spark.createDataFrame(rows, "g string, o bigint, k bigint").repartition(4).cache()
    sizes = large(cut(df, ["g"], "o", ["k"], chunk=100)).groupBy("g", "__chunk").count().collect()
    assert {r.g for r in sizes} == {"hot", None} and 25 <= len([r for r in sizes if r.g == "hot"]) <= 35
    assert all(50 <= r["count"] <= 200 for r in sizes)
    assert splitters(df, ["g"], "o", ["k"], chunk=100).count() == 2  # small groups have no row in a side table
    w = W.partitionBy("g").orderBy("o", "k")
    want = df.select("k", F.row_number().over(w).cast("bigint").alias("n"), F.lag("k").over(w).alias("p"), F.sum("k").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    laid = cut(df, ["g"], "o", ["k"], chunk=100)
    got = running(around(ranked(laid, ["g"], "o", "n", ["k"]), ["g"], "o", ["k"], ["k"]), ["g"], "o", F.col("k"), "sum", "s", ["k"])
    got = uncut(got).select("k", "n", F.col("prev.k").alias("p"), "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_exchange_of_the_data(spark):
    """The data is shuffled once for three operators of one order; all else is samples and carries."""
    df = spark.range(0, 100_000, 1, 4).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert plan(ranked(df, ["g"], "o", "n")) <= 4
        laid = cut(df, ["g"], "o")
        both = uncut(around(ranked(laid, ["g"], "o", "n"), ["g"], "o", ["o"]))
        assert "SortMergeJoin" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_playlist_trees_of_any_depth(spark, tmp_path):
    deep = '<NODE Name="L" Type="1" KeyType="0" Entries="1"><TRACK Key="7"/></NODE>'
    for n in range(20, 0, -1):
        deep = f'<NODE Name="f{n}" Type="0" Count="1">{deep}</NODE>'
    root = f'<NODE Name="ROOT" Type="0" Count="1">{deep}</NODE>'
    (tmp_path / "a.xml").write_text(f"<DJ_PLAYLISTS><PLAYLISTS>{root}</PLAYLISTS></DJ_PLAYLISTS>")
    nodes, entries, _ = read_xml_playlists(spark, str(tmp_path))
    assert [r.key for r in entries.collect()] == ["7"]
    assert nodes.count() == 21
    assert [r.name for r in nodes.where("NOT is_folder").select("name").collect()] == ["L"]


def test_small_groups_are_plain_windows(spark):
    """Where no group is large, the data is read once: no second branch looks for chunks' edges."""
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 50).alias("g"), F.col("id").alias("o"), F.col("id").alias("v"))
    made = [
        ranked(df, ["g"], "o", "n"), around(df, ["g"], "o", ["o"]), running(df, ["g"], "o", F.col("v"), "sum", "s"),
        running(df, ["g"], "o", F.col("v"), "last", "s", inclusive=False), running_max(df, ["g"], "o", {"m": F.col("v")}),
    ]
    for out in made:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Range (") == 1 and "Join" not in plan
    assert [r.n for r in made[0].where("g = 7").orderBy("o").collect()] == list(range(1, 21))
    assert [r.s for r in made[3].where("g = 7").orderBy("o").collect()] == [None, *range(7, 950, 50)]
