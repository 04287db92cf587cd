"""Repeated runs of lines, found by prefix doubling over line ids; later copies are deleted.

The lines of all documents are one sequence of line ids, cut at document ends. Prefix doubling names
the run of 2**k lines at every place: the pair of names of its halves is sorted over all places by
range partitions, and the place in that order is the name, so names order suffixes by their first
2**k lines. Places whose run occurs once drop out of every further round. Suffixes that share a
prefix are one interval of the suffix order, and two names, of the prefix's first and last 2**k
lines, tell it.

A run counts if it has ``min_words`` words or more. Every maximal repeated run with an earlier copy is
the union of its shortest such runs, taken forward from its first lines and backward from its last, so
these are the only prefixes looked at, and a run needs no more rounds than log2(min_words). The first
copy, in order of (doc_id, line), stays; all lines of the others go.

Only DataFrame functions are used. A line or run that a third of all rows share is a key of
aggregations and of joins with a unique side, never a group in one task.

Defined results: words are what lies between runs of any white space, at least one a line; lines are
compared without spaces, tabs and returns at their ends; blank lines are neither counted nor deleted, and a run goes on across them; NULL and empty texts stay as they are; a
NULL doc_id comes first; rows with the same doc_id and text are one row and get the same result; rows
with one doc_id and other texts are ordered by a hash of the text; an empty table gives no rows;
columns named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.session import materialise

PLACE = ["doc", "tag", "seq"]


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _tag() -> Column:
    return F.xxhash64("text")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: doc, tag (which text), seq (its number among these), no (its number
    in the text), two hashes, and its words."""
    lines = F.transform(
        F.split("text", "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(" \t\r")).alias("line"), i.alias("no"))
    )
    full = F.posexplode(F.filter(lines, lambda x: x["line"] != "")).alias("seq", "x")
    rows = docs.where(F.col("text").isNotNull()).select(_doc().alias("doc"), _tag().alias("tag"), full)
    line = F.col("x.line")
    return rows.select(
        "doc", "tag", "seq", F.col("x.no").alias("no"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"),
        F.greatest(F.lit(1), F.regexp_count(line, F.lit(r"[^\s\p{Z}\x{85}]+"))).alias("words"),
    )


def _named(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` whose (a, b) occurs more than once, with the pair's place in order as ``name``."""
    pairs = rows.groupBy(a, b).agg(F.count("*").alias("_n")).where("_n > 1").select(a, b)
    order = pairs.repartitionByRange(a, b).sortWithinPartitions(a, b)
    names = materialise(order.select(a, b, F.monotonically_increasing_id().alias("name")), "names")
    return rows.join(names, [a, b]).drop(a, b)


def _shortest_run(min_words: int, back: bool) -> Column:
    """How many consecutive repeated lines from this one on (or back) have ``min_words`` words; NULL if
    they end before that."""
    frame = Window.partitionBy("doc", "tag").orderBy("seq")
    frame = frame.rangeBetween(1 - min_words, 0) if back else frame.rangeBetween(0, min_words - 1)
    lines = F.collect_list(F.struct("seq", "words")).over(frame)
    step = -1 if back else 1
    run = F.aggregate(
        F.reverse(lines) if back else lines,
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.col("seq").alias("next")),
        lambda run, x: F.when(
            (run["words"] < min_words) & (x["seq"] == run["next"]),
            F.struct((run["words"] + x["words"]).alias("words"), (run["n"] + 1).alias("n"), (x["seq"] + step).alias("next")),
        ).otherwise(run),
    )
    return F.when(run["words"] >= min_words, run["n"])


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, tag, no) of every line to delete."""
    lines = materialise(numbered_lines(docs), "lines")
    named = _named(lines, "h1", "h2").dropDuplicates(PLACE)  # a repeated row is one row
    level = materialise(named, "level")
    seen = level.select(*PLACE, "no", "words")
    names = level.select(*PLACE, F.lit(0).alias("k"), "name")
    by_place = Window.partitionBy("doc", "tag").orderBy("seq")
    for k in range(int(math.log2(max(1, min_words)))):
        half = level.select(*PLACE, F.col("name").alias("a"), F.first("name").over(by_place.rangeBetween(2**k, 2**k)).alias("b"))
        level = materialise(_named(half.where("b IS NOT NULL"), "a", "b"), "level")
        names = names.unionByName(level.select(*PLACE, F.lit(k + 1).alias("k"), "name"))

    runs = seen.select(*PLACE, _shortest_run(min_words, False).alias("ahead"), _shortest_run(min_words, True).alias("behind"))
    runs = materialise(runs.where("ahead IS NOT NULL OR behind IS NOT NULL"), "runs")
    ahead = runs.where("ahead IS NOT NULL").select("doc", "tag", "seq", F.col("ahead").alias("n"))
    behind = runs.where("behind IS NOT NULL").select("doc", "tag", F.expr("seq - behind + 1").alias("seq"), F.col("behind").alias("n"))
    runs = ahead.unionByName(behind).distinct().withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int"))
    first = names.withColumnRenamed("name", "a")
    last = names.select("doc", "tag", F.col("seq").alias("at"), "k", F.col("name").alias("b"))
    prefixes = runs.join(first, [*PLACE, "k"]).withColumn("at", F.expr("seq + n - shiftleft(1, k)")).join(last, ["doc", "tag", "at", "k"])
    prefixes = materialise(prefixes.select(*PLACE, "n", "a", "b"), "prefixes")
    interval = ["n", "a", "b"]
    place = F.struct(*PLACE)
    firsts = prefixes.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = prefixes.join(firsts, interval).where(place > F.col("first"))
    gone = later.select("doc", "tag", F.explode(F.expr("sequence(seq, seq + n - 1)")).alias("seq")).distinct()
    return gone.join(seen, PLACE).select("doc", "tag", "no")


def delete_repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All columns of ``docs`` with the later copies' lines taken out of ``text``, and ``removed_lines``:
    their numbers in the old text from 0, ascending."""
    gone = later_copies(docs, min_words).groupBy("doc", "tag").agg(F.array_sort(F.collect_set("no")).alias("_gone"))
    gone = gone.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "_gone")
    keyed = docs.drop("removed_lines", "_doc", "_tag", "_gone", "_lines").withColumns({"_doc": _doc(), "_tag": _tag()})
    met = keyed.join(gone, ["_doc", "_tag"], "left").withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n", -1)))
    # the numbers left are found by one hash set a document, not by a search for each line
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.transform(left, lambda i: F.get("_lines", i))
    met = met.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return met.withColumn("removed_lines", F.coalesce("_gone", F.expr("array()").cast("array<int>"))).drop("_doc", "_tag", "_gone", "_lines")
