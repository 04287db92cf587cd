"""Mixing sources to target weights by budgets that flow down a domain-language-source tree.

A node's capacity is the tokens below it, as often as they may be repeated. From the root down, a
node's budget is divided among its children by their weights; a child that can't take its part gets
its capacity, and what is left is divided among its siblings again. A node never gets more than its
capacity, so only what all children together can't take is missing at the parent, where its own
siblings take it: shortages go to siblings before ancestors. All amounts are integers.

A leaf with a budget of e times its tokens and a rest takes e whole epochs and the first documents of
a further one, up to the rest: each epoch orders the documents anew by a seeded hash. The order is
never sorted as a whole: token sums by the hash's first 16 bits tell where the rest ends, and only
the documents of that one stretch are ranked.

Only DataFrame functions are used. A source with a third of all rows is summed up by partial
aggregation and joined as rows of a fact table.

Defined results: NULL and empty texts have no tokens and are taken in whole epochs only; NULL names
are the node '' of their level; nodes without a weight have ``default_weight``; weights of 0 and nodes
without tokens get nothing; ties in the hash go by doc_id and a hash of the text; repeated rows are
taken each; an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.session import materialise

STRETCHES = 4  # hexadecimal digits of the hash


def _divided(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``nodes`` (parent, name, weight, capacity, total: the parent's budget) with each one's ``budget``."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    wide = lambda x: F.expr(f"CAST({x} AS DECIMAL(19, 0))")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.where("weight > 0 AND capacity > 0").withColumns({"_before": before, "_after": after})
    nodes = nodes.withColumn("_full", wide("capacity") * wide("_after") <= wide("weight") * wide("total - _before"))
    full = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(by), F.lit(0))
    nodes = nodes.withColumns({"_left": F.col("total") - full, "_weights": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by)})
    nodes = nodes.withColumn("_share", F.expr("CASE WHEN NOT _full THEN CAST(weight AS DECIMAL(19, 0)) * CAST(_left AS DECIMAL(19, 0)) div _weights END"))
    spare = F.col("_left") - F.sum("_share").over(by)
    place = F.row_number().over(by.orderBy("_full", name))
    budget = F.when(F.col("_full"), F.col("capacity")).otherwise(F.col("_share") + (place <= spare).cast("long"))
    return nodes.withColumn("budget", budget).drop("_before", "_after", "_full", "_left", "_weights", "_share")


def leaf_budgets(leaves: DataFrame, path: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: int, max_epochs: int, default_weight: int) -> DataFrame:
    """``leaves`` (path, have) with ``budget`` tokens for each."""
    spark = leaves.sparkSession
    table = spark.createDataFrame(
        [("\0".join(k), int(v)) for k, v in weights.items()] or [("", int(default_weight))], "_path string, _weight long"
    ).dropDuplicates(["_path"])
    above = None
    for depth in range(1, len(path) + 1):
        parent, name = list(path[: depth - 1]), path[depth - 1]
        nodes = leaves.groupBy(*path[:depth]).agg((F.sum("have") * max_epochs).alias("capacity"))
        nodes = nodes.withColumn("_path", F.concat_ws("\0", *path[:depth])).join(table, "_path", "left").drop("_path")
        nodes = nodes.withColumn("weight", F.coalesce("_weight", F.lit(default_weight))).drop("_weight")
        if above is None:
            nodes = nodes.withColumn("total", F.lit(budget))
        else:
            nodes = nodes.join(above.select(*parent, F.col("budget").alias("total")), parent)
        above = _divided(nodes, parent, name)
    return above.select(*path, "budget")


def mix(
    docs: DataFrame, path: Mapping[str, Column], weights: Mapping[tuple[str, ...], int], tokens: Column, budget: int | None = None,
    share: float = 1.0, max_epochs: int = 1, seed: int = 0, default_weight: int = 1,
) -> DataFrame:
    """The documents taken, once for each epoch: all columns of ``docs``, the path's columns, ``epoch``,
    ``tokens`` and ``taken`` (fewer for the one document at which a leaf's budget ends).

    ``path``: columns of the tree from the root's children to the leaves; ``weights``: integers by path,
    as ("web",) or ("web", "en"); ``budget``: tokens, or else ``share`` of those there are.
    """
    names = list(path)
    named = {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in path.items()}
    rows = docs.drop("epoch", "tokens", "taken", "_code", "_full", "_rest", "_tie").withColumns(named).withColumn("tokens", F.coalesce(tokens.cast("long"), F.lit(0)))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    leaves = materialise(rows.groupBy(*names).agg(F.sum("tokens").alias("have")), "leaves")
    there = leaves.agg(F.sum("have")).first()[0] or 0
    wanted = min(int(there * share) if budget is None else budget, there * max_epochs)
    plan = leaves.join(leaf_budgets(leaves, names, weights, wanted, max_epochs, default_weight), names)
    plan = materialise(plan.select(*names, F.expr("budget div have").alias("_full"), F.expr("budget % have").alias("_rest")), "plan")

    code = F.md5(F.concat_ws(":", F.lit(seed), F.col("_full"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.join(plan, names).withColumn("_code", code)
    stretch = F.substring("_code", 1, STRETCHES)
    sums = rows.where("_rest > 0").groupBy(*names, "_rest", stretch.alias("_cut")).agg(F.sum("tokens").alias("_n"))
    upto = Window.partitionBy(*names).orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = sums.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
    cuts = materialise(cuts.where("_before < _rest AND _rest <= _upto").select(*names, "_cut", "_before"), "cuts")

    whole = rows.where("_full > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, _full - 1)"))).withColumn("taken", F.col("tokens"))
    last = rows.where("_rest > 0 AND tokens > 0").join(cuts, names).withColumn("epoch", F.col("_full"))
    inside = last.where(stretch < F.col("_cut")).withColumn("taken", F.col("tokens"))
    order = Window.partitionBy(*names).orderBy("_code", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = last.where(stretch == F.col("_cut")).withColumn("_sofar", F.col("_before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    edge = edge.where("_sofar < _rest").withColumn("taken", F.least(F.col("tokens"), F.col("_rest") - F.col("_sofar"))).drop("_sofar")
    spare = ["_code", "_full", "_rest", "_tie"]
    ended = inside.unionByName(edge).drop(*spare, "_cut", "_before")
    return whole.drop(*spare).unionByName(ended)
