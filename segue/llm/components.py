"""Connected components of a table of links, by least labels and pointer jumping.

Each round takes a node's least label among itself and its neighbours, then that label's own label,
so labels travel twice as far each time. A round is a written table, and the rounds end when no label
changes. Nothing but the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.session import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node it can reach."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = written = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        after = low.join(jump, "low").select("node", F.least("low", "beyond").alias("new"), (F.least("low", "beyond") < F.col("root")).alias("changed"))
        after = materialise(after.select("node", F.col("new").alias("root"), "changed"), "labels")
        discard(written)
        written, labels = after, after.select("node", "root")
        if after.where("changed").isEmpty():
            discard(both)
            return labels
