"""Connected components of an edge table, by random-priority contraction.

In every round each node goes to the neighbour (or itself) of the least hash for
that round; edges are renamed and loops and repeats dropped, until no edge is left.
A constant share of the nodes goes in each round, so rounds are few even for paths.
Nothing is collected; every round is a table in the shared folder, and the round before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanway.llm.common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b long); a label is a node of the component."""
    own = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stored(own.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    seed = 0
    while not own.isEmpty():
        seed += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = own.select(F.explode(F.array(F.struct(F.col("a").alias("node"), rank("b").alias("to")), F.struct(F.col("b").alias("node"), rank("a").alias("to")))).alias("e")).select("e.*")
        best = both.groupBy("node").agg(F.min("to").alias("to"))
        parents = stored(best.select("node", F.least(F.col("to"), rank("node"))["n"].alias("parent")), "parents")
        pa, pb = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        renamed = own.join(pa, "a").join(pb, "b").filter("pa <> pb")
        old = own, labels, parents
        own = stored(renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        labels = stored(labels.join(parents.toDF("label", "_p"), "label", "left").select("node", F.coalesce("_p", "label").alias("label")), "labels")
        forget(*old)
    return labels
