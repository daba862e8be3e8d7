"""Connected components of a link table, by star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.sources.workspace import materialize


def linked_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the smallest node of its component.

    Rounds of two steps: every node hands its larger neighbours, then its smaller ones, to
    its least neighbour. The links become one star per component after a number of rounds
    that grows with the logarithm of its size. Each round is written out, so a lost
    executor costs one round at most, and only the number of links that moved is collected.
    """
    least, greatest = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    edges = materialize(links.where("a != b").select(least, greatest).distinct())
    while True:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            edges.select(F.col("low").alias("node"), F.col("high").alias("other")))
        lowest = both.groupBy("node").agg(F.min("other").alias("to")).withColumn("to", F.least("node", "to"))
        large = both.where("other > node").join(lowest, "node").select(
            F.col("other").alias("high"), F.col("to").alias("low")).where("high > low").distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("to"))
        joined = large.join(lowest, "high")
        small = joined.select(F.explode(F.array(F.struct("high", F.col("to").alias("low")),
                                                F.struct(F.col("low").alias("high"), F.col("to").alias("low"))))
                              .alias("edge")).select("edge.*").where("high > low").distinct()
        turned = materialize(small.select("low", "high"))
        if turned.exceptAll(edges).isEmpty() and edges.exceptAll(turned).isEmpty():
            break
        edges = turned
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root"))).distinct()
