"""Connected components of an undirected graph given by its edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

JUMPS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (columns a, b: long): label is the smallest node of
    its component.

    Every round points each node at its smallest neighbour, follows the pointers some steps more,
    and draws the remaining edges between what is pointed at, until none remain. Stars end in one
    round, paths shrink to less than a fourth in each. Rounds are cut off by written tables; hubs
    are only aggregated by minimum or met in joins that Spark can split; pointers are broadcast
    while they are few. Null nodes are ignored.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        hook = written(both.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-hook")
        step = small(hook.toDF("label", "further"))
        up = hook
        for _ in range(JUMPS):
            up = up.join(step, "label").select("node", F.col("further").alias("label"))
        up = written(up, "cc-up")
        of_a, of_b = small(up.toDF("a", "la")), small(up.toDF("b", "lb"))
        edges = edges.join(of_a, "a").join(of_b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        edges = written(edges, "cc-edges")
        if found is None:
            found = up
        else:
            found = written(found.join(small(up.toDF("label", "to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-found")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return found
