"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a long, b long): root is one node of its component.

    Each round hooks every node to its least neighbour or itself, follows that once more, and
    contracts: edges are rewritten to the new nodes and loops dropped, so the number of nodes at
    least halves.  Rounds are written to the shared folder.
    """
    rest = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    both = rest.select("a").union(rest.select("b")).distinct()
    found = materialize(both.select(F.col("a").alias("node"), F.col("a").alias("root")), "labels")
    while not rest.isEmpty():
        ends = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "hooks")
        up = hook.select(F.col("a").alias("q"), F.col("p").alias("pp"))
        hook = materialize(hook.join(up, F.col("p") == F.col("q")).select("a", F.col("pp").alias("p")), "hooks")
        found = materialize(
            found.join(hook, F.col("root") == F.col("a"), "left").select("node", F.coalesce("p", "root").alias("root")), "labels"
        )
        left, right = hook.select(F.col("a").alias("x"), F.col("p").alias("px")), hook.select(F.col("a").alias("y"), F.col("p").alias("py"))
        rest = rest.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
        rest = materialize(rest.select(F.col("px").alias("a"), F.col("py").alias("b")).where("a <> b").distinct(), "edges")
    return found
