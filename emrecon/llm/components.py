"""Connected components by randomised contraction, two tables per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emrecon.llm.common import cut

#: Rounds whose maps are composed in one plan.
COMPOSED = 8


def connected(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node it is connected with) for every node in ``edges``
    (columns a, b). In each round a node is merged into the least node of its closed
    neighbourhood, and edges between merged nodes are what is left. The least is by id in
    even rounds, which merge stars around their least node at once, and by a hash that
    differs from round to round in odd ones, which leave three quarters of the nodes or
    less on average, whatever the graph; so 2 log n / log(4/3) rounds are expected at
    most, and mostly far fewer. The least node of a component always takes its neighbours
    in, so the loop ends without a cap. Joins are plain sort-merge joins of two written
    tables, whose skewed keys Spark splits at run time."""
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if len(maps) % 2:
            order = lambda c: F.xxhash64(c, F.lit(len(maps)))  # noqa: B023, E731
            near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("least"))
            near = near.select("node", F.when(order("least") < order("node"), F.col("least")).otherwise(F.col("node")).alias("to"))
        else:
            near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to"))
        maps.append(cut(near, "merged"))
        ends = [maps[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        merged = links.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        links = cut(merged.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    # from the last round, which has the fewest nodes, back to the first
    found = maps.pop()
    for at, near in enumerate(reversed(maps), 1):
        roots = found.select(F.col("node").alias("to"), F.col("to").alias("root"))
        found = near.join(roots, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        if at % COMPOSED == 0:
            found = cut(found, "roots")
    found = cut(found, "roots")
    least = found.groupBy("to").agg(F.min("node").alias("comp"))
    return cut(found.join(least, "to").select("node", "comp"), "labels")
