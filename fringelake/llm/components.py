"""Connected components of a link table, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b); comp is one node of the component.

    Each round, a node joins its least neighbour (and that one's choice), and
    links are drawn anew between what is left; components shrink geometrically.
    Hubs are safe: the least is summed before it is shuffled.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct())
    mapping = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")))
        onward = choice.select(F.col("node").alias("to"), F.col("to").alias("further"))
        root = stored(choice.join(onward, "to").select("node", F.col("further").alias("comp")))
        if mapping is None:
            mapping = root
        else:
            step = root.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            mapping = stored(mapping.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")))
        ends_a, ends_b = root.select(F.col("node").alias("a"), F.col("comp").alias("x")), root.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        edges = stored(edges.join(ends_a, "a").join(ends_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return mapping
