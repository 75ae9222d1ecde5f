"""Connected components by contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._cluster import drop_kept, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): component is the least node reachable.

    Each round every node points to its least neighbour or itself, pointers are followed once
    more, and the graph shrinks to the nodes pointed at; edges between different ones remain.
    Self-loops and repeated edges do no harm; an empty table gives an empty result.
    """
    graph = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    if graph.isEmpty():
        return edges.sparkSession.createDataFrame([], "node long, component long")
    while True:
        ends = graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to"))
        step = keep(step, "step")
        on = step.select(F.col("node").alias("via"), F.col("to").alias("beyond"))
        jump = keep(step.join(on, F.col("to") == F.col("via")).select("node", F.col("beyond").alias("to")), "jump")
        left = graph.join(jump.withColumnsRenamed({"node": "a", "to": "ra"}), "a").join(jump.withColumnsRenamed({"node": "b", "to": "rb"}), "b")
        left = left.where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = keep(left, "edges")
        if mapping is None:
            fresh = jump.withColumnRenamed("to", "component")
        else:
            moved = jump.select(F.col("node").alias("component"), "to")
            fresh = keep(mapping.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "mapping")
        for done in (graph, step, *([jump] if mapping is not None else []), *([mapping] if mapping is not None else [])):
            drop_kept(done)
        graph, mapping = rest, fresh
        if graph.isEmpty():
            drop_kept(graph)
            return mapping
