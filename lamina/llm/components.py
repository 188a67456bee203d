"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import drop, forget, park, save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks
    twice, and contracts the edges to the hooks' ends until none is left. A node with very many
    edges costs only rows of partial minima and of joins, and so does a component with very many
    nodes: both sides of these joins are tables, so adaptive execution can split a large key. Null
    ends, loops and repeated edges are ignored; no edges give no rows.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    left = save(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    nodes = left.select("u").union(left.select("v")).distinct()
    label = save(nodes.select(F.col("u").alias("node"), F.col("u").alias("component")), "cc-labels")
    left, loops = left.where("u <> v"), [left]
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        hooks = [park(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")))]
        for _ in range(2):
            further = hooks[-1].select(F.col("u").alias("to"), F.col("to").alias("then"))
            hooks.append(park(hooks[-1].join(further, "to").select("u", F.col("then").alias("to"))))
        hook = hooks[-1]
        a, b = (hook.select(F.col("u").alias(x), F.col("to").alias(f"{x}_to")) for x in ("u", "v"))
        moved = left.join(a, "u").join(b, "v").where("u_to <> v_to")
        left = save(moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct(), "cc-edges")
        named = hook.where("u <> to").select(F.col("u").alias("component"), "to")
        old, label = label, save(label.join(named, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "cc-labels")
        forget(old, *loops)
        loops = [left]
        drop(*hooks)
    forget(*loops)
    return label
