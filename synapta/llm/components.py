"""Connected components of a link table, by contraction: every round hooks each node to its
smallest neighbour, follows these pointers, and renames the links; the nodes that are left at
least halve. Every step is a join or a partial aggregate, so a node with very many links makes
no large task, and nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.llm.shared import free, save


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node in ``links`` (a long, b long); component: the smallest node reachable."""
    links = save(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-links")
    names = None
    while names is None or not links.isEmpty():
        both = links.union(links.select("b", "a"))
        first = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), f"{label}-hooks")
        hooks = first
        for _ in range(2):  # to < node or a root: pointers never run in circles
            up = hooks.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
            hooks = hooks.join(up, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_to", "to").alias("to"))
        hooks = save(hooks, f"{label}-hooks")
        if names is None:
            renamed = hooks.select("node", F.col("to").alias("component"))
        else:
            up = hooks.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
            renamed = names.join(up, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_to", "component").alias("component"))
        renamed = save(renamed, f"{label}-names")
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = links.join(a, "a").join(b, "b").filter("ta <> tb")
        left = save(moved.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), f"{label}-links")
        free(first, hooks, links, names)
        names, links = renamed, left
    free(links)
    return names
