"""Connected components of a link table, by repeated hooking and contraction.

Every step is a join or a min-aggregate over staged files: a node with very
many links costs partial aggregates and splittable joins, never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, root)`` for every linked node
    that isn't the smallest of its component; ``root`` is that smallest node.

    One round hooks each node to its smallest smaller neighbour, halves the
    paths until each ends at a root, and contracts the links to the roots.
    Each root that still has links hooks or is hooked in the next round, so
    the number of rounds is logarithmic.
    """
    links = work.stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .filter("a != b").distinct(), "links-0")
    found: DataFrame | None = None
    turn = 0
    while not links.isEmpty():
        hooks = work.stage(links.groupBy("a").agg(F.min("b").alias("p")), f"hooks-{turn}-0")
        jump, moved = 0, True
        while moved:
            jump += 1
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("up"))
            hooks = work.stage(hooks.join(up, "p", "left")
                               .select("a", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved")),
                               f"hooks-{turn}-{jump}")
            moved = not hooks.filter("moved").isEmpty()
            hooks = hooks.select("a", "p")
        if found is None:
            found = hooks
        else:
            higher = hooks.select(F.col("a").alias("p"), F.col("p").alias("up"))
            found = work.stage(found.join(higher, "p", "left").select("a", F.coalesce("up", "p").alias("p"))
                               .unionByName(hooks), f"found-{turn}")
        to_a = hooks.select("a", F.col("p").alias("ra"))
        to_b = hooks.select(F.col("a").alias("b"), F.col("p").alias("rb"))
        ends = (links.join(to_a, "a").join(to_b, "b", "left")
                .select(F.col("ra").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x != y"))
        turn += 1
        links = work.stage(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
                           f"links-{turn}")
    if found is None:
        found = links.select("a", F.col("b").alias("p"))
    return found.select(F.col("a").alias("node"), F.col("p").alias("root"))
