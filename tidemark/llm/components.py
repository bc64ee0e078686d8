"""Connected components of a graph given as edges, by rounds of hooking and contraction.

Each round, every node takes the smallest of itself and its neighbours as parent (a partial
aggregation, so a hub with millions of edges costs one row a task), parents are shortened by one
jump, and the edges are rewritten to parents, without loops and repeats.  The graph shrinks
by a constant factor a round; when no edge is left, the rounds' parents are followed from the
last to the first.  Every round is written to the shared folder; nothing reaches the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b: long); the root is one node of the
    component, the same for all.  Loops and repeated edges are allowed; no edges give no rows."""
    rounds: list[DataFrame] = []
    todo = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .filter("a < b").distinct(), "edges")
    while todo.limit(1).count():
        both = todo.union(todo.select("b", "a"))
        parent = save(both.groupBy(F.col("a").alias("node"))
                      .agg(F.least(F.first("a"), F.min("b")).alias("parent")), "parents")
        jump = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        parent = save(parent.join(jump, "parent").select("node", F.col("_up").alias("parent")), "jumps")
        rounds.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        moved = todo.join(left, "a").join(right, "b").select(F.least("_a", "_b").alias("a"),
                                                             F.greatest("_a", "_b").alias("b"))
        todo = save(moved.filter("a < b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).filter(F.lit(False))
    roots = rounds[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(rounds[:-1]):
        up = roots.select(F.col("node").alias("parent"), "root")
        roots = parent.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots
