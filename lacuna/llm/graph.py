"""Connected components of a table of edges, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import BROADCAST_ROWS, staged


def _bring(rows: DataFrame, small: DataFrame, on: str, how: str, n: int) -> DataFrame:
    """Joins a table of unique keys. It is broadcast where it has few rows; else both sides are shuffled
    as they were written, so that Spark can split the partition of a hot key."""
    return rows.join(F.broadcast(small) if n <= BROADCAST_ROWS else small.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: bigint): nodes share a root, itself one of them, just if
    they are connected.

    In each round every node is hooked to the node within two steps, or itself, that a hash of the round ranks first, and
    the edges are drawn anew between those. A star is one node after a round. As ranks are as good as random a chain
    loses a fixed share of its nodes, so rounds grow with the logarithm of the longest chain. A node's
    neighbours are only ever reduced to their minimum. No edges give no rows; self-loops and repeats are fine.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    hooks: list[tuple[DataFrame, int]] = []
    while not edges.isEmpty():
        seed = len(hooks)
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def rank(c: str, seed: int = seed):
            return F.struct(F.xxhash64(F.lit(seed), c).alias("r"), F.col(c).alias("v"))

        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        best = staged(best.select(F.col("a").alias("b"), F.least(F.col("m"), rank("a")).alias("m")), "best-neighbours")
        n = best.count()
        # every node is its neighbours' neighbour, so its own rank is among theirs
        hook = _bring(both, best, "b", "inner", n).groupBy("a").agg(F.min("m").alias("m"))
        hook = staged(hook.select(F.col("a").alias("node"), F.col("m.v").alias("to")), "hooks")
        hooks.append((hook, n))
        one = _bring(edges, hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a", "inner", n)
        two = _bring(one, hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b", "inner", n)
        edges = staged(two.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # nodes of a later round are among those of the one before
    roots, n = hooks[-1]
    roots = roots.select("node", F.col("to").alias("root"))
    for hook, size in reversed(hooks[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = staged(_bring(hook, later, "to", "left", n).select("node", F.coalesce("root", "to").alias("root")), "roots")
        n = size
    return roots
