"""Connected components by repeated contraction.

In each round every node is hung under the smallest label next to it, chains are
shortened by pointer jumping, and edges are rewritten to the new labels; edges
inside a component vanish. The number of labels that still have edges at least halves per
round, so rounds grow with the logarithm of the input. Rounds are cut by written
tables, never by local checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

JUMPS = 2


def connected_components(edges: DataFrame, *, a: str = "a", b: str = "b", scratch: Scratch | None = None, label: str = "cc") -> DataFrame:
    """(node, component) for every node of an edge list; the component is its smallest node. Self-loops and repeats are fine, nulls are not edges."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    x, y = F.col(a), F.col(b)
    pairs = edges.where(x.isNotNull() & y.isNotNull()).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()
    current = scratch.write(pairs, f"{label}-edges-0")
    nodes = current.select(F.col("u").alias("node")).union(current.select("v")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    current = current.where("u <> v")
    turn = 0
    while not current.isEmpty():
        turn += 1
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        for jump in range(JUMPS):
            over = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up = up.join(over, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        up = scratch.write(up, f"{label}-up-{turn}")
        labels = labels.join(up.select(F.col("u").alias("component"), F.col("p").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        moved = current.join(up.select("u", F.col("p").alias("pu")), "u").join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        kept = moved.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        current = scratch.write(kept, f"{label}-edges-{turn}")
        if turn > 1:
            scratch.drop(f"{label}-edges-{turn - 1}")
    return scratch.write(labels, f"{label}-labels")
