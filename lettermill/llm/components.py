"""Connected components of a link table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch

#: Each pair of steps at least halves the depth; 64-bit ids cannot need more, so more is an error.
MOST_STEPS = 64


def _star(edges: DataFrame, least: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them (or the node itself)."""
    near = edges.join(least, "u")
    if larger_only:
        near = near.where("v > u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(a, b) links to (node, component): the least node reachable, for nodes with a link to another.

    Null ends and self links are ignored, repeated links count once. Edges are shuffled by node only
    after a min() that is combined on the map side; the minima are written before they are joined, so
    that a node with very many links can be split by adaptive execution. Every step is a written
    table, the last two of which are kept: a lost executor costs one step at most.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}-edges-0")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for step in range(1, MOST_STEPS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-large-{step}")
        large = scratch.save(_star(both, least, True).distinct(), f"{name}-mid-{step}")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small-{step}")
        tied = _star(down, least, False).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        new = scratch.save(tied.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges-{step}")
        scratch.drop(f"{name}-edges-{step - 1}", f"{name}-mid-{step}", f"{name}-large-{step}", f"{name}-small-{step}")
        edges, before = new, state
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"components still change after {MOST_STEPS} steps")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
