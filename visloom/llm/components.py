"""Connected components of a link table, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visloom.storage import discard, written


def connected(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links (a, b); root is the smallest vertex of its component.

    Each round hooks every root to the smallest root that any neighbour of its members has, lets each vertex take the
    smallest root next to it, and then takes the root's root; whole trees move at once, so long chains need few rounds.
    Roots only fall, so rounds end when none moves, without a cap; each round is a table in the shared folder that the
    next one replaces.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = written(both, "edges")
    roots = last = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = edges.join(roots, edges["b"] == roots["v"]).groupBy("a").agg(F.min("root").alias("m"))
        seen = written(roots.join(near, roots["v"] == near["a"]).select("v", "root", F.least("root", "m").alias("m")), "roots-near")
        hooks = seen.where("m < root").groupBy(F.col("root").alias("u")).agg(F.min("m").alias("h"))
        hooked = written(seen.join(hooks, seen["v"] == hooks["u"], "left").select("v", F.col("root").alias("old"), F.least("m", "h").alias("r1")), "roots-hooked")
        up = hooked.select(F.col("v").alias("u"), F.col("r1").alias("r2"))
        best = F.least("r1", "r2")
        moved = written(hooked.join(up, hooked["r1"] == up["u"]).select("v", best.alias("root"), (best != F.col("old")).alias("moved")), "roots")
        discard(last, seen, hooked)
        roots, last = moved.select("v", "root"), moved
        if moved.where("moved").isEmpty():
            discard(edges)
            return roots
