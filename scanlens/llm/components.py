"""Connected components of a graph of links, on DataFrames: a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Scratch


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component.

    Every round hands each node the least root among its own and its neighbours', hooks the old root to the
    new one, and then shortens paths (root of root). Every node is linked with itself, too, so that one aggregate
    has its own root beside its neighbours'. A round is written to the shared folder, so lost executors cost one
    round at most; older rounds are deleted. Links may repeat, go both ways, or lead from a node to itself; no link
    is no row.
    """
    scratch = Scratch(links.sparkSession, "components")
    ways = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"])
    both = scratch.written(links.select(F.explode(ways).alias("l")).select("l.a", "l.b").distinct(), "links")
    now = scratch.written(both.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    for _ in range(most_rounds):
        roots = now.select("node", "root")
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
        seen = near.groupBy(F.col("a").alias("node")).agg(F.max(F.when(F.col("a") == F.col("b"), F.col("r"))).alias("root"), F.min("r").alias("best"))
        hooks = seen.where(F.col("best") < F.col("root")).groupBy("root").agg(F.min("best").alias("hook")).select(F.col("root").alias("node"), "hook")
        moved = seen.join(hooks, "node", "left").select("node", F.col("root").alias("was"), F.least("best", F.coalesce("hook", "best")).alias("to"))
        up = roots.select(F.col("node").alias("to"), F.col("root").alias("up"))
        after = scratch.written(moved.join(up, "to").select("node", "was", F.least("to", "up").alias("root")), "roots")
        changed = after.where(F.col("root") != F.col("was")).limit(1).count()
        scratch.drop(now)
        now = after
        if not changed:
            scratch.drop(both)
            return now.select("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links that made `roots` (node, root) and more links (a, b): only roots are linked anew."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    up = components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b"))
    more = up.select(F.col("node").alias("root"), F.col("root").alias("up"))
    old = roots.join(more, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    alone = up.join(roots.select("node"), "node", "left_anti")
    return Scratch(links.sparkSession, "components").written(old.unionByName(alone), "joined")
