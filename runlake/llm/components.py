"""Connected components of a graph whose links are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): (node, root), equal roots for connected nodes. The root is the smallest node of its component.

    Rounds of hooking (every root takes the smallest root next to its tree) and pointer jumping; their number grows with the
    logarithm of the longest chain. Each is a few joins and partial aggregations and is kept in the shared folder.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    while True:
        roots = cut(roots)
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        near = roots.join(near, F.col("node") == F.col("a")).filter("near < root")
        hooks = cut(near.groupBy("root").agg(F.min("near").alias("hook")))
        if hooks.isEmpty():
            # roots may still be nodes that have a smaller root themselves
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("hook")).filter("hook < root")
            moved = roots.join(up, "root", "left_semi")
            if moved.isEmpty():
                return roots
            hooks = up
        for _ in range(2):
            roots = roots.join(hooks, "root", "left").select("node", F.coalesce("hook", "root").alias("root"))
        parents = roots.select(F.col("node").alias("root"), F.col("root").alias("parent"))
        roots = roots.join(parents, "root", "left").select("node", F.least("root", F.coalesce("parent", "root")).alias("root"))
