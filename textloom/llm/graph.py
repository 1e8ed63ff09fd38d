"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_saved, saved


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(v, root) for every vertex of links (two columns of one ordered type, no nulls); root is the smallest vertex reachable.

    Each round lowers every root to the smallest root of the neighbours (a combined minimum, so a
    vertex with very many links needs no gathering) and then to that root's own root, so the rounds
    grow with the logarithm of the longest path. Each round is a table in the shared folder.
    """
    both = links.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(links.select(F.col(b).alias("v"), F.col(a).alias("u"))).where("v <> u")
    both = saved(both.distinct(), "links")
    roots = saved(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("root")), "roots")
    for _ in range(max_rounds):
        near = both.join(roots.select(F.col("v").alias("u"), "root"), "u").groupBy("v").agg(F.min("root").alias("near"))
        lower = roots.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # the root of the root, as it stood before this round
        jump = roots.select(F.col("v").alias("root"), F.col("root").alias("further"))
        step = saved(lower.join(jump, "root", "left").select("v", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "roots")
        moved = not step.where("old <> root").isEmpty()
        drop_saved(roots)
        roots = step.drop("old")
        if not moved:
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
