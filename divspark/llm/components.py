"""Connected components of a link table by label contraction.

Each round every vertex points to its smallest neighbour (or itself), pointers
are followed once more, and the links are renamed by them; links inside one
component vanish.  The number of rounds is logarithmic in practice and every
table is stored, so nothing is recomputed and nothing visits the driver but the
count of links left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divspark.llm.common import Workspace


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """``(key, root)`` for every vertex of ``links`` (columns a, b: bigint)."""
    links = ws.store(links.select("a", "b").where("a != b").distinct(), f"{name}-links0", few=True)
    roots = None
    for k in range(1000):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = ws.store(both.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("key"), F.least("a", "m").alias("to")), f"{name}-point{k}", few=True)
        hop = point.select(F.col("key").alias("to"), F.col("to").alias("root"))
        jump = ws.store(point.join(hop, "to").select("key", "root"), f"{name}-jump{k}", few=True)
        if roots is None:
            new = jump
        else:
            new = (roots.join(jump.select(F.col("key").alias("root"), F.col("root").alias("next")), "root", "left")
                   .select("key", F.coalesce("next", "root").alias("root")))
        roots = ws.store(new, f"{name}-roots{k}", few=True)
        a = jump.select(F.col("key").alias("a"), F.col("root").alias("ra"))
        b = jump.select(F.col("key").alias("b"), F.col("root").alias("rb"))
        left = ws.store(links.join(a, "a").join(b, "b").where("ra != rb")
                        .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"{name}-links{k + 1}", few=True)
        ws.drop(f"{name}-point{k}", f"{name}-jump{k}", f"{name}-links{k}", f"{name}-roots{k - 1}")
        if left.isEmpty():
            return roots
        links = left
    raise RuntimeError("components: no end after 1000 rounds")
