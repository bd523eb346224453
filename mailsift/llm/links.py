"""Connected components of a link table, by contraction.

Each round every node points to its smallest neighbour where that is smaller
than itself; pointers are followed to their roots; links are rewritten to
roots and loops and repeats are dropped. At least one end of every link is
merged in a round, so the links run out after a logarithmic number of rounds
in practice. Links, labels and components stay distributed; only row counts
reach the driver. Each round's tables are written to the shared folder, so a
lost executor never replays earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.tables import drop_handoff, handoff


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (long columns a, b), where
    root is the smallest node that can be reached; nodes without a link to
    another node are left out. Null ends and loops are ignored."""
    edges = handoff(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        up = _to_roots(edges.groupBy("a").agg(F.min("b").alias("b")))
        by_a = edges.join(up.withColumnRenamed("b", "ra"), "a").select("ra", "b")
        both = by_a.join(up.select(F.col("a").alias("b"), F.col("b").alias("rb")), "b", "left").select("ra", F.coalesce("rb", "b").alias("rb"))
        rest = handoff(both.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        if roots is None:
            merged = up.select(F.col("a").alias("node"), F.col("b").alias("root"))
        else:
            further = up.select(F.col("a").alias("root"), F.col("b").alias("r2"))
            merged = roots.join(further, "root", "left").select("node", F.coalesce("r2", "root").alias("root"))
            merged = merged.unionByName(up.select(F.col("a").alias("node"), F.col("b").alias("root")))  # roots until now
        merged = handoff(merged, "roots")
        for old in (edges, roots, up):
            if old is not None:
                drop_handoff(old)
        edges, roots = rest, merged
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()


def _to_roots(pointers: DataFrame) -> DataFrame:
    """Follow pointers (a -> smaller b) by doubling until none can be followed."""
    now = handoff(pointers, "pointers")
    while True:
        nxt = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        if now.join(nxt, "b", "left_semi").isEmpty():
            return now
        step = handoff(now.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b")), "pointers")
        drop_handoff(now)
        now = step
