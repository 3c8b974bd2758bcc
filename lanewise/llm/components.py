"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import drop, spread_join, written


#: Rows of which all may meet in one task: some 16 MB.
FEW = 1 << 20


def _joined(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges with what is known of their u; of many edges, the rows of a node with very many neighbours are spread."""
    return edges.join(least, "u") if total <= FEW else spread_join(edges, least, "u", "__n", total, "v")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each neighbour above u is tied to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("__n"))
    return _joined(both, least, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """With u > v in each edge: u and its lower neighbours are tied to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
    others = _joined(edges, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(id, component): for each end of an edge the smallest id reachable from it.

    Edges with a null end and loops are left out; an empty table gives an empty
    result. Every round is an aggregate with map-side combine and a join on the
    same key, written to the shared folder. Of more than FEW edges the rows of a
    node with very many neighbours are spread over several tasks, and no group
    is ever collected.
    """
    now = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = now.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).distinct()
    before, kept = None, written(now, "edges")
    for _ in range(most_rounds):
        state = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            return kept.select(F.col("u").alias("id"), F.col("v").alias("component")).union(kept.select("v", "v").distinct())
        old, before = kept, state
        kept = written(_small_star(_large_star(kept, state[0]), state[0]), "edges")
        drop(old)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
