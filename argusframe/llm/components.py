"""Connected components by randomised contraction (Bögeholz, Brand and Todor: In-database connected component analysis).

Each round every vertex takes the neighbour (or itself) with the least hash as its representative, and edges are
contracted to representatives; the expected number of edges falls geometrically whatever the shape. A round is one
aggregation with map-side combine and two joins that Spark may split where a hub is hot. Edge sets are written to the
shared folder between rounds, so the plan stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes with an edge to another node occur.

    Nulls and loops in edges are ignored; repeated edges count once. An empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    both = materialise(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    levels: list[DataFrame] = []
    for k in range(max_rounds):
        if both.isEmpty():
            break
        near = F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), F.col("v").alias("w")))
        own = F.struct(F.xxhash64("u", F.lit(k)).alias("h"), F.col("u").alias("w"))
        step = both.groupBy("u").agg(near.alias("m")).select("u", F.least("m", own)["w"].alias("r"))
        step = materialise(step, "cc-step")
        levels.append(step)
        a = step.select("u", F.col("r").alias("ru"))
        b = step.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        after = both.join(a, "u").join(b, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
        after = materialise(after, "cc-edges")
        discard(both)
        both = after
    else:
        raise RuntimeError("the contraction did not end")
    discard(both)
    if not levels:
        return e.select(F.col("u").alias("node"), F.col("u").alias("component")).where("false")
    found = levels[-1].select(F.col("u").alias("node"), F.col("r").alias("root"))
    for step in reversed(levels[:-1]):
        up = found.select(F.col("node").alias("r"), F.col("root").alias("up"))
        after = materialise(step.join(up, "r", "left").select(F.col("u").alias("node"), F.coalesce("up", "r").alias("root")), "cc-found")
        for done in (step, found):
            discard(done)
        found = after
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
