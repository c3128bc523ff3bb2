"""Connected components by alternating large-star and small-star rounds; every round is cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

MAX_ROUNDS = 60
#: So many edges (16 bytes each) are united in one task; more go through the rounds.
ONE_TASK_EDGES = 250_000


def _forest(batches):
    """A spanning forest of a partition's edges: each vertex with the smallest one it reaches there."""
    import numpy as np
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:  # vectorised hooking and pointer jumping
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    own = np.flatnonzero(low != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[low[own]])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, component (the smallest vertex it reaches) for every vertex that is not that smallest one itself.

    edges: two columns of longs; null ends, loops and repeated edges are harmless. Edges are first thinned to a spanning
    forest inside each partition; then large-star joins every vertex's larger neighbours to its smallest one, and
    small-star its other smaller ones, until nothing changes; a small rest is united in one task. A star's centre only sends its minimum through a window-free
    aggregation, so a hot vertex is one partial aggregate in each task.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    pairs = cut(pairs.mapInArrow(_forest, "u long, v long"), "forest")
    if pairs.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        return cut(pairs.coalesce(1).mapInArrow(_forest, "vertex long, component long"), "forest")
    for _ in range(MAX_ROUNDS):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v")))
        large = large.where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u")
        new = star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = cut(new, "star")
        # Done when each vertex has one edge and no edge's end has an edge of its own: a forest of stars.
        ends = new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("k")).first()
        pairs = new
        if ends["n"] == ends["k"] and not new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return new.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")
