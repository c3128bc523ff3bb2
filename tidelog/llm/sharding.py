"""Sharding by a hierarchical weighted hash tree (native DataFrame functions only).

A row descends region, rack and shard. At every level each child draws -ln(u) / weight with u hashed from the key and
the child's name, and the smallest draw wins: a child gets rows in proportion to its weight, and changing one weight
moves rows only into or out of the subtree that changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, take

SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: its name enters the draws; a leaf has a shard number and its own weight."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = ()

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def topology(shards: int, founded: int | None = None, weights: dict[int, float] | None = None, region: int = 8, rack: int = 4) -> Node:
    """The tree of `shards` shards: the first `founded` (default: all) in racks of `rack` and regions of `region`, as laid
    out when the store was founded; every later one appended as a region of its own.

    So one shard more is a new subtree at the root: no other subtree changes, and rows move into the new shard only, from
    any number to the next. To lay the shards out anew, name another `founded`; that moves rows everywhere.
    """
    founded = shards if founded is None else founded
    if not 1 <= founded <= shards:
        raise ValueError("at least one shard must be founded, and no more than there are")
    leaf = lambda s: Node(f"s{s}", (weights or {}).get(s, 1.0), s)
    regions = []
    for g in range(0, founded, region):
        end = min(g + region, founded)
        racks = [Node(f"k{r}", children=tuple(leaf(s) for s in range(r, min(r + rack, end)))) for r in range(g, end, rack)]
        regions.append(Node(f"g{g}", children=tuple(racks)))
    regions += [Node(f"g{s}+", children=(Node(f"k{s}+", children=(leaf(s),)),)) for s in range(founded, shards)]
    return Node("root", children=tuple(regions))


def place(tree: Node, *key: Column) -> Column:
    """The shard (int) that the key columns descend to; subtrees of weight 0 get nothing."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    alive = [c for c in tree.children if c.total() > 0]
    if not alive:
        raise ValueError(f"{tree.name} has no weight")
    if len(alive) == 1:
        return place(alive[0], *key)
    draw = lambda c: -F.log((F.shiftrightunsigned(F.xxhash64(F.lit(c.name), *key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(c.total()))
    best = F.array_min(F.array(*[F.struct(draw(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(alive)]))["i"]
    return F.element_at(F.array(*[place(c, *key) for c in alive]), best + 1)


def shard_rows(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None, founded: int | None = None) -> DataFrame:
    """One row for each row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    grown_shard is the shard of `shards + 1` shards of the same founding: shard_rows(df, shards + 1, founded=shards).

    Law `key`: key and shard count alone decide. size: UTF-8 bytes of the text plus 1 (null: 1). text_crc32: of the
    UTF-8 bytes, null counts as empty. slot: gapless from 0 in each shard; hash ranges of a shard are numbered apart and
    then offset by counts, so no task holds a whole shard. A null key is a key like any other (all its rows share a shard,
    by the law); repeated rows get slots of their own, ties among equal rows fall anyhow; a text's length changes only its
    size; an empty table gives an empty result; other columns are ignored.
    """
    founded = shards if founded is None else founded
    tree, grown = topology(shards, founded, weights), topology(shards + 1, founded, weights)
    bound = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = take(df, doc_id=key, text=text).select(
        "doc_id", (F.octet_length(bound).cast("long") + 1).alias("size"), F.crc32(bound).cast("long").alias("text_crc32"),
        place(tree, F.col("doc_id")).cast("int").alias("shard"), place(grown, F.col("doc_id")).cast("int").alias("grown_shard"),
        # Rows that share one key spread over the buckets by their texts: a hot key fills no single bucket.
        F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id"), F.crc32(bound), F.octet_length(bound)), F.lit(SLOT_BUCKETS)).cast("int").alias("_b"),
    )
    rows = cut(rows, "shards")
    counts = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("shard", "_b", "_from")
    inner = Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_r", F.row_number().over(inner))
    return ranked.join(starts, ["shard", "_b"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_from") + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard"
    )

