"""Embedding near-dedup by sorted projection passes.

In each pass the different vectors of one label are ordered lexicographically by a string of random hyperplane signs, taken
around the label's mean, and each is compared with the next `window` ones. Verified pairs of all passes are united to
components. A label goes through so many passes that an isolated pair at the wanted cosine is missed by all of them with a
probability of MISS at most (see passes_for): their number grows slowly with the label, and large tables keep their recall.
Inside each component every pair is then compared in blocks, so that the links of dense groups, which no bounded window
holds, are counted in full.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .components import _forest, components
from .scratch import cut, take

COSINE = 0.93
WINDOW = 64
#: How often all passes may miss a pair that has no others near it, at the wanted cosine itself.
MISS = 1e-4
KEY_BITS = 62
#: Vectors of a sorted partition, of a block of a component.
PART_ROWS = 8_192
BLOCK_ROWS = 4_000
#: Passes that are sorted in one shuffle, which so holds this many copies of the vectors.
AT_ONCE = 4


#: A label so dense that the wanted cosine, seen from its mean, is lower than this gets the passes for this one: there most
#: vectors have many links, and are not isolated.
LEAST_COSINE = 0.5


def passes_for(vectors: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS, spread: float = 1.0) -> int:
    """Passes that a label of so many vectors needs, whose mean squared distance from their mean is `spread`.

    Two vectors at angle t, seen from the mean, have equal signs at a random hyperplane with probability 1 - t / pi. Where
    they share so many leading signs that about `window` of the label's vectors share them, log2(vectors / window), one
    window holds both.
    """
    seen = max(LEAST_COSINE, 1 - (1 - min(1.0, cosine)) / max(spread, 1e-9))
    share = max(0.0, math.log2(max(vectors, 1) / window))
    once = (1 - math.acos(seen) / math.pi) ** share
    return 1 if once >= 1 else math.ceil(math.log(miss) / math.log1p(-once))


def unit(col: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(col: pa.Array):
    """Row numbers of each vector length in the array."""
    n = np.diff(col.offsets.to_numpy())
    for d in np.unique(n):
        yield int(d), np.flatnonzero(n == d)


def sign_keys(seeds: range):
    """mapInArrow over (class, grp, passes, vector, mean): the first four with the sort keys of the passes `seeds` after grp."""
    weight = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)

    def run(batches):
        for b in batches:
            keys = np.zeros((b.num_rows, len(seeds)), np.int64)
            for d, at in by_length(b.column(3)):
                x = unit(b.column(3).take(pa.array(at)))
                mean = b.column(4).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                for k, seed in enumerate(seeds):
                    planes = np.random.default_rng([seed, d]).standard_normal((d, KEY_BITS))
                    keys[at, k] = ((x - mean) @ planes >= 0) @ weight
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(seeds), dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists, b.column(3)], names=["class", "grp", "passes", "keys", "vector"])

    return run


def window_pairs(ids: np.ndarray, grp: np.ndarray, col: pa.Array, old: int, window: int, cosine: float):
    """Pairs (u, v) within the window that reach the cosine, in sorted rows of which the first `old` were compared before."""
    lengths = np.diff(col.offsets.to_numpy())
    runs = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (lengths[1:] != lengths[:-1]), [True]]))
    for a, z in zip(runs[:-1], runs[1:], strict=True):
        if z <= old or z - a < 2:
            continue
        x, own = unit(col.slice(a, z - a)), ids[a:z]
        for w in range(1, min(window, len(own) - 1) + 1):
            hit = np.flatnonzero(np.einsum("ij,ij->i", x[:-w], x[w:]) >= cosine)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(own[hit + w])], names=["u", "v"])


def neighbours(window: int, cosine: float, schema: pa.Schema):
    """mapInArrow over sorted (class, grp, key, vector) of one partition, to rows of two kinds.

    Without border: (u, v), a spanning forest of the pairs found. With one: the first and the last `window` rows, for
    their neighbours in other partitions; those of border i stand at the end of partition i and at the start of the next.
    """

    def rows(t: pa.RecordBatch, border: int, side: int) -> pa.RecordBatch:
        n = t.num_rows
        cols = {"border": pa.array([border] * n, pa.int32()), "side": pa.array([side] * n, pa.int32()), **{c: t.column(i) for i, c in enumerate(("class", "grp", "key", "vector"))}}
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) if f.name not in cols else cols[f.name].cast(f.type) for f in schema], schema=schema)

    def run(batches):
        part = TaskContext.get().partitionId()
        found: list[pa.RecordBatch] = []
        before = head = None
        total = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([before, b] if before is not None else [b]).combine_chunks().to_batches()[0]
            found += window_pairs(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(3), before.num_rows if before is not None else 0, window, cosine)
            if len(found) > 1_000:  # pairs of a dense group go before memory grows
                found = list(_forest(found))
            total += b.num_rows
            if head is None or head.num_rows < window:
                head = pa.Table.from_batches([b] if head is None else [head, b]).combine_chunks().to_batches()[0].slice(0, window)
            before = t.slice(max(0, t.num_rows - window))
        for f in _forest(found):
            cols = {"u": f.column(0), "v": f.column(1)}
            yield pa.RecordBatch.from_arrays([cols.get(x.name, pa.nulls(f.num_rows, x.type)) for x in schema], schema=schema)
        if total:
            yield rows(before, part, 0)
            for back in range(1, min(part, -(-window // total), 8) + 1):  # small partitions have neighbours farther away
                yield rows(head, part - back, 1)

    return run


def border_pairs(window: int, cosine: float):
    """applyInArrow over the rows of one border: the pairs found."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("grp", "ascending"), ("key", "ascending"), ("class", "ascending")]).combine_chunks()
        pairs = window_pairs(t["class"].to_numpy(), t["grp"].to_numpy(), t["vector"].combine_chunks(), 0, window, cosine)
        return pa.Table.from_batches(_forest(pairs), pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def block_links(cosine: float):
    """applyInArrow over one block pair of a component: links of each class to classes of the other side, by weight."""

    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        ids, m = t["class"].to_numpy(), t["m"].to_numpy()
        same = t["p"][0].as_py() == t["q"][0].as_py()  # a block with itself
        x = unit(t["vector"].combine_chunks())
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        n = np.zeros(len(ids), np.int64)
        for a in range(0, len(left), 512):
            own = left[a : a + 512]
            hit = (x[own] @ x[right].T >= cosine) & (own[:, None] != right[None, :])
            n[own] += hit @ m[right]
            if not same:
                n[right] += m[own] @ hit
        return pa.table({"class": ids, "n": n})

    return run


def found_pairs(classes: DataFrame, cosine: float, window: int, miss: float) -> DataFrame:
    """u, v: pairs of classes that the passes find, thinned to a forest in each partition of each pass."""
    sizes = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not sizes.limit(1).count():
        return classes.sparkSession.createDataFrame([], "u long, v long")
    needed = F.udf(lambda k, mean: passes_for(k, cosine, window, miss, 1 - sum(x * x for x in mean)), "int")  # once a label
    # The mean of the unit vectors; means and sums are partial aggregates in each task.
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = classes.join(sizes.select("grp"), "grp").select("grp", array_to_vector(F.transform("vector", lambda x: F.coalesce(x.cast("double") / length, F.lit(0.0)))).alias("x"))
    means = scaled.groupBy("grp").agg(Summarizer.mean(F.col("x")).alias("x")).select("grp", vector_to_array("x").alias("mean"))
    labels = cut(sizes.join(means, "grp").select("grp", needed("k", "mean").alias("passes"), "mean"), "labels")
    kind = classes.schema["vector"].dataType
    n, rounds = -(-classes.count() // PART_ROWS), labels.agg(F.max("passes")).first()[0]
    keep = f"u long, v long, border int, side int, class long, grp long, key long, vector {kind.simpleString()}"
    out = None
    for lo in range(0, rounds, AT_ONCE):
        seeds = range(lo, min(lo + AT_ONCE, rounds))
        own = classes.join(labels.where(F.col("passes") > lo), "grp").select("class", "grp", "passes", "vector", "mean")
        keyed = cut(own.mapInArrow(sign_keys(seeds), f"class long, grp long, passes int, keys array<long>, vector {kind.simpleString()}"), "keys")
        each = keyed.select("class", "grp", "passes", F.posexplode("keys").alias("i", "key"), "vector").where(F.col("passes") > F.col("i") + lo)
        # Each pass of a label is a group of its own.
        ready = each.select("class", F.xxhash64("grp", "i").alias("grp"), "key", "vector")
        order = ready.repartitionByRange(n * len(seeds), "grp", "key", "class").sortWithinPartitions("grp", "key", "class")
        fields = to_arrow_schema(order.schema)
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("border", pa.int32()), ("side", pa.int32()), *[fields.field(c) for c in ("class", "grp", "key", "vector")]])
        met = cut(order.mapInArrow(neighbours(window, cosine, schema), keep), "passes")
        across = met.where("border is not null").groupBy("border").applyInArrow(lambda t: border_pairs(window, cosine)(t), "u long, v long")
        pairs = met.where("border is null").select("u", "v").union(across)
        out = pairs if out is None else out.union(pairs)
    return out


def link(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Only vectors of one label (not null) and one length are compared. Null, empty or zero vectors and those with null or
    non-finite components link with nothing: they have no links, and are their own components. Equal vectors are one
    class, compared once; n_links counts rows. Null ids come last in a component and are never its component_id unless
    alone; repeated rows count as rows, ties in the order fall by class; vectors of any length are compared whole; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = take(vectors, vec_id=key, vector=vector, label=label)
    bad = F.col("label").isNull() | F.col("vector").isNull() | (F.size("vector") == 0) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    rows = rows.select("vec_id", "vector", "label", F.coalesce(bad, F.lit(True)).alias("bad"))
    rows = rows.withColumn("h", F.xxhash64("label", "vector")).withColumn("g", F.xxhash64(F.lit("second"), "vector", "label"))
    good = rows.where(~F.col("bad"))
    classes = good.groupBy("h", "g").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("m"), F.xxhash64(F.first("label"), F.size(F.first("vector"))).alias("grp"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    found = found_pairs(classes, cosine, window, miss)
    roots = cut(components(found, "u", "v").select(F.col("vertex").alias("class"), F.col("component").alias("root")), "roots")
    linked = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    sizes = linked.groupBy("root").agg(F.count(F.lit(1)).alias("k")).where("k > 1").withColumn("blocks", F.ceil(F.col("k") / BLOCK_ROWS).cast("int"))
    inside = linked.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # Each row meets every block of its component once: as the left side for blocks after its own, else as the right one.
    spread = inside.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "class", "m", "vector")
    counts = spread.groupBy("root", "p", "q").applyInArrow(lambda t: block_links(cosine)(t), "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    table = linked.join(counts, "class", "left").select("h", "g", "root", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"))
    joined = cut(rows.select("vec_id", "h", "g", "bad").join(table, ["h", "g"], "left"), "linked")
    least = joined.where(~F.col("bad")).groupBy("root").agg(F.min("vec_id").alias("low"))
    out = joined.join(least, "root", "left")
    component = F.when(F.col("bad"), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.when(F.col("bad"), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
