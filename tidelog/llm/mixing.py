"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. Word capacity flows from patterns to source quotas; the
k-th copy of a pattern costs more than the one before (convex), so copies are spread evenly before any is repeated. Each
pattern then takes its flow as whole copies of all its documents plus one copy more of seeded documents: in seeded order
those before the first that would exceed its words, and of the others, for what is left, a few of each size. That is the same for patterns of any size. The driver holds one row a source and a pattern (some 200 bytes each).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, local, small, take

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
HASH_BITS = 62
LEVEL_BITS = 8
#: The rows of one size that may fill what is left: the first one for each value of the hash's last bits.
FILL_BITS = 4


def shares(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Targets that share sum(sizes) by weight; none above cap times its size, the excess reshared by weight."""
    left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > cap * sizes[i]]
        for i in over or free:
            out[i] = float(cap * sizes[i]) if over else weights[i] * unit
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def flow(patterns: list[tuple[frozenset, int]], quotas: dict, repeats: int = MAX_REPEATS) -> dict[tuple[int, object], int]:
    """Words that each pattern gives to each source, at least cost, in the network

    start -> pattern (`repeats` parallel arcs of the pattern's size, the k-th costing k) -> its sources -> end (quota).

    Only the first arcs cost anything, so that cheapest paths first means: a maximum flow with the first arcs alone, carried
    on with the second ones, and so on; each is found by blocking flows over layers of shortest paths.
    """
    names = list(quotas)
    number = {s: j for j, s in enumerate(names)}
    outs = [sorted(number[s] for s in members if s in number) for members, _ in patterns]
    into: list[list[int]] = [[] for _ in names]
    given: list[dict[int, int]] = [dict.fromkeys(o, 0) for o in outs]
    for i, o in enumerate(outs):
        for j in o:
            into[j].append(i)
    left, supply = [int(quotas[s]) for s in names], [0] * len(patterns)

    def layers() -> tuple[list[int], list[int], bool]:
        of_pattern, of_source, depth, reached = [-1] * len(patterns), [-1] * len(names), 0, False
        front = [i for i, x in enumerate(supply) if x > 0]
        for i in front:
            of_pattern[i] = 0
        while front and not reached:
            met = []
            for i in front:
                for j in outs[i]:
                    if of_source[j] < 0:
                        of_source[j] = depth + 1
                        met.append(j)
                        reached = reached or left[j] > 0
            depth, front = depth + 2, []
            for j in met if not reached else ():
                for i in into[j]:
                    if of_pattern[i] < 0 and given[i][j] > 0:
                        of_pattern[i] = depth
                        front.append(i)
        return of_pattern, of_source, reached

    for _ in range(repeats):
        for i, (_, size) in enumerate(patterns):
            supply[i] += size
        while True:
            of_pattern, of_source, reached = layers()
            if not reached:
                break
            next_out, next_in = [0] * len(patterns), [0] * len(names)
            for first in [i for i, d in enumerate(of_pattern) if d == 0]:
                path = [first]  # pattern, source, pattern, ...
                while path and supply[first] > 0:
                    x = path[-1]
                    if len(path) % 2:
                        tried, fits = next_out, lambda j, x=x: of_source[j] == of_pattern[x] + 1
                        ways = outs[x]
                    elif left[x] > 0:
                        backs = [(path[k + 1], path[k]) for k in range(1, len(path) - 1, 2)]  # pattern that takes back, source
                        least = min([supply[first], left[x], *(given[i][j] for i, j in backs)])
                        supply[first] -= least
                        left[x] -= least
                        for k in range(0, len(path), 2):
                            given[path[k]][path[k + 1]] += least
                        for i, j in backs:
                            given[i][j] -= least
                        path = [first]
                        continue
                    else:
                        tried, fits = next_in, lambda i, x=x: of_pattern[i] == of_source[x] + 1 and given[i][x] > 0
                        ways = into[x]
                    while tried[x] < len(ways) and not fits(ways[tried[x]]):
                        tried[x] += 1
                    if tried[x] < len(ways):
                        path.append(ways[tried[x]])
                    else:  # a dead end: whoever led here tries its next way
                        path.pop()
                        if path:
                            (next_out if len(path) % 2 else next_in)[path[-1]] += 1
    return {(i, names[j]): n for i, own in enumerate(given) for j, n in own.items() if n}


def _near_table(df: DataFrame, other: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Inner join with a table that has `rows` rows: broadcast up to 10,000 of them, else as Spark plans it."""
    return df.join(F.broadcast(other) if rows <= 10_000 else other, on)


def _descend(rows: DataFrame, at: DataFrame, by: str, n: int) -> DataFrame:
    """at (p, want, n) with low: for each pattern where in the order of column `by` (HASH_BITS bits) its words are reached.

    Radix descent: each level sums sizes for 2**LEVEL_BITS parts of the range and enters the part in which the wanted words
    are reached, until it holds one row, or rows with equal values only; each is an aggregation over the rows in the range.
    want becomes what the rows before `low` leave of it, n the number of rows in the last part.
    """
    at, shift = at.withColumn("low", F.lit(0).cast("long")), HASH_BITS
    most = at.agg(F.max("n")).first()[0] or 0
    while most > 1 and shift:
        width, shift = 1 << shift, max(0, shift - LEVEL_BITS)
        inside = _near_table(rows, at.drop("n"), ["p"], n).where((F.col(by) >= F.col("low")) & (F.col(by) < F.col("low") + F.lit(width)))
        counts = inside.groupBy("p", "want", "low", F.shiftright(F.col(by) - F.col("low"), shift).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        hit = counts.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).where((F.col("before") <= F.col("want")) & (F.col("before") + F.col("s") > F.col("want")))
        at = cut(hit.select("p", (F.col("want") - F.col("before")).alias("want"), "n", (F.col("low") + F.col("b") * F.lit(1 << shift)).alias("low")), "mix-level")
        most = at.agg(F.max("n")).first()[0] or 0
    return at


def _edges(rows: DataFrame, want: DataFrame, n: int) -> DataFrame:
    """p, low, low2, gap: each pattern takes its rows before (low, low2) in the order of (h, h2), which leave `gap` words.

    rows: p, size, h (seeded hash of key and text), h2 (of the row number, which only tells rows with equal h apart).
    """
    first = _descend(rows, want, "h", n)
    ties = first.where("n > 1").withColumnRenamed("low", "h")
    if not ties.limit(1).count():
        return first.select("p", "low", F.lit(0).cast("long").alias("low2"), F.col("want").alias("gap"))
    same = cut(_near_table(rows, ties.select("p", "h"), ["p", "h"], n), "mix-ties")
    second = _descend(same, ties.select("p", "want", "n"), "h2", n).select("p", F.col("low").alias("low2"), F.col("want").alias("gap"))
    both = first.join(second, "p", "left")
    return cut(both.select("p", "low", F.coalesce("low2", F.lit(0)).alias("low2"), F.coalesce("gap", "want").alias("gap")), "mix-edges")


def _fill(g: pd.DataFrame) -> pd.DataFrame:
    """From the largest size down, in seeded order, each row that still fits; then the smallest other if that comes nearer."""
    left, taken, over = int(g["gap"].iloc[0]), [], None
    g = g.sort_values(["size", "h", "h2"], ascending=[False, True, True])
    for size, k in zip(g["size"], g["k"], strict=True):
        if size <= left:
            left -= size
            taken.append(k)
        elif over is None or size < over[0]:
            over = (size, k)
    if over and over[0] - left < left:
        taken.append(over[1])
    return pd.DataFrame({"k": taken}, dtype="int64")


def mix(docs: DataFrame, quotas, *, size: Column | None = None, key: str = "doc_id", text: str = "text", sources: str = "source", seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs with copies (int), taken (copies * size), size and p, plus the columns `keep`.

    sources: a column of one source name or an array of them (overlapping sources); null is a source of its own. quotas:
    a function from {source: words} to {source: target words}. size: words, unless a column is given; null text has 0.
    Seeded order: xxhash64 of seed, key and text; equal rows share it and are told apart by a row number, so that ties fall
    anyhow among equal rows only. No row is copied more than MAX_REPEATS times; rows of size 0 are taken once. Whole texts
    are counted, however long. An empty table gives an empty result; other columns are ignored.
    """
    rows = take(docs, id=key, text=text, src=sources, **{f"keep_{i}": c for i, c in enumerate(keep)})
    members = F.array_sort(F.array_distinct(F.transform("src", lambda x: F.struct(x.isNull().alias("n"), x.alias("s"))))) if dict(rows.dtypes)["src"].startswith("array") else F.array(F.struct(F.col("src").isNull().alias("n"), F.col("src").alias("s")))
    words = F.coalesce(size if size is not None else F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = rows.select("id", *[f"keep_{i}" for i in range(len(keep))], members.alias("m"), words.alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "text"), 64 - HASH_BITS).alias("h"))
    rows = rows.withColumn("k", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("h2", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k"), 64 - HASH_BITS)), "mix")
    seen = rows.groupBy("m").agg(F.sum("size").alias("s"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).collect()
    seen = sorted(((tuple((x["n"], x["s"]) for x in r["m"]), int(r["s"]), r["n"]) for r in seen), key=str)
    totals: dict = {}
    for m, s, _ in seen:
        for x in m:
            totals[x] = totals.get(x, 0) + s
    targets = quotas({x[1]: totals[x] for x in sorted(totals, key=lambda x: (x[0], (x[1] or "").encode()))})
    routed = flow([(frozenset(m), s) for m, s, _ in seen], {x: round(targets[x[1]]) for x in totals})
    out: dict[int, int] = {}
    for (i, _), f in routed.items():
        out[i] = out.get(i, 0) + f
    spark, kind = rows.sparkSession, rows.schema["m"].dataType.simpleString()
    plan = [(i, [list(x) for x in m], s, out.get(i, 0) // s if s else 1, out.get(i, 0) % s if s else 0, n) for i, (m, s, n) in enumerate(seen)]
    plan = local(spark, plan, f"p long, m {kind}, s long, base long, want long, n long").drop("s")
    rows = _near_table(rows, plan.drop("n"), ["m"], len(seen))
    want = plan.where("want > 0").select("p", "want", "n")
    sized = rows.select("p", "h", "h2", "size", "k").where("size > 0")
    edge = _edges(sized, want, len(seen))
    taken = (F.col("h") < F.col("low")) | ((F.col("h") == F.col("low")) & (F.col("h2") < F.col("low2")))
    near = _near_table(sized, edge.where("gap > 0"), ["p"], len(seen)).where(~taken & (F.col("size") < 2 * F.col("gap")))
    each = near.groupBy("p", "gap", "size", F.col("h").bitwiseAND((1 << FILL_BITS) - 1)).agg(F.min(F.struct("h", "h2", "k")).alias("r")).select("p", "gap", "size", "r.*")
    chosen = each.groupBy("p").applyInPandas(_fill, "k long").withColumn("one", F.lit(1))
    limits = plan.select("p").join(edge.select("p", "low", "low2"), "p", "left")
    whole = _near_table(rows, limits, ["p"], len(seen)).join(small(cut(chosen, "mix-chosen")), "k", "left")
    more = F.when(F.col("size") > 0, F.coalesce(taken.cast("int"), F.lit(0)) + F.coalesce("one", F.lit(0))).otherwise(0)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.col("base") + more, F.lit(MAX_REPEATS))).cast("int")
    return whole.select("id", "m", "p", "size", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def cycling_quotas(totals: dict) -> dict:
    """Sources in the given order weigh 1, 2, 3, repeating, and share all words."""
    return dict(zip(totals, shares(list(totals.values()), [1 + i % 3 for i in range(len(totals))]), strict=True))


def mix_report(docs: DataFrame) -> DataFrame:
    """The digest for one source a document: doc_id, size, source_size, target, taken; one row for each row of docs."""
    found: dict = {}

    def quotas(totals: dict) -> dict:
        found.update({s: (n, t) for (s, n), t in zip(totals.items(), cycling_quotas(totals).values(), strict=True)})
        return {s: t for s, (_, t) in found.items()}

    out = mix(docs, quotas)
    table = local(docs.sparkSession, [(s, n, float(t)) for s, (n, t) in found.items()], "s string, source_size long, target double")
    joined = out.join(F.broadcast(table) if len(found) <= 10_000 else table, F.col("m")[0]["s"].eqNullSafe(F.col("s")))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
