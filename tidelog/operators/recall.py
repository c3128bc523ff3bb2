"""Reads: ordered recall, counts, groupings, walks and merges of several filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import EventQuery
from .matching import matches
from .predicates import matching
from .ranking import scored

COLUMNS = ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")
RANKED = ("rank_desc", "rank_asc", "sort_followers", "text", "search")


def newest() -> list[Column]:
    """The one order: newest first, ties by id."""
    return [F.desc("created_at"), F.asc("id")]


def rows(events: DataFrame, q: EventQuery) -> DataFrame:
    """All rows that the filter matches, without order, limit or trust."""
    out = matching(events, q)
    if not q.searching and not q.not_search:
        return out
    # The row number keeps the long expression above what derives its columns: no scan can use it, and copied into those
    # derivations it would be computed many times over.
    numbered = out.withColumn("_row", F.monotonically_increasing_id())
    return numbered.where(matches(q.search, q.phrases, q.not_search) & (F.col("_row") >= 0)).drop("_row")


def recall(events: DataFrame, q: EventQuery, reputation: DataFrame | None = None) -> DataFrame:
    """Matched rows with score (null when unranked) and tier, in serving order, at most q.limit."""
    found = rows(events, q)
    if q.profile() == "recency" and q.min_rank is None:
        out, order = found.withColumns({"score": F.lit(None).cast("double"), "tier": F.lit(None).cast("string")}), newest()
    else:
        out = scored(found, events, q, reputation)
        order = newest() if q.profile() in ("recency", "recency_gated") else [F.desc("score"), *newest()]
    out = out.orderBy(*order)
    return out.limit(max(q.limit, 0)) if q.limit is not None else out


def query(events: DataFrame, filters: Sequence[EventQuery], reputation: DataFrame | None = None) -> DataFrame:
    """Several filters as one feed, each with its own limit before the merge.

    None ranked: distinct ids by time. All ranked by one profile: the best copy of each id by score. Mixed: the filters'
    runs one after another, the first copy of each id.
    """
    if len(filters) == 1:
        return recall(events, filters[0], reputation)
    keep = [*COLUMNS, "score", "tier"]
    parts = [recall(events, q, reputation).select(*keep) for q in filters]
    profiles = {q.profile() for q in filters}
    if not profiles & set(RANKED):
        return reduce(DataFrame.unionByName, parts).dropDuplicates(["id"]).orderBy(*newest())
    if len(profiles) == 1:
        best = Window.partitionBy("id").orderBy(F.desc("score"))
        return reduce(DataFrame.unionByName, parts).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").orderBy(F.desc("score"), *newest())
    numbered = []
    for i, (q, p) in enumerate(zip(filters, parts, strict=True)):
        rank = F.col("score") if q.profile() in RANKED else F.col("created_at").cast("double")
        numbered.append(p.withColumns({"_i": F.lit(i), "_key": rank}))
    first = Window.partitionBy("id").orderBy("_i")
    merged = reduce(DataFrame.unionByName, numbered).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return merged.orderBy("_i", F.desc("_key"), *newest()).drop("_i", "_key", "_n")


def count(events: DataFrame, filters: Sequence[EventQuery], reputation: DataFrame | None = None) -> DataFrame:
    """One row with n: the size of the feed that query() would serve; one plain filter needs no order."""
    if len(filters) == 1 and filters[0].profile() == "recency" and filters[0].min_rank is None:
        q = filters[0]
        n = rows(events, q).agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.least("n", F.lit(q.limit)).alias("n")) if q.limit is not None and q.limit > 0 else n
    return query(events, filters, reputation).select("id").distinct().agg(F.count(F.lit(1)).alias("n"))


def count_by_author(events: DataFrame, q: EventQuery) -> DataFrame:
    """pubkey, n over all matches; a limit never bounds a grouping, but a limit of 0 and less matches nothing."""
    return rows(events, q).groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"))


def count_by_kind(events: DataFrame, q: EventQuery) -> DataFrame:
    return rows(events, q).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def authors(events: DataFrame, q: EventQuery) -> DataFrame:
    return rows(events, q).select("pubkey").distinct()


def existing_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids (column id) that are stored, expired or not."""
    return ids.select("id").distinct().join(events.select("id"), "id", "left_semi")


def ids(events: DataFrame, q: EventQuery, with_d: bool = False) -> DataFrame:
    return rows(events, q).select("id", "created_at", *(["d"] if with_d else []))


def tag_rows(events: DataFrame, q: EventQuery) -> DataFrame:
    return rows(events, q).select("id", "tags")


def raw(events: DataFrame, q: EventQuery, reputation: DataFrame | None = None) -> DataFrame:
    """The feed with tags as JSON text."""
    return recall(events, q, reputation).select(*COLUMNS).withColumn("tags", F.to_json("tags"))


def page(events: DataFrame, q: EventQuery, size: int, after: str | None = None) -> DataFrame:
    """The next `size` rows in order of id; `after` is the last id of the page before."""
    found = rows(events, q)
    return (found.where(F.col("id") > after) if after is not None else found).orderBy("id").limit(size)


def distinct_tag_values(events: DataFrame, q: EventQuery, name: str, index: int = 1, where=None) -> DataFrame:
    """Distinct non-empty tag[index] of tags with that name (of any length); where: a function of the tag array Column."""
    t = rows(events, q).select(F.explode("tags").alias("t")).where(F.col("t")[0] == name)
    if where is not None:
        t = t.where(where(F.col("t")))
    return t.select(F.get("t", F.lit(index)).alias("value")).where("value is not null and value != ''").distinct()


def snapshot(events: DataFrame, filters: Sequence[EventQuery], max_entries: int | None = None, reputation: DataFrame | None = None) -> DataFrame:
    """Distinct (created_at, id) of all filters, all of them or max_entries + 1 at most; only searching or limited filters pass the gate."""
    parts = []
    for q in filters:
        walked = rows(events, q) if not q.searching and q.limit is None else recall(events, q, reputation)
        parts.append(walked.select("created_at", "id"))
    found = reduce(DataFrame.union, parts).distinct()
    return found if max_entries is None else found.limit(max_entries + 1)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change: what a rewrite removed and added."""
    gone = before.select("id").join(after.select("id"), "id", "left_anti").withColumn("change", F.lit("removed"))
    new = after.select("id").join(before.select("id"), "id", "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)
