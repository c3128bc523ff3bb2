"""EventQuery -> one boolean Column that Catalyst can push down where Parquet can use it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import CONTROL, EventQuery, hex_list

#: Longer id lists become a join instead of an IN set.
IN_LIST = 10_000


def conjunction(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def scalar_predicates(q: EventQuery) -> list[Column]:
    """Everything but text, trust and long id lists."""
    out: list[Column] = []
    for name, values in (("id", q.ids), ("pubkey", q.authors), ("owner", q.owners)):
        if values is not None and len(values) <= IN_LIST:
            out.append(F.col(name).isin(hex_list(values)))
    if q.kinds is not None:
        out.append(F.col("kind").isin(list(q.kinds)))
    for name, values in q.tags.items():  # any value of a name, all names
        wanted = [f"{name}:{v}" for v in values if not CONTROL.search(v)]
        out.append(F.arrays_overlap("tag_index", F.array(*map(F.lit, wanted))))
    for name, values in q.tags_all.items():  # every value
        out += [F.array_contains("tag_index", f"{name}:{v}") for v in dict.fromkeys(values)]
    for column, low in (("created_at", q.since),):
        if low is not None:
            out.append(F.col(column) >= low)
    if q.until is not None:
        out.append(F.col("created_at") <= q.until)
    if q.expires_before is not None:
        out.append(F.col("expires_at") < q.expires_before)
    if q.not_expired_at is not None:
        out.append(F.col("expires_at") > q.not_expired_at)
    return out


def matching(events: DataFrame, q: EventQuery) -> DataFrame:
    """Rows of derived events that the scalar part of q matches; long id lists join as a table of their own."""
    if q.empty():
        return events.limit(0)
    out = events.where(conjunction(scalar_predicates(q)))
    for name, values in (("id", q.ids), ("pubkey", q.authors), ("owner", q.owners)):
        if values is not None and len(values) > IN_LIST:
            wanted = events.sparkSession.createDataFrame([(v,) for v in hex_list(values)], f"{name} string")
            out = out.join(wanted, name, "left_semi")
    return out
