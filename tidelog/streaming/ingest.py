"""Structured Streaming: events into the store, and newest-per-address as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.derive import address, is_ephemeral
from ..schema import DELETION
from ..store import EventStore


def into_store(stream: DataFrame, store: EventStore, checkpoint: str, refresh_trust: bool = True, **trigger):
    """Every micro-batch is admitted as one batch, in order of (created_at, id). A replayed batch changes nothing: its ids
    are duplicates by then. Ephemeral events pass the sink by. The trust view follows the writes of each batch, or is left
    to store.drain_trust()."""

    def each(batch: DataFrame, number: int) -> None:
        # Written once in order, so that every read of the batch sees the same arrival numbers.
        path = f"{store.path}/arrivals/{number}"
        batch.where(~is_ephemeral()).orderBy("created_at", "id").withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        rows = store.spark.read.parquet(path)
        if rows.limit(1).count():
            store.insert(rows)
        if refresh_trust:
            store.drain_trust()
        store.state._fs.delete(store.state._path(path), True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the current version's time and id (null: none), and the time up to which versions are deleted."""
    if state.hasTimedOut:
        state.remove()
        return
    at, best, until = state.get if state.exists else (None, None, None)
    before = (at, best)
    rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (r.created_at, r.id))
    for r in rows:
        if r.deletes:
            until = max(int(r.created_at), until if until is not None else int(r.created_at))
        elif best is None or (-r.created_at, r.id) < (-at, best):
            at, best = int(r.created_at), r.id
    if best is not None and until is not None and at <= until:
        at = best = None
    state.update((at, best, until))
    if (at, best) != before:
        yield pd.DataFrame([{"address": key[0], "id": best, "created_at": at}]).astype({"created_at": "Int64"})


def newest_versions(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """address, id, created_at: a row whenever an address has a new current version, with null id and time when a deletion
    leaves it none. Late older versions emit nothing, and none that an earlier deletion covers, whichever comes first.

    idle_ms: state of an address without events for so long is dropped; none: it is kept.
    """
    versions = stream.withColumn("address", address()).where("address is not null").select("address", "id", "created_at", F.lit(False).alias("deletes"))
    names = stream.where(F.col("kind") == DELETION).select("id", "pubkey", "created_at", F.explode("tags").alias("t")).where("size(t) >= 2 and t[0] = 'a'")
    deleted = names.where(F.split(F.col("t")[1], ":")[1] == F.col("pubkey")).select(F.col("t")[1].alias("address"), "id", "created_at", F.lit(True).alias("deletes"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key, batches, state):
        yield from _newest(key, batches, state)
        if idle_ms is not None and state.exists:
            state.setTimeoutDuration(idle_ms)

    return versions.union(deleted).groupBy("address").applyInPandasWithState(step, "address string, id string, created_at long", "created_at long, id string, until long", "update", timeout)


def distinct_ids(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream without repeated ids inside the watermark on event time."""
    timed = stream.withColumn("at", F.timestamp_seconds("created_at"))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])
