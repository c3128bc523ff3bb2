"""The write rules on batches: admission, supersession, tombstones, vanish requests, expiry, deletes.

Every rule that looks at other events is scoped to one owner. A batch without deletions is decided by joins and windows
only; a batch with them is replayed in order of arrival inside each owner.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import derive, is_ephemeral, storable
from ..plans.query import EventQuery
from ..schema import DELETION, VANISH
from .recall import rows

#: Reasons of rejection.
EXPIRED, DUPLICATE, DELETED, VANISHED, REPLACED, UNSTORABLE = "expired", "duplicate", "deleted", "vanished", "replaced", "unstorable text"
#: Of an event whose write failed for other reasons; insert() raises then and has stored nothing.
INSERT_FAILED = "insert failed"


def latest(events: DataFrame) -> DataFrame:
    """Current versions: of each address the newest, ties by the lowest id; events without an address all stay."""
    best = Window.partitionBy("address").orderBy(F.desc("created_at"), F.asc("id"))
    versions = events.where("address is not null").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return versions.unionByName(events.where("address is null"))


def tombstones(events: DataFrame) -> DataFrame:
    """owner, target, until: for each id or address named by deletions, the newest deletion of that owner."""
    names = events.where(F.col("kind") == DELETION).select(F.col("pubkey").alias("owner"), "created_at", F.explode("tags").alias("t")).where("t[0] in ('e', 'a') and size(t) >= 2")
    return names.groupBy("owner", F.col("t")[1].alias("target")).agg(F.max("created_at").alias("until"))


def covers(relay: str | None):
    """Does a vanish request's relay tag list name all relays or this one?"""
    return F.exists("tags", lambda t: (F.size(t) >= 2) & (t[0] == "relay") & ((t[1] == "ALL_RELAYS") | (t[1] == F.lit(relay))))


def vanishes(events: DataFrame, relay: str | None = None) -> DataFrame:
    """owner, until: the newest vanish request of each author that covers the relay."""
    return events.where((F.col("kind") == VANISH) & F.coalesce(covers(relay), F.lit(False))).groupBy(F.col("pubkey").alias("owner")).agg(F.max("created_at").alias("until"))


def blocked(batch: DataFrame, stored: DataFrame, relay: str | None = None) -> DataFrame:
    """batch (derived) with `blocked`: deleted, vanished or null. Kinds 5 and 62 are immune to deletions, not to vanish requests.

    Tombstones and requests are aggregated before the joins, which are equi-joins on (owner, target) and owner.
    """
    t, v = tombstones(stored), vanishes(stored, relay)
    by_id = t.select(F.col("owner").alias("_o1"), F.col("target").alias("_t1"), F.col("until").alias("_u1"))
    by_address = t.select(F.col("owner").alias("_o2"), F.col("target").alias("_t2"), F.col("until").alias("_u2"))
    by_owner = v.select(F.col("owner").alias("_o3"), F.col("until").alias("_u3"))
    out = batch.join(by_id, (F.col("owner") == F.col("_o1")) & (F.col("id") == F.col("_t1")), "left")
    out = out.join(by_address, (F.col("owner") == F.col("_o2")) & (F.col("address") == F.col("_t2")), "left").join(by_owner, F.col("owner") == F.col("_o3"), "left")
    deleted = F.coalesce(F.col("_u1") >= F.col("created_at"), F.lit(False)) | F.coalesce(F.col("_u2") >= F.col("created_at"), F.lit(False))
    why = F.when(~F.col("kind").isin(DELETION, VANISH) & deleted, DELETED).when(F.col("_u3") >= F.col("created_at"), VANISHED)
    return out.withColumn("blocked", why).drop(*[f"_{x}{i}" for i in (1, 2, 3) for x in "otu"])


def admit_records(batch: DataFrame, stored: DataFrame, now: int, relay: str | None = None) -> DataFrame:
    """batch (derived, with its arrival number `seq`) with `reason`: why a row is refused, null where it is accepted.

    For batches without kinds 5 and 62. Checks in order: ephemeral (accepted, never stored), expired, repeated in the
    batch, unstorable, stored already, deleted, vanished, and replaced: an earlier accepted or stored version of its
    address wins (newest, then lowest id). The running winner is a window over the arrival order.
    """
    expired = F.col("expires_at") <= now
    eligible = ~is_ephemeral() & ~expired
    out = batch.withColumn("_twin", F.when(eligible, F.row_number().over(Window.partitionBy("id", eligible).orderBy("seq"))))
    out = out.join(stored.select(F.col("id").alias("_sid"), F.lit(True).alias("_held")), F.col("id") == F.col("_sid"), "left").drop("_sid")
    out = blocked(out, stored, relay)
    early = F.when(is_ephemeral(), F.lit("")).when(expired, EXPIRED).when(F.col("_twin") > 1, DUPLICATE).when(~storable(), UNSTORABLE).when(F.col("_held"), DUPLICATE).when(F.col("blocked").isNotNull(), F.col("blocked"))
    out = out.withColumn("_early", early).drop("_twin", "_held", "blocked")
    rank = F.struct((-F.col("created_at")).alias("t"), F.col("id").alias("id"))
    before = stored.where("address is not null").groupBy(F.col("address").alias("_a")).agg(F.min(rank).alias("_stored"))
    live = F.when(F.col("_early").isNull() & F.col("address").isNotNull(), rank)
    running = Window.partitionBy("address").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    versions = out.where("address is not null").withColumn("_best", F.min(live).over(running)).join(before, F.col("address") == F.col("_a"), "left").drop("_a")
    versions = versions.withColumn("reason", F.coalesce("_early", F.when(F.coalesce(F.col("_best") < rank, F.lit(False)) | F.coalesce(F.col("_stored") < rank, F.lit(False)), REPLACED)))
    others = out.where("address is null").withColumn("reason", F.col("_early"))
    done = versions.drop("_best", "_stored").unionByName(others).drop("_early")
    return done.withColumn("reason", F.when(F.col("reason") != "", F.col("reason")))


class Replay:
    """The sequential rules for the events of one owner."""

    def __init__(self, relay: str | None):
        self.relay, self.held, self.versions = relay, {}, {}
        self.tombs: dict[str, int] = {}  # what deletions name, with the newest one's time
        self.vanished = -(1 << 62)

    def _beats(self, a: dict, b: dict) -> bool:
        return (-a["created_at"], a["id"]) < (-b["created_at"], b["id"])

    def _put(self, e: dict) -> None:
        self.held[e["id"]] = e
        if e["address"]:
            self.versions[e["address"]] = e
        if e["kind"] == DELETION:
            for t in e["tags"]:
                if len(t) > 1 and t[0] in ("e", "a"):
                    self.tombs[t[1]] = max(e["created_at"], self.tombs.get(t[1], e["created_at"]))
        if e["kind"] == VANISH and self._covers(e):
            self.vanished = max(self.vanished, e["created_at"])

    def _drop(self, e: dict) -> None:
        del self.held[e["id"]]
        if e["address"] and self.versions.get(e["address"]) is e:
            del self.versions[e["address"]]

    def _covers(self, e: dict) -> bool:
        return any(len(t) > 1 and t[0] == "relay" and t[1] in ("ALL_RELAYS", self.relay) for t in e["tags"])

    def offer(self, e: dict, now: int) -> str | None:
        if 20_000 <= e["kind"] < 30_000:
            return None
        if e["expires_at"] <= now:
            return EXPIRED
        if not e["storable"]:
            return UNSTORABLE
        if e["id"] in self.held:
            return DUPLICATE
        if e["kind"] not in (DELETION, VANISH):
            if any(self.tombs.get(n, e["created_at"] - 1) >= e["created_at"] for n in (e["id"], e["address"]) if n):
                return DELETED
        if self.vanished >= e["created_at"]:
            return VANISHED
        old = self.versions.get(e["address"]) if e["address"] else None
        if old and self._beats(old, e):
            return REPLACED
        if e["kind"] == VANISH and self._covers(e):  # sweeps before it is stored itself
            for v in [v for v in self.held.values() if v["owner"] == e["pubkey"] and v["created_at"] <= e["created_at"]]:
                self._drop(v)
        if old and old["id"] in self.held:
            self._drop(old)
        self._put(e)
        if e["kind"] == DELETION:
            for t in (t for t in e["tags"] if len(t) > 1):
                v = self.held.get(t[1]) if t[0] == "e" else self.versions.get(t[1]) if t[0] == "a" else None
                timely = t[0] == "e" or (v and v["pubkey"] == e["pubkey"] and v["created_at"] <= e["created_at"])
                if v and timely and v["kind"] not in (DELETION, VANISH) and v["owner"] == e["pubkey"]:
                    self._drop(v)
        return None


def admit_mixed(batch: DataFrame, stored: DataFrame, now: int, relay: str | None = None) -> DataFrame:
    """For batches with deletions or vanish requests: id, seq, reason of batch rows, and seq null, reason `gone` for stored
    rows that they erase. Accepted rows that a later one of the batch erases or replaces have `erased`.

    One task holds one owner's events at a time; the rules allow no coarser and need no finer key.
    """
    columns = ["id", "pubkey", "created_at", "kind", "tags", "owner", "address", "expires_at"]
    # No rule looks at other owners' events.
    stored = stored.join(batch.select("owner").distinct(), "owner", "left_semi")
    both = stored.select(*columns, F.lit(True).alias("storable"), F.lit(None).cast("long").alias("seq")).unionByName(batch.select(*columns, storable().alias("storable"), "seq"))

    def replay(g: pd.DataFrame) -> pd.DataFrame:
        r, out = Replay(relay), []
        rows_ = g.to_dict("records")
        for e in rows_:
            e["tags"] = [list(t) for t in e["tags"]] if e["tags"] is not None else []
            e["address"] = e["address"] if isinstance(e["address"], str) else None
        before = [e for e in rows_ if pd.isna(e["seq"])]
        for e in sorted(before, key=lambda e: (e["created_at"], e["id"])):
            r._put(e)
        for e in sorted((e for e in rows_ if not pd.isna(e["seq"])), key=lambda e: e["seq"]):
            out.append({"id": e["id"], "seq": int(e["seq"]), "reason": r.offer(e, now), "kept": e})
        for o in out:
            e = o.pop("kept")
            o["erased"] = o["reason"] is None and r.held.get(e["id"]) is not e and not 20_000 <= e["kind"] < 30_000
        out += [{"id": e["id"], "seq": None, "reason": "gone", "erased": True} for e in before if e["id"] not in r.held]
        return pd.DataFrame(out, columns=["id", "seq", "reason", "erased"]).astype({"seq": "Int64", "reason": object, "erased": bool})

    return both.groupBy("owner").applyInPandas(replay, "id string, seq long, reason string, erased boolean")


def erase_by(events: DataFrame, deletions: DataFrame) -> DataFrame:
    """events (derived) without what the deletions erase: by id at any time, by address up to the deletion's time; only the
    owner's own events, never kinds 5 and 62."""
    names = deletions.where(F.col("kind") == DELETION).select(F.col("pubkey").alias("_by"), F.col("created_at").alias("_at"), F.explode("tags").alias("t")).where("size(t) >= 2")
    by_id = names.where("t[0] = 'e'").select("_by", F.col("t")[1].alias("_id")).distinct()
    by_address = names.where("t[0] = 'a'").groupBy("_by", F.col("t")[1].alias("_ad")).agg(F.max("_at").alias("_until"))
    open_ = ~F.col("kind").isin(DELETION, VANISH)
    left = events.join(by_id, open_ & (F.col("owner") == F.col("_by")) & (F.col("id") == F.col("_id")), "left_anti")
    return left.join(by_address, open_ & (F.col("owner") == F.col("_by")) & (F.col("pubkey") == F.col("_by")) & (F.col("address") == F.col("_ad")) & (F.col("created_at") <= F.col("_until")), "left_anti")


def vanish(events: DataFrame, relay: str | None = None) -> DataFrame:
    """events without what vanish requests among them erase: all of the owner up to the newest request, which stays itself."""
    v = vanishes(events, relay).withColumnRenamed("owner", "_o")
    request = (F.col("kind") == VANISH) & F.coalesce(covers(relay), F.lit(False)) & (F.col("created_at") == F.col("until"))
    return events.join(v, (F.col("owner") == F.col("_o")) & (F.col("created_at") <= F.col("until")) & ~request, "left_anti")


def delete(events: DataFrame, filters: list[EventQuery]) -> DataFrame:
    """events without the matches of any filter (no expiry guard, no trust)."""
    out = events
    for q in filters:
        gone = rows(events, q) if q.limit is None else rows(events, q).orderBy(F.desc("created_at"), "id").limit(max(q.limit, 0))
        out = out.join(gone.select("id"), "id", "left_anti")
    return out


def expire(events: DataFrame, now: int) -> DataFrame:
    """events that have not expired: what expires exactly now is gone."""
    return events.where(F.col("expires_at") > now)


def compact(events: DataFrame, now: int, relay: str | None = None) -> DataFrame:
    """The state that an append-only log of events stands for: derived, deduplicated, unexpired, deletions, vanish requests
    and supersession applied."""
    e = expire(derive(events).dropDuplicates(["id"]).where(~is_ephemeral()), now)
    return latest(vanish(erase_by(e, e), relay))
