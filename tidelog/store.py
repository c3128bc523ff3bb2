"""The store: queries, counts, writes and the trust view over one folder.

Everything that a query reads is derived when a row is written: tag index, address, owner, expiry, search columns, their
folded words and near columns. So filters on them reach the Parquet scan, and no search runs Python.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.derive import derive, search_columns
from .functions.text import index_text
from .operators import recall, trust, writes
from .plans import grammar
from .plans.query import EventQuery, hex_list
from .schema import CARD, DELETION, EVENT, PROVIDERS, REPUTATION, VANISH
from .sources.segments import Segments
from .sources.versions import Versions


def indexed(events: DataFrame) -> DataFrame:
    """Events with every column that the store keeps."""
    return index_text(search_columns(derive(events)))


class EventStore:
    """Current state only. `clock` gives the seconds that expiry is measured by; `buckets` is fixed with the first write.

    Buckets hold whole owners, and every rule of writing looks at one owner only, so a batch reads and writes the buckets
    of its owners; ids alone are looked up in all of them.
    """

    def __init__(self, spark: SparkSession, path: str, relay: str | None = None, clock=lambda: int(time.time()), buckets: int = 64):
        self.spark, self.path, self.relay, self.clock = spark, path.rstrip("/"), relay, clock
        self.state = Segments(spark, f"{path}/events", indexed(spark.createDataFrame([], EVENT)).schema, buckets)
        self.view = Versions(spark, f"{path}/reputation", REPUTATION)

    def events(self, owners: Sequence[str] | None = None) -> DataFrame:
        """All rows with all columns; owners: those of the buckets that hold these owners."""
        return self.state.read(None if owners is None else self.state.bucket_numbers(owners)).drop("bucket")

    def _plan(self, filters, search, observer) -> list[EventQuery]:
        """One cutoff for all filters of a request."""
        now = self.clock()
        filters = [filters] if isinstance(filters, EventQuery) else list(filters)
        return [grammar.apply(q, search, observer=observer, now=now) for q in filters]

    def _rows(self, plan: Sequence[EventQuery]) -> DataFrame:
        """The rows that the filters can match; statistics of a ranking need all of them."""
        ranked = any(q.searching or q.ranking for q in plan)
        owners = None if ranked or any(q.owners is None for q in plan) else sorted({o for q in plan for o in hex_list(q.owners)})
        return self.events(owners)

    def query(self, filters, search: str | None = None, observer: str | None = None) -> DataFrame:
        plan = self._plan(filters, search, observer)
        return recall.query(self._rows(plan), plan, self.view.read())

    def raw_query(self, filters, search: str | None = None, observer: str | None = None) -> DataFrame:
        return self.query(filters, search, observer).select(*recall.COLUMNS).withColumn("tags", F.to_json("tags"))

    def scored(self, q: EventQuery, search: str | None = None, observer: str | None = None) -> DataFrame:
        """The best 100 (or q.limit) with score and tier."""
        plan = self._plan(q, search, observer)[0]
        return recall.recall(self._rows([plan]), plan, self.view.read()).limit(q.limit or 100)

    def get(self, event_id: str) -> Row | None:
        """The stored event of that id, expired or not."""
        return self.events().where(F.col("id") == event_id.lower()).select(*EVENT.names).first()

    def count(self, filters, search: str | None = None, observer: str | None = None) -> int:
        plan = self._plan(filters, search, observer)
        return recall.count(self._rows(plan), plan, self.view.read()).first()["n"]

    def count_by_author(self, q: EventQuery) -> DataFrame:
        return recall.count_by_author(self.events(), q)

    def existing_ids(self, ids: DataFrame) -> DataFrame:
        return recall.existing_ids(self.events(), ids)

    def snapshot_ids(self, filters, max_entries: int, search: str | None = None, observer: str | None = None, progress=None) -> DataFrame:
        """progress: called with the number of distinct pairs found, max_entries + 1 at most."""
        plan = self._plan(filters, search, observer)
        out = recall.snapshot(self._rows(plan), plan, max_entries, self.view.read())
        if progress is not None:
            progress(out.count())
        return out

    def distinct_tag_values(self, q: EventQuery, name: str, index: int = 1, where=None) -> DataFrame:
        return recall.distinct_tag_values(self.events(), self._plan(q, None, None)[0], name, index, where)

    def _near(self, batch: DataFrame) -> DataFrame:
        """Stored rows that the rules can ask for: the buckets of the batch's owners, and its ids wherever they are."""
        here = [r[0] for r in batch.select(self.state.bucket_of(F.col("owner"))).distinct().collect()]  # one number a bucket
        own = self.state.read(here)
        there = sorted({b for _, b in self.state.manifest()["rows"]} - set(here))
        if not there:
            return own
        return own.unionByName(self.state.read(there).join(batch.select("id").distinct(), "id", "left_semi"))

    def _kept(self, out: DataFrame) -> DataFrame:
        """Outcomes as a table of their own, which later writes leave alone."""
        path = f"{self.path}/outcomes/{uuid.uuid4().hex}"
        out.write.parquet(path)
        return self.spark.read.schema(out.schema).parquet(path)

    def insert(self, batch: DataFrame) -> DataFrame:
        """Outcomes (id, seq, reason) of a batch with columns of EVENT and the arrival number seq; null reason: accepted."""
        rows, now = derive(batch), self.clock()
        stored = self._near(rows)
        lasting = ~F.col("kind").between(20_000, 29_999)
        where = stored.select("id", "bucket")
        if batch.where(F.col("kind").isin(DELETION, VANISH)).limit(1).count():
            out = self._kept(writes.admit_mixed(rows, stored, now, self.relay))
            gone = out.where("seq is null").select("id").join(where, "id")
            new = rows.join(out.where("seq is not null and reason is null and not erased").select("seq"), "seq", "left_semi").where(lasting)
        else:
            judged = writes.admit_records(rows, stored, now, self.relay)
            out = self._kept(judged.select("id", "seq", "reason"))
            new = rows.join(out.where("reason is null").select("seq"), "seq", "left_semi").where(lasting)
            # Of the accepted versions of an address only the last one stays, and none that was stored before.
            newest = new.where("address is not null")
            gone = stored.where("address is not null").join(newest.select("address").distinct(), "address", "left_semi").select("id", "bucket")
            new = writes.latest(new)
        self._change(new, gone)
        return out.where("seq is not null").select("id", "seq", "reason")

    def put_if_newer(self, event: dict) -> bool:
        """Insert one event (a dict of EVENT's columns); whether it was accepted."""
        row = self.spark.createDataFrame([tuple(event.get(c) for c in EVENT.names)], EVENT).withColumn("seq", F.lit(0).cast("long"))
        return self.insert(row).first()["reason"] is None

    def transaction(self, batch: DataFrame) -> DataFrame:
        """Insert in order up to the first rejection; later rows are neither stored nor judged."""
        rows = derive(batch)
        trial = self._kept(writes.admit_mixed(rows, self._near(rows), self.clock(), self.relay).where("seq is not null and reason is not null"))
        stop = trial.agg(F.min("seq").alias("s")).first()["s"]
        done = batch if stop is None else batch.where(F.col("seq") < stop)
        out = self.insert(done)
        return out if stop is None else out.unionByName(trial.where(F.col("seq") == stop).select("id", "seq", "reason"))

    def _change(self, new: DataFrame | None, gone: DataFrame) -> None:
        """Adds events, takes away stored ids (id, bucket), and first notes what that means for the trust view."""
        gone = self._kept(gone) if gone.limit(1).count() else None
        new = new if new is not None and new.limit(1).count() else None
        if new is None and gone is None:
            return
        dirt = [] if new is None else [new.select(*EVENT.names)]
        if gone is not None:
            here = [r[0] for r in gone.select("bucket").distinct().collect()]  # one number a bucket
            dirt.append(self.state.read(here).join(gone.select("id"), "id", "left_semi").select(*EVENT.names))
        trusted = reduce(DataFrame.unionByName, dirt).where(F.col("kind").isin(CARD, PROVIDERS))
        if trusted.limit(1).count():
            trusted.write.parquet(f"{self.path}/dirt/{uuid.uuid4().hex}")
        self.state.change(indexed(new.select(*EVENT.names)) if new is not None else None, gone)

    def _take(self, gone: DataFrame) -> None:
        self._change(None, gone)

    def delete(self, filters) -> None:
        filters = [filters] if isinstance(filters, EventQuery) else list(filters)
        stored = self.state.read()
        left = writes.delete(stored, filters).select(F.col("id").alias("_i"))
        self._take(stored.join(left, F.col("id") == F.col("_i"), "left_anti").select("id", "bucket"))

    def expire(self) -> None:
        self._take(self.state.read().where(F.col("expires_at") <= self.clock()).select("id", "bucket"))

    def reindex(self, start: int = 0, buckets: int | None = None) -> tuple[int, int | None]:
        """Derives the kept columns of some buckets anew, from number `start` on, and rewrites those that have drifted.

        How many rows had drifted, and the number to go on from (null: done).
        """
        stop = min(self.state.buckets, start + (buckets or self.state.buckets))
        own = range(start, stop)
        stored = self.state.read(own)
        names = [n for n in self.state.schema.names if n not in EVENT.names]
        fresh = indexed(stored.select(*EVENT.names, "bucket"))
        both = stored.select("id", "bucket", F.to_json(F.struct(*names)).alias("a")).join(fresh.select("id", F.to_json(F.struct(*names)).alias("b")), "id")
        drifted = [(r["bucket"], r["n"]) for r in both.where("not (a <=> b)").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()]
        if drifted:
            self.state.replace(fresh.where(F.col("bucket").isin([b for b, _ in drifted])), [b for b, _ in drifted])
        return sum(n for _, n in drifted), stop if stop < self.state.buckets else None

    def reputation_of(self, subject: str) -> DataFrame:
        """observer, influence, followers of one author."""
        return self.view.read().where(F.col("subject") == subject.lower()).drop("subject")

    def visit_subjects(self, on_page, size: int = 1_000) -> int:
        """Calls on_page with lists of `size` rated authors at most, in order; how many there are."""
        last, total = "", 0
        while True:
            page = [r["subject"] for r in self.view.read().select("subject").distinct().where(F.col("subject") > last).orderBy("subject").limit(size).collect()]
            if not page:
                return total
            on_page(page)
            last, total = page[-1], total + len(page)

    def refresh_trust(self, changed: DataFrame | None = None) -> DataFrame:
        """The view derived anew: whole, or for the authors only that changed rows (written or erased events) touch."""
        now = self.clock()
        if changed is None or not self.view.numbers():
            return self.view.write(trust.reputation(self.events(), now))
        touched = trust.touched_subjects(changed, self.events())
        return self.view.write(trust.refresh(self.view.read(), self.events(), touched, now))

    rebuild_trust = refresh_trust

    def _dirt(self) -> list[str]:
        root = self.state._path(f"{self.path}/dirt")
        return [str(s.getPath()) for s in self.state._fs.listStatus(root)] if self.state._fs.exists(root) else []

    def pending_trust(self) -> int:
        """Writes that touched cards or provider lists and are not in the view yet."""
        return len(self._dirt())

    def drain_trust(self) -> int:
        """Brings the view up to date with the writes so far; how many there were.

        They were noted before they changed the store and are forgotten after the view is written, so a drain that breaks
        off is done again, with the same result.
        """
        noted = self._dirt()
        if noted:
            self.refresh_trust(self.spark.read.schema(EVENT).parquet(*noted))
            for path in noted:
                self.state._fs.delete(self.state._path(path), True)
        return len(noted)

    def await_trust(self) -> None:
        """Returns when no write is left that the view does not have."""
        while self.drain_trust():
            pass

    def verify_trust(self, repair: bool = False) -> DataFrame:
        found = trust.verify(self.view.read(), self.events(), self.clock())
        if repair:
            self.view.write(trust.reconcile(self.view.read(), self.events(), self.clock()))
        return found

    def sweep_orphan_scores(self, dry_run: bool = True) -> DataFrame:
        orphans = self._kept(trust.orphan_cards(self.state.read(), self.clock()).select("id", "bucket"))
        if not dry_run:
            self._take(orphans)
        return orphans.select("id")


def open_store(spark: SparkSession, path: str, relay: str | None = None, **options) -> EventStore:
    return EventStore(spark, path, relay, **options)
