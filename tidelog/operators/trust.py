"""The trust view: score cards and provider lists folded into (subject, observer, influence, followers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import first_value
from ..schema import CARD, PROVIDERS

DIMENSIONS = {f"{CARD}:rank": "rank", f"{CARD}:followers": "followers"}


def providers(events: DataFrame, now: int | None = None) -> DataFrame:
    """service, observer, dim: which services an observer's provider list (kind 10040) names for which dimension."""
    lists = events.where(F.col("kind") == PROVIDERS)
    if now is not None:
        lists = lists.where(F.col("expires_at") > now)
    t = lists.select(F.col("pubkey").alias("observer"), F.explode("tags").alias("t")).where(F.col("t")[0].isin(*DIMENSIONS) & (F.size("t") >= 2))
    return t.select(F.col("t")[1].alias("service"), "observer", F.substring_index(F.col("t")[0], ":", -1).alias("dim")).distinct()


def cards(events: DataFrame, now: int | None = None) -> DataFrame:
    """service, subject, dim, value, created_at, id: the scores that unexpired cards (kind 30382) hold; rank is clamped to
    0..100, followers to 0 and more; tags without a number are no score."""
    c = events.where(F.col("kind") == CARD)
    if now is not None:
        c = c.where(F.col("expires_at") > now)
    c = c.select(F.col("pubkey").alias("service"), F.lower(first_value("d")).alias("subject"), "created_at", "id", first_value("rank").alias("rank"), first_value("followers").alias("followers"))
    c = c.where(F.col("subject").rlike("^[0-9a-f]{64}$"))
    rank = F.least(F.greatest(F.col("rank").try_cast("int"), F.lit(0)), F.lit(100)).cast("double")
    followers = F.greatest(F.col("followers").try_cast("double"), F.lit(0.0))
    long = c.select("service", "subject", "created_at", "id", F.explode(F.array(F.struct(F.lit("rank").alias("dim"), F.when(F.col("rank").isNotNull(), rank).alias("value")), F.struct(F.lit("followers").alias("dim"), F.when(F.col("followers").isNotNull(), followers).alias("value")))).alias("x"))
    return long.select("service", "subject", "x.dim", "x.value", "created_at", "id").where("value is not null")


def reputation(events: DataFrame, now: int | None = None) -> DataFrame:
    """subject, observer, influence, followers: of all cards by services that the observer names, the newest of each
    dimension wins, ties by the lowest id. A missing side is null; subjects without any have no row."""
    named = cards(events, now).join(providers(events, now), ["service", "dim"])
    best = Window.partitionBy("subject", "observer", "dim").orderBy(F.desc("created_at"), F.asc("id"))
    won = named.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return won.groupBy("subject", "observer").agg(F.max(F.when(F.col("dim") == "rank", F.col("value"))).cast("int").alias("influence"), F.max(F.when(F.col("dim") == "followers", F.col("value"))).cast("float").alias("followers"))


def update_cells(view: DataFrame, updates: DataFrame) -> DataFrame:
    """view with updates (subject, observer, influence, followers, seq) in order of seq; a null side stays as it was."""
    base = view.select("subject", "observer", "influence", "followers", F.lit(-1).cast("long").alias("seq"))
    both = base.unionByName(updates.select("subject", "observer", "influence", "followers", F.col("seq").cast("long")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return both.groupBy("subject", "observer").agg(last("influence"), last("followers"))


def refresh(view: DataFrame, events: DataFrame, subjects: DataFrame, now: int | None = None) -> DataFrame:
    """view with the touched subjects (column subject) derived anew and all others as they were."""
    touched = subjects.select("subject").distinct()
    fresh = reputation(events.join(touched, (F.col("kind") != CARD) | (F.lower(first_value("d")) == F.col("subject")), "left_semi"), now).join(touched, "subject", "left_semi")
    return view.join(touched, "subject", "left_anti").unionByName(fresh)


def touched_subjects(changed: DataFrame, events: DataFrame) -> DataFrame:
    """Subjects that changed rows touch: those of changed cards, and all of services that changed provider lists name."""
    direct = changed.where(F.col("kind") == CARD).select(F.lower(first_value("d")).alias("subject"))
    services = providers(changed).select("service").distinct()
    through = cards(events).join(services, "service", "left_semi").select("subject")
    return direct.union(through).where(F.col("subject").rlike("^[0-9a-f]{64}$")).distinct()


def verify(view: DataFrame, events: DataFrame, now: int | None = None) -> DataFrame:
    """subject, observer, problem for each difference between the stored view and a fresh one: missing, extra, different."""
    a = reputation(events, now).select("subject", "observer", F.struct("influence", F.col("followers").cast("float").alias("followers")).alias("want"))
    b = view.select("subject", "observer", F.struct("influence", F.col("followers").cast("float").alias("followers")).alias("have"))
    both = a.join(b, ["subject", "observer"], "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("have")), "different")
    return both.select("subject", "observer", problem.alias("problem")).where("problem is not null")


def reconcile(view: DataFrame, events: DataFrame, now: int | None = None) -> DataFrame:
    """view with the subjects that verify() finds derived anew."""
    return refresh(view, events, verify(view, events, now).select("subject"), now)


def orphan_cards(events: DataFrame, now: int | None = None) -> DataFrame:
    """Cards of services that no readable provider list names; refused (empty) where no list is readable at all."""
    p = providers(events, now).select(F.col("service").alias("_s")).distinct()
    if not p.limit(1).count():
        return events.limit(0)
    return events.where(F.col("kind") == CARD).join(p, F.col("pubkey") == F.col("_s"), "left_anti")
