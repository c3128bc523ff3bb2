"""Derived columns of an event, as JVM-side expressions over the seven stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GIFT_WRAP, NEVER


def _values(name: str) -> Column:
    """Second elements of the tags of that name that have one, in order."""
    return F.transform(F.filter("tags", lambda t: (F.size(t) >= 2) & (t[0] == name)), lambda t: t[1])


def first_value(name: str) -> Column:
    return F.get(_values(name), F.lit(0))


def tag_index() -> Column:
    """`letter:value` of each tag with a one-letter name and a value."""
    return F.transform(F.filter("tags", lambda t: (F.size(t) >= 2) & t[0].rlike("^[A-Za-z]$")), lambda t: F.concat(t[0], F.lit(":"), t[1]))


def expires_at() -> Column:
    """The first expiration tag that holds a number decides; none: never."""
    good = F.filter(_values("expiration"), lambda v: v.try_cast("long").isNotNull() & v.rlike(r"^[+-]?[0-9]+$"))
    return F.coalesce(F.get(good, F.lit(0)).try_cast("long"), F.lit(NEVER))


def d_tag() -> Column:
    return F.coalesce(first_value("d"), F.lit(""))


def is_replaceable() -> Column:
    k = F.col("kind")
    return k.isin(0, 3) | ((k >= 10_000) & (k < 20_000))


def is_addressable() -> Column:
    k = F.col("kind")
    return (k >= 30_000) & (k < 40_000)


def is_ephemeral() -> Column:
    k = F.col("kind")
    return (k >= 20_000) & (k < 30_000)


def address() -> Column:
    """`kind:pubkey:` of a replaceable event, `kind:pubkey:d` of an addressable one, else null."""
    head = F.concat(F.col("kind").cast("string"), F.lit(":"), F.col("pubkey"), F.lit(":"))
    return F.when(is_replaceable(), head).when(is_addressable(), F.concat(head, d_tag()))


def owner() -> Column:
    """Who may delete the event: a gift wrap's recipient, else the author."""
    return F.when(F.col("kind") == GIFT_WRAP, F.coalesce(first_value("p"), F.col("pubkey"))).otherwise(F.col("pubkey"))


#: Code points that no text may hold: C0 but for TAB, LF and CR; U+FDD0 to U+FDDF; the last two of each plane.
UNSTORABLE = "".join(map(chr, [*range(9), 11, 12, *range(14, 32), *range(0xFDD0, 0xFDE0), *(p * 0x10000 + x for p in range(17) for x in (0xFFFE, 0xFFFF))]))


def without_unstorable(c: Column) -> Column:
    return F.translate(c, UNSTORABLE, "")


def storable() -> Column:
    """Content and tags are kept verbatim, so one code point that cannot be stored refuses the event."""
    text = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.array_join(F.flatten(F.coalesce("tags", F.array().cast("array<array<string>>"))), " "))
    return without_unstorable(text) == text


def sanitize(c: Column) -> Column:
    """Derived search text loses such code points instead; empty is null."""
    return F.nullif(F.trim(without_unstorable(c)), F.lit(""))


def derive(events: DataFrame) -> DataFrame:
    """events with tag_index, d, address, owner and expires_at; sig is never null."""
    return events.withColumns({"sig": F.coalesce("sig", F.lit("")), "tag_index": tag_index(), "d": d_tag(), "address": address(), "owner": owner(), "expires_at": expires_at()})


def search_columns(events: DataFrame) -> DataFrame:
    """events with the ten search columns.

    Profiles (kind 0) read their JSON content. Other kinds fill tiers: title-like tags are primary; summaries and
    hashtags (as one line) secondary; content is text; locations and geohash names are joined by spaces; r tags of
    bookmarks are websites. Application handlers (kind 31990) hold a profile's JSON, whose names are primary and whose
    description is secondary. Empty and absent are both null.
    """
    content = F.from_json("content", "name string, display_name string, about string, nip05 string, lud16 string, website string")
    profile, handler = F.col("kind") == 0, F.col("kind") == 31_990
    lines = lambda *names: F.array_join(F.array_compact(F.flatten(F.array(*[F.transform(_values(n), sanitize) for n in names]))), "\n")
    hashtags = sanitize(F.array_join(_values("t"), " "))
    textual = ~profile & ~F.col("kind").isin(5, 6, 7, 62, 1059, 10_002)
    tiered = lambda c: F.when(textual, sanitize(c))
    return events.withColumns(
        {f: F.when(profile, sanitize(content[f])) for f in ("name", "display_name", "about", "nip05", "lud16")}
        | {
            "website": F.when(profile, sanitize(content["website"])).otherwise(tiered(F.when(F.col("kind") == 39_701, lines("r")).when(handler, content["website"]))),
            "search_primary": tiered(F.concat_ws("\n", *[F.when(handler, sanitize(content[c])) for c in ("name", "display_name")], sanitize(lines("title", "name", "subject")))),
            "search_secondary": tiered(F.concat_ws("\n", F.when(handler, sanitize(content["about"])), sanitize(lines("summary", "alt")), hashtags)),
            "search_text": tiered(F.when(~handler, F.col("content"))),
            "search_location": tiered(F.array_join(_values("location"), " ")),
        }
    )
