"""The logical plan of a read: one frozen filter object."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

HEX64 = re.compile(r"[0-9a-f]{64}")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def hex_list(values: Sequence[str]) -> list[str]:
    """Lower-cased valid 64-hex values, distinct, in order."""
    return [v for v in dict.fromkeys(x.lower() for x in values) if HEX64.fullmatch(v)]


@dataclass(frozen=True)
class EventQuery:
    """None means unconstrained; an empty list matches nothing. limit None: all; 0 and less: nothing."""

    ids: Sequence[str] | None = None
    authors: Sequence[str] | None = None
    owners: Sequence[str] | None = None
    kinds: Sequence[int] | None = None
    tags: Mapping[str, Sequence[str]] = field(default_factory=dict)
    tags_all: Mapping[str, Sequence[str]] = field(default_factory=dict)
    since: int | None = None
    until: int | None = None
    expires_before: int | None = None
    not_expired_at: int | None = None
    limit: int | None = None
    search: Sequence[str] | None = None
    phrases: Sequence[str] = ()
    not_search: Sequence[str] = ()
    observer: str | None = None
    ranking: str | None = None
    min_rank: float | None = None
    include_spam: bool = False

    def empty(self) -> bool:
        """Proof, before anything is read, that no row can match."""
        if self.limit is not None and self.limit <= 0:
            return True
        if any(v is not None and not hex_list(v) for v in (self.ids, self.authors, self.owners)) or (self.kinds is not None and not self.kinds):
            return True
        for name, values in {**self.tags}.items():
            if not re.fullmatch("[A-Za-z]", name) or not [v for v in values if not CONTROL.search(v)]:
                return True
        for name, values in {**self.tags_all}.items():
            if not re.fullmatch("[A-Za-z]", name) or not values or any(CONTROL.search(v) for v in values):
                return True
        spoken = [w for w in self.search or () if any(c.isalnum() for c in w)]
        return bool(self.search) and not spoken or any(not any(c.isalnum() for c in p) for p in self.phrases)

    @property
    def searching(self) -> bool:
        return bool(self.search) or bool(self.phrases)

    def profile(self) -> str:
        """Which order answers the query: an explicit ranking, else recency without text, else text with or without trust."""
        if self.ranking:
            return self.ranking
        if not self.searching:
            return "recency"
        return "search" if self.observer and HEX64.fullmatch(self.observer) else "text"
