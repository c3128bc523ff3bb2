"""The search string: words, "phrases", -exclusions and key:value extensions."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .query import HEX64, EventQuery

DEFAULT_FLOOR, SPAM_FLOOR = 2.0, 0.0
SORTS = {"rank": "rank_desc", "rank:desc": "rank_desc", "rank:asc": "rank_asc", "followers": "sort_followers", "text": "text", "recent": "recency_gated"}
TOKEN = re.compile(r'(-*)"([^"]*)(?:"|\Z)|(\S+?)(?=\s|"|\Z)')
EXTENSION = re.compile(r"([a-z]+):(?!//)(.*)", re.S)


@dataclass(frozen=True)
class Parsed:
    words: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    sort: str | None = None
    floor: float | None = None
    observer: str | None = None
    include_spam: bool = False


def _speaks(s: str) -> bool:
    return any(c.isalnum() for c in s)


def _floor(value: str) -> float | None:
    m = re.fullmatch(r"rank:(gte|gt):([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", value)
    return float(m[2]) + (m[1] == "gt") if m else None


def parse(text: str | None) -> Parsed:
    """Quotes first, then extensions, then leading minus signs."""
    words, phrases, excluded, found = [], [], [], {}
    for m in TOKEN.finditer(text or ""):
        if m[3] is None:
            phrase = m[2].strip()
            if m[1]:
                excluded += [phrase] if _speaks(phrase) else []
            elif phrase:
                phrases.append(phrase)
            continue
        word = m[3]
        if ext := EXTENSION.fullmatch(word):
            found.setdefault(ext[1], []).append(ext[2])
        elif word.startswith("-") and word.strip("-"):
            excluded += [word.lstrip("-")] if _speaks(word) else []
        else:
            words.append(word)
    sorts = [SORTS[v] for v in found.get("sort", ()) if v in SORTS]
    floors = [f for f in map(_floor, found.get("filter", ())) if f is not None]
    observers = [v.lower() for v in found.get("observer", ()) if HEX64.fullmatch(v.lower())]
    return Parsed(tuple(words), tuple(phrases), tuple(excluded), sorts[0] if sorts else None, floors[0] if floors else None, observers[0] if observers else None, "spam" in found.get("include", ()))


def apply(query: EventQuery, text: str | None, *, observer: str | None = None, now: int | None = None) -> EventQuery:
    """query with what the search string asks for, the context's observer where the string names none, and the gate.

    Without words the string constrains nothing. A ranked query has a trust floor: the one asked for, else 0 with
    include:spam, else 2. With an observer but neither words nor sort, a floor makes a gated feed in order of time;
    sort:recent without an observer and words is a plain query.
    """
    p = parse(text)
    ranked = bool(p.words or p.phrases or p.sort)
    floor = p.floor if p.floor is not None else ((SPAM_FLOOR if p.include_spam else DEFAULT_FLOOR) if ranked else None)
    who = p.observer or (observer.lower() if observer and HEX64.fullmatch(observer.lower()) else None)
    out = replace(query, search=p.words or None, phrases=p.phrases, not_search=p.excluded, observer=who, ranking=p.sort, min_rank=floor, include_spam=p.include_spam, not_expired_at=now if now is not None else query.not_expired_at)
    if who and not ranked:
        gate = p.floor if p.floor is not None else None if p.include_spam else DEFAULT_FLOOR
        return replace(out, ranking="recency_gated", min_rank=gate) if gate is not None else out
    if out.ranking == "recency_gated" and not who and not out.searching:
        return replace(out, ranking=None, min_rank=None)
    return out
