"""Folding, tokens and near columns. Python runs in Arrow batches, and only at ingest."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NEAR_FIELDS, SEARCH_FIELDS

MAX_ELEMENT, MAX_ELEMENTS, MAX_MERGED, MAX_CJK = 64, 48, 96, 8
#: The blocks of the scripts whose words are written without spaces.
CJK = re.compile("[ᄀ-ᇿ⺀-⿟々〇〡-〩〸-〻ぁ-ゟァ-ヿ㄰-㆏ㇰ-ㇿ㐀-䶿一-鿿ꥠ-꥿가-퟿豈-﫿ｦ-ﾟ\U00020000-\U0003134f]+")
ALNUM = re.compile(r"[^\W_]+")
BOUNDARY = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


class _Marks(dict):
    """For str.translate: marks go, all else stays; filled as characters are met."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.category(chr(c)) == "Mn" else c
        return self[c]


_MARKS = _Marks()


def _strip(s: str, form: str) -> str:
    return s.lower() if s.isascii() else unicodedata.normalize(form, s).translate(_MARKS).lower()


def fold(s: str) -> str:
    """Compatibility decomposition without marks, lower-cased."""
    return _strip(s, "NFKD")


def fold_accents(s: str) -> str:
    """Canonical decomposition without marks, lower-cased; full-width forms stay."""
    return _strip(s, "NFD")


def words(s: str | None) -> list[str]:
    """Maximal runs of letters and digits of the folded text."""
    return ALNUM.findall(fold(s)) if s else []


def _cut_camel(run: str) -> list[str]:
    if run.isascii():
        return BOUNDARY.split(run)
    edges = [0]
    for i in range(1, len(run)):
        up, before = run[i].isupper(), run[i - 1]
        if up and (before.islower() or before.isdigit() or (before.isupper() and run[i + 1 : i + 2].islower())):
            edges.append(i)
    return [run[a:z] for a, z in zip(edges, [*edges[1:], len(run)], strict=True)]


def _suffixes(part: str) -> list[str]:
    return [part[i:] for i in range(len(part))] if part and len(part) <= MAX_CJK and CJK.fullmatch(part) else [part]


def _cap(items, most: int = MAX_ELEMENTS) -> list[str]:
    kept: dict[str, None] = {}
    for item in items:
        e = fold(item)
        if e and len(e) <= MAX_ELEMENT:
            kept[e] = None
            if len(kept) == most:
                break
    return list(kept)


def parts(s: str | None) -> list[str]:
    """Pieces at separators and case changes, with suffixes of short CJK runs."""
    return _cap(x for run in ALNUM.findall(s or "") for piece in _cut_camel(run) for x in _suffixes(piece))


def tokens(s: str | None) -> list[str]:
    """Whitespace tokens, each also without its signs and with its CJK suffixes, and at last all of them as one."""
    raw = (s or "").split()

    def every():
        for t in raw:
            yield t
            plain = "".join(ALNUM.findall(t))
            if plain and plain != t:
                yield plain
            yield from _suffixes(t)[1:]
        if len(raw) > 1:
            yield "".join(ALNUM.findall("".join(raw)))

    return _cap(every())


def merge_near(first: list[str], second: list[str], most: int = MAX_MERGED) -> list[str]:
    return _cap([*first, *second], most)


FOLDED = T.StructType([T.StructField(f, T.StringType()) for f in (*SEARCH_FIELDS, "body")])
NEAR = T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in NEAR_FIELDS])


@F.pandas_udf(FOLDED)
def _folded(fields: pd.DataFrame) -> pd.DataFrame:
    line = lambda s: f" {' '.join(words(s))} " if s else ""
    out = pd.DataFrame({f: fields[f].map(line) for f in SEARCH_FIELDS})
    out["body"] = fields["search_text"].map(lambda s: fold_accents(s) if s else "")
    return out


@F.pandas_udf(NEAR)
def _near(f: pd.DataFrame) -> pd.DataFrame:
    get = lambda c: [x if isinstance(x, str) else None for x in f[c]]
    both = lambda *cols: [" ".join(x for x in row if x) for row in zip(*map(get, cols), strict=True)]
    return pd.DataFrame(
        {
            "name_near": [merge_near(parts(s), tokens(s)) for s in both("name", "display_name")],
            "search_primary_near": [merge_near(parts(s), tokens(s)) for s in get("search_primary")],
            "search_secondary_tokens": [tokens(s) for s in get("search_secondary")],
            "affil_tokens": [parts(s) for s in both("nip05", "lud16", "website", "about")],
        }
    )


def index_text(events: DataFrame) -> DataFrame:
    """events with `folded` (space-framed folded words of every search column, and the accent-folded body) and `near`."""
    fields = F.struct(*SEARCH_FIELDS)
    return events.withColumns({"folded": _folded(fields), "near": _near(fields)})
