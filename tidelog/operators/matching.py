"""Text matching over ingest-time folded columns: whole words, prefixes, typos, substrings, phrases, exclusions.

All tests are JVM-side. `events` needs the columns of functions.text.index_text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, fold_accents, words
from ..schema import NEAR_FIELDS, SEARCH_FIELDS

GRAM_FIELDS_NAME = ("name", "display_name", "search_primary")
GRAM_FIELDS_TEXT = ("about", "search_secondary")
FUZZY_FIELDS = ("name_near", "search_primary_near")


def any_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def all_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def in_field(field: str, word: str) -> Column:
    """The folded words of `word` stand next to each other in the field."""
    line = " ".join(words(word))
    return F.coalesce(F.contains(F.col(f"folded.{field}"), F.lit(f" {line} ")), F.lit(False)) if line else F.lit(False)


def exact(word: str, fields=SEARCH_FIELDS) -> Column:
    return any_of([in_field(f, word) for f in fields])


def prefix_in(field: str, word: str) -> Column:
    w = fold(word)
    if len(w) < (3 if w.isascii() else 2):
        return F.lit(False)
    return F.coalesce(F.exists(f"near.{field}", lambda x: F.startswith(x, F.lit(w))), F.lit(False))


def edits(word: str) -> int:
    n = len(word)
    return 3 if n >= 13 else 2 if n >= 9 else 1 if n >= 4 else 0


def fuzzy_in(field: str, word: str) -> Column:
    """Within 1, 2 or 3 edits (from 4, 9 and 13 letters on); the first two letters are as typed."""
    w = fold(word)
    k = edits(w)
    if not k:
        return F.lit(False)
    close = lambda x: F.startswith(x, F.lit(w[:2])) & (F.abs(F.length(x) - len(w)) <= k) & (F.levenshtein(x, F.lit(w), k) >= 0)
    return F.coalesce(F.exists(f"near.{field}", close), F.lit(False))


def trigrams(word: str) -> list[str]:
    w = word.lower()
    return [g for g in dict.fromkeys(w[i : i + 3] for i in range(len(w) - 2)) if g.isalnum()]


def grams_in(field: str, word: str, least: int) -> Column:
    """Every trigram of the word inside words of the field (lower case, accents kept).

    The trigrams are letters and digits only, so one that the text contains lies inside one of its words.
    """
    grams = trigrams(word)
    if len(grams) < least:
        return F.lit(False)
    low = F.lower(F.col(field))
    return F.coalesce(all_of([F.contains(low, F.lit(g)) for g in grams]), F.lit(False))


def body_phrase(word: str) -> Column:
    """The accent-folded word inside one whitespace token of the body; from four letters and digits on."""
    w = fold_accents(word)
    if len(w) < 4 or not w.isalnum():
        return F.lit(False)
    return F.coalesce(F.contains(F.col("folded.body"), F.lit(w)), F.lit(False))


def word_group(word: str, synthetic: bool = False) -> Column:
    """Any way to match one word; words that stand for several (synthetic) only match whole or as a prefix."""
    ways = [exact(word)] + [prefix_in(f, word) for f in NEAR_FIELDS]
    if not synthetic:
        ways += [fuzzy_in(f, word) for f in FUZZY_FIELDS]
        ways += [grams_in(f, word, 2) for f in GRAM_FIELDS_NAME] + [grams_in(f, word, 3) for f in GRAM_FIELDS_TEXT] + [body_phrase(word)]
    return any_of(ways)


def spoken(terms) -> list[str]:
    return [w for w in terms or () if any(c.isalnum() for c in w)]


def matches(search, phrases=(), not_search=()) -> Column:
    """All words (adjacent pairs of three and more words, or all of them run together, may stand for them), all phrases,
    and none of the exclusions; rows without search columns are never excluded."""
    terms = spoken(search)
    out: list[Column] = []
    if terms:
        groups = [word_group(w) for w in terms]
        each = []
        for i, g in enumerate(groups):
            ways = [g]
            if len(terms) >= 3:
                ways += [word_group(terms[j] + terms[j + 1], True) for j in (i - 1, i) if 0 <= j < len(terms) - 1]
            each.append(any_of(ways))
        whole = all_of(each)
        out.append(whole | word_group("".join(terms), True) if len(terms) >= 2 else whole)
    out += [exact(p) for p in phrases]
    out += [~exact(x) for x in not_search]
    return all_of(out)


def loosely(search) -> Column:
    """Every word is a part of some search column, in any case: a plain test beside matches(), not what search serves."""
    low = [F.coalesce(F.lower(F.col(f)), F.lit("")) for f in SEARCH_FIELDS]
    return all_of([any_of([F.contains(f, F.lit(w.lower())) for f in low]) for w in search])
