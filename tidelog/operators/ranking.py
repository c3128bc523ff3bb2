"""Scored projections: tiers of match quality, BM25 inside a tier, and the trust multiplier.

Weights are fixed values of the ranking; the score is a sum of rungs so far apart that tiers never mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.query import EventQuery
from ..schema import SEARCH_FIELDS
from .matching import FUZZY_FIELDS, GRAM_FIELDS_NAME, GRAM_FIELDS_TEXT, any_of, body_phrase, fuzzy_in, grams_in, in_field, prefix_in, spoken, trigrams

#: Fixed values.
WEIGHTS = {
    "name_tier": 130_000.0, "near_tier": 23_000.0, "weak_tier": 4_000.0, "affil_tier": 550.0, "near_tier_text": 700.0, "weak_tier_text": 620.0, "token_text": 1_100.0,
    "gram_cap": 80.0, "about": 0.1, "secondary": 0.4, "content": 0.15, "location": 0.3, "identity": 50.0, "proximity": 30.0, "words_pop": 3_000.0, "exactness_pop": 6_000.0,
    "perfect_pop": 80_000.0, "gram": 2.0, "gram_short": 8.0, "order_floor": 0.5, "cutoff": 100.0, "wot": 1.0, "wot_pow": 2.7, "followers": 100_000.0,
}
POP_TIERS = {"name": 1e9, "near": 1e8, "weak": 3e7, "affiliation": 1e7, "body": 1e7}
K1, B = 1.2, 0.75
RERANK = 1_000
DROP = 0.5


def score_columns(reputation: DataFrame | None, observer: str | None, events: DataFrame) -> DataFrame:
    """events with user_score and verified_followers of the author as the observer sees it; unknown authors have 0.

    One observer's slice is joined by author; Spark broadcasts it where its measured size allows.
    """
    if reputation is None or observer is None:
        return events.withColumns({"user_score": F.lit(0.0), "verified_followers": F.lit(0.0)})
    mine = reputation.where(F.col("observer") == observer).select(F.col("subject").alias("_s"), F.col("influence").alias("_i"), F.col("followers").alias("_f"))
    out = events.join(mine, events["pubkey"] == F.col("_s"), "left")
    return out.withColumns({"user_score": F.coalesce(F.col("_i").cast("double"), F.lit(0.0)), "verified_followers": F.coalesce(F.col("_f").cast("double"), F.lit(0.0))}).drop("_s", "_i", "_f")


def match_count(field: str, terms: list[str]) -> Column:
    return sum((in_field(field, w).cast("int") for w in terms), F.lit(0))


def field_columns(terms: list[str]) -> dict[str, Column]:
    """For each field how many of the words it has (h_) and its number of words (n_): what all terms below are made of."""
    return {f"h_{f}": match_count(f, terms) for f in SEARCH_FIELDS} | {f"n_{f}": length_of(f) if terms else F.lit(0) for f in SEARCH_FIELDS}


def hits(field: str) -> Column:
    return F.col(f"_m.h_{field}")


def tier_columns(terms: list[str]) -> dict[str, Column]:
    """Mutually exclusive tiers, best first, and whether any word matches as a whole."""
    hit = lambda f: hits(f) > 0
    near = lambda f: any_of([prefix_in(f, w) for w in terms] + ([fuzzy_in(f, w) for w in terms] if f in FUZZY_FIELDS else []))
    name = hit("name") | hit("display_name")
    token = name | hit("search_primary")
    loose = (~name & near("name_near")) | (~hit("search_primary") & near("search_primary_near"))
    infix = any_of([grams_in(f, w, 2) for f in GRAM_FIELDS_NAME for w in terms])
    identity = hit("nip05") | hit("lud16")
    direct = hit("about") | hit("website")
    weak = infix | hit("search_secondary") | near("search_secondary_tokens") | (~direct & near("affil_tokens")) | identity
    body = hit("search_text") | hit("search_location") | any_of([body_phrase(w) for w in terms])
    return {"name": token, "loose": loose, "weak": weak, "identity": identity, "direct": direct, "body": body, "real": any_of([hit(f) for f in SEARCH_FIELDS])}


def exclusive() -> dict[str, Column]:
    """The tiers below the first, of the columns of tier_columns()."""
    token, loose, weak = F.col("_t.name"), F.col("_t.loose"), F.col("_t.weak")
    rest = ~token & ~loose & ~weak
    return {"near": ~token & loose, "weak": ~token & ~loose & weak, "affiliation": rest & F.col("_t.direct"), "body": rest & F.col("_t.body")}


def tier_label() -> Column:
    """name, near, identity, weak, affiliation, body; else floor for a whole-word match, gram for the rest."""
    c = F.when(F.col("_t.name"), "name").when(F.col("_u.near"), "near").when(F.col("_t.identity"), "identity").when(F.col("_u.weak"), "weak")
    return c.when(F.col("_u.affiliation"), "affiliation").when(F.col("_u.body"), "body").when(F.col("_t.real"), "floor").otherwise("gram")


@dataclass(frozen=True)
class Stats:
    """Corpus statistics of BM25 for the words of a query: rows with text and mean length of each field, and rows with each
    word; the same for trigrams, whose fields are named `field_gram`."""

    rows: dict[str, int]
    length: dict[str, float]
    df: dict[tuple[str, str], int]


def length_of(field: str) -> Column:
    c = F.col(f"folded.{field}")
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) - 1)


def grams_of(field: str, terms: list[str]) -> list[str]:
    """Trigrams by which the words of a query look into a field: from two of a word on in names, from three on in texts."""
    least = 2 if field in GRAM_FIELDS_NAME else 3
    return list(dict.fromkeys(g for w in terms if len(trigrams(w)) >= least for g in trigrams(w)))


def gram_length(field: str) -> Column:
    return F.greatest(F.coalesce(F.length(F.col(field)), F.lit(0)) - 2, F.lit(0))


def statistics(events: DataFrame, terms: list[str]) -> Stats:
    """One aggregation over the whole corpus; a few numbers for each field, word and trigram."""
    pairs = [(f, w) for f in SEARCH_FIELDS for w in terms]
    grams = [(f, g) for f in (*GRAM_FIELDS_NAME, *GRAM_FIELDS_TEXT) for g in grams_of(f, terms)]
    lengths = {f: length_of(f) for f in SEARCH_FIELDS} | {f"{f}_gram": gram_length(f) for f in dict.fromkeys(f for f, _ in grams)}
    aggregates = [F.count(F.when(n > 0, 1)).alias(f"n{i}") for i, n in enumerate(lengths.values())]
    aggregates += [F.avg(F.when(n > 0, n)).alias(f"l{i}") for i, n in enumerate(lengths.values())]
    aggregates += [F.count(F.when(in_field(f, w), 1)).alias(f"d{i}") for i, (f, w) in enumerate(pairs)]
    aggregates += [F.count(F.when(F.contains(F.lower(f), F.lit(g)), 1)).alias(f"g{i}") for i, (f, g) in enumerate(grams)]
    r = events.agg(*aggregates).first()
    df = {p: r[f"d{i}"] for i, p in enumerate(pairs)} | {(f"{f}_gram", g): r[f"g{i}"] for i, (f, g) in enumerate(grams)}
    return Stats({f: r[f"n{i}"] for i, f in enumerate(lengths)}, {f: r[f"l{i}"] or 1.0 for i, f in enumerate(lengths)}, df)


def _term(tf: Column, n: Column, field: str, df: int, s: Stats) -> Column:
    idf = math.log(1 + (s.rows[field] - df + 0.5) / (df + 0.5))
    return F.coalesce(F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / s.length[field])), F.lit(0.0))


def bm25(field: str, terms: list[str], s: Stats) -> Column:
    text, total = F.col(f"folded.{field}"), F.lit(0.0)
    for w in terms:
        line = " ".join(words(w))
        if not line or not s.df[field, w]:
            continue
        # Words are framed by single spaces that neighbours share: doubling them lets every occurrence be counted.
        doubled = F.replace(text, F.lit(" "), F.lit("  "))
        frame = f" {line.replace(' ', '  ')} "
        total = total + _term((F.length(doubled) - F.length(F.replace(doubled, F.lit(frame), F.lit("")))) / len(frame), length_of(field), field, s.df[field, w], s)
    return total


def gram_text(field: str, terms: list[str], s: Stats) -> Column:
    """BM25 of the query's trigrams in a field, weighed (more where a word is too short for typos) and capped, so that it
    only orders what matches inside a tier."""
    low, total = F.lower(F.col(field)), F.lit(0.0)
    for g in grams_of(field, terms):
        if df := s.df[f"{field}_gram", g]:
            total = total + _term((F.length(low) - F.length(F.replace(low, F.lit(g), F.lit("")))) / 3, gram_length(field), f"{field}_gram", df, s)
    weight = WEIGHTS["gram_short" if min(map(len, terms), default=4) <= 3 else "gram"]
    return F.least(weight * total, F.lit(WEIGHTS["gram_cap"]))


def proximity(terms: list[str]) -> Column:
    """The share of the query's neighbouring words that are neighbours in a name-like field, of the best one; with one word,
    whether it is there."""
    pairs = [f"{a} {b}" for a, b in zip(terms[:-1], terms[1:], strict=True)] or terms
    return F.greatest(*[match_count(f, pairs) for f in GRAM_FIELDS_NAME], F.lit(0)) / max(1, len(pairs))


def text_columns(terms: list[str], s: Stats) -> dict[str, Column]:
    """BM25 of each field (b_), with the trigrams' part (g_) where it has one."""
    return {f"b_{f}": bm25(f, terms, s) for f in SEARCH_FIELDS} | {f"g_{f}": gram_text(f, terms, s) for f in (*GRAM_FIELDS_NAME, *GRAM_FIELDS_TEXT)}


def _names() -> Column:
    def text(f: str) -> Column:
        n = F.col(f"_m.n_{f}")
        return 100 * hits(f) + F.when(n > 0, F.col(f"_x.b_{f}") * F.pow(F.greatest(n, F.lit(1)).cast("double"), F.lit(-1.5))).otherwise(0.0) + F.col(f"_x.g_{f}")

    return F.greatest(text("name"), text("display_name")) + text("search_primary")


def _others() -> Column:
    """Secondary, body and location; what a profile says of itself only where nothing better matched."""
    w, b = WEIGHTS, lambda f: F.col(f"_x.b_{f}")
    quiet = F.when(F.col("_t.name") | F.col("_u.near") | F.col("_u.weak"), 0.0).otherwise(w["about"])
    return w["secondary"] * (b("search_secondary") + F.col("_x.g_search_secondary")) + w["content"] * b("search_text") + w["location"] * b("search_location") + quiet * (b("about") + F.col("_x.g_about"))


def relevance(terms: list[str]) -> Column:
    w = WEIGHTS
    num = lambda c: F.col(c).cast("double")
    tiers = num("_t.name") * w["token_text"] + num("_u.near") * w["near_tier_text"] + num("_u.weak") * w["weak_tier_text"] + F.greatest(num("_u.affiliation"), num("_u.body")) * w["affil_tier"]
    return tiers + _names() + w["proximity"] * proximity(terms) + _others()


def text_score() -> Column:
    w = WEIGHTS
    num = lambda c: F.col(c).cast("double")
    total = num("_t.name") * w["name_tier"] + num("_u.near") * w["near_tier"] + num("_u.weak") * w["weak_tier"] + F.greatest(num("_u.affiliation"), num("_u.body")) * w["affil_tier"] + _names()
    return total + w["identity"] * (F.col("_x.b_nip05") + F.col("_x.b_lud16")) + _others()


def floored(total: Column) -> Column:
    """A whole-word match never scores below the cutoff; anything else below it is nothing."""
    cutoff = WEIGHTS["cutoff"]
    return F.when(F.col("_t.real"), F.greatest(total, F.lit(cutoff))).when(total < cutoff, 0.0).otherwise(total)


def precision(terms: list[str]) -> Column:
    """How much of the query a name-like field covers, how much of the field the query covers, and both in order."""
    n, line = max(1, len(terms)), " ".join(x for w in terms for x in words(w))
    parts = []
    for f in ("name", "display_name", "search_primary"):
        own, size = hits(f), F.col(f"_m.n_{f}")
        field_share = F.when(size > 0, F.least(own / F.greatest(size, F.lit(1)), F.lit(1.0))).otherwise(0.0)
        order = F.when(F.contains(F.col(f"folded.{f}"), F.lit(f" {line} ")), 1.0).otherwise(WEIGHTS["order_floor"]) if n > 1 else F.lit(1.0)
        parts.append((own / n, field_share, F.least(own / n, F.lit(1.0)) * field_share * F.coalesce(order, F.lit(WEIGHTS["order_floor"]))))
    best = [F.greatest(*[F.coalesce(p[i], F.lit(0.0)) for p in parts]) for i in range(3)]
    return WEIGHTS["words_pop"] * best[0] + WEIGHTS["exactness_pop"] * best[1] + WEIGHTS["perfect_pop"] * best[2]


def trust_multiplier(floor: float) -> Column:
    over = F.least(F.greatest(F.col("user_score") - floor, F.lit(0.0)), F.lit(100.0))
    return F.when(F.col("user_score") < floor, 0.0).otherwise(1 + WEIGHTS["wot"] * F.pow(over, F.lit(WEIGHTS["wot_pow"])))


def population_tier() -> Column:
    c = F.when(F.col("_t.name"), POP_TIERS["name"]).when(F.col("_u.near"), POP_TIERS["near"]).when(F.col("_u.weak"), POP_TIERS["weak"])
    return c.when(F.col("_u.affiliation"), POP_TIERS["affiliation"]).when(F.col("_u.body"), POP_TIERS["body"]).otherwise(0.0)


def scored(rows: DataFrame, corpus: DataFrame, q: EventQuery, reputation: DataFrame | None = None) -> DataFrame:
    """rows (already matched) with score and tier, below-floor and dropped rows gone; not yet ordered.

    The text profile with an observer works in two steps: all rows by text times trust, then the best RERANK get their
    precision added; it is never negative, so that the others, which keep their scores, follow them.
    """
    floor = q.min_rank if q.min_rank is not None else -1e9
    profile, terms = q.profile(), spoken(q.search) + spoken(q.phrases)
    rows = score_columns(reputation, q.observer, rows)
    if profile in ("recency", "recency_gated"):
        kept = rows.where(F.col("user_score") >= floor) if profile == "recency_gated" else rows
        return kept.withColumns({"score": F.col("created_at").cast("double"), "tier": F.lit(None).cast("string")})
    # Each step is one struct: computed once, short in the generated code, and few names for the optimizer to follow.
    rows = _step(_step(_step(rows, "_m", field_columns(terms)), "_t", tier_columns(terms)), "_u", exclusive())
    tier = tier_label() if terms else F.lit(None).cast("string")
    if profile in ("rank_desc", "rank_asc", "sort_followers"):
        key = {"rank_desc": F.col("user_score"), "rank_asc": -F.col("user_score"), "sort_followers": WEIGHTS["followers"] * F.log1p(F.greatest(F.col("verified_followers"), F.lit(0.0)))}[profile]
        return _plain(rows.where(F.col("user_score") >= floor).withColumns({"score": population_tier() + key, "tier": tier}))
    rows = _step(rows, "_x", text_columns(terms, statistics(corpus, terms)))
    if profile == "text":
        kept = rows.where(F.col("user_score") >= floor) if q.observer and q.min_rank is not None else rows
        return _plain(kept.withColumns({"score": relevance(terms), "tier": tier}))
    # The row number keeps the optimizer from copying the long expressions into the filter, once for each use.
    rows = rows.withColumns({"_total": text_score(), "_row": F.monotonically_increasing_id()}).withColumns({"score": floored(F.col("_total")) * trust_multiplier(floor), "tier": tier})
    first = rows.where((F.col("score") > DROP) & (F.col("_row") >= 0))
    best = first.orderBy(F.desc("score"), F.desc("created_at"), "id").limit(RERANK)
    rest = first.join(best.select("id"), "id", "left_anti")
    return _plain(best.withColumn("score", F.col("score") + precision(terms) * trust_multiplier(floor))).unionByName(_plain(rest))


def _step(rows: DataFrame, name: str, columns: dict[str, Column]) -> DataFrame:
    return rows.withColumn(name, F.struct(*[c.alias(n) for n, c in columns.items()]))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])
