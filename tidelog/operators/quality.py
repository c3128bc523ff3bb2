"""How far two rankings of the same request agree, so that a change of the ranking can be measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(ranked: DataFrame, order: list[Column], most: int) -> DataFrame:
    """id, place (from 1) of the first `most` rows; a bounded list, so that one task may number it."""
    top = ranked.orderBy(*order).limit(most)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


def agreement(base: DataFrame, other: DataFrame, cuts: tuple[int, ...] = (10, 50)) -> DataFrame:
    """One row: overlap_K (share of the first K ids of `base` that are among the first K of `other`) for each cut, and
    kendall.

    base, other: bounded (id, place) lists as places() makes them. kendall: over pairs of ids that both lists have, those in
    the same order less those in the other one, by their number; 1 where there is no pair. An empty base agrees.
    """
    both = base.withColumnRenamed("place", "a").join(other.withColumnRenamed("place", "b"), "id", "left")
    shares = []
    for k in cuts:
        first, shared = F.count(F.when(F.col("a") <= k, 1)), F.count(F.when((F.col("a") <= k) & (F.col("b") <= k), 1))
        shares.append(F.when(first > 0, shared / F.greatest(first, F.lit(1))).otherwise(1.0).alias(f"overlap_{k}"))
    rows = both.agg(*shares, F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b"))).alias("l"))
    sign = lambda x: F.transform(F.filter("l", lambda y: y["a"] > x["a"]), lambda y: F.when(y["b"] > x["b"], 1.0).otherwise(-1.0))
    signs = F.flatten(F.transform("l", sign))
    mean = F.aggregate(signs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(signs), F.lit(1))
    return rows.select(*[f"overlap_{k}" for k in cuts], F.when(F.size(signs) > 0, mean).otherwise(1.0).alias("kendall"))
